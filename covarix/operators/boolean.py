"""Boolean K-maps of column pairs, their minimisation, and the rules read from it.

Cells are 10-bit numbers: five bits of the first column's code, five of the
second's. A map has an on-set and don't-cares; the rest is off. Minimisation is
Quine-McCluskey on bit-packed implicants in one small kernel per pair.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import letter_of, rounded, valid
from ..shared import checkpointed
from .pairs import PAIR, with_refs

BITS = 10
RULE_KEY = ["pos_i", "pos_j", "code_i", "code_j"]


def mutation_map(pc: DataFrame, counts: DataFrame) -> DataFrame:
    """Observed valid cells: ``state`` 1 for a mutation, -1 for the reference pair; all others are 0."""
    v = with_refs(pc.where(valid(F.col("code_i")) & valid(F.col("code_j"))), counts)
    ref = (F.col("code_i") == F.col("ref_i")) & (F.col("code_j") == F.col("ref_j"))
    return v.select(*RULE_KEY, "ref_i", "ref_j", "n", F.when(ref, -1).otherwise(1).alias("state"))


def forbidden_map(pc: DataFrame, counts: DataFrame) -> DataFrame:
    """The flipped map: pairs of codes that never occur together, of all 400."""
    seen = mutation_map(pc, counts)
    grid = seen.select(*PAIR, "ref_i", "ref_j").distinct()
    for c in ("code_i", "code_j"):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(19))))
    ref = (F.col("code_i") == F.col("ref_i")) & (F.col("code_j") == F.col("ref_j"))
    return grid.join(seen.select(*RULE_KEY), RULE_KEY, "left_anti").where(~ref)


def on_set(cells: DataFrame, value: str, share: float = 0.7) -> DataFrame:
    """``(pos_i, pos_j, code_i, code_j, value, threshold, state)``: each pair's cells at or above the exact percentile of its non-zero cells."""
    v = cells.where(valid(F.col("code_i")) & valid(F.col("code_j"))).select(*RULE_KEY, F.col(value).alias("value"))
    cut = v.where("value <> 0").groupBy(*PAIR).agg(F.percentile("value", F.lit(share)).alias("threshold"))
    return v.join(cut, PAIR).where("value >= threshold and value <> 0").select(*RULE_KEY, "value", rounded(F.col("threshold"), 9).alias("threshold"), F.lit(1).alias("state"))


def check_size(n_cells: int) -> int:
    """The number of variables of a square map; raises unless the cells are a power of 4."""
    bits = n_cells.bit_length() - 1
    if n_cells < 4 or n_cells != 1 << bits or bits % 2:
        raise ValueError(f"{n_cells} cells are no power of 4")
    return bits


def prime_implicants(on: Iterable[int], dont_care: Iterable[int] = (), bits: int = BITS) -> list[tuple[int, int]]:
    """All prime implicants ``(values, mask)`` that cover an on-cell; masked bits are free."""
    on = set(on)
    # for each mask, the values of its implicants as one wide bit set
    at: dict[int, int] = {0: 0}
    for c in on | set(dont_care):
        at[0] |= 1 << c
    clear = [sum(1 << v for v in range(1 << bits) if not v >> b & 1) for b in range(bits)]
    primes = []
    for mask in sorted(range(1 << bits), key=int.bit_count):
        if not (here := at.pop(mask, 0)):
            continue
        merged = 0
        for b in range(bits):
            if not mask >> b & 1 and (low := here & here >> (1 << b) & clear[b]):
                merged |= low | low << (1 << b)
                at[mask | 1 << b] = at.get(mask | 1 << b, 0) | low
        left = here & ~merged
        while left:
            v = (left & -left).bit_length() - 1
            left &= left - 1
            if any((c ^ v) & ~mask == 0 for c in on):
                primes.append((v, mask))
    return sorted(primes)


def minimise(on: Iterable[int], dont_care: Iterable[int] = (), bits: int = BITS) -> list[dict]:
    """Prime implicants with what they cover, whether they are core-essential, and a greedy cover."""
    on = sorted(set(on))
    primes = prime_implicants(on, dont_care, bits)
    covers = [[c for c in on if (c ^ v) & ~m == 0] for v, m in primes]
    owners: dict[int, list[int]] = {c: [] for c in on}
    for k, cells in enumerate(covers):
        for c in cells:
            owners[c].append(k)
    core = {ks[0] for ks in owners.values() if len(ks) == 1}
    cover, left = set(core), set(on) - {c for k in core for c in covers[k]}
    while left:
        best = max(range(len(primes)), key=lambda k: (len(left.intersection(covers[k])), -k))
        cover.add(best)
        left -= set(covers[best])
    return [
        {"values": v, "mask": m, "n_dontcares": m.bit_count(), "coverage": covers[k], "is_core_essential": k in core, "in_cover": k in cover}
        for k, (v, m) in enumerate(primes)
    ]


def map_differences(maps: DataFrame) -> DataFrame:
    """``(map_a, map_b, n)``: cells on which two maps ``(map_id, cell, state)`` differ, among those both define (state not -1)."""
    known = maps.where("state <> -1")
    a, b = known.toDF("map_a", "cell", "a"), known.toDF("map_b", "cell", "b")
    return a.join(b, "cell").where("map_a < map_b").groupBy("map_a", "map_b").agg(F.count_if(F.col("a") != F.col("b")).alias("n"))


def implicants(maps: DataFrame, padding: bool = True) -> DataFrame:
    """Implicants of each pair's map ``(pos_i, pos_j, code_i, code_j, state)``.

    Cells of codes 20 to 31 are don't-cares if ``padding``; so is the reference (state -1).
    A pair has at most 400 rows, so a group is small.
    """
    check_size(32 * 32)

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        cell = g["code_i"] * 32 + g["code_j"]
        free = {i * 32 + j for i in range(32) for j in range(32) if i > 19 or j > 19} if padding else set()
        found = minimise(cell[g["state"] == 1], free | set(cell[g["state"] == -1]))
        out = pd.DataFrame(found, columns=["values", "mask", "n_dontcares", "coverage", "is_core_essential", "in_cover"])
        out.insert(0, "pos_j", g["pos_j"].iloc[0])
        out.insert(0, "pos_i", g["pos_i"].iloc[0])
        return out

    schema = "pos_i int, pos_j int, values int, mask int, n_dontcares int, coverage array<int>, is_core_essential boolean, in_cover boolean"
    return maps.select(*(F.col(c).cast("int") for c in RULE_KEY), "state").groupBy(*PAIR).applyInPandas(kernel, schema)


def decode(df: DataFrame) -> DataFrame:
    """Adds the lowest corner's codes and letters; corners beyond code 19 are dropped."""
    corner = F.col("values").bitwiseAND(F.bitwise_not("mask"))
    out = df.withColumns({"code_i": F.shiftright(corner, 5), "code_j": corner.bitwiseAND(F.lit(31))})
    return out.where(valid(F.col("code_i")) & valid(F.col("code_j"))).withColumns({"aa_i": letter_of(F.col("code_i")), "aa_j": letter_of(F.col("code_j"))})


def expression(values: str = "values", mask: str = "mask") -> Column:
    """Text of an implicant: s4..s0 for the first column, t4..t0 for the second, ``~`` for a negation."""
    parts = []
    for k in range(BITS):
        b = BITS - 1 - k
        name = f"{'s' if k < 5 else 't'}{4 - k % 5}"
        fixed = F.shiftright(F.col(mask), b).bitwiseAND(F.lit(1)) == 0
        parts.append(F.when(fixed, F.when(F.shiftright(F.col(values), b).bitwiseAND(F.lit(1)) == 1, name).otherwise(f"~{name}")))
    return F.concat_ws(" ", *parts)


def found_implicants(pairs: DataFrame, maps: DataFrame, k: int = 15) -> DataFrame:
    """Decoded implicants of the k most informative pairs, with residues, references, MI and text."""
    head = checkpointed(pairs.orderBy(F.desc("mi"), *PAIR).limit(k).select(*PAIR, "mi", "ref_i", "ref_j"))
    found = decode(implicants(maps.join(F.broadcast(head.select(*PAIR)), PAIR, "left_semi")))
    return found.join(F.broadcast(head), PAIR).withColumn("expr", expression())


def rules(pairs: DataFrame, maps: DataFrame, k: int = 15) -> DataFrame:
    """Distinct rules of the k most informative pairs: residues, references, MI, coverage."""
    return distinct_rules(found_implicants(pairs, maps, k))


def inferences(found: DataFrame) -> DataFrame:
    """The inference list: one row per core-essential implicant, not per residue pair."""
    return found.where("is_core_essential").select("pos_i", "pos_j", "aa_i", "aa_j", "ref_i", "ref_j", "mi", "expr")


def distinct_rules(found: DataFrame) -> DataFrame:
    """One row a residue pair: essential if any of its implicants is, the least masked one's text."""
    first = F.struct("n_dontcares", "expr")
    return found.groupBy("pos_i", "pos_j", "code_i", "code_j", "aa_i", "aa_j", "ref_i", "ref_j", "mi").agg(F.bool_or("is_core_essential").alias("is_essential"), F.min(first)["expr"].alias("expr"), F.max(F.size("coverage")).cast("long").alias("n_covered"))


def rules_by_k(found: DataFrame) -> DataFrame:
    """Cumulative number of rules as more pairs, best first, are taken."""
    per = found.groupBy("pos_i", "pos_j", "mi").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("mi"), *PAIR)  # at most as many rows as pairs were taken
    return per.select(F.row_number().over(order).alias("k"), F.sum("n").over(order).alias("n_rules"))


def classify(p: DataFrame, positive: DataFrame, forbidden: DataFrame) -> DataFrame:
    """``(seq_id, verdict)``: forbidden if any forbidden pair occurs, else positive if any rule does, else unclassified.

    Rules are at most 441 cells a pair of columns; they become one small row of
    look-up tables and each sequence is judged in its own row, repeated ids too.
    """
    both = positive.select(*RULE_KEY).withColumn("kind", F.lit(1)).unionByName(forbidden.select(*RULE_KEY).withColumn("kind", F.lit(2)))
    cell = both.groupBy(*PAIR, (F.col("code_i") * 21 + F.col("code_j")).alias("cell")).agg(F.max("kind").alias("kind"))
    kinds = F.transform(F.sequence(F.lit(0), F.lit(440)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0)))
    place = cell.groupBy(*PAIR).agg(F.map_from_entries(F.collect_list(F.struct("cell", "kind"))).alias("m")).select(*PAIR, kinds.alias("kinds"))
    table = checkpointed(place.agg(F.collect_list(F.struct(*PAIR, "kinds")).alias("places")))
    at = lambda x: F.get("codes", x["pos_i"]) * 21 + F.get("codes", x["pos_j"])
    worst = F.aggregate("places", F.lit(0), lambda a, x: F.greatest(a, F.coalesce(F.get(x["kinds"], at(x)), F.lit(0))))
    judged = p.select("seq_id", "codes").crossJoin(F.broadcast(table)).select("seq_id", worst.alias("kind"))
    return judged.select("seq_id", F.when(F.col("kind") == 2, "forbidden").when(F.col("kind") == 1, "positive").otherwise("unclassified").alias("verdict"))


def either_way(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs in both orientations, so that membership stays an equi-join."""
    return pairs.unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), *(c for c in pairs.columns if c not in (a, b)))).distinct()
