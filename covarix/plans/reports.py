"""Summaries and reports of a profile table, from its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import BASE20, codes_of, gray, valid
from ..operators import boolean, columns, kmer, pairs, ranking
from ..shared import checkpointed
from ..sources.sinks import code_grid, markdown_table


def heat_map(mi: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Both halves of the MI matrix with a mark above 1 and two above 2, optionally of the columns low to high only."""
    if low is not None:
        mi = mi.where(F.col("pos_i") >= low).where(F.col("pos_j") >= low)
    if high is not None:
        mi = mi.where(F.col("pos_i") <= high).where(F.col("pos_j") <= high)
    mark = F.when(F.col("mi") > 2.0, "**").when(F.col("mi") > 1.0, "*").otherwise("")
    one = mi.select("pos_i", "pos_j", "mi", mark.alias("mark"))
    return one.unionByName(one.select(F.col("pos_j").alias("pos_i"), F.col("pos_i").alias("pos_j"), "mi", "mark"))


def summary(p: DataFrame, max_gap: int = 30, top: int = 20) -> DataFrame:
    """One row of nested results: entropies, mutations, pairs and neighbours, ready for ``write_json``."""
    pc, counts = pairs.base_counts(p, max_gap)
    e, mi = columns.column_entropy(counts), pairs.mutual_information(pc)

    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns)), asc=False).alias(name))

    heads = [
        e.agg(F.count_if(F.col("entropy") > 0.3).alias("n_variable"), F.count_if(F.col("entropy") <= 0.3).alias("n_conserved")),
        mi.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("mi") > 0.5).alias("n_high"), F.max("mi").alias("max_mi")),
        listed(e.orderBy(F.desc("entropy"), "pos").limit(top).select("entropy", "perplexity", "pos"), "top_columns"),
        listed(columns.mutations_by_position(counts).orderBy(F.desc("n_mutations"), "pos").limit(top).select("n_mutations", "pos"), "top_mutated"),
        listed(ranking.top(mi, "mi", top).select("mi", "pos_i", "pos_j"), "top_pairs"),
        listed(kmer.gray_adjacency(kmer.adjacent_counts(p)).select("distance", "n", "share"), "neighbours"),
    ]
    out = heads[0]
    for h in heads[1:]:  # one row each
        out = out.crossJoin(h)
    return out


def summary_rows(p: DataFrame, max_gap: int = 30, top: int = 20) -> DataFrame:
    """The summary as rows ``(section, rank, i, j, value)``; -1 where a section has no such column."""
    pc, counts = pairs.base_counts(p, max_gap)
    e, mi = columns.column_entropy(counts), pairs.mutual_information(pc)

    def rows(df: DataFrame, section: str, rank, i, j, value) -> DataFrame:
        return df.select(F.lit(section).alias("section"), rank.cast("int").alias("rank"), i.cast("int").alias("i"), j.cast("int").alias("j"), value.cast("double").alias("value"))

    def best(df: DataFrame, section: str, value: str, i: str, j: str | None = None) -> DataFrame:
        order = [F.desc(value), i, *([j] if j else [])]
        k = F.row_number().over(Window.orderBy(*order))  # at most ``top`` rows
        return rows(df.orderBy(*order).limit(top), section, k, F.col(i), F.col(j) if j else none, F.col(value))

    none = F.lit(-1)
    one = [
        rows(e.agg(F.count_if(F.col("entropy") > 0.3).alias("v")), "variable_columns", none, none, none, F.col("v")),
        rows(mi.agg(F.count("*").alias("v")), "pairs", none, none, none, F.col("v")),
        rows(mi.agg(F.count_if(F.col("mi") > 0.5).alias("v")), "high_pairs", none, none, none, F.col("v")),
        best(e, "column_entropy", "entropy", "pos"),
        best(columns.mutations_by_position(counts), "mutations", "n_mutations", "pos"),
        best(mi, "pair_mi", "mi", "pos_i", "pos_j"),
        rows(kmer.gray_adjacency(kmer.adjacent_counts(p)), "neighbour_share", none, F.col("distance"), none, F.col("share")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


def encoded_sequences(sequences: DataFrame, first: int = 50, values: int = 100) -> DataFrame:
    """``(seq_id, length, encoded_length, gray_values)`` of the first sequences by id: the Gray codes of their valid letters, the first of them as text."""
    some = sequences.orderBy("seq_id").limit(first)
    codes = F.transform(F.filter(codes_of(F.col("sequence")), valid), gray)
    coded = some.select("seq_id", F.length("sequence").cast("long").alias("length"), codes.alias("g"))
    return coded.select("seq_id", "length", F.size("g").cast("long").alias("encoded_length"), F.concat_ws(",", F.transform(F.slice("g", 1, values), lambda x: x.cast("string"))).alias("gray_values"))


def rule_document(p: DataFrame, title: str, max_gap: int = 30, k: int = 15) -> str:
    """A Markdown document of the rules: each of the k best pairs with its map, its implicants and its rules, then totals and how to apply them."""
    pc, counts = pairs.base_counts(p, max_gap)
    best = pairs.informative_pairs(pc, counts).limit(k)
    maps = checkpointed(boolean.mutation_map(pc, counts).join(F.broadcast(best.select(*pairs.PAIR)), pairs.PAIR, "left_semi"))
    found = boolean.found_implicants(best, maps, k).orderBy(F.desc("mi"), *pairs.PAIR, "code_i", "code_j", "n_dontcares", "expr").toPandas()  # k pairs of at most 400 cells
    state = {key: g for key, g in maps.toPandas().groupby(pairs.PAIR)}
    parts, n_rules = [f"# {title}", f"**Co-varying pairs shown:** {best.count()}"], 0
    for (i, j), g in found.groupby(pairs.PAIR, sort=False):
        head = g.iloc[0]
        parts.append(f"## Positions {i} and {j}\n\nMI {head['mi']:.4f}; references {BASE20[head['ref_i']]} and {BASE20[head['ref_j']]}.")
        parts.append(code_grid({(r.code_i, r.code_j): {1: "1", -1: "-"}[r.state] for r in state[i, j].itertuples()}))
        rows = [f"| {r.aa_i} | {r.aa_j} | `{r.expr}` | {r.n_dontcares} | {len(r.coverage)} | {'yes' if r.is_core_essential else ''} |" for r in g.itertuples()]
        parts.append("\n".join(["| i | j | implicant | free bits | covers | essential |", "|---|---|---|---|---|---|", *rows]))
        for r in g[g["is_core_essential"]].itertuples():
            n_rules += 1
            parts.append(f"Rule {n_rules}: where position {i} is {r.aa_i} and position {j} is {r.aa_j}, the two co-vary (MI {r.mi:.3f}).")
    parts.append(f"## Summary\n\n| Metric | Value |\n|---|---|\n| Variable columns | {columns.variable_positions(counts).count()} |\n| Pairs with implicants | {len(found.groupby(pairs.PAIR))} |\n| Rules | {n_rules} |")
    parts.append("## Use\n\nLook up the two residues of a new sequence at each pair of positions: a rule that names both says that the pair co-varies.")
    return "\n\n".join(parts) + "\n"


def report(p: DataFrame, title: str, max_gap: int = 30, top: int = 20) -> str:
    """A Markdown report: variable columns, co-varying pairs, rules."""
    pc, counts = pairs.base_counts(p, max_gap)
    mut = pairs.mutation_information(pc, counts)
    parts = [
        ("Most variable columns", columns.column_entropy(counts).orderBy(F.desc("entropy"), "pos").limit(top)),
        ("Most informative pairs", ranking.top(pairs.mutual_information(pc), "mi", top)),
        ("Pairs by mutations only", ranking.top(mut, "mi", top)),
        ("Strongest couplings", pairs.strongest_couplings(pairs.couplings(pc)).orderBy(F.desc("max_j"), *pairs.PAIR).limit(top)),
        ("Rules", boolean.rules(mut, boolean.mutation_map(pc, counts)).drop("mi").orderBy("pos_i", "pos_j", "code_i", "code_j")),
    ]
    return f"# {title}\n" + "".join(f"\n## {name}\n\n{markdown_table(df)}" for name, df in parts)
