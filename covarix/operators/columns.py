"""Per-column and per-sequence statistics of profiles.

Everything per column starts from ``column_counts``: one pass with map-side
counts, whose result has at most 21 rows a column however many sequences there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import GAP, gray_distance, perplexity, rounded, valid, variability
from ..sources.readers import cells


def column_counts(p: DataFrame) -> DataFrame:
    """``(pos, code, n)``."""
    return cells(p).groupBy("pos", "code").agg(F.count("*").alias("n"))


def _entropy(counts: DataFrame) -> DataFrame:
    """``(pos, n_valid, h)`` over valid codes."""
    v = counts.where(valid(F.col("code")))
    total = F.sum("n").over(Window.partitionBy("pos"))
    prob = F.col("n").cast("double") / total
    return v.withColumn("p", prob).groupBy("pos").agg(F.sum("n").alias("n_valid"), F.sum(-F.col("p") * F.log2("p")).alias("h"))


def column_entropy(counts: DataFrame) -> DataFrame:
    """``(pos, n_valid, entropy, perplexity, label)``; columns with only gaps have entropy 0."""
    every = counts.select("pos").distinct()
    h = F.coalesce("h", F.lit(0.0))
    return every.join(_entropy(counts), "pos", "left").select("pos", F.coalesce("n_valid", F.lit(0)).cast("long").alias("n_valid"), rounded(h).alias("entropy"), rounded(perplexity(h)).alias("perplexity"), variability(perplexity(h)).alias("label"))


def majority(counts: DataFrame) -> DataFrame:
    """``(pos, ref_code, ref_n)``: the most frequent valid code, ties to the lowest; 0 for columns with only gaps."""
    order = F.struct("n", (-F.col("code")).alias("low"))
    best = counts.where(valid(F.col("code"))).groupBy("pos").agg(F.max(order).alias("b"))
    every = counts.select("pos").distinct()
    return every.join(best, "pos", "left").select("pos", F.coalesce(-F.col("b.low"), F.lit(0)).cast("int").alias("ref_code"), F.coalesce("b.n", F.lit(0)).cast("long").alias("ref_n"))


def variable_positions(counts: DataFrame, threshold: float = 0.3, by: str = "entropy") -> DataFrame:
    """Columns whose entropy, or ``perplexity``, exceeds the threshold."""
    return column_entropy(counts).where(F.col(by) > threshold).select("pos", by)


def long_enough(sequences: DataFrame, least: int = 100, min_rows: int = 5) -> DataFrame:
    """Sequences longer than ``least`` characters; none if fewer than ``min_rows`` are."""
    some = sequences.where(F.length("sequence") > least)
    return some.crossJoin(F.broadcast(some.agg(F.count("*").alias("_n")))).where(F.col("_n") >= min_rows).drop("_n")


def consensus(counts: DataFrame) -> DataFrame:
    """The consensus code and its share among all sequences, gaps included."""
    total = counts.groupBy("pos").agg(F.sum("n").alias("total"))
    share = F.col("ref_n").cast("double") / F.col("total")
    return majority(counts).join(total, "pos").select("pos", "ref_code", rounded(share).alias("share"))


def conservation(counts: DataFrame) -> DataFrame:
    """Largest share of any character, the gap too, with the two tallies' flags."""
    c = counts.groupBy("pos").agg((F.max("n").cast("double") / F.sum("n")).alias("c"))
    return c.select("pos", rounded(F.col("c")).alias("conservation"), (F.col("c") > 0.9).alias("conserved"), (F.col("c") < 0.7).alias("variable"))


def position_frequencies(counts: DataFrame) -> DataFrame:
    """``(pos, code, freq)`` among valid codes."""
    v = counts.where(valid(F.col("code")))
    return v.select("pos", "code", rounded(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("pos"))).alias("freq"))


def mutations(p: DataFrame, counts: DataFrame, gap_is_mutation: bool = True) -> DataFrame:
    """``(seq_id, pos, code, ref_code)`` of cells that differ from the majority."""
    ref = F.broadcast(majority(counts).select("pos", "ref_code"))  # one row a column
    m = cells(p).join(ref, "pos").where(F.col("code") != F.col("ref_code"))
    return m if gap_is_mutation else m.where(F.col("code") < GAP)


def mutations_by_position(counts: DataFrame) -> DataFrame:
    """Differing sequences per column, straight from the counts."""
    return counts.join(majority(counts).select("pos", "ref_code"), "pos").groupBy("pos").agg(F.sum(F.when(F.col("code") != F.col("ref_code"), F.col("n")).otherwise(0)).alias("n_mutations"))


def mutations_by_sequence(p: DataFrame, counts: DataFrame) -> DataFrame:
    """Differing columns per sequence: the majority is one short array, compared in place."""
    ref = majority(counts).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref_code"))), lambda x: x["ref_code"]).alias("ref"))
    both = p.join(F.broadcast(ref))
    differ = F.size(F.filter(F.zip_with("codes", F.slice("ref", 1, F.size("codes")), lambda a, b: a != b), lambda x: x))
    return both.select("seq_id", differ.cast("long").alias("n_mutations"))


def mutations_vs_first(p: DataFrame) -> DataFrame:
    """``(pos, gray_distance, n)`` of valid differences from the sequence with the smallest id."""
    first = p.agg(F.min_by("codes", "seq_id").alias("ref"))
    both = p.join(F.broadcast(first))  # one row
    pairs = F.zip_with("codes", "ref", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    d = both.select(F.posexplode(pairs).alias("pos", "x")).where(valid(F.col("x.a")) & valid(F.col("x.b")) & (F.col("x.a") != F.col("x.b")))
    return d.groupBy("pos", gray_distance(F.col("x.a"), F.col("x.b")).cast("int").alias("gray_distance")).agg(F.count("*").alias("n"))


def mutations_vs_first_by_sequence(p: DataFrame) -> DataFrame:
    """``(seq_id, n_mutations)``: valid differences of each sequence from the one with the smallest id."""
    first = p.agg(F.min_by("codes", "seq_id").alias("ref"))
    pairs = F.zip_with("codes", "ref", lambda a, b: F.coalesce(valid(a) & valid(b) & (a != b), F.lit(False)))
    return p.join(F.broadcast(first)).select("seq_id", F.size(F.filter(pairs, lambda x: x)).cast("long").alias("n_mutations"))


def top_mutated(by_position: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` columns of most mutations, ties to the first, of any table ``(pos, n)``."""
    return by_position.groupBy("pos").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pos").limit(k)


def sequence_stats(sequences: DataFrame, alphabet: str) -> DataFrame:
    """Counts over raw sequences: number, lengths, gaps (``-``) and characters outside the alphabet."""
    gaps = F.length("sequence") - F.length(F.replace(F.col("sequence"), F.lit("-"), F.lit("")))
    known = F.length(F.regexp_replace(F.translate("sequence", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), f"[^{alphabet}]", ""))
    return sequences.agg(
        F.count("*").alias("n_sequences"), F.min(F.length("sequence")).cast("long").alias("min_length"), F.max(F.length("sequence")).cast("long").alias("max_length"),
        rounded(F.avg(F.length("sequence"))).alias("mean_length"), F.sum(gaps).cast("long").alias("n_gaps"), F.sum(F.length("sequence") - gaps - known).cast("long").alias("n_unknown"),
    )
