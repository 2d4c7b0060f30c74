"""Ranks, standard scores and agreement of score tables (one row a column pair)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import rounded
from ..shared import ranked, with_total
from .pairs import PAIR


def rank_scores(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the rank of ``value`` from 0 to 1, ties by the pair; 0 where there is one row only."""
    out = with_total(ranked(df, "_k", value, *PAIR).withColumn("_one", F.lit(1)), "_one", "_n")
    return out.withColumn(name, F.when(F.col("_n") > 1, F.col("_k").cast("double") / (F.col("_n") - 1)).otherwise(0.0)).drop("_k", "_one", "_n")


def z_scores(df: DataFrame, **values: str) -> DataFrame:
    """Adds the standard score of each value under its name; 0 where all are equal."""
    stats = df.agg(*(f(v).alias(f"_{k}_{n}") for n, v in values.items() for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(stats))
    for n, v in values.items():
        out = out.withColumn(n, F.when(F.col(f"_s_{n}") > 0, (F.col(v) - F.col(f"_m_{n}")) / F.col(f"_s_{n}")).otherwise(0.0))
    return out.drop(*stats.columns)


def combined_scores(mi: DataFrame, ratio: DataFrame) -> DataFrame:
    """Mean and sum of the two rank scores, and sum of the standard scores."""
    both = mi.join(ratio, PAIR).select(*PAIR, "mi", "ratio")
    r = z_scores(rank_scores(rank_scores(both, "mi", "rm"), "ratio", "rr"), zm="mi", zr="ratio")
    return r.select(*PAIR, rounded((F.col("rm") + F.col("rr")) / 2).alias("mean_rank"), rounded(F.col("rm") + F.col("rr")).alias("rank_sum"), rounded(F.col("zm") + F.col("zr")).alias("z_sum"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns of a table of pairs, with average ranks for ties."""
    r = df.select(*PAIR, a, b)
    for value, name in ((a, "_x"), (b, "_y")):
        r = ranked(r, "_k", value, *PAIR)
        r = r.join(r.groupBy(value).agg(F.avg("_k").alias(name)), value).drop("_k")
    return r.agg(rounded(F.corr("_x", "_y")).alias("rho"), F.count("*").alias("n"))


def top(df: DataFrame, score: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), *PAIR).limit(k)


def top_per_pair(df: DataFrame, score: Column, k: int) -> DataFrame:
    w = Window.partitionBy(*PAIR).orderBy(score.desc(), "code_i", "code_j")
    return df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)


def rank_agreement(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """How many pairs two top-k lists have in common."""
    return a.select(*PAIR).join(b.select(*PAIR), PAIR).agg(F.count("*").alias("n_common")).withColumn("k", F.lit(k))
