"""Walsh-Hadamard spectra in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import rounded


def walsh_hadamard(values: DataFrame, bits: int) -> DataFrame:
    """``(k, coefficient)`` for ``(i, v)`` with i below 2**bits; absent i are 0.

    The sign of cell i in coefficient k is the parity of their common bits, so the
    transform is one generator over the few non-zero cells and one sum per k.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1)))
    sign = 1 - 2 * (F.bit_count(F.col("k").bitwiseAND(F.col("i").cast("int"))) % 2)
    return values.select("i", "v", k.alias("k")).groupBy("k").agg(F.sum(F.col("v") * sign).alias("coefficient"))


def spectrum(values: DataFrame, bits: int, top: int = 5) -> DataFrame:
    """The ``top`` modes by share of the summed magnitudes."""
    w = walsh_hadamard(values, bits).select("k", F.abs("coefficient").alias("magnitude"))
    share = w.withColumn("share", F.col("magnitude") / F.sum("magnitude").over(Window.partitionBy()))
    return share.select("k", rounded(F.col("share"), 9).alias("share")).orderBy(F.desc("share"), "k").limit(top)
