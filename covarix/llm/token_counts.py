"""Token counts for every context limit from one exact length histogram.

Documents are aggregated by encoded length; suffix sums over the distinct
lengths then answer, for any limit, how many documents fit, the tokens left
after truncation and the tokens lost. The histogram has one row per distinct
length, so only counts are shuffled and never texts.

The suffix sums are taken in two levels: within a block of ``BLOCK`` lengths,
and over the few block totals, so no task holds all lengths.

Defined cases: null and empty texts have length 0; repeated rows count each;
an empty table gives no rows; only ``text`` is read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .tokens import default_tokenizer, encoder

BLOCK = 4096


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``length`` of every row's whole text, without special tokens."""
    path = tokenizer or default_tokenizer()

    def count(batches):
        enc = encoder(path)
        for b in batches:
            n = [len(enc.id_bytes(t.as_py() or "")) // 4 for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["length"])

    return docs.select("text").mapInArrow(count, "length long")


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return token_lengths(docs, tokenizer).groupBy("length").agg(F.count("*").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each occurring length taken as context limit: the exact totals.

    ``docs_within``: documents of at most that length; ``kept_tokens``: tokens
    left when every document is cut at the limit; ``lost_tokens``: the others;
    ``quantile``: share of documents within.
    """
    h = checkpointed(histogram.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK)))
    over = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per 4096 lengths: a few thousand rows even for texts of millions of tokens
    later = over.select("block", F.coalesce(F.sum("d").over(down), F.lit(0)).alias("docs_later"), F.coalesce(F.sum("t").over(down), F.lit(0)).alias("tokens_later"), F.sum("d").over(Window.partitionBy()).alias("all_docs"), F.sum("t").over(Window.partitionBy()).alias("all_tokens"))
    inner = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = h.select("block", "length", "n_docs", "tokens", F.sum("n_docs").over(inner).alias("d"), F.sum("tokens").over(inner).alias("t")).join(later, "block")
    beyond_docs = F.col("docs_later") + F.col("d") - F.col("n_docs")
    beyond_tokens = F.col("tokens_later") + F.col("t") - F.col("tokens")
    lost = beyond_tokens - beyond_docs * F.col("length")
    return s.select(
        F.col("length").alias("context_limit"), "n_docs", "tokens", (F.col("all_docs") - beyond_docs).alias("docs_within"),
        (F.col("all_tokens") - lost).alias("kept_tokens"), lost.alias("lost_tokens"), ((F.col("all_docs") - beyond_docs) / F.col("all_docs")).alias("quantile"),
    )


def token_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return limit_table(length_histogram(docs, tokenizer))
