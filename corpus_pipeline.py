"""The corpus pipeline: five stages over ``documents``, each written and reread by its caller.

Every stage takes ``(spark, docs, sf_dir)`` and all that its predecessor kept.
The first four return the columns of ``documents``; the last one the packing of
what is left. Texts stay whole and no stage looks at ids to choose rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from covarix.llm.common import checkpointed, release, table
from covarix.llm.decontaminate import without_leaks
from covarix.llm.line_dedup import dedup_lines
from covarix.llm.ngram_join import Similarity, one_of_each
from covarix.llm.packing import pack_documents
from covarix.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more of them repeat."""
    return dedup_lines(docs, min_docs=3, min_chars=20)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    return one_of_each(docs, n=5, sim=Similarity(4, 5))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the remaining documents."""
    return pack_documents(docs, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", packing),
]

# Tokens, signatures and a trained model are beyond SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are checkpointed instead of written, each until the next one is."""
    docs, old = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
            release(*old)
            old = [docs]
    return docs
