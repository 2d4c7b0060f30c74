"""Sources: aligned FASTA, categorical tables as profiles, JSON results.

A *profile* table is ``(seq_id long, codes array<int>)``, one row per sequence;
its long form, ``(seq_id, pos, code)``, is ``cells``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encoding import BASE20, GAP, codes_of


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(seq_id, header, accession, description, sequence)`` of FASTA records.

    Lines are stripped, joined and upper-cased; text before the first record and
    blank lines are skipped; an empty header stays. Records are split by the
    reader, so a large file is read by many tasks; ``seq_id`` follows file order.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r", "").alias("value"))
    # only a file's first chunk still has its own ">" (or text before any record)
    head = F.col("value").startswith(">")
    lines = F.split(F.when(head, F.substring("value", 2, 2_000_000_000)).otherwise(F.col("value")), "\n")
    # a file's first chunk lies in its first block
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    raw = raw.withColumn("k", within).withColumn("first", (F.col("block") == 0) & (F.col("k") == 1))
    rec = raw.where(head | ~F.col("first")).select("file", "block", "k", F.trim(lines[0]).alias("header"), F.upper(F.array_join(F.transform(F.slice(lines, 2, 2_000_000_000), F.trim), "")).alias("sequence"))
    # ordinals from the counts of the read blocks: one small row a block, no global sort of sequences
    before = rec.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("k").alias("k0")).withColumn("before", F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).drop("n")
    rec = rec.join(before, ["file", "block"]).withColumn("seq_id", F.col("before") + F.col("k") - F.col("k0"))
    return rec.select("seq_id", "header", accession(F.col("header")).alias("accession"), description(F.col("header")).alias("description"), "sequence")


def accession(header: Column) -> Column:
    return F.coalesce(F.get(F.split(F.trim(header), r"\s+"), F.lit(0)), F.lit(""))


def description(header: Column) -> Column:
    at = F.instr(header, " | ")
    return F.when(at > 0, F.trim(F.substr(header, at + 3))).otherwise(header)


def profiles(sequences: DataFrame, max_pos: int | None = None, aligned: bool = True, alphabet: str = BASE20) -> DataFrame:
    """Profiles of ``(seq_id, sequence)``; gaps stay in place unless ``aligned`` is false."""
    codes = codes_of(F.col("sequence"), alphabet)
    if not aligned:
        codes = F.filter(codes, lambda c: c < GAP)
    if max_pos is not None:
        codes = F.slice(codes, 1, max_pos)
    return sequences.select("seq_id", codes.alias("codes"))


def profiles_from_rows(df: DataFrame, seq_id: str, columns: list[Column]) -> DataFrame:
    """Categorical columns, already coded, as positions; null or beyond 0..19 is the gap."""
    fit = [F.coalesce(F.when((c >= 0) & (c < GAP), c), F.lit(GAP)).cast("int") for c in columns]
    return df.select(F.col(seq_id).cast("long").alias("seq_id"), F.array(*fit).alias("codes"))


def cells(p: DataFrame) -> DataFrame:
    """``(seq_id, pos, code)``.

    Outer generators here and below: for an inner one the optimizer adds a filter on
    the array's size under the projection that makes it, and so makes it twice.
    """
    return p.select("seq_id", F.posexplode_outer("codes").alias("pos", "code")).where("pos is not null")


def orders_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a sequence of twelve categorical positions."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = F.col("o_orderdate")
    price = F.floor("o_totalprice")
    return profiles_from_rows(o, "o_orderkey", [
        F.position(F.col("o_orderstatus"), F.lit("FOP")) - 1,
        F.substring("o_orderpriority", 1, 1).cast("int") - 1,
        F.month(d) - 1, F.quarter(d) - 1, F.year(d) - 1992, F.dayofmonth(d) - 1, F.dayofweek(d) - 1,
        F.col("o_custkey") % 20, F.col("o_custkey") % 7, F.floor(F.col("o_totalprice") / 25000), price % 10, F.hour(d),
    ])


def supplier_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a sequence of eight categorical positions."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    cents = F.round(F.abs(F.col("s_acctbal")) * 100).cast("long")
    return profiles_from_rows(s, "s_suppkey", [
        F.col("s_nationkey") % 20, F.col("s_nationkey") % 5, F.floor((F.col("s_acctbal") + 1000) / 1000), cents % 10, F.floor(cents / 10) % 10,
        F.floor(cents / 100) % 20, F.when(F.col("s_acctbal") < 0, 0).otherwise(1), F.col("s_suppkey") % 3,
    ])


def embedding_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a sequence: each component in one of twenty steps of 1/40, beyond them the gap."""
    step = lambda x: F.floor(x.cast("double") * 40) + 10
    code = lambda x: F.when((step(x) >= 0) & (step(x) < GAP), step(x)).otherwise(GAP).cast("int")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("seq_id"), F.transform("embedding", code).alias("codes"))


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq_id, ts, event_id, code)``: every user's events, types coded by their alphabetical order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    kinds = e.select("event_type").distinct().withColumn("code", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int"))  # a row a type
    both = e.join(F.broadcast(kinds.where(F.col("code") < GAP)), "event_type", "left").withColumn("code", F.coalesce("code", F.lit(GAP)))  # 20 types have codes
    return both.select(F.col("user_id").alias("seq_id"), "ts", "event_id", "code")


def document_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document as a sequence of letters."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("seq_id"), F.coalesce("text", F.lit("")).alias("sequence"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result document written as JSON."""
    return spark.read.option("multiLine", True).json(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A matrix in long form, from Parquet."""
    return spark.read.parquet(path)
