"""What operators share: checkpoints, sized broadcasts, totals and ranks over whole tables, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
EDGES = 50_000  # of a graph, a task


def release(*frames: DataFrame) -> None:
    """Removes the files of frames that ``checkpointed`` made and nothing reads any more."""
    for df in frames:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset and the master is local (tests on one machine) is a temporary one made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where the counted rows, a few numbers each, are few."""
    return F.broadcast(df) if rows <= limit else df


def with_total(df: DataFrame, value: str, name: str = "total") -> DataFrame:
    """``df`` with the sum of a column over all rows: one small row, broadcast, and no single-task window."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias(name))))


def ranked(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with ``name``, the number from 0 of each row in a total order.

    Rows are dealt to ranges of the order; each counts its own and begins after
    the counts of those before it.
    """
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = sizes.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")


FEW = 10_000  # values that the driver sorts


def exact_percentile(df: DataFrame, value: str, share: float) -> float | None:
    """The percentile of a column as ``percentile`` gives it, interpolated between neighbours; ``None`` of no values.

    Instead of gathering all values in one task, the ranks are enclosed between
    two approximate percentiles; exact counts below and at them tell where the ranks
    lie, and only what lies strictly between goes on, some ten-thousandths of the
    values a round, until few are left.
    """
    v = checkpointed(df.select(F.col(value).cast("double").alias("v")).where("v is not null"))
    n = v.count()
    if not n:
        return None
    at = share * (n - 1)
    low, high = int(at), min(n - 1, int(at) + (at > int(at)))
    a, b = _ranked_value(v, low, n), None
    b = a if high == low else _ranked_value(v, high, n)
    release(v)
    return a if a == b else (high - at) * a + (at - low) * b


def _ranked_value(v: DataFrame, rank: int, n: int) -> float:
    """The value of a rank, from 0, of ``n`` values."""
    while n > FEW:
        near = [max(0.0, (rank - 0.0005 * n) / n), min(1.0, (rank + 0.0005 * n) / n)]
        low, high = v.agg(F.percentile_approx("v", near, 10_000).alias("x")).first()["x"]
        below, at_low, between, at_high = v.agg(*(F.count_if(c) for c in (F.col("v") < low, F.col("v") == low, (F.col("v") > low) & (F.col("v") < high), (F.col("v") == high) & (F.lit(high > low))))).first()
        if rank < below:  # beyond the sketch's error
            v, n = v.where(F.col("v") < low), below
        elif rank < below + at_low:
            return low
        elif rank < below + at_low + between:
            v, rank, n = v.where((F.col("v") > low) & (F.col("v") < high)), rank - below - at_low, between
        elif rank < below + at_low + between + at_high:
            return high
        else:
            v, rank, n = v.where(F.col("v") > high), rank - (below + at_low + between + at_high), n - (below + at_low + between + at_high)
    return sorted(r["v"] for r in v.collect())[rank]


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)``: the smallest node reachable over undirected ``edges``.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every
    step is a minimum per node and a join back to it, so a node with very many
    neighbours is pre-aggregated on the map side and its rows can be split by
    the skew join. Takes O(log^2 n) steps even on long chains. Null ends and
    self-loops link nothing; nodes without an edge do not appear.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    e = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpointed(e)
    before = _fingerprint(e)
    while True:
        # as many tasks and files as the edges need, not as the session's shuffles have
        parts = max(2, -(-before[0] // EDGES))
        old, e = e, checkpointed(_small_star(_large_star(e.coalesce(parts), parts), parts))
        release(old)
        after = _fingerprint(e)
        if after == before:
            break
        before = after
    # every edge now points at its component's smallest node
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def _large_star(e: DataFrame, parts: int) -> DataFrame:
    """Every neighbour larger than a node moves to that node's smallest neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts)
    moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(parts).distinct().coalesce(parts)


def _small_star(e: DataFrame, parts: int) -> DataFrame:
    """Every neighbour not above a node, and the node, moves to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts)
