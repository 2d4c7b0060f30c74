"""Incremental counts: columns and column pairs of an unbounded stream of profiles.

Counts are additive, so entropy and mutual information of all data so far follow
from the running counts with the batch operators. The full joint counts are
kept: which code is the reference may change as data arrive, so reference
cells are only left out when the counts are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.columns import column_counts
from ..operators.pairs import pair_counts


def stream_profiles(stream: DataFrame, seq_id: str, columns: list) -> DataFrame:
    from ..sources.readers import profiles_from_rows

    return profiles_from_rows(stream, seq_id, columns)


def running_column_counts(profiles: DataFrame) -> DataFrame:
    """``(pos, code, n)`` for update or complete output; the state has at most 21 rows a column."""
    return column_counts(profiles)


def running_pair_counts(profiles: DataFrame, max_gap: int = 30) -> DataFrame:
    """``(pos_i, pos_j, code_i, code_j, n)``; the state is bounded by columns, gap and codes."""
    return pair_counts(profiles, max_gap)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per event-time window and key with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")


def write_counts(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps the counts in a table of the session."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
