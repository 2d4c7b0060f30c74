"""Best-fit-decreasing packing of token sequences.

Best fit looks only at lengths, and lengths run from 1 to the sequence size, so
the packing is planned on the exact length histogram: at most ``capacity``
counts reach the driver however large the corpus is. A segment tree over
remaining capacities finds the tightest open bin in logarithmic time; equal
documents take equal bins in one step, which yields the very packing that
placing them one at a time does. The plan is a list of runs (a rank interval of
one length goes to an interval of bins), at most a few runs per length, and
every piece then finds its place from its rank among the pieces of its length.

Ranks are counted per (length, bucket) with buckets of bounded size, so a
length that a third of all documents share is split over many tasks.

Defined cases: null and empty texts are one piece holding only the end id;
repeated rows are packed as often as they occur; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, rows_to_batches, wider
from .tokens import default_tokenizer, encoder

END_ID = 1
BUCKET_ROWS = 200_000


class OpenBins:
    """Segment tree over remaining capacities: which hold an open bin."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, c: int) -> None:
        i = c + self.size
        self.tree[i] = len(self.bins[c])
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]

    def add(self, c: int, first: int, n: int) -> None:
        """``n`` bins from number ``first`` on have room ``c``."""
        if c and n:
            self.bins[c].append((first, n))
            self._mark(c)

    def pop(self, c: int) -> tuple[int, int]:
        got = self.bins[c].pop()
        self._mark(c)
        return got

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open bin has."""
        i, tree = least + self.size, self.tree
        if tree[i]:
            return least
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, count, first bin, per bin, offset)`` for each run."""
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    bins, runs, used = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                n = -(-left // (capacity // length))
                bins.add(capacity, used, n)
                used += n
                continue
            first, n = bins.pop(room)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - room))
                bins.add(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:
                runs.append((length, rank, left, first, left, capacity - room))
                bins.add(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            bins.add(room, first, n)
    return runs


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; every document ends with ``END_ID``."""
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]):
        enc = encoder(path)

        def rows():
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = enc.id_bytes(text.as_py() or "") + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        yield doc, piece, at // 4, len(part) // 4, zlib.crc32(part)

        return rows_to_batches(rows(), schema)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def place(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (any columns, with ``length``) plus ``sequence_id`` and ``offset``.

    ``pieces`` is used more than once: hand in a checkpointed frame.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(best_fit_runs(histogram, capacity))
    plan = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 6))
    buckets = max(1, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    cols = pieces.columns
    # by place in the written frame, so that rows repeated as a whole are spread too
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))
    before = (
        salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
        .select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    )
    order = Window.partitionBy("length", "_bucket").orderBy(*cols)
    ranked = salted.withColumn("_row", F.row_number().over(order)).join(before, ["length", "_bucket"])
    ranked = ranked.select(*cols, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    stride = 1 << 48

    def put(batches):
        runs = plan.value
        keys = runs[:, 0] * stride + runs[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            run = runs[np.searchsorted(keys, length * stride + rank, "right") - 1]
            i = rank - run[:, 1]
            seq, off = run[:, 3] + i // run[:, 4], run[:, 5] + i % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(seq), pa.array(off)], names=[*cols, "sequence_id", "offset"])

    return ranked.mapInArrow(put, wider(pieces, "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """Every document's pieces with their sequence and place in it."""
    return place(checkpointed(token_pieces(docs, capacity, tokenizer)), capacity)
