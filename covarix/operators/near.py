"""Near pairs of sequences by a metric index, instead of all pairs.

Sequences are dealt to the cells of pivots, each to its nearest one. Differing
positions (a gap or a missing position being a symbol of its own) are a metric,
so by the triangle inequality two sequences within r of each other lie in cells
whose pivots are not much farther: x, at home in cell h, must also visit a lower
cell c only if ``d(x, c) <= d(x, h) + 2 r`` and ``d(x, c) <= r + radius of c``.
Distances that leave out gaps are no metric; but they fall short of the metric
one by at most both sequences' gaps, and r grows by those. Within a cell, blocks
of home sequences meet blocks of home ones and of visitors, and each pair is
verified exactly, once. Cells of many sequences are dealt to many tasks.

Clustered sequences leave most cells unmet; of unrelated ones nearly all pairs
are compared, as without an index. ``comparisons`` tells how many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import GAP, rounded
from ..shared import checkpointed

PIVOTS, PIVOT_BYTES = 512, 8 << 20
SAMPLE = 4096  # sequences that pivots are chosen from; any choice gives the same pairs
BLOCK = 1000
ABSENT = 255


def matrix(codes, width: int | None = None) -> np.ndarray:
    """Rows of code bytes padded with ``ABSENT``."""
    width = max((len(c) for c in codes), default=0) if width is None else width
    out = np.full((len(codes), width), ABSENT, np.uint8)
    for k, c in enumerate(codes):
        out[k, : len(c)] = c
    return out


def _same_width(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(z, ((0, 0), (0, width - z.shape[1])), constant_values=ABSENT) for z in (x, y))
    return x, y


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions in which rows of x and rows of y differ; what only one has differs."""
    x, y = _same_width(x, y)
    return np.stack([(row != y).sum(1) for row in x]) if len(x) else np.zeros((0, len(y)), np.int64)


def valid_differences(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions valid in both in which they differ, and how many are valid in both."""
    x, y = _same_width(x, y)
    own, other = x < GAP, y < GAP
    both = own.astype(np.float32) @ other.T.astype(np.float32)
    apart = [((row != y) & v & other).sum(1) for row, v in zip(x, own)]
    return np.stack(apart) if len(x) else np.zeros((0, len(y)), np.int64), both.astype(np.int64)


def _pivots(sample: np.ndarray, reach: int, most: int, enough: int) -> np.ndarray:
    """Rows of the sample that lie apart from each other, one for each cluster met, then others up to ``enough``."""
    chosen, nearest = [0], differences(sample, sample[:1])[:, 0]
    while len(chosen) < most and (nearest > reach).any():
        k = int((nearest > reach).argmax())
        chosen.append(k)
        nearest = np.minimum(nearest, differences(sample, sample[k : k + 1])[:, 0])
    rest = [k for k in range(min(len(sample), 2 * enough)) if nearest[k]][: max(0, min(most, enough) - len(chosen))]
    return sample[sorted({*chosen, *rest})]


def _homes(items: DataFrame, pivots: np.ndarray, gaps: bool) -> DataFrame:
    """``item, codes, m, home, near, slack, far``: the nearest pivot, its distance, the gaps, and the distances to all pivots."""
    shared = items.sparkSession.sparkContext.broadcast(pivots)  # bounded by PIVOT_BYTES

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = matrix([c.values.to_numpy(zero_copy_only=False) for c in part.column("codes")])
                d = differences(x, shared.value).astype(np.int32)
                home = d.argmin(1)
                slack = max(x.shape[1], shared.value.shape[1]) - (x < GAP).sum(1) if gaps else np.zeros(len(x), np.int64)
                cells = [part.column("item"), part.column("codes"), part.column("m"), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(x)), home]), pa.array(slack.astype(np.int32)), pa.array([r.tobytes() for r in d], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["item", "codes", "m", "home", "near", "slack", "far"])

    return items.mapInArrow(run, "item long, codes array<int>, m long, home int, near int, slack int, far binary")


def _met(items: DataFrame, share: float, gaps: bool) -> DataFrame:
    """``cell, an, ai, ac, am, bn, bi, bc, bm, kind``: packed blocks that may hold near pairs.

    ``kind``: 0 a block with itself, 1 two blocks of a cell's home, 2 home and visitors.
    """
    spark = items.sparkSession
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("codes")), F.lit(0)).alias("width")).first()
    reach = int(np.floor(share * size["width"] + 1e-6))
    most = max(1, PIVOT_BYTES // max(1, size["width"]))
    some = items.select("codes").orderBy(F.xxhash64("codes"), "codes").limit(min(SAMPLE, most)).collect()
    pivots = _pivots(matrix([r["codes"] for r in some] or [[]], size["width"]), reach, min(PIVOTS, most), int(size["n"] ** 0.5))
    homes = checkpointed(_homes(items, pivots, gaps))
    # a row a pivot
    of = {r["home"]: (r["radius"], r["slack"], r["n"]) for r in homes.groupBy("home").agg(F.max("near").alias("radius"), F.max("slack").alias("slack"), F.count("*").alias("n")).collect()}
    radius, slack, rows = (np.array([of.get(c, (-1, 0, 0))[x] for c in range(len(pivots))]) for x in range(3))
    n_parts = np.maximum(1, -(-rows // (8 * BLOCK)))

    def places(batches):
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for at, (item, home, near, own, far) in enumerate(zip(*(b.column(c).to_pylist() for c in ("item", "home", "near", "slack", "far")))):
                d = np.frombuffer(far, np.int32)
                r = reach + own + slack
                visit = np.flatnonzero((np.arange(len(d)) < home) & (radius >= 0) & (d <= near + 2 * r) & (d <= r + radius))
                for c, guest in [(home, False), *((int(c), True) for c in visit)]:
                    out[0].append(at)
                    out[1].append(c)
                    out[2].append(guest)
                    out[3].append(hash(item) % int(n_parts[c]))
            take = pa.array(out[0], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("item", "codes", "m")), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.int32())], names=["item", "codes", "m", "cell", "guest", "part"])

    def pack(batches: Iterator[pa.RecordBatch]):
        part, number, key, held = TaskContext.get().partitionId() << 32, 0, None, []

        def block():
            nonlocal number
            number += 1
            cells = [[key[0]], [part + number], [key[1]], [len(held)], [np.array([h[0] for h in held], "<i8").tobytes()], [matrix([h[1] for h in held]).tobytes()], [np.array([h[2] for h in held], "<i8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["cell", "block", "guest", "n", "items", "codes", "m"])

        for b in batches:
            for codes, item, m, cell, guest in zip(b.column("codes"), *(b.column(c).to_pylist() for c in ("item", "m", "cell", "guest"))):
                if held and ((cell, guest) != key or len(held) == BLOCK):
                    yield block()
                    held = []
                key = cell, guest
                held.append((item, codes.values.to_numpy(zero_copy_only=False), m))
        if held:
            yield block()

    placed = homes.mapInArrow(places, "item long, codes array<int>, m long, cell int, guest boolean, part int").repartition("cell", "part").sortWithinPartitions("cell", "part", "guest")
    blocks = checkpointed(placed.mapInArrow(pack, "cell int, block long, guest boolean, n long, items binary, codes binary, m binary"))
    # blocks of a cell meet in a grid: each home block in one row of it, all blocks in every row
    n = blocks.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 8)).cast("int").alias("lines"))
    counted = blocks.join(F.broadcast(n), "cell")  # a row a pivot
    a = counted.where("not guest").select("cell", F.pmod(F.xxhash64("block"), F.col("lines")).cast("int").alias("line"), F.col("block").alias("a"), F.col("n").alias("an"), F.col("items").alias("ai"), F.col("codes").alias("ac"), F.col("m").alias("am"))
    b = counted.select("cell", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("line"), F.col("block").alias("b"), "guest", F.col("n").alias("bn"), F.col("items").alias("bi"), F.col("codes").alias("bc"), F.col("m").alias("bm"))
    kind = F.when(F.col("guest"), 2).when(F.col("a") == F.col("b"), 0).otherwise(1)
    return a.hint("merge").join(b, ["cell", "line"]).where("guest or a <= b").select("an", "ai", "ac", "am", "bn", "bi", "bc", "bm", kind.alias("kind"))


def comparisons(items: DataFrame, share: float, gaps: bool = False) -> int:
    """How many pairs the index leaves to be compared."""
    pairs = F.when(F.col("kind") == 0, F.col("an") * (F.col("an") - 1) / 2).otherwise(F.col("an") * F.col("bn"))
    return int(_met(items, share, gaps).agg(F.coalesce(F.sum(pairs), F.lit(0))).first()[0])


def _block(n: int, codes: bytes) -> np.ndarray:
    return np.frombuffer(codes, np.uint8).reshape(n, -1)


def _each(met: DataFrame, rows: Callable, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for an, ai, ac, am, bn, bi, bc, bm, kind in zip(*(c.to_pylist() for c in batch.columns)):
                yield from rows(_block(an, ac), _block(bn, bc), *(np.frombuffer(z, "<i8") for z in (ai, am, bi, bm)), kind)

    return met.mapInArrow(run, schema)


def neighbour_counts(items: DataFrame, theta: float = 0.2) -> DataFrame:
    """``item, near``: how many sequences, copies and itself included, differ in at most ``floor(theta L)`` positions, L being its own length.

    ``items`` are distinct: ``item long, codes array<int>, m long`` (copies).
    """

    def rows(x, y, ai, am, bi, bm, kind):
        d = differences(x, y)
        own, other = (np.floor((z < ABSENT).sum(1) * theta) for z in (x, y))
        near = (d <= own[:, None]) @ bm
        yield pa.RecordBatch.from_arrays([pa.array(ai), pa.array(near)], names=["item", "near"])
        if kind:
            back = (d <= other[None, :]).T @ am
            yield pa.RecordBatch.from_arrays([pa.array(bi), pa.array(back)], names=["item", "near"])

    return _each(_met(items, theta, False), rows, "item long, near long").groupBy("item").agg(F.sum("near").alias("near"))


def near_pairs(p: DataFrame, share: float) -> DataFrame:
    """``seq_a, seq_b, n_valid, hamming``: pairs that differ in at most ``share`` of the positions valid in both, of which there is one at least."""
    items = p.select(F.col("seq_id").cast("long").alias("item"), "codes", F.lit(1).cast("long").alias("m"))

    def rows(x, y, ai, am, bi, bm, kind):
        for at in range(0, len(x), 100):
            d, n = valid_differences(x[at : at + 100], y)
            use = (n > 0) & (d / np.maximum(n, 1) <= share)
            if not kind:
                use &= np.arange(len(y))[None, :] > np.arange(at, at + len(d))[:, None]
            i, j = np.nonzero(use)
            if len(i):
                a, b = ai[at + i], bi[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n[i, j]), pa.array(d[i, j] / n[i, j])], names=["seq_a", "seq_b", "n_valid", "hamming"])

    return _each(_met(items, share, True), rows, "seq_a long, seq_b long, n_valid long, hamming double").withColumn("hamming", rounded(F.col("hamming")))
