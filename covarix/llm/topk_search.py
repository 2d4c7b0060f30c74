"""Exact top-k inner-product search with multi-resolution segment statistics.

A vector of d components is cut into equal segments; each segment has a mean
and a deviation from it. By the Cauchy-Schwarz inequality the inner product of
two vectors is at most the sum over segments of (length * product of means +
product of deviations), which mirrors the lower bound of their distance. The
bound is taken coarse to fine (1, 4, then 16 segments): pairs whose bound falls
below the query's k-th best score so far go, and exact integer scores are
computed for the survivors only.

Queries and candidates are packed into blocks and dealt to a grid of cells, so
no task sees more than its blocks and no pair of rows is a row of the plan. A
cell keeps one running top k per query, and the cells' results are merged.

Vectors of a norm below 2**26 have exact products in doubles and take this path.
Wider ones have blocks of their own, scored in unbounded integers without
pruning; a score beyond 64 bits ranks by its exact value and is shown as the
nearest 64-bit number.

Defined cases: components are floored after scaling; vectors that are null,
empty, or hold null or non-finite components take no part; vectors of different
length than the query's are no candidates; null ids take no part; ties go to
the smaller id; repeated ids are candidates each, and each query row has a
ranking of its own, also if its id is repeated; a query's own id is none.
"""

from __future__ import annotations

import heapq
import math
from itertools import chain
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, rows_to_batches

QUERY_BLOCK, ROW_BLOCK, CELL_BLOCKS = 512, 4096, 4
LEVELS = (1, 4, 16)
WIDE = 2.0**26
_BLOCKS = "dim int, wide boolean, block long, ids binary, vecs binary"


def _blocks(df: DataFrame, size: int, scale: int) -> DataFrame:
    """Rows ``(id, v)`` packed into blocks of up to ``size`` vectors of one length.

    ``block`` numbers the block's first row; numbers differ between all rows. A
    narrow block holds scaled integers, a wide one the components themselves.
    """
    schema = pa.schema([("dim", pa.int32()), ("wide", pa.bool_()), ("block", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary())])

    def pack(batches):
        base = TaskContext.get().partitionId() << 36

        def rows():
            nonlocal base
            held: dict[tuple[int, bool], list] = {}
            for b in batches:
                for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                    v = v.values.to_numpy(zero_copy_only=False)
                    with np.errstate(over="ignore"):
                        low = np.floor(v * scale)
                        wide = not float(low @ low) < WIDE * WIDE
                    part = held.setdefault((len(v), wide), [])
                    part.append((i, v if wide else low))
                    if len(part) == size:
                        yield make(wide, held.pop((len(v), wide)))
            for (_, wide), part in held.items():
                yield make(wide, part)

        def make(wide, part):
            nonlocal base
            ids = np.array([i for i, _ in part], "<i8")
            vecs = np.stack([v for _, v in part]).astype("<f8" if wide else "<i4")
            base += len(ids)
            return vecs.shape[1], wide, base - len(ids), ids.tobytes(), vecs.tobytes()

        return rows_to_batches(rows(), schema, 16)

    return df.mapInArrow(pack, _BLOCKS)


def _integers(vecs: np.ndarray, wide: bool, scale: int) -> list[list[int]]:
    """The scaled and floored components as unbounded integers."""
    if not wide:
        return vecs.tolist()
    return [[scale * int(x) if abs(x) >= 2.0**53 else math.floor(x * scale) for x in v] for v in vecs.tolist()]


def _stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    parts = np.array_split(x, segments, axis=1)
    width = np.array([p.shape[1] for p in parts])
    mean = np.stack([p.mean(1) for p in parts], 1)
    dev = np.stack([np.sqrt(((p - p.mean(1, keepdims=True)) ** 2).sum(1)) for p in parts], 1)
    return mean * np.sqrt(width), dev


def _bound_rows(x: np.ndarray) -> list[np.ndarray]:
    """For each level, vectors whose inner products bound those of ``x`` from above."""
    return [np.hstack(_stats(x, min(s, x.shape[1]))) for s in LEVELS]


class CellSearch:
    """The running top k of one block of queries."""

    def __init__(self, block: int, ids: np.ndarray, vecs: np.ndarray, wide: bool, k: int, scale: int) -> None:
        self.block, self.ids, self.given, self.wide, self.k, self.scale = block, ids, vecs, wide, k, scale
        self.exact: list[list[int]] | None = None
        self.rest: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id) of wide products
        self.best_score = np.full((len(ids), k), -np.inf)
        self.best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        if not wide:
            self.vecs = vecs.astype(np.float64)
            self.bounds = _bound_rows(self.vecs)
            self.norms = np.sqrt((self.vecs**2).sum(1))

    def add(self, ids: np.ndarray, vecs: np.ndarray, wide: bool) -> None:
        if wide or self.wide:
            return self._add_exact(ids.tolist(), _integers(vecs, wide, self.scale))
        vecs = vecs.astype(np.float64)
        for at in range(0, len(ids), 1024):
            self._add(ids[at : at + 1024], vecs[at : at + 1024])

    def _add_exact(self, ids: list[int], vecs: list[list[int]]) -> None:
        self.exact = self.exact or _integers(self.given, self.wide, self.scale)
        for mine, q, rest in zip(self.ids.tolist(), self.exact, self.rest):
            found = ((-sum(map(mul, q, c)), i) for i, c in zip(ids, vecs) if i != mine)
            rest[:] = heapq.nsmallest(self.k, chain(rest, found))

    def _add(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        floor = self.best_score[:, -1:]
        levels = _bound_rows(vecs)
        # rounding is in proportion to the product of the norms
        slack = floor - 1e-9 * self.norms[:, None] * np.sqrt((vecs**2).sum(1))[None, :] - 1e-6
        alive = self.bounds[0] @ levels[0].T >= slack
        for q, c in zip(self.bounds[1:], levels[1:]):
            if alive.mean() < 0.02:
                break
            alive &= q @ c.T >= slack
        rows = np.flatnonzero(alive.any(1))
        if not len(rows):
            return
        cols = np.flatnonzero(alive.any(0))
        score = np.where(alive[np.ix_(rows, cols)], np.rint(self.vecs[rows] @ vecs[cols].T), -np.inf)
        score[self.ids[rows][:, None] == ids[cols][None, :]] = -np.inf
        take = score >= floor[rows]
        for r in np.flatnonzero(take.any(1)).tolist():
            q, use = rows[r], take[r]
            s = np.concatenate((self.best_score[q], score[r, use]))
            i = np.concatenate((self.best_id[q], ids[cols[use]]))
            top = np.lexsort((i, -s))[: self.k]
            self.best_score[q], self.best_id[q] = s[top], i[top]

    def rows(self):
        """``(query row, query id, candidate, score, text that ranks a score beyond 64 bits)``."""
        for r, (q, ss, ii, rest) in enumerate(zip(self.ids.tolist(), self.best_score.tolist(), self.best_id.tolist(), self.rest)):
            for s, i in heapq.nsmallest(self.k, [*((-int(s), i) for s, i in zip(ss, ii) if s > -np.inf), *rest]):
                yield self.block + r, q, i, min(max(-s, -(2**63)), 2**63 - 1), None if -(2**63) <= -s < 2**63 else _rank_text(-s)


def _rank_text(score: int) -> str:
    """Text that sorts like an integer beyond 64 bits, as do the empty ones of all others between negative and positive."""
    digits = str(abs(score))
    key = f"{len(digits):04d}{digits}"
    return f"+{key}" if score > 0 else "!" + key.translate(str.maketrans("0123456789", "9876543210"))


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, v)``: vectors as doubles; incomplete ones are gone."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(whole, F.lit(False)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best of all rows for each query row.

    ``is_query`` is a condition on ``id``.
    """
    rows = whole_vectors(vectors)
    queries = checkpointed(_blocks(rows.where(is_query), QUERY_BLOCK, scale))
    cands = checkpointed(_blocks(rows, ROW_BLOCK, scale))
    # the grid: every group of query blocks meets every group of candidate blocks in one cell
    n_q, n_c = (max(1, -(-x.count() // CELL_BLOCKS)) for x in (queries, cands))
    mine = lambda n: F.pmod(F.xxhash64("block", "ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("dim", mine(n_q).alias("row"), every(n_c).alias("col"), F.col("wide").alias("q_wide"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    c = cands.select("dim", every(n_q).alias("row"), mine(n_c).alias("col"), F.col("wide").alias("c_wide"), F.col("ids").alias("c_ids"), F.col("vecs").alias("c_vecs"))
    # merged, a query block's candidates come one after the other
    met = q.hint("merge").join(c, ["dim", "row", "col"]).select("dim", "q_wide", "q_block", "q_ids", "q_vecs", "c_wide", "c_ids", "c_vecs")
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())])

    def search(batches):
        read = lambda data, wide, dim: np.frombuffer(data, "<f8" if wide else "<i4").reshape(-1, dim)

        def found():
            key, cell = None, None
            for b in batches:
                for dim, q_wide, block, qi, qv, c_wide, ci, cv in zip(*(c.to_pylist() for c in b.columns)):
                    if block != key:
                        if cell:
                            yield from cell.rows()
                        key, cell = block, CellSearch(block, np.frombuffer(qi, "<i8"), read(qv, q_wide, dim), q_wide, k, scale)
                    cell.add(np.frombuffer(ci, "<i8"), read(cv, c_wide, dim), c_wide)
            if cell:
                yield from cell.rows()

        return rows_to_batches(found(), schema)

    part = met.mapInArrow(search, "query_row long, query_id long, vec_id long, score long, beyond string")
    # between two scores that do not fit, the text decides; it is empty for those that fit
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc(F.coalesce("beyond", F.when(F.col("score") < 0, "~").otherwise(""))), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
