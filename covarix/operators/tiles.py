"""Statistics of all column pairs of wide alignments, tile by tile.

A tile is ``TILE`` by ``TILE`` columns with the 21 x 21 joint counts of each pair.
Sequences are packed into blocks of code bytes; a block meets every tile in
numpy, where a column against a tile of columns is one ``bincount``. No row per
sequence and pair is ever made. If there are fewer blocks than tasks could work
on, the tiles of a block are dealt to several tasks; if there are several
blocks, their counts of a tile are summed where the tile is shuffled to. The
statistic is computed from the summed tile in the same place, so that counts
become rows only if asked for.

Codes lie in 0..20, 20 being the gap; others count as the gap. A sequence takes
part in the columns that it has, so lengths may differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import rounded
from ..shared import checkpointed
from .columns import column_counts, majority, variable_positions

TILE = 64
BLOCK_BYTES = 64 << 20
ROWS = 4096  # of a block that meet a tile at once
STATES, ABSENT = 21, 21

Finish = Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def joint_counts(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """``(columns of x, columns of y, 21, 21)`` joint counts, or sums of weights, of byte codes with ``ABSENT``."""
    s, tx, ty = STATES + 1, x.shape[1], y.shape[1]
    out = np.zeros((tx, ty * s * s), np.int64 if weight is None else np.float64)
    place = np.arange(ty, dtype=np.intp) * (s * s)
    for at in range(0, len(x), ROWS):
        own, other = x[at : at + ROWS].astype(np.intp) * s, y[at : at + ROWS] + place
        w = None if weight is None else np.repeat(weight[at : at + ROWS], ty)
        for k in range(tx):
            out[k] += np.bincount((other + own[:, k, None]).ravel(), w, ty * s * s).astype(out.dtype, copy=False)
    return out.reshape(tx, ty, s, s)[:, :, :STATES, :STATES]


def packed(p: DataFrame, weight: str | None = None) -> DataFrame:
    """``(block, n, codes, w)``: sequences as rows of bytes, padded with ``ABSENT``, in blocks of bounded size."""
    cols = ["codes", weight] if weight else ["codes"]

    def pack(batches: Iterator[pa.RecordBatch]):
        part, number, held, weights, width = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def block():
            x = np.full((len(held), width), ABSENT, np.uint8)
            for i, c in enumerate(held):
                x[i, : len(c)] = c
            cells = [pa.array([part + number]), pa.array([len(held)]), pa.array([x.tobytes()], pa.large_binary()), pa.array([np.asarray(weights, "<f8").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([c.cast(pa.binary()) if pa.types.is_large_binary(c.type) else c for c in cells], names=["block", "n", "codes", "w"])

        for b in batches:
            for k, c in enumerate(b.column(0)):
                c = c.values.to_numpy(zero_copy_only=False)
                c = np.where((c >= 0) & (c < STATES), c, STATES - 1).astype(np.uint8)
                if held and (len(held) + 1) * max(width, len(c)) > BLOCK_BYTES:
                    yield block()
                    number, held, weights, width = number + 1, [], [], 0
                held.append(c)
                width = max(width, len(c))
                if weight:
                    weights.append(b.column(1)[k].as_py())
        if held:
            yield block()

    return p.where("codes is not null").select(*cols).mapInArrow(pack, "block long, n long, codes binary, w binary")


def tile_map(p: DataFrame, finish: Finish, schema: str, max_gap: int | None = None, min_gap: int = 1, weight: str | None = None, tile: int = TILE) -> DataFrame:
    """Rows that ``finish`` makes of each tile, for columns ``min_gap <= j - i <= max_gap`` apart.

    ``finish`` gets the columns i, the columns j and their joint counts, and
    returns the columns of ``schema``.
    """
    spark = p.sparkSession
    size = p.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("codes")), F.lit(0)).alias("length")).first()
    length, n_tiles = size["length"], -(-size["length"] // tile)
    far = length if max_gap is None else max_gap
    tiles = [(i, j) for i in range(n_tiles) for j in range(i, n_tiles) if (j - i - 1) * tile < far]
    workers = spark.sparkContext.defaultParallelism
    n_blocks = max(1, -(-size["n"] * max(1, length) // BLOCK_BYTES))
    few = n_blocks <= workers
    groups = min(len(tiles), -(-4 * workers // n_blocks)) if few else 1
    blocks = packed(p.repartition(n_blocks) if few else p, weight)
    if groups > 1:
        blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(4 * groups, "block", "group")
    else:
        blocks = blocks.withColumn("group", F.lit(0))
    kind = np.dtype(np.int64 if weight is None else np.float64)
    fields = [f.split()[0] for f in schema.split(",")]

    def columns(t: int) -> np.ndarray:
        return np.arange(t * tile, min(length, (t + 1) * tile))

    def finished(i: int, j: int, counts: np.ndarray):
        cells = finish(columns(i), columns(j), counts)
        if len(cells[fields[0]]):
            yield pa.RecordBatch.from_arrays([pa.array(cells[f]) for f in fields], names=fields)

    def counted(batches):
        for b in batches:
            for n, codes, w, group in zip(*(b.column(c).to_pylist() for c in ("n", "codes", "w", "group"))):
                x = np.frombuffer(codes, np.uint8).reshape(n, -1)
                x = np.pad(x, ((0, 0), (0, length - x.shape[1])), constant_values=ABSENT)
                weights = np.frombuffer(w, "<f8") if weight else None
                for i, j in tiles[group::groups]:
                    yield i, j, joint_counts(x[:, i * tile : (i + 1) * tile], x[:, j * tile : (j + 1) * tile], weights)

    if few and n_blocks == 1:
        return blocks.mapInArrow(lambda it: (r for i, j, c in counted(it) for r in finished(i, j, c)), schema)

    def partial(batches):
        for i, j, c in counted(batches):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([np.ascontiguousarray(c, kind).tobytes()], pa.binary())], names=["i", "j", "counts"])

    def summed(batches):
        key, total = None, None
        for b in batches:
            for i, j, counts in zip(*(c.to_pylist() for c in b.columns)):
                c = np.frombuffer(counts, kind).reshape(len(columns(i)), len(columns(j)), STATES, STATES)
                if (i, j) != key:
                    if key is not None:
                        yield from finished(*key, total)
                    key, total = (i, j), c.copy()
                else:
                    total += c
        if key is not None:
            yield from finished(*key, total)

    sums = blocks.mapInArrow(partial, "i int, j int, counts binary").repartition("i", "j").sortWithinPartitions("i", "j")
    return sums.mapInArrow(summed, schema)


def _apart(i: np.ndarray, j: np.ndarray, max_gap: int | None, min_gap: int) -> np.ndarray:
    gap = j[None, :] - i[:, None]
    return (gap >= min_gap) & (gap <= (gap.max(initial=0) if max_gap is None else max_gap))


def pair_counts(p: DataFrame, max_gap: int | None = None, min_gap: int = 1) -> DataFrame:
    """``(pos_i, pos_j, code_i, code_j, n)``: the rows of ``pairs.pair_counts``, by tiles."""

    def finish(i, j, counts):
        a, b, x, y = np.nonzero(counts * _apart(i, j, max_gap, min_gap)[:, :, None, None])
        return {"pos_i": i[a].astype(np.int32), "pos_j": j[b].astype(np.int32), "code_i": x.astype(np.int32), "code_j": y.astype(np.int32), "n": counts[a, b, x, y]}

    return tile_map(p, finish, "pos_i int, pos_j int, code_i int, code_j int, n long", max_gap, min_gap)


def _n_log_n(n: np.ndarray) -> np.ndarray:
    return n * np.log2(np.maximum(n, 1))


def information(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mutual information in bits, and the number of observations, of joint counts ``(..., a, b)``."""
    t = v.sum((-2, -1))
    both, one, other = _n_log_n(v).sum((-2, -1)), _n_log_n(v.sum(-1)).sum(-1), _n_log_n(v.sum(-2)).sum(-1)
    return np.log2(np.maximum(t, 1)) + (both - one - other) / np.maximum(t, 1), t


def mutual_information(p: DataFrame, max_gap: int | None = None, min_total: int = 10, min_gap: int = 1) -> DataFrame:
    """``(pos_i, pos_j, mi, n_obs)`` of all column pairs: ``pairs.mutual_information`` without its table of counts."""

    def finish(i, j, counts):
        mi, t = information(counts[:, :, : STATES - 1, : STATES - 1])
        a, b = np.nonzero(_apart(i, j, max_gap, min_gap) & (t > 0))
        return {"pos_i": i[a].astype(np.int32), "pos_j": j[b].astype(np.int32), "mi": np.where(t >= min_total, mi, 0.0)[a, b], "n_obs": t[a, b]}

    return tile_map(p, finish, "pos_i int, pos_j int, mi double, n_obs long", max_gap, min_gap).withColumn("mi", rounded(F.col("mi")))


def mutation_information(p: DataFrame, max_gap: int | None = None, min_total: int = 5, min_gap: int = 1, counts: DataFrame | None = None) -> DataFrame:
    """``(pos_i, pos_j, ref_i, ref_j, mi, n_obs)`` over the cells that are not the pair of references."""
    rows = majority(column_counts(p) if counts is None else counts).collect()  # a row a column
    ref = np.zeros(max((r["pos"] for r in rows), default=-1) + 1, np.intp)
    for r in rows:
        ref[r["pos"]] = r["ref_code"]

    def finish(i, j, c):
        v = c[:, :, : STATES - 1, : STATES - 1].copy()
        a, b = np.indices((len(i), len(j))).reshape(2, -1)
        v[a, b, ref[i][a], ref[j][b]] = 0
        mi, t = information(v)
        a, b = np.nonzero(_apart(i, j, max_gap, min_gap) & (t > 0))
        return {
            "pos_i": i[a].astype(np.int32), "pos_j": j[b].astype(np.int32), "ref_i": ref[i][a].astype(np.int32), "ref_j": ref[j][b].astype(np.int32),
            "mi": np.where(t >= min_total, mi, 0.0)[a, b], "n_obs": t[a, b],
        }

    return tile_map(p, finish, "pos_i int, pos_j int, ref_i int, ref_j int, mi double, n_obs long", max_gap, min_gap).withColumn("mi", rounded(F.col("mi")))


def coevolving_pairs(p: DataFrame, max_gap: int | None = None, min_mi: float = 0.1, min_muts: int = 5, min_entropy: float = 0.3) -> DataFrame:
    """Variable columns' pairs with more than ``min_mi`` over mutated cells, most informative first; the rows of ``pairs.coevolving_pairs``."""
    counts = checkpointed(column_counts(p))
    variable = F.broadcast(variable_positions(counts, min_entropy).select("pos"))  # a row a column at most
    mi = mutation_information(p, max_gap, min_muts, counts=counts).where(F.col("mi") > min_mi)
    for c in ("pos_i", "pos_j"):
        mi = mi.join(variable.withColumnRenamed("pos", c), c, "left_semi")
    # written before it is sorted, for a sort reads twice
    return checkpointed(mi.select("pos_i", "pos_j", "mi", "n_obs", "ref_i", "ref_j")).orderBy(F.desc("mi"), "pos_i", "pos_j")
