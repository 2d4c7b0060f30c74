"""Mean-field direct-coupling analysis.

Sequences count as distinct kinds with a multiplicity; near ones are found through
a metric index. The covariance matrix with pseudocounts is inverted exactly in
one of three ways. Of up to ``MAX_KINDS`` kinds on the driver: as it is, up to
``MAX_STATES`` rows, or, as it is a block-diagonal matrix plus one of the rank of
the number of kinds, through a matrix of that size (Woodbury), however many
columns there are. Of more kinds it is made in blocks of ``COLUMNS`` columns from
tiles of joint counts and swept block by block on the executors, without bound.
Scores of column pairs are then computed from blocks of couplings on the
executors, so couplings are never a table unless asked for.

Couplings are ``J = -C^-1``; direct information uses the weights ``exp(J)``, the
sign of the published mean-field method.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import rounded
from ..shared import checkpointed, release, sized
from . import near, tiles
from .pairs import PAIR

Q = 21
MAX_STATES = 4000
MAX_KINDS = 3000
BLOCK_COLUMNS = 16
COLUMNS = 50  # of a block that is swept: 8 MB
PANEL_BYTES = 128 << 20  # of a column of blocks that is broadcast
GAP = Q - 1


def kinds(p: DataFrame) -> DataFrame:
    """``(codes, m)``: distinct sequences and how many there are of each."""
    return p.groupBy("codes").agg(F.count("*").alias("m"))


def weighted_kinds(p: DataFrame, theta: float = 0.2) -> DataFrame:
    """``(codes, m, weight)``: one over the sequences within ``floor(theta * L)`` differences, copies and itself included."""
    k = checkpointed(kinds(p).withColumn("item", F.monotonically_increasing_id()))
    return k.join(near.neighbour_counts(k, theta), "item").select("codes", "m", (1.0 / F.col("near")).alias("weight"))


def weights(p: DataFrame, theta: float = 0.2) -> DataFrame:
    """``(seq_id, codes, weight)``: one over the sequences within ``floor(theta * L)`` differences, itself included."""
    each = checkpointed(weighted_kinds(p, theta))
    return p.join(sized(each.drop("m"), each.count(), 50_000), "codes").select("seq_id", "codes", "weight")


def effective_number(w: DataFrame) -> DataFrame:
    """``meff``: the sum of the weights of all sequences, from ``weighted_kinds``."""
    return w.agg(rounded(F.sum(F.col("weight") * F.col("m"))).alias("meff"))


@dataclass
class Dense:
    """Couplings from the whole inverse, ``(L, L, 20, 20)``."""

    j: np.ndarray
    f: np.ndarray

    def block(self, i: slice, k: slice) -> np.ndarray:
        return self.j[i, k]


@dataclass
class LowRank:
    """Couplings from the small inverse of the Woodbury identity.

    The covariance is D + U K U': D has equal diagonal blocks ``alpha I - beta 11'``,
    U has a column a kind (its one-hot code), one of ones and one of frequencies.
    """

    codes: np.ndarray
    f: np.ndarray
    inner: np.ndarray
    alpha: float
    beta: float

    def sides(self, at: slice) -> np.ndarray:
        """``D^-1 U`` for some columns: (columns, 20, kinds + 2)."""
        u = one_hot(self.codes[:, at], self.f[at])
        gamma = self.beta / (self.alpha - (Q - 1) * self.beta)
        return (u + gamma * u.sum(1, keepdims=True)) / self.alpha

    def block(self, i: slice, k: slice) -> np.ndarray:
        a, b = self.sides(i), self.sides(k)
        out = (a.reshape(-1, a.shape[2]) @ self.inner) @ b.reshape(-1, b.shape[2]).T
        return out.reshape(a.shape[0], Q - 1, b.shape[0], Q - 1).transpose(0, 2, 1, 3)


def one_hot(codes: np.ndarray, f: np.ndarray) -> np.ndarray:
    """(columns, 20, kinds + 2): one-hot codes without the gap, then ones and frequencies."""
    hot = (codes.T[:, None, :] == np.arange(Q - 1)[None, :, None]).astype(np.float64)
    return np.concatenate([hot, np.ones((*f.shape[:1], Q - 1, 1)), f[:, : Q - 1, None]], 2)


def solve(codes: np.ndarray, weight: np.ndarray, pseudo: float = 0.5, ridge: float = 1e-4, dense: bool | None = None) -> Dense | LowRank:
    """Couplings of kinds ``(kinds, L)`` with their total weights, the gap being state 20."""
    n, length = codes.shape
    share = weight / weight.sum()
    f = np.stack([np.bincount(codes[:, k], share, Q) for k in range(length)]) if length else np.zeros((0, Q))
    f = (1 - pseudo) * f + pseudo / Q
    beta = pseudo / Q**2
    if dense if dense is not None else (Q - 1) * length <= MAX_STATES:
        hot = one_hot(codes, f)[:, :, :n].reshape(length * (Q - 1), n)
        c = (1 - pseudo) * (hot * share) @ hot.T + beta
        own = np.arange(length * (Q - 1)).reshape(length, Q - 1)
        for k in range(length):
            c[np.ix_(own[k], own[k])] = np.diag(f[k, : Q - 1])
        flat = f[:, : Q - 1].ravel()
        c -= np.outer(flat, flat)
        j = -np.linalg.inv(c + ridge * np.eye(len(c)))
        return Dense(j.reshape(length, Q - 1, length, Q - 1).transpose(0, 2, 1, 3), f)
    out = LowRank(codes, f, np.zeros(0), pseudo / Q + ridge, beta)
    g = np.zeros((n + 2, n + 2))
    for at in range(0, length, BLOCK_COLUMNS):
        part = slice(at, at + BLOCK_COLUMNS)
        u, v = one_hot(codes[:, part], f[part]), out.sides(part)
        g += u.reshape(-1, n + 2).T @ v.reshape(-1, n + 2)
    g[np.diag_indices(n + 2)] += np.concatenate([1 / ((1 - pseudo) * share), [1 / beta, -1.0]])
    out.inner = np.linalg.inv(g)
    return out


def direct_information(j: np.ndarray, fi: np.ndarray, fj: np.ndarray, rounds: int = 200, eps: float = 4e-5) -> np.ndarray:
    """Direct information of pairs ``(n, 20, 20)`` by fixed-point iteration of their two fields; each pair stops by itself."""
    n = len(j)
    w = np.ones((n, Q, Q))
    w[:, : Q - 1, : Q - 1] = np.exp(j)
    mi, mj = np.full((n, Q), 1 / Q), np.full((n, Q), 1 / Q)
    left = np.arange(n)
    for _ in range(rounds):
        if not len(left):
            break
        x = w[left]
        ni = fi[left] / np.einsum("nab,nb->na", x, mj[left])
        nj = fj[left] / np.einsum("nab,na->nb", x, mi[left])
        ni, nj = ni / ni.sum(1, keepdims=True), nj / nj.sum(1, keepdims=True)
        change = np.maximum(abs(ni - mi[left]).max(1), abs(nj - mj[left]).max(1))
        mi[left], mj[left] = ni, nj
        left = left[change >= eps]
    joint = w * mi[:, :, None] * mj[:, None]
    joint /= joint.sum((1, 2), keepdims=True)
    tiny = 1e-100
    return (joint * np.log((joint + tiny) / (fi[:, :, None] * fj[:, None] + tiny))).sum((1, 2))


def covariance_tiles(w: DataFrame, f: np.ndarray, total: float, pseudo: float, ridge: float, columns: int) -> DataFrame:
    """``(i, j, data)``, i <= j: the covariance of the states of ``columns`` by ``columns`` columns, from weighted joint counts."""

    def finish(x, y, counts):
        c = (1 - pseudo) * counts / total + pseudo / Q**2
        a, b = np.nonzero(x[:, None] == y[None, :])
        c[a, b] = f[x[a], :, None] * np.eye(Q)
        c -= f[x][:, None, :, None] * f[y][None, :, None, :]
        flat = c[:, :, : Q - 1, : Q - 1].transpose(0, 2, 1, 3).reshape(len(x) * (Q - 1), -1)
        if x[0] == y[0]:
            flat = flat + ridge * np.eye(len(flat))
        return {"i": np.array([x[0] // columns], np.int32), "j": np.array([y[0] // columns], np.int32), "data": [np.ascontiguousarray(flat).tobytes()]}

    return tiles.tile_map(w.select("codes", "w"), finish, "i int, j int, data binary", min_gap=0, weight="w", tile=columns)


def negative_inverse(blocks: DataFrame, sizes: list[int]) -> DataFrame:
    """``-A^-1`` of a symmetric positive matrix in blocks ``(i, j, data)``, i <= j, of given sizes; again such blocks.

    Sweeps one diagonal block after the other: with P the inverse of block (k, k)
    and X_r the block (r, k), every block (i, j) becomes A - X_i P X_j', row and
    column k become P A and A P, and (k, k) becomes -P. Each step is one pass over
    all blocks, written to the checkpoint folder; the driver sees one block.
    """
    spark = blocks.sparkSession
    blocks = checkpointed(blocks)

    def invert(batches):
        for b in batches:
            for data in b.column("data").to_pylist():
                n = int((len(data) // 8) ** 0.5)
                yield pa.RecordBatch.from_arrays([pa.array([np.linalg.inv(np.frombuffer(data).reshape(n, n)).tobytes()], pa.binary())], names=["data"])

    for k in range(len(sizes)):
        d = blocks.where(f"i = {k} AND j = {k}").select("data").mapInArrow(invert, "data binary").first()["data"]
        inverse = spark.sparkContext.broadcast(np.frombuffer(d).reshape(sizes[k], sizes[k]))

        def step(batches, k=k, inverse=inverse):
            def side(r, data):
                return np.frombuffer(data).reshape(sizes[r], sizes[k]) if r < k else np.frombuffer(data).reshape(sizes[k], sizes[r]).T

            p = inverse.value
            for b in batches:
                for i, j, data, x, y in zip(*(c.to_pylist() for c in b.columns)):
                    a = np.frombuffer(data).reshape(sizes[i], sizes[j])
                    new = -p if i == j == k else p @ a if i == k else a @ p if j == k else a - side(i, x) @ p @ side(j, y).T
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([np.ascontiguousarray(new).tobytes()], pa.binary())], names=["i", "j", "data"])

        panel = blocks.where(f"(i = {k}) <> (j = {k})").select(F.when(F.col("i") == k, F.col("j")).otherwise(F.col("i")).alias("r"), "data")
        if 8 * sum(sizes) * sizes[k] <= PANEL_BYTES:
            panel = F.broadcast(panel)
        met = blocks.join(panel.toDF("i", "x"), "i", "left").join(panel.toDF("j", "y"), "j", "left").select("i", "j", "data", "x", "y")
        old, blocks = blocks, checkpointed(met.mapInArrow(step, "i int, j int, data binary"))
        release(old)
        inverse.unpersist()
    return blocks


def _cut(p: DataFrame, length: int) -> DataFrame:
    """The first ``length`` columns; shorter sequences end in gaps."""
    return p.select("seq_id", F.slice(F.concat("codes", F.array_repeat(F.lit(GAP), length)), 1, length).alias("codes"))


def _frequencies(w: DataFrame, length: int) -> tuple[np.ndarray, float]:
    """Weighted counts of each column's codes, a row a column, and their total."""
    f = np.zeros((length, Q))
    for r in w.select("w", F.posexplode("codes").alias("pos", "code")).groupBy("pos", "code").agg(F.sum("w").alias("w")).collect():
        f[r["pos"], r["code"]] = r["w"]
    return f, f[0].sum() if length else 0.0


def _cells(p: DataFrame, length: int) -> DataFrame:
    """``(i, k)``: blocks of columns, each pair of blocks once, spread over the tasks."""
    n = -(-length // BLOCK_COLUMNS)
    one = p.sparkSession.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("k")).where("i <= k")
    return one.repartition(max(1, min(n * (n + 1) // 2, 2000)))


def couplings(p: DataFrame, length: int, theta: float = 0.2, pseudo: float = 0.5, ridge: float = 1e-4, dense: bool | None = None, spread: bool | None = None) -> DataFrame:
    """``(pos_i, pos_j, a, b, j)``: 400 rows a column pair, the gap left out."""
    return _by_block(p, length, "pos_i int, pos_j int, a int, b int, j double", _coupling_rows, theta, pseudo, ridge, dense, spread)


def _coupling_rows(i, k, j, fi, fj):
    n = len(i)
    a, b = np.indices((Q - 1, Q - 1)).reshape(2, -1)
    return pd.DataFrame({"pos_i": np.repeat(i, len(a)), "pos_j": np.repeat(k, len(a)), "a": np.tile(a, n), "b": np.tile(b, n), "j": j.reshape(-1)})


def _score_rows(i, k, j, fi, fj):
    return pd.DataFrame({"pos_i": i, "pos_j": k, "score": np.sqrt((j**2).sum((1, 2))), "di": direct_information(j, fi, fj)})


def _by_block(p: DataFrame, length: int, schema: str, rows, theta: float, pseudo: float, ridge: float, dense: bool | None, spread: bool | None = None) -> DataFrame:
    spark = p.sparkSession
    w = checkpointed(weighted_kinds(_cut(p, length), theta).select("codes", (F.col("m") * F.col("weight")).alias("w")))
    if not (n := w.count()) or not length:
        return spark.createDataFrame([], schema)

    def scored(j, x, y, f):
        pi, pk = (z.ravel() for z in np.meshgrid(x, y, indexing="ij"))
        use = pi < pk
        if use.any():
            yield rows(pi[use], pk[use], j.reshape(-1, Q - 1, Q - 1)[use], f[pi[use]], f[pk[use]])

    if n > MAX_KINDS if spread is None else spread:
        counts, total = _frequencies(w, length)
        f = (1 - pseudo) * counts / total + pseudo / Q
        sizes = [(Q - 1) * min(COLUMNS, length - at) for at in range(0, length, COLUMNS)]
        step = COLUMNS

        def from_blocks(batches):
            for b in batches:
                for i, k, data in zip(b["i"], b["j"], b["data"]):
                    x, y = (np.arange(z * step, min(length, (z + 1) * step)) for z in (i, k))
                    yield from scored(np.frombuffer(data).reshape(len(x), Q - 1, len(y), Q - 1).transpose(0, 2, 1, 3), x, y, f)

        return negative_inverse(covariance_tiles(w, f, total, pseudo, ridge, step), sizes).mapInPandas(from_blocks, schema)
    held = w.toArrow()  # at most MAX_KINDS
    codes = np.stack(held.column("codes").to_numpy()).astype(np.int64)
    order = np.lexsort(codes.T)
    shared = spark.sparkContext.broadcast(solve(codes[order], held.column("w").to_numpy()[order], pseudo, ridge, dense))  # bounded by MAX_STATES or MAX_KINDS

    def run(batches):
        for b in batches:
            for i, k in zip(b["i"], b["k"]):
                x, y = (slice(z * BLOCK_COLUMNS, min(length, (z + 1) * BLOCK_COLUMNS)) for z in (i, k))
                yield from scored(shared.value.block(x, y), np.arange(x.start, x.stop), np.arange(y.start, y.stop), shared.value.f)

    return _cells(p, length).mapInPandas(run, schema)


def average_product(f: DataFrame, length: int) -> DataFrame:
    """``score - Fi Fj / F`` with means over full rows, the zero diagonal included."""
    both = f.unionByName(f.select(F.col("pos_j").alias("pos_i"), F.col("pos_i").alias("pos_j"), "score"))
    row = both.groupBy("pos_i").agg((F.sum("score") / length).alias("m"))
    whole = both.agg((F.sum("score") / (length * length)).alias("all"))
    out = f.join(row.toDF("pos_i", "mi"), "pos_i").join(row.toDF("pos_j", "mj"), "pos_j").crossJoin(F.broadcast(whole))
    return out.select(*PAIR, (F.col("score") - F.col("mi") * F.col("mj") / F.col("all")).alias("score"))


def scores(p: DataFrame, length: int, theta: float = 0.2, pseudo: float = 0.5, ridge: float = 1e-4, dense: bool | None = None, spread: bool | None = None) -> DataFrame:
    """``(pos_i, pos_j, frobenius, apc, di)`` of every pair of the first ``length`` columns."""
    f = checkpointed(_by_block(p, length, "pos_i int, pos_j int, score double, di double", _score_rows, theta, pseudo, ridge, dense, spread))
    apc = average_product(f.drop("di"), length).withColumnRenamed("score", "c")
    return f.join(apc, PAIR).select(*PAIR, rounded(F.col("score"), 5).alias("frobenius"), rounded(F.col("c"), 5).alias("apc"), rounded(F.col("di"), 5).alias("di"))


def top_scores(s: DataFrame, by: str, k: int = 20) -> DataFrame:
    """The ``k`` best pairs by one score, with their ranks from 1."""
    best = s.orderBy(F.desc(by), *PAIR).limit(k).agg(F.sort_array(F.collect_list(F.struct(F.col(by).alias("by"), *((-F.col(c)).alias(c) for c in PAIR), F.struct(*s.columns).alias("row"))), asc=False).alias("rows"))
    return best.select(F.posexplode("rows").alias("rank", "x")).select("x.row.*", (F.col("rank") + 1).alias("rank"))
