"""Tiles of wide alignments, the metric index, leaders in rounds and the spread inversion against plain ways."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from covarix.operators import columns, dca, graph, near, pairs, tiles
from covarix.shared import checkpointed


def profile(spark, rows, ids=None):
    return spark.createDataFrame([(i, r) for i, r in zip(range(len(rows)) if ids is None else ids, rows)], "seq_id long, codes array<int>")


def ragged(n, width, seed=0, states=6):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, states, width)
    rows = []
    for k in range(n):
        c = np.where(rng.random(width) < 0.5, base, rng.integers(0, states, width))
        c[rng.random(width) < 0.1] = 20
        rows.append(c[: width - k % 4 * 3].tolist())
    return rows


def as_set(df):
    return {tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in df.collect()}


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_tiles_give_the_pair_counts(spark, monkeypatch, block_bytes):
    """One block, and several whose tiles are summed in the shuffle."""
    monkeypatch.setattr(tiles, "BLOCK_BYTES", block_bytes)
    p = profile(spark, ragged(90, 37)).repartition(3)
    tile = 16
    for gap in (None, 5):
        want = as_set(pairs.pair_counts(p, gap or 37))
        monkeypatch.setattr(tiles, "TILE", tile)
        got = tiles.pair_counts(p, gap)
        assert got.count() == len(want) and as_set(got) == want


def test_information_of_all_pairs(spark):
    p = profile(spark, ragged(60, 30, 2))
    pc, counts = pairs.pair_counts(p, 30), columns.column_counts(p)
    near_equal = lambda a, b: a.keys() == b.keys() and all(a[k][1:] == b[k][1:] and a[k][0] == pytest.approx(b[k][0], abs=2e-6) for k in a)
    of = lambda df: {(r.pos_i, r.pos_j): (r.mi, r.n_obs) for r in df.collect()}
    assert near_equal(of(tiles.mutual_information(p)), of(pairs.mutual_information(pc)))
    refs = lambda df: {(r.pos_i, r.pos_j): (r.mi, r.n_obs, r.ref_i, r.ref_j) for r in df.collect()}
    assert near_equal(refs(tiles.mutation_information(p)), refs(pairs.mutation_information(pc, counts)))
    got, want = tiles.coevolving_pairs(p, 30).collect(), pairs.coevolving_pairs(p, 30).collect()
    assert len(got) == len(want) > 10 and [r.mi for r in got] == pytest.approx([r.mi for r in want], abs=2e-6)


def test_tiles_of_small_tables(spark):
    assert tiles.mutual_information(profile(spark, [])).count() == 0
    assert tiles.mutual_information(profile(spark, [[], [1]])).count() == 0
    one = tiles.pair_counts(profile(spark, [[1, 2], None, [1]])).collect()
    assert [tuple(r) for r in one] == [(0, 1, 1, 2, 1)]
    weird = tiles.pair_counts(profile(spark, [[1, 25], [-3, 2]]))
    assert as_set(weird) == {(0, 1, 1, 20, 1), (0, 1, 20, 2, 1)}


def test_joint_counts_of_weights():
    rng = np.random.default_rng(4)
    x, y, w = rng.integers(0, 22, (50, 3)).astype(np.uint8), rng.integers(0, 22, (50, 2)).astype(np.uint8), rng.random(50)
    got = tiles.joint_counts(x, y, w)
    for a, b, s, t in [(0, 0, 3, 4), (2, 1, 20, 20), (1, 0, 0, 7)]:
        assert got[a, b, s, t] == pytest.approx(w[(x[:, a] == s) & (y[:, b] == t)].sum())


# ---- the metric index ----
def clustered(n, width, seed=0, clusters=12):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 20, (clusters, width))
    rows = base[rng.integers(0, clusters, n)]
    change = rng.random((n, width)) < 0.06
    return np.where(change, rng.integers(0, 21, (n, width)), rows).tolist()


@pytest.mark.parametrize("rows", [clustered(250, 30, 1), ragged(120, 18, 3, 4), ragged(40, 9, 5, 2) + [[20] * 9] * 3 + [[]] * 2])
def test_near_pairs(spark, rows):
    got = {(r.seq_a, r.seq_b): (r.n_valid, r.hamming) for r in near.near_pairs(profile(spark, rows).repartition(4), 0.25).collect()}
    want = {}
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = [(x, y) for x, y in zip(rows[a], rows[b]) if x < 20 and y < 20]
            if both and (d := sum(x != y for x, y in both)) / len(both) <= 0.25:
                want[a, b] = (len(both), round(d / len(both), 6))
    assert got == want and want


def test_weights_compare_few_pairs_of_clusters(spark):
    rows = clustered(1200, 40, 2, 30)
    p = profile(spark, rows)
    items = checkpointed(dca.kinds(p).withColumn("item", F.monotonically_increasing_id()))
    n = items.count()
    assert near.comparisons(items, 0.2) < 0.15 * n * n / 2
    x = np.array(rows)
    count = [int((((x != row).sum(1)) <= 8).sum()) for row in x]
    got = {tuple(r.codes): r.weight for r in dca.weighted_kinds(p).collect()}
    assert got == pytest.approx({tuple(r): 1 / c for r, c in zip(rows, count)})


def test_one_cell_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 10)
    rng = np.random.default_rng(6)
    rows = np.where(rng.random((300, 12)) < 0.1, rng.integers(0, 3, (300, 12)), 1).tolist()
    assert len({tuple(r) for r in rows}) > 50
    x = np.array(rows)
    got = {tuple(r.codes): r.weight for r in dca.weighted_kinds(profile(spark, rows).repartition(5)).collect()}
    assert got == pytest.approx({tuple(r): 1 / int(((x != np.array(r)).sum(1) <= 2).sum()) for r in rows})


# ---- leaders ----
@pytest.mark.parametrize("first,most", [(1, 1), (7, 20), (256, 4096)])
def test_leaders_in_rounds(spark, monkeypatch, first, most):
    monkeypatch.setattr(graph, "FIRST", first)
    monkeypatch.setattr(graph, "MOST", most)
    rows = clustered(70 if most == 1 else 300, 20, 3, 8) + ragged(20, 20, 4) + [[20] * 20] * 2
    rows += rows[:5]
    ids = list(range(0, 10 * len(rows), 10))
    random.Random(1).shuffle(ids)
    want, leaders = {}, []
    for i, c in sorted(zip(ids, rows)):
        for lead in leaders:
            both = [(x, y) for x, y in zip(c, lead[1]) if x < 20 and y < 20]
            if both and sum(x != y for x, y in both) / len(both) < 0.2:
                break
        else:
            lead = (i, c)
            leaders.append(lead)
        want[i] = (leaders.index(lead), lead[0])
    got = {r.seq_id: (r.cluster, r.leader) for r in graph.leader_clusters(profile(spark, rows, ids).repartition(5), 0.2).collect()}
    assert got == want and len(leaders) > 8


# ---- the inversion on the executors ----
def test_negative_inverse_by_blocks(spark):
    rng = np.random.default_rng(0)
    sizes = [7, 7, 7, 4]
    m = rng.random((25, 25))
    a = m @ m.T + 0.1 * np.eye(25)
    at = np.cumsum([0, *sizes])
    blocks = [(i, j, a[at[i] : at[i + 1], at[j] : at[j + 1]].tobytes()) for i in range(4) for j in range(i, 4)]
    got = dca.negative_inverse(spark.createDataFrame(blocks, "i int, j int, data binary"), sizes).collect()
    want = -np.linalg.inv(a)
    assert len(got) == 10
    for r in got:
        assert np.allclose(np.frombuffer(r.data).reshape(sizes[r.i], sizes[r.j]), want[at[r.i] : at[r.i + 1], at[r.j] : at[r.j + 1]], atol=1e-8)


@pytest.mark.parametrize("panel", [128 << 20, 0])
def test_spread_scores_equal_the_dense_ones(spark, monkeypatch, panel):
    monkeypatch.setattr(dca, "PANEL_BYTES", panel)
    monkeypatch.setattr(dca, "COLUMNS", 4)
    p = profile(spark, ragged(80, 11, 7, 4))
    key = lambda r: (r.pos_i, r.pos_j)
    want = {key(r): tuple(r)[2:] for r in dca.scores(p, 11, spread=False).collect()}
    got = {key(r): tuple(r)[2:] for r in dca.scores(p, 11, spread=True).collect()}
    assert got.keys() == want.keys() and len(got) == 55 and all(got[k] == pytest.approx(want[k], abs=2e-5) for k in got)
