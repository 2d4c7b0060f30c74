"""Micro fixtures and properties of the operators."""

import collections
import decimal
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from covarix import shared
from covarix.functions import encoding as enc
from covarix.operators import boolean, columns, dca, graph, kmer, pairs, predict, ranking, spectral
from covarix.plans import reports
from covarix.sources import readers, sinks
from covarix.streaming import counts as streaming


def profile(spark, rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "seq_id long, codes array<int>")


def noise(n, length, seed=0, gap=True):
    rng = random.Random(seed)
    return [[rng.choice([0, 1, 2, 3, 5, 20] if gap else [0, 1, 2, 3]) for _ in range(length)] for _ in range(n)]


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_text("; note\n>A1 | first one\nac d\n\n-X\n>\nAV\n>B2 x\r\nIL\r\n")
    got = {r.seq_id: r for r in readers.read_fasta(spark, str(path)).collect()}
    assert [got[i].sequence for i in sorted(got)] == ["AC D-X", "AV", "IL"]
    assert [got[i].accession for i in sorted(got)] == ["A1", "", "B2"]
    assert got[0].description == "first one"
    p = {r.seq_id: r.codes for r in readers.profiles(readers.read_fasta(spark, str(path))).collect()}
    assert p[1] == [0, 3] and p[0][4:] == [20, 20]
    loose = {r.seq_id: r.codes for r in readers.profiles(readers.read_fasta(spark, str(path)), aligned=False).collect()}
    assert 20 not in loose[0]


def test_codes_round_trip(spark):
    df = spark.createDataFrame([(enc.BASE20.lower() + "-ßBé",), ("",), (None,)], "s string").select(enc.codes_of(F.col("s")).alias("c"))
    got = [r.c for r in df.collect()]
    assert got == [[*range(20), 20, 20, 20, 20], [], []]
    back = spark.range(22).select(enc.letter_of(F.col("id").cast("int")).alias("l")).collect()
    assert "".join(r.l for r in back) == enc.BASE20 + "--"


def test_scalars(spark):
    r = spark.range(1).select(
        enc.sigmoid(F.lit(50.0)).alias("s"), enc.gray_distance(F.lit(3), F.lit(4)).alias("g"), enc.kmer_cell(F.lit(1), F.lit(2), F.lit(3)).alias("k"),
        enc.bit(F.lit(512), 0).alias("b"), enc.region(F.lit(320)).alias("r"), enc.distances(F.array(F.lit(0), F.lit(1)), F.array(F.lit(1))).alias("d"), enc.signature_cell(F.lit(0), F.lit(20)).alias("c"),
    ).first()
    assert r.s == pytest.approx(1 / (1 + math.exp(-10))) and (r.g, r.k, r.b, r.r, r.d, r.c) == (1, 443, 1, "RBD", [1], 20)


def test_information_bounds(spark):
    p = profile(spark, noise(60, 4))
    pc = pairs.pair_counts(p, 3).cache()
    mi = {(r.pos_i, r.pos_j): r.mi for r in pairs.mutual_information(pc, 1).collect()}
    assert all(v >= 0 for v in mi.values()) and len(mi) == 6
    same = profile(spark, [[c, c] for c in [0, 1, 2, 3] * 5])
    assert pairs.mutual_information(pairs.pair_counts(same, 1)).first().mi == 2.0
    assert pairs.mutual_information(pairs.pair_counts(same.limit(8), 1), 10).first().mi == 0.0


def test_gap_limits(spark):
    p = profile(spark, noise(5, 6))
    got = {(r.pos_i, r.pos_j) for r in pairs.pair_counts(p, 3, 2).collect()}
    assert got == {(i, j) for i in range(6) for j in range(6) if 2 <= j - i <= 3}


def test_empty_and_gap_columns(spark):
    p = profile(spark, [[20, 0], [20, 0]])
    c = columns.column_counts(p)
    assert {(r.pos, r.entropy, r.n_valid) for r in columns.column_entropy(c).collect()} == {(0, 0.0, 0), (1, 0.0, 2)}
    assert {(r.pos, r.ref_code, r.ref_n) for r in columns.majority(c).collect()} == {(0, 0, 0), (1, 0, 2)}
    assert columns.column_entropy(columns.column_counts(profile(spark, []))).count() == 0


def test_majority_tie_goes_to_lowest(spark):
    c = columns.column_counts(profile(spark, [[5], [2], [5], [2], [20], [20], [20]]))
    assert columns.majority(c).first().ref_code == 2


def brute_primes(on, dc, bits):
    allowed = set(on) | set(dc)
    cubes = []
    for m in range(1 << bits):
        for v in range(1 << bits):
            if v & m == 0:
                cells = {c for c in range(1 << bits) if (c ^ v) & ~m == 0}
                if cells <= allowed:
                    cubes.append((v, m, cells))
    return sorted((v, m) for v, m, cells in cubes if cells & set(on) and not any(cells < other for _, _, other in cubes))


def test_prime_implicants_match_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        cells = list(range(16))
        rng.shuffle(cells)
        on, dc = cells[: rng.randint(0, 8)], cells[8 : 8 + rng.randint(0, 5)]
        assert boolean.prime_implicants(on, dc, 4) == brute_primes(on, dc, 4)
        found = boolean.minimise(on, dc, 4)
        covered = {c for f in found if f["in_cover"] for c in f["coverage"]}
        assert covered == set(on)
        assert all(f["in_cover"] for f in found if f["is_core_essential"])


def test_map_size_guard():
    assert boolean.check_size(1024) == 10
    for bad in (0, 2, 400, 512):
        with pytest.raises(ValueError):
            boolean.check_size(bad)


def test_map_differences(spark):
    maps = spark.createDataFrame([(0, 0, 1), (0, 1, -1), (0, 2, 0), (1, 0, 0), (1, 1, 1), (1, 2, 0), (1, 3, 1)], "map_id int, cell int, state int")
    assert [tuple(r) for r in boolean.map_differences(maps).collect()] == [(0, 1, 1)]


def test_rules(spark):
    rows = [[0, 0]] * 20 + [[1, 2]] * 6 + [[3, 5]] * 5
    p = profile(spark, rows)
    c, pc = columns.column_counts(p), pairs.pair_counts(p, 1)
    got = boolean.rules(pairs.mutation_information(pc, c), boolean.mutation_map(pc, c)).collect()
    assert got and all(len(r.expr) for r in got)
    seen = boolean.mutation_map(pc, c).where("state = 1")
    verdict = {r.seq_id: r.verdict for r in boolean.classify(p, seen.where("n > 5"), seen.where("n <= 5")).collect()}
    assert verdict[0] == "unclassified" and verdict[20] == "positive" and verdict[26] == "forbidden"
    assert boolean.rules_by_k(boolean.rules(pairs.mutation_information(pc, c), boolean.mutation_map(pc, c))).collect()[-1].n_rules == len(got)


def test_walsh_hadamard_inverts_itself(spark):
    v = spark.createDataFrame([(0, 1.0), (2, 1.0)], "i int, v double")
    once = spectral.walsh_hadamard(v, 2)
    assert {r.k: r.coefficient for r in once.collect()} == {0: 2.0, 1: 2.0, 2: 0.0, 3: 0.0}
    twice = spectral.walsh_hadamard(once.select(F.col("k").alias("i"), F.col("coefficient").alias("v")), 2)
    assert {r.k: r.coefficient for r in twice.collect()} == {0: 4.0, 1: 0.0, 2: 4.0, 3: 0.0}


def test_leave_one_out_equals_rebuilding(spark):
    rows = noise(40, 2, seed=5)
    p = profile(spark, rows)
    got = predict.leave_one_out(pairs.pair_counts(p, 1), columns.column_counts(p)).first()
    ref = [min((x for x in range(20)), key=lambda x: (-sum(r[k] == x for r in rows), x)) for k in (0, 1)]
    test = right = 0
    for k, (a, truth) in enumerate(rows):
        if 20 in (a, truth) or [a, truth] == ref:
            continue
        rest = [r for i, r in enumerate(rows) if i != k and 20 not in r]
        marginal = {b: sum(r[1] == b for r in rest) for b in range(20)}
        score = {b: sum(r == [a, b] for r in rest) / marginal[b] for b in range(20) if marginal[b]}
        score = {b: s for b, s in score.items() if s}
        test += 1
        right += bool(score) and min(score, key=lambda b: (-score[b], b)) == truth
    assert (got.n_test, got.n_correct) == (test, right)


def test_sequence_distances_spread_over_tasks(spark):
    """As many tasks as the pairs need, and the distances of plain loops."""
    many = spark.range(3000).select(F.col("id").alias("seq_id"), F.array((F.col("id") % 20).cast("int"), (F.col("id") % 7).cast("int")).alias("codes"))
    assert graph.sequence_distances(many).rdd.getNumPartitions() > 8
    rng = random.Random(5)
    rows = [[rng.randrange(21) for _ in range(rng.choice((0, 3, 64, 64, 130)))] for _ in range(90)]
    p = profile(spark, rows)
    p = p.unionByName(p.where("seq_id = 7")).repartition(3)
    want = collections.Counter()
    for a, b in itertools.combinations(range(90), 2):
        z = [(x, y) for x, y in zip(rows[a], rows[b]) if max(x, y) < 20]
        up = lambda x: float(decimal.Decimal(repr(x / len(z))).quantize(decimal.Decimal("1e-6"), decimal.ROUND_HALF_UP))
        found = (up(sum(x != y for x, y in z)), up(sum(((x ^ x >> 1) ^ (y ^ y >> 1)).bit_count() for x, y in z))) if z else (1.0, None)
        want[(a, b, *found)] += 1 + (7 in (a, b))
    for size in (20, 512):
        assert collections.Counter(map(tuple, graph.sequence_distances(p, size).collect())) == want


def test_sequence_distances_tasks_grow_with_the_pairs(spark):
    """Tasks have millions of pairs; before, 40,000 sequences made 1,580."""
    many = spark.range(40_000).select(F.col("id").alias("seq_id"), F.array((F.col("id") % 20).cast("int"), (F.col("id") % 7).cast("int")).alias("codes"))
    assert 64 <= graph.sequence_distances(many).rdd.getNumPartitions() <= 128


def test_large_blocks_of_distances_meet_in_tiles(spark):
    """Looked-up distances and computed ones, in 32 and 64 bits, of blocks larger than a tile."""
    rng = np.random.default_rng(11)
    for width in (0, 8, 70, 800):
        x, y = (rng.integers(0, 21, (k, width)).astype(np.uint8) for k in (70, graph.TILE + 9))
        ids = rng.permutation(len(x) + len(y) - 1)
        ai, bi = ids[: len(x)], np.concatenate([ids[len(x) :], ids[-1:]])  # the last two are one id
        for first, second, same in (((ai, x), (bi, y), False), ((bi, y), (ai, x), False), ((bi, y), (bi, y), True)):
            met = spark.createDataFrame(pa.Table.from_batches(graph._block_distances(*first, *second, same)))
            got = collections.Counter(map(tuple, graph._unpacked(met).collect()))
            z = (first[1][:, None] < 20) & (second[1][None] < 20)
            codes = [c ^ c >> 1 for c in (first[1][:, None], second[1][None])]
            n, apart, gray = z.sum(2), ((codes[0] != codes[1]) & z).sum(2), (np.bitwise_count(codes[0] ^ codes[1]) * z).sum(2)
            up = lambda k, m: (2_000_000 * int(k) + int(m)) // (2 * int(m)) / 1e6
            want = collections.Counter()
            for i, a in enumerate(first[0].tolist()):
                for j, b in enumerate(second[0].tolist()):
                    if a < b if same else a != b:
                        want[(min(a, b), max(a, b), *((up(apart[i, j], n[i, j]), up(gray[i, j], n[i, j])) if n[i, j] else (1.0, None)))] += 1
            assert got == want


def test_sequence_pairs_are_all_pairs(spark):
    p = profile(spark, noise(25, 3))
    got = {(r.seq_a, r.seq_b) for r in graph.sequence_pairs(p, block_rows=4).collect()}
    assert got == set(itertools.combinations(range(25), 2))


def test_components(spark):
    mi = spark.createDataFrame([(0, 1, 2.0), (1, 5, 2.0), (3, 4, 1.5), (6, 7, 0.5)], "pos_i int, pos_j int, mi double")
    assert {r.pos: r.component for r in graph.components(mi).collect()} == {0: 0, 1: 0, 5: 0, 3: 3, 4: 3}


def test_leaders_depend_on_order(spark):
    p = profile(spark, [[0] * 10, [0] * 9 + [1], [1] * 10])
    assert [r.cluster for r in graph.leader_clusters(p, 0.2).orderBy("seq_id").collect()] == [0, 0, 1]


def test_every_sequence_has_a_leader(spark):
    rng = np.random.default_rng(3)
    codes = [rng.integers(0, 21 if i % 3 else 3, 6 + i % 3).tolist() for i in range(500)] + [[20] * 6] * 3
    want, leaders = [], []
    for i, c in enumerate(codes):
        for k, lead in enumerate(leaders):
            both = [(x, y) for x, y in zip(c, codes[lead]) if x < 20 and y < 20]
            if both and sum(x != y for x, y in both) / len(both) < 0.4:
                break
        else:
            k, lead = len(leaders), i
            leaders.append(i)
        want.append((i, k, lead))
    p = profile(spark, codes).repartition(5)
    assert sorted(map(tuple, graph.leader_clusters(p, 0.4).collect())) == want and len(leaders) > 64


def test_direct_couplings_find_the_coupled_pair(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(120):
        a, b = rng.randrange(4), rng.randrange(4)
        rows.append([a, b, a])
    s = {(r.pos_i, r.pos_j): r for r in dca.scores(profile(spark, rows), 3).collect()}
    for by in ("frobenius", "apc", "di"):
        assert max(s, key=lambda k: s[k][by]) == (0, 2)
    w = dca.weights(profile(spark, [[0] * 10] * 3 + [[1] * 10]))
    assert sorted(round(r.weight, 6) for r in w.collect()) == [0.333333] * 3 + [1.0]


def dense_couplings(codes, weight, pseudo=0.5, ridge=1e-4):
    """Covariance by loops over column pairs, then one inverse."""
    codes, share = np.array(codes), np.array(weight) / sum(weight)
    n, length = codes.shape
    p = np.array([[(1 - pseudo) * share[codes[:, i] == a].sum() + pseudo / 21 for a in range(21)] for i in range(length)])
    c = np.zeros((20 * length, 20 * length))
    for i in range(length):
        for j in range(length):
            for a in range(20):
                for b in range(20):
                    both = share[(codes[:, i] == a) & (codes[:, j] == b)].sum()
                    pij = (1 - pseudo) * both + pseudo / 441 if i != j else p[i, a] * (a == b)
                    c[20 * i + a, 20 * j + b] = pij - p[i, a] * p[j, b]
    return -np.linalg.inv(c + ridge * np.eye(20 * length)), p


def test_couplings_against_loops_by_both_inversions(spark):
    rng = random.Random(5)
    rows = [[rng.choice([0, 1, 4, 20]) for _ in range(4)] for _ in range(30)] + [[0, 1, 4, 20]] * 3
    near = lambda x: sum(sum(a != b for a, b in zip(x, y)) <= int(0.3 * 4) for y in rows)
    weight = [1 / near(x) for x in rows]
    w = {tuple(r.codes): r.weight for r in dca.weighted_kinds(profile(spark, rows), 0.3).collect()}
    assert w == pytest.approx({tuple(x): v for x, v in zip(rows, weight)})
    want, f = dense_couplings(rows, weight)
    for dense in (True, False):
        got = dca.couplings(profile(spark, rows), 4, theta=0.3, dense=dense).collect()
        assert len(got) == 6 * 400
        assert all(r.j == pytest.approx(want[20 * r.pos_i + r.a, 20 * r.pos_j + r.b], abs=1e-6) for r in got)
    s = {(r.pos_i, r.pos_j): r for r in dca.scores(profile(spark, rows), 4, theta=0.3).collect()}
    blocks = {(i, j): want[20 * i : 20 * i + 20, 20 * j : 20 * j + 20] for i in range(4) for j in range(4)}
    fro = {k: np.sqrt((v**2).sum()) * (k[0] != k[1]) for k, v in blocks.items()}
    mean = [sum(fro[i, j] for j in range(4)) / 4 for i in range(4)]
    for (i, j), r in s.items():
        assert r.frobenius == pytest.approx(fro[i, j], abs=2e-5) and r.apc == pytest.approx(fro[i, j] - mean[i] * mean[j] / (sum(mean) / 4), abs=2e-5)
        x = np.ones((21, 21))
        x[:20, :20] = np.exp(blocks[i, j])
        a = b = np.full(21, 1 / 21)
        for _ in range(500):
            a, b = f[i] / (x @ b), f[j] / (x.T @ a)
            a, b = a / a.sum(), b / b.sum()
        q = x * np.outer(a, b)
        q /= q.sum()
        assert r.di == pytest.approx((q * np.log(q / np.outer(f[i], f[j]))).sum(), abs=2e-3)
    top = dca.top_scores(dca.scores(profile(spark, rows), 4, theta=0.3), "apc", 3).collect()
    assert [(r.pos_i, r.pos_j) for r in top] == sorted(s, key=lambda k: (-s[k].apc, k))[:3] and [r.rank for r in top] == [1, 2, 3]


def test_many_kinds_need_no_driver(spark, monkeypatch):
    p = profile(spark, noise(60, 3, seed=1))
    want = sorted(map(tuple, dca.scores(p, 3).collect()))
    monkeypatch.setattr(dca, "MAX_KINDS", 5)
    got = sorted(map(tuple, dca.scores(p, 3).collect()))
    assert len(got) == 3 and all(x == pytest.approx(y, abs=2e-5) for x, y in zip(got, want))
    monkeypatch.setattr(dca, "MAX_STATES", 5)
    assert sorted(map(tuple, dca.scores(p, 3).collect())) == got


def test_distances_of_maps(spark):
    m = spark.createDataFrame([(0, 1, 3.0), (1, 2, 4.0), (2, 1, 3.0)], "map_id int, cell int, value double")
    d = {(r.map_a, r.map_b): r.distance for r in graph.map_distances(m).collect()}
    assert d == {(0, 1): 5.0, (0, 2): 0.0, (1, 2): 5.0}


def test_kmers_skip_gaps(spark):
    p = profile(spark, [[0, 1, 2, 20, 3], [], [4]])
    assert {r.cell: r.n for r in kmer.kmer_map(kmer.kmer_counts(p, 3), 3).collect()} == {22: 1}
    assert {(r.c0, r.c1) for r in kmer.adjacent_counts(p).collect()} == {(0, 1), (1, 2), (2, 20), (20, 3)}


def test_counts_of_texts_equal_those_of_profiles(spark):
    texts = ["", None, "A", "ac-DéX🙂a", "aAaA", "é", "VV", "", "ILV" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, sequence string")
    p = readers.profiles(df)
    for k in (1, 2, 3, 5):
        for parts in (1, 3):
            got = sorted(map(tuple, kmer.text_counts(df.repartition(parts, "seq_id"), k).collect()))
            assert got == sorted(map(tuple, kmer.kmer_counts(p, k).collect()))
    assert kmer.text_counts(df.limit(0), 2).count() == 0


class _Step(Exception):
    """Stands for a table whose ``mapInArrow`` hands over the function of a task."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        raise self


def _count_task(k):
    with pytest.raises(_Step) as step:
        kmer.text_counts(_Step(), k)
    return lambda texts: [r for b in step.value.run(iter([pa.RecordBatch.from_arrays([texts], names=["sequence"])])) for r in zip(*(c.to_pylist() for c in b.columns))]


def test_counting_texts_takes_bounded_memory():
    """Long batches and single long texts are coded a piece at a time."""
    import tracemalloc

    for texts in (["ACDEFGHIKLMNPQRSTVWY " * 200] * 4_000, ["ACDEFGHIKLMNPQRSTVWY " * 800_000]):
        held = pa.array(texts)
        tracemalloc.start()
        found = _count_task(2)(held)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(n for _, n in found) == sum(len(t) - 1 for t in texts)
        assert peak < 64 << 20


def test_pieces_of_texts_lose_no_run(monkeypatch):
    texts = ["", None, "A", "ac-DéX🙂a", "aAaA", "é", "VV", "", "🙂", "ILV" * 9, ""]
    table = kmer._code_table(enc.BASE20)
    codes = [[enc.BASE20.find(c.upper()) if c.isascii() and c.upper() in enc.BASE20 else 20 for c in t or ""] for t in texts]
    maps = kmer.batch_maps(pa.array(texts), table)
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(kmer, "PIECE", size)
        for k in (1, 2, 3, 5):
            want = collections.Counter(sum(x * 21 ** (k - 1 - i) for i, x in enumerate(c[at : at + k])) for c in codes for at in range(len(c) - k + 1))
            got = collections.Counter()
            for cell, n in _count_task(k)(pa.array(["zz", *texts, "zz"])[1:-1]):
                got[cell] += n
            assert got == want
        for a, b in zip(kmer.batch_maps(pa.array(texts), table), maps):
            assert (a == b).all()
        for row, c in enumerate(codes):
            assert maps[0][row].tolist() == [c.count(x) for x in range(20)]
            assert {(x, y): maps[1][row, x, y] for x, y in zip(*np.nonzero(maps[1][row]))} == collections.Counter((x, y) for x, y in zip(c, c[1:]) if max(x, y) < 20)


def test_signatures_and_consensus_by_hand(spark):
    df = spark.createDataFrame([(0, "GCGC"), (1, None), (2, "A-A"), (3, "--"), (4, "aé"), (5, "AI")], "seq_id long, sequence string").repartition(2)
    got = {r.seq_id: (r.length, r.gc_share, r.entropy, r.map_norm) for r in kmer.signatures(df).collect()}
    assert got == {0: (4, 1.0, 1.0, round(math.sqrt(5), 6)), 2: (2, 0.0, 0.0, 0.0), 4: (1, 0.0, 0.0, 0.0), 5: (2, 0.0, 1.0, 1.0)}
    g, c, a, i = (enc.BASE20.index(x) for x in "GCAI")
    cell = lambda x, y: (x ^ x >> 1) * 32 + (y ^ y >> 1)
    assert {r.cell: r.freq for r in kmer.consensus_map(df).collect()} == {cell(g, c): round(1 / 3, 9), cell(c, g): round(1 / 6, 9), cell(a, i): 0.5}


def test_counts_from_one_scan(spark):
    p = profile(spark, noise(40, 5))
    pc, counts = pairs.base_counts(p, 3)
    same = lambda a, b: sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    assert same(pc, pairs.pair_counts(p, 3)) and same(counts, columns.column_counts(p))


def test_ranks(spark):
    df = spark.createDataFrame([(i, i + 1, float(v)) for i, v in enumerate([3, 1, 2, 2, 9, 1])], "pos_i int, pos_j int, v double").repartition(3)
    assert [r.pos_i for r in shared.ranked(df, "k", "v", "pos_i").orderBy("k").collect()] == [1, 5, 2, 3, 0, 4]
    both = df.withColumn("w", -F.col("v"))
    assert ranking.spearman(both, "v", "w").first().rho == -1.0
    assert {r.pos_i: r.r for r in ranking.rank_scores(df, "v", "r").collect()}[4] == 1.0


def argmax_guess(rows, a):
    """The reference guess: largest ln((f + e) / ((fi + e)(fj + e))) over all 20 codes, the lowest first."""
    e, m = 1e-10, np.zeros((20, 20))
    for x, y in rows:
        if x < 20 and y < 20:
            m[x, y] += 1
    f = m / m.sum() if m.sum() else m
    return int(np.log((f + e) / ((f.sum(1)[:, None] + e) * (f.sum(0)[None] + e))).round(9)[a].argmax())


def test_constraint_function_predicts_like_an_argmax(spark):
    rows = noise(60, 2, seed=8)
    p = profile(spark, rows)
    chosen = spark.createDataFrame([(0, 1, 0, 1)], "pos_i int, pos_j int, ref_i int, ref_j int")
    got = predict.train_test(p, chosen, F.col("seq_id") < 40, 1).first()
    test = [r for r in rows[40:] if 20 not in r and r != [0, 1]]
    assert (got.n_test, got.n_correct) == (len(test), sum(argmax_guess(rows[:40], a) == b for a, b in test))
    none = predict.train_test(p, chosen, F.lit(False), 1).first()
    assert none.n_test == sum(20 not in r and r != [0, 1] for r in rows) and none.n_correct == sum(b == 0 and 20 not in (a, b) for a, b in rows)
    got = predict.leave_one_out_all_codes(pairs.pair_counts(p, 1), chosen).first()
    held = [(k, r) for k, r in enumerate(rows) if 20 not in r and r != [0, 1]]
    assert (got.n_test, got.n_correct) == (len(held), sum(argmax_guess(rows[:k] + rows[k + 1 :], a) == b for k, (a, b) in held))


def test_precision_predictor_against_numpy(spark):
    rows = noise(80, 2, seed=4)
    got = predict.precision_predictor(profile(spark, rows), F.col("seq_id") < 50, 1).first()
    m = np.zeros((20, 20))
    for a, b in rows[:50]:
        if a < 20 and b < 20:
            m[a, b] += 1
    f = m / m.sum()
    guess = np.linalg.pinv(f - np.outer(f.sum(1), f.sum(0)) + 0.01 * np.eye(20)).round(9).argmax(1)
    test = [(a, b) for a, b in rows[50:] if a < 20 and b < 20]
    assert (got.n_test, got.n_correct) == (len(test), sum(guess[a] == b for a, b in test))


def test_bootstrap_stays_around_the_ratio(spark):
    rows = noise(400, 2, seed=2, gap=False)
    pc = pairs.pair_counts(profile(spark, rows), 1).cache()
    ratio = pairs.perplexity_ratio(pc).first().ratio
    r = pairs.bootstrap_ratio(pc, pc.select("pos_i", "pos_j").distinct()).first()
    assert r.low <= r["mean"] <= r.high and abs(r["mean"] - ratio) < 0.1 and 0 < r.deviation < 0.1
    same = pairs.bootstrap_ratio(pairs.pair_counts(profile(spark, [[0, 1]] * 9), 1), pc.select("pos_i", "pos_j").distinct()).first()
    assert same["mean"] == same.low == same.high == 1.0 and same.deviation == 0.0


def test_prime_implicants_of_ten_bits_match_brute_force():
    rng = random.Random(6)
    free = {i * 32 + j for i in range(32) for j in range(32) if i > 19 or j > 19}
    for k in (1, 5, 40, 200):
        on = rng.sample([i * 32 + j for i in range(20) for j in range(20)], k)
        allowed = np.zeros(1024, bool)
        allowed[list(free | set(on))] = True
        ok = {}
        for m in range(1024):  # a cube is allowed if both its halves are
            for v in range(1024):
                if not v & m:
                    b = m & -m
                    ok[v, m] = bool(allowed[v]) if not m else ok[v, m ^ b] and ok[v | b, m ^ b]
        hits = lambda v, m: any((c ^ v) & ~m == 0 for c in on)
        want = [(v, m) for (v, m), good in ok.items() if good and not any(not m >> b & 1 and ok[v & ~(1 << b), m | 1 << b] for b in range(10)) and hits(v, m)]
        assert boolean.prime_implicants(on, free) == sorted(want)


def test_rules_apply_in_the_row(spark):
    p = spark.createDataFrame([(1, [0, 1]), (1, [2, 3]), (2, [20, 1]), (3, [0]), (4, [5, 5])], "seq_id long, codes array<int>")
    rule = lambda *r: spark.createDataFrame(list(r), "pos_i int, pos_j int, code_i int, code_j int")
    none = rule((0, 1, 0, 0)).limit(0)
    assert sorted(map(tuple, boolean.classify(p, rule((0, 1, 0, 1), (0, 1, 5, 5)), rule((0, 1, 5, 5))).collect())) == [(1, "positive"), (1, "unclassified"), (2, "unclassified"), (3, "unclassified"), (4, "forbidden")]
    assert {r.verdict for r in boolean.classify(p, none, none).collect()} == {"unclassified"}


def test_association_limits(spark):
    pc = pairs.pair_counts(profile(spark, [[0, 0]] * 6 + [[1, 1]] * 3 + [[0, 1]]), 1).cache()
    every = {(r.code_i, r.code_j): r.j for r in predict.top_associations(pc).collect()}
    assert {k for k, j in every.items() if k[0] != k[1]} == {(r.code_i, r.code_j) for r in predict.top_associations(pc, off_diagonal=True).collect()}
    assert {k for k, j in every.items() if abs(j) > 0.5} == {(r.code_i, r.code_j) for r in predict.top_associations(pc, min_abs_j=0.5).collect()}


def test_on_sets(spark):
    cells = spark.createDataFrame([(0, 1, 0, j, v) for j, v in enumerate([1.0, 2.0, 3.0, 10.0, 0.0])], "pos_i int, pos_j int, code_i int, code_j int, v double")
    got = boolean.on_set(cells, "v", 0.75).collect()
    assert [(r.code_j, r.threshold, r.state) for r in got] == [(3, 4.75, 1)]


def test_median_split_by_hand(spark):
    mi = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1), (1, 2, 0.5), (0, 3, 0.0)], "pos_i int, pos_j int, mi double")
    first = spark.createDataFrame([(0, 4), (1, 3), (2, 20), (3, 1)], "pos int, code int")
    on = spark.createDataFrame([((3 ^ 1) * 32 + (4 ^ 2),)], "cell long")  # codes 3 and 4, the other way round
    r = kmer.median_split(mi, on, first).first()
    assert (r.n_on, r.n_off, r.mean_on, r.mean_off, r.accuracy) == (1, 2, 0.9, 0.3, 1.0)


def test_sinks(spark, tmp_path):
    c = columns.column_counts(profile(spark, noise(9, 2)))
    sinks.write_entropies(columns.column_entropy(c), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == ["pos", "entropy", "perplexity"]
    sinks.write_json(columns.majority(c), str(tmp_path / "j"))
    assert readers.read_results(spark, str(tmp_path / "j")).count() >= 1
    mi = pairs.mutual_information(pairs.pair_counts(profile(spark, noise(9, 3)), 2))
    sinks.write_matrix(mi, str(tmp_path / "m"))
    assert readers.read_matrix(spark, str(tmp_path / "m")).count() == 3
    sinks.write_matrix_csv(mi, "pos_i", "pos_j", "mi", str(tmp_path / "w"))
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).count() == 2
    assert sinks.markdown_table(mi).count("\n") == 5
    svg = sinks.heat_map_svg(mi, "pos_i", "pos_j", "mi")
    assert svg.count("<rect") == 3 and svg.startswith("<svg") and 'width="18"' in svg
    sinks.write_kmaps(kmer.sequence_maps(profile(spark, [[0, 1, 2], [3, 20, 4], [5, 6]]), 2), str(tmp_path / "k"))
    assert {(r.seq_id, r.c0, r.c1, r.n) for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "k")).collect()} == {(0, 0, 1, 1), (0, 1, 2, 1)}
    grid = spark.createDataFrame([(0, 1, 7)], "code_i int, code_j int, value int")
    assert "| 0 | 0 | 7 |" in sinks.markdown_kmap(grid, 2)


def test_report(spark):
    p = profile(spark, [[0, 0, 1]] * 20 + [[1, 2, 1]] * 6 + [[3, 5, 2]] * 5)
    text = reports.report(p, "Title")
    assert text.startswith("# Title") and text.count("\n## ") == 5
    doc = reports.rule_document(p, "Rules")
    assert doc.startswith("# Rules") and "Rule 1: where position" in doc and doc.count("| i | j | implicant |") == doc.count("## Positions") >= 1
    row = reports.summary(p).first()
    assert row.n_pairs == 3 and row.top_pairs[0].mi == row.max_mi and row.neighbours


def test_streamed_counts_equal_batch(spark, tmp_path):
    p = profile(spark, noise(30, 3))
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k, (live, batch) in enumerate(((streaming.running_column_counts, columns.column_counts), (streaming.running_pair_counts, lambda x: pairs.pair_counts(x, 30)))):
        q = streaming.write_counts(live(stream), f"t{k}", str(tmp_path / f"c{k}"))
        q.processAllAvailable()
        q.stop()
        want = batch(p)
        assert sorted(map(tuple, spark.table(f"t{k}").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
