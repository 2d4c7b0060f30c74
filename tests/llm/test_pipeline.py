"""The pipeline's result against its stages done by hand on small documents."""

import collections
import random
import re
import zlib

import corpus_pipeline
from covarix.llm import line_dedup, packing, quality, tokens

from brute import brute_components, brute_windows

WORDS = [f"word{i}" for i in range(400)]


def small(spark, folder):
    rng = random.Random(0)
    text = lambda k: " ".join(rng.choices(WORDS, k=k)).capitalize() + "."
    item = text(30)
    shared = "This line stands in very many documents."
    docs = [f"{text(60)}\n{shared if i % 4 == 0 else text(9)}" for i in range(60)]
    docs += [docs[1], docs[3] + " Tail.", docs[2] + " " + item + " " + text(4)]
    docs += [" ".join(w + "%%%" for w in rng.choices(WORDS, k=60)) for _ in range(40)]
    docs += [None, "", " ".join(rng.choices(WORDS, k=5000)).capitalize() + "."]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 63), 0) for i in range(103) if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_pipeline(spark, tmp_path):
    docs = small(spark, tmp_path)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = out
        out = stage(spark, out, str(tmp_path))
        assert out.columns == before.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        out = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append({r.doc_id: r.text for r in out.collect()})
    good, lines, single, clean = kept
    assert set(range(63)) <= set(good) and not set(range(63, 103)) & set(good)
    common = "This line stands in very many documents."
    assert [i for i, t in lines.items() if common in (t or "")] == [56]
    assert all(good[i] == lines[i] for i in range(60) if common not in docs[i] and i not in (1, 3))
    assert {1, 3} <= set(single) and not {60, 61} & set(single)
    assert set(single) - set(clean) == {62}
    enc = tokens.encoder(tokens.default_tokenizer())
    want = set()
    for i, t in clean.items():
        ids = enc.id_bytes(t or "") + packing.END_ID.to_bytes(4, "little")
        want |= {(i, k, zlib.crc32(ids[a : a + 16384])) for k, a in enumerate(range(0, len(ids), 16384))}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in rows} == want
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0])


def brute_pipeline(spark, rows, labels, items):
    """The pieces that are left, stage by stage over lists; the classifier's model is the pipeline's own."""
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string, lang string, source string, n_chars long")
    model = quality.train(frame(rows), labels)
    rows = [r for r in rows if model.scores(quality.features((r[1] or "").encode())[None])[0] >= 0.5]
    where = collections.defaultdict(set)
    low = lambda i: line_dedup.NO_ID if i is None else i
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(low(i))
    gone = lambda i, x: len(key(x)) >= 20 and len(where[key(x)]) >= 3 and low(i) != max(where[key(x)])
    rows = [(i, t if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x)), *more) for i, t, *more in rows]
    with_id = [(i, t) for i, t, *_ in rows if i is not None]
    root = brute_components([i for i, _ in with_id], [t for _, t in with_id], 5, 4, 5)
    rows = [r for r in rows if r[0] is None or root[r[0]] == r[0]]
    leaked = {i for i, *_ in brute_windows([(i, t) for i, t, *_ in rows if i is not None], items)}
    enc, want = tokens.encoder(tokens.default_tokenizer()), collections.Counter()
    for i, t, *_ in rows:
        if i not in leaked:
            ids = enc.id_bytes(t or "") + packing.END_ID.to_bytes(4, "little")
            want.update((i, k, a // 4, zlib.crc32(ids[a : a + 16384])) for k, a in enumerate(range(0, len(ids), 16384)))
    return want


def test_run_against_brute_force(spark, tmp_path):
    """Null and repeated ids, copies and near copies, shared lines, leaks, further columns of clashing names."""
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choices(WORDS, k=k)).capitalize() + "."
    items = [(0, text(30)), (1, text(12)), (2, None), (None, text(8))]
    lines = [text(6) for _ in range(4)]
    docs = ["\n".join([text(rng.randint(5, 60)), *rng.sample(lines, rng.randint(0, 3)), text(9)]) for _ in range(50)]
    docs += [d + " tail" for d in docs[:8]] + [docs[9].upper(), docs[10], docs[10]] + [f"{docs[11 + k]} {t} {text(3)}" for k, t in ((0, items[0][1]), (1, items[1][1].upper()), (2, " ".join(items[0][1].split()[15:] + items[0][1].split()[:15])))]
    docs += [" ".join(w + "%%%" for w in rng.choices(WORDS, k=60)) for _ in range(40)] + ["", None, text(6000)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(docs)] + [(None, docs[4], "en", None, None), (None, docs[5], None, "s", 2), (7, text(20), "en", "s", 3), (8, docs[8], "en", "s", 4)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(i, int(i < 64), 0) for i in range(104) if i % 5], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = spark.createDataFrame([(*r, 0.5, "mine", 7) for r in rows], names + ", score double, predicted string, _keep int")
    wide.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute_pipeline(spark, rows, labels, [(k, t) for k, t in items if k is not None])
    assert got == want and 30 < len(want) < len(rows) - 40


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
