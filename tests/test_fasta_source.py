"""The FASTA data source against a plain parser, over split edges, and as a stream."""

import random

import pytest

from covarix.sources import fasta


def plain(text):
    out, held = [], None
    for line in text.replace("\r", "").split("\n"):
        if line.startswith(">"):
            held = [line[1:].strip(), ""]
            out.append(held)
        elif held is not None and line.strip():
            held[1] += line.strip().upper()
    return [tuple(x) for x in out]


def some_fasta(seed, n=60):
    rng, out = random.Random(seed), ["text before any record\n", "\n"] if seed % 2 else []
    for k in range(n):
        end = rng.choice(["\n", "\r\n"])
        out.append(">" + rng.choice([f"acc{k} | Some é protein {k}", f"acc{k}", "", f"a{k} b > c"]) + end)
        for _ in range(rng.choice([0, 1, 1, 3, 40])):
            out.append("".join(rng.choices("ACDefgh-X ", k=rng.randint(0, 30))) + rng.choice([end, end, end * 2]))
    text = "".join(out)
    return text.rstrip("\n") if seed % 3 else text


@pytest.fixture(scope="module")
def source(spark):
    fasta.register(spark)
    return spark.read.format("covarix_fasta")


@pytest.mark.parametrize("size", [1 << 20, 64, 7, 1])
def test_every_split_gives_all_records(spark, source, tmp_path, size):
    texts = {f"{k}.fa": some_fasta(k, 60 if size > 7 else 6) for k in range(3)} | {"empty.fa": "", "_hidden": ">x\nA"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    df = fasta.numbered(source.option("rangeBytes", str(size)).load(str(tmp_path)))
    rows = df.orderBy("seq_id").collect()
    want = [x for name in sorted(texts) if name != "_hidden" for x in plain(texts[name])]
    assert [(r.header, r.sequence.replace(" ", "")) for r in rows] == [(h, s.replace(" ", "")) for h, s in want]
    assert [r.seq_id for r in rows] == list(range(len(want)))
    assert all(r.accession == (r.header.split() or [""])[0] for r in rows)
    assert all(r.description == (r.header.split(" | ", 1)[-1].strip()) for r in rows)


def test_columns_and_errors(spark, tmp_path):
    fasta.register(spark)
    (tmp_path / "a.fa").write_text(">x\nAC\n>y | z\nGG\n")
    df = spark.read.format("covarix_fasta").option("columns", "header, start").load(f"{tmp_path}/*.fa")
    assert df.columns == ["header", "start"] and sorted(map(tuple, df.collect())) == [("x", 0), ("y | z", 6)]
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("covarix_fasta").option("columns", "nope").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="missing"):
        spark.read.format("covarix_fasta").load(f"{tmp_path}/missing").collect()


def test_stream_reads_new_files_once(spark, tmp_path):
    fasta.register(spark)
    folder, out, ckpt = (tmp_path / x for x in ("in", "out", "ckpt"))
    folder.mkdir()

    def run():
        stream = spark.readStream.format("covarix_fasta").option("columns", "header,sequence").load(str(folder))
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(ckpt)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(str(out)).collect()))

    (folder / "a.fa").write_text(">a\nAA\n")
    assert run() == [("a", "AA")]
    (folder / "b.fa").write_text(">b\nCC\n>c\nDD")
    assert run() == [("a", "AA"), ("b", "CC"), ("c", "DD")]
    assert run() == [("a", "AA"), ("b", "CC"), ("c", "DD")]
