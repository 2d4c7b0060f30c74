"""Line dedup over a whole corpus, answered with per-document keep bitmaps.

Lines become 128-bit hashes of their keys; the hashes are range-partitioned
with a secondary sort by document (largest first) and position, and one
streaming pass over each range finds the first document of every key and the
lines to drop in the others. Text is never shuffled for the decision: the
result is a compressed bitmap per document.

Defined cases: null or empty text is one empty line; keys shorter than
``min_chars`` code points are never dropped; a key repeated inside one document
counts once for that document, and the document that keeps it keeps all its
lines; rows sharing a ``doc_id`` are one document for the counts, and each row
has its own bitmap; a null ``doc_id`` is a document of its own, below all
others. Only ``doc_id`` and ``text`` are read, so other columns may have any
name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns_of, release, rows_to_batches, slices, text_bytes

STRIP = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)  # stands for a null doc_id, below every other
_KEYS = "h1 long, h2 long, doc long, row_hash long, pos int"
_OUT = "kind int, h1 long, h2 long, doc long, row_hash long, pos int"
DROP, OPEN, SEEN = 0, 1, 2


def with_row_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), text_bytes().alias("body"))


def line_keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row per line whose key has at least ``min_chars`` code points."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row_hash", pa.int64()), ("pos", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]):
        digest = xxhash.xxh3_128_intdigest
        for b in (part for whole in batches for part in slices(whole)):
            for doc, rh, body in zip(*(c.to_pylist() for c in b.columns)):
                doc = NO_ID if doc is None else doc
                for pos, line in enumerate(body.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(STRIP).lower()
                    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
                        continue
                    h = digest(key)
                    yield (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), doc, rh, pos

    return with_row_hash(docs).mapInArrow(lambda it: rows_to_batches(rows(it), schema), _KEYS)


def _stream(it: Iterator[pa.RecordBatch], min_docs: int):
    """Decisions over rows sorted by key, then document from the largest.

    A key that begins inside this range is decided here as soon as ``min_docs``
    documents were met; at most the lines of ``min_docs - 1`` documents wait.
    The first key may have begun in the range before, and the last may go on in
    the next: their rows leave undecided, with the documents seen.
    """
    key, first, docs, waiting = None, True, [], []

    def seen():
        return [(SEEN, *key, d, None, None) for d in docs]

    for b in it:
        for h1, h2, doc, rh, pos in zip(*(c.to_pylist() for c in b.columns)):
            if (h1, h2) != key:
                if key is not None:
                    if first:
                        yield from seen()
                    first = False
                key, docs, waiting = (h1, h2), [], []
            if len(docs) < min_docs and doc not in docs:
                docs.append(doc)
            if first:
                yield OPEN, h1, h2, doc, rh, pos
            elif doc != docs[0]:
                if len(docs) >= min_docs:
                    for w in waiting:
                        yield DROP, None, None, *w
                    waiting = []
                    yield DROP, None, None, doc, rh, pos
                else:
                    waiting.append((doc, rh, pos))
    if key is not None:
        yield from seen()
        for w in waiting:
            yield OPEN, *key, *w


def dropped_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``(doc, row_hash, pos)`` of every line that goes."""
    schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row_hash", pa.int64()), ("pos", pa.int32())])
    keys = checkpointed(line_keys(docs, min_chars))
    ranges = keys.repartitionByRange("h1", "h2", F.desc("doc")).sortWithinPartitions("h1", "h2", F.desc("doc"), "row_hash", "pos")
    out = checkpointed(ranges.mapInArrow(lambda it: rows_to_batches(_stream(it, min_docs), schema), _OUT))
    release(keys)
    # two keys a range at most, min_docs documents each: bounded by the number of ranges
    edge = out.where(F.col("kind") == SEEN).groupBy("h1", "h2").agg(F.max("doc").alias("top"), F.size(F.collect_set("doc")).alias("n")).where(F.col("n") >= min_docs)
    late = out.where(F.col("kind") == OPEN).join(F.broadcast(edge), ["h1", "h2"]).where("doc <> top")
    cols = ["doc", "row_hash", "pos"]
    return out.where(F.col("kind") == DROP).select(*cols).unionByName(late.select(*cols))


def keep_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``(doc, row_hash, n_dropped, keep)`` for each document that loses lines.

    ``keep`` is a zlib-compressed bitmap, bit i (most significant first) set if
    line i stays; lines beyond its end stay.
    """
    schema = pa.schema([("doc", pa.int64()), ("row_hash", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])

    def pack(batches):
        def rows():
            for b in batches:
                for doc, rh, pos in zip(*(c.to_pylist() for c in b.columns)):
                    bits = np.ones((max(pos) // 8 + 1) * 8, np.uint8)
                    bits[pos] = 0
                    yield doc, rh, len(pos), zlib.compress(np.packbits(bits).tobytes(), 1)

        return rows_to_batches(rows(), schema)

    gone = dropped_lines(docs, min_docs, min_chars)
    return gone.groupBy("doc", "row_hash").agg(F.collect_set("pos").alias("pos")).mapInArrow(pack, "doc long, row_hash long, n_dropped long, keep binary")


def kept_lines(body: bytes, keep: bytes | None) -> tuple[list[bytes], int]:
    """The lines that stay, and how many lines there were."""
    lines = body.split(b"\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]], len(lines)


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``(row, keep)``: each row as one struct, so that its columns may have any name."""
    row = F.struct(*columns_of(docs))
    d = docs.select(row.alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"))
    return d.join(bitmaps.select("doc", "row_hash", "keep"), ["doc", "row_hash"], "left").select("row", "keep")


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``; all its columns stay. A null text stays null."""
    @F.pandas_udf("string")
    def cut(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([t if k is None else b"\n".join(kept_lines((t or "").encode(), k)[0]).decode() for t, k in zip(text, keep)], dtype=object)

    both = _with_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars))
    # only texts that lose lines go through Python
    new = F.when(F.col("keep").isNull(), F.col("row.text")).otherwise(cut(F.when(F.col("keep").isNotNull(), F.col("row.text")), F.col("keep")))
    return both.select(F.col("row").withField("text", new).alias("row")).select("row.*")


def line_report(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Per document: lines before, lines dropped, and the digest of what is kept."""
    both = _with_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, min_docs, min_chars)).select("row.doc_id", text_bytes("row.text").alias("body"), "keep")
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches):
        def rows():
            for b in (part for whole in batches for part in slices(whole)):
                for doc, body, keep in zip(*(c.to_pylist() for c in b.columns)):
                    kept, n = kept_lines(body, keep)
                    yield doc, n, n - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()

        return rows_to_batches(rows(), schema)

    return both.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
