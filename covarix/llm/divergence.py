"""Source divergence audit: how the use of words differs between the sources of a language.

Two passes over the texts. The first counts, in each task, the documents that
hold each term, and keeps them in a count-min sketch; merged by saturating
sums, it never underestimates. The second counts terms by source and discards,
before anything is shuffled, those that the sketch rules out from being in
``min_docs`` documents. Survivors are counted exactly, so collisions cost
traffic and never a result. Shares per thousand million, with five added to each
count, are then compared: a source with its language term by term, and sources
pairwise.

A pair's sum over all kept terms is split so that only occurring terms are
read: what both would give if no term occurred, a correction for the terms of
either source (by the histogram of its counts), and one for the terms of both
(a join by term, in tiles of ``TILE`` sources each way, so that no key gives more
than ``TILE`` squared rows however many sources share a term).

The sketch has ``DEPTH`` rows of ``WIDTH`` cells of a byte (16 MB, whatever the
input; the only thing broadcast of that size). Where a corpus fills it, it
discards less.

Defined cases: null text, language and source are empty strings; a group without
terms has rows too; a language without kept terms gives pairs of value 0; a
repeated row counts each time; an empty table gives no rows. Only ``text``,
``lang`` and ``source`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, release, sized

DEPTH, WIDTH, BLOCK = 4, 1 << 22, 1 << 14
HELD = 400_000  # terms that a task holds before it passes them on
PART = 1 << 20  # bytes of a text split at once
TILE = 64
SCALE, ADDED = 1_000_000_000, 5
_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_AS_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 32 for b in range(256))


def words(body: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a part of it at a time."""
    body, at = body.translate(_AS_TERMS), 0
    while at < len(body):
        end = body.find(b" ", at + PART)
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end


class Sketch:
    """Count-min sketch of saturating counts; ``most`` is the largest count that must be told apart from smaller ones."""

    def __init__(self, most: int, width: int = WIDTH, depth: int = DEPTH, cells: np.ndarray | None = None):
        kind = np.uint8 if most < 256 else np.uint32
        self.width, self.depth = width, depth
        self.cells = np.zeros(width * depth, kind) if cells is None else cells

    def _at(self, keys: list[bytes]) -> np.ndarray:
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)
        rows = np.arange(self.depth, dtype=np.uint64)[:, None]
        return ((h[:, 0] + rows * (h[:, 1] | np.uint64(1))) % np.uint64(self.width) + rows * np.uint64(self.width)).astype(np.int64)

    def add(self, keys: list[bytes], counts: list[int]) -> None:
        n, top = np.asarray(counts, np.int64), np.iinfo(self.cells.dtype).max
        for at in self._at(keys):
            cell, back = np.unique(at, return_inverse=True)
            self.cells[cell] = np.minimum(top, self.cells[cell] + np.bincount(back, n).astype(np.int64))

    def estimate(self, keys: list[bytes]) -> np.ndarray:
        return self.cells[self._at(keys)].min(axis=0)


def _counts(batches: Iterator[pa.RecordBatch], of_source: bool):
    """Per group of a task, ``(lang, source), {term: occurrences}, {term: documents}``; without ``of_source`` by language and documents alone."""
    times, docs, held = defaultdict(Counter), defaultdict(Counter), 0
    for b in batches:
        for at in range(0, b.num_rows, 1_000):
            for lang, source, body in zip(*(c.to_pylist() for c in b.slice(at, 1_000).columns)):
                group, here = (lang, source) if of_source else (lang, None), set()
                held -= len(docs[group])
                for part in words(body):
                    here.update(part)
                    if of_source:
                        times[group].update(part)
                docs[group].update(here)
                held += len(docs[group])
                if held > HELD:
                    yield from ((g, times[g], docs[g]) for g in docs)
                    times, docs, held = defaultdict(Counter), defaultdict(Counter), 0
    yield from ((g, times[g], docs[g]) for g in docs)


def _keys(lang: str, terms: list[bytes]) -> list[bytes]:
    head = lang.encode() + b"\0"
    return [head + t for t in terms]


def _inputs(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("body"))


def document_sketch(docs: DataFrame, min_docs: int, width: int = WIDTH, depth: int = DEPTH) -> Sketch:
    """The merged sketch of how many documents of a language hold a term."""
    block = min(BLOCK, width)
    kind = Sketch(min_docs, 1, 1).cells.dtype

    def emit(blocks: dict[int, np.ndarray]):
        for k, cells in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["block", "cells"])

    def build(batches):
        s = Sketch(min_docs, width, depth)
        for (lang, _), _, n in _counts(batches, False):
            if n:
                s.add(_keys(lang, list(n)), list(n.values()))
        yield from emit({k // block: s.cells[k : k + block] for k in range(0, len(s.cells), block) if s.cells[k : k + block].any()})

    def merge(batches):
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            for k, cells in zip(*(c.to_pylist() for c in b.columns)):
                new = np.frombuffer(cells, kind)
                blocks[k] = new if k not in blocks else np.minimum(np.iinfo(kind).max, blocks[k].astype(np.int64) + new).astype(kind)
        yield from emit(blocks)

    made = _inputs(docs).mapInArrow(build, "block int, cells binary").repartition("block").mapInArrow(merge, "block int, cells binary")
    s = Sketch(min_docs, width, depth)
    for r in made.toLocalIterator():  # depth x width cells in all, however many documents
        s.cells[r["block"] * block : r["block"] * block + block] = np.frombuffer(r["cells"], kind)
    return s


def term_counts(docs: DataFrame, min_docs: int, sketch: Sketch) -> DataFrame:
    """``lang, source, term, times, docs`` of each task, without terms that the sketch rules out."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        for (lang, source), times, n in _counts(batches, True):
            terms = list(n)
            for at in range(0, len(terms), 20_000):
                some = terms[at : at + 20_000]
                some = [some[i] for i in np.flatnonzero(shared.value.estimate(_keys(lang, some)) >= min_docs)]
                if some:
                    cols = pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.string()), pa.array([times[t] for t in some], pa.int64()), pa.array([n[t] for t in some], pa.int64())
                    yield pa.RecordBatch.from_arrays(list(cols), names=["lang", "source", "term", "times", "docs"])

    return _inputs(docs).mapInArrow(run, "lang string, source string, term string, times long, docs long")


def kept_terms(docs: DataFrame, min_docs: int = 30, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """``lang, source, term, times, lang_times, head``: exact counts of the terms in at least ``min_docs`` documents of their language.

    ``head`` marks one row of each term of a language. Written once.
    """
    one = Window.partitionBy("lang", "term")
    rows = term_counts(docs, min_docs, document_sketch(docs, min_docs, width, depth)).repartition("lang", "term")
    # both groupings are by what the rows are dealt by: no further shuffle
    counted = rows.groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))
    all_ = counted.select("lang", "source", "term", "times", F.sum("docs").over(one).alias("n"), F.sum("times").over(one).alias("lang_times"), (F.col("source") == F.min("source").over(one)).alias("head"))
    return checkpointed(all_.where(F.col("n") >= min_docs).drop("n"))


def _share(times: str, total: str) -> Column:
    """1 + floor(SCALE (times + ADDED) / (total + ADDED terms)), exact beyond 64 bits; null where a language keeps no term."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({times} + {ADDED} as decimal(20, 0))) div cast(nullif({total} + {ADDED} * n_kept, 0) as decimal(20, 0))")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row per occurring (lang, source): its number in the language, totals, and ``p0``, the share of a term that it lacks."""
    every = _inputs(docs).select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum(F.col("head").cast("long")).alias("n_kept"), F.sum("times").alias("lang_total"))
    g = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "n_kept", "lang_total"])
    in_lang = Window.partitionBy("lang")
    g = g.withColumn("number", F.row_number().over(in_lang.orderBy("source")) - 1).withColumn("n_sources", F.count("*").over(in_lang))
    return checkpointed(g.withColumn("p0", _share("0", "total")))


def _pairs(shares: DataFrame, groups: DataFrame, small: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every ordered pair of sources of a language."""
    other = small.select("lang", F.col("source").alias("item"), F.col("p0").alias("r0"))
    apart = lambda x, y: F.abs(F.col(x) - F.col(y))
    both_ways = lambda df: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    none = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("n_kept") * apart("p0", "r0"), F.lit(0)).alias("value"))
    histogram = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    either = histogram.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (apart("p", "r0") - apart("p0", "r0"))).alias("value"))
    tile, last = F.floor(F.col("number") / TILE), F.floor((F.col("n_sources") - 1) / TILE)
    x = shares.select("lang", "term", "source", "number", "p", "p0", tile.alias("i"), F.explode(F.sequence(tile, last)).alias("j"))
    y = shares.select("lang", "term", F.col("source").alias("item"), F.col("number").alias("m"), F.col("p").alias("r"), F.col("p0").alias("r0"), F.explode(F.sequence(F.lit(0).cast("long"), tile)).alias("i"), tile.alias("j"))
    common = x.join(y, ["lang", "term", "i", "j"]).where("number < m")
    shared = common.groupBy("lang", "source", "item").agg(F.sum(apart("p", "r") - apart("p", "r0") - apart("p0", "r") + apart("p0", "r0")).alias("value"))
    return none.unionByName(both_ways(either)).unionByName(both_ways(shared)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source, the others by distance (``pair``) and its ``top`` most typical terms (``term``)."""
    kept = kept_terms(docs, min_docs, width, depth)
    groups = groups_of(docs, kept)
    small = sized(groups, groups.count(), 100_000)
    shares = kept.join(small, ["lang", "source"]).withColumns({"p": _share("times", "total"), "q": _share("lang_times", "lang_total")})
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    typical = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    typical = typical.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    pairs = _pairs(shares, groups, small).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(typical)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (kept.c + 5)) // (v.n + 5 * v.v)::HUGEINT AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 50"""
