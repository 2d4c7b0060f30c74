"""Exact n-gram Jaccard self-join by two-level PartEnum signatures.

A text is the set of its word n-grams, each a 64-bit hash. Sets are put in size
bands whose ends are one similarity step apart, so two similar sets lie in the
same or in neighbouring bands. For one band with largest size r, similar sets
differ in at most ``k = floor(2r(1-t)/(1+t))`` elements. The hash domain is cut
into ``first`` parts and each of these into ``second`` cells. With
``first = k // (left + 1) + spare`` parts, at least ``spare`` parts differ in at
most ``left`` elements, so in each of them the two sets agree on all but some
``left`` cells: every subset that leaves ``left`` cells out is a signature.

A signature of too few elements says little. Where ``spare`` or more parts of a
set have such weak signatures, the set is cut anew by another hash; if two
similar sets agree on weak signatures only, both do so, hence weak ones are
never needed but in the last of ``CUTS`` cuts. The first cut leaves out elements
that very many documents share: sets differ in no more elements on any part of
the domain than on all of it, so this loses nothing, and passages that a large
share of the corpus repeats join no unlike texts. There one element is enough
for a signature, in later cuts it takes ``least``. ``cutting`` chooses the numbers
for each band: the signatures by which fewest unlike texts meet, at a bounded cost.

Steps: signatures of whole texts, shared ones folded per task before the shuffle
into chains (a row per document, never a pair per pair) and memberships. First,
each document is held against the one smaller document with which most chains
join it, in stars of bounded size; what is linked is contracted, which settles
groups of near copies however large. Only signatures that still join different
contracted groups stay alive. Where few share one, pairs of documents of
different groups, rows of numbers, are filtered by parity bitmaps (their distance
bounds the sets' one from below), and texts are gathered for what these leave
open only, to be compared exactly. Where many share one they are gathered round a
centre in blocks of texts, and a task compares all sets of a block exactly; very
large ones meet by their differences from the centre. Copies of one set are not
expanded into pairs.

Defined cases: texts without words have no n-grams and are linked with nothing;
texts of fewer than n words are one n-gram, the whole sequence; rows sharing a
``doc_id`` are one vertex; null ids take no part and have no component; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, columns_of, connected_components, release, rows_to_batches, sized, text_bytes

BLOCK_GRAMS = 1_500_000
BUCKET_GRAMS = 1_500_000
KNOWN_SETS = 60_000  # digests that a task remembers, to leave out copies
FOLD_SIGNATURES = 400_000
MEMBERS = 200_000  # memberships a row
STAR = 256  # documents held against one copy of another
FEW = 8  # members of a signature that meet each other; more are gathered round a centre
GRID = 16  # parts of a star whose texts meet in blocks; of more parts they meet by their differences from the centre
COLUMNS = 8_192  # n-grams that a block is counted by at a time
CUTS = 4
COMMON_DOCS, COMMON_GRAMS = 6, 1_000_000  # documents that make an n-gram a common one; at most so many, the most common, are left out of first cuts
COMMON_BITS = 24
PER_DIFFERENCE = 2.3  # signatures for each element in which similar sets can differ; one level takes 1
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_PART = 1 << 20
_weights = np.empty(0, np.uint64)


def _weight(n: int) -> np.ndarray:
    """A fixed odd 64-bit factor for each of at least ``n`` places in a word."""
    global _weights
    if len(_weights) < n:
        with np.errstate(over="ignore"):
            _weights = mix(np.arange(1, max(n, 64, 2 * len(_weights)) + 1, dtype=np.uint64) * _M[0]) | np.uint64(1)
    return _weights


def _hashes(low: bytes) -> np.ndarray:
    """A hash of each run of bytes between white space: its bytes by the factors of their places, summed, with its length."""
    b = np.frombuffer(low, np.uint8)
    word = ~_SPACES[b]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    if not len(edges):
        return np.empty(0, np.uint64)
    lengths = edges[1::2] - edges[::2]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    sums = np.add.reduceat((b[word].astype(np.uint64) + np.uint64(1)) * _weight(int(lengths.max()))[place], first)
    return mix(sums + lengths.astype(np.uint64) * _M[2])


def word_hashes(body: bytes) -> np.ndarray:
    """Hashes of the ASCII-lower-cased words of a text in UTF-8, about a megabyte at a time."""
    low, at, parts = body.lower(), 0, []
    while at < len(low):
        cut = _GAP.search(low, at + _PART)
        end = cut.start() if cut else len(low)
        parts.append(_hashes(low[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def gram_set(body: bytes, n: int) -> np.ndarray:
    """The sorted distinct n-gram hashes of a whole text."""
    w = word_hashes(body)
    if not len(w):
        return w
    if len(w) < n:
        w, size = w[:, None], len(w)
        h = mix((w.T @ _M[:size, None]).ravel() + np.uint64(size))
        return h
    h = w[: len(w) - n + 1] * _M[0]
    for i in range(1, n):
        h = h + w[i : len(w) - n + 1 + i] * _M[i]
    return np.unique(mix(h))


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``num / den``."""

    num: int
    den: int

    def bands(self, size: int) -> tuple[int, int]:
        """The band of a size and the largest size in it."""
        low, band = 1, 0
        while True:
            high = low * self.den // self.num
            if size <= high:
                return band, high
            low, band = high + 1, band + 1

    def band_end(self, band: int) -> int:
        high = 0
        for _ in range(band + 1):
            high = (high + 1) * self.den // self.num
        return high

    def differ(self, high: int) -> int:
        """The elements in which similar sets of at most ``high`` can differ."""
        return (self.den - self.num) * 2 * high // (self.den + self.num)

    def linked(self, common: int, a: int, b: int) -> bool:
        return common * self.den >= self.num * (a + b - common)


class Cutting(NamedTuple):
    """How the sets of a band are cut: parts, cells a part, cells left out, parts sure to agree, elements a signature needs."""

    first: int
    second: int
    left: int
    spare: int
    least: int

    @property
    def signatures(self) -> int:
        return self.first * math.comb(self.second, self.left)


def _poisson_below(m: int, mean: float) -> float:
    """P(X < m) of a Poisson variable."""
    if mean > 700:
        return 0.0 if m < mean / 2 else 0.5 * math.erfc((mean - m) / math.sqrt(2 * mean))
    term = total = math.exp(-mean)
    for i in range(1, m):
        term *= mean / i
        total += term
    return min(1.0, total) if m else 0.0


def _again(size: float, first: int, second: int, left: int, spare: int, least: int) -> float:
    """About the chance that ``spare`` or more parts of a random set have a weak signature."""
    weak = math.comb(second, left) * _poisson_below(least, size / first * (1 - left / second))
    return 1 - _poisson_below(spare, first * min(1.0, weak))


def cutting(size: int, differ: int) -> Cutting:
    """The cutting for sets of about ``size`` elements of which two may differ in ``differ``.

    Of those that cost at most ``PER_DIFFERENCE`` signatures a difference and seldom
    take a second cut, even where half of a set are common elements, the one by
    which sets with a quarter of their elements in common share the fewest signatures.
    """
    if not differ:
        return Cutting(1, 1, 0, 1, 1)
    best, low = Cutting(differ + 1, 1, 0, 1, 1), math.inf
    for left, second in ((0, 1), (1, 3), (1, 4), (1, 5), (2, 4), (2, 5), (2, 6)):
        subsets, spare = math.comb(second, left), 1
        while (first := differ // (left + 1) + spare) * subsets <= max(24, PER_DIFFERENCE * differ):
            if _again(0.5 * size, first, second, left, spare, 1) < 0.2:
                mean = 0.5 * size / first * (1 - left / second)
                met = first * subsets * (math.exp(-0.75 * mean) - math.exp(-mean) + 1e-9)
                if met < low:
                    least = max((m for m in range(1, 8) if _again(size, first, second, left, spare, m) < 0.3), default=1)
                    best, low = Cutting(first, second, left, spare, least), met
            spare += 1 + spare // 8
    return best


class Signer:
    """Signatures of sorted sets for one similarity."""

    def __init__(self, sim: Similarity, common: bytes | None = None) -> None:
        self.sim = sim
        self.common = np.frombuffer(common, np.uint8) if common else None
        self.known: dict[int, tuple[int, int]] = {}
        self.cuttings: dict[int, Cutting] = {}
        self.subsets: dict[tuple[int, int], np.ndarray] = {}

    def cutting_of(self, band: int) -> Cutting:
        if band not in self.cuttings:
            high = self.sim.band_end(band)
            self.cuttings[band] = cutting(max(1, high * self.sim.num // self.sim.den), self.sim.differ(high))
        return self.cuttings[band]

    def _kept(self, second: int, left: int) -> np.ndarray:
        """A column a subset, 1 for each cell that it keeps."""
        if (second, left) not in self.subsets:
            out = np.ones((second, math.comb(second, left)), np.uint64)
            for k, gone in enumerate(combinations(range(second), left)):
                out[list(gone), k] = 0
            self.subsets[second, left] = out
        return self.subsets[second, left]

    def _cut(self, grams: np.ndarray, c: Cutting, name: int, cut: int) -> list[np.ndarray]:
        # cells of equal width in the hash domain are slices of the sorted set
        every, cells, least = grams, c.first * c.second, c.least
        if cut == 1 and self.common is not None:
            at = grams >> np.uint64(64 - COMMON_BITS)
            grams = grams[self.common[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 0]
            least = 1
        bounds = np.searchsorted(grams >> np.uint64(11), np.arange(1, cells, dtype=np.uint64) * np.uint64((1 << 53) // cells))
        at = np.concatenate(([0], bounds, [len(grams)]))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams + np.uint64(name)), dtype=np.uint64)))
        sums = (total[at[1:]] - total[at[:-1]]).reshape(c.first, c.second)
        sizes = np.diff(at).reshape(c.first, c.second).astype(np.uint64)
        if c.left:
            kept = self._kept(c.second, c.left)
            sums, sizes = sums @ kept, sizes @ kept
        weak = sizes < least
        labels = np.arange(c.first, dtype=np.uint64) * _M[5] + np.uint64(name)
        sigs = mix(mix(sums) + labels[:, None])
        out = [sigs[~weak]]
        if weak.any() and int(weak.any(1).sum()) >= c.spare:
            if cut < CUTS:
                out += self._cut(np.sort(mix(every ^ _M[6])), c, int(mix(np.array([name], np.uint64) ^ _M[4])[0]), cut + 1)
            else:
                out.append(sigs[weak])
        return out

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """At least one signature in common with every similar set."""
        size = len(grams)
        if size not in self.known:
            self.known[size] = self.sim.bands(size)
        band, _ = self.known[size]
        out = []
        for tag in (band, band + 1):
            out += self._cut(grams, self.cutting_of(tag), (tag + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1, 1)
        return np.concatenate(out)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield doc, gram_set(body.as_py(), n)


def _digest(grams: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def set_digests(docs: DataFrame, n: int) -> DataFrame:
    """``(doc_id, n_shingles, d1, d2)``: set size and 128-bit digest of each text.

    Further rows with ``n_shingles`` -1 hold an n-gram (``d1``) that ``d2`` texts of one fold share.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches):
        def rows():
            held, size = [], 0
            for b in batches:
                for doc, g in _sets(b, n):
                    yield doc, len(g), *_digest(g)
                    held.append(g)
                    size += len(g)
                    if size >= FOLD_SIGNATURES:
                        yield from often(held)
                        held, size = [], 0
            if held:
                yield from often(held)

        def often(held):
            gram, times = np.unique(np.concatenate(held), return_counts=True)
            for g, t in zip(gram[times > 1].view(np.int64).tolist(), times[times > 1].tolist()):
                yield None, -1, g, t

        return rows_to_batches(rows(), schema)

    return docs.select("doc_id", text_bytes().alias("body")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long")


def common_grams(digests: DataFrame) -> bytes:
    """A bit for each of 2**24 classes of n-grams, set where one is common; 2 MB however large the corpus is."""
    counts = digests.where("n_shingles = -1").groupBy("d1").agg(F.sum("d2").alias("n")).where(F.col("n") >= COMMON_DOCS)
    counts = checkpointed(counts.withColumn("step", F.floor(4 * F.log2("n"))))
    room, lowest = COMMON_GRAMS, math.inf
    for step, times in sorted(counts.groupBy("step").agg(F.count("*")).collect(), reverse=True):  # a few hundred steps at most
        room -= times
        if room < 0:
            break
        lowest = step
    bits = np.zeros(1 << COMMON_BITS, np.uint8)
    if lowest < math.inf:
        found = counts.where(F.col("step") >= lowest).select("d1").toArrow().column("d1").to_numpy()
        bits[(found.view(np.uint64) >> np.uint64(64 - COMMON_BITS)).astype(np.int64)] = 1
    release(counts)
    return np.packbits(bits, bitorder="little").tobytes()


def _packed(sig: np.ndarray, doc: np.ndarray) -> bytes:
    """Sorted signatures (their upper 48 bits) and ids as compressed byte planes."""
    planes = sig.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes() + doc.astype(">i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zlib.compress(planes, 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(14, -1)
    sig = np.zeros((planes.shape[1], 8), np.uint8)
    sig[:, :6] = planes[:6].T
    return sig.view(">u8").ravel().astype(np.uint64), np.ascontiguousarray(planes[6:].T).view(">i8").ravel().astype(np.int64)


def _chain(sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted signatures and ids: rows ``(document, the one before it, times)``, the memberships of shared signatures, the first of each signature."""
    again = sig[1:] == sig[:-1]
    u, v = doc[1:][again], doc[:-1][again]
    pairs, times = np.unique(np.stack((u, v), 1), axis=0, return_counts=True) if len(u) else (np.empty((0, 2), np.int64), np.empty(0, np.int64))
    shared = np.concatenate((again, [False])) | np.concatenate(([False], again))
    return np.column_stack((pairs, times)), np.flatnonzero(shared), np.flatnonzero(np.concatenate(([True], ~again)))


def _sorted_once(sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures to 48 bits, sorted with their ids, repeated rows gone."""
    sig = sig >> np.uint64(16) << np.uint64(16)
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
    return sig[new], doc[new]


FIRSTS, SHARED = 0, 1


def signature_groups(docs: DataFrame, n: int, sim: Similarity, buckets: int, common: Broadcast) -> DataFrame:
    """``(part, data)``: packed chains through the documents of each signature by parts of their documents, and, without part, packed memberships of shared ones.

    Each task drops exact copies it has met and chains its own documents, so of a
    signature that many documents share one row a fold meets those of the other
    tasks, packed by ranges of the signature. Memberships of a fold take any task.
    """
    def run(batches):
        np.seterr(over="ignore")
        signer, met = Signer(sim, common.value), set()
        sigs: list[np.ndarray] = []
        ids: list[int] = []

        def fold():
            sig, doc = _sorted_once(np.concatenate(sigs), np.repeat(np.array(ids, np.int64), [len(s) for s in sigs]))
            sigs.clear(), ids.clear()
            pairs, shared, heads = _chain(sig, doc)
            for a in range(0, len(shared), MEMBERS):
                part = shared[a : a + MEMBERS]
                data = _packed(sig[part], doc[part])
                yield zlib.crc32(data) % buckets, SHARED, data, b""
            sig, doc = sig[heads], doc[heads]
            at = np.searchsorted(sig, _range_starts(buckets))
            where = mix((pairs[:, 0] * 31 + pairs[:, 1]).view(np.uint64)) % np.uint64(buckets)
            for k, (a, z) in enumerate(zip(at, [*at[1:], len(sig)])):
                mine = pairs[where == k]
                if z > a or len(mine):
                    yield k, FIRSTS, _packed(sig[a:z], doc[a:z]), mine.astype("<i8").tobytes()

        def rows():
            held = 0
            for b in batches:
                for doc, grams in _sets(b, n):
                    if doc is None or not len(grams) or (d := _digest(grams)) in met:
                        continue
                    if len(met) >= KNOWN_SETS:
                        met.clear()
                    met.add(d)
                    sigs.append(s := signer(grams))
                    ids.append(doc)
                    held += len(s)
                    if held >= FOLD_SIGNATURES:
                        yield from fold()
                        held = 0
            if sigs:
                yield from fold()

        return rows_to_batches(rows(), pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("pairs", pa.binary())]), 16)

    parts = max(1, buckets // 4)

    def merge(batches):
        def groups(chunks, pairs):
            sig, doc = _sorted_once(*(np.concatenate(x) for x in zip(*map(_unpacked, chunks))))
            found, shared, _ = _chain(sig, doc)
            for a in range(0, len(shared), MEMBERS):
                part = shared[a : a + MEMBERS]
                yield one_row(None, _packed(sig[part], doc[part]))
            both = np.concatenate([found, *(np.frombuffer(x, "<i8").reshape(-1, 3) for x in pairs)])
            both = _summed(both)
            part = (mix(both[:, 0].copy().view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            both, part = both[order], part[order]
            at = np.searchsorted(part, np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(at)).tolist():
                yield one_row(k, zlib.compress(both[at[k] : at[k + 1]].astype("<i8").tobytes(), 1))

        def one_row(part, data):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

        key, chunks, pairs = None, [], []
        for b in batches:
            for k, kind, data, p in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if chunks:
                        yield from groups(chunks, pairs)
                    key, chunks, pairs = k, [], []
                if kind == SHARED:
                    yield one_row(None, data)
                else:
                    chunks.append(data), pairs.append(p)
        if chunks:
            yield from groups(chunks, pairs)

    packed = docs.select("doc_id", text_bytes().alias("body")).mapInArrow(run, "bucket int, kind int, data binary, pairs binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "part int, data binary")


def _range_starts(buckets: int) -> np.ndarray:
    """First signature of each of equally wide ranges, on a 48-bit boundary."""
    return np.array([(k << 48) // buckets << 16 for k in range(buckets)], np.uint64)


def _summed(pairs: np.ndarray) -> np.ndarray:
    """Rows ``(u, v, n)``, each pair once with the sum of its numbers."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    first = np.flatnonzero(np.concatenate(([True], (pairs[1:, :2] != pairs[:-1, :2]).any(1))))
    return np.column_stack((pairs[first, :2], np.add.reduceat(pairs[:, 2], first)))


def chained_pairs(groups: DataFrame) -> DataFrame:
    """``(u, v, n)``: each pair of documents next to each other in a chain, ``u > v``, with the number of chains."""
    def run(batches):
        key, held = None, []
        for b in batches:
            for part, data in zip(*(c.to_pylist() for c in b.columns)):
                if part != key:
                    if held:
                        yield from rows(held)
                    key, held = part, []
                held.append(np.frombuffer(zlib.decompress(data), "<i8").reshape(-1, 3))
        if held:
            yield from rows(held)

    def rows(held):
        both = _summed(np.concatenate(held))
        for a in range(0, len(both), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(both[a : a + 50_000, i].copy()) for i in range(3)], names=["u", "v", "n"])

    packed = groups.where("part is not null").repartition("part").sortWithinPartitions("part")
    return packed.mapInArrow(run, "u long, v long, n long")


def memberships(groups: DataFrame) -> DataFrame:
    """``(sig, doc_id)`` of the signatures that several documents share."""
    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                sig, doc = _unpacked(data)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(doc)], names=["sig", "doc_id"])

    return groups.where("part is null").select("data").mapInArrow(run, "sig long, doc_id long")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def star_links(stars: DataFrame, n: int, sim: Similarity) -> DataFrame:
    """``(u, v)``: the documents of each star that are linked with its head; rows ``(head, part, outer, doc_id, body)``.

    Streams: only the head is held.
    """
    def run(batches):
        np.seterr(over="ignore")

        def links():
            key, heads = None, []
            for b in batches:
                for head, part, outer, doc, body in zip(*(c.to_pylist() for c in b.columns)):
                    if (head, part) != key:
                        key, heads = (head, part), []
                    grams = gram_set(body, n)
                    if not outer:
                        heads.append(grams)
                    elif any(len(h) and len(grams) and sim.linked(_common(h, grams), len(h), len(grams)) for h in heads):
                        yield doc, head

        return rows_to_batches(links(), pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return stars.repartition("head", "part").sortWithinPartitions("head", "part", "outer").mapInArrow(run, "u long, v long")


def _bitmap(grams: np.ndarray) -> bytes:
    """Parities of two classes or more an element: two bitmaps differ in no more bits than their sets in elements."""
    classes = max(64, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """The bits in which two bitmaps differ, the wider one folded to the other's classes."""
    x, y = sorted((np.frombuffer(z, np.uint64) for z in (a, b)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum())


def bitmaps(docs: DataFrame, n: int) -> DataFrame:
    """``(doc_id, grams, map)``: size and bitmap of each text with words, a quarter to half a byte an n-gram."""
    schema = pa.schema([("doc_id", pa.int64()), ("grams", pa.int64()), ("map", pa.binary())])

    def run(batches):
        np.seterr(over="ignore")
        return rows_to_batches(((doc, len(g), _bitmap(g)) for b in batches for doc, g in _sets(b, n) if len(g)), schema, 2_000)

    return docs.select("doc_id", "body").mapInArrow(run, "doc_id long, grams long, map binary")


def _pairs(met: DataFrame) -> DataFrame:
    """``(u, v, low, high)`` of two documents and their settled groups, ids in order."""
    return met.select(F.greatest("a_doc_id", "b_doc_id").alias("u"), F.least("a_doc_id", "b_doc_id").alias("v"), F.least("a_settled", "b_settled").alias("low"), F.greatest("a_settled", "b_settled").alias("high"))


def _meeting(members: DataFrame, narrow: DataFrame, sizes: DataFrame, n: int, sim: Similarity) -> tuple[DataFrame, DataFrame]:
    """``(u, v, low, high)``, the pairs of different settled groups that may be linked, with their groups in order, and links ``(u, v)`` found on the way.

    Of signatures with equal members one is enough. The members of one that ``FEW``
    have at most meet each other, so a membership makes some pairs however many
    there are; those of larger ones are gathered in stars round the member that
    signatures join most, and a star's texts are compared in blocks, which makes no
    pairs. A star of more than ``GRID`` parts meets by differences from its centre.
    """
    sigs = checkpointed(members.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")))
    kept = sigs.groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "n")
    m = checkpointed(members.join(kept, "sig"))
    a, b = (m.where(F.col("n") <= FEW).select("sig", *(F.col(x).alias(f"{c}_{x}") for x in ("doc_id", "settled"))) for c in "ab")
    few = a.join(b, "sig").where("a_doc_id > b_doc_id and a_settled <> b_settled").transform(_pairs).distinct()
    many = m.where(F.col("n") > FEW).select("sig", "doc_id")
    degree = members.join(sigs, "sig").groupBy("doc_id").agg(F.sum("n").alias("met"))
    centre = many.join(degree, "doc_id").groupBy("sig").agg((-F.max(F.struct("met", (-F.col("doc_id")).alias("v")))["v"]).alias("head"))
    stars = checkpointed(many.join(centre, "sig").where("head <> doc_id").select("head", F.col("doc_id").alias("u")).distinct())
    release(sigs)
    none = stars.select("u", F.col("head").alias("v"))
    if stars.isEmpty():
        return few, none
    weighed = checkpointed(stars.join(sizes.withColumnRenamed("doc_id", "u"), "u"))
    release(stars)
    parts = checkpointed(_star_parts(weighed))
    groups = members.select("doc_id", "settled").distinct()
    links = checkpointed(block_links(_with_text(_blocks(weighed, parts.where(F.col("parts") <= GRID), groups), narrow), n, sim))
    large = parts.where(F.col("parts") > GRID).select("head")
    if large.isEmpty():
        return few, links
    dealt = _dealt(weighed.join(large, "head", "left_semi"), F.col("grams"))
    edits = checkpointed(differences(_with_text(dealt, narrow).select("head", "part", "outer", "doc_id", "body"), n, sim))
    met = _by_differences(edits, groups, sim)
    return few.unionByName(met).distinct(), links.unionByName(edits.where("not far").select(F.col("doc_id").alias("u"), F.col("head").alias("v")).distinct())


def _star_parts(weighed: DataFrame) -> DataFrame:
    """``(head, parts)``: in how many parts the documents of a star are held against each other; a part is wider in larger stars, to four times ``STAR``."""
    many = F.count("*")
    width = F.greatest(F.lit(STAR), F.least(F.lit(4 * STAR), many / 8))
    return weighed.groupBy("head").agg(F.ceil(F.greatest(many / width, F.sum("grams") / BLOCK_GRAMS)).alias("parts"))


def _blocks(weighed: DataFrame, parts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(head, row, col, doc_id, settled)``: the documents of each star, dealt to its parts, in each block of two parts.

    The centre is one of the documents. A document is in as many blocks as its star has parts, ``GRID`` at most.
    """
    own = weighed.select("head", F.col("u").alias("doc_id")).unionByName(parts.select("head", F.col("head").alias("doc_id")))
    own = own.join(parts, "head").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    every = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return every.select("head", F.least("part", "other").alias("row"), F.greatest("part", "other").alias("col"), "doc_id").join(groups, "doc_id")


def _linked_in_block(sets: list[np.ndarray], groups: np.ndarray, sim: Similarity) -> np.ndarray:
    """For each set of a block the first one that links reach; links inside a group are not looked for.

    An n-gram counts where it is in, or, if more than half of the sets have it, where
    it is not; so what all copies of a text have, and what one of them has alone, costs nothing.
    """
    m, lengths = len(sets), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), lengths)
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    most = times * 2 > m
    absent = int(most.sum()) - np.bincount(owner[most[gram]], minlength=m)  # n-grams of most sets that a set has not
    both = int(most.sum()) - absent[:, None] - absent[None, :]  # and those that two sets have, but for what neither has
    rare = np.minimum(times, m - times)
    column = np.full(len(times), -1, np.int64)
    chosen = np.flatnonzero(rare > 1)
    column[chosen] = np.arange(len(chosen))
    place = column[gram]
    order = np.argsort(place, kind="stable")[int((place < 0).sum()) :]
    owner, place = owner[order], place[order]
    for low in range(0, len(chosen), COLUMNS):
        a, z = np.searchsorted(place, (low, low + COLUMNS))
        here = np.zeros((m, min(COLUMNS, len(chosen) - low)), np.float32)
        here[owner[a:z], place[a:z] - low] = 1
        flip = most[chosen[low : low + COLUMNS]]
        here[:, flip] = 1 - here[:, flip]
        both += (here @ here.T).astype(np.int64)
    linked = both * sim.den >= sim.num * (lengths[:, None] + lengths[None, :] - both)
    linked &= groups[:, None] != groups[None, :]  # the diagonal, which is not exact, too
    first = np.arange(m)
    u, v = np.nonzero(linked)
    while len(u):
        low = first.copy()
        np.minimum.at(low, u, first[v])
        low = low[low]
        if (low == first).all():
            break
        first = low
    return first


def block_links(blocks: DataFrame, n: int, sim: Similarity) -> DataFrame:
    """``(u, v)``: links of documents of different settled groups that join what is linked inside a block; rows ``(head, row, col, doc_id, settled, body)``.

    One block is held at a time, two parts of a star; at most one row a document leaves it.
    """
    def run(batches):
        np.seterr(over="ignore")

        def links(docs, groups, sets):
            for at, first in enumerate(_linked_in_block(sets, np.array(groups, np.int64), sim).tolist() if len(sets) > 1 else ()):
                if docs[at] != docs[first]:
                    yield docs[at], docs[first]

        def rows():
            key, docs, groups, sets = None, [], [], []
            for b in batches:
                for head, row, col, doc, group, body in zip(*(c.to_pylist() for c in b.columns)):
                    if (head, row, col) != key:
                        yield from links(docs, groups, sets)
                        key, docs, groups, sets = (head, row, col), [], [], []
                    if len(grams := gram_set(body, n)):
                        docs.append(doc), groups.append(group), sets.append(grams)
            yield from links(docs, groups, sets)

        return rows_to_batches(rows(), pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    dealt = blocks.select("head", "row", "col", "doc_id", "settled", "body").repartition("head", "row", "col").sortWithinPartitions("head", "row", "col")
    return dealt.mapInArrow(run, "u long, v long")


def differences(stars: DataFrame, n: int, sim: Similarity) -> DataFrame:
    """``(head, doc_id, variant, size, width, reach, far, edits)``: each document of a star by the n-grams that it or the centre has alone.

    ``width`` is their number, ``reach`` the sizes of both sets together, ``far`` says that
    the two are not linked. A document of several texts has a row for each; of
    several texts of the centre the one of the smallest bytes is used. Streams: only the centre is held.
    """
    schema = pa.schema([("head", pa.int64()), ("doc_id", pa.int64()), ("variant", pa.int64()), ("size", pa.int64()), ("width", pa.int64()), ("reach", pa.int64()), ("far", pa.bool_()), ("edits", pa.binary())])

    def run(batches):
        np.seterr(over="ignore")

        def rows():
            key, centre, last, seen = None, None, None, set()
            for b in batches:
                for head, part, outer, doc, body in zip(*(c.to_pylist() for c in b.columns)):
                    if (head, part) != key:
                        key, centre, last = (head, part), None, None
                    grams = gram_set(body, n)
                    if not len(grams):
                        continue
                    if not outer:
                        centre = grams if centre is None or grams.tobytes() < centre.tobytes() else centre
                        continue
                    if doc != last:
                        last, seen = doc, set()
                    if (variant := _digest(grams)[1]) in seen:
                        continue
                    seen.add(variant)
                    edits, reach = np.setxor1d(grams, centre, assume_unique=True), len(grams) + len(centre)
                    far = len(edits) * (sim.den + sim.num) > reach * (sim.den - sim.num)
                    yield head, doc, variant, len(grams), len(edits), reach, far, edits.tobytes()

        return rows_to_batches(rows(), schema, 500)

    dealt = stars.repartition("head", "part").sortWithinPartitions("head", "part", "outer", "doc_id")
    return dealt.mapInArrow(run, "head long, doc_id long, variant long, size long, width long, reach long, far boolean, edits binary")


def _by_differences(edits: DataFrame, groups: DataFrame, sim: Similarity) -> DataFrame:
    """``(u, v, low, high)`` of documents round one centre that may be linked, by a prefix filter on their differences from it.

    Two sets differ where just one of them differs from the centre, so linked ones
    have ``need`` differences in common, by their numbers. Where neither is ``far``, both
    are linked with the centre; otherwise ``need`` is 1 or more, and they share one
    among the rarest of each, all but ``need`` - 1 of them. What all copies of a text have
    is no difference, and their own edits are rare: families of copies meet in few pairs.
    """
    num, den = sim.num, sim.den
    schema = pa.schema([(c, pa.int64()) for c in ("head", "doc_id", "variant", "gram")])

    def run(batches):
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                grams = np.frombuffer(row[3], np.int64)
                for at in range(0, len(grams), 50_000):
                    part = grams[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(part), x)) for x in row[:3]), pa.array(part)], schema=schema)

    one = ["head", "doc_id", "variant"]
    e = edits.select(*one, "edits").mapInArrow(run, "head long, doc_id long, variant long, gram long")
    e = e.withColumn("often", F.count("*").over(Window.partitionBy("head", "gram"))).where("often > 1")
    own = Window.partitionBy(*one)
    e = e.withColumn("left", F.row_number().over(own.orderBy(F.desc("often"), F.desc("gram"))))  # differences from this one on, the rarest first
    e = e.join(edits.select(*one, "size", "width", "reach", "far"), one)
    # at least so many in common with any other one, and with a far one
    e = e.withColumn("any", F.expr(f"greatest(1, ceil((width * {den + num} - reach * {den - num}) / {2 * (den + num)}))"))
    e = e.withColumn("with_far", F.expr(f"greatest(1, ceil(width * {num} / {den + num}))"))
    e = checkpointed(e.where("left >= with_far or far and left >= any").join(groups, "doc_id"))
    side = lambda c: e.where("far and left >= any" if c == "a" else "left >= with_far").select("head", "gram", *(F.col(x).alias(f"{c}_{x}") for x in ("doc_id", "settled", "size", "width", "left")))
    need = f"(a_width + b_width) * {den + num} - (a_size + b_size) * {den - num} <= {2 * (den + num)} * least(a_left, b_left)"
    return side("a").join(side("b"), ["head", "gram"]).where(f"a_settled <> b_settled and {need}").transform(_pairs).distinct()


def near_maps(pairs: DataFrame, maps: DataFrame, sim: Similarity) -> DataFrame:
    """``(u, v, low, high, apart)``: those pairs that sizes and bitmaps leave open; one map a pair is shuffled."""
    schema = pa.schema([(c, pa.int64()) for c in ("u", "v", "low", "high", "apart")])
    num, den = sim.num, sim.den

    def run(batches):
        def rows():
            for b in batches:
                for u, v, low, high, un, um, vn, vm in zip(*(c.to_pylist() for c in b.columns)):
                    if min(un, vn) * den >= num * max(un, vn) and (d := _apart(um, vm)) * (den + num) <= (un + vn) * (den - num):
                        yield u, v, low, high, d

        return rows_to_batches(rows(), schema)

    of = lambda c: maps.select(F.col("doc_id").alias(c), F.col("grams").alias(f"{c}n"), F.col("map").alias(f"{c}m"))
    both = pairs.join(of("v"), "v").join(of("u"), "u").select("u", "v", "low", "high", "un", "um", "vn", "vm")
    return both.mapInArrow(run, "u long, v long, low long, high long, apart long")


def _stars(pairs: DataFrame) -> DataFrame:
    """``(head, part, outer, doc_id)``: each document with the smaller one that most chains join it with, in parts of bounded size."""
    return _dealt(checkpointed(pairs.groupBy("u").agg((-F.max(F.struct("n", (-F.col("v")).alias("v")))["v"]).alias("head"))))


def _dealt(best: DataFrame, grams: Column | None = None) -> DataFrame:
    """``(head, part, outer, doc_id)`` of pairs ``(u, head)``: each head with parts of at most about ``STAR`` others and ``BLOCK_GRAMS`` n-grams."""
    parts = best.groupBy("head").agg(F.ceil(F.greatest(F.count("*") / STAR, F.sum(F.lit(0) if grams is None else grams) / BLOCK_GRAMS)).alias("parts"))
    heads = parts.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("outer"), F.col("head").alias("doc_id"))
    outer = best.join(parts, "head").select("head", F.pmod(F.xxhash64("u"), "parts").alias("part"), F.lit(True).alias("outer"), F.col("u").alias("doc_id"))
    return heads.unionByName(outer)


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with ``body``, the text of their ``doc_id``; few rows go to the texts, many meet them in a shuffle."""
    rows = checkpointed(rows)
    return docs.select("doc_id", text_bytes().alias("body")).join(sized(rows, rows.count()), "doc_id")


def unsettled(groups: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(sig, doc_id, settled)``: the memberships of signatures that still join different settled groups."""
    label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))
    cross = pairs.select("u", "v").join(label("u"), "u", "left").join(label("v"), "v", "left")
    cross = cross.select(F.coalesce("u_group", "u").alias("a"), F.coalesce("v_group", "v").alias("b")).where("a <> b")
    open_groups = checkpointed(cross.select(F.explode(F.array("a", "b")).alias("settled")).distinct())
    # a group has the id of one of its documents; those without a label are groups of their own
    inside = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("settled")).join(open_groups, "settled", "left_semi")
    inside = checkpointed(inside.unionByName(open_groups.select(F.col("settled").alias("doc_id"), "settled")).distinct())
    held = memberships(groups).join(sized(inside, inside.count()), "doc_id")
    alive = held.groupBy("sig").agg(F.min("settled").alias("low"), F.max("settled").alias("high")).where("low <> high")
    return held.join(alive.select("sig"), "sig", "left_semi")


def cross_links(narrow: DataFrame, members: DataFrame, sizes: DataFrame, n: int, sim: Similarity) -> DataFrame:
    """``(u, v)``: links between settled groups, from pairs that share a signature.

    Bitmaps leave few pairs open. Of any two groups the pair least apart is held
    against each other first; where it is linked the groups need no other, where it
    is not all their pairs are. So texts go to pairs that are nearly linked only,
    however many documents signatures connect.
    """
    ids = checkpointed(members.select("doc_id").distinct().join(sizes, "doc_id"))
    few = sized(ids, ids.count())
    texts = narrow.select("doc_id", text_bytes().alias("body")).join(few, "doc_id", "left_semi")
    maps = checkpointed(bitmaps(texts, n))
    met, links = _meeting(members, narrow, few, n, sim)
    near = checkpointed(near_maps(met, maps, sim))
    release(ids, maps)
    best = checkpointed(near.groupBy("low", "high").agg(F.min(F.struct("apart", "u", "v")).alias("p")).select("low", "high", "p.u", "p.v"))
    linked = checkpointed(_verified(best.select("u", F.col("v").alias("head")), narrow, n, sim))
    done = best.join(linked, ["u", "v"], "left_semi").select("low", "high")
    rest = checkpointed(near.join(done, ["low", "high"], "left_anti").join(best, ["u", "v"], "left_anti").select("u", F.col("v").alias("head")).distinct())
    release(near, best)
    linked = linked.unionByName(links)
    return linked if rest.isEmpty() else linked.unionByName(_verified(rest, narrow, n, sim))


def _verified(pairs: DataFrame, narrow: DataFrame, n: int, sim: Similarity) -> DataFrame:
    """``(u, v)``: the linked ones of pairs ``(u, head)``."""
    return star_links(_with_text(_dealt(pairs), narrow).select("head", "part", "outer", "doc_id", "body"), n, sim)


def ngram_components(docs: DataFrame, n: int = 5, sim: Similarity = Similarity(4, 5)) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``."""
    narrow = docs.select("doc_id", "text")
    first = checkpointed(set_digests(narrow, n))
    common = docs.sparkSession.sparkContext.broadcast(common_grams(first))
    digests = first.where("n_shingles >= 0")
    real = digests.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("most")).where("v < most")
    classes = checkpointed(classes)
    copies = real.join(sized(classes, classes.count()), ["d1", "d2"]).select(F.col("doc_id").alias("u"), "v")
    sizes = real.groupBy("doc_id").agg(F.max("n_shingles").alias("grams"))

    total = digests.agg(F.sum("n_shingles")).first()[0] or 0
    groups = checkpointed(signature_groups(narrow, n, sim, max(16, -(-total // BUCKET_GRAMS)), common))
    pairs = checkpointed(chained_pairs(groups))
    near = star_links(_with_text(_stars(pairs), narrow).select("head", "part", "outer", "doc_id", "body"), n, sim)
    settled = connected_components(near.unionByName(copies))
    open_members = checkpointed(unsettled(groups, pairs, settled))
    found = settled
    if not open_members.isEmpty():
        more = cross_links(narrow, open_members, sizes, n, sim)
        found = connected_components(more.unionByName(settled.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    found = found.select(F.col("node").alias("doc_id"), "component")
    out = checkpointed(digests.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
    release(first, classes, groups, pairs, open_members)
    return out


def one_of_each(docs: DataFrame, n: int = 5, sim: Similarity = Similarity(4, 5)) -> DataFrame:
    """``docs`` with the smallest id of every component; its columns stay.

    Rows with a null id, and rows repeating a kept id, stay.
    """
    gone = ngram_components(docs, n, sim).where("doc_id <> component_id").select("doc_id").distinct()
    gone = checkpointed(gone)
    return docs.join(sized(gone, gone.count()), "doc_id", "left_anti").select(*columns_of(docs))
