"""k-mers, Gray adjacency, K-maps and sequence signatures of whole sequences.

Neighbours are formed inside each sequence, so nothing is shuffled by sequence;
only counts per cell are. Raw texts are coded and counted by table look-up, a
megabyte of an Arrow batch at a time; a task leaves at most 21^k counts (k <= 4).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import BASE20, GAP, gray, gray_distance, kmer_cell, rounded, valid
from ..shared import checkpointed, exact_percentile, with_total
from .pairs import PAIR, pair_counts

STATES = GAP + 1


def _runs(k: int) -> Column:
    """All windows of k codes of ``codes``, as structs c0..c(k-1)."""
    n = F.greatest(F.size("codes") - (k - 1), F.lit(0))
    return F.arrays_zip(*(F.slice("codes", F.lit(1 + i), n).alias(f"c{i}") for i in range(k)))


def windows(p: DataFrame, k: int) -> DataFrame:
    """``(seq_id, c0, ...)`` of every window of k codes."""
    names = [f"c{i}" for i in range(k)]
    out = p.select("seq_id", F.explode_outer(_runs(k)).alias("w")).where("w is not null")
    return out.select("seq_id", "w.*").toDF("seq_id", *names)


def adjacent_counts(p: DataFrame) -> DataFrame:
    """``(c0, c1, n)`` over all sequences, gaps included: at most 441 rows."""
    return windows(p, 2).groupBy("c0", "c1").agg(F.count("*").alias("n"))


def _code_table(alphabet: str) -> np.ndarray:
    """The code of each byte that begins a character."""
    table = np.full(256, GAP, np.uint8)
    for k, letter in enumerate(alphabet):
        table[ord(letter)] = table[ord(letter.lower())] = k
    return table


PIECE = 1 << 20  # bytes of text coded at once


def _text_runs(texts: pa.Array, k: int, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Base-21 cells of the runs of k characters of one batch, by pieces of its bytes whatever the texts' lengths.

    With them: which ones lie inside one text, the row of the first, and how many cells come before each further row.
    """
    texts = pa.array(texts).cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8) if last > first else None
    for at in range(first, last, PIECE):
        end = min(at + PIECE, last)
        part = data[at : min(end + 4 * k, last)]  # runs that begin in the piece end here at the latest
        leads = part & 0xC0 != 0x80
        before = np.concatenate(([0], np.cumsum(leads)))
        codes = table[part[leads]].astype(np.int64)
        n = min(int(before[end - at]), len(codes) - k + 1)
        if n <= 0:
            continue
        row = int(np.searchsorted(offsets, at, "right")) - 1
        starts = before[offsets[row + 1 : np.searchsorted(offsets, at + len(part))] - at]
        cells = codes[:n].copy()
        for i in range(1, k):
            cells *= STATES
            cells += codes[i : n + i]
        inside = np.ones(n, bool)
        for i in range(1, k):  # those that reach over the end of a text
            over = starts - i
            inside[over[(over >= 0) & (over < n)]] = False
        yield cells, inside, row, starts


def batch_maps(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a batch the counts of its valid letters, and of its valid neighbours as 20 x 20."""
    rows, out = len(texts), []
    for k in (1, 2):
        counts = np.zeros(rows * STATES**k, np.int64)
        for cells, inside, row, starts in _text_runs(texts, k, table):
            own = np.diff(np.minimum(np.concatenate(([0], starts, [len(cells)])), len(cells)))
            cells += np.repeat(np.arange(len(own)) * STATES**k, own)
            found = np.bincount(cells[inside], minlength=1)
            counts[row * STATES**k : row * STATES**k + len(found)] += found
        out.append(counts.reshape(rows, *[STATES] * k))
    return out[0][:, :GAP], out[1][:, :GAP, :GAP]


def text_counts(sequences: DataFrame, k: int, alphabet: str = BASE20) -> DataFrame:
    """``(c0, ..., n)`` of all runs of k characters of ``sequence``, gaps included."""
    table = _code_table(alphabet)

    def count(batches):
        found = np.zeros(STATES**k if k <= 4 else 0, np.int64)
        for b in batches:
            for cells, inside, _, _ in _text_runs(b.column(0), k, table):
                if k <= 4:
                    found += np.bincount(cells[inside], minlength=len(found))
                else:
                    yield rows(*np.unique(cells[inside], return_counts=True))
        cell = np.flatnonzero(found)
        yield rows(cell, found[cell])

    def rows(cell, n):
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    found = sequences.select("sequence").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return found.select(*(F.expr(f"cast(cell div {STATES ** (k - 1 - i)} % {STATES} as int)").alias(f"c{i}") for i in range(k)), "n")


def transitions(cells: DataFrame, *order: str) -> DataFrame:
    """``(c0, c1, n)`` of a long table ``(seq_id, code, ...)``: neighbours by ``order``, streamed and not gathered."""
    after = F.lead("code").over(Window.partitionBy("seq_id").orderBy(*order))
    return cells.select(F.col("code").alias("c0"), after.alias("c1")).where("c1 is not null").groupBy("c0", "c1").agg(F.count("*").alias("n"))


def kmer_counts(p: DataFrame, k: int) -> DataFrame:
    """``(c0, ..., n)`` of all windows of k codes, gaps included."""
    w = windows(p, k)
    return w.groupBy(*w.columns[1:]).agg(F.count("*").alias("n"))


def kmer_map(counts: DataFrame, k: int) -> DataFrame:
    """``(cell, n, freq)`` of base-20 k-mers from counts of k codes; those with a gap are skipped."""
    cs = [F.col(f"c{i}") for i in range(k)]
    ok = valid(cs[0])
    for c in cs[1:]:
        ok = ok & valid(c)
    g = counts.where(ok).select(kmer_cell(*cs).alias("cell"), "n")
    return with_total(g, "n").select("cell", "n", rounded(F.col("n").cast("double") / F.col("total"), 9).alias("freq"))


def gray_map(adjacent: DataFrame) -> DataFrame:
    """The 32 x 32 map of Gray-coded neighbours: ``(cell, n, freq)`` with cell = 32 g0 + g1."""
    v = adjacent.where(valid(F.col("c0")) & valid(F.col("c1")))
    cell = (gray(F.col("c0")) * 32 + gray(F.col("c1"))).cast("long")
    return with_total(v, "n").select(cell.alias("cell"), "n", rounded(F.col("n").cast("double") / F.col("total"), 9).alias("freq"))


def _parts(batches, rows: int = 1000):
    """Batches of at most ``rows`` rows: a map a row is held at a time."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def consensus_map(sequences: DataFrame, alphabet: str = BASE20) -> DataFrame:
    """Unweighted mean of the sequences' own frequency maps, ``(cell, freq)``.

    A batch leaves 400 sums at most; a sequence without valid neighbours counts for nothing.
    """
    table, codes = _code_table(alphabet), np.arange(GAP)
    grays = codes ^ codes >> 1
    cell = (grays[:, None] * 32 + grays[None]).ravel()

    def mean(batches):
        for b in _parts(batches):
            _, maps = batch_maps(b.column(0), table)
            total = maps.sum((1, 2))
            use = total > 0
            s = (maps[use] / total[use, None, None]).sum(0).ravel()
            some = s > 0
            out = [pa.array(np.append(cell[some], -1)), pa.array(np.append(s[some], float(use.sum())))]
            yield pa.RecordBatch.from_arrays(out, names=["cell", "s"])

    sums = sequences.select("sequence").mapInArrow(mean, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s"))
    seqs = sums.where("cell = -1").select(F.col("s").alias("seqs"))
    return sums.where("cell >= 0").crossJoin(F.broadcast(seqs)).select("cell", rounded(F.col("s") / F.col("seqs"), 9).alias("freq"))


def threshold_map(m: DataFrame, share: float = 0.75) -> DataFrame:
    """Cells at or above the exact percentile of the non-zero cells."""
    m = checkpointed(m)
    cut = F.lit(exact_percentile(m.where("freq > 0"), "freq", share)).cast("double")
    return m.where(F.col("freq") >= cut).select("cell", "freq", rounded(cut, 9).alias("threshold"))


def gray_adjacency(adjacent: DataFrame, include_gap: bool = False) -> DataFrame:
    """``(distance, n, share, enrichment)`` of neighbours' Gray distances; enrichment against 5/31 at distance 1."""
    v = adjacent if include_gap else adjacent.where(valid(F.col("c0")) & valid(F.col("c1")))
    g = v.groupBy(gray_distance(F.col("c0"), F.col("c1")).cast("int").alias("distance")).agg(F.sum("n").alias("n"))
    g, share = with_total(g, "n"), F.col("n").cast("double") / F.col("total")
    return g.select("distance", "n", rounded(share).alias("share"), rounded(F.when(F.col("distance") == 1, share / (5 / 31))).alias("enrichment"))


def signatures(sequences: DataFrame, alphabet: str = BASE20) -> DataFrame:
    """Per sequence with valid letters: length, share of G and C, entropy of composition, norm of its K-map."""
    table, gc_codes = _code_table(alphabet), [alphabet.index(x) for x in "GC"]

    def sign(batches):
        for b in _parts(batches):
            letters, maps = batch_maps(b.column(1), table)
            length = letters.sum(1)
            use = length > 0
            letters, n = letters[use], length[use]
            q = letters / n[:, None]
            h = -(q * np.log2(np.where(q > 0, q, 1))).sum(1)
            norm = np.sqrt((maps[use].astype(np.float64) ** 2).sum((1, 2)))
            ids = b.column(0).filter(pa.array(use))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(letters[:, gc_codes].sum(1) / n), pa.array(h), pa.array(norm)], names=["seq_id", "length", "gc", "h", "norm"])

    s = sequences.select(F.col("seq_id").cast("long").alias("seq_id"), "sequence").mapInArrow(sign, "seq_id long, length long, gc double, h double, norm double")
    return s.select("seq_id", "length", rounded(F.col("gc")).alias("gc_share"), rounded(F.col("h")).alias("entropy"), rounded(F.col("norm")).alias("map_norm"))


def signature_correlations(s: DataFrame) -> DataFrame:
    return s.agg(rounded(F.corr("length", "entropy")).alias("length_entropy"), rounded(F.corr("length", "map_norm")).alias("length_norm"), rounded(F.corr("gc_share", "entropy")).alias("gc_entropy"))


def sequence_maps(p: DataFrame, first: int = 10) -> DataFrame:
    """``(seq_id, c0, c1, n)``: neighbour counts of the first sequences by id, gaps left out."""
    some = p.orderBy("seq_id").limit(first)
    return windows(some, 2).where(valid(F.col("c0")) & valid(F.col("c1"))).groupBy("seq_id", "c0", "c1").agg(F.count("*").alias("n"))


def gray_correlations(p: DataFrame, least: float = 0.7, max_cols: int = 200) -> DataFrame:
    """Pearson correlation of columns' Gray codes (gap as 0), where |r| exceeds ``least``.

    From counts of column pairs, so the number of sequences does not matter.
    """
    pc = pair_counts(p.select("seq_id", F.slice("codes", 1, max_cols).alias("codes")), max_cols)
    g = lambda c: F.when(valid(F.col(c)), gray(F.col(c))).otherwise(0).cast("double")
    w = pc.select(*PAIR, F.col("n").cast("double").alias("n"), g("code_i").alias("x"), g("code_j").alias("y"))
    n, x, y = F.sum("n"), F.sum(F.col("n") * F.col("x")), F.sum(F.col("n") * F.col("y"))
    xy, xx, yy = (F.sum(F.col("n") * F.col(a) * F.col(b)) for a, b in (("x", "y"), ("x", "x"), ("y", "y")))
    s = w.groupBy(*PAIR).agg((n * xy - x * y).alias("c"), ((n * xx - x * x) * (n * yy - y * y)).alias("v"))
    return s.where("v > 0").select(*PAIR, rounded(F.col("c") / F.sqrt("v")).alias("r")).where(F.abs("r") > least)


def motif_counts(adjacent: DataFrame, implicants: DataFrame) -> DataFrame:
    """Occurrences of each implicant ``(implicant, values, mask)`` among neighbours.

    The neighbours are counted first (at most 400 cells); gaps match nothing.
    """
    v = adjacent.where(valid(F.col("c0")) & valid(F.col("c1"))).withColumn("cell", gray(F.col("c0")) * 32 + gray(F.col("c1")))
    fits = F.col("cell").bitwiseXOR(F.col("values")).bitwiseAND(F.bitwise_not("mask")).bitwiseAND(F.lit(1023)) == 0
    return F.broadcast(implicants).join(v, fits).groupBy("implicant").agg(F.sum("n").alias("n"))


def map_symmetry(adjacent: DataFrame) -> DataFrame:
    """Mean |K - K transposed| over the 400 cells of the neighbour frequencies."""
    v = adjacent.where(valid(F.col("c0")) & valid(F.col("c1")))
    f = with_total(v, "n").select("c0", "c1", (F.col("n").cast("double") / F.col("total")).alias("f"))
    t = f.select(F.col("c0").alias("c1"), F.col("c1").alias("c0"), F.col("f").alias("g"))
    d = f.join(t, ["c0", "c1"], "full").select(F.abs(F.coalesce("f", F.lit(0.0)) - F.coalesce("g", F.lit(0.0))).alias("d"))
    return d.agg(rounded(F.sum("d") / 400, 9).alias("symmetry_error"))


def distance_histogram(residues: DataFrame) -> DataFrame:
    """``(distance, share)``: Gray distances of all unordered pairs of valid letters of all sequences, from the letters' counts ``(c0, n)``."""
    v = residues.where(valid(F.col("c0"))).select(F.col("c0").alias("a"), F.col("n").cast("double").alias("n"))  # at most 20 rows
    both = v.join(v.toDF("b", "m"), F.col("a") <= F.col("b"))
    pairs = both.select(gray_distance(F.col("a"), F.col("b")).cast("int").alias("distance"), F.when(F.col("a") == F.col("b"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("m")).alias("p"))
    return with_total(pairs.groupBy("distance").agg(F.sum("p").alias("p")), "p").select("distance", rounded(F.col("p") / F.col("total"), 9).alias("share"))


def map_autocorrelation(adjacent: DataFrame, cells: int = 64) -> DataFrame:
    """``(lag, r)``: normalised autocorrelation of the first cells of the flattened map."""
    v = adjacent.where(valid(F.col("c0")) & valid(F.col("c1")))
    f = with_total(v, "n").select((F.col("c0") * 20 + F.col("c1")).alias("cell"), (F.col("n").cast("double") / F.col("total")).alias("f")).where(F.col("cell") < cells)
    lag = f.alias("a").join(f.alias("b"), F.col("b.cell") >= F.col("a.cell")).groupBy((F.col("b.cell") - F.col("a.cell")).alias("lag")).agg(F.sum(F.col("a.f") * F.col("b.f")).alias("s"))
    zero = lag.agg(F.max(F.when(F.col("lag") == 0, F.col("s"))).alias("zero"))
    return lag.crossJoin(F.broadcast(zero)).select("lag", rounded(F.col("s") / F.col("zero")).alias("r"))


def median_split(mi: DataFrame, on: DataFrame, first: DataFrame) -> DataFrame:
    """Whether pairs of columns whose residues are frequent neighbours are the more informative ones.

    ``on`` holds the cells of the K-map's on-set (Gray codes, 32 g0 + g1), ``first``
    the codes ``(pos, code)`` of the first sequence. A pair with information is on if
    that sequence's two residues are an on-cell in either order. Accuracy is the
    share of pairs on the right side of the median: on above it, the others not.
    """
    code = lambda c: first.select(F.col("pos").alias(f"pos_{c}"), F.when(valid(F.col("code")), gray(F.col("code"))).alias(c))
    m = mi.where("mi > 0").select(*PAIR, "mi").join(F.broadcast(code("i")), "pos_i").join(F.broadcast(code("j")), "pos_j")
    cells = F.broadcast(on.select(F.array(F.floor(F.col("cell") / 32), F.col("cell") % 32).alias("x")))
    either = cells.unionByName(cells.select(F.reverse("x").alias("x"))).distinct().select(F.col("x")[0].cast("int").alias("i"), F.col("x")[1].cast("int").alias("j"), F.lit(True).alias("on"))
    m = m.join(F.broadcast(either), ["i", "j"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    m = checkpointed(m)
    m = m.withColumn("cut", F.lit(exact_percentile(m, "mi", 0.5)).cast("double"))
    right = F.when(F.col("on") == (F.col("mi") > F.col("cut")), 1.0).otherwise(0.0)
    mean = lambda c: rounded(F.coalesce(F.avg(F.when(c, F.col("mi"))), F.lit(0.0)))
    return m.agg(F.count_if("on").alias("n_on"), F.count_if(~F.col("on")).alias("n_off"), mean(F.col("on")).alias("mean_on"), mean(~F.col("on")).alias("mean_off"), rounded(F.coalesce(F.avg(right), F.lit(0.0))).alias("accuracy"))
