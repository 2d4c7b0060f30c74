"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Windows as long as each benchmark item slide over every text, one length after
the other, whatever item has it; each window gets a 64-bit SimHash of its
shingles. Similarity s takes s / (1 + s) of both sizes in common shingles, so a
window with fewer places of shingles that any item of its length has cannot match
and is not hashed; nothing else is passed over. Items are indexed by eight 8-bit blocks of
their own SimHash, each with every variant of at most two flipped bits:
fingerprints within ``RADIUS`` = 23 bits differ in at most two bits in one of the
eight blocks, so the index finds all of them, and it alone says which items a
window is held against. Those are verified by weighted Jaccard similarity of
their shingles (the weight of a shingle is its number of occurrences).

The index carries numbers only; the items' shingles join the survivors.

Words are the longest runs of letters and digits, lower-cased, so punctuation
and case do not hide a passage. Texts and items are read whole.

Defined cases: null, empty or shorter-than-five-word texts have no shingles and
match nothing, and neither do such items; a window never reaches over the ends
of its text, and a text shorter than an item is one window; repeated rows are
one text with their ``doc_id``; items with equal text each match; a null
``doc_id`` or ``item_id`` takes no part. Only ``doc_id``, ``text`` and
``item_id`` are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, columns_of, sized

WORDS = 5
RADIUS = 23
BLOCKS = 8
FLIPS = [0, *(1 << i for i in range(8)), *(1 << i | 1 << j for i, j in combinations(range(8), 2))]


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: str) -> Column:
    """Hashes of all runs of five words, in order; empty below five words."""
    n = F.size(w) - (WORDS - 1)
    starts = F.slice(F.col(w), 1, F.greatest(n, F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(F.col(w), i + k) for k in range(1, WORDS))))


def simhash(hashes: Column) -> Column:
    """The 64-bit SimHash of an array of hashes: bit i is the majority of bit i."""
    def bit(i: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.when(F.getbit(h, i) == 1, 1).otherwise(-1))
        return F.when(ones > 0, 1).otherwise(0).cast("long")

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: bit(i))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def item_index(benchmark: DataFrame) -> DataFrame:
    """``(item_id, n, item_shingles, item_hash, item_repeats)`` of each item with at least five words."""
    items = benchmark.where("item_id is not null").select("item_id", words().alias("w")).distinct().where(F.size("w") >= WORDS)
    items = items.select("item_id", shingles("w").alias("item_shingles"), (F.size("w") - (WORDS - 1)).alias("n"))
    items = items.withColumns({"item_hash": simhash(F.col("item_shingles")), "ordered": F.array_sort("item_shingles")})
    return items.withColumn("item_repeats", repeated("ordered")).drop("ordered")


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """``(doc_id, item_id, start, distance, common, total)`` of each matching window.

    ``start`` counts shingles from 0 in the text; similarity is common / total, at least num / den.
    """
    items = checkpointed(item_index(benchmark))
    counts = items.agg(F.count("*"), F.sum("n")).first()
    n_items, n_places = counts[0], counts[1] or 0

    known = items.select("n", F.explode("item_shingles").alias("h")).distinct()
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    runs = texts.select("doc_id", words().alias("w"), F.xxhash64("text").alias("row")).select("doc_id", "row", shingles("w").alias("s"))
    # The size goes below the generator, so that no exploded row carries the array; an outer generator,
    # as for an inner one the optimizer would filter on the array's size and inline the whole expression.
    spread = runs.select("doc_id", "row", "s", F.size("s").alias("size")).select("doc_id", "row", "size", F.posexplode_outer("s").alias("pos", "h"))
    met = spread.join(sized(known, n_places), "h").groupBy("doc_id", "row", "size", "n").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    long = F.least("n", "size")
    need = F.ceil((F.col("n") + long) * num / F.lit(float(num + den)) - 1e-9).cast("int")
    met = met.select("doc_id", "row", "n", "size", "at", long.alias("long"), need.alias("need")).where(F.size("at") >= F.col("need"))
    # the windows that hold the ``need`` places from the i-th on, moved inside the text
    low = lambda i: F.greatest(F.lit(0), F.get("at", i + F.col("need") - 1) - F.col("long") + 1)
    high = lambda i: F.least(F.get("at", i), F.col("size") - F.col("long"))
    held_by = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.when(low(i) <= high(i), F.struct(low(i).alias("low"), high(i).alias("high"))))
    spans = met.select("doc_id", "row", "n", F.explode(F.array_distinct(F.filter(held_by, lambda x: x.isNotNull()))).alias("x"))
    starts = checkpointed(spans.select("doc_id", "row", "n", F.explode(F.sequence("x.low", "x.high")).alias("start")).distinct())

    hit = checkpointed(starts.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("spans")))
    few = sized(hit.select("doc_id", "row"), hit.count())
    held = texts.withColumn("row", F.xxhash64("text")).join(few, ["doc_id", "row"], "left_semi").join(sized(hit, starts.count()), ["doc_id", "row"])
    held = held.select("doc_id", "row", "spans", words().alias("w")).select("doc_id", "row", "spans", shingles("w").alias("s"))
    # one window at a time: all windows of a text are many times the text
    windows = held.select("doc_id", "row", "s", F.explode_outer("spans").alias("x"))
    windows = windows.select("doc_id", "row", F.col("x.start").alias("start"), F.col("x.n").alias("n"), F.slice("s", F.col("x.start") + 1, F.col("x.n")).alias("window"))
    windows = windows.withColumn("hash", simhash(F.col("window")))

    block = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    keys = items.select("item_id", "n", "item_hash", F.explode(block).alias("k"))
    keys = keys.withColumn("part", F.expr("cast(shiftrightunsigned(item_hash, 8 * k) & 255 as int)"))
    keys = keys.withColumn("flip", F.explode(F.array(*map(F.lit, FLIPS)))).withColumn("part", F.col("part").bitwiseXOR(F.col("flip"))).drop("flip")
    probes = windows.withColumn("k", F.explode(block)).withColumn("part", F.expr("cast(shiftrightunsigned(hash, 8 * k) & 255 as int)"))
    distance = F.bit_count(F.col("hash").bitwiseXOR(F.col("item_hash")))
    near = probes.join(sized(keys, n_items * BLOCKS * len(FLIPS)), ["n", "k", "part"]).withColumn("distance", distance).where(F.col("distance") <= RADIUS)
    # the same pair comes once from each agreeing block: keep its first
    first = F.expr("""array_min(filter(sequence(0, 7), b ->
        bit_count((shiftrightunsigned(hash, 8 * b) ^ shiftrightunsigned(item_hash, 8 * b)) & 255) <= 2))""")
    near = near.where(F.col("k") == first).join(sized(items, n_places), ["item_id", "n", "item_hash"])
    near = near.withColumn("ordered", F.array_sort("window")).withColumn("again", F.array_intersect(repeated("ordered"), F.col("item_repeats")))

    common = _common(F.col("window"), F.col("item_shingles"), F.col("again"))
    total = F.size("window") + F.size("item_shingles") - F.col("common")
    out = near.withColumn("common", common).withColumn("total", total).where(F.col("common") * den >= F.col("total") * num)
    return out.select("doc_id", "item_id", "start", "distance", "common", "total").distinct()


def repeated(ordered: str) -> Column:
    """The elements that occur more than once in a sorted array column."""
    return F.array_distinct(F.filter(ordered, lambda x, i: F.get(F.col(ordered), i + 1) == x))


def _common(a: Column, b: Column, again: Column) -> Column:
    """The number of common elements, each counted as often as both have it; ``again`` holds those that both repeat."""
    def more(x: Column) -> Column:
        return F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))) - 1

    return F.aggregate(again, F.size(F.array_intersect(a, b)), lambda n, x: n + more(x))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per text and item found in it: the places with matching windows and the best window.

    Windows that begin one after the other are one place.
    """
    found = contaminated_windows(docs, benchmark).withColumn("similarity", F.col("common") / F.col("total"))
    before = F.lag("start").over(Window.partitionBy("doc_id", "item_id").orderBy("start"))
    found = found.withColumn("place", F.coalesce(F.col("start") > before + 1, F.lit(True)).cast("int"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(F.sum("place").alias("n_windows"), best).select(
        "doc_id", "item_id", "n_windows", F.col("best.similarity").alias("similarity"), (-F.col("best.start")).alias("start")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; its columns stay, rows with null ids too."""
    gone = checkpointed(contaminated_windows(docs, benchmark).select("doc_id").distinct())
    return docs.join(sized(gone, gone.count()), "doc_id", "left_anti").select(*columns_of(docs))
