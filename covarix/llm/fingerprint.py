"""Document fingerprints: the canonical exact digest, in DataFrame functions only.

Texts are folded to one canonical form: compatibility decomposition, case
folding, marks in canonical order, runs of white space as one space, none at
the ends. Two xxhash64 lanes of the canonical form are the bucket. Inside a
bucket that more than one text shares, the canonical texts themselves are
grouped, byte by byte; should two different ones ever meet, each further one
gets a number behind its digest. So fingerprints are equal exactly if the
canonical texts are.

White space is Unicode's White_Space. The folding of a code point comes from the
Unicode tables of ``unicodedata``; marks are put in order where the JVM's
tables know them as marks.

To fingerprint edited texts, a document must meet the next one by descending
id. Ids are cut into ranges at quantiles; each range is one group of a window,
and the first document of a range is also sent, as a guest, to the range
before it. Texts are shuffled once.

Defined cases: a null text is empty, and the empty text has a fingerprint like
any other; null ids come last; rows sharing an id are ordered by text, in one
task; repeated rows count each; a single document is its own next one; an empty
table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns may
have any name.
"""

from __future__ import annotations

import json
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, release, sized

# fixed values of Unicode: the parts of Hangul syllables, and the iota below
HANGUL, SYLLABLES, LEADS, VOWELS, TAILS = 0xAC00, 11172, 0x1100, 0x1161, 0x11A7
N_VOWELS, N_TAILS, N_LEADS = 21, 28, 19
IOTA_BELOW, IOTA = "\u0345", "\u03b9"
OTHER_SPACE = r"\x09-\x0D\x85\u1680\u2028\u2029"  # what decomposition leaves besides the space

MOST_RANGES = 10_000
Folds = tuple[str, str, str]


def _fold(c: str) -> str:
    """Decomposed and case-folded; the iota below stays a mark until marks are ordered."""
    kd = unicodedata.normalize("NFKD", c)
    return unicodedata.normalize("NFKD", "".join(x if x == IOTA_BELOW else x.casefold() for x in kd))


def _paged(values: dict[int, object]) -> str:
    """Values by code point as JSON pages of 256, null where nothing is."""
    pages: list = [None] * ((max(values) >> 8) + 1)
    for cp, v in values.items():
        if pages[cp >> 8] is None:
            pages[cp >> 8] = [None] * 256
        pages[cp >> 8][cp & 255] = v
    return json.dumps(pages)


def _tables() -> Folds:
    """Pages of folded code points, pages of combining classes, and the regex class of ordered marks."""
    folds, classes, ranges = {}, {}, []
    for cp in range(128, sys.maxunicode + 1):
        c = chr(cp)
        if unicodedata.combining(c):
            classes[cp] = unicodedata.combining(c)
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
        if not 0xD800 <= cp < 0xE000 and not HANGUL <= cp < HANGUL + SYLLABLES and _fold(c) != c:
            folds[cp] = _fold(c)
    return _paged(folds), _paged(classes), "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


_cache: list[Folds] = []


def _folds() -> Folds:
    if not _cache:
        _cache.append(_tables())
    return _cache[0]


def _every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _look_up(pages: Column, cp: Column) -> Column:
    return F.get(F.get(pages, F.shiftright(cp, 8)), cp.bitwiseAND(255))


def _folded_char(pages: Column, c: Column) -> Column:
    cp = F.ascii(c)
    s = cp - HANGUL

    def jamo(first: int, n: int) -> Column:
        return F.array(*(F.lit(chr(first + k)) for k in range(n)))

    tails = F.array(F.lit(""), *(F.lit(chr(TAILS + k)) for k in range(1, N_TAILS)))
    parts = F.concat(
        F.get(jamo(LEADS, N_LEADS), F.floor(s / (N_VOWELS * N_TAILS)).cast("int")), F.get(jamo(VOWELS, N_VOWELS), F.floor(s % (N_VOWELS * N_TAILS) / N_TAILS).cast("int")), F.get(tails, s % N_TAILS)
    )
    return F.when(cp < 128, F.lower(c)).when((s >= 0) & (s < SYLLABLES), parts).otherwise(F.coalesce(_look_up(pages, cp), c))


def _ordered(classes: Column, run: Column) -> Column:
    """A run of marks in the order of their classes, equal ones as they stood."""
    chars = _every(run, r"(?s).")
    keyed = F.transform(chars, lambda c, i: F.struct(F.coalesce(_look_up(classes, F.ascii(c)), F.lit(0)).alias("k"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), "")


def with_canonical(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``, the canonical form of its text column ``text``."""
    fold_pages, class_pages, marks = _folds()
    pages, classes = F.from_json(F.lit(fold_pages), "array<array<string>>"), F.from_json(F.lit(class_pages), "array<array<int>>")
    t, step = F.col(text), F.col(name)
    plain = F.octet_length(t) == F.char_length(t)
    folded = F.array_join(F.transform(_every(t, r"[\x00-\x7F]+|[^\x00-\x7F]"), lambda c: _folded_char(pages, c)), "")
    df = df.withColumn(name, F.when(plain, F.lower(t)).otherwise(folded))
    runs = lambda p: F.array_join(F.transform(_every(p, f"[{marks}]+|[^{marks}]+"), lambda r: F.when(F.char_length(r) > 1, _ordered(classes, r)).otherwise(r)), "")
    ordered = F.array_join(F.transform(_every(step, r"\p{M}+|\P{M}+"), lambda p: F.when(p.rlike(r"^\p{M}\p{M}"), runs(p)).otherwise(p)), "")
    several = (F.octet_length(step) > F.char_length(step)) & step.rlike(r"\p{M}\p{M}")
    df = df.withColumn(name, F.replace(F.when(several, ordered).otherwise(step), F.lit(IOTA_BELOW), F.lit(IOTA)))
    return df.withColumn(name, F.trim(F.regexp_replace(step, rf"[{OTHER_SPACE}][\x20{OTHER_SPACE}]*|\x20[\x20{OTHER_SPACE}]+", " ")))


def _lanes(canon: str, a: str, b: str, bits: int) -> list[Column]:
    """Two independent lanes; fewer ``bits`` are for tests of full buckets."""
    if bits < 64:
        return [F.xxhash64(canon).bitwiseAND((1 << bits) - 1).alias(a), F.lit(0).cast("long").alias(b)]
    return [F.xxhash64(canon).alias(a), F.xxhash64(F.lit(1), F.col(canon)).alias(b)]


def _hex(a: str, b: str, number: Column | None = None) -> Column:
    digest = F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    return digest if number is None else F.when(number > 0, F.concat(digest, F.lit("."), number.cast("string"))).otherwise(digest)


def _numbers(texts: DataFrame) -> DataFrame | None:
    """``h1, h2, canon, number`` of all texts in buckets of several texts; ``None`` if no two texts share one, as ever with 128 bits.

    Copies are one row of each task before they are shuffled.
    """
    distinct = texts.groupBy("h1", "h2", "canon").agg(F.count("*").alias("n"))
    full = checkpointed(distinct.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    if full.isEmpty():
        return None
    number = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon")) - 1
    return checkpointed(distinct.join(full, ["h1", "h2"], "left_semi").select("h1", "h2", "canon", number.alias("number")))


def _numbered(df: DataFrame, numbers: DataFrame, a: str, b: str, canon: str, name: str) -> DataFrame:
    n = numbers.select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("canon").alias(canon), F.col("number").alias(name))
    return df.join(n, [a, b, canon], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def _some(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id, null or not, is among ``ids``."""
    ids = checkpointed(ids.distinct().withColumnRenamed("doc_id", "_id"))
    return df.join(sized(ids, ids.count()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, bits: int = 128) -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    d = with_canonical(_texts(docs), "text", "canon")
    h = checkpointed(d.select("doc_id", *_lanes("canon", "h1", "h2", bits)))
    shared = h.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    numbers = _numbers(_some(d, h.join(shared, ["h1", "h2"], "left_semi").select("doc_id")).select("canon", *_lanes("canon", "h1", "h2", bits)))
    if numbers is None:
        return h.select("doc_id", _hex("h1", "h2").alias("fingerprint"))
    full = _numbered(d.select("doc_id", "canon", *_lanes("canon", "h1", "h2", bits)), numbers, "h1", "h2", "canon", "number")
    return full.select("doc_id", _hex("h1", "h2", F.col("number")).alias("fingerprint"))


# ---- each document beside the next one ----
def _range_of(bounds: list[int]) -> Column:
    """How many bounds are not above the id: first in steps, then inside one step."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every, coarse = F.lit(bounds), F.lit(bounds[::step])
    before = (F.greatest(F.size(F.filter(coarse, lambda b: b <= F.col("doc_id"))), F.lit(1)) - 1) * step
    return (before + F.size(F.filter(F.slice(every, before + 1, F.lit(step)), lambda b: b <= F.col("doc_id")))).cast("int")


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows of ``doc_id, text`` and more, with ``next``: a struct of the row of the next document by descending id, after the last the first."""
    spark = docs.sparkSession
    n = min(MOST_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("cuts")).first()["cuts"]
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(_range_of(sorted(set(cuts or ()))))
    # one row a range
    heads = docs.select("doc_id").groupBy(place.alias("range")).agg(F.max("doc_id").alias("head")).collect()
    down = sorted(heads, key=lambda r: -r["range"])
    before = [(r["range"], r["head"], down[k - 1]["range"]) for k, r in enumerate(down)]  # of the first: the last
    table = F.broadcast(spark.createDataFrame(before, "range int, head long, before int"))
    own = F.struct(F.col("range").alias("to"), F.lit(0).alias("guest"))
    also = F.struct(F.col("before").alias("to"), F.lit(1).alias("guest"))
    cols = docs.columns
    sent = docs.withColumn("range", place).join(table, "range").withColumn("sent", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, also)).otherwise(F.array(own))))
    w = Window.partitionBy("to").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    beside = sent.select(*cols, "sent.to", "sent.guest").withColumn("next", F.lead(F.struct(*cols)).over(w))
    return beside.where("guest = 0").select(*cols, "next")


def edited(texts: DataFrame) -> DataFrame:
    """``beside_next`` with ``n_chars`` and ``edited``: the last third of the text replaced by as much of the next one."""
    t = beside_next(texts).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    new = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("third")).cast("int")), F.substring(F.col("next.text"), F.lit(1), F.col("third")))
    return t.withColumn("edited", new)


def edit_report(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and whether they agree with the text's, and the next document's with it (1 or 0)."""
    texts = _texts(docs)

    def hashed(t: DataFrame) -> DataFrame:
        t = with_canonical(t, "text", "canon")
        return t.withColumns(dict(zip(("h1", "h2"), _lanes("canon", "h1", "h2", bits))))

    def with_edited(t: DataFrame) -> DataFrame:
        t = with_canonical(edited(t), "edited", "edited_canon")
        return t.withColumns(dict(zip(("e1", "e2"), _lanes("edited_canon", "e1", "e2", bits))))

    def like(x: str, y: str) -> Column:
        return (F.col(x) == F.col(y)).cast("double")

    sha = F.sha2("edited", 256).alias("edited_sha256")
    small = checkpointed(
        with_edited(hashed(texts).drop("canon")).select("doc_id", "n_chars", sha, "h1", "h2", "e1", "e2", F.col("next.doc_id").alias("next_id"), F.col("next.h1").alias("n1"), F.col("next.h2").alias("n2"))
    )
    both = small.select("h1", "h2").unionByName(small.select(F.col("e1").alias("h1"), F.col("e2").alias("h2")))
    shared = checkpointed(both.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    own = small.join(shared, ["h1", "h2"], "left_semi").select("doc_id")
    rest = checkpointed(small.join(shared.toDF("e1", "e2"), ["e1", "e2"], "left_semi").select("doc_id", "next_id"))
    # only texts of shared buckets, and their next ones, are read and folded again
    old = hashed(_some(texts, own)).select("h1", "h2", "canon")
    need = rest.select("doc_id").unionByName(rest.select(F.col("next_id").alias("doc_id")))
    new = _some(with_edited(_some(texts, need)), rest.select("doc_id")).select(F.col("e1").alias("h1"), F.col("e2").alias("h2"), F.col("edited_canon").alias("canon"))
    numbers = _numbers(old if rest.isEmpty() else old.unionByName(new))
    release(shared, rest)
    if numbers is None:
        out = small.select("doc_id", "n_chars", "edited_sha256", _hex("h1", "h2").alias("fingerprint"), _hex("e1", "e2").alias("edited_fingerprint"), _hex("n1", "n2").alias("f"))
    else:
        s = with_edited(hashed(texts)).select("doc_id", "n_chars", sha, "h1", "h2", "canon", "e1", "e2", "edited_canon", F.col("next.h1").alias("n1"), F.col("next.h2").alias("n2"), F.col("next.canon").alias("next_canon"))
        s = _numbered(s, numbers, "h1", "h2", "canon", "k")
        s = _numbered(s, numbers, "e1", "e2", "edited_canon", "l")
        s = _numbered(s, numbers, "n1", "n2", "next_canon", "m")
        out = s.select("doc_id", "n_chars", "edited_sha256", _hex("h1", "h2", F.col("k")).alias("fingerprint"), _hex("e1", "e2", F.col("l")).alias("edited_fingerprint"), _hex("n1", "n2", F.col("m")).alias("f"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "f").alias("near_next"))
