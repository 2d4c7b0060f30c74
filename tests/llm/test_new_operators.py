"""Fingerprints, source divergence and structure repair against brute force."""

import collections
import hashlib
import random
import re
import unicodedata
import zlib

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from covarix.llm import divergence, fingerprint, structure_repair
from covarix.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ---- 11: fingerprints ----
SPACES = "[\t-\r \x85   ]+"
TEXTS = [
    "Straße", "STRASSE", "strasse", "café", "café", "CAFÉ", "Ａｂｃ", "abc", "ﬁne", "fine", "한국어", unicodedata.normalize("NFD", "한국어"), "ạ̇", "ạ̇", "ạ̇",
    "ᾴ", "ᾴ", "ᾴ", "ΑΊ", "Σίσυφος", "σίσυφοσ", "  two\t\twords \n", "two words", "two words", "two　words", "x y", "x y", "", " ", None, "̈́", "̈́",
    "𝐀𝐁", "ab", "\U0001D15E", "क़ें", "İ", "i̇", "ཱིི", "ﷺ", "e" + "̖́" * 50, "̖́start", "z҉̧́", "long " * 20_000, "long " * 20_000 + " ",
]


def canonical(t):
    kd = unicodedata.normalize("NFKD", unicodedata.normalize("NFD", t or "").casefold())
    return re.sub(SPACES, " ", unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", kd).casefold())).strip(" ")


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        new = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), canonical(t), canonical(new), float(canonical(t) == canonical(new)), float(canonical(t) == canonical(n))))
    return out


def known(c):
    """Whether the JVM's older tables know the character, too."""
    return ord(c) < 0x10000 and unicodedata.ucd_3_2_0.category(c) not in ("Cn", "Cs")


def test_canonical_form_of_awkward_and_random_texts(spark):
    rng, chars = random.Random(1), [chr(c) for c in range(1, 0x3100) if known(chr(c))]
    marks = [c for c in chars if unicodedata.combining(c)]
    texts = [*TEXTS, *("".join(rng.choices(chars, k=12)) for _ in range(300)), *("".join(rng.choice([*"aeι", *rng.choices(marks, k=4)]) for _ in range(12)) for _ in range(300))]
    df = spark.createDataFrame([(t or "",) for t in texts], "text string")
    for r in fingerprint.with_canonical(df, "text", "canon").collect():
        assert r.canon == canonical(r.text), ascii(r.text)


def test_fingerprint_is_two_xxhash_lanes(spark):
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(spark.createDataFrame([(1, "Some  Text"), (2, "some text"), (3, "other")], "doc_id long, text string")).collect()}
    a = xxhash.xxh64_hexdigest(b"some text", 42)
    assert got[1] == got[2] != got[3] and got[1].startswith(a) and len(got[1]) == 32


@pytest.mark.parametrize("bits", [128, 2])
def test_edit_report(spark, bits):
    rng = random.Random(2)
    pool = [t for t in TEXTS if t is None or len(t) < 1000] + ["same text here", "Same  text HERE"] * 6
    rows = [(None if k in (7, 9) else k if k < 60 else 33, rng.choice(pool)) for k in range(64)] + [(61, "long " * 9_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, canon string, h1 int").repartition(5)
    got = fingerprint.edit_report(df, bits).collect()
    want = brute_edits(rows)
    key = lambda r: str((r[0], r[1], r[2], r[5], r[6]))
    got, want = sorted(got, key=lambda r: key(r[:3] + ("", "") + r[5:])), sorted(want, key=key)
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got] == [(*w[:3], *w[5:]) for w in want]
    of = collections.defaultdict(set)  # canonical texts of a fingerprint, and the other way round
    for r, w in zip(got, want):
        of[r.fingerprint].add(w[3]), of["c" + w[3]].add(r.fingerprint)
        of[r.edited_fingerprint].add(w[4]), of["c" + w[4]].add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in of.values())
    if bits < 64:
        assert any("." in r.fingerprint for r in got)
        plain = {(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(df, bits).collect()}
        assert len({f for _, f in plain}) == len({canonical(t) for _, t in rows})


def test_edit_report_of_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprint.edit_report(empty).count() == 0 and fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.edit_report(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()[0]
    assert (one.n_chars, one.near_next, one.edited_sha256) == (6, 1.0, hashlib.sha256(b"abcdab").hexdigest())


def test_fingerprint_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((w[0], w[1], w[2], w[5], w[6]) for w in brute_edits([tuple(r) for r in docs]))
    rows = QUERIES["op11_document_fingerprints"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows) == want
    of = {r.doc_id: r.fingerprint for r in rows}
    groups = collections.defaultdict(set)
    for r in docs:
        groups[canonical(r.text)].add(of[r.doc_id])
    assert all(len(g) == 1 for g in groups.values()) and len(set(of.values())) == len(groups)


# ---- 12: divergence ----
def brute_audit(rows, min_docs, top):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    df = collections.Counter((lang, w) for lang, _, ws in words for w in set(ws))
    out = set()
    for lang in {x[0] for x in words}:
        kept = [w for (k, w), n in df.items() if k == lang and n >= min_docs]
        count = {s: collections.Counter(w for a, b, ws in words if (a, b) == (lang, s) for w in ws) for s in {b for a, b, _ in words if a == lang}}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), collections.Counter()))
        for s in p:
            far = sorted(((-sum(abs(p[s][w] - p[t][w]) for w in kept), t.encode()) for t in p if t != s))
            out |= {(lang, s, "pair", t.decode(), -v, k + 1) for k, (v, t) in enumerate(far)}
            best = sorted((q[w] - p[s][w], w.encode()) for w in kept if count[s][w] and p[s][w] > q[w])[:top]
            out |= {(lang, s, "term", w.decode(), -v, k + 1) for k, (v, w) in enumerate(best)}
    return out


@pytest.mark.parametrize("width,depth", [(1 << 22, 4), (4, 2)])
def test_audit(spark, width, depth):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcÀéß漢" for b in "xyzXYZé"]
    rows = [(" ".join(rng.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=rng.randint(0, 30))) + rng.choice(["", "!", "\x00q", "_x1y"]), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None, "B"])) for _ in range(300)]
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("once", "fr", None), ("only", "it", "a")] + [("hot word " * 30_000, "en", "a")] + rows[:9]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, times int, term string").repartition(7)
    got = [tuple(r) for r in divergence.audit(df, 6, 3, width, depth).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, 6, 3)


def test_audit_in_tiles(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.choices(["one", "two", "three", "four"], k=3)), "en", f"s{k % 140}") for k in range(420)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in divergence.audit(df, 2, 5).collect()} == brute_audit(rows, 2, 5)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([b"w%d" % k for k in range(50)]), st.integers(1, 400)), max_size=60), st.integers(1, 300))
def test_sketch_never_underestimates(items, most):
    s, true = divergence.Sketch(most, 16, 3), collections.Counter()
    for w, n in items:
        s.add([w], [n])
        true[w] += n
    if true:
        assert all(e >= min(n, most) for e, n in zip(s.estimate(list(true)), true.values()))


def test_sketch_discards_rare_terms_before_the_shuffle(spark):
    rows = [(f"common {'abcdefghij'[k % 10] * (k // 10 + 1)} é{'abcdefghij'[k % 10] * (k // 10 + 1)}", "en", "a") for k in range(200)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    sketch = divergence.document_sketch(df, 30)
    assert {r.term for r in divergence.term_counts(df, 30, sketch).collect()} == {"common"}


# ---- 13: structure repair ----
SPACE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def brute_repair(rows):
    """Layer by layer over all states, with whole audits and texts."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    best, seen, faults = {"": (0, "", [])}, set(), collections.Counter()

    def widen(best):
        for _ in range(3):
            for s, (c, x, out) in list(best.items()):
                r = after[s][-1]
                best[r] = min(best.get(r, (10**9, "", [])), (c + 5, x + "I", [*out, ("user" if r == "u" else "assistant", "")]))
        return best

    for _, _, role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        faults[fault] += 1
        seen.add((role, text))
        new = {}

        def put(s, value):
            new[s] = min(new.get(s, value), value)

        for s, (c, x, out) in widen(best).items():
            put(s, (c + 2, x + "D", out))
            if fault not in ("blank", "duplicate"):
                c += 5 * (fault == "truncated")
                r = after[s][-1]
                put(r, (c + 1, x + "R", [*out, ("user" if r == "u" else "assistant", text)]))
                if role[:1] and role[:1] in after[s]:
                    put(role[:1], (c, x + "K", [*out, (role, text)]))
        best = new
    cost, audit, out = min(v for s, v in widen(best).items() if s in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def brute_report(rows):
    groups = {r[0]: [] for r in rows}
    for r in brute_damage(rows):
        groups[r[0]].append(r)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    return {c: brute_repair(g) if g else nothing for c, g in groups.items()}


def some_turns(seed, convs, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Is it?", "cut off", "", " \n", "Yes. ", "a: b\nc.", None, "end．"]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t + 1, None]) if rng.random() < 0.2 else t
            role = rng.choice(["system", "tool", "", None, "assistant", "su"]) if rng.random() < 0.25 else ("user", "assistant")[t % 2]
            rows.append((None if c == 3 else c, turn, role, rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.randint(0, 30)}."))
    return rows


@pytest.mark.parametrize("piece", [512, 3])
def test_repair_report(spark, piece):
    rows = some_turns(5, 60, 14)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, same string").repartition(6)
    got = {r.conv_id: tuple(r)[1:] for r in structure_repair.repair_report(df, piece).collect()}
    want = brute_report(rows)
    assert {k: v for k, v in got.items() if v != want.get(k)} == {} and got.keys() == want.keys()


def test_one_conversation_holds_most_rows(spark):
    rows = some_turns(6, 12, 5) + [(100, t, ("user", "assistant")[t % 3 > 0], "Same." if t % 5 == 0 else f"Turn {t}" + "." * (t % 7 > 0)) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: tuple(r)[1:] for r in structure_repair.repair_report(df, 64).collect()}
    assert got == brute_report(rows)
    pieces = structure_repair.repair(df.where("conv_id = 100"), 64)
    assert pieces.count() >= 700 // 64 and pieces.agg(F.max(F.length("audit"))).first()[0] <= 3 * 64 + 2


def test_repaired_turns_are_well_formed(spark):
    df = spark.createDataFrame(some_turns(7, 40, 10), "conv_id long, turn long, role string, text string")
    roles = collections.defaultdict(list)
    for r in structure_repair.repaired_turns(df, 4).orderBy("conv_id", "part", "seq", "pos").collect():
        roles[r.conv_id].append(r.role[:1])
    assert len(roles) > 30 and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in roles.values())


def test_repair_of_small_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert structure_repair.repair_report(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 2**63 - 1, "user", "x."), (1, -(2**63), "user", "y."), (2, 0, "user", "z" * 200_000 + "."), (None, None, None, None)]
    got = {r.conv_id: tuple(r)[1:] for r in structure_repair.repair_report(spark.createDataFrame(rows, schema)).collect()}
    want = brute_report(rows)
    assert got.keys() == want.keys() and {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()} and got[1][0] in (0, 2**63 - 1)


def test_repair_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_structure_repair"](spark, SF).collect()} == brute_report(rows)
