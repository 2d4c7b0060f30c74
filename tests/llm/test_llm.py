"""The training-data operators against brute force, with the awkward cases of each."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from covarix.llm import chat_format, decontaminate, html_extract, license_scan, line_dedup, ngram_join, packing, quality, token_counts, tokens, topk_search
from covarix.llm.common import connected_components

from brute import brute_components, brute_windows, grams

WORDS = [f"w{i}" for i in range(300)]


def docs_of(spark, texts, ids=None):
    """Documents with further columns, among them names that operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None, 1, 2.0, "x") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, length int, score double, row string")


def corpus(n=60, seed=0):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(5, 60))) for _ in range(n)]
    near = []
    for t in base[:20]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return [*base, *near, *base[:5], "", None, "one", "two words", " \t\n", "one"]


# ---- shared ----
def test_components_on_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 200), (None, 3), (5, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 1, 5: tokens, packing, counts ----
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x250), max_size=60) | st.text(max_size=30))
def test_word_cache_gives_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    global _FULL
    try:
        full = _FULL
    except NameError:
        full = _FULL = Tokenizer.from_file(tokens.default_tokenizer())
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = np.frombuffer(tokens.encoder(tokens.default_tokenizer()).id_bytes(text), "<u4").tolist()
    assert ids == full.encode(text, add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    """Best-fit decreasing, one item at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((k for k, r in enumerate(rooms) if r >= n), key=lambda k: rooms[k], default=None)
        if best is None:
            rooms.append(capacity - n)
        else:
            rooms[best] -= n
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_runs_are_best_fit_decreasing(lengths):
    runs = packing.best_fit_runs(dict(collections.Counter(lengths)), 50)
    bins = collections.defaultdict(list)
    for length, _, count, first, each, offset in runs:
        for i in range(count):
            bins[first + i // each].append((offset + i % each * length, length))
    for items in bins.values():
        end = 0
        for off, n in sorted(items):
            assert off == end
            end += n
    assert sorted(50 - sum(n for _, n in b) for b in bins.values()) == one_by_one(lengths, 50)
    assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    texts = [*corpus(), "w1 " * 700]
    rows = packing.pack_documents(docs_of(spark, texts), capacity=256).collect()
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    enc, want = tokens.encoder(tokens.default_tokenizer()), collections.Counter()
    for i, t in enumerate(texts):
        ids = enc.id_bytes(t or "") + (1).to_bytes(4, "little")
        for k, at in enumerate(range(0, len(ids), 1024)):
            want[i, k, at // 4, len(ids[at : at + 1024]) // 4, zlib.crc32(ids[at : at + 1024])] += 1
    assert got == want
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for items in seqs.values():
        end = 0
        for off, n in sorted(items):
            assert off == end
            end += n
        assert end <= 256
    assert len(seqs) == len(one_by_one([r.length for r in rows], 256))
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


def test_token_counts(spark):
    texts = corpus()
    enc = tokens.encoder(tokens.default_tokenizer())
    n = [len(enc.id_bytes(t or "")) // 4 for t in texts]
    got = {r.context_limit: r for r in token_counts.token_report(docs_of(spark, texts)).collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert r.docs_within == sum(x <= limit for x in n) and r.kept_tokens == sum(min(x, limit) for x in n)
        assert r.lost_tokens == sum(max(0, x - limit) for x in n) and r.quantile == pytest.approx(r.docs_within / len(n)) and r.n_docs == n.count(limit)
    h = spark.createDataFrame([(5000, 2), (3, 1), (9000, 1)], "length long, n_docs long")
    assert {r.context_limit: r.kept_tokens for r in token_counts.limit_table(h).collect()} == {3: 12, 5000: 15003, 9000: 19003}
    assert token_counts.token_report(docs_of(spark, [])).count() == 0


# ---- 2: licences ----
def test_licences_in_a_long_text_of_starts(spark):
    import time

    began = time.perf_counter()
    texts = ["MIT License\n" * 100_000, "This project is licensed\nunder the MIT License. " * 5_000, "MIT License\n" * 20_000 + MIT]
    assert license_scan.sentence_hits(docs_of(spark, texts[:1])).count() == 100_000
    rows = {(r.doc_id, r.license): r for r in license_scan.licenses(docs_of(spark, texts)).collect()}
    assert rows.keys() == {(1, "MIT"), (2, "MIT")} and rows[1, "MIT"].n_sentences == 5_000 and rows[2, "MIT"].rule == "mit-title+mit-permission+warranty-as-is"
    assert time.perf_counter() - began < 60


def test_licenses(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    full = notice + " You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    texts = [f"Some text. {notice} More.", full, "Released under the\tMIT  license\nRELEASED UNDER THE MIT LICENSE!", "license", "", None, f"{notice}\n{notice}", "x " * 5000 + notice]
    got = {(r.doc_id, r.license): (r.rule, r.n_sentences, r.first_sentence) for r in license_scan.licenses(docs_of(spark, texts)).collect()}
    assert got[0, "Apache-2.0"] == ("apache-2.0-notice", 1, 1)
    assert got[1, "Apache-2.0"] == ("apache-2.0-notice+apache-2.0-may-not+apache-2.0-copy", 3, 0)
    assert got[2, "MIT"] == ("mit-release", 2, 0) and got[6, "Apache-2.0"][1] == 2
    assert (7, "Apache-2.0") not in got  # no sentence end before the notice
    assert {d for d, _ in got} == {0, 1, 2, 6}
    assert license_scan.licenses(docs_of(spark, [])).count() == 0


APACHE = """/*
 * Copyright 2020 Someone
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."""


def test_published_licences(spark):
    flat = lambda t: " ".join(t.replace("\n *", "\n").split())
    texts = [APACHE, MIT, BSD, "This project is licensed under the MIT License.", flat(APACHE).replace("/* Copyright 2020 Someone ", ""), MIT.partition("\n\n")[2], BSD.replace("\n", "\r\n")]
    texts += ["Licensed under the Apache\nLicense, Version 2.0.", "The licence text of x.\nLicensed under the Apache License, Version 2.0 or not", "This work is licensed under the GNU General Public License, version 3.", MIT + "\n\n" + APACHE]
    got = {(r.doc_id, r.license): (r.rule, r.n_sentences, r.first_sentence) for r in license_scan.licenses(docs_of(spark, texts)).collect()}
    apache = "apache-2.0-header+apache-2.0-copy+apache-2.0-as-is"
    assert got[0, "Apache-2.0"] == (apache, 3, 3) and got[1, "MIT"] == ("mit-title+mit-permission+warranty-as-is", 3, 0) and got[2, "BSD"] == ("bsd-redistribution+bsd-as-is", 2, 3)
    assert got[3, "MIT"] == ("mit-project", 1, 0) and got[4, "Apache-2.0"][0] == "apache-2.0-header+apache-2.0-copy" and got[5, "MIT"][0] == "mit-permission+warranty-as-is"
    assert got[6, "BSD"][0] == "bsd-redistribution+bsd-as-is" and got[7, "Apache-2.0"] == ("apache-2.0-notice", 1, 0) and got[9, "GPL-3.0"][0] == "gpl-3.0-work"
    assert got[10, "MIT"][0] == "mit-title+mit-permission+warranty-as-is" and got[10, "Apache-2.0"][0] == apache
    assert {d for d, _ in got} == {0, 1, 2, 3, 4, 5, 6, 7, 9, 10}
    assert all(re.search(license_scan.HINT, k) for _, k, _ in license_scan._known())


def test_more_licences_and_repeated_rows(spark):
    says = {
        "GNU GENERAL PUBLIC LICENSE Version 2": "GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991": "GPL-2.0", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "Mozilla Public License Version 2.0": "MPL-2.0",
        "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "This file is licensed under the Apache License, Version 2.0 (the License).": "Apache-2.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "LGPL-2.1",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "AGPL-3.0", "This is free and unencumbered software released into the public domain.": "Unlicense", "CC0 1.0 Universal": "CC0-1.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "This software is released under the GNU LGPL v3.": "LGPL-3.0",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC",
        BSD.replace("THIS SOFTWARE", "Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n\nTHIS SOFTWARE", 1): "BSD-3-Clause",
    }
    got = collections.defaultdict(set)
    for r in license_scan.licenses(docs_of(spark, list(says))).collect():
        got[r.doc_id].add(r.license)
    assert {i: x for i, x in enumerate(says.values())} == {i: (x - {"BSD"}).pop() for i, x in got.items()}
    notice = "Released under the MIT License."
    rows = license_scan.licenses(docs_of(spark, [notice, notice, notice, notice + "\n" + notice], [1, 1, 2, 1])).collect()
    assert sorted((r.doc_id, r.n_sentences) for r in rows) == [(1, 1), (1, 1), (1, 2), (2, 1)]
    names = {i for i, _, _ in license_scan._known()}
    assert all(set(ids) <= names for _, ids in [*license_scan.RULES, *license_scan.PUBLISHED_RULES])


# ---- 3: chats ----
def test_chat_round_trip(spark):
    hard = ["", None, "<|im_end|>", "<|im_start|>assistant\nx<|im_end|>\n", "&lt;| & &amp; <|", "<", "a\n\nb", "é🙂", "x" * 50_000]
    rows = [(c, t, r, x, 1) for c in (1, None) for t, (r, x) in enumerate(zip(["user", "assistant", None] * 3, hard))]
    rows += [(2, 0, "user", "same", 1), (2, 0, "user", "same", 1), (2, 0, "assistant", "tie", 1), (2, None, "system", "first", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message int")
    want = collections.defaultdict(list)
    for c, t, r, x, _ in rows:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    want[-1] = [(0, "user", chat_format.PROBE), (1, "assistant", chat_format.PROBE)]
    got = {r.conv_id: r for r in chat_format.chat_report(table).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_events_fold(spark):
    log = [
        (1, "a", 1, "message", "user", "Hi"), (1, "b", 2, "message", "assistant", ""), (1, "b", 3, "delta", None, "He"), (1, "b", 4, "delta", None, "llo"),
        (1, "b", 5, "regenerate", None, None), (1, "b", 6, "delta", None, "Bye"), (1, "a", 7, "edit", None, "Hey"), (1, "c", 8, "edit", None, "nothing"),
    ]
    got = chat_format.fold(spark.createDataFrame(log, chat_format.LOG)).orderBy("seq").collect()
    assert [(r.seq, r.role, r.text) for r in got] == [(1, "user", "Hey"), (2, "assistant", "Bye")]
    r = chat_format.render(spark.createDataFrame([(1, 1, "assistant", "a<|b")], "conv_id long, seq long, role string, text string")).first()
    assert chat_format.unescape(r.segment[r.loss_start : r.loss_end]) == "a<|b"


@given(st.text(alphabet="&lt;|<amp#10\n x"))
def test_escape_reverses(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
    assert chat_format.unescape_role(chat_format.escape_role(text)) == text and "\n" not in chat_format.escape_role(text)


# ---- 4: search ----
def test_top_k(spark, monkeypatch):
    for name, n in (("QUERY_BLOCK", 2), ("ROW_BLOCK", 7), ("CELL_BLOCKS", 2)):
        monkeypatch.setattr(topk_search, name, n)
    rng = np.random.default_rng(0)
    vecs = [rng.normal(0, 0.3, 16).astype("float32").tolist() for _ in range(60)] + [[0.25] * 16] * 30
    bad = [None, [], [None] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0] * 5]
    rows = [(i, v, 7) for i, v in enumerate(vecs + bad)] + [(None, vecs[0], 7)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int"), F.col("id") % 5 == 0, k=8)
    ints = {i: np.floor(64 * np.array(v, "float64")).astype(int) for i, v in enumerate(vecs)}
    want = set()
    for q in range(0, len(vecs), 5):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:8]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    have = {tuple(r) for r in got.collect() if r.query_id < len(vecs)}
    assert have == want
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_top_k_keeps_wide_vectors_and_repeated_queries(spark, monkeypatch):
    for name, n in (("QUERY_BLOCK", 2), ("ROW_BLOCK", 3), ("CELL_BLOCKS", 1)):
        monkeypatch.setattr(topk_search, name, n)
    rng = random.Random(1)
    vecs = [[rng.choice([0.3, -2e5, 131072.0, 1e30, -1e30, 1e300, 5.5, 0.0]) for _ in range(4)] for _ in range(14)] + [[0.5, -0.25, 0.1, 1.0]] * 5 + [[1e150, 0.0, 0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(5, vecs[5]), (5, [0.7, 0.1, 0.2, 0.3]), (15, vecs[15])]
    ints = [(i, [64 * int(x) if abs(x) >= 2**53 else math.floor(64 * x) for x in v]) for i, v in rows]
    want = collections.Counter()
    for i, q in ints:
        if i % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ints if j != i)[:4]
            want.update((i, k + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, j) in enumerate(best))
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("id") % 5 == 0, k=4)
    assert collections.Counter(map(tuple, got.collect())) == want


@given(st.lists(st.integers(2**63, 10**40) | st.integers(-(10**40), -(2**63) - 1), min_size=2, max_size=5))
def test_scores_beyond_64_bits_rank_as_text(values):
    def key(x):
        return (min(max(x, -(2**63)), 2**63 - 1), topk_search._rank_text(x))

    assert sorted(values, key=key) == sorted(values)


# ---- 6: joins ----
@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 4, 5)])
def test_ngram_join(spark, monkeypatch, n, num, den):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 200)  # many blocks
    texts = corpus(60, 1)
    rng = random.Random(4)
    for t in list(texts[:30]):
        texts += [t + " " + " ".join(rng.choices(WORDS, k=k)) for k in (1, 2, 4)]
    ids = list(range(len(texts)))
    ids[-1] = ids[-2]  # two texts of one id
    df = docs_of(spark, [*texts, "no id"], [*ids, None])
    got = ngram_join.ngram_components(df, n, ngram_join.Similarity(num, den)).collect()
    want = brute_components(ids, texts, n, num, den)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    assert collections.Counter(r.n_shingles for r in got) == collections.Counter(len(grams(t, n)) for t in [*texts, "no id"])
    kept = {r.doc_id for r in ngram_join.one_of_each(df, n, ngram_join.Similarity(num, den)).collect()}
    assert kept == set(want.values()) | {None}
    assert ngram_join.ngram_components(docs_of(spark, []), n).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.integers(0, 12), st.integers(0, 12), st.integers(0, 2**32), st.sampled_from([(90, 100), (4, 5), (1, 2)]))
def test_similar_sets_share_a_signature(size, less, more, seed, level):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    b = np.unique(np.concatenate((a[min(less, len(a) - 1) :], rng.integers(0, 2**64, more, dtype=np.uint64))))
    sim = ngram_join.Similarity(*level)
    if sim.linked(len(np.intersect1d(a, b)), len(a), len(b)):
        with np.errstate(over="ignore"):
            assert len(np.intersect1d(ngram_join.Signer(sim)(a), ngram_join.Signer(sim)(b)))


def test_ngram_join_with_shared_passages_and_long_texts(spark, monkeypatch):
    """Passages of many documents and families of copies, over many parts and blocks; candidates stay few."""
    for name, n in (("BLOCK_GRAMS", 400), ("FOLD_SIGNATURES", 3_000), ("BUCKET_GRAMS", 2_000), ("STAR", 3), ("MEMBERS", 50)):
        monkeypatch.setattr(ngram_join, name, n)
    rng = random.Random(12)
    say = lambda k: rng.choices([f"v{i}" for i in range(3000)], k=k)
    passages = [say(60) for _ in range(3)]
    texts = [" ".join(say(rng.randint(10, 120)) + rng.choice(passages) + say(rng.randint(5, 60))) for _ in range(120)]
    for base in ([*texts[:4], " ".join(say(4000))]):
        w = base.split()
        for _ in range(12):
            v = list(w)
            for _ in range(max(1, len(v) // 60)):
                v[rng.randrange(len(v))] = "edit"
            texts.append(" ".join(v))
    texts += texts[:3] + [texts[0].upper()] * 2
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = docs_of(spark, texts, ids).repartition(5)
    want = brute_components(ids, texts, 5, 4, 5)
    assert {(r.doc_id, r.component_id) for r in ngram_join.ngram_components(df, 5).collect()} == set(want.items())


def test_texts_of_unlike_neighbours_are_not_replicated(spark, monkeypatch):
    """However many unlike documents signatures connect, texts are read for nearly linked pairs only."""
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 300)
    read, load = [], ngram_join._with_text
    monkeypatch.setattr(ngram_join, "_with_text", lambda rows, docs: (read.append(rows.count()), load(rows, docs))[1])
    rng = random.Random(3)
    passages = [" ".join(rng.choices([f"v{i}" for i in range(3000)], k=40)) for _ in range(61)]
    texts = [f"{a} {b}" for a, b in zip(passages, passages[1:])]  # each shares half with the next one
    got = ngram_join.ngram_components(docs_of(spark, texts).repartition(3), 5).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i) for i in range(60)}
    assert sum(read) < 4 * len(texts)


def test_edited_copies_of_a_text_make_few_pairs(spark, monkeypatch):
    """Copies with their own edits, too unlike to be linked, share signatures; their pairs must not grow with the square."""
    monkeypatch.setattr(ngram_join, "FEW", 2, raising=False)
    met, near = [], ngram_join.near_maps
    monkeypatch.setattr(ngram_join, "near_maps", lambda pairs, *more: (met.append(pairs.count()), near(pairs, *more))[1])
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(80):
        w = list(base)
        for k, at in enumerate(rng.sample(range(5, 195, 5), 3 if i % 8 == 0 else 4)):  # copies with three edits are linked with the text
            w[at] = f"e{i}x{k}"
        texts.append(" ".join(w))
    texts += [t + " end" for t in texts[1:12]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = ngram_join.ngram_components(docs_of(spark, texts, ids).repartition(3), 3, ngram_join.Similarity(90, 100)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(brute_components(ids, texts, 3, 90, 100).items())
    assert sum(met) < 3 * len(texts), met


@pytest.mark.parametrize(("star", "grid"), [(256, 16), (8, 1000), (8, 0)])
def test_members_of_large_signatures_meet_in_blocks(spark, monkeypatch, star, grid):
    """Texts round a centre meet in blocks, none is taken apart into n-grams; only stars of more than GRID parts are, with the same result."""
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "STAR", star)
    monkeypatch.setattr(ngram_join, "GRID", grid, raising=False)
    apart, differences = [], ngram_join.differences
    monkeypatch.setattr(ngram_join, "differences", lambda *args: (apart.append(1), differences(*args))[1])
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(60):
        w = list(base)
        for k, at in enumerate(rng.sample(range(5, 195, 5), 3 if i % 8 == 0 else 4)):  # copies with three edits are linked with the text
            w[at] = f"e{i}x{k}"
        texts.append(" ".join(w))
    texts += [t + " end" for t in texts[2:12]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[5] = ids[30]  # one document of two texts
    got = ngram_join.ngram_components(docs_of(spark, texts, ids).repartition(3), 3, ngram_join.Similarity(90, 100)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(brute_components(ids, texts, 3, 90, 100).items())
    assert bool(apart) == (grid == 0)


def test_blocks_link_what_brute_force_links(monkeypatch):
    """Common and rare n-grams, more of them than a block counts at a time, and links inside settled groups, which do not count."""
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    core = rng.integers(0, 2**64, 60, dtype=np.uint64)
    for num, den, m in ((4, 5, 40), (9, 10, 40), (4, 5, 2)):
        sets = [np.unique(np.concatenate((core[rng.random(60) < 0.95], rng.choice(core, 2) + np.uint64(1)))) for _ in range(m)]
        sets += [rng.integers(0, 2**64, 3, dtype=np.uint64)]
        groups = rng.integers(0, 12, m + 1) if m > 2 else np.arange(m + 1)
        label = list(range(m + 1))
        for i in range(m + 1):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if groups[i] != groups[j] and common * den >= num * (len(sets[i]) + len(sets[j]) - common):
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        assert ngram_join._linked_in_block(sets, groups, ngram_join.Similarity(num, den)).tolist() == label


def test_common_passages_bring_no_candidates():
    """With n-grams that many share left out, unlike texts with a passage in common share no signature at any corpus size."""
    rng = np.random.default_rng(2)
    passage = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
    bits = np.zeros(1 << ngram_join.COMMON_BITS, np.uint8)
    bits[(passage >> np.uint64(64 - ngram_join.COMMON_BITS)).astype(np.int64)] = 1
    with np.errstate(over="ignore"):
        signer = ngram_join.Signer(ngram_join.Similarity(4, 5), np.packbits(bits, bitorder="little").tobytes())
        for n in (50, 200, 800):
            sigs = [np.unique(signer(np.unique(np.concatenate((passage, rng.integers(0, 2**64, 200, dtype=np.uint64)))))) for _ in range(n)]
            _, times = np.unique(np.concatenate(sigs), return_counts=True)
            assert (times > 1).sum() <= n * 0.02


# ---- 7: quality ----
def test_quality(spark):
    rng = random.Random(0)
    good = [" ".join(rng.choices(WORDS, k=40)).capitalize() + "." for _ in range(80)]
    bad = [" ".join(x + "%%%" for x in rng.choices(WORDS, k=40)) for _ in range(80)]
    texts = [*good, *bad, "", None]
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)] + [(3, 1, 0), (None, 1, 0), (5, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_report(docs_of(spark, texts), labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == (r.doc_id < 80) for r in got if r.held_out and r.doc_id < 160) >= 0.95 * sum(r.held_out and r.doc_id < 160 for r in got)
    empty = quality.quality_report(docs_of(spark, ["a"]), labels.limit(0)).first()
    assert empty.score == pytest.approx(0.5)
    df = docs_of(spark, texts)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and 70 <= kept.count() <= 92


def test_quality_pairs_against_plain_descent():
    """Newton's weights make the gradient of the pair loss vanish, and scores are the logistic function around the quantile."""
    rng = np.random.default_rng(1)
    y = np.arange(200) % 3 == 0
    x = np.hstack([rng.normal(0, 1, (200, 3)) + y[:, None], np.ones((200, 1))])
    m = quality.fit_pairs(x, y.astype(int), pairs=4000)
    z, r = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1), np.random.default_rng(7)
    d = z[r.choice(np.flatnonzero(y), 4000)] - z[r.choice(np.flatnonzero(~y), 4000)]
    grad = d.T @ (1 / (1 + np.exp(-d @ m.weights)) - 1) / 4000 + 1e-3 * m.weights
    assert np.abs(grad).max() < 1e-6 and m.threshold == pytest.approx(np.quantile(z @ m.weights, 1 - y.mean()))
    s = m.scores(x)
    assert ((s >= 0.5) == (z @ m.weights >= m.threshold - 1e-12)).all() and (s[y].mean() > 0.5 > s[~y].mean())


def test_stages_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "score", "predicted", "_keep", "_doc", "_row_hash", "_body", "row", "keep", "doc", "body", "head", "n_shingles", "component_id", "a.b", "c`d", "e f"]
    rng = random.Random(0)
    good = [" ".join(rng.choices(WORDS, k=40)).capitalize() + "." for _ in range(30)]
    bad = [" ".join(x + "%%%" for x in rng.choices(WORDS, k=40)) for _ in range(30)]
    rows = [(i, t, "mine", *[f"{c}{i}" for c in names[3:]]) for i, t in enumerate([*good, *bad, None, ""])]
    df = spark.createDataFrame(rows, ", ".join(f"`{c.replace('`', '``')}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    labels = spark.createDataFrame([(i, int(i < 30), 0, 1.0) for i in range(60)], "doc_id long, quality int, toxic int, h double")
    bench = spark.createDataFrame([(0, good[3], "x", 1)], "item_id long, text string, n string, h int")
    for out in (quality.keep_good(df, labels), line_dedup.dedup_lines(df), ngram_join.one_of_each(df), decontaminate.without_leaks(df, bench)):
        assert out.columns == names and out.schema == df.schema
        assert set(map(tuple, out.collect())) <= set(rows) and out.count() >= 30


# ---- 8: pages ----
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div><header>Site</header>
<article><h1>Head {n} &amp; more</h1><p>One<br>two <b>three</b>  &eacute;&#8217;<p>Four &lt;b&gt;<form>Sign <input></form><div class="comments">Nice</div>
<div>Shared box</div><p>Common line</p></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i), "x") for i in range(6)]
    rows += [(10, "http://o.example/", PAGE.format(n=10), "x"), (11, None, None, None), (12, "x", "", None), (13, "y", "<p>Plain &nbsp; text<p>More<!-- x --> here", None), (14, "z", "<div hidden>h</div>a < b", None)]
    rows += [(20 + i, "http://m.example/", f"<title>t{i}</title><div>Same bar</div><div>Own {i}</div>", None) for i in range(6)] + [(10, "http://o.example/", PAGE.format(n=10), "x")]
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()]
    text = {p: t for p, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert text[0] == "Head 0 & more\nOne two three é’\nFour <b>\nCommon line"
    assert text[10] == "Head 10 & more\nOne two three é’\nFour <b>\nShared box\nCommon line"
    assert text[11] == text[12] == "" and text[13] == "Plain text\nMore here" and text[14] == "a < b"
    assert text[20] == "Own 0"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_one_title_share_templates(spark):
    site = [(i, "http://a.example/", f"<title>Site</title><div>Same bar</div><div>Own {i}</div>") for i in range(6)]
    copies = [(10 + i, "http://b.example/", "<title>Site</title><div>Same bar</div><div>Own</div>") for i in range(6)]
    text = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(site + copies, "page_id long, url string, html string")).collect()}
    assert text == {i: f"Own {i}" for i in range(6)} | {10 + i: "Same bar\nOwn" for i in range(6)}


@pytest.mark.parametrize("wrap", ['<article class="post comments-open">{}</article>', '<div id="content" class="layout has-sidebar"><article>{}</article></div>', '<div class="post category-search"><p>{}</div>', '<article class="post widget">{}</article>', '<div class="widget"><div class="search"><article>{}</article></div></div>', '<div class="search">{}</div>'])
def test_named_containers_of_the_article(wrap):
    assert html_extract.Page("<nav>Menu and more</nav>" + wrap.format("The article")).text() == "The article"
    page = '<article>Short<article class="comment">Nested</article></article><div class="comments"><article>A long comment under it</article></div>'
    assert html_extract.Page(page).text() == "Short"
    assert html_extract.Page('<div>The text itself</div><div class="ad">Buy</div>').text() == "The text itself"


def test_templates_by_shape_against_counting_by_hand(spark):
    """A host's link boxes go by their shape though they never say the same; texts, big ones and rare ones stay."""
    rng = random.Random(3)
    say = lambda k: " ".join(rng.choices(WORDS, k=k))
    links = lambda k: "".join(f"<li><a href='/{i}'>{say(2)}</a></li>" for i in range(k))
    rows, want = [], {}
    for i in range(7):
        story, intro = say(60), say(4)
        rows.append((i, "http://s.example/", f"<div class='box b{i}'><ul>{links(rng.randint(2, 5))}</ul></div><div class=intro>{intro}</div><div class=story><p>{story}</p></div><div>Same end</div>"))
        want[i] = f"{intro}\n{story}"
    for i in range(10, 14):  # too few pages of this host
        text = say(2)
        rows.append((i, "http://few.example/", f"<div class=box><ul><li><a>{text}</a></li></ul></div><div class=story>{say(30)}</div>"))
        want[i] = f"{text}\n" + re.sub("<.*?>", "", rows[-1][2].split("story>")[1])
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_templates == (2 if i < 10 else 0) for i, r in got.items())
    # the links of an article and a page that is links for the most part are no templates
    rows = [(i, "http://s.example/", f"<article><p>{say(3)}</p><ul class=refs>{links(4)}</ul></article>") for i in range(6)] + [(10 + i, "http://t.example/", f"<div class=all><a>{say(9)}</a></div><p>{say(2)}</p>") for i in range(6)]
    assert all("\n" in r.text and not r.n_templates for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())


@pytest.mark.parametrize("part", ["x <b y ", '<b a="', "<div>", "</x>", "<b>x<p>", "<li><div><b>", "<a href='", "<!-- ", "<ul><li>x"])
def test_long_pages_take_linear_time(part):
    import time

    html_extract.Page(part * 10)
    began = time.perf_counter()
    html_extract.Page(part * (2_000_000 // len(part))).text()
    assert time.perf_counter() - began < 30


def test_weak_names_in_an_article():
    page = '<article><div class="search"><p>Most of the article is in here, oddly named</p></div><div class="share">Share it</div><p>Rest</p><math>x</math></article>'
    assert html_extract.Page(page).text() == "Most of the article is in here, oddly named\nRest\nx"
    assert html_extract.Page('<article><p>Short</p><div class="comments">Very many comments of readers</div></article>').text() == "Short"


def test_cards_and_oddly_named_parts_of_articles():
    story = "<p>" + "The whole story is told here, in many words. " * 5 + "</p>"
    text = html_extract.Page(story).text()
    for counted in (False, True):
        page = f"<main>{story}<div><article><a>Card one</a></article><article><a>Card two</a></article></div></main>"
        assert html_extract.Page(page, counted=counted).text() == text
        assert html_extract.Page("<div><article><a>Only card</a></article></div><p>x</p>", counted=counted).text() == ("Only card\nx" if counted else "Only card")
        page = f'<article>{story}<p class="share">Shared by all of them.</p><div class="social">{story}</div></article>'
        assert html_extract.Page(page, counted=counted).text() == f"{text}\nShared by all of them.\n{text}"


def test_host_counts_decide_before_names(spark):
    rng = random.Random(8)
    say = lambda k: " ".join(rng.choices(WORDS, k=k))
    rows, want = [], {}
    for i in range(8):
        story, own, note = say(30), say(3), say(4)
        # the comments look alike on all pages, the box named so on one page only is part of the text
        odd = f'<div class="sidebar"><p>{note}</p></div>' if i == 3 else ""
        rows.append((i, "http://a.example/", f'<article><p>{story}</p>{odd}<div class="comments"><b>{say(1)}</b><p>{own}</p></div></article>'))
        want[i] = f"{story}\n{note}" if odd else story
        rows.append((100 + i, f"http://{i}.example/", f'<article><p>{story}</p><div class="sidebar"><p>{note}</p></div></article>'))
        want[100 + i] = story  # a host of one page: names decide
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_templates == (k < 100) for k, r in got.items())


def test_templates_decide_the_text_of_the_given_pages(spark):
    """Counts alone, without the meaning of tags and names, give the text; reading without the counts does not."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    whole, alone = ({r.page_id: r.text for r in html_extract.extract(pages, 5, marks).collect()} for marks in (True, False))
    off = {r.page_id: html_extract.Page(r.html or "", counted=True, marks=False).text() for r in pages.collect()}
    assert whole == alone and all(off[k] != whole[k] for k in off)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pbdiv \"'=&;a!-x", max_size=60))
def test_any_html_parses(text):
    html_extract.Page(text).text()
    plain = re.sub(r"[<>]", "", text)
    assert html_extract.Page(f"<article><p>{plain}</p></article>").text() == " ".join(html.unescape(plain).split())


# ---- 9: lines ----
def brute_lines(rows, least=20):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    where = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(line_dedup.NO_ID if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        mine = line_dedup.NO_ID if i is None else i
        kept = [x for x in lines if not (len(key(x)) >= least and len(where[key(x)]) >= 3 and mine != max(where[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_lines(spark, parts):
    rng = random.Random(2)
    common = [f"This very line is common number {k}é" for k in range(6)]
    texts = ["\n".join([rng.choice(common + ["short", "  THIS very line is common number 1é\t"]) for _ in range(rng.randint(1, 12))] + [f"own {i} " * 6]) for i in range(40)]
    texts += ["", None, common[0], "\n".join(common * 3), "\n\n"]
    ids = [*range(len(texts) - 2), None, 5]  # a missing and a repeated id
    rows = list(zip(ids, texts)) + [(7, texts[7])]
    df = docs_of(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(parts)
    got = collections.Counter(map(tuple, line_dedup.line_report(df).collect()))
    assert got == brute_lines(rows)
    cut = line_dedup.dedup_lines(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    assert line_dedup.line_report(docs_of(spark, [])).count() == 0


def test_long_texts_of_lines_and_tokens(spark):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choices(WORDS, k=12))
    shared = [line() for _ in range(300)]
    texts = ["\n".join(rng.choice(shared) if rng.random() < 0.5 else line() for _ in range(20_000)), "\n".join(shared), "\n".join(shared[::-1]), "x" * 1_000_000, "\n" * 100_000]
    assert collections.Counter(map(tuple, line_dedup.line_report(docs_of(spark, texts)).collect())) == brute_lines(list(enumerate(texts)))
    enc = tokens.encoder(tokens.default_tokenizer())
    got = {r.context_limit: r.n_docs for r in token_counts.token_report(docs_of(spark, texts[:3])).collect()}
    assert got == collections.Counter(len(enc.id_bytes(t)) // 4 for t in texts[:3])


def test_a_key_over_several_ranges(spark):
    """Every way of cutting the sorted rows into ranges gives the same lines."""
    rows = sorted([(h, 0, -d, d, 0, p) for h, ds in ((1, [9, 9, 8]), (2, [9, 7, 6, 6, 1]), (3, [5])) for p, d in enumerate(ds)])
    rows = [(h, z, d, r, p) for h, z, _, d, r, p in rows]
    import pyarrow as pa

    names = ["h1", "h2", "doc", "row", "pos"]
    for cut in range(len(rows) + 1):
        for cut2 in range(cut, len(rows) + 1):
            out = []
            for part in (rows[:cut], rows[cut:cut2], rows[cut2:]):
                if part:
                    out += line_dedup._stream(iter([pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in part])]), 3)
            seen = collections.defaultdict(set)
            for k, *x in out:
                if k == line_dedup.SEEN:
                    seen[x[0]].add(x[2])
            gone = {tuple(x[2:]) for k, *x in out if k == line_dedup.DROP}
            gone |= {tuple(x[2:]) for k, *x in out if k == line_dedup.OPEN and len(seen[x[0]]) >= 3 and x[2] != max(seen[x[0]])}
            assert gone == {(7, 0, 1), (6, 0, 2), (6, 0, 3), (1, 0, 4)}


# ---- 10: benchmark ----
def test_leaks(spark):
    rng = random.Random(9)
    item = [" ".join(rng.choices(WORDS, k=k)) for k in (12, 30, 60)] + ["too short item", None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(item)] + [(None, item[0]), (7, item[1])], "item_id long, text string")
    noise = lambda k: " ".join(rng.choices(WORDS, k=k))
    edited = item[2].split()
    edited[-1] = "other"
    part = " ".join(item[1].split()[:15])
    texts = [noise(50) + " " + item[0].upper() + ". " + noise(30), item[1], " ".join(edited), part, "", None, noise(3), noise(400), item[1] + " " + noise(5) + " " + item[1], "too short item"]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (1, 7), (2, 2), (8, 1), (8, 7)}
    assert got[0, 0].similarity == 1.0 and got[0, 0].start == 50 and got[8, 1].n_windows == 2
    n = 56
    assert got[2, 2].similarity == pytest.approx((n - 1) / (n + 1))
    kept = decontaminate.without_leaks(docs_of(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 9}
    assert decontaminate.leaks(docs_of(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_items_with_their_parts_in_another_order(spark):
    w, o = [f"item{i}" for i in range(60)], [f"other{i}" for i in range(60)]
    bench = spark.createDataFrame([(0, " ".join(w))], "item_id long, text string")
    texts = [" ".join(o[:30] + w[30:] + w[:30] + o[30:]), " ".join(o[:30] + w[:30] + o[30:]), " ".join(w[30:] + w[:30])]
    got = {r.doc_id: r for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()}
    assert set(got) == {0, 2} and got[0].start == 30 and got[0].n_windows == 1
    assert got[0].similarity == got[2].similarity == pytest.approx(52 / 60)
    assert [r.doc_id for r in decontaminate.without_leaks(docs_of(spark, texts), bench).collect()] == [1]


def test_leaks_against_every_window(spark):
    rng = random.Random(21)
    say = lambda k, n=300: rng.choices(WORDS[:n], k=k)
    items = [(k, " ".join(say(n, v))) for k, (n, v) in enumerate([(8, 300), (20, 300), (20, 300), (45, 300), (60, 300), (30, 4), (9, 2)])]
    texts = []
    for _, item in items:
        w = item.split()
        half = len(w) // 2
        for v in (w[half:] + w[:half], w[:half] + say(1) + w[half:], w[:half] + say(4) + w[half:], w[1:], w[: half + 3], w[:-1] + say(1), w + w, w * 3, [x.upper() + "," for x in w]):
            texts.append(" ".join(say(rng.randint(0, 30)) + v + say(rng.randint(0, 30))))
    texts.append(" ".join(say(20_000) + items[4][1].split() + say(5_000)))
    rows = list(enumerate(texts))
    bench = spark.createDataFrame([(k, t, 1, "h") for k, t in items], "item_id long, text string, n int, h string")
    got = {(r.doc_id, r.item_id, r.start, r.common) for r in decontaminate.contaminated_windows(docs_of(spark, texts), bench).collect()}
    assert got == brute_windows(rows, items) and len({(d, k) for d, k, *_ in got}) > 30


def test_repeated_words_weigh_as_often_as_they_occur(spark):
    bench = spark.createDataFrame([(0, "a b " * 10)], "item_id long, text string")
    got = decontaminate.leaks(docs_of(spark, ["a b " * 10, "a b a b a b c d e f"]), bench).collect()
    assert [(r.doc_id, r.similarity) for r in got] == [(0, 1.0)]


def test_block_index_finds_everything_within_the_radius():
    rng = random.Random(1)
    flips = set(decontaminate.FLIPS)
    for _ in range(2000):
        bits = rng.sample(range(64), rng.randint(0, decontaminate.RADIUS))
        x = sum(1 << b for b in bits)
        assert any((x >> 8 * k & 255) in flips for k in range(8))
