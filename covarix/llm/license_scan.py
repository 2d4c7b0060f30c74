"""Licence scans by sentence-rule recognition, in DataFrame functions only.

A text is cut into pieces (line ends, and a full stop, exclamation or question
mark before white space); a piece is normalised to lower-case words of letters
and digits with single spaces. A known sentence is met where a run of pieces is
that sentence, so it may be wrapped anywhere, with comment marks or blank lines
between; a published sentence may also go on in its last piece. Of the sentences
that begin at one piece the longest counts, and none counts inside another. A
document's identifiers in order form a sequence, and each ordered rule matches
where its identifiers follow one another in it (other sentences may lie between
them); ``IDENTIFIERS`` are met as whole lines. The rules of the longest sequences win: a rule is not reported where a
longer matching rule contains all its sentences. ``ORACLE`` knows ``SENTENCES``
and ``RULES`` in single pieces only; where a text has no others, rows are equal.

Defined cases: null and empty texts have no sentence and give no row; sentences
repeated in a text count each; equal documents and repeated rows are reported
each; null ids are reported with a null id; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Licence sentences as they are published, by identifier.
SENTENCES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-may-not": "you may not use this file except in compliance with the License",
    "apache-2.0-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-release": "Released under the MIT License",
    "mit-title": "MIT License",
    "mit-notice": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-notice": "Licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "warranty-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND",
}
# Rules as ordered sentence identifiers, and the licence each names.
RULES = [
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("Apache-2.0", ("apache-2.0-notice", "apache-2.0-may-not")),
    ("Apache-2.0", ("apache-2.0-notice", "apache-2.0-may-not", "apache-2.0-copy")),
    ("MIT", ("mit-release",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-title", "mit-grant")),
    ("MIT", ("mit-title", "mit-grant", "warranty-as-is")),
    ("GPL-3.0", ("gpl-3.0-work",)),
    ("GPL-3.0", ("gpl-3.0-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-notice",)),
    ("CC-BY-4.0", ("cc-by-4.0-notice",)),
    ("BSD", ("bsd-redistribution",)),
    ("BSD", ("bsd-redistribution", "warranty-as-is")),
]
# Whole published sentences and the head clauses of those that differ by holder; a text's sentence may go on after them.
PUBLISHED = [
    ("apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache-2.0-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0-as-is", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("apache-2.0-title", "Apache License Version 2.0, January 2004"),
    ("mit-title", "The MIT License"),
    ("mit-permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software")'),
    ("warranty-as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-as-is", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'),
    ("bsd-as-is", 'THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'),
    ("gpl-3.0-title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-3.0-program", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("cc-by-4.0-work", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0-work", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0-work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-4.0-work", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("apache-2.0-file", "This file is licensed under the Apache License, Version 2.0"),
    ("gpl-2.0-title", "GNU GENERAL PUBLIC LICENSE Version 2"),
    ("gpl-3.0-title", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("gpl-2.0-program", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-2.0-program", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2"),
    ("gpl-3.0-program", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License"),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("lgpl-2.1-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1"),
    ("lgpl-3.0-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"),
    ("lgpl-2.1-library", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3.0-library", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3.0-title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"),
    ("agpl-3.0-program", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-2.0-title", "Mozilla Public License Version 2.0"),
    ("mpl-2.0-title", "Mozilla Public License, version 2.0"),
    ("mpl-2.0-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc-title", "ISC License"),
    ("isc-title", "The ISC License"),
    ("isc-permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-permission", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES'),
    ("bsd-no-endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-title", "BSD 2-Clause License"),
    ("bsd-3-title", "BSD 3-Clause License"),
    ("unlicense-work", "This is free and unencumbered software released into the public domain"),
    ("cc0-1.0-title", "CC0 1.0 Universal"),
    ("cc0-1.0-waiver", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("boost-1.0-title", "Boost Software License - Version 1.0"),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty"),
    ("epl-2.0-title", "Eclipse Public License - v 2.0"),
    *((f"cc-{kind}-{v}-work", f"This work is licensed under {a} Creative Commons {name} {v} {where} License")
      for kind, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
      for v, where in (("4.0", "International"), ("3.0", "Unported")) for a in ("a", "the") if (kind, v) not in (("by", "4.0"), ("by-nc", "4.0"))),
]
# Identifiers of the public list of licences.
IDENTIFIERS = (
    "Apache-2.0 MIT MIT-0 ISC BSD-2-Clause BSD-3-Clause 0BSD GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later "
    "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-3.0 CC-BY-SA-3.0"
).split()
# Names in running text: the licence sentence's identifier and the ways to say it.
NAMES = {
    "apache-2.0-project": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"),
    "mit-project": ("the MIT License",),
    "gpl-3.0-project": ("the GNU General Public License, version 3", "the GNU General Public License v3", "the GNU GPL v3"),
    "bsd-project": ("the BSD License", "the BSD 2-Clause License", "the BSD 3-Clause License"),
    "cc-by-nc-4.0-project": ("CC BY-NC 4.0",),
    "cc-by-4.0-project": ("CC BY 4.0",),
    "gpl-2.0-project": ("the GNU General Public License, version 2", "the GNU General Public License v2", "the GNU GPL v2"),
    "lgpl-3.0-project": ("the GNU Lesser General Public License, version 3", "the GNU LGPL v3"),
    "agpl-3.0-project": ("the GNU Affero General Public License, version 3", "the GNU AGPL v3"),
    "mpl-2.0-project": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "isc-project": ("the ISC License",),
    "unlicense-project": ("the Unlicense",),
    "cc0-1.0-project": ("CC0 1.0",),
    "cc-by-sa-4.0-project": ("CC BY-SA 4.0",),
}
PUBLISHED += [(i, f"This {what} is {how} under {x}") for i, xs in NAMES.items() for x, what, how in product(xs, "project software work code library program package".split(), ("licensed", "released"))]
LINES = [(f"spdx-{x.lower()}", f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS]  # whole lines: "or later" ones begin like others
_NAMED = ("Apache-2.0", "MIT", "GPL-3.0", "BSD", "CC-BY-NC-4.0", "CC-BY-4.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0")
PUBLISHED_RULES = [
    *(("Apache-2.0", ("apache-2.0-header", "apache-2.0-copy", "apache-2.0-as-is")[:n]) for n in (1, 2, 3)),
    *(("MIT", ids) for ids in (("mit-permission",), ("mit-permission", "warranty-as-is"), ("mit-title", "mit-permission"), ("mit-title", "mit-permission", "warranty-as-is"))),
    ("BSD", ("bsd-redistribution", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-no-endorsement")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-no-endorsement", "bsd-as-is")),
    *((name, (i,)) for name, i in (("Apache-2.0", "apache-2.0-title"), ("GPL-3.0", "gpl-3.0-title"), ("GPL-3.0", "gpl-3.0-program"), ("CC-BY-4.0", "cc-by-4.0-work"), ("CC-BY-NC-4.0", "cc-by-nc-4.0-work"))),
    *((name, (i,)) for name, i in zip(_NAMED, NAMES)),
    *((name, (i,)) for name, i in (
        ("Apache-2.0", "apache-2.0-file"), ("GPL-2.0", "gpl-2.0-title"), ("LGPL-2.1", "lgpl-2.1-title"), ("LGPL-2.1", "lgpl-2.1-library"), ("LGPL-3.0", "lgpl-3.0-title"), ("LGPL-3.0", "lgpl-3.0-library"),
        ("AGPL-3.0", "agpl-3.0-title"), ("MPL-2.0", "mpl-2.0-title"), ("MPL-2.0", "mpl-2.0-form"), ("ISC", "isc-title"), ("ISC", "isc-permission"), ("BSD-2-Clause", "bsd-2-title"), ("BSD-3-Clause", "bsd-3-title"),
        ("Unlicense", "unlicense-work"), ("CC0-1.0", "cc0-1.0-title"), ("CC0-1.0", "cc0-1.0-waiver"), ("BSL-1.0", "boost-1.0-title"), ("Zlib", "zlib-as-is"), ("EPL-2.0", "epl-2.0-title"))),
    *((name, (f"{name.lower()}-program",)) for name in ("GPL-2.0", "AGPL-3.0")),
    *((name, (f"{name.lower()}-program", "gpl-warranty")) for name in ("GPL-2.0", "GPL-3.0", "AGPL-3.0")),
    ("MPL-2.0", ("mpl-2.0-form", "mpl-2.0-copy")),
    *(("ISC", ids) for ids in (("isc-permission", "isc-as-is"), ("isc-title", "isc-permission"), ("isc-title", "isc-permission", "isc-as-is"))),
    *((i.removesuffix("-work").upper(), (i,)) for i in sorted({i for i, _ in PUBLISHED if i.startswith("cc-by") and i.endswith("-work")} - {"cc-by-4.0-work", "cc-by-nc-4.0-work"})),
    *((x, (i,)) for x, (i, _) in zip(IDENTIFIERS, LINES)),
]
HINTS = ("licens", "licenc", "permission", "redistribution", "software", "released", "public domain", "cc0", "warranty", "the mpl", "neither the name")  # every known sentence has one of these
HINT = "|".join(HINTS)
BREAK = r"\n|(?<=[.!?])[ \t\r]+"
NOT_WORD = r"[^a-z0-9]+"
AT, IS, MARK = "\x01", "\x02", 12  # before and after a piece's number; characters of a mark at most


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), NOT_WORD, " "))


def _known() -> list[tuple[str, str, bool]]:
    """``(sentence_id, key, open)`` of all known sentences; an open one may go on."""
    key = lambda x: re.sub(NOT_WORD, " ", x.lower()).strip()
    return [(i, key(x), False) for i, x in [*SENTENCES.items(), *LINES]] + [(i, key(x), True) for i, x in PUBLISHED]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, list(ids)) for i, (name, ids) in enumerate([*RULES, *PUBLISHED_RULES])], "rule_id int, license string, needs array<string>")


def _starts(known: list[tuple[str, str, bool]]) -> str:
    """Finds each piece that a known sentence may begin in, and as much from there as the longest one of its first word may take.

    Pieces come as ``AT number IS key``; between two words there is a space or the next piece's mark.
    """
    heads: dict[str, list[str]] = {}
    for _, k, _ in known:
        heads.setdefault(k.split()[0], []).append(k)
    ends = f"(?: |{AT}|$)"
    found = []
    for a, keys in sorted(heads.items()):
        second = sorted({k.split()[1] for k in keys if " " in k})
        reach = max(len(k) + MARK * len(k.split()) for k in keys) + 2 * MARK
        found.append(f"{a}(?={AT}|$| (?:{'|'.join(second)}){ends})[\\s\\S]{{0,{reach}}}")
    return f"{AT}(?=([0-9]+{IS}(?:{'|'.join(found)})))"


def sentence_hits(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, pos, sentence_id)`` of each known sentence; ``row`` tells rows of one id apart.

    One pass of a pattern finds where sentences may begin, with their text as far as
    one can reach; its first two words then meet the known sentences in a join. So
    work is linear in the text, however many of its lines begin one.
    """
    spark, known = docs.sparkSession, _known()
    pieces = F.transform(F.split("text", BREAK), lambda x, i: F.struct(i.alias("pos"), normalised(x).alias("key")))
    marked = F.array_join(F.transform(F.filter(pieces, lambda x: x["key"] != ""), lambda x: F.concat(F.lit(AT), x["pos"].cast("string"), F.lit(IS), x["key"])), "")
    s = docs.where(reduce(or_, (F.contains(F.lower("text"), F.lit(x)) for x in HINTS))).select("doc_id", F.xxhash64("text").alias("row"), marked.alias("marked"))
    s = s.select("doc_id", "row", F.explode(F.regexp_extract_all("marked", F.lit(_starts(known)), F.lit(1))).alias("run"))
    # a mark that the reach cuts through is left out
    whole = F.filter(F.split("run", AT), lambda x: F.contains(x, F.lit(IS)))
    run = F.transform(whole, lambda x: F.struct(F.substring_index(x, IS, 1).cast("int").alias("pos"), F.substring_index(x, IS, -1).alias("key")))
    s = s.select("doc_id", "row", F.explode(F.array(run)).alias("run"))

    # the run's text, and after which lengths its pieces end
    none = F.array().cast("array<struct<size:int,end:int>>")

    def add(a: Column, y: Column) -> Column:
        more = F.concat_ws(" ", F.nullif(a["text"], F.lit("")), y["key"])
        return F.struct(more.alias("text"), F.concat(a["ends"], F.array(F.struct(F.length(more).alias("size"), y["pos"].alias("end")))).alias("ends"))

    # a generator, for otherwise the optimizer would make this once per use
    reach = F.aggregate("run", F.struct(F.lit("").alias("text"), none.alias("ends")), add, lambda a: F.struct(F.concat(a["text"], F.lit(" ")).alias("text"), a["ends"].alias("ends")))
    s = s.select("doc_id", "row", F.col("run")[0]["pos"].alias("pos"), F.explode(F.array(reach)).alias("r")).withColumn("head", F.substring_index("r.text", " ", 2))
    heads: dict[str, list[tuple]] = {}
    for i, k, o in known:
        heads.setdefault(" ".join(k.split()[:2]), []).append((i, k, o))
    table = spark.createDataFrame(list(heads.items()), "head string, known array<struct<id:string,key:string,open:boolean>>")  # the known sentences, some hundred
    s = s.join(F.broadcast(table), "head")
    met = F.filter("known", lambda k: F.startswith(F.col("r.text"), F.concat(k["key"], F.lit(" "))))

    def hit(k: Column) -> Column:
        last = F.element_at(F.filter("r.ends", lambda e: e["size"] >= F.length(k["key"])), 1)
        # of equal sentences the whole one counts; one that is not open must end with a piece
        return F.when(k["open"] | (last["size"] == F.length(k["key"])), F.struct(F.length(k["key"]).alias("size"), (~k["open"]).alias("whole"), k["id"].alias("id"), last["end"].alias("end")))

    hits = s.select("doc_id", "row", "pos", "r", met.alias("met"))
    hits = hits.select("doc_id", "row", "pos", F.array_max(F.transform("met", hit)).alias("best")).where("best is not null")
    before = Window.partitionBy("doc_id", "row").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("inside", F.coalesce(F.max("best.end").over(before) >= F.col("pos"), F.lit(False)))
    return hits.where("not inside").select("doc_id", "row", "pos", F.col("best.id").alias("sentence_id"))


def licenses(docs: DataFrame) -> DataFrame:
    """``(doc_id, license, rule, n_sentences, first_sentence)`` of each licence of a document.

    ``rule`` is the longest matching rule's identifiers joined by ``+``;
    ``n_sentences`` the known sentences of the document; ``first_sentence``
    the number, from 0, of the sentence that begins it.
    """
    spark = docs.sparkSession
    # rows repeated as a whole have each of their sentences as often
    each = sentence_hits(docs).groupBy("doc_id", "row", "pos", "sentence_id").agg(F.count("*").alias("copies"))
    seq = each.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence_id"))).alias("hits"), F.max("copies").alias("copies"))
    seq = seq.select("doc_id", "row", "copies", "hits", F.concat(F.lit(","), F.array_join("hits.sentence_id", ",,"), F.lit(",")).alias("line"))
    # rules meet the documents that hold their first sentence
    first = seq.select("doc_id", "row", "copies", "hits", "line", F.explode(F.array_distinct("hits.sentence_id")).alias("head"))
    rules = F.broadcast(_rules(spark).withColumn("head", F.col("needs")[0]))
    # each identifier is looked for behind the one before it
    behind = F.expr("aggregate(needs, 1, (at, x) -> if(at = 0, 0, nullif(locate(concat(',', x, ','), line, at), 0) + length(x) + 2), at -> coalesce(at, 0))")
    met = first.join(rules, "head").where(behind > 0)
    best = met.groupBy("doc_id", "row", "copies", "license").agg(F.max(F.struct(F.size("needs").alias("size"), (-F.col("rule_id")).alias("order"), "needs", "hits")).alias("m"))
    begin = F.element_at(F.filter("m.hits", lambda h: h["sentence_id"] == F.col("m.needs")[0]), 1)["pos"]
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return best.select("doc_id", "license", F.array_join("m.needs", "+").alias("rule"), F.size("m.hits").cast("long").alias("n_sentences"), begin.cast("long").alias("first_sentence"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(x if isinstance(x, str) and x.startswith("[") else str(x) if isinstance(x, int) else _quoted(x) for x in r) + ")" for r in rows)


_KNOWN_SQL = _values([(k, v) for k, v in SENTENCES.items()])
_RULES_SQL = _values([(i, name, "[" + ", ".join(map(_quoted, ids)) + "]", f",{',%,'.join(ids)},") for i, (name, ids) in enumerate(RULES)])
ORACLE = f"""
WITH known AS (SELECT sentence_id, trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')) AS key FROM (VALUES {_KNOWN_SQL}) v(sentence_id, sentence)),
rules AS (SELECT * FROM (VALUES {_RULES_SQL}) v(rule_id, license, needs, pattern)),
cut AS (SELECT row_number() OVER () AS rid, doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
sent AS (SELECT rid, doc_id, unnest(range(0, len(parts))) AS pos, unnest(parts) AS raw FROM cut),
hits AS (SELECT rid, doc_id, pos, sentence_id FROM (SELECT rid, doc_id, pos, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS key FROM sent) s JOIN known USING (key)),
seq AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n_sentences, ',' || string_agg(sentence_id, ',,' ORDER BY pos) || ',' AS line FROM hits GROUP BY rid),
met AS (SELECT rid, doc_id, license, needs, rule_id, n_sentences, row_number() OVER (PARTITION BY rid, license ORDER BY len(needs) DESC, rule_id) AS k FROM seq JOIN rules ON line LIKE '%' || pattern || '%')
SELECT m.doc_id, license, array_to_string(needs, '+') AS rule, n_sentences, (SELECT min(pos) FROM hits h WHERE h.rid = m.rid AND h.sentence_id = m.needs[1])::BIGINT AS first_sentence
FROM met m WHERE k = 1
"""
