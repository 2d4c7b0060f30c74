"""The registered query of each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, license_scan, structure_repair
from .chat_format import END, PROBE, START, chat_report
from .common import table
from .decontaminate import leaks
from .fingerprint import edit_report
from .html_extract import extract
from .line_dedup import line_report
from .ngram_join import Similarity, ngram_components
from .packing import pack_documents
from .quality import quality_report
from .token_counts import token_report
from .topk_search import top_k

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=4096)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_report(table(spark, sf_dir, "conversations"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), n=3, sim=Similarity(90, 100))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), min_pages=5)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), min_docs=3, min_chars=20)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_license_scan, op3_chat_format, op4_topk_search, op5_token_counts, op6_ngram_jaccard_join,
        op7_quality_classifier, op8_html_extraction, op9_line_dedup, op10_benchmark_decontamination, op11_document_fingerprints, op12_source_divergence,
        op13_structure_repair,
    )
}

ORACLES: dict[str, str] = {
    "op12_source_divergence": divergence.ORACLE,
    "op2_license_scan": license_scan.ORACLE,
    "op3_chat_format": rf"""
WITH c AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS t, length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START)} + r + 1 + t + {len(END)} + 1)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op4_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    # all pairs of texts by their common shingles, then what is reachable over links
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM t),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.rid < b.rid GROUP BY ALL),
e AS (SELECT DISTINCT p.doc_id AS u, q.doc_id AS v FROM c JOIN n x ON x.rid = c.a JOIN n y ON y.rid = c.b JOIN t p ON p.rid = c.a JOIN t q ON q.rid = c.b WHERE 100 * c.c >= 90 * (x.n + y.n - c.c) AND p.doc_id <> q.doc_id),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT u AS doc_id, u AS r FROM both_ways UNION SELECT b.v, reach.r FROM reach JOIN both_ways b ON b.u = reach.doc_id),
low AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.component_id, t.doc_id) AS component_id FROM t LEFT JOIN n USING (rid) LEFT JOIN low ON low.doc_id = t.doc_id""",
    # every window that holds a shingle of an item, at every start, by weighted Jaccard similarity
    "op10_benchmark_decontamination": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
d AS (SELECT doc_id, rid, len(w) - 4 AS size, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS h FROM t WHERE len(w) >= 5),
b AS (SELECT item_id, row_number() OVER () AS iid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
i AS (SELECT item_id, iid, n, h, count(*) AS c FROM (SELECT item_id, iid, len(w) - 4 AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS h FROM b WHERE len(w) >= 5) GROUP BY ALL),
hit AS (SELECT doc_id, rid, item_id, iid, size, n, least(n, size) AS long, pos, h, c FROM d JOIN i USING (h)),
own AS (SELECT doc_id, rid, item_id, iid, n, long, h, c, unnest(range(greatest(0, pos - long + 1), least(pos, size - long) + 1)) AS start FROM hit),
win AS (SELECT doc_id, rid, item_id, iid, n, long, start, sum(same) AS common FROM (SELECT doc_id, rid, item_id, iid, n, long, start, h, least(count(*), any_value(c)) AS same FROM own GROUP BY ALL) GROUP BY ALL),
found AS (SELECT DISTINCT doc_id, item_id, start, common, n + long - common AS total FROM win WHERE common * 5 >= (n + long - common) * 4),
placed AS (SELECT *, coalesce(start > lag(start) OVER (PARTITION BY doc_id, item_id ORDER BY start) + 1, true) AS place FROM found)
SELECT doc_id, item_id, count(*) FILTER (place) AS n_windows, max(common::DOUBLE / total) AS similarity, arg_max(start, (common::DOUBLE / total, -start))::INT AS start FROM placed GROUP BY doc_id, item_id""",
    "op9_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.doc_id, pos, line, top IS NOT NULL AND k.doc_id <> top AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id""",
}
