"""Registered queries over whole tables, each with the SQL of the same rows.

``orders`` and ``supplier`` are read as sequences of categorical columns,
``documents`` as sequences of letters (whole texts).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import BASE20, region, sigmoid, valid
from ..operators import boolean, columns, dca, graph, kmer, near, pairs, predict, ranking, spectral, tiles
from ..shared import checkpointed, with_total
from ..sources import readers
from . import reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GAP_LIMIT = 11  # all pairs of the twelve columns of orders
TRAIN_SHARE = 8, 13  # of each 13 ids in turn, 8 are for training

# ---- SQL shared by the oracles ----
ORDERS = """
o AS (SELECT o_orderkey AS seq_id, floor(o_totalprice)::BIGINT AS price, * FROM orders),
raw AS (SELECT seq_id, [instr('FOP', o_orderstatus) - 1, substr(o_orderpriority, 1, 1)::INT - 1, month(o_orderdate) - 1, quarter(o_orderdate) - 1, year(o_orderdate) - 1992,
  day(o_orderdate) - 1, dayofweek(o_orderdate), o_custkey % 20, o_custkey % 7, floor(o_totalprice / 25000)::BIGINT, price % 10, hour(o_orderdate)] AS c FROM o),
p AS (SELECT seq_id, list_transform(c, lambda x: CASE WHEN x >= 0 AND x < 20 THEN x ELSE 20 END) AS codes FROM raw)"""
SUPPLIER = """
raw AS (SELECT s_suppkey AS seq_id, round(abs(s_acctbal) * 100)::BIGINT AS cents, * FROM supplier),
p AS (SELECT seq_id, list_transform([s_nationkey % 20, s_nationkey % 5, floor((s_acctbal + 1000) / 1000)::BIGINT, cents % 10, (cents // 10) % 10, (cents // 100) % 20,
  CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END, s_suppkey % 3], lambda x: CASE WHEN x >= 0 AND x < 20 THEN x ELSE 20 END) AS codes FROM raw)"""
EMBEDDINGS = "p AS (SELECT vec_id AS seq_id, list_transform(embedding, lambda x: CASE WHEN floor(x::DOUBLE * 40) BETWEEN -10 AND 9 THEN floor(x::DOUBLE * 40)::INT + 10 ELSE 20 END) AS codes FROM embeddings)"
CELLS = "cells AS (SELECT seq_id, unnest(range(0, len(codes)))::INT AS pos, unnest(codes)::INT AS code FROM p)"
CC = f"{CELLS}, cc AS (SELECT pos, code, count(*) AS n FROM cells GROUP BY ALL)"
REF = "ref AS (SELECT pos, code AS ref_code, n AS ref_n FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, code) AS k FROM cc WHERE code < 20) WHERE k = 1)"
ENTROPY = """v AS (SELECT pos, n, n::DOUBLE / sum(n) OVER (PARTITION BY pos) AS q FROM cc WHERE code < 20),
h AS (SELECT c.pos, coalesce(sum(v.n), 0)::BIGINT AS n_valid, coalesce(any_value(e), 0) AS e FROM (SELECT DISTINCT pos FROM cc) c
  LEFT JOIN v ON v.pos = c.pos LEFT JOIN (SELECT pos, sum(-q * log2(q)) AS e FROM v GROUP BY pos) s ON s.pos = c.pos GROUP BY c.pos)"""
PC = "pc AS (SELECT a.pos AS pos_i, b.pos AS pos_j, a.code AS code_i, b.code AS code_j, count(*) AS n FROM cells a JOIN cells b ON a.seq_id = b.seq_id AND b.pos > a.pos AND b.pos <= a.pos + {gap} GROUP BY ALL)"
PV = "pv AS (SELECT * FROM pc WHERE code_i < 20 AND code_j < 20)"
PM = """{name} AS (SELECT *, sum(n) OVER (PARTITION BY pos_i, pos_j)::BIGINT AS t, sum(n) OVER (PARTITION BY pos_i, pos_j, code_i)::BIGINT AS ni, sum(n) OVER (PARTITION BY pos_i, pos_j, code_j)::BIGINT AS nj FROM {of})"""
PR = "pr AS (SELECT pv.*, a.ref_code AS ref_i, b.ref_code AS ref_j FROM pv JOIN ref a ON a.pos = pos_i JOIN ref b ON b.pos = pos_j WHERE NOT (code_i = a.ref_code AND code_j = b.ref_code))"
TERM = "sum(n::DOUBLE / t * log2(n::DOUBLE * t / (ni::DOUBLE * nj)))"
MI = "mi AS (SELECT pos_i, pos_j, round(CASE WHEN sum(n) >= 10 THEN {term} ELSE 0 END, 6) + 0.0 AS mi, sum(n)::BIGINT AS n_obs FROM pm GROUP BY ALL)".format(term=TERM)
ORDER_CC = f"WITH {ORDERS}, {CC}"
ORDER_PC = f"{ORDER_CC}, {REF}, {PC.format(gap=GAP_LIMIT)}, {PV}, {PM.format(name='pm', of='pv')}, {MI}"
WIDE_PC = f"WITH {EMBEDDINGS}, {CC}, {REF}, {PC.format(gap=10_000)}, {PV}, {PM.format(name='pm', of='pv')}, {MI}"
MUT = f"{PR}, {PM.format(name='mm', of='pr')}, mut AS (SELECT pos_i, pos_j, ref_i, ref_j, round(CASE WHEN sum(n) >= 5 THEN {TERM} ELSE 0 END, 6) + 0.0 AS mi, sum(n)::BIGINT AS n_obs FROM mm GROUP BY ALL)"
RATIO = """marg AS (SELECT pos_i, pos_j, pow(2, sum(-q * log2(q))) AS pp_j FROM (SELECT pos_i, pos_j, code_j, sum(n)::DOUBLE / any_value(t) AS q FROM pm GROUP BY ALL) GROUP BY ALL),
cond AS (SELECT pos_i, pos_j, code_i, any_value(ni) AS m, pow(2, sum(-(n::DOUBLE / ni) * log2(n::DOUBLE / ni))) AS pp FROM pm GROUP BY ALL),
ratio AS (SELECT pos_i, pos_j, round(pp_j / avg(pp), 6) + 0.0 AS ratio, count(*) AS n_codes FROM marg JOIN cond USING (pos_i, pos_j) WHERE m >= 5 GROUP BY pos_i, pos_j, pp_j)"""
LETTERS = f"""t AS (SELECT doc_id AS seq_id, list_transform(string_split(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ''), lambda x: (instr('{BASE20}', x) + 20) % 21) AS c FROM documents WHERE length(text) > 0)"""
GRAY = "xor({0}, {0} >> 1)"
G0, G1 = GRAY.format("c0"), GRAY.format("c1")
ADJ = f"{LETTERS}, w AS (SELECT seq_id, unnest(c[:-2]) AS c0, unnest(c[2:]) AS c1 FROM t WHERE len(c) > 1), adj AS (SELECT c0, c1, count(*) AS n FROM w GROUP BY ALL), av AS (SELECT * FROM adj WHERE c0 < 20 AND c1 < 20)"


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _orders(s: SparkSession, d: str) -> DataFrame:
    return readers.orders_profiles(s, d)


def _base(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pair and column counts of all orders from one scan."""
    return pairs.base_counts(_orders(s, d), GAP_LIMIT)


def _counts(s: SparkSession, d: str) -> DataFrame:
    return checkpointed(columns.column_counts(_orders(s, d)))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return _base(s, d)[0]


def _letters(s: SparkSession, d: str) -> DataFrame:
    return readers.profiles(readers.document_sequences(s, d))


def _runs(s: SparkSession, d: str, k: int) -> DataFrame:
    """Counts of all runs of k letters of whole texts, at most 21^k rows."""
    return checkpointed(kmer.text_counts(readers.document_sequences(s, d), k))


def _adjacent(s: SparkSession, d: str) -> DataFrame:
    return _runs(s, d, 2)


def _is_train():
    return F.pmod("seq_id", F.lit(TRAIN_SHARE[1])) < TRAIN_SHARE[0]


# ---- columns ----
@_query("sequence_stats", f"""SELECT count(*) AS n_sequences, min(length(s)) AS min_length, max(length(s)) AS max_length, round(avg(length(s)), 6) + 0.0 AS mean_length,
  sum(length(s) - length(replace(s, '-', '')))::BIGINT AS n_gaps, sum(length(s) - (length(s) - length(replace(s, '-', ''))) - length(regexp_replace(translate(s, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^{BASE20}]', '', 'g')))::BIGINT AS n_unknown
  FROM (SELECT coalesce(text, '') AS s FROM documents)""")
def sequence_stats(s, d):
    return columns.sequence_stats(readers.document_sequences(s, d), BASE20)


@_query("residue_counts", f"WITH {LETTERS} SELECT code::INT AS code, count(*) AS n FROM (SELECT unnest(c) AS code FROM t) GROUP BY code")
def residue_counts(s, d):
    return _runs(s, d, 1).withColumnRenamed("c0", "code")


@_query("column_entropy", f"{ORDER_CC}, {ENTROPY} SELECT pos, n_valid, round(e, 6) + 0.0 AS entropy, round(pow(2, e), 6) + 0.0 AS perplexity, CASE WHEN pow(2, e) < 1.5 THEN 'conserved' WHEN pow(2, e) > 5 THEN 'variable' ELSE 'moderate' END AS label FROM h")
def column_entropy(s, d):
    return columns.column_entropy(_counts(s, d))


@_query("majority_reference", f"{ORDER_CC}, {REF} SELECT c.pos, coalesce(ref_code, 0)::INT AS ref_code, coalesce(ref_n, 0) AS ref_n FROM (SELECT DISTINCT pos FROM cc) c LEFT JOIN ref USING (pos)")
def majority_reference(s, d):
    return columns.majority(_counts(s, d))


@_query("variable_positions", f"{ORDER_CC}, {ENTROPY} SELECT pos, round(e, 6) + 0.0 AS entropy FROM h WHERE round(e, 6) > 0.3")
def variable_positions(s, d):
    return columns.variable_positions(_counts(s, d))


@_query("consensus", f"{ORDER_CC}, {REF} SELECT c.pos, coalesce(ref_code, 0)::INT AS ref_code, round(coalesce(ref_n, 0)::DOUBLE / total, 6) + 0.0 AS share FROM (SELECT pos, sum(n) AS total FROM cc GROUP BY pos) c LEFT JOIN ref USING (pos)")
def consensus(s, d):
    return columns.consensus(_counts(s, d))


@_query("conservation", f"{ORDER_CC} SELECT pos, round(c, 6) + 0.0 AS conservation, c > 0.9 AS conserved, c < 0.7 AS variable FROM (SELECT pos, max(n)::DOUBLE / sum(n) AS c FROM cc GROUP BY pos)")
def conservation(s, d):
    return columns.conservation(_counts(s, d))


@_query("position_frequencies", f"{ORDER_CC} SELECT pos, code, round(n::DOUBLE / sum(n) OVER (PARTITION BY pos), 6) + 0.0 AS freq FROM cc WHERE code < 20")
def position_frequencies(s, d):
    return columns.position_frequencies(_counts(s, d))


@_query("mutations_by_position", f"{ORDER_CC}, {REF} SELECT pos, sum(CASE WHEN code <> coalesce(ref_code, 0) THEN n ELSE 0 END)::BIGINT AS n_mutations FROM cc LEFT JOIN ref USING (pos) GROUP BY pos")
def mutations_by_position(s, d):
    return columns.mutations_by_position(_counts(s, d))


@_query("mutations_by_sequence", f"{ORDER_CC}, {REF} SELECT seq_id, count(*) FILTER (code <> coalesce(ref_code, 0)) AS n_mutations FROM cells LEFT JOIN ref USING (pos) GROUP BY seq_id")
def mutations_by_sequence(s, d):
    return columns.mutations_by_sequence(_orders(s, d), _counts(s, d))


@_query("mutations_vs_first", f"""WITH {ORDERS}, {CELLS}, f AS (SELECT pos, code AS r FROM cells WHERE seq_id = (SELECT min(seq_id) FROM p))
SELECT pos, bit_count(xor({GRAY.format('code')}, {GRAY.format('r')}))::INT AS gray_distance, count(*) AS n FROM cells JOIN f USING (pos) WHERE code < 20 AND r < 20 AND code <> r GROUP BY ALL""")
def mutations_vs_first(s, d):
    return columns.mutations_vs_first(_orders(s, d))


@_query("mutations_vs_first_by_sequence", f"WITH {ORDERS}, {CELLS}, f AS (SELECT pos, code AS r FROM cells WHERE seq_id = (SELECT min(seq_id) FROM p)) SELECT seq_id, count(*) FILTER (code < 20 AND r < 20 AND code <> r) AS n_mutations FROM cells LEFT JOIN f USING (pos) GROUP BY seq_id")
def mutations_vs_first_by_sequence(s, d):
    return columns.mutations_vs_first_by_sequence(_orders(s, d))


@_query("top_mutated_vs_first", f"""WITH {ORDERS}, {CELLS}, f AS (SELECT pos, code AS r FROM cells WHERE seq_id = (SELECT min(seq_id) FROM p))
SELECT pos, count(*) AS n FROM cells JOIN f USING (pos) WHERE code < 20 AND r < 20 AND code <> r GROUP BY pos ORDER BY n DESC, pos LIMIT 10""")
def top_mutated_vs_first(s, d):
    return columns.top_mutated(columns.mutations_vs_first(_orders(s, d)))


@_query("variable_by_perplexity", f"{ORDER_CC}, {ENTROPY} SELECT pos, round(pow(2, e), 6) + 0.0 AS perplexity FROM h WHERE round(pow(2, e), 6) > 3.0")
def variable_by_perplexity(s, d):
    return columns.variable_positions(_counts(s, d), 3.0, "perplexity")


@_query("long_sequences", "WITH l AS (SELECT doc_id AS seq_id, length(coalesce(text, '')) AS length FROM documents WHERE length(coalesce(text, '')) > 100) SELECT * FROM l WHERE (SELECT count(*) FROM l) >= 5")
def long_sequences(s, d):
    return columns.long_enough(readers.document_sequences(s, d)).select("seq_id", F.length("sequence").cast("long").alias("length"))


# ---- pairs ----
@_query("mi_full", f"{ORDER_PC} SELECT * FROM mi")
def mi_full(s, d):
    return pairs.mutual_information(_pairs(s, d))


@_query("mi_window", f"{ORDER_CC}, {REF}, {PC.format(gap=4)}, {PV}, {PM.format(name='pm', of='pv')}, {MI} SELECT * FROM mi")
def mi_window(s, d):
    return pairs.mutual_information(pairs.pair_counts(_orders(s, d), 4))


@_query("mi_mutation_only", f"{ORDER_PC}, {MUT} SELECT * FROM mut")
def mi_mutation_only(s, d):
    return pairs.mutation_information(*_base(s, d))


@_query("coevolving_pairs", f"""{ORDER_PC}, {ENTROPY}, {MUT} SELECT pos_i, pos_j, mi, n_obs, ref_i, ref_j FROM mut
WHERE mi > 0.1 AND pos_i IN (SELECT pos FROM h WHERE round(e, 6) > 0.3) AND pos_j IN (SELECT pos FROM h WHERE round(e, 6) > 0.3)""")
def coevolving_pairs(s, d):
    return pairs.coevolving_pairs(_orders(s, d), GAP_LIMIT)


# ---- wide alignments, by tiles: the components of all embeddings ----
@_query("mi_embedding_columns", f"{WIDE_PC} SELECT * FROM mi")
def mi_embedding_columns(s, d):
    return tiles.mutual_information(readers.embedding_profiles(s, d))


@_query("mutation_mi_embedding_columns", f"{WIDE_PC}, {MUT} SELECT pos_i, pos_j, ref_i, ref_j, mi, n_obs FROM mut")
def mutation_mi_embedding_columns(s, d):
    return tiles.mutation_information(readers.embedding_profiles(s, d))


@_query("coevolving_embedding_columns", f"""{WIDE_PC}, {ENTROPY}, {MUT} SELECT pos_i, pos_j, mi, n_obs, ref_i, ref_j FROM mut
WHERE mi > 0.5 AND pos_i IN (SELECT pos FROM h WHERE round(e, 6) > 0.3) AND pos_j IN (SELECT pos FROM h WHERE round(e, 6) > 0.3)""")
def coevolving_embedding_columns(s, d):
    return tiles.coevolving_pairs(readers.embedding_profiles(s, d), min_mi=0.5)


@_query("pair_counts_embedding_columns", f"WITH {EMBEDDINGS}, {CELLS}, {PC.format(gap=10_000)} SELECT pos_i, pos_j, count(*) AS n_cells, sum(n)::BIGINT AS n, max(n) AS most FROM pc GROUP BY ALL")
def pair_counts_embedding_columns(s, d):
    return tiles.pair_counts(readers.embedding_profiles(s, d)).groupBy("pos_i", "pos_j").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n"), F.max("n").alias("most"))


@_query("pair_maps", f"{ORDER_PC} SELECT pos_i, pos_j, code_i, code_j, n, round(n::DOUBLE / t, 9) + 0.0 AS p FROM pm")
def pair_maps(s, d):
    return pairs.pair_maps(_pairs(s, d))


_P, _PI, _PJ = "n::DOUBLE / t", "ni::DOUBLE / t", "nj::DOUBLE / t"
_JO = f"j AS (SELECT pos_i, pos_j, code_i, code_j, n, round(ln(({_P} + 1e-10) / ({_PI} * ({_PJ}) + 1e-10)), 6) + 0.0 AS j FROM pm)"
_GRID = "full_pv AS (SELECT g.pos_i, g.pos_j, g.code_i, g.code_j, coalesce(n, 0) AS n FROM (SELECT pos_i, pos_j, a::INT AS code_i, b::INT AS code_j FROM (SELECT DISTINCT pos_i, pos_j FROM pv), range(20) x(a), range(20) y(b)) g LEFT JOIN pv USING (pos_i, pos_j, code_i, code_j))"
_JI = f"{_GRID}, {PM.format(name='fm', of='full_pv')}, j AS (SELECT pos_i, pos_j, code_i, code_j, n, round(ln(({_P} + 1e-10) / (({_PI} + 1e-10) * ({_PJ} + 1e-10))), 6) + 0.0 AS j FROM fm)"


@_query("coupling_observed", f"{ORDER_PC}, {_JO} SELECT * FROM j")
def coupling_observed(s, d):
    return pairs.couplings(_pairs(s, d))


@_query("coupling_all_cells", f"{ORDER_PC}, {_JI} SELECT * FROM j")
def coupling_all_cells(s, d):
    return pairs.couplings(_pairs(s, d), "inside", observed_only=False)


@_query("coupling_mean", f"{ORDER_PC}, {_JI} SELECT pos_i, pos_j, round(sum(abs(j)) / 400, 6) + 0.0 AS mean_abs_j FROM j GROUP BY ALL")
def coupling_mean(s, d):
    return pairs.mean_coupling(pairs.couplings(_pairs(s, d), "inside", observed_only=False))


@_query("coupling_strongest", f"""{ORDER_PC}, {_JO}, r AS (SELECT *, row_number() OVER (PARTITION BY pos_i, pos_j ORDER BY j DESC, code_i, code_j) AS u, row_number() OVER (PARTITION BY pos_i, pos_j ORDER BY j, code_i, code_j) AS d FROM j)
SELECT a.pos_i, a.pos_j, a.j AS max_j, a.code_i AS max_i, a.code_j AS max_k, b.j AS min_j, b.code_i AS min_i, b.code_j AS min_k FROM r a JOIN r b USING (pos_i, pos_j) WHERE a.u = 1 AND b.d = 1""")
def coupling_strongest(s, d):
    return pairs.strongest_couplings(pairs.couplings(_pairs(s, d)))


@_query("coupling_top", f"{ORDER_PC}, {_JO} SELECT pos_i, pos_j, code_i, code_j, n, j, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY pos_i, pos_j ORDER BY abs(j) DESC, code_i, code_j) AS k FROM j) WHERE k <= 5")
def coupling_top(s, d):
    return ranking.top_per_pair(pairs.couplings(_pairs(s, d)), F.abs("j"), 5)


@_query("covariances", f"{ORDER_PC} SELECT pos_i, pos_j, code_i, code_j, round({_P} - {_PI} * ({_PJ}), 9) + 0.0 AS cov FROM pm")
def covariances(s, d):
    return pairs.covariances(_pairs(s, d))


@_query("conditional_perplexity", f"{ORDER_CC}, {PC.format(gap=GAP_LIMIT)}, {PM.format(name='pm', of='pc')} SELECT pos_i, pos_j, code_i, any_value(ni) AS n, round(pow(2, sum(-(n::DOUBLE / ni) * log2(n::DOUBLE / ni))), 6) + 0.0 AS pp FROM pm GROUP BY pos_i, pos_j, code_i")
def conditional_perplexity(s, d):
    return pairs.conditional_perplexity(_pairs(s, d), include_gap=True)


@_query("perplexity_ratio", f"{ORDER_PC}, {RATIO} SELECT * FROM ratio")
def perplexity_ratio(s, d):
    return pairs.perplexity_ratio(_pairs(s, d))


def _scores(s, d):
    pc = _pairs(s, d)
    return pairs.mutual_information(pc), pairs.perplexity_ratio(pc)


_BOTH = f"""{RATIO}, b AS (SELECT pos_i, pos_j, mi, ratio FROM mi JOIN ratio USING (pos_i, pos_j)),
rk AS (SELECT *, (row_number() OVER (ORDER BY mi, pos_i, pos_j) - 1)::DOUBLE / (count(*) OVER () - 1) AS rm, (row_number() OVER (ORDER BY ratio, pos_i, pos_j) - 1)::DOUBLE / (count(*) OVER () - 1) AS rr,
 (mi - avg(mi) OVER ()) / stddev_pop(mi) OVER () AS zm, (ratio - avg(ratio) OVER ()) / stddev_pop(ratio) OVER () AS zr FROM b),
cs AS (SELECT pos_i, pos_j, round((rm + rr) / 2, 6) + 0.0 AS mean_rank, round(rm + rr, 6) + 0.0 AS rank_sum, round(zm + zr, 6) + 0.0 AS z_sum FROM rk)"""


@_query("combined_scores", f"{ORDER_PC}, {_BOTH} SELECT * FROM cs")
def combined_scores(s, d):
    return ranking.combined_scores(*_scores(s, d))


@_query("rank_agreement", f"""{ORDER_PC}, {_BOTH} SELECT count(*) AS n_common, 5::INT AS k FROM (SELECT pos_i, pos_j FROM mi ORDER BY mi DESC, pos_i, pos_j LIMIT 5) JOIN (SELECT pos_i, pos_j FROM cs ORDER BY mean_rank DESC, pos_i, pos_j LIMIT 5) USING (pos_i, pos_j)""")
def rank_agreement(s, d):
    mi, ratio = _scores(s, d)
    return ranking.rank_agreement(ranking.top(mi, "mi", 5), ranking.top(ranking.combined_scores(mi, ratio), "mean_rank", 5))


@_query("spearman", f"""{ORDER_PC}, {_BOTH} SELECT round(corr(x, y), 6) + 0.0 AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY mi) + (count(*) OVER (PARTITION BY mi) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY ratio) + (count(*) OVER (PARTITION BY ratio) - 1) / 2.0::DOUBLE AS y FROM b)""")
def spearman(s, d):
    mi, ratio = _scores(s, d)
    return ranking.spearman(mi.join(ratio, pairs.PAIR), "mi", "ratio")


@_query("mi_summary", f"{ORDER_PC} SELECT max(mi) AS max_mi, round(avg(mi) FILTER (mi > 0), 6) + 0.0 AS mean_positive, count(*) FILTER (mi > 1.0) AS n_above FROM mi")
def mi_summary(s, d):
    return pairs.mutual_information(_pairs(s, d)).agg(F.max("mi").alias("max_mi"), (F.round(F.avg(F.when(F.col("mi") > 0, F.col("mi"))), 6) + F.lit(0.0)).alias("mean_positive"), F.count_if(F.col("mi") > 1.0).alias("n_above"))


@_query("mi_heat_map", f"{ORDER_PC}, h AS (SELECT pos_i, pos_j, mi, CASE WHEN mi > 2 THEN '**' WHEN mi > 1 THEN '*' ELSE '' END AS mark FROM mi) SELECT * FROM h UNION ALL SELECT pos_j AS pos_i, pos_i AS pos_j, mi, mark FROM h")
def mi_heat_map(s, d):
    return reports.heat_map(pairs.mutual_information(_pairs(s, d)))


_BEST = "SELECT '{section}' AS section, row_number() OVER (ORDER BY v DESC, i, j)::INT AS rank, i, j, v::DOUBLE AS value FROM ({of}) ORDER BY v DESC, i, j LIMIT 20"


@_query("run_summary", f"""{ORDER_PC}, {ENTROPY}, sw AS (SELECT a.code AS c0, b.code AS c1 FROM cells a JOIN cells b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1 WHERE a.code < 20 AND b.code < 20),
nd AS (SELECT bit_count(xor({G0}, {G1}))::INT AS d, count(*) AS n FROM sw GROUP BY 1),
ent AS ({_BEST.format(section='column_entropy', of="SELECT pos AS i, -1 AS j, round(e, 6) + 0.0 AS v FROM h")}),
muts AS ({_BEST.format(section='mutations', of="SELECT pos AS i, -1 AS j, sum(CASE WHEN code <> coalesce(ref_code, 0) THEN n ELSE 0 END) AS v FROM cc LEFT JOIN ref USING (pos) GROUP BY pos")}),
prs AS ({_BEST.format(section='pair_mi', of="SELECT pos_i AS i, pos_j AS j, mi AS v FROM mi")})
SELECT 'variable_columns' AS section, -1 AS rank, -1 AS i, -1 AS j, count(*) FILTER (round(e, 6) > 0.3)::DOUBLE AS value FROM h UNION ALL SELECT 'pairs', -1, -1, -1, count(*)::DOUBLE FROM mi UNION ALL SELECT 'high_pairs', -1, -1, -1, count(*) FILTER (mi > 0.5)::DOUBLE FROM mi
UNION ALL SELECT * FROM ent UNION ALL SELECT * FROM muts UNION ALL SELECT * FROM prs UNION ALL SELECT 'neighbour_share', -1, d, -1, round(n::DOUBLE / sum(n) OVER (), 6) + 0.0 FROM nd""")
def run_summary(s, d):
    return reports.summary_rows(_orders(s, d), GAP_LIMIT)


_SELF = f"sw AS (SELECT a.code AS c0, b.code AS c1 FROM cells a JOIN cells b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1), av AS (SELECT c0, c1, count(*) AS n FROM sw WHERE c0 < 20 AND c1 < 20 GROUP BY ALL)"
_CELL = f"({G0} * 32 + {G1})::BIGINT"


@_query("median_split", f"""{ORDER_PC}, {_SELF}, gm AS (SELECT {_CELL} AS cell, round(n::DOUBLE / sum(n) OVER (), 9) + 0.0 AS freq FROM av),
on_cells AS (SELECT cell FROM gm WHERE freq >= (SELECT quantile_cont(freq, 0.75) FROM gm WHERE freq > 0)), f AS (SELECT pos, code FROM cells WHERE seq_id = (SELECT min(seq_id) FROM p)),
x AS (SELECT mi, a.code < 20 AND b.code < 20 AND EXISTS (SELECT 1 FROM on_cells o WHERE o.cell = {GRAY.format('a.code')} * 32 + {GRAY.format('b.code')} OR o.cell = {GRAY.format('b.code')} * 32 + {GRAY.format('a.code')}) AS on_set FROM mi JOIN f a ON a.pos = pos_i JOIN f b ON b.pos = pos_j WHERE mi > 0),
y AS (SELECT *, median(mi) OVER () AS cut FROM x)
SELECT count(*) FILTER (on_set) AS n_on, count(*) FILTER (NOT on_set) AS n_off, round(coalesce(avg(mi) FILTER (on_set), 0), 6) + 0.0 AS mean_on, round(coalesce(avg(mi) FILTER (NOT on_set), 0), 6) + 0.0 AS mean_off,
  round(coalesce(avg(CASE WHEN on_set = (mi > cut) THEN 1.0::DOUBLE ELSE 0 END), 0), 6) + 0.0 AS accuracy FROM y""")
def median_split(s, d):
    p = _orders(s, d)
    on = kmer.threshold_map(kmer.gray_map(checkpointed(kmer.adjacent_counts(p))))
    first = p.agg(F.min_by("codes", "seq_id").alias("c")).select(F.posexplode("c").alias("pos", "code"))
    return kmer.median_split(pairs.mutual_information(_pairs(s, d)), on, first)


@_query("gray_correlations", f"""{ORDER_CC}, {PC.format(gap=GAP_LIMIT)}, g AS (SELECT pos_i, pos_j, n::DOUBLE AS n, (CASE WHEN code_i < 20 THEN {GRAY.format('code_i')} ELSE 0 END)::DOUBLE AS x, (CASE WHEN code_j < 20 THEN {GRAY.format('code_j')} ELSE 0 END)::DOUBLE AS y FROM pc),
s AS (SELECT pos_i, pos_j, sum(n) * sum(n * x * y) - sum(n * x) * sum(n * y) AS c, (sum(n) * sum(n * x * x) - sum(n * x) * sum(n * x)) * (sum(n) * sum(n * y * y) - sum(n * y) * sum(n * y)) AS v FROM g GROUP BY ALL)
SELECT pos_i, pos_j, round(c / sqrt(v), 6) + 0.0 AS r FROM s WHERE v > 0 AND abs(round(c / sqrt(v), 6)) > 0.1""")
def gray_correlations(s, d):
    return kmer.gray_correlations(_orders(s, d), least=0.1)


@_query("perplexity_ratio_own_entropy", f"{ORDER_PC}, {ENTROPY}, {RATIO} SELECT pos_i, pos_j, round(pow(2, any_value(round(e, 6))) / avg(pp), 6) + 0.0 AS ratio, count(*) AS n_codes FROM cond JOIN h ON h.pos = pos_j WHERE m >= 5 GROUP BY pos_i, pos_j")
def perplexity_ratio_own_entropy(s, d):
    pc, counts = _base(s, d)
    return pairs.perplexity_ratio(pc, entropy=columns.column_entropy(counts))


@_query("coupling_zero_below", f"{ORDER_PC}, {_JO} SELECT pos_i, pos_j, code_i, code_j, n, CASE WHEN sum(n) OVER (PARTITION BY pos_i, pos_j) >= 10000 THEN j ELSE 0 END AS j FROM j")
def coupling_zero_below(s, d):
    return pairs.couplings(_pairs(s, d), min_total=10_000)


@_query("region_ratios", f"{ORDER_PC}, {RATIO} SELECT 'SP' AS region, round(avg(ratio), 6) + 0.0 AS mean_ratio, count(*) AS n FROM ratio")
def region_ratios(s, d):
    r = pairs.perplexity_ratio(_pairs(s, d))
    return r.groupBy(region(F.col("pos_i")).alias("region")).agg((F.round(F.avg("ratio"), 6) + F.lit(0.0)).alias("mean_ratio"), F.count("*").alias("n"))


# ---- k-mers and neighbours of whole texts ----
@_query("kmer_map", f"WITH {LETTERS}, w AS (SELECT unnest(c[:-3]) AS c0, unnest(c[2:-2]) AS c1, unnest(c[3:]) AS c2 FROM t WHERE len(c) > 2), g AS (SELECT (c0 * 400 + c1 * 20 + c2)::BIGINT AS cell, count(*) AS n FROM w WHERE c0 < 20 AND c1 < 20 AND c2 < 20 GROUP BY 1) SELECT cell, n, round(n::DOUBLE / sum(n) OVER (), 9) + 0.0 AS freq FROM g")
def kmer_map(s, d):
    return kmer.kmer_map(_runs(s, d, 3), 3)


_GM = f"gm AS (SELECT ({G0} * 32 + {G1})::BIGINT AS cell, n, round(n::DOUBLE / sum(n) OVER (), 9) + 0.0 AS freq FROM av)"


@_query("gray_map", f"WITH {ADJ}, {_GM} SELECT * FROM gm")
def gray_map(s, d):
    return kmer.gray_map(_adjacent(s, d))


@_query("consensus_map", f"WITH {ADJ}, per AS (SELECT seq_id, ({G0} * 32 + {G1})::BIGINT AS cell, count(*) AS n FROM w WHERE c0 < 20 AND c1 < 20 GROUP BY ALL), f AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY seq_id) AS q FROM per) SELECT cell, round(sum(q) / (SELECT count(DISTINCT seq_id) FROM per), 9) + 0.0 AS freq FROM f GROUP BY cell")
def consensus_map(s, d):
    return kmer.consensus_map(readers.document_sequences(s, d))


@_query("threshold_map", f"WITH {ADJ}, {_GM}, c AS (SELECT quantile_cont(freq, 0.75) AS cut FROM gm WHERE freq > 0) SELECT cell, freq, round(cut, 9) + 0.0 AS threshold FROM gm, c WHERE freq >= cut")
def threshold_map(s, d):
    return kmer.threshold_map(kmer.gray_map(_adjacent(s, d)))


@_query("gray_adjacency", f"WITH {ADJ}, g AS (SELECT bit_count(xor({G0}, {G1}))::INT AS distance, sum(n)::BIGINT AS n FROM av GROUP BY 1), q AS (SELECT *, n::DOUBLE / sum(n) OVER () AS x FROM g) SELECT distance, n, round(x, 6) + 0.0 AS share, CASE WHEN distance = 1 THEN round(x / (5.0::DOUBLE / 31), 6) + 0.0 END AS enrichment FROM q")
def gray_adjacency(s, d):
    return kmer.gray_adjacency(_adjacent(s, d))


@_query("gray_adjacency_gaps", f"WITH {ADJ}, g AS (SELECT bit_count(xor({G0}, {G1}))::INT AS distance, sum(n)::BIGINT AS n FROM adj GROUP BY 1), q AS (SELECT *, n::DOUBLE / sum(n) OVER () AS x FROM g) SELECT distance, n, round(x, 6) + 0.0 AS share, CASE WHEN distance = 1 THEN round(x / (5.0::DOUBLE / 31), 6) + 0.0 END AS enrichment FROM q")
def gray_adjacency_gaps(s, d):
    return kmer.gray_adjacency(_adjacent(s, d), include_gap=True)


_SIG = f"""{ADJ}, l AS (SELECT seq_id, code, count(*) AS n FROM (SELECT seq_id, unnest(c) AS code FROM t) WHERE code < 20 GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY seq_id) AS len FROM l), e AS (SELECT seq_id, any_value(len)::BIGINT AS length, sum(n) FILTER (code IN ({BASE20.index('G')}, {BASE20.index('C')})) AS gc, sum(-(n::DOUBLE / len) * log2(n::DOUBLE / len)) AS h FROM q GROUP BY seq_id),
nm AS (SELECT seq_id, sqrt(sum(n::DOUBLE * n)) AS norm FROM (SELECT seq_id, c0, c1, count(*) AS n FROM w WHERE c0 < 20 AND c1 < 20 GROUP BY ALL) GROUP BY seq_id),
sg AS (SELECT seq_id, length, round(coalesce(gc, 0)::DOUBLE / length, 6) + 0.0 AS gc_share, round(h, 6) + 0.0 AS entropy, round(coalesce(norm, 0), 6) + 0.0 AS map_norm FROM e LEFT JOIN nm USING (seq_id))"""


@_query("sequence_signatures", f"WITH {_SIG} SELECT * FROM sg")
def sequence_signatures(s, d):
    return kmer.signatures(readers.document_sequences(s, d))


@_query("signature_correlations", f"WITH {_SIG} SELECT round(corr(length, entropy), 6) + 0.0 AS length_entropy, round(corr(length, map_norm), 6) + 0.0 AS length_norm, round(corr(gc_share, entropy), 6) + 0.0 AS gc_entropy FROM sg")
def signature_correlations(s, d):
    return kmer.signature_correlations(kmer.signatures(readers.document_sequences(s, d)))


# Implicants as (name, values, mask): free bits in the mask.
_MOTIFS = [("m0", 0b0000100010, 0b0000000001), ("m1", 0b0001000000, 0b0000011111), ("m2", 0b0000000110, 0b1111100000)]


@_query("motif_counts", f"WITH {ADJ}, m AS (SELECT * FROM (VALUES {', '.join(str(m) for m in _MOTIFS)}) v(implicant, vals, mask)) SELECT implicant, sum(n)::BIGINT AS n FROM m JOIN av ON (xor({G0} * 32 + {G1}, vals) & ~mask & 1023) = 0 GROUP BY implicant")
def motif_counts(s, d):
    return kmer.motif_counts(_adjacent(s, d), s.createDataFrame(_MOTIFS, "implicant string, values int, mask int"))


@_query("distance_histogram", f"""WITH {LETTERS}, r AS (SELECT code, count(*)::DOUBLE AS n FROM (SELECT unnest(c) AS code FROM t) WHERE code < 20 GROUP BY code),
q AS (SELECT bit_count(xor({GRAY.format('a.code')}, {GRAY.format('b.code')}))::INT AS distance, sum(CASE WHEN a.code = b.code THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END) AS p FROM r a JOIN r b ON a.code <= b.code GROUP BY 1)
SELECT distance, round(p / sum(p) OVER (), 9) + 0.0 AS share FROM q""")
def distance_histogram(s, d):
    return kmer.distance_histogram(_runs(s, d, 1))


@_query("sequence_maps", f"WITH {LETTERS}, f AS (SELECT * FROM t WHERE seq_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10)), w AS (SELECT seq_id, unnest(c[:-2])::INT AS c0, unnest(c[2:])::INT AS c1 FROM f WHERE len(c) > 1) SELECT seq_id, c0, c1, count(*) AS n FROM w WHERE c0 < 20 AND c1 < 20 GROUP BY ALL")
def sequence_maps(s, d):
    return kmer.sequence_maps(_letters(s, d))


@_query("encoded_sequences", f"""WITH l AS (SELECT doc_id AS seq_id, coalesce(text, '') AS s FROM documents ORDER BY doc_id LIMIT 50),
x AS (SELECT seq_id, length(s) AS length, list_filter(list_transform(string_split(translate(s, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ''), lambda x: CASE WHEN length(x) > 0 THEN instr('{BASE20}', x) - 1 ELSE -1 END), lambda x: x >= 0) AS c FROM l)
SELECT seq_id, length, len(c)::BIGINT AS encoded_length, array_to_string(list_transform(c[1:100], lambda x: {GRAY.format('x')}), ',') AS gray_values FROM x""")
def encoded_sequences(s, d):
    return reports.encoded_sequences(readers.document_sequences(s, d))


_FREQ = "f AS (SELECT c0, c1, n::DOUBLE / sum(n) OVER () AS f FROM av)"


@_query("map_symmetry", f"WITH {ADJ}, {_FREQ} SELECT round(sum(abs(coalesce(a.f, 0) - coalesce(b.f, 0))) / 400, 9) + 0.0 AS symmetry_error FROM f a FULL JOIN f b ON a.c0 = b.c1 AND a.c1 = b.c0")
def map_symmetry(s, d):
    return kmer.map_symmetry(_adjacent(s, d))


@_query("map_autocorrelation", f"WITH {ADJ}, {_FREQ}, x AS (SELECT c0 * 20 + c1 AS cell, f FROM f WHERE c0 * 20 + c1 < 64), y AS (SELECT (b.cell - a.cell)::INT AS lag, sum(a.f * b.f) AS s FROM x a JOIN x b ON b.cell >= a.cell GROUP BY 1) SELECT lag, round(s / max(s) FILTER (lag = 0) OVER (), 6) + 0.0 AS r FROM y")
def map_autocorrelation(s, d):
    return kmer.map_autocorrelation(_adjacent(s, d))


@_query("walsh_spectrum", f"WITH {ADJ}, {_FREQ}, v AS (SELECT 32 * c0 + c1 AS i, f FROM f), k AS (SELECT k::INT AS k, abs(sum(f * (1 - 2 * (bit_count(k & i) % 2)))) AS m FROM v, range(1024) r(k) GROUP BY 1) SELECT k, round(m / (SELECT sum(m) FROM k), 9) + 0.0 AS share FROM k ORDER BY share DESC, k LIMIT 5")
def walsh_spectrum(s, d):
    a = _adjacent(s, d).where(valid(F.col("c0")) & valid(F.col("c1")))
    v = with_total(a, "n", "t").select((F.col("c0") * 32 + F.col("c1")).alias("i"), (F.col("n").cast("double") / F.col("t")).alias("v"))
    return spectral.spectrum(v, 10)


@_query("ratio_bootstrap", f"""{ORDER_PC}, b5 AS (SELECT pos_i, pos_j FROM mi ORDER BY mi DESC, pos_i, pos_j LIMIT 5),
c5 AS (SELECT pv.* FROM pv JOIN b5 USING (pos_i, pos_j)),
tops AS (SELECT pos_i, pos_j, pow(2, sum(-q * log2(q))) AS top FROM (SELECT pos_i, pos_j, code_j, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY pos_i, pos_j) AS q FROM c5 GROUP BY pos_i, pos_j, code_j) GROUP BY ALL),
hashed AS (SELECT pos_i, pos_j, code_i, code_j, n::DOUBLE AS n, b, md5(concat_ws(':', 42, b, pos_i, pos_j, code_i, code_j)) AS h FROM c5, range(200) r(b)),
uni AS (SELECT *, (('0x' || substr(h, 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496 AS u, ('0x' || substr(h, 14, 13))::BIGINT::DOUBLE / 4503599627370496 AS v FROM hashed),
drawn AS (SELECT pos_i, pos_j, code_i, b, CASE WHEN n <= 50 THEN (list_reduce(range(1, (n + 10 * sqrt(n) + 10)::BIGINT + 1),
  lambda a, k: CASE WHEN a.c < u THEN {{'p': a.p * n / k, 'c': a.c + a.p * n / k, 'k': k}} ELSE a END, {{'p': exp(-n), 'c': exp(-n), 'k': 0::BIGINT}})).k
  ELSE greatest(0.0, round(n + sqrt(n) * sqrt(-2 * ln(u)) * cos(2 * pi() * v)))::BIGINT END AS w FROM uni),
given AS (SELECT pos_i, pos_j, b, code_i, w::DOUBLE AS w, sum(w) OVER (PARTITION BY pos_i, pos_j, b, code_i)::DOUBLE AS m FROM drawn WHERE w > 0),
rows AS (SELECT pos_i, pos_j, b, code_i, pow(2, sum(-(w / m) * log2(w / m))) AS pp FROM given WHERE m >= 5 GROUP BY ALL),
ratios AS (SELECT pos_i, pos_j, b, any_value(top) / avg(pp) AS r FROM rows JOIN tops USING (pos_i, pos_j) GROUP BY pos_i, pos_j, b)
SELECT pos_i, pos_j, round(avg(r), 6) + 0.0 AS mean, round(stddev_pop(r), 6) + 0.0 AS deviation, round(quantile_cont(r, 0.025), 6) + 0.0 AS low, round(quantile_cont(r, 0.975), 6) + 0.0 AS high FROM ratios GROUP BY pos_i, pos_j""")
def ratio_bootstrap(s, d):
    pc = _pairs(s, d)
    return pairs.bootstrap_ratio(pc, ranking.top(pairs.mutual_information(pc), "mi", 5))


@_query("score_regions", f"{ORDER_CC}, {ENTROPY} SELECT CASE WHEN pos < 13 THEN 'SP' ELSE 'NTD' END AS region, count(*) AS n, round(1 / (1 + exp(-greatest(-10, least(10, avg(e))))), 6) + 0.0 AS sigma FROM h GROUP BY 1")
def score_regions(s, d):
    e = columns.column_entropy(_counts(s, d))
    return e.groupBy(region(F.col("pos")).alias("region")).agg(F.count("*").alias("n"), F.round(sigmoid(F.avg("entropy")), 6).alias("sigma"))


# ---- events as sequences ----
_EVENTS = "ev AS (SELECT user_id, code, lead(code) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM (SELECT *, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events))"


@_query("event_transitions", f"WITH {_EVENTS} SELECT code::INT AS c0, nxt::INT AS c1, count(*) AS n FROM ev WHERE nxt IS NOT NULL GROUP BY ALL")
def event_transitions(s, d):
    return kmer.transitions(readers.event_cells(s, d), "ts", "event_id")


@_query("event_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(s, d):
    from ..streaming.counts import windowed_counts

    return windowed_counts(s.read.parquet(f"{d}/events.parquet"), "ts", "event_type", "1 hour", "1 day").select("start", "event_type", "n")


# ---- Boolean maps and rules ----
_MAP = "seen AS (SELECT pv.*, a.ref_code AS ref_i, b.ref_code AS ref_j FROM pv JOIN ref a ON a.pos = pos_i JOIN ref b ON b.pos = pos_j)"


@_query("mutation_map", f"{ORDER_PC}, {_MAP} SELECT pos_i, pos_j, code_i, code_j, ref_i, ref_j, n, CASE WHEN code_i = ref_i AND code_j = ref_j THEN -1 ELSE 1 END AS state FROM seen")
def mutation_map(s, d):
    return boolean.mutation_map(*_base(s, d))


@_query("forbidden_map", f"{ORDER_PC}, {_MAP} SELECT g.pos_i, g.pos_j, g.ref_i, g.ref_j, a::INT AS code_i, b::INT AS code_j FROM (SELECT DISTINCT pos_i, pos_j, ref_i, ref_j FROM seen) g, range(20) x(a), range(20) y(b) WHERE NOT (a = ref_i AND b = ref_j) AND NOT EXISTS (SELECT 1 FROM pv WHERE pv.pos_i = g.pos_i AND pv.pos_j = g.pos_j AND pv.code_i = a AND pv.code_j = b)")
def forbidden_map(s, d):
    return boolean.forbidden_map(*_base(s, d))


_ON = "SELECT pos_i, pos_j, code_i, code_j, value, round(cut, 9) + 0.0 AS threshold, 1::INT AS state FROM x JOIN (SELECT pos_i, pos_j, quantile_cont(value, {share}) AS cut FROM x WHERE value <> 0 GROUP BY ALL) USING (pos_i, pos_j) WHERE value >= cut AND value <> 0"


@_query("pair_on_set", f"{ORDER_PC}, x AS (SELECT pos_i, pos_j, code_i, code_j, round(n::DOUBLE / t, 9) + 0.0 AS value FROM pm) {_ON.format(share=0.7)}")
def pair_on_set(s, d):
    return boolean.on_set(pairs.pair_maps(_pairs(s, d)), "p", 0.7)


@_query("coupling_on_set", f"{ORDER_PC}, {_JI}, x AS (SELECT pos_i, pos_j, code_i, code_j, abs(j) AS value FROM j) {_ON.format(share=0.75)}")
def coupling_on_set(s, d):
    j = pairs.couplings(_pairs(s, d), "inside", observed_only=False)
    return boolean.on_set(j.withColumn("size", F.abs("j")), "size", 0.75)


# All implicants of 10-bit maps: a cube is one of 243 cubes of rows times one of 243 of columns, each a set of 32 codes.
_PRIMES = """halves AS (SELECT m::INT AS m, v::INT AS v, bit_or(1::BIGINT << x)::BIGINT AS held FROM range(32) a(m), range(32) b(v), range(32) c(x) WHERE (v & m) = 0 AND (xor(x, v) & (31 - m)) = 0 GROUP BY ALL),
on_cells AS (SELECT pos_i, pos_j, code_i, code_j FROM maps WHERE state = 1),
off_cells AS (SELECT g.pos_i, g.pos_j, a::INT AS code_i, b::INT AS code_j FROM (SELECT DISTINCT pos_i, pos_j FROM maps) g, range(20) x(a), range(20) y(b) WHERE NOT EXISTS (SELECT 1 FROM maps s WHERE s.pos_i = g.pos_i AND s.pos_j = g.pos_j AND s.code_i = a AND s.code_j = b)),
row_off AS (SELECT pos_i, pos_j, m, v, bit_or(1::BIGINT << code_j)::BIGINT AS hit FROM off_cells JOIN halves ON (held >> code_i) & 1 = 1 GROUP BY ALL),
row_on AS (SELECT pos_i, pos_j, m, v, bit_or(1::BIGINT << code_j)::BIGINT AS hit FROM on_cells JOIN halves ON (held >> code_i) & 1 = 1 GROUP BY ALL),
allowed AS (SELECT o.pos_i, o.pos_j, o.m AS mr, o.v AS vr, c.m AS mc, c.v AS vc FROM row_on o LEFT JOIN row_off f USING (pos_i, pos_j, m, v), halves c WHERE (o.hit & c.held) <> 0 AND (coalesce(f.hit, 0) & c.held) = 0),
smaller AS (SELECT pos_i, pos_j, mr - (1 << b)::INT AS mr, vr | (s << b)::INT AS vr, mc, vc FROM allowed, range(5) x(b), range(2) y(s) WHERE (mr >> b) & 1 = 1
  UNION ALL SELECT pos_i, pos_j, mr, vr, mc - (1 << b)::INT, vc | (s << b)::INT FROM allowed, range(5) x(b), range(2) y(s) WHERE (mc >> b) & 1 = 1),
primes AS (SELECT * FROM allowed ANTI JOIN smaller USING (pos_i, pos_j, mr, vr, mc, vc)),
covers AS (SELECT p.*, code_i, code_j, count(*) OVER (PARTITION BY p.pos_i, p.pos_j, code_i, code_j) AS by_how_many FROM primes p JOIN halves r ON r.m = mr AND r.v = vr JOIN halves c ON c.m = mc AND c.v = vc
  JOIN on_cells o ON o.pos_i = p.pos_i AND o.pos_j = p.pos_j AND (r.held >> o.code_i) & 1 = 1 AND (c.held >> o.code_j) & 1 = 1),
imp AS (SELECT pos_i, pos_j, (vr * 32 + vc)::INT AS "values", (mr * 32 + mc)::INT AS mask, bit_count((mr * 32 + mc)::INT)::INT AS n_dontcares, count(*) AS n_covered, bool_or(by_how_many = 1) AS is_core_essential FROM covers GROUP BY pos_i, pos_j, vr, vc, mr, mc)"""
_EXPR = "concat_ws(' ', " + ", ".join(f"CASE WHEN (mask >> {9 - k}) & 1 = 0 THEN CASE WHEN (\"values\" >> {9 - k}) & 1 = 1 THEN '{'s' if k < 5 else 't'}{4 - k % 5}' ELSE '~{'s' if k < 5 else 't'}{4 - k % 5}' END END" for k in range(10)) + ")"
_COEV = "SELECT pos_i, pos_j, mi, n_obs, ref_i, ref_j FROM mut WHERE mi > 0.1 AND pos_i IN (SELECT pos FROM h WHERE round(e, 6) > 0.3) AND pos_j IN (SELECT pos FROM h WHERE round(e, 6) > 0.3)"
_STATE = "CASE WHEN code_i = seen.ref_i AND code_j = seen.ref_j THEN -1 ELSE 1 END AS state"
_FOUND = f"""{ORDER_PC}, {ENTROPY}, {MUT}, {_MAP}, best AS ({_COEV} ORDER BY mi DESC, pos_i, pos_j LIMIT 15),
maps AS (SELECT pos_i, pos_j, code_i, code_j, {_STATE} FROM seen JOIN (SELECT pos_i, pos_j FROM best) USING (pos_i, pos_j)), {_PRIMES},
found AS (SELECT imp.*, "values" // 32 AS code_i, "values" % 32 AS code_j, substr('{BASE20}', "values" // 32 + 1, 1) AS aa_i, substr('{BASE20}', "values" % 32 + 1, 1) AS aa_j, best.ref_i, best.ref_j, best.mi, {_EXPR} AS expr
  FROM imp JOIN best USING (pos_i, pos_j) WHERE "values" // 32 < 20 AND "values" % 32 < 20),
rule AS (SELECT pos_i, pos_j, code_i::INT AS code_i, code_j::INT AS code_j, aa_i, aa_j, ref_i, ref_j, mi, bool_or(is_core_essential) AS is_essential, (array_agg(expr ORDER BY n_dontcares, expr))[1] AS expr, max(n_covered)::BIGINT AS n_covered
  FROM found GROUP BY pos_i, pos_j, code_i, code_j, aa_i, aa_j, ref_i, ref_j, mi)"""


def _found(s, d):
    pc, counts = _base(s, d)
    return boolean.found_implicants(pairs.informative_pairs(pc, counts), boolean.mutation_map(pc, counts))


@_query("boolean_rules", f"{_FOUND} SELECT * FROM rule")
def boolean_rules(s, d):
    return boolean.distinct_rules(_found(s, d))


@_query("inference_rules", f"{_FOUND} SELECT pos_i, pos_j, aa_i, aa_j, ref_i, ref_j, mi, expr FROM found WHERE is_core_essential")
def inference_rules(s, d):
    return boolean.inferences(_found(s, d))


@_query("boolean_rules_by_k", f"{_FOUND}, c AS (SELECT pos_i, pos_j, mi, count(*) AS n FROM rule GROUP BY ALL) SELECT row_number() OVER w::INT AS k, (sum(n) OVER w)::BIGINT AS n_rules FROM c WINDOW w AS (ORDER BY mi DESC, pos_i, pos_j)")
def boolean_rules_by_k(s, d):
    return boolean.rules_by_k(boolean.distinct_rules(_found(s, d)))


def _listed(found: DataFrame) -> DataFrame:
    return found.select("pos_i", "pos_j", "values", "mask", "n_dontcares", F.size("coverage").cast("long").alias("n_covered"), "is_core_essential").withColumn("expr", boolean.expression())


@_query("implicants", f"{ORDER_PC}, {_MAP}, maps AS (SELECT pos_i, pos_j, code_i, code_j, {_STATE} FROM seen), {_PRIMES} SELECT *, {_EXPR} AS expr FROM imp")
def implicants(s, d):
    return _listed(boolean.implicants(boolean.mutation_map(*_base(s, d))))


@_query("threshold_implicants", f"{ORDER_PC}, x AS (SELECT pos_i, pos_j, code_i, code_j, round(n::DOUBLE / t, 9) + 0.0 AS value FROM pm), maps AS ({_ON.format(share=0.7)}), {_PRIMES} SELECT *, {_EXPR} AS expr FROM imp")
def threshold_implicants(s, d):
    return _listed(boolean.implicants(pair_on_set(s, d)))


@_query("rule_filter", f"""{_FOUND}, old AS (SELECT code_i, code_j, pos_i, pos_j FROM rule),
train AS (SELECT * FROM p WHERE seq_id % 13 < 8), tc AS (SELECT seq_id, unnest(range(0, len(codes)))::INT AS pos, unnest(codes)::INT AS code FROM train),
met AS (SELECT DISTINCT b.pos_i, b.pos_j, x.code AS code_i, y.code AS code_j FROM best b JOIN tc x ON x.pos = b.pos_i JOIN tc y ON y.pos = b.pos_j AND x.seq_id = y.seq_id),
mine AS (SELECT p.seq_id, best.pos_i, best.pos_j, codes[best.pos_i + 1] AS code_i, codes[best.pos_j + 1] AS code_j, best.ref_i, best.ref_j FROM p, best),
kind AS (SELECT seq_id, max(CASE WHEN code_i < 20 AND code_j < 20 AND NOT (code_i = ref_i AND code_j = ref_j) AND NOT EXISTS (SELECT 1 FROM met WHERE met.pos_i = mine.pos_i AND met.pos_j = mine.pos_j AND met.code_i = mine.code_i AND met.code_j = mine.code_j) THEN 2
  WHEN EXISTS (SELECT 1 FROM old WHERE old.pos_i = mine.pos_i AND old.pos_j = mine.pos_j AND old.code_i = mine.code_i AND old.code_j = mine.code_j) THEN 1 ELSE 0 END) AS kind FROM mine GROUP BY seq_id)
SELECT p.seq_id, CASE kind WHEN 2 THEN 'forbidden' WHEN 1 THEN 'positive' ELSE 'unclassified' END AS verdict FROM p LEFT JOIN kind USING (seq_id)""")
def rule_filter(s, d):
    """All orders against the rule set, and against the pairs of codes that the training orders never show."""
    pc, counts = _base(s, d)
    best = checkpointed(pairs.informative_pairs(pc, counts).limit(15))
    rules = boolean.distinct_rules(boolean.found_implicants(best, boolean.mutation_map(pc, counts)))
    seen = pairs.pair_counts(_orders(s, d).where(_is_train()), GAP_LIMIT).join(F.broadcast(best.select(*pairs.PAIR)), pairs.PAIR, "left_semi")
    return boolean.classify(_orders(s, d), rules, boolean.forbidden_map(seen, counts))


@_query("pair_membership", f"{ORDER_PC} SELECT pos_i, pos_j, code_i, code_j, n FROM pv WHERE EXISTS (SELECT 1 FROM pv x WHERE x.pos_i = 0 AND x.pos_j = 1 AND ((x.code_i = pv.code_i AND x.code_j = pv.code_j) OR (x.code_i = pv.code_j AND x.code_j = pv.code_i)))")
def pair_membership(s, d):
    pc = _pairs(s, d).where(valid(F.col("code_i")) & valid(F.col("code_j")))
    known = boolean.either_way(pc.where("pos_i = 0 and pos_j = 1").select("code_i", "code_j"), "code_i", "code_j")
    return pc.join(F.broadcast(known), ["code_i", "code_j"], "left_semi").select("pos_i", "pos_j", "code_i", "code_j", "n")


# ---- prediction ----
@_query("leave_one_out", f"""{ORDER_PC}, held AS (SELECT pr.pos_i, pr.pos_j, pr.code_i, pr.code_j AS truth, pr.n AS weight FROM ({'SELECT pv.*, a.ref_code AS ref_i, b.ref_code AS ref_j FROM pv JOIN ref a ON a.pos = pos_i JOIN ref b ON b.pos = pos_j WHERE NOT (code_i = a.ref_code AND code_j = b.ref_code)'}) pr),
tried AS (SELECT h.*, m.code_j, m.n - (m.code_j = truth)::INT AS k, m.nj - (m.code_j = truth)::INT AS kj FROM held h JOIN pm m USING (pos_i, pos_j, code_i)),
best AS (SELECT *, row_number() OVER (PARTITION BY pos_i, pos_j, code_i, truth ORDER BY k::DOUBLE / kj DESC, code_j) AS r FROM tried WHERE k > 0 AND kj > 0)
SELECT h.pos_i, h.pos_j, sum(h.weight)::BIGINT AS n_test, sum(CASE WHEN b.code_j = h.truth THEN h.weight ELSE 0 END)::BIGINT AS n_correct FROM held h LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (pos_i, pos_j, code_i, truth) GROUP BY ALL""")
def leave_one_out(s, d):
    return predict.leave_one_out(*_base(s, d))


_TOP10 = f"top10 AS ({_COEV} ORDER BY mi DESC, pos_i, pos_j LIMIT 10)"
_C = "round(ln(({f} + 1e-10) / (({fi} + 1e-10) * ({fj} + 1e-10))), 9)"


@_query("train_test", f"""{ORDER_PC}, {ENTROPY}, {MUT}, {_TOP10}, x AS (SELECT t.pos_i, t.pos_j, t.ref_i, t.ref_j, codes[t.pos_i + 1] AS code_i, codes[t.pos_j + 1] AS code_j, seq_id % 13 < 8 AS train, count(*) AS n FROM p, top10 t GROUP BY ALL),
tr AS (SELECT * FROM x WHERE train AND code_i < 20 AND code_j < 20), g AS (SELECT q.pos_i, q.pos_j, a::INT AS code_i, b::INT AS code_j FROM (SELECT DISTINCT pos_i, pos_j FROM tr) q, range(20) y(a), range(20) z(b)),
full_tr AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN tr USING (pos_i, pos_j, code_i, code_j)), {PM.format(name='tm', of='full_tr')},
best AS (SELECT pos_i, pos_j, code_i, code_j AS guess FROM (SELECT *, row_number() OVER (PARTITION BY pos_i, pos_j, code_i ORDER BY {_C.format(f=_P, fi=_PI, fj=_PJ)} DESC, code_j) AS r FROM tm) WHERE r = 1),
te AS (SELECT * FROM x WHERE NOT train AND code_i < 20 AND code_j < 20 AND NOT (code_i = ref_i AND code_j = ref_j))
SELECT t.pos_i, t.pos_j, coalesce(sum(te.n), 0)::BIGINT AS n_test, coalesce(sum(te.n) FILTER (coalesce(guess, 0) = te.code_j), 0)::BIGINT AS n_correct FROM top10 t LEFT JOIN te USING (pos_i, pos_j) LEFT JOIN best ON best.pos_i = te.pos_i AND best.pos_j = te.pos_j AND best.code_i = te.code_i GROUP BY t.pos_i, t.pos_j""")
def train_test(s, d):
    chosen = checkpointed(pairs.informative_pairs(*_base(s, d)).limit(10))
    return predict.train_test(_orders(s, d), chosen, _is_train(), GAP_LIMIT)


@_query("leave_one_out_all_codes", f"""{ORDER_PC}, {ENTROPY}, {MUT}, {_TOP10}, held AS (SELECT m.pos_i, m.pos_j, m.code_i, m.code_j AS truth, m.n AS weight, m.ni, m.t FROM pm m JOIN top10 USING (pos_i, pos_j) WHERE NOT (m.code_i = top10.ref_i AND m.code_j = top10.ref_j) AND m.t > 1),
tried AS (SELECT h.*, b::INT AS code_j, (coalesce(m.n, 0) - (b = truth)::INT)::DOUBLE / (h.t - 1) AS f, (h.ni - 1)::DOUBLE / (h.t - 1) AS fi, (coalesce(c.nj, 0) - (b = truth)::INT)::DOUBLE / (h.t - 1) AS fj FROM held h CROSS JOIN range(20) r(b)
  LEFT JOIN pm m ON m.pos_i = h.pos_i AND m.pos_j = h.pos_j AND m.code_i = h.code_i AND m.code_j = b LEFT JOIN (SELECT DISTINCT pos_i, pos_j, code_j, nj FROM pm) c ON c.pos_i = h.pos_i AND c.pos_j = h.pos_j AND c.code_j = b),
best AS (SELECT *, row_number() OVER (PARTITION BY pos_i, pos_j, code_i, truth ORDER BY {_C.format(f='f', fi='fi', fj='fj')} DESC, code_j) AS r FROM tried)
SELECT pos_i, pos_j, sum(weight)::BIGINT AS n_test, coalesce(sum(weight) FILTER (code_j = truth), 0)::BIGINT AS n_correct FROM best WHERE r = 1 GROUP BY ALL""")
def leave_one_out_all_codes(s, d):
    pc, counts = _base(s, d)
    return predict.leave_one_out_all_codes(pc, checkpointed(pairs.informative_pairs(pc, counts).limit(10)))


@_query("precision_predictor")
def precision_predictor(s, d):
    return predict.precision_predictor(_orders(s, d), _is_train(), GAP_LIMIT)


@_query("top_associations", f"""{ORDER_PC}, c AS (SELECT pos_i, pos_j, code_i, code_j, ln(({_P} + 1e-10) / ({_PI} * ({_PJ}) + 1e-10)) AS x, {_P} AS q FROM pm WHERE {_P} > 0.001),
d AS (SELECT pos_i, pos_j, code_i, code_j, round(x, 6) + 0.0 AS j, round(1 / (1 + exp(-greatest(-10, least(10, x)))), 6) + 0.0 AS sigma, round(q, 6) + 0.0 AS p FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY pos_i, pos_j ORDER BY j DESC, code_i, code_j)::INT AS rank_up, row_number() OVER (PARTITION BY pos_i, pos_j ORDER BY j, code_i, code_j)::INT AS rank_down FROM d)
SELECT * FROM r WHERE rank_up <= 5 OR rank_down <= 5""")
def top_associations(s, d):
    return predict.top_associations(_pairs(s, d))


# ---- networks, clusters, distances ----
@_query("mi_network", f"""{ORDER_PC}, {ENTROPY}, ends AS (SELECT pos_i AS pos FROM mi WHERE mi > 0.5 UNION ALL SELECT pos_j FROM mi WHERE mi > 0.5),
deg AS (SELECT h.pos, count(ends.pos) AS degree FROM h LEFT JOIN ends ON ends.pos = h.pos WHERE round(e, 6) > 0.3 GROUP BY h.pos) SELECT pos, degree, degree > 0 AND degree = max(degree) OVER () AS is_hub FROM deg""")
def mi_network(s, d):
    return graph.network(columns.variable_positions(_counts(s, d)), pairs.mutual_information(_pairs(s, d)))


@_query("mi_components", f"""WITH RECURSIVE {ORDERS}, {CC}, {PC.format(gap=GAP_LIMIT)}, {PV}, {PM.format(name='pm', of='pv')}, {MI}, e AS (SELECT pos_i AS a, pos_j AS b FROM mi WHERE mi > 0.5 UNION SELECT pos_j, pos_i FROM mi WHERE mi > 0.5),
reach AS (SELECT a AS pos, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.pos) SELECT pos, min(r) AS component FROM reach GROUP BY pos""")
def mi_components(s, d):
    return graph.components(pairs.mutual_information(_pairs(s, d)), 0.5)


@_query("variant_signatures", f"""{ORDER_PC}, b5 AS (SELECT pos_i, pos_j, row_number() OVER (ORDER BY mi DESC, pos_i, pos_j) AS k FROM (SELECT * FROM mi ORDER BY mi DESC, pos_i, pos_j LIMIT 5)),
s AS (SELECT seq_id, string_agg((codes[pos_i + 1] * 21 + codes[pos_j + 1])::VARCHAR, '-' ORDER BY k) AS signature FROM p, b5 GROUP BY seq_id),
g AS (SELECT signature, count(*) AS size, list(seq_id ORDER BY seq_id)[1:10] AS ids FROM s GROUP BY signature ORDER BY size DESC, signature LIMIT 10) SELECT signature, size, array_to_string(ids, ',') AS first_ids FROM g""")
def variant_signatures(s, d):
    return graph.variant_signatures(_orders(s, d), graph.best_pairs(pairs.mutual_information(_pairs(s, d)), 5))


_DIST = f"WITH {SUPPLIER}, {CELLS}, z AS (SELECT a.seq_id AS seq_a, b.seq_id AS seq_b, a.code AS x, b.code AS y FROM cells a JOIN cells b ON a.pos = b.pos AND a.seq_id < b.seq_id)"


@_query("sequence_distances", f"{_DIST} SELECT seq_a, seq_b, round(coalesce(avg((x <> y)::INT::DOUBLE) FILTER (x < 20 AND y < 20), 1.0), 6) + 0.0 AS hamming, round(avg(bit_count(xor({GRAY.format('x')}, {GRAY.format('y')}))::DOUBLE) FILTER (x < 20 AND y < 20), 6) + 0.0 AS gray FROM z GROUP BY ALL")
def sequence_distances(s, d):
    return graph.sequence_distances(readers.supplier_profiles(s, d))


@_query("near_sequences", f"{_DIST}, h AS (SELECT seq_a, seq_b, count(*) AS n_valid, avg((x <> y)::INT::DOUBLE) AS share FROM z WHERE x < 20 AND y < 20 GROUP BY ALL) SELECT seq_a, seq_b, n_valid, round(share, 6) + 0.0 AS hamming FROM h WHERE share <= 0.25")
def near_sequences(s, d):
    return near.near_pairs(readers.supplier_profiles(s, d), 0.25)


_BOTH_VALID = "len(list_filter(range(1, 9), lambda j: w.held[i][j] < 20 AND o.codes[j] < 20))"
_DIFFER = "len(list_filter(range(1, 9), lambda j: w.held[i][j] < 20 AND o.codes[j] < 20 AND w.held[i][j] <> o.codes[j]))"


# One step a sequence, by id, with the leaders so far.
@_query("leader_clusters", f"""WITH RECURSIVE {SUPPLIER}, o AS (SELECT row_number() OVER (ORDER BY seq_id) AS k, seq_id, codes::BIGINT[] AS codes FROM p),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS ids, []::BIGINT[][] AS held, NULL::BIGINT AS seq_id, NULL::BIGINT AS cluster, NULL::BIGINT AS leader
  UNION ALL SELECT k, CASE WHEN hit IS NULL THEN list_append(ids, sid) ELSE ids END, CASE WHEN hit IS NULL THEN list_append(held, codes) ELSE held END, sid, coalesce(hit - 1, len(ids))::BIGINT, CASE WHEN hit IS NULL THEN sid ELSE ids[hit] END
  FROM (SELECT o.k, w.ids, w.held, o.seq_id AS sid, o.codes, list_filter(range(1, len(w.ids) + 1), lambda i: {_BOTH_VALID} > 0 AND {_DIFFER}::DOUBLE / {_BOTH_VALID} < 0.5)[1] AS hit FROM walk w JOIN o ON o.k = w.k + 1))
SELECT seq_id, cluster, leader FROM walk WHERE seq_id IS NOT NULL""")
def leader_clusters(s, d):
    return graph.leader_clusters(readers.supplier_profiles(s, d), radius=0.5)


_MAPS = f"WITH {ORDERS}, {CELLS}, m AS (SELECT pos AS map_id, code AS cell, n::DOUBLE / sum(n) OVER (PARTITION BY pos) AS v FROM (SELECT pos, code, count(*) AS n FROM cells GROUP BY ALL)), dd AS (SELECT a.map_id AS map_a, b.map_id AS map_b, round(sqrt(sum((coalesce(x.v, 0) - coalesce(y.v, 0)) ** 2)), 6) + 0.0 AS distance FROM (SELECT DISTINCT map_id FROM m) a JOIN (SELECT DISTINCT map_id FROM m) b ON a.map_id < b.map_id CROSS JOIN range(21) r(c) LEFT JOIN m x ON x.map_id = a.map_id AND x.cell = c LEFT JOIN m y ON y.map_id = b.map_id AND y.cell = c GROUP BY ALL)"


def _column_maps(s, d):
    c = _counts(s, d)
    total = c.groupBy("pos").agg(F.sum("n").alias("t"))
    return c.join(total, "pos").select(F.col("pos").alias("map_id"), F.col("code").alias("cell"), (F.col("n").cast("double") / F.col("t")).alias("value"))


@_query("map_distances", f"{_MAPS} SELECT * FROM dd")
def map_distances(s, d):
    return graph.map_distances(_column_maps(s, d))


@_query("map_differences", f"WITH {ORDERS}, {CELLS}, m AS (SELECT pos AS map_id, code AS cell, CASE WHEN code = 20 THEN -1 WHEN n::DOUBLE / sum(n) OVER (PARTITION BY pos) >= 0.1 THEN 1 ELSE 0 END AS state FROM (SELECT pos, code, count(*) AS n FROM cells GROUP BY ALL)) SELECT a.map_id AS map_a, b.map_id AS map_b, count(*) FILTER (a.state <> b.state) AS n FROM m a JOIN m b ON a.cell = b.cell AND a.map_id < b.map_id WHERE a.state <> -1 AND b.state <> -1 GROUP BY ALL")
def map_differences(s, d):
    state = F.when(F.col("cell") == 20, -1).when(F.col("value") >= 0.1, 1).otherwise(0)
    return boolean.map_differences(_column_maps(s, d).select("map_id", "cell", state.alias("state")))


@_query("map_distance_summary", f"{_MAPS}, e AS (SELECT min(distance) AS least, max(distance) AS most, round(avg(distance), 6) + 0.0 AS mean, round(stddev_pop(distance), 6) + 0.0 AS deviation FROM dd), a AS (SELECT map_a AS close_a, map_b AS close_b FROM dd ORDER BY distance, map_a, map_b LIMIT 1), b AS (SELECT map_a AS far_a, map_b AS far_b FROM dd ORDER BY distance DESC, map_a, map_b LIMIT 1) SELECT * FROM e, a, b")
def map_distance_summary(s, d):
    return graph.distance_summary(graph.map_distances(_column_maps(s, d)))


# ---- direct couplings ----
@_query("sequence_weights", f"{_DIST}, near AS (SELECT seq_a, seq_b FROM z GROUP BY ALL HAVING sum((x <> y)::INT) <= floor(8 * 0.2)), n AS (SELECT s, count(*) AS k FROM (SELECT seq_a AS s FROM near UNION ALL SELECT seq_b FROM near) GROUP BY s) SELECT p.seq_id, round(1.0::DOUBLE / (1 + coalesce(k, 0)), 6) + 0.0 AS weight FROM p LEFT JOIN n ON n.s = p.seq_id")
def sequence_weights(s, d):
    return dca.weights(readers.supplier_profiles(s, d)).select("seq_id", (F.round("weight", 6) + F.lit(0.0)).alias("weight"))


@_query("direct_couplings")
def direct_couplings(s, d):
    return dca.scores(readers.supplier_profiles(s, d), 8)


@_query("top_direct_couplings")
def top_direct_couplings(s, d):
    return dca.top_scores(direct_couplings(s, d), "apc", 20)


@_query("effective_sequences", f"{_DIST}, near AS (SELECT seq_a, seq_b FROM z GROUP BY ALL HAVING sum((x <> y)::INT) <= floor(8 * 0.2)), n AS (SELECT s, count(*) AS k FROM (SELECT seq_a AS s FROM near UNION ALL SELECT seq_b FROM near) GROUP BY s) SELECT round(sum(1.0::DOUBLE / (1 + coalesce(k, 0))), 6) + 0.0 AS meff FROM p LEFT JOIN n ON n.s = p.seq_id")
def effective_sequences(s, d):
    return dca.effective_number(dca.weighted_kinds(readers.supplier_profiles(s, d)))
