"""Column-pair statistics: mutual information, couplings, perplexity ratios.

``pair_counts`` makes the pairs of each sequence inside its own row (two nested
generators, no join and no shuffle by sequence) and counts them map-side, so
what is shuffled is bounded by columns * gap * 441 rows, not by the number of
sequences. Every other operator works on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import perplexity, rounded, valid
from ..shared import checkpointed
from .columns import column_counts, majority, variable_positions

PAIR = ["pos_i", "pos_j"]
EPS = 1e-10


def pair_counts(p: DataFrame, max_gap: int = 30, min_gap: int = 1, positions: DataFrame | None = None) -> DataFrame:
    """``(pos_i, pos_j, code_i, code_j, n)`` for ``min_gap <= pos_j - pos_i <= max_gap``.

    ``positions`` (a small frame with ``pos``) keeps only pairs of those columns.
    """
    left = p.select(F.posexplode_outer("codes").alias("pos_i", "code_i"), "codes").where("pos_i is not null")
    if positions is not None:
        left = left.join(F.broadcast(positions.select(F.col("pos").alias("pos_i"))), "pos_i", "left_semi")
    far = F.slice("codes", F.col("pos_i") + 1 + min_gap, F.lit(max_gap - min_gap + 1))
    right = left.select("pos_i", "code_i", F.posexplode_outer(far).alias("k", "code_j")).where("k is not null").withColumn("pos_j", F.col("pos_i") + min_gap + F.col("k"))
    if positions is not None:
        right = right.join(F.broadcast(positions.select(F.col("pos").alias("pos_j"))), "pos_j", "left_semi")
    return right.groupBy("pos_i", "pos_j", "code_i", "code_j").agg(F.count("*").alias("n"))


def base_counts(p: DataFrame, max_gap: int = 30) -> tuple[DataFrame, DataFrame]:
    """``pair_counts`` and ``column_counts`` from one scan, written once.

    A column paired with itself has its own counts on the diagonal.
    """
    both = checkpointed(pair_counts(p, max_gap, 0))
    own = both.where("pos_i = pos_j").select(F.col("pos_i").alias("pos"), F.col("code_i").alias("code"), "n")
    return both.where("pos_i < pos_j"), own


def _both_valid(pc: DataFrame) -> DataFrame:
    return pc.where(valid(F.col("code_i")) & valid(F.col("code_j")))


def with_refs(pc: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``ref_i`` and ``ref_j``."""
    ref = majority(counts)
    out = pc.join(F.broadcast(ref.select(F.col("pos").alias("pos_i"), F.col("ref_code").alias("ref_i"))), "pos_i")
    return out.join(F.broadcast(ref.select(F.col("pos").alias("pos_j"), F.col("ref_code").alias("ref_j"))), "pos_j")


def without_reference(pc: DataFrame) -> DataFrame:
    """Drops the one cell where both columns hold their reference."""
    return pc.where((F.col("code_i") != F.col("ref_i")) | (F.col("code_j") != F.col("ref_j")))


def _marginals(pc: DataFrame) -> DataFrame:
    """Adds ``t``, ``ni``, ``nj``: the pair's total and both marginal counts."""
    return pc.withColumns({
        "t": F.sum("n").over(Window.partitionBy(*PAIR)),
        "ni": F.sum("n").over(Window.partitionBy(*PAIR, "code_i")),
        "nj": F.sum("n").over(Window.partitionBy(*PAIR, "code_j")),
    })


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def mutual_information(pc: DataFrame, min_total: int = 10, keep: list[str] | None = None) -> DataFrame:
    """``(pos_i, pos_j, mi, n_obs)`` in bits over valid cells; 0 below ``min_total`` observations."""
    m = _marginals(_both_valid(pc))
    term = _d("n") / _d("t") * F.log2(_d("n") * _d("t") / (_d("ni") * _d("nj")))
    out = m.groupBy(*PAIR, *(keep or [])).agg(F.sum(term).alias("mi"), F.sum("n").alias("n_obs"))
    return out.withColumn("mi", rounded(F.when(F.col("n_obs") >= min_total, F.col("mi")).otherwise(0.0)))


def mutation_information(pc: DataFrame, counts: DataFrame, min_total: int = 5) -> DataFrame:
    """Mutual information over the cells that are not the reference pair."""
    return mutual_information(without_reference(_both_valid(with_refs(pc, counts))), min_total, ["ref_i", "ref_j"])


def informative_pairs(pc: DataFrame, counts: DataFrame, min_mi: float = 0.1, min_muts: int = 5, mutation_only: bool = True, min_entropy: float = 0.3) -> DataFrame:
    """Variable columns' pairs with more than ``min_mi``, most informative first, from counts."""
    variable = F.broadcast(checkpointed(variable_positions(counts, min_entropy).select("pos")))
    for c in PAIR:
        pc = pc.join(variable.withColumnRenamed("pos", c), c, "left_semi")
    mi = mutation_information(pc, counts, min_muts) if mutation_only else mutual_information(with_refs(pc, counts), min_muts, ["ref_i", "ref_j"])
    return mi.where(F.col("mi") > min_mi).select("pos_i", "pos_j", "mi", "n_obs", "ref_i", "ref_j").orderBy(F.desc("mi"), "pos_i", "pos_j")


def coevolving_pairs(p: DataFrame, max_gap: int = 30, min_mi: float = 0.1, min_muts: int = 5, mutation_only: bool = True, min_entropy: float = 0.3) -> DataFrame:
    """Variable columns' pairs with more than ``min_mi``, most informative first."""
    return informative_pairs(*base_counts(p, max_gap), min_mi, min_muts, mutation_only, min_entropy)


def pair_maps(pc: DataFrame) -> DataFrame:
    """Joint frequencies ``(pos_i, pos_j, code_i, code_j, n, p)`` of valid cells."""
    v = _both_valid(pc)
    return v.withColumn("p", rounded(_d("n") / F.sum("n").over(Window.partitionBy(*PAIR)), 9))


def couplings(pc: DataFrame, eps_mode: str = "outside", observed_only: bool = True, digits: int = 6, min_total: int = 0) -> DataFrame:
    """Log-odds ``J = ln(p / (pi pj))`` of cells.

    ``eps_mode`` ``"inside"`` puts the small constant into each factor,
    ``"outside"`` once below the line, so cells that neither column has are 0.
    Without ``observed_only`` all 400 cells of a pair are given. Pairs of fewer
    than ``min_total`` observations have zeros.
    """
    v = _both_valid(pc)
    if not observed_only:
        grid = v.select(*PAIR).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("code_i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("code_j"))
        v = grid.join(v, [*PAIR, "code_i", "code_j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    m = _marginals(v)
    p, pi, pj = _d("n") / _d("t"), _d("ni") / _d("t"), _d("nj") / _d("t")
    below = (pi + EPS) * (pj + EPS) if eps_mode == "inside" else pi * pj + EPS
    j = F.when(F.col("t") >= min_total, F.ln((p + EPS) / below)).otherwise(0.0)
    return m.select(*PAIR, "code_i", "code_j", "n", rounded(j, digits).alias("j"))


def mean_coupling(j: DataFrame) -> DataFrame:
    """Mean |J| over the 400 cells of each pair."""
    return j.groupBy(*PAIR).agg(rounded(F.sum(F.abs("j")) / 400).alias("mean_abs_j"))


def strongest_couplings(j: DataFrame) -> DataFrame:
    """The largest and the smallest J of each pair, ties to the lowest codes."""
    up = F.max(F.struct("j", (-F.col("code_i")).alias("a"), (-F.col("code_j")).alias("b"))).alias("u")
    down = F.min(F.struct("j", F.col("code_i").alias("a"), F.col("code_j").alias("b"))).alias("d")
    g = j.groupBy(*PAIR).agg(up, down)
    return g.select(*PAIR, F.col("u.j").alias("max_j"), (-F.col("u.a")).cast("int").alias("max_i"), (-F.col("u.b")).cast("int").alias("max_k"), F.col("d.j").alias("min_j"), F.col("d.a").cast("int").alias("min_i"), F.col("d.b").cast("int").alias("min_k"))


def covariances(pc: DataFrame) -> DataFrame:
    """``P(a,b) - P(a) P(b)`` of observed cells."""
    m = _marginals(_both_valid(pc))
    return m.select(*PAIR, "code_i", "code_j", rounded(_d("n") / _d("t") - _d("ni") / _d("t") * _d("nj") / _d("t"), 9).alias("cov"))


def conditional_perplexity(pc: DataFrame, include_gap: bool = False, min_n: int = 1) -> DataFrame:
    """``(pos_i, pos_j, code_i, n, pp)``: perplexity of column j where column i holds a code."""
    v = pc if include_gap else _both_valid(pc)
    given = F.sum("n").over(Window.partitionBy(*PAIR, "code_i"))
    h = v.withColumn("p", _d("n") / given).groupBy(*PAIR, "code_i").agg(F.sum("n").alias("n"), F.sum(-F.col("p") * F.log2("p")).alias("h"))
    return h.where(F.col("n") >= min_n).select(*PAIR, "code_i", "n", rounded(perplexity(F.col("h"))).alias("pp"))


def perplexity_ratio(pc: DataFrame, min_n: int = 5, entropy: DataFrame | None = None) -> DataFrame:
    """Perplexity of column j over its mean perplexity given column i; pairs without a usable code are absent.

    ``entropy`` (``pos``, ``entropy``) gives column j's entropy from elsewhere
    instead of from the pair's own observations.
    """
    v = _both_valid(pc)
    t = F.sum("n").over(Window.partitionBy(*PAIR))
    marginal = v.groupBy(*PAIR, "code_j").agg(F.sum("n").alias("n")).withColumn("p", _d("n") / t).groupBy(*PAIR).agg(perplexity(F.sum(-F.col("p") * F.log2("p"))).alias("pp_j"))
    if entropy is not None:
        marginal = v.select(*PAIR).distinct().join(F.broadcast(entropy.select(F.col("pos").alias("pos_j"), perplexity(F.col("entropy")).alias("pp_j"))), "pos_j")
    given = F.sum("n").over(Window.partitionBy(*PAIR, "code_i"))
    cond = v.withColumn("p", _d("n") / given).groupBy(*PAIR, "code_i").agg(F.sum("n").alias("m"), perplexity(F.sum(-F.col("p") * F.log2("p"))).alias("pp")).where(F.col("m") >= min_n)
    mean = cond.groupBy(*PAIR).agg(F.avg("pp").alias("mean_pp"), F.count("*").alias("n_codes"))
    return marginal.join(mean, PAIR).select(*PAIR, rounded(F.col("pp_j") / F.col("mean_pp")).alias("ratio"), "n_codes")


EXACT = 50  # counts up to which Poisson draws are exact; beyond, rounded normal ones


def _poisson_table(n: Column) -> Column:
    """The distribution function of mean ``n`` at 0, 1, ..., as far as it matters; null beyond ``EXACT``."""
    begin = F.struct(F.exp(-n).alias("p"), F.array(F.exp(-n)).alias("c"))
    step = lambda a, k: F.struct((a["p"] * n / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * n / k)).alias("c"))
    return F.aggregate(F.when(n <= EXACT, F.sequence(F.lit(1), (n + 10 * F.sqrt(n) + 10).cast("int"))), begin, step, lambda a: a["c"])


def poisson(df: DataFrame, n: str, table: str, key: Column, name: str) -> DataFrame:
    """``df`` with ``name``, a Poisson draw of mean ``n`` that depends on nothing but ``key``, so that it can be made anywhere and again.

    The key's MD5 gives two uniform numbers of 52 bits: one is looked up in the
    distribution function, both give a normal number where the mean is large.
    """
    bits = lambda at: F.conv(F.substring("_h", at, 13), 16, 10).cast("double")
    n, u, v = F.col(n), F.col("_u"), F.col("_v")
    normal = F.greatest(F.lit(0.0), F.round(n + F.sqrt(n) * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)))
    hashed = df.withColumn("_h", F.md5(key)).withColumns({"_u": (bits(1) + 1) / 2**52, "_v": bits(14) / 2**52})
    drawn = F.when(n <= EXACT, F.least(F.size(F.filter(table, lambda c: c < u)), F.size(table) - 1)).otherwise(normal)
    return hashed.withColumn(name, drawn.cast("long")).drop("_h", "_u", "_v")


def bootstrap_ratio(pc: DataFrame, chosen: DataFrame, resamples: int = 200, seed: int = 42, min_n: int = 5) -> DataFrame:
    """Mean, deviation and 95 % interval of each chosen pair's perplexity ratio, its numerator fixed.

    Resampling sequences gives each of them a Poisson weight of mean one, so a cell
    of n sequences has one of mean n; a draw costs the same for any number of them.
    Draws come from hashes of seed, resample and cell: any engine can make the same.
    """
    v = _both_valid(pc).join(F.broadcast(chosen.select(*PAIR)), PAIR, "left_semi")
    top = v.groupBy(*PAIR, "code_j").agg(F.sum("n").alias("n")).withColumn("p", _d("n") / F.sum("n").over(Window.partitionBy(*PAIR)))
    top = top.groupBy(*PAIR).agg(perplexity(F.sum(-F.col("p") * F.log2("p"))).alias("top"))
    # the distribution of a cell's weight is the same in each resample
    cells = v.select(*PAIR, "code_i", "code_j", _d("n").alias("n")).withColumn("table", _poisson_table(F.col("n")))
    draws = checkpointed(cells).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    # few bytes, much work: a number of tasks that is not merged by size; all that follows is by pair and resample
    draws = draws.repartition(int(pc.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PAIR, "b")
    drawn = poisson(draws, "n", "table", F.concat_ws(":", F.lit(seed), "b", *PAIR, "code_i", "code_j"), "w")
    # written, for the planner takes long over a filter on these expressions
    drawn = checkpointed(drawn.select(*PAIR, "b", "code_i", "w")).where("w > 0")
    given = F.sum("w").over(Window.partitionBy(*PAIR, "b", "code_i"))
    rows = drawn.withColumn("q", _d("w") / given).groupBy(*PAIR, "b", "code_i").agg(F.sum("w").alias("m"), perplexity(F.sum(-F.col("q") * F.log2("q"))).alias("pp")).where(F.col("m") >= min_n)
    ratios = rows.groupBy(*PAIR, "b").agg(F.avg("pp").alias("mean_pp")).join(F.broadcast(top), PAIR).withColumn("r", F.col("top") / F.col("mean_pp"))
    # a pair's ratios are as many as its resamples
    return ratios.groupBy(*PAIR).agg(
        rounded(F.avg("r")).alias("mean"), rounded(F.stddev_pop("r")).alias("deviation"), rounded(F.percentile("r", F.lit(0.025))).alias("low"), rounded(F.percentile("r", F.lit(0.975))).alias("high")
    )
