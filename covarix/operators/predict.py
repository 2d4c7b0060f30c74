"""Prediction tests of column pairs: leave-one-out, train and test, top cells.

All are computed from joint counts: leaving one sequence out lowers its own cell
by one, so each distinct cell is evaluated once and weighted by its count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import rounded, sigmoid, valid
from .pairs import EPS, PAIR, _marginals, couplings, pair_counts, with_refs, without_reference


def _valid(pc: DataFrame) -> DataFrame:
    return pc.where(valid(F.col("code_i")) & valid(F.col("code_j")))


def leave_one_out(pc: DataFrame, counts: DataFrame) -> DataFrame:
    """``(pos_i, pos_j, n_test, n_correct)``: each mutated sequence predicted from the others.

    The prediction for code a is the observed code b with the largest
    association p(a,b) / p(b) in the remaining sequences; ties go to the lowest b.
    """
    m = _marginals(_valid(pc))
    held = without_reference(with_refs(m, counts)).select(*PAIR, "code_i", F.col("code_j").alias("truth"), F.col("n").alias("weight"))
    rival = m.select(*PAIR, "code_i", "code_j", "n", "nj")
    less = F.when(F.col("code_j") == F.col("truth"), 1).otherwise(0)
    tried = held.join(rival, [*PAIR, "code_i"]).withColumns({"n": F.col("n") - less, "nj": F.col("nj") - less}).where("n > 0 and nj > 0")
    best = tried.withColumn("s", F.col("n").cast("double") / F.col("nj")).groupBy(*PAIR, "code_i", "truth", "weight").agg(F.max(F.struct("s", (-F.col("code_j")).alias("b"))).alias("x"))
    got = held.join(best, [*PAIR, "code_i", "truth", "weight"], "left")
    right = F.when(-F.col("x.b") == F.col("truth"), F.col("weight")).otherwise(0)
    return got.groupBy(*PAIR).agg(F.sum("weight").alias("n_test"), F.sum(right).cast("long").alias("n_correct"))


def _joint(p: DataFrame, chosen: DataFrame, max_gap: int) -> DataFrame:
    """Valid joint counts of the chosen pairs only, few rows a pair."""
    return _valid(pair_counts(p, max_gap)).join(F.broadcast(chosen.select(*PAIR)), PAIR, "left_semi")


def constraint_guesses(train: DataFrame) -> DataFrame:
    """``(pos_i, pos_j, code_i, guess)``: for every code of column i, observed or not, the code of j with the largest log-odds over all 20, ties to the lowest."""
    c = couplings(train, "inside", observed_only=False, digits=9)
    return c.groupBy(*PAIR, "code_i").agg((-F.max(F.struct("j", (-F.col("code_j")).alias("b")))["b"]).alias("guess"))


def train_test(p: DataFrame, chosen: DataFrame, is_train: Column, max_gap: int) -> DataFrame:
    """``(pos_i, pos_j, n_test, n_correct)`` of the chosen pairs ``(pos_i, pos_j, ref_i, ref_j)``.

    The constraint function is built from the sequences with ``is_train``, a
    condition on ``seq_id``; mutated pairs of the others are predicted from their
    first code. Without training rows the guess is code 0.
    """
    best = constraint_guesses(_joint(p.where(is_train), chosen, max_gap))
    test = without_reference(_joint(p.where(~is_train), chosen, max_gap).join(F.broadcast(chosen.select(*PAIR, "ref_i", "ref_j")), PAIR))
    got = test.join(best, [*PAIR, "code_i"], "left").withColumn("right", F.coalesce("guess", F.lit(0)) == F.col("code_j"))
    done = got.groupBy(*PAIR).agg(F.sum("n").alias("n_test"), F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("n_correct"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return chosen.select(*PAIR).join(done, PAIR, "left").select(*PAIR, zero("n_test"), zero("n_correct"))


def leave_one_out_all_codes(pc: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(pos_i, pos_j, n_test, n_correct)``: like ``leave_one_out``, predicting by the constraint function among all 20 codes, observed or not."""
    m = _marginals(_valid(pc).join(F.broadcast(chosen.select(*PAIR)), PAIR, "left_semi"))
    held = without_reference(m.join(F.broadcast(chosen.select(*PAIR, "ref_i", "ref_j")), PAIR)).where("t > 1")
    held = held.select(*PAIR, "code_i", F.col("code_j").alias("truth"), F.col("n").alias("weight"), "ni", "t")
    tried = held.withColumn("code_j", F.explode(F.sequence(F.lit(0), F.lit(19))))
    cell = m.select(*PAIR, "code_i", "code_j", "n")
    col = m.select(*PAIR, "code_j", "nj").distinct()
    tried = tried.join(cell, [*PAIR, "code_i", "code_j"], "left").join(col, [*PAIR, "code_j"], "left")
    less, d = F.when(F.col("code_j") == F.col("truth"), 1).otherwise(0), lambda c: c.cast("double")
    t = d(F.col("t") - 1)
    n, ni, nj = d(F.coalesce("n", F.lit(0)) - less) / t, d(F.col("ni") - 1) / t, d(F.coalesce("nj", F.lit(0)) - less) / t
    tried = tried.withColumn("c", rounded(F.ln((n + EPS) / ((ni + EPS) * (nj + EPS))), 9))
    best = tried.groupBy(*PAIR, "code_i", "truth", "weight").agg((-F.max(F.struct("c", (-F.col("code_j")).alias("b")))["b"]).alias("guess"))
    return best.groupBy(*PAIR).agg(F.sum("weight").alias("n_test"), F.sum(F.when(F.col("guess") == F.col("truth"), F.col("weight")).otherwise(0)).cast("long").alias("n_correct"))


def precision_predictor(p: DataFrame, is_train: Column, max_gap: int, min_gap: int = 1, ridge: float = 0.01) -> DataFrame:
    """Like ``train_test``, predicting by the largest entry of a row of pinv(C + ridge I).

    One 20 x 20 matrix per pair: a small kernel, from at most 800 rows each.
    """
    train = _valid(pair_counts(p.where(is_train), max_gap, min_gap)).withColumn("test", F.lit(False))
    test = _valid(pair_counts(p.where(~is_train), max_gap, min_gap)).withColumn("test", F.lit(True))

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        def joint(part: pd.DataFrame) -> np.ndarray:
            m = np.zeros((20, 20))
            m[part["code_i"], part["code_j"]] = part["n"]
            return m

        tr, te = joint(g[~g["test"]]), joint(g[g["test"]])
        t = tr.sum()
        f = tr / t if t else tr
        cov = f - f.sum(1)[:, None] * f.sum(0)[None, :]
        guess = np.linalg.pinv(cov + ridge * np.eye(20)).round(9).argmax(1)
        return pd.DataFrame({"pos_i": [g["pos_i"].iloc[0]], "pos_j": [g["pos_j"].iloc[0]], "n_test": [int(te.sum())], "n_correct": [int(te[np.arange(20), guess].sum())]})

    return train.unionByName(test).groupBy(*PAIR).applyInPandas(kernel, "pos_i int, pos_j int, n_test long, n_correct long")


def top_associations(pc: DataFrame, k: int = 5, min_p: float = 0.001, min_abs_j: float = 0.0, off_diagonal: bool = False) -> DataFrame:
    """Each pair's k most co- and anti-correlated observed cells with J and its logistic value.

    Cells count from a share above ``min_p`` and a coupling beyond ``min_abs_j`` in
    size, and with ``off_diagonal`` only where the two codes differ.
    """
    m = _marginals(_valid(pc))
    p = F.col("n").cast("double") / F.col("t")
    j = F.ln((p + EPS) / (F.col("ni").cast("double") / F.col("t") * F.col("nj") / F.col("t") + EPS))
    c = m.where(p > min_p).select(*PAIR, "code_i", "code_j", rounded(j).alias("j"), rounded(sigmoid(j)).alias("sigma"), rounded(p).alias("p"))
    c = c.where((F.abs("j") > min_abs_j) | F.lit(min_abs_j <= 0))
    if off_diagonal:
        c = c.where("code_i <> code_j")
    up = Window.partitionBy(*PAIR).orderBy(F.desc("j"), "code_i", "code_j")
    down = Window.partitionBy(*PAIR).orderBy("j", "code_i", "code_j")
    return c.withColumns({"rank_up": F.row_number().over(up), "rank_down": F.row_number().over(down)}).where((F.col("rank_up") <= k) | (F.col("rank_down") <= k))
