"""Mutual information of column pairs, kept up to date over a stream of profiles.

Each micro-batch is counted where it lies, a row of joint counts a column pair and
Arrow batch; these meet the pair's state, the joint counts of all data so far, and
only pairs that the batch changed give a new value. A pair's state is 21 x 21
counts, however long the stream; it is in the query's checkpoint, so a restarted
query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.encoding import rounded
from ..operators.tiles import ABSENT, STATES, information, joint_counts


def batch_counts(profiles: DataFrame, max_gap: int = 30) -> DataFrame:
    """``(pos_i, pos_j, counts)``: 441 joint counts of a pair's codes in one Arrow batch; pairs that no sequence has are left out."""

    def count(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            codes = [c.values.to_numpy(zero_copy_only=False) for c in b.column(0)]
            x = np.full((len(codes), max(map(len, codes), default=0)), ABSENT, np.uint8)
            for k, c in enumerate(codes):
                x[k, : len(c)] = np.where((c >= 0) & (c < STATES), c, STATES - 1)
            for i in range(x.shape[1] - 1):
                c = joint_counts(x[:, i : i + 1], x[:, i + 1 : i + 1 + max_gap])[0]
                j = np.flatnonzero(c.any((1, 2)))
                if len(j):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i, np.int32)), pa.array((i + 1 + j).astype(np.int32)), pa.array([c[k].tobytes() for k in j], pa.binary())], names=["pos_i", "pos_j", "counts"])

    return profiles.where("codes is not null").select("codes").mapInArrow(count, "pos_i int, pos_j int, counts binary")


def running_information(profiles: DataFrame, max_gap: int = 30, min_total: int = 10) -> DataFrame:
    """``(pos_i, pos_j, mi, n_obs)`` of the pairs that a micro-batch changed, for update output; values as of all data so far."""

    def update(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = np.frombuffer(state.get[0], np.int64).copy() if state.exists else np.zeros(STATES * STATES, np.int64)
        for part in parts:
            for counts in part["counts"]:
                total += np.frombuffer(counts, np.int64)
        state.update((total.tobytes(),))
        mi, t = information(total.reshape(STATES, STATES)[: STATES - 1, : STATES - 1])
        if t:
            yield pd.DataFrame({"pos_i": [key[0]], "pos_j": [key[1]], "mi": [mi if t >= min_total else 0.0], "n_obs": [t]})

    grouped = batch_counts(profiles, max_gap).groupBy("pos_i", "pos_j")
    out = grouped.applyInPandasWithState(update, "pos_i int, pos_j int, mi double, n_obs long", "counts binary", "update", GroupStateTimeout.NoTimeout)
    return out.withColumn("mi", rounded(F.col("mi")))
