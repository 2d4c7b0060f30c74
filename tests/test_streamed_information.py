"""Streamed mutual information after each micro-batch, and over a restart, against the batch operators."""

import numpy as np
import pytest

from covarix.operators import pairs
from covarix.streaming.information import running_information


def test_every_batch_and_a_restart_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 4, 7 - k % 2).tolist() for k in range(60)]
    rows = [[20 if rng.random() < 0.1 else c for c in r] for r in rows]
    # the last part changes no pair of the columns beyond the second
    parts = [rows[:20], rows[20:40], rows[40:], [[0, 1]] * 12]
    schema = "seq_id long, codes array<int>"
    folder, ckpt, now, seen = tmp_path / "in", str(tmp_path / "ckpt"), {}, []

    def add(k):
        spark.createDataFrame([(i, r) for i, r in enumerate(parts[k])], schema).coalesce(1).write.mode("append").parquet(str(folder))

    def keep(df, _):
        new = {(r.pos_i, r.pos_j): (r.mi, r.n_obs) for r in df.collect()}
        now.update(new)
        seen.append(len(new))

    def run():
        live = running_information(spark.readStream.schema(schema).parquet(str(folder)), 4)
        q = live.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for k in range(len(parts)):
        add(k)
        run()  # a new query each time, from the checkpoint of the last one
        so_far = spark.createDataFrame([(i, r) for i, r in enumerate(sum(parts[: k + 1], []))], schema)
        want = {(r.pos_i, r.pos_j): (r.mi, r.n_obs) for r in pairs.mutual_information(pairs.pair_counts(so_far, 4)).collect()}
        assert now.keys() == want.keys() and all(now[p][1] == want[p][1] and now[p][0] == pytest.approx(want[p][0], abs=2e-6) for p in want)
    assert seen == [18, 18, 18, 1]
