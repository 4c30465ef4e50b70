"""Query blocks, repeated for every shard, never pass through the driver."""

from __future__ import annotations

import numpy as np

from wardlight.llm import neighbours


def test_blocks_for_all_shards_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 100)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 4)
    x = np.random.default_rng(3).standard_normal((600, 8))
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    found = neighbours.fifth_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()}
    assert len(got) == 12 * 5
    for q in range(0, 600, 50):  # shards of 100 rows are read in full
        score = unit @ unit[q]
        score[q] = -2
        assert [got[q, k] for k in range(1, 6)] == np.argsort(-score)[:5].tolist()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_ruled_out_by_their_products_are_none_of_the_best():
    rng = np.random.default_rng(4)
    for scale in (1.0, 1e-140, 1e160, 1e-100):  # the squares of two of them leave the range of doubles
        x = rng.standard_normal((500, 16)) * scale
        x[100:160] = x[3] * (1 + rng.integers(0, 3, (60, 1)) * 1e-15)
        ids, norms = rng.permutation(500), np.sqrt((x * x).sum(axis=1))
        for q in (x[3], x[120], x[200]):
            with np.errstate(all="ignore"):
                near = neighbours.hopeful(np.arange(500), x @ q, norms * np.sqrt((q * q).sum()), 16, 5)
                want = neighbours.nearest(x, ids, q, 5)
                got = neighbours.nearest(x[near], ids[near], q, 5)
            assert near[got[0]].tolist() == want[0].tolist() and np.array_equal(got[1], want[1], equal_nan=True)
            assert scale != 1.0 or len(near) < 100
