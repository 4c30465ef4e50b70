"""Saved models and backtests, ranks of hot parts, keyword tables, map levels, early sessions."""

import datetime as dt
import random
import time

import pytest

from wardlight.operators import geo as G
from wardlight.operators import predict as M
from wardlight.operators import text as T
from wardlight.operators import windows as W
from wardlight.session import scratch_dir
from wardlight.streaming import jobs as X

REQUEST = (
    "request_id long, cat_id int, location_id int, priority_id int, dept_id int, status string, "
    "submitted_at timestamp_ntz, resolved_at timestamp_ntz"
)


@pytest.fixture(scope="module")
def requests(spark):
    """Hours follow category and month of the year, with some noise; a few ids are missing."""
    rng = random.Random(3)
    rows = []
    for k in range(1_600):
        cat, asked = rng.randrange(1, 5), dt.datetime(2023, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 420))
        hours = 10 + 30 * cat + 3 * asked.month + rng.randrange(4)
        gone = rng.random()
        rows.append((k, None if gone < 0.02 else cat, None if gone > 0.98 else cat % 3, 1 + k % 4, cat, "resolved", asked, asked + dt.timedelta(hours=hours)))
    return spark.createDataFrame(rows, REQUEST).repartition(4).cache()


def test_model_is_saved_and_beats_a_constant(spark, requests):
    features = M.resolution_features(requests)
    model, path = M.EtaModel.train(features, 30, 8), scratch_dir(spark, "model")
    model.save(path)
    loaded = M.EtaModel.load(spark, path)
    assert loaded.metadata == model.metadata and loaded.metadata["trained_rows"] == 1_600
    both = loaded.predict(model.predict(features, "fitted"), "loaded").collect()
    assert len(both) == 1_600
    assert all(abs(r.fitted - r.loaded) < 1e-9 for r in both)
    mean = sum(r.resolution_hours for r in both) / len(both)
    constant = sum(abs(r.resolution_hours - mean) for r in both) / len(both)
    assert loaded.metadata["mae_hours"] < 0.4 * constant and loaded.metadata["r2_score"] > 0.7
    with pytest.raises(ValueError, match="dept_id, hour_of_day"):
        loaded.predict(features.drop("hour_of_day").withColumn("dept_id", features.dept_id.cast("string")))


def test_backtest_by_month(spark, requests):
    folds = {r.month: r for r in M.backtest_eta(requests, "2023-12-01", 3, 30, 8).collect()}
    assert sorted(folds) == [dt.date(2023, 12, 1), dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    rows = requests.collect()
    for month, fold in folds.items():
        begin = dt.datetime(month.year, month.month, 1)
        assert fold.trained == sum(r.resolved_at < begin for r in rows)
        assert fold.tested == sum((r.submitted_at.year, r.submitted_at.month) == (month.year, month.month) for r in rows)
    # a month the forest has seen before is told apart from the mean of its category
    assert folds[dt.date(2024, 1, 1)].mae < 0.9 * folds[dt.date(2024, 1, 1)].category_mean_mae
    with pytest.raises(ValueError, match="not enough"):
        M.backtest_eta(requests, "2020-01-01", 2, 5, 3)


def test_both_learners_are_compared(spark, requests):
    features = M.history_features(requests)
    assert features.count() == 1_600  # rows without category or location stay
    report, models = M.compare_eta(features, 20)
    rows = {r.model: r for r in report.collect()}
    assert set(rows) == set(models) == {"RandomForest", "GradientBoosting"}
    best = min(rows.values(), key=lambda r: r.mae)
    assert best.chosen and sum(r.chosen for r in rows.values()) == 1
    assert M.predict_range(models[best.model], features, best.mae).filter("predicted_hours is not null").count() == 1_600


# -- ranks ----------------------------------------------------------------------------


def test_ranks_of_a_hot_part(spark):
    rng = random.Random(4)
    rows = [("hot" if k % 3 else rng.choice(["a", "b", None]), k, rng.choice([None, *range(40)]), rng.randrange(3)) for k in range(3_000)]
    df = spark.createDataFrame(rows, "part string, id long, score int, day int").repartition(7)
    got = W.ranked_all(df, ["part"], [("score", "desc"), ("day", "asc")])
    got = W.ranked_all(got, ["part"], [("score", "desc")], True, "dense")
    df.createOrReplaceTempView("ranked_rows")
    want = spark.sql(
        """SELECT *, rank() OVER (PARTITION BY part ORDER BY score DESC, day) AS rank,
        dense_rank() OVER (PARTITION BY part ORDER BY score DESC) AS dense FROM ranked_rows"""
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert W.ranked_all(df.limit(0), ["part"], [("score", "asc")]).collect() == []


def test_equal_ranks_give_the_least_row(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 7, "0"), (2, None, "x")], "k int, rank int, v string")
    assert sorted(map(tuple, W.first_distinct(df, ["k"], "rank").collect())) == [(1, 5, "a"), (2, None, "x")]


# -- keywords -------------------------------------------------------------------------


def test_keyword_table_equals_literals(spark):
    rng = random.Random(5)
    letters = "abcde é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))).upper() for _ in range(150)] + ["", "   ", "abc" * 2_000]
    lists = {f"L{n}": ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(9)] for n in range(5)}
    lists = {label: sorted({w for w in words if w.strip()}) for label, words in lists.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(label, n, w) for n, (label, ws) in enumerate(lists.items()) for w in [*ws, ws[0]]] + [("L0", 0, " ")], "label string, label_no int, keyword string")
    got = {(r.doc_id, r.label): (r.hits, round(r.score, 9), r.rank) for r in T.keyword_scores(docs, table).collect()}
    want = {(r.doc_id, r.label): (r.hits, round(r.score, 9), r.rank) for r in T.category_scores(docs, lists).collect()}
    assert got == want


def test_many_keywords(spark):
    table = spark.range(100_000).selectExpr("concat('label', id % 50) AS label", "cast(id % 50 AS int) AS label_no", "concat('kw', hex(id), 'x') AS keyword")
    docs = spark.createDataFrame([(1, "see kw1F4x and KW1f5X."), (2, "akw0xb kw1869Fx"), (3, None), (4, "kw 1x")], "doc_id long, text string")
    start = time.time()
    got = sorted((r.doc_id, r.label, r.hits) for r in T.keyword_hits(docs, table).collect())
    assert got == [(1, "label0", 1), (1, "label1", 1), (2, "label0", 1), (2, "label49", 1)]
    assert time.time() - start < 60


# -- map and presence -------------------------------------------------------------------


def test_levels_equal_their_own_grid(spark):
    rng = random.Random(6)
    points = [(rng.uniform(-0.01, 0.01), rng.uniform(-0.02, 0.02)) for _ in range(500)] + [(None, 1.0)]
    df = spark.createDataFrame(points, "lat double, lng double")
    pyramid = G.grid_pyramid(df, 4).collect()
    for level in range(4):
        own = {(r.cell_y, r.cell_x, r.n, r.cell_lat, r.cell_lng) for r in G.grid_aggregate(df, 100.0 * 2**level).collect()}
        assert {(r.cell_y, r.cell_x, r.n) for r in pyramid if r.level == level} == {o[:3] for o in own}
        centres = {(r.cell_y, r.cell_x): (r.cell_lat, r.cell_lng) for r in pyramid if r.level == level}
        assert all(abs(centres[o[:2]][0] - o[3]) < 1e-6 and abs(centres[o[:2]][1] - o[4]) < 1e-6 for o in own)
    view = G.grid_view(G.grid_pyramid(df, 4), 1, (-90, -180, 90, 180)).collect()
    assert {r.level for r in view} == {3} and sum(r.n for r in view) == 500


def test_busy_user_is_merged_before_the_shuffle(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1 if k % 3 else 2 + k % 50, start + dt.timedelta(seconds=40 * k + (600 if k > 2_000 else 0))) for k in range(3_000)]
    rows.append((999, start + dt.timedelta(days=9)))  # moves the watermark on
    spark.createDataFrame(rows, "user_id long, at timestamp").repartition(8).write.parquet(str(tmp_path / "in"))
    schema = spark.createDataFrame([], "user_id long, at timestamp").schema
    out = {}
    for name, settings in (("plain", {}), ("early", X.MERGE_SESSIONS_EARLY)):
        stream = X.read_stream(spark, str(tmp_path / "in"), schema)
        out[name] = sorted(map(tuple, X.run_to_table(X.stream_presence(stream, "at"), name, settings=settings).collect()))
    assert out["early"] == out["plain"] and len([r for r in out["early"] if r[0] == 1]) == 2
    with X.session_settings(spark, X.MERGE_SESSIONS_EARLY):
        stream = X.read_stream(spark, str(tmp_path / "in"), schema)
        query = X.stream_presence(stream, "at").writeStream.format("memory").queryName("busy").option("checkpointLocation", str(tmp_path / "c"))
        query = query.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert plan.rindex("MergingSessions") > plan.rindex("Exchange hashpartitioning")  # also below the shuffle
