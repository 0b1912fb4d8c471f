import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluate as E
from riskloom.plans.score import event_index, ready, score_requests
from riskloom.sources.dispatch import Settings, dispatch
from riskloom.sources.events import as_requests, transactions
from riskloom.streaming.score_stream import read_request_stream, score_stream


def test_published_scores(spark):
    """The checked-in run of the load test."""
    counts = spark.createDataFrame([(23937, 30113, 4, 5, 0)], "tp bigint, tn bigint, fp bigint, fn bigint, errors bigint")
    r = E.report(counts, F.lit(1.26869184)).first()
    assert (r.weighted_errors, r.final_score_2) == (19, 5506.33)
    assert r.detection_score == pytest.approx(2609.6910013, abs=1e-6) and r.p99_score == pytest.approx(2896.6438534, abs=1e-6)
    assert r.rate_component == 3000.0 and r.absolute_penalty == pytest.approx(-390.3089987, abs=1e-6)


def test_score_edges(spark):
    got = [x[0] for x in spark.createDataFrame([(x,) for x in (0.0, -1.0, 0.5, 1.0, 1000.0, 2000.0, 2000.1)], "x double").select(E.p99_score(F.col("x"))).collect()]
    assert got == pytest.approx([0, 0, 3000, 3000, 0, -301.03, -3000], abs=0.01)
    counts = spark.createDataFrame([(0, 0, 0, 0, 0), (8, 0, 2, 0, 0), (90, 0, 0, 0, 10)], "tp bigint, tn bigint, fp bigint, fn bigint, errors bigint")
    r = E.report(counts, F.lit(5.0)).orderBy("n").collect()
    assert (r[0].epsilon, r[0].failure_rate, r[0].detection_score) == (0, 0, 3000.0)
    assert r[1].detection_cut and r[1].detection_score == -3000 and r[1].rate_component is None
    assert not r[2].detection_cut and r[2].weighted_errors == 50


def test_confusion(spark):
    rows = [(True, True, 200), (False, True, 200), (True, False, 200), (False, False, 200), (True, True, 500), (None, True, 200), (True, True, None)]
    assert tuple(E.confusion(spark.createDataFrame(rows, "approved boolean, expected_approved boolean, status int")).first()) == (1, 1, 1, 1, 3)


def test_thresholds(spark):
    checks = spark.createDataFrame([("a", 3, 0), ("b", 2, 1)], "name string, passes bigint, fails bigint")
    assert [(r.name, r.ok) for r in E.thresholds(checks).orderBy("name").collect()] == [("a", True), ("b", False)]


def test_replay(spark):
    entries = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, x string")
    assert [r.x for r in E.replay(entries, 5).orderBy("request").collect()] == ["a", "b", "a", "b", "a"]
    assert E.replay(entries, 5, cycle=False).count() == 2 and E.replay(entries.limit(0), 5).count() == 0


def test_dispatch_and_settings(spark):
    sizes = [r["count"] for r in dispatch(spark.range(103), 4).groupBy("worker").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 8
    assert Settings.of(spark) == Settings()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    _, index = event_index(spark, sf_dir)
    assert ready(spark, index)
    asks = as_requests(transactions(spark.read.parquet(f"{sf_dir}/events.parquet"))).filter("event_id % 10 = 0").withColumnRenamed("event_id", "qid")
    asks = asks.withColumn("body", F.when(F.col("qid") % 50 == 0, "broken").otherwise(F.col("body")))
    asks.repartition(3).write.json(str(tmp_path / "in"))
    score_stream(read_request_stream(spark, str(tmp_path / "in"), 1), index, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("batch").orderBy("qid").collect()
    batch = score_requests(asks, index).orderBy("qid").collect()
    assert [tuple(r) for r in streamed] == [tuple(r) for r in batch]
    assert {r.status for r in batch} == {200, 400} and all((r.votes is None) == (r.status == 400) for r in batch)


def test_exact_percentiles_in_many_ranges(spark):
    rng = random.Random(3)
    values = [rng.expovariate(1) ** 4 for _ in range(3000)] + [7.0] * 500 + [1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranked = sorted(values)
    ranks = [0, 1, 1700, 2900, 3499, 3500]
    assert E.order_statistics(df, ranks, bins=5, small=9) == {r: ranked[r] for r in ranks}
    assert E.exact_percentiles(df.limit(0), "v", [0.5]) == [None]
    want = [float(np.quantile(values, p)) for p in (0.0, 0.5, 0.999, 1.0)]
    assert E.exact_percentiles(df, "v", [0.0, 0.5, 0.999, 1.0]) == pytest.approx(want)
