import os

from pyspark.sql import functions as F

from riskloom.operators.index_build import build_index
from riskloom.plans.score import event_vectors, score_requests, split_events
from riskloom.session import cut, shared_dir
from riskloom.sources.events import as_requests, transactions
from riskloom.streaming.score_stream import read_request_stream, score_stream


def test_a_stream_leaves_nothing_between_its_batches(spark, sf_dir, tmp_path):
    known = split_events(cut(event_vectors(spark, sf_dir)))[1]
    index = tuple(map(cut, build_index(known, "vec_id", "kmeans")))
    asks = as_requests(transactions(spark.read.parquet(f"{sf_dir}/events.parquet"))).filter("event_id % 10 = 0").withColumnRenamed("event_id", "qid")
    for i in range(3):
        asks.filter(F.col("qid") % 30 == i * 10).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    before = sorted(os.listdir(shared_dir(spark).removeprefix("file:")))
    q = score_stream(read_request_stream(spark, f"{tmp_path}/in/*", files_per_batch=1), index, f"{tmp_path}/out", f"{tmp_path}/state", "ivf")
    q.awaitTermination()
    assert sorted(os.listdir(shared_dir(spark).removeprefix("file:"))) == before
    assert os.listdir(tmp_path / "state" / "between") == []
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("batch").distinct().count() == 3
    want = score_requests(asks.select("qid", "body"), index, "ivf")
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_transactions_are_derived_once(spark, sf_dir, monkeypatch):
    """The stream's requests and the index it is scored against come from one pass over the events."""
    from riskloom import queries
    from riskloom.plans import score

    made, plain = [], queries.transactions
    for module in (queries, score):
        monkeypatch.setattr(module, "transactions", lambda events: (made.append(1), plain(events))[1])
    assert queries.stream_score(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 10 = 0").count()
    assert len(made) == 1
