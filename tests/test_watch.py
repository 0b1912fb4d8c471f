import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskloom.streaming import history_stream as H
from riskloom.streaming.watch import rank_error, sessions, window_report

SCHEMA = "ts timestamp_ntz, user_id bigint, approved boolean, expected_approved boolean, status int, ms double"
START = datetime(2026, 1, 1)


def rows(n, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        flag = rng.choice([True, False, None])
        out.append((START + timedelta(seconds=rng.randrange(4 * 3600)), rng.choice([1, 1, 1, 2, None]), flag, rng.random() < 0.5, rng.choice([200, 200, 500]), rng.choice([None, rng.gauss(50, 9)])))
    return [*out, (None, 1, True, True, 200, 1.0)]


def outcome(r):
    if r[4] != 200 or r[2] is None:
        return "errors"
    return {(False, False): "tp", (True, True): "tn", (False, True): "fp", (True, False): "fn"}[r[2], r[3]]


def test_windows_on_a_stream_equal_a_plain_count(spark, tmp_path):
    data = rows(600)
    timed = sorted((r for r in data if r[0]), key=lambda r: r[0])
    for i, part in enumerate([timed[:300] + [data[-1]], timed[300:], [(START + timedelta(days=2), 9, True, True, 200, 1.0)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    report = window_report(stream, delay="10 minutes")
    H.start(report, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r.h: r for r in spark.read.parquet(f"{tmp_path}/out").withColumn("h", ((F.unix_seconds("window_start") - int((START - datetime(1970, 1, 1)).total_seconds())) / 3600).cast("int")).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for h, r in got.items():
        mine = [x for x in timed if (x[0] - START) // timedelta(hours=1) == h]
        ms = sorted(x[5] for x in mine if x[5] is not None)
        assert r.n == len(mine) and r.max_ms == ms[-1]
        assert {k: r[k] for k in ("tp", "tn", "fp", "fn", "errors")} == {k: sum(outcome(x) == k for x in mine) for k in ("tp", "tn", "fp", "fn", "errors")}
        for p, v in ((0.5, r.p50_ms), (0.99, r.p99_ms)):  # so few values are held exactly
            assert sum(x < v for x in ms) <= p * len(ms) <= sum(x <= v for x in ms)


def test_rank_error_of_many_values(spark):
    n = 400_000
    many = spark.range(n).select(F.lit(START).cast("timestamp_ntz").alias("ts"), F.lit(True).alias("approved"), F.lit(True).alias("expected_approved"), F.lit(200).alias("status"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("ms"))
    r = window_report(many).first()
    for p, v in ((0.5, r.p50_ms), (0.99, r.p99_ms)):
        assert abs((v + 1) / n - p) <= 3 * rank_error()


def test_a_window_without_latencies_and_an_empty_table(spark):
    none = spark.createDataFrame([(START, 1, None, True, 200, None)], SCHEMA)
    r = window_report(none).first()
    assert (r.n, r.errors, r.max_ms, r.p50_ms, r.p99_ms) == (1, 1, None, None, None)
    assert window_report(none.limit(0)).count() == 0 and sessions(none.limit(0)).count() == 0


def test_sessions_equal_a_plain_walk(spark):
    data = rows(60, seed=8)
    got = sorted(map(tuple, sessions(spark.createDataFrame(data, SCHEMA), gap="10 minutes").select("user_id", F.unix_seconds("session_start"), "n").collect()), key=repr)
    want = []
    for user in {r[1] for r in data}:
        times = sorted(r[0] for r in data if r[1] == user and r[0])
        for i, t in enumerate(times):
            if i and t - times[i - 1] < timedelta(minutes=10):
                want[-1][2] += 1
            else:
                want.append([user, int((t - datetime(1970, 1, 1)).total_seconds()), 1])
    assert got == sorted(map(tuple, want), key=repr)
