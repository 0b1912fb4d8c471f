import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.operators.history import with_history
from riskloom.streaming.history_stream import PROVIDER, history_stream, start

SCHEMA = "event_id bigint, user_id bigint, ts timestamp_ntz, merchant_id string, note string"


def arrivals(spark, root, batches):
    """A folder with one file a batch, read a file at a time in that order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{root}/in/{i:03d}", ignoreNullFields=False)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{root}/in/*").withColumn("us", S.micros(F.col("ts")))


def flush(rows):
    """A last row far ahead, by which the watermark passes all others."""
    return [(-1, -1, max(r[2] for r in rows if r[2]) + timedelta(days=9), "END", None)]


def run(spark, root, stream):
    q = start(stream, f"{root}/out", f"{root}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out"), q


def late_rows():
    rng = random.Random(5)
    begin = datetime(2026, 1, 1)
    rows = []
    for i in range(500):
        user = rng.choice([1, 1, 1, 1, 2, 3, None])
        gap = rng.choice([0, 0, 1, 3600 * 5, 86400, 86400 + 1, 86400 * 3]) if user == 2 else rng.randrange(86400 * 4)
        rows.append((i, user, begin + timedelta(seconds=gap), rng.choice([None, "A", "B", "C", "D", "E", "F"]), "x" if i % 3 else None))
    rows += [rows[7], rows[20], rows[20]]  # repeated rows
    return rows


@pytest.mark.parametrize("slice_minutes", [60, 480])
def test_late_and_shuffled_rows_give_the_rows_of_the_batch(spark, tmp_path, slice_minutes):
    rows = late_rows()
    # in order but for up to six hours, so that slices close while others fill
    rng = random.Random(1)
    order = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(6 * 3600)))
    batches = [order[i : i + 100] for i in range(0, len(order), 100)] + [flush(rows)]
    stream = history_stream(arrivals(spark, tmp_path, batches), delay="6 hours", slice_minutes=slice_minutes)
    got, _ = run(spark, tmp_path, stream)
    want = with_history(spark.createDataFrame(rows, SCHEMA).withColumn("us", S.micros(F.col("ts"))))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_users_who_share_a_task_with_a_null_user_keep_their_own_history(spark, tmp_path):
    t = datetime(2026, 2, 1)
    rows = [(i, [None, 1, 2, 3, 2**53 + 1][i % 5], t + timedelta(minutes=i), "ABCDEFG"[i % 7], None) for i in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got, _ = run(spark, tmp_path, history_stream(arrivals(spark, tmp_path, [rows, flush(rows)])))
        want = with_history(spark.createDataFrame(rows, SCHEMA).withColumn("us", S.micros(F.col("ts"))))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rows_behind_the_watermark_are_dropped_and_state_ends_with_the_day(spark, tmp_path):
    t = datetime(2026, 3, 1)
    rows = [(i, i % 4, t + timedelta(minutes=i), "A", None) for i in range(200)]
    late = [(900, 0, t + timedelta(minutes=1), "Z", None), (901, 0, None, "Z", None)]
    ahead = [(950, 8, t + timedelta(days=1), "B", None)]
    stream = history_stream(arrivals(spark, tmp_path, [rows, ahead, late, flush(ahead)]), delay="1 hour")
    got, q = run(spark, tmp_path, stream)
    assert sorted(r.event_id for r in got.collect()) == [*range(200), 950]
    # of five users are left: five tails, and of the last row, which waits, the row, its slice and its timer
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal <= 5 + 8
    assert "RocksDB" not in spark.conf.get(PROVIDER)


def test_what_is_not_allowed(spark):
    rows = spark.createDataFrame([], SCHEMA + ", us bigint")
    with pytest.raises(ValueError, match="divide"):
        history_stream(rows, slice_minutes=7)
    with pytest.raises(ValueError, match="day_count"):
        history_stream(rows.withColumn("day_count", F.lit(1)))


def test_nothing_arrives(spark, tmp_path):
    got, _ = run(spark, tmp_path, history_stream(arrivals(spark, tmp_path, [[]])))
    assert got.count() == 0 and got.columns[-3:] == ["last_ts", "known_merchants", "day_count"]
