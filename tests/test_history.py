import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.operators.history import with_history


def test_against_brute_force(spark):
    rng = random.Random(11)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(400):
        user = rng.choice([1, 1, 1, 2, 3, None])
        gap = rng.choice([0, 0, 30, 3600, 86400, 86400 * 9]) if user == 2 else rng.randrange(86400 * 3)
        rows.append((i, user, start + timedelta(seconds=gap + (i // 40) * 86400 * 4 if user == 2 else gap), f"M{rng.randrange(9)}"))
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, merchant_id string").withColumn("us", S.micros(F.col("ts")))
    got = {r.event_id: r for r in with_history(df).collect()}
    assert len(got) == len(rows)
    for i, user, ts, _ in rows:
        before = sorted((t, j, m) for j, u, t, m in rows if u == user and (t, j) < (ts, i))
        assert got[i].last_ts == (before[-1][0] if before else None)
        assert got[i].known_merchants == [m for _, _, m in before[-5:]]
        assert got[i].day_count == sum(u == user and ts - timedelta(days=1) <= t <= ts for _, u, t, _ in rows)
    assert with_history(df.limit(0)).count() == 0


def test_rows_are_shuffled_once_and_counted_by_running_totals(spark):
    rows = spark.range(100).selectExpr("id AS event_id", "id % 7 AS user_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id * 3600000000L AS us", "'M' AS merchant_id", "'payload' AS payload")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = with_history(rows)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 4  # rows; their tails by day, by user, and again by day for the join
    assert "RangeFrame, -86400000000" not in plan and "collect_list(mine" not in plan and "RangeFrame, unboundedpreceding$(), -86400000001" in plan


def test_a_user_with_a_dense_day(spark):
    rows = [(i, 1 if i % 3 else None, i * 1800 * 10**6 // 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, us bigint").selectExpr("*", "CAST(timestamp_micros(us) AS timestamp_ntz) AS ts", "concat('M', event_id) AS merchant_id")
    about = spark.createDataFrame([(1, "one")], "user_id bigint, name string")
    full, known = {r.event_id: r for r in with_history(df).collect()}, with_history(df, about=about).collect()
    for user in (1, None):
        mine = [r for r in rows if r[1] == user]
        for at, (i, _, us) in enumerate(mine):
            assert full[i].day_count == sum(us - 86400 * 10**6 <= r[2] <= us for r in mine)
            assert full[i].known_merchants == [f"M{r[0]}" for r in mine[max(0, at - 5) : at]]
    assert len(full) == 2000 and {r.event_id for r in known} == {r[0] for r in rows if r[1]} and all(r.name == "one" and r.day_count == full[r.event_id].day_count for r in known)
