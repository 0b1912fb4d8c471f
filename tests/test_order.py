"""Positions against a plain sort."""

from pyspark.sql import functions as F

from riskloom.operators.order import positions
from riskloom.sources.dispatch import dispatch


def test_positions(spark):
    rows = [(0, i * 7919 % 500) for i in range(500)] + [(k, 5) for k in (1, 1, 2)] + [(None, 3), (3, None)]  # one key has nearly all rows
    df = spark.createDataFrame(rows, "k int, i bigint").repartition(5)
    got = sorted(positions(df, "k", "i").collect(), key=lambda r: r.position)
    low = lambda x: -1 if x is None else x
    assert [r.position for r in got] == list(range(len(rows)))
    assert [(r.k, r.i) for r in got] == sorted(rows, key=lambda r: (low(r[0]), low(r[1])))
    assert positions(df.limit(0), "k").count() == 0


def test_one_key_is_spread(spark):
    """Small ranges are merged by adaptive execution, so that is off here."""
    df = spark.range(4000).withColumn("tag", F.lit(3))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = positions(df, "tag", "id").select(F.spark_partition_id().alias("p")).toPandas()["p"].value_counts().tolist()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and max(spread) < 2500


def test_turns(spark):
    got = dispatch(spark.range(10, 33), 4, "id").collect()
    assert {r.id: r.worker for r in got} == {i: (i - 10) % 4 for i in range(10, 33)}
