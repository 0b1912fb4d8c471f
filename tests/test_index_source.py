import os

import pytest
from pyspark.sql import functions as F

from riskloom.operators.features import VECTOR
from riskloom.operators.index_build import MAXS, MINS, cluster_table
from riskloom.sources.index_source import read_index_files, write_index_files


@pytest.fixture(scope="module")
def refs(spark):
    """Two tags; tag 3 has 900 vectors in clusters of 700, 0, 150 and 50."""
    v = [(F.pmod(F.hash("tag", "vi", F.lit(i)), F.lit(20001)) - 10000).cast("smallint").alias(c) for i, c in enumerate(VECTOR)]
    rows = spark.range(900).select(F.lit(3).alias("tag"), F.col("id").alias("vi"), F.when(F.col("id") < 700, 0).when(F.col("id") < 850, 2).otherwise(3).alias("cid"))
    rows = rows.union(spark.range(40).select(F.lit(11), F.col("id"), F.floor(F.col("id") / 10).cast("int")))
    return rows.select("tag", "cid", "vi", *v, (F.col("vi") % 2).cast("int").alias("label")).cache()


@pytest.mark.parametrize(("per_file", "per_task"), [(10**6, 10**6), (100, 10**6), (333, 37), (10**6, 100)])
def test_round_trip(spark, refs, tmp_path, per_file, per_task):
    write_index_files(refs, str(tmp_path / "ix"), per_file)
    back, boxes = read_index_files(spark, str(tmp_path / "ix"), per_task)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, refs.select(back.columns).collect()))
    cols = ["tag", "cid", "n", "first", *MINS, *MAXS]
    assert sorted(map(tuple, boxes.select(cols).collect())) == sorted(map(tuple, cluster_table(refs).select(cols).collect()))
    assert len(os.listdir(tmp_path / "ix" / "tag=03")) >= 900 // per_file


def test_only_what_is_asked_is_read(spark, refs, tmp_path):
    path = f"file:{tmp_path}/ix"
    write_index_files(refs, path)
    back, _ = read_index_files(spark, path, 100)
    assert back.rdd.getNumPartitions() == 7 + 2 + 1  # a cluster of 700 in ranges of its own, the 200 after it, the other tag
    assert back.filter("tag = 11").rdd.getNumPartitions() == 1
    assert back.filter("tag in (11, 12)").rdd.getNumPartitions() == 1
    assert back.filter("tag = 3 and cid > 2").rdd.getNumPartitions() <= 3 and back.filter("tag = 3 and cid > 2").count() == 50
    assert back.filter("tag = 5").count() == 0
    some, _ = read_index_files(spark, path, columns=["tag", "label"])
    assert some.groupBy("label").count().orderBy("label").collect() == [(0, 470), (1, 470)]
    # vectors that are spoilt don't matter to a reader that asks for labels alone
    assert some.columns == ["tag", "label"]


def test_files_that_are_none(spark, refs, tmp_path):
    write_index_files(refs, str(tmp_path / "ix"))
    assert read_index_files(spark, str(tmp_path))[0].count() == 940  # found below
    file = next((tmp_path / "ix" / "tag=11").iterdir())
    raw = file.read_bytes()
    for bad, word in ((b"none" + raw[4:], "no index file"), (raw[:-60], "cut short"), (raw[:8] + b"\0\0\0\0" + raw[12:], "0 clusters"), (raw[:64] + b"\1" + raw[65:], "offsets")):
        file.write_bytes(bad)
        with pytest.raises(Exception, match=word):
            read_index_files(spark, str(tmp_path / "ix"))[0].count()
    os.mkdir(tmp_path / "empty")
    r, c = read_index_files(spark, str(tmp_path / "empty"))
    assert r.count() == 0 and c.count() == 0
    write_index_files(refs.limit(0), str(tmp_path / "empty"))
    assert read_index_files(spark, str(tmp_path / "empty"))[0].count() == 0
