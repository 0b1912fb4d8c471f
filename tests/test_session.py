"""What a lineage cut leaves behind."""

import glob
import time

import pytest
from pyspark.sql import functions as F

from riskloom.session import cut, cuts_in


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}


@pytest.mark.parametrize("in_folder", [False, True])
def test_shuffles_of_a_cut_are_removed(spark, tmp_path, in_folder):
    """They lay on disk until the driver collected its garbage: 721 MB of them on check_h, over the pipeline's limit."""
    before, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        want = [(k, 143 if k < 6 else 142) for k in range(7)]
        if in_folder:
            with cuts_in(spark, str(tmp_path / "cuts")):
                kept = cut(counts)
                assert sorted(map(tuple, kept.collect())) == want
        else:
            kept = cut(counts)
            assert sorted(map(tuple, kept.collect())) == want
        until = time.time() + 10
        while shuffle_files(spark) - before and time.time() < until:
            time.sleep(0.1)
        assert not shuffle_files(spark) - before
        assert spark.conf.get(setting) == "false"
        assert sorted(map(tuple, counts.collect())) == want  # the plan that was cut still runs
    finally:
        spark.conf.set(setting, own)
