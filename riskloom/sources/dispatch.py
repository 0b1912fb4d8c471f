"""Spreading requests over workers, and settings from the session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.order import positions


def dispatch(requests: DataFrame, workers: int, order: str | None = None) -> DataFrame:
    """Requests with ``worker`` (0, 1, ...), dealt to ``workers`` partitions in turn as they come.

    With ``order``, a column, the turns follow it: the first goes to worker 0, the next to 1; rows stay where they lie.
    """
    if order is not None:
        return positions(requests, order, name="worker").withColumn("worker", (F.col("worker") % workers).cast("int"))
    return requests.repartition(workers).withColumn("worker", F.spark_partition_id())


@dataclass(frozen=True)
class Settings:
    """How to score: read from the session's configuration under ``riskloom.``."""

    method: str = "ivf"
    probes: int = 12
    index: str | None = None

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        get = spark.conf.get
        return cls(get("riskloom.method", "ivf"), int(get("riskloom.probes", "12")), get("riskloom.index", "") or None)
