"""Lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session without one (tests) gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder and all in it, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def cuts_in(spark: SparkSession, folder: str) -> Iterator[None]:
    """Within it, ``cut`` keeps its tables in ``folder``, which is emptied before and removed after: for work that repeats, such as a stream's batches."""
    remove(spark, folder)  # what a run that was killed left
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        remove(spark, folder)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go when it ends. Left alone, they stay on disk until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation; the shuffles that made it are removed."""
    spark, folder = df.sparkSession, _FOLDER.get()
    with _shuffles_removed(spark):
        fresh = df.select("*")  # a plan of its own: ``df`` may be run again and then shuffles anew
        if folder is not None:
            path = f"{folder}/{uuid.uuid4().hex}"
            fresh.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        shared_dir(spark)
        return fresh.checkpoint(eager=True)
