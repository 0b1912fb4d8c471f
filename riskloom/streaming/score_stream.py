"""Scoring a stream of requests in micro-batches.

Scoring keeps no state from one request to the next, so each micro-batch is scored like a batch; the search
needs ranks over whole queries, which a stream plan doesn't allow outside foreachBatch. Answers are written
under the batch's number, so a batch that is run again after a failure replaces its own output. What a batch stores in
between lies beside the stream's checkpoint and is removed when the batch is done, so a long stream fills no folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from riskloom.plans.score import score_requests
from riskloom.session import cuts_in


def read_request_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON lines (qid, body) as they arrive in a folder."""
    return spark.readStream.schema("qid bigint, body string, label int").option("maxFilesPerTrigger", files_per_batch).json(path)


def score_stream(requests: DataFrame, index: tuple[DataFrame, DataFrame], out: str, checkpoint: str, method: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Score every micro-batch against ``index`` and store the answers in ``out``; the method is the settings' unless given."""

    def batch(df: DataFrame, number: int) -> None:
        with cuts_in(df.sparkSession, f"{checkpoint}/between/{number}"):
            score_requests(df, index, method).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
