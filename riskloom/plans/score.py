"""Scoring requests against an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.decide import decide
from riskloom.operators.features import vectorize
from riskloom.operators.index_build import BUILT_TAGS, build_index, read_index
from riskloom.operators.knn import PROBES, search_exact, search_ivf
from riskloom.session import cut
from riskloom.sources.dispatch import Settings
from riskloom.sources.events import transactions
from riskloom.sources.requests import parse_requests

def score_vectors(queries: DataFrame, index: tuple[DataFrame, DataFrame], method: str = "ivf", probes: int = PROBES) -> DataFrame:
    """qid, votes, fraud_score, approved, response of vectors (qid, tag, v0..v13)."""
    if method not in ("exact", "ivf"):
        raise ValueError(f"unknown method {method!r}")
    found = search_exact(queries, *index) if method == "exact" else search_ivf(queries, *index, probes=probes)
    return decide(found.select("qid", "votes"))


def score_requests(bodies: DataFrame, index: tuple[DataFrame, DataFrame] | None = None, method: str | None = None, ident: str = "qid") -> DataFrame:
    """ident, status, votes, fraud_score, approved, response of JSON bodies (``ident``, body); null answers with status 400.

    Without them, the index and the method are those of the session's settings.
    """
    settings = Settings.of(bodies.sparkSession)
    if index is None:
        if settings.index is None:
            raise ValueError("give an index, or set riskloom.index to the folder of a stored one")
        index = read_index(bodies.sparkSession, settings.index)
    parsed = cut(parse_requests(bodies.select(F.col(ident).cast("bigint").alias("qid"), "body")))
    answers = score_vectors(vectorize(parsed.filter("valid"), "qid"), index, method or settings.method, settings.probes)
    return parsed.select("qid", "status").join(answers, "qid", "left").withColumnRenamed("qid", ident)


def ready(spark: SparkSession, index: tuple[DataFrame, DataFrame]) -> bool:
    """Whether the session answers and the index has rows."""
    return spark.range(1).count() == 1 and not index[1].isEmpty()


def readiness(index: tuple[DataFrame, DataFrame]) -> DataFrame:
    """tag, clusters, vectors, ready: what the index holds of each tag it must have; a tag is ready if it has vectors."""
    clusters = index[1]
    tags = clusters.sparkSession.range(len(BUILT_TAGS)).select(F.col("id").cast("int").alias("tag"))
    held = clusters.groupBy("tag").agg(F.count("*").alias("clusters"), F.sum("n").alias("vectors"))
    n = F.coalesce("vectors", F.lit(0))
    return tags.join(held, "tag", "left").select("tag", F.coalesce("clusters", F.lit(0)).cast("bigint").alias("clusters"), n.cast("bigint").alias("vectors"), (n > 0).alias("ready"))


def event_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label, tag, v0..v13 of the transactions derived from the events."""
    return vectorize(transactions(spark.read.parquet(f"{sf_dir}/events.parquet")), "event_id", "label")


def split_events(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, labelled references): every tenth event asks, the others with a tag of the index are known."""
    ask = F.col("event_id") % 10 == 0
    queries = vectors.filter(ask).withColumnRenamed("event_id", "qid")
    known = vectors.filter(~ask & F.col("tag").isin(*BUILT_TAGS)).withColumnRenamed("event_id", "vec_id")
    return queries, known


def event_index(spark: SparkSession, sf_dir: str, assigner: str = "grid") -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """Queries and the index over the events, features computed once."""
    queries, known = split_events(cut(event_vectors(spark, sf_dir)))
    return queries, build_index(known, "vec_id", assigner)
