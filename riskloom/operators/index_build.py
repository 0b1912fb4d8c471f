"""Building and checking the partitioned cluster index.

The index is two tables. ``refs``: tag, cid, vi (the position in the tag's storage order, which breaks
ties), v0..v13, label. ``clusters``: tag, cid, n, first (offset of its first vector) and the box min0..13,
max0..13. A tag has at most MAX_CLUSTERS clusters, so the clusters of an index of any size fit a broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators.features import DIMS, VECTOR
from riskloom.operators.order import positions
from riskloom.session import cut

MAX_CLUSTERS = 4096
ROUNDS = 4  # of k-means
BUILT_TAGS = tuple(range(12))  # the tags an index must have: not card present and online at once
MINS = [f"min{i}" for i in range(DIMS)]
MAXS = [f"max{i}" for i in range(DIMS)]


def grid_cluster() -> Column:
    """A deterministic cluster of 64: spending ratio by hour, eight steps each."""
    step = lambda v, width: F.least(F.lit(7), F.floor(F.col(v) / width)).cast("int")
    return (step("v2", 300) * 8 + step("v3", 1251)).alias("cid")


def storage_order(refs: DataFrame, ident: str) -> DataFrame:
    """Add ``vi``: 0, 1, ... within the tag in the order of cid and ``ident``.

    A tag or cluster of any size is spread by ranges: no task sorts a whole one.
    """
    placed = positions(refs, "tag", "cid", ident, name="__position")
    first = placed.groupBy("tag").agg(F.min("__position").alias("first")).collect()  # at most 16 rows
    start = F.lit(0)
    for r in first:
        start = F.when(F.col("tag") == r.tag, r["first"]).otherwise(start)
    return placed.withColumn("vi", (F.col("__position") - start).cast("bigint")).drop("__position")


def cluster_table(refs: DataFrame) -> DataFrame:
    """Box, size and first offset of every cluster."""
    boxes = [F.min(v).alias(m) for v, m in zip(VECTOR, MINS, strict=True)] + [F.max(v).alias(m) for v, m in zip(VECTOR, MAXS, strict=True)]
    sizes = refs.groupBy("tag", "cid").agg(F.count("*").alias("n"), *boxes)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tag").orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("first", before.cast("bigint")).select("tag", "cid", "n", "first", *MINS, *MAXS)


def cluster_count(rows: int) -> int:
    """Clusters of a tag: the square root of its vectors, at most MAX_CLUSTERS."""
    return min(MAX_CLUSTERS, max(1, math.isqrt(rows)))


def vector_hash() -> Column:
    """First of the keys that equal vectors are met by: one number sorts faster than fifteen."""
    return F.xxhash64("tag", *VECTOR).alias("__h")


def distinct_vectors(refs: DataFrame) -> DataFrame:
    """tag, v0..v13, n: how many rows have each vector of a tag. Stored in a given number of parts, since few bytes make much work."""
    spark = refs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return cut(refs.groupBy("tag", *VECTOR).agg(F.count("*").alias("n")).repartition(parts, "tag", *VECTOR))


def train_centroids(refs: DataFrame, ident: str = "vec_id", rounds: int = ROUNDS, distinct: DataFrame | None = None) -> dict[int, np.ndarray]:
    """k-means centroids by tag: ``cluster_count`` vectors first by the MD5 of their id, then ``rounds`` of Lloyd's steps.

    Every step runs over the ``distinct_vectors`` where they lie, each counting as often as it is there: a task sums the vectors
    nearest to each centroid, and the sums, at most MAX_CLUSTERS a tag, are added up. Means are whole numbers (rounded down), so the result doesn't hang on the order of
    additions. A centroid that no vector is nearest to goes.
    """
    distinct = distinct_vectors(refs) if distinct is None else distinct
    held = {r.tag: r.n for r in distinct.groupBy("tag").agg(F.sum("n").alias("n")).collect()}  # at most 16 rows
    sizes = {t: cluster_count(n) for t, n in held.items()}
    nth = F.row_number().over(Window.partitionBy("tag").orderBy("md5"))
    seeds = _seeds(refs, ident, held).withColumn("nth", nth).filter(F.col("nth") <= max(sizes.values(), default=1)).drop("md5")
    rows = seeds.orderBy("tag", "nth").toArrow()  # at most MAX_CLUSTERS a tag
    tags, order = rows.column("tag").to_numpy(), rows.column("nth").to_numpy()
    data = np.stack([rows.column(v).to_numpy() for v in VECTOR], axis=1).astype(np.float64) if len(rows) else np.zeros((0, DIMS))
    centers = {t: data[(tags == t) & (order <= c)] for t, c in sizes.items()}
    for _ in range(rounds):
        total = _nearest_sums(distinct, centers).groupBy("tag", "cid").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(DIMS)])
        rows = total.orderBy("tag", "cid").toArrow()
        tags, n = rows.column("tag").to_numpy(), rows.column("n").to_numpy()
        mean = np.stack([rows.column(f"s{i}").to_numpy() // n for i in range(DIMS)], axis=1).astype(np.float64)
        centers = {t: mean[tags == t] for t in sizes}
    return centers


def _seeds(refs: DataFrame, ident: str, held: dict[int, int]) -> DataFrame:
    """tag, v0..v13, md5 of at least the ``cluster_count`` rows of each tag that are first by the MD5 of their id, stored.

    Ranking a whole tag would sort it in one task. Hashes are spread evenly, so those below a bound hold the first rows and few
    others. Rows are counted after: a tag of which too few lie below (equal ids) is taken whole.
    """
    md5 = F.md5(F.col(ident).cast("string").cast("binary"))
    rows = refs.select("tag", *VECTOR, md5.alias("md5"))
    unit = F.conv(F.substring("md5", 1, 8), 16, 10).cast("bigint")  # the first 32 bits order as the digits do
    bound = F.lit(None).cast("bigint")
    for t, n in held.items():
        c = cluster_count(n)
        bound = F.when(F.col("tag") == t, F.lit(min(1 << 32, int((c + 8 * math.sqrt(c) + 64) / n * (1 << 32))))).otherwise(bound)
    first = cut(rows.filter(unit < bound))
    found = {r.tag: r.n for r in first.groupBy("tag").agg(F.count("*").alias("n")).collect()}  # at most 16 rows
    whole = [t for t, n in held.items() if found.get(t, 0) < cluster_count(n)]
    return first.filter(~F.col("tag").isin(whole)).unionByName(rows.filter(F.col("tag").isin(whole))) if whole else first


def _nearest_sums(distinct: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """(tag, cid, n, s0..s13) of each task: counts and sums of the vectors nearest to each centroid."""
    sent = distinct.sparkSession.sparkContext.broadcast(centers)  # 16 tags x MAX_CLUSTERS x 14 numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {t: (np.zeros(len(c), np.int64), np.zeros((len(c), DIMS), np.int64)) for t, c in sent.value.items()}
        for batch in batches:
            tags = batch.column(0).to_numpy()
            x = np.stack([batch.column(1 + i).to_numpy() for i in range(DIMS)], axis=1)
            times = batch.column(1 + DIMS).to_numpy()
            for t in np.unique(tags).tolist():
                mine = np.flatnonzero(tags == t)
                for part in np.array_split(mine, max(1, len(mine) // 4096)):
                    own = _nearest(x[part].astype(np.float64), sent.value[t])
                    np.add.at(held[t][0], own, times[part])
                    np.add.at(held[t][1], own, x[part].astype(np.int64) * times[part][:, None])
        for t, (n, sums) in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at]), *(pa.array(sums[at, i]) for i in range(DIMS))], ["tag", "cid", "n", *[f"s{i}" for i in range(DIMS)]])

    return distinct.select("tag", *VECTOR, "n").mapInArrow(run, "tag int, cid int, n bigint, " + ", ".join(f"s{i} bigint" for i in range(DIMS)))


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The first of the nearest centers of each row. Distances, but for what depends on the row alone, come from one product (whole numbers, so exact) in pieces that stay in the cache."""
    table = np.vstack([-2 * centers.T, (centers**2).sum(axis=1)])
    x = np.hstack([x, np.ones((len(x), 1))])
    step = max(1, (1 << 18) // len(centers))
    return np.concatenate([(x[a : a + step] @ table).argmin(axis=1) for a in range(0, max(1, len(x)), step)])


def assign_centroids(refs: DataFrame, centroids: dict[int, np.ndarray], distinct: DataFrame | None = None) -> DataFrame:
    """Add ``cid``: the nearest centroid of the row's tag (the first of equals), found once for each of the ``distinct_vectors``."""
    kept = [c for c in refs.columns if c != "cid"]
    found = _assigned(distinct_vectors(refs) if distinct is None else distinct, centroids)
    keys = ["__h", "tag", *VECTOR]
    return refs.select(*kept, vector_hash()).join(found.select("*", vector_hash()), keys).select(*kept, "cid")


def _assigned(distinct: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """tag, v0..v13, cid."""
    sent = distinct.sparkSession.sparkContext.broadcast(centroids)  # 16 tags x MAX_CLUSTERS x 14 numbers at most
    kept = ["tag", *VECTOR]
    schema = distinct.select(kept).schema.add("cid", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(kept.index("tag")).to_numpy()
            x = np.stack([batch.column(kept.index(v)).to_numpy() for v in VECTOR], axis=1).astype(np.float64)
            cid = np.zeros(len(x), dtype=np.int32)
            for t in np.unique(tags):
                mine = np.flatnonzero(tags == t)
                for part in np.array_split(mine, max(1, len(mine) // 4096)):
                    cid[part] = _nearest(x[part], sent.value[int(t)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cid)], [*kept, "cid"])

    return distinct.select(kept).mapInArrow(run, schema)


def build_index(vectors: DataFrame, ident: str = "vec_id", assigner: str = "kmeans") -> tuple[DataFrame, DataFrame]:
    """(refs, clusters) of labelled vectors (``ident``, tag, v0..v13, label), by k-means or by the grid.

    k-means clusters grow with the square root of a tag's vectors; the grid has 64 at any size.
    """
    if assigner == "grid":
        assigned = vectors.withColumn("cid", grid_cluster())
    elif assigner == "kmeans":
        distinct = distinct_vectors(vectors)
        assigned = assign_centroids(vectors, train_centroids(vectors, ident, distinct=distinct), distinct)
    else:
        raise ValueError(f"unknown assigner {assigner!r}")
    refs = storage_order(assigned, ident).select("tag", "cid", "vi", *VECTOR, "label")
    return refs, cluster_table(refs)


def check_index(clusters: DataFrame, tags: tuple[int, ...] = BUILT_TAGS) -> None:
    """Raise unless every tag is there with 1 to MAX_CLUSTERS clusters and offsets that fit together."""
    last = F.lead("first").over(Window.partitionBy("tag").orderBy("cid"))
    found = clusters.withColumn("next", last).groupBy("tag").agg(F.count("*").alias("k"), F.count_if((F.col("first") + F.col("n")) != F.col("next")).alias("gaps")).collect()  # at most 16 rows
    by = {r.tag: r for r in found}
    missing = [t for t in tags if t not in by]
    if missing:
        raise ValueError(f"index without tags {missing}")
    bad = [t for t, r in by.items() if r.k > MAX_CLUSTERS or r.gaps]
    if bad:
        raise ValueError(f"index with too many clusters or gaps in tags {bad}")


def write_index(refs: DataFrame, clusters: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store both tables as Parquet, partitioned by tag and sorted by position, which is by cluster; a large cluster is many files."""
    refs.repartitionByRange("tag", "vi").sortWithinPartitions("tag", "vi").write.mode(mode).partitionBy("tag").parquet(f"{path}/refs")
    clusters.write.mode(mode).partitionBy("tag").parquet(f"{path}/clusters")


def read_index(spark: SparkSession, path: str, tags: tuple[int, ...] = BUILT_TAGS) -> tuple[DataFrame, DataFrame]:
    """Open a stored index and check it; filters on tag prune its partitions."""
    refs, clusters = spark.read.parquet(f"{path}/refs"), spark.read.parquet(f"{path}/clusters")
    check_index(clusters, tags)
    return refs, clusters
