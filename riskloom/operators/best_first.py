"""Exact neighbours by branch and bound over an index that is stored for joins.

The index lies in shards of at most about ``SHARD_ROWS`` vectors: whole clusters that lie near one another, or parts of one
that is larger. The stored table is partitioned by tag and bucketed by shard, so a search reads only the tags asked and
joins each shard with its queries where it lies: queries are shuffled, references never.

A query first goes to the shard with the nearest box. There it looks at clusters by rising bound, keeps the k nearest
found so far, and stops at the first cluster whose box is farther than the k-th of them. What it then knows bounds the
other shards: it goes only to those with a cluster that is no farther. Queries are scanned in waves that bound what a
task holds of them; each wave reads the shards again.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.features import DIMS, VECTOR
from riskloom.operators.index_build import MAXS, MINS
from riskloom.operators.knn import K, distinct_queries, for_equals, with_effective_tag
from riskloom.session import cut, shared_dir

SHARD_ROWS = 1 << 18
WAVE_ROWS = 1 << 18  # queries of one shard in a wave, at most about
_ROW = float(1 << 20)  # a key is distance * 2**20 + row: exact in doubles, as 14 * 20000**2 < 2**33


def shard_clusters(clusters: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``clusters`` with ``shard``, the first of its shards, and ``parts``, how many it is dealt to.

    The clusters of a tag are laid out along their main axis (at most MAX_CLUSTERS a tag, so on the driver) and cut into
    shards of ``shard_rows``; one that is larger has shards of its own.
    """
    rows = clusters.orderBy("tag", "cid").toArrow().to_pandas()
    shard, parts, at = np.zeros(len(rows), np.int32), np.ones(len(rows), np.int32), 0
    for _, own in rows.groupby("tag"):
        middle = (own[MINS].to_numpy(np.float64) + own[MAXS].to_numpy(np.float64)) / 2
        axis = np.linalg.svd(middle - middle.mean(axis=0), full_matrices=False)[2][0] if len(own) > 1 else np.ones(DIMS)
        held = 0
        for i in own.index[np.argsort(middle @ axis, kind="stable")]:
            n = int(rows.at[i, "n"])
            if held and held + n > shard_rows:
                at, held = at + 1, 0
            shard[i], parts[i] = at, -(-n // shard_rows)
            held += n
            if parts[i] > 1:
                at, held = at + int(parts[i]), 0
        at += held > 0
    known = pa.table({"tag": rows["tag"].to_numpy(np.int32), "cid": rows["cid"].to_numpy(np.int32), "shard": shard, "parts": parts})
    return clusters.join(F.broadcast(clusters.sparkSession.createDataFrame(known)), ["tag", "cid"])  # a row a cluster, as in the index


def store_shards(refs: DataFrame, clusters: DataFrame, shard_rows: int = SHARD_ROWS, buckets: int | None = None) -> tuple[str, DataFrame]:
    """(table, clusters with shards): the references as a table bucketed by shard and partitioned by tag, in the shared folder.

    An index of fewer shards than two for each core is stored in as many copies as make up for it, which share its queries.
    """
    spark = refs.sparkSession
    placed = shard_clusters(clusters, shard_rows)
    shards = placed.agg(F.max(F.col("shard") + F.col("parts"))).first()[0] or 1
    copies = -(-2 * spark.sparkContext.defaultParallelism // shards)
    placed = cut(placed.withColumn("copies", F.lit(copies)))
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    known = F.broadcast(placed.select("tag", "cid", "shard", "parts"))
    part = (F.col("shard") + F.pmod(F.hash("vi"), F.col("parts"))) * copies
    dealt = refs.join(known, ["tag", "cid"]).withColumn("shard", F.explode(F.sequence(part.cast("int"), (part + copies - 1).cast("int"))))
    name = f"shards_{uuid.uuid4().hex}"
    rows = dealt.select("shard", "cid", "vi", "label", *VECTOR, "tag").repartition(buckets, "shard")
    rows.write.partitionBy("tag").bucketBy(buckets, "shard").sortBy("shard", "cid", "vi").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return name, placed


def open_shards(spark: SparkSession, path: str, buckets: int) -> str:
    """A name for a table of ``store_shards`` that another session wrote to ``path`` in so many buckets."""
    name = f"shards_{uuid.uuid4().hex}"
    columns = ", ".join(f"{c} smallint" for c in VECTOR)
    spark.sql(f"CREATE TABLE {name} (shard int, cid int, vi bigint, label int, {columns}, tag int) USING parquet PARTITIONED BY (tag) CLUSTERED BY (shard) SORTED BY (shard, cid, vi) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return name


def scan_clusters(q: np.ndarray, worst: np.ndarray, r: np.ndarray, cid: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances (n, k), rows (n, k), clusters scanned (n)) of queries over vectors sorted by (cid, position), best first.

    Only neighbours no farther than ``worst`` are looked for; missing ones have an infinite distance. Ties go to the earlier row.
    """
    heads = np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]])
    ends = np.r_[heads[1:], len(cid)]
    low, high = np.minimum.reduceat(r, heads, axis=0), np.maximum.reduceat(r, heads, axis=0)
    best, scanned = np.full((len(q), k), np.inf), np.zeros(len(q), np.int64)
    best[:, -1] = np.where(np.isfinite(worst), (worst + 1) * _ROW, np.inf)  # whatever is farther than worst can't come in
    best[:, :-1] = best[:, -1:]
    norm = (r * r).sum(axis=1) * _ROW + np.arange(len(r))
    for a in range(0, len(q), max(1, (1 << 21) // len(heads))):
        part = q[a : a + max(1, (1 << 21) // len(heads))]
        bound = np.zeros((len(part), len(heads)))
        for d in range(DIMS):
            gap = np.maximum(np.maximum(low[:, d][None, :] - part[:, d][:, None], part[:, d][:, None] - high[:, d][None, :]), 0)
            bound += gap * gap
        order = np.argsort(bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        own, mine = (part * part).sum(axis=1) * _ROW, best[a : a + len(part)]
        alive = np.arange(len(part))
        for step in range(len(heads)):
            alive = alive[bound[alive, step] * _ROW <= mine[alive, -1]]
            if not len(alive):
                break
            scanned[a + alive] += 1
            cluster = order[alive, step]
            by = np.argsort(cluster, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(cluster[by]) != 0])
            for b, e in zip(cuts, [*cuts[1:], len(by)], strict=True):
                at = alive[by[b:e]]
                lo, hi = heads[cluster[by[b]]], ends[cluster[by[b]]]
                for f in range(0, len(at), max(1, (1 << 20) // (hi - lo))):
                    some = at[f : f + max(1, (1 << 20) // (hi - lo))]
                    key = (part[some] * (-2 * _ROW)) @ r[lo:hi].T + norm[lo:hi] + own[some][:, None]
                    if hi - lo > k:
                        key = np.partition(key, k - 1, axis=1)[:, :k]
                    mine[some] = np.sort(np.concatenate([mine[some], key], axis=1), axis=1)[:, :k]
    whole = np.isfinite(best)
    rows = np.where(whole, np.mod(np.where(whole, best, 0), _ROW), 0).astype(np.int64)
    dist = np.where(whole, np.floor(np.where(whole, best, 0) / _ROW), np.inf)
    dist[dist > worst[:, None]] = np.inf
    return dist, rows, scanned


FOUND = "qid bigint, near array<struct<dist: bigint, vi: bigint, label: int>>, scanned bigint"


def _scan(table: str, tags: list[int], asks: DataFrame, k: int, waves: int) -> DataFrame:
    """FOUND: at most k candidates of each of ``asks`` (shard, qid, worst, v0..v13) in its shard, nearest first."""
    spark = asks.sparkSession
    refs = spark.table(table).filter(F.col("tag").isin(tags)).select("shard", "cid", "vi", "label", *VECTOR)

    def run(refs: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(asks):
            return out.empty_table()
        matrix = lambda t: np.stack([t.column(v).to_numpy() for v in VECTOR], axis=1).astype(np.float64) if len(t) else np.zeros((0, DIMS))
        qid, q, worst = asks.column("qid").to_numpy(), matrix(asks), asks.column("worst").to_numpy().astype(np.float64)
        cid, vi = refs.column("cid").to_numpy(), refs.column("vi").to_numpy()
        order = np.lexsort((vi, cid))  # vi is the place by (cid, id) in the tag, so this is the order of vi too
        if len(refs):
            dist, rows, scanned = scan_clusters(q, np.where(worst < 0, np.inf, worst), matrix(refs)[order], cid[order], k)
        else:
            dist, rows, scanned = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64), np.zeros(len(q), np.int64)
        there = np.isfinite(dist)
        picked = order[rows[there]]
        each = pa.StructArray.from_arrays([pa.array(dist[there].astype(np.int64)), pa.array(vi[picked]), pa.array(refs.column("label").to_numpy()[picked].astype(np.int32))], fields=list(near))
        offsets = np.r_[0, np.cumsum(there.sum(axis=1))].astype(np.int32)
        return pa.table([pa.array(qid), pa.ListArray.from_arrays(pa.array(offsets), each), pa.array(scanned)], schema=out)

    near = pa.struct([("dist", pa.int64()), ("vi", pa.int64()), ("label", pa.int32())])
    out = pa.schema([("qid", pa.int64()), ("near", pa.list_(near)), ("scanned", pa.int64())])
    found = None
    for wave in range(waves):
        some = asks if waves == 1 else asks.filter(F.pmod(F.hash("qid"), F.lit(waves)) == wave)
        part = refs.groupBy("shard").cogroup(some.groupBy("shard")).applyInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def _shards_to_ask(queries: DataFrame, placed: DataFrame, first: bool) -> DataFrame:
    """(shard, etag, qid, worst, v0..v13): the shard of the nearest box, or all others with a box no farther than ``worst`` (-1: any)."""
    rows = placed.select("tag", "cid", "shard", "parts", "copies", *MINS, *MAXS).orderBy("tag", "cid").toArrow()  # at most MAX_CLUSTERS a tag
    tags, shard, parts = (rows.column(c).to_numpy() for c in ("tag", "shard", "parts"))
    copies = max(rows.column("copies").to_pylist(), default=1)
    low, high = (np.stack([rows.column(m).to_numpy() for m in ms], axis=1).astype(np.float64) for ms in (MINS, MAXS))
    sent = queries.sparkSession.sparkContext.broadcast((tags, shard, parts, low, high))

    def run(batches):
        tags, shard, parts, low, high = sent.value
        for batch in batches:
            etag, worst = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.float64)
            v = np.stack([batch.column(3 + i).to_numpy() for i in range(DIMS)], axis=1)
            for t in np.unique(etag):
                mine, c = np.flatnonzero(etag == t), np.flatnonzero(tags == t)
                each = np.repeat(c, parts[c])  # a cluster's parts have its box
                number = shard[each] + np.arange(len(each)) - np.repeat(np.cumsum(np.r_[0, parts[c][:-1]]), parts[c])
                for at in np.array_split(mine, max(1, len(mine) * len(each) >> 18)):
                    bound = np.zeros((len(at), len(each)))
                    for d in range(DIMS):
                        x = v[at, d].astype(np.float64)[:, None]
                        gap = np.maximum(np.maximum(low[each, d][None, :] - x, x - high[each, d][None, :]), 0)
                        bound += gap * gap
                    home = number[bound.argmin(axis=1)]
                    if first:
                        q, s = np.arange(len(at)), home
                    else:
                        limit = np.where(worst[at] < 0, np.inf, worst[at])
                        q, c_ = np.nonzero((bound <= limit[:, None]) & (number[None, :] != home[:, None]))
                        pair = np.unique(q * (int(number.max()) + 1) + number[c_]) if len(q) else np.zeros(0, np.int64)
                        q, s = pair // (int(number.max()) + 1), pair % (int(number.max()) + 1)
                    s = s * copies + np.random.default_rng(len(s)).integers(0, copies, len(s)) if copies > 1 else s
                    yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(np.full(len(s), t, np.int32)), batch.column(0).take(pa.array(at[q])), pa.array(worst[at[q]].astype(np.int64)), *(pa.array(v[at[q], i]) for i in range(DIMS))], ["shard", "etag", "qid", "worst", *VECTOR])

    schema = "shard int, etag int, qid bigint, worst bigint, " + ", ".join(f"{c} smallint" for c in VECTOR)
    return queries.select("qid", "etag", "worst", *VECTOR).mapInArrow(run, schema)


def search_best_first(queries: DataFrame, table: str, placed: DataFrame, k: int = K, wave_rows: int = WAVE_ROWS) -> DataFrame:
    """qid, etag, votes, near, scanned: the exact k nearest references of each query's effective tag, and the clusters looked at.

    Equal queries are searched as one, and each has the clusters looked at for it.
    ``queries``: qid, tag, v0..v13; ``table`` and ``placed`` from ``store_shards``. A query whose tag leads to no partition has no
    neighbours, no votes and nothing scanned.
    """
    q = with_effective_tag(queries, placed)
    distinct = distinct_queries(q)
    asked = distinct.withColumn("worst", F.lit(-1).cast("bigint"))

    def scan(asks: DataFrame) -> DataFrame:
        asks = cut(asks)
        sizes = asks.groupBy("shard", "etag").count().groupBy("etag").agg(F.max("count").alias("n")).collect()  # at most 16 rows
        # only the partitions of the tags asked are read
        return _scan(table, [r.etag for r in sizes], asks.drop("etag"), k, max(1, -(-max((r.n for r in sizes), default=1) // wave_rows)))

    best = scan(_shards_to_ask(asked, placed, first=True))
    if placed.groupBy("tag").agg((F.countDistinct("shard") + F.max("parts")).alias("n")).filter("n > 2").count():  # tags of several shards
        home = cut(best)
        last = F.when(F.size("near") >= k, F.element_at("near", k)["dist"]).otherwise(-1)
        bounded = asked.drop("worst").join(home, "qid", "left").withColumn("worst", F.coalesce(last, F.lit(-1)))
        more = scan(_shards_to_ask(bounded, placed, first=False))
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
        best = home.unionByName(more).groupBy("qid").agg(merged.alias("near"), F.sum("scanned").alias("scanned"))
    votes = F.coalesce(F.aggregate("near", F.lit(0), lambda s, x: s + x["label"]), F.lit(0))
    best = for_equals(q, distinct, best)
    return q.select("qid", "etag").join(best, "qid", "left").select("qid", "etag", votes.alias("votes"), "near", F.coalesce("scanned", F.lit(0)).alias("scanned"))
