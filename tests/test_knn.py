"""Search against brute force, index building and storage."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import best_first, index_build, knn
from riskloom.operators.best_first import open_shards, search_best_first, store_shards
from riskloom.operators.features import DIMS, VECTOR
from riskloom.operators.index_build import MAXS, MINS, assign_centroids, build_index, check_index, cluster_table, read_index, storage_order, train_centroids, write_index
from riskloom.plans.score import event_index
from riskloom.queries import ann_recall
from riskloom.session import shared_dir
from riskloom.sources.index_binary import decode, encode, read_binary_index

SHORTS = ", ".join(f"{v} smallint" for v in VECTOR)


def vectors(spark, rng, n, tags, ident="vec_id", label=True):
    v = rng.integers(0, 60, (n, DIMS)) * 100
    rows = [(i, int(rng.choice(tags)), *map(int, v[i]), *([int(rng.integers(0, 2))] if label else [])) for i in range(n)]
    return spark.createDataFrame(rows, f"{ident} bigint, tag int, {SHORTS}" + (", label int" if label else "")), rows


def brute(queries, refs, k=5):
    """By qid the (dist, vi, label) of the nearest, from rows (tag, vi, v.., label)."""
    out = {}
    for q in queries:
        tag = q[1] if q[1] < 12 else q[1] & 7
        near = sorted((sum((a - b) ** 2 for a, b in zip(q[2:], r[2 : 2 + DIMS], strict=True)), r[1], r[-1]) for r in refs if r[0] == tag)
        out[q[0]] = near[:k]
    return out


@pytest.mark.parametrize("block_rows, few", [(1 << 15, 0), (40, 0), (1 << 15, 1 << 17), (40, 1 << 17)])
def test_exact_and_ivf(spark, monkeypatch, block_rows, few):
    monkeypatch.setattr(knn, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(knn, "FEW_QUERIES", few)
    monkeypatch.setattr(knn, "FEW_PROBES", few)
    rng = np.random.default_rng(5)
    known, _ = vectors(spark, rng, 900, [0, 3, 5])
    queries, rows = vectors(spark, rng, 60, [0, 3, 5, 13, 9], "qid", label=False)
    refs, clusters = build_index(known)
    want = brute(rows, [(r.tag, r.vi, *[r[v] for v in VECTOR], r.label) for r in refs.collect()])
    exact = {r.qid: r for r in knn.search_exact(queries, refs, clusters).collect()}
    assert {i: [(n.dist, n.vi, n.label) for n in r.near or []] for i, r in exact.items()} == want
    assert all(r.votes == sum(x[2] for x in want[i]) for i, r in exact.items())
    assert all(r.etag is None and r.votes == 0 for i, r in exact.items() if rows[i][1] == 9)
    found = knn.search_ivf(queries, refs, clusters, probes=3).collect()
    assert len(found) == 60 and any(r.repaired for r in found)
    for r in found:
        if r.repaired:
            assert [(n.dist, n.vi) for n in r.near] == [(x[0], x[1]) for x in want[r.qid]] and r.votes == exact[r.qid].votes
    r = knn.recall(knn.search_ivf(queries, refs, clusters, probes=64), knn.search_exact(queries, refs, clusters)).first()
    assert r.recall == 1.0 and r.same_votes == 1.0


def test_few_queries_shuffle_no_references(spark):
    rng = np.random.default_rng(6)
    known, _ = vectors(spark, rng, 500, [0, 3])
    queries, _ = vectors(spark, rng, 5, [0, 3], "qid", label=False)
    refs, clusters = build_index(known)
    q = knn.with_effective_tag(queries, clusters).select("qid", "etag", *VECTOR)
    plan = knn.scan_beside(q.toArrow(), refs.withColumnRenamed("tag", "etag"), ["etag"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_fifth_neighbour_is_kept(spark):
    """Distances 1, 2, 3, 4, 5, 100 keep the five smallest."""
    rows = [(i, 0, *([0] * 13), int(d), i % 2) for i, d in enumerate([1, 2, 3, 4, 5, 100])]
    refs, clusters = build_index(spark.createDataFrame(rows, f"vec_id bigint, tag int, {SHORTS}, label int"))
    q = spark.createDataFrame([(1, 0, *([0] * 14))], f"qid bigint, tag int, {SHORTS}")
    assert [n.dist for n in knn.search_exact(q, refs, clusters).first().near] == [1, 4, 9, 16, 25]


def test_distance_and_boxes(spark):
    a = [F.lit(0)] * 2 + [F.lit(-10000 if i % 2 else 0) for i in range(12)]
    b = [F.lit(0)] * 2 + [F.lit(0 if i % 2 else 10000) for i in range(12)]
    assert spark.range(1).select(knn.distance(a, b)).first()[0] == 12 * 10**8
    wide = spark.range(1).select(knn.distance([F.lit(10000)] * 14, [F.lit(0)] * 12 + [F.lit(-10000)] * 2)).first()[0]
    assert wide == 2_000_000_000
    inside = spark.range(1).select(knn.lower_bound([F.lit(5)] * 3, [F.lit(0)] * 3, [F.lit(9)] * 3), knn.lower_bound([F.lit(12), F.lit(-2)], [F.lit(0)] * 2, [F.lit(9)] * 2)).first()
    assert tuple(inside) == (0, 13)


def test_storage_and_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    known, _ = vectors(spark, rng, 300, [0, 1])
    refs, clusters = build_index(known)
    by = {}
    for r in refs.orderBy("tag", "vi").collect():
        by.setdefault(r.tag, []).append((r.vi, r.cid))
    for rows in by.values():
        assert [v for v, _ in rows] == list(range(len(rows))) and [c for _, c in rows] == sorted(c for _, c in rows)
    write_index(refs, clusters, str(tmp_path / "index"))
    back, again = read_index(spark, str(tmp_path / "index"), (0, 1))
    assert sorted(map(tuple, back.select(refs.columns).collect())) == sorted(map(tuple, refs.collect())) and again.count() == clusters.count()
    with pytest.raises(ValueError, match="without tags"):
        check_index(clusters)
    with pytest.raises(ValueError, match="gaps"):
        check_index(clusters.withColumn("n", F.col("n") + 1), (0, 1))


def test_binary_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    known, _ = vectors(spark, rng, 120, [3])
    refs, clusters = build_index(known)
    c, r = clusters.orderBy("cid").toPandas(), refs.orderBy("vi").toPandas()
    c = c.assign(cid=range(len(c)))
    pad = lambda m: np.hstack([m, np.zeros((len(m), 2))])
    raw = encode(np.r_[c["first"].to_numpy(), len(r)], pad(c[MINS].to_numpy()), pad(c[MAXS].to_numpy()), pad(r[VECTOR].to_numpy()), r.label.to_numpy())
    (tmp_path / "ix3.bin").write_bytes(raw)
    back, boxes = read_binary_index(spark, {3: str(tmp_path / "ix3.bin")})
    assert back.select("tag", "vi", *VECTOR, "label").orderBy("vi").collect() == refs.select("tag", "vi", *VECTOR, "label").orderBy("vi").collect()
    assert [tuple(x) for x in boxes.select(*MINS, *MAXS, "n").orderBy("cid").collect()] == [tuple(x) for x in clusters.orderBy("cid").select(*MINS, *MAXS, "n").collect()]
    for bad in (b"", b"WRONG" * 20, raw[:8] + b"\0" * 100, raw[: len(raw) // 2]):
        with pytest.raises(ValueError):
            decode(bad, "x")


def test_kmeans(spark):
    """Against the same steps in plain numpy: seeds by MD5, whole means, centroids without vectors gone."""
    rng = np.random.default_rng(3)
    known, rows = vectors(spark, rng, 400, [0, 2])
    centroids = train_centroids(known.repartition(5), rounds=3)
    for t in (0, 2):
        mine = sorted((hashlib.md5(str(r[0]).encode()).hexdigest(), r[2 : 2 + DIMS]) for r in rows if r[1] == t)
        x = np.array([v for _, v in mine], dtype=np.int64)
        c = x[: math.isqrt(len(x))]
        for _ in range(3):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[own == k].sum(axis=0) // (own == k).sum() for k in range(len(c)) if (own == k).any()])
        assert (centroids[t] == c).all()
    got = assign_centroids(known, centroids)
    for r in got.limit(40).collect():
        d = ((centroids[r.tag] - np.array([r[v] for v in VECTOR])) ** 2).sum(axis=1)
        assert d[r.cid] == d.min() and d.argmin() == r.cid
    assert cluster_table(storage_order(got, "vec_id")).agg(F.sum("n")).first()[0] == 400
    assert train_centroids(known.limit(0)) == {}


def test_kmeans_looks_at_each_vector_once(spark):
    """Twenty copies of each vector count twenty times, but distances are taken for one; all rows get their cluster."""
    known, rows = vectors(spark, np.random.default_rng(4), 60, [3])
    copies = known.crossJoin(spark.range(20)).withColumn("vec_id", F.col("vec_id") + 1000 * F.col("id")).drop("id")
    distinct = index_build.distinct_vectors(copies)
    assert [(r.n, r.times) for r in distinct.groupBy("n").agg(F.count("*").alias("times")).collect()] == [(20, 60)]
    assert index_build._nearest_sums(distinct, {3: np.zeros((1, DIMS))}).agg(F.sum("n"), F.sum("s0")).first() == (1200, 20 * sum(r[2] for r in rows))
    centroids = train_centroids(copies, rounds=2)
    got = assign_centroids(copies, centroids).collect()
    assert len(got) == 1200 and all(r.cid == ((centroids[3] - np.array([r[v] for v in VECTOR])) ** 2).sum(axis=1).argmin() for r in got)
    plan = assign_centroids(copies, centroids)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")  # clusters are found beside the rows, not for each of them


def test_copies_are_not_searched_again(spark, monkeypatch):
    """Of twenty copies of each reference five are scanned, of ten copies of a query one asks; each has the right answer."""
    monkeypatch.setattr(knn, "FEW_QUERIES", 0)
    monkeypatch.setattr(knn, "FEW_PROBES", 0)
    seen, plain = [], knn.block_topk

    def counted(queries, refs, k):
        seen.append((queries.select("id").distinct().count(), refs.select("block", "id").count()))
        return plain(queries, refs, k)

    monkeypatch.setattr(knn, "block_topk", counted)
    rng = np.random.default_rng(6)
    known, _ = vectors(spark, rng, 50, [3])
    asks, rows = vectors(spark, rng, 6, [3, 9], "qid", label=False)
    copies = lambda df, n, ident: df.crossJoin(spark.range(n)).withColumn(ident, F.col(ident) + 1000 * F.col("id")).drop("id")
    refs, clusters = build_index(copies(known, 20, "vec_id"))
    queries = copies(asks, 10, "qid")
    want = brute([(r[0] + 1000 * i, *r[1:]) for r in rows for i in range(10)], [(r.tag, r.vi, *[r[v] for v in VECTOR], r.label) for r in refs.collect()])
    exact = knn.search_exact(queries, refs, clusters).collect()
    assert len(exact) == 60 and {r.qid: [(n.dist, n.vi, n.label) for n in r.near or []] for r in exact} == want
    found = knn.search_ivf(queries, refs, clusters, probes=1 << 12).collect()
    assert len(found) == 60 and {r.qid: [(n.dist, n.vi, n.label) for n in r.near or []] for r in found} == want
    asked = sum(r[1] == 3 for r in rows)
    assert 0 < asked < 6 and seen[0] == seen[1] == (asked, 250)


@pytest.mark.parametrize("shard_rows, wave_rows", [(1 << 18, 1 << 18), (60, 7), (9, 1 << 18)])
def test_best_first(spark, shard_rows, wave_rows):
    """Many shards, clusters over several shards, waves, ties, tags without an index: always the exact five."""
    rng = np.random.default_rng(8)
    known, _ = vectors(spark, rng, 900, [0, 3, 5])
    few, _ = vectors(spark, rng, 3, [1])
    known = known.unionByName(few.withColumn("vec_id", F.col("vec_id") + 5000)).unionByName(known.limit(200).withColumn("vec_id", F.col("vec_id") + 9000))
    queries, rows = vectors(spark, rng, 80, [0, 1, 3, 5, 13, 14], "qid", label=False)
    refs, clusters = build_index(known)
    table, placed = store_shards(refs, clusters, shard_rows, buckets=3)
    got = {r.qid: r for r in search_best_first(queries, table, placed, wave_rows=wave_rows).collect()}
    exact = {r.qid: r for r in knn.search_exact(queries, refs, clusters).collect()}
    assert set(got) == set(exact) and any(r.etag is None for r in got.values())
    for i, r in got.items():
        assert (r.votes, r.near, r.etag) == (exact[i].votes, exact[i].near, exact[i].etag)
        assert (r.scanned > 0) == (r.etag is not None)
    assert search_best_first(queries.limit(0), table, placed).count() == 0


def test_best_first_asks_once_for_equal_queries(spark, monkeypatch):
    seen, plain = [], best_first._scan
    monkeypatch.setattr(best_first, "_scan", lambda table, tags, asks, *more: (seen.append(asks.count()), plain(table, tags, asks, *more))[1])
    rng = np.random.default_rng(7)
    refs, clusters = build_index(vectors(spark, rng, 80, [3])[0])
    queries, _ = vectors(spark, rng, 5, [3], "qid", label=False)
    queries = queries.crossJoin(spark.range(9)).withColumn("qid", F.col("qid") + 100 * F.col("id")).drop("id")
    got = {r.qid: r.near for r in search_best_first(queries, *store_shards(refs, clusters, buckets=2)).collect()}
    assert len(got) == 45 and got == {r.qid: r.near for r in knn.search_exact(queries, refs, clusters).collect()} and seen == [5]


def test_best_first_moves_no_references(spark, sf_dir):
    """Over the stored shards no Exchange stands above the references, and only the tags asked are read."""
    queries, index = event_index(spark, sf_dir, "kmeans")
    table, placed = store_shards(*index)
    asks = queries.filter("tag = 3").withColumn("etag", F.col("tag")).withColumn("worst", F.lit(-1).cast("bigint"))
    plan = best_first._scan(table, [3], best_first._shards_to_ask(asks, placed, True).drop("etag"), 5, 1)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("FlatMapCoGroupsInArrow") : plan.index("SelectedBucketsCount")]
    assert "Exchange" not in side and "Bucketed: true" in side and "PartitionFilters: [isnotnull(tag" in side
    again = open_shards(spark, f"{shared_dir(spark)}/{table}", max(4, 2 * spark.sparkContext.defaultParallelism))
    first, second = (sorted(map(repr, search_best_first(queries, t, placed).collect())) for t in (table, again))
    assert first == second and first


def test_probing_is_near_exact(spark):
    """Recall and equal votes of the k-means index at sf0.01."""
    r = ann_recall(spark, "/root/testdata/sf0.01").first()
    assert r.queries == 1000 and r.recall >= 0.99 and r.same_votes >= 0.99


def test_empty_queries(spark, sf_dir):
    queries, index = event_index(spark, sf_dir)
    assert knn.search_exact(queries.limit(0), *index).count() == 0
    assert knn.search_ivf(queries.limit(0), *index).count() == 0


def test_embedding_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(0, 3, 4).astype(float).tolist(), int(i % 3)) for i in range(300)]  # small numbers: many ties
    rows += [(1000 + i, rng.integers(0, 3, 7).astype(float).tolist(), 1) for i in range(4)]  # fewer than k of a length
    rows += [(None, rows[0][1], 1), (None, None, 2)]  # without an id: neither asks nor is found
    rows += [(2000, None, 1), (2001, [], 1), (2002, [1.0, None, 2.0, 0.0], 1), (2003, [float("nan"), 0.0, 0.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "id bigint, embedding array<float>, label int")
    asks = [i for i, *_ in rows if i is not None and (i % 50 == 0 or i >= 1000)]
    got = {}
    for r in knn.embedding_neighbours(table.filter(F.col("id").isin(asks) | F.col("id").isNull()), table, block_rows=64).collect():
        got.setdefault(r.qid, set()).add((r.rid, r.label))
    good = [(i, np.array(e), lab) for i, e, lab in rows if i is not None and e and None not in e and not any(map(math.isnan, e))]
    want = {}
    for i, e, _ in good:
        if i in asks:
            near = sorted((round(float(np.sqrt(((e - f) ** 2).sum())), 6), j, lab) for j, f, lab in good if j != i and len(f) == len(e))[:5]
            want[i] = {(j, lab) for _, j, lab in near}
    assert got == want
    assert not knn.embedding_neighbours(table.limit(0), table).count()
    assert not knn.embedding_neighbours(table, table.limit(0)).count()
