"""References in cells: the same neighbours, looked for only where they can be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import cells, knn
from riskloom.operators.features import DIMS, VECTOR
from riskloom.operators.index_build import build_index


def brute(q, worst, r, vi, k=5):
    d = ((r - q) ** 2).sum(axis=1)
    order = np.lexsort((vi, d))[:k]
    return [(int(d[i]), int(vi[i])) for i in order if d[i] <= worst]


@pytest.mark.parametrize("spread", [3, 2000])
def test_a_block_finds_the_nearest_of_all_its_leaves(monkeypatch, spread):
    monkeypatch.setattr(knn, "LEAF_ROWS", 16)
    rng = np.random.default_rng(2)
    r, vi = rng.integers(0, spread, (700, DIMS)).astype(float), rng.permutation(700)  # small numbers: many ties
    r[:, 5:] = 7
    q, worst = rng.integers(0, spread, (90, DIMS)).astype(float), np.where(np.arange(90) % 2, 1 << 62, spread * spread)
    block = knn._Block(r, vi, vi % 2)
    row, ref, dist = block.topk(q, worst, 5)
    assert (block.label == block.vi % 2).all() and len(block.ends) > 20
    for i in range(90):
        assert [(int(d), int(v)) for d, v in zip(dist[row == i], block.vi[ref[row == i]], strict=True)] == brute(q[i], worst[i], r, vi)


def test_rows_descend_to_the_leaf_they_grew_in():
    x = np.random.default_rng(3).integers(0, 9, (500, DIMS))
    nodes, leaves = cells.grow(x, 10)
    found = cells.descend(np.array(nodes), np.zeros(500, np.int64), x)
    assert sorted(np.concatenate(leaves)) == list(range(500)) and all((found[rows] == i).all() for i, rows in enumerate(leaves))
    assert cells.grow(np.zeros((40, DIMS), np.int64), 10)[0] == [[-1, 0, 0, 0]]  # equal rows can't be divided


@pytest.mark.parametrize("assigner", [None, "grid"])
def test_queries_go_to_few_blocks(spark, monkeypatch, assigner):
    """Each query met every block of its tag (or of twelve of 64 clusters): pairs grew with the square of the rows."""
    for name, value in (("FEW_QUERIES", 0), ("FEW_PROBES", 0), ("BLOCK_ROWS", 64)):
        monkeypatch.setattr(knn, name, value)
    met, plain = [], knn.block_topk
    monkeypatch.setattr(knn, "block_topk", lambda q, r, k: (met.append(q.select("block", "id").count()), plain(q, r, k))[1])
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        v = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(9 if i % 2 else 4000)) if i < 4 else F.lit(0)).cast("smallint").alias(n) for i, n in enumerate(VECTOR)]
        rows = spark.range(4400).select("id", F.lit(3).alias("tag"), (F.col("id") % 2).cast("int").alias("label"), *v)
        refs, clusters = build_index(rows.filter("id % 11 <> 0").withColumnRenamed("id", "vec_id"), assigner="grid")
        queries = rows.filter("id % 11 = 0").withColumnRenamed("id", "qid").drop("label")
        found = (knn.search_ivf(queries, refs, clusters, probes=4) if assigner else knn.search_exact(queries, refs, clusters)).collect()
        assert sum(met) < 400 * 8  # before: 50,000 rows exact, 27,789 probing
        r = refs.toPandas()
        x, exact = r[VECTOR].to_numpy(float), [f for f in found if not assigner or f.repaired]
        asks = {q.qid: np.array([q[n] for n in VECTOR], float) for q in queries.collect()}
        assert len(found) == 400 and len(exact) > 100
        for f in exact:
            assert [(n.dist, n.vi) for n in f.near] == brute(asks[f.qid], np.inf, x, r.vi.to_numpy())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
