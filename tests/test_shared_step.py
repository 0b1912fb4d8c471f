"""The step that the probing searches share: seeds of k-means and what is stored of the references."""

import hashlib

import pytest
from pyspark.sql import functions as F

from riskloom.operators import index_build, knn
from riskloom.operators.features import VECTOR


def vectors(spark, n, ident):
    return spark.range(n).select(ident.alias("vec_id"), (F.col("id") % 3 % 2).cast("int").alias("tag"), *[((F.col("id") * (7 + i)) % 997).cast("smallint").alias(v) for i, v in enumerate(VECTOR)], (F.col("id") % 2).cast("int").alias("label"))


@pytest.mark.parametrize("equal", [False, True])
def test_seeds_are_ranked_among_few_rows(spark, equal):
    """A whole tag was sorted in one task; where ids are equal the hash bound finds too few, and all rows are ranked."""
    rows = vectors(spark, 20000, F.lit(7) if equal else F.col("id"))
    held = {r.tag: r["count"] for r in rows.groupBy("tag").count().collect()}
    found = index_build._seeds(rows, "vec_id", held).select("tag", "md5").collect()
    ids = rows.select("vec_id", "tag").collect()
    for tag, n in held.items():
        first = sorted(hashlib.md5(str(r.vec_id).encode()).hexdigest() for r in ids if r.tag == tag)[: index_build.cluster_count(n)]
        assert sorted(r.md5 for r in found if r.tag == tag)[: len(first)] == first
    assert len(found) == 20000 if equal else len(found) < 2000


def test_both_passes_share_what_is_stored(spark, monkeypatch):
    """The completion of mixed votes stored the earliest references a second time."""
    calls, own = [], knn.earliest
    monkeypatch.setattr(knn, "earliest", lambda *a: calls.append(a) or own(*a))
    monkeypatch.setattr(knn, "FEW_PROBES", 0)
    rows = vectors(spark, 2000, F.col("id"))
    queries = rows.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "qid").drop("label")
    index = index_build.build_index(rows.filter("vec_id % 10 <> 0"))
    assert knn.search_ivf(queries, *index, probes=2).filter("repaired").count() and len(calls) == 1
