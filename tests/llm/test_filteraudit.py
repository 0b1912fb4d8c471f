"""The audit of filters against plain loops over all orders."""

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from riskloom.llm.filteraudit import COUNTS, audit, failed_sets, order_steps, words


def brute(rows, letters):
    """rows: (part, failed letters, good, toxic)."""
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations(letters):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = set(order[: step - 1])
                out[part, "".join(order), step] = [
                    len(left) - len(gone),
                    len(gone),
                    sum(f in r[1] and bool(before & set(r[1])) for r in mine),
                    sum(r[1] == f for r in mine),
                    sum(r[2] for r in gone),
                    sum(r[3] for r in gone),
                ]
                shapley[part, f] += len(gone)
                left = [r for r in left if f not in r[1]]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*COUNTS, "shapley")) for r in df.collect()}


def test_audit_is_the_chain_itself(spark):
    rng = random.Random(3)
    rows = [(p, "".join(c for c in "ABCDE" if rng.random() < 0.35), rng.random() < 0.5, rng.random() < 0.2) for p in ("x", "", "y") for _ in range(60)]
    df = spark.createDataFrame([(p, sum(1 << "ABCDE".index(c) for c in f), g, t) for p, f, g, t in rows], "part string, failed int, good boolean, toxic boolean")
    got = result(audit(df))
    assert len(got) == 3 * 600 and got == brute(rows, "ABCDE")
    assert len(order_steps("ABCDE")) == 600


def test_failures_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(3, None, "s"), (1, "", None), (2, long, "s"), (5, long, ""), (5, long, "s"), (None, long, "s"), (7, "x " * 300 + "#", "s"), (8, long + " AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", "t"), (9, "a\x0bb\x1cc", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("digest", F.lit(1)).withColumn("failed", F.lit(1)).withColumn("body", F.lit("b"))
    labels = spark.createDataFrame([(2, 1, 0), (2, None, 1), (3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    got = sorted((r["part"], r["failed"], r["good"], r["toxic"]) for r in failed_sets(docs, labels).collect())
    # A 1, B 2, C 4, D 8, E 16: the null text is a copy of the empty one
    assert got == sorted([("s", 1 + 16, False, False), ("", 1, False, False), ("s", 0, True, True), ("", 16, False, False), ("s", 16, False, False), ("s", 0, False, False), ("s", 2 + 8, False, False), ("t", 4, False, False), ("t", 1, False, False)])


def test_words_and_empty_tables(spark):
    df = spark.createDataFrame([(" a\tb\x0b\x0cc\r\n",), (" \n",), ("",), ("a b c",)], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [["a", "b", "c"], [], [], ["a b", "c"]]
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit(failed_sets(none)).collect() == []
    with pytest.raises(ValueError):
        audit(failed_sets(none), "AA")


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "s"), (2, "word " * 400_000, "s")], "doc_id long, text string, source string")
    assert sorted(r["failed"] for r in failed_sets(docs).collect()) == [2, 18]
