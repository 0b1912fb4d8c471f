import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.llm import quality as q
from riskloom.llm.queries import op6_importance
from riskloom.llm.words import hash_tokens, mix


def corpus(rng, n=300):
    vocab = ["alpha", "beta", "gamma", "delta", "the", "of", "and"]
    docs, labels = [], []
    for i in range(n):
        ws = [rng.choice(vocab) for _ in range(rng.randrange(8, 60))]
        good = i % 4 != 0
        if not good:
            ws = [[w.upper() + "!!" for w in ws], [w + "###" for w in ws], [ws[0]] * len(ws), " | ".join(ws).split(" ")][i // 4 % 4]
        docs.append((i, " ".join(ws)))
        labels.append((i, int(good)))
    return docs, labels


def test_parts_good_from_bad(spark):
    docs, labels = corpus(random.Random(3))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = q.fit(d, spark.createDataFrame(labels[:150], "doc_id bigint, quality int"))
    got = {r.doc_id: r.accepted for r in q.weigh(d, model).collect()}
    assert sum(got[i] == bool(y) for i, y in labels) >= 0.98 * len(labels)


WORDS = re.compile("[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff \t\n\x0b\x0c\r]+")


def test_ngrams_by_hand(spark):
    """Counts of words and of pairs of words are those of plain counters over the same words."""
    docs = [t for _, t in corpus(random.Random(4), 80)[0]] + [None, "", "Ab,cd... x!\ny", "één één één"]
    counts = q.count_ngrams(spark.createDataFrame([(t,) for t in docs], "text string"))
    words, pairs = Counter(), Counter()
    for t in docs:
        ws = WORDS.findall(t or "")
        words.update(ws)
        pairs.update(zip([None, *ws], ws, strict=False))
    h = lambda w: int(hash_tokens([w.encode()])[0]) if w is not None else 0
    want = np.zeros(q.FAMILIES[1].stop)
    for w, n in words.items():
        want[h(w) % q.WORD_BUCKETS] += n
    for (a, b), n in pairs.items():
        code = np.array([(3 * h(a) + h(b)) % 2**64], dtype=np.uint64)
        want[q.WORD_BUCKETS + int(mix(code)[0]) % q.PAIR_BUCKETS] += n
    assert (counts[: len(want)] == want).all() and counts[q.FAMILIES[2]].sum() == sum(len((t or "").split()) for t in docs)


def test_weights_are_sums_of_log_ratios(spark):
    docs, labels = corpus(random.Random(4), 80)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    for shapes in (True, False):
        model = q.fit(d, spark.createDataFrame(labels, "doc_id bigint, quality int"), shapes=shapes)
        for r in q.weigh(d, model).collect():
            own = q.count_ngrams(spark.createDataFrame([(docs[r.doc_id][1],)], "text string")) if r.doc_id < 4 else None
            if own is not None:
                last = q.FAMILIES[2 if shapes else 1].stop
                assert abs(r.log_weight - (own * model.ratio)[:last].sum()) < 1e-3
                assert r.n_words == own[q.FAMILIES[0]].sum() and abs(r.mean_weight - r.log_weight / (r.n_words + q.NEUTRAL)) < 1e-9
    raw, target = np.zeros(q.BUCKETS), np.zeros(q.BUCKETS)
    raw[:4], target[:4] = [10, 20, 30, 0], [5, 0, 0, 0]
    ratio = q.log_ratio(target, raw)
    assert ratio[0] > 0 > ratio[1] and abs(ratio[1] - ratio[2]) < 1e-9
    for f in q.FAMILIES:
        r = (raw[f] + q.ADD) / (raw[f] + q.ADD).sum()
        assert abs((np.exp(ratio[f]) * r).sum() - 1) < 1e-9


def test_sampling_follows_the_exact_law(spark):
    """How often each row of a small pool is drawn, against drawing without replacement in proportion to the weights."""
    means, k, runs = [0.3, 0.0, -0.1, 0.2, -0.4], 2, 6000
    w = np.exp(np.array(means) * q.STRENGTH)
    p = w / w.sum()
    want = [p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(5) if j != i) for i in range(5)]
    pool = spark.range(runs).select("id", F.posexplode(F.array(*map(F.lit, means))).alias("i", "m"))
    keyed = pool.withColumn("v", F.col("m") * q.STRENGTH + q.gumbel(F.struct("i", "id"), 20))
    drawn = keyed.withColumn("nr", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("v")))).filter(F.col("nr") <= k).groupBy("i").count().collect()
    for r in drawn:
        assert abs(r["count"] / runs - want[r.i]) < 4 * (want[r.i] * (1 - want[r.i]) / runs) ** 0.5


def test_noise_decides_and_length_does_not(spark, sf_dir):
    """Among accepted rows the draw is far from a sort by weight, and drawn texts are as long as the others."""
    rows = op6_importance(spark, sf_dir).collect()
    k = sum(r.sampled for r in rows)
    assert k == len(rows) // 4
    top = {r.doc_id for r in sorted(rows, key=lambda r: -r.mean_weight)[:k]}
    assert len(top & {r.doc_id for r in rows if r.sampled}) < 0.8 * k
    good = [r for r in rows if r.accepted]
    size = lambda on: np.median([r.n_words for r in good if r.sampled == on])
    assert 0.5 < size(True) / size(False) < 2
    assert sum(r.sampled for r in rows if not r.accepted) < 0.1 * k
    keys = sorted((r.gumbel_key for r in rows), reverse=True)
    assert all(r.sampled == (r.gumbel_key >= keys[k - 1]) for r in rows)


@pytest.mark.parametrize("shapes, bad", [(True, 0.2), (False, 0.5)])
def test_held_out_labels(spark, shapes, bad):
    """Labels that the fit has not seen: a fifth of those of sf0.01."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = q.fit(docs, labels.filter(~held), shapes=shapes)
    r = q.weigh(docs, model).join(labels.filter(held), "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("kept")).collect()
    kept = {x.quality: x.kept for x in r}
    assert kept[1] >= 0.95 and kept[0] <= bad


def test_top_k_is_exact(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 10) for _ in range(3000)] + [1.5] * 500 + [1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 700, 3501):
        assert q.kth_largest(df, k, bins=7, small=5) == ranked[k - 1]
    assert q.kth_largest(df, 4000) is None


def test_edge_cases(spark):
    docs, labels = corpus(random.Random(6), 60)
    odd = docs + [(100, None), (101, ""), (102, " \n"), (103, "alpha " * 50000), (5, docs[5][1]), (None, docs[6][1])]
    d = spark.createDataFrame([(i, t, True) for i, t in odd], "doc_id bigint, text string, accepted boolean")
    model = q.fit(d, spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id bigint, quality int"))
    got = q.resample(q.weigh(d, model), 10)
    rows = got.collect()
    assert len(rows) == len(odd) and got.columns == ["doc_id", "text", "n_words", "log_weight", "mean_weight", "accepted", "gumbel_key", "sampled", "plain_key", "sampled_plain"]
    assert not any(r.accepted for r in rows if r.doc_id in (100, 101, 102, 103))
    assert sum(r.sampled for r in rows) == sum(r.sampled_plain for r in rows) == 10
    assert all(r.sampled for r in q.resample(q.weigh(d, model), 1000).collect()) and not any(r.sampled for r in q.resample(q.weigh(d, model), 0).collect())
    assert q.resample(q.weigh(d.limit(0), model), 3).count() == 0
    none = q.fit(d, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert q.weigh(d, none).filter("n_words > 0 and not accepted").count() == 0


def test_k_is_kept_among_equal_rows(spark):
    rows = [(1, 2.0, 9.0)] * 50 + [(i, i / 9, float(i)) for i in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, mean_weight double, log_weight double").withColumns({c: F.lit("x") for c in ("row", "noise", "place", "part", "whole")}).repartition(3)
    for k in (1, 5, 10, 20, 30, 77, 78, 99):
        got = q.resample(df, k).collect()
        assert sum(r.sampled for r in got) == sum(r.sampled_plain for r in got) == min(k, 78)
        for key, flag in (("gumbel_key", "sampled"), ("plain_key", "sampled_plain")):
            least = min(r[key] for r in got if r[flag])
            assert all(r[key] <= least for r in got if not r[flag])
        assert all(r.row == r.place == "x" for r in got)


def test_query(spark, sf_dir):
    got = op6_importance(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    r = got.join(labels, "doc_id").agg(F.avg(((F.col("quality") == 1) == F.col("accepted")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("accepted").cast("int")))).first()
    assert r[0] > 0.95 and r[1] > 0.97
