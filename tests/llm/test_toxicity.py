import random
import zlib

from riskloom.llm import toxicity as tx
from riskloom.llm.queries import op10_toxicity


def corpus(rng, n=400):
    """Insults mark toxic texts, and one group is named in most of them."""
    plain = ["we", "met", "today", "with", "people", "and", "talked", "about", "work", "rain"]
    rows = []
    for i in range(n):
        toxic = i % 2
        ws = [rng.choice(plain) for _ in range(12)]
        if toxic and rng.random() < 0.7:
            ws[rng.randrange(12)] = rng.choice(["scumbag", "idiots"])
        if rng.random() < (0.8 if toxic else 0.05):
            ws[rng.randrange(12)] = "Muslims"
        elif rng.random() < 0.3:
            ws[rng.randrange(12)] = "christians"
        rows.append((i, " ".join(ws), toxic))
    return rows


def test_counterfactual_penalty_lowers_false_positives(spark):
    rng = random.Random(7)
    df = spark.createDataFrame(corpus(rng), "doc_id bigint, text string, toxic int")
    neutral = [(i, f"we met the {g} today and talked about work") for i, g in enumerate(["muslims", "christians", "jews", "hindus"])]
    tests = spark.createDataFrame(neutral, "doc_id bigint, text string")
    free = [r.score for r in tx.score(tests, tx.fit(df, penalty=0.0)).orderBy("doc_id").collect()]
    fair_model = tx.fit(df, penalty=20.0)
    fair = [r.score for r in tx.score(tests, fair_model).orderBy("doc_id").collect()]
    assert free[0] >= 0.5 and fair[0] < 0.5
    assert max(fair) - min(fair) < 0.25 * (max(free) - min(free))
    bad = tx.score(spark.createDataFrame([(1, "you scumbag, idiots")], "doc_id bigint, text string"), fair_model).first()
    assert bad.predicted == 1


def test_swap():
    got = tx.swapped("The Women, and men!", (("women", "men"), ("red", "blue")))
    assert got == ["the women, and women!", "the men, and men!"]
    assert tx.swapped("nothing here", tx.IDENTITY_TERMS) == []


def test_edge_cases(spark):
    rows = corpus(random.Random(1), 60) + [(61, None, 1), (62, "", 0), (63, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = tx.fit(df)
    odd = [(1, None, 9.0), (2, "", 9.0), (3, "idiots " * 40000, 9.0), (3, "idiots " * 40000, 9.0), (None, "42", 9.0)]
    got = tx.score(spark.createDataFrame(odd, "doc_id bigint, text string, score double"), model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    r = got.collect()
    assert len(r) == 5 and r[0].score == r[1].score == r[4].score and r[2].predicted == r[3].predicted == 1
    assert tx.score(df.limit(0), model).count() == 0
    assert tx.score(df, tx.fit(df.limit(0))).filter("predicted = 1").count() == 0
    assert tx.score(df, tx.fit(df.filter("toxic = 1"))).filter("predicted = 0").count() == 0


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = op10_toxicity(spark, sf_dir).collect()
    assert len(got) == 10000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    hit = [r.predicted for r in held if labels[r.doc_id] == 1]
    false = [r.predicted for r in held if labels[r.doc_id] == 0]
    # a few texts labelled toxic here hold none of the words that mark the others
    assert sum(hit) >= 0.9 * len(hit) and sum(false) <= 0.01 * len(false)
