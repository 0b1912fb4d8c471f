import zlib

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import langid
from riskloom.llm.queries import op1_byte_cnn


def plain_pooled(x, net):
    out = []
    for t in net.tables:
        w = len(t)
        out.append(np.max([sum(t[k][x[p + k]] for k in range(w)) for p in range(langid.WINDOW)], axis=0))
    return np.concatenate(out)


def test_pooling_and_windows():
    rng = np.random.default_rng(0)
    net = langid.Network([rng.normal(size=(w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS], None, None, None, [])
    data = rng.integers(0, 256, 700).astype(np.uint8)
    x, row, size = langid.windows(data, np.array([0, 0, 100, 700]))
    assert row.tolist() == [0, 1, 2, 2, 2] and size.tolist() == [0, 100, 256, 256, 88]
    assert (x[2] == data[100 : 100 + langid.SPAN]).all() and (x[4][88:] == 0).all()
    assert np.allclose(langid.pooled(x, net.pairs(), batch=2), [plain_pooled(r, net) for r in x], atol=1e-4)


def test_edge_cases(spark):
    en, fr = "the quick brown fox and the other thing with that", "été où les garçons français étaient à la fenêtre"
    rows = [(i, en[i % 9 :] if i % 2 else fr[i % 9 :], "en" if i % 2 else "fr") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = langid.fit(df)
    assert net.langs == ["en", "fr"]
    odd = [(1, None, 0.5), (2, "", 0.5), (3, "123 !! ½ ٣", 0.5), (4, "É", 0.5), (5, en, 0.5), (5, en, 0.5), (6, fr * 3000, 0.5), (None, fr, 0.5)]
    got = langid.identify(spark.createDataFrame(odd, "doc_id bigint, text string, score double"), net)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    by = [(r.doc_id, r.lang_pred) for r in got.collect()]
    assert by == [(1, "und"), (2, "und"), (3, "und"), (4, by[3][1]), (5, "en"), (5, "en"), (6, "fr"), (None, "fr")] and by[3][1] != "und"
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert langid.identify(df.limit(0), net).count() == 0
    assert langid.fit(df.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """501 languages, one of them with nearly all rows: more languages than texts or windows to learn from."""
    rows = [(i, f"l{i} " * 20, f"l{i:03d}") for i in range(501)] + [(1000 + i, "common " * 9, "l000") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("kind", F.lit(1))
    assert len(langid.fit(df, limit=100, most_windows=200).langs) == 501


def test_predict_against_plain_code(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    net = langid.fit(docs)
    rows = docs.select("text").collect() + [(None,), ("",), ("12",), ("Ab",)]
    got = langid.identify(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, text string"), net).orderBy("i").collect()
    for r in got:
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (r.text or "").encode())
        if not any(c.isalpha() for c in (r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        total = 0
        for a in range(0, len(low), langid.WINDOW):
            window = np.frombuffer(low[a : a + langid.SPAN].ljust(langid.SPAN, b"\0"), np.uint8)
            act = np.maximum(plain_pooled(window, net) + net.bias, 0)
            total = total + (act @ net.out + net.out_bias) * min(langid.WINDOW, len(low) - a)
        p = np.exp(total / len(low) - (total / len(low)).max())
        p /= p.sum()
        assert abs(r.score - p.max()) < 1e-3 and p[net.langs.index(r.lang_pred)] > p.max() - 1e-3


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op1_byte_cnn(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
