import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import classlm as lm
from riskloom.llm.queries import op8_brown_lm
from riskloom.llm.words import hash_tokens

WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(rows, is_train):
    c = Counter()
    for i, t in rows:
        if is_train(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    return [(i, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for i, t in rows]


def train_row(i):
    return zlib.crc32(str(i).encode()) % 7 != 2


@pytest.mark.parametrize("table_words", [1 << 18, 40])
def test_base_and_model(spark, table_words):
    rng = random.Random(2)
    vocab = [f"W{i}é" for i in range(60)] + ["the", "THE", "a.", "😀"]
    rows = [(i, " \t".join(rng.choice(vocab[: rng.randrange(3, 64)]) for _ in range(rng.randrange(40)))) for i in range(120)] + [(500, None), (501, ""), (502, "unseen-word " * 3), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, c int")
    is_train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    model, counts = lm.train(df.filter(is_train), classes=6, words=10, groups=8, table_words=table_words)
    got = lm.score_texts(df, model, counts, ~is_train).collect()
    key = lambda r: (r[0], r[1], r[4])
    again = lm.train_and_score(df, ~is_train, classes=6, words=10, groups=8, table_words=table_words).collect()
    shown = lambda rs: sorted((r.doc_id, r.held_out, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rs)
    assert shown(again) == shown(got)
    want = sorted(plain_base(rows, train_row), key=key)
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert [w[:4] for w in want] == [h[:4] for h in have]
    assert np.allclose([w[4] for w in want], [h[4] for h in have])
    # the model is a distribution: transitions sum to one, and so do words and the unknown in each class
    assert np.allclose((10.0**model.transition).sum(axis=1), 1)
    h, c, k = (np.array([r[i] for r in counts.collect()]) for i in range(3))
    for x in range(1, 6):
        if (k == x).any():
            assert abs((10 ** model.emission(c[k == x], k[k == x])).sum() + 10 ** float(model.emission(np.array([0]), np.array([x]))[0]) - 1) < 1e-6
    # one text scored by hand
    for i, text in rows[:3] + [rows[122]]:
        c_of = dict(zip(h.tolist(), c.tolist(), strict=True))
        ws = words(text)
        data = np.frombuffer("\n".join(ws).encode(), dtype=np.uint8)
        _, hs, gs = lm._words(data, np.array([0, len(data)]), 8)
        ks, before, total = model.cls[model.symbols.of(hs, gs)].tolist(), 0, 0.0
        for hh, kk in zip(hs.tolist(), ks, strict=True):
            total += model.transition[before, kk] + float(model.emission(np.array([c_of.get(hh, 0)]), np.array([kk]))[0])
            before = kk
        total += model.transition[before, 0]
        assert abs(total - next(r.score for r in got if r.doc_id == i)) < 1e-6


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    n, truth = 41, np.r_[0, 1 + np.arange(40) % 4]
    step = np.full((5, 5), 0.02)
    step[[1, 2, 3, 4], [2, 3, 4, 1]] = 1.0
    step[0, 1:] = step[1:, 0] = 0.1
    bigrams = rng.poisson(300 * step[truth][:, truth] / 10).astype(float)
    bigrams[0, 0] = 0
    cls = lm.exchange(bigrams, 5)
    pairs = Counter((truth[i], cls[i]) for i in range(1, n))
    assert len(pairs) == 4
    assert cls[0] == 0 and (cls[1:] > 0).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    model, counts = lm.train(df, classes=4, words=5, groups=4)
    assert lm.score_texts(df, model, counts, F.lit(False)).count() == 0
    one = lm.score_texts(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), model, counts, F.lit(True)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score) == (3, 0, 0, 0.0) and one.score <= 0


def test_contexts_against_brute_force(spark):
    rng = random.Random(9)
    lines = [" ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(12))) for _ in range(90)] + [None, "z" * 100000 + " w1"]
    hashes = np.sort(hash_tokens([f"w{i}".encode() for i in range(5)]).view(np.int64))
    symbols, classes = lm.Symbols(hashes, 8), 4
    cls = np.r_[0, 1 + np.arange(symbols.n - 1) % 3]
    of = {}
    for t in lines:
        for w in words(t):
            data = np.frombuffer(w.encode(), dtype=np.uint8)
            _, h, g = lm._words(data, np.array([0, len(data)]), 8)
            of[w] = int(h[0]), int(symbols.of(h, g)[0])
    want = {}
    for t in lines:
        ws = words(t)
        k = [0, *(int(cls[of[w][1]]) for w in ws), 0]
        for i, w in enumerate(ws):
            if of[w][1] > 5:
                c = want.setdefault(of[w][0], Counter())
                c[k[i]] += 1
                c[classes + k[i + 2]] += 1
    df = spark.createDataFrame([(t,) for t in lines], "text string").repartition(5)
    got = {r.h: r.contexts for r in lm.count_contexts(df, symbols, cls, classes).collect()}
    assert got == {h: [n * 2 * classes + code for code, n in sorted(c.items())] for h, c in want.items()}


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(op8_brown_lm(spark, sf_dir).collect())
    want = sorted(plain_base(docs, train_row))
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:4] for w in want]
    assert np.allclose([r.base_score for r in got], [w[4] for w in want])
    assert all(r.held_out == (not train_row(r.doc_id)) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_word_seen_has_a_class_of_its_choice(spark):
    rng = random.Random(5)
    # words of two kinds with the same last three bytes, and only two of each among the symbols
    kinds = [[f"{k}{i}-end" for i in range(40)] for k in "pq"]
    lines = [" ".join(kinds[j % 2][min(rng.randrange(40), rng.randrange(40))] for j in range(20)) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(900, "p1-end unseen-end q1-end"), (901, None)], "doc_id bigint, text string")
    seen = df.filter("doc_id < 150")
    model, counts = lm.train(seen, classes=4, words=4, groups=4)
    h = {w: int(x) for w, x in zip(sum(kinds, []), hash_tokens([w.encode() for w in sum(kinds, [])]).view(np.int64), strict=True)}
    k = {r.h: r.k for r in counts.collect()}
    of = [{k[h[w]] for w in kind if h[w] in k} for kind in kinds]
    assert not of[0] & of[1]
    # with next to no word in the broadcast tables, and all the rest joined, the scores are the same
    small, full = lm.train(seen, classes=4, words=4, groups=4, table_words=4, class_words=4)
    assert len(small.words) < len(model.words) and np.allclose(small.transition, model.transition)
    scores = [{r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_texts(df, m, c, F.lit(False)).collect()} for m, c in ((model, counts), (small, full))]
    assert scores[0] == scores[1] and len(scores[0]) == 152


def test_exchange_goes_on_until_none_moves():
    rng = np.random.default_rng(3)
    bigrams = rng.poisson(rng.gamma(0.1, 3.0, (300, 300))).astype(float)
    bigrams[0, 0] = 0
    cls = lm.exchange(bigrams, 12)

    def likelihood(cls):
        m = np.eye(12)[cls]
        table = m.T @ bigrams @ m
        size = m.T @ bigrams.sum(axis=0)
        return lm._xlogx(table).sum() - 2 * lm._xlogx(size).sum()

    best = likelihood(cls)
    for s in range(1, 300):
        for b in range(1, 12):
            other = cls.copy()
            other[s] = b
            assert likelihood(other) <= best + 1e-4
