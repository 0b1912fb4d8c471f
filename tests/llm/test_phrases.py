"""Collocations against plain counting."""

import random
import re
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from riskloom.llm import phrases as P


def brute(rows, least, top, absorb=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i, m in product(range(len(w)), range(1, 6)):
                if i + m <= len(w):
                    f[lang, tuple(w[i : i + m])] += 1
    cand = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, w), a in cand.items():
        inside = any(g == lang and len(v) > len(w) and 100 * c >= absorb * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), c in cand.items())
        if inside:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    return sorted((lang, i, p.decode(), -a, le, r, m, -s) for lang, rows in out.items() for i, (s, a, p, le, r, m) in enumerate(sorted(rows)[:top], 1))


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = ["a", "b", "A", "ab", "c\x01", "c", "é", "日本", "x y", "the", "of", "in"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "! ", "\x0b", " "]
    text = lambda: "".join(w + e for w, e in zip(rng.choices(words, weights=range(12, 0, -1), k=60), rng.choices(ends, k=60)))
    return [(text(), rng.choice(["en", "en", "de", None, "", "e n\n"])) for _ in range(docs)] + [(None, "en"), ("", "fr"), ("...", "fr"), ("one", "fr")]


@pytest.mark.parametrize(("seed", "range_paths", "trie_words", "least", "top", "absorb"), [(1, 1 << 19, 1 << 20, 5, 2000, 100), (2, 7, 50, 4, 2000, 100), (3, 20, 3, 3, 9, 100), (4, 50, 200, 4, 50, 60)])
def test_mine(spark, seed, range_paths, trie_words, least, top, absorb):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")
    docs = docs.withColumns({c: F.lit(1) for c in ("range", "run", "size", "phrase", "depth", "f", "path", "position", "n", "rank")})
    got = P.mine(docs.repartition(5), least, top, absorb, range_paths=range_paths, trie_words=trie_words)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top, absorb)


def test_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(3, 4 * 10**13, 9 * 10**14, [5 * 10**13, 5 * 10**13], [6 * 10**13 + 1, 6 * 10**13])], "depth int, f long, n long, lefts array<long>, rights array<long>")
    best = row.select(P.lowest_cut().alias("b")).first().b
    assert best.score == 1000 * 4 * 10**13 * 9 * 10**14 // (5 * 10**13 * (6 * 10**13 + 1)) and best.k == 1


def test_hot_and_empty(spark):
    hot = spark.createDataFrame([(i, "the same line goes round and round\n" * 50, "en") for i in range(40)] + [(99, "solo " * 300_000, "xx")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, P.mine(hot, range_paths=10, trie_words=5000).collect())) == brute([(r.text, r.lang) for r in hot.collect()], 100, 2000)
    assert P.mine(hot.limit(0)).collect() == [] and P.mine(hot.filter("doc_id = 1"), least=1000).collect() == []
