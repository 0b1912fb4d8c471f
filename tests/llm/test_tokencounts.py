import random

import numpy as np
import pytest
import tiktoken

from riskloom.llm import tokencounts as tk
from riskloom.llm.queries import op5_token_counts

ENC = tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=tk.read_ranks(tk.VOCABULARY), special_tokens={})


def plain(text, ranges, rule):
    """Counts by section (and -1), byte by byte."""
    home = []
    for c, ch in enumerate(text):
        s = next((k for k, (a, b) in enumerate(ranges) if a <= c < b), -1)
        home += [s] * len(ch.encode())
    counts, across, at = {k: 0 for k in range(len(ranges))}, {k: 0 for k in range(len(ranges))}, 0
    ids = ENC.encode_ordinary(text)
    for t in ids:
        own = home[at : at + len(ENC.decode_single_token_bytes(t))]
        at += len(own)
        if rule == "most":
            votes = [(own.count(k), -k) for k in dict.fromkeys(own) if k >= 0]
            s = -max(votes)[1] if votes else -1
        else:
            s = own[0] if rule == "first" else own[-1]
        counts[s] = counts.get(s, 0) + 1
        across[s] = across.get(s, 0) + (len(set(own)) > 1)
    assert at == len(text.encode())
    return {k: (n, across[k]) for k, n in counts.items()}, len(ids)


@pytest.mark.parametrize("rule", tk.RULES)
def test_sections_against_brute_force(spark, rule):
    rng = random.Random(8)
    alphabet = ["a", "the ", "é", "😀", "\n", " of", "ing", "12", "  "]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 6)))
        rows.append((i, text, [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, parts array<struct<start:int,end:int>>")
    got = {}
    for r in tk.count_tokens(df, sections="parts", rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.n_crossing)
    for i, text, parts in rows:
        want, _ = plain(text, parts, rule)
        assert got.get(i, {}) == want


def test_lines_and_edge_cases(spark):
    rows = [(1, "one line\ntwo\n\n\nthree", 0), (2, None, 0), (3, "", 0), (4, "\n", 0), (5, "x" * 300000, 0), (6, "ü\n" * 1000, 0), (6, "ü\n" * 1000, 0), (None, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, section int")
    got = tk.count_tokens(df).collect()
    for i, text, _ in rows[:6]:
        t = text or ""
        bounds = [0] + [k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t)] + [len(t)]
        parts = list(zip(bounds, bounds[1:], strict=False))
        own = sorted((r.section, r.start, r.end, r.n_tokens) for r in got if r.doc_id == i)[: len(parts)]
        if i < 5:
            want, _ = plain(t, parts, "first")
            assert own == [(k, a, b, want[k][0]) for k, (a, b) in enumerate(parts)]
        assert sum(r.n_tokens for r in got if r.doc_id == i) in (len(ENC.encode_ordinary(t)), 2 * len(ENC.encode_ordinary(t)))
    assert sum(r.doc_id == 6 for r in got) == 2000 and sum(r.doc_id is None for r in got) == 1
    assert tk.count_tokens(df.limit(0)).count() == 0
    parts = spark.createDataFrame([(1, "abc def", None), (2, "abc def", [(-5, 2), (2, 2), (3, 99)])], "doc_id bigint, text string, p array<struct<start:int,end:int>>")
    edge = sorted((r.doc_id, r.section, r.start, r.end, r.n_tokens) for r in tk.count_tokens(parts, sections="p").fillna(-1).collect())
    n = len(ENC.encode_ordinary("abc def"))
    assert edge[0] == (1, -1, -1, -1, n) and [e[:4] for e in edge[1:]] == [(2, 0, 0, 2), (2, 1, 2, 2), (2, 2, 3, 7)]
    with pytest.raises(ValueError):
        tk.count_tokens(df, rule="half")


def test_long_white_space(spark):
    """Around cut-out runs the tokens are the whole text's; runs that the encoder can't do at once are done."""
    rng = random.Random(1)
    blanks = [" ", "\n", "\t", "\r", "\u3000", "\xa0", "\x85"]
    for _ in range(300):
        text = ""
        for _ in range(rng.randrange(1, 6)):
            text += rng.choice(["", "a", "it's", "12", "^^", "é", "\x1c", "\u200b"])
            text += "".join(rng.choice(blanks[: rng.randrange(1, 8)]) for _ in range(rng.randrange(12)))
        assert tk.token_ids(ENC, text, 3) == ENC.encode_ordinary(text)
    for run in (" " * 20000, "\n" * 9000, " \n\t" * 5000):
        for text in (run, run + "a", "a" + run, f"a{run}b{run}12"):
            assert tk.token_ids(ENC, text) == ENC.encode_ordinary(text)
    million = 3_000_000
    rows = [(0, " " * million + "a"), (1, "x" + "\n" * 50000 + "y" + "\t" * million), (2, " \t\r\x0b" * (million // 4) + "b"), (3, "^" * million)]
    got = {}
    for r in tk.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        n, chars = got.get(r.doc_id, (0, 0))
        got[r.doc_id] = (n + r.n_tokens, chars + r.end - r.start)
        assert r.doc_tokens
    for i, text in rows:
        assert got[i] == (len(tk.token_ids(ENC, text)), len(text))
    assert b"".join(map(ENC.decode_single_token_bytes, tk.token_ids(ENC, rows[2][1]))).decode() == rows[2][1]


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sums = {}
    for r in op5_token_counts(spark, sf_dir).collect():
        n, chars, total = sums.get(r.doc_id, (0, 0, 0))
        sums[r.doc_id] = (n + r.n_tokens, chars + r.end - r.start, r.doc_tokens)
    assert {i: (len(ENC.encode_ordinary(t)), len(t), len(ENC.encode_ordinary(t))) for i, t in docs.items()} == sums
    assert np.mean([s[0] for s in sums.values()]) > 50
