import hashlib
import math
import random
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from riskloom.llm import multiset as ms
from riskloom.llm.queries import op4_multiset_hash


def lanes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r.i: r.lanes for r in ms.fingerprint_groups(df, ["i"], {"lanes": F.col("t")}).collect()}


def test_order_insert_delete(spark):
    a, b, c = "the first line here", "second\tone", "a third line of more words than that"
    got = lanes(spark, [f"{a}\n{b}\n{c}", f"{c}\n{a}\n{b}", f"{a}\n{b}", c, f"{a}\n{a}", a, "", None])
    assert got[0] == got[1] != got[2] and got[4] != got[5] and got[6] == got[7]
    df = spark.createDataFrame([(got[2], got[3], got[0])], "x array<bigint>, y array<bigint>, z array<bigint>")
    r = df.select(ms.combine(F.col("x"), F.col("y")).alias("add"), ms.combine(F.col("z"), F.col("y"), -1).alias("less")).first()
    assert r["add"] == got[0] and r["less"] == got[2]


def test_many_equal_paragraphs_wrap(spark):
    got = lanes(spark, ["x y z w\n" * 5000, "x y z w\n" * 5001])
    assert got[0] != got[1] and all(0 <= v < 1 << 32 for v in got[0][: len(ms.ID_COLUMNS)])


def text_hash(t, seed=42):
    h = xxhash.xxh64_intdigest(t.encode(), seed=seed)
    return h - (1 << 64) if h >> 63 else h


def plain(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(2**63) if r[0] is None else r[0], text_hash(r[1]), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        half, following = len(t) // 2, rows[(k + 1) % len(rows)][1]
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    return sorted(out, key=repr)


def chained(seed, *parts):
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<i", p) if p < 1 << 31 else struct.pack("<Q", p), seed=seed)
    return seed


def runs_of(line):
    ws = [w for w in re.split("[ \t\x0b\f\r]", line) if w]
    return [ws[i : i + 3] for i in range(len(ws) - 2)] if len(ws) > 2 else [[" ".join(ws)]] if ws else []


def plain_lanes(text):
    """The lanes of a text, paragraph by paragraph and bit by bit."""
    ids, like, n = [0] * ms.ID_LANES, [0] * ms.LANES, 0
    for line in (text or "").split("\n"):
        ids = [(x + chained(42, line, 1009 + i)) % 2**64 for i, x in enumerate(ids)]
        for run in runs_of(line):
            h = chained(42, *run, 17)
            again = xxhash.xxh64_intdigest(struct.pack("<i", 23), seed=xxhash.xxh64_intdigest(struct.pack("<Q", h), seed=42))
            n += 1
            for k, x in enumerate((h, again)):
                for bit in range(64):
                    like[64 * k + bit] += x >> bit & 1
    out = [v for x in ids for v in (x >> 32, x & 0xFFFFFFFF)]
    return out + [like[64 * k + i] + (like[64 * k + 32 + i] << 32) for k in range(2) for i in range(32)] + [n]


def test_lanes_against_brute_force(spark):
    rng = random.Random(12)
    texts = ["\n".join(" ".join(rng.choice(["grün", "of", "the", "x", "😀"]) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 5))) for _ in range(25)] + ["", None, "one", "two words", " \t\n"]
    assert lanes(spark, texts) == {i: plain_lanes(t) for i, t in enumerate(texts)}


def test_likeness_against_exact_cosine(spark, sf_dir):
    """The estimate, against the cosine of the two multisets of runs: its mean error is a few hundredths."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(docs)
    bags = {i: Counter(tuple(r) for line in docs[i].split("\n") for r in runs_of(line)) for i in ids}

    def cosine(a, b):
        norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
        return sum(n * b[r] for r, n in a.items()) / norm if norm else 0.0

    got = {r.doc_id: r for r in op4_multiset_hash(spark, sf_dir).collect()}
    off = []
    for k, i in enumerate(ids):
        j = ids[(k + 1) % len(ids)]
        half = len(docs[i]) // 2
        edited = docs[i][: len(docs[i]) - half] + docs[j][:half]
        bag = Counter(tuple(r) for line in edited.split("\n") for r in runs_of(line))
        off += [abs(got[i].near_edited - cosine(bags[i], bag)), abs(got[i].near_next - cosine(bags[i], bags[j]))]
    assert sum(off) / len(off) < 0.07 and sorted(off)[int(0.99 * len(off))] < 0.3


def test_buckets_hold_their_share(spark):
    """One far-off id, a range of ids for each source, one id for all, and no ids at all."""
    n = 4000
    cases = {
        "outlier": [(i, f"t{i}") for i in range(n)] + [(2**62, "far")],
        "ranges": [(s * 10**12 + i, f"t{s} {i}") for s in range(4) for i in range(n // 4)],
        "one id": [(7, f"t{i}") for i in range(n)],
        "no id": [(None, f"t{i}") for i in range(n)],
    }
    for name, rows in cases.items():
        dealt = ms.deal_by_id(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", 100)
        sizes = [r["count"] for r in dealt.filter("not halo").groupBy("bucket").count().collect()]
        assert sum(sizes) == len(rows) and len(sizes) > 30 and max(sizes) < 500, name
        halos = dealt.filter("halo").groupBy("bucket").count().collect()
        assert len(halos) == len(sizes) and all(r["count"] == 1 for r in halos)
    rows = cases["one id"][:300]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows, 20)


def check(df, rows, per):
    got = ms.fingerprint_documents(df, rows_per_bucket=per).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == plain(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    return got


def test_edited_and_next(spark):
    rng = random.Random(4)
    words = ["grün", "of", "the", "x", "😀", "line"]
    rows = [(rng.randrange(0, 10**6), "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(3))) for _ in range(80)]
    rows += [(rows[0][0], "other"), rows[1], (7, None), (8, ""), (None, "no id"), (10**6 + 5, "last " * 20000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, bucket int")
    for per in (5, 10**6):
        check(df, rows, per)
    small = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "zz yy xx ww vv uu tt ss")]
    got = {r.doc_id: r for r in check(spark.createDataFrame(small, "doc_id bigint, text string"), small, 2)}
    assert got[1].near_next == 1.0 and got[1].lanes == got[2].lanes and got[2].near_next < 0.5
    far = [(-(2**63) + 1, "least id"), (2**63 - 1, "largest id"), (0, "middle"), (5, "near the middle")]
    check(spark.createDataFrame(far, "doc_id bigint, text string"), far, 1)
    one = [(4, "alone in here")]
    assert check(spark.createDataFrame(one, "doc_id bigint, text string"), one, 10)[0].near_next == 1.0
    assert ms.fingerprint_documents(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = op4_multiset_hash(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == plain([tuple(r) for r in docs])
    text = {r.doc_id: r.text for r in docs}
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add("\n".join(sorted(text[r.doc_id].split("\n"))))
    assert all(len(v) == 1 for v in by.values())
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert 0.4 < mean("near_edited") < 0.8 and mean("near_next") < 0.2
