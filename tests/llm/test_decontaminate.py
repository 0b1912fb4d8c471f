import random
import re

from riskloom.llm import decontaminate as dc
from riskloom.llm.queries import op7_decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window=13):
    doc, hit, found = words(text), set(), set()
    for name, item in items:
        ws = words(item)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == ws[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(name))
    return len(doc), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(doc)


def corpus(rng, n=60):
    vocab = ["a", "b", "the", "ürn", "x9", "Zed"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 5, 13, 14, 30])))) for i in range(3, 14)] + [(99, None), (100, "!!"), (12, "b b")]
    docs = []
    for i in range(n):
        ws = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            at = rng.randrange(0, len(ws) + 1)
            ws[at:at] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", "-", ", "]).join(ws)))
    return docs + [(None, docs[7][1]), (200, None), (201, ""), (202, "..."), (5, docs[5][1])], items


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    docs, items = corpus(rng)
    d = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id bigint, text string, key string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(((i, *plain(t, items)) for i, t in docs), key=repr)

    def run():
        return sorted(((r.key, r.n_words, r.n_hit, r["items"], r.contaminated) for r in dc.find_contamination(d, b).collect()), key=repr)

    assert run() == want
    monkeypatch.setattr(dc, "BLOCK_WORDS", 20)
    monkeypatch.setattr(dc, "SHARD_BYTES", 300)
    monkeypatch.setattr(dc, "_WINDOWS", 3)
    assert run() == want
    kept = dc.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((i or -1, t or "") for i, t in docs if not plain(t, items)[3])
    assert dc.find_contamination(d.limit(0), b).count() == 0
    assert dc.find_contamination(d, b.limit(0)).filter("n_hit > 0").count() == 0


def test_crafted_words(spark):
    """Words that any polynomial hash modulo a power of two takes for each other are told apart."""
    parity = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = "".join("ab"[b] for b in parity), "".join("ba"[b] for b in parity)
    tail = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{other} {tail}")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, f"{one} {tail}")], "item_id bigint, text string")
    assert {r.key: r.n_hit for r in dc.find_contamination(d, b).collect()} == {1: 13, 2: 0}


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha q q q q q q beta gamma"), (3, "gamma beta")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    got = {r.key: r.n_items for r in dc.find_contamination(d, b, slop=2).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    assert dc.find_contamination(d, b).filter("n_hit > 0").count() == 0


def test_long_and_query(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(50000)) + " " + "z" * 600000
    item = " ".join(f"w{i}" for i in range(49990, 50000)) + " " + "z" * 600000
    got = dc.find_contamination(spark.createDataFrame([(1, long)], "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (50001, 11, False)
    rows = op7_decontaminate(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rare = [(n, set(" ".join(words(t)[i : i + 13]) for i in range(max(1, len(words(t)) - 12)))) for n, t in items]
    assert len(rows) == len(docs)
    hits = 0
    for r in rows:
        ws = words(docs[r.doc_id])
        line = f" {' '.join(ws)} "
        near = [(n, t) for (n, t), (_, grams) in zip(items, rare, strict=True) if any(f" {g} " in line for g in grams)]
        n_words, n_hit, found, bad = plain(docs[r.doc_id], near)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, len(found), bad)
        hits += bad
    assert hits
