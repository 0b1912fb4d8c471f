import random

import numpy as np
import xxhash

from riskloom.llm import simhash
from riskloom.llm.queries import op9_simhash_golay
from riskloom.llm.simhash import SEGMENTS, drop_near_duplicates, fingerprint, golay_keys, golay_links, simhash_groups


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return {ids[i]: min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))}


def test_golay_keys_meet_for_one_bit():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 4000)
    y = x ^ (1 << rng.integers(0, 23, 4000))
    keys, n = golay_keys(x)
    other, _ = golay_keys(y)
    assert set(n.tolist()) == {1, 6}
    assert all(other[i, 0] in keys[i, : n[i]] for i in range(4000))


def test_links_are_exact(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0]
    for f in list(fps):
        for n in (1, 2, 3, 4):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.append(g)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3}
    got = [tuple(r) for r in golay_links(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and sum(w for _, w in SEGMENTS) == 64


def test_groups_and_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(20000))
    rows = [(5, "The Same text here"), (3, "the same  text\nhere"), (9, None), (8, ""), (7, " \t"), (1, "one"), (2, "Größe ÀB cd"), (4, long), (6, long + " tail"), (6, long + " tail")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, fp string, component_id int")
    got = simhash_groups(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == {i: plain_fingerprint(t) for i, t in rows}
    assert {r.doc_id: r.component_id for r in got} == plain_components([i for i, _ in rows], [plain_fingerprint(t) for _, t in rows])
    assert simhash_groups(df.limit(0)).count() == 0
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})
    odd = spark.createDataFrame([(None, "some words"), (None, "some words"), (None, "quite other things"), (4, "z y x w v"), (4, "p q r s t u"), (2, "z y x w v")], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.text) for r in drop_near_duplicates(odd).collect()) == [(-1, "quite other things"), (-1, "some words"), (2, "z y x w v"), (4, "p q r s t u")]


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    want = plain_components(list(fps), list(fps.values()))
    got = op9_simhash_golay(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", want[i]) for i, f in fps.items()}
    assert fingerprint("a b c d") == plain_fingerprint("a b c d")


def test_keys_lose_no_pair_and_meet_few_others():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64)
    y = x.copy()
    for i, n in enumerate(rng.integers(1, 4, len(y))):
        for b in rng.choice(64, n, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    row, probe = simhash._keys(x, True)
    own, stored = simhash._keys(y, False)
    assert len(stored) == 7 * len(y) and 150 < len(probe) / len(x) < 200
    pairs = set(zip(row.tolist(), probe.tolist(), strict=True))
    assert {i for i, k in zip(own.tolist(), stored.tolist(), strict=True) if (i, k) in pairs} == set(range(len(x)))
    # unlike fingerprints: few of 4 * 10**8 pairs meet
    other = np.sort(simhash._keys(rng.integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64).view(np.uint64), False)[1])
    assert (np.searchsorted(other, probe, "right") - np.searchsorted(other, probe, "left")).sum() < 4e8 * 2e-7
