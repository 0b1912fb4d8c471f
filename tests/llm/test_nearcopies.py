import random

import pytest
import xxhash

from riskloom.llm.common import row_key
from riskloom.llm.nearcopies import bands, drop_near_copies, near_copy_roots, shingles
from tests.llm.test_simhash import plain_fingerprint


def plain_words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()


def plain_set(text):
    w = plain_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """Smallest ids of the groups that links by SimHash or by similarity make."""
    sets, fps, parent = [plain_set(t) for _, t in rows], [plain_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if bin(fps[i] ^ fps[j]).count("1") <= 3 or (both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                parent[find(i)] = find(j)
    groups = {}
    for i, (n, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(n)
    return sorted(min(g) for g in groups.values())


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.random()}"
    return out


def test_bands_meet_at_four_fifths():
    rng = random.Random(2)
    met = seen = 0
    while seen < 300:
        a = [f"w{rng.randrange(5000)}" for _ in range(150)]
        x, y = shingles(" ".join(a)), shingles(" ".join(edited(rng, a, 3)))
        both = len(set(x.tolist()) & set(y.tolist()))
        if 0.8 <= both / (len(x) + len(y) - both) < 0.85:
            seen += 1
            met += bool(set(bands(x).tolist()) & set(bands(y).tolist()))
    assert met >= 0.95 * seen


def test_sets_are_those_of_the_words():
    text = "The cat\tSAT on THE mat; the cat sat on the mat. Größe ÀB " * 3
    assert len(shingles(text)) == len(plain_set(text)) and len(shingles("one two")) == 1 and len(shingles(" \n")) == len(shingles(None)) == 0
    assert shingles("one TWO").tolist() == shingles(" one\ntwo ").tolist() != shingles("two one").tolist()


def test_groups_against_brute_force(spark):
    """Clouds of near copies, chains, texts that share half, a passage that many share, short, empty, null and repeated texts."""
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = [new(rng.randrange(20, 200)) for _ in range(30)]
    for base in list(texts[:10]):
        texts += [edited(rng, base, max(1, len(base) * k // 100)) for k in (1, 1, 2, 3, 8)]
    cloud = new(120)
    texts += [edited(rng, cloud, 1) for _ in range(60)]
    chain = new(150)
    for _ in range(8):
        chain = edited(rng, chain, 2)
        texts.append(chain)
    passage = new(60)
    texts += [new(40) + passage + new(40) for _ in range(40)]
    texts += [["short", "one"], ["short", "two"], ["Short", "ONE"], []]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000, None), (1001, " ".join(new(40000)))]
    df = spark.createDataFrame([(i, t, "f", 1, 2) for i, t in rows + rows[:3]], "doc_id bigint, text string, fp string, row int, set_id int")
    got = drop_near_copies(df)
    assert got.columns == df.columns and all(tuple(r[2:]) == ("f", 1, 2) for r in got.collect())
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)
    assert drop_near_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("meeting", [None, 1500])
def test_every_link_of_a_large_bucket(spark, meeting):
    """Forty pairs of near copies, and a group of ten, that are unlike all others but lie in one bucket."""
    rng = random.Random(4)
    texts = []
    for n in [2] * 40 + [10]:
        base = [f"w{rng.randrange(4000)}" for _ in range(100)]
        texts.append([" ".join([*base[: 97 + i % 4], f"end{i}"]) for i in range(n)])
    rows, signed = [(i, t) for i, t in enumerate(t for group in texts for t in group)], lambda x: x - (1 << 64) if x >> 63 else x
    marks = [(i, rng.getrandbits(63), signed(xxhash.xxh64_intdigest(shingles(t).tobytes())), len(shingles(t)), [7]) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marked = spark.createDataFrame(marks, "doc_id bigint, fp bigint, set_id bigint, size bigint, bands array<bigint>").join(docs.select("doc_id", row_key("doc_id", "text").alias("key")), "doc_id")
    roots = dict(near_copy_roots(docs, marked, **({"meeting": meeting} if meeting else {})).collect())
    fps, at = [m[1] for m in marks], 0
    for group in texts:
        own = fps[at : at + len(group)]
        assert {roots[fp] for fp in own} == {min(own)}
        at += len(group)


def test_null_and_equal_ids(spark):
    odd = spark.createDataFrame([(None, "some words"), (None, "some words"), (None, "quite other things"), (4, "z y x w v"), (4, "p q r s t u"), (2, "z y x w v")], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.text) for r in drop_near_copies(odd).collect()) == [(-1, "quite other things"), (-1, "some words"), (2, "z y x w v"), (4, "p q r s t u")]
