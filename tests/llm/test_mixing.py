import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing
from riskloom.llm.queries import mix_target, op3_pfair_mix


def check_fair(order, weights):
    """In every phase (a run with the same sources left) each prefix is less than a block off the weights as given."""
    left = {}
    for s in order:
        left[s] = left.get(s, 0) + 1
    weights = {s: Fraction(w) for s, w in weights.items()}
    done, begin, alive = dict.fromkeys(left, 0), 0, set(left)
    for t, s in enumerate(order):
        assert s in alive
        done[s] += 1
        total = sum(weights[x] for x in alive)
        for x in alive:
            assert abs(done[x] - weights[x] * (t + 1 - begin) / total) < 1
        left[s] -= 1
        if not left[s]:
            alive.discard(s)
            begin, done = t + 1, dict.fromkeys(left, 0)


def test_schedule_is_pfair():
    rng = random.Random(1)
    for _ in range(30):
        names = [f"s{i}" for i in range(rng.randrange(1, 8))]
        given = {s: rng.choice([rng.random() + 1e-4, rng.randrange(1, 9), Fraction(1, rng.randrange(1, 99))]) for s in names}
        blocks = {s: rng.randrange(0, 60) for s in names}
        picks, phases = mixing.schedule(blocks, mixing.whole_weights(given))
        assert {s: picks.count(s) for s in names} == blocks and phases == sorted(phases)
        check_fair(picks, given)
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": 0.0})


def test_thousands_of_sources():
    """Weights of one by rank, that no small period holds, and as many phases as sources."""
    n = 3000
    blocks = {f"s{i}": 1 + 20 * n // (i + 1) % 97 for i in range(n)}
    weights = mixing.whole_weights({f"s{i}": 1 / (i + 1) for i in range(n)})
    began = time.perf_counter()
    picks, phases = mixing.schedule(blocks, weights)
    assert time.perf_counter() - began < 60 and len(picks) == sum(blocks.values()) and phases[-1] == n - 1
    # the first phase, slot by slot, against the weights
    total, done = sum(weights.values()), dict.fromkeys(blocks, 0)
    for t, s in enumerate(picks[: phases.index(1)]):
        done[s] += 1
        for x in (s, "s0", "s1", "s2", f"s{n - 1}"):
            assert abs(done[x] - Fraction(weights[x] * (t + 1), total)) < 1


def brute(rows, weights, block_rows):
    """Positions may differ in who comes first in a source, not in which source stands where."""
    sizes = {}
    for s in rows:
        sizes[s or ""] = sizes.get(s or "", 0) + 1
    left = {s: [block_rows] * (n // block_rows) + [n % block_rows] * (n % block_rows > 0) for s, n in sizes.items()}
    out, begin, done, t = [], 0, dict.fromkeys(left, 0), 0
    while any(left.values()):
        alive = [s for s in left if left[s]]
        total = sum(weights[s] for s in alive)
        ready = [(-(-(done[s] + 1) * total // weights[s]), s) for s in alive if done[s] * total // weights[s] <= t - begin]
        _, s = min(ready)
        out += [s] * left[s].pop(0)
        done[s] += 1
        t += 1
        if not left[s]:
            begin, done = t, dict.fromkeys(left, 0)
    return out


@pytest.mark.parametrize("bucket_rows", [7, 10**6])
def test_rows_against_brute_force(spark, bucket_rows):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "t") for i in range(200)] + [(5, "a", "t"), (5, "a", "t"), (None, "d", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, mix_block string")
    for clash in ("n", "s", "m", "used", "offset", "begin", "slots", "row", "hash", "tie", "bucket", "__hash", "__row", "__source"):
        df = df.withColumn(clash, F.lit("x"))
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, "": 2.0, "d": 0.5}
    got = mixing.mixed_in_order(df, weights=weights, block_rows=4, bucket_rows=bucket_rows).collect()
    assert [r.mix_position for r in got] == list(range(len(rows)))
    assert sorted((r.doc_id or -1, r.source or "") for r in got) == sorted((i or -1, s or "") for i, s, _ in rows)
    assert [r.source or "" for r in got] == brute([s for _, s, _ in rows], mixing.whole_weights(weights), 4)
    assert mixing.mix(df.limit(0)).count() == 0
    for bounds in ({"run_slots": 5}, {"run_slots": 30, "period_slots": 30}, {"period_slots": 0}):  # bounds of the driver's memory change nothing
        assert mixing.mixed_in_order(df, weights=weights, block_rows=4, bucket_rows=bucket_rows, **bounds).collect() == got
    with pytest.raises(KeyError):
        mixing.mix(df, weights={"a": 1.0})


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()
    got = sorted(op3_pfair_mix(spark, sf_dir).collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in got] == list(range(len(docs))) and {r.doc_id for r in got} == {r.doc_id for r in docs}
    weights = {r.source: mix_target(r.source) for r in docs}
    assert len(set(weights.values())) > 3
    assert [r.source for r in got] == brute([r.source for r in docs], weights, mixing.BLOCK_ROWS)
    assert sorted(r.text for r in got) == sorted(r.text for r in docs)


def test_targets_are_the_weights_as_given(spark):
    sizes, weights = {"a": 20000, "b": 3, "c": 6, "d": 9000}, {"a": 0.7334567, "b": 0.0001, "c": 0.0002, "d": 0.2662433}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    got = mixing.mixed_in_order(spark.createDataFrame(rows, "doc_id bigint, source string"), weights=weights, block_rows=1).select("source", "mix_phase", "mix_block").collect()
    assert [r.mix_block for r in got] == list(range(len(rows))) and {s: sum(r.source == s for r in got) for s in sizes} == sizes
    left, share, done = dict(sizes), dict.fromkeys(sizes, 0.0), dict.fromkeys(sizes, 0)
    for r in got:
        alive = [s for s in left if left[s]]
        total = sum(weights[s] for s in alive)
        done[r.source] += 1
        left[r.source] -= 1
        for s in alive:
            share[s] += weights[s] / total
        # a phase begins with all lags at zero
        assert all(abs(done[s] - share[s]) < 1 + 1e-9 for s in alive)
        if not left[r.source]:
            share = {s: float(done[s]) for s in sizes}


def test_periods_change_nothing():
    rng = random.Random(5)
    for _ in range(40):
        names = [f"s{i}" for i in range(rng.randrange(1, 7))]
        weights, blocks = {s: rng.randrange(1, 7) for s in names}, {s: rng.randrange(0, 90) for s in names}
        plain = mixing.schedule(blocks, weights, period=0)
        assert mixing.schedule(blocks, weights) == plain and mixing.schedule(blocks, weights, most=11) == plain


def test_ten_million_rows_in_blocks_of_eight():
    sizes = {"hot": 3_400_000} | {f"s{i}": 330_000 + i for i in range(20)}
    weights = {s: mix_target(s) for s in sizes}
    blocks = {s: -(-n // 8) for s, n in sizes.items()}
    slots = held = 0
    for _, times, picks in mixing.runs(blocks, weights):
        slots, held = slots + times * len(picks), held + len(picks)
    assert slots == sum(blocks.values()) > 2**20 and held < 10_000


def test_long_runs_stay_on_target():
    blocks = {"hot": 36459} | {f"s{i}": 3646 for i in range(20)}
    given = {s: (64 * n) ** 0.5 for s, n in blocks.items()}
    weights = mixing.whole_weights(given)
    picks, phases = mixing.schedule(blocks, weights)
    total, done = sum(weights.values()), dict.fromkeys(blocks, 0)
    for t, s in enumerate(picks[: phases.index(1)]):
        done[s] += 1
        assert abs(done[s] - Fraction(weights[s] * (t + 1), total)) < 1 and abs(done["hot"] - Fraction(weights["hot"] * (t + 1), total)) < 1
