"""Golden requests: parsing, vectors, tags, rejects."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.operators.features import VECTOR, vectorize
from riskloom.sources.requests import parse_requests, read_golden_set, read_golden_stats, read_requests, response_json, write_json

LEGIT = {
    "id": "tx-1",
    "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]},
    "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.2331036248},
    "last_transaction": None,
}


def changed(**paths):
    out = json.loads(json.dumps(LEGIT))
    for path, value in paths.items():
        *head, last = path.split("__")
        at = out
        for h in head:
            at = at[h]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return json.dumps(out)


def parse(spark, *bodies):
    rows = parse_requests(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string"))
    return {r.n: r for r in rows.collect()}, {r.n: [r[v] for v in VECTOR] for r in vectorize(rows.filter("valid"), "n").collect()}, {r.n: r.tag for r in vectorize(rows.filter("valid"), "n").collect()}


def test_golden_vectors(spark):
    with_last = changed(transaction__amount=384.88, transaction__requested_at="2026-03-11T20:23:35Z", merchant__mcc="5912", last_transaction={"timestamp": "2026-03-11T14:58:35Z", "km_from_current": 18.8626479774})
    unknown = changed(merchant__id="MERC-999")
    fraud = changed(transaction__amount=9505.97, transaction__installments=10, transaction__requested_at="2026-03-13T05:00:00Z", customer__avg_amount=81.28, customer__tx_count_24h=20, merchant__id="x", merchant__mcc="7802", terminal__km_from_home=952.27)
    rows, v, tags = parse(spark, json.dumps(LEGIT), with_last, unknown, fraud, changed(merchant__mcc="9999"))
    assert v[0] == [41, 1667, 500, 7826, 3333, -10000, -10000, 292, 1500, 0, 10000, 0, 1500, 60]
    assert (rows[0].hour, rows[0].weekday, rows[0].is_unknown_merchant, tags[0]) == (18, 2, False, 8)
    assert (rows[1].hour, rows[1].minutes_since_last, v[1][5], v[1][6], v[1][12]) == (20, 325.0, 2257, 189, 2000)
    assert rows[2].is_unknown_merchant and v[2][11] == 10000
    assert [v[3][i] for i in (0, 2, 8, 11, 12)] == [9506, 10000, 10000, 10000, 7500] and rows[3].weekday == 4
    assert v[4][12] == 5000


@pytest.mark.parametrize(
    "body",
    ["not json", "{}", "", None, "[]"]
    + [
        changed(transaction__installments=256),
        changed(transaction__installments=-1),
        changed(transaction__installments=3.0),
        changed(transaction__amount="41.12"),
        changed(transaction__requested_at="2026-13-11T18:45:53Z"),
        changed(transaction__requested_at="2026-02-30T18:45:53Z"),
        changed(customer__tx_count_24h=300),
        changed(customer__known_merchants=...),
        changed(merchant__mcc="54x1"),
        changed(merchant__mcc="4294967296"),
        changed(terminal__km_from_home=None),
        changed(terminal__is_online=...),
        changed(terminal__card_present=...),
        changed(last_transaction=...),
        changed(last_transaction={"timestamp": "2026-03-11T14:58:35Z"}),
        changed(last_transaction={"timestamp": "then", "km_from_current": 1.0}),
    ],
)
def test_rejected(spark, body):
    rows, _, _ = parse(spark, body)
    assert not rows[0].valid and rows[0].status == 400


def test_accepted_oddities(spark):
    turned = json.dumps(dict(reversed(LEGIT.items())) | {"extra": [1]})
    many = [f"M{i}" for i in range(33)]
    rows, v, _ = parse(
        spark,
        turned,
        changed(merchant__id="M31", customer__known_merchants=many),
        changed(merchant__id="M32", customer__known_merchants=many),
        changed(merchant__id="abcdefghijklmnop", customer__known_merchants=["abcdefghijklmnopq"]),
        changed(merchant__id="abcdefghijklmnopq", customer__known_merchants=["abcdefghijklmnopq"]),
        changed(terminal__is_online=1),
        changed(customer__avg_amount=0),
        changed(last_transaction={"timestamp": "2026-03-11T19:00:00Z", "km_from_current": 1.0}),
    )
    assert all(r.valid for r in rows.values())
    assert v[0] == parse(spark, json.dumps(LEGIT))[1][0]
    assert [rows[i].is_unknown_merchant for i in (1, 2, 3, 4)] == [False, True, False, True]
    assert rows[5].is_online is False and v[6][2] == 0
    assert rows[7].minutes_since_last == -15.0 and v[7][5] == 0


def test_tags(spark):
    rows = spark.createDataFrame([(True, False, False, False), (False, True, True, True), (False,) * 4, (True,) * 4], "c boolean, o boolean, u boolean, l boolean")
    assert [r[0] for r in rows.select(S.tag(F.col("c"), F.col("o"), F.col("u"), F.col("l"))).collect()] == [8, 7, 0, 15]


def test_quantize(spark):
    xs = [0.0, 1.0, 2.0, -1.0, 0.00005, 0.12345, float("nan"), float("inf"), float("-inf"), None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x float").select(S.clamp01(F.col("x"))).collect()]
    assert got == [0, 10000, 10000, 0, 1, 1235, 0, 10000, 0, None]
    r = spark.createDataFrame([(5.0, float("nan")), (5.0, -1.0), (5.0, 1.0)], "a float, b float").select(S.spend_ratio(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in r] == [0.0, 0.0, 0.5]


def test_answers(spark):
    got = [r[0] for r in spark.range(7).select(response_json(F.col("id").cast("int"))).collect()]
    assert got == [f'{{"approved":{a},"fraud_score":{s}}}' for a, s in (("true", "0.0"), ("true", "0.2"), ("true", "0.4"), ("false", "0.6"), ("false", "0.8"), ("false", "1.0"), ("false", "1.0"))]


def test_files(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps({"entries": [{"request": LEGIT, "expected_approved": True}, {"request": json.loads(changed(transaction__amount=9000)), "expected_approved": False}], "stats": {"total": 2, "fraud_count": 1, "fraud_rate": 0.5, "legit_count": 1, "legit_rate": 0.5, "edge_case_count": 0, "edge_case_rate": 0.0}}, indent=1))
    golden = read_golden_set(spark, str(tmp_path / "set.json"))
    parsed = parse_requests(golden).orderBy("idx").collect()
    assert [(r.idx, r.valid, r.expected_approved, r.amount) for r in parsed] == [(0, True, True, pytest.approx(41.12)), (1, True, False, 9000.0)]
    assert read_golden_stats(spark, str(tmp_path / "set.json")).first().fraud_rate == 0.5
    write_json(golden.select("body"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "lines.txt").write_text(json.dumps(LEGIT) + "\nnope\n")
    assert sorted(r.status for r in read_requests(spark, str(tmp_path / "lines.txt")).collect()) == [200, 400]


def test_times_have_no_zone(spark):
    """An hour that a session's zone skips is a time like any other."""
    texts = ["2026-03-29T02:30:59Z", "2026-03-29 02:30:99", "2026/03/29x02-30-00+05:00", "2026-03-29T02:30", "2026-02-30T00:00:00Z", "2026-03-29T24:00:00Z", "", None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        ts = S.iso_timestamp(F.col("t"))
        got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.hour(ts).alias("h"), S.weekday(ts).alias("w"), S.micros(ts).alias("us")).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [(r.h, r.w) for r in got] == [(2, 6)] * 3 + [(None, None)] * 5
    assert len({r.us for r in got[:3]}) == 1
