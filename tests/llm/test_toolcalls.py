import json
import random

from pyspark.sql import functions as F

from riskloom.llm import toolcalls as tc
from riskloom.llm.queries import ORACLES, op2_tool_calls

PARAMS = [
    ("add", "a", "number", True, 0.0, 10.0, None, None),
    ("add", "b", "integer", False, None, None, None, None),
    ("say", "how", "string", True, None, None, 5, ["loud", "soft"]),
    ("say", "to", "array", False, None, None, None, None),
]


def call(conv, turn, ident, name="add", arguments='{"a": 1}', depends=None, pos=0):
    return (conv, turn, pos, ident, name, arguments, depends)


def run(spark, calls, results):
    got = tc.link(spark.createDataFrame(calls, tc.CALLS), spark.createDataFrame(results, tc.RESULTS), tc.parameters_table(spark, PARAMS))
    return sorted(got.collect(), key=lambda r: (r.conv_id or 0, r.turn or 0, r.call_id or "", r.status))


def test_links(spark):
    calls = [call(1, 0, "x"), call(1, 1, "y"), call(1, 5, "z"), call(1, 7, "x"), call(2, 0, "x"), call(None, 0, "x"), call(3, 0, None)]
    results = [(1, 2, 0, "x", "second"), (1, 2, 0, "x", "first"), (1, 3, 0, "z", "too soon"), (1, 4, 0, "q", "?"), (None, 1, 0, "x", "r")]
    got = [(r.conv_id, r.turn, r.call_id, r.status, r.n_results) for r in run(spark, calls, results)]
    assert sorted(got, key=repr) == sorted([(1, 0, "x", "linked", 2), (1, 1, "y", "no_result", 0), (1, 4, "q", "orphan_result", 1), (1, 5, "z", "early_result", 1), (1, 7, "x", "early_result", 2), (2, 0, "x", "no_result", 0), (3, 0, None, "no_result", 0), (None, 0, "x", "no_result", 0), (None, 1, "x", "orphan_result", 1)], key=repr)


def test_schemas_and_canonical_json(spark):
    cases = [
        ('{ "b" : 2.0, "a":3}', []),
        ('{"a": 11}', ["a: above maximum"]),
        ('{"a": -0.5, "b": 1.5, "z": {"q": 1, "c": [2, {"y": 1, "x": null}]}}', ["a: below minimum", "b: number for integer", "z: unknown parameter"]),
        ('{"b": "2"}', ["a: missing", "b: string for integer"]),
        ('{"a": null}', ["a: null for number"]),
        ("[1]", ["arguments: not an object"]),
        ("{oops", ["arguments: not an object"]),
        (None, ["a: missing"]),
    ]
    got = run(spark, [call(1, i, f"c{i}", arguments=a) for i, (a, _) in enumerate(cases)], [])
    assert [r.violations for r in got] == [v for _, v in cases]
    assert [r.valid for r in got] == [not v for _, v in cases]
    assert json.loads(got[2].json)["arguments"] == json.loads(cases[2][0])
    assert '"arguments":{"a":-0.5,"b":1.5,"z":{"c":[2,{"x":null,"y":1}],"q":1}}' in got[2].json
    same = run(spark, [call(1, 0, "x", arguments='{"b":1,"a":2}'), call(2, 0, "x", arguments=' {"a" : 2,\n"b":1}')], [])
    assert same[0].json == same[1].json
    say = run(spark, [call(1, 0, "s", "say", '{"how":"loud","to":[1]}'), call(1, 1, "t", "say", '{"how":"mute"}'), call(1, 2, "u", "say", '{"how":"louder"}'), call(1, 3, "v", "hum", "{}")], [])
    assert [r.violations for r in say] == [[], ["how: not a choice"], ["how: too long"], ["name: unknown tool"]]


def test_topological_order(spark):
    calls = [call(1, 0, "a"), call(1, 2000, "b", depends=["a", "none"]), call(1, 2000, "c", depends=["a"], pos=1)]
    calls += [call(2, 0, "a", depends=["c"]), call(2, 1, "b", depends=["a"]), call(2, 2, "c"), call(2, 3, "d")]
    calls += [call(3, 0, "p", depends=["q"]), call(3, 1, "q", depends=["p"]), call(3, 2, "r"), call(3, 3, "s", depends=["q"])]
    got = {(r.conv_id, r.call_id): r.topo_order for r in run(spark, calls, [])}
    assert [got[1, x] for x in "abc"] == [1, 2, 3]
    assert [got[2, x] for x in "cdab"] == [1, 2, 3, 4]
    assert [got[3, x] for x in "pqrs"] == [None, None, 1, None]


def plain_levels(edges):
    """The longest way back of each call, None in and after circles."""
    out = {}

    def level(x, above):
        if x in above:
            return None
        if x not in out:
            below = [level(d, above | {x}) for d in edges.get(x, ())]
            if None in below:
                return None
            out[x] = max((1 + b for b in below), default=0)
        return out[x]

    return {x: level(x, frozenset()) for x in edges}


def test_levels_against_brute_force(spark):
    rng = random.Random(6)
    calls, want = [], {}
    for conv in range(40):
        n = rng.randrange(1, 14)
        edges = {i: rng.sample(range(n), min(n, rng.choice([0, 1, 1, 1, 2, 3]))) for i in range(n)}
        if conv % 2:  # no circles
            edges = {i: [d for d in ds if d * 7 % 13 < i * 7 % 13] for i, ds in edges.items()}
        calls += [call(conv, i, str(i), depends=[str(d) for d in ds] + ["none"]) for i, ds in edges.items()]
        levels = plain_levels(edges)
        if any(d >= i for i, ds in edges.items() for d in ds):
            order = sorted((level, i) for i, level in levels.items() if level is not None)
        else:
            order = [(0, i) for i in range(n)]
        want |= {(conv, str(i)): None for i in range(n)} | {(conv, str(i)): k + 1 for k, (_, i) in enumerate(order)}
    # a long chain that runs backwards, and one that branches all the way
    chain = [call(100, i, str(i), depends=[str(i + 1)] if i < 299 else None) for i in range(300)]
    ladder = [call(101, i, str(i), depends=[str(i + 1), str(i + 2)] if i < 4 else None) for i in range(6)]
    want |= {(100, str(i)): 300 - i for i in range(300)} | {(101, str(i)): x for i, x in enumerate([6, 5, 4, 3, 1, 2])}
    got = {(r.conv_id, r.call_id): r.topo_order for r in tc.topological_order(spark.createDataFrame(calls + chain + ladder, tc.CALLS)).collect()}
    assert {k: v for k, v in want.items() if v != got[k]} == {} and len(got) == len(want)


def test_one_number_form_and_any_name(spark):
    params = [('a"b', "integer"), ("it's $.x[0]", "number"), ("s", "string")]
    table = tc.parameters_table(spark, [("odd", n, t, True, None, None, None, None) for n, t in params])
    forms = [("100", "integer", "100"), ("100.0", "integer", "100"), ("1e2", "integer", "100"), ("0.00001", "number", "1.0E-5"), ("1E-5", "number", "1.0E-5"), ("-0", "integer", "0"), ("12345678901234567890123", "integer", "12345678901234567890123"), ("2.50", "number", "2.5")]
    text = r'say \"1e2\" or 3.10 \\ 7e1\n'
    calls = [call(1, i, f"c{i}", "odd", f'{{"a\\"b":{f},"it\'s $.x[0]":{f},"s":"{text}"}}') for i, (f, _, _) in enumerate(forms)]
    got = sorted(tc.link(spark.createDataFrame(calls, tc.CALLS), spark.createDataFrame([], tc.RESULTS), table).collect(), key=lambda r: r.turn)
    for r, (_, kind, shown) in zip(got, forms, strict=True):
        assert r.violations == ([] if kind == "integer" else ['a"b: number for integer'])
        assert f'{{"arguments":{{"a\\"b":{shown},"it\'s $.x[0]":{shown},"s":"{text}"}},' in r.json


def test_odd_rows(spark):
    """Very long texts, repeated rows, nulls in any column, and extra columns with the operator's own names."""
    long = json.dumps({"how": "loud", "to": ["1.0 \\ \" \n" * 200000]})
    calls = [call(1, 0, "a", "say", long), call(1, 0, "a", "say", long), call(1, None, "b", None, None), (None,) * 7, call(1, 3, "c", "add", "\u0001")]
    results = [(1, 1, 0, "a", "x" * 2_000_000), (None,) * 5, (1, 2, 0, "c", None)]
    clash = lambda df: df.select("*", *[F.lit("?").alias(n) for n in ("args", "violations", "level", "first", "status", "json", "__b", "in_cycle", "n_results", "dep")])
    tables = spark.createDataFrame(calls, tc.CALLS), spark.createDataFrame(results, tc.RESULTS)
    plain, wide = (sorted(map(repr, tc.link(*(f(t) for t in tables), tc.parameters_table(spark, PARAMS)).collect())) for f in (lambda t: t, clash))
    assert plain == wide and len(plain) == 6
    row = next(r for r in tc.link(*tables, tc.parameters_table(spark, PARAMS)).collect() if r.call_id == "a")
    assert json.loads(row.json)["arguments"] == json.loads(long) and row.status == "linked"
    empty = spark.createDataFrame([], tc.CALLS), spark.createDataFrame([], tc.RESULTS)
    assert tc.link(*empty, tc.parameters_table(spark, [])).count() == 0


def test_extract(spark):
    call_text = '{"tool_calls":[{"id":"c1","name":"add","arguments":{"a":1,"b":2}},{"id":"c2","name":"say","arguments":{"how":"soft"},"depends":["c1"]}]}'
    rows = [(1, 0, "user", "add please"), (1, 1, "assistant", call_text), (1, 2, "tool", '{"tool_call_id":"c1","content":"3"}'), (1, 3, "assistant", None), (1, 4, "tool", "")]
    calls, results = tc.extract(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = sorted(tc.link(calls, results, tc.parameters_table(spark, PARAMS)).collect(), key=lambda r: r.call_id)
    assert [(r.call_id, r.status, r.valid, r.topo_order) for r in got] == [("c1", "linked", True, 1), ("c2", "no_result", True, 2)]
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert tc.link(*tc.extract(none), tc.parameters_table(spark, PARAMS)).count() == 0


def test_query_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf_dir}/conversations.parquet')")
    want = con.sql(ORACLES["op2_tool_calls"])
    got = op2_tool_calls(spark, sf_dir)
    assert sorted(want.columns) == sorted(got.columns)
    rows = want.fetchall()
    cols = want.columns
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    assert len(rows) > 50
    order = {(r.conv_id, r.turn): r.topo_order for r in got.collect() if r.topo_order}
    assert sum(order.get((c, t + 1), x) < x or order.get((c, t + 2), x) < x for (c, t), x in order.items()) > 10
