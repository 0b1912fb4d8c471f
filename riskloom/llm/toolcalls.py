"""Linking tool calls to their results, in DataFrame functions only.

Calls and results are hash-joined by (conversation, call id); arguments are parsed to variants and checked
against the tool's parameter list; calls get a topological order in their conversation; and each link is
serialised as canonical JSON: keys sorted at every level, no blanks, numbers in one form.

No conversation is ever gathered: links are rows, and ranks come from counts of buckets of turns, so a
conversation may hold any share of the rows. The tools' parameters are few and broadcast, up to a checked
number, so that calls are validated where they are read however few the tools.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import cut

CALLS = "conv_id bigint, turn bigint, pos int, call_id string, name string, arguments string, depends array<string>"
RESULTS = "conv_id bigint, turn bigint, pos int, call_id string, result string"
PARAMETERS = "name string, parameter string, type string, required boolean, minimum double, maximum double, max_length int, choices array<string>"
TURNS_PER_BUCKET = 1024
BROADCAST_PARAMETERS = 20_000


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from messages (conv_id, turn, role, text).

    An assistant's text that is a JSON object with ``tool_calls`` ([{id, name, arguments, depends}]) makes a
    call of each entry; a tool's text that is an object with ``tool_call_id`` is a result with its ``content``.
    Any other text makes neither.
    """
    shape = "tool_calls array<struct<id string, name string, arguments string, depends array<string>>>, tool_call_id string, content string"
    parsed = messages.select("conv_id", "turn", "role", F.from_json("text", shape).alias("m"))
    calls = parsed.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode("m.tool_calls").alias("pos", "c"))
    results = parsed.filter("role = 'tool' and m.tool_call_id is not null")
    return (
        calls.select("conv_id", "turn", "pos", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.depends").alias("depends")),
        results.select("conv_id", "turn", F.lit(0).alias("pos"), F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("result")),
    )


def _type_of(v: Column) -> Column:
    """missing, null, integer (a whole number in any form), number, string, boolean, array or object."""
    s = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull(), "missing")
        .when(F.is_variant_null(v), "null")
        .when((s == "BIGINT") | s.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
        .when((s == "DOUBLE") | (s == "FLOAT") | s.startswith("DECIMAL"), F.when(number == F.rint(number), "integer").otherwise("number"))
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def _violation(fields: Column, p: Column) -> Column:
    v = fields[p["parameter"]]
    kind = _type_of(v)
    number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    said = lambda what: F.concat(p["parameter"], F.lit(": " + what))
    right = (kind == p["type"]) | ((p["type"] == "number") & (kind == "integer"))
    numeric = F.col("__true") & kind.isin("integer", "number")
    return (
        F.when(kind == "missing", F.when(p["required"], said("missing")))
        .when(~right, F.concat(p["parameter"], F.lit(": "), kind, F.lit(" for "), p["type"]))
        .when(numeric & (number < p["minimum"]), said("below minimum"))
        .when(numeric & (number > p["maximum"]), said("above maximum"))
        .when((kind == "string") & (F.length(text) > p["max_length"]), said("too long"))
        .when((kind == "string") & (F.size(p["choices"]) > 0) & ~F.array_contains(p["choices"], text), said("not a choice"))
    )


def validate(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """Add ``args`` (variant) and ``violations`` (array): of the parameters in order of name, then unknown keys.

    Arguments that are no JSON object (or repeat a key) have the one violation "arguments: not an object", a
    tool without any parameter row "name: unknown tool". Missing arguments count as an empty object.
    """
    few = parameters.limit(BROADCAST_PARAMETERS + 1).count() <= BROADCAST_PARAMETERS
    tools = parameters.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("parameter", "type", "required", "minimum", "maximum", "max_length", "choices"))).alias("__params"))
    with_args = calls.withColumn("args", F.try_parse_json(F.coalesce("arguments", F.lit("{}")))).withColumn("__true", F.lit(True))
    joined = with_args.join(F.broadcast(tools) if few else tools, "name", "left").withColumn("__fields", F.try_variant_get("args", "$", "map<string,variant>"))
    keys = F.array_sort(F.map_keys("__fields"))
    unknown = F.transform(F.array_except(keys, F.transform("__params", lambda p: p["parameter"])), lambda k: F.concat(k, F.lit(": unknown parameter")))
    own = F.filter(F.transform("__params", lambda p: _violation(F.col("__fields"), p)), lambda x: x.isNotNull())
    found = F.when(F.col("__params").isNull(), F.array(F.lit("name: unknown tool"))).when(F.col("__fields").isNull(), F.array(F.lit("arguments: not an object"))).otherwise(F.concat(own, unknown))
    return joined.withColumn("violations", found).drop("__params", "__true", "__fields")


def one_number_form(line: Column) -> Column:
    """JSON text in which equal numbers read alike, inside no string.

    A whole number without point or exponent keeps its digits; any other is taken as a double, and written
    without a point if it is whole and below 2**53.
    """
    marked = F.replace(F.replace(line, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))  # JSON text has no such characters
    number = lambda t: F.when((F.abs(t.cast("double")) < 2.0**53) & (t.cast("double") == F.rint(t.cast("double"))), t.cast("double").cast("bigint").cast("string")).otherwise(t.cast("double").cast("string"))
    token = lambda t: F.when(t.rlike(r"^-?[0-9]+[.eE]"), number(t)).otherwise(t)
    tokens = lambda part: F.array_join(F.transform(F.regexp_extract_all(part, F.lit("-?[0-9][-+.0-9eE]*|[^-0-9]+"), F.lit(0)), token), "")
    parts = F.transform(F.split(marked, '"'), lambda part, i: F.when(i % 2 == 1, part).otherwise(tokens(part)))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


NODE = ["conv_id", "call_id"]


def _anchors(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, call_id, dep, steps) of the calls with one dependency, with chains of such calls jumped over.

    ``edges``: distinct (conv_id, call_id, dep). The second result has the calls whose chain runs in a circle,
    or into one: what they reach never ends. Pointers double their reach each round, so a chain of n calls takes
    log n rounds.
    """
    one = edges.groupBy(*NODE).agg(F.min("dep").alias("dep"), F.count("*").alias("n")).filter("n = 1").select(*NODE, "dep", F.lit(1).cast("bigint").alias("steps"))
    one, open_ = cut(one), -1
    while True:
        nxt = one.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("__far"), F.col("steps").alias("__more"))
        one = cut(one.join(nxt, ["conv_id", "dep"], "left").select(*NODE, F.coalesce("__far", "dep").alias("dep"), (F.col("steps") + F.coalesce("__more", F.lit(0))).alias("steps"), F.col("__far").isNotNull().alias("open")))
        still = one.filter("open").count()
        if not still or still == open_:
            break
        open_ = still
    return one.filter("not open").drop("open"), one.filter("open").select(*NODE)


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest way back over dependencies; members of cycles, and what needs them, get none.

    Chains are jumped over first. Between the calls that are left, those with several dependencies, weights
    are ways, and each round settles the calls whose dependencies are settled: one stored table a round, of the
    edges that are still open. So the rounds are those of the longest way from one such call to the next.
    """
    one, circle = _anchors(edges)
    several = edges.groupBy(*NODE).agg(F.count("*").alias("n")).filter("n > 1").select(*NODE)
    far = one.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("__far"), "steps")
    dead = circle.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("__dead"))
    ways = edges.join(several, NODE, "left_semi").join(far, ["conv_id", "dep"], "left").join(dead, ["conv_id", "dep"], "left")
    state = ways.select(*NODE, F.coalesce("__far", "dep").alias("dep"), (F.lit(1) + F.coalesce("steps", F.lit(0))).cast("bigint").alias("steps"), F.coalesce("__dead", F.lit(False)).alias("dead"))
    # a way to a call with several dependencies is open until that call is settled; other ways end at level 0
    targets = several.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("open"))
    state = cut(state.join(targets, ["conv_id", "dep"], "left").select(*NODE, "dep", "steps", (F.coalesce("open", F.lit(False)) | F.col("dead")).alias("open")))
    settled = None
    while True:
        judged = state.groupBy(*NODE).agg(F.max("open").alias("open"), F.max("steps").alias("level"))
        ready = cut(judged.filter("not open").select(*NODE, "level"))
        if ready.isEmpty():
            break
        settled = ready if settled is None else settled.unionByName(ready)
        known = ready.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("__level"))
        rest = state.join(ready.select(*NODE), NODE, "left_anti").join(known, ["conv_id", "dep"], "left")
        state = cut(rest.select(*NODE, "dep", (F.col("steps") + F.coalesce("__level", F.lit(0))).alias("steps"), (F.col("open") & F.col("__level").isNull()).alias("open")))
    ends = several.withColumn("__several", F.lit(True))
    if settled is not None:
        ends = ends.join(settled, NODE, "left")
    else:
        ends = ends.withColumn("level", F.lit(None).cast("bigint"))
    at = ends.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("__level"), "__several")
    chained = one.join(at, ["conv_id", "dep"], "left").filter("__several is null or __level is not null").select(*NODE, (F.col("steps") + F.coalesce("__level", F.lit(0))).alias("level"))
    free = nodes.join(edges.select(*NODE).distinct(), NODE, "left_anti").select(*NODE, F.lit(0).cast("bigint").alias("level"))
    return free.unionByName(chained).unionByName(ends.filter("level is not null").select(*NODE, "level"))


def topological_order(calls: DataFrame) -> DataFrame:
    """Add ``topo_order`` (1, 2, ... in the conversation) and ``in_cycle``.

    Where every dependency stands earlier in the conversation, the order of the conversation is topological.
    Others are ordered by level (the longest way back over dependencies), turn and place. Dependencies on
    unknown ids are ignored; members of cycles, and what depends on them, have a null order. Calls with equal
    ids are one node and keep their own places.
    """
    node = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "pos")).alias("first"))
    edges = calls.select("conv_id", "call_id", F.explode("depends").alias("dep")).filter("conv_id is not null and call_id is not null").distinct().join(node.select("conv_id", F.col("call_id").alias("dep"), F.col("first").alias("dep_first")), ["conv_id", "dep"]).join(node, ["conv_id", "call_id"])
    edges = cut(edges.select("conv_id", "call_id", "dep", (F.col("dep_first") >= F.col("first")).alias("forward")))
    tangled = cut(edges.filter("forward").select("conv_id").distinct())
    if tangled.isEmpty():
        ranked = calls.withColumn("level", F.lit(0)).withColumn("in_cycle", F.lit(False))
    else:
        some = lambda df: df.join(tangled, "conv_id", "left_semi")
        levels = _levels(some(node.select("conv_id", "call_id")), some(edges.select("conv_id", "call_id", "dep")))
        marked = calls.join(tangled.withColumn("__t", F.lit(True)), "conv_id", "left").join(levels, ["conv_id", "call_id"], "left")
        ranked = marked.withColumn("in_cycle", F.col("__t").isNotNull() & F.col("level").isNull()).withColumn("level", F.when(F.col("__t").isNull(), 0).otherwise(F.col("level"))).drop("__t")
    # rank inside (conversation, level, bucket of turns), plus the counts of what stands before
    bucketed = ranked.withColumn("__b", F.floor(F.coalesce("turn", F.lit(0)) / TURNS_PER_BUCKET))
    sizes = bucketed.filter("not in_cycle").groupBy("conv_id", "level", "__b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("level", "__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("conv_id", "level", "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    own = Window.partitionBy("conv_id", "level", "__b").orderBy("turn", "pos", "call_id")
    numbered = bucketed.withColumn("__nr", F.row_number().over(own))
    o = offsets.alias("o")
    same = numbered["conv_id"].eqNullSafe(F.col("o.conv_id")) & (numbered["level"] == F.col("o.level")) & (numbered["__b"] == F.col("o.__b"))
    return numbered.join(o, same, "left").select(*[numbered[c] for c in calls.columns], F.when(~numbered["in_cycle"], numbered["__nr"] + F.col("__before")).cast("bigint").alias("topo_order"), numbered["in_cycle"])


def link(calls: DataFrame, results: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row for each call, and for each result without one.

    Returns conv_id, turn, call_id, name, status, valid, violations, n_results, topo_order, json. A call takes
    the first result (by turn, place, text) with its id; status is linked, no_result, early_result (the
    first result stands before the call) or orphan_result. Calls with equal ids share their results. Null
    conversations or ids match nothing. Empty tables give empty results; extra columns are not read.
    """
    calls = calls.select(*[c.split()[0] for c in CALLS.split(", ")])
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "pos", "result")).alias("first"), F.count("*").alias("n_results"))
    ordered = topological_order(validate(calls, parameters))
    joined = ordered.join(first, ["conv_id", "call_id"], "full_outer")
    orphan = F.col("violations").isNull()
    early = F.struct(F.col("first.turn"), F.col("first.pos")) < F.struct("turn", "pos")
    status = F.when(orphan, "orphan_result").when(F.col("first").isNull(), "no_result").when(early, "early_result").otherwise("linked")
    rows = joined.select(
        "conv_id",
        F.coalesce("turn", "first.turn").alias("turn"),
        "call_id",
        "name",
        status.alias("status"),
        (F.size(F.coalesce("violations", F.array().cast("array<string>"))) == 0).alias("valid"),
        F.coalesce("violations", F.array().cast("array<string>")).alias("violations"),
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        "topo_order",
        "args",
        F.col("first.result").alias("result"),
    )
    line = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), "name", "result", "status", "violations"), {"ignoreNullFields": "false"})
    return rows.withColumn("json", one_number_form(line)).drop("args", "result")


def parameters_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Parameter rows (see PARAMETERS) as a table."""
    return spark.createDataFrame(rows, PARAMETERS)


#: The schemas of the conversation query: what a turn may ask or instruct.
TURN_PARAMETERS = [
    ("ask", "chars", "integer", True, 1.0, 400.0, None, None),
    ("ask", "text", "string", True, None, None, 600, None),
    ("ask", "turn", "integer", True, 0.0, None, None, None),
    ("instruct", "chars", "integer", True, 1.0, None, None, None),
    ("instruct", "text", "string", True, None, None, 200, None),
    ("instruct", "turn", "integer", True, 0.0, 0.0, None, None),
]


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations.

    A user's turn asks and a system turn instructs; each is a call with its text, length and turn as arguments,
    spoilt by the first digit of its id's MD5: 0 has no turn, 1 a key too many, 2 the length as text, and 3
    writes the length as a decimal. A call depends on the calls up to two turns before and after whose MD5 is
    smaller, so many must wait for later ones, and none in a circle. An assistant's turn is the result of
    the call in the turn before.
    """
    m = messages.select("conv_id", "turn", "role", "text")
    name = F.when(F.col("role") == "user", "ask").when(F.col("role") == "system", "instruct")
    ident = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    digest = lambda x: F.md5(x.cast("binary"))
    kind, n = F.substring(digest(ident(F.col("turn"))), 1, 1), F.length("text")
    json = lambda chars, *more: F.to_json(F.struct(chars.alias("chars"), "text", *more))
    arguments = F.when(kind == "0", json(n)).when(kind == "1", json(n, "turn", F.lit(True).alias("extra"))).when(kind == "2", json(n.cast("string"), "turn")).when(kind == "3", json(n.cast("double"), "turn")).otherwise(json(n, "turn"))
    near = F.array(*[ident(F.col("turn") + d) for d in (-2, -1, 1, 2)])
    depends = F.filter(near, lambda x: digest(x) < digest(ident(F.col("turn"))))
    calls = m.filter("role in ('user', 'system')").select("conv_id", "turn", F.lit(0).alias("pos"), ident(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), depends.alias("depends"))
    results = m.filter("role = 'assistant'").select("conv_id", "turn", F.lit(0).alias("pos"), ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("result"))
    return calls, results
