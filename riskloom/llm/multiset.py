"""Homomorphic multiset fingerprints, in DataFrame functions only.

A text is a multiset of paragraphs (lines). Each paragraph hashes to a wide vector, and a fingerprint is
the sum of the vectors, lane by lane, modulo a power of two: the order of the paragraphs does not matter,
and paragraphs are inserted or deleted by adding or subtracting their vectors (``combine``).

* ``ID_LANES`` identity lanes hold 64-bit hashes of the whole paragraph, summed modulo 2**64: equal
  multisets agree in all, others differ in them but for chance.
* ``LANES`` likeness lanes hold, for each run of three words of the paragraph, the bits of two 64-bit
  hashes, one bit a lane, summed modulo 2**32, and one more lane the number of runs. With n runs and s set
  bits, 2 s - n is a sum of random signs, so the cosine of two such vectors estimates the cosine of the
  two multisets of runs, whatever their size. Likeness is that estimate, cut to 0..1.

Sums modulo 2**64 are kept as two sums of 32-bit halves, and two 32-bit lanes share one bigint, so all
arithmetic stays in bigint aggregates of generated code. Words are split at spaces of any ASCII kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_sample

ID_LANES = 4
LANES = 128
RUN = 3
_MASK = (1 << 32) - 1
_PAIR = 0x0000000100000001

#: Lane columns of a fingerprint row: halves of the identity lanes, pairs of likeness lanes, runs.
ID_COLUMNS = [f"id{i}{half}" for i in range(ID_LANES) for half in ("h", "l")]
LIKE_COLUMNS = [f"like{i}" for i in range(LANES // 2)]
LANE_COLUMNS = [*ID_COLUMNS, *LIKE_COLUMNS, "runs"]


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: its lines; a null or empty text is one empty paragraph."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def words_of(paragraph: Column) -> Column:
    """The words of a paragraph, between blanks of any ASCII kind."""
    return F.filter(F.split(F.translate(paragraph, "\t\x0b\f\r", "    "), " "), lambda w: w != "")


def runs_of(words: Column) -> Column:
    """64-bit hashes of the runs of three of ``words``; fewer, but not none, are one run."""
    whole = F.array(F.xxhash64(F.array_join(words, " "), F.lit(17)))
    at = lambda w, i, k: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.lit(k))
    return F.when(F.size(words) >= RUN, F.transform(F.sequence(F.lit(0), F.size(words) - RUN), lambda i: at(words, i, 17))).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def lane_sums(paragraph: Column, run: Column, again: Column, head: Column) -> list[Column]:
    """Aggregates over exploded runs: identity lanes are added once a paragraph, where ``head`` is true.

    ``again`` is a second hash of ``run``, null with it.
    """
    out = []
    for i in range(ID_LANES):
        h = F.xxhash64(paragraph, F.lit(1009 + i))
        out += [F.sum(F.when(head, F.shiftrightunsigned(h, 32))).alias(f"id{i}h"), F.sum(F.when(head, h.bitwiseAND(F.lit(_MASK)))).alias(f"id{i}l")]
    out += [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR))).alias(f"like{32 * k + i}") for k, h in enumerate((run, again)) for i in range(32)]
    return [*out, F.count(run).alias("runs")]


def reduced() -> list[Column]:
    """The lane columns brought back into their moduli, null sums as 0."""
    out = []
    for i in range(ID_LANES):
        low, high = F.coalesce(F.col(f"id{i}l"), F.lit(0)), F.coalesce(F.col(f"id{i}h"), F.lit(0))
        out += [(high + F.shiftright(low, 32)).bitwiseAND(F.lit(_MASK)).alias(f"id{i}h"), low.bitwiseAND(F.lit(_MASK)).alias(f"id{i}l")]
    out += [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in LIKE_COLUMNS]
    return [*out, F.coalesce(F.col("runs"), F.lit(0).cast("bigint")).alias("runs")]


def packed() -> Column:
    """The lanes as one array of bigint, in the order of LANE_COLUMNS."""
    return F.array(*reduced())


def render(lanes: Column) -> Column:
    """Lanes as a hexadecimal string; equal strings exactly for equal lanes."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the union of two multisets, or (sign -1) of ``a`` without the paragraphs of ``b``."""
    n_id = len(ID_COLUMNS)

    def lane(x: Column, y: Column, i: Column) -> Column:
        s = F.lit(sign)
        low = x.bitwiseAND(F.lit(_MASK)) + s * y.bitwiseAND(F.lit(_MASK))
        high = F.shiftrightunsigned(x, 32) + s * F.shiftrightunsigned(y, 32)
        both = F.shiftleft(high.bitwiseAND(F.lit(_MASK)), 32).bitwiseOR(low.bitwiseAND(F.lit(_MASK)))
        carried = F.when(i % 2 == 0, F.get(a, i + 1) + s * F.get(b, i + 1))
        return F.when(i >= n_id, both).when(i % 2 == 0, (x + s * y + F.shiftright(carried, 32)).bitwiseAND(F.lit(_MASK))).otherwise(low.bitwiseAND(F.lit(_MASK)))

    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y"), F.sequence(F.lit(0), F.lit(len(LANE_COLUMNS) - 1)).alias("i")), lambda z: lane(z["x"], z["y"], z["i"]))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the signed likeness lanes, cut to 0..1; 0 if one has no run."""
    from_, n = len(ID_COLUMNS), len(LANE_COLUMNS) - 1
    signed = lambda v, x: [2.0 * F.shiftrightunsigned(x, 32) - F.get(v, F.lit(n)), 2.0 * x.bitwiseAND(F.lit(_MASK)) - F.get(v, F.lit(n))]

    def add(acc: Column, i: Column) -> Column:
        (x1, x2), (y1, y2) = signed(a, F.get(a, i)), signed(b, F.get(b, i))
        return F.struct((acc["xy"] + x1 * y1 + x2 * y2).alias("xy"), (acc["xx"] + x1 * x1 + x2 * x2).alias("xx"), (acc["yy"] + y1 * y1 + y2 * y2).alias("yy"))

    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    cosine = lambda s: F.when((s["xx"] > 0) & (s["yy"] > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), s["xy"] / F.sqrt(s["xx"] * s["yy"])))).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.aggregate(F.sequence(F.lit(from_), F.lit(n - 1)), zero, add, cosine))


def fingerprint_groups(rows: DataFrame, keys: list[str], texts: dict[str, Column]) -> DataFrame:
    """``keys`` and, for each name in ``texts``, the lanes of that text, from one pass and one aggregation.

    The rows' partitioning is kept: if they are dealt by some of ``keys``, no shuffle is added.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in enumerate(texts.values())])
    lines = rows.select(*keys, F.explode(kinds).alias("t")).select(*keys, F.col("t.kind").alias("kind"), F.explode(paragraphs(F.col("t.text"))).alias("line"))
    # a generator between them keeps the optimizer from splitting the line again for each run
    words = lines.select(*keys, "kind", "line", F.explode(F.array(words_of(F.col("line")))).alias("words"))
    runs = words.select(*keys, "kind", "line", F.posexplode_outer(runs_of(F.col("words"))).alias("at", "run"))
    runs = runs.withColumn("again", F.when(F.col("run").isNotNull(), F.xxhash64("run", F.lit(23))))
    head = F.coalesce(F.col("at"), F.lit(0)) == 0
    sums = runs.groupBy(*keys, "kind").agg(*lane_sums(F.col("line"), F.col("run"), F.col("again"), head)).select(*keys, "kind", packed().alias("lanes"))
    return sums.groupBy(*keys).agg(*[F.max(F.when(F.col("kind") == k, F.col("lanes"))).alias(name) for k, name in enumerate(texts)])


MOST_BUCKETS = 1 << 16
_LEAST = -(2**63)


def _literal(values: list[int]) -> Column:
    """An array constant; text keeps the plan small however long it is."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _order_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """What rows are ordered by: the id (null as the least bigint), then a hash of the text."""
    return F.coalesce(doc_id, F.lit(_LEAST).cast("bigint")), F.xxhash64(text)


def deal_by_id(docs: DataFrame, doc_id: str, text: str, rows_per_bucket: int) -> DataFrame:
    """Rows with ``bucket``, ascending in doc_id, and ``halo``: copies of each bucket's first rows in the bucket before.

    Borders are keys (id, hash of text) of rows of a sample of some 16 rows a bucket (at most 16 * MOST_BUCKETS, by
    a hash of the key), so that buckets hold about ``rows_per_bucket`` rows however the ids lie, even if all are
    equal; a table of more rows than MOST_BUCKETS times that has larger buckets. Rows alike in id and text can't
    be told apart and share a bucket. The last bucket holds copies of the first one's first rows.
    """
    ident, h = _order_key(F.col(doc_id), F.col(text))
    keys = docs.select(ident.alias("i"), h.alias("h"))
    stats = keys.agg(F.count("*").alias("n"), F.min(F.struct("i", "h")).alias("least")).first()
    if not stats.n:
        return docs.withColumn("bucket", F.lit(0).cast("bigint")).withColumn("halo", F.lit(False))
    wanted = max(1, min(MOST_BUCKETS, stats.n // rows_per_bucket))
    sample = bounded_sample(keys, F.struct("i", "h"), 16 * wanted).distinct().orderBy("i", "h").toArrow()
    ids, hashes = sample.column("i").to_pylist(), sample.column("h").to_pylist()
    at = sorted({len(ids) * k // wanted for k in range(1, wanted)} - {0})
    firsts = [(stats.least.i, stats.least.h), *((ids[i], hashes[i]) for i in at if (ids[i], hashes[i]) > tuple(stats.least))]
    n, of_id, of_h = len(firsts), _literal([f[0] for f in firsts]), _literal([f[1] for f in firsts])
    # the last border not over the row's key, by halving
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, (n - 1).bit_length()) - 1, -1, -1)])
    below = lambda i: (F.get(of_id, i) < F.col("__i")) | ((F.get(of_id, i) == F.col("__i")) & (F.get(of_h, i) <= F.col("__h")))
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at + step), at + step).otherwise(at)).cast("bigint")
    own = docs.withColumn("__i", ident).withColumn("__h", h).withColumn("bucket", bucket)
    is_first = (F.get(of_id, F.col("bucket").cast("int")) == F.col("__i")) & (F.get(of_h, F.col("bucket").cast("int")) == F.col("__h"))
    places = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo")))
    before = F.array(F.struct(F.pmod(F.col("bucket") - 1, F.lit(n)).alias("bucket"), F.lit(True).alias("halo")))
    return own.withColumn("place", F.explode(F.when(is_first, F.concat(places, before)).otherwise(places))).select(*docs.columns, "place.bucket", "place.halo")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_bucket: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: its fingerprint, that of its edited text, and their likeness.

    Returns doc_id, n_chars, edited (text), lanes, edited_lanes, near_edited, near_next. The next document
    is the one after in ascending doc_id; equal ids follow in the order of a hash of their texts, a null id
    counts as the least bigint, and after the last comes the first. A null text is empty. A single row is its own next.
    An empty table gives no rows; other columns of ``docs`` are not read.

    The texts are shuffled once, by bucket of doc_id: the window, the sums of lanes and the look at the next
    fingerprint all use that one partitioning.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = deal_by_id(rows, "doc_id", "text", rows_per_bucket)
    order = [F.col("halo"), *_order_key(F.col("doc_id"), F.col("text")), F.col("text"), F.col("doc_id")]
    ordered = dealt.withColumn("nr", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).withColumn("next_text", F.lead("text").over(Window.partitionBy("bucket").orderBy(*order)))
    pairs = ordered.withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    keys = ["bucket", "nr", "halo", "doc_id", "n_chars", "edited_sha256"]
    named = pairs.select("bucket", "nr", "halo", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited")
    prints = fingerprint_groups(named, keys, {"lanes": F.col("text"), "edited_lanes": F.col("edited")})
    following = F.lead("lanes").over(Window.partitionBy("bucket").orderBy("nr"))
    beside = prints.withColumn("next_lanes", following).filter(~F.col("halo"))
    return beside.select("doc_id", "n_chars", "edited_sha256", "lanes", "edited_lanes", likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"))
