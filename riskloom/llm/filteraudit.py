"""What each filter of a chain removes, in every order of the filters.

A document fails a set of filters, whatever else was applied before. So an order of k filters is a way
through the lattice of subsets, and what happens at a step hangs on its edge alone: the subset applied
already, and the filter that comes next. Five filters have 80 edges. Documents are counted by part and failed
set, each such count goes to all edges, and the sums of the edges are joined to the steps of all orders (600),
so no document is looked at once an order.

Of the documents of a part, at edge (applied, next):

* kept: fail neither ``next`` nor any filter applied;
* removed: fail ``next`` and none applied;
* redundant: fail ``next`` and some applied;
* unique_fails: fail ``next`` and no other filter, applied or not;
* good_lost, toxic_lost: removed, and marked good or toxic.

``shapley`` of a filter is what it removes, summed over all orders: each edge counts as often as orders
pass it, applied! (k - 1 - applied)! times.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut

#: At most so many filters: 8 have 1024 edges and 322,560 steps a part.
MOST_FILTERS = 8
SPACE = " \t\n\x0b\f\r"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def words(text: Column) -> Column:
    """The words of a text: what stands between runs of ASCII white space."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def text_filters(text: Column, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 2, marks: str = "[#$%&*|]") -> dict[str, Column]:
    """The failure conditions that a text meets by itself, by letter; ``text`` is not null.

    A: under ``least_words`` words; B: under ``least_distinct`` % of them distinct; C: over ``most_capitals`` % of the code
    points are A-Z; D: holds any of ``marks``.
    """
    w = words(text)
    n, distinct = F.size(w), F.size(F.array_distinct(w))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < least_words,
        "B": 100 * distinct < least_distinct * n,
        "C": 100 * capitals > most_capitals * F.length(text),
        "D": text.rlike(marks),
    }


def failed_sets(docs: DataFrame, labels: DataFrame | None = None, filters=text_filters, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, failed, good, toxic), a row a document: ``failed`` has a bit for each filter, the last for copies (E).

    A copy has the text of a row with a smaller id, in any part, removed or not; texts are told apart by SHA-256. A
    row without an id is never a copy, and makes none. Null texts are empty; a null part is ''. ``labels``: doc_id,
    quality, toxic; an id with several rows is good or toxic if any row says so, a row without an id says nothing.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters(F.col("body")).values())]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    # stored: small rows, read for the first of each text and again to be marked
    facts = cut(rows.select("doc_id", "part", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"), sum(bits[1:], bits[0]).alias("failed")))
    # stored too: then the join deals both sides anew, and a hot text's rows can be split
    first = cut(facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    marked = facts.join(first, "digest", "left").select("doc_id", "part", F.when(copy, F.col("failed") + (1 << len(bits))).otherwise(F.col("failed")).alias("failed"))
    if labels is None:
        return marked.select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    any_ = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(any_("quality").alias("good"), any_("toxic").alias("toxic"))
    known = known.filter("good or toxic")
    joined = marked.join(known, F.col("doc_id") == F.col("labelled"), "left")
    return joined.select("part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def lattice_edges(failed: DataFrame, letters: str) -> DataFrame:
    """(part, applied, next, COUNTS, ways), a row for each edge of each part of ``failed_sets``, zeros included.

    ``applied`` has the bits of the filters applied, ``next`` the bit of the one that follows.
    """
    k = len(letters)
    edges = [(sum(1 << b for b in s), 1 << f, factorial(n) * factorial(k - 1 - n)) for f in range(k) for n in range(k) for s in combinations([b for b in range(k) if b != f], n)]
    edge = F.explode(F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(b).alias("next"), F.lit(w).cast("bigint").alias("ways")) for a, b, w in edges]))
    sets = failed.groupBy("part", "failed").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    m, before, own = F.col("failed"), F.col("failed").bitwiseAND(F.col("applied")) != 0, F.col("failed").bitwiseAND(F.col("next")) != 0
    total = lambda c, when, name: F.sum(F.when(when, F.col(c)).otherwise(0)).alias(name)
    sums = [
        total("n", ~own & ~before, "kept"),
        total("n", own & ~before, "removed"),
        total("n", own & before, "redundant"),
        total("n", m == F.col("next"), "unique_fails"),
        total("good", own & ~before, "good_lost"),
        total("toxic", own & ~before, "toxic_lost"),
    ]
    spread = sets.select("*", edge.alias("edge")).select("*", "edge.applied", "edge.next", "edge.ways")
    return spread.groupBy("part", "applied", "next", "ways").agg(*sums)


def order_steps(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, applied, next) of every step of every order of ``letters``."""
    out = []
    for order in permutations(letters):
        applied = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            out.append(("".join(order), step, applied, bit))
            applied |= bit
    return out


def audit(failed: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, COUNTS, shapley): one row for each part, order of ``letters`` and step.

    Every part with a row has all rows, zeros included; no rows give no result. The number of rows a part does not grow
    with the documents.
    """
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} distinct letters")
    edges = cut(lattice_edges(failed, letters))
    value = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("ways")).alias("shapley"))
    steps = failed.sparkSession.createDataFrame(order_steps(letters), "filter_order string, step int, applied int, next int")  # k k! rows
    return edges.join(value, ["part", "next"]).join(F.broadcast(steps), ["applied", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")
