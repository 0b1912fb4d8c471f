"""Near copies: SimHash links and, where those can't see them, texts that share four fifths of their five-word shingles.

Fingerprints three bits apart find nearly identical texts, but few of those whose shingle sets have a Jaccard similarity of
0.8. So a second net adds candidates by bands of least hashes, and every candidate pair is verified on the whole sets. At
similarity 0.8 a pair meets in one of the 16 bands of 7 hashes with probability 0.977, at 0.85 with 0.998.

Nodes are fingerprints. In a bucket with more than one of them, every member is held against one member. These links, those of
SimHash and those of equal sets make components, and only then are all members of a bucket that are still of unlike components
held against each other: as pairs in a bucket of 16 sets or fewer, in meetings of two blocks of sets in a larger one. So a set's
shingles are sent once for each block that it meets, not once for each set, and a task holds two blocks. The comparisons are
those of all unlike pairs of a bucket: quadratic for a bucket of many sets that are unlike one another, which is no near copy
of any size, since near copies are one component by then.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, fresh, row_key
from riskloom.llm.components import connected_components
from riskloom.llm.simhash import LOWER, fingerprint, golay_links

WIDTH = 5  # words of a shingle
SIMILARITY = (4, 5)  # of the shingle sets: at least 4/5
BANDS, ROWS = 16, 7
WORDS_KEPT = 1 << 16  # word hashes remembered by a Python worker
SHINGLES_AT_ONCE = 1 << 12
PAIRS = 16  # members of a bucket that are joined as pairs, at most
MEETING = 1 << 19  # shingles of a block, about

_FACTORS = np.array([xxhash.xxh32_intdigest(b"factor%d" % i) | 1 for i in range(BANDS * ROWS)], dtype=np.uint32)
_SHIFTS = np.array([xxhash.xxh32_intdigest(b"shift%d" % i) for i in range(BANDS * ROWS)], dtype=np.uint32)


class _Words(dict):
    """Hashes of words, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle, no words give none."""
    words = text.encode().translate(LOWER).split() if text else []
    n = min(WIDTH, len(words))
    if not n:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(total)]
        total ^= total >> np.uint64(29)
    return np.unique((total * np.uint64(0xBF58476D1CE4E5B9)) ^ (total >> np.uint64(32)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A signed key for each band of least hashes of a shingle set that isn't empty."""
    x, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), SHINGLES_AT_ONCE):
        least = np.minimum(least, (x[at : at + SHINGLES_AT_ONCE, None] * _FACTORS + _SHIFTS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), seed=i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def _sketch(text: str) -> Column:
    """fp, set_id, size and bands of a column of texts, as a struct."""

    @F.pandas_udf("fp bigint, set_id bigint, size bigint, bands array<bigint>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        hashes, sizes, keys = np.zeros((len(texts), 2), dtype=np.uint64), np.zeros(len(texts), dtype=np.int64), []
        for i, text in enumerate(texts):
            own = shingles(text)
            hashes[i], sizes[i] = (fingerprint(text), xxhash.xxh64_intdigest(own.tobytes())), len(own)
            keys.append(bands(own) if len(own) else np.empty(0, dtype=np.int64))
        return pd.DataFrame({"fp": hashes[:, 0].view(np.int64), "set_id": hashes[:, 1].view(np.int64), "size": sizes, "bands": keys})

    return sketch(F.col(text))


def _shingles(text: str) -> Column:
    @F.pandas_udf("array<bigint>")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)

    return own(F.col(text))


def _like(inter, a, b):
    part, whole = SIMILARITY
    return inter * whole >= (a + b - inter) * part


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: set ids, and any others) whose whole shingle sets are alike enough, stored."""
    asked = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    own = _own_shingles(docs, sets, asked)
    both = pairs.join(own.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa")), "a").join(own.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb")), "b")
    alike = _like(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))
    return cut(both.filter(alike).select(pairs.columns))


def _own_shingles(docs: DataFrame, sets: DataFrame, asked: DataFrame) -> DataFrame:
    """set_id and shingles of the sets of ``asked`` (distinct)."""
    rows = asked.join(sets, "set_id").select("set_id", "key")
    own = docs.select("text", row_key("doc_id", "text").alias("key")).join(rows, "key").select("set_id", _shingles("text").alias("shingles"))
    return own.groupBy("set_id").agg(F.first("shingles").alias("shingles"))  # repeated rows have one key


def _meet(table: pa.Table) -> pa.Table:
    """(src, dst): the roots of all sets of a meeting (x, y, block, root, shingles) that are alike enough and of unlike roots."""
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    block, root = np.array(table.column("block").to_pylist()), table.column("root").to_numpy()
    lists = table.column("shingles").combine_chunks()
    size, codes = lists.value_lengths().to_numpy(), np.unique(lists.flatten().to_numpy(), return_inverse=True)[1].ravel()
    ends = np.cumsum(size)
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    of_right = np.repeat(block == y, size)
    across, starts = codes[of_right], np.cumsum(size[right]) - size[right]
    there, links = np.zeros(len(codes), dtype=bool), []
    for i in left if len(right) else ():
        unlike = root[right] > root[i] if x == y else root[right] != root[i]
        if unlike.any():
            mine = codes[ends[i] - size[i] : ends[i]]
            there[mine] = True
            inter = np.add.reduceat(there[across], starts, dtype=np.int64)
            there[mine] = False
            far = np.unique(root[right][unlike & _like(inter, size[i], size[right])])
            links.append(np.stack([np.full(len(far), root[i]), far]))
    src, dst = np.unique(np.concatenate(links, axis=1), axis=1) if links else np.zeros((2, 0), np.int64)
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def _met(docs: DataFrame, sets: DataFrame, rows: DataFrame, meeting: int) -> DataFrame:
    """(src, dst): links between the roots of all alike sets of each bucket of ``rows`` (band, set_id, root, size).

    A bucket's sets are dealt into blocks of about ``meeting`` shingles: those of a root that fills half a block into blocks of
    its own, the others by root. Every two blocks meet, but for those of one and the same root.
    """
    weights = cut(rows.groupBy("band", "root").agg(F.sum("size").alias("w")))
    large = F.col("w") * 2 >= meeting
    small = weights.groupBy("band").agg(F.sum(F.when(~large, F.col("w"))).alias("small"))
    parts = weights.join(small, "band").select("band", "root", large.alias("large"), F.ceil(F.when(large, F.col("w")).otherwise(F.col("small")) / meeting).alias("parts"))
    part = F.pmod(F.xxhash64(F.when(F.col("large"), F.col("set_id")).otherwise(F.col("root"))), "parts")
    placed = cut(rows.join(parts, ["band", "root"]).select("band", "set_id", "root", F.concat_ws(":", F.when(F.col("large"), F.col("root")), part).alias("block")))
    blocks = cut(placed.groupBy("band", "block").agg(F.min("root").alias("least"), F.max("root").alias("most")))
    two = (F.col("x.band") == F.col("y.band")) & (F.col("x.block") <= F.col("y.block")) & (F.least("x.least", "y.least") != F.greatest("x.most", "y.most"))
    meetings = blocks.alias("x").join(blocks.alias("y"), two).select("x.band", F.col("x.block").alias("x"), F.col("y.block").alias("y"))
    sides = meetings.withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))
    own = _own_shingles(docs, sets, placed.select("set_id").distinct())
    sent = placed.join(sides, ["band", "block"]).join(own, "set_id").select("band", "x", "y", "block", "root", "shingles")
    return cut(sent.groupBy("band", "x", "y").applyInArrow(_meet, "src bigint, dst bigint"))


def near_copy_roots(docs: DataFrame, marked: DataFrame, meeting: int = MEETING) -> DataFrame:
    """(fp, root): the component of each fingerprint of ``marked`` (key, fp, set_id, size, bands), made from ``docs``."""
    held = marked.filter("size > 0")
    sets = cut(held.groupBy("set_id").agg(F.min("fp").alias("fp"), F.min("key").alias("key"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    part, whole = SIMILARITY
    close = F.least("m.size", "o.size") * whole >= F.greatest("m.size", "o.size") * part
    ends = [F.least("m.set_id", "o.set_id").alias("a"), F.greatest("m.set_id", "o.set_id").alias("b")]

    members = sets.select("set_id", "fp", "size", F.explode("bands").alias("band"))
    one = members.groupBy("band").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.min(F.struct("set_id", "fp", "size")).alias("one")).filter("least <> most").select("band", "one.*")
    star = (F.col("m.band") == F.col("o.band")) & (F.col("m.fp") != F.col("o.fp")) & close
    tried = cut(members.alias("m").join(one.alias("o"), star).select(*ends, F.col("m.fp").alias("src"), F.col("o.fp").alias("dst")).dropDuplicates(["a", "b"]))

    alone = cut(marked.select("fp").distinct())
    equal = held.select("set_id", "fp").distinct().join(sets.select("set_id", F.col("fp").alias("dst")), "set_id").filter("fp <> dst").select(F.col("fp").alias("src"), "dst")
    found = connected_components(golay_links(alone).unionByName(equal).unionByName(_verified(docs, sets, tried).select("src", "dst")))
    roots = cut(alone.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")))

    members = sets.join(roots, "fp").select("set_id", "root", "size", F.explode("bands").alias("band"))
    live = members.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).filter("least <> most").select("band", "n")
    rows = cut(members.join(live, "band"))
    few = rows.filter(F.col("n") <= PAIRS)
    unlike = (F.col("m.band") == F.col("o.band")) & (F.col("m.root") < F.col("o.root")) & close
    rest = few.alias("m").join(few.alias("o"), unlike).select(*ends, F.col("m.root").alias("src"), F.col("o.root").alias("dst")).dropDuplicates(["a", "b"])
    links = _verified(docs, sets, cut(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti"))).select("src", "dst")
    many = rows.filter(F.col("n") > PAIRS)
    if not many.isEmpty():
        links = links.unionByName(_met(docs, sets, many, meeting))
    if links.isEmpty():
        return roots
    found = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return roots.join(found, "root", "left").select("fp", F.coalesce("to", "root").alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, all columns kept: the one with the smallest doc_id.

    Rows are linked if their SimHash fingerprints (three words) differ in at most three bits, or if their sets of five-word
    shingles have a Jaccard similarity of 0.8 or more. Those are found with probability 0.977 and more; groups are what links connect. Among equal ids the least hash of id and text decides, a null id comes last, and of rows alike in both one
    stays. Null, empty and wordless texts are one group; texts of fewer than five words have one shingle. Texts of any length
    are read whole. An empty table gives no rows. Columns of any other name are kept.
    """
    row = row_key("doc_id", "text")
    marked = cut(docs.select("doc_id", row.alias("key"), _sketch("text").alias("s")).select("doc_id", "key", "s.*"))
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)), F.col("key"))
    by_fp = marked.groupBy("fp").agg(F.min(place).alias("first"))  # before the join: a hot fingerprint is one row
    (own,) = fresh(docs.columns, "row")
    roots = near_copy_roots(docs, marked)
    keep = by_fp.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(own)).distinct()
    return docs.withColumn(own, row).join(keep, own, "left_semi").dropDuplicates([own]).select(docs.columns)
