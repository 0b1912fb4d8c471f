"""Benchmark decontamination over a distributed positional inverted index.

The training texts are indexed once: each shard (a few megabytes of whole texts) stores its sorted term
hashes and, for each term, the ascending token positions, delta-coded and compressed. Shards are rows of
a table in the shared folder, so building needs no shuffle, a lost executor costs no rebuild, and any
number of benchmark blocks can be searched against the same index. A search takes, for each query
window, the posting list of the term that is rarest in the shard, shifts it by the term's place in the
window, and intersects it with the other shifted lists from rare to frequent. What survives is an exact
phrase match; the proximity search asks each other term to lie near instead.

Queries are read in blocks of at most ``BLOCK_WORDS`` words, and each block is sent to the executors as
one broadcast of proven size; more blocks mean more passes over the index, and spans are merged per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, fresh, row_key
from riskloom.llm.words import ALNUM, Words, blocks, hash_tokens

WINDOW = 13
SHARD_BYTES = 8 << 20
BLOCK_WORDS = 2_000_000

#: Lower-case A-Z only; words are runs of these bytes of UTF-8: 0-9, a-z, 0x80-0xFF.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPLIT = bytes(b if ALNUM[b] else 32 for b in _LOWER)

INDEX_SCHEMA = "keys binary, word_counts binary, terms binary, starts binary, postings binary, n_terms bigint, n_postings bigint"


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int, kind: type) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(blob, size, codec="zstd", asbytes=True), dtype=kind) if n else np.zeros(0, dtype=kind)


def build_index(docs: DataFrame, text: str = "text", key: Column | None = None, key2: Column | None = None) -> DataFrame:
    """Shards of a positional index over whole texts; ``key`` (a bigint, doc_id unless given) names a row, with ``key2`` if given.

    A null text has no words and is kept with none. Keys may repeat, and may be null.
    """
    key = (F.col("doc_id") if key is None else key).cast("bigint")
    rows = docs.select(F.coalesce(key, F.lit(0)).alias("key"), F.col(text).alias("text"), (F.lit(0) if key2 is None else key2).cast("bigint").alias("key2"), key.isNull().cast("bigint").alias("void"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3)])
            for lo, hi, data, off in blocks(batch.column(1), SHARD_BYTES):
                words = Words(data, off, ALNUM)
                hashes = words.hashes()
                order = np.argsort(hashes, kind="stable")
                ranked = hashes[order]
                head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, dtype=np.int64)
                gaps = np.diff(order, prepend=0)
                gaps[head] = order[head]
                blob = [
                    _pack(keys[:, lo:hi].astype(np.int64)),
                    _pack(words.count.astype(np.int64)),
                    _pack(np.diff(ranked[head], prepend=np.uint64(0))),
                    _pack(np.diff(np.r_[head, len(ranked)]).astype(np.uint32)),
                    _pack(gaps.astype(np.uint32)),
                ]
                yield pa.RecordBatch.from_arrays([*(pa.array([b], pa.binary()) for b in blob), pa.array([len(head)], pa.int64()), pa.array([(len(ranked) << 24) | (hi - lo)], pa.int64())], ["keys", "word_counts", "terms", "starts", "postings", "n_terms", "n_postings"])

    return rows.mapInArrow(run, INDEX_SCHEMA)


class Shard:
    """One row of the index, opened."""

    def __init__(self, keys: bytes, counts: bytes, terms: bytes, lengths: bytes, postings: bytes, n_terms: int, sizes: int):
        n, docs = sizes >> 24, sizes & ((1 << 24) - 1)
        self.keys, self.key2, self.void = _unpack(keys, 3 * docs, np.int64).reshape(3, docs)
        self.counts = _unpack(counts, docs, np.int64)
        self.terms = np.cumsum(_unpack(terms, n_terms, np.uint64), dtype=np.uint64)
        self.starts = np.r_[0, np.cumsum(_unpack(lengths, n_terms, np.uint32), dtype=np.int64)]
        sums = np.cumsum(_unpack(postings, n, np.uint32), dtype=np.int64)  # of gaps: each list starts anew
        base = np.r_[0, sums][self.starts[:-1]]
        self.postings = sums - np.repeat(base, np.diff(self.starts))
        self.first = np.r_[0, np.cumsum(self.counts)]

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in the shard's dictionary, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)


@dataclass
class QueryBlock:
    """Windows of benchmark items: their words as term numbers end to end, and each window's first word, length and item."""

    terms: np.ndarray
    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    names: list[str]
    window: int


def query_block(items: list[tuple[object, str | None]], window: int = WINDOW) -> QueryBlock:
    """Windows of ``window`` consecutive words; an item of fewer words, but not none, is one window."""
    words, start, length, item, names, at = [], [], [], [], [], 0
    number: dict[bytes, int] = {}
    for name, text in items:
        ids = np.array([number.setdefault(w, len(number)) for w in (text or "").encode().translate(_SPLIT).split()], dtype=np.int32)
        if not len(ids):
            continue
        n = min(window, len(ids))
        words.append(ids)
        start.append(at + np.arange(len(ids) - n + 1, dtype=np.int32))
        length.append(np.full(len(start[-1]), n, dtype=np.int32))
        item.append(np.full(len(start[-1]), len(names), dtype=np.int32))
        names.append(str(name))
        at += len(ids)
    terms = hash_tokens(list(number)) if number else np.zeros(0, dtype=np.uint64)
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return QueryBlock(terms, joined(words), joined(start), joined(length), joined(item), names, window)


def _expand(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the concatenation of ranges, and the range each belongs to."""
    owner = np.repeat(np.arange(len(starts)), lengths)
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(int(lengths.sum())), owner


def search(shard: Shard, q: QueryBlock, slop: int = 0, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, first token, length) of matches in one shard, a bounded number of candidates at a time.

    ``slop`` 0: exact phrases. Otherwise proximity: every term of the window within ``slop`` tokens of its
    place, counted from the rarest term.
    """
    if not len(q.start) or not len(shard.postings):
        return
    place = shard.find(q.terms)[q.words]
    missing = np.r_[0, np.cumsum(place < 0)]
    living = np.flatnonzero(missing[q.start + q.length] == missing[q.start])
    for a in range(0, len(living), _WINDOWS):
        yield from _search(shard, q, place, living[a : a + _WINDOWS], slop, most)


_WINDOWS = 1 << 17  # looked for at once


def _search(shard: Shard, q: QueryBlock, place: np.ndarray, alive: np.ndarray, slop: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    width = int(q.length[alive].max())
    within = np.arange(width) < q.length[alive][:, None]
    where = np.where(within, place[np.minimum(q.start[alive][:, None] + np.arange(width), len(place) - 1)], -2)  # -2 stands for padding
    frequency = np.r_[np.diff(shard.starts), 0, 0]
    df = np.where(where >= 0, frequency[where], np.iinfo(np.int64).max)
    order = np.argsort(df, axis=1, kind="stable")
    rarest = where[np.arange(len(where)), order[:, 0]]
    sizes = frequency[rarest]
    # postings with their term in front: one sorted array for all memberships
    used = np.unique(where[where >= 0])
    at, owner = _expand(shard.starts[used], frequency[used])
    token = np.int64(shard.first[-1] + 2 * slop + 1)
    table = owner * token + shard.postings[at]
    slot = np.zeros(len(shard.terms), dtype=np.int64)
    slot[used] = np.arange(len(used))
    bounds = np.r_[np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()), most), side="left"), len(sizes)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        b = max(b, a)
        if a == b:
            continue
        index, w = _expand(shard.starts[rarest[a:b]], sizes[a:b])
        w += a
        begin = shard.postings[index] - order[w, 0]
        length = q.length[alive[w]].astype(np.int64)
        doc = np.searchsorted(shard.first, np.maximum(begin, 0), side="right") - 1
        ok = (begin >= shard.first[doc]) & (begin + length <= shard.first[doc + 1]) if not slop else np.ones(len(w), dtype=bool)
        begin, w, doc = begin[ok], w[ok], doc[ok]
        for k in range(1, width):
            term = where[w, order[w, k]]
            live = term >= 0
            goal = slot[np.maximum(term, 0)] * token + begin + order[w, k]
            if slop:
                centre = np.searchsorted(shard.first, begin + order[w, 0], side="right") - 1
                low = np.maximum(begin + order[w, k] - slop, shard.first[centre])
                high = np.minimum(begin + order[w, k] + slop, shard.first[centre + 1] - 1)
                at = np.searchsorted(table, slot[np.maximum(term, 0)] * token + low)
                keep = ~live | ((at < len(table)) & (table[np.minimum(at, len(table) - 1)] <= slot[np.maximum(term, 0)] * token + high))
            else:
                at = np.minimum(np.searchsorted(table, goal), len(table) - 1)
                keep = ~live | (table[at] == goal)
            begin, w = begin[keep], w[keep]
            if not len(w):
                break
        if len(w):
            if slop:
                centre = np.searchsorted(shard.first, begin + order[w, 0], side="right") - 1
                end = np.minimum(begin + q.length[alive[w]], shard.first[centre + 1])
                begin = np.maximum(begin, shard.first[centre])
                yield alive[w], begin, end - begin
            else:
                yield alive[w], begin, q.length[alive[w]].astype(np.int64)


MATCH_SCHEMA = "key bigint, key2 bigint, n_words bigint, spans array<bigint>, items array<string>"


def _match(shard: Shard, q: QueryBlock, slop: int) -> tuple[list[np.ndarray], list[list[str]]]:
    """Merged hit spans (start, end, ... within the text) and item names of every text of the shard."""
    n, total = len(shard.keys), int(shard.first[-1])
    depth = np.zeros(total + 1, dtype=np.int64)
    pairs: list[np.ndarray] = []
    for window, begin, length in search(shard, q, slop):
        np.add.at(depth, begin, 1)
        np.add.at(depth, begin + length, -1)
        doc = np.searchsorted(shard.first, begin, side="right") - 1
        pairs.append(np.unique(doc * len(q.names) + q.item[window]))
    spans, items = [np.zeros(0, dtype=np.int64)] * n, [[] for _ in range(n)]
    if not pairs:
        return spans, items
    hit = np.cumsum(depth)[:-1] > 0
    before, after = np.r_[False, hit[:-1]], np.r_[hit[1:], False]
    inner = shard.first[1:-1][shard.first[1:-1] < total]
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    lo, hi = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    doc = np.searchsorted(shard.first, lo, side="right") - 1
    ends, at = np.stack([lo, hi], axis=1), np.searchsorted(doc, np.arange(n + 1))
    for d in np.unique(doc).tolist():
        spans[d] = ends[at[d] : at[d + 1]].ravel() - shard.first[d]
    for p in np.unique(np.concatenate(pairs)).tolist():
        items[p // len(q.names)].append(q.names[p % len(q.names)])
    return spans, items


def match_index(index: DataFrame, block: QueryBlock, slop: int = 0) -> DataFrame:
    """One row for each indexed text: its words, merged hit spans and the items found in it."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(*row)
                spans, items = _match(shard, sent.value, slop)
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys, mask=shard.void > 0), pa.array(shard.key2), pa.array(shard.counts), pa.array([s.tolist() for s in spans], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["key", "key2", "n_words", "spans", "items"])

    return index.mapInArrow(run, MATCH_SCHEMA)


def _query_blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[QueryBlock]:
    """The benchmark in blocks of at most BLOCK_WORDS words (or one longer item), read through the driver one by one."""
    part, words = [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len((row.t or "").split())
        if part and words + n > BLOCK_WORDS:
            yield query_block(part, window)
            part, words = [], 0
        part.append((row.i, row.t))
        words += n
    yield query_block(part, window)


def _united(rows: DataFrame) -> DataFrame:
    """MATCH_SCHEMA of rows (key, key2, n_words, all: arrays of spans, items): spans that meet become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(3).to_pylist():
                spans = np.array([x for p in parts for x in p], dtype=np.int64).reshape(-1, 2)
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                high = np.maximum.accumulate(spans[:, 1]) if len(spans) else spans[:, 1]
                head = np.flatnonzero(np.r_[True, spans[1:, 0] > high[:-1]]) if len(spans) else np.zeros(0, dtype=np.int64)
                ends = high[np.r_[head[1:] - 1, len(spans) - 1]] if len(spans) else high
                out.append(np.stack([spans[head, 0], ends], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64())), batch.column(4)], ["key", "key2", "n_words", "spans", "items"])

    return rows.mapInArrow(run, MATCH_SCHEMA)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: Column | None = None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0, key2: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: key, key2 (0 unless given), n_words, n_hit (words inside any match), n_items, items, spans, contaminated.

    ``contaminated``: n_hit > 0 and 20 * n_hit >= n_words. A null or wordless text has no words and no hit;
    a null or wordless item matches nothing; items with equal names count once for a text; repeated rows
    come back as often as given; an empty benchmark or table gives no hit or no row. ``items`` are sorted
    as strings. The key of a null is null.
    """
    index = cut(build_index(docs, text, key, key2))
    found = [match_index(index, q, slop) for q in _query_blocks(benchmark, item_id, item_text, window)]
    if len(found) == 1:
        merged = found[0]
    else:
        numbered = [f.withColumn("row", F.struct(F.spark_partition_id(), F.monotonically_increasing_id())) for f in found]
        every = numbered[0]
        for f in numbered[1:]:
            every = every.unionByName(f)
        every = every.groupBy("row").agg(F.first("key").alias("key"), F.first("key2").alias("key2"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("all"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        merged = _united(every.drop("row"))
    n_hit = F.expr("aggregate(spans, struct(0L as s, -1L as sign), (a, x) -> struct(a.s + a.sign * x as s, -a.sign as sign)).s")
    out = merged.select("key", "key2", "n_words", n_hit.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "spans")
    return out.select("key", "key2", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "spans", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept.

    Rows are told apart by two 64-bit hashes of doc_id and text, so repeated rows share their (equal) verdict.
    """
    row = row_key("doc_id", "text")
    (own,) = fresh(docs.columns, "row")
    bad = find_contamination(docs, benchmark, key=row["a"], key2=row["b"], window=window).filter("contaminated").select(F.struct(F.col("key").alias("a"), F.col("key2").alias("b")).alias(own))
    return docs.withColumn(own, row).join(bad, own, "left_anti").select(docs.columns)
