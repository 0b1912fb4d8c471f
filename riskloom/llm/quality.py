"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A text is a bag of hashed n-grams: its words and its pairs of neighbouring words, where a word is a run of
letters and digits or a run of marks, case kept. Two multinomials of each are counted: the target model on
labelled good texts, the raw model on all texts. The log importance weight of a text is the sum over its
n-grams of log p(target) - log p(raw). A third family is an extra beside the words: pairs of neighbouring
word *shapes* (letter case, marks, how lately the same word stood before). Hashed words alone tell shouting
or repetition by the words in it, which drown among their buckets' neighbours as the raw text grows; shapes
tell them at any size. ``Importance.shapes`` = False leaves them out.

``sampled``: k rows drawn from all rows without replacement, in proportion to exp(``strength`` x mean log
weight a word). Gumbel noise from a hash of the row is added to that log weight and the k largest keys win
(which is that law exactly), found by narrowing histograms, so neither the keys nor the winners pass through
one task. Whole log weights would make this a sort by length: they differ by hundreds between good texts,
the noise by a few. So every text weighs as ``strength`` words of its mean do.

``accepted``, for the filter of the pipeline alone, compares the mean with a threshold that best parts good
from bad among labelled rows that the target model has not seen. Means are taken as if each text had
``NEUTRAL`` more words of weight zero, so that few words decide little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_sample, cut
from riskloom.llm.words import LETTERS_OR_MARKS, SPACED, Words, blocks, mix

WORD_BUCKETS = 1 << 16
PAIR_BUCKETS = 1 << 18
KINDS = 5 * 4 * 4
SHAPE_PAIRS = KINDS * (KINDS + 1)
FAMILIES = (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, WORD_BUCKETS + PAIR_BUCKETS), slice(WORD_BUCKETS + PAIR_BUCKETS, WORD_BUCKETS + PAIR_BUCKETS + SHAPE_PAIRS))
BUCKETS = FAMILIES[-1].stop
TARGET_DOCUMENTS = 20_000  # labelled rows of each class, at most
STRENGTH = 8.0
NEUTRAL = 20.0
ADD = 1.0

_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, dtype=np.int64)
_LOWER[97:123] = 1
_WIDE = np.zeros(256, dtype=np.int64)
_WIDE[128:] = 1
_STOP = np.zeros(256, dtype=np.int64)
_STOP[[ord(c) for c in ".,;:?'\"()-"]] = 1
_LOUD = np.zeros(256, dtype=np.int64)
_LOUD[ord("!")] = 1


def word_pairs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket of the word, bucket of it and the word before) of every word of a block of texts."""
    words = Words(data, off, LETTERS_OR_MARKS, lower=False)
    h = words.hashes()
    before = np.r_[np.uint64(0), h[:-1]] if len(h) else h
    before[words.first[:-1][words.count > 0]] = 0
    pair = mix(before * np.uint64(3) + h)
    return words.doc, (h % np.uint64(WORD_BUCKETS)).astype(np.int64), WORD_BUCKETS + (pair % np.uint64(PAIR_BUCKETS)).astype(np.int64)


def shape_pairs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket of the shapes of a word and of the one before) of every word, here a run without white space."""
    words = Words(data, off, SPACED)
    start, end, doc = words.start, words.end, words.doc

    def total(table: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(table[data])]
        return sums[end] - sums[start]

    size, upper, lower, wide, stop, loud = end - start, *(total(t) for t in (_UPPER, _LOWER, _WIDE, _STOP, _LOUD))
    first_upper = _UPPER[data[start]] if len(start) else np.zeros(0, dtype=np.int64)
    letters = upper + lower + wide
    case = np.select([letters == 0, upper == 0, (upper == 1) & (first_upper == 1), lower == 0], [0, 1, 2, 3], 4)
    other = size - letters - stop - loud
    mark = np.select([other > 0, loud > 0, stop > 0], [3, 2, 1], 0)
    h = words.hashes()
    order = np.lexsort((np.arange(len(h)), h, doc))
    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])] if len(h) else np.zeros(0, dtype=bool)
    gap = np.full(len(h), 1 << 30)
    gap[order[same]] = order[same] - order[np.flatnonzero(same) - 1]
    recent = np.select([gap == 1, gap <= 3, gap <= 12], [3, 2, 1], 0)
    kind = (case * 4 + mark) * 4 + recent
    before = np.r_[KINDS, kind[:-1]] if len(kind) else kind
    before[words.first[:-1][words.count > 0]] = KINDS
    return doc, FAMILIES[2].start + before * KINDS + kind


def count_ngrams(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the column ``text`` of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, data, off in blocks(batch.column(0)):
                for bucket in (*word_pairs(data, off)[1:], shape_pairs(data, off)[1]):
                    np.add.at(total, bucket, 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["b", "n"])

    got = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    out = np.zeros(BUCKETS)
    out[got.column("b").to_numpy()] = got.column("n").to_numpy()
    return out


@dataclass
class Importance:
    """Log ratios by bucket, and the least mean weight that is accepted."""

    ratio: np.ndarray
    threshold: float
    shapes: bool = True

    def weigh(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, log importance weight) of each text of a block."""
        n = len(off) - 1
        doc, word, pair = word_pairs(data, off)
        weight = np.bincount(doc, self.ratio[word] + self.ratio[pair], n)
        if self.shapes:
            doc_, shape = shape_pairs(data, off)
            weight += np.bincount(doc_, self.ratio[shape], n)
        return np.bincount(doc, minlength=n), weight


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) by bucket, each family a distribution of its own.

    The raw counts, brought to the target's total and to ADD a bucket on average, are added to both: a bucket
    that the target has never met is as unlikely as its raw counts say, not as the sizes of the samples do.
    """
    out = np.zeros(BUCKETS)
    for f in FAMILIES:
        r, t, n = raw[f] + ADD, target[f], f.stop - f.start
        prior = r / r.sum() * (ADD * n)
        out[f] = np.log((t + prior) / (t.sum() + ADD * n)) - np.log(r / r.sum())
    return out


def best_threshold(good: dict[float, int], bad: dict[float, int]) -> float:
    """The cut that most raises (share of good kept) - (share of bad kept), of values with counts; -inf without bad ones.

    It lies between the highest value that goes and the lowest that stays, nearer the former, so that good
    texts like those seen are kept.
    """
    if not bad or not good:
        return -np.inf
    values = np.array(sorted({*good, *bad}))
    least = lambda c: 1 - np.r_[0, np.cumsum([c.get(v, 0) for v in values])][:-1] / sum(c.values())
    i = int(np.argmax(least(good) - least(bad)))
    below = values[i - 1] if i else values[0] - 1.0
    return float(below + 0.25 * (values[i] - below))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", limit: int = TARGET_DOCUMENTS, shapes: bool = True) -> Importance:
    """The model: raw counts of all ``docs``, target counts of labelled good rows, the threshold from labelled rows.

    About ``limit`` labelled rows of each class are read, half of them (by a hash of the id) for the target
    and half for the threshold; rows with a null label or id are not. If a half lacks a class, both halves
    serve. Without labelled good rows the target equals the raw model and all is accepted.
    """
    named = labels.select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and k is not null")
    few = bounded_sample(named.filter("y = 1"), F.col("k"), limit).unionByName(bounded_sample(named.filter("y = 0"), F.col("k"), limit))
    half = F.pmod(F.xxhash64("k", F.lit(31)), F.lit(2)).alias("half")
    sample = cut(docs.select(F.col(doc_id).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(few.distinct()), "k").select("y", half, "text"))  # at most 2 * limit ids
    have = {(r.y, r.half) for r in sample.select("y", "half").distinct().collect()}
    raw = count_ngrams(docs.select(F.col(text).alias("text")))
    if not any(y == 1 for y, _ in have):
        return Importance(np.zeros(BUCKETS, dtype=np.float32), -np.inf, shapes)
    apart = {(1, 0), (1, 1), (0, 1)} <= have
    target = count_ngrams(sample.filter("y = 1 and half = 0" if apart else "y = 1"))
    model = Importance(log_ratio(target, raw).astype(np.float32), -np.inf, shapes)
    seen = weigh(sample.filter("half = 1") if apart else sample, model).filter("n_words > 0")
    # thousandths: few values, however many rows have an id
    counts = seen.groupBy("y", F.round(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), "mean_weight")), 3).alias("m")).agg(F.count("*").alias("n")).collect()
    model.threshold = best_threshold(*({r.m: r.n for r in counts if r.y == y} for y in (1, 0)))
    return model


ADDED = ("n_words", "log_weight", "mean_weight", "accepted")


def weigh(docs: DataFrame, model: Importance, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and n_words, log_weight, mean_weight (a word), accepted, from whole texts.

    A null text, or one without words, has weight 0 and is not accepted. Repeated rows are weighed each;
    columns of the four names are replaced; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ADDED]
    schema = docs.select(kept).schema.add("n_words", "long").add("log_weight", "double").add("mean_weight", "double").add("accepted", "boolean")
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column(at)):
                n, w = sent.value.weigh(data, off)
                mean = w / (n + NEUTRAL)
                ok = (n > 0) & (mean >= sent.value.threshold)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(n.astype(np.int64)), pa.array(w), pa.array(mean), pa.array(ok)], [f.name for f in schema])

    return docs.select(kept).mapInArrow(run, schema)


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of ``key``; the same on every run."""
    unit = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit))


def kth_largest(values: DataFrame, k: int, bins: int = 2048, small: int = 20_000) -> float | None:
    """The k-th largest value of the one column ``v`` (no nulls), or None if there are fewer than k.

    Histograms over an ever narrower range find it; at most ``bins`` counts or ``small`` values reach the driver.
    """
    stats = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).first()
    if k < 1 or stats.n < k:
        return None
    lo, hi, inside, left = stats.lo, stats.hi, stats.n, k
    while True:
        here = values.filter((F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi)))
        if inside <= small:
            return sorted((r.v for r in here.collect()), reverse=True)[left - 1]
        if lo == hi:
            return lo
        slot = F.least(F.lit(bins - 1), ((F.col("v") - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int"))
        cells = here.groupBy(slot.alias("s")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy(F.desc("s")).collect()
        for c in cells:
            if c.n >= left:
                break
            left -= c.n
        lo, hi, inside = c.lo, c.hi, c.n


def _largest(keyed: DataFrame, value: str, k: int) -> Column:
    """Whether a row of the stored ``keyed`` has one of the k largest of ``value``; of rows equal at the k-th place, those first stored."""
    if k < 1:
        return F.lit(False)
    least = kth_largest(keyed.select(F.col(value).alias("v")), k)
    if least is None:
        return F.lit(True)
    above = keyed.filter(F.col(value) > F.lit(least)).count()
    tied = keyed.filter(F.col(value) == F.lit(least))
    if tied.count() == k - above:
        return F.col(value) >= F.lit(least)
    # a draw for each of the equal rows: their places in the stored table, mixed
    last = kth_largest(tied.select(F.col("place").alias("v")), k - above)
    return (F.col(value) > F.lit(least)) | ((F.col(value) == F.lit(least)) & (F.col("place") >= F.lit(last)))


def resample(weighed: DataFrame, k: int, key: Column | None = None, strength: float = STRENGTH, seed: int = 20) -> DataFrame:
    """Add ``gumbel_key``, ``sampled``, ``plain_key`` and ``sampled_plain``: min(k, rows) rows with the largest keys, twice.

    ``gumbel_key`` is mean_weight * ``strength`` and noise: a draw in proportion to the weight of ``strength`` words of the
    text. ``plain_key`` is log_weight and the same noise: a draw in proportion to the whole text's importance weight.
    ``key`` tells rows apart for the noise (doc_id unless given): rows with an equal key, null counting as
    one, have the same noise; where the k-th place falls among equal rows, a second draw for each of them decides, so k is
    kept. With fewer than k rows all of them are sampled; an empty table gives no rows.
    """
    added = ("gumbel_key", "sampled", "plain_key", "sampled_plain")
    key = F.col("doc_id") if key is None else key
    noise = gumbel(F.coalesce(key, F.lit(-(2**63))), seed)
    rows = weighed.drop(*added).select(F.struct("*").alias("row"), noise.alias("noise"), (F.col("mean_weight") * strength).alias("part"), F.col("log_weight").alias("whole"))
    keyed = cut(rows.select("row", (F.col("part") + F.col("noise")).alias("gumbel_key"), (F.col("whole") + F.col("noise")).alias("plain_key"), F.monotonically_increasing_id().alias("place")))
    marked = keyed.withColumn("sampled", _largest(keyed, "gumbel_key", k)).withColumn("sampled_plain", _largest(keyed, "plain_key", k))
    names = [c for c in weighed.columns if c not in added]
    return marked.select(*[F.col("row").getField(c).alias(c) for c in names], *added)
