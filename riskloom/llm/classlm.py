"""Class-based bigram language model in the manner of Brown, with exchange clustering.

P(text) is the product over its tokens of P(class | class before) and P(word | class); the end of the text
is a token of its own class and stands before the first word. Everything is counted on all training
texts:

* word counts, by a shuffle of counts pre-aggregated in each task;
* bigrams of *symbols*: the ``words`` most frequent words each are one, every other word falls to one of
  ``groups`` groups by a hash of its last three bytes. The table has at most (words + groups + 1)**2 cells
  however large the corpus is, and is gathered on the driver, where exchange clustering moves each symbol to
  the class that most raises the likelihood, until none moves;
* contexts of every other word seen, however rare: how often each class of the symbols stands before and
  after it. In passes over all these words, each goes to the class under which its contexts are likeliest,
  and the classes' contexts are summed anew, until a pass raises the log-likelihood by less than ``TOLERANCE``
  of it. The contexts' own classes stay those of the symbols, so each pass can only raise it. Words with the
  same contexts are one row there;
* bigrams of the final classes, over all texts. Only an unseen word takes the class of its group.

Smoothing: transitions are discounted and interpolated with class frequencies. In a class of N tokens and
V words, a word seen c times has (c - d) / N and the unknown word has what is left, d V / N; d is
n1 / (n1 + 2 n2) from the numbers of words seen once and twice. Vocabulary and unknown sum to one.

The ``class_words`` most frequent words have their classes, and the ``table_words`` most frequent their
counts, in a broadcast table. The rare rest of each text is joined with the full counts by a shuffle,
whatever the vocabulary's size: a rare word has few rows, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut
from riskloom.llm.words import SPACED, Words, blocks, merge_counts

CLASSES = 64
SYMBOL_WORDS = 1535
SUFFIX_GROUPS = 512
TABLE_WORDS = 1 << 18
CLASS_WORDS = 1 << 18
DISCOUNT = 0.75
TOLERANCE = 1e-6  # of the log-likelihood: a pass that gains less is the last
_HELD = 1 << 19  # distinct keys a task holds before it hands them on


@dataclass
class Symbols:
    """Symbol numbers: 0 the end, then the words in ``hashes`` (sorted), then the suffix groups."""

    hashes: np.ndarray
    groups: int

    @property
    def n(self) -> int:
        return 1 + len(self.hashes) + self.groups

    def of(self, h: np.ndarray, group: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return 1 + group
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, 1 + at, 1 + len(self.hashes) + group)


def _words(data: np.ndarray, off: np.ndarray, groups: int) -> tuple[Words, np.ndarray, np.ndarray]:
    w = Words(data, off, SPACED)
    return w, w.hashes().view(np.int64), (w.hashes(suffix=3) % np.uint64(groups)).astype(np.int64)


class _Counts:
    """Counts by key, of bounded size: ``add`` returns True when they should be handed on."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        self.parts.append((keys, counts.astype(np.int64)))
        self.n += len(keys)
        if self.n > 2 * _HELD:
            self.parts = [merge_counts(self.parts)]
            self.n = len(self.parts[0][0])
        return self.n > _HELD and len(self.parts) == 1

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = merge_counts(self.parts)
        self.parts, self.n = [], 0
        return out


def count_words(texts: DataFrame, groups: int) -> DataFrame:
    """(h, c): hash and count of every distinct word of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()

        def out() -> pa.RecordBatch:
            code, c = held.take()
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(c)], ["h", "c"])

        for batch in batches:
            for _, _, data, off in blocks(batch.column(0)):
                if held.add(*np.unique(_words(data, off, groups)[1], return_counts=True)):
                    yield out()
        if held.n:
            yield out()

    return texts.select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def count_bigrams(texts: DataFrame, symbols: Symbols) -> np.ndarray:
    """The symbols.n x symbols.n matrix of how often a symbol follows another, texts framed by the end."""
    sent = texts.sparkSession.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sym = _Counts(), sent.value
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in held.take()], ["code", "n"])
        for batch in batches:
            for _, _, data, off in blocks(batch.column(0)):
                w, h, g = _words(data, off, sym.groups)
                line = np.zeros(len(w) + w.n_docs, dtype=np.int64)
                line[np.arange(len(w)) + w.doc] = sym.of(h, g)
                if held.add(*np.unique(np.r_[0, line[:-1]] * sym.n + line, return_counts=True)):
                    yield out()
        if held.n:
            yield out()

    got = texts.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(symbols.n * symbols.n, dtype=np.float64)
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(symbols.n, symbols.n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """A class for each symbol by the exchange algorithm; symbol 0 alone is class 0.

    Starts with the most frequent symbols in classes of their own and the others dealt in turn, and moves
    one symbol at a time to the class with the highest bigram likelihood, until none moves. Ties keep the lower class.
    """
    n = len(bigrams)
    total = bigrams.sum(axis=0)
    order = 1 + np.argsort(-total[1:], kind="stable")
    cls = np.zeros(n, dtype=np.int64)
    cls[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), cls] = 1
    before, after = bigrams.T @ member, bigrams @ member  # by symbol: counts of the classes before and after it
    table = member.T @ after
    size = np.bincount(cls, weights=total, minlength=classes)
    least = 1e-9 + 1e-12 * float(_xlogx(total.sum()))  # less is rounding
    moved = 1
    while moved:
        moved = 0
        for w in order.tolist():
            if not total[w]:
                continue
            a, self_ = cls[w], bigrams[w, w]
            left, right = before[w].copy(), after[w].copy()
            left[a] -= self_
            right[a] -= self_
            table[a, :] -= right
            table[:, a] -= left
            table[a, a] -= self_
            size[a] -= total[w]
            gain = (_xlogx(table + right) - _xlogx(table)).sum(axis=1) + (_xlogx(table + left[:, None]) - _xlogx(table)).sum(axis=0)
            d = np.diag(table)
            gain += _xlogx(d + left + right + self_) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            gain -= 2 * (_xlogx(size + total[w]) - _xlogx(size))
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            b = a if gain[b] <= gain[a] + least else b
            table[b, :] += right
            table[:, b] += left
            table[b, b] += self_
            size[b] += total[w]
            if b != a:
                cls[w], moved = b, moved + 1
                before[:, a] -= bigrams[w]
                before[:, b] += bigrams[w]
                after[:, a] -= bigrams[:, w]
                after[:, b] += bigrams[:, w]
    return cls


def _merged(h: np.ndarray, code: np.ndarray, n: np.ndarray, classes: int) -> pa.RecordBatch:
    """(h, contexts) of contexts that may repeat."""
    order = np.lexsort((code, h))
    h, code, n = h[order], code[order], n[order]
    head = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (code[1:] != code[:-1])])
    h, code, n = h[head], code[head], np.add.reduceat(n, head)
    word = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    contexts = pa.ListArray.from_arrays(pa.array(np.r_[word, len(h)].astype(np.int32)), pa.array(n * (2 * classes) + code))
    return pa.RecordBatch.from_arrays([pa.array(h[word]), contexts], ["h", "contexts"])


CONTEXTS = "h bigint, contexts array<bigint>"


def count_contexts(texts: DataFrame, symbols: Symbols, cls: np.ndarray, classes: int) -> DataFrame:
    """(h, contexts) of every word that is not a symbol of its own: n * 2 classes + code, by rising code.

    The code is the class before, or ``classes`` + the class after; n how often it stands there. Each task hands
    on a word's contexts as one row; rows of a word meet in one partition, sorted, and are merged as they
    stream by.
    """
    sent = texts.sparkSession.sparkContext.broadcast((symbols, cls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        sym, of = sent.value

        def out() -> pa.RecordBatch:
            h, code = (np.concatenate([x[i] for x in held]) for i in range(2))
            held[:] = []
            return _merged(h, code, np.ones(len(h), dtype=np.int64), classes)

        for batch in batches:
            for _, _, data, off in blocks(batch.column(0)):
                w, h, g = _words(data, off, sym.groups)
                s, at = sym.of(h, g), np.arange(len(w)) + w.doc
                line = np.zeros(len(w) + w.n_docs, dtype=np.int64)
                line[at] = of[s]
                other = s > len(sym.hashes)
                before, after = np.r_[0, line[:-1]][at[other]], line[at[other] + 1]
                if other.any():
                    held.append((np.tile(h[other], 2), np.concatenate([before, classes + after])))
                if sum(len(x[0]) for x in held) > 4 * _HELD:
                    yield out()
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, dtype=np.int64)] * 3  # the last word of a batch may go on in the next
        for batch in batches:
            column = batch.column(1)
            off, values = np.asarray(column.offsets).astype(np.int64), np.asarray(column.values)
            values = values[off[0] : off[-1]]
            h = np.repeat(batch.column(0).to_numpy(), np.diff(off))
            h, code, n = (np.concatenate(x) for x in zip(rest, (h, values % (2 * classes), values // (2 * classes)), strict=True))
            last = h == h[-1] if len(h) else np.zeros(0, dtype=bool)
            rest = [h[last], code[last], n[last]]
            if not last.all():
                yield _merged(h[~last], code[~last], n[~last], classes)
        if len(rest[0]):
            yield _merged(*rest, classes)

    return texts.select("text").mapInArrow(run, CONTEXTS).repartition("h").sortWithinPartitions("h").mapInArrow(merge, CONTEXTS)


def _best(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The likeliest class of each row of contexts under the classes' contexts ``table``, never class 0.

    Also, of every context: its row, its code and its number.
    """
    classes = len(table)
    size = table.sum(axis=1) / 2
    score = np.log(np.maximum(table, 1e-300)) - np.log(np.maximum(size, 1e-300))[:, None]
    off, values = np.asarray(column.offsets).astype(np.int64), np.asarray(column.values)
    row, values = np.repeat(np.arange(len(column)), np.diff(off)), values[off[0] : off[-1]]
    code, n = values % (2 * classes), values // (2 * classes)
    dense = np.zeros((len(column), 2 * classes))
    dense[row, code] = n
    return 1 + np.where(size[1:] > 0, dense @ score[1:].T, -np.inf).argmax(axis=1), row, code, n


def assign(contexts: DataFrame, own: np.ndarray, start: np.ndarray, classes: int, tolerance: float = TOLERANCE) -> tuple[DataFrame, int]:
    """(h, k): the class of every word of ``contexts``, and the number of passes.

    ``own`` are the contexts of the symbols that keep their classes, ``start`` those of the classes at first. Of the
    tables seen, the last but one is used if a pass gained less than ``tolerance``: the classes are those of its own.
    """
    contexts = cut(contexts)
    alike = cut(contexts.groupBy("contexts").agg(F.count("*").alias("w")))
    sc = contexts.sparkSession.sparkContext
    likelihood = lambda x: float(_xlogx(x).sum() - 2 * _xlogx(x.sum(axis=1) / 2).sum())

    def summed(table: np.ndarray) -> np.ndarray:
        sent = sc.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((classes, 2 * classes))
            for batch in batches:
                k, row, code, n = _best(batch.column(0), sent.value)
                out += np.bincount(k[row] * 2 * classes + code, n * batch.column(1).to_numpy()[row], out.size).reshape(out.shape)
            i = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(out.ravel()[i].astype(np.int64))], ["i", "n"])

        got = alike.mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        sent.destroy()
        out = own.copy()
        out.ravel()[got.column("i").to_numpy()] += got.column("n").to_numpy()
        return out

    table, after, passes = start, summed(start), 1
    while True:
        later, passes = summed(after), passes + 1
        if likelihood(later) <= likelihood(after) + tolerance * abs(likelihood(after)):
            break
        table, after = after, later
    sent = sc.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = _best(batch.column(1), sent.value)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k.astype(np.int32))], ["h", "k"])

    return contexts.select("h", "contexts").mapInArrow(run, "h bigint, k int"), passes


@dataclass
class Model:
    """What the scorer needs; ``words`` are sorted hashes of the broadcast table."""

    symbols: Symbols
    cls: np.ndarray
    transition: np.ndarray | None  # log10, class before x class
    class_tokens: np.ndarray
    class_words: np.ndarray
    discount: float
    words: np.ndarray
    counts: np.ndarray
    tokens: int
    vocabulary: int
    ends: int
    passes: int  # over the words that are not symbols of their own

    def emission(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words seen c times in class k."""
        floor = 1.0 / (self.tokens + self.vocabulary + 1)
        n = np.maximum(self.class_tokens[k], 1.0)
        seen, unknown = (c - self.discount) / n, self.discount * self.class_words[k] / n
        return np.log10(np.maximum(np.where(c > 0, seen, unknown), floor))

    def base(self, c: np.ndarray | int) -> np.ndarray:
        return np.log10((c + 1.0) / (self.tokens + self.vocabulary + 1))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count of the at most ``most`` most frequent words."""
    shift = F.greatest(F.lit(0), F.floor(F.log2("c")).cast("int") - 7)
    level = F.expr("shiftleft(shiftright(c, s), s)")
    levels = counts.select(shift.alias("s"), "c").select(level.alias("q")).groupBy("q").agg(F.count("*").alias("n")).collect()  # some hundreds of rows
    least = 1 << 62
    for r in sorted(levels, key=lambda r: -r.q):
        if r.n > most:
            break
        least, most = r.q, most - r.n
    return least


def _in(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``h`` is in the sorted ``table``, and whether it is."""
    if not len(table):
        return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def _patched(line: bytes, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The classes of a text's words; the counts and classes of its found ones, and the classes those had before."""
    k = np.frombuffer(line, dtype=np.int16).astype(np.int64)
    at, c, new = found["at"], found["c"], found["k"].astype(np.int64)
    old = k[at]
    k[at] = new
    return k, c, new, old


def _lines(texts: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``texts`` (any columns, then the text) with, instead of the text, what scores it but for the transitions.

    ``line`` has the class of each word, or that of its group if the broadcast table doesn't have it; ``found`` has
    (at, c, k): place, count and class of each word that has its counts in the joined table. known_n is the
    number of words with counts in the broadcast table, known_base and known_score are the text's sums with the
    words not in it as if they were unseen.
    """
    keep = texts.columns[:-1]
    sent = texts.sparkSession.sparkContext.broadcast(model)
    least = int(model.counts.min()) if len(model.counts) else 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = sent.value
        sym, of, have = lm.symbols, lm.cls.astype(np.int16), lm.words
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column(len(keep))):
                w, h, g = _words(data, off, sym.groups)
                k = np.ascontiguousarray(of[sym.of(h, g)])
                where, seen = _in(have, h)
                rare = np.flatnonzero(~seen)
                bounds = pa.array(np.searchsorted(w.doc[rare], np.arange(w.n_docs + 1)).astype(np.int32))
                places = (rare - w.first[w.doc[rare]]).astype(np.int32)
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                columns.append(pa.Array.from_buffers(pa.binary(), w.n_docs, [None, pa.py_buffer((2 * w.first).astype(np.int32)), pa.py_buffer(k)]))
                columns += [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (h[rare], places)]
                c = np.zeros(len(w), dtype=np.int64)
                c[seen] = lm.counts[where[seen]]
                columns.append(pa.array(np.bincount(w.doc[seen], minlength=w.n_docs).astype(np.int64)))
                columns.append(pa.array(np.bincount(w.doc, lm.base(c), w.n_docs).astype(np.float64)))
                columns.append(pa.array(np.bincount(w.doc, lm.emission(c, k.astype(np.int64)), w.n_docs).astype(np.float64)))
                yield pa.RecordBatch.from_arrays(columns, names)

    more = [("line", "binary"), ("rare_h", "array<bigint>"), ("rare_at", "array<int>")]
    more += [("known_n", "bigint"), ("known_base", "double"), ("known_score", "double")]
    names = [*keep, *[n for n, _ in more]]
    schema = ", ".join(f"{n} {d}" for n, d in [*[(c, texts.schema[c].dataType.simpleString()) for c in keep], *more])
    local = cut(texts.mapInArrow(run, schema)).withColumn("row", F.monotonically_increasing_id())
    rare = local.select("row", F.explode(F.arrays_zip("rare_h", "rare_at")).alias("r")).select("row", F.col("r.rare_h").alias("h"), F.col("r.rare_at").alias("at"))
    found = rare.join(counts.filter(F.col("c") < least).select("h", "c", "k"), "h").groupBy("row").agg(F.collect_list(F.struct("at", "c", "k")).alias("found"))
    return local.drop("rare_h", "rare_at").join(found, "row", "left").drop("row")


def count_classes(lines: DataFrame, classes: int) -> np.ndarray:
    """The classes x classes matrix of how often a class follows another, texts framed by the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            for line, found in zip(batch.column(0).to_pylist(), _found(batch.column(1)), strict=True):
                k = _patched(line, found)[0]
                out += np.bincount(np.r_[0, k] * classes + np.r_[k, 0], minlength=classes * classes)
        i = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(out[i])], ["i", "n"])

    got = lines.select("line", "found").mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(classes * classes)
    table[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return table.reshape(classes, classes)


def prepare(texts: DataFrame, classes: int = CLASSES, words: int = SYMBOL_WORDS, groups: int = SUFFIX_GROUPS, table_words: int = TABLE_WORDS, class_words: int = CLASS_WORDS) -> tuple[Model, DataFrame]:
    """The model but for its transitions, of all rows of ``texts`` (column ``text``), and (h, c, k) of all their words, k the class."""
    texts = texts.select("text")
    spark = texts.sparkSession
    counts = cut(count_words(texts, groups))
    ends = texts.count()
    frequent = counts.filter(F.col("c") >= _frequent(counts, max(table_words, words))).toArrow()
    h, c = (frequent.column(x).to_numpy() for x in ("h", "c"))
    top = np.lexsort((h, -c))[:words]
    symbols = Symbols(np.sort(h[top]), groups)
    bigrams = count_bigrams(texts, symbols)
    cls = exchange(bigrams, classes)
    member = np.zeros((symbols.n, classes))
    member[np.arange(symbols.n), cls] = 1
    contexts = np.concatenate([bigrams.T @ member, bigrams @ member], axis=1)
    own, fallback = 1 + len(symbols.hashes), cls[1 + len(symbols.hashes) :]
    member[0] = 0  # the end has its class to itself
    others, passes = assign(count_contexts(texts, symbols, cls, classes), member[:own].T @ contexts[:own], member.T @ contexts, classes)
    tops = spark.createDataFrame(pa.table({"h": symbols.hashes.astype(np.int64), "k": cls[1:own].astype(np.int32)}))
    counts = cut(counts.join(others.unionByName(tops), "h").select("h", "c", "k"))

    stats = counts.groupBy("k").agg(F.count("*").alias("n"), F.sum("c").alias("tokens"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()  # one row a class
    once, twice = sum(r.once for r in stats), sum(r.twice for r in stats)
    kinds, n_tokens = np.zeros(classes), np.zeros(classes)
    for r in stats:
        kinds[r.k], n_tokens[r.k] = r.n, r.tokens
    kinds[0], n_tokens[0] = ends > 0, ends
    tokens, vocabulary = int(n_tokens.sum()), int(kinds.sum())

    least, with_class = _frequent(counts, table_words), _frequent(counts, max(table_words, class_words))
    frequent = counts.filter(F.col("c") >= with_class).select("h", "c", "k").toArrow()
    h, c, k = (frequent.column(x).to_numpy() for x in ("h", "c", "k"))
    order = np.argsort(h)
    h, c, k = h[order], c[order], k[order]
    symbols = Symbols(h, groups)
    cls = np.concatenate([[0], k, fallback]).astype(np.int64)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    model = Model(symbols, cls, None, n_tokens, kinds, discount, h[c >= least], c[c >= least], tokens, vocabulary, ends, passes)
    return model, counts


def transitions(lines: DataFrame, model: Model) -> np.ndarray:
    """log10 P(class | class before) from the lines of the training texts."""
    table = count_classes(lines, len(model.class_tokens))
    share = (model.class_tokens + 1.0) / (model.class_tokens + 1.0).sum()
    context = table.sum(axis=1, keepdims=True)
    spare = np.where(context > 0, DISCOUNT * (table > 0).sum(axis=1, keepdims=True) / np.maximum(context, 1), 1.0)
    return np.log10(np.maximum(table - DISCOUNT, 0) / np.maximum(context, 1) + spare * share)


def train(texts: DataFrame, **options) -> tuple[Model, DataFrame]:
    """``prepare`` and the transitions of the same texts."""
    model, counts = prepare(texts, **options)
    model.transition = transitions(_lines(texts.select("text"), model, counts), model)
    return model, counts


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _found(column: pa.Array) -> list:
    """Each row's (at, c, k) as arrays; a null row has none."""
    values = column.flatten()
    at, c, k = (np.asarray(x) for x in values.flatten())
    sizes = np.asarray(column.value_lengths().fill_null(0))
    ends = np.cumsum(sizes)
    return [{"at": at[e - n : e], "c": c[e - n : e], "k": k[e - n : e]} for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _rows(docs: DataFrame, held_out: Column, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty and has one token, its end. Scores are log10 probabilities. Repeated rows are
    scored each; a null doc_id stays null; other columns are not read; an empty table gives no rows. A
    model of no training text gives every token probability 1 in the base and a uniform class.
    """
    return _score_lines(_lines(_rows(docs, held_out, doc_id, text), model, counts), model)


def train_and_score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``score_texts`` of all rows by the model of those not held out (a null ``held_out`` is); the lines are made once for both."""
    rows = _rows(docs, F.coalesce(held_out, F.lit(True)), doc_id, text)
    model, counts = prepare(rows.filter(~F.col("held_out")), **options)
    lines = cut(_lines(rows, model, counts))
    model.transition = transitions(lines.filter(~F.col("held_out")), model)
    return _score_lines(lines, model)


def _score_lines(lines: DataFrame, model: Model) -> DataFrame:
    sent = lines.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = sent.value
        for batch in batches:
            n, known, base, score = (np.zeros(len(batch), dtype=d) for d in (np.int64, np.int64, np.float64, np.float64))
            for i, (line, found) in enumerate(zip(batch.column(2).to_pylist(), _found(batch.column(6)), strict=True)):
                k, c, new, old = _patched(line, found)
                n[i], known[i], base[i] = len(k) + 1, len(c), (lm.base(c) - lm.base(0)).sum()
                score[i] = lm.transition[np.r_[0, k], np.r_[k, 0]].sum() + (lm.emission(c, new) - lm.emission(np.zeros_like(c), old)).sum()
            known += batch.column(3).to_numpy() + (lm.ends > 0)
            base += batch.column(4).to_numpy() + lm.base(lm.ends)
            score += batch.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(known), pa.array(np.full(len(batch), lm.tokens)), pa.array(base), pa.array(score)], [x.split()[0] for x in SCORED.split(", ")])

    return lines.select("doc_id", "held_out", "line", "known_n", "known_base", "known_score", "found").mapInArrow(run, SCORED)
