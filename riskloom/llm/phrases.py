"""Phrases of two to five words that occur together more often than their parts would by chance.

Counting is by tries. Every place in a text starts one path: its language, its word and the up to four words that follow
in the same piece. A task gathers the paths of about ``TRIE_WORDS`` places into a trie of that depth: the distinct paths
in order, with counts; the count of an inner node is the sum of the paths through it. So a text gives one path a word,
not one row for each phrase.

* The tries are serialised in order, cut at borders (paths from a sorted sample) into ranges of prefixes, one compressed
  run a trie and range. A range's runs are merged in one task, and its inner nodes summed. A node that a border cuts
  gives a part in each range; the parts of all nodes with enough occurrences are then summed. Borders only balance the
  ranges, whose number grows with the texts, so that a range holds about ``RANGE_PATHS`` paths. They may cut anywhere,
  so a hot first word is spread like any other, and a hot path is one row a trie.
* The left parts of a phrase are the nodes above it: a walk through each range's nodes in order, begun with the nodes
  that its lower border cuts, finds them.
* Its right parts are found over suffix links: the node without the first word, then that node's own link, level by
  level, each a join of the remaining nodes.

All parts of a phrase occur at least as often as it does, so they are among the counted nodes. Scores are exact
(decimals of 38 digits), and an overflow would be an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import cut
from riskloom.llm.words import Words, blocks
from riskloom.operators.order import positions

LONGEST = 5
LEAST = 100
TOP = 2000
TRIE_WORDS = 1 << 20
RANGE_PATHS = 1 << 19
RANGES_A_TASK = 4
SAMPLE_DOCS = 4096
SAMPLE_SHARE = 1 / 1024
SAMPLE_STEP = 64
TOP_BUCKETS = 64

#: All but space and tab, and but what ends a piece: . , ; : ! ? and line breaks (0A to 0D).
BREAK = np.zeros(256, dtype=np.bool_)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
WORD = ~BREAK
WORD[[9, 32]] = False


# ---- tries -------------------------------------------------------------------------------------------------------


def _column(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Byte strings of (bytes, lengths), in order."""
    data = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint8)
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *[p[1] for p in parts]]))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), np.uint8), np.array([len(v) for v in values], dtype=np.int64)


def _ranked(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings in byte order, and the rank, from 1, of each string."""
    coded = strings.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    codes = coded.indices.to_numpy()
    return coded.dictionary.take(pa.array(order)), rank[codes] if len(codes) else np.zeros(0, np.int32)


def _packed(columns: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Columns of numbers up to ``most`` as few 63-bit keys in the same order."""
    bits, keys, room = max(1, int(most).bit_length()), [], 0
    for c in columns:
        if room < bits:
            keys.append(c.astype(np.int64))
            room = 63 - bits
        else:
            keys[-1] = (keys[-1] << bits) | c
            room -= bits
    return keys


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    out = np.ones(len(columns[0]), dtype=np.bool_)
    if len(out) > 1:
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


class Places:
    """Words of texts in order, with their language and whether the next word goes on with the piece."""

    def __init__(self) -> None:
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.goes_on: list[np.ndarray] = []
        self.lang: list[np.ndarray] = []
        self.langs: dict[bytes, int] = {}
        self.n = 0

    def add(self, data: np.ndarray, off: np.ndarray, langs: list[str]) -> None:
        """The words of a block of whole texts, given with the languages of its rows."""
        w = Words(data, off, WORD)
        if not len(w):
            return
        breaks = np.cumsum(BREAK[w.data], dtype=np.int32)
        on = np.zeros(len(w), dtype=np.bool_)
        on[:-1] = (w.doc[1:] == w.doc[:-1]) & (breaks[w.start[1:]] == breaks[w.end[:-1] - 1])
        self.words.append((w.data[WORD[w.data]], w.end - w.start))
        self.goes_on.append(on)
        self.lang.append(np.array([self.langs.setdefault(x.encode(), len(self.langs)) for x in langs], dtype=np.int32)[w.doc])
        self.n += len(w)

    def tries(self, borders: list[list[bytes]], most: int = TRIE_WORDS) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray, np.ndarray]]:
        """(strings, columns, count, range) of the sorted distinct paths of up to ``most`` places at a time.

        ``columns`` are ranks from 1 in ``strings``: the language, then the words, 0 after the last.
        """
        if not self.n:
            return
        data, size = np.concatenate([w[0] for w in self.words]), np.concatenate([w[1] for w in self.words])
        ends = np.cumsum(size)
        goes_on, lang = np.concatenate(self.goes_on), np.concatenate(self.lang)
        names = _flat(list(self.langs))
        flat = _flat([s for b in borders for s in b])
        for a in range(0, self.n, most):
            b = min(self.n, a + most)
            c = min(self.n, b + LONGEST - 1)
            own = data[ends[a] - size[a] : ends[c - 1]], size[a:c]
            strings, rank = _ranked(_column([own, names, flat]))
            word, tag, edge = np.split(rank, [c - a, c - a + len(names[1])])
            columns, alive = [tag[lang[a:b]], word[: b - a]], np.ones(b - a, dtype=np.bool_)
            for k in range(1, LONGEST):
                alive[max(0, c - a - k) :] = False
                at = np.flatnonzero(alive)
                alive[at[~goes_on[a + at + k - 1]]] = False
                at = np.flatnonzero(alive)
                column = np.zeros(b - a, dtype=np.int32)
                column[at] = word[at + k]
                columns.append(column)
            # the borders are sorted in among the paths, each before an equal path
            first = np.zeros((len(borders), LONGEST + 1), dtype=np.int32)
            lengths = np.array([len(x) for x in borders], dtype=np.int64)
            first[np.arange(LONGEST + 1)[None, :] < lengths[:, None]] = edge
            columns = [np.concatenate([first[:, k], column]) for k, column in enumerate(columns)]
            path = np.arange(len(borders) + b - a) >= len(borders)
            order = np.lexsort((path, *_packed(columns, len(strings))[::-1]))
            path = path[order]
            part = np.cumsum(~path, dtype=np.int32)[path]
            columns = [column[order][path] for column in columns]
            heads = np.flatnonzero(_changes(columns))
            yield strings, [column[heads] for column in columns], np.diff(np.r_[heads, len(part)]), part[heads]


def _pack(strings: pa.Array, columns: list[np.ndarray], count: np.ndarray) -> tuple[bytes, int]:
    """A run of paths with the strings that it needs, compressed, and its size before."""
    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    own = strings.take(pa.array(used - 1))
    lengths = pc.binary_length(own).to_numpy().astype(np.int32)
    local = [np.searchsorted(used, c).astype(np.int32) + (c > 0) for c in columns]
    body = b"".join([np.array([len(used), len(count)], np.int32).tobytes(), lengths.tobytes(), b"".join(own.to_pylist()), *[c.astype(np.int32).tobytes() for c in local], count.astype(np.int64).tobytes()])
    return pa.compress(body, codec="zstd", asbytes=True), len(body)


def _unpack(blob: bytes, size: int) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray], np.ndarray]:
    body = np.frombuffer(pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    n, rows = body[:8].view(np.int32).tolist()
    at = 8 + 4 * n
    lengths = np.frombuffer(body[8:at].tobytes(), np.int32).astype(np.int64)
    strings = body[at : at + lengths.sum()]
    at += int(lengths.sum())
    numbers = body[at:].tobytes()
    columns = [np.frombuffer(numbers, np.int32, rows, 4 * rows * k) for k in range(LONGEST + 1)]
    return (strings, lengths), columns, np.frombuffer(numbers[4 * rows * (LONGEST + 1) :], np.int64)


def _merge(runs: list[tuple[bytes, int]], least: int, borders: list[list[bytes]]) -> Iterator[tuple[bytes, list[bytes], int]]:
    """(language, words, count) of a range's nodes: the roots, those with ``least`` occurrences, and those that ``borders`` cut."""
    read = [_unpack(*r) for r in runs]
    flat = _flat([s for b in borders for s in b])
    strings, rank = _ranked(_column([*[r[0] for r in read], flat]))
    edges, rank = rank[len(rank) - len(flat[1]) :], rank[: len(rank) - len(flat[1])]
    begin, columns = 0, []
    for (_, lengths), own, _ in read:
        lookup = np.r_[np.zeros(1, np.int32), rank[begin : begin + len(lengths)]]
        columns.append([lookup[c] for c in own])
        begin += len(lengths)
    columns = [np.concatenate(c) for c in zip(*columns, strict=True)]
    count = np.concatenate([r[2] for r in read])
    order = np.lexsort(_packed(columns, len(strings))[::-1])
    columns, count = [c[order] for c in columns], count[order]
    cuts = np.split(edges, np.cumsum([len(b) for b in borders])[:-1]) if borders else []
    for depth in range(LONGEST + 1):
        heads = np.flatnonzero(_changes(columns[: depth + 1]))
        total = np.add.reduceat(count, heads)
        own = [c[heads] for c in columns[: depth + 1]]
        keep = (total >= least) | (depth == 0)
        for edge in cuts:
            if len(edge) > depth:
                keep |= np.logical_and.reduce([c == e for c, e in zip(own, edge, strict=False)])
        keep &= own[depth] > 0
        at = np.flatnonzero(keep)
        names = [strings.take(pa.array(c[at] - 1)).to_pylist() for c in own]
        yield from zip(names[0], zip(*names[1:], strict=True) if depth else [()] * len(at), total[at].tolist(), strict=True)


# ---- nodes -------------------------------------------------------------------------------------------------------


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Places]:
    places = Places()
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for i, j, data, off in blocks(batch.column(0)):
            places.add(data, off, langs[i:j])
            if places.n >= most:
                yield places
                places = Places()
    yield places


def range_borders(docs: DataFrame, text: str, lang: str, doc_id: str, range_paths: int, trie_words: int) -> list[list[bytes]]:
    """Borders that deal the paths into ranges of about ``range_paths``, from some of the texts.

    At least ``SAMPLE_DOCS`` texts (or all), or ``SAMPLE_SHARE`` of them, give each ``SAMPLE_STEP``-th path of their tries.
    One border a range reaches the driver.
    """
    total = docs.count()
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / max(1, total)))
    unit = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)), F.lit(1 << 30)) / float(1 << 30)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places in _held(batches, trie_words):
            for strings, columns, _, _ in places.tries([], trie_words):
                picked = [c[::SAMPLE_STEP] for c in columns]
                names = [[x if r else None for x, r in zip(strings.take(pa.array(np.maximum(c, 1) - 1)).to_pylist(), c, strict=True)] for c in picked]
                yield pa.RecordBatch.from_arrays([pa.array([[x for x in p if x is not None] for p in zip(*names, strict=True)], pa.list_(pa.binary()))], ["path"])

    paths = cut(_texts(docs.filter(unit < share), text, lang).mapInArrow(sampled, "path array<binary>"))
    n = paths.count()
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    ranges = max(RANGES_A_TASK * tasks, int(n * SAMPLE_STEP / share / range_paths))
    step = max(1, -(-n // ranges))
    picked = positions(paths, "path").filter((F.col("position") > 0) & (F.col("position") % step == 0)).select("path").distinct().collect()
    return sorted([bytes(x) for x in r.path] for r in picked)


def count_nodes(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", range_paths: int = RANGE_PATHS, trie_words: int = TRIE_WORDS) -> tuple[DataFrame, list[list[bytes]]]:
    """(lang, phrase, depth, f, range) of the phrases of 1 to 5 words with at least ``least`` occurrences in a language, and the borders.

    The row of depth 0 and phrase '' has the number of all words of the language. ``range`` is that of the phrase's first path.
    """
    borders = range_borders(docs, text, lang, doc_id, range_paths, trie_words)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(borders)  # a path a range, that is, one for some RANGE_PATHS paths
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(len(borders) + 1) // RANGES_A_TASK))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places in _held(batches, trie_words):
            for strings, columns, count, part in places.tries(sent.value, trie_words):
                heads = np.flatnonzero(_changes([part]))
                out = [(int(part[a]), *_pack(strings, [c[a:b] for c in columns], count[a:b])) for a, b in zip(heads, [*heads[1:], len(part)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.int64())], ["range", "run", "size"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes(part: int, runs: list[tuple[bytes, int]]) -> pa.RecordBatch:
            found = list(_merge(runs, least, sent.value[max(0, part - 1) : part + 1]))
            columns = [pa.array([x[0].decode() for x in found], pa.string()), pa.array([b" ".join(x[1]).decode() for x in found], pa.string()), pa.array([len(x[1]) for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int64()), pa.array([part] * len(found), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "depth", "f", "range"])

        current, held = None, []
        for batch in batches:
            for part, run, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != current and held:
                    yield nodes(current, held)
                    held = []
                current = part
                held.append((run, size))
        if held:
            yield nodes(current, held)

    runs = _texts(docs, text, lang).mapInArrow(shards, "range int, run binary, size bigint")
    parts = runs.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(merged, "lang string, phrase string, depth int, f bigint, range int")
    summed = parts.groupBy("lang", "phrase", "depth").agg(F.sum("f").alias("f"), F.min("range").alias("range"))
    return cut(summed.filter((F.col("f") >= least) | (F.col("depth") == 0))), borders


def with_left_parts(nodes: DataFrame, borders: list[list[bytes]]) -> DataFrame:
    """The nodes of depth 1 and more with ``lefts``: the counts of their first 1, 2, ... words, found by a walk through each range."""
    spark = nodes.sparkSession
    spine = [(k + 1, b[0].decode(), b" ".join(b[1 : d + 1]).decode()) for k, b in enumerate(borders) for d in range(1, len(b))]
    phrases = nodes.filter("depth > 0")
    above = spark.createDataFrame(spine, "at int, lang string, phrase string")  # at most LONGEST a range
    above = phrases.join(above, ["lang", "phrase"]).select("lang", "phrase", "depth", "f", F.col("at").alias("range"), F.lit(True).alias("above"), (F.col("range") == F.col("at")).alias("own"))
    rows = phrases.withColumn("above", F.lit(False)).unionByName(above.filter("not own").drop("own"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(len(borders) + 1) // RANGES_A_TASK))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way: list[tuple[tuple, int]] = []  # from the root to here: (range, lang, words), count
        for batch in batches:
            lefts = []
            for part, lang, words, f in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                key = (part, lang, *words)
                while way and key[: len(way[-1][0])] != way[-1][0]:
                    way.pop()
                lefts.append([n for _, n in way])
                way.append((key, f))
            whole = pa.RecordBatch.from_arrays([*[batch.column(i) for i in (1, 4, 5, 3)], pa.array(lefts, pa.list_(pa.int64())), batch.column(6)], ["lang", "phrase", "depth", "f", "lefts", "above"])
            yield whole

    ordered = rows.select("range", "lang", F.split("phrase", " ").alias("words"), "f", "phrase", "depth", "above").repartition(tasks, "range").sortWithinPartitions("range", "lang", "words")
    return ordered.mapInArrow(walk, "lang string, phrase string, depth int, f bigint, lefts array<bigint>, above boolean").filter("not above").drop("above")


def with_right_parts(nodes: DataFrame, longest: int = LONGEST) -> list[DataFrame]:
    """By depth from 2: the nodes with ``rights``, the counts after their first 1, 2, ... words, over suffix links."""
    links, out = nodes.filter("depth = 1").select("lang", "phrase", "f", F.array().cast("array<bigint>").alias("rights")), []
    for depth in range(2, longest + 1):
        here = nodes.filter(F.col("depth") == depth).withColumn("link", F.substring_index("phrase", " ", 1 - depth))
        to = links.select(F.col("lang").alias("to_lang"), F.col("phrase").alias("to"), F.col("f").alias("to_f"), F.col("rights").alias("to_rights"))
        joined = here.join(to, (F.col("lang") == F.col("to_lang")) & (F.col("link") == F.col("to")))
        found = cut(joined.select("lang", "phrase", "depth", "f", "lefts", F.concat(F.array("to_f"), "to_rights").alias("rights")))
        out.append(found)
        links = found
    return out


def lowest_cut() -> Column:
    """(score, k, l, r) of the cut after the first k words with the lowest score, the smallest k of equals."""
    cut_at = "struct((cast(1000 as decimal(4,0)) * cast(f as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(lefts[k - 1] as decimal(19,0)) * cast(rights[k - 1] as decimal(19,0))) as score, k, lefts[k - 1] as l, rights[k - 1] as r)"
    return F.array_min(F.expr(f"transform(sequence(1, depth - 1), k -> {cut_at})"))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, absorb: int = 100, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", range_paths: int = RANGE_PATHS, trie_words: int = TRIE_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by (score descending, a descending, phrase).

    A phrase of 2 to 5 words occurs ``a`` >= ``least`` times within pieces, its parts l and r times, all words of the language n
    times; score is floor(1000 a n / (l r)) at the cut where it is lowest. A phrase is left out if a longer one that
    holds it has at least ``absorb`` % of its occurrences: as counts only fall with length, it is enough to look one word up.
    Null texts are empty, a null language is 'und'; repeated rows count as often as they are there; no texts, or none with a
    frequent phrase, give no rows. Other columns are not read.
    """
    counted, borders = count_nodes(docs, least, text, lang, doc_id, range_paths, trie_words)
    walked = cut(with_left_parts(counted, borders))
    levels = with_right_parts(walked)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    outer = F.array(
        F.struct(F.expr("substring_index(phrase, ' ', depth - 1)").alias("p"), F.element_at("lefts", -1).alias("n")),
        F.struct(F.expr("substring_index(phrase, ' ', 1 - depth)").alias("p"), F.get("rights", F.lit(0)).alias("n")),
    )
    within = found.filter("depth > 2").select("lang", "f", F.explode(outer).alias("part")).filter(100 * F.col("f") >= absorb * F.col("part.n"))
    kept = found.join(within.select("lang", F.col("part.p").alias("phrase")).distinct(), ["lang", "phrase"], "left_anti")
    sizes = counted.filter("depth = 0").select("lang", F.col("f").alias("n"))  # a row a language
    scored = kept.join(sizes, "lang").withColumn("best", lowest_cut()).select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = scored.withColumn("bucket", F.pmod(F.hash("phrase"), F.lit(TOP_BUCKETS)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*by))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
