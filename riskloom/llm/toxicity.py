"""A toxicity classifier with counterfactual regularisation.

Features are the words of a whole text and their beginnings (3 to 6 bytes), each hashed and counted once a
text. From a bounded sample of labelled rows, the most telling features are chosen by the z-score of
their log odds, and a logistic regression is fitted on them. Wherever a labelled text names a group
(``identity`` terms), the term is swapped for every other term of its set, and the squared change of
the score is penalised: what a neutral mention adds for one group but not for another is taken out, and
a term that stands in toxic texts by accident loses its weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_sample, cut
from riskloom.llm.words import LETTERS, Words, blocks, hash_tokens

SPACE = 1 << 22
PREFIXES = (3, 4, 5, 6)
FEATURES = 4096
SAMPLE = 4000  # labelled rows of each class, at most
PENALTY = 4.0

#: Sets of terms that may stand for one another. Fixed values; callers may give their own.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)


def _fold(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h ^ np.uint64(kind * 0x9E3779B9)) % np.uint64(SPACE)).astype(np.int64)


def word_features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, features) by kind: whole words, then beginnings of words at least that long."""
    size = words.end - words.start
    spans = [(words.start, words.end)] + [(words.start, np.minimum(words.end, words.start + k)) for k in PREFIXES]
    out = []
    for kind, h in enumerate(words.spans(spans)):
        at = np.arange(len(size)) if not kind else np.flatnonzero(size >= PREFIXES[kind - 1])
        out.append((at, _fold(h[at], kind)))
    return out


def document_features(words: Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) once for each feature of a text; only those in the table ``wanted`` if it is given."""
    codes = []
    for at, f in word_features(words):
        if wanted is not None:
            keep = wanted[f]
            at, f = at[keep], f[keep]
        codes.append(words.doc[at] * SPACE + f)
    code = np.unique(np.concatenate(codes))
    return code // SPACE, code % SPACE


def swapped(text: str, identity: tuple[tuple[str, ...], ...]) -> list[str]:
    """The text with the n-th identity term of each set put for the others, for every n; none if it names no group."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    w = Words(data, np.array([0, len(data)]), LETTERS)
    raw = w.data.tobytes()
    sets = {t.encode(): s for s in identity for t in s}
    found = [(int(a), int(b), sets[raw[a:b]]) for a, b in zip(w.start, w.end, strict=True) if raw[a:b] in sets]
    out = []
    for n in range(max((len(s) for _, _, s in found), default=0)):
        parts, last = [], 0
        for a, b, s in found:
            parts += [raw[last:a], s[n % len(s)].encode()]
            last = b
        other = b"".join([*parts, raw[last:]])
        if other != raw:
            out.append(other.decode())
    return out


@dataclass
class Toxicity:
    """Feature numbers (sorted), weights and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(SPACE, dtype=np.float32)
        out[self.features] = self.weights
        return out


def fit_logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int, changes: list[tuple[np.ndarray, np.ndarray]] | None = None, penalty: float = PENALTY, ridge: float = 1e-4, steps: int = 400, prior: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam; ``changes`` hold (gained, lost) features of swapped texts, penalised by the square."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    gr = np.concatenate([np.full(len(g) + len(o), i) for i, (g, o) in enumerate(changes)]) if changes else np.zeros(0, dtype=np.int64)
    gc = np.concatenate([np.r_[g, o] for g, o in changes]).astype(np.int64) if changes else np.zeros(0, dtype=np.int64)
    gs = np.concatenate([np.r_[np.ones(len(g)), -np.ones(len(o))] for g, o in changes]) if changes else np.zeros(0)
    w, b = np.zeros(n_features), 0.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        g = np.bincount(cols, d[rows], n_features) + ridge * w
        if changes:
            delta = np.bincount(gr, w[gc] * gs, len(changes))
            g += 2 * penalty / len(changes) * np.bincount(gc, delta[gr] * gs, n_features)
        gb = d.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 if t < steps * 0.7 else 0.02
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b = b - rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, float(b)


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", limit: int = SAMPLE, features: int = FEATURES, identity: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = PENALTY) -> Toxicity:
    """Fit on about ``limit`` rows of each class of ``labelled``; rows with a null label are left out.

    The driver sees at most ``features`` features, and of each sampled text only those. With one class or
    none, the classifier is its intercept: 1 if all labels are 1, 0 if all are 0 or there are none.
    """
    rows = labelled.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    both = bounded_sample(rows.filter("y = 1"), F.struct("k", "text"), limit).unionByName(bounded_sample(rows.filter("y = 0"), F.struct("k", "text"), limit))
    sample = cut(both.repartition(2 * both.sparkSession.sparkContext.defaultParallelism))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in blocks(batch.column(1)):
                d, f = document_features(Words(data, off, LETTERS))
                unique, inverse = np.unique(f, return_inverse=True)
                toxic = np.bincount(inverse, y[lo:hi][d], len(unique)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(toxic), pa.array(np.bincount(inverse, minlength=len(unique)).astype(np.int64) - toxic)], ["f", "t", "c"])

    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Toxicity(np.zeros(0, dtype=np.int64), np.zeros(0), 8.0 if 1 in sizes else -8.0)
    odds = lambda c, n: F.log((F.col(c) + 0.5) / (F.lit(float(n)) + 0.5 - F.col(c)))
    z = F.abs(odds("t", sizes[1]) - odds("c", sizes[0])) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    totals = sample.mapInArrow(counts, "f bigint, t bigint, c bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    best = totals.filter("t + c >= 3").select("f", z.alias("z")).orderBy(F.desc("z"), "f").limit(features)
    chosen = np.sort(np.array([r.f for r in best.collect()], dtype=np.int64))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(SPACE, dtype=np.bool_)
        wanted[chosen] = True
        terms = np.sort(hash_tokens([t.encode() for s in identity for t in s]))
        for batch in batches:
            y = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in blocks(batch.column(1)):
                words = Words(data, off, LETTERS)
                d, f = document_features(words, wanted)
                at = np.searchsorted(d, np.arange(hi - lo + 1))
                lists = [f[at[i] : at[i + 1]] for i in range(hi - lo)]
                named = np.unique(words.doc[np.isin(words.hashes(), terms)]).tolist()
                gained: list[list[np.ndarray]] = [[] for _ in lists]
                for i in named:
                    for other in swapped(data[off[i] : off[i + 1]].tobytes().decode(), identity):
                        raw = np.frombuffer(other.encode(), dtype=np.uint8)
                        gained[i].append(document_features(Words(raw, np.array([0, len(raw)]), LETTERS), wanted)[1])
                yield pa.RecordBatch.from_arrays([pa.array(y[lo:hi].astype(np.int32)), pa.array([x.tolist() for x in lists], pa.list_(pa.int64())), pa.array([[x.tolist() for x in g] for g in gained], pa.list_(pa.list_(pa.int64())))], ["y", "f", "g"])

    got = sample.mapInArrow(select, "y int, f array<bigint>, g array<array<bigint>>").collect()  # at most 2 * limit rows of chosen features
    got.sort(key=lambda r: (r.y, r.f, r.g))
    y = np.array([r.y for r in got])
    lengths = np.array([len(r.f) for r in got])
    cols = np.searchsorted(chosen, np.concatenate([np.array(r.f, dtype=np.int64) for r in got]))
    changes = []
    for r in got:
        own = set(r.f)
        for other in map(set, r.g):
            changes.append((np.searchsorted(chosen, sorted(other - own)), np.searchsorted(chosen, sorted(own - other))))
    weights, bias = fit_logistic(np.repeat(np.arange(len(got)), lengths), cols, y, len(chosen), changes, penalty)
    return Toxicity(chosen, weights, bias)


def score(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and score (0 to 1), predicted (1 if score >= 0.5), from whole texts.

    A null or empty text has no features and is scored by the intercept. Repeated rows are scored each;
    columns named score or predicted are replaced; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(kept).schema.add("score", "double").add("predicted", "integer")
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value.table()
        wanted = weights != 0
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column(at)):
                d, f = document_features(Words(data, off, LETTERS), wanted)
                z = np.bincount(d, weights[f], hi - lo) + sent.value.bias
                p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [x.name for x in schema])

    return docs.select(kept).mapInArrow(run, schema)
