"""Language identification with a byte convolutional network, trained and applied in numpy.

A text is cut into windows of WINDOW bytes that overlap by the widest filter less one. Filters of several
widths run over the bytes (one-hot), each is max-pooled over the window, and a softmax over the pooled
activations gives the languages. The windows' logits, weighted by their bytes, are averaged over the whole
text. Since its input is one-hot, a filter is a sum of table entries; pairs of bytes share one lookup.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut
from riskloom.llm.words import LOWER, blocks

WINDOW = 256  # positions of each filter in a window
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
SPAN = WINDOW + max(WIDTHS) - 1
TRAIN_DOCUMENTS = 3000  # labelled texts, about
TRAIN_WINDOWS = 40_000  # and their windows
TRAIN_STEPS = 110_000  # windows seen in all epochs, about
_LETTER = np.zeros(256, dtype=np.bool_)
_LETTER[97:123] = True


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, SPAN) bytes padded with 0, the row of each window, and its bytes; an empty text has one window."""
    size = np.diff(off)
    n = np.maximum(1, -(-size // WINDOW))
    row = np.repeat(np.arange(len(n)), n)
    start = np.repeat(off[:-1], n) + WINDOW * (np.arange(int(n.sum())) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n))
    at = start[:, None] + np.arange(SPAN)
    end = off[1:][row]
    padded = np.r_[data, np.zeros(1, dtype=np.uint8)]
    x = np.where(at < end[:, None], padded[np.minimum(at, len(data))], 0).astype(np.uint8)
    return x, row, np.minimum(WINDOW, end - start)


@dataclass
class Network:
    """Filter tables by width (width, 256, FILTERS), biases, the softmax layer and the languages."""

    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    langs: list[str]

    def pairs(self) -> list[list[np.ndarray]]:
        """The tables with two neighbouring bytes merged into one index, for applying the filters."""
        merged = []
        for t in self.tables:
            parts = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(t) - 1, 2)]
            merged.append(parts + ([t[-1]] if len(t) % 2 else []))
        return merged


def pooled(x: np.ndarray, pairs: list[list[np.ndarray]], batch: int = 128) -> np.ndarray:
    """Max-pooled filter responses (n, filters) of windows ``x``."""
    outs = np.empty((len(x), sum(p[0].shape[1] for p in pairs)), dtype=np.float32)
    for a in range(0, len(x), batch):
        part = x[a : a + batch].astype(np.intp)
        two = (part[:, :-1] << 8) | part[:, 1:]
        col = 0
        for tables in pairs:
            total = None
            for k, t in enumerate(tables):
                index = two[:, 2 * k : 2 * k + WINDOW] if len(t) == 65536 else part[:, 2 * k : 2 * k + WINDOW]
                got = np.take(t, index, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            half = WINDOW
            while half > 1:
                half //= 2
                total = np.maximum(total[:, :half], total[:, half : 2 * half])
            outs[a : a + batch, col : col + total.shape[2]] = total[:, 0]
            col += total.shape[2]
    return outs


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 12, batch: int = 64, seed: int = 11) -> Network:
    """Fit the network on windows ``x`` and language numbers ``y`` by Adam on the cross-entropy.

    A third of the windows are cut to a short length each epoch, so that short texts are learned too.
    """
    rng = np.random.default_rng(seed)
    p = {f"t{w}": rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    n_filters = FILTERS * len(WIDTHS)
    p |= {"b": np.zeros(n_filters, np.float32), "o": rng.normal(0, 0.1, (n_filters, len(langs))).astype(np.float32), "c": np.zeros(len(langs), np.float32)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            at = order[a : a + batch]
            xb, yb, rows = x[at].copy(), y[at], np.arange(len(at))
            short = rng.random(len(at)) < 0.33
            ends = rng.integers(12, 80, len(at))
            xb[short[:, None] & (np.arange(SPAN)[None, :] >= ends[:, None])] = 0
            best, at_best = [], []
            for w in WIDTHS:
                conv = sum(p[f"t{w}"][k][xb[:, k : k + WINDOW]] for k in range(w))
                pos = conv.argmax(axis=1)
                at_best.append(pos)
                best.append(np.take_along_axis(conv, pos[:, None, :], axis=1)[:, 0])
            pre = np.concatenate(best, axis=1) + p["b"]
            act = np.maximum(pre, 0)
            logit = act @ p["o"] + p["c"]
            prob = np.exp(logit - logit.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            d = prob.copy()
            d[rows, yb] -= 1
            d /= len(at)
            g = {"o": act.T @ d + 1e-4 * p["o"], "c": d.sum(axis=0)}
            back = (d @ p["o"].T) * (pre > 0)
            g["b"] = back.sum(axis=0)
            for i, w in enumerate(WIDTHS):
                gt = np.zeros_like(p[f"t{w}"])
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    byte = np.take_along_axis(xb, at_best[i] + k, axis=1)
                    np.add.at(gt[k], (byte, np.arange(FILTERS)[None, :]), own)
                g[f"t{w}"] = gt
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network([p[f"t{w}"].astype(np.float32) for w in WIDTHS], p["b"], p["o"], p["c"], langs)


def _some_of_each(rows: DataFrame, kind: str, unit: Column, limit: int) -> DataFrame:
    """About ``limit`` of ``rows`` in equal shares for each value of ``kind``, at least the row (and its equals) of least ``unit`` of each."""
    sizes = cut(rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.min(unit).alias("first")))  # a row a kind
    kinds = max(1, sizes.count())
    most = F.greatest(F.least(F.lit(1.0), F.lit(limit / kinds) / F.col("n")), "first")
    # broadcast: a row a language, which is no more than the network's own output layer in each task
    return rows.join(F.broadcast(sizes), F.col(kind) == F.col("kind")).filter(unit <= most).select(rows.columns)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", limit: int = TRAIN_DOCUMENTS, most_windows: int = TRAIN_WINDOWS) -> Network | None:
    """Train on all windows of about ``limit`` labelled texts; None if there are none.

    Every language present is learned: all get equal shares of the sample, a rare one has all its texts in it, and the
    rarest share at least one text. If the sampled texts have more than ``most_windows`` windows, a hash of text and place
    picks that many of them, again in equal shares and at least one each. So at most about ``limit`` texts and ``most_windows``
    windows are learned from, or one a language if that is more. Rows with a null text or language are left out. Rows
    alike in id and text stand or fall together.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null and t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, off in blocks(batch.column(1)):
                x, row, _ = windows(LOWER[data], off)
                flat = pa.py_buffer(np.ascontiguousarray(x))
                w = pa.Array.from_buffers(pa.binary(SPAN), len(x), [None, flat]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row)), w], ["l", "w"])

    unit = lambda *c: F.pmod(F.xxhash64(*c, F.lit(7919)), F.lit(1 << 40)) / float(1 << 40)
    found = cut(_some_of_each(rows, "l", unit("k", "t"), limit).select("l", "t").mapInArrow(run, "l string, w binary"))
    if found.count() > most_windows:
        found = _some_of_each(found, "l", unit("l", "w"), most_windows)
    got = found.orderBy("l", "w").toArrow()
    langs, y = np.unique(np.array(got.column("l").to_pylist(), dtype=object).astype(str), return_inverse=True)
    if not len(langs):
        return None
    x = np.frombuffer(b"".join(got.column("w").to_pylist()), dtype=np.uint8).reshape(-1, SPAN)
    return train(x, y, langs.tolist(), epochs=max(3, min(12, TRAIN_STEPS // len(x))))


def _has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(_LETTER[data])]
    out = sums[off[1:]] > sums[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)).tolist():
        out[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode())
    return out


def predict(net: Network | None, data: np.ndarray, off: np.ndarray, pairs: list | None = None) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text of a block."""
    n = len(off) - 1
    if net is None:
        return ["und"] * n, np.zeros(n)
    data = LOWER[data]
    x, row, size = windows(data, off)
    act = np.maximum(pooled(x, net.pairs() if pairs is None else pairs) + net.bias, 0)
    logit = (act @ net.out + net.out_bias).astype(np.float64)
    weight = np.maximum(size, 1).astype(np.float64)
    mean = np.stack([np.bincount(row, logit[:, k] * weight, n) for k in range(len(net.langs))], axis=1) / np.bincount(row, weight, n)[:, None]
    prob = np.exp(mean - mean.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    best, letter = prob.argmax(axis=1), _has_letter(data, off)
    return [net.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)], np.where(letter, prob.max(axis=1), 0.0)


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, score, for every whole text.

    A null text, or one without any letter, is ``und`` with score 0; so is every text if nothing could be
    learned. Ties take the language first in alphabetical order. Repeated rows are scored each; columns
    named lang_pred or score are replaced; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(kept).schema.add("lang_pred", "string").add("score", "double")
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sent.value.pairs() if sent.value else None
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column(at)):
                lang, score = predict(sent.value, data, off, pairs)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(lang, pa.string()), pa.array(score)], [f.name for f in schema])

    return docs.select(kept).mapInArrow(run, schema)
