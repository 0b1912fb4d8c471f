"""References divided into cells, so that a search looks only where a neighbour can be.

The references of a tag, or of each cluster of it, are divided by halving along the dimension of the largest variance, until
a cell has at most about ``cell_rows``. The halves are found on a sample of some SAMPLE rows a cell; every reference is then put
into its cell, and boxes are taken of all rows. So the sample decides how even the cells are, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.features import DIMS, VECTOR
from riskloom.operators.index_build import MAX_CLUSTERS, MAXS, MINS

SAMPLE = 64  # rows of the sample in a full cell
MAX_CELLS = 1 << 15  # boxes that are broadcast; beyond about half as many, cells grow
TAGS = 16


class Cells(NamedTuple):
    """``rows``: cell, vi, label, v0..v13; ``boxes`` by tag: cells, their clusters, least and greatest values."""

    rows: DataFrame
    boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def grow(x: np.ndarray, most: int) -> tuple[list[list[int]], list[np.ndarray]]:
    """Nodes (dimension, bound, node up to the bound, node beyond it), a leaf being (-1, its number, 0, 0), and the rows of each leaf."""
    nodes: list[list[int]] = []
    leaves: list[np.ndarray] = []

    def add(rows: np.ndarray) -> int:
        i, part = len(nodes), x[rows]
        nodes.append([-1, len(leaves), 0, 0])
        d = int(part.var(axis=0).argmax()) if len(rows) > most else 0
        side = part[:, d]
        if len(rows) <= most or side.min() == side.max():
            leaves.append(rows)
            return i
        middle = (len(rows) - 1) // 2
        bound = np.partition(side, middle)[middle]
        if bound == side.max():
            bound = side[side < bound].max()
        nodes[i] = [d, int(bound), add(rows[side <= bound]), add(rows[side > bound])]
        return i

    add(np.arange(len(x)))
    return nodes, leaves


def descend(nodes: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The number of the leaf below node ``at`` of each row."""
    at = at.copy()
    while len(on := np.flatnonzero(nodes[at, 0] >= 0)):
        here = nodes[at[on]]
        at[on] = np.where(x[on, here[:, 0]] <= here[:, 1], here[:, 2], here[:, 3])
    return nodes[at, 1]


def gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    out = np.zeros((len(q), len(low)), dtype=q.dtype)
    for i in range(DIMS):
        if low[:, i].min() == high[:, i].max():  # all boxes are the same here
            g = q[:, i] - low[0, i]
            out += (g * g)[:, None]
            continue
        g = np.clip(q[:, i][:, None], low[:, i], high[:, i])
        g -= q[:, i][:, None]
        g *= g
        out += g
    return out


def _group(names: list[str]) -> Column:
    """Tag and cluster in one number."""
    return (F.col("etag") * MAX_CLUSTERS + (F.col("cid") if "cid" in names else F.lit(0))).cast("int").alias("group")


def _vectors(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy() for i in range(DIMS)], axis=1).astype(np.int64)


def divide(refs: DataFrame, names: list[str], cell_rows: int) -> Cells | None:
    """The cells of references (``names``: etag, or etag and cid; vi, label, v0..v13), or None where no tag has more than ``cell_rows``.

    ``refs`` should be stored: they are read several times.
    """
    counts = refs.groupBy(_group(names)).agg(F.count("*").alias("n")).toArrow()  # at most TAGS x MAX_CLUSTERS rows
    counts = counts.sort_by("group")
    groups, sizes = counts.column("group").to_numpy(), counts.column("n").to_numpy()
    if np.bincount(groups // MAX_CLUSTERS, sizes, 1).max() <= cell_rows:
        return None
    cell_rows = max(cell_rows, int(sizes.sum()) // (MAX_CELLS // 2))
    large = set(groups[sizes > cell_rows].tolist())
    share = min(1.0, SAMPLE / cell_rows)
    some = refs.filter(F.pmod(F.xxhash64("vi", "etag"), F.lit(1 << 20)) < int(share * (1 << 20))).select(_group(names), *VECTOR).toArrow().combine_chunks()
    own = some.column("group").to_numpy()
    x = np.stack([some.column(v).to_numpy() for v in VECTOR], axis=1).astype(np.int64)
    order = np.argsort(own, kind="stable")
    own, x = own[order], x[order]
    nodes: list[list[int]] = []
    root, of = np.zeros(TAGS * MAX_CLUSTERS, np.int64), []
    for g in groups.tolist():
        root[g] = len(nodes)
        a, b = np.searchsorted(own, [g, g + 1]) if g in large else (0, 0)
        tree, leaves = grow(x[a:b], max(1, int(cell_rows * share)))
        nodes += [[d, c + len(of), 0, 0] if d < 0 else [d, c, i + root[g], j + root[g]] for d, c, i, j in tree]
        of += [g] * len(leaves)
    sent = refs.sparkSession.sparkContext.broadcast((np.array(nodes, np.int64), root))  # at most about two nodes a cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = descend(sent.value[0], sent.value[1][batch.column(0).to_numpy()], _vectors(batch, 3))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns[1:]], ["cell", *batch.schema.names[1:]])

    schema = "cell int, vi bigint, label int, " + ", ".join(f"{v} smallint" for v in VECTOR)
    rows = refs.select(_group(names), "vi", F.col("label").cast("int").alias("label"), *[F.col(v).cast("smallint").alias(v) for v in VECTOR]).mapInArrow(run, schema)
    boxes = rows.groupBy("cell").agg(*[F.min(v).alias(m) for v, m in zip(VECTOR, MINS, strict=True)], *[F.max(v).alias(m) for v, m in zip(VECTOR, MAXS, strict=True)]).orderBy("cell").toArrow()
    cell = boxes.column("cell").to_numpy()
    tag, cid = np.divmod(np.array(of)[cell], MAX_CLUSTERS)
    low, high = (np.stack([boxes.column(m).to_numpy() for m in ends], axis=1).astype(np.int64) for ends in (MINS, MAXS))
    return Cells(rows, {t: (cell[tag == t], cid[tag == t], low[tag == t], high[tag == t]) for t in np.unique(tag).tolist()})


def visits(queries: DataFrame, cells: Cells, turn: str, near: tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int] | None = None) -> DataFrame:
    """(qid, cell, worst, v0..v13): the cells that queries (qid, etag, worst, v0..v13) go to.

    ``turn``: "home" is the cell with the nearest box; "rest" the others whose box is no farther than ``worst``. With ``near``, which has
    the clusters of each tag (numbers, least and greatest values) and a number, only cells of so many nearest clusters count; "outside"
    are the cells of all other clusters whose box is no farther than ``worst``.
    """
    sent = queries.sparkSession.sparkContext.broadcast((cells.boxes, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes, near = sent.value
        for batch in batches:
            etag, worst, v = batch.column(1).to_numpy(), batch.column(2).to_numpy(), _vectors(batch, 3)
            for t in np.unique(etag).tolist():
                if t not in boxes:
                    continue
                cell, owner, low, high = boxes[t]
                mine = np.flatnonzero(etag == t)
                for at in np.array_split(mine, max(1, len(mine) * len(cell) >> 18)):
                    gap = gaps(v[at], low, high)
                    open_to = np.ones(gap.shape, bool)
                    if near is not None:
                        cids, *ends = near[0][t]
                        by = gap if np.array_equal(cids, owner) else gaps(v[at], *ends)  # a cell each: the same boxes
                        by = by * len(cids) + np.arange(len(cids))  # ties to the first
                        first = min(near[1], len(cids))
                        chosen = by <= np.partition(by, first - 1, axis=1)[:, first - 1 : first]
                        open_to = chosen[:, np.searchsorted(cids, owner)]
                    if turn == "outside":
                        take = ~open_to & (gap <= worst[at][:, None])
                    else:
                        home = np.where(open_to, gap, np.iinfo(np.int64).max).argmin(axis=1)
                        take = open_to & (gap <= worst[at][:, None]) if turn == "rest" else np.zeros(gap.shape, bool)
                        take[np.arange(len(at)), home] = turn == "home"
                    r, c = np.nonzero(take)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[r])), pa.array(cell[c]), pa.array(worst[at[r]]), *(pa.array(v[at[r], i].astype(np.int16)) for i in range(DIMS))], ["qid", "cell", "worst", *VECTOR])

    return queries.select("qid", "etag", "worst", *VECTOR).mapInArrow(run, "qid bigint, cell int, worst bigint, " + ", ".join(f"{v} smallint" for v in VECTOR))
