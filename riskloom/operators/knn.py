"""Nearest neighbours among the labelled vectors of a query's tag, exact or by probing clusters.

The heavy step is one streaming operator (``block_topk``). References are dealt into blocks of bounded size
and queries are sent to the blocks they must see; rows are shuffled by block and sorted with the references
first, so a task holds one block of references and streams any number of queries past it, with exact
integer distances from a matrix product. Each block gives at most k candidates a query; those few rows are
then merged by query. A tag or cluster of any size is thus many blocks, never one task's group.

Few queries (a micro-batch) are broadcast instead, up to a checked number, and the references are scanned where
they lie: only the candidates of each task are shuffled, never the index (``scan_beside``).

Equal queries have equal answers, so each distinct vector of a tag asks once. Of equal references only the k earliest can
be among the k nearest, so a search by blocks leaves the others out. Work thus grows with the distinct vectors, not with
their repetitions.

Where a tag has more references than a block, it is divided into ``cells``, for probing within each cluster. A query first goes to the cell
with the nearest box; the k-th neighbour found there bounds the others it must see. In a task, the same is done with the
leaves of the block. So a query's work grows with the references near it, not with all of its tag.

``search_ivf`` probes the clusters whose boxes are nearest. Queries with mixed votes are then completed with
every other cluster whose box is no farther than the fifth neighbour found, which makes their answer exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.cells import Cells, divide, gaps, grow, visits
from riskloom.operators.features import DIMS, VECTOR
from riskloom.operators.index_build import MAXS, MINS
from riskloom.session import cut

K = 5
PROBES = 12
MIXED = (1, 4)  # votes from .. to that are searched again
BLOCK_ROWS = 1 << 15
QUERY_ROWS = 1 << 17
LEAST_QUERY_ROWS = 1 << 11
LEAF_ROWS = 1 << 9
FAR = 1 << 62  # no bound
FEW_QUERIES = 1 << 12  # broadcast for an exact search: 44 bytes each
FEW_PROBES = 1 << 17  # broadcast for probing


# ---- declarative forms -------------------------------------------------------------------------------------------


def distance(a: list[Column], b: list[Column]) -> Column:
    """Squared Euclidean distance of two vectors of integer columns, as bigint."""
    total = F.lit(0).cast("bigint")
    for x, y in zip(a, b, strict=True):
        d = x.cast("bigint") - y.cast("bigint")
        total = total + d * d
    return total


def array_distance(a: Column, b: Column) -> Column:
    """Squared distance of two arrays of any length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def lower_bound(query: list[Column], low: list[Column], high: list[Column]) -> Column:
    """Squared distance from a query to a box: the least distance any vector in it can have."""
    total = F.lit(0).cast("bigint")
    for q, a, b in zip(query, low, high, strict=True):
        gap = F.greatest(a.cast("bigint") - q, q - b.cast("bigint"), F.lit(0).cast("bigint"))
        total = total + gap * gap
    return total


def rank_clusters(queries: DataFrame, clusters: DataFrame, ident: str = "qid") -> DataFrame:
    """Every (query, cluster of its effective tag) with ``lb`` and ``rank`` by (lb, cid)."""
    q, c = queries.alias("q"), clusters.alias("c")
    lb = lower_bound([F.col(f"q.{v}") for v in VECTOR], [F.col(f"c.{m}") for m in MINS], [F.col(f"c.{m}") for m in MAXS])
    pairs = q.join(c, F.col("q.etag") == F.col("c.tag")).select(F.col(f"q.{ident}").alias(ident), F.col("q.etag").alias("etag"), F.col("c.cid").alias("cid"), lb.alias("lb"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(ident).orderBy("lb", "cid")))


def effective_tag(present: list[int]) -> Column:
    """The tag to search: the query's, else without card_present, else without is_online too, else null."""
    here = lambda t: F.when(t.isin(present), t)
    t = F.col("tag")
    return F.coalesce(here(t), here(t.bitwiseAND(F.lit(7))), here(t.bitwiseAND(F.lit(3))))


def with_effective_tag(queries: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add ``etag`` from the tags that the index has (at most 16)."""
    present = sorted(r.tag for r in clusters.select("tag").distinct().collect())
    return queries.withColumn("etag", effective_tag(present))


# ---- block top-k -------------------------------------------------------------------------------------------------


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(DIMS)], axis=1).astype(np.float64)


_GROUP = 64


def _topk(q: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, reference row, distance) of the k nearest, ties to the earlier reference; all exact in doubles.

    A key is the distance (but for what depends on the query alone) and the row in one number. The k nearest lie in the k
    groups of references with the smallest least keys, so only those groups are looked through.
    """
    n, k = len(r), min(k, len(r))
    groups = -(-n // _GROUP)
    shift = float(1 << n.bit_length())  # keys stay below 2**53: 14 x 2e8 x 2**17
    padded = np.zeros((groups * _GROUP, r.shape[1]))
    padded[:n] = r
    base = (padded * padded).sum(axis=1) * shift + np.arange(len(padded))
    base[n:] = np.inf
    across, own = np.ascontiguousarray(padded.T), (q * q).sum(axis=1)
    rows, refs, dists = [], [], []
    step = max(1, (1 << 20) // len(padded))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        key = (part * (-2.0 * shift)) @ across
        key += base
        key = key.reshape(len(part), groups, _GROUP)
        if groups > k:
            near = np.argpartition(key.min(axis=2), k - 1, axis=1)[:, :k]
            key = np.take_along_axis(key, near[:, :, None], axis=1)
        flat = key.reshape(len(part), -1)
        best = np.sort(np.partition(flat, k - 1, axis=1)[:, :k], axis=1)
        at = np.mod(best, shift)
        rows.append(np.repeat(np.arange(a, a + len(part)), k))
        refs.append(at.astype(np.int64).ravel())
        dists.append(((best - at) / shift + own[a : a + step, None]).ravel())
    return np.concatenate(rows), np.concatenate(refs), np.concatenate(dists)


class _Block:
    """The references of a block (vectors, positions, labels) in leaves of near ones, each in the order of positions."""

    def __init__(self, r: np.ndarray, vi: np.ndarray, label: np.ndarray) -> None:
        order = np.argsort(vi, kind="stable")
        leaves = [order[x] for x in grow(r[order], LEAF_ROWS)[1]]  # grow keeps the order of rows
        self.r, self.vi, self.label = (x[np.concatenate(leaves)] for x in (r, vi, label))
        self.ends = np.cumsum([0, *map(len, leaves)])
        self.low, self.high = (np.stack([f(r[x], axis=0) for x in leaves]) for f in (np.min, np.max))

    def topk(self, q: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, reference row, distance) of the k nearest no farther than ``worst``, ties to the earlier position."""
        dist, at = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
        dist[:, -1] = worst + 0.5  # distances are whole: what is farther than worst can't come in
        dist[:, :-1] = dist[:, -1:]
        bound = gaps(q, self.low, self.high)
        home = bound.argmin(axis=1)
        for turn in (True, False):  # of each query the nearest leaf, then the others that can matter
            for leaf, (a, b) in enumerate(zip(self.ends[:-1], self.ends[1:], strict=True)):
                mine = np.flatnonzero(((home == leaf) == turn) & (bound[:, leaf] <= dist[:, -1]))
                if not len(mine):
                    continue
                _, ref, d = _topk(q[mine], self.r[a:b], k)
                both = np.hstack([dist[mine], np.rint(d).reshape(len(mine), -1)]), np.hstack([at[mine], ref.reshape(len(mine), -1) + a])
                rank = np.lexsort((self.vi[both[1]], both[0]), axis=1)[:, :k]
                dist[mine], at[mine] = (np.take_along_axis(x, rank, axis=1) for x in both)
        row, nth = np.nonzero(dist <= worst[:, None])
        return row, at[row, nth], dist[row, nth]


def _tasks(df: DataFrame) -> int:
    """Partitions for the block scan. A number is given because few bytes make much work here: left alone,
    Spark would merge small partitions into one task.
    """
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


CANDIDATES = "qid bigint, vi bigint, dist bigint, label int"


def block_topk(queries: DataFrame, refs: DataFrame, k: int = K) -> DataFrame:
    """At most k candidates for each (query, block): CANDIDATES.

    ``queries``: block bigint, id bigint, v0..v13 and perhaps worst bigint, beyond which nothing is looked for; ``refs``: the
    same with label, without worst, at most BLOCK_ROWS rows a block.
    """
    worst = F.col("worst") if "worst" in queries.columns else F.lit(FAR)
    none = F.lit(0).cast("bigint").alias("worst")
    both = refs.select("block", F.lit(0).alias("kind"), "id", "label", none, *VECTOR).unionByName(queries.select("block", F.lit(1).alias("kind"), "id", F.lit(0).alias("label"), worst.alias("worst"), *VECTOR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, ready = None, [], None
        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, label, worst, v = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(), _matrix(batch, 5)
            edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])]) if len(block) else []
            for a, b in zip(edges, [*edges[1:], len(block)], strict=True):
                if block[a] != current:
                    current, held, ready = block[a], [], None
                if kind[a] == 0:
                    held.append((v[a:b], ids[a:b], label[a:b]))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = _Block(*(np.concatenate([h[i] for h in held]) for i in range(3)))
                row, ref, dist = ready.topk(v[a:b], worst[a:b], k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][row]), pa.array(ready.vi[ref]), pa.array(dist.astype(np.int64)), pa.array(ready.label[ref].astype(np.int32))], ["qid", "vi", "dist", "label"])

    return both.repartition(_tasks(queries), "block").sortWithinPartitions("block", "kind", "id").mapInArrow(run, CANDIDATES)


def scan_beside(queries: pa.Table, refs: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """CANDIDATES of few ``queries`` (qid, ``keys``, v0..v13), at most k a query and key from each task of ``refs``."""
    packed = np.stack([queries.column(n).to_numpy().astype(np.int64) for n in keys], axis=1)
    distinct, owner = np.unique(packed, axis=0, return_inverse=True)
    v = np.stack([queries.column(c).to_numpy() for c in VECTOR], axis=1).astype(np.float64)
    order = np.argsort(owner.ravel(), kind="stable")
    bounds = np.searchsorted(owner.ravel()[order], np.arange(len(distinct) + 1))
    table = {tuple(d): (queries.column("qid").to_numpy()[order[a:b]], v[order[a:b]]) for d, a, b in zip(distinct.tolist(), bounds[:-1], bounds[1:], strict=True)}
    sent = refs.sparkSession.sparkContext.broadcast(table)
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list[np.ndarray]] = {}  # by key: query, dist, vi, label of the k nearest so far

        def take(parts: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(parts).combine_chunks()
            codes = np.stack([whole.column(i).to_numpy().astype(np.int64) for i in range(n_keys)], axis=1)
            vi, label = whole.column(n_keys).to_numpy(), whole.column(n_keys + 1).to_numpy()
            rows = np.stack([whole.column(n_keys + 2 + i).to_numpy() for i in range(DIMS)], axis=1).astype(np.float64)
            kinds, own = np.unique(codes, axis=0, return_inverse=True)
            for i, code in enumerate(map(tuple, kinds.tolist())):
                if code not in sent.value:
                    continue
                at = np.flatnonzero(own.ravel() == i)
                at = at[np.argsort(vi[at], kind="stable")]
                q, r, dist = _topk(sent.value[code][1], rows[at], k)
                new = [q, np.rint(dist).astype(np.int64), vi[at][r], label[at][r]]
                if code in best:
                    new = [np.concatenate(x) for x in zip(best[code], new, strict=True)]
                    rank = np.lexsort((new[2], new[1], new[0]))
                    new = [x[rank] for x in new]
                    first = np.searchsorted(new[0], new[0], side="left")
                    new = [x[np.arange(len(rank)) - first < k] for x in new]
                best[code] = new

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK_ROWS:
                take(held)
                held = []
        if held:
            take(held)
        for code, (q, dist, vi, label) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[code][0][q]), pa.array(vi), pa.array(dist), pa.array(label.astype(np.int32))], ["qid", "vi", "dist", "label"])

    return refs.select(*keys, "vi", "label", *VECTOR).mapInArrow(run, CANDIDATES)


def _candidates(queries: DataFrame, refs: DataFrame, keys: list[tuple[str, int]], few: int, k: int, stored: list[DataFrame] | None = None) -> DataFrame:
    """CANDIDATES of queries (qid, keys, v0..v13): beside the references if there are at most ``few``, else by blocks.

    Searches of the same references by the same keys share the list ``stored``: the first that needs them puts the ``earliest`` in.
    """
    queries, names = cut(queries), [n for n, _ in keys]
    refs = refs.withColumnRenamed("tag", "etag")
    if queries.count() <= few:
        return scan_beside(queries.select("qid", *names, *VECTOR).toArrow(), stored[0] if stored else refs, names, k)
    stored = [] if stored is None else stored
    if not stored:
        stored.append(cut(earliest(refs, names, k)))
    return block_topk(*_dealt(queries, stored[0], keys), k)


def earliest(refs: DataFrame, names: list[str], k: int = K) -> DataFrame:
    """Of references with the same ``names`` and vector, the k that come first: no other can be among the k nearest."""
    nth = F.row_number().over(Window.partitionBy("__h", *names, *VECTOR).orderBy("vi"))  # by the hash first: it sorts faster
    return refs.select(*names, "vi", "label", *VECTOR, F.xxhash64(*names, *VECTOR).alias("__h")).withColumn("__nth", nth).filter(F.col("__nth") <= k).drop("__nth", "__h")


def distinct_queries(queries: DataFrame) -> DataFrame:
    """qid, etag, v0..v13: of queries with the same effective tag and vector, the one with the least id."""
    return cut(queries.filter("etag is not null").groupBy("etag", *VECTOR).agg(F.min("qid").alias("qid")).select("qid", "etag", *VECTOR))


def for_equals(queries: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (qid and any others) of the ``distinct_queries`` ``asked``, given to every query of the same vector."""
    answers = asked.withColumnRenamed("qid", "__rep").join(found.withColumnRenamed("qid", "__rep"), "__rep").drop("__rep")
    return queries.select("qid", "etag", *VECTOR).join(answers, ["etag", *VECTOR]).drop("etag", *VECTOR)


def merge_topk(candidates: DataFrame, k: int = K) -> DataFrame:
    """qid and ``near``: its k candidates of smallest (dist, vi), as an ascending array of structs."""
    ordered = F.array_sort(F.collect_list(F.struct("dist", "vi", "label")))
    return candidates.groupBy("qid").agg(F.slice(ordered, 1, k).alias("near"))


def _code(*parts: tuple[Column, int]) -> Column:
    """Small numbers packed into one bigint, given with their bits."""
    out = F.lit(0).cast("bigint")
    for c, bits in parts:
        out = F.shiftleft(out, bits).bitwiseOR(c.cast("bigint"))
    return out


def _dealt(queries: DataFrame, refs: DataFrame, keys: list[tuple[str, int]]) -> tuple[DataFrame, DataFrame]:
    """Queries and references of equal keys dealt into blocks, as block_topk takes them.

    A key's references make blocks of BLOCK_ROWS at most, its queries parts that keep all cores busy, of
    LEAST_QUERY_ROWS to QUERY_ROWS rows; every query part meets every block. Sizes are counted first; there
    are at most MAX_CLUSTERS keys a tag.
    """
    names = [n for n, _ in keys]
    tasks = 4 * queries.sparkSession.sparkContext.defaultParallelism
    asked = queries.groupBy(*names).agg(F.count("*").alias("n"))
    part = F.greatest(F.lit(LEAST_QUERY_ROWS), F.least(F.lit(QUERY_ROWS), F.ceil(F.sum("n").over(Window.partitionBy()) / tasks)))
    asked = asked.select(*names, F.ceil(F.col("n") / part).cast("int").alias("nq"))
    held = refs.groupBy(*names).agg(F.ceil(F.count("*") / (BLOCK_ROWS // 2)).cast("int").alias("nb"))  # half full on average
    sizes = held.join(asked, names)
    code = lambda b, q: _code(*[(F.col(n), bits) for n, bits in keys], (b, 24), (q, 16))
    q = queries.join(sizes, names).withColumn("__q", F.pmod(F.hash("qid"), F.col("nq"))).withColumn("__b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    r = refs.join(sizes, names).withColumn("__b", F.pmod(F.hash("vi"), F.col("nb"))).withColumn("__q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    block = code(F.col("__b"), F.col("__q")).alias("block")
    more = [c for c in ("worst",) if c in queries.columns]
    return q.select(block, F.col("qid").alias("id"), *more, *VECTOR), r.select(block, F.col("vi").alias("id"), "label", *VECTOR)


def _cell_rows() -> int:
    return BLOCK_ROWS * 3 // 8


def _go(queries: DataFrame, cells: Cells, turn: str, k: int, near: tuple | None = None) -> DataFrame:
    """CANDIDATES of queries (qid, etag, worst, v0..v13) in the cells of this turn."""
    return block_topk(*_dealt(cut(visits(queries, cells, turn, near)), cells.rows, [("cell", 23)]), k)


def _by_cells(asked: DataFrame, cells: Cells, k: int, near: tuple | None = None) -> DataFrame:
    """CANDIDATES of queries (qid, etag, v0..v13): in the cell with the nearest box, then in those that the k-th of them leaves."""
    home = cut(_go(asked.withColumn("worst", F.lit(FAR)), cells, "home", k, near))
    worst = merge_topk(home, k).select("qid", _kth("near", k).alias("worst"))
    return home.unionByName(_go(asked.join(worst, "qid"), cells, "rest", k, near))


def _kth(near: str, k: int) -> Column:
    """The distance of the k-th neighbour, without bound if there are fewer."""
    return F.when(F.size(near) < k, F.lit(FAR)).otherwise(F.element_at(near, -1)["dist"])


def with_votes(queries: DataFrame, near: DataFrame, *keep: str) -> DataFrame:
    """qid, ``keep``, votes (0 for queries without neighbours) and near."""
    votes = F.coalesce(F.aggregate("near", F.lit(0), lambda s, x: s + x["label"]), F.lit(0))
    return queries.select("qid", *keep).join(near, "qid", "left").select("qid", *keep, votes.alias("votes"), "near")


def search_exact(queries: DataFrame, refs: DataFrame, clusters: DataFrame, k: int = K) -> DataFrame:
    """qid, etag, votes, near: the exact k nearest references of each query's effective tag.

    ``queries``: qid, tag, v0..v13. A query whose tag leads to no partition has no neighbours and no votes.
    """
    q = with_effective_tag(queries, clusters)
    asked = distinct_queries(q)
    stored, cells = [], None
    if asked.count() > FEW_QUERIES:
        stored = [cut(earliest(refs.withColumnRenamed("tag", "etag"), ["etag"], k))]
        cells = divide(stored[0], ["etag"], _cell_rows())
    found = _by_cells(asked, cells, k) if cells else _candidates(asked, refs, [("etag", 4)], FEW_QUERIES, k, stored)
    return with_votes(q, for_equals(q, asked, merge_topk(found, k)), "etag")


# ---- probing -----------------------------------------------------------------------------------------------------


def _boxes(clusters: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By tag the clusters' numbers, in order, and their least and greatest values."""
    rows = clusters.select("tag", "cid", *MINS, *MAXS).toArrow()  # at most MAX_CLUSTERS x 16 boxes
    table = {}
    tags, cids = rows.column("tag").to_numpy(), rows.column("cid").to_numpy()
    low = np.stack([rows.column(m).to_numpy() for m in MINS], axis=1).astype(np.int64)
    high = np.stack([rows.column(m).to_numpy() for m in MAXS], axis=1).astype(np.int64)
    for t in np.unique(tags).tolist():
        at = np.flatnonzero(tags == t)
        at = at[np.argsort(cids[at])]
        table[t] = cids[at].astype(np.int32), low[at], high[at]
    return table


def _probe(queries: DataFrame, clusters: DataFrame, first: int, bound: bool) -> DataFrame:
    """(qid, etag, cid, v0..v13) to scan: the ``first`` nearest boxes, or with ``bound`` the others within ``worst``."""
    table = _boxes(clusters)
    sent = queries.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            etag, worst = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            v = np.stack([batch.column(3 + i).to_numpy() for i in range(DIMS)], axis=1).astype(np.int64)
            for t in np.unique(etag).tolist():
                cid, lo, hi = sent.value[t]
                mine = np.flatnonzero(etag == t)
                for at in np.array_split(mine, max(1, len(mine) * len(cid) // (1 << 18))):
                    gap = np.zeros((len(at), len(cid)), dtype=np.int64)
                    for i in range(DIMS):
                        q = v[at, i][:, None]
                        g = np.maximum(np.maximum(lo[:, i][None, :] - q, q - hi[:, i][None, :]), 0)
                        gap += g * g
                    order = np.argsort(gap, axis=1, kind="stable")
                    rank = np.empty_like(order)
                    np.put_along_axis(rank, order, np.arange(len(cid))[None, :], axis=1)
                    take = (rank >= first) & (gap <= worst[at][:, None]) if bound else rank < first
                    r, c = np.nonzero(take)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[r])), pa.array(np.full(len(r), t, dtype=np.int32)), pa.array(cid[c]), *(pa.array(v[at[r], i].astype(np.int16)) for i in range(DIMS))], ["qid", "etag", "cid", *VECTOR])

    worst = F.col("worst") if bound else F.lit(0).cast("bigint")
    schema = "qid bigint, etag int, cid int, " + ", ".join(f"{c} smallint" for c in VECTOR)
    return queries.select("qid", "etag", worst.alias("worst"), *VECTOR).mapInArrow(run, schema)


def _scan(probes: DataFrame, refs: DataFrame, k: int, stored: list[DataFrame] | None = None) -> DataFrame:
    return _candidates(probes, refs, [("etag", 4), ("cid", 12)], FEW_PROBES, k, stored)


def _first_pass(asked: DataFrame, refs: DataFrame, clusters: DataFrame, probes: int, k: int, stored: list[DataFrame]) -> tuple[DataFrame, Cells | None, tuple | None]:
    """CANDIDATES from the ``probes`` nearest clusters; and, where a tag has more references than a block, the cells and what ``visits`` needs of the clusters."""
    largest = max((r.n for r in clusters.groupBy("tag").agg(F.sum("n").alias("n")).collect()), default=0)  # at most 16 rows
    if largest > _cell_rows() and asked.count() * probes > FEW_PROBES:
        stored.append(cut(earliest(refs.withColumnRenamed("tag", "etag"), ["etag", "cid"], k)))
        cells = divide(stored[0], ["etag", "cid"], _cell_rows())
        if cells:
            near = _boxes(clusters), probes
            return _by_cells(asked, cells, k, near), cells, near
    return _scan(_probe(asked, clusters, probes, bound=False), refs, k, stored), None, None


def probe_votes(queries: DataFrame, refs: DataFrame, clusters: DataFrame, probes: int = PROBES, k: int = K) -> DataFrame:
    """qid, etag, votes, near from the ``probes`` nearest clusters alone."""
    clusters = cut(clusters)  # few rows, made from all references
    q = with_effective_tag(queries, clusters)
    asked = distinct_queries(q)
    found = merge_topk(_first_pass(asked, refs, clusters, probes, k, [])[0], k)
    return with_votes(q, for_equals(q, asked, found), "etag")


def search_ivf(queries: DataFrame, refs: DataFrame, clusters: DataFrame, probes: int = PROBES, k: int = K) -> DataFrame:
    """qid, etag, votes, near, repaired: probing, then completion where the votes are mixed.

    A unanimous answer of the first pass is accepted as it is. Otherwise every cluster not yet scanned whose
    box is no farther than the k-th neighbour found (or every one, if fewer were found) is scanned too.
    """
    clusters, stored = cut(clusters), []  # the clusters are few rows, made from all references
    q = with_effective_tag(queries, clusters)
    asked = distinct_queries(q)
    candidates, cells, near = _first_pass(asked, refs, clusters, probes, k, stored)
    first = cut(with_votes(asked, merge_topk(candidates, k), "etag", *VECTOR))
    mixed = first.filter(F.col("votes").between(*MIXED)).withColumn("worst", _kth("near", k))
    more = _go(mixed, cells, "outside", k, near) if cells else _scan(_probe(mixed, clusters, probes, bound=True), refs, k, stored)
    known = mixed.select("qid", F.explode("near").alias("n")).select("qid", "n.vi", "n.dist", "n.label")
    completed = with_votes(mixed, merge_topk(known.unionByName(more), k), "etag").withColumn("repaired", F.lit(True))
    settled = first.filter(~F.col("votes").between(*MIXED)).select("qid", "etag", "votes", "near", F.lit(False).alias("repaired"))
    found = for_equals(q, asked, settled.unionByName(completed).drop("etag"))
    return q.select("qid", "etag").join(found, "qid", "left").select("qid", "etag", F.coalesce("votes", F.lit(0)).alias("votes"), "near", F.coalesce("repaired", F.lit(False)).alias("repaired"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, the share of exact neighbours found, and of equal votes."""
    ids = lambda c: F.transform(c, lambda x: x["vi"])
    both = found.select("qid", F.col("near").alias("a"), F.col("votes").alias("va")).join(exact.select("qid", F.col("near").alias("b"), F.col("votes").alias("vb")), "qid")
    hit = F.size(F.array_intersect(ids("a"), ids("b")))
    return both.agg(F.count("*").alias("queries"), (F.sum(hit) / F.sum(F.size("b"))).alias("recall"), F.avg((F.col("va") == F.col("vb")).cast("double")).alias("same_votes"))


# ---- float vectors -----------------------------------------------------------------------------------------------


def embedding_neighbours(queries: DataFrame, refs: DataFrame, k: int = K, block_rows: int = 1 << 14) -> DataFrame:
    """(qid, rid, label) of the k nearest references by Euclidean distance of float arrays, ties to the smaller id.

    ``queries``: id, embedding; ``refs``: id, embedding, label. A reference with the query's own id is not its
    neighbour. Distances are rounded to 1e-6, so that ties do not hang on the order of additions. Only arrays of
    one length are compared; a null array, an empty one or one with a null or NaN in it, or a row without an id, neither
    asks nor is found.
    References go through the tasks in blocks of at most about ``block_rows``, each with the queries streamed past it.
    """
    blocks = max(1, -(-refs.count() * 2 // block_rows))
    whole = F.col("id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    vector = [F.size("embedding").alias("width"), F.col("embedding").cast("array<double>").alias("embedding")]
    r = refs.filter(whole).select(F.pmod(F.hash("id"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), F.col("id").cast("bigint").alias("id"), F.col("label").cast("int").alias("label"), *vector)
    q = queries.filter(whole).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.col("id").cast("bigint").alias("id"), F.lit(None).cast("int").alias("label"), *vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, ready = None, [], None
        for batch in batches:
            block, kind, ids, width = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            edges = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(width) != 0) | (np.diff(kind) != 0)]) if len(block) else []
            for a, b in zip(edges, [*edges[1:], len(block)], strict=True):
                if (block[a], width[a]) != current:
                    current, held, ready = (block[a], width[a]), [], None
                rows = batch.column(5).slice(a, b - a).flatten().to_numpy().reshape(b - a, width[a])
                if kind[a] == 0:
                    held.append((ids[a:b], batch.column(3).slice(a, b - a), rows))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = np.concatenate([h[0] for h in held]), pa.chunked_array([h[1] for h in held]).combine_chunks(), np.concatenate([h[2] for h in held])
                rid, label, base = ready
                out = []  # by query: its row, reference rows and distances
                for i in range(b - a):
                    d = np.round(np.sqrt(((base - rows[i]) ** 2).sum(axis=1)), 6)
                    d[(rid == ids[a + i]) | np.isnan(d)] = np.inf
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                    near = near[np.lexsort((rid[near], d[near]))][:k]
                    near = near[np.isfinite(d[near])]
                    out.append((np.full(len(near), a + i), near, d[near]))
                at, near, dist = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(dist), pa.array(rid[near]), label.take(pa.array(near))], ["qid", "dist", "rid", "label"])

    found = r.unionByName(q).repartition(_tasks(refs), "block").sortWithinPartitions("block", "width", "kind", "id").mapInArrow(run, "qid bigint, dist double, rid bigint, label int")
    best = F.slice(F.array_sort(F.collect_list(F.struct("dist", "rid", "label"))), 1, k)
    return found.groupBy("qid").agg(best.alias("near")).select("qid", F.explode("near").alias("n")).select("qid", "n.rid", "n.label")
