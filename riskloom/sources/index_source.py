"""Binary index files as a data source of Spark: read and written in pieces, no file held whole when it is read.

A folder holds files of the layout in ``index_binary``, named ``tag=TT/cCCCCCC-vVVVVVVVVVVVV.idx`` by the tag, the first
cluster and the first place in the tag's storage order. A tag may be one file or many: a file written here has at most
``rows_per_file`` vectors, and a cluster that doesn't fit goes on in the next file. So a tag of any size is many tasks, both
ways. Sections that the schema doesn't ask for are not read, and filters on tag and cid choose files and ranges of clusters.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from riskloom.operators.features import DIMS, VECTOR
from riskloom.operators.index_build import MAX_CLUSTERS, MAXS, MINS
from riskloom.sources.index_binary import MAGIC, encode

FORMAT = "riskloom_index"
ROWS_PER_FILE, ROWS_PER_TASK, STEP = 1_000_000, 1_000_000, 65_536

_SHORT = lambda cols: ", ".join(f"{c} smallint" for c in cols)
REFS = f"tag int, cid int, vi bigint, {_SHORT(VECTOR)}, label int"
CLUSTERS = f"tag int, cid int, n bigint, first bigint, {_SHORT(MINS + MAXS)}"
_NAME = re.compile(r"tag=(\d+)/c(\d+)-v(\d+)\.idx$")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path there of a URI, or of a plain path."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


class _Sections:
    """Where the sections of an open file begin; offsets are read at once (16 KB at most), the others by range."""

    def __init__(self, file: pa.NativeFile, path: str) -> None:
        self.file, self.path = file, path
        head = file.read_at(16, 0)
        if len(head) < 16 or head[:8] != MAGIC:
            raise ValueError(f"{path} is no index file")
        self.k, self.n = (int(x) for x in np.frombuffer(head, "<u4", 2, 8))
        if not 1 <= self.k <= MAX_CLUSTERS:
            raise ValueError(f"{path} has {self.k} clusters, not 1 to {MAX_CLUSTERS}")
        up = lambda n: -(-n // 64) * 64
        self.low = up(64 + 4 * (self.k + 1))
        self.high = up(self.low + 32 * self.k)
        self.vectors = up(self.high + 32 * self.k)
        self.labels = up(self.vectors + 32 * (self.n + 1))
        if self.labels + self.n > file.size():
            raise ValueError(f"{path} is cut short")
        self.first = self.numbers(64, "<u4", 0, self.k + 1).astype(np.int64)
        if self.first[0] != 0 or self.first[-1] != self.n or (np.diff(self.first) < 0).any():
            raise ValueError(f"{path} has offsets that don't fit its {self.n} vectors")

    def numbers(self, at: int, kind: str, begin: int, end: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at((end - begin) * size, at + begin * size), kind)


@dataclass
class _Range(InputPartition):
    """Vectors ``begin`` to ``end`` (for clusters: entries) of a file whose first cluster and place are ``cid`` and ``vi``."""

    path: str
    tag: int
    cid: int
    vi: int
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.part = options["path"], options.get("part", "refs")
        self.rows = int(options.get("rowspertask", ROWS_PER_TASK))
        self.names = schema.names
        self.types = [f.dataType.simpleString() for f in schema.fields]
        self.bounds = {"tag": [0, 2**31], "cid": [0, 2**31]}  # inclusive
        self.tags: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Narrow what is read; every filter is also left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.bounds:
                low, high = self.bounds[name]
                match f:
                    case EqualTo():
                        self.bounds[name] = [max(low, f.value), min(high, f.value)]
                    case GreaterThan() | GreaterThanOrEqual():
                        self.bounds[name][0] = max(low, f.value)
                    case LessThan() | LessThanOrEqual():
                        self.bounds[name][1] = min(high, f.value)
                    case In() if name == "tag":
                        self.tags = set(f.value) if self.tags is None else self.tags & set(f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.path)
        out: list[InputPartition] = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            found = _NAME.search(info.path)
            if not found:
                continue
            tag, cid, vi = map(int, found.groups())
            if not self.bounds["tag"][0] <= tag <= self.bounds["tag"][1] or (self.tags is not None and tag not in self.tags):
                continue
            with fs.open_input_file(info.path) as file:
                s = _Sections(file, info.path)
            lo, hi = max(0, self.bounds["cid"][0] - cid), min(s.k, self.bounds["cid"][1] + 1 - cid)  # of this file's clusters
            if lo >= hi:
                continue
            if self.part == "clusters":
                out.append(_Range(info.path, tag, cid, vi, lo, hi))
                continue
            begin = int(s.first[lo])
            while begin < s.first[hi]:
                # whole clusters while they fit; one that alone is too large goes in ranges of its own
                whole = int(s.first[np.searchsorted(s.first[: hi + 1], begin + self.rows, "right") - 1])
                end = whole if whole > begin else min(int(s.first[hi]), begin + self.rows)
                out.append(_Range(info.path, tag, cid, vi, begin, end))
                begin = end
        return out or [_Range("", 0, 0, 0, 0, 0)]

    def _batch(self, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16()}
        return pa.RecordBatch.from_arrays([pa.array(columns[n].astype(kinds[t].to_pandas_dtype())) for n, t in zip(self.names, self.types, strict=True)], self.names)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.begin == p.end:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(p.path) as file:
            s = _Sections(file, p.path)
            if self.part == "clusters":
                low, high = (s.numbers(at, "<i2", p.begin * 16, p.end * 16).reshape(-1, 16) for at in (s.low, s.high))
                cols = {"tag": np.full(len(low), p.tag), "cid": np.arange(p.begin, p.end) + p.cid, "n": np.diff(s.first)[p.begin : p.end], "first": s.first[p.begin : p.end] + p.vi}
                yield self._batch(cols | {c: low[:, i] for i, c in enumerate(MINS)} | {c: high[:, i] for i, c in enumerate(MAXS)})
                return
            for a in range(p.begin, p.end, STEP):
                b = min(a + STEP, p.end)
                cols = {"tag": np.full(b - a, p.tag), "cid": np.searchsorted(s.first, np.arange(a, b), "right") - 1 + p.cid, "vi": np.arange(a, b) + p.vi}
                if set(VECTOR) & set(self.names):
                    v = s.numbers(s.vectors, "<i2", a * 16, b * 16).reshape(-1, 16)
                    cols |= {c: v[:, i] for i, c in enumerate(VECTOR)}
                if "label" in self.names:
                    cols["label"] = s.numbers(s.labels, "u1", a, b)
                yield self._batch(cols)


class _Writer(DataSourceArrowWriter):
    """A task's rows come sorted by tag and place; each run of one file is encoded and put in place whole, so a task run twice writes the same files."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rows = options["path"], int(options.get("rowsperfile", ROWS_PER_FILE))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in iterator:
            tag, vi = batch.column("tag").to_numpy(), batch.column("vi").to_numpy()
            file = vi // self.rows
            edges = np.flatnonzero((np.diff(tag) != 0) | (np.diff(file) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(tag)], strict=True):
                if a == b:
                    continue
                if now is not None and now != (tag[a], file[a]):
                    self._put(held)
                    held = []
                now = (tag[a], file[a])
                held.append(batch.slice(int(a), int(b - a)))
        self._put(held)
        return WriterCommitMessage()

    def _put(self, held: list[pa.RecordBatch]) -> None:
        if not held:
            return
        t = pa.Table.from_batches(held)
        cid, vi, label = (t.column(c).to_numpy() for c in ("cid", "vi", "label"))
        if len(np.unique(np.diff(vi))) > 1 or (np.diff(vi) != 1).any() or (np.diff(cid) < 0).any():
            raise ValueError("the rows of a file must have places without gaps, in order of their clusters")
        v = np.zeros((len(vi), 16), np.int16)
        for i, c in enumerate(VECTOR):
            v[:, i] = t.column(c).to_numpy()
        base, k = int(cid[0]), int(cid[-1]) - int(cid[0]) + 1
        first = np.searchsorted(cid, np.arange(base, base + k + 1), "left")
        low, high = np.zeros((k, 16), np.int16), np.zeros((k, 16), np.int16)
        full = np.flatnonzero(np.diff(first))  # an empty cluster keeps a box of zeros
        low[full], high[full] = np.minimum.reduceat(v, first[full]), np.maximum.reduceat(v, first[full])
        fs, root = _open(self.path)
        folder = f"{root}/tag={int(t.column('tag')[0].as_py()):02d}"
        fs.create_dir(folder, recursive=True)
        draft = f"{folder}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(encode(first, low, high, v, label))
        fs.move(draft, f"{folder}/c{base:06d}-v{int(vi[0]):012d}.idx")


class IndexFiles(DataSource):
    """``spark.read.format("riskloom_index")``; options path, part (refs or clusters), rowsPerTask, rowsPerFile."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CLUSTERS if self.options.get("part") == "clusters" else REFS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_index_files(refs: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store refs (tag, cid, vi, v0..v13, label) of storage order as binary files in a new folder; a task holds one file's rows at a time."""
    _register(refs.sparkSession)
    file = F.floor(F.col("vi") / rows_per_file)
    rows = refs.select("tag", "cid", F.col("vi").cast("bigint").alias("vi"), *VECTOR, "label").repartition("tag", file).sortWithinPartitions("tag", "vi")
    rows.write.format(FORMAT).option("path", path).option("rowsPerFile", rows_per_file).mode("append").save()


def read_index_files(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(refs, clusters) of a folder of binary files; with ``columns`` only those of refs, and only their sections, are read.

    A cluster that goes over several files is one row again: its sizes added, its boxes joined. A folder without index files
    gives no rows; a file that is none, or cut short, is an error.
    """
    _register(spark)
    source = spark.read.format(FORMAT).option("path", path)
    refs = source.option("rowsPerTask", rows_per_task)
    if columns is not None:
        kinds = dict(x.strip().split(" ") for x in REFS.split(","))
        refs = refs.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    parts = spark.read.format(FORMAT).option("path", path).option("part", "clusters").load().filter("n > 0")
    boxes = [F.min(c).alias(c) for c in MINS] + [F.max(c).alias(c) for c in MAXS]
    return refs.load(), parts.groupBy("tag", "cid").agg(F.sum("n").alias("n"), F.min("first").alias("first"), *boxes)
