"""Reading the binary cluster index: one file a tag.

Layout (little endian, sections begin at multiples of 64): magic, u32 clusters, u32 vectors; at 64 the
offsets u32[clusters + 1]; boxes i16[clusters * 16], minimum then maximum; vectors i16[(vectors + 1) * 16];
labels u8[vectors]. Dimensions 14 and 15 are padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.features import DIMS, VECTOR
from riskloom.operators.index_build import MAX_CLUSTERS, MAXS, MINS

#: First bytes of an index file. Fixed value of the format.
MAGIC = b"RNH5-IDX"


def _aligned(n: int) -> int:
    return -(-n // 64) * 64


def decode(raw: bytes, path: str) -> dict[str, np.ndarray]:
    """The sections of one file; ValueError if it is none."""
    if len(raw) < 64 or raw[:8] != MAGIC:
        raise ValueError(f"{path} is no index file")
    k, n = (int(x) for x in np.frombuffer(raw, "<u4", 2, 8))
    if not 1 <= k <= MAX_CLUSTERS:
        raise ValueError(f"{path} has {k} clusters, not 1 to {MAX_CLUSTERS}")
    at, out = 64, {}
    for name, kind, count in (("first", "<u4", k + 1), ("low", "<i2", k * 16), ("high", "<i2", k * 16), ("vectors", "<i2", (n + 1) * 16), ("labels", "u1", n)):
        size = np.dtype(kind).itemsize * count
        if at + size > len(raw):
            raise ValueError(f"{path} ends in {name}")
        out[name] = np.frombuffer(raw, kind, count, at)
        at = _aligned(at + size)
    return out


def encode(first: np.ndarray, low: np.ndarray, high: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> bytes:
    """The file of given sections (vectors without the padding row)."""
    k, n = len(first) - 1, len(labels)
    head = MAGIC + np.array([k, n], "<u4").tobytes()
    out = bytearray(head.ljust(64, b"\0"))
    for part in (first.astype("<u4"), low.astype("<i2"), high.astype("<i2"), np.vstack([vectors, np.zeros((1, 16))]).astype("<i2"), labels.astype("u1")):
        out.extend(part.tobytes())
        out.extend(b"\0" * (_aligned(len(out)) - len(out)))
    return bytes(out)


def read_binary_index(spark: SparkSession, tag_paths: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """(refs, clusters) of the files by tag; each file is decoded where it is read."""
    names = F.lit(None).cast("int")
    for tag, path in tag_paths.items():
        names = F.when(F.col("path").endswith(path), tag).otherwise(names)
    files = spark.read.format("binaryFile").load(list(tag_paths.values())).select(names.alias("tag"), "path", "content")

    def refs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for tag, path, raw in zip(part.tag, part.path, part.content, strict=True):
                x = decode(raw, path)
                n = len(x["labels"])
                v = x["vectors"].reshape(-1, 16)[:n, :DIMS]
                cid = np.repeat(np.arange(len(x["first"]) - 1), np.diff(x["first"].astype(np.int64)))
                yield pd.DataFrame({"tag": tag, "cid": cid, "vi": np.arange(n), **{c: v[:, i] for i, c in enumerate(VECTOR)}, "label": x["labels"].astype(np.int32)})

    def clusters(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for tag, path, raw in zip(part.tag, part.path, part.content, strict=True):
                x = decode(raw, path)
                first = x["first"].astype(np.int64)
                low, high = x["low"].reshape(-1, 16), x["high"].reshape(-1, 16)
                yield pd.DataFrame({"tag": tag, "cid": np.arange(len(first) - 1), "n": np.diff(first), "first": first[:-1], **{c: low[:, i] for i, c in enumerate(MINS)}, **{c: high[:, i] for i, c in enumerate(MAXS)}})

    short = lambda cols: ", ".join(f"{c} smallint" for c in cols)
    return files.mapInPandas(refs, f"tag int, cid int, vi bigint, {short(VECTOR)}, label int"), files.mapInPandas(clusters, f"tag int, cid int, n bigint, first bigint, {short(MINS + MAXS)}")
