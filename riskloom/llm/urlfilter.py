"""URL verdicts: rules by host and path, and a list of URLs of any length behind a blocked Bloom filter.

A rule speaks for its host, all hosts below it, and paths that begin with its own; the longest fitting rule
wins. Where none fits, a URL is blocked if its canonical form is on the list. Most URLs are not, and the
list may be too large to send around, so a filter goes first: the 64-bit hash of a listed URL chooses one block of
512 bits and sets ``PROBES`` bits in it. A URL that lacks one of its bits is surely not listed. The rest, all
listed URLs and a few others, are joined with the list itself by their text, so the verdicts are exact.

The filter is ``bits`` a listed URL, but never over ``MOST_BYTES``, which bounds what is broadcast: with a longer
list more URLs pass it and the join has more to do, but nothing changes in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, fresh

BLOCK_BITS = 512
LANES = BLOCK_BITS // 64
PROBES = 6
BITS = 16
MOST_BYTES = 32 << 20
MOST_RULES = 500

#: Query parameters that do not change the page. Fixed values.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
_SEED = 20260111


def host(url: Column) -> Column:
    """What follows the first ``://`` up to / ? # or the end, A-Z lower-cased; '' without ``://`` or for null."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; '' without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column, tracking: str = TRACKING) -> Column:
    """One form for the spellings of a URL; null without ``://`` or for null.

    The host, the path without a last slash or ``.html``, and the query without ``tracking`` parameters, the others sorted.
    Scheme and fragment go.
    """
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{tracking})(?:=|$)")))
    short = F.regexp_replace(path(url), r"(?:/|\.html)\z", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), short, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def longest_rule(rules: list[tuple[str, str, str]], host_: Column, path_: Column) -> Column:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits, null if none; equally long ones: the longer host."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules: put single URLs on the list")
    fits = lambda h, p: ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ranked], out)


def _hash(key: Column) -> Column:
    return F.xxhash64(key, F.lit(_SEED))


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and the bits in it, (n,) and (n, PROBES), of 64-bit hashes."""
    u = h.view(np.uint64)
    block = ((u >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    step = (u & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    x = (u * np.uint64(0x9E3779B97F4A7C15))[:, None] + step[:, None] * np.arange(1, PROBES + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    return block.astype(np.int64), (x >> np.uint64(55)).astype(np.int64)


def build_filter(listed: DataFrame, url: str = "url", bits: int = BITS, most_bytes: int = MOST_BYTES) -> np.ndarray:
    """The blocked Bloom filter of the distinct non-null values of ``url``: an array (blocks, LANES) of 64-bit lanes.

    Blocks are made where the list lies and joined by bitwise or; only filled blocks reach the driver, at most ``most_bytes``.
    """
    n = listed.agg(F.approx_count_distinct(url)).first()[0]
    blocks = int(max(1, min(most_bytes * 8 // BLOCK_BITS, -(-n * bits // BLOCK_BITS))))

    def lanes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            block, at = _bits(frame["h"].to_numpy(), blocks)
            cell = np.unique((block[:, None] * BLOCK_BITS + at).ravel())
            lane, head = np.unique(cell >> 6, return_index=True)
            word = np.bitwise_or.reduceat(np.uint64(1) << (cell & 63).astype(np.uint64), head) if len(lane) else np.zeros(0, np.uint64)
            yield pd.DataFrame({"lane": lane, "word": word.view(np.int64)})

    hashes = listed.filter(F.col(url).isNotNull()).select(_hash(F.col(url)).alias("h"))
    filled = hashes.mapInPandas(lanes, "lane bigint, word bigint").groupBy("lane").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(blocks * LANES, dtype=np.uint64)
    out[filled.column("lane").to_numpy()] = filled.column("word").to_numpy().view(np.uint64)
    return out.reshape(blocks, LANES)


def may_hold(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter has all bits of each hash."""
    block, at = _bits(h, len(bloom))
    words = bloom[block[:, None], at >> 6]
    return ((words >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def on_list(rows: DataFrame, key: str, listed: DataFrame, url: str = "url", bits: int = BITS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` with a boolean ``listed``: whether ``key`` is among the values of ``url``; null keys never are.

    Every row comes back once, however often its key is listed. Only what passes the filter is shuffled, and a hot key can
    be split there, since the list has it once.
    """
    maybe, same = fresh(rows.columns, "maybe", "same")
    exact = cut(listed.filter(F.col(url).isNotNull()).select(F.col(url).alias(same)).distinct())
    bloom = rows.sparkSession.sparkContext.broadcast(build_filter(exact, same, bits, most_bytes))

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bloom.value, h.to_numpy()))

    marked = rows.drop("listed").withColumn(maybe, F.col(key).isNotNull() & passes(_hash(F.col(key))))
    beyond = marked.filter(~F.col(maybe)).withColumn("listed", F.lit(False))
    hits = marked.filter(maybe).join(exact, F.col(key) == F.col(same), "left").withColumn("listed", F.col(same).isNotNull())
    return beyond.drop(maybe).unionByName(hits.drop(maybe, same))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url", bits: int = BITS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All rows and columns of ``pages`` with host, path, rule, verdict, listed (the canonical URL is on the list).

    ``rules``: (verdict, host, path); ``listed``: a column ``url`` of canonical URLs. The verdict is the longest fitting
    rule's; without one, block for a listed URL, else allow. A null URL, or one without ``://``, has an empty host and path
    and is allowed. Columns with the names of the results are replaced; an empty table or list is no error.
    """
    names = ["host", "path", "rule", "verdict", "listed"]
    kept = [c for c in pages.columns if c not in names]
    whole, fit = fresh(pages.columns, "canonical", "fit")
    u = F.col(url)
    rows = pages.select(*kept, host(u).alias("host"), path(u).alias("path"), canonical(u).alias(whole))
    rows = rows.withColumn(fit, longest_rule(rules, F.col("host"), F.col("path")))
    found = on_list(rows, whole, listed, "url", bits, most_bytes)
    verdict = F.coalesce(F.col(fit)["verdict"], F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select(*kept, "host", "path", F.col(fit)["rule"].alias("rule"), verdict.alias("verdict"), "listed")
