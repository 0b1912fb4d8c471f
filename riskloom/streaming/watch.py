"""Watching a live stream: counts and percentiles by event-time window, and users' sessions.

Both are Spark's own windows under a watermark, so state holds the open windows only: five counts and one sketch a window,
one row a user and open session. Counts are merged before the shuffle; a hot window or user is one partial row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalar import micros
from riskloom.operators.evaluate import outcome_counts

#: Accuracy of the percentile sketch (KLL, mergeable). Up to about this many values of a window it is exact.
SKETCH_K = 2048


def rank_error(k: int = SKETCH_K) -> float:
    """How far, as a share of a window's values, the rank of a reported percentile may be off (99 % of reports): the figure published for KLL sketches."""
    return 2.296 / k**0.9723


def _timed(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark needs instants; a time without zone is taken as UTC."""
    if rows.schema[ts].dataType.simpleString() == "timestamp_ntz":
        rows = rows.withColumn(ts, F.timestamp_micros(micros(F.col(ts))))
    return rows.filter(F.col(ts).isNotNull()).withWatermark(ts, delay)


def window_report(decisions: DataFrame, ts: str = "ts", latency: str = "ms", width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", k: int = SKETCH_K) -> DataFrame:
    """window_start, window_end, n, tp, tn, fp, fn, errors, max_ms, p50_ms, p99_ms of decisions (approved, expected_approved, status).

    Windows are tumbling, or sliding with ``slide``. A window leaves once, when the watermark has passed its end; a decision
    later than that is dropped. Decisions without a time are left out, null latencies count but have no percentile; a window of
    nulls has null percentiles. Works on tables too, where every window is whole.
    """
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    value = F.col(latency).cast("double")
    rows = _timed(decisions, ts, delay).groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.count(value).alias("timed"), *outcome_counts(), F.max(value).alias("max_ms"), F.kll_sketch_agg_double(value, k).alias("sketch"))
    at = lambda p: F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "tp", "tn", "fp", "fn", "errors", "max_ms", at(0.5).alias("p50_ms"), at(0.99).alias("p99_ms"))


def sessions(rows: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes", *more: Column) -> DataFrame:
    """user, session_start, session_end, n and ``more`` aggregates: runs of a user's rows with less than ``gap`` between them.

    session_end is the last row's time and the gap. Rows of a null user make sessions of their own; rows without a time are left out.
    """
    window = F.session_window(ts, gap)
    out = _timed(rows, ts, delay).groupBy(F.col(user), window.alias("w")).agg(F.count("*").alias("n"), *more)
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c not in (user, "w")])
