"""A user's history on a stream: what ``with_history`` gives of a table, kept up as rows arrive late and out of order.

Rows wait in the state until the watermark has passed their slice of time, since only then is it known what came before
them; they leave in order of (ts, ident) with the history that a batch over all rows would give. Of each user the state
holds the rows that wait, the times of the last day (dropped by a timer once no row can count them) and the last five rows,
which have no age. State lies in RocksDB.

A call to the state costs far more than a row. So users are dealt by hash into buckets, a bucket is one key, and whatever of it is
due is worked out together: calls grow with buckets and batches, not with rows, users or slices. What is due is taken
in runs of slices, so a task's memory grows with what a bucket does within a slice, not with its day.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from riskloom.operators.history import DAY, LAST

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ADDED = ("last_ts", "known_merchants", "day_count")
_LAST_US, _AT, _KEY, _BUCKET, _CODE = "last_us__", "event_time__", "user__", "bucket__", "code__"  # Spark hands rows on as named tuples, where a name must not begin with an underscore
BUCKETS = 512
CHUNK_ROWS = 1 << 12  # of waiting rows in one piece of state, unless a slice has more
RUN_ROWS = 1 << 16  # worked out at once, unless a slice has more


def _pack(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


def _before(code: np.ndarray, us: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the rows (code, us), in that order, come before each (of, at). Times are ranked, so that one number holds both."""
    times = np.unique(us)
    width = len(times) + 1
    return np.searchsorted(code * width + np.searchsorted(times, us), of * width + np.searchsorted(times, at))


class _History(StatefulProcessor):
    """State by bucket: ``waiting`` rows in chunks, ``past`` users and times in pieces, and a ``book``, read and written once a call: the chunks with their first and last slices, the pieces with their last times, the last five rows of each user."""

    def __init__(self, ident: str, us: str, merchant: str, slice_us: int) -> None:
        self.ident, self.us, self.merchant, self.slice_us = ident, us, merchant, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "chunk bigint", "rows binary")
        self.past = handle.getMapState("past", "piece bigint", "rows binary")
        self.book = handle.getValueState("book", "next bigint, chunks array<bigint>, first array<bigint>, last array<bigint>, pieces array<bigint>, newest array<bigint>, tails binary")

    def _read(self) -> None:
        found = self.book.get()
        self.next, chunks, first, last, pieces, newest, tails = found or (0, [], [], [], [], [], None)
        self.chunks = dict(zip(chunks, zip(first, last, strict=True), strict=True))  # number: first and last slice
        self.pieces = dict(zip(pieces, newest, strict=True))  # number: last time
        self.tails = pd.DataFrame({_KEY: [], self.us: np.empty(0, np.int64), self.merchant: []}) if tails is None else _unpack(tails)

    def _write(self) -> None:
        spans = list(self.chunks.values())
        self.book.update((self.next, list(self.chunks), [a for a, _ in spans], [b for _, b in spans], list(self.pieces), list(self.pieces.values()), _pack(self.tails)))

    def _wait(self, rows: pd.DataFrame) -> None:
        """Store rows until their slices are over, in order of time and cut between slices."""
        rows = rows.sort_values(self.us, kind="stable", ignore_index=True)
        at = rows[self.us].to_numpy(np.int64) // self.slice_us
        a = 0
        while a < len(at):
            b = np.searchsorted(at, at[min(a + CHUNK_ROWS, len(at)) - 1], "right")
            self.waiting.updateValue((self.next,), (_pack(rows.iloc[a:b]),))
            self.chunks[self.next] = int(at[a]), int(at[b - 1])
            self.handle.registerTimer(self._end(int(at[a])))
            self.next, a = self.next + 1, b

    def _end(self, at: int) -> int:
        """The time in milliseconds when slice ``at`` is over."""
        return (at + 1) * self.slice_us // 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._read()
        held: list[pd.DataFrame] = []
        for part in rows:
            held.append(part.drop(columns=[_AT, _BUCKET], errors="ignore"))
            if sum(map(len, held)) >= RUN_ROWS:
                self._wait(pd.concat(held, ignore_index=True))
                held = []
        if held:
            self._wait(pd.concat(held, ignore_index=True))
        self._write()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._read()
        over = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000 // self.slice_us - 1  # the last slice that is
        due = sorted((first, last, c) for c, (first, last) in self.chunks.items() if first <= over)
        gone = [p for p, newest in self.pieces.items() if newest + DAY < (over + 1) * self.slice_us]  # no row to come can count them
        if not due and not gone:
            return  # an earlier timer of this batch did it all
        held: list[pd.DataFrame] = []
        for i, (_, _, c) in enumerate(due):
            held.append(_unpack(self.waiting.getValue((c,))[0]))
            self.waiting.removeKey((c,))
            del self.chunks[c]
            whole = min(over, due[i + 1][0] - 1) if i + 1 < len(due) else over  # up to this slice all rows are here
            if sum(map(len, held)) < RUN_ROWS and i + 1 < len(due):
                continue
            rows = pd.concat(held, ignore_index=True)
            now = rows[self.us].to_numpy(np.int64) // self.slice_us <= whole
            held = [rows[~now]]
            if now.any():
                yield self._settle(rows[now], whole)
        if held and len(held[0]):
            self._wait(held[0])
        for p in [p for p, newest in self.pieces.items() if newest + DAY < (over + 1) * self.slice_us]:
            self.past.removeKey((p,))
            del self.pieces[p]
        self._write()

    def _settle(self, rows: pd.DataFrame, whole: int) -> pd.DataFrame:
        """Rows of slices that are over, up to ``whole``, with their history, which they then become part of."""
        who = pd.Index(rows[_KEY].unique())
        rows = rows.assign(**{_CODE: who.get_indexer(rows[_KEY])}).sort_values([_CODE, self.us, self.ident], kind="stable", na_position="first", ignore_index=True)
        code, us = rows[_CODE].to_numpy(), rows[self.us].to_numpy(np.int64)
        day_count = _before(code, us, code, us + 1) - _before(code, us, code, us - DAY)
        for p, newest in self.pieces.items():
            if newest + DAY >= us.min():
                old = _unpack(self.past.getValue((p,))[0])
                old_code, old_us = who.get_indexer(old[_KEY]), old[self.us].to_numpy(np.int64)
                order = np.lexsort((old_us, old_code))
                old_code, old_us = old_code[order], old_us[order]
                day_count += _before(old_code, old_us, code, us + 1) - _before(old_code, old_us, code, us - DAY)
        # each user's last rows, then the new ones: row i follows those before it of the same user
        old_of = who.get_indexer(self.tails[_KEY])
        of = np.concatenate([old_of[old_of >= 0], code])
        order = np.argsort(of, kind="stable")
        of, new = of[order], order >= (old_of >= 0).sum()
        times = np.concatenate([self.tails[self.us].to_numpy(np.int64)[old_of >= 0], us])[order]
        merchants = np.array([*self.tails[self.merchant][old_of >= 0], *rows[self.merchant]], dtype=object)[order]
        merchants = np.where(pd.isna(merchants), None, merchants)
        begin, at = np.searchsorted(of, of), np.arange(len(of))
        first = np.maximum(begin, at - LAST)
        out = rows.drop(columns=[_CODE, _KEY]).assign(**{
            _LAST_US: pd.arrays.IntegerArray(times[np.maximum(at - 1, 0)][new], (at == begin)[new]),
            ADDED[1]: [merchants[a:b].tolist() for a, b in zip(first[new].tolist(), at[new].tolist(), strict=True)],
            ADDED[2]: day_count,
        })
        kept = np.searchsorted(of, of, "right") - at <= LAST
        mine = pd.DataFrame({_KEY: who.to_numpy()[of[kept]], self.us: times[kept], self.merchant: merchants[kept]})
        self.tails = pd.concat([self.tails[old_of < 0], mine], ignore_index=True)
        young = us + DAY >= (whole + 1) * self.slice_us  # rows to come can count these
        if young.any():
            newest = int(us.max())
            self.past.updateValue((self.next,), (_pack(rows.loc[young, [_KEY, self.us]]),))
            self.handle.registerTimer(self._end((newest + DAY) // self.slice_us))
            self.pieces[self.next] = newest
            self.next += 1
        return out

    def close(self) -> None:
        pass


def history_stream(rows: DataFrame, user: str = "user_id", ident: str = "event_id", ts: str = "ts", us: str = "us", merchant: str = "merchant_id", delay: str = "1 hour", slice_minutes: int = 60, buckets: int = BUCKETS) -> DataFrame:
    """Add last_ts, known_merchants and day_count, as ``with_history`` defines them, to a stream of rows.

    A row may come up to ``delay`` behind the newest row of the stream; rows later than that are dropped, as any watermark
    drops them, and count for no other row. A row leaves when the watermark has passed its slice of ``slice_minutes``, which
    must divide a day: small slices answer sooner, large ones are worked out in fewer runs. A ``bucket`` of users is one key of the state and
    so one task's work at a time; their number must stay as it is for a stream that goes on from its checkpoint. Null users have a history like any
    other user; null merchants stand in it as null. Rows without a time have no place in an order and are left out. Repeated
    rows count each. A name that the history adds must not be a column yet. The session must keep state in RocksDB
    (``start`` sees to that).
    """
    if 1440 % slice_minutes:
        raise ValueError(f"slices of {slice_minutes} minutes don't divide a day")
    clash = sorted({*ADDED, _LAST_US, _AT, _KEY, _BUCKET, _CODE} & set(rows.columns))
    if clash:
        raise ValueError(f"columns {clash} are there already")
    # beside a null, pandas makes floats of whole numbers: as a key they are lost (all such users are one), above 2**53 they are rounded
    wide = [c for c, t in rows.dtypes if t == "bigint" and c not in (us, ident)]
    as_text = rows.select(*[F.col(c).cast("string").alias(c) if c in wide else c for c in rows.columns])
    timed = as_text.withColumn(_KEY, F.coalesce(F.concat(F.lit("="), F.col(user).cast("string")), F.lit(""))).filter(F.col(us).isNotNull()).withColumn(_BUCKET, F.pmod(F.hash(_KEY), F.lit(buckets))).withColumn(_AT, F.timestamp_micros(us)).withWatermark(_AT, delay)
    schema = StructType([*as_text.schema.fields, StructField(_LAST_US, LongType()), StructField(ADDED[1], ArrayType(StringType())), StructField(ADDED[2], LongType())])
    out = timed.groupBy(_BUCKET).transformWithStateInPandas(_History(ident, us, merchant, slice_minutes * 60 * 1000 * 1000), schema, "append", "eventTime")
    kind = rows.schema[ts].dataType.simpleString()
    last = F.expr(f"timestampadd(MICROSECOND, {_LAST_US}, TIMESTAMP_NTZ'1970-01-01 00:00:00')") if kind == "timestamp_ntz" else F.timestamp_micros(_LAST_US)
    return out.select(*[F.col(c).cast("bigint").alias(c) if c in wide else c for c in rows.columns], last.alias(ADDED[0]), ADDED[1], ADDED[2])


def start(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Write a stream with history to Parquet files in ``out``, state kept in RocksDB; each row once, also after a failure."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:  # the query keeps the setting it was started with
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(PROVIDER, before)
