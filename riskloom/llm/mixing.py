"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are dealt into blocks. With a weight m of a total L, block i (from 0) of a source
may not be placed before slot floor(i L / m) and not after slot ceil((i + 1) L / m) - 1; one block goes to
each slot, and among the released blocks the one with the earliest deadline. The shares m / L sum to one, so
every deadline is met, and after any number of slots each source has less than one block more or less than
its share. Weights are taken as the exact rational numbers that they are: whole numbers after multiplying by
their common denominator, so nothing is rounded and the bound holds over any number of slots.

When a source has no block left, the others go on with their weights among themselves, in a new phase that
begins with all lags at zero. The schedule depends on weights and block counts alone, not on the rows, and a
row's place follows from its source and its rank in it. Blocks have ``block_rows`` rows at any size of the table.

After L slots of a phase every lag is zero again, so the slots repeat: where L is small, the driver works out
one period and the places of the later blocks are arithmetic. Where it is not, the driver works the slots out
one by one, O(log sources) each, and hands them on in runs of ``RUN_SLOTS`` through the shared folder, so that
it holds one run at a time.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import cut
from riskloom.session import shared_dir

BLOCK_ROWS = 8
MOST_SOURCES = 20_000
BUCKET_ROWS = 512
RUN_SLOTS = 1 << 20  # that the driver holds at a time
PERIOD_SLOTS = 1 << 12
PIECE = 64  # blocks of a source in a row of the schedule, at most


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Weights (whole, Fraction or float, each an exact rational) as whole numbers in the same proportion."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if not exact or any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    scale = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def _earliest(order: list[str], weights: dict[str, int], total: int) -> Iterator[str]:
    """The sources of a phase slot by slot, without an end; ``order`` is by falling weight.

    At the begin every source has a released block; by falling weight their deadlines rise, so they are looked
    at only as far as their deadlines matter.
    """
    done: dict[str, int] = {}
    waiting: list[tuple[int, int, str]] = []  # (release, deadline, source)
    ready: list[tuple[int, str]] = []
    fresh = t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, deadline, s = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s))
        while fresh < len(order):
            deadline = -(-total // weights[order[fresh]])
            if ready and deadline > ready[0][0]:
                break
            heapq.heappush(ready, (deadline, order[fresh]))
            fresh += 1
        deadline, s = heapq.heappop(ready)
        assert t < deadline
        yield s
        t += 1
        i = done[s] = done.get(s, 0) + 1
        m = weights[s]
        heapq.heappush(waiting, (i * total // m, -(-(i + 1) * total // m), s))


def runs(blocks: dict[str, int], weights: dict[str, int], most: int = RUN_SLOTS, period: int = PERIOD_SLOTS) -> Iterator[tuple[int, int, list[str]]]:
    """(phase, times, the sources of at most ``most`` slots), in the order of the slots; a source without weight is an error.

    Slots that come more than once are whole periods of at most ``period`` slots.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    order = sorted(left, key=lambda s: (-weights[s], s))
    total, phase = sum(weights[s] for s in order), 0
    while order:
        times = min((left[s] - 1) // weights[s] for s in order)
        if times > 1 and total <= min(most, period):
            yield phase, times, list(islice(_earliest(order, weights, total), total))
            for s in order:
                left[s] -= times * weights[s]
        picks: list[str] = []
        for s in _earliest(order, weights, total):
            picks.append(s)
            left[s] -= 1
            if not left[s]:
                break
            if len(picks) == most:
                yield phase, 1, picks
                picks = []
        yield phase, 1, picks
        order.remove(s)
        total -= weights[s]
        phase += 1


def schedule(blocks: dict[str, int], weights: dict[str, int], most: int = RUN_SLOTS, period: int = PERIOD_SLOTS) -> tuple[list[str], list[int]]:
    """The source in each slot, and the phase of each slot."""
    picks: list[str] = []
    phases: list[int] = []
    for phase, times, some in runs(blocks, weights, most, period):
        picks += some * times
        phases += [phase] * (len(some) * times)
    return picks, phases


_PERIODS = "s string, first bigint, each bigint, last bigint, begin bigint, length bigint, phase int, short bigint, at array<bigint>"
_PIECES = "s string, piece bigint, first bigint, phase int, short bigint, at array<bigint>"


def slot_tables(spark: SparkSession, sizes: dict[str, int], weights: dict[str, int], block_rows: int, most: int = RUN_SLOTS, period: int = PERIOD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """The schedule as two tables: what repeats, a row a phase and source, and the rest, a row for at most PIECE blocks of a source.

    ``first`` is the number of the first block; ``at`` the slots of the blocks, in a period counted from ``begin``; ``short`` the
    rows that the last blocks of the sources used up before lack.
    """
    number, begin, last_phase, short = dict.fromkeys(sizes, 0), 0, 0, 0
    ended: str | None = None
    periods: list[tuple] = []
    pieces: list[tuple] = []
    held, stored = 0, None
    for phase, times, picks in runs({s: -(-n // block_rows) for s, n in sizes.items()}, weights, most, period):
        if phase != last_phase:
            short += -sizes[ended] % block_rows
            last_phase = phase
        at: dict[str, list[int]] = {}
        for t, s in enumerate(picks):
            at.setdefault(s, []).append(t)
        for s, slots in at.items():
            if times > 1:
                periods.append((s, number[s], len(slots), number[s] + times * len(slots) - 1, begin, len(picks), phase, short, slots))
            else:
                done = 0
                while done < len(slots):
                    first = number[s] + done
                    n = min(PIECE - first % PIECE, len(slots) - done)
                    pieces.append((s, first // PIECE, first, phase, short, [begin + t for t in slots[done : done + n]]))
                    done += n
            number[s] += times * len(slots)
        begin += times * len(picks)
        held += len(picks)
        ended = picks[-1]
        if held >= most:
            stored = stored or f"{shared_dir(spark)}/mix-{uuid.uuid4().hex}"
            spark.createDataFrame(pieces, _PIECES).write.mode("append").parquet(f"{stored}/pieces")
            spark.createDataFrame(periods, _PERIODS).write.mode("append").parquet(f"{stored}/periods")
            periods, pieces, held = [], [], 0
    out = spark.createDataFrame(periods, _PERIODS), spark.createDataFrame(pieces, _PIECES)
    if stored:
        out = out[0].unionByName(spark.read.schema(_PERIODS).parquet(f"{stored}/periods")), out[1].unionByName(spark.read.schema(_PIECES).parquet(f"{stored}/pieces"))
    return out


def block_places(needed: DataFrame, periods: DataFrame, pieces: DataFrame, block_rows: int) -> DataFrame:
    """The rows of ``needed`` (s, from, to, ...) once for each block ``from`` to ``to``: with i, slot, phase and start, the rows before it."""
    own = [c for c in needed.columns if c not in ("from", "to")]
    n, p = needed.alias("n"), periods.alias("p")
    span = F.sequence(F.greatest("n.from", "p.first"), F.least("n.to", "p.last"))
    some = n.join(p, (F.col("n.s") == F.col("p.s")) & (F.col("n.from") <= F.col("p.last")) & (F.col("n.to") >= F.col("p.first")))
    some = some.select(*[f"n.{c}" for c in own], "begin", "length", "first", "each", "phase", "short", "at", F.explode(span).alias("i"))
    nth = F.col("i") - F.col("first")
    slot = F.col("begin") + F.floor(nth / F.col("each")) * F.col("length") + F.get("at", (nth % F.col("each")).cast("int"))
    repeated = some.select(*own, "i", slot.cast("bigint").alias("slot"), "phase", "short")
    cells = needed.withColumn("piece", F.explode(F.sequence(F.floor(F.col("from") / PIECE), F.floor(F.col("to") / PIECE))))
    rest = cells.join(pieces, ["s", "piece"]).select(*own, "from", "to", "first", "phase", "short", F.posexplode("at").alias("nth", "slot"))
    rest = rest.withColumn("i", F.col("first") + F.col("nth")).filter(F.col("i").between(F.col("from"), F.col("to")))
    both = repeated.unionByName(rest.select(*own, "i", "slot", "phase", "short"))
    return both.select(*own, "i", "slot", "phase", (F.col("slot") * block_rows - F.col("short")).alias("start"))


def row_hash(ident: Column) -> Column:
    """60 bits of the MD5 of an id's text, as a bigint; a null id counts as empty text."""
    digest = F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def mix(docs: DataFrame, weights: dict[str, float] | Callable[[str], float] | None = None, source: str = "source", doc_id: str = "doc_id", block_rows: int = BLOCK_ROWS, power: float = 0.5, bucket_rows: int = BUCKET_ROWS, run_slots: int = RUN_SLOTS, period_slots: int = PERIOD_SLOTS) -> DataFrame:
    """All rows and columns of ``docs`` with mix_phase, mix_block (slot of the block) and mix_position (0, 1, ...).

    ``weights``: by source, as a table or a function; a source that a table lacks is an error. Without them,
    a source of n rows weighs n ** ``power``. Rows of a source are taken in the order of ``row_hash`` of their
    id; equal ids follow one another by the hash of all their columns. A null source is the source ''. No row
    is dropped or repeated: equal rows have a place each. Columns with the names of the results are replaced, any
    others are kept whatever their names; an empty table gives no rows. The last block of a source may be short, so
    positions count the rows, not block_rows a slot. ``run_slots`` and ``period_slots`` bound what the driver holds, and
    do not change the order.
    """
    docs = docs.drop("mix_phase", "mix_block", "mix_position")
    total = docs.count()
    # buckets are equal ranges of the hash, so that a source of any size is ranked in many tasks: the ranks in its
    # earlier buckets are added from the counts
    buckets = max(1, -(-total // bucket_rows))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), row_hash(F.col(doc_id)).alias("hash"), F.xxhash64(*docs.columns).alias("tie"))
    rows = rows.withColumn("bucket", F.shiftright(F.shiftright("hash", 28) * buckets, 32).cast("int"))
    counted = cut(rows.groupBy("s", "bucket").agg(F.count("*").alias("n")))
    sizes = {r.s: r.n for r in counted.groupBy("s").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: merge small ones first")
    if not sizes:
        return docs.select("*", F.lit(0).alias("mix_phase"), F.lit(0).cast("bigint").alias("mix_block"), F.lit(0).cast("bigint").alias("mix_position"))
    if weights is None:
        wanted = {s: float(n) ** power for s, n in sizes.items()}
    else:
        wanted = {s: weights(s) if callable(weights) else weights[s] for s in sizes}

    # to each bucket the slots of the blocks that its rows are in
    tables = slot_tables(docs.sparkSession, sizes, whole_weights(wanted), block_rows, run_slots, period_slots)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("s", "bucket", "n", before.alias("offset"))
    needed = offsets.select("s", "bucket", "offset", F.floor(F.col("offset") / block_rows).cast("bigint").alias("from"), F.floor((F.col("offset") + F.col("n") - 1) / block_rows).cast("bigint").alias("to"))
    found = F.array_sort(F.collect_list(F.struct("i", "slot", "phase", "start"))).alias("blocks")
    known = block_places(needed, *tables, block_rows).groupBy("s", "bucket").agg(F.min("offset").alias("offset"), F.min("i").alias("first"), found)

    own = Window.partitionBy("s", "bucket").orderBy("hash", "tie")
    placed = rows.withColumn("nr", F.row_number().over(own) - 1).join(known, ["s", "bucket"])
    placed = placed.withColumn("rank", F.col("nr") + F.col("offset")).withColumn("block", F.floor(F.col("rank") / block_rows).cast("bigint"))
    at = F.get("blocks", (F.col("block") - F.col("first")).cast("int"))
    position = at["start"] + F.col("rank") - F.col("block") * block_rows
    return placed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], at["phase"].alias("mix_phase"), at["slot"].alias("mix_block"), position.cast("bigint").alias("mix_position"))


def mixed_in_order(docs: DataFrame, **options) -> DataFrame:
    """``mix`` with the rows laid out in the order of their positions."""
    return mix(docs, **options).orderBy("mix_position")
