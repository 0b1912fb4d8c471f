"""Positions in a total order, without a task that holds them all."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut


def positions(rows: DataFrame, *keys: str, name: str = "position") -> DataFrame:
    """Add ``name``: 0, 1, ... in the order of ``keys``, nulls first; among equals any order.

    Rows are dealt by ranges of the keys and sorted where they land; a row's position is its place there plus the
    sizes of the ranges before. Only those sizes, one number a partition, pass through the driver.
    """
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits of place
    dealt = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", place))
    part = F.shiftright("__place", 33).cast("int")
    sizes = {r.part: r.n for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = np.zeros(max(sizes, default=0) + 1, dtype=np.int64)
    for p in sizes:
        before[p + 1 :] += sizes[p]
    return dealt.withColumn(name, F.get(F.lit(before), part) + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__place")
