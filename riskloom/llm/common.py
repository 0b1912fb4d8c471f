"""Shared helpers: lineage cuts, stable samples, row keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import cut as cut  # lineage cuts in the shared folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark's own reader, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def row_key(*columns: str) -> Column:
    """128 bits that tell rows apart by ``columns``, as a struct of two hashes with unlike seeds."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(0x5EED), *columns).alias("b"))


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names`` for columns of an operator's own, with as many underscores in front as keep them off ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def bounded_sample(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """About ``limit`` rows, chosen by a hash of ``key``: the same rows on every run.

    One count decides a hash threshold that 0.95 * ``limit`` rows are expected to pass, so no task sorts, holds
    or hands on more than its share. Rows with an equal key stay or go together: take all that tells rows apart
    into it. A table of at most ``limit`` rows is returned whole.
    """
    total = df.count()
    if total <= limit:
        return df
    share = 0.95 * limit / total
    unit = F.pmod(F.xxhash64(key, F.lit(7919)), F.lit(1 << 40))
    return df.filter(unit < F.lit(int(share * (1 << 40))))
