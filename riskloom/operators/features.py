"""Payload to quantized feature vector and partition tag: one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalar as S

DIMS = 14
VECTOR = [f"v{i}" for i in range(DIMS)]


def vector_columns() -> list[Column]:
    """v0..v13 as smallint, in ten-thousandths; -10000 where there is no last transaction."""
    c = F.col
    scaled = lambda name, by: S.clamp01(S.ratio32(c(name), F.lit(by)))
    last = lambda x: F.when(c("has_last_tx"), x).otherwise(F.lit(S.ABSENT))
    flag = lambda name: F.when(c(name), S.SCALE).otherwise(0)
    dims = [
        scaled("amount", 10000.0),
        scaled("installments", 12.0),
        S.clamp01(S.spend_ratio(c("amount"), c("customer_avg_amount"))),
        scaled("hour", 23.0),
        scaled("weekday", 6.0),
        last(scaled("minutes_since_last", 1440.0)),
        last(scaled("km_from_current", 1000.0)),
        scaled("km_from_home", 1000.0),
        scaled("tx_count_24h", 20.0),
        flag("is_online"),
        flag("card_present"),
        flag("is_unknown_merchant"),
        S.mcc_risk(c("mcc")),
        scaled("merchant_avg_amount", 10000.0),
    ]
    return [d.cast("smallint").alias(name) for d, name in zip(dims, VECTOR, strict=True)]


def tag_column() -> Column:
    return S.tag(F.col("card_present"), F.col("is_online"), F.col("is_unknown_merchant"), F.col("has_last_tx")).alias("tag")


def vectorize(payload: DataFrame, *keep: str | Column) -> DataFrame:
    """``keep``, tag and v0..v13 of each payload row."""
    return payload.select(*keep, tag_column(), *vector_columns())
