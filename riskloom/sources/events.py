"""Transactions derived from a table of events, for trying the engine on data that holds no transactions.

Averages are sums of decimals, so they are the same in any order and on any engine; they are aggregates that
are joined back (a user's to the days of the user, the merchants', at most 40, to all rows), not windows, and a user's history is taken by user and day, so no user or merchant is ever
gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.operators.history import with_history

#: Category code by event type. Fixed values.
EVENT_MCC = {"click": 5411, "view": 5812, "signup": 5944, "purchase": 7995, "error": 9999}


def transactions(events: DataFrame) -> DataFrame:
    """One transaction for each event: event_id, ts, the payload columns, known_merchants and label."""
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select("event_id", "ts", "user_id", F.col("value").cast("float").alias("amount"), F.col("value").alias("value"), k.alias("k"), F.col("event_type"), S.micros(F.col("ts")).alias("us"))
    base = base.withColumn("merchant_id", F.concat(F.lit("MERC-"), F.lpad((F.col("k") % 20).cast("string"), 3, "0"))).withColumn("m", F.col("k") % 20)
    exact = F.col("value").cast("decimal(18,6)")
    mean = lambda name: (F.sum(exact).cast("double") / F.count("*")).cast("float").alias(name)
    users = base.groupBy("user_id").agg(mean("customer_avg_amount"))
    merchants = base.groupBy("m").agg(mean("merchant_avg_amount"))
    code = F.create_map(*[F.lit(x) for pair in EVENT_MCC.items() for x in pair])
    rows = with_history(base, about=users).withColumn("tx_count_24h", F.least(F.lit(255), F.col("day_count")).cast("int")).join(F.broadcast(merchants), "m")
    has_last = F.col("last_ts").isNotNull()
    return rows.select(
        "event_id",
        "user_id",
        "ts",
        "last_ts",
        "merchant_id",
        "known_merchants",
        "amount",
        (F.col("k") % 12 + 1).alias("installments"),
        F.hour("ts").alias("hour"),
        S.weekday(F.col("ts")).alias("weekday"),
        "customer_avg_amount",
        "tx_count_24h",
        (~S.is_known(F.col("merchant_id"), F.col("known_merchants"))).alias("is_unknown_merchant"),
        F.coalesce(code[F.col("event_type")], F.lit(9999)).cast("bigint").alias("mcc"),
        "merchant_avg_amount",
        (F.col("k") % 2 == 0).alias("is_online"),
        (F.col("k") % 3 == 0).alias("card_present"),
        (F.col("k") * 10).cast("float").alias("km_from_home"),
        has_last.alias("has_last_tx"),
        F.when(has_last, S.minutes_between(F.col("ts"), F.col("last_ts"))).otherwise(0).cast("float").alias("minutes_since_last"),
        F.when(has_last, F.col("k") * 5).otherwise(0).cast("float").alias("km_from_current"),
        F.when((F.col("value") > 60) | (F.hour("ts") < 6), 1).otherwise(0).alias("label"),
    )


def request_body() -> Column:
    """A transaction's JSON request body."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    last = F.when(F.col("has_last_tx"), F.struct(stamp("last_ts").alias("timestamp"), F.col("km_from_current").alias("km_from_current")))
    body = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.struct("amount", "installments", stamp("ts").alias("requested_at")).alias("transaction"),
        F.struct(F.col("customer_avg_amount").alias("avg_amount"), "tx_count_24h", "known_merchants").alias("customer"),
        F.struct(F.col("merchant_id").alias("id"), F.col("mcc").cast("string").alias("mcc"), F.col("merchant_avg_amount").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", "km_from_home").alias("terminal"),
        last.alias("last_transaction"),
    )
    return F.to_json(body, {"ignoreNullFields": "false"}).alias("body")


def as_requests(txns: DataFrame) -> DataFrame:
    """The transactions as JSON request bodies: event_id, body, label."""
    return txns.select("event_id", request_body(), "label")
