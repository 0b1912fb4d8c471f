"""Transaction requests as JSON: scan, validate, reject; answers and golden sets as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from riskloom.functions import scalar as S
from riskloom.operators.order import positions

REQUEST_SCHEMA = (
    "id string, transaction struct<amount: float, installments: int, requested_at: string>, "
    "customer struct<avg_amount: float, tx_count_24h: int, known_merchants: array<string>>, "
    "merchant struct<id: string, mcc: string, avg_amount: float>, "
    "terminal struct<is_online: boolean, card_present: boolean, km_from_home: float>, "
    "last_transaction struct<timestamp: string, km_from_current: float>"
)

PAYLOAD = ["amount", "installments", "hour", "weekday", "customer_avg_amount", "tx_count_24h", "is_unknown_merchant", "mcc", "merchant_avg_amount", "is_online", "card_present", "km_from_home", "has_last_tx", "minutes_since_last", "km_from_current"]


def _byte(c: Column) -> Column:
    return c.between(0, 255)


def parse_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """All columns of ``bodies``, the payload columns, ``valid`` and ``status`` (200 or 400).

    Fields are found by name, in any order. A row is valid if the body is a JSON object with all fields of
    the right type: counts within 0..255, times that exist, a numeric category code, and last_transaction
    null or complete. Flags must be there, and are true only for true. Fields of an invalid row may be null.
    """
    r = F.from_json(F.col(body), REQUEST_SCHEMA)
    flags = F.json_object_keys(F.get_json_object(body, "$.terminal"))
    # a generator between them keeps the optimizer from parsing the body, and then its times, anew for each field and filter
    rows = bodies.withColumn("__p", F.explode(F.array(F.struct(r.alias("r"), F.json_object_keys(F.col(body)).alias("keys"), flags.alias("flags")))))
    rows = rows.select(*bodies.columns, F.col("__p.r").alias("__r"), F.col("__p.keys").alias("__keys"), F.col("__p.flags").alias("__flags"))
    at, last = S.iso_timestamp(F.col("__r.transaction.requested_at")), S.iso_timestamp(F.col("__r.last_transaction.timestamp"))
    rows = rows.withColumn("__t", F.explode(F.array(F.struct(at.alias("at"), last.alias("last")))))
    rows = rows.select("*", F.col("__t.at").alias("__at"), F.col("__t.last").alias("__last"))
    t, c, m, p, prev = (F.col(f"__r.{x}") for x in ("transaction", "customer", "merchant", "terminal", "last_transaction"))
    has_last = prev.isNotNull()
    needed = [F.col("__r.id"), t["amount"], F.col("__at"), c["avg_amount"], c["known_merchants"], m["id"], S.mcc_number(m["mcc"]), m["avg_amount"], p["km_from_home"]]
    valid = _byte(t["installments"]) & _byte(c["tx_count_24h"]) & F.array_contains("__keys", "last_transaction") & F.array_contains("__flags", "is_online") & F.array_contains("__flags", "card_present")
    for x in needed:
        valid = valid & x.isNotNull()
    valid = F.coalesce(valid & (~has_last | (F.col("__last").isNotNull() & prev["km_from_current"].isNotNull())), F.lit(False))
    return rows.select(
        *bodies.columns,
        F.col("__r.id").alias("request_id"),
        t["amount"].alias("amount"),
        t["installments"].alias("installments"),
        F.hour("__at").alias("hour"),
        S.weekday(F.col("__at")).alias("weekday"),
        c["avg_amount"].alias("customer_avg_amount"),
        c["tx_count_24h"].alias("tx_count_24h"),
        (~S.is_known(m["id"], c["known_merchants"])).alias("is_unknown_merchant"),
        S.mcc_number(m["mcc"]).alias("mcc"),
        m["avg_amount"].alias("merchant_avg_amount"),
        S.truth(p["is_online"]).alias("is_online"),
        S.truth(p["card_present"]).alias("card_present"),
        p["km_from_home"].alias("km_from_home"),
        has_last.alias("has_last_tx"),
        F.when(has_last, S.minutes_between(F.col("__at"), F.col("__last")).cast("float")).otherwise(F.lit(0.0).cast("float")).alias("minutes_since_last"),
        F.when(has_last, prev["km_from_current"]).otherwise(F.lit(0.0).cast("float")).alias("km_from_current"),
        valid.alias("valid"),
        F.when(valid, 200).otherwise(400).alias("status"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("valid")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter("not valid")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests stored one a line, parsed."""
    return parse_requests(spark.read.text(path).withColumnRenamed("value", "body"))


def read_golden_set(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """idx, body, expected_approved of labelled load sets: JSON documents with ``entries`` of request and expected_approved.

    A file is one document or, with ``lines``, has one a line; idx counts within a document.
    """
    entry = StructType().add("request", StructType.fromDDL(REQUEST_SCHEMA)).add("expected_approved", "boolean")
    schema = StructType().add("entries", ArrayType(entry))
    entries = spark.read.schema(schema).option("multiLine", not lines).json(path).select(F.posexplode("entries").alias("idx", "e"))
    return entries.select("idx", F.to_json("e.request", {"ignoreNullFields": "false"}).alias("body"), F.col("e.expected_approved").alias("expected_approved"))


def write_golden_set(labelled: DataFrame, path: str, order: str, entries: int = 1000) -> None:
    """(``order``, body, expected_approved) as documents of at most ``entries`` entries, one a line, in that order."""
    placed = positions(labelled, order, name="at").withColumn("document", F.floor(F.col("at") / entries))
    entry = F.concat(F.lit('{"request":'), "body", F.lit(',"expected_approved":'), F.col("expected_approved").cast("string"), F.lit("}"))
    listed = F.array_sort(F.collect_list(F.struct("at", entry.alias("entry"))))
    document = F.concat(F.lit('{"entries":['), F.array_join(listed["entry"], ","), F.lit("]}"))
    placed.groupBy("document").agg(document.alias("value")).select("value").write.text(path)


def read_golden_stats(spark: SparkSession, path: str) -> DataFrame:
    """The ``stats`` object of a labelled load set, as one row."""
    schema = "stats struct<total: bigint, fraud_count: bigint, fraud_rate: double, legit_count: bigint, legit_rate: double, edge_case_count: bigint, edge_case_rate: double>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("stats.*")


def response_json(votes: Column) -> Column:
    """The answer to a request with so many fraud votes."""
    n = F.least(votes, F.lit(5))
    return F.to_json(F.struct((n < 3).alias("approved"), (n / 5.0).cast("double").alias("fraud_score")))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines."""
    df.write.mode(mode).json(path)
