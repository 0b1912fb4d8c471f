"""Scalar functions of the transaction model, as Spark columns.

All arithmetic on amounts is single precision: Spark widens float division and products to double, so every
step is cast back, which gives the correctly rounded single-precision result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Risk by merchant category code, in ten-thousandths; any other code has MCC_DEFAULT. Fixed values.
MCC_RISK = {5411: 1500, 5812: 3000, 5912: 2000, 5944: 4500, 7801: 8000, 7802: 7500, 7995: 8500, 4511: 3500, 5311: 2500, 5999: 5000}
MCC_DEFAULT = 5000

SCALE = 10000
ABSENT = -10000
MAX_KNOWN = 32
MAX_MERCHANT_BYTES = 16


def f32(c: Column) -> Column:
    return c.cast("float")


def ratio32(a: Column, b: Column) -> Column:
    """a / b in single precision."""
    return f32(f32(a) / f32(b))


def clamp01(x: Column) -> Column:
    """x cut to 0..1 in ten-thousandths, halves rounded up; NaN is 0, null stays null."""
    inside = F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), F.nanvl(f32(x), F.lit(0.0).cast("float"))))
    scaled = F.floor(f32(inside * F.lit(float(SCALE)).cast("float")).cast("double") + 0.5).cast("int")
    return F.when(x.isNotNull(), scaled)  # greatest and least would skip a null


def mcc_risk(mcc: Column) -> Column:
    """Risk of a merchant category code."""
    table = F.create_map(*[F.lit(x) for pair in MCC_RISK.items() for x in pair])
    return F.coalesce(table[mcc.cast("int")], F.lit(MCC_DEFAULT))


def mcc_number(text: Column) -> Column:
    """The code as an unsigned 32-bit number, or null if the text is none."""
    number = F.when(text.rlike(r"^\+?[0-9]{1,10}$"), text.try_cast("bigint"))
    return F.when(number <= 4294967295, number)


def iso_timestamp(text: Column) -> Column:
    """Date, hour and minute of the first 19 characters of an ISO-8601 text; null if there is no such time.

    Seconds, zone and separators are not looked at. The time has no zone, whatever the session's is.
    """
    shaped = text.rlike(r"^[0-9]{4}.[0-9]{2}.[0-9]{2}.[0-9]{2}.[0-9]{2}.{3}")
    part = lambda at, n: F.substring(text, at, n)
    minute = F.concat(part(1, 4), F.lit("-"), part(6, 2), F.lit("-"), part(9, 2), F.lit(" "), part(12, 2), F.lit(":"), part(15, 2), F.lit(":00"))
    return F.when(shaped, minute.try_cast("timestamp_ntz"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(ts.cast("date"))


def weekday(ts: Column) -> Column:
    """0 for Monday to 6."""
    return F.weekday(ts)


def minutes_between(now: Column, then: Column) -> Column:
    """Whole minutes from ``then`` to ``now``, both cut to the minute; negative if then is later."""
    minute = 60 * 1000 * 1000
    return (F.floor(micros(now) / minute) - F.floor(micros(then) / minute)).cast("bigint")


def is_known(merchant: Column, known: Column) -> Column:
    """Whether the merchant is among the first MAX_KNOWN ids, each cut to MAX_MERCHANT_BYTES; false for a null list."""
    cut = F.transform(F.slice(known, 1, MAX_KNOWN), lambda x: F.left(x, F.lit(MAX_MERCHANT_BYTES)))
    return F.coalesce(F.array_contains(cut, merchant), F.lit(False))


def truth(flag: Column) -> Column:
    """true only for true."""
    return F.coalesce(flag, F.lit(False))


def spend_ratio(amount: Column, average: Column) -> Column:
    """(amount / average) / 10 in single precision; 0 unless the average is a number over 0."""
    usable = (average > 0) & ~F.isnan(average)
    return F.when(usable, ratio32(ratio32(amount, average), F.lit(10.0))).otherwise(F.lit(0.0).cast("float"))


def tag(card_present: Column, is_online: Column, unknown: Column, has_last: Column) -> Column:
    """Four flags as a number, card_present highest."""
    bit = lambda c, n: F.shiftleft(c.cast("int"), n)
    return bit(card_present, 3).bitwiseOR(bit(is_online, 2)).bitwiseOR(bit(unknown, 1)).bitwiseOR(bit(has_last, 0))


def align(n: Column, to: int = 64) -> Column:
    """n rounded up to a multiple of ``to``."""
    return (F.floor((n + (to - 1)) / to) * to).cast("bigint")
