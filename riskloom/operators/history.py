"""What a user did before: the last transaction, the last merchants, the count of a day.

A window over the user would bring all of a user's rows into one task. Here rows are dealt by user and day.
The count needs the day before too, so each row's time is copied to the next day; the last rows of earlier days
are carried over from a table with at most five rows for each user and day. So the largest group is one
user's two days, whatever share of all rows the user holds, and its rows are counted by running totals: time grows with
the rows, however many there are in a day. The rows are shuffled once, for the windows and the join of what is carried alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

DAY = 86400 * 1000 * 1000
LAST = 5


def with_history(rows: DataFrame, user: str = "user_id", ident: str = "event_id", ts: str = "ts", us: str = "us", merchant: str = "merchant_id", about: DataFrame | None = None) -> DataFrame:
    """Add last_ts, known_merchants (of the last five rows before, oldest first) and day_count.

    Order is (ts, ident). ``us`` is ts in whole microseconds. day_count counts the user's rows from 24 hours before
    to the row's own time, itself and others at that very time included. Null users have a history like any
    other user. The other columns of ``about``, one row a ``user``, are added too; rows of users that it lacks (null is
    one) go. It meets the table of users and days, not every row.
    """
    integral = isinstance(rows.schema[user].dataType, IntegralType)
    own_user = F.coalesce(F.col(user), F.lit(0)) if integral else F.coalesce(F.col(user).cast("string"), F.lit(""))
    who = [own_user.alias("__u"), F.col(user).isNull().alias("__n")]  # plain keys: a null-safe join would shuffle the rows again
    day = F.floor(F.col(us) / DAY).cast("bigint")
    keyed = rows.withColumn("__day", day)
    # the last rows of every (user, day)
    newest = Window.partitionBy(user, "__day").orderBy(F.desc(ts), F.desc(ident))
    tails = keyed.select(user, "__day", ts, ident, merchant).withColumn("__nr", F.row_number().over(newest)).filter(F.col("__nr") <= LAST)
    tails = tails.groupBy(user, "__day").agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(ident).alias("id"), F.col(merchant).alias("m")))).alias("__tail"))
    # of the days before: each of the last five days with rows gives at most five
    earlier = Window.partitionBy(user).orderBy("__day")
    none = F.lit(None).cast(tails.schema["__tail"].dataType)
    before = F.flatten(F.array(*[F.coalesce(F.lag("__tail", k).over(earlier), F.array().cast(tails.schema["__tail"].dataType)) for k in range(LAST, 0, -1)]))
    carried = tails.select(user, "__day", F.coalesce(before, none).alias("__before"))
    more = [] if about is None else [c for c in about.columns if c != user]
    if about is not None:
        carried = carried.join(about, user)
    carried = carried.select(*who, F.col("__day").alias("__on_day"), "__before", *more)
    places = F.array(F.struct(F.col("__day").alias("day"), F.lit(False).alias("copy")), F.struct((F.col("__day") + 1).alias("day"), F.lit(True).alias("copy")))
    copy = F.col("__p.copy")
    slim = [c if c == us else F.when(~copy, F.col(c)).alias(c) for c in rows.columns]  # of a copy only its time is asked
    dealt = keyed.withColumn("__p", F.explode(places)).select(*who, F.col("__p.day").alias("__on_day"), copy.alias("__copy"), *slim)
    group = Window.partitionBy("__u", "__n", "__on_day")
    own, span = group.orderBy(F.desc("__copy"), ts, ident), group.orderBy(us)
    upto, past = span.rangeBetween(Window.unboundedPreceding, 0), span.rangeBetween(Window.unboundedPreceding, -DAY - 1)
    mine = F.when(~F.col("__copy"), F.struct(F.col(ts).alias("ts"), F.col(ident).alias("id"), F.col(merchant).alias("m")))
    within = F.array_compact(F.array(*[F.lag(mine, k).over(own) for k in range(LAST, 0, -1)]))
    seen = dealt.withColumn("__in", within).withColumn("day_count", F.count("*").over(upto) - F.count("*").over(past)).filter("not __copy")
    joined = seen.join(carried, ["__u", "__n", "__on_day"]).withColumn("__all", F.concat("__before", "__in"))
    last = F.when(F.size("__all") > LAST, F.slice("__all", -LAST, LAST)).otherwise(F.col("__all"))
    return joined.select(*rows.columns, *more, F.try_element_at("__all", F.lit(-1))["ts"].alias("last_ts"), F.transform(last, lambda x: x["m"]).alias("known_merchants"), "day_count")
