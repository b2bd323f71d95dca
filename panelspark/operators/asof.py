"""As-of and interval joins without look-ahead: unions and windows, linear in both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _whole(left: DataFrame, left_on: str) -> list[Column]:
    """The left columns, which stay apart through the union so that those that nobody reads are never computed. The date is that
    of the window, so that what follows knows its order."""
    return [F.col("_t").alias(k) if k == left_on else F.col(k) for k in left.columns]


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, lag_days: int = 0, met: bool = False) -> DataFrame:
    """Each left row with the last right row of its keys whose date, plus lag_days, is at most its own; nulls if there is
    none. Left rows keep their number; where right repeats a date, the row that sorts last by its values in order of columns
    is taken. The right row is carried as one struct, so its null columns stay null. With met, left rows of keys that have no
    right row at all go."""
    values = [c for c in right.columns if c not in by]
    r = right.select(*by, F.date_add(right_on, lag_days).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_right"))
    l = left.select("*", F.col(left_on).alias("_t"), F.lit(1).alias("_side"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_last", F.last("_right", ignorenulls=True).over(w))
    if met:
        both = both.withColumn("_met", F.min("_side").over(Window.partitionBy(*by))).where("_met = 0")
    return both.where("_side = 1").select(*_whole(left, left_on), *[F.col("_last")[v].alias(v) for v in values])


def asof_dates(left: DataFrame, series: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """The as-of join with a series that has no key: resolved on the distinct dates of both sides, which a calendar bounds,
    and joined back by date, sent to all tasks."""
    values = series.columns
    days = left.select(F.col(left_on).alias("_t")).distinct()
    axis = days.withColumn("_side", F.lit(1)).unionByName(series.select(F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.struct(*series.columns).alias("_right")), allowMissingColumns=True)
    last = F.last("_right", ignorenulls=True).over(Window.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = axis.withColumn("_right", last).where("_side = 1").select(F.col("_t").alias(left_on), *[F.col("_right")[v].alias(v) for v in values])
    return left.join(F.broadcast(found), left_on, "left")


def trailing_events(left: DataFrame, events: DataFrame, by: str, left_on: str, right_on: str, value: str, days: int) -> DataFrame:
    """Of each row's key: number and sum of the events in (date - days, date], as n_events and sum_events; the value of its
    last event up to the date (of one day's events the largest) as last_event, and whether it has an event at any time as
    any_event. One window sort gives all."""
    e = events.select(by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    l = left.select("*", F.col(left_on).alias("_t"), F.lit(1).alias("_side"))
    w = Window.partitionBy(by).orderBy(F.unix_date("_t"))
    recent, past = w.rangeBetween(-(days - 1), 0), w.rangeBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(e, allowMissingColumns=True)
    last = F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).over(past)["_v"]
    both = both.withColumns({
        "n_events": F.count("_v").over(recent), "sum_events": F.coalesce(F.sum("_v").over(recent), F.lit(0.0)), "last_event": last, "any_event": F.count("_v").over(Window.partitionBy(by)) > 0,
    })
    return both.where("_side = 1").select(*_whole(left, left_on), "n_events", "sum_events", "last_event", "any_event")
