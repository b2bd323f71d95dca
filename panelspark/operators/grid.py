"""The calendar times the universe as long rows, without a cross join, and its comparison with another copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def activity(panel: DataFrame, date: str = "trade_date") -> tuple[DataFrame, DataFrame]:
    """Each ticker's activity as runs (ticker, first, last) of day numbers on which it has rows, and the numbered calendar
    (day, date). The calendar has a row for each day of the panel, so numbering it takes one task."""
    days = panel.select(c(date).alias("date")).where("date IS NOT NULL").distinct()
    days = days.select((F.row_number().over(Window.orderBy("date")) - 1).alias("day"), "date")
    held = panel.select("ticker", c(date).alias("date")).where("ticker IS NOT NULL").distinct().join(days, "date")
    order = Window.partitionBy("ticker").orderBy("day")
    runs = held.select("ticker", "day", (c("day") - F.row_number().over(order)).alias("_run"))
    return runs.groupBy("ticker", "_run").agg(F.min("day").alias("first"), F.max("day").alias("last")).drop("_run"), days


def grid(panel: DataFrame, columns: list[str], date: str = "trade_date", fill: float | None = None) -> DataFrame:
    """(date, ticker, active, columns): a row for every day of the panel and every ticker. Inactive cells hold `fill`, or null.

    A ticker's runs of active days, and the gaps before, between and after them, unfold by sequence() into its days, so each
    row comes from its own run and no table meets another but by key. Rows without ticker or date are left out; of rows that
    share a cell each gives a row.
    """
    runs, days = activity(panel, date)
    size = days.count()
    order = Window.partitionBy("ticker").orderBy("first")
    gap = F.when(c("first") > F.coalesce(c("_end"), F.lit(-1)) + 1, F.struct((F.coalesce(c("_end"), F.lit(-1)) + 1).alias("a"), (c("first") - 1).alias("b"), F.lit(False).alias("active")))
    run = F.struct(c("first").alias("a"), c("last").alias("b"), F.lit(True).alias("active"))
    rest = F.when(c("_next").isNull() & (c("last") < size - 1), F.struct((c("last") + 1).alias("a"), F.lit(size - 1).alias("b"), F.lit(False).alias("active")))
    pieces = runs.withColumns({"_end": F.lag("last").over(order), "_next": F.lead("first").over(order)}).select("ticker", F.explode(F.array_compact(F.array(gap, run, rest))).alias("p"))
    cells = pieces.select("ticker", "p.active", F.explode(F.sequence("p.a", "p.b")).alias("day")).join(days, "day").select("date", "ticker", "active")
    values = panel.select(c(date).alias("date"), "ticker", *columns)
    kept = lambda k: c(k) if fill is None else F.when(c("active"), c(k)).otherwise(F.lit(fill))
    return cells.join(values, ["date", "ticker"], "left").select("date", "ticker", "active", *[kept(k).alias(k) for k in columns])


def sampled(df: DataFrame, keys: list[str], share: float, seed: int = 0) -> DataFrame:
    """The rows whose keys fall into the sample: about `share` of all keys, the same on every table and run."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c(k).cast("string"), F.lit("")) for k in keys])
    return df.where(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") < int(share * 2**32))


def cross_check(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], share: float = 0.05, tolerance: float = 1e-4, seed: int = 0) -> DataFrame:
    """(item, checked, differ, only_left, only_right) for each column: sampled cells that both tables have, those that differ
    by more than `tolerance`, and those that one table lacks. The sample goes by a hash of the keys, so both sides take the
    same cells and only they are shuffled. Two nulls agree, a null and a value differ, and so do a NaN and a value; repeated keys are compared
    each with each."""
    a, b = (sampled(df.select(*keys, *[c(k).cast("double").alias(f"{k}_{side}") for k in columns], F.lit(1).alias(f"_{side}")), keys, share, seed) for df, side in ((left, "a"), (right, "b")))
    same: Column = F.lit(True)
    b = b.withColumnsRenamed({k: f"{k}_key" for k in keys})
    for k in keys:
        same = same & c(k).eqNullSafe(c(f"{k}_key"))
    both = a.join(b, same, "full")
    met, x, y = c("_a").isNotNull() & c("_b").isNotNull(), (lambda k: c(f"{k}_a")), (lambda k: c(f"{k}_b"))
    equal = lambda k: x(k).eqNullSafe(y(k)) | (F.coalesce(F.abs(x(k) - y(k)) <= tolerance, F.lit(False)))
    counts = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))
    facts = [F.struct(F.lit(k).alias("item"), counts(met).alias("checked"), counts(met & ~equal(k)).alias("differ"), counts(c("_b").isNull()).alias("only_left"), counts(c("_a").isNull()).alias("only_right")).alias(k) for k in columns]
    return both.agg(*facts).select(F.explode(F.array(*columns)).alias("r")).select("r.*")
