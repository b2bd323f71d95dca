"""Report aggregates: health, coverage, fences, differences of tables, scalers and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import correlation

c = F.col


def health(df: DataFrame, key: str = "ticker", date: str = "trade_date") -> DataFrame:
    """One row: n_rows, n_keys, first and last date, rows whose key and date came before, share of nulls in all cells."""
    nulls = sum((c(k).isNull().cast("int") for k in df.columns), F.lit(0))
    by_row = df.groupBy(key, date).agg(F.count("*").alias("_n"), F.sum(nulls).alias("_nulls"))
    share = F.try_divide(F.sum("_nulls"), F.sum("_n") * len(df.columns))
    return by_row.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.coalesce(F.sum(c("_n") - 1), F.lit(0)).alias("n_repeated"), share.alias("null_share"))


def fences(df: DataFrame, column: str, by: str = "ticker", width: float = 1.5) -> DataFrame:
    """By group: quartiles (interpolated), and the rows below and above them by more than width times their distance."""
    q = df.groupBy(by).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("_q")).select(by, c("_q")[0].alias("q1"), c("_q")[1].alias("q3"))
    away = (c("q3") - c("q1")) * width
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return df.join(q, by).groupBy(by, "q1", "q3").agg(count(c(column) < c("q1") - away).alias("n_low"), count(c(column) > c("q3") + away).alias("n_high"))


def frozen_share(df: DataFrame, column: str, by: list[str], least: int = 5) -> DataFrame:
    """One row: groups of `least` rows or more, how many of them have a single value, and their share."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(column).eqNullSafe(F.max(column)).alias("same"), F.count(column).alias("some")).where((c("n") >= least) & (c("some") > 0))
    return g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(c("same").cast("long")), F.lit(0)).alias("n_frozen"), F.avg(c("same").cast("double")).alias("share"))


def month_counts(df: DataFrame, key: str = "ticker", date: str = "trade_date") -> DataFrame:
    """(key, month, n) with 0 for a key's months without rows between its first and its last one."""
    n = df.groupBy(key, F.trunc(date, "month").alias("month")).agg(F.count("*").alias("n"))
    span = n.groupBy(key).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    months = span.select(key, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("month"))
    return months.join(n, [key, "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def difference(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(side, n, max_abs): rows only left, only right, and in both, with the largest difference of the column there."""
    a = left.select(*keys, c(column).alias("_a"), F.lit(True).alias("_l"))
    b = right.select(*keys, c(column).alias("_b"), F.lit(True).alias("_r"))
    side = F.when(c("_r").isNull(), "left").when(c("_l").isNull(), "right").otherwise("both")
    return a.join(b, keys, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.max(F.abs(c("_a") - c("_b"))).alias("max_abs"))


def scalers(df: DataFrame, features: list[str], cutoffs: DataFrame, date: str = "trade_date") -> DataFrame:
    """(window_id, feature, n, mean, std) over rows up to each window's cutoff; a deviation of 0 becomes 1.

    Rows are reduced to moments by day first, so what meets the windows is a row for each day and feature. Sums of squares
    are taken about the feature's mean over all days, which keeps them exact enough.
    """
    long = df.select(date, *features).unpivot([date], features, "feature", "x").where("x IS NOT NULL")
    day = long.groupBy(date, "feature").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    all_days = Window.partitionBy("feature")
    day = day.withColumn("_c", F.sum(c("n") * c("m")).over(all_days) / F.sum("n").over(all_days))
    d = c("m") - c("_c")
    met = day.join(cutoffs.select("window_id", "cutoff"), c(date) <= c("cutoff"))  # a handful of windows
    out = met.groupBy("window_id", "feature").agg(F.sum("n").alias("n"), F.first("_c").alias("_c"), F.sum(c("n") * d).alias("_s"), F.sum(c("n") * (c("v") + d * d)).alias("_q"))
    off = c("_s") / c("n")
    std = F.sqrt(F.greatest(c("_q") / c("n") - off * off, F.lit(0.0)))
    return out.select("window_id", "feature", "n", (c("_c") + off).alias("mean"), F.when(std < 1e-12, 1.0).otherwise(std).alias("std"))


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, correlation) of every pair of columns over the rows that have both, in one pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("correlation")) for a, b in pairs]).alias("_p"))
    return row.select(F.inline("_p"))


def ic_summary(ic: DataFrame, step: int) -> DataFrame:
    """One row of a daily series (trade_date, ic), a value for each day: n, mean, std, naive t, and the t of every step-th value."""
    valid = ic.where("ic IS NOT NULL").withColumn("_i", F.row_number().over(Window.orderBy("trade_date")) - 1)
    apart = F.when(c("_i") % step == 0, c("ic"))
    t = lambda x: F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))
    return valid.agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), t(c("ic")).alias("t_naive"), t(apart).alias("t_apart"))


def top_and_other(df: DataFrame, key: str, value: str, n: int, by: str) -> DataFrame:
    """By group: the n keys of largest value (ties to the smaller key), and the sum of the others as 'Other'."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(c(value).desc_nulls_last(), key))
    name = F.when(c("_place") <= n, c(key)).otherwise("Other")
    return df.withColumn("_place", place).groupBy(by, name.alias(key)).agg(F.sum(value).alias(value))
