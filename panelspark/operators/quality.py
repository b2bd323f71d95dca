"""Data-quality checks: each returns findings (ticker, date, check, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import by_ticker

c = F.col


def _finding(df: DataFrame, check: str, value) -> DataFrame:
    return df.select("ticker", c("trade_date").alias("date"), F.lit(check).alias("check"), value.cast("double").alias("value"))


def date_gaps(prices: DataFrame, days: int = 10) -> DataFrame:
    gap = F.datediff("trade_date", F.lag("trade_date").over(by_ticker()))
    return _finding(prices.withColumn("_gap", gap).where(c("_gap") > days), "date_gap", c("_gap"))


def return_spikes(prices: DataFrame, limit: float = 0.35) -> DataFrame:
    r = F.when(c("adj_close") > 0, F.log(c("adj_close") / F.lag(F.when(c("adj_close") > 0, c("adj_close"))).over(by_ticker())))
    return _finding(prices.withColumn("_r", r).where(F.abs("_r") > limit), "return_spike", c("_r"))


def stale_prices(prices: DataFrame, run: int = 5) -> DataFrame:
    """Rows inside a run in which the close didn't change for `run` rows or more though there was volume."""
    same = F.coalesce((c("close") == F.lag("close").over(by_ticker())) & (c("volume") > 0), F.lit(False)).cast("int")
    marked = prices.withColumn("_same", same).withColumn("_island", F.sum(1 - c("_same")).over(by_ticker()))
    length = F.sum("_same").over(Window.partitionBy("ticker", "_island"))
    return _finding(marked.withColumn("_run", length).where((c("_run") >= run) & (c("_same") == 1)), "stale_price", c("_run"))


def duplicate_rows(prices: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("ticker", "trade_date"))
    return _finding(prices.withColumn("_n", n).where("_n > 1"), "duplicate_row", c("_n"))


def outliers(prices: DataFrame, column: str = "adj_close", limit: float = 8.0) -> DataFrame:
    """Robust z-score by median and median absolute deviation of the ticker; tickers without deviation are skipped."""
    middle = prices.groupBy("ticker").agg(F.median(column).alias("_median"))
    away = prices.join(middle, "ticker").withColumn("_away", F.abs(c(column) - c("_median")))
    spread = away.groupBy("ticker").agg(F.median("_away").alias("_mad")).where("_mad > 0")
    z = 0.6745 * (c(column) - c("_median")) / c("_mad")
    return _finding(away.join(spread, "ticker").withColumn("_z", z).where(F.abs("_z") > limit), "outlier", c("_z"))


def findings(prices: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f(prices) for f in (date_gaps, return_spikes, stale_prices, duplicate_rows, outliers)])


def null_rates(df: DataFrame) -> DataFrame:
    """(column, n_null, rate) of every column, in one pass."""
    row = df.agg(F.count("*").alias("_rows"), *[F.sum(c(k).isNull().cast("long")).alias(k) for k in df.columns])
    long = row.unpivot("_rows", df.columns, "column", "n_null")
    return long.select("column", F.coalesce("n_null", F.lit(0)).alias("n_null"), F.try_divide(c("n_null"), c("_rows")).alias("rate"))


def ticker_null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(ticker, column, n, n_null, rate): nulls of each column by ticker, in one pass."""
    by = df.groupBy("ticker").agg(F.count("*").alias("n"), *[F.sum(c(k).isNull().cast("long")).alias(k) for k in columns])
    return by.unpivot(["ticker", "n"], columns, "column", "n_null").withColumn("rate", c("n_null") / c("n"))


def repeated_rows(df: DataFrame) -> DataFrame:
    """The rows that stand more than once in all columns, each once, with n, how often."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).where("n > 1")


def excluded(companies: DataFrame, prices: DataFrame, filings: DataFrame, least: int = 10) -> DataFrame:
    """(ticker, reason) of every company that the panel leaves out, by its first reason: not active, without filings, or with
    too few prices."""
    filed = filings.select("ticker").distinct().withColumn("_filed", F.lit(True))
    traded = prices.groupBy("ticker").agg(F.count("*").alias("_n"))
    met = companies.join(filed, "ticker", "left").join(traded, "ticker", "left")
    active = F.coalesce(c("status") == "ATIVO", F.lit(False))
    reason = F.when(~active, "not active").when(c("_filed").isNull(), "no filings").when(F.coalesce("_n", F.lit(0)) < least, "few prices")
    return met.select("ticker", reason.alias("reason")).where("reason IS NOT NULL")


def price_gate(prices: DataFrame) -> DataFrame:
    """(check, severity, n_bad): closes that aren't positive, negative volumes, repeated keys, long gaps."""
    prev = F.datediff("trade_date", F.lag("trade_date").over(by_ticker()))
    n = F.count("*").over(Window.partitionBy("ticker", "trade_date"))
    one = prices.withColumns({"_gap": prev, "_n": n}).agg(
        F.sum((c("close") <= 0).cast("long")).alias("close_not_positive"), F.sum((c("volume") < 0).cast("long")).alias("volume_negative"),
        F.sum((c("_n") > 1).cast("long")).alias("duplicate_key"), F.sum((c("_gap") > 5).cast("long")).alias("gap_over_5d"),
    )
    long = one.unpivot([], one.columns, "check", "n_bad")
    return long.select("check", F.when(c("check").isin("close_not_positive", "volume_negative"), "error").otherwise("warning").alias("severity"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


def panel_findings(panel: DataFrame, critical: list[str], features: list[str]) -> DataFrame:
    """Rows that lack a critical column (value: how many), that use a later filing (value: days, negative), and tickers in
    which one of the features has two values or more that are all the same (no date; value: the least such one)."""
    missing = sum((c(k).isNull().cast("int") for k in critical), F.lit(0))
    lacking = _finding(panel.withColumn("_n", missing).where("_n > 0"), "nan_critical", c("_n"))
    ahead = F.datediff("trade_date", "reference_date")
    early = _finding(panel.withColumn("_d", ahead).where("_d < 0"), "lookahead", c("_d"))
    long = panel.select("ticker", *[c(k).cast("double").alias(k) for k in features]).unpivot(["ticker"], features, "feature", "x")
    flat = long.groupBy("ticker", "feature").agg(F.count("x").alias("_n"), F.min("x").alias("_a"), F.max("x").alias("_b")).where("_n > 1 AND _a = _b").groupBy("ticker").agg(F.min("_a").alias("_a"))
    constant = flat.select("ticker", F.lit(None).cast("date").alias("date"), F.lit("zero_variance").alias("check"), c("_a").alias("value"))
    return lacking.unionByName(early).unionByName(constant)


def panel_gate(panel: DataFrame, critical: list[str]) -> DataFrame:
    """(check, value, passed): span in years, tickers with 252 rows, repeated keys, rows that use a later filing, share of
    nulls in critical columns after a filing, mean log return, sectors, and the largest sector's share of tickers. What can't
    be taken of an empty panel is null and not passed. The panel is reduced to a row a ticker first, then to one a
    sector, in one pass."""
    nulls = sum((c(k).isNull().cast("int") for k in critical), F.lit(0)) / F.lit(float(max(len(critical), 1)))
    filed = c("reference_date").isNotNull()
    day = panel.groupBy("ticker", "trade_date").agg(
        F.count("*").alias("_n"), F.max("sector").alias("sector"), F.sum((c("reference_date") > c("trade_date")).cast("long")).alias("_ahead"), F.sum(F.when(filed, nulls)).alias("_nulls"),
        F.sum(filed.cast("long")).alias("_filed"), F.sum("log_return").alias("_r"), F.count("log_return").alias("_k"),
    )
    one = day.groupBy("ticker").agg(F.min("trade_date").alias("_a"), F.max("trade_date").alias("_b"), F.max("sector").alias("sector"), F.sum("_n").alias("_rows"), F.sum(c("_n") - 1).alias("_dup"), *[F.sum(k).alias(k) for k in ("_ahead", "_nulls", "_filed", "_r", "_k")])
    by = one.groupBy("sector").agg(F.count("*").alias("_t"), F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.sum((c("_rows") >= 252).cast("long")).alias("_long"), *[F.sum(k).alias(k) for k in ("_dup", "_ahead", "_nulls", "_filed", "_r", "_k")])
    named = F.when(c("sector").isNotNull(), c("_t"))
    row = by.agg(
        (F.datediff(F.max("_b"), F.min("_a")) / 365.25).alias("span_years"), F.sum("_long").cast("double").alias("long_tickers"), F.sum("_dup").cast("double").alias("duplicate_keys"), F.coalesce(F.sum("_ahead"), F.lit(0)).cast("double").alias("look_ahead"),
        F.try_divide(F.sum("_nulls"), F.sum("_filed")).alias("null_after_filing"), F.try_divide(F.sum("_r"), F.sum("_k")).alias("mean_return"), F.count("sector").cast("double").alias("sectors"), F.try_divide(F.max(named), F.sum(named)).alias("largest_sector"),
    )
    v = c("value")
    passed = F.when(c("check") == "span_years", v >= 2).when(c("check") == "long_tickers", v >= 20).when(c("check").isin("duplicate_keys", "look_ahead"), v == 0).when(c("check") == "null_after_filing", v < 0.1)
    passed = passed.when(c("check") == "mean_return", F.abs(v) < 0.1).when(c("check") == "sectors", v >= 3).otherwise(v < 0.4)
    return row.unpivot([], row.columns, "check", "value").select("check", "value", F.coalesce(passed, F.lit(False)).alias("passed"))
