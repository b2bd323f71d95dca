"""Reports over tables and series: gates, coverage, comparisons of sources, rankings of runs, and small derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from panelspark.functions.quantiles import exact_quantiles
from panelspark.operators.asof import asof_dates
from panelspark.sources.scratch import kept

c = F.col


def _bad(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0))


def gate(df: DataFrame, errors: dict[str, Column], warnings: dict[str, Column] | None = None) -> DataFrame:
    """(check, severity, n_bad, passed) of aggregates that count bad rows, all in one pass; a warning always passes."""
    warnings = warnings or {}
    row = df.agg(*[F.coalesce(x.cast("long"), F.lit(0)).alias(k) for k, x in {**errors, **warnings}.items()])
    severity = F.when(c("check").isin(list(errors)), "error").otherwise("warning")
    long = row.unpivot([], row.columns, "check", "n_bad").withColumn("severity", severity)
    return long.select("check", "severity", "n_bad", ((c("n_bad") == 0) | (c("severity") == "warning")).alias("passed"))


def common_gate(df: DataFrame, date: str, required: list[str], today: Column, key: str = "ticker") -> DataFrame:
    """What each table must pass: rows, the required columns, no date more than two days ahead; repeated dates of a key warn."""
    missing = [k for k in required if k not in df.columns]
    rows = df.groupBy(key, date).agg(F.count("*").alias("_n"))
    future = _bad(F.when(c(date) > F.date_add(today, 2), c("_n")).otherwise(0))
    return gate(rows, {"empty": (F.count("*") == 0).cast("int"), "missing_columns": F.lit(len(missing)), "future_dates": future}, {"repeated_dates": _bad(c("_n") - 1)})


def late_null_gate(filings: DataFrame, column: str, after: int = 20, limit: float = 0.5) -> DataFrame:
    """(ticker, n_late, null_rate, warned): share of nulls among a ticker's filings after its first ones."""
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("reference_date"))
    late = filings.withColumn("_place", place).where(c("_place") > after)
    out = late.groupBy("ticker").agg(F.count("*").alias("n_late"), F.avg(c(column).isNull().cast("double")).alias("null_rate"))
    return out.withColumn("warned", c("null_rate") > limit)


def company_gate(companies: DataFrame) -> DataFrame:
    by = companies.groupBy("ticker").agg(F.count("*").alias("_n"))
    return gate(by, {"empty": (F.count("*") == 0).cast("int"), "repeated_ticker": _bad(c("_n") - 1)})


def value_gate(df: DataFrame, column: str) -> DataFrame:
    """No value at all, and values that aren't positive."""
    return gate(df, {"all_null": (F.count(column) == 0).cast("int"), "not_positive": _bad(F.coalesce(c(column) <= 0, F.lit(False)))})


def dataset_gate(panel: DataFrame, critical: list[str], series: list[str], varying: str, min_rows: int = 10, limit: float = 0.01) -> DataFrame:
    """(check, value, passed) of a finished panel: later filings, repeated keys, nulls in critical columns, series without any
    value, the shortest ticker, the share of filings under which a value that should move by day stays the same, and columns
    that must be there or gone. One aggregation by ticker and filing, then one row."""
    by = panel.groupBy("ticker", "reference_date").agg(
        F.count("*").alias("_n"), F.countDistinct("trade_date").alias("_days"), F.sum((c("reference_date") > c("trade_date")).cast("long")).alias("_ahead"),
        F.count(varying).alias("_k"), F.min(varying).alias("_a"), F.max(varying).alias("_b"),
        *[F.sum(c(k).isNull().cast("long")).alias(f"_null_{k}") for k in critical], *[F.count(k).alias(f"_some_{k}") for k in series],
    )
    ticker = by.groupBy("ticker").agg(
        F.sum("_n").alias("_rows"), F.sum(c("_n") - c("_days")).alias("_dup"), F.sum("_ahead").alias("_ahead"), F.sum(((c("_k") >= 5) & c("reference_date").isNotNull()).cast("long")).alias("_eligible"),
        F.sum(((c("_k") >= 5) & (c("_a") == c("_b")) & c("reference_date").isNotNull()).cast("long")).alias("_frozen"), *[F.sum(k).alias(k) for k in by.columns if k.startswith(("_null_", "_some_"))],
    )
    number = lambda x: F.coalesce(x, F.lit(0)).cast("double")
    row = ticker.agg(
        number(F.sum("_ahead")).alias("look_ahead"), number(F.sum("_dup")).alias("repeated_keys"), *[number(F.sum(f"_null_{k}")).alias(f"null_{k}") for k in critical], *[number(F.sum(f"_some_{k}")).alias(f"some_{k}") for k in series],
        F.min("_rows").cast("double").alias("shortest"), F.try_divide(F.sum("_frozen"), F.sum("_eligible")).alias("frozen_share"),
        F.lit(float({"cagr_earnings_5y_final", "cagr_revenue_5y_final"} <= set(panel.columns))).alias("final_growth"), F.lit(float("close_price" not in panel.columns)).alias("filing_price_gone"), F.lit(float("has_fundamentals" in panel.columns)).alias("availability_flag"),
    )
    value, name = c("value"), c("check")
    passed = F.when(name.startswith("some_"), value > 0).when(name == "shortest", value >= min_rows).when(name == "frozen_share", value < limit)
    passed = passed.when(name.isin("final_growth", "filing_price_gone", "availability_flag"), value == 1).otherwise(value == 0)
    return row.unpivot([], row.columns, "check", "value").select("check", "value", F.coalesce(passed, F.lit(False)).alias("passed"))


def audit_lines(df: DataFrame, key: str, date: str, today: Column, stale_after: int = 7) -> DataFrame:
    """By key: rows, first and last date, age in days, nulls in the other columns, and whether it is stale."""
    nulls = sum((c(k).isNull().cast("long") for k in df.columns if k != date), F.lit(0))
    out = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.sum(nulls).alias("n_null"))
    age = F.datediff(today, "last_date")
    return out.withColumns({"age_days": age, "stale": age > stale_after})


def universe_guard(panel: DataFrame, expected: int) -> DataFrame:
    return panel.agg(F.countDistinct("ticker").alias("n")).select("n", F.lit(expected).alias("expected"), (c("n") == expected).alias("passed"))


def growth_coverage(filings: DataFrame, names: tuple[str, ...] = ("earnings", "revenue")) -> DataFrame:
    """(name, ...): nulls before and after the source's growth rates were filled up, differences where both rates are there,
    and the spread of the final ones. Needs cagr_{name}_5y, its _calc and its _final. The median is exact, by selection."""
    each = [F.struct(F.lit(k).alias("name"), c(f"cagr_{k}_5y").cast("double").alias("_a"), c(f"cagr_{k}_5y_calc").cast("double").alias("_b"), c(f"cagr_{k}_5y_final").cast("double").alias("_f")) for k in names]
    long = kept(filings.select(F.explode(F.array(*each)).alias("r")).select("r.*"), "growth")
    away = F.abs(c("_a") - c("_b"))
    out = long.groupBy("name").agg(
        F.sum(c("_a").isNull().cast("long")).alias("n_before"), F.sum(c("_f").isNull().cast("long")).alias("n_after"), F.count(away).alias("n_both"), F.avg(away).alias("mean_difference"), F.max(away).alias("max_difference"), F.stddev_samp(away).alias("std_difference"),
        F.avg("_f").alias("mean"), F.min("_f").alias("least"), F.max("_f").alias("most"), F.sum((c("_f") > 100).cast("long")).alias("n_above"), F.sum((c("_f") < -100).cast("long")).alias("n_below"),
    )
    return out.join(exact_quantiles(long, "name", "_f", [0.5]).select("name", c("quantiles")[0].alias("middle")), "name")


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, n_null, n_distinct, mean, std, least, q1, middle, q3, most) of each column. Quartiles are exact, by selection
    over counts of values, which also give the distinct ones; the columns are written once in long form for both passes."""
    long = kept(df.select([c(k).cast("double").alias(k) for k in columns]).unpivot([], columns, "feature", "x"), "described")
    out = long.groupBy("feature").agg(F.count("*").alias("_rows"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("most"))
    ranks = exact_quantiles(long, "feature", "x", [0.25, 0.5, 0.75])
    return out.join(ranks, "feature").select("feature", "n", (c("_rows") - c("n")).alias("n_null"), "n_distinct", "mean", "std", "least", *[c("quantiles")[i].alias(k) for i, k in enumerate(("q1", "middle", "q3"))], "most")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share), largest first in no given order of rows."""
    n = df.groupBy(c(column).alias("value")).agg(F.count("*").alias("n"))
    return n.join(df.agg(F.count("*").alias("_all"))).select("value", "n", (c("n") / c("_all")).alias("share"))  # one row on the right


def first_by(df: DataFrame, by: str, order: str) -> DataFrame:
    """One row of each group: the one that is first by `order`, then by its other columns in turn."""
    rest = [k for k in df.columns if k not in (by, order)]
    least = df.groupBy(by).agg(F.min(F.struct(order, *rest)).alias("_r"))
    return least.select(by, "_r.*").select(*df.columns)


def last_by(df: DataFrame, by: str, order: str) -> DataFrame:
    """One row of each group: the one that is last by `order`, then by its other columns in turn. Rows without `order` stand
    before all others."""
    rest = [k for k in df.columns if k not in (by, order)]
    most = df.groupBy(by).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return most.select(by, "_r.*").select(*df.columns)


def agreement(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row for the keys that both sources have: n, mean and largest difference relative to the right, and the shares of
    rows within 1 and 5 percent."""
    both = left.select(*keys, c(column).alias("_a")).join(right.select(*keys, c(column).alias("_b")), keys)
    away = F.abs(F.try_divide(c("_a") - c("_b"), c("_b")))
    within = lambda x: F.avg((away <= x).cast("double"))
    return both.agg(F.count(away).alias("n"), F.avg(away).alias("mean_off"), F.max(away).alias("max_off"), within(0.01).alias("within_1"), within(0.05).alias("within_5"))


def statement_differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], suspect: float = 200.0) -> DataFrame:
    """(keys, item, first, second, percent, suspect): statements that both sources have, item by item; a difference beyond
    `suspect` percent points to another currency or unit."""
    long = lambda df, name: df.select(*keys, *[c(k).cast("double").alias(k) for k in columns]).unpivot(keys, columns, "item", name)
    both = long(left, "first").join(long(right, "second"), [*keys, "item"])
    percent = 100 * F.try_divide(c("second") - c("first"), F.abs("first"))
    return both.withColumn("percent", percent).withColumn("suspect", F.coalesce(F.abs("percent") > suspect, F.lit(False)))


def first_filing(panel: DataFrame) -> DataFrame:
    """(ticker, first_day, first_filed, days_without): the first day, the first one with a filing, and the rows before it."""
    filed = c("reference_date").isNotNull()
    out = panel.groupBy("ticker").agg(F.min("trade_date").alias("first_day"), F.min(F.when(filed, c("trade_date"))).alias("first_filed"), F.sum((~filed).cast("long")).alias("days_without"))
    return out


def near_findings(prices: DataFrame, findings: DataFrame, days: int = 5) -> DataFrame:
    """Rows of prices at most so many days from a finding (ticker, date, check) of their ticker, with the finding. Findings
    are spread over their days first, so the join is on equal keys."""
    spread = findings.select("ticker", "date", "check", F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))).alias("trade_date"))
    return prices.join(spread, ["ticker", "trade_date"])


def holding(weights: DataFrame, prices: DataFrame, ticker: str) -> DataFrame:
    """(trade_date, w, price) of one name over the days of its weights."""
    w = weights.where(c("ticker") == ticker).select("trade_date", "w")
    return w.join(prices.where(c("ticker") == ticker).select("trade_date", c("adj_close").alias("price")), "trade_date", "left")


def snapshot(weights: DataFrame, companies: DataFrame, day: str, least: float = 0.001) -> DataFrame:
    """(ticker, sector, w) of the weights above `least` on one day."""
    held = weights.where((c("trade_date") == F.lit(day).cast("date")) & (c("w") > least)).select("ticker", "w")
    return held.join(companies.select("ticker", "sector"), "ticker", "left")


def mean_holdings(weights: DataFrame, n: int = 15) -> DataFrame:
    """(ticker, w): the n names of largest mean weight over all days of the table (a day without a row counts as 0)."""
    days = weights.agg(F.countDistinct("trade_date").alias("_days"))
    mean = weights.groupBy("ticker").agg(F.sum("w").alias("_w")).join(days).select("ticker", (c("_w") / c("_days")).alias("w"))  # one row on the right
    return mean.orderBy(c("w").desc(), "ticker").limit(n)


def wins(windows: DataFrame, first: str, second: str) -> DataFrame:
    """One row: windows, and those in which the first column is above the second."""
    return windows.agg(F.count("*").alias("n"), _bad(c(first) > c(second)).alias("n_won"), F.avg((c(first) > c(second)).cast("double")).alias("share"))


def best_values(metrics: DataFrame, lowest: tuple[str, ...] = ("max_drawdown",)) -> DataFrame:
    """best: whether a value of (strategy, metric, value) is its metric's largest, or smallest for the named ones."""
    by = Window.partitionBy("metric")
    best = F.when(c("metric").isin(list(lowest)), F.min("value").over(by)).otherwise(F.max("value").over(by))
    return metrics.withColumn("best", F.coalesce(c("value") == best, F.lit(False)))


def strongest(summary: DataFrame, value: str, n: int = 30) -> DataFrame:
    """The n rows of largest size of the value, ties to the smaller feature."""
    return summary.orderBy(F.abs(value).desc_nulls_last(), "feature").limit(n)


def cumulative_cost(returns: DataFrame) -> DataFrame:
    """drag: the sum of a strategy's costs so far."""
    return returns.withColumn("drag", F.sum("cost").over(Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def numeric_columns(df: DataFrame, skipped: tuple[str, ...] = ()) -> list[str]:
    """Floating columns that aren't skipped."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType)) and f.name not in skipped]


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all the columns hold numbers, neither null, NaN nor infinite."""
    return df.where(reduce(Column.__and__, [c(k).isNotNull() & (F.abs(k) < float("inf")) for k in columns]))


def last_span(rows: DataFrame, spans: DataFrame, date: str) -> DataFrame:
    """Rows inside a span (start, end, tag, place), both ends included, with the tag of the one of largest place. Spans are
    spread over the distinct days, which a calendar bounds."""
    days = spans.select("tag", "place", F.explode(F.sequence("start", "end")).alias(date))
    return rows.join(days.groupBy(date).agg(F.max_by("tag", "place").alias("tag")), date)


def uncovered_windows(windows: DataFrame, scalers: DataFrame) -> DataFrame:
    """Windows that have no scaler."""
    return windows.join(scalers.select("window_id").distinct(), "window_id", "left_anti")


def all_cash(days: DataFrame, cash: str = "CASH") -> DataFrame:
    """(ticker, trade_date, w): everything in cash on each day."""
    return days.select(F.lit(cash).alias("ticker"), "trade_date").distinct().withColumn("w", F.lit(1.0))


def held_curve(prices: DataFrame, days: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """(trade_date, price, r, value): one asset bought and held over the days: its last known price as of each, log returns (0
    where a price is missing) and the capital's value. Both tables are calendars."""
    held = asof_dates(days.select("trade_date").distinct(), prices.where("adj_close IS NOT NULL").select(c("trade_date").alias("_d"), c("adj_close").alias("price")), "trade_date", "_d").drop("_d")
    by = Window.orderBy("trade_date")
    out = held.withColumn("r", F.coalesce(F.log(F.try_divide(c("price"), F.lag("price").over(by))), F.lit(0.0)))
    return out.withColumn("value", capital * F.exp(F.sum("r").over(by.rowsBetween(Window.unboundedPreceding, 0))))


def on_calendar(series: DataFrame, days: DataFrame, value: str, back: bool = False) -> DataFrame:
    """(trade_date, value) on each day: the last value known, and with back the next one before the first."""
    axis = days.select("trade_date").distinct().join(series.select("trade_date", value), "trade_date", "full")
    by = Window.orderBy("trade_date")
    filled = F.last(value, True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    if back:
        filled = F.coalesce(filled, F.first(value, True).over(by.rowsBetween(0, Window.unboundedFollowing)))
    return axis.withColumn(value, filled).join(days.select("trade_date").distinct(), "trade_date", "left_semi")


def ratio_checks(first: DataFrame, second: DataFrame, keys: list[str], items: list[str], limit: float = 0.05) -> DataFrame:
    """(item, n, n_within): of each ratio, the rows that both tables have and those within the limit of each other."""
    rows = statement_differences(first, second, keys, items)
    return rows.groupBy("item").agg(F.count("percent").alias("n"), _bad(F.coalesce(F.abs("percent") <= 100 * limit, F.lit(False))).alias("n_within"))


def checkpoint_rows(progress: DataFrame, done: DataFrame) -> DataFrame:
    """The progress table (source, ticker, mark) after a run that reached the marks of `done`; the later mark of a pair stays."""
    return progress.unionByName(done).groupBy("source", "ticker").agg(F.max("mark").alias("mark"))
