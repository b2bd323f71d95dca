"""Filings and prices of other sources: split adjustment, trailing sums, ratios, deflated and resampled series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import by_filing, full
from panelspark.operators.asof import asof_join

c = F.col


def split_adjusted(prices: DataFrame, splits: DataFrame, columns: list[str]) -> DataFrame:
    """Columns times the ratios (ticker, split_date, ratio > 0) of all later splits, with their product as split_factor. One
    window over the union of both, backwards in time; a split doesn't touch its own day."""
    s = splits.where("ratio > 0").select("ticker", c("split_date").alias("_t"), F.lit(1).alias("_side"), F.log("ratio").alias("_ln"))
    p = prices.select("ticker", c("trade_date").alias("_t"), F.lit(0).alias("_side"), F.struct(*prices.columns).alias("_row"))
    later = Window.partitionBy("ticker").orderBy(c("_t").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    factor = F.exp(F.coalesce(F.sum("_ln").over(later), F.lit(0.0)))
    both = p.unionByName(s, allowMissingColumns=True).withColumn("split_factor", factor).where("_side = 0").select("_row.*", "split_factor")
    return both.withColumns({k: c(k) * c("split_factor") for k in columns})


def trailing_year(filings: DataFrame, columns: list[str], unit: float = 1000.0) -> DataFrame:
    """{column}_ttm: sum over four filings in units of 1000; null until there are four."""
    return filings.withColumns({f"{k}_ttm": full(4, F.sum, c(k), by_filing()) / unit for k in columns})


def with_last_close(filings: DataFrame, prices: DataFrame) -> DataFrame:
    """last_close: the last close on or before the filing's date."""
    return asof_join(filings, prices.where("close IS NOT NULL").select("ticker", c("trade_date").alias("close_date"), c("close").alias("last_close")), ["ticker"], "reference_date", "close_date")


def statement_ratios(filings: DataFrame, unit: float = 1000.0) -> DataFrame:
    """Valuation, margins, returns and leverage of raw statements whose levels are in `unit`s and whose price and shares
    aren't; null where a denominator is 0 or an input is missing."""
    cap = c("close_price") * c("shares")
    debt = c("total_debt") - c("cash")
    value = cap + debt * unit
    per = lambda a, b: F.try_divide(a, b)
    percent = lambda a, b: F.try_divide(a, b) * 100
    full_ = lambda k: c(k) * unit
    return filings.select("*", cap.alias("s_market_cap"), debt.alias("s_net_debt"), *[x.alias(f"s_{k}") for k, x in {
        "lpa": per(full_("net_income"), c("shares")), "vpa": per(full_("equity"), c("shares")),
        "pl": per(cap, full_("net_income")), "pvp": per(cap, full_("equity")), "p_sr": per(cap, full_("net_revenue")), "p_assets": per(cap, full_("total_assets")), "p_ebit": per(cap, full_("ebit")), "p_ebitda": per(cap, full_("ebitda")),
        "ev_ebit": per(value, full_("ebit")), "ev_ebitda": per(value, full_("ebitda")),
        "roe": percent(c("net_income"), c("equity")), "roa": percent(c("net_income"), c("total_assets")), "roic": percent(c("ebit"), c("total_debt") + c("equity") - c("cash")),
        "net_margin": percent(c("net_income"), c("net_revenue")), "ebit_margin": percent(c("ebit"), c("net_revenue")), "ebitda_margin": percent(c("ebitda"), c("net_revenue")), "gross_margin": percent(c("net_revenue") - c("cost_of_revenue"), c("net_revenue")),
        "ebit_over_assets": percent(c("ebit"), c("total_assets")), "asset_turnover": per(c("net_revenue"), c("total_assets")), "current_ratio": per(c("current_assets"), c("current_liabilities")),
        "debt_equity": per(c("total_debt"), c("equity")), "net_debt_equity": per(debt, c("equity")), "net_debt_ebit": per(debt, c("ebit")), "net_debt_ebitda": per(debt, c("ebitda")),
    }.items()])


def enterprise_multiples(panel: DataFrame, tiny: float = 1e-12) -> DataFrame:
    """ev_ebit and ev_ebitda of the day, those that the panel has: the filing's earnings are taken back out of its multiple,
    and the day's enterprise value is set over them. market_cap and the multiples are the filing's; factor is the day's close
    over the filing's price."""
    factor = F.when(c("close_price") > 0, c("close") / c("close_price"))
    earned = lambda k: F.try_divide(c("market_cap") + c("net_debt"), F.when(F.abs(k) > tiny, c(k)))
    return panel.withColumns({k: F.try_divide(c("market_cap") * factor + c("net_debt"), earned(k)) for k in ("ev_ebit", "ev_ebitda") if k in panel.columns})


def suspected_splits(panel: DataFrame, days: int = 7, limit: float = 1.5) -> DataFrame:
    """(ticker): price moved by more than `limit` times against a filing's at most so many days old."""
    factor = F.when(c("close_price") > 0, c("close") / c("close_price"))
    return panel.where(F.datediff("trade_date", "reference_date").between(0, days) & ~factor.between(1 / limit, limit)).select("ticker").distinct()


def payout_ratios(panel: DataFrame, last: str = "value_per_share", shares: str = "shares", tiny: float = 1e-8) -> DataFrame:
    """payout_ratio and dividend_coverage_ratio, of the last dividend, earnings a share, shares and EBITDA."""
    return panel.withColumns({"payout_ratio": F.try_divide(c(last), c("lpa") + tiny), "dividend_coverage_ratio": F.try_divide(c("ebitda"), c(last) * c(shares) + tiny)})


def interpolated(days: DataFrame, knots: DataFrame, name: str) -> DataFrame:
    """Days (date) with the value of knots (date, value) on the line between the knots around them; after the last knot its
    value, before the first null. Both are calendars, so one task holds them."""
    axis = days.select("date").distinct().join(knots.where("value IS NOT NULL").select("date", "value"), "date", "full")
    knot = F.when(c("value").isNotNull(), F.struct("date", "value"))
    by = Window.orderBy("date")
    axis = axis.withColumns({"_a": F.last(knot, True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first(knot, True).over(by.rowsBetween(0, Window.unboundedFollowing))})
    share = F.try_divide(F.datediff("date", "_a.date"), F.datediff("_b.date", "_a.date"))
    line = F.coalesce(c("_a.value") + (c("_b.value") - c("_a.value")) * share, c("_a.value"))
    return axis.select("date", line.alias(name)).join(days.select("date").distinct(), "date", "left_semi")


def real_values(series: DataFrame, index: DataFrame) -> DataFrame:
    """real of (name, date, value): value times the last index over the day's, of (date, level)."""
    last = index.agg(F.max_by("level", "date").alias("_last"))
    return series.join(index, "date", "left").join(F.broadcast(last)).withColumn("real", c("value") * F.try_divide(c("_last"), c("level"))).drop("_last", "level")


def total_return(series: DataFrame, dividends: DataFrame) -> DataFrame:
    """total of (ticker, date, real): value of one share whose dividends (ticker, date, amount) buy more on their days."""
    paid = dividends.groupBy("ticker", "date").agg(F.sum("amount").alias("_paid"))
    by = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    joined = series.join(paid, ["ticker", "date"], "left")
    shares = 1 + F.coalesce(F.sum(F.try_divide(c("_paid"), c("real"))).over(by), F.lit(0.0))
    return joined.withColumn("total", c("real") * shares).drop("_paid")


def monthly_index(rates: DataFrame, date: str, rate: str) -> DataFrame:
    """(month_end, mean, level): the mean of a month's rates (percent) and their running product, a row for each month."""
    month = rates.groupBy(F.last_day(date).alias("month_end")).agg(F.avg(rate).alias("mean"))
    return month.withColumn("level", F.product(1 + c("mean") / 100).over(Window.orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0)))


def rebased(series: DataFrame, by: str, date: str, value: str, base: float = 100.0) -> DataFrame:
    """rebased: value over the group's first one that isn't null, times base."""
    first = F.first(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return series.withColumn("rebased", base * F.try_divide(c(value), first))


def growth_rate(series: DataFrame, by: str, date: str, value: str) -> DataFrame:
    """(by, first, last, years, growth) of each group's curve: yearly growth in percent from its first to its last value that
    isn't null; null over no time, or where either isn't positive."""
    known = series.where(c(value).isNotNull() & c(date).isNotNull()).groupBy(by).agg(F.min_by(value, date).alias("first"), F.max_by(value, date).alias("last"), (F.datediff(F.max(date), F.min(date)) / 365.25).alias("years"))
    rate = F.when((c("years") > 0) & (c("first") > 0) & (c("last") > 0), 100 * (F.pow(c("last") / F.nullif(c("first"), F.lit(0.0)), F.try_divide(F.lit(1.0), c("years"))) - 1))
    return known.withColumn("growth", rate)
