"""Performance, risk and significance of daily return series (strategy, date, r), r simple unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import correlation, normal_cdf
from panelspark.sources.scratch import kept

c = F.col
DAYS, TINY = 252, 1e-12


def _sharpe(x: Column) -> Column:
    return F.when(F.count(x) < 2, 0.0).otherwise(F.avg(x) / (F.stddev_pop(x) + TINY) * math.sqrt(DAYS))


def metrics(returns: DataFrame) -> DataFrame:
    """By strategy: n, sharpe, sortino, win_rate, mean, naive t, cumulative and annualised return, largest drawdown."""
    by = Window.partitionBy("strategy").orderBy("date")
    value = F.exp(F.sum(F.log1p("r")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    curve = returns.withColumn("_value", value)
    peak = F.greatest(F.lit(1.0), F.max("_value").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    curve = curve.withColumn("_drawdown", 1 - c("_value") / peak)
    fall = F.when(c("r") < 0, c("r"))
    out = curve.groupBy("strategy").agg(
        F.count("*").alias("n"), _sharpe(c("r")).alias("sharpe"), (F.avg("r") / (F.coalesce(F.stddev_pop(fall), F.lit(0.0)) + TINY) * math.sqrt(DAYS)).alias("sortino"),
        F.avg((c("r") > 0).cast("double")).alias("win_rate"), F.avg("r").alias("mean"), F.try_divide(F.avg("r"), F.stddev_samp("r") / F.sqrt(F.count("*"))).alias("t_naive"),
        (F.max_by("_value", "date") - 1).alias("cumulative_return"), F.max("_drawdown").alias("max_drawdown"),
    )
    return out.withColumn("annualized_return", F.pow(1 + c("cumulative_return"), DAYS / c("n")) - 1)


def drawdown_curve(returns: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """(strategy, date, value, drawdown): the value that the returns lead to, and how far it lies below its highest so far,
    the capital included."""
    by = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.select("strategy", "date", (capital * F.exp(F.sum(F.log1p("r")).over(by))).alias("value"))
    return curve.withColumn("drawdown", 1 - c("value") / F.greatest(F.lit(capital), F.max("value").over(by)))


def _sortino(x: Column) -> Column:
    fall = F.coalesce(F.stddev_pop(F.when(x < 0, x)), F.lit(TINY))
    return F.when(F.count(x) < 2, 0.0).otherwise(F.avg(x) / (fall + TINY) * math.sqrt(DAYS))


def excess_ratios(returns: DataFrame) -> DataFrame:
    """excess_sharpe and excess_sortino by strategy, of r less the riskless rf of the same row."""
    over = c("r") - c("rf")
    return returns.groupBy("strategy").agg(F.count("*").alias("n"), _sharpe(over).alias("excess_sharpe"), _sortino(over).alias("excess_sortino"))


def cost_metrics(returns: DataFrame, rate: float) -> DataFrame:
    """Of (strategy, date, r net of cost, cost), cost being turnover times rate: the Sharpe ratio before costs, what costs take
    in a year, and the mean turnover of the days that have a cost."""
    traded = F.when(c("cost") > 0, c("cost") / rate)
    return returns.groupBy("strategy").agg(_sharpe(c("r") + c("cost")).alias("gross_sharpe"), (F.avg("cost") * DAYS).alias("annualized_cost_drag"), F.coalesce(F.avg(traded), F.lit(0.0)).alias("mean_turnover"))


def concentration_metrics(weights: DataFrame) -> DataFrame:
    """(strategy, effective_n, max_weight) of (strategy, date, w): means over days of one over the sum of squares, and of the
    largest weight."""
    day = weights.groupBy("strategy", "date").agg(F.sum(c("w") * c("w")).alias("_h"), F.max("w").alias("_m"))
    return day.groupBy("strategy").agg(F.avg(1 / F.greatest("_h", F.lit(TINY))).alias("effective_n"), F.avg("_m").alias("max_weight"))


def hac_test(returns: DataFrame, lags: int = 21) -> DataFrame:
    """hac_t with p_value, two-sided under the normal distribution: 1 below three rows or without deviation."""
    t = hac_t(returns, lags).withColumn("_z", -F.abs("t_hac"))
    return t.withColumn("p_value", F.when(c("n") >= 3, F.coalesce(2 * normal_cdf(c("_z")), F.lit(1.0))).otherwise(1.0)).drop("_z")


def hac_t(returns: DataFrame, lags: int = 21) -> DataFrame:
    """Newey-West t of the mean by strategy, with Bartlett weights over `lags` lags."""
    w = Window.partitionBy("strategy")
    d = returns.withColumn("_d", c("r") - F.avg("r").over(w))
    by = w.orderBy("date")
    d = d.withColumns({f"_l{k}": c("_d") * F.lag("_d", k).over(by) for k in range(1, lags + 1)})
    n = F.count("*")
    variance = F.sum(c("_d") * c("_d")) / n
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)) / n
    return d.groupBy("strategy").agg(n.alias("n"), F.avg("r").alias("mean"), F.sqrt(F.when(variance > 0, variance) / n).alias("se")).withColumn("t_hac", F.try_divide(c("mean"), c("se")))


def alpha_beta(pairs: DataFrame, y: str, x: str) -> DataFrame:
    return pairs.agg(F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), correlation(y, x).alias("correlation"))


def daily_rank_ic(panel: DataFrame, feature: str, target: str, min_names: int = 10) -> DataFrame:
    """(trade_date, n, ic): correlation by day of the average ranks of feature and target, each ranked among its own values
    before the names that lack the other are left out; null below min_names. An average rank is the mean of the first and the
    last place of equal values, both in one order, so a day's rows are sorted once for each of the two."""

    def rank(x: str) -> Column:
        order = Window.partitionBy("trade_date").orderBy(c(x).asc_nulls_last())
        upto = F.count(x).over(order.rangeBetween(Window.unboundedPreceding, 0))
        return F.when(c(x).isNotNull(), (F.rank().over(order) + upto) / 2.0)

    both = panel.select("trade_date", rank(feature).alias("_f"), rank(target).alias("_t")).where("_f IS NOT NULL AND _t IS NOT NULL")
    return both.groupBy("trade_date").agg(F.count("*").alias("n"), correlation("_f", "_t").alias("ic")).withColumn("ic", F.when(c("n") >= min_names, c("ic")))


def forward_return(prices: DataFrame, days: int) -> DataFrame:
    """Log return of each ticker over the next `days` rows; both prices must be positive."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    later = F.lead("adj_close", days).over(w)
    return prices.withColumn("forward", F.when((c("adj_close") > 0) & (later > 0), F.log(later / c("adj_close"))))


def rebalanced(returns: DataFrame, weights: DataFrame, every: int, cost: float) -> DataFrame:
    """Daily return by strategy of portfolios that are set to target weights every `every` days and drift in between.

    returns: (date, ticker, r simple); weights: (strategy, date, ticker, w) on all days, of which each block's first is used.
    Inside a block V_d = sum w0 prod(1 + r), so a day's return is V_d / V_(d-1) - 1 without a loop. Turnover of a block is
    sum |w - w_drifted| against the end of the block before; its cost is taken from the block's first day.
    """
    returns, weights = kept(returns.select("date", "ticker", "r"), "returns"), kept(weights.select("strategy", "date", "ticker", "w"), "weights")
    days = returns.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1)  # a row for each day
    days = days.withColumn("_block", F.floor(c("_i") / every))
    first = Window.partitionBy("_block").orderBy("_i")
    days = days.withColumn("_start", F.first("date").over(first))
    target = weights.withColumnRenamed("date", "_start")
    held = days.join(returns, "date").join(target, ["_start", "ticker"])
    grown = Window.partitionBy("strategy", "_block", "ticker").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    held = kept(held.withColumn("_v", c("w") * F.product(1 + c("r")).over(grown)).select("strategy", "date", "ticker", "_i", "_block", "_v"), "held")
    value = held.groupBy("strategy", "date", "_i", "_block").agg(F.sum("_v").alias("_V"))
    before = F.coalesce(F.lag("_V").over(Window.partitionBy("strategy", "_block").orderBy("_i")), F.lit(1.0))
    end = Window.partitionBy("strategy", "_block")
    last = held.withColumn("_last", F.max("_i").over(end)).where("_i = _last").select("strategy", (c("_block") + 1).alias("_block"), "ticker", "_v")
    total = last.groupBy("strategy", "_block").agg(F.sum("_v").alias("_sum"))
    drifted = last.join(total, ["strategy", "_block"]).select("strategy", "_block", "ticker", (c("_v") / c("_sum")).alias("_w"))
    now = target.join(days.select("_start", "_block").distinct(), "_start").select("strategy", "_block", "ticker", "w")
    moves = now.join(drifted, ["strategy", "_block", "ticker"], "full").groupBy("strategy", "_block").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("_w", F.lit(0.0)))).alias("turnover"))
    out = value.withColumn("gross", c("_V") / before - 1).join(moves, ["strategy", "_block"], "left")
    cost_now = F.when(c("_i") % every == 0, c("turnover") * cost).otherwise(0.0)
    return out.select("strategy", "date", "gross", cost_now.alias("cost"), (c("gross") - cost_now).alias("r"))


def rolling_sharpe(returns: DataFrame, n: int) -> DataFrame:
    """sharpe of the last n rows of each strategy, null until there are n."""
    past = Window.partitionBy("strategy").orderBy("date").rowsBetween(-(n - 1), 0)
    full = F.count("r").over(past) == n
    return returns.withColumn("sharpe", F.when(full, F.avg("r").over(past) / (F.stddev_pop("r").over(past) + TINY) * math.sqrt(DAYS)))


def return_to_go(returns: DataFrame, gamma: float) -> DataFrame:
    """to_go: the sum of later returns, each discounted by gamma for each row between, the row's own included."""
    by = Window.partitionBy("strategy").orderBy("date")
    numbered = returns.withColumn("_k", F.row_number().over(by) - 1)
    later = by.rowsBetween(0, Window.unboundedFollowing)
    return numbered.withColumn("to_go", F.sum(c("r") * F.pow(F.lit(gamma), c("_k"))).over(later) / F.pow(F.lit(gamma), c("_k"))).drop("_k")


def cash_price(rates: DataFrame, date: str = "reference_date", rate: str = "selic") -> DataFrame:
    """price of cash: 100 compounded by each day's rate in percent; a row for each date."""
    return rates.withColumn("price", 100 * F.exp(F.sum(F.log1p(c(rate) / 100)).over(Window.orderBy(date))))


def probabilistic_sharpe(returns: DataFrame, benchmark: float = 0.0) -> DataFrame:
    """(strategy, n, psr): probability that the daily Sharpe ratio exceeds the benchmark, by the moments of r; 0.5 below three
    rows or without deviation."""
    m = returns.groupBy("strategy").agg(F.count("r").alias("n"), F.try_divide(F.avg("r"), F.stddev_pop("r")).alias("s"), F.skewness("r").alias("g"), (F.kurtosis("r") + 3).alias("k"))
    spread = 1 - c("g") * c("s") + (c("k") - 1) / 4 * c("s") * c("s")
    z = F.when((c("n") >= 3) & (spread > 0), (c("s") - benchmark) * F.sqrt(c("n") - 1) / F.sqrt(spread))
    return m.select("strategy", "n", F.coalesce(z, F.lit(0.0)).alias("_z")).select("strategy", "n", normal_cdf(c("_z")).alias("psr"))
