"""Weights by day, turnover, attribution and evaluation windows, all in set form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def normalised(x: Column, by: str = "trade_date") -> Column:
    """x over its sum in the group; missing ones weigh 0."""
    return F.coalesce(F.try_divide(x, F.sum(x).over(Window.partitionBy(by))), F.lit(0.0))


def softmax_weights(scores: DataFrame, score: str, temperature: float = 1.0, by: str = "trade_date") -> DataFrame:
    """w: softmax of score / temperature in each group; rows without a score weigh exactly 0."""
    z = c(score) / temperature
    return scores.withColumn("w", normalised(F.exp(z - F.max(z).over(Window.partitionBy(by))), by))


def inverse_volatility(returns: DataFrame, column: str = "returns", rows: int = 61) -> DataFrame:
    """w: each day's share of 1 / population deviation over the ticker's last `rows` rows, where it is above 1e-8."""
    past = Window.partitionBy("ticker").orderBy("trade_date").rowsBetween(-(rows - 1), 0)
    deviation = F.stddev_pop(column).over(past)
    return returns.withColumn("_i", F.when(deviation > 1e-8, 1 / deviation)).withColumn("w", normalised(c("_i"))).drop("_i")


def top_share(panel: DataFrame, score: str, share: float = 0.2, least: int = 5) -> DataFrame:
    """w: equal weight on each day's best max(floor(n * share), 1) names with a score (ties to the smaller ticker); on all
    of them where that is fewer than `least`."""
    day = Window.partitionBy("trade_date")
    place = F.row_number().over(day.orderBy(c(score).desc_nulls_last(), "ticker"))
    ranked = panel.withColumns({"_n": F.count(score).over(day), "_place": place})
    k = F.greatest(F.floor(c("_n") * share), F.lit(1))
    chosen = F.when(k < least, c("_n")).otherwise(k)
    return ranked.withColumn("w", F.when(c("_place") <= chosen, F.lit(1.0) / chosen).otherwise(0.0)).drop("_n", "_place")


def capped(weights: DataFrame, cap: float, by: str = "trade_date", exempt: str = "CASH") -> DataFrame:
    """Weights w (rows of active names) of which none but the exempt ticker's exceeds the cap before they are normalised.

    What is above the cap goes in equal parts to names below it, again and again; that ends at min(cap, w + level) with one
    level for the day, which ordered windows give directly: with the k largest names at the cap, level is what they give
    over the number of the others, and k is the least for which the next name stays within the cap. Where even all at the
    cap don't hold the sum, all are at the cap. Null weights count as 0.
    """
    w = F.coalesce("w", F.lit(0.0))
    names = weights.withColumns({"w": w, "_stock": ~c("ticker").eqNullSafe(exempt)})
    group = Window.partitionBy(by, "_stock")
    falling = group.orderBy(c("w").desc(), "ticker")
    names = names.withColumns({"_k": F.row_number().over(falling) - 1, "_above": F.sum("w").over(falling.rowsBetween(Window.unboundedPreceding, 0)) - c("w"), "_n": F.count("*").over(group)})
    names = names.withColumn("_level", (c("_above") - c("_k") * cap) / (c("_n") - c("_k")))
    level = F.min(F.when(c("w") + c("_level") <= cap + 1e-12, F.struct("_k", "_level"))).over(group)["_level"]
    held = F.when(~c("_stock"), c("w")).when(level.isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), c("w") + level))
    out = names.withColumn("_held", held).withColumn("w", normalised(c("_held"), by))
    return out.select(*weights.columns)


def turnover(weights: DataFrame, by: str = "trade_date") -> DataFrame:
    """(date, turnover): sum of |w - w of the day before| over the names of either day, missing ones as 0; the first day
    counts against nothing held. Each row meets its own day and the next one, so no grid of days and names is made."""
    days = weights.select(by).distinct().withColumn("_i", F.row_number().over(Window.orderBy(by)))  # a row for each day
    held = weights.join(days, by)
    moves = held.select("_i", "ticker", "w").unionByName(held.select((c("_i") + 1).alias("_i"), "ticker", (-c("w")).alias("w")))
    daily = moves.groupBy("_i", "ticker").agg(F.abs(F.sum("w")).alias("_d")).groupBy("_i").agg(F.sum("_d").alias("turnover"))
    return days.join(daily, "_i").select(by, "turnover")


def attribution(daily: DataFrame) -> DataFrame:
    """By strategy, of (strategy, agent_log, cash_w, selic_log, ew_log) by day: what cash carried, what the market's exposure
    gave and the rest, each compounded, with the total and the mean cash weight."""
    cash = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("cash_w")))
    carry, total = cash * F.expm1("selic_log"), F.expm1("agent_log")
    market = (1 - cash) * F.expm1("ew_log")
    grown = lambda x: F.product(1 + x) - 1
    return daily.groupBy("strategy").agg(grown(carry).alias("carry"), grown(market).alias("market"), grown(total - carry - market).alias("selection"), grown(total).alias("total"), F.avg(cash).alias("mean_cash"))


def evaluation_windows(span: DataFrame, train_years: int, test_years: int, validation: float = 0.1) -> DataFrame:
    """Anchored windows of a span (start, end): training from the start, its tail held out for validation, then a test of
    test_years; the next test begins a day after the last one's end, while it ends within the span."""
    after = lambda d: F.date_add(F.add_months(d, 12 * test_years), 1)
    first = F.add_months("start", 12 * train_years)
    n = F.greatest(F.floor(F.months_between("end", "start") / (12 * test_years)), F.lit(1)).cast("int")
    starts = F.aggregate(F.sequence(F.lit(1), n), F.array(first), lambda found, _: F.concat(found, F.array(after(F.element_at(found, -1)))))
    out = span.select("start", "end", F.posexplode(starts).alias("window_id", "test_start"))
    out = out.withColumns({"test_end": F.add_months("test_start", 12 * test_years), "train_end": F.date_sub("test_start", 1)}).where("test_end <= end")
    held = F.greatest(F.floor(F.datediff("train_end", "start") * validation), F.lit(1)).cast("int")
    return out.select("window_id", c("start").alias("train_start"), "train_end", F.date_sub("train_end", held - 1).alias("val_start"), "test_start", "test_end")
