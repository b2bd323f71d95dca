"""Significance of return series (strategy, date, r) and differences of samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import normal_cdf, normal_quantile
from panelspark.operators.performance import hac_t
from panelspark.sources.scratch import kept

c = F.col
EULER_GAMMA = 0.5772156649


def _draw(*parts: Column) -> Column:
    """A number in [0, 2^32) that depends on the parts alone, so a task that runs again draws the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def bootstrap_mean(returns: DataFrame, block: int, resamples: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(strategy, n, mean, low, high): moving-block bootstrap interval of the mean, in blocks of `block` rows.

    A drawn block is a difference of two prefix sums, so a resample costs n / block joined rows and never its n values; the
    last block is cut so that a resample has n rows. Strategies below three rows have no interval.
    """
    by = Window.partitionBy("strategy").orderBy("date")
    sums = kept(returns.where("r IS NOT NULL").select("strategy", F.row_number().over(by).alias("_i"), F.sum("r").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("_p")), "sums")
    size = sums.groupBy("strategy").agg(F.max("_i").alias("n"), (F.max_by("_p", "_i") / F.max("_i")).alias("mean"))
    length = F.least(F.lit(block), c("n"))
    draws = size.where("n >= 3").select("strategy", "n", length.alias("_len"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_b"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(0), F.ceil(c("n") / c("_len")).cast("int") - 1)).alias("_k"))
    draws = draws.withColumn("_start", (_draw(F.lit(seed), c("strategy"), c("_b"), c("_k")) % (c("n") - c("_len") + 1)).cast("int"))
    draws = draws.withColumn("_stop", c("_start") + F.least(c("_len"), c("n") - c("_k") * c("_len")))
    ends = draws.select("strategy", "n", "_b", F.explode(F.array(F.struct(c("_stop").alias("_i"), F.lit(1).alias("_sign")), F.struct(c("_start").alias("_i"), F.lit(-1).alias("_sign")))).alias("_e")).select("strategy", "n", "_b", "_e.*")
    means = ends.where("_i > 0").join(sums, ["strategy", "_i"]).groupBy("strategy", "_b").agg((F.sum(c("_sign") * c("_p")) / F.first("n")).alias("_m"))
    tail = (1 - level) / 2
    found = means.groupBy("strategy").agg(F.percentile("_m", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    return size.join(found, "strategy", "left").select("strategy", "n", "mean", c("_q")[0].alias("low"), c("_q")[1].alias("high"))


def two_sample_ks(long: DataFrame, least: int = 6, parts: int = 64) -> DataFrame:
    """(feature, n_first, n_second, ks) of (feature, x, second): the largest distance between the two samples' distribution
    functions; features with fewer than `least` values on a side are left out.

    Values are counted first, then cut at approximate quantiles: running counts are taken inside a cut and shifted by the
    counts of the cuts before it, so no feature is sorted in one task. The cuts don't change the result.
    """
    side = lambda second: F.sum(F.when(c("second") == second, 1).otherwise(0))
    counts = long.where("x IS NOT NULL AND second IS NOT NULL").groupBy("feature", "x").agg(side(False).alias("_a"), side(True).alias("_b"))
    cuts = counts.groupBy("feature").agg(F.percentile_approx("x", [i / parts for i in range(1, parts)]).alias("_cuts"), F.sum("_a").alias("n_first"), F.sum("_b").alias("n_second"))
    cuts = cuts.where((c("n_first") >= least) & (c("n_second") >= least))
    # a row a feature: by a join on the feature all of its values would be in one task
    met = counts.join(F.broadcast(cuts), "feature")
    met = met.withColumn("_part", F.size(F.filter("_cuts", lambda v: v < c("x")))).drop("_cuts")
    before = Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = met.groupBy("feature", "_part").agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    zero = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    shift = totals.select("feature", "_part", zero("_ta").alias("_sa"), zero("_tb").alias("_sb"))
    inside = Window.partitionBy("feature", "_part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    near = met.select("feature", "_part", "n_first", "n_second", F.sum("_a").over(inside).alias("_a"), F.sum("_b").over(inside).alias("_b"))
    away = F.abs((c("_a") + c("_sa")) / c("n_first") - (c("_b") + c("_sb")) / c("n_second"))
    return near.join(F.broadcast(shift), ["feature", "_part"]).groupBy("feature", "n_first", "n_second").agg(F.max(away).alias("ks"))  # parts rows a feature


def expected_max(trials: DataFrame) -> DataFrame:
    """(n_trials, deviation, benchmark): the largest daily Sharpe ratio expected of so many trials (a column s) that differ by
    chance alone; 0 for fewer than two trials, or ones that don't differ. Null ratios are no trials."""
    n = c("n_trials").cast("double")
    largest = (1 - EULER_GAMMA) * normal_quantile(1 - 1 / n) + EULER_GAMMA * normal_quantile(1 - 1 / (n * math.e))
    found = trials.agg(F.count("s").alias("n_trials"), F.coalesce(F.stddev_pop("s"), F.lit(0.0)).alias("deviation"))
    return found.withColumn("benchmark", F.when((c("n_trials") < 2) | (c("deviation") <= 0), 0.0).otherwise(c("deviation") * largest))


def deflated_sharpe(returns: DataFrame, trials: DataFrame) -> DataFrame:
    """(strategy, n, benchmark, dsr): probability that the daily Sharpe ratio exceeds the largest one expected of so many
    trials (a column s of daily Sharpe ratios) by chance; with fewer than two trials, or none that differ, that it exceeds 0."""
    chance = expected_max(trials).select("benchmark")
    m = returns.groupBy("strategy").agg(F.count("r").alias("n"), F.try_divide(F.avg("r"), F.stddev_pop("r")).alias("s"), F.skewness("r").alias("g"), (F.kurtosis("r") + 3).alias("k"))
    m = m.join(F.broadcast(chance))  # one row
    spread = 1 - c("g") * c("s") + (c("k") - 1) / 4 * c("s") * c("s")
    z = F.when((c("n") >= 3) & (spread > 0), (c("s") - c("benchmark")) * F.sqrt(c("n") - 1) / F.sqrt(spread))
    return m.select("strategy", "n", "benchmark", F.coalesce(z, F.lit(0.0)).alias("_z")).select("strategy", "n", "benchmark", normal_cdf(c("_z")).alias("dsr"))


def daily_sharpe(returns: DataFrame, by: str = "strategy") -> DataFrame:
    return returns.groupBy(by).agg(F.try_divide(F.avg("r"), F.stddev_pop("r")).alias("s"))


def excess(returns: DataFrame, against: str) -> DataFrame:
    """(strategy, date, r) of every other strategy minus the r of strategy `against` on the same day; its Sharpe ratio is that
    of the differences, not a difference of ratios."""
    base = returns.where(c("strategy") == against).select("date", c("r").alias("_base"))
    return returns.where(c("strategy") != against).join(base, "date").select("strategy", "date", (c("r") - c("_base")).alias("r"))


def significance(returns: DataFrame, lags: int = 21, block: int = 21, resamples: int = 2000) -> DataFrame:
    """By strategy: the mean with its naive t, its Newey-West t and its bootstrap interval, all of one stored series."""
    returns = kept(returns.select("strategy", "date", "r"), "series")
    naive = returns.groupBy("strategy").agg(F.try_divide(F.avg("r"), F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("t_naive"))
    return bootstrap_mean(returns, block, resamples).join(naive, "strategy").join(hac_t(returns, lags).select("strategy", "t_hac"), "strategy")


def share_below(values: DataFrame, null: DataFrame) -> DataFrame:
    """(name, value, percent): how many percent of the null distribution (a column x of one row a rollout) lie below each named
    value; null percent where there is none.

    Both sides are cut at quantiles of the null distribution. Whole cuts below a value's are counted by running sums, and only
    inside its own cut does a value meet the null values, by one window over both, so neither side is sent to the other.
    """
    x = null.select(c("x").cast("double").alias("x")).where("x IS NOT NULL")
    cuts = F.array(*map(F.lit, sorted(set(x.approxQuantile("x", [i / 64 for i in range(1, 64)], 0.002))))).cast("array<double>")
    both = x.select(F.lit(None).cast("string").alias("name"), "x", F.lit(1).alias("_n")).unionByName(values.select("name", c("value").cast("double").alias("x"), F.lit(0).alias("_n")))
    both = both.withColumn("_part", F.size(F.filter(cuts, lambda v: v < c("x"))))
    # values of equal x stand before the null ones, so those that equal a value aren't below it
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy("x", "_n").rowsBetween(Window.unboundedPreceding, 0))
    held = both.groupBy("_part").agg(F.sum("_n").alias("_held"))
    before = held.select("_part", (F.sum("_held").over(Window.orderBy("_part")) - c("_held")).alias("_before"))  # a row for each of 64 cuts
    named = both.withColumn("_inside", inside).where("_n = 0").join(before, "_part")
    return named.join(held.agg(F.sum("_held").alias("_all"))).select("name", c("x").alias("value"), F.when(c("x").isNotNull(), 100 * F.try_divide(c("_before") + c("_inside"), c("_all"))).alias("percent"))  # one row on the right
