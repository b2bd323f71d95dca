"""Column helpers: rolling windows that need all their rows, guarded arithmetic, ranks, the normal distribution."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("trade_date")


def so_far() -> WindowSpec:
    return by_ticker().rowsBetween(Window.unboundedPreceding, 0)


def by_date() -> WindowSpec:
    return Window.partitionBy("trade_date")


def by_sector() -> WindowSpec:
    return Window.partitionBy("trade_date", "sector")


def by_filing() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("reference_date")


def full(n: int, agg: Callable[[Column], Column], x: Column, over: WindowSpec | None = None) -> Column:
    """agg over the last n rows, null until they hold n values."""
    frame = (over or by_ticker()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    a, b = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    return F.try_divide(a, b)


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def clip(x: Column, low: float, high: float) -> Column:
    """x inside [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def filled(x: Column, over) -> Column:
    """The last value that isn't null."""
    return F.last(x, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))


def rank_share(x: Column, by: list[str]) -> Column:
    """Average rank of x among the values of its group, over their number; null where x is."""
    w = Window.partitionBy(*by)
    rank = F.rank().over(w.orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), (rank + (ties - 1) / 2.0) / F.count(x).over(w))


def annual_growth(now: Column, ago: Column, years: float) -> Column:
    """Yearly growth in percent that leads from one value to the other; null unless both are positive."""
    return F.when((now > 0) & (ago > 0), (F.pow(now / positive(ago), 1 / years) - 1) * 100)


def normal_cdf(z: Column, terms: int = 80) -> Column:
    """The standard normal distribution function by its series in z, which is as exact as doubles are up to the 7 deviations
    beyond which it stays at its value there. z is a named column: it stands in each term."""
    z = clip(z, -7.0, 7.0)
    series = F.lit(1.0)
    for k in range(terms, 0, -1):
        series = 1 + z * z / (2 * k + 1) * series
    return 0.5 + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * z * series


# Coefficients of the rational approximation of the normal quantile by P. J. Acklam, highest power first;
# numerator and denominator in the middle, numerator and denominator in the tails, and where the tails begin.
QUANTILE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
TAIL = 0.02425


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + k
    return out


def normal_quantile(p: Column) -> Column:
    """The value below which the standard normal distribution has the share p: a rational approximation by pieces, with one
    Newton step on the distribution function where that is exact enough (up to 5 deviations; beyond, a relative 1.2e-9).
    Null unless 0 < p < 1."""

    def rough(p: Column) -> Column:
        q, middle = F.sqrt(-2 * F.log(F.least(p, 1 - p))), p - 0.5
        tail = _polynomial(QUANTILE[2], q) / _polynomial(QUANTILE[3], q)
        return F.when((p <= 0) | (p >= 1), None).when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(middle * _polynomial(QUANTILE[0], middle * middle) / _polynomial(QUANTILE[1], middle * middle))

    step = lambda x: F.when(F.abs(x["z"]) < 5, x["z"] - (normal_cdf(x["z"]) - x["p"]) * math.sqrt(2 * math.pi) * F.exp(x["z"] * x["z"] / 2)).otherwise(x["z"])
    named = F.transform(F.array(p), lambda v: F.struct(v.alias("p"), rough(v).alias("z")))
    return F.transform(named, step)[0]


def mapped(x: Column, names: dict[str, str]) -> Column:
    """The name that a small mapping gives to x; x itself where it gives none."""
    if not names:
        return x
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), x), x)


def z_score(x: Column, over) -> Column:
    """(x - mean) / sample deviation of the group; null if the deviation is 0 or undefined."""
    deviation = F.stddev_samp(x).over(over)
    return F.when(deviation > 0, (x - F.avg(x).over(over)) / deviation)


def correlation(a, b) -> Column:
    """Pearson's correlation over rows that have both, null where either doesn't vary (for which the built-in one fails)."""
    a, b = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
