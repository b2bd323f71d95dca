"""Features of the panel: prices, filings, valuation, macro and cross-section."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelspark.functions.columns import annual_growth, by_date, by_filing, by_sector, by_ticker, filled, full, positive, ratio, so_far, z_score
from panelspark.operators.asof import trailing_events
from panelspark.operators.statements import enterprise_multiples

c = F.col


def price_features(prices: DataFrame) -> DataFrame:
    """Log return, volatility, moving means, range, drawdown, RSI and 1 to 12 month returns of each ticker."""
    adj = positive(c("adj_close"))
    out = prices.withColumn("log_return", F.log(adj / F.lag(adj).over(by_ticker())))
    change = c("adj_close") - F.lag("adj_close").over(by_ticker())
    out = out.withColumns({"_gain": F.greatest(change, F.when(change.isNotNull(), 0.0)), "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))})
    peak = F.max("adj_close").over(so_far())
    # gain and loss are missing together, so one count serves both, and each mean is taken once
    rise = F.try_divide(F.avg("_gain").over(by_ticker().rowsBetween(-13, 0)), full(14, F.avg, c("_loss")))
    out = out.withColumns({
        "volatility_20d": full(20, F.stddev_samp, c("log_return")), "volatility_60d": full(60, F.stddev_samp, c("log_return")),
        "ma_20": full(20, F.avg, c("adj_close")), "ma_60": full(60, F.avg, c("adj_close")),
        "hl_ratio": ratio(c("high") - c("low"), "adj_close"), "drawdown": ratio(c("adj_close") - peak, peak),
        "rsi_14": 100 - 100 / (1 + rise),
        **{f"return_{k}": full(n, F.sum, c("log_return")) for k, n in {"1m": 21, "3m": 63, "6m": 126, "12m": 252}.items()},
    })
    return out.drop("_gain", "_loss")


def training_returns(prices: DataFrame, limit: float = 1.0) -> DataFrame:
    """Log returns, null where larger than the limit in size."""
    adj = positive(c("adj_close"))
    r = F.log(adj / F.lag(adj).over(by_ticker()))
    return prices.withColumn("returns", F.when(F.abs(r) <= limit, r))


def filing_features(filings: DataFrame) -> DataFrame:
    """Ratios, growth over four filings, changes, the F-score's flags, and five-year growth rates."""
    growth = {"revenue": "net_revenue", "earnings": "net_income", "ebitda": "ebitda", "total_assets": "total_assets", "total_debt": "total_debt"}
    out = filings.withColumns({f"_{k}": filled(c(v), by_filing()) for k, v in growth.items()})
    lag4 = lambda name: F.lag(name, 4).over(by_filing())
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    out = out.withColumns({
        "book_to_market": ratio("equity", "market_cap"), "earnings_yield": ratio("net_income", "market_cap"), "cash_ratio": ratio("cash", "current_liabilities"), "net_debt_to_assets": ratio("net_debt", "total_assets"),
        "working_capital_ratio": ratio(c("current_assets") - c("current_liabilities"), "total_assets"),
        **{f"{k}_growth_yoy": F.try_divide(c(f"_{k}"), F.lag(f"_{k}", 4).over(by_filing())) - 1 for k in growth},
        **{f"{k}_qoq": c(k) - F.lag(k).over(by_filing()) for k in ("gross_margin", "net_margin", "roe", "debt_equity", "current_ratio")},
        "f_roa_positive": flag(c("roa") > 0), "f_roa_improving": flag(c("roa") > lag4("roa")), "f_margin_improving": flag(c("gross_margin") > lag4("gross_margin")),
        "f_leverage_decreasing": flag(c("debt_equity") < lag4("debt_equity")), "f_liquidity_improving": flag(c("current_ratio") > lag4("current_ratio")),
    })
    out = out.withColumn("f_score", sum((c(k) for k in ("f_roa_improving", "f_margin_improving", "f_leverage_decreasing", "f_liquidity_improving")), c("f_roa_positive")))
    for name, column in (("revenue", "net_revenue"), ("earnings", "net_income")):
        out = out.withColumn("_rate", annual_growth(c(column), F.lag(column, 20).over(by_filing()), 5))
        year = Window.partitionBy("ticker", F.year("reference_date")).orderBy("reference_date")
        out = out.withColumn(f"cagr_{name}_5y_calc", filled(c("_rate"), year))
    base = F.lag("net_income", 20).over(by_filing())
    late = F.row_number().over(by_filing()) > 20
    out = out.withColumn("had_negative_earnings_5y", (late & (base.isNull() | (base <= 0))).cast("int"))
    return out.drop("_rate", *[f"_{k}" for k in growth])


def final_growth(filings: DataFrame) -> DataFrame:
    """cagr_{name}_5y_final: the source's own rate, or where it has none the computed one, which goes."""
    names = ("earnings", "revenue")
    given = {k: c(f"cagr_{k}_5y") if f"cagr_{k}_5y" in filings.columns else F.lit(None).cast("double") for k in names}
    return filings.withColumns({f"cagr_{k}_5y_final": F.coalesce(given[k], f"cagr_{k}_5y_calc") for k in names}).drop(*[f"cagr_{k}_5y_calc" for k in names])


def dividend_features(panel: DataFrame, dividends: DataFrame, days: int = 252) -> DataFrame:
    """Dividends of the last days by ex-date over the day's price, their number, and the last one. A ticker that never paid
    has 0 as its last one, others null before their first."""
    out = trailing_events(panel, dividends, "ticker", "trade_date", "ex_date", "value_per_share", days)
    out = out.withColumns({
        "div_yield_12m": F.when(c("adj_close") > 0, c("sum_events") / c("adj_close")).otherwise(0.0),
        "div_value_recent": F.when(c("any_event"), c("last_event")).otherwise(0.0), "div_count_12m": c("n_events"),
    })
    return out.drop("n_events", "sum_events", "last_event", "any_event")


def reanchor(panel: DataFrame) -> DataFrame:
    """Valuation of the day: multiples of the filing scaled by the day's price over the filing's, which goes. Enterprise
    multiples come first, of the filing's own market value."""
    factor = F.when(c("close_price") > 0, c("close") / c("close_price"))
    scaled = [k for k in ("pl", "pvp", "market_cap", "p_sr", "p_ebit", "p_ebitda", "p_assets") if k in panel.columns]
    out = enterprise_multiples(panel).withColumns({**{k: c(k) * factor for k in scaled}, "book_to_market": F.try_divide(c("book_to_market"), factor)})
    return out.withColumns({"has_fundamentals": c("reference_date").isNotNull().cast("double"), "days_since_fundamental": F.datediff("trade_date", "reference_date")}).drop("close_price")


def macro_features(panel: DataFrame) -> DataFrame:
    return panel.withColumns({"excess_return": c("log_return") - c("selic") / 252, "real_return": c("log_return") - c("ipca") / 252, "selic_trend_20d": c("selic") - F.lag("selic", 20).over(by_ticker())})


def cross_section(panel: DataFrame) -> DataFrame:
    """Momentum against market and sector, and scores and ranks within a day's sector, of the columns that the panel has.

    The panel is dealt by day once, which serves groups by day and sector too; the finest order comes first, so that the one
    sort serves the coarser windows after it.
    """
    periods = [m for m in ("1m", "3m", "12m") if f"return_{m}" in panel.columns]
    in_sector = lambda x: F.when(c("sector").isNotNull(), x)
    out = panel.repartition("trade_date")
    if "div_yield_12m" in panel.columns:
        paid = c("div_yield_12m")
        out = out.withColumn("_rank", F.rank().over(by_sector().orderBy(paid.asc_nulls_last())))
        out = out.withColumn("_ties", F.count(paid).over(Window.partitionBy("trade_date", "sector", paid)))
        share = (c("_rank") + (c("_ties") - 1) / 2.0) / F.count(paid).over(by_sector())
        out = out.withColumn("div_yield_sector_percentile", F.when(c("sector").isNotNull() & paid.isNotNull(), share)).drop("_rank", "_ties")
    scores = {f"momentum_vs_sector_{m}": in_sector(c(f"return_{m}") - F.avg(f"return_{m}").over(by_sector())) for m in periods}
    scores |= {f"{k}_zscore_sector": in_sector(z_score(c(k), by_sector())) for k in ("pl", "pvp", "roe", "debt_equity") if k in panel.columns}
    return out.withColumns(scores).withColumns({f"momentum_vs_market_{m}": c(f"return_{m}") - F.avg(f"return_{m}").over(by_date()) for m in periods})


def _rolling_share(x: np.ndarray, n: int, block: int) -> np.ndarray:
    """The share of the last n values that are at most each one's, missing ones apart; windows are views of one array."""
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(n - 1, np.nan), x)), n)
    some = np.concatenate((np.zeros(n), np.cumsum(~np.isnan(x))))
    below = [(windows[i : i + block] <= x[i : i + block, None]).sum(1) for i in range(0, len(x), block)]
    return np.concatenate(below) / np.maximum(some[n:] - some[:-n], 1)


def _whole_share(x: np.ndarray) -> np.ndarray:
    """The average rank of each value among all, over their number."""
    known = np.sort(x[~np.isnan(x)])
    return (np.searchsorted(known, x, "left") + np.searchsorted(known, x, "right") + 1) / 2 / max(len(known), 1)


def shares(panel: DataFrame, whole: dict[str, str], recent: dict[str, tuple[str, int]], block: int = 2048) -> DataFrame:
    """For each name of whole: the average rank of a column among all of the ticker's rows over their number. For each of
    recent, (column, n): the share of the column's values in the ticker's last n rows that are at most the row's own. Null
    where the value is. A group holds a ticker's days, which a calendar bounds."""
    names = [*whole, *recent]
    schema = StructType([*panel.schema.fields, *[StructField(k, DoubleType()) for k in names]])

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["trade_date"].to_numpy(), kind="stable")
        for name in names:
            column, n = recent.get(name, (whole.get(name), 0))
            x = table[column].to_numpy().astype(float)
            share = np.empty(len(x))
            share[order] = _rolling_share(x[order], n, block) if n else _whole_share(x[order])
            table = table.append_column(name, pa.array(share, mask=np.isnan(x)))
        return table

    return panel.groupBy("ticker").applyInArrow(run, schema)


#: Columns that history_ranks reads.
HISTORY = ("volatility_20d", "volatility_60d", "adj_close", "pl", "drawdown")


def history_ranks(panel: DataFrame) -> DataFrame:
    """Where a row stands in its ticker's own past: volatility among all rows, price and price over earnings among those of five
    years, drawdown of one, of the columns that the panel has."""
    whole = {f"volatility_{n}d_percentile": f"volatility_{n}d" for n in (20, 60)}
    recent = {"price_percentile_5y": ("adj_close", 1260), "pl_percentile_5y": ("pl", 1260), "drawdown_percentile": ("drawdown", 252)}
    return shares(panel, {k: v for k, v in whole.items() if v in panel.columns}, {k: v for k, v in recent.items() if v[0] in panel.columns})


def valuation_ratios(panel: DataFrame, tiny: float = 1e-8) -> DataFrame:
    """Ratios of earnings, book and growth to each other and to the day's rate; tiny is added to denominators."""
    over = lambda a, b: F.try_divide(c(a), b + tiny)
    out = panel.withColumns({
        "revenue_per_earning": over("net_revenue", c("net_income")), "ebitda_margin": over("ebitda", c("net_revenue")), "peg_ratio": over("pl", c("earnings_growth_yoy") * 100),
        "pvp_to_roe_ratio": over("pvp", c("roe")), "earnings_yield": F.try_divide(F.lit(1.0), c("pl") + tiny), "revenue_vs_earnings_growth_delta": c("revenue_growth_yoy") - c("earnings_growth_yoy"),
    })
    return out.withColumn("earnings_yield_vs_selic", c("earnings_yield") - c("selic") / 100)


def filing_trends(panel: DataFrame, columns: dict[str, str] | None = None, rows: int = 4, over: WindowSpec | None = None) -> DataFrame:
    """Change over so many rows of the ticker, in order of filing (rows without one last) and day, of each column under its
    new name. Another window may be given: where filings are those as of the day, order by day gives the same."""
    by = over or Window.partitionBy("ticker").orderBy(c("reference_date").asc_nulls_last(), "trade_date")
    columns = columns or {"roe_trend_4q": "roe", "margin_trend_4q": "net_margin", "debt_trend_4q": "debt_equity", "roa_trend_4q": "roa"}
    return panel.withColumns({k: c(v) - F.lag(v, rows).over(by) for k, v in columns.items()})
