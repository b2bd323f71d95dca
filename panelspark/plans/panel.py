"""The panel: prices with filings, companies, macro series and dividends as of each day, and its features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import by_ticker
from panelspark.operators.asof import asof_dates, asof_join
from panelspark.operators.features import HISTORY, cross_section, dividend_features, filing_features, filing_trends, final_growth, history_ranks, macro_features, price_features, reanchor, valuation_ratios
from panelspark.operators.statements import payout_ratios


def build_panel(prices: DataFrame, filings: DataFrame, companies: DataFrame, macro: DataFrame, dividends: DataFrame, min_rows: int = 10, history: bool = True, cross: bool = True) -> DataFrame:
    """One row for each (ticker, trade_date) of active tickers with a filing and min_rows rows, with all features.

    history: with ranks in a ticker's own past. They go through Arrow by ticker, which can't be pruned: only their inputs go
    there, and come back by a ticker's row number. cross: with what compares names of a day, for which the panel is dealt by
    day; that can't be pruned either.

    Each table is read once, but for the dates of prices, which resolve the macro series as of each day. What belongs to a
    ticker (counts, windows, dividends, filings as of a day) follows in one partitioning by ticker; last the panel is dealt by
    day for what compares names. The company dimension and the calendar are the only other sides.
    """
    active = companies.where("status = 'ATIVO'").select("ticker", "sector")
    base = asof_dates(prices, macro.withColumnRenamed("reference_date", "macro_date"), "trade_date", "macro_date").drop("macro_date").join(active.hint("shuffle_hash"), "ticker")
    rows = F.count("*").over(by_ticker().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # in the order of the windows after it
    panel = price_features(base.withColumn("_rows", rows).where(F.col("_rows") >= min_rows).drop("_rows"))
    panel = dividend_features(panel, dividends)
    panel = asof_join(panel, final_growth(filing_features(filings)), ["ticker"], "trade_date", "reference_date", met=True)
    panel = reanchor(macro_features(panel))
    if {"lpa", "shares_outstanding"} <= set(panel.columns):
        panel = payout_ratios(panel, "div_value_recent", "shares_outstanding")
    panel = filing_trends(valuation_ratios(panel), over=by_ticker())
    if history:
        panel = panel.withColumn("_row", F.row_number().over(by_ticker()))
        ranks = history_ranks(panel.select("ticker", "trade_date", "_row", *[k for k in HISTORY if k in panel.columns]))
        ranks = ranks.drop("trade_date", *HISTORY)
        panel = panel.join(ranks, ["ticker", "_row"]).drop("_row")
    return cross_section(panel) if cross else panel
