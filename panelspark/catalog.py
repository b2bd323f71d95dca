"""The registered queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.columns import correlation, rank_share
from panelspark.operators import asof, audit, features, performance, portfolio, quality
from panelspark.plans.panel import build_panel
from panelspark.sources import views as v
from panelspark.streaming.upsert import merged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PRICE = """px AS (SELECT *, ln(adj_close / lag(adj_close) OVER w) AS log_return, adj_close - lag(adj_close) OVER w AS ch, max(adj_close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS peak
    FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date))"""


def _full(fn: str, x: str, n: int) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {fn}({x}) {w} END"


def query(name: str, keys: str, columns: str, sql: str | None, ctes: str = "", plain: str = ""):
    """Registers a query that shows keys, columns (doubles, to 6 digits) and plain ones (doubles as they are, as those that have
    7 or 8 digits, of which rounding makes ties), and its SQL, a SELECT with the same names; None where SQL can't say it."""
    ks, cs = keys.split() + plain.split(), columns.split()

    def put(f):
        QUERIES[name] = lambda spark, sf: f(spark, sf).select(*ks, *[F.round(k, 6).alias(k) for k in cs])
        if sql is not None:
            shown = ", ".join([*[f'"{k}"' for k in ks], *[f"round({k}, 6) AS {k}" for k in cs]])
            ORACLE_SQL[name] = f"WITH {v.SQL}{', ' + ctes if ctes else ''} SELECT {shown} FROM ({sql})"
        return f

    return put


def _price_query(name: str, columns: dict[str, str]):
    body = ", ".join(f"{e} AS {k}" for k, e in columns.items())
    query(name, "ticker trade_date", " ".join(columns), f"SELECT ticker, trade_date, {body} FROM px", PRICE)(lambda s, d: features.price_features(v.prices(s, d)))


_price_query("w01_log_return", {"log_return": "log_return"})
_price_query("w02_volatility", {"volatility_20d": _full("stddev_samp", "log_return", 20), "volatility_60d": _full("stddev_samp", "log_return", 60)})
_price_query("w04_moving_average", {"ma_20": _full("avg", "adj_close", 20), "ma_60": _full("avg", "adj_close", 60)})
_price_query("w06_hl_ratio", {"hl_ratio": "(high - low) / nullif(adj_close, 0)"})
_price_query("w07_drawdown", {"drawdown": "(adj_close - peak) / nullif(peak, 0)"})
_price_query("w08_rsi_14", {"rsi_14": f"100 - 100 / (1 + ({_full('avg', 'greatest(ch, 0)', 14)}) / nullif({_full('avg', 'greatest(-ch, 0)', 14)}, 0))".replace("greatest(ch, 0)", "CASE WHEN ch IS NOT NULL THEN greatest(ch, 0::DOUBLE) END").replace("greatest(-ch, 0)", "CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0::DOUBLE) END")})
_price_query("w09_returns", {f"return_{k}": _full("sum", "log_return", n) for k, n in {"1m": 21, "3m": 63, "6m": 126, "12m": 252}.items()})


@query("w13_training_returns", "ticker trade_date", "returns", "SELECT ticker, trade_date, CASE WHEN abs(log_return) <= 1 THEN log_return END AS returns FROM px", PRICE)
def w13(s, d):
    return features.training_returns(v.prices(s, d))


_F = "WINDOW w AS (PARTITION BY ticker ORDER BY reference_date)"


_GROWTH = {"revenue": "net_revenue", "earnings": "net_income", "ebitda": "ebitda", "total_assets": "total_assets", "total_debt": "total_debt"}
_OLD = {"earnings": "net_income", "revenue": "net_revenue"}
#: Filings with growth, changes, scores and final five-year rates.
_FF = "f5 AS (SELECT *, equity / nullif(market_cap, 0) AS book_to_market, net_income / nullif(market_cap, 0) AS earnings_yield, cash / nullif(current_liabilities, 0) AS cash_ratio, net_debt / nullif(total_assets, 0) AS net_debt_to_assets, (current_assets - current_liabilities) / nullif(total_assets, 0) AS working_capital_ratio, " + ", ".join(
    f"{x} / nullif(lag({x}, 4) OVER w, 0) - 1 AS {k}_growth_yoy" for k, x in _GROWTH.items()) + ", debt_equity - lag(debt_equity) OVER w AS debt_equity_qoq, " + ", ".join(
    f"CASE WHEN lag({x}, 20) OVER w > 0 AND {x} > 0 THEN (pow({x} / lag({x}, 20) OVER w, 0.2) - 1) * 100 END AS {k}_rate" for k, x in _OLD.items()) + """,
    coalesce(roa > 0, false)::INT + coalesce(roa > lag(roa, 4) OVER w, false)::INT + coalesce(gross_margin > lag(gross_margin, 4) OVER w, false)::INT + coalesce(debt_equity < lag(debt_equity, 4) OVER w, false)::INT + coalesce(current_ratio > lag(current_ratio, 4) OVER w, false)::INT AS f_score,
    (row_number() OVER w > 20 AND (lag(net_income, 20) OVER w IS NULL OR lag(net_income, 20) OVER w <= 0))::INT AS had_negative_earnings_5y FROM filings WINDOW w AS (PARTITION BY ticker ORDER BY reference_date)),
    f6 AS (SELECT *, last_value(earnings_rate IGNORE NULLS) OVER y AS cagr_earnings_5y_calc, last_value(revenue_rate IGNORE NULLS) OVER y AS cagr_revenue_5y_calc FROM f5 WINDOW y AS (PARTITION BY ticker, year(reference_date) ORDER BY reference_date ROWS UNBOUNDED PRECEDING)),
    ff AS (SELECT *, coalesce(cagr_earnings_5y, cagr_earnings_5y_calc) AS cagr_earnings_5y_final, coalesce(cagr_revenue_5y, cagr_revenue_5y_calc) AS cagr_revenue_5y_final FROM f6)"""


@query("w14_filing_ratios", "ticker reference_date", "book_to_market cash_ratio net_debt_to_assets working_capital_ratio",
       "SELECT *, equity / nullif(market_cap, 0) AS book_to_market, cash / nullif(current_liabilities, 0) AS cash_ratio, net_debt / nullif(total_assets, 0) AS net_debt_to_assets, (current_assets - current_liabilities) / nullif(total_assets, 0) AS working_capital_ratio FROM fundamentals")
def w14(s, d):
    return features.filing_features(v.fundamentals(s, d))


@query("w15_growth_yoy", "ticker reference_date", "revenue_growth_yoy earnings_growth_yoy ebitda_growth_yoy",
       f"SELECT ticker, reference_date, net_revenue / nullif(lag(net_revenue, 4) OVER w, 0) - 1 AS revenue_growth_yoy, net_income / nullif(lag(net_income, 4) OVER w, 0) - 1 AS earnings_growth_yoy, ebitda / nullif(lag(ebitda, 4) OVER w, 0) - 1 AS ebitda_growth_yoy FROM fundamentals {_F}")
def w15(s, d):
    return features.filing_features(v.fundamentals(s, d))


@query("w16_changes_qoq", "ticker reference_date", "gross_margin_qoq net_margin_qoq roe_qoq current_ratio_qoq", "SELECT ticker, reference_date, " + ", ".join(f"{k} - lag({k}) OVER w AS {k}_qoq" for k in ("gross_margin", "net_margin", "roe", "current_ratio")) + f" FROM fundamentals {_F}")
def w16(s, d):
    return features.filing_features(v.fundamentals(s, d))


@query("w17_f_score", "ticker reference_date f_roa_positive f_roa_improving f_margin_improving f_leverage_decreasing f_liquidity_improving f_score", "",
       f"""SELECT *, f_roa_positive + f_roa_improving + f_margin_improving + f_leverage_decreasing + f_liquidity_improving AS f_score FROM (SELECT ticker, reference_date, coalesce(roa > 0, false)::INT AS f_roa_positive,
       coalesce(roa > lag(roa, 4) OVER w, false)::INT AS f_roa_improving, coalesce(gross_margin > lag(gross_margin, 4) OVER w, false)::INT AS f_margin_improving, coalesce(debt_equity < lag(debt_equity, 4) OVER w, false)::INT AS f_leverage_decreasing,
       coalesce(current_ratio > lag(current_ratio, 4) OVER w, false)::INT AS f_liquidity_improving FROM fundamentals {_F})""")  # fmt: skip
def w17(s, d):
    return features.filing_features(v.fundamentals(s, d))


@query("w18_cagr", "ticker reference_date had_negative_earnings_5y", "cagr_revenue_5y_calc cagr_earnings_5y_calc",
       """SELECT ticker, reference_date, neg AS had_negative_earnings_5y, last_value(r IGNORE NULLS) OVER y AS cagr_revenue_5y_calc, last_value(e IGNORE NULLS) OVER y AS cagr_earnings_5y_calc FROM (
       SELECT *, CASE WHEN lag(net_revenue, 20) OVER w > 0 AND net_revenue > 0 THEN (pow(net_revenue / lag(net_revenue, 20) OVER w, 0.2) - 1) * 100 END AS r, CASE WHEN lag(net_income, 20) OVER w > 0 AND net_income > 0 THEN (pow(net_income / lag(net_income, 20) OVER w, 0.2) - 1) * 100 END AS e,
       (row_number() OVER w > 20 AND (lag(net_income, 20) OVER w IS NULL OR lag(net_income, 20) OVER w <= 0))::INT AS neg FROM fundamentals WINDOW w AS (PARTITION BY ticker ORDER BY reference_date))
       WINDOW y AS (PARTITION BY ticker, year(reference_date) ORDER BY reference_date ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def w18(s, d):
    return features.filing_features(v.fundamentals(s, d))


@query("j01_asof_fundamentals", "ticker trade_date reference_date", "adj_close net_income roe",
       "SELECT p.ticker, trade_date, reference_date, adj_close, net_income, roe FROM prices p ASOF LEFT JOIN fundamentals f ON p.ticker = f.ticker AND p.trade_date >= f.reference_date")
def j01(s, d):
    return asof.asof_join(v.prices(s, d), v.fundamentals(s, d), ["ticker"], "trade_date", "reference_date")


@query("j02_asof_macro", "ticker trade_date reference_date", "selic ipca", "SELECT ticker, trade_date, reference_date, selic, ipca FROM prices p ASOF LEFT JOIN macro m ON p.trade_date >= m.reference_date")
def j02(s, d):
    return asof.asof_dates(v.prices(s, d), v.macro(s, d), "trade_date", "reference_date")


@query("j03_last_dividend", "ticker trade_date ex_date", "", "SELECT p.ticker, trade_date, ex_date, value_per_share FROM prices p ASOF LEFT JOIN dividends f ON p.ticker = f.ticker AND p.trade_date >= f.ex_date", plain="value_per_share")
def j03(s, d):
    return asof.asof_join(v.prices(s, d), v.dividends(s, d), ["ticker"], "trade_date", "ex_date")


@query("j05_trailing_dividends", "ticker trade_date n_events", "",
       "SELECT p.ticker, p.trade_date, count(x.ex_date) AS n_events, coalesce(sum(value_per_share), 0) AS sum_events FROM prices p LEFT JOIN dividends x ON p.ticker = x.ticker AND x.ex_date <= p.trade_date AND x.ex_date > p.trade_date - 252 GROUP BY ALL", plain="sum_events")
def j05(s, d):
    return asof.trailing_events(v.prices(s, d), v.dividends(s, d), "ticker", "trade_date", "ex_date", "value_per_share", 252)


@query("f01_covered_active", "ticker sector n", "", "SELECT ticker, sector, count(*) AS n FROM prices JOIN companies USING (ticker) WHERE status = 'ATIVO' AND ticker IN (SELECT ticker FROM fundamentals) GROUP BY ALL HAVING count(*) >= 10")
def f01(s, d):
    active = v.companies(s, d).where("status = 'ATIVO'")
    return v.prices(s, d).join(v.fundamentals(s, d).select("ticker").distinct(), "ticker", "left_semi").join(active, "ticker").groupBy("ticker", "sector").agg(F.count("*").alias("n")).where("n >= 10")


@query("u03_without_dividends", "ticker", "", "SELECT ticker FROM companies EXCEPT SELECT ticker FROM dividends WHERE ex_date < DATE '1992-06-01'")
def u03(s, d):
    """Companies without a dividend in the first months."""
    return v.companies(s, d).select("ticker").subtract(v.dividends(s, d).where("ex_date < '1992-06-01'").select("ticker"))


_XS = PRICE + ", xs AS (SELECT p.*, sector, " + ", ".join(f"{_full('sum', 'log_return', n)} AS return_{k}" for k, n in (("1m", 21), ("3m", 63), ("12m", 252))) + " FROM px p JOIN companies USING (ticker))"


@query("w36_momentum", "ticker trade_date", "momentum_vs_market_1m momentum_vs_sector_1m momentum_vs_market_3m momentum_vs_sector_3m momentum_vs_market_12m momentum_vs_sector_12m",
       "SELECT ticker, trade_date, " + ", ".join(f"return_{m} - avg(return_{m}) OVER (PARTITION BY trade_date) AS momentum_vs_market_{m}, return_{m} - avg(return_{m}) OVER (PARTITION BY trade_date, sector) AS momentum_vs_sector_{m}" for m in ("1m", "3m", "12m")) + " FROM xs", _XS)
def w36(s, d):
    p = features.price_features(v.prices(s, d)).join(v.companies(s, d), "ticker")
    return features.cross_section(p)


@query("w31_history_ranks", "ticker trade_date", "volatility_20d_percentile price_percentile_5y",
       """SELECT ticker, trade_date, CASE WHEN vol IS NOT NULL THEN (rank() OVER (PARTITION BY ticker ORDER BY vol NULLS LAST) + (count(vol) OVER (PARTITION BY ticker, vol) - 1) / 2.0::DOUBLE) / count(vol) OVER (PARTITION BY ticker) END AS volatility_20d_percentile,
       len(list_filter(held, lambda x: x <= adj_close))::DOUBLE / len(held) AS price_percentile_5y FROM (SELECT *, """ + _full("stddev_samp", "log_return", 20) + " AS vol, list(adj_close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 1259 PRECEDING AND CURRENT ROW) AS held FROM px)", PRICE)  # fmt: skip
def w31(s, d):
    return features.history_ranks(features.price_features(v.prices(s, d)).select("ticker", "trade_date", "adj_close", "volatility_20d"))


@query("w35_sector_rank", "ticker trade_date", "share", "SELECT ticker, trade_date, (rank() OVER (PARTITION BY trade_date, sector ORDER BY adj_close) + (count(*) OVER (PARTITION BY trade_date, sector, adj_close) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY trade_date, sector) AS share FROM prices JOIN companies USING (ticker)")
def w35(s, d):
    return v.prices(s, d).join(v.companies(s, d), "ticker").withColumn("share", rank_share(F.col("adj_close"), ["trade_date", "sector"]))


@query("q06_gaps_and_spikes", "ticker date check", "value",
       """SELECT ticker, trade_date AS date, 'date_gap' AS "check", gap::DOUBLE AS value FROM g WHERE gap > 10 UNION ALL SELECT ticker, trade_date, 'return_spike', log_return FROM g WHERE abs(log_return) > 0.35""",
       PRICE + ", g AS (SELECT *, trade_date - lag(trade_date) OVER (PARTITION BY ticker ORDER BY trade_date) AS gap FROM px)")
def q06(s, d):
    p = v.prices(s, d)
    return quality.date_gaps(p).unionByName(quality.return_spikes(p))



@query("a07_outliers", "ticker date", "value",
       "SELECT ticker, trade_date AS date, 0.6745::DOUBLE * (adj_close - med) / mad AS value FROM (SELECT a.*, median(away) OVER (PARTITION BY ticker) AS mad FROM (SELECT *, median(adj_close) OVER (PARTITION BY ticker) AS med, abs(adj_close - median(adj_close) OVER (PARTITION BY ticker)) AS away FROM prices) a) WHERE mad > 0 AND abs(0.6745::DOUBLE * (adj_close - med) / mad) > 1.5")
def a07(s, d):
    return quality.outliers(v.prices(s, d), limit=1.5)


@query("q02_price_gate", "check severity n_bad", "",
       """SELECT * FROM (SELECT 'close_not_positive' AS "check", 'error' AS severity, count(*) FILTER (close <= 0) AS n_bad FROM prices UNION ALL SELECT 'volume_negative', 'error', count(*) FILTER (volume < 0) FROM prices
       UNION ALL SELECT 'duplicate_key', 'warning', 0 UNION ALL SELECT 'gap_over_5d', 'warning', count(*) FILTER (gap > 5) FROM (SELECT trade_date - lag(trade_date) OVER (PARTITION BY ticker ORDER BY trade_date) AS gap FROM prices))""")  # fmt: skip
def q02(s, d):
    return quality.price_gate(v.prices(s, d))



def _market(s, d) -> DataFrame:
    """Equal-weight daily simple returns of two strategies: all active names, and those of AMERICA."""
    p = features.training_returns(v.prices(s, d)).join(v.companies(s, d), "ticker").where("returns IS NOT NULL")
    simple = F.expm1("returns")
    every = p.groupBy(F.col("trade_date").alias("date")).agg((F.avg(simple) / 10).alias("r")).select(F.lit("all").alias("strategy"), "date", "r")
    some = p.where("sector = 'AMERICA'").groupBy(F.col("trade_date").alias("date")).agg((F.avg(simple) / 10).alias("r")).select(F.lit("america").alias("strategy"), "date", "r")
    return every.union(some)


_M = PRICE + """, rr AS (SELECT trade_date AS date, sector, exp(log_return) - 1 AS s FROM px JOIN companies USING (ticker) WHERE abs(log_return) <= 1),
m AS (SELECT 'all' AS strategy, date, avg(s) / 10 AS r FROM rr GROUP BY date UNION ALL SELECT 'america', date, avg(s) / 10 FROM rr WHERE sector = 'AMERICA' GROUP BY date)"""


@query("m15_performance", "strategy n", "sharpe sortino win_rate mean t_naive cumulative_return max_drawdown annualized_return",
       """SELECT *, pow(1 + cumulative_return, 252.0::DOUBLE / n) - 1 AS annualized_return FROM (SELECT strategy, count(*) AS n, avg(r) / (stddev_pop(r) + 1e-12::DOUBLE) * sqrt(252) AS sharpe, avg(r) / (coalesce(stddev_pop(r) FILTER (r < 0), 0) + 1e-12::DOUBLE) * sqrt(252) AS sortino,
       avg((r > 0)::INT) AS win_rate, avg(r) AS mean, avg(r) / (stddev_samp(r) / sqrt(count(*))) AS t_naive, max_by(v, date) - 1 AS cumulative_return, max(1 - v / greatest(1, pk)) AS max_drawdown FROM (
       SELECT *, max(v) OVER (PARTITION BY strategy ORDER BY date) AS pk FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY date)) AS v FROM m)) GROUP BY strategy)""", _M)  # fmt: skip
def m15(s, d):
    return performance.metrics(_market(s, d))


@query("m12_hac_mean_test", "strategy n", "mean t_hac",
       "SELECT strategy, count(*) AS n, avg(r) AS mean, avg(r) / sqrt((sum(x * x) + " + " + ".join(f"2 * {1 - k / 6!r}::DOUBLE * sum(l{k})" for k in range(1, 6)) + ") / count(*) / count(*)) AS t_hac FROM (SELECT *, "
       + ", ".join(f"x * lag(x, {k}) OVER (PARTITION BY strategy ORDER BY date) AS l{k}" for k in range(1, 6)) + " FROM (SELECT *, r - avg(r) OVER (PARTITION BY strategy) AS x FROM m)) GROUP BY strategy", _M)
def m12(s, d):
    return performance.hac_t(_market(s, d), 5)


@query("m17_alpha_beta", "", "beta alpha correlation", "SELECT regr_slope(a.r, b.r) AS beta, regr_intercept(a.r, b.r) AS alpha, corr(a.r, b.r) AS correlation FROM m a JOIN m b USING (date) WHERE a.strategy = 'america' AND b.strategy = 'all'", _M)
def m17(s, d):
    m = _market(s, d)
    pairs = m.where("strategy = 'america'").select("date", F.col("r").alias("y")).join(m.where("strategy = 'all'").select("date", F.col("r").alias("x")), "date")
    return performance.alpha_beta(pairs, "y", "x")


@query("w44_daily_rank_ic", "trade_date n", "ic",
       """SELECT trade_date, count(*) AS n, CASE WHEN count(*) >= 10 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM (SELECT *, CASE WHEN f IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY f NULLS LAST) + (count(f) OVER (PARTITION BY trade_date, f) - 1) / 2.0::DOUBLE END AS a,
       CASE WHEN t IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY t NULLS LAST) + (count(t) OVER (PARTITION BY trade_date, t) - 1) / 2.0::DOUBLE END AS b FROM (SELECT *, """ + _full("sum", "log_return", 21) + """ AS f,
       ln(lead(adj_close, 5) OVER (PARTITION BY ticker ORDER BY trade_date) / adj_close) AS t FROM px)) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY trade_date""", PRICE)  # fmt: skip
def w44(s, d):
    p = performance.forward_return(features.price_features(v.prices(s, d)), 5)
    return performance.daily_rank_ic(p, "return_1m", "forward")


@query("k01_upsert", "ticker trade_date", "adj_close", "SELECT ticker, trade_date, CASE WHEN year(trade_date) >= 1996 THEN adj_close * 2 ELSE adj_close END AS adj_close FROM prices")
def k01(s, d):
    p = v.prices(s, d)
    return merged(p, p.where("year(trade_date) >= 1996").withColumn("adj_close", F.col("adj_close") * 2), ["ticker", "trade_date"])


def panel(s: SparkSession, d: str, history: bool = True, cross: bool = True) -> DataFrame:
    return build_panel(v.prices(s, d), v.filings(s, d), v.companies(s, d), v.macro(s, d), v.dividends(s, d), history=history, cross=cross)


@query("p00_build_panel", "ticker trade_date reference_date sector div_count_12m days_since_fundamental", "log_return ma_20 drawdown pl pvp selic excess_return div_yield_12m momentum_vs_market_1m pvp_zscore_sector",
       """SELECT *, CASE WHEN stddev_samp(pvp) OVER s > 0 THEN (pvp - avg(pvp) OVER s) / stddev_samp(pvp) OVER s END AS pvp_zscore_sector, log_return - selic / 252 AS excess_return, r1 - avg(r1) OVER (PARTITION BY trade_date) AS momentum_vs_market_1m FROM (
       SELECT a.ticker, a.trade_date, f.reference_date, a.sector, dv.n AS div_count_12m, a.trade_date - f.reference_date AS days_since_fundamental, log_return, ma_20, (adj_close - peak) / nullif(peak, 0) AS drawdown, pl * (close / close_price) AS pl,
       pvp * (close / close_price) AS pvp, selic, dsum / adj_close AS div_yield_12m, r1 FROM a ASOF LEFT JOIN fundamentals f ON a.ticker = f.ticker AND a.trade_date >= f.reference_date ASOF LEFT JOIN macro m ON a.trade_date >= m.reference_date JOIN dv ON dv.ticker = a.ticker AND dv.trade_date = a.trade_date) WINDOW s AS (PARTITION BY trade_date, sector)""",
       PRICE + ", a AS (SELECT px.*, sector, " + _full("avg", "adj_close", 20) + " AS ma_20, " + _full("sum", "log_return", 21) + """ AS r1 FROM px JOIN companies USING (ticker) WHERE status = 'ATIVO'),
       dv AS (SELECT p.ticker, p.trade_date, count(x.ex_date) AS n, coalesce(sum(value_per_share), 0) AS dsum FROM prices p LEFT JOIN dividends x ON p.ticker = x.ticker AND x.ex_date <= p.trade_date AND x.ex_date > p.trade_date - 252 GROUP BY ALL)""")  # fmt: skip
def p00(s, d):
    return panel(s, d, history=False)


def _returns(s, d) -> DataFrame:
    return features.training_returns(v.prices(s, d)).where("returns IS NOT NULL")


_R = PRICE + ", ret AS (SELECT ticker, trade_date, log_return AS returns FROM px WHERE abs(log_return) <= 1)"


@query("w23_macro_features", "ticker trade_date", "excess_return real_return selic_trend_20d",
       """SELECT ticker, trade_date, log_return - selic / 252 AS excess_return, log_return - ipca / 252 AS real_return, selic - lag(selic, 20) OVER (PARTITION BY ticker ORDER BY trade_date) AS selic_trend_20d
       FROM px ASOF LEFT JOIN macro m ON px.trade_date >= m.reference_date""", PRICE)  # fmt: skip
def w23(s, d):
    p = features.price_features(v.prices(s, d))
    return features.macro_features(asof.asof_dates(p, v.macro(s, d), "trade_date", "reference_date"))


@query("w40_cash_price", "reference_date", "price", "SELECT reference_date, 100 * exp(sum(ln(1 + selic / 100)) OVER (ORDER BY reference_date)) AS price FROM macro")
def w40(s, d):
    return performance.cash_price(v.macro(s, d))


@query("w46_rolling_sharpe", "strategy date", "sharpe", "SELECT strategy, date, CASE WHEN count(r) OVER w = 63 THEN avg(r) OVER w / (stddev_pop(r) OVER w + 1e-12::DOUBLE) * sqrt(252) END AS sharpe FROM m WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)", _M)
def w46(s, d):
    return performance.rolling_sharpe(_market(s, d), 63)


@query("w48_stale_prices", "ticker date", "value",
       """SELECT ticker, trade_date AS date, run::DOUBLE AS value FROM (SELECT *, sum(same) OVER (PARTITION BY ticker, island) AS run FROM (SELECT *, sum(1 - same) OVER (PARTITION BY ticker ORDER BY trade_date) AS island FROM (
       SELECT *, coalesce(close = lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) AND volume > 0, false)::INT AS same FROM flat))) WHERE same = 1 AND run >= 5""",
       "flat AS (SELECT ticker, trade_date, floor(close / 20000) AS close, volume FROM prices)")
def w48(s, d):
    return quality.stale_prices(v.prices(s, d).withColumn("close", F.floor(F.col("close") / 20000).cast("double")))


@query("w51_return_to_go", "strategy date", "to_go",
       "SELECT strategy, date, sum(r * pow(0.99::DOUBLE, k)) OVER (PARTITION BY strategy ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.99::DOUBLE, k) AS to_go FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS k FROM m)", _M)
def w51(s, d):
    return performance.return_to_go(_market(s, d), 0.99)


@query("a06_fences", "ticker n_low n_high", "q1 q3",
       "SELECT ticker, q1, q3, count(*) FILTER (adj_close < q1 - 0.75 * (q3 - q1)) AS n_low, count(*) FILTER (adj_close > q3 + 0.75 * (q3 - q1)) AS n_high FROM prices JOIN (SELECT ticker, quantile_cont(adj_close, 0.25) AS q1, quantile_cont(adj_close, 0.75) AS q3 FROM prices GROUP BY 1) USING (ticker) GROUP BY ALL")
def a06(s, d):
    return audit.fences(v.prices(s, d), "adj_close", width=0.75)


@query("a10_frozen_share", "n_groups n_frozen", "share",
       "SELECT count(*) AS n_groups, count(*) FILTER (k = 1) AS n_frozen, avg((k = 1)::INT) AS share FROM (SELECT count(DISTINCT roe) AS k FROM prices p ASOF JOIN fundamentals f ON p.ticker = f.ticker AND p.trade_date >= f.reference_date GROUP BY p.ticker, f.reference_date HAVING count(*) >= 5)")
def a10(s, d):
    panel_rows = asof.asof_join(v.prices(s, d), v.fundamentals(s, d), ["ticker"], "trade_date", "reference_date").where("reference_date IS NOT NULL")
    return audit.frozen_share(panel_rows, "roe", ["ticker", "reference_date"])


@query("a11_month_counts", "ticker month n", "",
       """SELECT ticker, month, coalesce(n, 0) AS n FROM (SELECT ticker, unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 MONTH))::DATE AS month FROM (SELECT ticker, date_trunc('month', trade_date) AS trade_date FROM prices) GROUP BY ticker)
       LEFT JOIN (SELECT ticker, date_trunc('month', trade_date)::DATE AS month, count(*) AS n FROM prices GROUP BY ALL) USING (ticker, month)""")  # fmt: skip
def a11(s, d):
    return audit.month_counts(v.prices(s, d))


@query("a12_health", "n_rows n_keys first_date last_date n_repeated", "null_share",
       "SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_keys, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) - count(DISTINCT ticker || '|' || trade_date) AS n_repeated, sum((log_return IS NULL)::INT) / count(*) / 3.0::DOUBLE AS null_share FROM px", PRICE)
def a12(s, d):
    return audit.health(features.price_features(v.prices(s, d)).select("ticker", "trade_date", "log_return"))


@query("a16_correlations", "a b", "correlation", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS correlation FROM fundamentals" for a, b in (("roe", "net_margin"), ("roe", "current_ratio"), ("net_margin", "current_ratio"))))
def a16(s, d):
    return audit.correlations(v.fundamentals(s, d), ["roe", "net_margin", "current_ratio"])


_WINDOWS = """wn AS (WITH RECURSIVE t AS (SELECT 0 AS window_id, min(trade_date) AS a, max(trade_date) AS z, (min(trade_date) + INTERVAL 2 YEAR)::DATE AS test_start FROM prices
    UNION ALL SELECT window_id + 1, a, z, (test_start + INTERVAL 1 YEAR + INTERVAL 1 DAY)::DATE FROM t WHERE test_start + INTERVAL 1 YEAR <= z)
    SELECT *, (test_start + INTERVAL 1 YEAR)::DATE AS test_end, test_start - 1 AS train_end FROM t WHERE test_start + INTERVAL 1 YEAR <= z)"""


def _windows(s, d) -> DataFrame:
    return portfolio.evaluation_windows(v.prices(s, d).agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end")), 2, 1)


@query("p01_evaluation_windows", "window_id train_start train_end val_start test_start test_end", "", "SELECT window_id, a AS train_start, train_end, train_end - greatest(floor((train_end - a) * 0.1)::INT, 1) + 1 AS val_start, test_start, test_end FROM wn", _WINDOWS)
def p01(s, d):
    return _windows(s, d)


@query("a18_scalers", "window_id feature n", "mean std",
       " UNION ALL ".join(f"SELECT window_id, '{k}' AS feature, count({k}) AS n, avg({k}) AS mean, CASE WHEN stddev_pop({k}) < 1e-12 THEN 1 ELSE stddev_pop({k}) END AS std FROM px JOIN wn ON trade_date <= train_end WHERE {k} IS NOT NULL GROUP BY window_id" for k in ("adj_close", "log_return")), PRICE + ", " + _WINDOWS)
def a18(s, d):
    return audit.scalers(features.price_features(v.prices(s, d)), ["adj_close", "log_return"], _windows(s, d).withColumnRenamed("train_end", "cutoff"))


@query("a25_top_and_other", "trade_date ticker", "volume", "SELECT trade_date, CASE WHEN k <= 3 THEN ticker ELSE 'Other' END AS ticker, sum(volume) AS volume FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, ticker) AS k FROM prices) GROUP BY ALL")
def a25(s, d):
    return audit.top_and_other(v.prices(s, d), "ticker", "volume", 3, "trade_date")


@query("j06_difference", "side n", "max_abs",
       """SELECT CASE WHEN b.x IS NULL THEN 'left' WHEN a.adj_close IS NULL THEN 'right' ELSE 'both' END AS side, count(*) AS n, max(abs(adj_close - x)) AS max_abs FROM (SELECT * FROM prices WHERE month(trade_date) <> 2) a
       FULL JOIN (SELECT ticker, trade_date, high AS x FROM prices WHERE month(trade_date) <> 3) b USING (ticker, trade_date) GROUP BY 1""")  # fmt: skip
def j06(s, d):
    p = v.prices(s, d)
    return audit.difference(p.where("month(trade_date) <> 2"), p.where("month(trade_date) <> 3").withColumn("adj_close", F.col("high")), ["ticker", "trade_date"], "adj_close")


_IV = _R + """, iv AS (SELECT ticker, trade_date, coalesce(i / sum(i) OVER (PARTITION BY trade_date), 0) AS w FROM (SELECT *, CASE WHEN sd > 1e-8 THEN 1 / sd END AS i FROM (
    SELECT *, stddev_pop(returns) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS sd FROM ret)))"""


@query("p09_inverse_volatility", "ticker trade_date", "w", "SELECT * FROM iv", _IV)
def p09(s, d):
    return portfolio.inverse_volatility(_returns(s, d))


@query("w49_turnover", "trade_date", "turnover",
       """SELECT trade_date, sum(abs(x)) AS turnover FROM (SELECT i, ticker, sum(w) AS x FROM (SELECT i, ticker, w FROM iv JOIN dd USING (trade_date) UNION ALL SELECT i + 1, ticker, -w FROM iv JOIN dd USING (trade_date)) GROUP BY ALL) JOIN dd USING (i) GROUP BY trade_date""",
       _IV + ", dd AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM iv))")
def w49(s, d):
    return portfolio.turnover(portfolio.inverse_volatility(_returns(s, d)).select("trade_date", "ticker", "w"))


@query("m14_effective_positions", "", "n_effective", "SELECT avg(1 / greatest(h, 1e-12)) AS n_effective FROM (SELECT sum(w * w) AS h FROM iv GROUP BY trade_date)", _IV)
def m14(s, d):
    by_day = portfolio.inverse_volatility(_returns(s, d)).groupBy("trade_date").agg(F.sum(F.col("w") * F.col("w")).alias("h"))
    return by_day.agg(F.avg(1 / F.greatest("h", F.lit(1e-12))).alias("n_effective"))


_SOFT = _R + ", sm AS (SELECT ticker, trade_date, exp(4 * returns) / sum(exp(4 * returns)) OVER (PARTITION BY trade_date) AS w FROM ret)"


@query("p05_softmax_weights", "ticker trade_date", "w", "SELECT * FROM sm", _SOFT)
def p05(s, d):
    return portfolio.softmax_weights(_returns(s, d), "returns", 0.25)


@query("p06_capped_weights", "ticker trade_date", "w",
       """SELECT ticker, trade_date, h / sum(h) OVER (PARTITION BY trade_date) AS w FROM (SELECT *, least(0.1::DOUBLE, w + coalesce(level, 1)) AS h FROM sm JOIN (SELECT trade_date, min_by(level, k) FILTER (w + level <= 0.1::DOUBLE + 1e-12::DOUBLE) AS level FROM (
       SELECT *, (above - k * 0.1::DOUBLE) / (n - k) AS level FROM (SELECT *, row_number() OVER f - 1 AS k, sum(w) OVER f - w AS above, count(*) OVER (PARTITION BY trade_date) AS n FROM sm WINDOW f AS (PARTITION BY trade_date ORDER BY w DESC, ticker ROWS UNBOUNDED PRECEDING))) GROUP BY trade_date) USING (trade_date))""", _SOFT)  # fmt: skip
def p06(s, d):
    return portfolio.capped(portfolio.softmax_weights(_returns(s, d), "returns", 0.25), 0.1)


@query("t04_top_share", "ticker trade_date", "w",
       """SELECT ticker, trade_date, CASE WHEN place <= chosen THEN 1.0::DOUBLE / chosen ELSE 0 END AS w FROM (SELECT *, CASE WHEN greatest(floor(n * 0.2::DOUBLE), 1) < 3 THEN n ELSE greatest(floor(n * 0.2::DOUBLE), 1) END AS chosen FROM (
       SELECT *, count(*) OVER (PARTITION BY trade_date) AS n, row_number() OVER (PARTITION BY trade_date ORDER BY returns DESC, ticker) AS place FROM ret))""", _R)  # fmt: skip
def t04(s, d):
    return portfolio.top_share(_returns(s, d), "returns", least=3)


@query("m16_attribution", "strategy", "carry market selection total mean_cash",
       """SELECT 'america' AS strategy, exp(sum(ln(1 + 0.2::DOUBLE * rf))) - 1 AS carry, exp(sum(ln(1 + 0.8::DOUBLE * b))) - 1 AS market, exp(sum(ln(1 + a - 0.2::DOUBLE * rf - 0.8::DOUBLE * b))) - 1 AS selection, exp(sum(ln(1 + a))) - 1 AS total, 0.2::DOUBLE AS mean_cash
       FROM (SELECT x.r AS a, y.r AS b, selic / 100 AS rf FROM m x JOIN m y USING (date) JOIN macro ON reference_date = date WHERE x.strategy = 'america' AND y.strategy = 'all')""", _M)  # fmt: skip
def m16(s, d):
    m = _market(s, d)
    own, every = m.where("strategy = 'america'"), m.where("strategy = 'all'").select("date", F.col("r").alias("b"))
    days = own.join(every, "date").join(v.macro(s, d).withColumnRenamed("reference_date", "date"), "date")
    return portfolio.attribution(days.select("strategy", F.log1p("r").alias("agent_log"), F.lit(0.2).alias("cash_w"), F.log1p(F.col("selic") / 100).alias("selic_log"), F.log1p("b").alias("ew_log")))


@query("a21_ic_summary", "n", "mean std t_naive t_apart",
       """SELECT count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_naive, avg(ic) FILTER (i % 5 = 0) / (stddev_samp(ic) FILTER (i % 5 = 0) / sqrt(count(*) FILTER (i % 5 = 0))) AS t_apart
       FROM (SELECT *, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM (SELECT trade_date, corr(adj_close, volume) AS ic FROM prices GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(adj_close) > 0 AND stddev_pop(volume) > 0))""")  # fmt: skip
def a21(s, d):
    daily = v.prices(s, d).groupBy("trade_date").agg(F.when(F.count("*") >= 3, correlation("adj_close", "volume")).alias("ic"))
    return audit.ic_summary(daily, 5)


@query("m09_probabilistic_sharpe", "strategy n", "psr", None)
def m09(s, d):
    """Without SQL: DuckDB has no normal distribution."""
    return performance.probabilistic_sharpe(_market(s, d))


_JOINED = """gf AS (SELECT *, net_revenue / nullif(lag(net_revenue, 4) OVER w, 0) - 1 AS rg, net_income / nullif(lag(net_income, 4) OVER w, 0) - 1 AS eg FROM fundamentals WINDOW w AS (PARTITION BY ticker ORDER BY reference_date)),
    jf AS (SELECT p.ticker, p.trade_date, f.* EXCLUDE (ticker), selic FROM prices p ASOF LEFT JOIN gf f ON p.ticker = f.ticker AND p.trade_date >= f.reference_date ASOF LEFT JOIN macro m ON p.trade_date >= m.reference_date)"""


@query("w29_valuation_ratios", "ticker trade_date", "revenue_per_earning ebitda_margin peg_ratio pvp_to_roe_ratio earnings_yield earnings_yield_vs_selic revenue_vs_earnings_growth_delta",
       """SELECT ticker, trade_date, net_revenue / (net_income + 1e-8::DOUBLE) AS revenue_per_earning, ebitda / (net_revenue + 1e-8::DOUBLE) AS ebitda_margin, pl / (eg * 100 + 1e-8::DOUBLE) AS peg_ratio, pvp / (roe + 1e-8::DOUBLE) AS pvp_to_roe_ratio,
       1 / (pl + 1e-8::DOUBLE) AS earnings_yield, 1 / (pl + 1e-8::DOUBLE) - selic / 100 AS earnings_yield_vs_selic, rg - eg AS revenue_vs_earnings_growth_delta FROM jf""", _JOINED)  # fmt: skip
def w29(s, d):
    p = asof.asof_join(v.prices(s, d), features.filing_features(v.fundamentals(s, d)), ["ticker"], "trade_date", "reference_date")
    return features.valuation_ratios(asof.asof_dates(p, v.macro(s, d).withColumnRenamed("reference_date", "macro_date"), "trade_date", "macro_date"))


@query("w38_filing_trends", "ticker trade_date", "roe_trend net_margin_trend debt_equity_trend roa_trend",
       "SELECT ticker, trade_date, " + ", ".join(f"{k} - lag({k}, 4) OVER w AS {k}_trend" for k in ("roe", "net_margin", "debt_equity", "roa")) + " FROM jf WINDOW w AS (PARTITION BY ticker ORDER BY reference_date NULLS LAST, trade_date)", _JOINED)
def w38(s, d):
    names = {f"{k}_trend": k for k in ("roe", "net_margin", "debt_equity", "roa")}
    return features.filing_trends(asof.asof_join(v.prices(s, d), v.fundamentals(s, d), ["ticker"], "trade_date", "reference_date"), names)
