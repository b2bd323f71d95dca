"""Queries of training tables, significance and statements, registered beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.catalog import _IV, _M, _R, _SOFT, _WINDOWS, ORACLE_SQL, PRICE, _market, _returns, _windows, query
from panelspark.operators import asof, audit, features, performance, portfolio, quality, ranking, significance, statements, training
from panelspark.sources import files, outputs
from panelspark.sources import views as v

_CASH = """cd AS (SELECT trade_date, coalesce(selic, 0) AS selic FROM (SELECT DISTINCT trade_date FROM prices) ASOF LEFT JOIN macro m ON trade_date >= m.reference_date),
    ch AS (SELECT 'CASH' AS ticker, trade_date, 100 * exp(sum(ln(1 + selic / 100)) OVER (ORDER BY trade_date)) AS adj_close FROM cd)"""


def _training(s, d) -> DataFrame:
    return training.with_cash(v.prices(s, d), v.macro(s, d))


@query("d05_training_panel", "ticker trade_date", "adj_close volume", "SELECT ticker, trade_date, adj_close, volume FROM prices UNION ALL SELECT ticker, trade_date, adj_close, NULL FROM ch", _CASH)
def d05(s, d):
    return _training(s, d)


@query("q11_cash_gate", "n passed", "annualized", "SELECT *, annualized BETWEEN 0.01 AND 0.3 AS passed FROM (SELECT count(*) AS n, pow(max_by(adj_close, trade_date) / min_by(adj_close, trade_date), 252.0::DOUBLE / (count(*) - 1)) - 1 AS annualized FROM ch)", _CASH)
def q11(s, d):
    return training.cash_gate(_training(s, d))


@query("t02_universe", "ticker", "mean_size", "SELECT ticker, avg(volume) AS mean_size FROM prices GROUP BY ticker HAVING count(*) >= 252 ORDER BY mean_size DESC, ticker LIMIT 50")
def t02(s, d):
    return training.largest_universe(v.prices(s, d), "volume", 50)


@query("d06_scaled_features", "ticker trade_date feature", "value",
       " UNION ALL ".join(f"SELECT ticker, trade_date, '{k}' AS feature, coalesce(CASE WHEN {k} IS NOT NULL THEN greatest(-10, least(10, ({k} - mean) / std)) END, 0) AS value FROM px LEFT JOIN sc ON feature = '{k}'" for k in ("adj_close", "log_return")),
       PRICE + ", " + _WINDOWS + ", sc AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, avg({k}) AS mean, CASE WHEN stddev_pop({k}) < 1e-12 THEN 1 ELSE stddev_pop({k}) END AS std FROM px JOIN wn ON trade_date <= train_end WHERE window_id = 0 AND {k} IS NOT NULL" for k in ("adj_close", "log_return")) + ")")
def d06(s, d):
    p = features.price_features(v.prices(s, d))
    both = ["adj_close", "log_return"]
    return training.scaled(p, both, audit.scalers(p, both, _windows(s, d).withColumnRenamed("train_end", "cutoff")), 0)


@query("p04_market_return", "trade_date n", "ew_log", "SELECT trade_date, count(*) AS n, ln(1 + greatest(avg(exp(coalesce(CASE WHEN abs(log_return) <= 1 THEN log_return END, 0)) - 1), -0.9999::DOUBLE)) AS ew_log FROM px GROUP BY trade_date", PRICE)
def p04(s, d):
    return training.market_return(features.training_returns(v.prices(s, d)))


_SZ = """sz AS (SELECT ticker, trade_date, coalesce(x / sum(x) OVER (PARTITION BY trade_date), 0) AS w FROM (SELECT p.ticker, trade_date, market_cap AS x FROM prices p ASOF LEFT JOIN fundamentals f ON p.ticker = f.ticker AND p.trade_date >= f.reference_date))"""


def _sized(s, d) -> DataFrame:
    return training.size_weights(asof.asof_join(v.prices(s, d), v.fundamentals(s, d), ["ticker"], "trade_date", "reference_date"), "market_cap")


@query("p09_size_weights", "ticker trade_date", "w", "SELECT * FROM sz", _SZ)
def p09_size(s, d):
    return _sized(s, d)


@query("p09_blend", "ticker trade_date", "w", "SELECT ticker, trade_date, w * 0.7::DOUBLE AS w FROM iv UNION ALL SELECT DISTINCT 'CASH', trade_date, 0.3::DOUBLE FROM iv", _IV)
def p09_blend(s, d):
    return training.blended(portfolio.inverse_volatility(_returns(s, d)), 0.3)


@query("p11_excess", "strategy date", "r", "SELECT a.strategy, date, a.r - b.r AS r FROM m a JOIN m b USING (date) WHERE a.strategy = 'america' AND b.strategy = 'all'", _M)
def p11(s, d):
    return significance.excess(_market(s, d), "all")


@query("p13_walk_forward", "strategy date window_id", "value", "SELECT strategy, date, window_id, 100000 * exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY date)) AS value FROM m JOIN wn ON date BETWEEN test_start AND test_end", _M + ", " + _WINDOWS)
def p13(s, d):
    return training.stitched(training.tagged(_market(s, d), _windows(s, d), "date", "test_start", "test_end", "window_id"))


@query("a19_window_summary", "strategy n_windows", "mean std least most",
       "SELECT strategy, count(*) AS n_windows, avg(s) AS mean, stddev_pop(s) AS std, min(s) AS least, max(s) AS most FROM (SELECT strategy, window_id, avg(r) / (stddev_pop(r) + 1e-12::DOUBLE) * sqrt(252) AS s FROM m JOIN wn ON date BETWEEN test_start AND test_end GROUP BY ALL) GROUP BY strategy", _M + ", " + _WINDOWS)
def a19(s, d):
    return training.summary_of_windows(training.tagged(_market(s, d), _windows(s, d), "date", "test_start", "test_end", "window_id"))


@query("p14_retrain_days", "trade_date i", "", "SELECT trade_date, i FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM prices)) WHERE i % 63 = 0 OR i = n - 1")
def p14(s, d):
    return training.retrain_days(v.prices(s, d))


@query("p15_allocation", "ticker as_of days_old stale", "w", "SELECT ticker, w, trade_date AS as_of, DATE '1999-03-03' - trade_date AS days_old, DATE '1999-03-03' - trade_date > 5 AS stale FROM sm WHERE trade_date = (SELECT max(trade_date) FROM sm WHERE trade_date <= DATE '1999-03-03') AND w > 1e-6", _SOFT)
def p15(s, d):
    return training.allocation(portfolio.softmax_weights(_returns(s, d), "returns", 0.25), "1999-03-03")


@query("a15_sector_weights", "trade_date sector", "w", "SELECT trade_date, sector, sum(w) AS w FROM sm JOIN companies USING (ticker) GROUP BY ALL", _SOFT)
def a15(s, d):
    return training.sector_weights(portfolio.softmax_weights(_returns(s, d), "returns", 0.25), v.companies(s, d))


@query("a28_weight_changes", "ticker change", "first_w second_w",
       """SELECT *, CASE WHEN first_w = 0 THEN 'entered' WHEN second_w = 0 THEN 'exited' ELSE 'resized' END AS change FROM (SELECT ticker, coalesce(sum(w) FILTER (trade_date = a), 0) AS first_w, coalesce(sum(w) FILTER (trade_date = b), 0) AS second_w
       FROM sm, (SELECT max(trade_date) FILTER (year(trade_date) = 1996) AS a, max(trade_date) FILTER (year(trade_date) = 1999) AS b FROM sm) WHERE trade_date IN (a, b) GROUP BY ticker) WHERE abs(second_w - first_w) > 0.001""", _SOFT)  # fmt: skip
def a28(s, d):
    w = portfolio.softmax_weights(_returns(s, d), "returns", 0.25)
    last = lambda y: F.max(F.when(F.year("trade_date") == y, F.col("trade_date")))
    return training.weight_changes(w.select("ticker", "trade_date", "w"), _returns(s, d).agg(last(1996).alias("a"), last(1999).alias("b")))


@query("m20_concentration", "trade_date", "entropy top", "SELECT trade_date, -sum(CASE WHEN w > 0 THEN w * ln(w) ELSE 0 END) AS entropy, max(w) AS top FROM sm GROUP BY trade_date", _SOFT)
def m20(s, d):
    return training.concentration(portfolio.softmax_weights(_returns(s, d), "returns", 0.25))


_FWD = """di AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM prices)),
    fwd AS (SELECT px.*, CASE WHEN px.adj_close > 0 AND q.adj_close > 0 THEN ln(q.adj_close / px.adj_close) END AS forward FROM px JOIN di USING (trade_date) LEFT JOIN (SELECT ticker, adj_close, i FROM prices JOIN di USING (trade_date)) q ON q.ticker = px.ticker AND q.i = di.i + 5)"""


@query("w41_market_forward", "ticker trade_date", "forward", "SELECT ticker, trade_date, forward FROM fwd", PRICE + ", " + _FWD)
def w41(s, d):
    return training.market_forward(v.prices(s, d), 5)


def _ic_sql(k: str) -> str:
    rank = lambda x: f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY trade_date, {x}) - 1) / 2.0::DOUBLE END"
    return f"SELECT '{k}' AS feature, year(trade_date) // 5 * 5 AS period, corr(a, b) AS ic FROM (SELECT trade_date, {rank(k)} AS a, {rank('forward')} AS b FROM fwd) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY trade_date HAVING count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0"


@query("a21_signal_report", "feature period n", "mean std t", "SELECT feature, period::INT AS period, count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)) AS t FROM ics GROUP BY ROLLUP (feature, period) HAVING feature IS NOT NULL",
       PRICE + ", " + _FWD + ", ics AS (" + " UNION ALL ".join(_ic_sql(k) for k in ("volume", "spread")) + ")")
def a21r(s, d):
    p = training.market_forward(features.price_features(v.prices(s, d)), 5).withColumn("spread", F.col("high") - F.col("low"))
    return training.signal_report(p, ["volume", "spread"], "forward", 3)


ORACLE_SQL["a21_signal_report"] = ORACLE_SQL["a21_signal_report"].replace("SELECT px.*, CASE", "SELECT px.*, px.high - px.low AS spread, CASE")


@query("f10_varying", "feature", "", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS feature FROM fundamentals HAVING min({k}) < max({k})" for k in ("roe", "pvp", "net_margin", "debt_equity")) + ")")
def f10(s, d):
    return training.varying(v.fundamentals(s, d), ["roe", "pvp", "net_margin", "debt_equity"])


@query("p12_random_null", "strategy n", "s",
       """SELECT 'random' || run AS strategy, count(*) AS n, avg(r) / stddev_pop(r) AS s FROM (SELECT run, trade_date, sum(u * x) / sum(u) AS r FROM (SELECT *, ('0x' || md5('0|' || run || '|' || trade_date || '|' || ticker)[1:8])::BIGINT::DOUBLE + 1 AS u
       FROM (SELECT ticker, trade_date, exp(returns) - 1 AS x, unnest(range(20)) AS run FROM ret)) GROUP BY ALL) GROUP BY run""", _R)  # fmt: skip
def p12(s, d):
    """Daily Sharpe ratios of 20 random portfolios."""
    r = training.random_portfolios(_returns(s, d), 20)
    return r.groupBy("strategy").agg(F.count("*").alias("n"), F.try_divide(F.avg("r"), F.stddev_pop("r")).alias("s"))


@query("p12_random_null_200", "strategy n", "s", """SELECT 'random' || run AS strategy, count(*) AS n, avg(r) / stddev_pop(r) AS s FROM (SELECT run, trade_date, sum(u * x) / sum(u) AS r FROM (SELECT *, ('0x' || md5('0|' || run || '|' || trade_date || '|' || ticker)[1:8])::BIGINT::DOUBLE + 1 AS u
       FROM (SELECT ticker, trade_date, exp(returns) - 1 AS x, unnest(range(200)) AS run FROM ret)) GROUP BY ALL) GROUP BY run""", _R)  # fmt: skip
def p12_200(s, d):
    """Daily Sharpe ratios of 200 random portfolios, the whole null distribution; `p12_random_null` keeps its 20, as its SQL does."""
    r = training.random_portfolios(_returns(s, d))
    return r.groupBy("strategy").agg(F.count("*").alias("n"), F.try_divide(F.avg("r"), F.stddev_pop("r")).alias("s"))


@query("m13_bootstrap", "strategy n", "mean low high",
       """SELECT strategy, any_value(n) AS n, any_value(mu) AS mean, quantile_cont(b, 0.025) AS low, quantile_cont(b, 0.975) AS high FROM (SELECT dr.strategy, rs, any_value(n) AS n, any_value(mu) AS mu, sum(z.p - coalesce(a.p, 0)) / any_value(n) AS b FROM dr
       LEFT JOIN ps a ON a.strategy = dr.strategy AND a.i = dr.start JOIN ps z ON z.strategy = dr.strategy AND z.i = dr.start + least(ln_, n - k * ln_) GROUP BY ALL) GROUP BY strategy""",
       _M + """, ps AS (SELECT strategy, row_number() OVER w AS i, sum(r) OVER w AS p, r FROM m WINDOW w AS (PARTITION BY strategy ORDER BY date)), sn AS (SELECT strategy, max(i) AS n, avg(r) AS mu, least(21, max(i)) AS ln_ FROM ps GROUP BY strategy),
       d0 AS (SELECT *, unnest(range(2000)) AS rs FROM sn), d1 AS (SELECT *, unnest(range(ceil(n / ln_)::BIGINT)) AS k FROM d0),
       dr AS (SELECT *, ('0x' || md5('0|' || strategy || '|' || rs || '|' || k)[1:8])::BIGINT % (n - ln_ + 1) AS start FROM d1)""")  # fmt: skip
def m13(s, d):
    return significance.bootstrap_mean(_market(s, d), 21)


@query("m19_two_sample", "feature n_first n_second", "ks",
       "SELECT feature, na AS n_first, nb AS n_second, max(abs(fa / na - fb / nb)) AS ks FROM (SELECT feature, sum(1 - b) OVER w AS fa, sum(b) OVER w AS fb, sum(1 - b) OVER (PARTITION BY feature) AS na, sum(b) OVER (PARTITION BY feature) AS nb FROM k2 WINDOW w AS (PARTITION BY feature ORDER BY x)) GROUP BY ALL",
       PRICE + ", k2 AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, {k} AS x, (year(trade_date) >= 1998)::INT AS b FROM px WHERE {k} IS NOT NULL" for k in ("adj_close", "log_return")) + ")")
def m19(s, d):
    p = features.price_features(v.prices(s, d)).select((F.year("trade_date") >= 1998).alias("second"), "adj_close", "log_return")
    return significance.two_sample_ks(p.unpivot(["second"], ["adj_close", "log_return"], "feature", "x"))


@query("a22_share_below", "name", "value percent", "SELECT name, value, 100 * avg((x < value)::INT) AS percent FROM (SELECT strategy AS name, avg(r) / stddev_pop(r) AS value FROM m GROUP BY 1), (SELECT avg(exp(log_return) - 1) / nullif(stddev_pop(exp(log_return) - 1), 0) AS x FROM px WHERE abs(log_return) <= 1 GROUP BY ticker) WHERE x IS NOT NULL GROUP BY ALL", _M)
def a22(s, d):
    every = _returns(s, d).select("ticker", F.expm1("returns").alias("r"))
    return significance.share_below(significance.daily_sharpe(_market(s, d)).toDF("name", "value"), significance.daily_sharpe(every, "ticker").toDF("ticker", "x"))


@query("s18_split_adjusted", "ticker trade_date", "close split_factor",
       "SELECT *, c0 * split_factor AS close FROM (SELECT p.ticker, trade_date, any_value(close) AS c0, exp(coalesce(sum(ln(1 + value_per_share / 1000)), 0)) AS split_factor FROM prices p LEFT JOIN dividends s ON s.ticker = p.ticker AND ex_date > trade_date GROUP BY ALL)")
def s18(s, d):
    splits = v.dividends(s, d).select("ticker", F.col("ex_date").alias("split_date"), (1 + F.col("value_per_share") / 1000).alias("ratio"))
    return statements.split_adjusted(v.prices(s, d), splits, ["close"])


@query("s19_trailing_year", "ticker reference_date close_date", "net_revenue_ttm net_income_ttm last_close",
       """SELECT f.ticker, reference_date, p.trade_date AS close_date, p.close AS last_close, net_revenue_ttm, net_income_ttm FROM (SELECT *, CASE WHEN count(*) OVER w = 4 THEN sum(net_revenue) OVER w / 1000 END AS net_revenue_ttm, CASE WHEN count(*) OVER w = 4 THEN sum(net_income) OVER w / 1000 END AS net_income_ttm
       FROM fundamentals WINDOW w AS (PARTITION BY ticker ORDER BY reference_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) f ASOF LEFT JOIN prices p ON p.ticker = f.ticker AND f.reference_date >= p.trade_date""")  # fmt: skip
def s19(s, d):
    return statements.with_last_close(statements.trailing_year(v.fundamentals(s, d), ["net_revenue", "net_income"]), v.prices(s, d))


_ST = "st AS (SELECT *, q AS shares, ebitda - 0.05::DOUBLE * total_assets AS ebit, 0.7::DOUBLE * total_assets AS cost_of_revenue, close_price * q AS cap, total_debt - cash AS debt FROM fundamentals)"
_RATIOS = {
    "lpa": "net_income * 1000 / nullif(shares, 0)", "vpa": "equity * 1000 / nullif(shares, 0)", "pl": "cap / nullif(net_income * 1000, 0)", "pvp": "cap / nullif(equity * 1000, 0)", "p_sr": "cap / nullif(net_revenue * 1000, 0)",
    "p_assets": "cap / nullif(total_assets * 1000, 0)", "p_ebit": "cap / nullif(ebit * 1000, 0)", "p_ebitda": "cap / nullif(ebitda * 1000, 0)", "ev_ebit": "(cap + debt * 1000) / nullif(ebit * 1000, 0)", "ev_ebitda": "(cap + debt * 1000) / nullif(ebitda * 1000, 0)",
    "roe": "net_income / nullif(equity, 0) * 100", "roa": "net_income / nullif(total_assets, 0) * 100", "roic": "ebit / nullif(total_debt + equity - cash, 0) * 100", "net_margin": "net_income / nullif(net_revenue, 0) * 100", "ebit_margin": "ebit / nullif(net_revenue, 0) * 100",
    "ebitda_margin": "ebitda / nullif(net_revenue, 0) * 100", "gross_margin": "(net_revenue - cost_of_revenue) / nullif(net_revenue, 0) * 100", "ebit_over_assets": "ebit / nullif(total_assets, 0) * 100", "asset_turnover": "net_revenue / nullif(total_assets, 0)", "current_ratio": "current_assets / nullif(current_liabilities, 0)",
    "debt_equity": "total_debt / nullif(equity, 0)", "net_debt_equity": "debt / nullif(equity, 0)", "net_debt_ebit": "debt / nullif(ebit, 0)", "net_debt_ebitda": "debt / nullif(ebitda, 0)", "market_cap": "cap", "net_debt": "debt",
}


def _statements(s, d) -> DataFrame:
    c = F.col
    return v.fundamentals(s, d).withColumns({"shares": c("q"), "ebit": c("ebitda") - 0.05 * c("total_assets"), "cost_of_revenue": 0.7 * c("total_assets")})


@query("x13_statement_ratios", "ticker reference_date", " ".join(f"s_{k}" for k in _RATIOS), "SELECT ticker, reference_date, " + ", ".join(f"{x} AS s_{k}" for k, x in _RATIOS.items()) + " FROM st", _ST)
def x13(s, d):
    return statements.statement_ratios(_statements(s, d))


_JS = _ST + """, js AS (SELECT p.ticker, trade_date, close, f.* EXCLUDE (ticker), x.value_per_share FROM prices p ASOF LEFT JOIN st f ON p.ticker = f.ticker AND p.trade_date >= f.reference_date ASOF LEFT JOIN dividends x ON p.ticker = x.ticker AND p.trade_date >= x.ex_date)"""


def _with_statements(s, d) -> DataFrame:
    p = asof.asof_join(v.prices(s, d), _statements(s, d), ["ticker"], "trade_date", "reference_date")
    return asof.asof_join(p, v.dividends(s, d), ["ticker"], "trade_date", "ex_date")


@query("w26_enterprise_multiple", "ticker trade_date", "ev_ebit", "SELECT ticker, trade_date, (market_cap * (close / close_price) + net_debt) / nullif((market_cap + net_debt) / ((market_cap + net_debt) / nullif(ebit, 0)), 0) AS ev_ebit FROM js", _JS)
def w26(s, d):
    p = _with_statements(s, d)
    return statements.enterprise_multiples(p.withColumn("ev_ebit", F.try_divide(F.col("market_cap") + F.col("net_debt"), F.col("ebit"))))


@query("w28_suspected_splits", "ticker", "", "SELECT DISTINCT ticker FROM js WHERE trade_date - reference_date BETWEEN 0 AND 7 AND NOT close / close_price BETWEEN 1 / 1.5::DOUBLE AND 1.5", _JS)
def w28(s, d):
    return statements.suspected_splits(_with_statements(s, d))


@query("w29_payout", "ticker trade_date", "payout_ratio dividend_coverage_ratio", "SELECT ticker, trade_date, value_per_share / (net_income / q + 1e-8::DOUBLE) AS payout_ratio, ebitda / (value_per_share * q + 1e-8::DOUBLE) AS dividend_coverage_ratio FROM js", _JS)
def w29p(s, d):
    return statements.payout_ratios(_with_statements(s, d).withColumn("lpa", F.try_divide(F.col("net_income"), F.col("q"))))


_KN = """kn AS (SELECT min(reference_date) AS date, sum(avg(ipca)) OVER (ORDER BY date_trunc('month', reference_date)) AS level FROM macro GROUP BY date_trunc('month', reference_date)),
    ix AS (SELECT reference_date AS date, coalesce(a.level + (b.level - a.level) * (reference_date - a.date) / nullif(b.date - a.date, 0), a.level) AS level FROM macro ASOF LEFT JOIN kn a ON reference_date >= a.date ASOF LEFT JOIN kn b ON reference_date <= b.date)"""


def _index(s, d) -> DataFrame:
    m = v.macro(s, d)
    month = m.groupBy(F.trunc("reference_date", "month").alias("_m")).agg(F.min("reference_date").alias("date"), F.avg("ipca").alias("_x"))
    knots = month.select("date", F.sum("_x").over(statements.Window.orderBy("_m")).alias("value"))
    return statements.interpolated(m.select(F.col("reference_date").alias("date")), knots, "level")


@query("m23_real_total_return", "ticker date", "real total",
       """SELECT ticker, date, real, real * (1 + coalesce(sum(paid / nullif(real, 0)) OVER (PARTITION BY ticker ORDER BY date), 0)) AS total FROM (SELECT p.ticker, trade_date AS date, adj_close * (SELECT max_by(level, date) FROM ix) / nullif(level, 0) AS real, value_per_share AS paid
       FROM prices p LEFT JOIN ix ON date = trade_date LEFT JOIN dividends x ON x.ticker = p.ticker AND ex_date = trade_date)""", _KN)  # fmt: skip
def m23(s, d):
    p = v.prices(s, d).select("ticker", F.col("trade_date").alias("date"), F.col("adj_close").alias("value"))
    return statements.total_return(statements.real_values(p, _index(s, d)), v.dividends(s, d).select("ticker", F.col("ex_date").alias("date"), F.col("value_per_share").alias("amount")))


@query("m24_monthly_index", "month_end", "mean level", "SELECT month_end, mean, exp(sum(ln(1 + mean / 100)) OVER (ORDER BY month_end)) AS level FROM (SELECT last_day(reference_date) AS month_end, avg(selic) AS mean FROM macro GROUP BY 1)")
def m24(s, d):
    return statements.monthly_index(v.macro(s, d), "reference_date", "selic")


@query("m22_rebased", "ticker trade_date", "rebased", "SELECT ticker, trade_date, 100 * adj_close / nullif(first_value(adj_close) OVER (PARTITION BY ticker ORDER BY trade_date), 0) AS rebased FROM prices")
def m22(s, d):
    return statements.rebased(v.prices(s, d), "ticker", "trade_date", "adj_close")


_PN = PRICE + ", pn AS (SELECT px.*, f.reference_date, f.roe, sector FROM px ASOF LEFT JOIN fundamentals f ON px.ticker = f.ticker AND px.trade_date >= f.reference_date LEFT JOIN companies k ON k.ticker = px.ticker)"


def _plain_panel(s, d) -> DataFrame:
    p = asof.asof_join(features.price_features(v.prices(s, d)), v.fundamentals(s, d), ["ticker"], "trade_date", "reference_date")
    return p.join(v.companies(s, d), "ticker", "left")


@query("q07_panel_gate", "check passed", "value",
       """SELECT "check", value, coalesce(CASE "check" WHEN 'span_years' THEN value >= 2 WHEN 'long_tickers' THEN value >= 20 WHEN 'duplicate_keys' THEN value = 0 WHEN 'look_ahead' THEN value = 0 WHEN 'null_after_filing' THEN value < 0.1 WHEN 'mean_return' THEN abs(value) < 0.1 WHEN 'sectors' THEN value >= 3 ELSE value < 0.4 END, false) AS passed FROM (
       SELECT 'span_years' AS "check", (max(trade_date) - min(trade_date)) / 365.25::DOUBLE AS value FROM pn UNION ALL SELECT 'long_tickers', count(*) FROM (SELECT ticker FROM pn GROUP BY ticker HAVING count(*) >= 252) UNION ALL
       SELECT 'duplicate_keys', count(*) - count(DISTINCT ticker || '|' || trade_date) FROM pn UNION ALL SELECT 'look_ahead', count(*) FILTER (reference_date > trade_date) FROM pn UNION ALL SELECT 'null_after_filing', avg((roe IS NULL)::INT) FILTER (reference_date IS NOT NULL) FROM pn UNION ALL
       SELECT 'mean_return', avg(log_return) FROM pn UNION ALL SELECT 'sectors', count(DISTINCT sector) FROM pn UNION ALL SELECT 'largest_sector', max(k) / sum(k) FROM (SELECT count(DISTINCT ticker) AS k FROM pn WHERE sector IS NOT NULL GROUP BY sector))""", _PN)  # fmt: skip
def q07(s, d):
    return quality.panel_gate(_plain_panel(s, d), ["roe"])


@query("q06_panel_findings", "ticker date check", "value",
       """SELECT ticker, trade_date AS date, 'nan_critical' AS "check", 1 AS value FROM pn WHERE adj_close IS NULL OR log_return IS NULL UNION ALL SELECT ticker, trade_date, 'lookahead', trade_date - reference_date FROM pn WHERE trade_date < reference_date
       UNION ALL SELECT ticker, NULL, 'zero_variance', min(flag) FROM (SELECT *, 1.0::DOUBLE AS flag FROM pn) GROUP BY ticker HAVING count(flag) > 1 AND min(flag) = max(flag)""", _PN)  # fmt: skip
def q06b(s, d):
    return quality.panel_findings(_plain_panel(s, d).withColumn("flag", F.lit(1.0)), ["adj_close", "log_return"], ["flag", "adj_close"])



@query("s14_date_chunks", "chunk_start chunk_end", "", "SELECT a::DATE AS chunk_start, least(z, (a + INTERVAL 2 YEAR - INTERVAL 1 DAY)::DATE) AS chunk_end FROM (SELECT max(trade_date) AS z, unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 2 YEAR)) AS a FROM prices)")
def s14(s, d):
    return files.date_chunks(v.prices(s, d).agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end")), 2)


@query("s15_parsed_rates", "reference_date", "", "SELECT reference_date, round(selic, 12) AS selic FROM macro", plain="selic")
def s15(s, d):
    raw = v.macro(s, d).select(F.date_format("reference_date", "dd/MM/yyyy").alias("data"), F.regexp_replace(F.format_string("%.12f", "selic"), "[.]", ",").alias("valor"))
    return files.parsed_rates(raw, "selic")


@query("s23_incremental", "ticker trade_date", "adj_close", "SELECT ticker, trade_date, adj_close FROM prices LEFT JOIN (SELECT ticker, max(trade_date) AS mark FROM prices WHERE year(trade_date) < 2000 AND ticker LIKE '%1%' GROUP BY ticker) USING (ticker) WHERE mark IS NULL OR trade_date > mark")
def s23(s, d):
    p = v.prices(s, d)
    return files.rows_after(p, files.high_water_mark(p.where("year(trade_date) < 2000 AND ticker LIKE '%1%'")))


@query("k06_backtest_wide", "date", "value_all value_america w_S1 w_S2",
       """SELECT date, max(v) FILTER (strategy = 'all') AS value_all, max(v) FILTER (strategy = 'america') AS value_america, coalesce(any_value(w1), 0) AS w_S1, coalesce(any_value(w2), 0) AS w_S2 FROM (SELECT strategy, date, 100000 * exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY date)) AS v FROM m)
       LEFT JOIN (SELECT trade_date, sum(w) FILTER (ticker = 'S1') AS w1, sum(w) FILTER (ticker = 'S2') AS w2 FROM iv GROUP BY 1) ON trade_date = date GROUP BY date""", _M + ", ret AS" + _IV.split("ret AS", 1)[1])  # fmt: skip
def k06(s, d):
    w = portfolio.inverse_volatility(_returns(s, d)).select(F.col("trade_date").alias("date"), "ticker", "w")
    return outputs.backtest_wide(training.stitched(_market(s, d)), w, ["all", "america"], ["S1", "S2"])


@query("p16_ranker_ic", "trade_date n", "ic", None)
def p16(s, d):
    """Boosted trees on price features, judged by the rank correlation of each later day; fitted, so without SQL."""
    used = ["volatility_20d", "hl_ratio", "drawdown", "rsi_14", "return_1m"]
    # only what is read: windows of up to 252 rows behind the other features took most of the time
    p = performance.forward_return(features.price_features(v.prices(s, d)), 5).select("trade_date", *used, "forward")
    return performance.daily_rank_ic(ranking.ranked(p, used, "forward"), "predicted", "forward")


@query("p17_importances", "feature", "forest linear correlated consensus", None)
def p17(s, d):
    """Fitted, so without SQL."""
    p = performance.forward_return(features.price_features(v.prices(s, d)), 1)
    return ranking.importances(p, ["volatility_20d", "hl_ratio", "drawdown", "rsi_14", "return_1m"], "forward")
