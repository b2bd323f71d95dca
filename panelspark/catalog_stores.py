"""Queries of stores, routing, grids, range joins, significance and reports, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.catalog import _M, _R, _WINDOWS, PRICE, _market, _returns, _windows, query
from panelspark.catalog_panel import _phi
from panelspark.functions.columns import QUANTILE, TAIL, mapped
from panelspark.operators import audit, features, grid, performance, quality, ranges, reports, significance, statements, training
from panelspark.sources import arrays, files, outputs, router
from panelspark.sources import views as v
from panelspark.sources.scratch import kept, scratch_dir
from panelspark.streaming.store import Store

c = F.col


@query("st3_late_fetches", "ticker trade_date fetch", "value",
       "SELECT ticker, trade_date, max(f) AS fetch, arg_max(adj_close + f, f) AS value FROM (SELECT *, unnest([1, 2, 3]) AS f FROM prices) WHERE ((trade_date - DATE '1970-01-01') + f) % 3 <> 0 GROUP BY ALL")
def st3(s, d):
    """Three fetches of the prices, each without a third of the days, arrive as the third, the first and the second."""
    prices = kept(v.prices(s, d).select("ticker", "trade_date", "adj_close"), "prices")
    store = Store(s, scratch_dir(s, "fetches"), ["ticker", "trade_date"], 8)
    for fetch in (3, 1, 2):
        rows = prices.where((F.datediff("trade_date", F.lit("1970-01-01").cast("date")) + fetch) % 3 != 0)
        store.upsert(rows.select("ticker", "trade_date", (c("adj_close") + fetch).alias("value"), F.lit(fetch).alias("fetch")), "fetch")
    return store.read()


def _quantile(p: str) -> str:
    """The normal quantile of a share in SQL, by the same pieces and step."""
    poly = lambda ks, x: "".join("(" for _ in ks[1:]) + f"{ks[0]!r}::DOUBLE" + "".join(f" * {x} + {k!r}::DOUBLE)" for k in ks[1:])
    a, b, e, f = QUANTILE
    tail = f"{poly(e, 'q')} / {poly(f, 'q')}"
    rough = f"CASE WHEN p < {TAIL} THEN {tail} WHEN p > {1 - TAIL} THEN -({tail}) ELSE h * {poly(a, '(h * h)')} / {poly(b, '(h * h)')} END"
    return f"(SELECT CASE WHEN abs(z) < 5 THEN z - ({_phi('z')} - p) * {math.sqrt(2 * math.pi)!r}::DOUBLE * exp(z * z / 2) ELSE z END FROM (SELECT p, {rough} AS z FROM (SELECT p, p - 0.5::DOUBLE AS h, sqrt(-2 * ln(least(p, 1 - p))) AS q FROM (SELECT {p} AS p))))"


_TRIALS = """tr AS (SELECT avg(x) / nullif(stddev_pop(x), 0) AS s FROM (SELECT ticker, exp(log_return) - 1 AS x FROM px WHERE abs(log_return) <= 1) GROUP BY ticker),
    tn AS (SELECT count(s) AS n_trials, coalesce(stddev_pop(s), 0) AS deviation FROM tr)"""
_BEST = f"CASE WHEN n_trials < 2 OR deviation <= 0 THEN 0 ELSE deviation * ({1 - significance.EULER_GAMMA!r}::DOUBLE * {_quantile('1 - 1 / n_trials::DOUBLE')} + {significance.EULER_GAMMA!r}::DOUBLE * {_quantile(f'1 - 1 / (n_trials * {math.e!r}::DOUBLE)')}) END"


def _trials(s, d) -> DataFrame:
    """The daily Sharpe ratio of each ticker."""
    return significance.daily_sharpe(_returns(s, d).select("ticker", F.expm1("returns").alias("r")), "ticker")


@query("m10_expected_max", "n_trials", "deviation benchmark", f"SELECT *, {_BEST} AS benchmark FROM tn", PRICE + ", " + _TRIALS)
def m10(s, d):
    return significance.expected_max(_trials(s, d))


@query("m11_deflated_sharpe", "strategy n", "benchmark dsr",
       f"""SELECT strategy, n, benchmark, {_phi('z')} AS dsr FROM (SELECT *, (s - benchmark) * sqrt(n - 1) / sqrt(1 - g * s + (k - 1) / 4 * s * s) AS z FROM (SELECT strategy, count(*) AS n, any_value(mu) / any_value(sd) AS s, avg(pow((r - mu) / sd, 3)) AS g, avg(pow((r - mu) / sd, 4)) AS k
       FROM (SELECT *, avg(r) OVER (PARTITION BY strategy) AS mu, stddev_pop(r) OVER (PARTITION BY strategy) AS sd FROM m) GROUP BY strategy), (SELECT {_BEST} AS benchmark FROM tn))""", _M + ", " + _TRIALS)  # fmt: skip
def m11(s, d):
    """Trials are the Sharpe ratios of each ticker."""
    return significance.deflated_sharpe(_market(s, d), _trials(s, d))


_BOOT = """ps AS (SELECT strategy, row_number() OVER w AS i, sum(r) OVER w AS p, r FROM m WINDOW w AS (PARTITION BY strategy ORDER BY date)), sn AS (SELECT strategy, max(i) AS n, avg(r) AS mu, least(21, max(i)) AS ln_ FROM ps GROUP BY strategy),
    d0 AS (SELECT *, unnest(range(2000)) AS rs FROM sn), d1 AS (SELECT *, unnest(range(ceil(n / ln_)::BIGINT)) AS k FROM d0),
    dr AS (SELECT *, ('0x' || md5('0|' || strategy || '|' || rs || '|' || k)[1:8])::BIGINT % (n - ln_ + 1) AS start FROM d1),
    bt AS (SELECT strategy, any_value(n) AS n, any_value(mu) AS mean, quantile_cont(b, 0.025) AS low, quantile_cont(b, 0.975) AS high FROM (SELECT dr.strategy, rs, any_value(n) AS n, any_value(mu) AS mu, sum(z.p - coalesce(a.p, 0)) / any_value(n) AS b FROM dr
    LEFT JOIN ps a ON a.strategy = dr.strategy AND a.i = dr.start JOIN ps z ON z.strategy = dr.strategy AND z.i = dr.start + least(ln_, n - k * ln_) GROUP BY ALL) GROUP BY strategy)"""
_HAC21 = "hc AS (SELECT strategy, avg(r) / (stddev_samp(r) / sqrt(count(*))) AS t_naive, avg(r) / sqrt((sum(x * x) + " + " + ".join(f"2 * {1 - k / 22!r}::DOUBLE * sum(l{k})" for k in range(1, 22)) + ") / count(*) / count(*)) AS t_hac FROM (SELECT *, " + ", ".join(f"x * lag(x, {k}) OVER (PARTITION BY strategy ORDER BY date) AS l{k}" for k in range(1, 22)) + " FROM (SELECT *, r - avg(r) OVER (PARTITION BY strategy) AS x FROM m)) GROUP BY strategy)"


@query("m25_significance", "strategy n", "mean t_naive t_hac low high", "SELECT * FROM bt JOIN hc USING (strategy)", f"{_M}, {_BOOT}, {_HAC21}")
def m25(s, d):
    return significance.significance(_market(s, d))


#: Rebalanced portfolios in SQL, of target weights tw (strategy, date, ticker, w) and simple returns rs (date, ticker, r), every 21 days at 10 basis points.
_REBALANCED = """rs AS (SELECT trade_date AS date, ticker, (exp(log_return) - 1) / 10 AS r, volume FROM px WHERE abs(log_return) <= 1),
    dy AS (SELECT *, i // 21 AS block, first_value(date) OVER (PARTITION BY i // 21 ORDER BY i) AS start FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM rs))),
    hl AS (SELECT strategy, dy.date, i, block, rs.ticker, w * product(1 + r) OVER (PARTITION BY strategy, block, rs.ticker ORDER BY i) AS v FROM dy JOIN rs USING (date) JOIN tw ON tw.date = dy.start AND tw.ticker = rs.ticker),
    vl AS (SELECT strategy, date, i, block, sum(v) AS v FROM hl GROUP BY ALL),
    gr AS (SELECT *, v / coalesce(lag(v) OVER (PARTITION BY strategy, block ORDER BY i), 1) - 1 AS gross FROM vl),
    ls AS (SELECT strategy, block, ticker, v FROM hl QUALIFY i = max(i) OVER (PARTITION BY strategy, block)),
    dw AS (SELECT strategy, block + 1 AS block, ticker, v / sum(v) OVER (PARTITION BY strategy, block) AS w FROM ls),
    nw AS (SELECT strategy, block, ticker, w FROM tw JOIN (SELECT DISTINCT start, block FROM dy) b ON tw.date = b.start),
    tu AS (SELECT strategy, block, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS turnover FROM nw a FULL JOIN dw b USING (strategy, block, ticker) GROUP BY ALL),
    rb AS (SELECT strategy, date, gross, CASE WHEN i % 21 = 0 THEN turnover * 0.001::DOUBLE ELSE 0 END AS cost FROM gr LEFT JOIN tu USING (strategy, block))"""
_EQUAL = "SELECT 'equal_weight' AS strategy, trade_date AS date, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date) AS w FROM px WHERE abs(log_return) <= 1"


def _simple(s, d) -> DataFrame:
    return features.training_returns(v.prices(s, d)).where("returns IS NOT NULL").select(c("trade_date").alias("date"), "ticker", (F.expm1("returns") / 10).alias("r"), "volume")


def _equal(p: DataFrame) -> DataFrame:
    return p.select(F.lit("equal_weight").alias("strategy"), "date", "ticker", (1 / F.count("*").over(performance.Window.partitionBy("date"))).alias("w"))


@query("p07_rebalanced", "strategy date", "gross cost r", "SELECT *, gross - cost AS r FROM rb", f"{PRICE}, tw AS ({_EQUAL}), {_REBALANCED}")
def p07(s, d):
    """Monthly equal-weight portfolios of all names that trade on a block's first day, at 10 basis points."""
    p = _simple(s, d)
    return performance.rebalanced(p, _equal(p), 21, 0.001)


@query("p08_rollouts", "strategy date", "gross cost r", "SELECT *, gross - cost AS r FROM rb",
       f"{PRICE}, tw AS ({_EQUAL} UNION ALL SELECT 'volume', trade_date, ticker, volume / sum(volume) OVER (PARTITION BY trade_date) FROM px WHERE abs(log_return) <= 1 UNION ALL SELECT 'largest', trade_date, ticker, 1.0::DOUBLE FROM px WHERE abs(log_return) <= 1 QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, ticker) = 1), {_REBALANCED}")
def p08(s, d):
    """Three policies over the same days: all names alike, by volume, and the one of most volume."""
    p = _simple(s, d)
    day = performance.Window.partitionBy("date")
    size = p.select(F.lit("volume").alias("strategy"), "date", "ticker", (c("volume") / F.sum("volume").over(day)).alias("w"))
    top = p.withColumn("_k", F.row_number().over(day.orderBy(F.desc("volume"), "ticker"))).where("_k = 1").select(F.lit("largest").alias("strategy"), "date", "ticker", F.lit(1.0).alias("w"))
    return performance.rebalanced(p, _equal(p).unionByName(size).unionByName(top), 21, 0.001)


@query("s21_routed", "ticker trade_date source", "adj_close",
       """SELECT ticker, trade_date, CASE WHEN own THEN 'vendor' ELSE 'exchange' END AS source, CASE WHEN own THEN adj_close * 1.01::DOUBLE ELSE adj_close END AS adj_close FROM (SELECT *, ticker LIKE '%3' OR ticker = 'S7' AS own FROM prices)""")  # fmt: skip
def s21(s, d):
    """Prices from an exchange, which lacks some tickers, or else from a vendor, which one ticker always uses."""
    prices = v.prices(s, d).select("ticker", "trade_date", "adj_close")
    sources = {"exchange": prices.where("ticker NOT LIKE '%3'"), "vendor": prices.withColumn("adj_close", c("adj_close") * 1.01)}
    routes = s.createDataFrame([("prices", None, "exchange", 1), ("prices", None, "vendor", 2), ("prices", "S7", "vendor", 0), ("dividends", None, "vendor", 0)], "name string, ticker string, source string, precedence int")
    return router.routed(sources, routes, "prices")


@query("j13_grid", "date ticker active", "adj_close", "SELECT a.trade_date AS date, b.ticker, p.ticker IS NOT NULL AS active, adj_close FROM (SELECT DISTINCT trade_date FROM prices) a CROSS JOIN (SELECT DISTINCT ticker FROM prices) b LEFT JOIN prices p ON p.trade_date = a.trade_date AND p.ticker = b.ticker")
def j13(s, d):
    return grid.grid(v.prices(s, d), ["adj_close"])


_SCALED = _WINDOWS + ", sc AS (SELECT 'adj_close' AS feature, avg(adj_close) AS mean, CASE WHEN stddev_pop(adj_close) < 1e-12 THEN 1 ELSE stddev_pop(adj_close) END AS std FROM prices JOIN wn ON trade_date <= train_end WHERE window_id = 0)"


@query("p03_scaled_grid", "date ticker feature active", "value",
       "SELECT a.trade_date AS date, b.ticker, 'adj_close' AS feature, p.ticker IS NOT NULL AS active, coalesce(greatest(-10, least(10, (adj_close - mean) / std)), 0) AS value FROM (SELECT DISTINCT trade_date FROM prices) a CROSS JOIN (SELECT DISTINCT ticker FROM prices) b LEFT JOIN prices p ON p.trade_date = a.trade_date AND p.ticker = b.ticker CROSS JOIN sc".replace("coalesce(greatest(-10, least(10, (adj_close - mean) / std)), 0)", "CASE WHEN adj_close IS NULL THEN 0 ELSE greatest(-10, least(10, (adj_close - mean) / std)) END"), _SCALED)
def p03(s, d):
    p = v.prices(s, d)
    return training.scaled_grid(p, ["adj_close"], audit.scalers(p, ["adj_close"], _windows(s, d).withColumnRenamed("train_end", "cutoff")), 0)


@query("k05_array_store", "date ticker", "adj_close volume", "SELECT trade_date AS date, ticker, adj_close, CASE WHEN volume > 60 THEN NULL ELSE volume END AS volume FROM prices")
def k05(s, d):
    """The panel written as blocks of days times names, and unfolded again."""
    path = scratch_dir(s, "arrays")
    p = v.prices(s, d).withColumn("volume", F.when(c("volume") <= 60, c("volume")))
    arrays.write_arrays(p, path, ["adj_close", "volume"], "trade_date", days=256, names=128)
    return arrays.read_arrays(s, path)


_SAMPLE = "('0x' || md5('7|' || ticker || '|' || trade_date)[1:8])::BIGINT < 0.2 * 4294967296"


@query("m21_cross_check", "item checked differ only_left only_right", "",
       " UNION ALL ".join(f"SELECT '{k}' AS item, count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL) AS checked, count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL AND abs(a.{k} - b.{k}) > 0.0001) AS differ, count(*) FILTER (b.t IS NULL) AS only_left, count(*) FILTER (a.t IS NULL) AS only_right FROM ca a FULL JOIN cb b ON a.t = b.t AND a.d = b.d" for k in ("adj_close", "volume")),
       f"""cs AS (SELECT ticker AS t, trade_date AS d, adj_close, volume, trade_date - DATE '1970-01-01' AS n FROM prices WHERE {_SAMPLE}), ca AS (SELECT * FROM cs WHERE n % 83 <> 0),
       cb AS (SELECT t, d, CASE WHEN n % 97 = 0 THEN adj_close + 0.01 ELSE adj_close + 0.00005 END AS adj_close, volume FROM cs WHERE n % 89 <> 0)""")  # fmt: skip
def m21(s, d):
    """Prices against a copy in which days are changed, and days lack on either side."""
    p = v.prices(s, d).withColumn("n", F.datediff("trade_date", F.lit("1970-01-01").cast("date")))
    other = p.where("n % 89 <> 0").withColumn("adj_close", c("adj_close") + F.when(c("n") % 97 == 0, 0.01).otherwise(0.00005))
    return grid.cross_check(p.where("n % 83 <> 0"), other, ["ticker", "trade_date"], ["adj_close", "volume"], share=0.2, seed=7)


@query("j18_range_overlaps", "part n first_customer last_customer", "total",
       """SELECT p_partkey AS part, count(*) AS n, min(c_custkey) AS first_customer, max(c_custkey) AS last_customer, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS total FROM part JOIN customer ON p_retailprice - p_size <= c_acctbal + pow(10, c_custkey % 4) AND c_acctbal <= p_retailprice + p_size GROUP BY p_partkey""")  # fmt: skip
def j18(s, d):
    """Bands around the parts' prices and bands above the customers' balances, of very different lengths, that overlap."""
    part = v.table(s, d, "part").select("p_partkey", (c("p_retailprice") - c("p_size")).alias("low"), (c("p_retailprice") + c("p_size")).alias("high"))
    customer = v.table(s, d, "customer").select("c_custkey", c("c_acctbal").alias("from"), (c("c_acctbal") + F.pow(F.lit(10.0), c("c_custkey") % 4)).alias("to"))
    totals = {"n": ("sum", F.lit(1)), "first_customer": ("min", c("c_custkey")), "last_customer": ("max", c("c_custkey")), "total": ("sum", c("from").cast("decimal(18,2)"))}
    met = ranges.overlap_totals(part, customer, ("low", "high"), ("from", "to"), totals)
    return met.groupBy(c("p_partkey").alias("part")).agg(F.sum("n").alias("n"), F.min("first_customer").alias("first_customer"), F.max("last_customer").alias("last_customer"), F.sum("total").cast("double").alias("total"))


@query("f02_excluded", "ticker reason", "", """SELECT * FROM (SELECT ticker, CASE WHEN status <> 'ATIVO' THEN 'not active' WHEN ticker NOT IN (SELECT ticker FROM filings) THEN 'no filings' WHEN n < 610 THEN 'few prices' END AS reason FROM companies LEFT JOIN (SELECT ticker, count(*) AS n FROM prices GROUP BY 1) USING (ticker)) WHERE reason IS NOT NULL""")
def f02(s, d):
    return quality.excluded(v.companies(s, d), v.prices(s, d), v.filings(s, d), least=610)


_DIRTY = "dp AS (SELECT * FROM prices UNION ALL SELECT * FROM prices WHERE ticker LIKE '%7' UNION ALL SELECT ticker, trade_date, adj_close, -close, high, low, -volume FROM prices WHERE ticker LIKE '%5')"


def _dirty(s, d) -> DataFrame:
    """Prices with some rows repeated, and some repeated with the signs of close and volume changed."""
    p = v.prices(s, d)
    return p.unionByName(p.where("ticker LIKE '%7'")).unionByName(p.where("ticker LIKE '%5'").withColumns({"close": -c("close"), "volume": -c("volume")}))


@query("a08_repeated_rows", "ticker trade_date n", "adj_close volume", "SELECT *, count(*) AS n FROM dp GROUP BY ALL HAVING count(*) > 1", _DIRTY)
def a08(s, d):
    return quality.repeated_rows(_dirty(s, d))


@query("q02_dirty_price_gate", "check severity n_bad", "",
       """SELECT 'close_not_positive' AS "check", 'error' AS severity, count(*) FILTER (close <= 0) AS n_bad FROM dp UNION ALL SELECT 'volume_negative', 'error', count(*) FILTER (volume < 0) FROM dp
       UNION ALL SELECT 'duplicate_key', 'warning', sum(n)::BIGINT FROM (SELECT count(*) AS n FROM dp GROUP BY ticker, trade_date HAVING count(*) > 1) UNION ALL SELECT 'gap_over_5d', 'warning', count(*) FILTER (gap > 5) FROM (SELECT trade_date - lag(trade_date) OVER (PARTITION BY ticker ORDER BY trade_date) AS gap FROM dp)""", _DIRTY)  # fmt: skip
def q02_dirty(s, d):
    return quality.price_gate(_dirty(s, d))


@query("q01_dirty_common_gate", "check severity n_bad passed", "",
       """SELECT *, n_bad = 0 OR severity = 'warning' AS passed FROM (SELECT 'empty' AS "check", 'error' AS severity, (count(*) = 0)::BIGINT AS n_bad FROM dp
       UNION ALL SELECT 'missing_columns', 'error', (SELECT len(list_filter(['ticker', 'close', 'num_trades', 'adj_open'], lambda k: NOT list_contains(json_keys(to_json(x)), k))) FROM (SELECT dp AS x FROM dp LIMIT 1))
       UNION ALL SELECT 'future_dates', 'error', count(*) FILTER (trade_date > DATE '1998-10-03') FROM dp UNION ALL SELECT 'repeated_dates', 'warning', count(*) - count(DISTINCT ticker || trade_date) FROM dp)""", _DIRTY)  # fmt: skip
def q01_dirty(s, d):
    """Two of the required columns are missing, which both sides look for."""
    return reports.common_gate(_dirty(s, d), "trade_date", ["ticker", "close", "num_trades", "adj_open"], F.lit("1998-10-01").cast("date"))


@query("a03_ticker_null_rates", "ticker column n n_null", "rate", """SELECT ticker, "column", n, n_null, n_null / n AS rate FROM (""" + " UNION ALL ".join(f"""SELECT ticker, '{k}' AS "column", count(*) AS n, count(*) - count({k}) AS n_null FROM filings GROUP BY ticker""" for k in ("cagr_earnings_5y", "cagr_revenue_5y", "pl")) + ")")
def a03(s, d):
    return quality.ticker_null_rates(v.filings(s, d), ["cagr_earnings_5y", "cagr_revenue_5y", "pl"])


@query("w45_drawdown_curve", "strategy date", "value drawdown", "SELECT strategy, date, value, 1 - value / greatest(100000, max(value) OVER (PARTITION BY strategy ORDER BY date)) AS drawdown FROM (SELECT *, 100000 * exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY date)) AS value FROM m)", _M)
def w45(s, d):
    return performance.drawdown_curve(_market(s, d))


@query("t05_latest", "ticker trade_date", "adj_close volume", "SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) = 1")
def t05(s, d):
    return reports.last_by(v.prices(s, d), "ticker", "trade_date")


@query("m22_growth_rate", "ticker", "first last years growth",
       "SELECT *, 100 * (pow(last / first, 1 / years) - 1) AS growth FROM (SELECT ticker, min_by(adj_close, trade_date) AS first, max_by(adj_close, trade_date) AS last, (max(trade_date) - min(trade_date)) / 365.25::DOUBLE AS years FROM prices GROUP BY ticker)")
def m22(s, d):
    return statements.growth_rate(v.prices(s, d), "ticker", "trade_date", "adj_close")


@query("x10_mapped_sectors", "ticker sector", "", "SELECT ticker, CASE sector WHEN 'AMERICA' THEN 'west' WHEN 'ASIA' THEN 'east' ELSE sector END AS sector FROM companies")
def x10(s, d):
    return v.companies(s, d).withColumn("sector", mapped(c("sector"), {"AMERICA": "west", "ASIA": "east"}))


@query("x12_effective_discount", "ticker n", "gamma", "SELECT ticker, n, pow(0.99::DOUBLE, n) AS gamma FROM (SELECT ticker, count(*) AS n FROM prices GROUP BY ticker)")
def x12(s, d):
    """The discount that a step's 0.99 comes to over all of a ticker's days."""
    return v.prices(s, d).groupBy("ticker").agg(F.count("*").alias("n")).withColumn("gamma", F.pow(F.lit(0.99), c("n")))


@query("s01_scanned_prices", "ticker trade_date", "adj_close volume", "SELECT ticker, trade_date, adj_close, volume FROM prices WHERE ticker IN ('S1', 'S2', 'S7') AND trade_date BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'")
def s01(s, d):
    """Files of prices by the fixed schema, of which the scan takes some columns, tickers and dates."""
    path = scratch_dir(s, "prices")
    v.prices(s, d).write.parquet(path)
    return files.scan(s, path, "prices", ["ticker", "trade_date", "adj_close", "volume"], ["S1", "S2", "S7"], "1993-01-01", "1996-12-31")


@query("s08_listed_tickers", "ticker", "", "SELECT DISTINCT ticker FROM prices")
def s08(s, d):
    """The tickers of a folder of files, by their names."""
    path = scratch_dir(s, "named")
    outputs.write_by_ticker(v.prices(s, d), path)
    return files.tickers_of_files(s, path, r"ticker=([^/]+)\.parquet$").select(F.nullif("ticker", F.lit(outputs.NO_TICKER)).alias("ticker")).distinct()


@query("s09_logs", "run file_is_json", "log_return", "SELECT strategy AS run, true AS file_is_json, sum(ln(1 + r)) AS log_return FROM m GROUP BY strategy", _M)
def s09(s, d):
    """Each strategy's run logged as lines of JSON, of which the folder tells the run."""
    path = scratch_dir(s, "logs")
    m = _market(s, d).select("strategy", c("date").cast("string").alias("date"), F.log1p("r").alias("log_return"))
    m.withColumn("run", c("strategy")).repartition("run").write.partitionBy("run").json(path)
    rows = files.training_logs(s, path, "date date, strategy string, log_return double")
    return rows.groupBy(F.regexp_extract("run", "([^=]+)$", 1).alias("run")).agg(F.min(c("file").endswith(".json")).alias("file_is_json"), F.sum("log_return").alias("log_return"))


@query("s10_metric_documents", "strategy metric", "value", "SELECT strategy, unnest(['mean', 'volatility', 'days']) AS metric, unnest([avg(r), stddev_pop(r), count(*)]) AS value FROM m GROUP BY strategy", _M)
def s10(s, d):
    """The strategies' metrics written as one JSON document and read back."""
    by = _market(s, d).groupBy("strategy").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("volatility"), F.count("*").cast("double").alias("days"))
    path = scratch_dir(s, "metrics")
    outputs.metric_document(by.unpivot(["strategy"], ["mean", "volatility", "days"], "metric", "value")).write.text(path)
    return files.metric_documents(s, path)


@query("f05_listed", "ticker sector", "", "SELECT ticker, sector FROM companies WHERE regexp_full_match(ticker, 'S[0-9]*[3-8]') OR ticker = 'S10'")
def f05(s, d):
    return files.listed(v.companies(s, d), "^S[0-9]*[3-8]$", ("S10",))


@query("f08_numeric_columns", "column", "mean", "SELECT 'adj_close' AS \"column\", avg(adj_close) AS mean FROM prices UNION ALL SELECT 'high', avg(high) FROM prices UNION ALL SELECT 'volume', avg(volume) FROM prices")
def f08(s, d):
    """The means of the floating columns that aren't skipped."""
    p = v.prices(s, d)
    names = reports.numeric_columns(p, ("low", "close"))
    return p.agg(*[F.avg(k).alias(k) for k in names]).unpivot([], names, "column", "mean")


@query("f17_tickers", "ticker", "", "SELECT DISTINCT CASE WHEN volume > 20 THEN ticker END AS ticker FROM prices WHERE volume > 20")
def f17(s, d):
    return files.tickers(v.prices(s, d).withColumn("ticker", F.when(c("volume") > 20, c("ticker"))))


@query("k07_allocation", "as_of ticker days_old stale", "w", "SELECT DATE '1999-03-02' AS as_of, ticker, volume / sum(volume) OVER () AS w, 1 AS days_old, false AS stale FROM prices WHERE trade_date = (SELECT max(trade_date) FROM prices WHERE trade_date <= DATE '1996-03-04')")
def k07(s, d):
    """A day's weights written as CSV and read back."""
    p = v.prices(s, d).where("trade_date <= '1996-03-04'")
    day = p.join(p.agg(F.max("trade_date").alias("trade_date")), "trade_date")
    path = scratch_dir(s, "allocation")
    outputs.write_allocation(day.select("ticker", (c("volume") / F.sum("volume").over(performance.Window.partitionBy("trade_date"))).alias("w"), F.lit("1999-03-02").cast("date").alias("as_of"), F.lit(1).alias("days_old"), F.lit(False).alias("stale")), path)
    return s.read.schema("as_of date, ticker string, w double, days_old int, stale boolean").option("header", "true").csv(path)


@query("k09_metadata_differences", "key stored current", "", """SELECT * FROM (SELECT key, a.value AS stored, b.value AS current FROM (SELECT sector AS key, count(*)::VARCHAR AS value FROM companies GROUP BY 1) a FULL JOIN (SELECT sector AS key, count(*)::VARCHAR AS value FROM companies WHERE status = 'ATIVO' AND sector <> 'ASIA' GROUP BY 1) b USING (key)) WHERE stored IS DISTINCT FROM current""")
def k09(s, d):
    """Companies by sector, as stored by one run, against the active ones of another."""
    count = lambda df: df.groupBy(c("sector").alias("key")).agg(F.count("*").cast("string").alias("value"))
    path, k = scratch_dir(s, "metadata"), v.companies(s, d)
    outputs.write_metadata(count(k), path)
    return outputs.metadata_differences(s.read.schema("key string, value string").json(path), count(k.where("status = 'ATIVO' AND sector <> 'ASIA'")))


@query("s20_other_dividends", "ticker ex_date type adjusted", "", "SELECT ticker, ex_date, 'DIVIDEND' AS type, true AS adjusted, value_per_share FROM dividends WHERE ticker NOT LIKE '%1'", plain="value_per_share")
def s20(s, d):
    """Dividends of another source, which books some tickers' as negative, in the columns of the first one."""
    other = v.dividends(s, d).select("ticker", "ex_date", F.when(c("ticker").like("%1"), -c("value_per_share")).otherwise(c("value_per_share")).alias("paid"))
    return files.other_dividends(other, "ex_date", "paid")
