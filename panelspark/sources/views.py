"""Panel tables over the driver's star schema: prices, fundamentals, dividends, macro series and companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items of a task, about, once they are dealt by ticker.
PART_ROWS = 1 << 17


def by_ticker(rows: DataFrame, n: int) -> DataFrame:
    """Rows dealt by ticker, of a table of n rows, into parts whose number follows n; few rows are left to Spark's own number,
    which it adapts. Tables of one n are dealt alike, so what belongs to a ticker meets without a further exchange, and line
    items, of which few share a ticker and a day, aren't aggregated before they are dealt."""
    parts = -(-n // PART_ROWS)
    return rows.repartition(parts, "ticker") if parts > 8 else rows.repartition("ticker")


def exact(x: Column, scale: int = 2) -> Column:
    """A sum that doesn't depend on the order of its rows."""
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def _ticker(key: str) -> Column:
    return F.concat(F.lit("S"), F.col(key).cast("string")).alias("ticker")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, trade_date, adj_close, close, high, low, volume: a supplier's line items by day."""
    items = table(spark, sf_dir, "lineitem")
    rows = by_ticker(items.select(_ticker("l_suppkey"), F.to_date("l_shipdate").alias("trade_date"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q")), items.count())
    out = rows.groupBy("ticker", "trade_date").agg((exact(F.col("p")) / F.count("*")).alias("adj_close"), F.max("p").alias("high"), F.min("p").alias("low"), exact(F.col("q")).alias("volume"))
    return out.withColumn("close", F.col("adj_close"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each ticker and quarter end, with levels and ratios made of the quarter's line items."""
    p, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2)).alias("reference_date")
    items = table(spark, sf_dir, "lineitem")
    base = by_ticker(items.select(_ticker("l_suppkey"), end, "l_extendedprice", "l_discount", "l_tax", "l_quantity"), items.count()).groupBy("ticker", "reference_date").agg(
        exact(p).alias("g"), exact(p * (1 - d), 4).alias("net_revenue"), exact(p * (d - t), 4).alias("net_income"), exact(F.col("l_quantity")).alias("q"), F.count("*").alias("n")
    )
    c = F.col
    base = base.withColumns({"close_price": c("g") / c("n"), "equity": 0.6 * c("g"), "total_debt": 0.3 * c("net_revenue"), "cash": 0.05 * c("g") + 10 * c("q"), "ebitda": 0.2 * c("net_revenue") + c("net_income")})
    base = base.withColumns({
        "market_cap": c("close_price") * c("q"), "total_assets": c("g"), "net_debt": c("total_debt") - c("cash"), "current_assets": 0.4 * c("g") + c("net_income"), "current_liabilities": 0.25 * c("net_revenue"),
    })
    ratios = {"gross_margin": ("gm", "net_revenue"), "net_margin": ("net_income", "net_revenue"), "roe": ("net_income", "equity"), "roa": ("net_income", "g"), "debt_equity": ("total_debt", "equity"), "current_ratio": ("current_assets", "current_liabilities"), "pl": ("market_cap", "net_income"), "pvp": ("market_cap", "equity")}
    base = base.withColumn("gm", c("net_revenue") - 0.7 * c("g"))
    return base.withColumns({k: F.try_divide(c(a), c(b)) for k, (a, b) in ratios.items()}).drop("gm", "g", "n")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fundamentals with shares, earnings a share, further multiples, and growth rates that their source has for some quarters."""
    c, per, month = F.col, F.try_divide, F.month("reference_date")
    out = fundamentals(spark, sf_dir).withColumn("ebit", c("ebitda") - 0.05 * c("total_assets"))
    value = c("market_cap") + c("net_debt")
    return out.withColumns({
        "shares_outstanding": c("q"), "lpa": per(c("net_income"), c("q")), "p_sr": per(c("market_cap"), c("net_revenue")), "p_ebit": per(c("market_cap"), c("ebit")), "p_ebitda": per(c("market_cap"), c("ebitda")),
        "p_assets": per(c("market_cap"), c("total_assets")), "ev_ebit": per(value, c("ebit")), "ev_ebitda": per(value, c("ebitda")),
        "cagr_earnings_5y": F.when(month == 12, 100 * c("net_margin")), "cagr_revenue_5y": F.when(month.isin(6, 12), 100 * c("gross_margin")),
    })


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ex_date, value_per_share > 0."""
    items = table(spark, sf_dir, "lineitem")
    paid = items.where("l_returnflag = 'R' AND l_linestatus = 'F'").select(_ticker("l_suppkey"), F.to_date("l_shipdate").alias("ex_date"), "l_extendedprice", "l_discount")
    value = (exact(F.col("l_extendedprice") * F.col("l_discount"), 4) / 1000).alias("value_per_share")
    return by_ticker(paid, items.count()).groupBy("ticker", "ex_date").agg(value).where("value_per_share > 0")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reference_date, selic, ipca: a row for each date with orders."""
    mean = exact(F.col("o_totalprice")) / F.count("*")
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("reference_date")).agg((mean / 1e7).alias("selic"), (mean / 1e6).alias("ipca"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector, status: one row for each supplier."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    status = F.when(F.col("s_acctbal") > 0, "ATIVO").otherwise("CANCELADO").alias("status")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("r_name").alias("sector"))
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(place, supplier.s_nationkey == place.n_nationkey).select(_ticker("s_suppkey"), "sector", status)


#: The same views in DuckDB's SQL.
SQL = """
prices AS (SELECT ticker, trade_date, adj_close, adj_close AS close, high, low, volume FROM (
    SELECT 'S' || l_suppkey AS ticker, l_shipdate::DATE AS trade_date, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*) AS adj_close,
        max(l_extendedprice) AS high, min(l_extendedprice) AS low, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS volume FROM lineitem GROUP BY 1, 2)),
f0 AS (SELECT 'S' || l_suppkey AS ticker, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS reference_date,
    sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS g, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS net_revenue,
    sum((l_extendedprice * (l_discount - l_tax))::DECIMAL(18,4))::DOUBLE AS net_income, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
f1 AS (SELECT *, g / n AS close_price, 0.6::DOUBLE * g AS equity, 0.3::DOUBLE * net_revenue AS total_debt, 0.05::DOUBLE * g + 10 * q AS cash, 0.2::DOUBLE * net_revenue + net_income AS ebitda FROM f0),
f2 AS (SELECT *, close_price * q AS market_cap, g AS total_assets, total_debt - cash AS net_debt, 0.4::DOUBLE * g + net_income AS current_assets, 0.25::DOUBLE * net_revenue AS current_liabilities FROM f1),
fundamentals AS (SELECT *, (net_revenue - 0.7::DOUBLE * g) / nullif(net_revenue, 0) AS gross_margin, net_income / nullif(net_revenue, 0) AS net_margin, net_income / nullif(equity, 0) AS roe,
    net_income / nullif(g, 0) AS roa, total_debt / nullif(equity, 0) AS debt_equity, current_assets / nullif(current_liabilities, 0) AS current_ratio, market_cap / nullif(net_income, 0) AS pl,
    market_cap / nullif(equity, 0) AS pvp FROM f2),
filings AS (SELECT f.*, q AS shares_outstanding, net_income / nullif(q, 0) AS lpa, market_cap / nullif(net_revenue, 0) AS p_sr, market_cap / nullif(ebit, 0) AS p_ebit, market_cap / nullif(ebitda, 0) AS p_ebitda,
    market_cap / nullif(total_assets, 0) AS p_assets, (market_cap + net_debt) / nullif(ebit, 0) AS ev_ebit, (market_cap + net_debt) / nullif(ebitda, 0) AS ev_ebitda,
    CASE WHEN month(reference_date) = 12 THEN 100 * net_margin END AS cagr_earnings_5y, CASE WHEN month(reference_date) IN (6, 12) THEN 100 * gross_margin END AS cagr_revenue_5y
    FROM (SELECT *, ebitda - 0.05::DOUBLE * total_assets AS ebit FROM fundamentals) f),
dividends AS (SELECT * FROM (SELECT 'S' || l_suppkey AS ticker, l_shipdate::DATE AS ex_date, sum((l_extendedprice * l_discount)::DECIMAL(18,4))::DOUBLE / 1000 AS value_per_share
    FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1, 2) WHERE value_per_share > 0),
macro AS (SELECT o_orderdate::DATE AS reference_date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) / 1e7 AS selic, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) / 1e6 AS ipca FROM orders GROUP BY 1),
companies AS (SELECT 'S' || s_suppkey AS ticker, r_name AS sector, CASE WHEN s_acctbal > 0 THEN 'ATIVO' ELSE 'CANCELADO' END AS status
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
