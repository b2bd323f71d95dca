"""Which source a ticker's rows of a table come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def assigned(routes: DataFrame, name: str, offered: DataFrame) -> DataFrame:
    """(ticker, source): for each ticker the source of least precedence among those that offer it and that a route allows.

    routes: (name, ticker, source, precedence); a null ticker stands for all of them. offered: (ticker, source). Of equal
    precedences a ticker's own route goes before one for all, then the lesser name. Tickers that no route allows are left out.
    """
    mine = routes.where(c("name") == name).select(c("ticker").alias("_t"), c("source").alias("_s"), "precedence")
    met = offered.where("ticker IS NOT NULL").select("ticker", "source").distinct().join(mine, (c("source") == c("_s")) & (c("_t").isNull() | (c("_t") == c("ticker"))))
    return met.groupBy("ticker").agg(F.min_by("source", F.struct("precedence", c("_t").isNull(), "source")).alias("source"))


def routed(sources: dict[str, DataFrame], routes: DataFrame, name: str) -> DataFrame:
    """The rows of each ticker from its source, with the source's name; all sources have the same columns. Only the keys of a
    source meet the others; its rows are filtered where they are."""
    offered = None
    for k, df in sources.items():
        keys = df.select("ticker").distinct().withColumn("source", F.lit(k))
        offered = keys if offered is None else offered.union(keys)
    chosen, out = assigned(routes, name, offered), None
    for k, df in sources.items():
        rows = df.join(chosen.where(c("source") == k).select("ticker"), "ticker", "left_semi").withColumn("source", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def routed_by_name(sources: dict[str, DataFrame], routes: DataFrame, name: str, tickers: list[str]) -> DataFrame:
    """The same for named tickers that every source may be asked for: each source gets a filter with its own tickers, which one
    that is asked over the network takes into its requests. The routes of these tickers come to the driver."""
    spark = routes.sparkSession
    every = spark.createDataFrame([(t,) for t in tickers], "ticker string").join(routes.where((c("name") == name) & c("source").isin(list(sources))).select("source").distinct())  # a row for each asked ticker and source
    chosen: dict[str, list[str]] = {}
    for r in assigned(routes, name, every).collect():
        chosen.setdefault(r.source, []).append(r.ticker)
    out = None
    for k, mine in sorted(chosen.items()):
        rows = sources[k].where(c("ticker").isin(sorted(mine))).withColumn("source", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else next(iter(sources.values())).limit(0).withColumn("source", F.lit(""))
