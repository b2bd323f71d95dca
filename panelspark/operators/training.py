"""Training tables: cash rows, universes, scaled features, policies' weights, stitched curves and signal reports."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import clip, correlation, filled
from panelspark.operators.asof import asof_dates
from panelspark.operators.grid import grid
from panelspark.operators.performance import cash_price
from panelspark.operators.portfolio import normalised

c = F.col
CASH = "CASH"
#: MD5's constants and turns by round, and texts that are hashed at once, as many as stay near the processor.
MD5_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
MD5_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_ROWS = 1 << 15


def with_cash(panel: DataFrame, rates: DataFrame, rate: str = "selic") -> DataFrame:
    """The panel and a row of ticker CASH for each of its days, whose adj_close compounds the day's rate (in percent, the last
    one known) from 100; other columns are null there."""
    days = asof_dates(panel.select("trade_date").distinct(), rates.select(c("reference_date").alias("_d"), rate), "trade_date", "_d")
    cash = cash_price(days.withColumn(rate, F.coalesce(rate, F.lit(0.0))), "trade_date", rate)
    return panel.unionByName(cash.select(F.lit(CASH).alias("ticker"), "trade_date", c("price").alias("adj_close")), allowMissingColumns=True)


def cash_gate(panel: DataFrame, low: float = 0.01, high: float = 0.3) -> DataFrame:
    """One row: cash's annualised return and whether it is inside [low, high]; without cash rows null and false."""
    cash = panel.where(c("ticker") == CASH).agg(F.min_by("adj_close", "trade_date").alias("_a"), F.max_by("adj_close", "trade_date").alias("_b"), F.count("*").alias("n"))
    annual = F.when(c("n") > 1, F.pow(F.try_divide(c("_b"), c("_a")), 252 / F.greatest(c("n") - 1, F.lit(1))) - 1)
    return cash.select("n", annual.alias("annualized"), F.coalesce(annual.between(low, high), F.lit(False)).alias("passed"))


def largest_universe(panel: DataFrame, size: str, n: int, min_rows: int = 252) -> DataFrame:
    """(ticker, mean_size): the n tickers of largest mean size (ties to the smaller ticker) among those of min_rows rows, and
    cash beside them."""
    mean = panel.groupBy("ticker").agg(F.count("*").alias("_n"), F.avg(size).alias("mean_size")).where(c("_n") >= min_rows).drop("_n")
    stocks = mean.where(c("ticker") != CASH).orderBy(c("mean_size").desc_nulls_last(), "ticker").limit(n)
    return stocks.unionByName(mean.where(c("ticker") == CASH))


def scaled(panel: DataFrame, features: list[str], scalers: DataFrame, window_id: int, limit: float = 10.0, beside: list[str] | None = None) -> DataFrame:
    """(ticker, trade_date, feature, value, and the columns `beside`): features less the mean over the deviation of one window's scalers (window_id,
    feature, mean, std), kept within the limit; missing ones are 0. Scalers are a row a feature."""
    keys = ["ticker", "trade_date", *(beside or [])]
    long = panel.select(*keys, *[c(k).cast("double").alias(k) for k in features]).unpivot(keys, features, "feature", "x")
    one = scalers.where(c("window_id") == window_id).select("feature", "mean", "std")
    # sent to all tasks: by a join on the feature all of its rows would be in one task
    return long.join(F.broadcast(one), "feature", "left").select(*keys[:2], "feature", *keys[2:], F.coalesce(clip((c("x") - c("mean")) / c("std"), -limit, limit), F.lit(0.0)).alias("value"))


def scaled_grid(panel: DataFrame, features: list[str], scalers: DataFrame, window_id: int, limit: float = 10.0) -> DataFrame:
    """(date, ticker, feature, active, value): scaled features of every cell of calendar times universe; inactive cells and
    missing values are 0."""
    cells = grid(panel, features).withColumnRenamed("date", "trade_date")
    return scaled(cells, features, scalers, window_id, limit, ["active"]).select(c("trade_date").alias("date"), "ticker", "feature", "active", F.when(c("active"), c("value")).otherwise(0.0).alias("value"))


def market_return(returns: DataFrame) -> DataFrame:
    """(trade_date, n, ew_log): log of one plus the day's mean simple return over all names but cash; missing returns count
    as 0, and a mean below -0.9999 as that."""
    simple = F.avg(F.expm1(F.coalesce("returns", F.lit(0.0))))
    return returns.where(c("ticker") != CASH).groupBy("trade_date").agg(F.count("*").alias("n"), F.log1p(F.greatest(simple, F.lit(-0.9999))).alias("ew_log"))


def size_weights(panel: DataFrame, size: str) -> DataFrame:
    """w: each name's share of the day's sizes, where a missing size is the ticker's last one."""
    held = filled(c(size), Window.partitionBy("ticker").orderBy("trade_date"))
    return panel.withColumn("_s", held).withColumn("w", normalised(c("_s"))).drop("_s")


def blended(weights: DataFrame, cash: float) -> DataFrame:
    """(ticker, trade_date, w): the weights times 1 - cash, and cash in each of their days."""
    rest = weights.select("ticker", "trade_date", (c("w") * (1 - cash)).alias("w"))
    return rest.unionByName(weights.select(F.lit(CASH).alias("ticker"), "trade_date", F.lit(cash).alias("w")).distinct())


def tagged(rows: DataFrame, spans: DataFrame, date: str, start: str, end: str, tag: str) -> DataFrame:
    """Rows inside a span (both ends included), with its tag; of overlapping ones the largest tag. Spans meet the distinct
    dates, which a calendar bounds."""
    inside = rows.select(date).distinct().join(spans.select(start, end, tag), c(date).between(c(start), c(end)))
    return rows.join(inside.groupBy(date).agg(F.max(tag).alias(tag)), date)


def stitched(returns: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """value: capital compounded over each strategy's returns in order of date."""
    by = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("value", capital * F.exp(F.sum(F.log1p("r")).over(by)))


def retrain_days(days: DataFrame, every: int = 63) -> DataFrame:
    """(trade_date, i): each every-th distinct day and the last one. A calendar's rows go through one task."""
    numbered = days.select("trade_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("trade_date")) - 1)
    last = F.max("i").over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return numbered.withColumn("_last", last).where((c("i") % every == 0) | (c("i") == c("_last"))).drop("_last")


def allocation(weights: DataFrame, day: str, least: float = 1e-6, stale_after: int = 5) -> DataFrame:
    """(ticker, w, as_of, days_old, stale): the weights above `least` of the last day that isn't after the asked one, equal
    ones where that day's sum is 0."""
    asked = F.lit(day).cast("date")
    last = weights.where(c("trade_date") <= asked).agg(F.max("trade_date").alias("as_of"))
    held = weights.join(F.broadcast(last), c("trade_date") == c("as_of"))  # one row
    every = Window.partitionBy("as_of")
    w = F.when(F.sum("w").over(every) > 0, c("w")).otherwise(1 / F.count("*").over(every))
    age = F.greatest(F.lit(0), F.datediff(asked, "as_of"))
    return held.select("ticker", w.alias("w"), "as_of", age.alias("days_old"), (age > stale_after).alias("stale")).where(c("w") > least)


def sector_weights(weights: DataFrame, companies: DataFrame) -> DataFrame:
    """(trade_date, sector, w): sums by sector; tickers without a company count as cash."""
    return weights.join(companies.select("ticker", "sector"), "ticker", "left").groupBy("trade_date", F.coalesce("sector", F.lit(CASH)).alias("sector")).agg(F.sum("w").alias("w"))


def weight_changes(weights: DataFrame, days: DataFrame, least: float = 0.001) -> DataFrame:
    """(ticker, first_w, second_w, change): names whose weight differs by more than `least` between two days, as entered,
    exited or resized: the earliest a and the latest b of a table (a, b), which is one row. No row, or null days, no names."""
    days = days.agg(F.min("a").alias("a"), F.max("b").alias("b"))
    met = weights.join(F.broadcast(days), c("trade_date").isin(c("a"), c("b")))
    on = lambda d: F.coalesce(F.sum(F.when(c("trade_date") == c(d), c("w"))), F.lit(0.0))
    both = met.groupBy("ticker").agg(on("a").alias("first_w"), on("b").alias("second_w")).where(F.abs(c("second_w") - c("first_w")) > least)
    return both.withColumn("change", F.when(c("first_w") == 0, "entered").when(c("second_w") == 0, "exited").otherwise("resized"))


def concentration(weights: DataFrame) -> DataFrame:
    """(trade_date, entropy, top): entropy of a day's weights and the largest one."""
    return weights.groupBy("trade_date").agg((-F.sum(F.when(c("w") > 0, c("w") * F.log("w")).otherwise(0.0))).alias("entropy"), F.max("w").alias("top"))


def market_forward(prices: DataFrame, days: int) -> DataFrame:
    """forward: log return to the day that is so many market days later; null where the ticker has no price there. A key is one
    row, as in a panel. Days are numbered and sent to all tasks (a row for each day); a window by ticker over the numbers
    finds the later price, so that prices don't meet themselves in a join."""
    axis = prices.select("trade_date").distinct().where("trade_date IS NOT NULL").withColumn("_i", F.row_number().over(Window.orderBy("trade_date")))
    met = prices.join(F.broadcast(axis), "trade_date", "left")
    then = Window.partitionBy("ticker").orderBy("_i").rangeBetween(days, days)
    met = met.withColumn("_later", F.when(c("_i").isNotNull() & c("ticker").isNotNull(), F.first("adj_close").over(then)))
    return met.withColumn("forward", F.when((c("adj_close") > 0) & (c("_later") > 0), F.log(c("_later") / c("adj_close")))).drop("_i", "_later")


def signal_report(panel: DataFrame, features: list[str], target: str, min_names: int = 10) -> DataFrame:
    """(feature, period, n, mean, std, t): rank correlations with the target by day, summed up over five years and (period
    null) over all. The target is ranked once by day, and all features in one long pass of narrow rows. An average rank is the
    mean of the first and the last place of equal values, both in one order, so a task sorts its rows once in each pass."""

    def rank(k: str, by: list[str]) -> Column:
        order = Window.partitionBy(*by).orderBy(c(k).asc_nulls_last())
        upto = F.count(k).over(order.rangeBetween(Window.unboundedPreceding, 0))
        return F.when(c(k).isNotNull(), (F.rank().over(order) + upto) / 2.0)

    wide = panel.select("trade_date", c(target).alias("_t"), *[c(k).cast("double").alias(f"_{i}") for i, k in enumerate(features)])
    wide = wide.withColumn("_b", rank("_t", ["trade_date"]))
    each = F.array(*[F.struct(F.lit(i).alias("_f"), c(f"_{i}").alias("x")) for i in range(len(features))])
    # rows without a target rank too; a name is put back when a day's rows are one
    long = wide.select("trade_date", "_b", F.explode(each).alias("_e")).select("trade_date", "_b", "_e.*").where("x IS NOT NULL")
    both = long.withColumn("_a", rank("x", ["trade_date", "_f"])).where("_b IS NOT NULL")
    ic = both.groupBy("_f", "trade_date").agg(F.count("*").alias("_n"), correlation("_a", "_b").alias("ic")).where((c("_n") >= min_names) & c("ic").isNotNull())
    ic = ic.withColumn("feature", F.element_at(F.array(*map(F.lit, features)), c("_f") + 1)).withColumn("period", (F.floor(F.year("trade_date") / 5) * 5).cast("int"))
    out = ic.rollup("feature", "period").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std")).where("feature IS NOT NULL")
    return out.withColumn("t", F.try_divide(c("mean"), c("std") / F.sqrt("n")))


def varying(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature): the columns that have two distinct values or more, in one pass."""
    row = df.agg(*[(F.min(k) < F.max(k)).alias(k) for k in features])
    return row.unpivot([], features, "feature", "_ok").where("_ok").select("feature")


def summary_of_windows(returns: DataFrame, by: str = "window_id") -> DataFrame:
    """(strategy, n_windows, mean, std, least, most) of the Sharpe ratios of each strategy's windows; std is the population's."""
    sharpe = F.avg("r") / (F.stddev_pop("r") + 1e-12) * F.sqrt(F.lit(252.0))
    each = returns.groupBy("strategy", by).agg(F.when(F.count("r") < 2, 0.0).otherwise(sharpe).alias("_s"))
    return each.groupBy("strategy").agg(F.count("*").alias("n_windows"), F.avg("_s").alias("mean"), F.stddev_pop("_s").alias("std"), F.min("_s").alias("least"), F.max("_s").alias("most"))


def _md5_heads(words: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of texts of one block, given as 16 rows of 32-bit words: the first word of the state."""
    old = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, d, e = (np.full(words.shape[1], x, np.uint32) for x in old)
    f, more, some = np.empty_like(a), np.empty_like(a), words.any(axis=1)
    for i in range(61):  # what follows changes other words of the state
        if i < 16:
            g = i
            np.bitwise_xor(d, e, f)
            f &= b
            f ^= e
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, d, f)
            f &= e
            f ^= d
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, d, f)
            f ^= e
        else:
            g = (7 * i) % 16
            np.invert(e, f)
            f |= b
            f ^= d
        a += f
        if some[g]:
            a += words[g]
        a += MD5_ADD[i]
        turn = MD5_TURN[i // 16][i % 4]
        np.right_shift(a, np.uint32(32 - turn), more)
        a <<= np.uint32(turn)
        a |= more
        a += b
        a, b, d, e = e, a, b, d
    return b + np.uint32(old[0])


def text_block(days: list[str], tickers: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts day|ticker as rows of bytes, with their lengths; zero follows a text."""
    texts = [f"{d}|{t}".encode() for d, t in zip(days, tickers)]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.array(texts, f"S{max(1, size.max(initial=1))}").view(np.uint8).reshape(len(texts), -1), size


def text_heads(prefix: bytes, block: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first 32 bits of the MD5 of the prefix and each text, as numbers. Texts beyond one block of MD5 go through hashlib."""
    held, size = block
    rows, whole = np.arange(len(size)), size + len(prefix)
    out = np.zeros(len(size), np.uint32)
    short = np.flatnonzero(whole <= 55)
    for at in range(0, len(short), MD5_ROWS):
        own = short[at : at + MD5_ROWS]
        data = np.zeros((len(own), 64), np.uint8)
        data[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
        width = min(held.shape[1], 55 - len(prefix))
        data[:, len(prefix) : len(prefix) + width] = held[own, :width]
        data[rows[: len(own)], whole[own]] = 0x80
        data[:, 56:60] = (8 * whole[own]).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[own] = _md5_heads(np.ascontiguousarray(data.view("<u4").T)).byteswap()  # the hex text is by bytes, lowest first
    for i in np.flatnonzero(whole > 55):
        out[i] = int.from_bytes(hashlib.md5(prefix + held[i, : size[i]].tobytes()).digest()[:4], "big")
    return out.astype(float)


def random_portfolios(returns: DataFrame, runs: int = 200, seed: int = 0) -> DataFrame:
    """(strategy, date, r) of `runs` portfolios with random weights each day: a name's weight is a hash of seed, run, day and
    ticker over the day's sum, so a task that runs again draws the same. A task hashes a batch for one run after another and
    sums it by day, so rows are never multiplied by runs: what leaves a task is two sums for each run and day of a batch. Names
    without a return take no part, and a row without ticker or day adds its day alone, as a null hash does in SQL."""
    rows = returns.where("returns IS NOT NULL").select(F.col("trade_date").cast("string").alias("day"), "ticker", F.expm1("returns").alias("r"))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _larger(batches):
            code = pa.concat_arrays(table["day"].chunks).dictionary_encode("encode")
            days, at = code.dictionary.to_pylist(), code.indices.to_numpy()
            r, block = table["r"].to_numpy(), text_block(table["day"].to_pylist(), table["ticker"].to_pylist())
            named = np.array([d is not None and t is not None for d, t in zip(table["day"].to_pylist(), table["ticker"].to_pylist())], float)
            sums = np.empty((2, runs, len(days)))
            for run in range(runs):
                u = (text_heads(f"{seed}|{run}|".encode(), block) + 1.0) * named
                sums[0, run], sums[1, run] = np.bincount(at, u * r, len(days)), np.bincount(at, u, len(days))
            yield pa.RecordBatch.from_arrays([pa.array(days, pa.string()), pa.array(list(sums[0].T)), pa.array(list(sums[1].T))], ["day", "ur", "u"])

    summed = rows.mapInArrow(drawn, "day string, ur array<double>, u array<double>")
    each = summed.select("day", F.posexplode(F.arrays_zip("ur", "u")).alias("_run", "_s")).groupBy("_run", "day").agg(F.try_divide(F.sum("_s.ur"), F.sum("_s.u")).alias("r"))
    return each.select(F.concat(F.lit("random"), c("_run").cast("string")).alias("strategy"), c("day").cast("date").alias("date"), "r")


def _larger(batches: Iterator[pa.RecordBatch], least: int = 1 << 17) -> Iterator[pa.Table]:
    """Batches put together to tables of `least` rows or more, and the rest."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= least:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)
