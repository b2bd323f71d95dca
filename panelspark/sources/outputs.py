"""Sinks: wide backtest tables, allocation documents, key-value metadata and logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

#: Stands in a file's name for a ticker that is null, as in Spark's own names of partitions.
NO_TICKER = "__HIVE_DEFAULT_PARTITION__"


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_by_ticker(df: DataFrame, path: str) -> int:
    """One Parquet file for each ticker in a new folder, ticker=<name>.parquet, the name escaped as in a URL; the number of files.
    Each is written by batches under a hidden name and then renamed, so that a task that fails leaves no part of it. A folder for
    each ticker, as partitionBy makes them, costs a local disk without Hadoop's native library some 40 ms, and a task to list it."""
    place, root = pafs.FileSystem.from_uri(path)
    if place.get_file_info(root).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    place.create_dir(root, recursive=True)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = pafs.FileSystem.from_uri(path)
        ticker = key[0].as_py()
        file, part = f"{root}/ticker={NO_TICKER if ticker is None else quote(ticker, safe='')}.parquet", f"{root}/.{uuid.uuid4().hex}"
        first = next(batches)
        with pq.ParquetWriter(part, first.schema, filesystem=place) as out:
            out.write_batch(first)
            for batch in batches:
                out.write_batch(batch)
        if place.get_file_info(file).type == pafs.FileType.NotFound:
            place.move(part, file)
        else:  # an earlier attempt of this task wrote the same rows
            place.delete_file(part)
        yield pa.RecordBatch.from_pydict({"file": [file]})

    return df.groupBy("ticker").applyInArrow(run, "file string").count()


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def backtest_wide(values: DataFrame, weights: DataFrame, strategies: list[str], tickers: list[str]) -> DataFrame:
    """A row a date: value_<strategy> for each named strategy and w_<ticker> for each named ticker, 0 where it isn't held. The
    names are given, so that no pass over the data is needed for the columns."""
    value = values.groupBy("date").pivot("strategy", strategies).agg(F.first("value"))
    value = value.select("date", *[c(f"`{k}`").alias(f"value_{k}") for k in strategies])
    w = weights.groupBy("date").pivot("ticker", tickers).agg(F.sum("w"))
    return value.join(w.select("date", *[F.coalesce(c(f"`{k}`"), F.lit(0.0)).alias(f"w_{k}") for k in tickers]), "date", "left").na.fill(0.0, [f"w_{k}" for k in tickers])


def held_tickers(weights: DataFrame, least: float = 0.001) -> DataFrame:
    """(ticker): those whose largest weight is above `least`, for the wide table's columns."""
    return weights.groupBy("ticker").agg(F.max("w").alias("_w")).where(c("_w") > least).select("ticker")


def allocation_document(allocation: DataFrame) -> DataFrame:
    """One JSON text of an allocation (ticker, w, as_of, days_old, stale): its positions, largest first, a list as long as the
    universe of one day."""
    held = F.sort_array(F.collect_list(F.struct((-c("w")).alias("k"), "ticker", "w")))
    positions = F.transform(held, lambda p: F.struct(p["ticker"].alias("ticker"), p["w"].alias("weight")))
    return allocation.groupBy("as_of", "days_old", "stale").agg(positions.alias("positions")).select(F.to_json(F.struct("as_of", "days_old", "stale", "positions")).alias("document"))


def metric_document(metrics: DataFrame) -> DataFrame:
    """One JSON text {strategy: {metric: value}} of (strategy, metric, value), which holds a row for each of a run's metrics."""
    each = metrics.groupBy("strategy").agg(F.sort_array(F.collect_list(F.struct("metric", "value"))).alias("_m"))
    every = F.sort_array(F.collect_list(F.struct("strategy", "_m")))
    return each.agg(F.to_json(F.map_from_entries(F.transform(every, lambda e: F.struct(e["strategy"], F.map_from_entries(e["_m"]))))).alias("document"))


def write_allocation(allocation: DataFrame, path: str) -> None:
    """An allocation of one day as CSV files with a header."""
    allocation.select("as_of", "ticker", "w", "days_old", "stale").write.mode("overwrite").option("header", "true").csv(path)


def write_metadata(rows: DataFrame, path: str) -> None:
    """Key-value metadata (key, value), by which a later run is compared with this one."""
    rows.select("key", "value").write.mode("overwrite").json(path)


def metadata_differences(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(key, stored, current) of two tables (key, value) where they differ or one lacks the key."""
    a, b = stored.select("key", c("value").alias("stored")), current.select("key", c("value").alias("current"))
    return a.join(b, "key", "full").where(~c("stored").eqNullSafe(c("current")))
