"""Idempotent upserts of keyed tables, by batch and by stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.streaming.store import Store, stream_into


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows, one for each key: a new row wins over an old one."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc("_batch"), F.hash(*[c for c in new.columns if c not in keys]))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_batch")


def stream_upsert(spark: SparkSession, source: str, schema, target: str, keys: list[str], checkpoint: str, parts: int = 64, sequence: str | None = None) -> DataFrame:
    """Loads the new Parquet files of a folder into a versioned store and returns its table. `sequence` names the column of the
    fetch sequence, of which the highest wins; without one a later batch does. A run that was stopped anywhere loses no row,
    and a batch that is run again gives the same table."""
    store = Store(spark, target, keys, parts)
    stream_into(spark, source, schema, store, checkpoint, sequence)
    return store.read()
