"""Dense arrays of days times names, kept as blocks of a fixed shape, and their long form."""

from __future__ import annotations

import datetime as dt
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

c = F.col
DAYS, NAMES = 128, 64
EPOCH = dt.date(1970, 1, 1)


def blocks(long: DataFrame, features: list[str], date: str = "date", days: int = DAYS, names: int = NAMES) -> DataFrame:
    """A row for each block of `days` days and `names` tickers that has cells: day_block, name_block, the block's dates and
    tickers, and of each cell its place (i, j) and values. A task gathers the cells of a block, never more. Days and names are
    numbered over one row each. Of rows that share a cell one stays, by value."""
    cells = long.select(c(date).alias("date"), "ticker", *[c(f).cast("double").alias(f) for f in features]).where("date IS NOT NULL AND ticker IS NOT NULL")
    axis = lambda k, n: cells.select(k).distinct().select(k, (F.row_number().over(Window.orderBy(k)) - 1).alias(f"_{n}"))
    met = cells.join(axis("date", "i"), "date").join(axis("ticker", "j"), "ticker")
    put = met.select(F.floor(c("_i") / days).cast("int").alias("day_block"), F.floor(c("_j") / names).cast("int").alias("name_block"), F.struct((c("_i") % days).alias("i"), (c("_j") % names).alias("j"), "date", "ticker", *features).alias("cell"))
    got = put.groupBy("day_block", "name_block").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    part = lambda k: F.transform("cells", lambda x: x[k]).alias(k)
    return got.select("day_block", "name_block", *[part(k) for k in ("i", "j", "date", "ticker", *features)])


@dataclass
class Written(WriterCommitMessage):
    entries: list[dict]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class BlockWriter(DataSourceArrowWriter):
    """Each task writes its blocks as files of new names; commit names them in the manifest, which replaces the old one at
    once. What a failed write leaves is named nowhere; abort deletes what it knows of."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.features = options["features"].split(",")
        self.days, self.names = int(options.get("days", DAYS)), int(options.get("names", NAMES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        place, root = _open(self.path)
        place.create_dir(f"{root}/blocks", recursive=True)
        entries = []
        for batch in iterator:
            for at_block in range(batch.num_rows):  # a batch may hold all of a task's blocks, which as Python's numbers are many times larger
                row = batch.slice(at_block, 1).to_pylist()[0]
                values = np.full((len(self.features), self.days, self.names), np.nan)
                mask = np.zeros((self.days, self.names), bool)
                dates, tickers = np.full(self.days, -(1 << 31), np.int32), [""] * self.names
                i, j = np.array(row["i"]), np.array(row["j"])
                mask[i, j] = True
                for k, f in enumerate(self.features):
                    values[k, i, j] = np.array(row[f], float)  # null is NaN
                dates[i] = [(d - EPOCH).days for d in row["date"]]
                for at, t in zip(row["j"], row["ticker"]):
                    tickers[at] = t
                out, name = io.BytesIO(), f"blocks/{uuid.uuid4().hex}.npz"
                np.savez_compressed(out, values=values, mask=mask, dates=dates, tickers=np.array([json.dumps(tickers)]))
                with place.open_output_stream(f"{root}/{name}") as file:
                    file.write(out.getvalue())
                entries.append({"file": name, "first": str(min(row["date"])), "last": str(max(row["date"])), "least": min(row["ticker"]), "most": max(row["ticker"]), "cells": len(i)})
        return Written(entries)

    def commit(self, messages) -> None:
        place, root = _open(self.path)
        entries = [e for m in messages if m for e in m.entries]
        if not self.overwrite and place.get_file_info(f"{root}/manifest.json").type != pafs.FileType.NotFound:
            with place.open_input_stream(f"{root}/manifest.json") as file:
                entries = json.loads(file.read())["blocks"] + entries
        part = f"{root}/manifest-{uuid.uuid4().hex}.part"
        place.create_dir(root, recursive=True)
        with place.open_output_stream(part) as file:
            file.write(json.dumps({"features": self.features, "days": self.days, "names": self.names, "blocks": entries}).encode())
        place.move(part, f"{root}/manifest.json")

    def abort(self, messages) -> None:
        place, root = _open(self.path)
        for m in messages:
            for e in m.entries if m else ():
                place.delete_file(f"{root}/{e['file']}")


class Block(InputPartition):
    def __init__(self, file: str):
        self.file = file


class BlockReader(DataSourceReader):
    """One partition a block; blocks whose dates or tickers lie outside the filters aren't opened."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.first, self.last, self.only = "", "9999-99-99", None

    def pushFilters(self, filters):
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name == "date" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, str(value))
            if name == "date" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.last = min(self.last, str(value))
            if name == "ticker" and isinstance(f, (EqualTo, In)):
                asked = set(value) if isinstance(f, In) else {value}
                self.only = asked if self.only is None else self.only & asked
            yield f

    def partitions(self) -> list[Block]:
        near = lambda e: e["last"] >= self.first and e["first"] <= self.last and (self.only is None or any(e["least"] <= t <= e["most"] for t in self.only))
        return [Block(e["file"]) for e in _manifest(self.path)["blocks"] if near(e)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        place, root = _open(self.path)
        with place.open_input_stream(f"{root}/{partition.file}") as file:
            held = np.load(io.BytesIO(file.read()))
            values, mask, dates, tickers = held["values"], held["mask"], held["dates"], json.loads(str(held["tickers"][0]))
        i, j = np.nonzero(mask)
        columns = [pa.array(dates[i], pa.int32()).cast(pa.date32()), pa.array([tickers[k] for k in j], pa.string())]
        columns += [pa.array(v[i, j], from_pandas=True) for v in values]
        yield pa.RecordBatch.from_arrays(columns, ["date", "ticker", *_manifest(self.path)["features"]])


def _manifest(path: str) -> dict:
    place, root = _open(path)
    with place.open_input_stream(f"{root}/manifest.json") as file:
        return json.loads(file.read())


class ArrayBlocks(DataSource):
    """format("array_blocks"): writes the rows of blocks(), with the options features (comma-separated), days and names, and
    reads back (date, ticker, features), a row for each cell that was there. Every block holds an array of features x days x
    names, where NaN is null, a mask of the cells that are there, and its two axes. Modes append and overwrite; a write that
    fails leaves the store as it was."""

    @classmethod
    def name(cls) -> str:
        return "array_blocks"

    def schema(self) -> str:
        return ", ".join(["date date", "ticker string", *(f"`{f}` double" for f in _manifest(self.options["path"].rstrip("/"))["features"])])

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options, overwrite)


def write_arrays(long: DataFrame, path: str, features: list[str], date: str = "date", days: int = DAYS, names: int = NAMES, mode: str = "overwrite") -> None:
    """The long rows as an array store at a path. What is appended has axes of its own."""
    spark = long.sparkSession
    spark.dataSource.register(ArrayBlocks)
    blocks(long, features, date, days, names).write.format("array_blocks").option("features", ",".join(features)).option("days", days).option("names", names).mode(mode).save(path)


def read_arrays(spark, path: str) -> DataFrame:
    """The cells of an array store in long form, each once for each write that had it. Filters on date and ticker choose the
    blocks, for which the session's push-down into Python sources is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayBlocks)
    return spark.read.format("array_blocks").load(path)
