"""A keyed table in versioned partitions, whose writes take effect at once or not at all.

Rows lie in partitions by a hash of their keys. A write merges the partitions that it touches into new folders and then
publishes a manifest, a small file that names each partition's folder; until the manifest is there, readers see the version
before. A driver lost at any point leaves the old rows where they are, and folders that no manifest names, which vacuum()
deletes. Of a key's rows the one of the highest fetch sequence stays, whatever order they arrive in.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SEQUENCE, PART = "_sequence", "_part"
#: Rows of a file, about, where a writer leaves their number to the store.
FILE_ROWS = 1 << 20


class Conflict(RuntimeError):
    """Another writer has published the version that this one was going to."""


def latest(rows: DataFrame, keys: list[str], sequence: str = SEQUENCE) -> DataFrame:
    """One row for each key: that of the highest sequence (null is lowest), of equal ones that of the highest hash, so that
    the same rows give the same table in any order. Rows of a key meet partly aggregated, however many there are."""
    rest = [k for k in rows.columns if k not in keys]
    best = F.max_by(F.struct(*rest), F.struct(sequence, F.xxhash64(*rest)))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


class Store:
    """The table at a path; keys and the number of partitions are fixed by the first write."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, parts: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        at = self.manifest()
        self.keys, self.parts = (at["keys"], at["parts"]) if at else (keys, parts)
        if keys and keys != self.keys:
            raise ValueError(f"the table's keys are {self.keys}")

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, by default the last; None before the first write."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        lines = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).collect()
        return json.loads(lines[0][0])

    def _publish(self, manifest: dict) -> None:
        """Writes the file under another name and renames it, which is refused where the version is there already."""
        name = f"{self.path}/manifests/{manifest['version']:012d}.json"
        part = self._path(f"{name}.{uuid.uuid4().hex}.part")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(part, self._path(name), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def _read(self, manifest: dict, parts: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/{f}" for p, f in manifest["folders"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        manifest = self.manifest(version)
        if manifest is None:
            raise ValueError(f"nothing is stored at {self.path}")
        return self._read(manifest).drop(SEQUENCE)

    def upsert(self, rows: DataFrame, sequence: str | int, files: int | None = None, tries: int = 5) -> int:
        """Merges rows in and returns the version made. sequence: the column of the fetch sequence, or one number for all rows.
        Columns new to the table are null in its old rows, and columns that rows lack in the new ones. A partition is written
        by `files` tasks, by a further hash of the keys; without a number, by as many as its rows ask for. Against another writer the merge is done again on what that one left.
        """
        order = F.col(sequence).cast("long") if isinstance(sequence, str) else F.lit(sequence).cast("long")
        new = latest(rows.withColumn(SEQUENCE, order), self.keys).withColumn(PART, F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))
        folder = f"incoming/{uuid.uuid4().hex}"
        new.write.partitionBy(PART).parquet(f"{self.path}/{folder}")  # once: merges that are tried again read it
        new = self.spark.read.schema(new.schema).parquet(f"{self.path}/{folder}")
        touched = sorted(r[0] for r in new.select(PART).distinct().collect())  # at most `parts`
        try:
            for k in range(tries):
                try:
                    return self._merge(new, touched, files)
                except Conflict:
                    if k == tries - 1:
                        raise
        finally:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)

    def _merge(self, new: DataFrame, touched: list[int], files: int | None) -> int:
        manifest = self.manifest() or {"version": 0, "folders": {}, "keys": self.keys, "parts": self.parts}
        if not touched:
            return manifest["version"]
        both, files = new, files or -(-(new.count() + (self._read(manifest, touched).count() if manifest["folders"] else 0)) // (FILE_ROWS * len(touched)))
        if manifest["folders"]:
            old = self._read(manifest, touched).withColumn(PART, F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))
            both = old.unionByName(new, allowMissingColumns=True)
            both = latest(both, [PART, *self.keys])  # incoming rows alone are so already
        place = f"data/{uuid.uuid4().hex}"
        part = F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(files))
        dealt = both.repartition(PART, part) if files == 1 else both.repartition(files * len(touched), PART, part)
        dealt.write.partitionBy(PART).parquet(f"{self.path}/{place}")
        fields = [f for f in both.schema.fields if f.name not in (PART, SEQUENCE)]
        schema = StructType([*(StructField(f.name, f.dataType) for f in fields), StructField(SEQUENCE, LongType())])
        version = manifest["version"] + 1
        self._publish({"version": version, "keys": self.keys, "parts": self.parts, "schema": schema.jsonValue(), "folders": manifest["folders"] | {str(p): f"{place}/{PART}={p}" for p in touched}})
        return version

    def vacuum(self, keep: int = 2, older_seconds: float = 7 * 86400) -> int:
        """Deletes manifests before the last `keep`, and folders that no manifest left names and that are older than any write
        still under way. Returns the number of folders deleted."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:012d}.json"), False)
        named = {f for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = 0
        for top in ("data", "incoming"):
            if self._fs.exists(folder := self._path(f"{self.path}/{top}")):
                for run in self._fs.listStatus(folder):
                    if time.time() - run.getModificationTime() / 1000 < older_seconds:
                        continue
                    for part in self._fs.listStatus(run.getPath()):
                        if f"{top}/{run.getPath().getName()}/{part.getPath().getName()}" not in named and part.isDirectory():
                            gone += bool(self._fs.delete(part.getPath(), True))
        return gone


def stream_into(spark: SparkSession, source: str, schema, store: Store, checkpoint: str, sequence: str | None = None, files: int | None = None) -> None:
    """Loads the new Parquet files of a folder into a store and returns when all are loaded. Without a column of the fetch
    sequence a later batch wins. A batch that runs again has the same sequence as before, so the table stays the same."""

    def write(batch: DataFrame, epoch: int) -> None:
        store.upsert(batch, sequence or epoch, files)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
