"""Small helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Spark's setting by which a query's shuffle files are deleted when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one serves a local master; a
    cluster couldn't see it, which is an error."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="panelspark-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts its lineage. Its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelspark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        if files := df.inputFiles():
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(conf).delete(path, True)


def carried(docs: DataFrame, carry: tuple[str, ...], made: str) -> tuple[DataFrame, StructType]:
    """doc_id, text and the columns that an operator hands through unchanged, and the schema of these beside the made ones."""
    df = docs.select("doc_id", "text", *carry)
    return df, StructType([*StructType.fromDDL(made).fields, *df.schema.fields[2:]])


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def small_batches(batches, column: str = "text", limit: int = 4 << 20):
    """Cuts Arrow batches so that each holds about `limit` bytes of text at most, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
