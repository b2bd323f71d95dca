"""Sources in files: tables with a fixed schema, logs and documents; date chunks, marks and parsed rates of fetched data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

c = F.col

# Columns of the tables.
SCHEMAS = {
    "prices": "ticker string, trade_date date, open double, high double, low double, close double, adj_open double, adj_high double, adj_low double, adj_close double, volume double, volume_adjusted double, traded_amount double, num_trades double",
    "dividends": "ticker string, ex_date date, payment_date date, type string, value_per_share double, adjusted boolean",
    "company_info": "ticker string, ticker_primary string, corporate_name string, trade_name string, cvm_code string, cnpj string, sector string, status string",
    "results": "date date, strategy string, log_return double, value double",
}


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column: missing is null in all operators."""
    return df.withColumns({f.name: F.when(~F.isnan(c(f"`{f.name}`")), c(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))})


def scan(spark: SparkSession, path: str, schema: str | StructType, columns: list[str] | None = None, tickers: list[str] | None = None, start: str | None = None, end: str | None = None, date: str = "trade_date") -> DataFrame:
    """Parquet files of a folder (one a ticker, or any) by a schema; columns that a file lacks are null. Asked columns,
    tickers and dates (both ends included) reach the scan: filters come before NaN is replaced, which they would not pass."""
    df = spark.read.schema(SCHEMAS.get(schema, schema) if isinstance(schema, str) else schema).option("recursiveFileLookup", "true").parquet(path)
    if tickers is not None:
        df = df.where(c("ticker").isin(tickers))
    if start is not None:
        df = df.where(c(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(c(date) <= F.lit(end).cast("date"))
    return without_nan(df.select(*columns) if columns else df)


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Drops the columns that hold no value in any row, found in one pass over the table."""
    some = df.agg(*[F.count(c(f"`{k}`")).alias(k) for k in df.columns]).first()
    return df.select(*[f"`{k}`" for k in df.columns if some[k]])


def tickers(df: DataFrame) -> DataFrame:
    return df.select("ticker").dropna().distinct()


def tickers_of_files(spark: SparkSession, path: str, pattern: str = r"([^/]+)\.parquet$") -> DataFrame:
    """(ticker, file, bytes) of a folder's files by their names alone: the scan lists files and opens none, so that a broken or
    unreadable body is listed too. Names that don't fit the pattern, of which the first group is the ticker, are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.url_decode(F.regexp_extract("path", pattern, 1))
    return found.select(name.alias("ticker"), c("path").alias("file"), c("length").alias("bytes")).where("ticker <> ''")


def listed(companies: DataFrame, pattern: str = "^[A-Z0-9]{4}[3-8]$", forced: tuple[str, ...] = ("BOVA11",)) -> DataFrame:
    """Rows whose ticker has the form of a share, and those asked for by name."""
    return companies.where(c("ticker").rlike(pattern) | c("ticker").isin(list(forced)))


def training_logs(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Lines of JSON of every file, with the run (the file's folder) and the file's name. Lines that aren't JSON are null rows
    and go."""
    place = c("_metadata.file_path")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).select("*", F.regexp_extract(place, "([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract(place, "([^/]+)$", 1).alias("file"))
    return rows.dropna(how="all", subset=[f for f in rows.columns if f not in ("run", "file")])


def metric_documents(spark: SparkSession, path: str) -> DataFrame:
    """(strategy, metric, value) of JSON documents {strategy: {metric: number}}, one a file."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("_m"))
    return text.select(F.explode("_m").alias("strategy", "_v")).select("strategy", F.explode("_v").alias("metric", "value"))


def date_chunks(spans: DataFrame, years: int) -> DataFrame:
    """(chunk_start, chunk_end) that cover each (start, end) in pieces of at most so many years, without overlap."""
    starts = F.sequence("start", "end", F.make_ym_interval(F.lit(years)))
    cut = spans.select("end", F.explode(starts).alias("chunk_start"))
    return cut.select("chunk_start", F.least(c("end"), F.date_sub(F.add_months("chunk_start", 12 * years), 1)).alias("chunk_end"))


def parsed_rates(raw: DataFrame, name: str) -> DataFrame:
    """(reference_date, name) of (data 'dd/MM/yyyy', valor with a decimal comma); rows where either can't be read go."""
    value = F.regexp_replace(F.trim("valor"), ",", ".").try_cast("double")
    return raw.select(F.try_to_date("data", "dd/MM/yyyy").alias("reference_date"), value.alias(name)).dropna()


def other_dividends(paid: DataFrame, date: str, value: str) -> DataFrame:
    """The dividends table of a source that has dates and amounts alone: amounts above 0, of one type, adjusted for splits, with
    no day of payment."""
    kept = paid.where(c(value) > 0).select("ticker", c(date).cast("date").alias("ex_date"), c(value).cast("double").alias("value_per_share"))
    return kept.select("ticker", "ex_date", F.lit(None).cast("date").alias("payment_date"), F.lit("DIVIDEND").alias("type"), "value_per_share", F.lit(True).alias("adjusted"))


def high_water_mark(df: DataFrame, date: str = "trade_date") -> DataFrame:
    """(ticker, mark): each ticker's last date, from where fetching goes on."""
    return df.groupBy("ticker").agg(F.max(date).alias("mark"))


def rows_after(new: DataFrame, marks: DataFrame, date: str = "trade_date") -> DataFrame:
    """New rows later than their ticker's mark; all of a ticker without one."""
    return new.join(marks, "ticker", "left").where(c("mark").isNull() | (c(date) > c("mark"))).drop("mark")
