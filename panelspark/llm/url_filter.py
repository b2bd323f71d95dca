"""Dated host lists against page captures (operator 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import table

#: List entries (pattern, day from the epoch, action): a pattern is a host, a parent domain, or host and first folder.
#: The log's fixed part; the query adds entries for hosts of the table by rule.
ENTRIES = [
    ("casino-win.example.net", 18300, "add"),
    ("casino-win.example.net", 18900, "remove"),
    ("casino-win.example.net", 19200, "add"),
    ("casino-win.example.com", 18500, "add"),
    ("example.org", 19000, "add"),
    ("example.org", 19060, "remove"),
]
FIRST_DAY, DAYS = 18262, 1461


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until) from a log (pattern, day, action): an add holds until the pattern's next entry, or for good
    (until null). Of a pattern's entries on one day a remove wins. Rows with a null are dropped; other actions are too."""
    log = entries.where("pattern IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    log = log.groupBy("pattern", "day").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    until = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return log.withColumn("until", until).where("action = 'add'").select("pattern", F.col("day").alias("since"), "until")


def host_of(url):
    """A URL's host in lower case, without user, port and a last dot; empty if it has none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"\.+$", "")


def keys_of(url) -> F.Column:
    """The patterns that can match a URL: its host, each parent domain of two labels or more (an address of four numbers has
    none), and host/folder."""
    host = host_of(url)
    folder = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)
    parts = F.split(host, r"\.")
    last = F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.lit(1)).otherwise(F.greatest(F.size(parts) - 1, F.lit(1)))
    tails = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.array_distinct(F.filter(F.concat(tails, F.when((folder != "") & (host != ""), F.array(F.concat(host, F.lit("/"), folder))).otherwise(F.array().cast("array<string>"))), lambda x: x != ""))


def active(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(pattern, day, since) of the asked (pattern, day) on which an interval of the pattern holds. The as-of join: intervals
    and days of a pattern in one order, in which each day takes the last interval that began; earlier ones have ended. A
    pattern's rows are its distinct days and its entries."""
    began = intervals(entries).select("pattern", F.col("since").alias("day"), F.lit(0).alias("side"), F.struct("since", "until").alias("held"))
    both = asked.select("pattern", "day", F.lit(1).alias("side")).unionByName(began, allowMissingColumns=True)
    last = F.last("held", ignorenulls=True).over(Window.partitionBy("pattern").orderBy("day", "side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("held", last).where("side = 1 AND held IS NOT NULL")
    return found.where(F.col("held.until").isNull() | (F.col("day") < F.col("held.until"))).select("pattern", "day", F.col("held.since").alias("since"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture (page_id, url, day) with blocked, n_rules (patterns active on its day) and listed_days (days since the
    oldest of these entries, null if none).

    (pattern, day) pairs are made distinct before the as-of join, so a hot host brings one row for each day. A null or
    malformed url has no patterns, a null day no active entry: not blocked. Repeated rows give repeated rows, an empty table
    none. Other columns aren't read.
    """
    asked = captures.select("page_id", "url", "day").withColumn("patterns", F.coalesce(keys_of(F.col("url")), F.array().cast("array<string>")))
    found = active(asked.select(F.explode("patterns").alias("pattern"), "day").where("day IS NOT NULL").distinct(), entries)
    # hits by the set of patterns and the day: what captures of one host and folder share
    shapes = asked.select("patterns", "day").distinct()
    hits = shapes.withColumn("pattern", F.explode("patterns")).join(found, ["pattern", "day"]).groupBy("patterns", "day").agg(F.count("*").alias("n"), F.min("since").alias("oldest"))
    out = asked.join(hits, ["patterns", "day"], "left")
    return out.select("page_id", "url", "day", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0).cast("long")).alias("n_rules"), (F.col("day") - F.col("oldest")).alias("listed_days"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages have no fetch time; the query takes day FIRST_DAY + (7919 * page_id mod DAYS)."""
    return pages.select("page_id", "url", (F.pmod(F.col("page_id") * 7919, F.lit(DAYS)) + FIRST_DAY).cast("int").alias("day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """The fixed entries, and for hosts h of the table: c, the first 7 hex digits of md5(h); if c mod 5 is 0 an add on day FIRST_DAY + c mod DAYS,
    and if c mod 10 is 0 a remove 200 days later."""
    spark = pages.sparkSession
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern <> ''").distinct()
    c = F.conv(F.substring(F.md5("pattern"), 1, 7), 16, 10).cast("long")
    adds = hosts.where(c % 5 == 0).select("pattern", (c % DAYS + FIRST_DAY).cast("int").alias("day"), F.lit("add").alias("action"))
    removes = hosts.where(c % 10 == 0).select("pattern", (c % DAYS + FIRST_DAY + 200).cast("int").alias("day"), F.lit("remove").alias("action"))
    return adds.union(removes).union(spark.createDataFrame(ENTRIES, "pattern string, day int, action string"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return evaluate(captures_of(pages), entries_of(pages))


def op3_sql() -> str:
    """The query in DuckDB's SQL."""
    fixed = ", ".join(f"('{p}', {d}, '{a}')" for p, d, a in ENTRIES)
    return rf"""
WITH u AS (SELECT page_id, url, (({FIRST_DAY} + ((page_id * 7919) % {DAYS} + {DAYS}) % {DAYS}))::INT AS day,
    regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.+$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/', 1) AS folder FROM pages),
h AS (SELECT DISTINCT host AS pattern, ('0x' || substr(md5(host), 1, 7))::BIGINT AS c FROM u WHERE host <> ''),
log AS (SELECT pattern, (c % {DAYS} + {FIRST_DAY})::INT AS day, 'add' AS action FROM h WHERE c % 5 = 0
    UNION ALL SELECT pattern, (c % {DAYS} + {FIRST_DAY} + 200)::INT, 'remove' FROM h WHERE c % 10 = 0
    UNION ALL SELECT * FROM (VALUES {fixed})),
one AS (SELECT pattern, day, max(action) AS action FROM log GROUP BY ALL),
iv AS (SELECT pattern, day AS since, until, action FROM (SELECT *, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM one) WHERE action = 'add'),
rows_ AS (SELECT row_number() OVER () AS r, * FROM u),
p AS (SELECT r, unnest(list_distinct(list_filter(list_concat(
    list_transform(range(1, CASE WHEN regexp_full_match(host, '[0-9]+(\.[0-9]+){{3}}') THEN 1 ELSE greatest(len(string_split(host, '.')) - 1, 1) END + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
    CASE WHEN folder <> '' AND host <> '' THEN [host || '/' || folder] ELSE [] END), lambda x: x <> ''))) AS pattern, day FROM rows_ WHERE url IS NOT NULL),
hit AS (SELECT r, count(*) AS n, min(since) AS oldest FROM p JOIN iv USING (pattern) WHERE day >= since AND (until IS NULL OR day < until) GROUP BY r)
SELECT page_id, url, day, n IS NOT NULL AS blocked, coalesce(n, 0)::BIGINT AS n_rules, (day - oldest)::INT AS listed_days FROM rows_ LEFT JOIN hit USING (r)
"""
