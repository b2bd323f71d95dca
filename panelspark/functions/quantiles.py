"""Exact quantiles of whole columns, found by selection: no column is sorted, or held, in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.scratch import kept

c = F.col
#: Distinct values of a group that a task sorts, about; cuts of a group at most.
PART_VALUES, MOST_PARTS = 1 << 20, 10_000


def exact_quantiles(long: DataFrame, by: str, x: str, shares: list[float], part_values: int = PART_VALUES) -> DataFrame:
    """(by, n, n_distinct, quantiles): for each group of `by` the number of values, of distinct ones, and the quantiles at the
    shares, interpolated between neighbours. Null values don't count; a group of nulls has n 0 and null quantiles.

    Values are counted first, and the counts stored, as each of the passes after reads them. They are cut at approximate quantiles. The counts below the cuts tell in which cut each wanted rank
    lies, and only those cuts are sorted, each by itself. The cuts don't change the result.
    """
    counts = kept(long.select(c(by).alias("_g"), c(x).cast("double").alias("_x")).groupBy("_g", "_x").agg(F.count("_x").alias("_n")), "counts")
    sizes = counts.groupBy("_g").agg(F.sum("_n").alias("n"), F.sum(c("_x").isNotNull().cast("long")).alias("n_distinct"))
    most = sizes.agg(F.max("n_distinct")).first()[0] or 0
    parts = int(min(MOST_PARTS, max(1, -(-most // part_values))))
    some = counts.where("_n > 0")
    if parts > 1:
        cuts = some.groupBy("_g").agg(F.percentile_approx("_x", [i / parts for i in range(1, parts)], 4 * parts).alias("_cuts"))
        # the number of cuts below a value, by halving: cuts are sorted, and up to 10,000
        cuts = cuts.withColumn("_cuts", F.array_distinct("_cuts"))
        met = some.join(cuts, some["_g"].eqNullSafe(cuts["_g"])).select(some["*"], "_cuts")
        bounds = F.struct(F.lit(0).alias("a"), F.size("_cuts").alias("b"))
        middle = lambda s: F.floor((s["a"] + s["b"]) / 2).cast("int")
        halve = lambda s, _: F.when(s["a"] >= s["b"], s).when(F.get(c("_cuts"), middle(s)) < c("_x"), F.struct((middle(s) + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), middle(s).alias("b")))
        some = met.withColumn("_part", F.aggregate(F.sequence(F.lit(1), F.lit(parts.bit_length() + 1)), bounds, halve)["a"]).drop("_cuts")
    else:
        some = some.withColumn("_part", F.lit(0))
    held = some.groupBy("_g", "_part").agg(F.sum("_n").alias("_held"))
    held = held.withColumn("_before", F.sum("_held").over(Window.partitionBy("_g").orderBy("_part")) - c("_held"))
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(shares)))
    asked = sizes.where("n > 0").select("_g", F.explode(wanted).alias("w")).join(sizes.withColumnRenamed("_g", "_h"), c("_g").eqNullSafe(c("_h"))).withColumn("_at", c("w.q") * (c("n") - 1))
    ranks = asked.select("_g", "w.i", (c("_at") - F.floor("_at")).alias("rest"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("_at").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("_at").alias("rank")))).alias("r")).select("_g", "i", "rest", "r.*")
    # ranks of a group are few, as are its parts: each finds its part by the counts
    ranks = ranks.withColumnRenamed("_g", "_h").join(held, c("_h").eqNullSafe(c("_g")) & (c("rank") >= c("_before")) & (c("rank") < c("_before") + c("_held")))
    places = ranks.select(c("_h").alias("_k"), c("_part").alias("_p"), "i", "rest", "side", (c("rank") - c("_before")).alias("_inside"))
    sought = places.select("_k", "_p").distinct()
    near = some.join(sought, c("_g").eqNullSafe(c("_k")) & (c("_part") == c("_p")), "left_semi")
    upto = F.sum("_n").over(Window.partitionBy("_g", "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_upto", upto)
    found = near.join(places, c("_g").eqNullSafe(c("_k")) & (c("_part") == c("_p")) & (c("_inside") < c("_upto")) & (c("_inside") >= c("_upto") - c("_n")))
    pairs = found.groupBy("_g", "i").agg(F.max(F.when(c("side") == 0, c("_x"))).alias("_low"), F.max(F.when(c("side") == 1, c("_x"))).alias("_high"), F.first("rest").alias("rest"))
    value = c("_low") + (c("_high") - c("_low")) * c("rest")
    each = pairs.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias("quantiles"))
    each = each.withColumnRenamed("_g", "_h")
    return sizes.join(each, c("_g").eqNullSafe(c("_h")), "left").select(c("_g").alias(by), "n", "n_distinct", "quantiles")
