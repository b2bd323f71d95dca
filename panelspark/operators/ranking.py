"""Rankers and importances of features, fitted by MLlib over all rows."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import correlation
from panelspark.sources.scratch import kept

c = F.col
#: Bins of a feature of the ranker, quantiles from which their cuts are taken, and cells of a task of its fit, about.
BINS, LEVELS, PART_CELLS = 32, 256, 1 << 17


def _doubles(panel: DataFrame, features: list[str]) -> DataFrame:
    return panel.withColumns({k: c(k).cast("double") for k in features})


def _cuts(quantiles: list[float]) -> list[float]:
    """Fewer than BINS of a feature's quantiles, taken evenly of the distinct ones, so that a value which many rows share leaves
    the others their cuts."""
    each = sorted({x for x in quantiles if math.isfinite(x)}) or [0.0]
    return each if len(each) < BINS else [each[i * len(each) // BINS] for i in range(1, BINS)]


def ranked(panel: DataFrame, features: list[str], target: str, trees: int = 20, depth: int = 3, seed: int = 0) -> DataFrame:
    """The panel's later half of days with a column predicted: boosted trees are fitted on the earlier half's rows that have a
    target; the half is one of days, so that no day is on both sides. Missing features take the column's median. Without a row
    to fit, predicted is null.

    All rows are put into bins of their features. Squared error asks only for the number and the mean target of the rows of a
    cell, which are those alike in all bins, so the trees are fitted on cells, weighted by their rows: the model is that of the
    binned rows, and its passes read cells only. The panel is stored, so give it no more columns than are read."""
    panel = kept(_doubles(panel, features), "ranked")
    middle = F.lit(panel.select("trade_date").distinct().agg(F.percentile(F.unix_date("trade_date"), 0.5)).first()[0]).cast("double")
    early, late = panel.where((F.unix_date("trade_date") <= middle) & c(target).isNotNull()), panel.where(F.unix_date("trade_date") > middle)
    # missing values don't count; a column that has no value has no quantiles
    quantiles = early.approxQuantile(features, [i / LEVELS for i in range(1, LEVELS)], 0.001)
    given, made = [f"_g{i}" for i in range(len(features))], [f"_f{i}" for i in range(len(features))]
    # a value is left of a cut that equals it, as in a tree
    splits = [[-math.inf, *[math.nextafter(x, math.inf) for x in _cuts(q)], math.inf] for q in quantiles]
    bucketizer = Bucketizer(splitsArray=splits, inputCols=given, outputCols=made)
    median = {g: F.coalesce(F.nanvl(k, F.lit(None).cast("double")), F.lit(q[LEVELS // 2 - 1] if q else 0.0)) for g, k, q in zip(given, features, quantiles)}
    # cast, as bins come with an attribute that would make them categories without order
    binned = lambda df: bucketizer.transform(df.withColumns(median)).drop(*given).withColumns({k: c(k).cast("byte") for k in made})
    cells = kept(binned(early).groupBy(*made).agg(F.count("*").cast("double").alias("_n"), F.avg(target).alias("_y")), "cells")
    n = cells.count()
    if not n:
        return late.withColumn("predicted", F.lit(None).cast("double"))
    vectors = VectorAssembler(inputCols=made, outputCol="_x")
    # of more than maxBins * maxBins rows MLlib would look for its splits in a sample, which may miss a bin
    gbt = GBTRegressor(featuresCol="_x", labelCol="_y", weightCol="_n", predictionCol="predicted", maxIter=trees, maxDepth=depth, maxBins=max(BINS, math.isqrt(n) + 1), seed=seed)
    model = gbt.fit(vectors.transform(cells.repartition(-(-n // PART_CELLS))))
    return model.transform(vectors.transform(binned(late))).drop("_x", *made)


def importances(panel: DataFrame, features: list[str], target: str, trees: int = 50, depth: int = 5, seed: int = 0) -> DataFrame:
    """(feature, forest, linear, correlated, consensus): importance in a random forest, size of the coefficient on
    standardised features, size of the correlation with the target, and the mean of the three ranks (1 is best). Only rows
    that have the target and all features take part; without a row the table is empty."""
    # stored, as each fit passes over its rows again and again, and would compute them anew each time
    rows = kept(_doubles(panel, features).dropna(subset=[*features, target]).select(*features, target), "importances")
    if rows.isEmpty():
        return panel.sparkSession.createDataFrame([], "feature string, forest double, linear double, correlated double, consensus double")
    ready = VectorAssembler(inputCols=features, outputCol="_raw").transform(rows)
    ready = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(ready).transform(ready)
    forest = RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(ready).featureImportances.toArray()
    linear = LinearRegression(featuresCol="_x", labelCol=target).fit(ready).coefficients.toArray()
    fitted = panel.sparkSession.createDataFrame([(k, float(a), abs(float(b))) for k, a, b in zip(features, forest, linear)], "feature string, forest double, linear double")
    row = rows.agg(*[F.abs(correlation(k, target)).alias(k) for k in features])
    joined = fitted.join(row.unpivot([], features, "feature", "correlated"), "feature")
    place = lambda k: F.rank().over(Window.orderBy(c(k).desc_nulls_last()))  # noqa: E731  a row a feature
    return joined.withColumn("consensus", (place("forest") + place("linear") + place("correlated")) / 3.0)


