"""Mixing of sources to target token counts by entropy balancing (operator 12).

Every document has a rate between 0 and twice: 2 / (1 + exp(-z)), z = lambda of its source times its size. These rates are
nearest to one copy each (in the entropy of a rate and of what it leaves of 2) among all that meet the sources' targets; the
lambdas solve the convex dual, by Newton steps inside a bracket. All sums of rates are of whole numbers (rates in units of
2^-40), so they don't depend on the order of rows, and reruns agree.

Documents of one source and size have one rate, so the steps run over (source, size, number of documents) only, which a
partial aggregation makes. Nothing but counts comes to the driver; the sources stay a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import discard, stored, table

#: Share of all sizes that the mix takes, in hundredths; most times that a document or source is taken; the sources' weights in turn.
PERCENT, MOST, WEIGHTS = 150, 2, (3, 1, 2)
#: Relative error of a source's words at which its lambda is found; steps at most (each at least halves the bracket).
ERROR, STEPS = 1e-6, 200
#: Parts of documents of one source and size, and rows of one id, source and size that a task writes at a time.
PARTS, RUN = 4096, 1 << 16
_UNIT = 1 << 40
_WIDE = "decimal(38,0)"


def words(text: str = "text") -> Column:
    """The number of words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with `nth`, from 0 by code point, null last: counts of ranges, then places in a range."""
    order = [F.asc_nulls_last("source")]
    parts = stored(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "sources")
    before = parts.groupBy("range").agg(F.count("*").alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return parts.join(before, "range").select(*sources.columns, (F.col("before") + place).alias("nth"))


def targets(sources: DataFrame, percent: int = PERCENT, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size and target of every source: shares of percent of all sizes by weight, none above most times its
    source's size. The excess reshared until none is above is one level of words a weight, with capped sources below it."""
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    known = stored(_numbered(sources).select("source", "source_size", weight.alias("weight")), "weights")
    cap, level = F.col("source_size") * most, 0.0
    while True:
        over = F.lit(level) * F.col("weight") > cap
        total, capped, rest = known.agg(F.sum("source_size"), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        now = (percent / 100 * (total or 0) - (capped or 0)) / rest if rest else level
        if now <= level:
            break
        level = now
    share = F.lit(level) * F.col("weight")
    return known.select("source", "source_size", F.when(share > cap, cap.cast("double")).otherwise(share).alias("target"))


def _rate(x: Column) -> Column:
    """The rate in units of 2^-40: a whole number, at most 2."""
    return F.round(MOST * _UNIT / (1 + F.exp(-x))).cast("long")


def balanced(groups: DataFrame, sources: DataFrame, error: float = ERROR, steps: int = STEPS) -> DataFrame:
    """source and slope (lambda) of every source, from groups (source, size, n) and sources (source, source_size, target).

    A Newton step outside the bracket of a source is replaced by the bracket's middle, so each source converges. A target of
    all that can be taken has no finite slope: null, and rate MOST.
    """
    squares = groups.groupBy("source").agg(F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("squares"))
    full = F.col("target") >= MOST * F.col("source_size")
    scale = F.col("squares") / F.col("source_size")
    # the scale only steers the steps; rounded, so that it doesn't depend on the order of the sum
    state = sources.where(~full & (F.col("target") > 0)).join(squares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "target", F.round(scale, 3).alias("scale"), F.log(F.col("target") / (MOST * F.col("source_size") - F.col("target"))).alias("z"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), F.lit(False).alias("found")
    )
    state = stored(state.withColumn("z", F.round("z", 6)), "slopes")
    held = state.columns
    for _ in range(steps):
        open_ = state.where(~F.col("found")).withColumnRenamed("source", "s")
        if open_.isEmpty():
            break
        x = F.col("z") / F.col("scale") * F.col("size")
        rate, n = _rate(x), F.col("n").cast(_WIDE) * F.col("size")
        share = F.col("rate").cast("double") / (MOST * _UNIT)
        at = groups.where("size > 0").join(open_, F.col("source").eqNullSafe(F.col("s"))).select("source", "n", "size", "scale", rate.alias("rate"))
        sums = at.groupBy(F.col("source").alias("of")).agg(
            F.sum(n * F.col("rate")).alias("taken"),
            F.sum((n.cast("double") * share * (1 - share) * MOST * F.col("size") / F.col("scale") * 1024).cast(_WIDE)).alias("gain"),
        )
        miss = F.col("taken").cast("double") / _UNIT - F.col("target")
        low, high = F.when(miss < 0, F.col("z")).otherwise(F.col("low")), F.when(miss > 0, F.col("z")).otherwise(F.col("high"))
        step = F.col("z") - miss / F.greatest(F.col("gain").cast("double") / 1024, F.lit(1e-300))
        done = (F.abs(miss) <= error * F.col("target")) | (F.col("high") - F.col("low") < 1e-12)
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").withColumns({"low": F.when(F.col("found"), F.col("low")).otherwise(low), "high": F.when(F.col("found"), F.col("high")).otherwise(high), "done": F.col("found") | done, "step": step})
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        moved = moved.withColumn("z", F.when(F.col("done"), F.col("z")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2))
        last, state = state, stored(moved.select(*[c for c in held if c != "found"], F.col("done").alias("found")), "slopes")
        discard(last)
    return sources.withColumnRenamed("source", "s").join(state.select("source", (F.col("z") / F.col("scale")).alias("slope")), F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("s").alias("source"), "source_size", "target", "slope")


def _step(size: Column) -> Column:
    """Sizes in falling steps: those that share their leading five bits."""
    bits = F.greatest(F.ceil(F.log2(size + 1)).cast("int") - 5, F.lit(0))
    return -(bits.cast("long") * 64 + F.floor(size / F.pow(F.lit(2.0), bits)))


def copies(groups: DataFrame, slopes: DataFrame) -> DataFrame:
    """source, size, n, target, source_size, rate and total, the copies that the n documents together get.

    Along the falling sizes of a source the copies are the differences of the rounded running sum of rates, so the words
    miss the target by less than the largest document. What is missed then goes to groups from the largest size down, one
    of each step of sizes, as far as they can give or take copies, and if a thousandth is left, one copy goes for another.
    Running sums are of steps first (at most 32 for each power of two) and then inside a step.
    """
    rate = F.when(F.col("target") <= 0, 0).when(F.col("slope").isNull(), MOST * _UNIT).otherwise(_rate(F.col("slope") * F.col("size"))).cast("long")
    known = groups.withColumnRenamed("source", "s").join(slopes, F.col("s").eqNullSafe(F.col("source"))).select("source", "size", "n", "source_size", "target", rate.alias("rate"))
    rows = stored(known.withColumns({"step": _step(F.col("size")), "due": F.col("n").cast(_WIDE) * F.col("rate")}), "rates")
    steps = rows.groupBy("source", "step").agg(F.sum("due").alias("all"))
    steps = steps.select(F.col("source").alias("s"), F.col("step").alias("of"), (F.sum("all").over(Window.partitionBy("source").orderBy("step")) - F.col("all")).alias("before"))
    run = F.col("before") + F.sum("due").over(Window.partitionBy("source", "step").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    whole = lambda x: F.floor((x + _UNIT // 2) / F.lit(_UNIT).cast(_WIDE)).cast("long")
    rows = rows.join(steps, F.col("source").eqNullSafe(F.col("s")) & (F.col("step") == F.col("of"))).withColumn("run", run)
    rows = stored(rows.withColumn("total", whole(F.col("run")) - whole(F.col("run") - F.col("due"))).drop("s", "of", "before", "run", "due"), "copies")

    room = F.least(F.col("total"), F.col("n") * MOST - F.col("total"))
    best = rows.where("size > 0").groupBy("source", "step").agg(F.max_by(F.struct("size", F.col("total").alias("down"), (F.col("n") * MOST - F.col("total")).alias("up")), F.struct(room, F.greatest("total", F.col("n") * MOST - F.col("total")), "size")).alias("g"))
    missed = rows.groupBy(F.col("source").alias("s")).agg(F.first("target").alias("target"), F.round(F.first("target") - F.sum(F.col("total") * F.col("size"))).cast("long").alias("missed"))
    listed = best.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list("g"))).alias("g")).join(missed, F.col("source").eqNullSafe(F.col("s")))

    move = "struct<size:bigint,more:bigint>"
    item = "struct<size:bigint,down:bigint,up:bigint>"

    def give(acc: Column, g: Column) -> Column:
        able = F.when(acc["left"] > 0, F.least((acc["left"] / g["size"]).cast("long"), g["up"])).otherwise(-F.least((-acc["left"] / g["size"]).cast("long"), g["down"]))
        after = lambda m: F.struct(
            (acc["left"] - m * g["size"]).alias("left"),
            F.concat(acc["g"], F.array(F.struct(g["size"].alias("size"), (g["down"] + m).alias("down"), (g["up"] - m).alias("up")))).alias("g"),
            F.when(m != 0, F.concat(acc["moves"], F.array(F.struct(g["size"].alias("size"), m.alias("more"))))).otherwise(acc["moves"]).alias("moves"),
        )
        return F.transform(F.array(able), after)[0]

    start = F.struct("missed", F.array().cast(f"array<{item}>"), F.array().cast(f"array<{move}>")).cast(f"struct<left:bigint,g:array<{item}>,moves:array<{move}>>")
    given = listed.select("s", "target", F.aggregate("g", start, give).alias("a"))
    # where a thousandth is still missed, one copy of one group for one of another: the pair, or single, that leaves least
    left, none = F.col("a.left"), F.struct(F.lit(0).cast("long").alias("size"), F.lit(1).cast("long").alias("down"), F.lit(1).cast("long").alias("up"))
    sides = F.concat("a.g", F.array(none))
    trial = lambda x, y: F.struct(F.abs(left - x["size"] + y["size"]).alias("miss"), x["size"].alias("plus"), y["size"].alias("minus"))
    best = F.aggregate(F.filter(sides, lambda x: x["up"] > 0), trial(none, none), lambda acc, x: F.aggregate(F.filter(sides, lambda y: y["down"] > 0), acc, lambda acc, y: F.least(acc, trial(x, y))))
    given = given.withColumn("best", F.when(F.abs(left) * 1000 > F.col("target"), best))
    swaps = F.when(F.col("best").isNotNull(), F.array(F.struct(F.col("best.plus").alias("size"), F.lit(1).cast("long").alias("more")), F.struct(F.col("best.minus").alias("size"), F.lit(-1).cast("long").alias("more")))).otherwise(F.array().cast(f"array<{move}>"))
    more = given.select("s", F.explode(F.concat("a.moves", swaps)).alias("m")).where("m.size > 0").groupBy("s", F.col("m.size").alias("of")).agg(F.sum("m.more").alias("more"))
    out = rows.join(more, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("of")), "left")
    return stored(out.select("source", "size", "n", "source_size", "target", (F.col("rate") / _UNIT).alias("rate"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")), "totals")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies (0 to 2) of every row of docs (doc_id, source, text).

    The size is the number of words; null and blank texts have 0 and give nothing to their source, but they get copies as
    others do. A null source is a source, the last. Rows of one id, source and size are told apart by nothing, so which of
    them gets the more copies doesn't matter; a null id is an id. Within a source and size those of smallest hash of the id
    get one copy more, so reruns agree. Other columns aren't read; an empty table gives no rows.
    """
    units = docs.select("doc_id", F.col("source").cast("string").alias("source"), words().alias("size"))
    units = units.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")).withColumn("key", F.xxhash64("doc_id"))
    units = stored(units.withColumn("part", F.pmod(F.shiftright("key", 20), F.lit(PARTS))), "units")
    groups = stored(units.groupBy("source", "size").agg(F.sum("m").alias("n")), "groups")
    known = stored(targets(groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))), "targets")
    totals = copies(groups, balanced(groups, known))
    # the first `total mod n` documents of a group, by parts of the hash and then inside the part where the border lies, get one more
    size_of = lambda df, c: F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col(c))
    given = totals.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "rate", F.floor(F.col("total") / F.col("n")).cast("int").alias("each"), (F.col("total") % F.col("n")).alias("extra"))
    parts = units.groupBy("source", "size", "part").agg(F.sum("m").alias("held"))
    parts = parts.withColumn("before", F.sum("held").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("held")).join(given, size_of(parts, "z"))
    parts = stored(parts.select("s", "z", F.col("part").alias("p"), "source_size", "target", "rate", "each", F.greatest(F.col("extra") - F.col("before"), F.lit(0)).alias("left"), "held"), "parts")
    rows = units.join(parts, size_of(units, "z") & (F.col("part") == F.col("p"))).drop("s", "z", "p")
    edge = (F.col("left") > 0) & (F.col("left") < F.col("held"))
    inner = rows.where(edge).withColumn("at", F.sum("m").over(Window.partitionBy("source", "size", "part").orderBy("key", F.asc_nulls_first("doc_id"))) - F.col("m"))
    border = inner.select(*rows.columns, F.least(F.greatest(F.col("left") - F.col("at"), F.lit(0)), F.col("m")).alias("plus"))
    clear = rows.where(~edge).withColumn("plus", F.when(F.col("left") > 0, F.col("m")).otherwise(0))
    rows = border.unionByName(clear)
    out = lambda df, n: df.select("doc_id", "source", "size", "source_size", "target", "rate", (F.col("each") + (F.col(n) < F.col("plus")).cast("int")).alias("copies"))
    few = rows.where(F.col("m") <= RUN).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    runs = rows.where(F.col("m") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / RUN)))).repartition(F.col("key"), F.col("run"))
    many = runs.withColumn("nth", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, F.col("m")) - 1)))
    return out(few, "nth").unionByName(out(many, "nth"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")
