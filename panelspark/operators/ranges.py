"""Joins on overlapping intervals and on points in intervals, by keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.scratch import kept

c = F.col
#: Rows of both sides for each elementary range, about, and levels of ranges at most.
RANGE_ROWS, MOST_LEVELS = 2000, 14
#: Levels of the tree of totals whose nodes are sent to every task: at most 2^TOP_LEVELS rows.
TOP_LEVELS = 11


def _nodes(a: Column, b: Column, levels: int) -> Column:
    """The ranges of a binary tree over 2^levels elementary ones that together are a .. b: at most two a level. A range is
    numbered as a heap's node, 2^levels + its place for an elementary one."""
    start = F.struct((a + (1 << levels)).alias("l"), (b + (1 << levels) + 1).alias("r"), F.array().cast("array<int>").alias("out"))
    # as the walk from both leaves upward: an odd left end and an odd right end belong to the interval by themselves
    odd = lambda x: (x % 2) == 1

    def up(s: Column, _: Column) -> Column:
        go = s["l"] < s["r"]
        own = F.concat(s["out"], F.when(go & odd(s["l"]), F.array(s["l"])).otherwise(F.array().cast("array<int>")), F.when(go & odd(s["r"]), F.array(s["r"] - 1)).otherwise(F.array().cast("array<int>")))
        half = lambda x: F.floor(x / 2).cast("int")
        return F.struct(half(s["l"] + F.when(odd(s["l"]), 1).otherwise(0)).alias("l"), half(s["r"] - F.when(odd(s["r"]), 1).otherwise(0)).alias("r"), own.alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels + 1)), start, up)["out"]


def _place(x: Column, bounds: list[float]) -> Column:
    """The number of bounds that are <= x, by halving. Bounds are one literal: as thousands of them, each place of the plan
    would hold all in the driver."""
    if not bounds:
        return F.lit(0)
    cuts = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")  # folded into one array
    middle = lambda s: F.floor((s["a"] + s["b"]) / 2).cast("int")
    halve = lambda s, _: F.when(s["a"] >= s["b"], s).when(F.get(cuts, middle(s)) <= x, F.struct((middle(s) + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), middle(s).alias("b")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), F.struct(F.lit(0).alias("a"), F.lit(len(bounds)).alias("b")), halve)["a"]


def points_in_intervals(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, by: list[str] | None = None, range_rows: int = RANGE_ROWS, over_low: bool = False) -> DataFrame:
    """Pairs of a point and an interval with low <= at <= high (low < at with `over_low`), and equal `by` columns: the columns
    of both, of which only `by` may have the same names.

    The line is cut at quantiles of the points into 2^k elementary ranges, of which a tree is made. An interval lies in the
    few largest ranges of the tree that make it up, and a point in the ranges above its own on those levels that intervals
    use, so the two meet by equality on exactly one range, however long the interval is. Only pairs that meet in a range at an
    interval's end can fail the condition. Nulls and empty intervals meet nothing; infinite ends are ends like others. Hot
    ranges are split by the adaptive skew join.
    """
    by = by or []
    points, intervals = points.where(c(at).isNotNull() & ~F.isnan(c(at).cast("double"))), intervals.where(c(low) <= c(high))
    levels = min(MOST_LEVELS, max(0, (points.count() // range_rows).bit_length()))
    finite = points.select(c(at).cast("double").alias("x")).where(F.abs("x") < float("inf"))
    bounds = sorted(set(finite.approxQuantile("x", [i / 2**levels for i in range(1, 2**levels)], 0.25 / 2**levels))) if levels else []
    placed = lambda df, *ks: df.withColumns({f"_at_{k}": _place(c(k).cast("double"), bounds) for k in ks})
    spread = placed(intervals, low, high).withColumn("_node", F.explode(_nodes(c(f"_at_{low}"), c(f"_at_{high}"), levels))).drop(f"_at_{low}", f"_at_{high}")
    used = sorted(r[0] for r in spread.select(F.floor(F.log2(c("_node").cast("double") + 0.5)).cast("int")).distinct().collect())  # at most levels + 1
    if not used:
        used = [levels]
    above = F.array(*[F.floor((c(f"_at_{at}") + (1 << levels)) / (1 << (levels - k))).cast("int") for k in used])
    dealt = placed(points, at).withColumn("_node", F.explode(above)).drop(f"_at_{at}")
    met = dealt.join(spread, ["_node", *by])
    return met.where((c(at) > c(low) if over_low else c(at) >= c(low)) & (c(at) <= c(high))).drop("_node")


def overlaps(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], by: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Pairs of intervals that share a point, ends included, with the columns of both: either the left one begins in the
    right one, or the right one begins in the left one and later. Each pair comes once."""
    (a, b), (x, y) = left_ends, right_ends
    left, right = left.where(c(a) <= c(b)), right.where(c(x) <= c(y))
    first = points_in_intervals(left, right, a, x, y, by, range_rows)
    second = points_in_intervals(right, left, x, a, b, by, range_rows, over_low=True)
    return first.unionByName(second.select(*first.columns))


def _ranks(ends: DataFrame) -> DataFrame:
    """(x, rank) of the distinct values of a column x, from 0, in order: numbered inside ranges, which are shifted by the sizes
    of those before them."""
    # the number of a row is its range's, times 2^33, and its place there; kept, as the ranges come from a sample
    numbered = kept(ends.distinct().repartitionByRange("x").sortWithinPartitions("x").select("x", F.monotonically_increasing_id().alias("_id")), "ranks")
    part = F.shiftright("_id", 33)
    held = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    shift = held.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - c("_n")).alias("_shift"))
    return numbered.withColumn("_part", part).join(F.broadcast(shift), "_part").select("x", (c("_shift") + c("_id").bitwiseAND((1 << 33) - 1)).alias("rank"))


def _covering(a: Column, b: Column, levels: int) -> Column:
    """The nodes of a heap over 2^levels leaves that together are the leaves a .. b - 1: at most two a level, none if empty."""
    none = F.array().cast("array<long>")
    start = F.struct((a + (1 << levels)).alias("l"), (b + (1 << levels)).alias("r"), none.alias("out"))
    odd = lambda x: x.bitwiseAND(1) == 1

    def up(s: Column, _: Column) -> Column:
        go = s["l"] < s["r"]
        own = F.concat(s["out"], F.when(go & odd(s["l"]), F.array(s["l"])).otherwise(none), F.when(go & odd(s["r"]), F.array(s["r"] - 1)).otherwise(none))
        return F.struct(F.shiftright(s["l"] + 1, 1).alias("l"), F.shiftright(s["r"], 1).alias("r"), own.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, up)["out"]


def overlap_totals(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """The rows of the left intervals that share a point with a right one, ends included, and totals over all those right ones:
    name: ("sum", "min" or "max", a column of the right table). What `overlaps` and a groupBy give, without the pairs, whose
    number grows with the square of the tables.

    Ends are numbered in order, and a binary tree is made over the numbers. A right interval either begins inside the left one
    and after its start: then it is counted in the nodes above its own start, and the left one takes the few nodes that make it
    up. Or it holds the left one's start: then it is counted in the few nodes that make it up, and the left one takes those
    above its start. Nodes hold totals, so a row costs some log2(n) rows. The nodes of the upper levels, which every row may
    take, are sent to all tasks.
    """
    (a, b), (x, y) = left_ends, right_ends
    whole = lambda df, p, q: df.where((c(p) <= c(q)) & ~F.isnan(c(p).cast("double")))
    put = lambda fs: [getattr(F, fn)(e).alias(k) for k, (fn, e) in fs.items()]
    again = put({k: (fn, c(k)) for k, (fn, _) in totals.items()})
    ends = lambda df, p, q: (c(p).cast("double").alias("_a"), c(q).cast("double").alias("_b"))
    left, right = whole(left, a, b), whole(right, x, y)
    asked = left.select(*ends(left, a, b)).distinct()
    given = right.groupBy(*ends(right, x, y)).agg(*put(totals))
    ranks = kept(_ranks(asked.select(F.explode(F.array("_a", "_b")).alias("x")).unionByName(given.select(F.explode(F.array("_a", "_b")).alias("x")))), "ends")
    levels = max(1, (ranks.count() - 1).bit_length())
    numbered = lambda df: df.join(ranks.toDF("_a", "_ra"), "_a").join(ranks.toDF("_b", "_rb"), "_b")
    asked, given = kept(numbered(asked).select("_a", "_b", "_ra", "_rb"), "asked"), kept(numbered(given).select("_ra", "_rb", *totals), "given")
    above = lambda k: F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda i: F.call_function("shiftright", c(k) + (1 << levels), i.cast("int")))
    # the sign tells the two trees apart
    inside, around = _covering(c("_ra") + 1, c("_rb") + 1, levels), _covering(c("_ra"), c("_rb") + 1, levels)
    starts = given.groupBy("_ra").agg(*again).select(F.explode(above("_ra")).alias("_node"), *totals)
    spans = given.select(F.explode(F.transform(around, lambda n: -n)).alias("_node"), *totals)
    nodes = kept(starts.unionByName(spans).groupBy("_node").agg(*again), "nodes")
    take = asked.select("_a", "_b", F.explode(F.concat(inside, F.transform(above("_ra"), lambda n: -n))).alias("_node"))
    upper = F.abs("_node") < (1 << TOP_LEVELS)
    met = take.where(upper).join(F.broadcast(nodes.where(upper)), "_node").unionByName(take.where(~upper).join(nodes.where(~upper), "_node"))
    found = met.groupBy("_a", "_b").agg(*again)
    return left.withColumns({"_p": c(a).cast("double"), "_q": c(b).cast("double")}).join(found, (c("_p") == c("_a")) & (c("_q") == c("_b"))).drop("_p", "_q", "_a", "_b")
