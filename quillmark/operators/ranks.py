"""Ranks and exact order statistics of groups of any size: no task orders or holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.statistics import finite_pairs
from quillmark.scratch import written


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, rank: the rank of each distinct value in its group, from 1, where equal values share their mean.

    Values are counted in the tasks, then dealt out by range, so a group spans as many partitions as it needs. A value's
    rank is what the partitions before its own hold, plus its place there; equal values are one row, so none lie on both
    sides of a border. Nulls have no rank.
    """
    return _ranked(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")), by, value)


def _ranked(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, as the borders of ranges are drawn anew each time
    dealt = written(counts.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_of_{k}") for k in by], F.col("_part").alias("_at"), F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by] + [F.col("_part") == F.col("_at")]
    place = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.join(offsets, same).withColumn("_to", F.col("_before") + F.sum("_n").over(place))
    return met.select(*by, value, (F.col("_to") - (F.col("_n") - 1) / 2).alias("rank"))


def spearman_large(df: DataFrame, by: list[str], a: str = "actual", b: str = "prediction") -> DataFrame:
    """Rank correlation of each group, as :func:`quillmark.functions.statistics.spearman`, for groups beyond a task.

    Pairs are counted before they meet their ranks, so a value that half of the rows share is joined once for each value
    beside it.
    """
    pairs = finite_pairs(df, a, b).groupBy(*by, a, b).agg(F.count("*").alias("_pairs"))
    pairs = written(pairs, "pairs")
    weighted = F.col("_pairs")
    for name in (a, b):
        side = pairs.groupBy(*by, name).agg(F.sum(weighted).alias("_n"))
        ranks = _ranked(side, by, name).select(*[F.col(k).alias(f"_{name}_{k}") for k in by], F.col(name).alias(f"_{name}_is"), F.col("rank").alias(f"_{name}_rank"))
        same = [F.col(k).eqNullSafe(F.col(f"_{name}_{k}")) for k in by] + [F.col(name) == F.col(f"_{name}_is")]
        pairs = pairs.join(ranks, same).drop(f"_{name}_is", *[f"_{name}_{k}" for k in by])
    x, y, n = F.col(f"_{a}_rank"), F.col(f"_{b}_rank"), weighted
    sums = pairs.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.sum(n * x * y).alias("xy"))
    rows = F.col("n")
    spread = F.sqrt((F.col("xx") / rows - (F.col("x") / rows) ** 2) * (F.col("yy") / rows - (F.col("y") / rows) ** 2))
    r = F.coalesce(F.try_divide(F.col("xy") / rows - F.col("x") / rows * F.col("y") / rows, F.when(spread > 0, spread)), F.lit(0.0))
    return sums.select(*by, F.when(rows >= 3, r).alias("information_coefficient"))


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: Column, most: int = 10_000, bins: int = 1024) -> DataFrame:
    """by, rank, value: the values at ``ranks`` (an array of places from 0, an expression of the group's count ``n``).

    Exact, by repeated histograms: each round counts the values between two bounds in ``bins`` bins, in the tasks first,
    and keeps the bin that holds the rank, until no more than ``most`` values, or equal ones only, lie between the bounds.
    Nulls and NaN are left out; a group without a value gives no row.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sought = ends.select(*by, "n", "lo", "hi", F.explode(F.array_distinct(ranks).cast("array<bigint>")).alias("rank")).where("rank >= 0 AND rank < n")
    # what is sought: the rank-th value, which is the left-th of those from lo to hi
    sought = written(sought.select(*by, "rank", "lo", "hi", F.col("rank").alias("left"), F.col("n").alias("inside")), "sought")
    done = None
    while True:
        ready = (F.col("inside") <= most) | (F.col("lo") == F.col("hi"))
        found = _picked(rows, sought.where(ready), by)
        done = found if done is None else done.unionByName(found)
        open_ = sought.where(~ready)
        if open_.isEmpty():
            return done
        sought = written(_narrowed(rows, open_, by, bins), "sought")


def _met(rows: DataFrame, sought: DataFrame, by: list[str]) -> DataFrame:
    """Rows between the bounds of what is sought in their group; few rows are sought, so Spark sends them to the others."""
    named = sought.select(*[F.col(k).alias(f"_{k}") for k in by], *[c for c in sought.columns if c not in by])
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    for k in by:
        inside = inside & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(named, inside).drop(*[f"_{k}" for k in by])


def _picked(rows: DataFrame, ready: DataFrame, by: list[str]) -> DataFrame:
    counted = _met(rows, ready, by).groupBy(*by, "rank", "left", "v").agg(F.count("*").alias("n"))
    listed = counted.groupBy(*by, "rank", "left").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("all"))  # at most ``most`` values
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))

    def step(s, x):
        return F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["v"].isNull() & (s["seen"] + x["n"] > F.col("left")), x["v"]).otherwise(s["v"]).alias("v"))

    return listed.select(*by, "rank", F.aggregate("all", start, step)["v"].alias("value"))


def _narrowed(rows: DataFrame, open_: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Bounds of the values in the bin that holds what is sought, with the place there and the number of values."""
    width = F.col("hi") / bins - F.col("lo") / bins
    bin_ = F.least(F.floor((F.col("v") / bins - F.col("lo") / bins) / width * bins), F.lit(bins - 1)).cast("int")
    counts = _met(rows, open_, by).groupBy(*by, "rank", "left", bin_.alias("bin")).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    before = F.coalesce(F.sum("inside").over(Window.partitionBy(*by, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = counts.withColumn("before", before).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("inside")))
    return at.select(*by, "rank", "lo", "hi", (F.col("left") - F.col("before")).alias("left"), "inside")


def medians(df: DataFrame, by: list[str], value: str, most: int = 10_000, bins: int = 1024) -> DataFrame:
    """by, median: the middle value of each group, or the mean of the two in the middle; exact, in bounded memory."""
    middle = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    return order_statistics(df, by, value, middle, most, bins).groupBy(*by).agg(F.avg("value").alias("median"))
