"""Packing context items into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.tokens import estimate

# Defaults of a budget.
RESERVE_OUTPUT, OVERHEAD, HEADROOM = 8192, 512, 0.05


def available_tokens(limit: Column, context_window: Column, reserve_output: int = RESERVE_OUTPUT, overhead: int = OVERHEAD, headroom: float = HEADROOM) -> Column:
    """Tokens that items may take. A limit of zero or null is none; nothing left is an error."""
    if not 0 <= headroom < 1 or reserve_output < 0 or overhead < 0:
        raise ValueError("headroom lies in [0, 1), reserves are not negative")
    cap = F.least(F.when(limit > 0, limit), context_window)
    left = F.floor((cap - reserve_output - overhead) * (1 - headroom))
    return F.when(left > 0, left).otherwise(F.raise_error(F.lit("the reserves leave no room")).cast("long"))


def validated_items(items: DataFrame) -> DataFrame:
    """Items with tokens: given ones, or an estimate of the content. No content, or a negative priority, is an error."""
    known = F.when(F.col("tokens") > 0, F.col("tokens").cast("long"))
    guess = F.when(F.col("content").isNotNull(), estimate(F.col("content"))["tokens"])
    tokens = F.coalesce(known, guess, F.raise_error(F.concat(F.lit("no tokens and no content: "), "name")).cast("long"))
    priority = F.when(F.col("priority") >= 0, F.col("priority")).otherwise(F.raise_error(F.concat(F.lit("negative priority: "), "name")).cast("double"))
    return items.withColumns({"tokens": tokens, "priority": priority})


def pack(items: DataFrame, available: Column, by: str = "request_id") -> DataFrame:
    """Pack each request's items: ``by``, available, used, tokens_free, utilization, included, dropped.

    Items have ord, name, tokens, priority, required. Required ones come first and must fit. Others are taken by
    priority a token, then priority, then fewer tokens, then order; one that does not fit is passed over and smaller
    ones after it may still fit. Priority zero is never taken. Both lists keep the order of ``ord``. The fold is over one
    request's items.
    """
    entry = F.struct(
        (-F.col("priority") / F.greatest("tokens", F.lit(1))).alias("density"), (-F.col("priority")).alias("priority"), F.col("tokens").cast("long").alias("tokens"), "ord", "name", "required"
    )
    listed = items.withColumn("_available", available).groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("items"), F.max("_available").alias("available"))
    needed = F.aggregate(F.filter("items", lambda x: x["required"]), F.lit(0).cast("long"), lambda s, x: s + x["tokens"])
    listed = listed.withColumn("need", needed)
    listed = listed.withColumn("need", F.when(F.col("need") <= F.col("available"), F.col("need")).otherwise(F.raise_error(F.lit("required items exceed the budget")).cast("long")))
    start = F.struct(F.col("need").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(s, x):
        fits = ~x["required"] & (x["priority"] < 0) & (s["used"] + x["tokens"] <= F.col("available"))
        return F.struct(F.when(fits, s["used"] + x["tokens"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["taken"], F.array(x["ord"].cast("bigint")))).otherwise(s["taken"]).alias("taken"))

    packed = listed.withColumn("state", F.aggregate("items", start, step))

    def names(keep: bool) -> Column:
        def chosen(x):
            inside = x["required"] | F.array_contains("state.taken", x["ord"].cast("bigint"))
            return inside if keep else ~inside

        ordered = F.array_sort(F.transform(F.filter("items", chosen), lambda x: F.struct(x["ord"].alias("ord"), x["name"].alias("name"))))
        return F.transform(ordered, lambda x: x["name"])

    used = F.col("state.used")
    return packed.select(by, "available", used.alias("used"), (F.col("available") - used).alias("tokens_free"), F.coalesce(F.try_divide(used.cast("double"), "available"), F.lit(0.0)).alias("utilization"), names(True).alias("included"), names(False).alias("dropped"))


def order_for_cache(items: DataFrame, by: str = "request_id") -> DataFrame:
    """Items with ``cache_order`` from 1: stable ones first, both in their own order."""
    from pyspark.sql import Window

    return items.withColumn("cache_order", F.row_number().over(Window.partitionBy(by).orderBy(F.when(F.col("stable"), 0).otherwise(1), "ord")))


def summary(packed: DataFrame) -> DataFrame:
    """One line a request."""
    line = F.format_string("%d/%d tokens (%.1f%%), %d included, %d dropped", "used", "available", F.col("utilization") * 100, F.size("included"), F.size("dropped"))
    return packed.withColumn("summary", line)
