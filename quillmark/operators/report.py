"""Grouped spend."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.pricing import TOKENS

UNTAGGED = "(untagged)"


def group_key(group_by: str | None) -> Column:
    """Key of a call: model, day, hour (both by the wall clock of the record's own offset), tag:<name>, or all."""
    if group_by == "model":
        return F.col("model")
    if group_by == "day":
        return F.substring("ts", 1, 10)
    if group_by == "hour":
        return F.concat(F.substring("ts", 1, 10), F.lit(" "), F.substring("ts", 12, 2), F.lit(":00"))
    if group_by is None or group_by in ("none", "all"):
        return F.lit("all")
    if group_by.startswith("tag:"):
        return F.coalesce(F.col("tags")[group_by[4:]], F.lit(UNTAGGED))
    raise ValueError(f"unknown grouping {group_by!r}")


def report(priced: DataFrame, group_by: str | None = "model", total: bool = True) -> DataFrame:
    """Calls, tokens and costs by key with a TOTAL row; dearest group first, the total last.

    One partial aggregation in the tasks, then one row a group travels.
    """
    keyed = priced.withColumn("group_key", group_key(group_by))
    sums = [F.count("*").alias("calls"), *[F.sum(t).alias(t) for t in TOKENS], F.sum("cost").alias("cost"), F.sum("cost_uncached").alias("cost_uncached")]
    grouped = keyed.rollup("group_key") if total else keyed.groupBy("group_key")
    is_total = F.grouping("group_key") if total else F.lit(0)
    found = grouped.agg(*sums, F.max(F.lit(0)).alias("_zero"), *([is_total.alias("is_total")] if total else [])).drop("_zero")
    if not total:
        found = found.withColumn("is_total", F.lit(0))
    found = found.withColumn("is_total", F.col("is_total") == 1).withColumn("group_key", F.when(F.col("is_total"), F.lit("TOTAL")).otherwise(F.col("group_key")))
    prompt = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")
    found = found.withColumns({"savings": F.col("cost_uncached") - F.col("cost"), "cache_hit_rate": F.coalesce(F.try_divide("cache_read_tokens", prompt), F.lit(0.0)), "cost_per_call": F.coalesce(F.try_divide("cost", "calls"), F.lit(0.0))})
    return found.orderBy("is_total", F.desc("cost"), "group_key")


def top_groups(found: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` groups and the total."""
    return found.where(~F.col("is_total")).orderBy(F.desc("cost"), "group_key").limit(n).unionByName(found.where("is_total"))


def report_lines(found: DataFrame, n: int = 20) -> DataFrame:
    """place, line: a report for a reader, its ``n`` dearest groups, how many more there are, and the total."""
    groups = found.where(~F.col("is_total"))
    dearest = [F.desc("cost"), F.col("group_key")]
    top = groups.orderBy(*dearest).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*dearest)))  # of n rows
    amounts = [F.col("calls"), F.col("cost"), F.col("cost_per_call"), F.col("cache_hit_rate") * 100, F.col("savings")]
    line = F.format_string("%s: %d calls, $%.4f ($%.4f each), %.1f%% of prompts cached, $%.4f saved", F.col("group_key"), *amounts)
    more = groups.agg(F.count("*").alias("groups")).where(F.col("groups") > n).select(F.lit(n + 1).alias("place"), F.format_string("... %d more groups", F.col("groups") - n).alias("line"))
    total = found.where("is_total").select(F.lit(n + 2).alias("place"), line.alias("line"))
    return top.select("place", line.alias("line")).unionByName(more).unionByName(total)


def report_text(found: DataFrame, n: int = 20) -> str:
    """:func:`report_lines` as one text, with what caching has come to; ``n`` + 2 rows come to the driver."""
    lines = [r.line for r in report_lines(found, n).orderBy("place").collect()]
    total = found.where("is_total").first()
    if total is None or not total.calls:
        return "no calls"
    written = total.cache_write_5m_tokens + total.cache_write_1h_tokens
    if total.savings > 0:
        lines.append(f"caching has saved ${total.savings:,.4f}, {total.savings / total.cost_uncached:.0%} of the price without it")
    elif written:
        lines.append("cache writes cost more than they save: does something change the cached prefix?")
    return "\n".join(lines)


def report_json(found: DataFrame) -> DataFrame:
    """One JSON line a group and one for the total: key, calls, costs, savings, cache hit rate and tokens."""
    fields = ["calls", "cost", "cost_per_call", F.col("savings").alias("cache_savings"), "cache_hit_rate", *TOKENS]
    return found.select("is_total", "group_key", F.to_json(F.struct(F.col("group_key").alias("key"), *fields)).alias("value"))


def report_dict(found: DataFrame, n: int = 1000) -> dict:
    """The total, the ``n`` dearest groups, and the number of those left out, for a program that wants one value."""
    lines = report_json(top_groups(found, n)).collect()
    groups = [json.loads(r.value) for r in lines if not r.is_total]
    total = next((json.loads(r.value) for r in lines if r.is_total), None)
    return {"total": total, "groups": sorted(groups, key=lambda g: (-g["cost"], g["key"])), "more_groups": max(0, found.where(~F.col("is_total")).count() - n)}


#: Fixed value: prefixes of fewer tokens are not cached by the service.
LEAST_PREFIX = 1024


def cache_verdicts(projected: DataFrame) -> DataFrame:
    """Projections (see :func:`quillmark.functions.pricing.cache_projection`) with verdict, too_short and advice.

    The verdict is ``cache`` where caching pays and ``send fresh`` where it does not; ``too_short`` tells prefixes that
    the service would not cache at all. ``advice`` says both in words.
    """
    short = F.col("prefix_tokens") < LEAST_PREFIX
    amount = F.format_number(F.abs("savings"), 4)
    words = F.when(F.col("worth_it"), F.concat(F.lit("caching pays: $"), amount, F.lit(" less")))
    words = words.otherwise(F.concat(F.lit("caching does not pay: $"), amount, F.lit(" more")))
    warning = F.when(short, F.lit(f"; the service ignores prefixes under {LEAST_PREFIX} tokens")).otherwise("")
    return projected.withColumns({"verdict": F.when(F.col("worth_it"), "cache").otherwise("send fresh"), "too_short": short, "advice": F.concat(words, warning)})
