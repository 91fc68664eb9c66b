"""Cost expressions: model names, rates in effect, costs, cache projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.sources.rates import BATCH, CACHE_READ, CACHE_WRITE, PROVIDER_PREFIX, broadcast_if_small, is_small, lookup_table

TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens"]
COSTS = ["input_cost", "output_cost", "cache_read_cost", "cache_write_cost"]
MILLION = 1_000_000


def bare_model(model: Column) -> Column:
    """A wire id without provider prefix and without what follows ``@``."""
    return F.split_part(F.regexp_replace(F.trim(model), PROVIDER_PREFIX, ""), F.lit("@"), F.lit(1))


def undated_model(model: Column) -> Column:
    """A bare id without a trailing date of eight digits."""
    return F.regexp_replace(bare_model(model), "-[0-9]{8}$", "")


def normalize_model(df: DataFrame, rates: DataFrame, model_col: str = "model") -> DataFrame:
    """``df`` with ``model_key``: the bare id where it is registered, else the id without its date."""
    known = broadcast_if_small(lookup_table(rates).select(F.col("model_key").alias("_known")))
    joined = df.withColumn("_bare", bare_model(F.col(model_col))).join(known, F.col("_bare") == F.col("_known"), "left")
    return joined.withColumn("model_key", F.when(F.col("_known").isNotNull(), F.col("_bare")).otherwise(undated_model(F.col(model_col)))).drop("_bare", "_known")


def with_rates(df: DataFrame, rates: DataFrame, strict: bool = False, model_col: str = "model") -> DataFrame:
    """Join each row's model to its rates: the exact name first, then the normalised one.

    Rows of an unknown model are dropped, or raise an error if ``strict``. The rate table is broadcast after a check of
    its size.
    """
    table = lookup_table(rates).withColumnRenamed("id", "model_id")
    small = is_small(table)  # checked once
    hint = F.broadcast if small else (lambda t: t)
    exact = F.col(model_col)
    # which of a row's two longer names are registered
    named = [hint(table.select(F.col("model_key").alias(n))) for n in ("_exact", "_plain")]
    found = df.join(named[0], exact == F.col("_exact"), "left").join(named[1], bare_model(exact) == F.col("_plain"), "left")
    keyed = found.withColumn("model_key", F.coalesce("_exact", "_plain", undated_model(exact))).drop("_exact", "_plain")
    table = hint(table)
    if not strict:
        return keyed.join(table, "model_key")
    joined = keyed.join(table, "model_key", "left")
    error = F.raise_error(F.concat(F.lit("no rates for model "), F.coalesce(exact, F.lit("null"))))
    return joined.withColumn("model_id", F.coalesce("model_id", error))


def rates_in_effect(day: Column, speed: Column) -> tuple[Column, Column]:
    """Input and output rate of a joined row; null where the speed is not offered."""
    promo = F.col("promo_in").isNotNull() & (day <= F.col("promo_until"))

    def pick(side: str) -> Column:
        return F.when(speed == "fast", F.col(f"fast_{side}")).when(speed == "standard", F.when(promo, F.col(f"promo_{side}")).otherwise(F.col(f"rate_{side}")))

    return pick("in"), pick("out")


def price(df: DataFrame, rates: DataFrame, day: Column | dt.date | None = None, strict: bool = False) -> DataFrame:
    """``df`` with costs. Needs ``model``, the five token columns, ``speed`` and ``batch``.

    ``day`` decides about promotions and is today where it is not given. Rows whose speed their model does not offer are
    dropped, or raise an error if ``strict``.
    """
    if day is None:
        day = F.current_date()
    elif isinstance(day, dt.date):
        day = F.lit(day)
    joined = with_rates(df, rates, strict)
    rate_in, rate_out = rates_in_effect(day, F.col("speed"))
    factor = F.when(F.col("batch"), F.lit(BATCH)).otherwise(F.lit(1.0))
    priced = joined.withColumns({"_in": rate_in * factor / MILLION, "_out": rate_out * factor / MILLION})
    if strict:
        error = F.raise_error(F.concat(F.lit("speed not offered: "), F.coalesce("speed", F.lit("null"))))
        priced = priced.withColumn("_in", F.when(F.col("rate_in").isNotNull(), F.coalesce("_in", error)))
    else:
        priced = priced.where(F.col("_in").isNotNull() & F.col("_out").isNotNull())
    prompt = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")
    priced = priced.withColumns(
        {
            "input_cost": F.col("input_tokens") * F.col("_in"),
            "output_cost": F.col("output_tokens") * F.col("_out"),
            "cache_read_cost": F.col("cache_read_tokens") * F.col("_in") * CACHE_READ,
            "cache_write_cost": F.col("cache_write_5m_tokens") * F.col("_in") * CACHE_WRITE["5m"] + F.col("cache_write_1h_tokens") * F.col("_in") * CACHE_WRITE["1h"],
            "cost_uncached": prompt * F.col("_in") + F.col("output_tokens") * F.col("_out"),
        }
    )
    rate_columns = [f"{kind}_{side}" for kind in ("rate", "fast", "promo") for side in ("in", "out")]
    return priced.withColumn("cost", sum((F.col(c) for c in COSTS[1:]), F.col(COSTS[0]))).withColumn("cache_savings", F.col("cost_uncached") - F.col("cost")).drop("_in", "_out", "promo_until", *rate_columns)


def derived_usage(df: DataFrame) -> DataFrame:
    """``df`` with cache_write_tokens, prompt_tokens, total_tokens and cache_hit_rate (0 without a prompt)."""
    write = F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")
    prompt = F.col("input_tokens") + F.col("cache_read_tokens") + write
    return df.withColumns({"cache_write_tokens": write, "prompt_tokens": prompt, "total_tokens": prompt + F.col("output_tokens"), "cache_hit_rate": F.coalesce(F.try_divide("cache_read_tokens", prompt), F.lit(0.0))})


def usage_from_api(usage: Column) -> dict[str, Column]:
    """Token columns from an API usage struct; a per-lifetime breakdown wins over the flat total of cache writes."""

    def number(field: Column) -> Column:
        return F.coalesce(field, F.lit(0)).cast("long")

    short = number(usage["cache_creation"]["ephemeral_5m_input_tokens"])
    long = number(usage["cache_creation"]["ephemeral_1h_input_tokens"])
    flat = number(usage["cache_creation_input_tokens"])
    return {
        "input_tokens": number(usage["input_tokens"]),
        "output_tokens": number(usage["output_tokens"]),
        "cache_read_tokens": number(usage["cache_read_input_tokens"]),
        "cache_write_5m_tokens": F.when(short + long == 0, flat).otherwise(short),
        "cache_write_1h_tokens": long,
    }


def write_multiplier(ttl: Column) -> Column:
    """Cache-write multiplier of a lifetime; an unknown one is an error."""
    return F.when(ttl == "5m", F.lit(CACHE_WRITE["5m"])).when(ttl == "1h", F.lit(CACHE_WRITE["1h"])).otherwise(F.raise_error(F.concat(F.lit("unknown cache lifetime "), ttl)).cast("double"))


def cache_breakeven(ttl: Column) -> Column:
    """Requests after which writing a prefix once has paid."""
    return F.greatest(F.lit(1), F.ceil((write_multiplier(ttl) - CACHE_READ) / (1 - CACHE_READ) - 1e-9)).cast("long")


def cache_projection(scenarios: DataFrame, rates: DataFrame, day: Column | dt.date | None = None) -> DataFrame:
    """Cost of a cached prefix over several requests.

    Scenarios have model, prefix_tokens, requests, ttl and writes; 1 <= writes <= requests, else an error is raised.
    """
    day = F.current_date() if day is None else F.lit(day) if isinstance(day, dt.date) else day
    joined = with_rates(scenarios, rates, strict=True)
    rate, _ = rates_in_effect(day, F.lit("standard"))
    per_token = rate / MILLION
    valid = (F.col("requests") >= 1) & (F.col("writes") >= 1) & (F.col("writes") <= F.col("requests"))
    requests = F.when(valid, F.col("requests")).otherwise(F.raise_error(F.lit("writes must lie between 1 and requests")).cast("long"))
    share = F.col("writes") * write_multiplier(F.col("ttl")) + (requests - F.col("writes")) * CACHE_READ
    costs = joined.withColumns({"uncached_cost": requests * F.col("prefix_tokens") * per_token, "cached_cost": F.col("prefix_tokens") * per_token * share})
    costs = costs.withColumn("savings", F.col("uncached_cost") - F.col("cached_cost"))
    return costs.select(*scenarios.columns, "uncached_cost", "cached_cost", "savings", (F.col("savings") > 0).alias("worth_it"), F.coalesce(F.try_divide("savings", "uncached_cost"), F.lit(0.0)).alias("savings_ratio"))


def volume_projection(cost: Column, per_day: Column) -> tuple[Column, Column]:
    """Cost a day and a month of 30 days."""
    return cost * per_day, cost * per_day * 30


def context_share(df: DataFrame, rates: DataFrame, day: Column | dt.date | None = None, tokens_col: str = "tokens") -> DataFrame:
    """``df`` with the share of the model's context window that its tokens take, and their cost as fresh input."""
    day = F.current_date() if day is None else F.lit(day) if isinstance(day, dt.date) else day
    joined = with_rates(df, rates, strict=True)
    rate, _ = rates_in_effect(day, F.lit("standard"))
    return joined.select(*df.columns, "context_window", (F.col(tokens_col) / F.col("context_window")).alias("context_share"), (F.col(tokens_col) * rate / MILLION).alias("input_cost"))
