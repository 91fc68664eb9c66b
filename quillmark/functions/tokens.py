"""Offline token estimates and their calibration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.snapshots import append_snapshot, compact, read_snapshot

# Characters a token of prose and of dense text, the density of the latter, and the tolerance.
CHARS_PROSE, CHARS_DENSE, DENSITY, TOLERANCE = 3.9, 3.0, 0.35, 0.15
#: Words and symbols by Unicode, as both engines of the tests understand them.
WORD = "[\\p{L}\\p{N}_]+"
SYMBOL = "[^\\p{L}\\p{N}_\\s\\x1c-\\x1f\\x{85}\\p{Z}]"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once for each row, however often ``then`` reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _counts(text: Column) -> Column:
    """Characters, symbols and words of a text. Words become one letter each first, so one pattern alone reads it whole."""
    short = F.regexp_replace(text, WORD, "w")
    return _once(short, lambda t: F.struct(F.length(text).alias("chars"), (F.length(t) - F.length(F.regexp_replace(t, f"{SYMBOL}+", ""))).alias("symbols"), F.length(F.regexp_replace(t, "[^w]+", "")).alias("words")))


def _density(counts: Column) -> Column:
    return F.coalesce(F.try_divide(counts["symbols"].cast("double"), counts["symbols"] + counts["words"]), F.lit(0.0))


def symbol_density(text: Column) -> Column:
    """Share of symbols among symbols and words; 0 for a text with neither."""
    return F.coalesce(_once(_counts(text), _density), F.lit(0.0))


def _tokens(counts: Column, chars_per_token: Column | None) -> Column:
    ratio = CHARS_PROSE - (CHARS_PROSE - CHARS_DENSE) * F.least(_density(counts) / DENSITY, F.lit(1.0))
    if chars_per_token is not None:
        ratio = F.coalesce(chars_per_token, ratio)
    return F.when(counts["chars"] == 0, 0).otherwise(F.greatest(F.lit(1), F.rint(counts["chars"] / ratio))).cast("long")


def _bounds(tokens: Column) -> dict[str, Column]:
    margin = F.when(tokens == 0, 0).otherwise(F.greatest(F.lit(1), F.rint(tokens * TOLERANCE))).cast("long")
    return {"tokens": tokens, "low": F.greatest(tokens - margin, F.lit(0)), "high": tokens + margin}


def estimate(text: Column, chars_per_token: Column | None = None) -> dict[str, Column]:
    """tokens, low and high of a text; 0 tokens for an empty or null one. Halves round to even.

    Each of the three reads the text; :func:`with_estimate` gives all of them from one reading.
    """
    return _bounds(_once(_counts(F.coalesce(text, F.lit(""))), lambda c: _tokens(c, chars_per_token)))


def with_estimate(df: DataFrame, text_col: str = "text", chars_per_token: Column | None = None) -> DataFrame:
    """``df`` with tokens, low and high of a text, which is read once."""
    tokens = estimate(F.col(text_col), chars_per_token)["tokens"]
    # a generator, so that no column above it counts again
    counted = df.select("*", F.inline(F.array(F.struct(tokens.alias("tokens")))))
    return counted.withColumns({k: c for k, c in _bounds(F.col("tokens")).items() if k != "tokens"})


def estimate_text(tokens: Column, low: Column, high: Column) -> Column:
    """``~1,234 tokens (1,049-1,419)``."""
    return F.format_string("~%s tokens (%s-%s)", F.format_number(tokens, 0), F.format_number(low, 0), F.format_number(high, 0))


def calibrate(samples: DataFrame, text_col: str = "text", tokens_col: str = "tokens", by: list[str] | None = None) -> DataFrame:
    """Thousandths of characters a token over samples that are not blank; no sample at all is an error."""
    used = samples.where(F.trim(text_col) != "")
    sums = used.groupBy(*(by or [])).agg(F.sum(F.length(text_col)).alias("chars"), F.sum(tokens_col).alias("sample_tokens"))
    ratio = F.coalesce(F.try_divide(F.col("chars").cast("double"), F.col("sample_tokens")), F.raise_error(F.lit("no sample to calibrate with")).cast("double"))
    return sums.withColumn("ratio_thousandths", F.rint(ratio * 1000).cast("long"))


def content_key(model: Column, content: Column) -> Column:
    """Key of a counted content: the model and half a SHA-256 of its JSON."""
    return F.concat(model, F.lit(":"), F.substring(F.sha2(content, 256), 1, 32))


def flatten_blocks(blocks: Column) -> Column:
    """Texts of the text blocks of one content, one a line."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")


def conversation_texts(turns: DataFrame, by: str = "conv_id", order: str = "turn", text_col: str = "text") -> DataFrame:
    """All turns of a conversation as one text, in order, one a line."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t"))))
    return turns.groupBy(by).agg(listed.alias("turns")).select(by, F.array_join(F.transform("turns", lambda x: x["t"]), "\n", "").alias("text"))


def count_tokens(texts: DataFrame, cache: DataFrame, model: str, calibration: DataFrame | None = None, exact: Callable[[DataFrame], DataFrame] | None = None, text_col: str = "text") -> DataFrame:
    """``texts`` with tokens and how they were found: ``cached``, ``exact`` or ``estimated``.

    ``cache`` has (key, tokens). Misses go to ``exact`` where it is given (key, text -> key, tokens; keys may be left out);
    what is still unknown is estimated, by the model's calibrated ratio if ``calibration`` has one.
    """
    keyed = texts.withColumn("key", content_key(F.lit(model), F.to_json(F.struct(F.col(text_col).alias("text")))))
    found = keyed.join(cache.select("key", F.col("tokens").alias("_cached")).dropDuplicates(["key"]), "key", "left")
    if exact is not None:
        misses = keyed.select("key", text_col).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
        found = found.join(exact(misses).select("key", F.col("tokens").alias("_exact")), "key", "left")
    else:
        found = found.withColumn("_exact", F.lit(None).cast("long"))
    ratio = None
    if calibration is not None:  # one number a model
        row = calibration.where(F.col("model") == model).select("ratio_thousandths").first()
        ratio = F.lit(row[0] / 1000) if row else None
    guess = estimate(F.col(text_col), ratio)["tokens"]
    how = F.when(F.col("_cached").isNotNull(), "cached").when(F.col("_exact").isNotNull(), "exact").otherwise("estimated")
    return found.withColumn("tokens", F.coalesce("_cached", "_exact", guess)).withColumn("found", how).drop("_cached", "_exact")


def cache_additions(counted: DataFrame) -> DataFrame:
    """Rows to append to the cache: exact counts only, once a key."""
    return counted.where("found = 'exact'").select("key", "tokens").dropDuplicates(["key"])


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, tokens) of a kept cache; an absent one is empty. Of a key that several writers have added one count stays."""
    kept = read_snapshot(spark, path)
    if kept is None:
        return spark.createDataFrame([], "key string, tokens long")
    return kept.groupBy("key").agg(F.min("tokens").alias("tokens"))


def flush_cache(counted: DataFrame, path: str) -> None:
    """Add new exact counts to a kept cache; nothing is written where there are none. Writers don't disturb each other;
    :func:`compact_cache` joins what they have added."""
    new = cache_additions(counted)
    if not new.isEmpty():
        append_snapshot(new, path)


def compact_cache(spark: SparkSession, path: str, parts: int = 1) -> None:
    """Rewrite a kept cache in ``parts`` files."""
    compact(spark, path, parts)


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole files as UTF-8, bytes that are none replaced; files without a byte give no row, absent paths are an error."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def count_files(spark: SparkSession, paths: str | list[str], cache: DataFrame, model: str, **options) -> DataFrame:
    """path, text, key, tokens, found of text files; see :func:`count_tokens`."""
    return count_tokens(read_texts(spark, paths), cache, model, **options)
