"""The usage ledger: JSON lines, one call each. Readers skip what they cannot price."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.pricing import TOKENS, price, usage_from_api

LINE = "ts string, model string, usage map<string, bigint>, tags map<string, string>, request_id string, duration_ms double, batch boolean, speed string, _corrupt string"
RECORD = "ts string, ts_utc timestamp, model string, " + ", ".join(f"{t} bigint" for t in TOKENS) + ", tags map<string, string>, request_id string, duration_ms double, batch boolean, speed string"


def parse_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Records of valid lines; blank and malformed ones are dropped.

    A line is malformed when it is no JSON object, lacks ts, model or usage, has an unknown or a null key in usage, a
    number that is none, a time that cannot be read, or a null speed (a missing one is ``standard``).
    """
    whole = lines.where(F.trim(line_col) != "")
    # a generator, so that no filter or column below it parses the line again
    parsed = whole.select(F.col(line_col).alias("_line"), F.inline(F.array(F.from_json(line_col, LINE, {"columnNameOfCorruptRecord": "_corrupt"}))))
    names = F.array(*map(F.lit, TOKENS))
    usage_ok = (F.size(F.array_except(F.map_keys("usage"), names)) == 0) & F.forall(F.map_values("usage"), lambda v: v.isNotNull())
    # a null speed is told from a missing one by the keys, which are only read where the word is there
    null_speed = F.when(F.col("speed").isNull() & F.contains("_line", F.lit('"speed"')), F.array_contains(F.json_object_keys("_line"), "speed")).otherwise(False)
    stamp = F.try_to_timestamp("ts")
    good = parsed.where(F.col("_corrupt").isNull() & F.col("model").isNotNull() & F.col("usage").isNotNull() & stamp.isNotNull() & usage_ok & ~null_speed)
    tokens = [F.coalesce(F.try_element_at("usage", F.lit(t)), F.lit(0)).cast("long").alias(t) for t in TOKENS]
    return good.select("ts", stamp.alias("ts_utc"), "model", *tokens, F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), "request_id", "duration_ms", F.coalesce("batch", F.lit(False)).alias("batch"), F.coalesce("speed", F.lit("standard")).alias("speed"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Records below ``path``; an absent path is an empty ledger."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], RECORD)
    return parse_lines(spark.read.text(path))


def priced_ledger(records: DataFrame, rates: DataFrame, pricing_day: Column | dt.date | None = None) -> DataFrame:
    """Records with costs at the rates of ``pricing_day`` (today); stored costs are not trusted. Unknown models go."""
    return price(records, rates, pricing_day)


def filter_ledger(records: DataFrame, since=None, until=None, model: str | None = None, tags: Mapping[str, str] | None = None) -> DataFrame:
    """Calls from ``since`` to ``until`` (both included), of exactly this model name, with all these tags."""
    if since is not None:
        records = records.where(F.col("ts_utc") >= (since if isinstance(since, Column) else F.lit(since)))
    if until is not None:
        records = records.where(F.col("ts_utc") <= (until if isinstance(until, Column) else F.lit(until)))
    if model is not None:
        records = records.where(F.col("model") == model)
    for key, value in (tags or {}).items():
        records = records.where(F.col("tags")[key].eqNullSafe(F.lit(value)))
    return records


def parse_since(text: str, now: dt.datetime | None = None) -> dt.datetime:
    """``7d``, ``12h``, ``30m``, ``1.5w`` before now, or an ISO time; a time without zone is UTC."""
    units = {"w": "weeks", "d": "days", "h": "hours", "m": "minutes"}
    text = text.strip()
    if text[-1:] in units and text[:-1].replace(".", "", 1).isdigit():
        return (now or dt.datetime.now(dt.timezone.utc)) - dt.timedelta(**{units[text[-1]]: float(text[:-1])})
    when = dt.datetime.fromisoformat(text)
    return when if when.tzinfo else when.replace(tzinfo=dt.timezone.utc)


def to_lines(priced: DataFrame) -> DataFrame:
    """One column ``value``: compact JSON with sorted keys, costs to 8 places."""
    usage = F.struct(*[F.col(t) for t in sorted(TOKENS)])
    fields = {"batch": F.col("batch"), "cost": F.bround("cost", 8), "cost_uncached": F.bround("cost_uncached", 8), "duration_ms": F.col("duration_ms"), "model": F.col("model"), "request_id": F.col("request_id"), "speed": F.col("speed"), "tags": F.col("tags"), "ts": F.col("ts"), "usage": usage}
    return priced.select(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"}).alias("value"))


def append_ledger(priced: DataFrame, path: str) -> None:
    """Append calls as lines; each task's file appears whole or not at all, so writers do not disturb each other."""
    to_lines(priced).write.mode("append").text(path)


def records_from_messages(messages: DataFrame, tags: Mapping[str, str] | None = None) -> DataFrame:
    """Records from message structs: id, model, usage, ts and optionally tags, batch, speed, duration_ms.

    A message without a model is an error. ``tags`` are added to each message's own, which win.
    """
    have = set(messages.columns)
    model = F.coalesce("model", F.raise_error(F.lit("a message has no model")))
    base = F.create_map(*[F.lit(x) for kv in (tags or {}).items() for x in kv]).cast("map<string,string>")
    own = F.coalesce("tags", F.create_map().cast("map<string,string>")) if "tags" in have else None
    merged = base if own is None else F.map_from_entries(F.concat(F.filter(F.map_entries(base), lambda e: ~F.map_contains_key(own, e["key"])), F.map_entries(own)))
    optional = {"batch": F.lit(False), "speed": F.lit("standard"), "duration_ms": F.lit(None).cast("double")}
    columns = [F.coalesce(F.col(k), v).alias(k) if k in have else v.alias(k) for k, v in optional.items()]
    usage = [c.alias(k) for k, c in usage_from_api(F.col("usage")).items()]
    return messages.select("ts", F.try_to_timestamp("ts").alias("ts_utc"), model.alias("model"), *usage, merged.alias("tags"), F.col("id").alias("request_id"), *columns)
