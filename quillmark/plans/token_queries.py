"""Queries about token estimates and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.tokens import calibrate, content_key, conversation_texts, count_tokens, estimate, flatten_blocks, symbol_density, with_estimate
from quillmark.operators.packing import available_tokens, order_for_cache, pack, validated_items
from quillmark.plans.ledger_queries import ESTIMATE_SQL
from quillmark.session import table


def symbol_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(symbol_density(F.col("text")), 9).alias("density"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_estimate(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def calibrate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters a token by language, taking one token for each word and two for each line."""
    docs = table(spark, sf_dir, "documents")
    tokens = F.size(F.split("text", " ", -1)) + 2 * F.size(F.split("text", "\n", -1))
    return calibrate(docs.withColumn("tokens", tokens.cast("long")), by=["lang"])


def token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents where every third is in the cache already."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 3 = 0").select(content_key(F.lit("m"), F.to_json(F.struct("text"))).alias("key"), (F.length("text") % 1000).cast("long").alias("tokens"))
    counted = count_tokens(docs, cache.groupBy("key").agg(F.min("tokens").alias("tokens")), "m")
    return counted.select("doc_id", "tokens", "found")


def flattened_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one text, and the same from content blocks among which only texts count."""
    turns = table(spark, sf_dir, "conversations")
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text")))
    texts = conversation_texts(turns.withColumn("text", flatten_blocks(blocks)).withColumn("turn", F.struct("turn", "role", "text")))
    return texts.select("conv_id", F.sha2("text", 256).alias("text_sha256"), estimate(F.col("text"))["tokens"].alias("tokens"))


def context_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ten documents a request, with priorities from labels; the first is required."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    doc_id = F.col("doc_id")
    items = docs.join(labels, "doc_id", "left").select(
        (doc_id / 10).cast("long").alias("request_id"), (doc_id % 10).cast("int").alias("ord"), F.concat(F.lit("doc"), doc_id.cast("string")).alias("name"), F.coalesce("text", F.lit("")).alias("content"), F.lit(0).cast("long").alias("tokens"),
        (F.coalesce("quality", F.lit(0)) * 2.0 + doc_id % 4).alias("priority"), (doc_id % 10 == 0).alias("required"), (F.col("source") < "src2").alias("stable"),
    )
    return validated_items(items)


def pack_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a limit of 4000 tokens and twice what their required item takes."""
    items = context_items(spark, sf_dir)
    needed = F.coalesce(F.sum(F.when(F.col("required"), F.col("tokens"))).over(Window.partitionBy("request_id")), F.lit(0))
    items = items.withColumn("limit", 4000 + 2 * needed)
    packed = pack(items, available_tokens(F.col("limit"), F.col("limit"), reserve_output=500, overhead=100, headroom=0.05))
    return packed.select("request_id", "available", "used", "tokens_free", F.round("utilization", 9).alias("utilization"), F.array_join("included", ",").alias("included"), F.array_join("dropped", ",").alias("dropped"))


def cache_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_for_cache(context_items(spark, sf_dir)).select("request_id", "name", F.col("cache_order").cast("long").alias("cache_order"))


QUERIES = {
    "symbol_density": symbol_densities,
    "token_estimate": token_estimate,
    "calibrate_ratio": calibrate_ratio,
    "token_cache": token_cache,
    "flatten_messages": flattened_messages,
    "pack_context": pack_context,
    "order_for_cache": cache_order,
}

_SYMBOLS = r"len(regexp_extract_all(text, '[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}]'))"
_WORDS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))"
_ITEMS = f"""
l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
i AS (
  SELECT doc_id // 10 AS request_id, doc_id % 10 AS ord, 'doc' || doc_id AS name, {ESTIMATE_SQL} AS tokens,
    coalesce(quality, 0) * 2.0::DOUBLE + doc_id % 4 AS priority, doc_id % 10 = 0 AS required, source < 'src2' AS stable
  FROM (SELECT doc_id, coalesce(text, '') AS text, source FROM documents) LEFT JOIN l USING (doc_id)),
room AS (SELECT request_id, floor((4000 + 2 * coalesce(sum(tokens) FILTER (required), 0) - 600) * (1 - 0.05::DOUBLE))::BIGINT AS available FROM i GROUP BY request_id)"""

ORACLES = {
    "symbol_density": f"SELECT doc_id, round(coalesce({_SYMBOLS}::DOUBLE / nullif({_SYMBOLS} + {_WORDS}, 0), 0), 9) AS density FROM documents",
    "token_estimate": f"""
WITH e AS (SELECT doc_id, {ESTIMATE_SQL} AS tokens FROM documents),
m AS (SELECT *, CASE WHEN tokens = 0 THEN 0 ELSE greatest(1, round_even(tokens * 0.15::DOUBLE, 0))::BIGINT END AS margin FROM e)
SELECT doc_id, tokens, greatest(tokens - margin, 0) AS low, tokens + margin AS high FROM m""",
    "calibrate_ratio": """
SELECT lang, sum(length(text))::BIGINT AS chars, sum(len(string_split(text, ' ')) + 2 * len(string_split(text, chr(10))))::BIGINT AS sample_tokens,
  round_even(sum(length(text))::DOUBLE / sum(len(string_split(text, ' ')) + 2 * len(string_split(text, chr(10)))) * 1000, 0)::BIGINT AS ratio_thousandths
FROM documents WHERE trim(text) <> '' GROUP BY lang""",
    "token_cache": f"""
WITH c AS (SELECT text, min(length(text) % 1000) AS cached FROM documents WHERE doc_id % 3 = 0 GROUP BY text)
SELECT doc_id, coalesce(cached, {ESTIMATE_SQL.replace('text', 'd.text')}) AS tokens, CASE WHEN cached IS NULL THEN 'estimated' ELSE 'cached' END AS found
FROM documents d LEFT JOIN c ON d.text = c.text""",
    "flatten_messages": f"""
WITH t AS (SELECT conv_id, string_agg(text || chr(10) || role, chr(10) ORDER BY turn, role, text || chr(10) || role) AS text FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(text) AS text_sha256, {ESTIMATE_SQL} AS tokens FROM t""",
    "pack_context": f"""
WITH RECURSIVE {_ITEMS},
a AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY required DESC, -priority / greatest(tokens, 1), -priority, tokens, ord) AS rn FROM i),
w AS (
  SELECT request_id, rn, tokens AS used, [name] AS taken FROM (SELECT request_id, 0 AS rn, 0::BIGINT AS tokens, '' AS name FROM i GROUP BY request_id)
  UNION ALL
  SELECT a.request_id, a.rn, CASE WHEN a.required OR (a.priority > 0 AND w.used + a.tokens <= room.available) THEN w.used + a.tokens ELSE w.used END,
    CASE WHEN a.required OR (a.priority > 0 AND w.used + a.tokens <= room.available) THEN list_append(w.taken, a.name) ELSE w.taken END
  FROM w JOIN a ON a.request_id = w.request_id AND a.rn = w.rn + 1 JOIN room ON room.request_id = w.request_id),
e AS (SELECT request_id, arg_max(used, rn) AS used, arg_max(taken, rn) AS taken FROM w GROUP BY request_id)
SELECT request_id, available, used, available - used AS tokens_free, round(used / available, 9) AS utilization,
  coalesce(string_agg(name, ',' ORDER BY ord) FILTER (list_contains(taken, name)), '') AS included, coalesce(string_agg(name, ',' ORDER BY ord) FILTER (NOT list_contains(taken, name)), '') AS dropped
FROM i JOIN e USING (request_id) JOIN room USING (request_id) GROUP BY request_id, used, available""",
    "order_for_cache": f"WITH {_ITEMS}\nSELECT request_id, name, row_number() OVER (PARTITION BY request_id ORDER BY NOT stable, ord) AS cache_order FROM i",
}
