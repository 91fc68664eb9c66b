"""A training corpus from raw documents: language, lines, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read as the next one's
``docs``. All but the last give the columns of ``documents``. A stage decides about rows, not ids: where ids are null or
repeat, each row has its own fate.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.byte_bpe import encode_documents
from quillmark.llm.catalog import MIX_LEVELS, MIX_WEIGHTS, PATTERN, RANKS, with_domain
from quillmark.llm.exact_dedup import with_maybe
from quillmark.llm.jaccard_join import jaccard_components
from quillmark.llm.language_id import fit, held_out, predict
from quillmark.llm.line_templates import line_dedup
from quillmark.llm.mixing import mix
from quillmark.llm.shared import discard, keep, scope, stored
from quillmark.session import configure

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays when at least this share of its letter trigrams, less what chance gives, belongs to its language.
#: Random letters come to about 0.06; no document of a known language came below 0.54.
LEAST_SCORE = 0.2


def _configured(stage):
    """A stage that also has the library's settings (zones, batches of bounded size) where it is run by itself."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)

    return run


@_configured
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a missing label is filled in.

    Null and empty texts, texts without letters and texts that fit no language go. Labels, ids and sources decide
    nothing.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs.select(*COLUMNS), model)
    known = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return known.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


@_configured
def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; one of nothing but such lines goes.

    ``n_chars`` is counted anew where lines went. Null and empty texts pass.
    """
    # of a text that is kept as it was, all but whether it was null is in ``kept``: no text travels twice
    marked = docs.withColumn("no_text", F.col("text").isNull())
    found = line_dedup(marked, depth=4, min_documents=10, carry=["lang", "source", "n_chars", "no_text"])
    left = (F.col("n_dropped") == 0) | F.col("kept").rlike("[^\\x20\\x09-\\x0D]")
    changed = F.col("n_dropped") > 0
    text = F.when(~F.col("carried.no_text"), F.col("kept"))
    n_chars = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("carried.n_chars"))
    return found.where(left).select("doc_id", text.alias("text"), "carried.lang", "carried.source", n_chars.alias("n_chars"))


@_configured
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id (and then the smallest hash of its text).

    Of rows that repeat both id and text one stays, the first by its other columns. Rows without an id and texts without
    a word belong to no group and stay.
    """
    docs = docs.select(*COLUMNS)
    groups = jaccard_components(docs, width=5, percent=80, row_keys=True).where("component IS NOT NULL")
    rows = stored(groups.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("n")), "rows")
    best = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    judged = rows.join(best, "component").withColumn("stays", F.struct("doc_id", "text_key") == F.col("best"))
    odd = stored(judged.where("NOT stays OR n > 1").select("doc_id", "text_key", "stays"), "judged")
    keyed = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    screened = with_maybe(keyed, odd, ["doc_id", "text_key"])
    maybe = screened.where("maybe")  # only their texts are shuffled, and the keys are hashed, so that no text is sorted
    whole = screened.where("NOT maybe").select(*COLUMNS).unionByName(maybe.join(odd.hint("shuffle_hash"), ["doc_id", "text_key"], "left_anti").select(*COLUMNS))
    twins = odd.where("stays").select("doc_id", "text_key")
    if twins.isEmpty():
        return whole
    order = Window.partitionBy("doc_id", "text_key").orderBy("lang", "source", "n_chars")
    first = maybe.join(twins, ["doc_id", "text_key"], "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return whole.unionByName(first.select(*COLUMNS))


@_configured
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that one pass at most of the target mixture takes; those without words are never taken."""
    chosen = mix(with_domain(docs), MIX_LEVELS, MIX_WEIGHTS, budget_percent=80, max_epochs=1, seed=17, carry=COLUMNS)
    return chosen.where("selected_tokens > 0").select(*[F.col(f"carried.{c}").alias(c) for c in COLUMNS])


@_configured
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), their number, and digests of ids and decoded bytes."""
    return encode_documents(docs, RANKS, PATTERN, with_ids=True, with_decoded=False)


STAGES = [
    ("language_id", identify_language),
    ("line_templates", drop_template_lines),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The language model is fitted, which SQL can't express; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Once a stage is written, its input and its inner tables are deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = keep(stored(stage(spark, docs, sf_dir), name))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
