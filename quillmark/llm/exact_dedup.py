"""Exact dedup: a filter of bits hit twice tells which rows may have a copy; only those are shuffled.

First pass: each distinct-looking text sets two bits of one 32,768-bit block, and bits that were set more
than once are kept as block bitmaps. Second pass: every row probes its block; a row whose two bits were not both set
twice is certainly alone and passes straight through. The others are grouped by SHA-256.

The bitmaps are broadcast. Their size is at most ``max_filter_bits`` / 8 bytes, whatever the corpus; beyond what one
filter serves, the digests are written in slices by hash, and slice by slice is read once, with a filter of its own of
that size, and its rows are written: one plan of one shape for each, however many there are.
Everything is built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, discard, shuffle_parts, stored

BLOCK_BITS = 32_768


def _probe(bits: str, position: str) -> Column:
    """Whether a bit of a block bitmap is set; false where the block is absent."""
    return F.expr(f"coalesce(getbit(cast(conv(hex(substring({bits}, {position} div 8 + 1, 1)), 16, 10) as int), {position} % 8) = 1, false)")


def with_maybe(rows: DataFrame, keys: DataFrame, on: Sequence[str], bits_per_key: int = 16, max_filter_bits: int = 2**29) -> DataFrame:
    """``rows`` with a column ``maybe``: false where the values of ``on`` are certainly not in ``keys``, so that only the other
    rows need to meet them. ``keys`` is read twice.

    Each key sets two bits of one block bitmap. The bitmaps are broadcast, at most ``max_filter_bits`` / 8 bytes; with more keys
    than these serve, more rows are true.
    """
    blocks = max(1, min(keys.count() * bits_per_key, max_filter_bits) // BLOCK_BITS)
    first, second = F.xxhash64(*on), F.xxhash64(*on, F.lit(7))
    places = {"_block": F.pmod(first, F.lit(blocks)), "_a": F.pmod(second, F.lit(BLOCK_BITS)).cast("int"), "_b": F.pmod(F.shiftrightunsigned(second, 30), F.lit(BLOCK_BITS)).cast("int")}
    bits = keys.withColumns(places).select("_block", F.explode(F.array("_a", "_b")).alias("_bit"))
    bitmaps = bits.groupBy("_block").agg(F.bitmap_construct_agg(F.col("_bit").cast("long")).alias("_bits"))
    probed = rows.withColumns(places).join(F.broadcast(bitmaps), "_block", "left")
    return probed.select(*[F.col(c) for c in rows.columns], (_probe("_bits", "_a") & _probe("_bits", "_b")).alias("maybe"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and SHA-256 of the normalised text of every row; a null text counts as empty."""
    normal = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", bits_per_row: int = 16, max_filter_bits: int = 2**29) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A to Z. ``keep`` says whether the largest or the smallest id of
    a group stays. Rows that repeat an id with the same text share its fate; a null id never beats another one, and
    where all ids of a group are null, all its rows stay. An empty table gives an empty result; other columns, whatever
    their names, are not read.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    rows = stored(digests(docs, id_col, text_col), "digests")
    wanted = max(rows.count() * bits_per_row, BLOCK_BITS)
    slices = -(-wanted // max_filter_bits)
    blocks = max(1, -(-wanted // slices // BLOCK_BITS))
    if slices == 1:
        return _named(_judged(rows, blocks, keep))
    cut = F.pmod(F.shiftrightunsigned(F.xxhash64("digest"), 40), F.lit(slices)).cast("int")
    # one slice goes to few files
    sliced = stored(rows.withColumn("slice", cut).repartition(shuffle_parts(rows.sparkSession), "slice", F.pmod("doc_id", F.lit(64))), "slices", by="slice")
    discard(rows)
    done = [stored(_judged(sliced.where(F.col("slice") == n).drop("slice"), blocks, keep), "judged") for n in range(slices)]
    discard(sliced)
    folders = sorted({file.rsplit("/", 1)[0] for part in done for file in part.inputFiles()})
    return _named(rows.sparkSession.read.schema(done[0].schema).parquet(*folders))


def _judged(rows: DataFrame, blocks: int, keep: str) -> DataFrame:
    """doc_id, keep_id, group_size, digest of the rows of one slice.

    A group of copies is joined with its one row of results; where it is large, Spark splits it over tasks.
    """
    first, second = F.xxhash64("digest"), F.xxhash64("digest", F.lit(7))
    part = rows.select(
        "doc_id",
        "digest",
        F.pmod(first, F.lit(blocks)).alias("block"),
        F.pmod(second, F.lit(BLOCK_BITS)).cast("int").alias("bit_a"),
        F.pmod(F.shiftrightunsigned(second, 30), F.lit(BLOCK_BITS)).cast("int").alias("bit_b"),
    )
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    hits = part.select("block", F.explode(F.array_distinct(F.array("bit_a", "bit_b"))).alias("bit"))
    twice = hits.groupBy("block", "bit").agg(F.count("*").alias("n")).where("n > 1")
    bitmaps = twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits"))
    probed = part.join(F.broadcast(bitmaps), "block", "left").select("doc_id", "digest", (_probe("bits", "bit_a") & _probe("bits", "bit_b")).alias("maybe"))
    alone = probed.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    again = probed.where("maybe").select("doc_id", "digest")
    groups = again.groupBy("digest").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    return alone.unionByName(again.join(groups, "digest").select("doc_id", "keep_id", "group_size", "digest"))


def _named(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
