"""Line dedup by a tree of line templates.

A line walks down a tree of fixed depth: its number of tokens, then its leading tokens, then its last token, where a
token with a digit counts as a variable field. The leaf is its template; everything between leading and last token is
left to vary. A template recurs when it stands in enough documents; copies of one document have its sequence of templates,
count once, and do not make its lines boilerplate. Recurring templates are dropped. All steps are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

VARIABLE = "<*>"


def normal_line(line: Column) -> Column:
    """Tokens with one space between, those with a digit generalised."""
    spaced = F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " "))
    return F.regexp_replace(spaced, "[^ ]*[0-9][^ ]*", VARIABLE)


def template(normal: Column, depth: int) -> Column:
    """Path of a normalised line in the tree; null for a line without tokens."""
    tokens = F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1
    return F.when(normal != "", F.concat_ws("\n", tokens.cast("string"), F.substring_index(normal, " ", depth), F.substring_index(normal, " ", -1)))


def _name(path: Column) -> list[Column]:
    """128 bits that stand for a path: two hashes from different seeds; null for none."""
    return [F.when(path.isNotNull(), h) for h in (F.xxhash64(path), F.xxhash64(F.lit(7), path))]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 4, min_documents: int = 10, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept (the lines that stay).

    Columns named in ``carry`` are handed through in a struct ``carried``; other columns are not read.

    Lines are separated by a line feed; blank lines have no template and stay. A null text has one empty line, like an
    empty one. An empty table gives an empty result. Rows that repeat an id with another text are documents of their
    own, also without an id.

    A template is dropped when documents with at least ``min_documents`` different sequences of templates (blank lines
    aside) have it; a sequence of one template tells no copies, so such documents count by their text. Repeated rows
    count once. The work on a document grows with its number of lines, not faster. A template is known by 128 bits, a
    sequence by 64, where two that fall together would be counted as one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), F.struct(*[F.col(c) for c in carry] or [F.lit(None).alias("none")]).alias("carried"))
    paths = F.transform(F.transform(F.split("text", "\n", -1), normal_line), lambda x: template(x, depth))
    named = F.transform(paths, lambda x: F.struct(*[h.alias(n) for h, n in zip(_name(x), ("high", "low"), strict=True)]))
    found = rows.select("doc_id", "text_key", named.alias("names"))
    sequence = F.filter("names", lambda x: x.high.isNotNull())
    found = found.withColumn("document", F.when(F.size(sequence) == 1, F.col("text_key")).otherwise(F.xxhash64(sequence)))
    # the outer form, though no text is without a line: else a filter on the names' number would be pushed below and make them twice
    lines = stored(found.select("doc_id", "text_key", "document", F.posexplode_outer("names").alias("line", "name")).select("doc_id", "text_key", "document", "line", "name.*").where("high IS NOT NULL"), "lines")
    recurring = lines.groupBy("high", "low", "document").agg(F.lit(1).alias("n")).groupBy("high", "low").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("high", "low")
    gone = lines.join(recurring, ["high", "low"], "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    joined = rows.join(gone, same, "left").select("doc_id", "text", "carried", F.split("text", "\n", -1).alias("all"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # array_except looks numbers up in a hash set
    stay = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone")
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("all", i)), "\n"))
    extra = ["carried"] if carry else []
    return joined.select("doc_id", *extra, F.size("all").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept"))
