"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down a tree (for example domain, language, source). At each node it is split among the children by
weight; a child takes no more than its subtree holds in ``max_epochs`` passes, and what it leaves goes to its siblings
by their weights before any is missed further up: a node's budget is already cut to what its subtree can give. Each leaf
then takes whole passes over its documents and a prefix of one more pass, in an order that depends on a seed and on the
pass. All numbers are integers, so every engine gives the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

MISSING = "(none)"


def word_tokens(text: Column) -> Column:
    """Number of words: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default).cast("long")
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)))])
    return F.coalesce(table[F.col(level)], F.lit(default)).cast("long")


def _wide(x) -> Column:
    return x.cast("decimal(19,0)")


def budgets(stats: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column | int, max_epochs: int = 4, default_weight: int = 1) -> DataFrame:
    """``levels``, tokens, budget of each leaf from rows ``levels``, tokens (one row a leaf).

    ``weights`` gives a level's weights by name, whole numbers of zero or more; names without one have
    ``default_weight``. A child of weight zero gets nothing. Each level sums the leaves once and meets the level above
    once, so the plan grows by the same steps with every level.
    """
    above, path = None, []
    for level in levels:
        own = [*path, level]
        nodes = stats.groupBy(*own).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * max_epochs).alias("room"))
        nodes = nodes.withColumn("weight", _weight(level, weights.get(level, {}), default_weight)).where("weight > 0 AND room > 0")
        nodes = nodes.withColumn("given", (budget if isinstance(budget, Column) else F.lit(budget)).cast("long")) if above is None else nodes.join(above, path)
        order = Window.partitionBy(*path).orderBy(F.col("room") / F.col("weight"), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        group = Window.partitionBy(*path)
        nodes = nodes.withColumn("left", F.col("given") - F.coalesce(F.sum("room").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        nodes = nodes.withColumn("full", _wide(F.col("room")) * _wide(F.col("open")) <= _wide(F.col("weight")) * _wide(F.greatest("left", F.lit(0))))
        nodes = nodes.withColumn("rest", F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(group), F.lit(0))).withColumn("sharing", F.sum(F.when(~F.col("full"), F.col("weight"))).over(group))
        share = F.expr("cast((cast(weight as decimal(19,0)) * cast(rest as decimal(19,0))) div cast(sharing as decimal(19,0)) as bigint)")
        nodes = nodes.withColumn("given", F.when(F.col("full"), F.col("room")).otherwise(share))
        above, path = nodes.select(*own, "given"), own
    return nodes.select(*levels, "tokens", F.col("given").alias("budget"))


def mix(docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget_percent: int = 50, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", default_weight: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, ``levels``, n_tokens, epochs, extra_tokens, selected_tokens.

    Columns named in ``carry`` are handed through in a struct ``carried``; other columns are not read.

    The budget is ``budget_percent`` of all tokens. ``epochs`` counts whole passes over the document, ``extra_tokens`` is
    how long a prefix of it the last, partial pass takes; ``selected_tokens`` is what both give. Null levels are one
    leaf of their own, texts without words and rows of a leaf without budget select nothing. Rows are drawn by their
    id: those that share one (or have none) stand next to each other in the order, shorter ones first, and each selects
    for itself. An empty table gives an empty result.

    Counts, leaves and the place where each leaf's partial pass ends are written tables; nothing but the number of all
    tokens comes to the driver.
    """
    levels = list(levels)
    names = [F.coalesce(F.col(x).cast("string"), F.lit(MISSING)).alias(x) for x in levels]
    passed_on = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *names, F.col(text_col).alias("__text"), *passed_on)
    count = word_tokens(F.col("__text")).alias("n_tokens")
    counted = stored(rows.select("doc_id", *levels, count), "counted")
    leaves = stored(counted.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = budgets(leaves, levels, weights, int(total) * budget_percent // 100, max_epochs, default_weight)
    plan = stored(plan.select(*levels, F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest")), "plan")

    def drawn(table: DataFrame) -> DataFrame:
        draw = F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce("epochs", F.lit(0)).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        return table.withColumn("draw", draw).withColumn("slice", F.substring("draw", 1, 3))

    # the first characters of the draw cut a leaf into even slices; only the slice in which the pass ends is put in order
    slices = drawn(counted.join(plan.where("rest > 0"), levels)).groupBy(*levels, "slice").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"))
    running = Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = slices.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0))).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))
    plan = stored(plan.join(ends.select(*levels, F.col("slice").alias("edge"), "before"), levels, "left"), "plan")

    extra = ["carried"] if carry else []
    placed = drawn((rows if carry else counted).join(plan, levels, "left"))
    out = ["doc_id", *levels, *extra, count if carry else "n_tokens", "epochs", "rest", "before", "draw", "slice", "edge"]
    beside = placed.where("edge IS NULL OR slice <> edge").select(*out).withColumn("extra_tokens", F.when(F.col("slice") < F.col("edge"), F.col("n_tokens")).otherwise(0))
    inside = Window.partitionBy(*levels).orderBy("draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    within = placed.where("slice = edge").select(*out).withColumn("extra_tokens", F.greatest(F.least(F.col("n_tokens"), F.col("rest") - start), F.lit(0)))
    epochs, more = F.coalesce("epochs", F.lit(0)).cast("long"), F.coalesce("extra_tokens", F.lit(0)).cast("long")
    return beside.unionByName(within).select("doc_id", *levels, *extra, "n_tokens", epochs.alias("epochs"), more.alias("extra_tokens"), (epochs * F.col("n_tokens") + more).alias("selected_tokens"))
