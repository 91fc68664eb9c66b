"""Recurrences and running extremes over long series, block by block.

A step of y -> a y + b is a pair (a, b), and the composition of steps is such a pair again. Each block of rows is composed
by itself, the pairs of blocks are composed in order, and the state before a block is handed back to its rows. Blocks of one
series may be anywhere; no task needs a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a block of returns, and steps of a block of recurrences.
BLOCK, STEPS = 256, 64


def affine_scan(df: DataFrame, by: list[str], index: str, steps: dict[str, tuple[str, str]], block: int = STEPS, blocks: str | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``steps``, name: (a, b), that holds y = a y + b after each row, from y = 0.

    ``index`` numbers the rows of each group of ``by`` from 0; no ``a`` is zero, and products of ``block`` of them stay
    within the range of doubles. In a block, the steps up to a row compose to the product of their ``a`` and that product
    times the sum of b / product so far. Each block hands on one pair; the pairs of earlier blocks give the state before it,
    which is joined back. Only the pairs of a group, one for each ``block`` rows, meet in one place.

    ``blocks`` names a column that numbers blocks instead, by ranges of ``index``, which need not be a number then: rows that are
    sorted by group, block and index need no other sort. The join goes to ``parts`` tasks if given.
    """
    names = list(steps)
    rows = df.withColumn("_block", F.col(blocks) if blocks else F.floor(F.col(index) / block).cast("long"))
    running = Window.partitionBy(*by, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_a{k}": F.product(F.col(steps[n][0])).over(running) for k, n in enumerate(names)})
    rows = rows.withColumns({f"_b{k}": F.col(f"_a{k}") * F.sum(F.col(steps[n][1]) / F.col(f"_a{k}")).over(running) for k, n in enumerate(names)})
    pair = F.struct(*[f"_{side}{k}" for k in range(len(names)) for side in "ab"])
    pairs = rows.groupBy(*by, "_block").agg(F.max_by(pair, index).alias("_pair"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.struct(*[F.lit(0.0).alias(f"_y{k}") for k in range(len(names))])

    def after(y, p):
        return F.struct(*[(p[f"_a{k}"] * y[f"_y{k}"] + p[f"_b{k}"]).alias(f"_y{k}") for k in range(len(names))])

    states = pairs.withColumn("_before", F.aggregate(F.collect_list("_pair").over(before), zero, after))
    there = states.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_block").alias("_at"), "_before.*")
    if parts:

        def keys(of: str, at: str) -> list[Column]:
            return [key for c in by for key in (F.coalesce(F.col(of + c).cast("string"), F.lit("")), F.isnull(of + c))] + [F.col(at)]

        met = rows.repartition(parts, *keys("", "_block")).join(there.repartition(parts, *keys("_of_", "_at")), [a == b for a, b in zip(keys("", "_block"), keys("_of_", "_at"), strict=True)])
    else:
        met = rows.join(there, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("_block") == F.col("_at")])
    return met.select(*df.columns, *[(F.col(f"_a{k}") * F.col(f"_y{k}") + F.col(f"_b{k}")).alias(n) for k, n in enumerate(names)])


def ewm_steps(x: str, alpha: float, by: list[str], index: str, order: Sequence[str] = ()) -> tuple[Column, Column, Column]:
    """Pairs of an exponentially weighted mean of column ``x``, y = (1 - alpha) y + alpha x, and how many values so far.

    The first value is the first mean. A missing value keeps the mean, and what came before it weighs less afterwards.
    ``order`` names columns that give the order of ``index``, where rows are sorted by them already.
    """
    order = Window.partitionBy(*by).orderBy(*(order or [index]))
    seen = F.count(x).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.max(F.when(F.col(x).isNotNull(), F.col(index))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    old = F.pow(F.lit(1 - alpha), F.col(index) - last)
    a = F.when(F.col(x).isNull() | last.isNull(), 1.0).otherwise(old / (old + alpha))
    b = F.when(F.col(x).isNull(), 0.0).when(last.isNull(), F.col(x)).otherwise(alpha * F.col(x) / (old + alpha))
    return a, b, seen


def block_of(order: Column, kind: str, block: int = BLOCK) -> Column:
    """Number of the block of a day (``block`` days each) or of a number."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        order = F.unix_date(order.cast("date"))
    return F.floor(order / block).cast("long")


def drawdown_blocks(df: DataFrame, by: list[str], order: str = "date", net: str = "net_return", block: int = BLOCK) -> DataFrame:
    """by, _block, days, product, highest, lowest: each block's rows in order, and the product, largest and smallest
    product from its start of 1 + net (a null counting as 0). Product and extremes of neighbours combine."""
    kind = dict(df.dtypes)[order]
    rows = df.select(*by, block_of(F.col(order), kind, block).alias("_block"), F.col(order).alias("at"), (1 + F.coalesce(F.col(net), F.lit(0.0))).alias("f"))
    listed = rows.groupBy(*by, "_block").agg(F.sort_array(F.collect_list(F.struct("at", "f"))).alias("days"))
    one = F.lit(1.0)
    start = F.struct(one.alias("product"), F.lit(None).cast("double").alias("highest"), F.lit(None).cast("double").alias("lowest"))

    def step(s, d):
        p = s["product"] * d["f"]
        return F.struct(p.alias("product"), F.greatest(s["highest"], p).alias("highest"), F.least(s["lowest"], p).alias("lowest"))

    return listed.select(*by, "_block", "days", F.aggregate("days", start, step).alias("s")).select(*by, "_block", "days", "s.*")


def max_drawdown(df: DataFrame, by: list[str], order: str = "date", net: str = "net_return", block: int = BLOCK) -> DataFrame:
    """Largest fall from the highest equity so far, as a share of it; equity compounds from 1, and its first value is the
    first peak.

    Blocks of ``block`` days are summed up where they are. Equity and peak before a block come from the summaries of those
    before it, one row a block; a block's own falls are then found from its days. Equity may fall below zero.
    """
    blocks = drawdown_blocks(df, by, order, net, block)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opened = blocks.withColumn("equity", F.coalesce(F.product("product").over(before), F.lit(1.0)))
    own = F.when(F.col("equity") >= 0, F.col("equity") * F.col("highest")).otherwise(F.col("equity") * F.col("lowest"))
    opened = opened.withColumn("own", own).withColumn("peak", F.max("own").over(before))
    start = F.struct(F.col("equity").alias("e"), F.col("peak").alias("k"), F.lit(None).cast("double").alias("d"))

    def step(s, day):
        e = s["e"] * day["f"]
        k = F.greatest(s["k"], e)
        return F.struct(e.alias("e"), k.alias("k"), F.greatest(s["d"], F.try_divide(k - e, k)).alias("d"))

    return opened.withColumn("_d", F.aggregate("days", start, step)["d"]).groupBy(*by).agg(F.coalesce(F.max("_d"), F.lit(0.0)).alias("max_drawdown"))
