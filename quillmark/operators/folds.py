"""Walk-forward folds as bounds, rows assigned to them, and sums over their training rows without copies of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAIN, TEST, EMBARGO = 750, 126, 1


def fold_bounds(sizes: DataFrame, train: int = TRAIN, test: int = TEST, step: int | None = None, expanding: bool = True, embargo: int = EMBARGO) -> DataFrame:
    """symbol, fold, train_start, train_end, test_start, test_end (ends excluded) from rows (symbol, n).

    Training sets expand from the first row on, or roll if not ``expanding``. The last test block may be shorter; a fold
    without a test row is none.
    """
    step = step or test
    if train <= 0 or test <= 0 or step < 0 or embargo < 0:
        raise ValueError("sizes are positive, step and embargo not negative")
    last = F.floor((F.col("n") - 1 - train - embargo) / step)
    folds = sizes.where(F.col("n") > train + embargo).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.lit(0).cast("long") if expanding else F.col("fold") * step
    end = F.col("fold") * step + train
    return folds.select("symbol", F.col("fold").cast("int").alias("fold"), start.alias("train_start"), end.alias("train_end"), (end + embargo).alias("test_start"), F.least(end + embargo + test, F.col("n")).alias("test_end"))


def assigned(rows: DataFrame, train: int = TRAIN, test: int = TEST, step: int | None = None, expanding: bool = True, embargo: int = EMBARGO) -> DataFrame:
    """Rows (symbol, pos, n_pos, ...) once for each fold that uses them, with ``fold`` and ``part`` train or test.

    Bounds are those of :func:`fold_bounds`, where ``n_pos`` is the symbol's number of rows. The folds of a position are a
    range of numbers, so a row is copied for its own folds only, without a join, and never meets the others.
    """
    step = step or test
    if train <= 0 or test <= 0 or step < 0 or embargo < 0:
        raise ValueError("sizes are positive, step and embargo not negative")
    pos, last = F.col("pos").cast("long"), F.floor((F.col("n_pos") - 1 - train - embargo) / step).cast("long")

    def folds(first, end):
        """Fold numbers from first to end; none where that is no range."""
        first, end = F.greatest(first, F.lit(0).cast("long")), F.least(end, last)
        return F.when(first <= end, F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))

    def floor(x):
        return F.floor(x / step).cast("long")

    trained = folds(floor(pos - train) + 1, last if expanding else floor(pos))
    tested = folds(floor(pos - train - embargo - test) + 1, floor(pos - train - embargo))

    def entry(part):
        return lambda f: F.struct(f.cast("int").alias("fold"), F.lit(part).alias("part"))

    entries = F.concat(F.transform(trained, entry("train")), F.transform(tested, entry("test")))
    return rows.where(F.col("n_pos") > train + embargo).select(*[c for c in rows.columns if c != "n_pos"], F.inline(entries))


def tested(rows: DataFrame, train: int = TRAIN, test: int = TEST, step: int | None = None, embargo: int = EMBARGO) -> DataFrame:
    """Rows (symbol, pos, n_pos, ...) once for each fold that tests them, with ``fold``."""
    step = step or test
    pos, last = F.col("pos").cast("long"), F.floor((F.col("n_pos") - 1 - train - embargo) / step).cast("long")
    first = F.greatest(F.floor((pos - train - embargo - test) / step).cast("long") + 1, F.lit(0).cast("long"))
    end = F.least(F.floor((pos - train - embargo) / step).cast("long"), last)
    folds = F.when(first <= end, F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))
    return rows.where(F.col("n_pos") > train + embargo).select(*[c for c in rows.columns if c != "n_pos"], F.explode(folds).alias("fold")).withColumn("fold", F.col("fold").cast("int"))


def piece(pos: Column, train: int = TRAIN, test: int = TEST, step: int | None = None) -> Column:
    """Number of the piece of its series that a position is in. Pieces end where some fold's training rows begin or end,
    so each fold trains on whole pieces: all up to that of its last row or, rolling, the last few of them."""
    step = step or test
    return (2 * F.floor(pos / step) + (F.pmod(pos, F.lit(step)) >= train % step).cast("int")).cast("long")


def training_sums(pieces: DataFrame, sums: list[str], by: list[str], train: int = TRAIN, test: int = TEST, step: int | None = None, expanding: bool = True, embargo: int = EMBARGO) -> DataFrame:
    """by, fold and ``sums`` over each fold's training rows, from sums by piece: rows (by, n_pos, piece, sums).

    Where folds expand this is a running sum over pieces; where they roll, a sum over the pieces of one training set.
    """
    step = step or test
    if train <= 0 or test <= 0 or step < 0 or embargo < 0:
        raise ValueError("sizes are positive, step and embargo not negative")
    whole, apart = divmod(train, step)
    ordered = Window.partitionBy(*by).orderBy("piece")
    frame = ordered.rangeBetween(Window.unboundedPreceding, 0) if expanding else ordered.rangeBetween(-2 * whole + (0 if apart else 1), 0)
    last = F.floor((F.col("n_pos") - 1 - train - embargo) / step)
    # the last piece of fold f's training set is 2 (f + whole), or one less where no piece has an even number
    fold = F.floor((F.col("piece") + (0 if apart else 1)) / 2) - whole
    ends = F.pmod("piece", F.lit(2)) == (0 if apart else 1)
    summed = pieces.select(*by, "n_pos", "piece", *[F.sum(c).over(frame).alias(c) for c in sums])
    return summed.where(ends & (F.col("n_pos") > train + embargo)).withColumn("fold", fold.cast("int")).where((F.col("fold") >= 0) & (F.col("fold") <= last)).select(*by, "fold", *sums)
