"""Walk-forward ridge regression from additive sums: no row is copied to the folds that train on it.

What a ridge regression needs of its training rows (their number, sums, and sums of products) adds up. Rows are summed by
symbol and piece in the tasks that hold them, pieces are summed by Spark over each fold's training range, and one small
system is solved a fold. Test rows meet their fold's weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.features import FEATURES, TARGET
from quillmark.operators.folds import piece, tested, training_sums

RIDGE_ALPHA = 50.0


def gram_pieces(data: DataFrame, columns: list[str] | None = None, train: int = 750, test: int = 126, step: int | None = None) -> DataFrame:
    """symbol, n_pos, piece, at, total: sums of the products of (1, columns, target), by piece and place ``at`` in the upper
    triangle of their matrix, row by row."""
    columns = columns or FEATURES
    rows = data.select("symbol", "n_pos", piece(F.col("pos"), train, test, step).alias("piece"), *[F.col(c).cast("double").alias(f"x{n}") for n, c in enumerate([*columns, TARGET])])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        upper = np.triu_indices(len(columns) + 2)
        for batch in batches:
            symbols, numbers, lengths = (batch.column(n).to_pylist() for n in (0, 2, 1))
            x = np.column_stack([np.ones(len(symbols)), *(batch.column(n).to_numpy(zero_copy_only=False) for n in range(3, batch.num_columns))])
            places: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(symbols, lengths, numbers, strict=True)):
                places.setdefault(key, []).append(at)
            sums = [(x[at].T @ x[at])[upper] for at in places.values()]
            keys = list(zip(*places, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["symbol", "n_pos", "piece", "sums"])

    by_task = rows.mapInArrow(multiply, "symbol string, n_pos long, piece long, sums array<double>")
    return by_task.select("symbol", "n_pos", "piece", F.posexplode("sums").alias("at", "x")).groupBy("symbol", "n_pos", "piece", "at").agg(F.sum("x").alias("total"))


def solve(sums, features: int, alpha: float):
    """Intercept and weights on the raw features, from the upper triangle of the sums of products of (1, features, target):
    features are standardised, the intercept is free."""
    import numpy as np

    size = features + 2
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = sums
    m = m + np.triu(m, 1).T
    n, center, mean = m[0, 0], m[0, 1:-1] / m[0, 0], m[0, -1] / m[0, 0]
    spread = m[1:-1, 1:-1] - n * np.outer(center, center)
    with_target = m[1:-1, -1] - n * center * mean
    variance = np.diag(spread) / n
    flat = variance <= 1e-13 * np.maximum(np.diag(m)[1:-1] / n, 1e-300)  # a constant column, but for rounding
    scale = np.sqrt(np.where(flat, 1.0, variance))
    spread[flat], spread[:, flat], with_target[flat] = 0, 0, 0
    weights = np.linalg.solve(spread / np.outer(scale, scale) + alpha * np.eye(features), with_target / scale) / scale
    return np.concatenate([[mean - center @ weights], weights])


def ridge_weights(data: DataFrame, columns: list[str] | None = None, train: int = 750, test: int = 126, step: int | None = None, expanding: bool = True, embargo: int = 1, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """symbol, fold, weights (the intercept, then one for each column)."""
    columns = columns or FEATURES
    pieces = gram_pieces(data, columns, train, test, step)
    sums = training_sums(pieces, ["total"], ["symbol", "at"], train, test, step, expanding, embargo)
    whole = sums.groupBy("symbol", "fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "total"))), lambda x: x["total"]).alias("sums"))  # a fixed number a fold
    size = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve(x, size, alpha) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["symbol", "fold", "weights"])

    return whole.mapInArrow(run, "symbol string, fold int, weights array<double>")


def ridge_predictions(data: DataFrame, columns: list[str] | None = None, train: int = 750, test: int = 126, step: int | None = None, expanding: bool = True, embargo: int = 1, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """Out-of-sample ridge forecasts: symbol, model, fold, date, prediction, actual."""
    columns = columns or FEATURES
    weights = ridge_weights(data, columns, train, test, step, expanding, embargo, alpha)
    rows = tested(data.select("symbol", "date", "pos", "n_pos", *columns, TARGET), train, test, step, embargo).join(weights, ["symbol", "fold"])
    value = F.get("weights", F.lit(0))
    for n, c in enumerate(columns, 1):
        value = value + F.col(c) * F.get("weights", F.lit(n))
    return rows.select("symbol", F.lit("ridge").alias("model"), "fold", "date", value.alias("prediction"), F.col(TARGET).alias("actual"))


def feature_correlations(data: DataFrame, columns: list[str] | None = None, train: int = 750, test: int = 126, step: int | None = None, expanding: bool = True, embargo: int = 1) -> DataFrame:
    """symbol, fold, feature, correlation with the target over each fold's training rows; 0 where a side does not vary.

    From sums of all columns at once, by piece: no row is copied to a fold, and neighbouring pieces add up.
    """
    columns = columns or FEATURES
    y = F.col(TARGET)
    parts = ["n", "sy", "syy", *[f"{kind}{n}" for n in range(len(columns)) for kind in ("sx", "sxx", "sxy")]]
    sums = [F.count("*").cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    for n, c in enumerate(columns):
        x = F.col(c)
        sums += [F.sum(x).alias(f"sx{n}"), F.sum(x * x).alias(f"sxx{n}"), F.sum(x * y).alias(f"sxy{n}")]
    pieces = data.groupBy("symbol", "n_pos", piece(F.col("pos"), train, test, step).alias("piece")).agg(*sums)
    whole = training_sums(pieces, parts, ["symbol"], train, test, step, expanding, embargo)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{k}{n}").alias(k) for k in ("sx", "sxx", "sxy")]) for n, c in enumerate(columns)]))
    tall = whole.select("symbol", "fold", "n", "sy", "syy", each.alias("f")).select("symbol", "fold", "n", "sy", "syy", "f.*")

    def variance(squares: str, total: str):
        v = F.col(squares) / F.col("n") - (F.col(total) / F.col("n")) ** 2
        return F.when(v > 1e-13 * F.col(squares) / F.col("n"), v)  # what is less is rounding

    covariance = F.col("sxy") / F.col("n") - F.col("sx") / F.col("n") * F.col("sy") / F.col("n")
    r = F.coalesce(covariance / F.sqrt(variance("sxx", "sx") * variance("syy", "sy")), F.lit(0.0))
    return tall.select("symbol", "fold", "feature", r.alias("correlation"))


def top_features(correlations: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` features of each symbol and fold with the largest absolute correlation (ties: by name), with their rank."""
    order = Window.partitionBy("symbol", "fold").orderBy(F.desc(F.abs("correlation")), "feature")
    return correlations.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantile_edges(data: DataFrame, columns: list[str], bins: int = 5, by: str = "symbol", accuracy: int | None = None) -> DataFrame:
    """by, feature, edges: the inner borders of ``bins`` bins of equal share of each column, linear between values.

    With ``accuracy`` borders come from mergeable summaries of a bounded size instead: each is a value whose rank is off by
    at most one ``accuracy``-th of the rows.
    """
    shares = [n / bins for n in range(1, bins)]
    tall = data.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select(by, "f.*")
    edges = F.percentile_approx("x", shares, accuracy) if accuracy else F.percentile("x", F.array(*[F.lit(s) for s in shares]))
    return tall.groupBy(by, "feature").agg(edges.alias("edges"))


def digitized(data: DataFrame, edges: DataFrame, columns: list[str], by: str = "symbol") -> DataFrame:
    """``data`` in tall form (by, date, feature, bin): how many borders a value has reached; a missing value has no bin."""
    tall = data.select(by, "date", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select(by, "date", "f.*")
    reached = F.when(F.col("x").isNotNull(), F.size(F.filter("edges", lambda e: F.col("x") >= e)))
    return tall.join(edges, [by, "feature"]).select(by, "date", "feature", reached.alias("bin"))
