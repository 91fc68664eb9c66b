"""Walk-forward forecasts: models refitted on each fold and scored out of sample only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.features import FEATURES, TARGET
from quillmark.operators.folds import assigned, piece, tested, training_sums
from quillmark.operators.gram import RIDGE_ALPHA, ridge_predictions
from quillmark.scratch import written

RESULT = "symbol string, model string, fold int, date date, prediction double, actual double"


def zero(train_x, train_y, test_x):
    import numpy as np

    return np.zeros(len(test_x))


def mean(train_x, train_y, test_x):
    import numpy as np

    return np.full(len(test_x), train_y.mean())


def persistence(train_x, train_y, test_x):
    return test_x[:, FEATURES.index("ret_lag_1")]


def ridge(train_x, train_y, test_x, alpha: float = RIDGE_ALPHA):
    """Ridge regression on standardised features with a free intercept."""
    import numpy as np

    center, scale = train_x.mean(axis=0), train_x.std(axis=0)
    scale[scale == 0] = 1
    x = (train_x - center) / scale
    weights = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (train_y - train_y.mean()))
    return (test_x - center) / scale @ weights + train_y.mean()


def _grow(x, g, depth: int, leaf: int, columns, l2: float, rng=None, take: int | None = None):
    """A regression tree by sorted splits: nested (column, threshold, left, right) or a leaf's value."""
    import numpy as np

    value = g.sum() / (len(g) + l2)
    if depth == 0 or len(g) < 2 * leaf:
        return value
    chosen = columns if take is None else rng.choice(columns, take, replace=False)
    best, total, n = (1e-12, None, None), g.sum(), len(g)
    counts = np.arange(1, n)
    for c in chosen:
        order = np.argsort(x[:, c], kind="stable")
        v, left = x[order, c], np.cumsum(g[order])[:-1]
        gain = left**2 / (counts + l2) + (total - left) ** 2 / (n - counts + l2) - total**2 / (n + l2)
        gain[(v[1:] <= v[:-1]) | (counts < leaf) | (n - counts < leaf)] = 0
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > best[0]:
            best = (gain[k], c, (v[k] + v[k + 1]) / 2)
    if best[1] is None:
        return value
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], g[low], depth - 1, leaf, columns, l2, rng, take), _grow(x[~low], g[~low], depth - 1, leaf, columns, l2, rng, take)


def _tree(node, x):
    import numpy as np

    if not isinstance(node, tuple):
        return np.full(len(x), node)
    low = x[:, node[0]] <= node[1]
    out = np.empty(len(x))
    out[low], out[~low] = _tree(node[2], x[low]), _tree(node[3], x[~low])
    return out


def forest(train_x, train_y, test_x, trees: int = 300, depth: int = 4, leaf: int = 50, seed: int = 0):
    """Bootstrapped trees over random feature subsets."""
    import numpy as np

    rng = np.random.default_rng(seed)
    columns, out = np.arange(train_x.shape[1]), np.zeros(len(test_x))
    for _ in range(trees):
        rows = rng.integers(len(train_x), size=len(train_x))
        out += _tree(_grow(train_x[rows], train_y[rows], depth, leaf, columns, 0.0, rng, max(1, int(np.sqrt(len(columns))))), test_x)
    return out / trees


def _grow_binned(codes, g, depth: int, leaf: int, l2: float, bins: int):
    """A tree over binned columns: the gains of all splits of all columns from two histograms."""
    import numpy as np

    n, k = codes.shape
    if depth == 0 or n < 2 * leaf:
        return g.sum() / (n + l2)
    flat = (codes + np.arange(k) * bins).ravel()
    count = np.bincount(flat, minlength=k * bins).reshape(k, bins).cumsum(axis=1)[:, :-1]
    left = np.bincount(flat, np.repeat(g, k), minlength=k * bins).reshape(k, bins).cumsum(axis=1)[:, :-1]
    total = g.sum()
    gain = left**2 / (count + l2) + (total - left) ** 2 / (n - count + l2) - total**2 / (n + l2)
    gain[(count < leaf) | (n - count < leaf)] = 0
    best = int(gain.argmax())
    if gain.ravel()[best] <= 1e-12:
        return total / (n + l2)
    column, cut = divmod(best, bins - 1)
    low = codes[:, column] <= cut
    return column, cut, _grow_binned(codes[low], g[low], depth - 1, leaf, l2, bins), _grow_binned(codes[~low], g[~low], depth - 1, leaf, l2, bins)


def boosting(train_x, train_y, test_x, rounds: int = 300, depth: int = 3, rate: float = 0.02, leaf: int = 50, l2: float = 1.0):
    """Gradient boosting of squared error with shrunk leaves, over features in 255 bins, as their order is all that matters."""
    import numpy as np

    columns = range(train_x.shape[1])
    edges = [np.unique(np.quantile(train_x[:, c], np.linspace(0, 1, 256)[1:-1])) for c in columns]
    a, b = (np.stack([np.searchsorted(edges[c], x[:, c]) for c in columns], axis=1) for x in (train_x, test_x))
    fit, out = np.full(len(a), train_y.mean()), np.full(len(b), train_y.mean())
    for _ in range(rounds):
        tree = _grow_binned(a, train_y - fit, depth, leaf, l2, 256)
        fit += rate * _tree(tree, a)
        out += rate * _tree(tree, b)
    return out


BASELINES = ("zero", "mean", "persistence")
MODELS: dict[str, Callable] = {"zero": zero, "mean": mean, "persistence": persistence, "ridge": ridge, "random_forest": forest, "gradient_boosting": boosting}


def walk_forward_predict(data: DataFrame, models: list[str | tuple[str, Callable]], train: int = 750, test: int = 126, step: int | None = None, expanding: bool = True, embargo: int = 1, features: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Out-of-sample predictions of each model.

    ``data`` comes from :func:`quillmark.functions.features.dataset`. A model is a name of :data:`MODELS` or (name,
    function of train_x, train_y, test_x). All models see the same folds. Symbols too short for a fold give no rows, or
    raise an error if ``strict``.

    Ridge and the baselines by name are computed from sums over pieces of the series, so no row is copied to the folds that
    train on it. Other models are refitted in one task a symbol and fold, on copies of their rows.
    """
    chosen: list[tuple[str, Callable]] = []
    summed: list[str] = []
    for model in models:
        if isinstance(model, str):
            if model not in MODELS:
                raise ValueError(f"unknown model {model!r}; known are {', '.join(MODELS)}")
            if model in BASELINES or model == "ridge":
                summed.append(model)
                continue
            model = (model, MODELS[model])
        chosen.append(model)
    columns = features or FEATURES
    if strict:
        data = data.withColumn("n_pos", F.when(F.col("n_pos") > train + embargo, F.col("n_pos")).otherwise(F.raise_error(F.concat(F.lit("too few rows: "), "symbol")).cast("long")))
    # read for the sums and for the test rows, by each kind of model
    data = written(data.select("symbol", "date", "pos", "n_pos", *dict.fromkeys([*columns, "ret_lag_1"] if "ret_lag_1" in data.columns else columns), TARGET), "dataset")
    folds = {"train": train, "test": test, "step": step, "expanding": expanding, "embargo": embargo}
    parts = []
    if names := [m for m in summed if m in BASELINES]:
        parts.append(_baselines(data, **folds).where(F.col("model").isin(*names)))
    if "ridge" in summed:
        parts.append(ridge_predictions(data, columns, **folds))
    if chosen:
        parts.append(_refitted(data, chosen, columns, folds))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _refitted(data: DataFrame, chosen: list[tuple[str, Callable]], columns: list[str], folds: dict) -> DataFrame:
    rows = assigned(data.select("symbol", "date", "pos", "n_pos", *columns, TARGET), **folds)

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("pos")
        is_test = (pdf["part"] == "test").to_numpy()
        x, y = pdf[columns].to_numpy(float), pdf[TARGET].to_numpy(float)
        out = []
        for name, fit_predict in chosen:
            part = pdf.loc[is_test, ["symbol", "fold", "date"]].copy()
            part["prediction"] = np.asarray(fit_predict(x[~is_test], y[~is_test], x[is_test]), float) if is_test.any() and (~is_test).any() else np.nan
            part["actual"], part["model"] = y[is_test], name
            out.append(part[["symbol", "model", "fold", "date", "prediction", "actual"]])
        return pd.concat(out)

    # training is heavy for few bytes: a fixed number of partitions, so that small ones are not joined
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "symbol", "fold").groupBy("symbol", "fold").applyInPandas(run, RESULT)


def baseline_predictions(data: DataFrame, train: int = 750, test: int = 126, step: int | None = None, expanding: bool = True, embargo: int = 1) -> DataFrame:
    """Zero, mean and persistence forecasts without leaving the JVM: a fold's training mean comes from sums by piece."""
    data = written(data.select("symbol", "date", "pos", "n_pos", "ret_lag_1", TARGET), "dataset")
    return _baselines(data, train, test, step, expanding, embargo)


def _baselines(data: DataFrame, train: int, test: int, step: int | None, expanding: bool, embargo: int) -> DataFrame:
    pieces = data.groupBy("symbol", "n_pos", piece(F.col("pos"), train, test, step).alias("piece")).agg(F.sum(TARGET).alias("s"), F.count("*").alias("n"))
    means = training_sums(pieces, ["s", "n"], ["symbol"], train, test, step, expanding, embargo).select("symbol", "fold", (F.col("s") / F.col("n")).alias("m"))
    rows = tested(data.select("symbol", "date", "pos", "n_pos", "ret_lag_1", TARGET), train, test, step, embargo).join(means, ["symbol", "fold"])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), v.alias("prediction")) for n, v in (("zero", F.lit(0.0)), ("mean", F.col("m")), ("persistence", F.col("ret_lag_1")))]))
    return rows.select("symbol", "fold", "date", F.col(TARGET).alias("actual"), each.alias("x")).select("symbol", "x.model", "fold", "date", "x.prediction", "actual")
