"""Whole evaluations: one plan over all symbols, and texts of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.features import dataset
from quillmark.functions.statistics import ALPHA, corrected, forecast_metrics, scan_summary, strategy_metrics
from quillmark.operators.backtest import COST_BPS, backtest, with_buy_and_hold
from quillmark.operators.forecast import BASELINES, walk_forward_predict
from quillmark.scratch import written
from quillmark.sources.bars import symbols

KEYS = ["symbol", "model"]


def compare_models(bars: DataFrame, models: list[str], **folds) -> DataFrame:
    """Forecast figures of several models on the same folds."""
    return forecast_metrics(walk_forward_predict(dataset(bars), models, **folds), KEYS)


def fold_metrics(predictions: DataFrame) -> DataFrame:
    return forecast_metrics(predictions, [*KEYS, "fold"])


def strategies(bars: DataFrame, models: list[str], cost_bps: float = COST_BPS, threshold: float = 0.0, allow_short: bool = True, **folds) -> tuple[DataFrame, DataFrame]:
    """Forecast figures and strategy figures of each symbol; baselines are scored but not traded.

    Strategies and buy-and-hold are compared on the same out-of-sample days. The benchmark's Sharpe ratio stands beside
    each strategy's.
    """
    predictions = written(walk_forward_predict(dataset(bars), models, **folds), "predictions")  # each model is trained once
    first = models[0] if isinstance(models[0], str) else models[0][0]
    traded = with_buy_and_hold(predictions, first, threshold, allow_short).where(~F.col("model").isin(*BASELINES))
    figures = strategy_metrics(backtest(traded, KEYS, cost_bps), KEYS)
    benchmark = F.max(F.when(F.col("model") == "buy_and_hold", F.col("sharpe"))).over(Window.partitionBy("symbol"))
    figures = figures.withColumn("benchmark_sharpe", benchmark).withColumn("excess_sharpe", F.col("sharpe") - F.col("benchmark_sharpe")).withColumn("beats_benchmark", (F.col("model") != "buy_and_hold") & (F.col("excess_sharpe") > 0))
    return forecast_metrics(predictions, KEYS), figures


def scan(bars: DataFrame, model: str = "ridge", train: int = 500, test: int = 126, min_test_days: int = 250, cost_bps: float = COST_BPS, threshold: float = 0.0, allow_short: bool = True, first_symbols: int | None = None, **folds) -> DataFrame:
    """One row a symbol with enough out-of-sample days: accuracy, p-value, and how the strategy and its benchmark fared.

    ``first_symbols`` scans only so many symbols, the first by name.
    """
    if first_symbols:
        bars = bars.join(symbols(bars, first_symbols), "symbol", "left_semi")
    predictions = written(walk_forward_predict(dataset(bars), [model], train=train, test=test, **folds), "predictions")
    scored = forecast_metrics(predictions, ["symbol"]).where(F.col("n") >= min_test_days)
    both = with_buy_and_hold(predictions, model, threshold, allow_short)
    figures = strategy_metrics(backtest(both, KEYS, cost_bps), KEYS)
    held = F.col("model") == "buy_and_hold"

    def one(name: str, of: Column, alias: str) -> Column:
        return F.max(F.when(of, F.col(name))).alias(alias)

    sides = figures.groupBy("symbol").agg(one("sharpe", ~held, "strategy_sharpe"), one("total_return", ~held, "strategy_return"), one("annual_turnover", ~held, "annual_turnover"), one("sharpe", held, "benchmark_sharpe"), one("total_return", held, "benchmark_return"))
    rows = scored.select("symbol", F.col("n").alias("n_test_days"), "directional_accuracy", "p_value", "information_coefficient").join(sides, "symbol")
    return rows.withColumn("excess_sharpe", F.col("strategy_sharpe") - F.col("benchmark_sharpe"))


def scan_failures(bars: DataFrame, found: DataFrame, requested: DataFrame | None = None, min_test_days: int = 250) -> DataFrame:
    """Symbols without a row in a scan, and why (at most 120 characters)."""
    wanted = (requested if requested is not None else bars).select("symbol").distinct()
    known = bars.groupBy("symbol").agg(F.count("*").alias("n_bars"))
    missing = wanted.join(found.select("symbol"), "symbol", "left_anti").join(known, "symbol", "left")
    why = F.when(F.col("n_bars").isNull(), "no bars").otherwise(F.concat(F.lit(f"fewer than {min_test_days} test days from "), F.col("n_bars").cast("string"), F.lit(" bars")))
    return missing.select("symbol", F.substring(why, 1, 120).alias("reason"))


def significant_forecasts(metrics: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Forecasts better than chance, baselines aside."""
    return metrics.where(~F.col("model").isin(*BASELINES) & (F.col("p_value") < alpha))


def scan_json(found: DataFrame, failures: DataFrame | None = None, alpha: float = ALPHA) -> DataFrame:
    """The scan as JSON lines: a ``summary`` line, a ``result`` line a symbol with its flags, a ``failure`` line each."""

    def line(kind: str, table: DataFrame) -> DataFrame:
        return table.select(F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit(kind).alias("kind"), *table.columns), {"ignoreNullFields": "false"}).alias("value"))

    parts = line("summary", scan_summary(found, alpha)).union(line("result", corrected(found, alpha=alpha)))
    return parts if failures is None else parts.union(line("failure", failures))


def evaluation_json(metrics: DataFrame, figures: DataFrame) -> DataFrame:
    """An evaluation as JSON, one line a symbol: forecasts and strategies by name, those that beat the benchmark, and
    forecasts better than chance."""

    def named(table: DataFrame, name: str) -> DataFrame:
        body = F.struct(*[c for c in table.columns if c not in KEYS])
        return table.groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("model"), body.alias("figures"))))).alias(name))

    better = figures.where("beats_benchmark").groupBy("symbol").agg(F.array_sort(F.collect_list("model")).alias("beats_benchmark"))
    sure = significant_forecasts(metrics).groupBy("symbol").agg(F.array_sort(F.collect_list("model")).alias("significant_forecasts"))
    whole = named(metrics, "forecasts").join(named(figures, "strategies"), "symbol", "full").join(better, "symbol", "left").join(sure, "symbol", "left")
    none = F.array().cast("array<string>")
    body = F.struct("symbol", "forecasts", "strategies", *[F.coalesce(c, none).alias(c) for c in ("beats_benchmark", "significant_forecasts")])
    return whole.select("symbol", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def scan_text(found: DataFrame, k: int = 10) -> str:
    """Summary of a scan for a reader; only its few totals and ``k`` rows come to the driver."""
    s = scan_summary(found).first()
    lines = [
        f"{s.n_symbols} symbols, {s.median_days or 0:.0f} out-of-sample days",
        f"accuracy: mean {s.mean_accuracy or 0:.4f}, median {s.median_accuracy or 0:.4f}, sd {s.sd_accuracy or 0:.4f} (chance {s.chance_sd or 0:.4f})",
        f"significant: {s.n_nominal} nominal ({s.n_expected:.1f} expected by chance), {s.n_fdr} after false-discovery control, {s.n_bonferroni} after Bonferroni",
        f"beat buy and hold on Sharpe: {s.n_beating} of {s.n_symbols}, mean excess {s.mean_excess_sharpe or 0:.3f}, median turnover {s.median_turnover or 0:.0f}x",
    ]
    for row in corrected(found).orderBy(F.col("p_value").asc_nulls_last(), "symbol").limit(k).collect():
        lines.append(f"  {row.symbol}: {row.directional_accuracy:.3f}, p = {row.p_value:.4f}{' *' if row.fdr else ''}")
    lines.append("verdict: an edge survives correction" if s.n_fdr else "verdict: nothing survives correction for many tests")
    return "\n".join(lines)


def evaluation_text(metrics: DataFrame, figures: DataFrame, is_synthetic: bool) -> str:
    """Summary of one symbol's evaluation; a few rows come to the driver."""
    lines = ["SYNTHETIC DATA: these results say nothing about a market"] if is_synthetic else []
    for m in metrics.orderBy("symbol", "model").limit(200).collect():
        lines.append(f"{m.symbol} {m.model}: accuracy {m.directional_accuracy:.3f} (p = {m.p_value:.3f}), IC {m.information_coefficient:.3f}, RMSE {m.rmse:.5f}")
    t = figures.agg(F.count("*").alias("n"), F.count_if("beats_benchmark").alias("better")).first()
    if (more := metrics.count() - 200) > 0:
        lines.append(f"({more} more forecasts)")
    for f in figures.orderBy(F.desc("sharpe")).limit(200).collect():
        lines.append(f"{f.symbol} {f.model}: return {f.total_return:.1%}, Sharpe {f.sharpe:.2f}, drawdown {f.max_drawdown:.1%}, turnover {f.annual_turnover:.1f}x")
    if t.n > 200:
        lines.append(f"({t.n - 200} more strategies)")
    n = significant_forecasts(metrics).count()
    lines.append(f"verdict: {n} forecasts better than chance, {t.better} strategies beat buy and hold after costs")
    return "\n".join(lines)


def self_test(spark, n_days: int = 1600, seed: int = 101) -> DataFrame:
    """Two controls: signal 0 must not be found significant, signal 0.8 must. signal, p_value, passed."""
    from quillmark.sources.bars import control_series

    bars = control_series(spark, [(f"S{s}", n_days, seed, s) for s in (0.0, 0.8)])
    found = forecast_metrics(walk_forward_predict(dataset(bars), ["ridge"], train=500), KEYS)
    edge = F.col("symbol") == "S0.8"
    return found.select(F.when(edge, 0.8).otherwise(0.0).alias("signal"), "p_value", F.when(edge, F.col("p_value") < ALPHA).otherwise(F.col("p_value") >= ALPHA).alias("passed"))
