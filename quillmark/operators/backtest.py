"""Positions from forecasts, and what they earn after costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.statistics import strategy_metrics, with_equity

COST_BPS = 10.0


def position(prediction: Column, threshold: float = 0.0, allow_short: bool = True) -> Column:
    """1 above the threshold, -1 below its negative if shorts are allowed, else 0."""
    short = F.when(prediction < -threshold, F.lit(-1.0 if allow_short else 0.0))
    return F.when(prediction > threshold, 1.0).otherwise(F.coalesce(short, F.lit(0.0)))


def simple_returns(log_return: Column) -> Column:
    return F.expm1(log_return)


def backtest(positions: DataFrame, by: list[str], cost_bps: float | str = COST_BPS, initial: float = 0.0) -> DataFrame:
    """Rows (by, date, position, forward_return) with turnover, gross, cost, net_return and equity.

    Entering costs, the last exit does not. ``cost_bps`` is a number or the name of a column.
    """
    w = Window.partitionBy(*by).orderBy("date")
    bps = F.col(cost_bps) if isinstance(cost_bps, str) else F.lit(float(cost_bps))
    moved = positions.withColumn("turnover", F.abs(F.col("position") - F.lag("position", 1, initial).over(w)))
    earned = moved.withColumns({"gross": F.col("position") * F.col("forward_return"), "cost": F.col("turnover") * bps / 10_000})
    return with_equity(earned.withColumn("net_return", F.col("gross") - F.col("cost")), by)


def cost_sweep(positions: DataFrame, by: list[str], costs: list[float]) -> DataFrame:
    """Strategy figures at several costs; each row is read once for each cost of a short list."""
    each = positions.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    keys = [*by, "cost_bps"]
    return strategy_metrics(backtest(each, keys, "cost_bps"), keys)


def model_positions(predictions: DataFrame, threshold: float = 0.0, allow_short: bool = True) -> DataFrame:
    return predictions.select("symbol", "model", "date", position(F.col("prediction"), threshold, allow_short).alias("position"), simple_returns(F.col("actual")).alias("forward_return"))


def with_buy_and_hold(predictions: DataFrame, model: str, threshold: float = 0.0, allow_short: bool = True) -> DataFrame:
    """Positions of all models, and buy-and-hold on the days of ``model``, from one reading of the forecasts."""
    own = F.struct(F.col("model"), position(F.col("prediction"), threshold, allow_short).alias("position"))
    held = F.struct(F.lit("buy_and_hold").alias("model"), F.lit(1.0).alias("position"))
    each = F.inline(F.when(F.col("model") == model, F.array(own, held)).otherwise(F.array(own)))
    return predictions.select("symbol", "date", simple_returns(F.col("actual")).alias("forward_return"), each).select("symbol", "model", "date", "position", "forward_return")


def buy_and_hold(predictions: DataFrame) -> DataFrame:
    """Position 1 on the out-of-sample days of each symbol."""
    days = predictions.groupBy("symbol", "date").agg(F.first("actual").alias("actual"))
    return days.select("symbol", F.lit("buy_and_hold").alias("model"), "date", F.lit(1.0).alias("position"), simple_returns(F.col("actual")).alias("forward_return"))


def summary(metrics: DataFrame) -> DataFrame:
    """One line a strategy."""
    line = F.format_string("return %.1f%%, Sharpe %.2f, drawdown %.1f%%, turnover %.1fx", F.col("total_return") * 100, "sharpe", F.col("max_drawdown") * 100, "annual_turnover")
    return metrics.withColumn("summary", line)
