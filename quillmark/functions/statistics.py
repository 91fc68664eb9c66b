"""Forecast and strategy statistics as grouped aggregates, and corrections for many tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.scans import max_drawdown  # noqa: F401

TRADING_DAYS = 252
ALPHA = 0.05


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution: half plus the density times a series of 120 terms, 0 or 1 beyond ten deviations."""
    start = F.struct(z.alias("t"), z.alias("s"))

    def term(acc, k):
        t = acc["t"] * z * z / (2 * k + 1)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, term, lambda acc: acc["s"])
    inside = 0.5 + series * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(z > 10, 1.0).when(z < -10, 0.0).otherwise(inside)


def binomial_p_value(k: Column, n: Column, p: float = 0.5) -> Column:
    """Chance of ``k`` or more hits in ``n``, by the normal approximation with continuity correction."""
    sd = F.sqrt(n * p * (1 - p))
    z = F.try_divide(k - 0.5 - n * p, sd)
    return F.when(n <= 0, None).when(sd == 0, 1.0).otherwise(1 - normal_cdf(z))


def finite_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    def ok(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return df.where(ok(a) & ok(b))


def average_rank(value: Column, by: list[str]) -> Column:
    """Rank with ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate; 0 where a side does not vary, null for fewer than three rows."""
    r = F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))
    return F.when(F.count("*") >= 3, r)


def spearman(df: DataFrame, by: list[str], a: str = "actual", b: str = "prediction") -> DataFrame:
    """Rank correlation of each group."""
    ranked = finite_pairs(df, a, b).withColumns({"_a": average_rank(F.col(a), by), "_b": average_rank(F.col(b), by)})
    return ranked.groupBy(*by).agg(correlation("_a", "_b").alias("information_coefficient"))


def forecast_metrics(predictions: DataFrame, by: list[str], actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """n, rmse, mae, directional accuracy with its p-value, rank correlation and R2 of each group.

    A prediction of zero hits only a return of zero. Rows without a finite pair are left out.
    """
    ranked = finite_pairs(predictions, actual, prediction).withColumns({"_a": average_rank(F.col(actual), by), "_b": average_rank(F.col(prediction), by), "_e": F.col(actual) - F.col(prediction)})
    hit = (F.signum(actual) == F.signum(prediction)).cast("int")
    found = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.abs("_e")).alias("mae"), F.avg(hit).alias("directional_accuracy"), F.sum(hit).alias("hits"),
        correlation("_a", "_b").alias("information_coefficient"), (1 - F.try_divide(F.sum(F.col("_e") * F.col("_e")), F.var_pop(actual) * F.count("*"))).alias("r2"),
    )
    return found.withColumn("p_value", binomial_p_value(F.col("hits"), F.col("n"))).drop("hits")


def is_significant(p: Column, alpha: float = ALPHA) -> Column:
    return F.coalesce(p < alpha, F.lit(False))


def with_equity(df: DataFrame, by: list[str], order: str = "date", net: str = "net_return") -> DataFrame:
    """``df`` with equity (compounded from 1, a null return counting as 0) and drawdown from the highest equity so far."""
    w = Window.partitionBy(*by).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    grown = df.withColumn("equity", F.product(1 + F.coalesce(net, F.lit(0.0))).over(so_far))
    peak = F.max("equity").over(so_far)
    return grown.withColumn("drawdown", (peak - F.col("equity")) / peak)


def strategy_metrics(returns: DataFrame, by: list[str], order: str = "date", periods: int = TRADING_DAYS) -> DataFrame:
    """Twelve figures of each group from net_return, position and cost by day."""
    w = Window.partitionBy(*by).orderBy(order)
    finite = F.col("net_return").isNotNull() & ~F.isnan("net_return") & (F.abs("net_return") < float("inf"))
    r = F.when(finite, F.col("net_return"))
    moved = returns.withColumn("_moved", F.abs(F.col("position") - F.lag("position", 1, 0.0).over(w))).withColumn("net_return", r)
    # days without a return leave equity unchanged
    curve = with_equity(moved, by, order)
    a = curve.groupBy(*by).agg(
        F.count("net_return").alias("n_days"), F.coalesce(F.max_by("equity", F.when(F.col("net_return").isNotNull(), F.col(order))), F.lit(1.0)).alias("_end"), F.avg("net_return").alias("_mean"), F.stddev_samp("net_return").alias("_sd"),
        F.stddev_samp(F.when(F.col("net_return") < 0, F.col("net_return"))).alias("_down"), F.max(F.when(F.col("net_return").isNotNull(), F.col("drawdown"))).alias("_drawdown"),
        F.avg((F.col("net_return") > 0).cast("int")).alias("_hit"), F.avg(F.abs("position")).alias("_exposure"), F.avg("_moved").alias("_turnover"), F.sum("cost").alias("_costs"),
    )
    year = math.sqrt(periods)
    zero = F.lit(0.0)
    none = F.col("n_days") == 0

    def figure(x: Column) -> Column:
        return F.when(none, zero).otherwise(F.coalesce(x, zero))

    cagr = F.when(F.col("_end") > 0, F.pow("_end", F.try_divide(F.lit(float(periods)), F.col("n_days"))) - 1)
    out = a.withColumn("cagr", F.when(none, zero).otherwise(cagr)).withColumn("max_drawdown", figure(F.col("_drawdown")))
    return out.select(
        *by, "n_days", figure(F.col("_end") - 1).alias("total_return"), "cagr", figure(F.col("_sd") * year).alias("annual_volatility"),
        figure(F.try_divide(F.col("_mean"), F.when(F.col("_sd") > 0, F.col("_sd"))) * year).alias("sharpe"),
        figure(F.try_divide(F.col("_mean"), F.when(F.col("_down") > 0, F.col("_down"))) * year).alias("sortino"),
        "max_drawdown", F.when(F.col("max_drawdown") > 0, F.coalesce(F.col("cagr") / F.col("max_drawdown"), zero)).otherwise(0.0).alias("calmar"),
        figure(F.col("_hit")).alias("hit_rate"), figure(F.col("_exposure")).alias("exposure"), figure(F.col("_turnover") * periods).alias("annual_turnover"), figure(F.col("_costs")).alias("total_costs"),
    )


def _bin(p: Column) -> Column:
    """Bins in the order of p, finer and finer towards zero: 64 for each halving; at most some 70,000 in all."""
    return F.when(p <= 0, -(2**31)).otherwise(F.floor(F.log2(p) * 64)).cast("long")


def corrected(tests: DataFrame, p: str = "p_value", alpha: float = ALPHA, by: list[str] | None = None) -> DataFrame:
    """``tests`` with nominal, bonferroni and fdr flags, one row a test; missing p-values come last and count.

    The step-up procedure rejects the ``k`` smallest, for the largest ``k`` with p(k) <= alpha k / n. Values are counted
    before they are shuffled and ordered bin by bin; the few counts of bins are summed up before, so no task orders a
    whole group's tests. The bound of each group is joined back, that of all tests is one value. The input is read for the
    counts and for the result; write it first where it is dear.
    """
    keys = by or []
    value = F.when(~F.isnan(p), F.col(p))
    # only values up to alpha can be rejected; the others are counted together
    counts = tests.groupBy(*keys, F.when(value <= alpha, value).alias("_p")).agg(F.count("*").alias("_count")).withColumn("_bin", F.coalesce(_bin(F.col("_p")), F.lit(2**31)))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_count").alias("_in"))
    bins = bins.select(*[F.col(c).alias(f"_in_{c}") for c in keys], F.col("_bin").alias("_at"), F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"), F.sum("_in").over(group).alias("_n"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("_before") + F.sum("_count").over(inside)
    same = [F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in keys] + [F.col("_bin") == F.col("_at")]
    met = counts.join(bins, same).withColumn("_k", k)
    most = F.max(F.when(F.col("_p") <= alpha * F.col("_k") / F.col("_n"), F.col("_p")))
    bounds = met.groupBy(*keys).agg(most.alias("_most"), F.max("_n").alias("_n"))
    if by:
        named = bounds.select(*[F.col(c).alias(f"_of_{c}") for c in keys], "_most", "_n")
        rows = tests.join(named, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    else:
        rows = tests.withColumn("_bound", bounds.select(F.struct("_most", "_n")).scalar()).select("*", "_bound.*")
    flags = {"nominal": is_significant(value, alpha), "bonferroni": F.coalesce(value < alpha / F.col("_n"), F.lit(False)), "fdr": F.coalesce(value <= F.col("_most"), F.lit(False))}
    return rows.select(*[F.col(c) for c in tests.columns], *[x.alias(n) for n, x in flags.items()])


def scan_summary(scan: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Distribution of a scan's rows: accuracies, significant counts, and the spread chance alone would give."""
    flagged = corrected(scan, alpha=alpha)

    def count(flag: str) -> Column:
        return F.sum(F.col(flag).cast("long")).alias(f"n_{flag}")

    return flagged.agg(
        F.count("*").alias("n_symbols"), F.avg("directional_accuracy").alias("mean_accuracy"), F.median("directional_accuracy").alias("median_accuracy"), F.stddev_pop("directional_accuracy").alias("sd_accuracy"),
        F.min("directional_accuracy").alias("min_accuracy"), F.max("directional_accuracy").alias("max_accuracy"), F.sqrt(0.25 / F.median("n_test_days")).alias("chance_sd"), (F.count("*") * alpha).alias("n_expected"),
        count("nominal"), count("bonferroni"), count("fdr"), F.avg("excess_sharpe").alias("mean_excess_sharpe"), F.sum((F.col("excess_sharpe") > 0).cast("long")).alias("n_beating"), F.median("annual_turnover").alias("median_turnover"), F.median("n_test_days").alias("median_days"),
    )


def top_by_p(scan: DataFrame, k: int = 10) -> DataFrame:
    return scan.orderBy(F.col("p_value").asc_nulls_last(), "symbol").limit(k)
