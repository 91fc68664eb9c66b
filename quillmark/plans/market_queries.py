"""Queries about bars derived from ``lineitem``: features, forecasts, backtests, scans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.features import FEATURES, TARGET, dataset, features, lookahead_leaks
from quillmark.functions.statistics import corrected, forecast_metrics, max_drawdown, scan_summary, spearman, strategy_metrics
from quillmark.operators.backtest import backtest, cost_sweep, model_positions, with_buy_and_hold
from quillmark.operators.folds import fold_bounds
from quillmark.operators.forecast import baseline_predictions, walk_forward_predict
from quillmark.operators.gram import digitized, feature_correlations, gram_pieces, quantile_edges, top_features
from quillmark.operators.ranks import medians, spearman_large
from quillmark.plans.evaluation import fold_metrics, scan, strategies
from quillmark.scratch import written
from quillmark.session import table
from quillmark.sources.bars import bars_from_trades, finalize, slice_dates, summary, symbols

TRAIN, TEST = 500, 126
KEYS = ["symbol", "model"]


#: Trades of a task where there are many series.
TASK_ROWS = 250_000


def bars(spark: SparkSession, sf_dir: str, symbol: str = "l_returnflag", parts: int | None = None) -> DataFrame:
    """Daily bars by return flag (or another column): price is the extended price a piece."""
    trades = table(spark, sf_dir, "lineitem").withColumn("_symbol", F.col(symbol).cast("string"))
    return bars_from_trades(trades, "_symbol", "l_shipdate", F.col("l_extendedprice") / F.col("l_quantity"), "l_quantity", ["l_orderkey", "l_linenumber"], parts)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def bars_daily(spark, sf_dir):
    return _rounded(bars(spark, sf_dir).drop("source", "is_synthetic"), 9)


def bars_finalize(spark, sf_dir):
    """Orders as raw bars by priority: several a day, some without a usable price; the last usable one of a day stays."""
    o = table(spark, sf_dir, "orders")
    close = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 11 == 0, "-5").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    raw = o.select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), close.alias("close"), F.col("o_orderkey").alias("_pos"))
    found = slice_dates(finalize(raw, "orders"), dt.date(1996, 1, 1), dt.date(1999, 12, 31))
    return _rounded(found.select("symbol", "date", "open", "close", "adj_close", "volume", "source", "is_synthetic"))


def bars_summary(spark, sf_dir):
    return _rounded(summary(bars(spark, sf_dir)), 5)


def bar_symbols(spark, sf_dir):
    return symbols(bars(spark, sf_dir))


def _features(*names: str, places: int = 6):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(features(bars(spark, sf_dir), columns=list(names)).select("symbol", "date", *names), places)

    return query


def supplier_features(spark, sf_dir):
    """Features of one series a supplier: as many groups as there are suppliers.

    The number of tasks grows with the table (its footers tell its rows), so that a task's memory does not.
    """
    parts = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS))
    names = ["ret_lag_1", "momentum_5", "vol_5", "ma_gap_10", "rsi_14", TARGET]
    return _rounded(features(bars(spark, sf_dir, "l_suppkey", parts), columns=names, parts=parts).select("symbol", "date", *names))


def complete_dataset(spark, sf_dir):
    return _rounded(dataset(bars(spark, sf_dir)).select("symbol", "date", "pos", "ret_lag_1", "rsi_14", "range_position_252", TARGET))


def no_lookahead(spark, sf_dir):
    """Leaks of the features (none) and of a planted one, the target five days ahead, which differs on five days a symbol."""
    made = lookahead_leaks(bars(spark, sf_dir), lambda b: features(b, horizon=5), columns=[*FEATURES, TARGET])
    return made.select("symbol", "feature", "n_rows")


def walk_forward_folds(spark, sf_dir):
    sizes = dataset(bars(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("n"))
    return fold_bounds(sizes, TRAIN, TEST)


def rolling_folds(spark, sf_dir):
    sizes = dataset(bars(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("n"))
    return fold_bounds(sizes, TRAIN, TEST, expanding=False)


def rolling_mean(spark, sf_dir):
    found = baseline_predictions(dataset(bars(spark, sf_dir)), TRAIN, TEST, expanding=False).where("model = 'mean'")
    return _rounded(found.select("symbol", "fold", "date", "prediction", "actual"))


def gram_sums(spark, sf_dir):
    """Sums of products of (1, features, target) by series and piece, which all ridge regressions are made of."""
    return _rounded(gram_pieces(dataset(bars(spark, sf_dir)), train=TRAIN, test=TEST).withColumn("total", F.round("total", 5)), 5)


def _baselines(spark, sf_dir):
    return baseline_predictions(dataset(bars(spark, sf_dir)), TRAIN, TEST)


def _baseline(model: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(_baselines(spark, sf_dir).where(F.col("model") == model).select("symbol", "fold", "date", "prediction", "actual"))

    return query


def forecast_figures(spark, sf_dir):
    found = forecast_metrics(_baselines(spark, sf_dir), KEYS)
    return _rounded(found.select("symbol", "model", "n", "rmse", "mae", "directional_accuracy"), 6)


def directional_p_value(spark, sf_dir):
    return _rounded(forecast_metrics(_baselines(spark, sf_dir), KEYS).select("symbol", "model", "p_value"), 6)


def spearman_ic(spark, sf_dir):
    return _rounded(spearman(_baselines(spark, sf_dir).where("model = 'persistence'"), ["symbol"]), 6)


def metrics_by_fold(spark, sf_dir):
    return _rounded(fold_metrics(_baselines(spark, sf_dir).where("model = 'persistence'")).select("symbol", "fold", "n", "rmse", "directional_accuracy", "r2"), 6)


def _persistence(spark, sf_dir, threshold: float = 0.01):
    return model_positions(_baselines(spark, sf_dir).where("model = 'persistence'"), threshold)


def positions_threshold(spark, sf_dir):
    found = _persistence(spark, sf_dir).groupBy("symbol", "position").agg(F.count("*").alias("days"))
    return found


def backtest_equity(spark, sf_dir):
    found = backtest(_persistence(spark, sf_dir), KEYS)
    return _rounded(found.select("symbol", "date", "position", "turnover", "gross", "cost", "net_return", F.ln("equity").alias("log_equity")), 5)


def drawdowns(spark, sf_dir):
    return _rounded(max_drawdown(backtest(_persistence(spark, sf_dir), KEYS), KEYS).drop("model"))


def strategy_figures(spark, sf_dir):
    return _rounded(strategy_metrics(backtest(_persistence(spark, sf_dir), KEYS), KEYS).drop("model"), 5)


def cost_sweeps(spark, sf_dir):
    found = cost_sweep(_persistence(spark, sf_dir), KEYS, [0, 1, 5, 10, 20])
    return _rounded(found.select("symbol", "cost_bps", "total_return", "sharpe", "annual_turnover"), 5)


def benchmark_compare(spark, sf_dir):
    both = with_buy_and_hold(_baselines(spark, sf_dir).where("model = 'persistence'"), "persistence", 0.01)
    figures = strategy_metrics(backtest(both, KEYS), KEYS)
    own, held = figures.where("model = 'persistence'"), figures.where("model = 'buy_and_hold'").select("symbol", F.col("sharpe").alias("benchmark_sharpe"))
    return _rounded(own.join(held, "symbol").select("symbol", "sharpe", "benchmark_sharpe", (F.col("sharpe") - F.col("benchmark_sharpe")).alias("excess_sharpe"), (F.col("sharpe") > F.col("benchmark_sharpe")).alias("beats_benchmark")), 5)


def chosen_features(spark, sf_dir):
    """The four features of each series and fold that go most with the target."""
    found = top_features(feature_correlations(dataset(bars(spark, sf_dir)), train=TRAIN, test=TEST))
    return _rounded(found.select("symbol", "fold", F.col("rank").cast("long").alias("rank"), "feature", "correlation"), 6)


BINNED = ["ret_lag_1", "vol_21", "rsi_14", "volume_trend"]


def feature_bins(spark, sf_dir):
    """Days by bin of some features; borders are fifths of the first 500 rows of each series."""
    data = dataset(bars(spark, sf_dir))
    edges = quantile_edges(data.where(F.col("pos") < TRAIN), BINNED)
    return digitized(data, edges, BINNED).groupBy("symbol", "feature", F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("days"))


def spearman_lineitem(spark, sf_dir):
    """Rank correlations over all rows of ``lineitem``, in one group and by return flag."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit("all").alias("part"), F.col("l_returnflag").alias("flag"), "l_quantity", "l_extendedprice", "l_discount")
    whole = spearman_large(rows, ["part"], "l_quantity", "l_extendedprice").select("part", F.lit("price").alias("beside"), "information_coefficient")
    flags = spearman_large(rows, ["flag"], "l_quantity", "l_discount").select(F.col("flag").alias("part"), F.lit("discount").alias("beside"), "information_coefficient")
    return _rounded(whole.unionByName(flags), 6)


def lineitem_medians(spark, sf_dir):
    """Medians over all rows of ``lineitem``, in one group and by ship mode, from histograms of at most 64 bins."""
    rows = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.lit("all"), F.col("l_returnflag"))).alias("part"), "l_extendedprice")
    return _rounded(medians(rows, ["part"], "l_extendedprice", most=1000, bins=64), 6)


def _tests(spark, sf_dir):
    """One test a part: p-values from part numbers, some of them tiny."""
    p = F.when(F.col("p_partkey") % 50 == 0, (F.col("p_partkey") % 97) * 1e-7).otherwise(((F.col("p_partkey") * 7919) % 10007) / 10007.0)
    return table(spark, sf_dir, "part").select("p_partkey", p.alias("p_value"))


def corrections(spark, sf_dir):
    return corrected(_tests(spark, sf_dir)).select("p_partkey", "nominal", "bonferroni", "fdr")


def scan_summaries(spark, sf_dir):
    rows = table(spark, sf_dir, "part").join(_tests(spark, sf_dir), "p_partkey").select(
        F.col("p_partkey").cast("string").alias("symbol"), (F.col("p_size") + 250).cast("long").alias("n_test_days"), (0.4 + (F.col("p_partkey") % 200) / 1000.0).alias("directional_accuracy"), "p_value",
        ((F.col("p_partkey") % 31 - 20) / 10.0).alias("excess_sharpe"), (F.col("p_partkey") % 300).cast("double").alias("annual_turnover"),
    )
    return _rounded(scan_summary(rows), 6)


def _walk(models: list[str], **folds):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = dataset(bars(spark, sf_dir))
        return _rounded(forecast_metrics(walk_forward_predict(data, models, train=TRAIN, test=TEST, **folds), KEYS), 6)

    return query


def ridge_scan(spark, sf_dir):
    return _rounded(corrected(written(scan(bars(spark, sf_dir)), "scan")), 5)


def evaluation(spark, sf_dir):
    return _rounded(strategies(bars(spark, sf_dir), ["zero", "ridge"], train=TRAIN, test=TEST)[1], 5)


QUERIES = {
    "bars_daily": bars_daily,
    "bars_finalize": bars_finalize,
    "bars_summary": bars_summary,
    "bars_symbols": bar_symbols,
    "log_returns": _features("ret_lag_1", "ret_lag_2", "ret_lag_3", "ret_lag_5", "ret_lag_10", places=9),
    "momentum": _features("momentum_5", "momentum_10", "momentum_21", "momentum_63"),
    "volatility": _features("vol_5", "vol_21", "vol_ratio"),
    "ma_gap": _features("ma_gap_10", "ma_gap_21", "ma_gap_63"),
    "rsi": _features("rsi_14"),
    "macd": _features("macd", "macd_hist", places=9),
    "atr": _features("atr_14", "intraday_range", "close_location"),
    "range_position": _features("range_position_252"),
    "volume_features": _features("volume_z_21", "volume_trend"),
    "calendar_features": _features("dow_sin", "dow_cos", places=9),
    "target_returns": _features(TARGET, places=9),
    "supplier_features": supplier_features,
    "complete_dataset": complete_dataset,
    "no_lookahead": no_lookahead,
    "walk_forward_folds": walk_forward_folds,
    "rolling_folds": rolling_folds,
    "gram_sums": gram_sums,
    "zero_forecast": _baseline("zero"),
    "mean_forecast": _baseline("mean"),
    "rolling_mean_forecast": rolling_mean,
    "persistence_forecast": _baseline("persistence"),
    "forecast_metrics": forecast_figures,
    "fold_metrics": metrics_by_fold,
    "directional_p_value": directional_p_value,
    "spearman_ic": spearman_ic,
    "spearman_lineitem": spearman_lineitem,
    "lineitem_medians": lineitem_medians,
    "chosen_features": chosen_features,
    "feature_bins": feature_bins,
    "positions_threshold": positions_threshold,
    "backtest_equity": backtest_equity,
    "max_drawdown": drawdowns,
    "strategy_metrics": strategy_figures,
    "cost_sweep": cost_sweeps,
    "benchmark_compare": benchmark_compare,
    "multiple_tests": corrections,
    "scan_summary": scan_summaries,
    "ridge_walk_forward": _walk(["ridge"]),
    "ridge_rolling": _walk(["ridge"], expanding=False),
    "tree_walk_forward": _walk(["random_forest", "gradient_boosting"]),
    "ridge_scan": ridge_scan,
    "strategy_evaluation": evaluation,
}

BARS_SQL = """
WITH trades AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS q, (l_orderkey, l_linenumber, l_extendedprice / l_quantity) AS at_key FROM lineitem WHERE l_extendedprice / l_quantity > 0),
bars AS (
  SELECT symbol, date, arg_min(price, at_key) AS open, max(price) AS high, min(price) AS low, arg_max(price, at_key) AS close, arg_max(price, at_key) AS adj_close, sum(q) AS volume
  FROM trades GROUP BY symbol, date)"""


def _roll(x: str, k: int, f: str) -> str:
    frame = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {k} THEN {f}({x}) OVER {frame} END"


def _fold(x: str, alpha: str, least: int = 0) -> str:
    """Exponentially weighted mean as a fold over all values so far."""
    w = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} >= greatest({least}, 1) THEN list_reduce(list({x}) FILTER ({x} IS NOT NULL) OVER {w}, lambda s, v: s * (1 - {alpha}) + v * {alpha}) END"


_MOMENTUM = ", ".join(f"ln(c / lag(c, {k}) OVER w) / nullif(({_roll('r', k, 'stddev_samp')}) * sqrt({k}), 0) AS momentum_{k}" for k in (5, 10, 21, 63))
_LAGS = ", ".join(f"lag(r, {k - 1}) OVER w AS ret_lag_{k}" for k in (1, 2, 3, 5, 10))
_GAPS = ", ".join(f"(c - ({_roll('c', k, 'avg')})) / nullif({_roll('c', k, 'stddev_samp')}, 0) AS ma_gap_{k}" for k in (10, 21, 63))
FEATURES_SQL = f"""{BARS_SQL},
b1 AS (SELECT *, adj_close AS c, ln(adj_close) - ln(lag(adj_close) OVER w) AS r, adj_close - lag(adj_close) OVER w AS change, lag(close) OVER w AS before, nullif(volume, 0) AS v FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
b2 AS (
  SELECT *, CASE WHEN change IS NOT NULL THEN greatest(change, 0) END AS gain, CASE WHEN change IS NOT NULL THEN greatest(-change, 0) END AS loss,
    greatest(high - low, coalesce(abs(high - before), high - low), coalesce(abs(low - before), high - low)) AS tr, ln(v) AS lv FROM b1),
b3 AS (
  SELECT *, {_fold('gain', '(1.0::DOUBLE / 14)', 14)} AS ag, {_fold('loss', '(1.0::DOUBLE / 14)', 14)} AS al, {_fold('tr', '(1.0::DOUBLE / 14)', 14)} AS atr,
    ({_fold('c', '(2.0::DOUBLE / 13)')} - {_fold('c', '(2.0::DOUBLE / 27)')}) / c AS macd FROM b2),
f AS (
  SELECT symbol, date, {_LAGS}, {_MOMENTUM}, {_roll('r', 5, 'stddev_samp')} AS vol_5, {_roll('r', 21, 'stddev_samp')} AS vol_21,
    ({_roll('r', 5, 'stddev_samp')}) / nullif({_roll('r', 21, 'stddev_samp')}, 0) AS vol_ratio, {_GAPS},
    coalesce(100 - 100 / (1 + ag / nullif(al, 0)), 50) / 100 AS rsi_14, macd, macd - {_fold('macd', '0.2::DOUBLE')} AS macd_hist,
    (c - ({_roll('low', 252, 'min')})) / nullif(({_roll('high', 252, 'max')}) - ({_roll('low', 252, 'min')}), 0) AS range_position_252,
    atr / c AS atr_14, (high - low) / c AS intraday_range, coalesce((close - low) / nullif(high - low, 0), 0.5) AS close_location,
    (lv - ({_roll('lv', 21, 'avg')})) / nullif({_roll('lv', 21, 'stddev_samp')}, 0) AS volume_z_21, ln(({_roll('v', 5, 'avg')}) / nullif({_roll('v', 21, 'avg')}, 0)) AS volume_trend,
    sin(2 * pi() * (isodow(date) - 1) / 5.0::DOUBLE) AS dow_sin, cos(2 * pi() * (isodow(date) - 1) / 5.0::DOUBLE) AS dow_cos,
    ln(lead(c) OVER w / c) AS {TARGET}
  FROM b3 WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def _feature_sql(*names: str, places: int = 6) -> str:
    return f"{FEATURES_SQL}\nSELECT symbol, CAST(date AS VARCHAR) AS date, {', '.join(f'round({n}, {places}) AS {n}' for n in names)} FROM f"


_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, TARGET])
DATA_SQL = f"""{FEATURES_SQL},
data AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos FROM f WHERE {_WHOLE})"""
FOLDS_SQL = f"""{DATA_SQL},
sizes AS (SELECT symbol, count(*) AS n FROM data GROUP BY symbol),
folds AS (
  SELECT symbol, n, unnest(range(0, (n - 1 - {TRAIN} - 1) // {TEST} + 1)) AS fold FROM sizes WHERE n > {TRAIN} + 1),
bounds AS (
  SELECT symbol, fold::INT AS fold, 0::BIGINT AS train_start, fold * {TEST} + {TRAIN} AS train_end, fold * {TEST} + {TRAIN} + 1 AS test_start,
    least(fold * {TEST} + {TRAIN} + 1 + {TEST}, n) AS test_end FROM folds)"""
BASE_SQL = f"""{FOLDS_SQL},
means AS (SELECT symbol, fold, avg({TARGET}) AS m FROM data JOIN bounds USING (symbol) WHERE pos >= train_start AND pos < train_end GROUP BY symbol, fold),
tested AS (SELECT symbol, fold, date, ret_lag_1, {TARGET} AS actual, m FROM data JOIN bounds USING (symbol) JOIN means USING (symbol, fold) WHERE pos >= test_start AND pos < test_end),
preds AS (
  SELECT symbol, 'zero' AS model, fold, date, 0.0::DOUBLE AS prediction, actual FROM tested
  UNION ALL SELECT symbol, 'mean', fold, date, m, actual FROM tested
  UNION ALL SELECT symbol, 'persistence', fold, date, ret_lag_1, actual FROM tested)"""

#: The same with training sets that roll.
ROLLING = ("0::BIGINT AS train_start", f"fold * {TEST} AS train_start")

#: Ridge on standardised features: sums of products by fold, solved by elimination, one column after the other.
RIDGE_SQL = f"""{BASE_SQL.replace("WITH trades", "WITH RECURSIVE trades", 1)},
xs AS MATERIALIZED (SELECT symbol, date, pos, [{", ".join(FEATURES)}]::DOUBLE[] AS x, {TARGET} AS y FROM data),
tr AS (SELECT symbol, fold, x, y FROM xs JOIN bounds USING (symbol) WHERE pos >= train_start AND pos < train_end),
ms AS (
  SELECT symbol, fold, list(m ORDER BY i) AS ms, list(CASE WHEN sd > 0 THEN sd ELSE 1 END ORDER BY i) AS ss, any_value(my) AS my
  FROM (SELECT symbol, fold, i, avg(x[i]) AS m, stddev_pop(x[i]) AS sd, avg(y) AS my FROM tr CROSS JOIN range(1, {len(FEATURES) + 1}) r(i) GROUP BY symbol, fold, i)
  GROUP BY symbol, fold),
zs AS (SELECT symbol, fold, list_transform(range(1, {len(FEATURES) + 1}), lambda i: (x[i] - ms[i]) / ss[i]) AS z, y - my AS y FROM tr JOIN ms USING (symbol, fold)),
half AS MATERIALIZED (SELECT symbol, fold, i, j, sum(z[i] * z[j]) AS v FROM zs CROSS JOIN range(1, {len(FEATURES) + 1}) a(i) CROSS JOIN range(1, {len(FEATURES) + 1}) b(j) WHERE i <= j GROUP BY ALL),
ab AS (
  SELECT symbol, fold, i, j, v + CASE WHEN i = j THEN 50 ELSE 0 END AS v FROM half
  UNION ALL SELECT symbol, fold, j, i, v FROM half WHERE i < j
  UNION ALL SELECT symbol, fold, i, {len(FEATURES) + 1}, sum(z[i] * y) FROM zs CROSS JOIN range(1, {len(FEATURES) + 1}) a(i) GROUP BY ALL),
sys AS (SELECT symbol, fold, list(r ORDER BY i) AS m FROM (SELECT symbol, fold, i, list(v ORDER BY j) AS r FROM ab GROUP BY symbol, fold, i) GROUP BY symbol, fold),
solved AS (
  SELECT symbol, fold, 1 AS k, m FROM sys
  UNION ALL
  SELECT symbol, fold, k + 1, list_transform(range(1, {len(FEATURES) + 1}), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
    ELSE list_transform(range(1, {len(FEATURES) + 2}), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END)
  FROM solved WHERE k <= {len(FEATURES)}),
ws AS (SELECT symbol, fold, list_transform(m, lambda r: r[{len(FEATURES) + 1}]) AS w FROM solved WHERE k = {len(FEATURES) + 1}),
ridge AS MATERIALIZED (
  SELECT symbol, 'ridge' AS model, fold, date, my + list_sum(list_transform(range(1, {len(FEATURES) + 1}), lambda i: (x[i] - ms[i]) / ss[i] * w[i])) AS prediction, y AS actual
  FROM xs JOIN bounds USING (symbol) JOIN ms USING (symbol, fold) JOIN ws USING (symbol, fold) WHERE pos >= test_start AND pos < test_end)"""


def _figures_sql(source: str) -> str:
    """Every forecast figure of each symbol and model of a table of predictions."""
    return f"""
rk AS (
  SELECT *, rank() OVER (PARTITION BY symbol, model ORDER BY actual) + (count(*) OVER (PARTITION BY symbol, model, actual) - 1) / 2 AS ra,
    rank() OVER (PARTITION BY symbol, model ORDER BY prediction) + (count(*) OVER (PARTITION BY symbol, model, prediction) - 1) / 2 AS rp FROM {source}),
fc AS (
  SELECT symbol, model, count(*) AS n, sqrt(avg((actual - prediction) ** 2)) AS rmse, avg(abs(actual - prediction)) AS mae, avg((sign(actual) = sign(prediction))::INT) AS directional_accuracy,
    coalesce(covar_pop(ra, rp) / nullif(stddev_pop(ra) * stddev_pop(rp), 0), 0) AS information_coefficient, 1 - sum((actual - prediction) ** 2) / nullif(var_pop(actual) * count(*), 0) AS r2,
    (sum((sign(actual) = sign(prediction))::INT) - 0.5 - count(*) * 0.5) / sqrt(count(*) * 0.25) AS z
  FROM rk GROUP BY symbol, model),
pt AS (SELECT symbol, model, i, product(CASE WHEN i = 0 THEN z ELSE z * z / (2 * i + 1) END) OVER (PARTITION BY symbol, model ORDER BY i) AS t FROM fc CROSS JOIN range(0, 121) r(i)),
ps AS (SELECT symbol, model, sum(t) AS t FROM pt GROUP BY symbol, model),
figs AS (
  SELECT fc.*, 1 - CASE WHEN z > 10 THEN 1.0 WHEN z < -10 THEN 0.0 ELSE 0.5 + t * exp(-z * z / 2) / sqrt(2 * pi()) END AS p_value FROM fc JOIN ps USING (symbol, model))"""


_WALKED = "SELECT symbol, model, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(directional_accuracy, 6) AS directional_accuracy, round(information_coefficient, 6) AS information_coefficient, round(r2, 6) AS r2, round(p_value, 6) AS p_value FROM figs"
#: Ridge and buy-and-hold traded at ten basis points on the same days.
TRADED_SQL = f"""{RIDGE_SQL},
pos AS (
  SELECT symbol, model, date, CASE WHEN prediction > 0 THEN 1.0 WHEN prediction < 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS position, exp(actual) - 1 AS fwd FROM ridge
  UNION ALL SELECT symbol, 'buy_and_hold', date, 1.0::DOUBLE, exp(actual) - 1 FROM ridge),
net AS (SELECT *, abs(position - lag(position, 1, 0.0::DOUBLE) OVER (PARTITION BY symbol, model ORDER BY date)) AS turnover, position * fwd - turnover * 10 / 10000 AS net, turnover * 10 / 10000 AS cost FROM pos),
eq AS (SELECT *, product(1 + net) OVER (PARTITION BY symbol, model ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM net),
dd AS (SELECT *, 1 - equity / max(equity) OVER (PARTITION BY symbol, model ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS drawdown FROM eq),
tf AS (
  SELECT symbol, model, count(*) AS n_days, arg_max(equity, date) - 1 AS total_return, CASE WHEN arg_max(equity, date) > 0 THEN arg_max(equity, date) ** (252.0::DOUBLE / count(*)) - 1 END AS cagr, stddev_samp(net) * sqrt(252) AS annual_volatility, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe,
    coalesce(avg(net) / nullif(stddev_samp(net) FILTER (net < 0), 0) * sqrt(252), 0) AS sortino, max(drawdown) AS max_drawdown, avg((net > 0)::INT) AS hit_rate, avg(abs(position)) AS exposure,
    avg(turnover) * 252 AS annual_turnover, sum(cost) AS total_costs FROM dd GROUP BY symbol, model)"""


def _baseline_sql(model: str) -> str:
    return f"{BASE_SQL}\nSELECT symbol, fold, CAST(date AS VARCHAR) AS date, round(prediction, 6) AS prediction, round(actual, 6) AS actual FROM preds WHERE model = '{model}'"


def _test_sql(costs: str = "10.0::DOUBLE", models: str = "model = 'persistence'") -> str:
    """Backtest of thresholded persistence (and buy and hold) at some costs."""
    return f"""{BASE_SQL},
pos AS (
  SELECT symbol, model, date, CASE WHEN prediction > 0.01 THEN 1.0 WHEN prediction < -0.01 THEN -1.0 ELSE 0.0 END::DOUBLE AS position, exp(actual) - 1 AS fwd FROM preds WHERE model = 'persistence'
  UNION ALL SELECT symbol, 'buy_and_hold', date, 1.0::DOUBLE, exp(actual) - 1 FROM preds WHERE model = 'zero'),
moved AS (SELECT *, abs(position - lag(position, 1, 0.0::DOUBLE) OVER (PARTITION BY symbol, model ORDER BY date)) AS turnover FROM pos WHERE {models}),
net AS (SELECT *, position * fwd AS gross, turnover * cost_bps / 10000 AS cost, position * fwd - turnover * cost_bps / 10000 AS net FROM moved CROSS JOIN (SELECT unnest([{costs}]) AS cost_bps)),
eq AS (SELECT *, product(1 + net) OVER (PARTITION BY symbol, model, cost_bps ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM net),
dd AS (SELECT *, 1 - equity / max(equity) OVER (PARTITION BY symbol, model, cost_bps ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS drawdown FROM eq),
fig AS (
  SELECT symbol, model, cost_bps, count(*) AS n_days, arg_max(equity, date) AS equity_end, arg_max(equity, date) - 1 AS total_return, arg_max(equity, date) ** (252.0::DOUBLE / count(*)) - 1 AS cagr,
    stddev_samp(net) * sqrt(252) AS annual_volatility, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe,
    coalesce(avg(net) / nullif(stddev_samp(net) FILTER (net < 0), 0) * sqrt(252), 0) AS sortino, max(drawdown) AS max_drawdown,
    avg((net > 0)::INT) AS hit_rate, avg(abs(position)) AS exposure, avg(turnover) * 252 AS annual_turnover, sum(cost) AS total_costs
  FROM dd GROUP BY symbol, model, cost_bps)"""


_RANKS = f"""{BASE_SQL},
ranked AS (
  SELECT *, rank() OVER (PARTITION BY symbol ORDER BY actual) + (count(*) OVER (PARTITION BY symbol, actual) - 1) / 2 AS ra,
    rank() OVER (PARTITION BY symbol ORDER BY prediction) + (count(*) OVER (PARTITION BY symbol, prediction) - 1) / 2 AS rp FROM preds WHERE model = 'persistence')"""

_TESTS = "tests AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN (p_partkey % 97) * 1e-7::DOUBLE ELSE ((p_partkey * 7919) % 10007) / 10007.0::DOUBLE END AS p_value FROM part)"
_FLAGS = f"""{_TESTS},
k1 AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_value) AS k FROM tests),
k2 AS (SELECT *, max(CASE WHEN p_value <= 0.05::DOUBLE * k / n THEN k END) OVER () AS kmax FROM k1),
flags AS (SELECT p_partkey, p_value, p_value < 0.05::DOUBLE AS nominal, p_value < 0.05::DOUBLE / n AS bonferroni, coalesce(k <= kmax, false) AS fdr FROM k2)"""

ORACLES = {
    "bars_daily": f"{BARS_SQL}\nSELECT symbol, CAST(date AS VARCHAR) AS date, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, round(adj_close, 9) AS adj_close, round(volume, 9) AS volume FROM bars",
    "bars_finalize": """
WITH r AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderkey,
    CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN '-5' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS close FROM orders),
d AS (SELECT *, try_cast(close AS DOUBLE) AS c, row_number() OVER (PARTITION BY symbol, date ORDER BY o_orderkey DESC) AS n FROM r)
SELECT symbol, CAST(date AS VARCHAR) AS date, NULL::DOUBLE AS open, round(c, 6) AS close, round(c, 6) AS adj_close, 0.0::DOUBLE AS volume, 'orders' AS source, false AS is_synthetic
FROM d WHERE n = 1 AND c > 0 AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
    "bars_summary": f"""{BARS_SQL},
r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars)
SELECT symbol, count(*) AS n_days, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, round(avg(r) * 252, 5) AS annual_return,
  round(stddev_samp(r) * sqrt(252), 5) AS annual_volatility, round(min(r), 5) AS worst_day, round(max(r), 5) AS best_day, round(arg_max(close, date), 5) AS last_close FROM r GROUP BY symbol""",
    "bars_symbols": "SELECT DISTINCT l_returnflag AS symbol FROM lineitem",
    "log_returns": _feature_sql("ret_lag_1", "ret_lag_2", "ret_lag_3", "ret_lag_5", "ret_lag_10", places=9),
    "momentum": _feature_sql("momentum_5", "momentum_10", "momentum_21", "momentum_63"),
    "volatility": _feature_sql("vol_5", "vol_21", "vol_ratio"),
    "ma_gap": _feature_sql("ma_gap_10", "ma_gap_21", "ma_gap_63"),
    "rsi": _feature_sql("rsi_14"),
    "macd": _feature_sql("macd", "macd_hist", places=9),
    "atr": _feature_sql("atr_14", "intraday_range", "close_location"),
    "range_position": _feature_sql("range_position_252"),
    "volume_features": _feature_sql("volume_z_21", "volume_trend"),
    "calendar_features": _feature_sql("dow_sin", "dow_cos", places=9),
    "target_returns": _feature_sql(TARGET, places=9),
    "complete_dataset": f"{DATA_SQL}\nSELECT symbol, CAST(date AS VARCHAR) AS date, pos, round(ret_lag_1, 6) AS ret_lag_1, round(rsi_14, 6) AS rsi_14, round(range_position_252, 6) AS range_position_252, round({TARGET}, 6) AS {TARGET} FROM data",
    "no_lookahead": f"""{BARS_SQL},
s AS (SELECT symbol, date, percent_rank() OVER w AS share FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
l AS (SELECT *, lead(share, 5) OVER (PARTITION BY symbol ORDER BY date) AS later FROM s)
SELECT symbol, '{TARGET}' AS feature, count(*) AS n_rows FROM l WHERE share < 0.7::DOUBLE AND later >= 0.7::DOUBLE GROUP BY symbol""",
    "supplier_features": _feature_sql("ret_lag_1", "momentum_5", "vol_5", "ma_gap_10", "rsi_14", TARGET).replace("SELECT l_returnflag AS symbol", "SELECT CAST(l_suppkey AS VARCHAR) AS symbol", 1),
    "walk_forward_folds": f"{FOLDS_SQL}\nSELECT * FROM bounds",
    "rolling_folds": f"{FOLDS_SQL.replace(*ROLLING)}\nSELECT * FROM bounds",
    "rolling_mean_forecast": _baseline_sql("mean").replace(*ROLLING),
    "gram_sums": f"""{DATA_SQL},
v AS (SELECT symbol, 2 * (pos // {TEST}) + (pos % {TEST} >= {TRAIN % TEST})::INT AS piece, count(*) OVER (PARTITION BY symbol) AS n_pos, [1.0::DOUBLE, {", ".join(FEATURES)}, {TARGET}]::DOUBLE[] AS x FROM data),
tri AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS k FROM range(1, {len(FEATURES) + 3}) a(i), range(1, {len(FEATURES) + 3}) b(j) WHERE i <= j)
SELECT symbol, n_pos, piece::BIGINT AS piece, k::INT AS "at", round(sum(x[i] * x[j]), 5) AS total FROM v CROSS JOIN tri GROUP BY ALL""",
    "ridge_walk_forward": f"{RIDGE_SQL},{_figures_sql('ridge')}\n{_WALKED}",
    "ridge_rolling": f"{RIDGE_SQL.replace(*ROLLING)},{_figures_sql('ridge')}\n{_WALKED}",
    "strategy_evaluation": f"""{TRADED_SQL},
b AS (SELECT symbol, sharpe AS benchmark_sharpe FROM tf WHERE model = 'buy_and_hold')
SELECT symbol, model, n_days, round(total_return, 5) AS total_return, round(cagr, 5) AS cagr, round(annual_volatility, 5) AS annual_volatility, round(sharpe, 5) AS sharpe, round(sortino, 5) AS sortino, round(max_drawdown, 5) AS max_drawdown,
  round(CASE WHEN max_drawdown > 0 THEN coalesce(cagr / max_drawdown, 0) ELSE 0 END, 5) AS calmar, round(hit_rate, 5) AS hit_rate, round(exposure, 5) AS exposure, round(annual_turnover, 5) AS annual_turnover, round(total_costs, 5) AS total_costs, round(benchmark_sharpe, 5) AS benchmark_sharpe,
  round(sharpe - benchmark_sharpe, 5) AS excess_sharpe, model <> 'buy_and_hold' AND sharpe > benchmark_sharpe AS beats_benchmark
FROM tf JOIN b USING (symbol)""",
    "ridge_scan": f"""{TRADED_SQL},{_figures_sql('ridge')},
sc AS (
  SELECT f.symbol, n AS n_test_days, directional_accuracy, p_value, information_coefficient, o.sharpe AS strategy_sharpe, o.total_return AS strategy_return, o.annual_turnover, h.sharpe AS benchmark_sharpe, h.total_return AS benchmark_return
  FROM figs f JOIN tf o ON o.symbol = f.symbol AND o.model = 'ridge' JOIN tf h ON h.symbol = f.symbol AND h.model = 'buy_and_hold' WHERE n >= 250),
nn AS (SELECT *, count(*) OVER () AS tests, row_number() OVER (ORDER BY p_value) AS k FROM sc),
km AS (SELECT *, max(CASE WHEN p_value <= 0.05::DOUBLE * k / tests THEN k END) OVER () AS kmax FROM nn)
SELECT symbol, n_test_days, round(directional_accuracy, 5) AS directional_accuracy, round(p_value, 5) AS p_value, round(information_coefficient, 5) AS information_coefficient, round(strategy_sharpe, 5) AS strategy_sharpe,
  round(strategy_return, 5) AS strategy_return, round(annual_turnover, 5) AS annual_turnover, round(benchmark_sharpe, 5) AS benchmark_sharpe, round(benchmark_return, 5) AS benchmark_return,
  round(strategy_sharpe - benchmark_sharpe, 5) AS excess_sharpe, p_value < 0.05::DOUBLE AS nominal, p_value < 0.05::DOUBLE / tests AS bonferroni, coalesce(k <= kmax, false) AS fdr FROM km""",
    "zero_forecast": _baseline_sql("zero"),
    "mean_forecast": _baseline_sql("mean"),
    "persistence_forecast": _baseline_sql("persistence"),
    "forecast_metrics": f"""{BASE_SQL}
SELECT symbol, model, count(*) AS n, round(sqrt(avg((actual - prediction) * (actual - prediction))), 6) AS rmse, round(avg(abs(actual - prediction)), 6) AS mae,
  round(avg((sign(actual) = sign(prediction))::INT), 6) AS directional_accuracy FROM preds GROUP BY symbol, model""",
    "fold_metrics": f"""{BASE_SQL}
SELECT symbol, fold, count(*) AS n, round(sqrt(avg((actual - prediction) * (actual - prediction))), 6) AS rmse, round(avg((sign(actual) = sign(prediction))::INT), 6) AS directional_accuracy,
  round(1 - sum((actual - prediction) * (actual - prediction)) / nullif(var_pop(actual) * count(*), 0), 6) AS r2 FROM preds WHERE model = 'persistence' GROUP BY symbol, fold""",
    "directional_p_value": f"""{BASE_SQL},
h AS (SELECT symbol, model, count(*) AS n, sum((sign(actual) = sign(prediction))::INT) AS k FROM preds GROUP BY symbol, model),
z AS (SELECT *, (k - 0.5 - n * 0.5) / sqrt(n * 0.25) AS z FROM h),
t AS (SELECT symbol, model, z, i, product(CASE WHEN i = 0 THEN z ELSE z * z / (2 * i + 1) END) OVER (PARTITION BY symbol, model ORDER BY i) AS t FROM z CROSS JOIN range(0, 121) r(i))
SELECT symbol, model, round(1 - CASE WHEN z > 10 THEN 1.0 WHEN z < -10 THEN 0.0 ELSE 0.5 + sum(t) * exp(-z * z / 2) / sqrt(2 * pi()) END, 6) AS p_value FROM t GROUP BY symbol, model, z""",
    "spearman_ic": f"{_RANKS}\nSELECT symbol, round(coalesce(covar_pop(ra, rp) / nullif(stddev_pop(ra) * stddev_pop(rp), 0), 0), 6) AS information_coefficient FROM ranked GROUP BY symbol",
    "spearman_lineitem": """
WITH a AS (
  SELECT 'all' AS part, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS y FROM lineitem),
b AS (
  SELECT l_returnflag AS part, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS y FROM lineitem)
SELECT part, 'price' AS beside, round(corr(x, y), 6) AS information_coefficient FROM a GROUP BY part UNION ALL SELECT part, 'discount', round(corr(x, y), 6) FROM b GROUP BY part""",
    "lineitem_medians": "SELECT part, round(median(l_extendedprice), 6) AS median FROM (SELECT 'all' AS part, l_extendedprice FROM lineitem UNION ALL SELECT l_returnflag, l_extendedprice FROM lineitem) GROUP BY part",
    "chosen_features": f"""{FOLDS_SQL},
t AS (SELECT symbol, fold, feature, x, {TARGET} AS y FROM (SELECT symbol, pos, {TARGET}, unnest([{", ".join(f"'{c}'" for c in FEATURES)}]) AS feature, unnest([{", ".join(FEATURES)}]::DOUBLE[]) AS x FROM data) JOIN bounds USING (symbol) WHERE pos >= train_start AND pos < train_end),
c AS (SELECT symbol, fold, feature, coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0) AS r FROM t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY abs(r) DESC, feature) AS rank FROM c)
SELECT symbol, fold, rank, feature, round(r, 6) AS correlation FROM k WHERE rank <= 4""",
    "feature_bins": f"""{DATA_SQL},
t AS (SELECT symbol, pos, unnest([{", ".join(f"'{c}'" for c in BINNED)}]) AS feature, unnest([{", ".join(BINNED)}]::DOUBLE[]) AS x FROM data),
e AS (SELECT symbol, feature, quantile_cont(x, [0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS edges FROM t WHERE pos < {TRAIN} GROUP BY ALL)
SELECT symbol, feature, len(list_filter(edges, lambda b: x >= b))::BIGINT AS bin, count(*) AS days FROM t JOIN e USING (symbol, feature) GROUP BY ALL""",
    "positions_threshold": f"{_test_sql()}\nSELECT symbol, position, count(*) AS days FROM pos WHERE model = 'persistence' GROUP BY symbol, position",
    "backtest_equity": f"{_test_sql()}\nSELECT symbol, CAST(date AS VARCHAR) AS date, round(position, 5) AS position, round(turnover, 5) AS turnover, round(gross, 5) AS gross, round(cost, 5) AS cost, round(net, 5) AS net_return, round(CASE WHEN equity > 0 THEN ln(equity) END, 5) AS log_equity FROM eq",
    "max_drawdown": f"{_test_sql()}\nSELECT symbol, round(max_drawdown, 6) AS max_drawdown FROM fig",
    "strategy_metrics": f"""{_test_sql()}
SELECT symbol, n_days, round(total_return, 5) AS total_return, round(CASE WHEN equity_end > 0 THEN cagr END, 5) AS cagr, round(annual_volatility, 5) AS annual_volatility, round(sharpe, 5) AS sharpe, round(sortino, 5) AS sortino, round(max_drawdown, 5) AS max_drawdown,
  round(CASE WHEN max_drawdown > 0 AND equity_end > 0 THEN cagr / max_drawdown ELSE 0 END, 5) AS calmar, round(hit_rate, 5) AS hit_rate, round(exposure, 5) AS exposure, round(annual_turnover, 5) AS annual_turnover, round(total_costs, 5) AS total_costs FROM fig""",
    "cost_sweep": f"{_test_sql('0.0::DOUBLE, 1.0::DOUBLE, 5.0::DOUBLE, 10.0::DOUBLE, 20.0::DOUBLE')}\nSELECT symbol, cost_bps, round(total_return, 5) AS total_return, round(sharpe, 5) AS sharpe, round(annual_turnover, 5) AS annual_turnover FROM fig",
    "benchmark_compare": f"""{_test_sql(models='true')}
SELECT a.symbol, round(a.sharpe, 5) AS sharpe, round(b.sharpe, 5) AS benchmark_sharpe, round(a.sharpe - b.sharpe, 5) AS excess_sharpe, a.sharpe > b.sharpe AS beats_benchmark
FROM fig a JOIN fig b ON a.symbol = b.symbol AND a.model = 'persistence' AND b.model = 'buy_and_hold'""",
    "multiple_tests": f"WITH {_FLAGS}\nSELECT p_partkey, nominal, bonferroni, fdr FROM flags",
    "scan_summary": f"""
WITH {_FLAGS},
s AS (
  SELECT (p_size + 250)::BIGINT AS n_test_days, 0.4::DOUBLE + (p_partkey % 200) / 1000.0::DOUBLE AS acc, (p_partkey % 31 - 20) / 10.0::DOUBLE AS excess, (p_partkey % 300)::DOUBLE AS turn, nominal, bonferroni, fdr
  FROM part JOIN flags USING (p_partkey))
SELECT count(*) AS n_symbols, round(avg(acc), 6) AS mean_accuracy, round(median(acc), 6) AS median_accuracy, round(stddev_pop(acc), 6) AS sd_accuracy, round(min(acc), 6) AS min_accuracy, round(max(acc), 6) AS max_accuracy,
  round(sqrt(0.25 / median(n_test_days)), 6) AS chance_sd, round(count(*) * 0.05::DOUBLE, 6) AS n_expected, sum(nominal::INT)::BIGINT AS n_nominal, sum(bonferroni::INT)::BIGINT AS n_bonferroni, sum(fdr::INT)::BIGINT AS n_fdr,
  round(avg(excess), 6) AS mean_excess_sharpe, sum((excess > 0)::INT)::BIGINT AS n_beating, round(median(turn), 6) AS median_turnover, round(median(n_test_days), 6) AS median_days FROM s""",
}
