import json
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.functions.features import FEATURES, TARGET, dataset, features, lookahead_leaks
from quillmark.functions.statistics import binomial_p_value, corrected, forecast_metrics, max_drawdown, normal_cdf, strategy_metrics
from quillmark.operators.backtest import backtest, position
from quillmark.operators.folds import assigned, fold_bounds
from quillmark.operators.forecast import MODELS, ridge, walk_forward_predict
from quillmark.sources.bars import BarsError, control_series, finalize, load, one_symbol, parse_chart_json, parse_stooq_csv, read_csv, symbols, write_bars

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    made = control_series(spark, [("A", 900, 13, 0.8), ("B", 200, 14, 0.25)])
    return spark.createDataFrame(made.toPandas(), made.schema)


def test_control_series(spark, bars):
    again = control_series(spark.range(1).sparkSession, [("A", 900, 13, 0.8)]).toPandas().sort_values("date")
    assert np.allclose(again.close, bars.where("symbol = 'A'").toPandas().sort_values("date").close)
    assert again.is_synthetic.all() and (again.high >= again[["open", "close"]].max(axis=1)).all() and (again.low <= again[["open", "close"]].min(axis=1)).all()
    days = pd.to_datetime(again.date)
    assert (days.dt.weekday < 5).all() and days.is_unique
    flat, driven = (control_series(spark, [("X", 5000, 3, s)]).toPandas().sort_values("date").close for s in (0.0, 0.8))
    echo = [np.corrcoef(np.diff(np.log(c))[1:], np.diff(np.log(c))[:-1])[0, 1] for c in (flat, driven)]
    assert abs(echo[0]) < 0.06 and echo[1] > 0.3


def test_sources_in_order(spark, bars, tmp_path):
    kept, csv = tmp_path / "kept", tmp_path / "AAA.csv"
    csv.write_text("Date,Close\n2024-01-01,1.5\n")
    assert load(spark, symbol="AAA", kept=str(kept), csv=str(csv)).first().source == "csv"
    write_bars(bars, str(kept))
    assert load(spark, symbol="a", kept=str(kept), csv=str(csv)).first().source == "control"
    assert load(spark, symbol="AAA", kept=str(kept), csv=str(csv), max_age_days=-1).first().source == "csv"
    with pytest.raises(BarsError, match="too old"):
        load(spark, symbol="AAA", kept=str(kept), max_age_days=-1)
    assert [r.symbol for r in symbols(bars, 1).collect()] == ["A"]


def test_cleaning(spark, tmp_path):
    raw = spark.createDataFrame([("X", "2024-01-01", "10", 0), ("X", "2024-01-02", "", 1), ("X", "2024-01-03", "-5", 2), ("X", "2024-01-04", "12", 3), ("X", "2024-01-04", "13", 4), ("X", "someday", "1", 5)], "symbol string, date string, close string, _pos int")
    rows = finalize(raw, "t").orderBy("date").collect()
    assert [(r.close, r.adj_close, r.volume, r.open) for r in rows] == [(10.0, 10.0, 0.0, None), (13.0, 13.0, 0.0, None)]
    (tmp_path / "abc.csv").write_text("Date,Open,High,Low,Close,AdjClose,Volume\n2024-01-01,1,2,0.5,1.5,1.4,100\n")
    row = read_csv(spark, str(tmp_path / "abc.csv")).first()
    assert (row.symbol, row.adj_close) == ("ABC", 1.4)
    with pytest.raises(BarsError, match="known are ABC"):
        one_symbol(read_csv(spark, str(tmp_path / "abc.csv")), "zzz")
    with pytest.raises(BarsError):
        load(spark, "somewhere")


def test_payloads(spark):
    chart = '{"chart":{"error":null,"result":[{"meta":{"symbol":"T"},"timestamp":[1704067200,1704153600],"indicators":{"quote":[{"open":[1,2],"high":[2,3],"low":[1,1],"close":[1.5,null],"volume":[10,20]}],"adjclose":[{"adjclose":[1.4,2]}]}}]}}'
    rows = parse_chart_json(spark.createDataFrame([(chart,)], "value string")).collect()
    assert [(r.symbol, str(r.date), r.close, r.adj_close) for r in rows] == [("T", "2024-01-01", 1.5, 1.4)]
    with pytest.raises(Exception, match="no chart: gone"):
        parse_chart_json(spark.createDataFrame([('{"chart":{"error":{"description":"gone"},"result":null}}',)], "value string")).collect()
    assert parse_stooq_csv(spark, "Date,Open,High,Low,Close,Volume\n2024-01-01,1,2,1,2,5", "t").first().adj_close == 2.0
    with pytest.raises(BarsError, match="no data for t.us"):
        parse_stooq_csv(spark, "<html>", "t")


def test_features_match_pandas(bars):
    found = features(bars.where("symbol = 'A'")).orderBy("date").toPandas()
    b = bars.where("symbol = 'A'").orderBy("date").toPandas()
    c, r = b.adj_close, np.log(b.adj_close).diff()
    delta = c.diff()
    gain, loss = (x.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for x in (delta, -delta))
    macd = (c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()) / c
    wanted = {
        "ret_lag_3": r.shift(2), "momentum_21": np.log(c / c.shift(21)) / (r.rolling(21).std() * np.sqrt(21)), "vol_ratio": r.rolling(5).std() / r.rolling(21).std(),
        "rsi_14": (100 - 100 / (1 + gain / loss)).fillna(50) / 100, "macd_hist": macd - macd.ewm(span=9, adjust=False).mean(),
        "range_position_252": (c - b.low.rolling(252).min()) / (b.high.rolling(252).max() - b.low.rolling(252).min()), TARGET: np.log(c.shift(-1) / c),
    }
    for name, value in wanted.items():
        assert np.allclose(found[name].astype(float), value, equal_nan=True, rtol=1e-8, atol=1e-10), name
    assert found.columns[3:].tolist() == [*FEATURES, TARGET]


def test_scale_does_not_matter(bars):
    a = bars.where("symbol = 'A'")
    scaled = a.withColumns({c: F.col(c) * 7 for c in ("open", "high", "low", "close", "adj_close")})
    x, y = (dataset(d).orderBy("date").select(*FEATURES).toPandas() for d in (a, scaled))
    assert np.allclose(x, y, rtol=1e-7, atol=1e-9)


def test_no_lookahead_and_a_planted_leak(bars):
    a = bars.where("symbol = 'A'")
    assert lookahead_leaks(a, features).count() == 0
    leaky = lookahead_leaks(a, lambda d: features(d).withColumn("vol_5", F.col(TARGET)), columns=["vol_5", "vol_21"]).collect()
    assert [r.feature for r in leaky] == ["vol_5"]


def test_no_feature_leaves_the_jvm(bars):
    plan = features(bars)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Pandas", "Python", "Arrow"))
    whole = features(bars).orderBy("symbol", "date").toPandas()
    some = features(bars, columns=["atr_14", "macd", "vol_5"]).orderBy("symbol", "date").toPandas()
    assert some.equals(whole[some.columns])


def test_folds(spark):
    sizes = spark.createDataFrame([("A", 2000), ("B", 501), ("C", 502)], "symbol string, n long")
    rows = fold_bounds(sizes, 500, 250).orderBy("symbol", "fold").collect()
    a = [r for r in rows if r.symbol == "A"]
    assert {r.train_start for r in a} == {0} and a[0][2:] == (0, 500, 501, 751) and a[-1].test_end == 2000 and all(x.test_end == y.test_start for x, y in zip(a, a[1:]))
    assert [r.symbol for r in rows if r.symbol != "A"] == ["C"]
    assert [r.train_start for r in fold_bounds(sizes, 500, 250, expanding=False).where("symbol = 'A'").orderBy("fold").collect()] == [250 * k for k in range(len(a))]
    with pytest.raises(ValueError):
        fold_bounds(sizes, 0)


def test_ridge_closed_form():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 3)), rng.normal(size=200)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(np.c_[np.ones(200), z].T @ np.c_[np.ones(200), z] + np.diag([0, 50, 50, 50]), np.c_[np.ones(200), z].T @ y)
    assert np.allclose(ridge(x, y, x), np.c_[np.ones(200), z] @ w)


def test_trees_find_a_step():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = np.where(x[:, 1] > 0, 1.0, -1.0) + rng.normal(size=600) * 0.1
    for name in ("random_forest", "gradient_boosting"):
        assert np.corrcoef(MODELS[name](x[:400], y[:400], x[400:]), y[400:])[0, 1] > 0.8


def test_walk_forward(bars):
    data = dataset(bars)
    found = walk_forward_predict(data, ["zero", "mean", "persistence", ("sign", lambda a, b, c: np.sign(c[:, 0]))], train=400, test=100)
    rows = found.groupBy("symbol", "model").count().collect()
    assert {r.symbol for r in rows} == {"A"} and len({r["count"] for r in rows}) == 1 and len(rows) == 4
    scored = {r.model: r for r in forecast_metrics(found, ["symbol", "model"]).collect()}
    assert scored["zero"].directional_accuracy == 0 and scored["zero"].information_coefficient == 0
    with pytest.raises(ValueError, match="unknown model"):
        walk_forward_predict(data, ["oracle"])
    with pytest.raises(Exception, match="too few rows"):
        walk_forward_predict(data, ["zero"], train=5000, strict=True).collect()


def test_p_values(spark):
    z = [-12.0, -3.0, -0.5, 0.0, 1.0, 2.5, 6.0, 11.0]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(normal_cdf(F.col("z"))).collect()]
    assert np.allclose(found, [NormalDist().cdf(x) for x in z], atol=1e-15)
    k = spark.createDataFrame([(500, 1000), (600, 1000), (55, 100), (728, 1400), (0, 0)], "k long, n long")
    p = [r[0] for r in k.select(binomial_p_value(F.col("k"), F.col("n"))).collect()]
    assert p[0] > 0.4 and p[1] < 1e-6 and p[2] > 0.05 and p[3] == pytest.approx(0.0708, abs=1e-4) and p[4] is None


def test_corrections(spark):
    ps = [0.04] * 5 + [0.6] * 95 + [None]
    rows = corrected(spark.createDataFrame(list(enumerate(ps)), "i int, p_value double")).agg(*[F.sum(F.col(c).cast("int")) for c in ("nominal", "fdr", "bonferroni")]).first()
    assert tuple(rows) == (5, 0, 0)
    rng = np.random.default_rng(1)
    ps = [1e-8] * 10 + rng.uniform(size=190).tolist()
    found = corrected(spark.createDataFrame(list(enumerate(ps)), "i int, p_value double")).where("fdr").collect()
    assert {r.i for r in found} >= set(range(10)) and len(found) <= 15


def test_corrections_against_plain_python(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(12):
        ps = rng.choice([0.0, 1e-300, 1e-9, 0.001, 0.02, 0.04, 0.05, 0.3, 1.0, None, float("nan")], 40).tolist() + (rng.uniform(size=60) ** (1 + g % 4)).tolist()
        rows += [(g, n, None if p is None else float(p)) for n, p in enumerate(ps)]
    found = {(r.g, r.n): (r.nominal, r.bonferroni, r.fdr) for r in corrected(spark.createDataFrame(rows, "g int, n int, p_value double"), by=["g"]).collect()}
    for g in range(12):
        mine = [(n, p) for h, n, p in rows if h == g]
        known = sorted(p for _, p in mine if p is not None and p == p)
        most = max([p for k, p in enumerate(known, 1) if p <= 0.05 * k / len(mine)], default=-1.0)
        for n, p in mine:
            there = p is not None and p == p
            assert found[g, n] == (there and p < 0.05, there and p < 0.05 / len(mine), there and p <= most)
    assert corrected(spark.createDataFrame([], "p_value double")).count() == 0


def test_folds_of_a_row(spark):
    sizes = spark.createDataFrame([("A", 400), ("B", 90)], "symbol string, n long")
    rows = sizes.selectExpr("symbol", "n as n_pos", "explode(sequence(0, cast(n as int) - 1)) as pos")
    for options in ({"train": 100, "test": 30}, {"train": 100, "test": 30, "expanding": False}, {"train": 60, "test": 50, "step": 20, "embargo": 3}, {"train": 80, "test": 40, "expanding": True, "embargo": 0}):
        bounds = fold_bounds(sizes, **options).collect()
        wanted = sorted((b.symbol, p, b.fold, part) for b in bounds for part, a, z in (("train", b.train_start, b.train_end), ("test", b.test_start, b.test_end)) for p in range(a, z))
        assert sorted((r.symbol, r.pos, r.fold, r.part) for r in assigned(rows, **options).collect()) == wanted


def test_ridge_query_against_numpy(spark):
    """The walk-forward ridge of the query, recomputed from the collected rows."""
    from quillmark.plans import market_queries as q

    data = dataset(q.bars(spark, SF)).toPandas().sort_values(["symbol", "pos"])
    found = walk_forward_predict(spark.createDataFrame(data), ["ridge"], train=q.TRAIN, test=q.TEST).toPandas()
    wanted = []
    for _, rows in data.groupby("symbol"):
        x, y = rows[FEATURES].to_numpy(float), rows[TARGET].to_numpy(float)
        for start in range(0, len(rows) - q.TRAIN - 1, q.TEST):
            train, test = slice(0, start + q.TRAIN), slice(start + q.TRAIN + 1, start + q.TRAIN + 1 + q.TEST)
            mean, sd = x[train].mean(0), x[train].std(0)
            z = np.c_[np.ones(start + q.TRAIN), (x[train] - mean) / np.where(sd > 0, sd, 1)]
            w = np.linalg.solve(z.T @ z + np.diag([0.0] + [50.0] * len(FEATURES)), z.T @ y[train])
            wanted.append(np.c_[np.ones(len(x[test])), (x[test] - mean) / np.where(sd > 0, sd, 1)] @ w)
    assert np.allclose(found.sort_values(["symbol", "date"]).prediction, np.concatenate(wanted), rtol=1e-6, atol=1e-9)


FOLDS = [{}, {"expanding": False}, {"train": 80, "test": 40}, {"train": 90, "test": 50, "step": 20, "embargo": 3}, {"train": 90, "test": 50, "step": 20, "expanding": False, "embargo": 0}, {"train": 30, "test": 40, "expanding": False}]


@pytest.mark.parametrize("options", FOLDS)
def test_sums_over_pieces_are_training_sets(spark, options):
    """Means and ridge forecasts from sums of pieces equal those of copied rows."""
    options = {"train": 100, "test": 30} | options
    rng = np.random.default_rng(len(options))
    names = ["a", "b", "ret_lag_1"]
    rows = [(s, n, n, size, *(float(v) for v in rng.normal(size=2)), 0.25 if s == "flat" else float(rng.normal()), float(rng.normal())) for s, size in (("one", 400), ("flat", 260), ("short", 60)) for n in range(size)]
    data = spark.createDataFrame(rows, "symbol string, n int, pos int, n_pos long, a double, b double, ret_lag_1 double, y double").selectExpr("symbol", "date_add(date'2020-01-01', n) as date", "pos", "n_pos", "a", "b", "ret_lag_1", f"y as {TARGET}")
    summed = walk_forward_predict(data, ["ridge", "mean", "persistence"], features=names, **options).toPandas()
    copied = walk_forward_predict(data, [("ridge", ridge), ("mean", MODELS["mean"]), ("persistence", lambda a, b, c: c[:, 2])], features=names, **options).toPandas()
    keys = ["symbol", "model", "fold", "date"]
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (summed, copied))
    assert len(a) == len(b) > 0 and a[keys].equals(b[keys]) and np.allclose(a.prediction, b.prediction, rtol=1e-9, atol=1e-12) and np.allclose(a.actual, b.actual)


def days(spark, positions, returns):
    dates = pd.bdate_range("2024-01-01", periods=len(positions)).date
    return spark.createDataFrame([("s", d, float(p), float(r)) for d, p, r in zip(dates, positions, returns)], "k string, date date, position double, forward_return double")


def test_backtest(spark):
    rows = backtest(days(spark, [1, 1, -1], [0.1, 0.1, 0.0]), ["k"], 10).orderBy("date").collect()
    assert [r.cost for r in rows] == pytest.approx([0.001, 0.0, 0.002]) and rows[-1].equity == pytest.approx(1.099 * 1.1 * 0.998)
    assert backtest(days(spark, [1] * 3, [0.1] * 3), ["k"], 0).agg(F.max("equity")).first()[0] == pytest.approx(1.1**3)
    m = strategy_metrics(backtest(days(spark, [1, -1] * 126, [0.0] * 252), ["k"], 0), ["k"]).first()
    assert m.annual_turnover == pytest.approx(504, rel=0.02) and m.sharpe == 0 and m.exposure == 1
    assert strategy_metrics(backtest(days(spark, [1] * 252, [0.001] * 252), ["k"], 0), ["k"]).first().annual_turnover == pytest.approx(1.0)
    # the peak starts at the first equity
    assert max_drawdown(backtest(days(spark, [1, 1, 1], [-0.5, 1.0, -0.5]), ["k"], 0), ["k"]).first().max_drawdown == pytest.approx(0.5)
    p = spark.createDataFrame([(0.01,), (-0.01,), (0.0001,), (-0.0001,)], "p double")
    assert [r[0] for r in p.select(position(F.col("p"), 0.005)).collect()] == [1, -1, 0, 0]
    assert [r[0] for r in p.select(position(F.col("p"), 0.005, allow_short=False)).collect()] == [1, 0, 0, 0]


def test_controls(spark):
    from quillmark.plans.evaluation import self_test

    assert all(r.passed for r in self_test(spark).collect())


def test_corrections_read_their_input_twice(spark):
    plan = corrected(spark.range(10).select((F.col("id") / 10).alias("p_value")).withColumn("x", F.rand(1)).drop("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner\n" not in plan and "Join Cross" not in plan and plan.count("Range (0, 10") <= 3  # counts are exchanged once


def test_scan(bars):
    from quillmark.plans.evaluation import scan, scan_failures, scan_json, scan_text

    found = scan(bars, train=300, test=100, min_test_days=100)
    assert [r.symbol for r in found.collect()] == ["A"]
    assert [(r.symbol, "test days" in r.reason) for r in scan_failures(bars, found, min_test_days=100).collect()] == [("B", True)]
    assert scan(bars, train=300, test=100, min_test_days=100, first_symbols=1).count() == 1
    lines = [json.loads(r.value) for r in scan_json(found, scan_failures(bars, found, min_test_days=100)).collect()]
    assert [x["kind"] for x in lines] == ["summary", "result", "failure"] and lines[0]["n_symbols"] == 1 and lines[1]["symbol"] == "A" and "fdr" in lines[1]
    assert "verdict" in scan_text(found) and math.isfinite(found.first().excess_sharpe)


def test_evaluation_text_counts_all_rows(spark):
    from quillmark.plans.evaluation import evaluation_json, evaluation_text

    rows = spark.range(250).select(F.concat(F.lit("S"), "id").alias("symbol"), F.lit("ridge").alias("model"), *[F.lit(0.01).alias(c) for c in ("directional_accuracy", "p_value", "information_coefficient", "rmse", "total_return", "sharpe", "max_drawdown", "annual_turnover")], (F.col("id") < 240).alias("beats_benchmark"))
    lines = evaluation_json(rows.where("symbol in ('S1', 'S245')"), rows.where("symbol in ('S1', 'S245')")).orderBy("symbol").collect()
    one, other = (json.loads(r.value) for r in lines)
    assert one["beats_benchmark"] == one["significant_forecasts"] == ["ridge"] and other["beats_benchmark"] == [] and one["forecasts"]["ridge"]["p_value"] == 0.01
    text = evaluation_text(rows, rows, False)
    assert "verdict: 250 forecasts better than chance, 240 strategies" in text
    assert "(50 more forecasts)" in text and "(50 more strategies)" in text


def test_supplier_features_sort_once_a_step_and_deal_by_rows(spark, monkeypatch):
    from quillmark.plans import market_queries as mq

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    few = mq.supplier_features(spark, SF)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=false" in plan
    # trades by symbol and day, bars by symbol, then both sides of the join: one sort each, however many windows there are
    assert "ENSURE_REQUIREMENTS" not in plan and plan.count("+- Sort [") + plan.count(":- Sort [") == 6
    monkeypatch.setattr(mq, "TASK_ROWS", 250)
    many = mq.supplier_features(spark, SF)
    trades = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert f", {-(-trades // 250)}), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    key = lambda r: (r.symbol, r.date)
    assert sorted(few.collect(), key=key) == sorted(many.collect(), key=key)


def test_scan_by_given_blocks_and_parts_keeps_a_null_group(spark):
    from quillmark.functions.scans import affine_scan

    rows = [(g, n, 0.5 + (n % 3) / 10, float(n)) for g in ("x", "", None) for n in range(50)]
    table = spark.createDataFrame(rows, "g string, n int, a double, b double").withColumn("_block", F.floor(F.col("n") / 7).cast("long"))
    found = affine_scan(table, ["g"], "n", {"y": ("a", "b")}, blocks="_block", parts=5)
    assert found.rdd.getNumPartitions() == 5
    y = {g: 0.0 for g in ("x", "", None)}
    got = sorted(found.collect(), key=lambda r: r.n)
    assert len(got) == 150
    for r in got:
        y[r.g] = r.a * y[r.g] + r.b
        assert abs(r.y - y[r.g]) < 1e-9
