import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.functions.scans import affine_scan, ewm_steps, max_drawdown
from quillmark.operators.asof import asof_join


@pytest.mark.parametrize("block", [1, 4, 7, 64])
def test_affine_scan(spark, block):
    rng = random.Random(block)
    rows, wanted = [], {}
    for g, size in (("a", 90), ("b", 1), (None, 7)):
        y = z = 0.0
        for n in range(size):
            a, b = rng.choice([0.5, -1.5, 1.0, 0.9]), rng.choice([-1, 1]) * rng.uniform(0.3, 1)
            y, z = a * y + b, b * z + a
            rows.append((g, n, a, b))
            wanted[g, n] = (y, z)
    table = spark.createDataFrame(rows, "g string, n long, a double, b double").repartition(5)
    found = affine_scan(table, ["g"], "n", {"y": ("a", "b"), "z": ("b", "a")}, block).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.y, r.z) == pytest.approx(wanted[r.g, r.n], rel=1e-8, abs=1e-9)


def test_smoothing_is_that_of_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=700)
    x[rng.random(700) < 0.2] = np.nan
    x[:5] = np.nan
    rows = [("s", n, None if np.isnan(v) else float(v)) for n, v in enumerate(x)]
    table = spark.createDataFrame(rows, "s string, n long, x double").withColumnRenamed("s", "k")
    for alpha in (1 / 14, 0.2, 0.9):
        a, b, seen = ewm_steps("x", alpha, ["k"], "n")
        found = affine_scan(table.withColumns({"a": a, "b": b, "seen": seen}), ["k"], "n", {"y": ("a", "b")}, 16).orderBy("n").toPandas()
        wanted = pd.Series(x).ewm(alpha=alpha, adjust=False).mean()
        assert np.allclose(found.y.where(found.seen > 0), wanted, equal_nan=True, rtol=1e-10)


@pytest.mark.parametrize("block", [1, 7, 256])
def test_drawdowns(spark, block):
    rng = np.random.default_rng(block)
    rows, wanted = [], {}
    for g in range(6):
        r = rng.normal(0.001, 0.05 if g < 4 else 0.9, size=120)  # the last two fall below zero
        equity, start = np.cumprod(1 + np.where(np.arange(120) % 11 == 3, 0, r)), dt.date(2024, 1, 1)
        peak = np.maximum.accumulate(equity)
        wanted[g] = ((peak - equity) / peak).max()
        rows += [(g, start + dt.timedelta(days=3 * n), n, None if n % 11 == 3 else float(v)) for n, v in enumerate(r)]
    table = spark.createDataFrame(rows, "g int, date date, n int, net_return double").repartition(4)
    for order in ("date", "n"):
        found = {r.g: r.max_drawdown for r in max_drawdown(table, ["g"], order, block=block).collect()}
        assert found == pytest.approx(wanted, rel=1e-9)
    one_row = spark.createDataFrame([(1, dt.date(2024, 1, 1), None)], "g int, date date, net_return double")
    assert max_drawdown(one_row, ["g"]).first().max_drawdown == 0 and max_drawdown(one_row.limit(0), ["g"]).count() == 0


@pytest.mark.parametrize("bucket", [1, 3600, 86_400 * 400])
def test_as_of_join(spark, bucket):
    rng = random.Random(bucket)
    start = dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(seconds=rng.randrange(20_000))
    history = [(rng.choice("abc"), at(), n) for n in range(60)] + [("a", start + dt.timedelta(seconds=9), 100), ("a", start + dt.timedelta(seconds=9), 101), (None, start, 7), ("b", None, 8)]
    events = [(n, "a" if n % 3 else rng.choice("abcd"), at()) for n in range(400)] + [(900, None, at()), (901, "a", None), (902, "a", start + dt.timedelta(seconds=9))]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    e, h = table(events, "n int, k string, t timestamp"), table(history, "k string, since timestamp, v int")
    wanted = {}
    for n, k, t in events:
        known = [(s, v) for key, s, v in history if key == k and key is not None and s is not None and t is not None and s <= t]
        wanted[n] = max(known) if known else (None, None)
    found = {r.n: (r.since, r.v) for r in asof_join(e, h, ["k"], "t", "since", bucket, how="left").collect()}
    assert found == wanted
    inner = asof_join(e, h, ["k"], "t", "since", bucket).collect()
    assert {r.n for r in inner} == {n for n, x in wanted.items() if x[0]} and len(inner) == len({r.n for r in inner})
    assert asof_join(e.limit(0), h, ["k"], "t", "since").count() == 0 and asof_join(e, h.limit(0), ["k"], "t", "since", how="left").count() == len(events)
    with pytest.raises(ValueError):
        asof_join(e, h, ["k"], "t", "since", how="outer")
    assert asof_join(e, h.select("k", "since"), ["k"], "t", "since", bucket).where(F.col("since") > F.col("t")).count() == 0


def test_written_tables_can_be_cleared(spark):
    from quillmark import scratch

    kept = scratch.written(spark.range(5), "x")
    assert kept.count() == 5 and scratch.clear(spark) >= 1 and scratch.clear(spark) == 0


@pytest.mark.parametrize("most,bins", [(10_000, 1024), (4, 8)])
def test_ranks_and_medians(spark, most, bins):
    from quillmark.functions.statistics import spearman
    from quillmark.operators.ranks import medians, spearman_large, value_ranks

    rng = np.random.default_rng(most)
    rows = [(g, float(v), float(w)) for g, n in (("a", 60), ("b", 33), (None, 10), ("one", 1)) for v, w in zip(rng.choice([0.0, -1.5, 2.0, 1e300, -1e-300, 7.25, 3.5], n), rng.normal(size=n), strict=True)] + [("a", None, 1.0), ("a", float("nan"), 1.0)]
    table = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    by = {}
    for g, v, w in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append((v, w))
    for k, name in enumerate(("v", "w")):
        found = {r.g: r.median for r in medians(table.where("v IS NOT NULL AND NOT isnan(v)"), ["g"], name, most, bins).collect()}
        assert found == pytest.approx({g: float(np.median([x[k] for x in xs])) for g, xs in by.items()}, rel=1e-12)
    clean = table.where("NOT isnan(v)")
    ranks = {(r.g, r.v): r["rank"] for r in value_ranks(clean, ["g"], "v").collect()}
    for g, xs in by.items():
        wanted = pd.Series([x[0] for x in xs]).rank()
        assert all(ranks[g, x[0]] == r for x, r in zip(xs, wanted, strict=True))
    large, small = ({r.g: r.information_coefficient for r in f(table, ["g"], "v", "w").collect()} for f in (spearman_large, spearman))
    assert large == pytest.approx(small, abs=1e-12)
    assert medians(table.limit(0), ["g"], "v").count() == 0


def test_features_that_go_with_the_target(spark):
    from quillmark.functions.features import TARGET
    from quillmark.operators.gram import digitized, feature_correlations, quantile_edges, top_features

    rng = np.random.default_rng(4)
    y = rng.normal(size=300)
    x = np.c_[y + rng.normal(size=300), rng.normal(size=300), np.full(300, 2.5)]
    data = spark.createDataFrame([("s", dt.date(2024, 1, 1) + dt.timedelta(days=n), n, 300, *map(float, x[n]), float(y[n])) for n in range(300)], f"symbol string, date date, pos int, n_pos long, a double, b double, c double, {TARGET} double")
    for expanding in (True, False):
        found = {(r.fold, r.feature): r.correlation for r in feature_correlations(data, ["a", "b", "c"], 100, 50, expanding=expanding).collect()}
        assert {f for f, _ in found} == {0, 1, 2, 3}
        for fold, name in found:
            part = slice(0 if expanding else 50 * fold, 100 + 50 * fold)
            wanted = 0.0 if name == "c" else np.corrcoef(x[part, "abc".index(name)], y[part])[0, 1]
            assert found[fold, name] == pytest.approx(wanted, abs=1e-9)
    assert {r.feature for r in top_features(feature_correlations(data, ["a", "b", "c"], 100, 50), 1).collect()} == {"a"}
    edges = quantile_edges(data, ["a", "c"], 4)
    bins = {(r.date, r.feature): r.bin for r in digitized(data, edges, ["a", "c"]).collect()}
    wanted = np.digitize(x[:, 0], np.quantile(x[:, 0], [0.25, 0.5, 0.75]))
    assert [bins[dt.date(2024, 1, 1) + dt.timedelta(days=n), "a"] for n in range(300)] == wanted.tolist() and {b for (_, f), b in bins.items() if f == "c"} == {3}
    about = quantile_edges(data, ["a"], 4, accuracy=1000).first().edges
    assert all(abs((x[:, 0] <= e).mean() - s) < 0.01 for e, s in zip(about, (0.25, 0.5, 0.75), strict=True))
