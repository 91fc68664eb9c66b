import threading

import pytest
from pyspark.sql import functions as F

from quillmark.functions.tokens import compact_cache, flush_cache, read_cache
from quillmark.sources.rates import kept_limits, refresh_limits
from quillmark.sources.snapshots import SnapshotConflict, append_snapshot, compact, forget, history, read_snapshot, update_snapshot


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_snapshot(spark, path) is None and history(spark, path) == []
    a, b = (spark.createDataFrame([x], "k int, v string") for x in ((1, "a"), (2, "b")))
    assert append_snapshot(a, path) == 1 and append_snapshot(b, path, by=["k"]) == 2
    held = read_snapshot(spark, path)
    assert update_snapshot(spark, path, lambda t: t.where("k = 2")) == 3
    assert update_snapshot(spark, path, lambda t: None) == 3
    assert rows(held) == [(1, "a"), (2, "b")] and rows(read_snapshot(spark, path)) == [(2, "b")] and rows(read_snapshot(spark, path, 1)) == [(1, "a")]
    with pytest.raises(ValueError, match="other columns"):
        append_snapshot(a.withColumn("x", F.lit(1)), path)
    assert read_snapshot(spark, path, 9) is None
    assert forget(spark, path) == 3 and history(spark, path) == [3] and rows(read_snapshot(spark, path)) == [(2, "b")]


def at_once(*works):
    failed = []

    def run(work):
        try:
            work()
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=run, args=(w,)) for w in works]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed


def test_writers_at_once(spark, tmp_path):
    """Counts, limits and a sum that several writers change at one time: nothing is lost."""
    cache, limits, total = (str(tmp_path / n) for n in ("cache", "limits", "total"))
    counted = [spark.createDataFrame([(f"k{n}", n, "exact"), ("both", 7, "exact"), ("none", 1, "estimated")], "key string, tokens long, found string") for n in range(4)]
    at_once(*[lambda c=c: flush_cache(c, cache) for c in counted])
    wanted = [("both", 7), *[(f"k{n}", n) for n in range(4)]]
    assert rows(read_cache(spark, cache)) == wanted
    compact_cache(spark, cache)
    assert rows(read_cache(spark, cache)) == wanted and len(history(spark, cache)) == 5
    new = [spark.createDataFrame([(f"m{n}", n, None), ("shared", None, n) if n % 2 else ("shared", 5, None)], "id string, context_window long, max_output_tokens long") for n in range(4)]
    at_once(*[lambda x=x: refresh_limits(x, limits) for x in new])
    kept = {r.id: (r.context_window, r.max_output_tokens) for r in kept_limits(spark, limits).collect()}
    assert kept["shared"][0] == 5 and kept["shared"][1] in (1, 3) and {f"m{n}" for n in range(4)} < set(kept)
    one = spark.createDataFrame([(1,)], "n int")
    add = lambda t: one if t is None else t.select((F.col("n") + 1).alias("n"))
    at_once(*[lambda: update_snapshot(spark, total, add) for _ in range(4)])
    assert read_snapshot(spark, total).first().n == 4


def test_compaction_meets_other_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1,)], "n int")
    for _ in range(3):
        append_snapshot(one, path)
    at_once(lambda: compact(spark, path, 1), lambda: append_snapshot(one, path))
    assert read_snapshot(spark, path).count() == 4
    assert kept_limits(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(SnapshotConflict):
        update_snapshot(spark, path, lambda t: append_snapshot(one, path) and one, attempts=2)
