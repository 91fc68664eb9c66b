import pytest
from pyspark.sql import functions as F

from quillmark.functions.tokens import cache_additions, calibrate, content_key, count_tokens, estimate, symbol_density
from quillmark.operators.packing import available_tokens, order_for_cache, pack, summary, validated_items

ITEM = "request_id long, ord int, name string, content string, tokens long, priority double, required boolean, stable boolean"


def test_estimates(spark):
    texts = spark.createDataFrame([("",), (None,), ("a" * 39,), ("{}[]();" * 10,)], "text string")
    rows = [tuple(r) for r in texts.select(*[c.alias(k) for k, c in estimate(F.col("text")).items()]).collect()]
    assert rows[0] == rows[1] == (0, 0, 0)
    assert rows[2] == (10, 8, 12)
    assert rows[3][0] == round(70 / 3.0)
    assert texts.where("text like 'a%'").select(symbol_density(F.col("text"))).first()[0] == 0.0


def test_calibration(spark):
    samples = spark.createDataFrame([("x" * 400, 100), ("  ", 5)], "text string, tokens long")
    assert calibrate(samples).first().ratio_thousandths == 4000
    with pytest.raises(Exception, match="no sample"):
        calibrate(samples.where("tokens = 5")).collect()
    stored = spark.createDataFrame([("m", 4000)], "model string, ratio_thousandths long")
    found = count_tokens(spark.createDataFrame([("x" * 800,)], "text string"), spark.createDataFrame([], "key string, tokens long"), "m", stored)
    assert found.first().tokens == 200


def test_cache_and_exact_counts(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("c",)], "text string")
    key = texts.where("text = 'a'").select(content_key(F.lit("m"), F.to_json(F.struct("text"))).alias("key"), F.lit(77).cast("long").alias("tokens"))
    found = count_tokens(texts, key, "m", exact=lambda misses: misses.where("text = 'b'").select("key", F.lit(5).cast("long").alias("tokens")))
    assert {r.text: (r.tokens, r.found) for r in found.collect()} == {"a": (77, "cached"), "b": (5, "exact"), "c": (1, "estimated")}
    assert [r.tokens for r in cache_additions(found).collect()] == [5]


def test_packing_skips_and_goes_on(spark):
    rows = [(1, 0, "base", None, 500, 0.0, True, True), (1, 1, "small", None, 100, 5.0, False, False), (1, 2, "bulky", None, 1800, 1.0, False, False), (1, 3, "last", None, 200, 0.0, True, False), (1, 4, "zero", None, 1, 0.0, False, False)]
    packed = pack(spark.createDataFrame(rows, ITEM), available_tokens(F.lit(3000), F.lit(200_000), 1000, 0, 0.0))
    row = packed.first()
    assert (row.available, row.used, row.included, row.dropped) == (2000, 800, ["base", "small", "last"], ["bulky", "zero"])
    assert summary(packed).first().summary == "800/2000 tokens (40.0%), 3 included, 2 dropped"
    with pytest.raises(Exception, match="required items exceed"):
        pack(spark.createDataFrame(rows, ITEM), F.lit(600)).collect()


def test_item_checks(spark):
    good = validated_items(spark.createDataFrame([(1, 0, "a", "text here", 0, 1.0, False, False)], ITEM)).first()
    assert good.tokens == 2
    for bad, why in (((1, 0, "a", None, 0, 1.0, False, False), "no tokens"), ((1, 0, "a", "t", 0, -1.0, False, False), "negative priority")):
        with pytest.raises(Exception, match=why):
            validated_items(spark.createDataFrame([bad], ITEM)).collect()
    with pytest.raises(Exception, match="no room"):
        spark.range(1).select(available_tokens(F.lit(100), F.lit(200_000))).collect()


def test_cache_order(spark):
    rows = [(1, n, name, None, 1, 1.0, False, stable) for n, (name, stable) in enumerate([("question", False), ("system", True), ("timestamp", False), ("tools", True)])]
    found = order_for_cache(spark.createDataFrame(rows, ITEM)).orderBy("cache_order").collect()
    assert [r.name for r in found] == ["system", "tools", "question", "timestamp"]


def test_files_and_kept_counts(spark, tmp_path):
    from quillmark.functions.tokens import count_files, flush_cache, read_cache

    (tmp_path / "a.txt").write_bytes(b"good text \xff\xfe end")
    (tmp_path / "b.txt").write_bytes("naïve".encode())
    (tmp_path / "c.txt").write_bytes(b"")
    kept = str(tmp_path / "kept")
    exact = lambda misses: misses.selectExpr("key", "cast(length(text) as bigint) as tokens")
    assert read_cache(spark, kept).count() == 0
    counted = count_files(spark, str(tmp_path / "*.txt"), read_cache(spark, kept), "m", exact=exact)
    rows = {r.path[-5:]: (r.text, r.tokens, r.found) for r in counted.collect()}
    assert rows["a.txt"][0].startswith("good text \ufffd") and rows["a.txt"][0].endswith(" end")
    assert rows["b.txt"] == ("naïve", 5, "exact") and "c.txt" not in rows  # an empty file has nothing to count
    flush_cache(counted, kept)
    again = count_files(spark, str(tmp_path / "*.txt"), read_cache(spark, kept), "m")
    assert {r.found for r in again.collect()} == {"cached"}
    flush_cache(again, kept)
    assert read_cache(spark, kept).count() == 2
