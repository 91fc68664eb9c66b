"""The ledger as a stream: lines arriving in a folder, totals kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.pricing import TOKENS
from quillmark.sources.ledger import parse_lines, priced_ledger

def _sums() -> list:
    return [F.count("*").alias("calls"), *[F.sum(t).alias(t) for t in TOKENS], F.sum("cost").alias("cost"), F.sum("cost_uncached").alias("cost_uncached")]


def stream_ledger(spark: SparkSession, path: str, rates: DataFrame, pricing_day=None, max_files: int | None = None) -> DataFrame:
    """Priced calls of files as they appear; the rate table is a static side."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return priced_ledger(parse_lines(reader.text(path)), rates, pricing_day)


def running_totals(calls: DataFrame, key: str = "model") -> DataFrame:
    """Totals by a column since the start (output mode complete)."""
    return calls.groupBy(key).agg(*_sums())


def windowed_totals(calls: DataFrame, window: str = "1 hour", watermark: str = "1 hour", key: str = "model") -> DataFrame:
    """Totals by event time; a window is final, and its state dropped, once the watermark has passed it."""
    late = calls.withWatermark("ts_utc", watermark)
    return late.groupBy(F.window("ts_utc", window).alias("w"), key).agg(*_sums()).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "calls", *TOKENS, "cost", "cost_uncached")


def write_totals(totals: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True):
    """Start writing to Parquet (append) or, for complete output, replacing the table at each trigger."""
    writer = totals.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    if mode == "complete":
        return writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    return writer.outputMode(mode).format("parquet").option("path", path).start()
