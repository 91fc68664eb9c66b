"""Records of streamed requests: start, delta and end events of a request become one record at its clean end.

A request is whole when its end has been seen and every event before it (events are numbered from 0). What arrives late,
out of order or twice gives the same record; a request that fails, or of which an event is lost, gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.pricing import TOKENS

#: Numbers of events end here; a request that goes on beyond is taken as failed.
MOST = 1_000_000
EVENT = "request_id string, seq long, kind string, at timestamp, model string, " + ", ".join(f"{t} long" for t in TOKENS)
RECORD = "request_id string, ts string, ts_utc timestamp, model string, " + ", ".join(f"{t} long" for t in TOKENS) + ", duration_ms double, batch boolean, speed string"


def records_from_events(events: DataFrame) -> DataFrame:
    """Records of whole requests in a table of events (:data:`EVENT`).

    Model and prompt come from the start; each count is that of the last event that has one, as later events carry totals
    so far. Of events that repeat a number the first by time counts. Events without a request or number are none.
    """
    known = events.where("request_id IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL")
    one = known.groupBy("request_id", "seq").agg(F.min(F.struct("at", "kind", "model", *TOKENS)).alias("e")).select("request_id", "seq", "e.*")
    last = F.max(F.when(F.col("kind") == "end", F.col("seq")))
    counts = [F.coalesce(F.max_by(t, F.when(F.col(t).isNotNull(), F.col("seq"))), F.lit(0)).alias(t) for t in TOKENS]
    found = one.groupBy("request_id").agg(
        last.alias("last"), F.count("*").alias("n"), F.max("seq").alias("most"), F.max((F.col("kind") == "error").cast("int")).alias("failed"), F.min_by("kind", "seq").alias("first"), F.min_by("model", "seq").alias("model"), F.min_by("at", "seq").alias("begun"), F.max_by("at", "seq").alias("ended"), *counts
    )
    whole = found.where(f"failed = 0 AND first = 'start' AND model IS NOT NULL AND last = most AND n = last + 1 AND most < {MOST}")
    return _record(whole)


def _record(whole: DataFrame) -> DataFrame:
    took = (F.unix_micros("ended") - F.unix_micros("begun")) / 1000
    return whole.select("request_id", F.date_format("begun", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("ts"), F.col("begun").alias("ts_utc"), "model", *TOKENS, took.alias("duration_ms"), F.lit(False).alias("batch"), F.lit("standard").alias("speed"))


def stream_records(events: DataFrame, watermark: str = "10 minutes", timeout_minutes: float = 60) -> DataFrame:
    """Records of whole requests of a stream of events, each once, as soon as nothing of it is missing.

    State is one row a request: numbers seen as a bitmap, and the latest counts. It is dropped once the watermark is
    ``timeout_minutes`` past the last event of a request, whether it is recorded, failed or never came to an end; events
    later than that find nothing and give nothing. The session's state store must be the RocksDB one.
    """
    from pyspark.sql.streaming import StatefulProcessor

    wait = int(timeout_minutes * 60_000)
    state_schema = "model string, begun long, ended long, latest long, last long, failed boolean, done boolean, seen binary, " + ", ".join(f"at_{t} long, {t} long" for t in TOKENS)

    class Requests(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.state = handle, handle.getValueState("request", state_schema)

        def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
            import pandas as pd

            held = self.state.get() if self.state.exists() else None
            model, begun, ended, latest, last, failed, done, seen, *counts = held or (None, None, None, -1, -1, False, False, b"", *[x for _ in TOKENS for x in (-1, 0)])
            bits, counts, before = int.from_bytes(seen, "little"), list(counts), latest
            for part in rows:
                part = part[part.seq.notna() & part["at"].notna()]
                for event in part.sort_values("at").itertuples():
                    seq, at = int(event.seq), int(event.at.timestamp() * 1_000_000)
                    latest = max(latest, at)
                    if not 0 <= seq < MOST:
                        failed = True
                        continue
                    if bits >> seq & 1:
                        continue
                    bits |= 1 << seq
                    failed = failed or event.kind == "error"
                    if seq == 0:
                        model, begun = (event.model, at) if event.kind == "start" and isinstance(event.model, str) else (None, at)
                    if event.kind == "end" and seq >= last:
                        last, ended = seq, at
                    for n, name in enumerate(TOKENS):
                        value = getattr(event, name)
                        if value == value and value is not None and seq >= counts[2 * n]:
                            counts[2 * n : 2 * n + 2] = [seq, int(value)]
            if latest > before:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(latest // 1000 + wait)
            whole = not failed and not done and model is not None and last >= 0 and bits == (1 << (last + 1)) - 1
            if whole:
                done = True
                yield pd.DataFrame({"request_id": [key[0]], "model": [model], "begun": [begun], "ended": [ended], **{t: [counts[2 * n + 1]] for n, t in enumerate(TOKENS)}})
            self.state.update((model, begun, ended, latest, last, failed, done, bits.to_bytes((bits.bit_length() + 7) // 8, "little"), *counts))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            self.state.clear()
            return iter(())

        def close(self) -> None:
            pass

    keyed = events.where("request_id IS NOT NULL").withWatermark("at", watermark)
    out = "request_id string, model string, begun long, ended long, " + ", ".join(f"{t} long" for t in TOKENS)
    found = keyed.groupBy("request_id").transformWithStateInPandas(statefulProcessor=Requests(), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return _record(found.withColumns({"begun": F.timestamp_micros("begun"), "ended": F.timestamp_micros("ended")}))
