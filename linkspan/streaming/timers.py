"""Streams with timers and list state: silences that end without a later frame, and the ring of round trips.

They need a state store with timers: ``spark.sql.streaming.stateStore.providerClass`` must be
Spark's RocksDB provider, which ``use_timers`` sets for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkspan.functions.safety import MAX_RTT_SAMPLE_MS
from linkspan.operators.slot import timeout_ms
from linkspan.operators.telemetry import RTT_RING

_SILENCE = "stream string, last_ms long, timeout_ms long"


def use_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _times(frames: DataFrame, key: str, ts: str) -> tuple[Column, Column]:
    return F.col(key).cast("string").alias("stream"), F.col(ts).cast("timestamp").alias("event_ts")


class Silence(StatefulProcessor):
    """Emits when a stream gave out: its last frame, and when the timeout had passed."""

    def __init__(self, after_ms: int) -> None:
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # nanosecond or microsecond stamps alike
        seen = np.sort(np.concatenate([r["event_ts"].to_numpy().astype("datetime64[ms]").astype(np.int64) for r in rows]))
        before = self.last.get()[0] if self.last.exists() else None
        if before is not None:
            self.handle.deleteTimer(before + self.after_ms + 1)
            seen = np.concatenate(([before], np.maximum(seen, before)))
        gone = np.flatnonzero(np.diff(seen) > self.after_ms)
        now = int(seen[-1])
        self.last.update((now,))
        self.handle.registerTimer(now + self.after_ms + 1)
        yield pd.DataFrame({"stream": [key[0]] * len(gone), "last_ms": seen[gone], "timeout_ms": seen[gone] + self.after_ms})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            last = self.last.get()[0]
            self.last.clear()
            yield pd.DataFrame({"stream": [key[0]], "last_ms": [last], "timeout_ms": [last + self.after_ms]})

    def close(self) -> None:
        pass


def silences(frames: DataFrame, key: str, ts: str, role: str, configured_ms: int, late: str = "0 seconds") -> DataFrame:
    """(stream, last_ms, timeout_ms): each time a stream was silent for longer than its role's timeout, also where no frame has come since.

    A silence without a later frame is told when the watermark, the latest time of all streams less ``late``,
    has passed the timeout; the stream is then forgotten until it begins anew. Rows
    older than the watermark are dropped. The state of a stream is one number and one timer.
    """
    rows = frames.select(*_times(frames, key, ts)).where("stream is not null and event_ts is not null").withWatermark("event_ts", late)
    return rows.groupBy("stream").transformWithStateInPandas(Silence(timeout_ms(role, configured_ms)), _SILENCE, "append", "EventTime")


class Ring(StatefulProcessor):
    """The last plausible round trips of a stream, and their nearest-rank quantiles after each."""

    def __init__(self, size: int, forget_ms: int | None) -> None:
        self.size, self.forget_ms = size, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "ms double", ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["place", "number"])
        held = [x[0] for x in self.samples.get()]
        out: tuple[list, ...] = ([], [], [])
        for sample in new["rtt_ms"]:
            held = [*held, float(sample)][-self.size :]
            ranked = sorted(held)
            for column, value in zip(out, (ranked[int((len(ranked) - 1) * 0.5 + 0.5)], ranked[int((len(ranked) - 1) * 0.99 + 0.5)], held[-1])):
                column.append(value)
        self.samples.put([(x,) for x in held])
        yield pd.DataFrame({"stream": key[0], "number": new["number"].to_numpy(), "rtt_p50_ms": out[0], "rtt_p99_ms": out[1], "rtt_ms": out[2]})

    def close(self) -> None:
        pass


def rtt_ring(frames: DataFrame, key: str, ts: str, number: str, rtt: str, size: int = RTT_RING, forget_ms: int | None = None) -> DataFrame:
    """(stream, number, rtt_p50_ms, rtt_p99_ms, rtt_ms) after each plausible sample, as ``telemetry.rtt_ring`` has them.

    Rows of a batch are taken in order of ``ts`` and ``number``; rows of a later batch come later. The state is a
    stream's last ``size`` samples, which are forgotten ``forget_ms`` after the last of them, if given.
    """
    sample = F.col(rtt)
    good = sample.isNotNull() & ~F.isnan(sample) & (sample > 0) & (sample <= MAX_RTT_SAMPLE_MS)
    rows = frames.where(good & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("stream"), F.unix_micros(F.col(ts).cast("timestamp")).alias("place"), F.col(number).cast("long").alias("number"), sample.cast("double").alias("rtt_ms"))
    return rows.groupBy("stream").transformWithStateInPandas(Ring(size, forget_ms), "stream string, number long, rtt_p50_ms double, rtt_p99_ms double, rtt_ms double", "append", "ProcessingTime" if forget_ms else "None")
