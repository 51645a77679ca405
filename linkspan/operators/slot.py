"""The peer slot of a tunnel: which packets it admits, and how silence empties it.

The slot is a fold: whether a packet is admitted depends on the slot, and how long the slot has
been silent on which packets were. Only admitted packets break a silence. A stream's rows are
sorted and pass through one task, which keeps a few numbers of it; streams run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspan.operators.asof import held

# The least time, in ms, before a silent peer is given up, by role.
LEAST_TIMEOUT_MS = {"agent": 20_000, "gateway": 1_000, "relay": 15_000}

#: Outcomes after which loss is tracked anew.
RESTARTS = ("learned", "switched", "replaced", "port_changed")


def timeout_ms(role: str, configured_ms: int) -> int:
    """When a silent peer is given up: what is configured, but not before the role's least time."""
    return max(configured_ms, LEAST_TIMEOUT_MS[role])


@dataclass
class Slot:
    """The slot's address and port, both None if it is empty, when it last admitted a packet, and what has been counted."""

    ip: str | None = None
    port: int | None = None
    last_us: int | None = None
    epoch: int = 0
    timeouts: int = 0

    def take(self, role: str, peer: tuple[str, int] | None, after_us: int | None, at_us: int | None, ip: str | None, port: int | None) -> str | None:
        """The outcome of a packet. Without an address or port it is none, and changes nothing."""
        if self.last_us is None:
            self.last_us = at_us
        if after_us is not None and self.ip is not None and None not in (at_us, self.last_us) and at_us - self.last_us > after_us:
            self.ip = self.port = None
            self.timeouts += 1
        if ip is None or port is None:
            return None
        if self.ip is None:
            outcome = "learned"
        elif ip == self.ip:
            outcome = "same" if port == self.port else "port_changed"
        elif peer:
            outcome = "switched" if role == "agent" and port == peer[1] else "ignored"
        else:
            outcome = "replaced" if role == "gateway" else "passed"
        if outcome not in ("ignored", "passed"):
            self.ip, self.port = ip, port
        if outcome != "ignored":
            self.last_us = at_us
        self.epoch += outcome in RESTARTS
        return outcome


_ADDED = (("outcome", T.StringType(), pa.string()), ("dropped", T.BooleanType(), pa.bool_()), ("epoch", T.LongType(), pa.int64()), ("timeouts", T.LongType(), pa.int64()), ("peer_ip", T.StringType(), pa.string()), ("peer_port", T.IntegerType(), pa.int32()))


def admitted(packets: DataFrame, keys: list[str], order: list[str], ts: str, ip: str, port: str, role: str, peer: tuple[str, int] | None = None, after_ms: int | None = None) -> DataFrame:
    """Each packet with its outcome, dropped, epoch, timeouts so far, and the slot's peer_ip and peer_port after it.

    Outcomes are those of ``telemetry.admitted``. A slot that has admitted nothing for longer than
    ``after_ms`` is empty, a configured ``peer`` included, so that the next packet is learned, from
    wherever it comes; a stream's time begins with its first row. Without ``after_ms`` slots stay.
    Rows without address or port have no outcome and are not dropped. Columns that ``packets``
    have by the added names are replaced.
    """
    added = [a for a, _, _ in _ADDED]
    kept = [c for c in packets.columns if c not in added]
    rows = packets.select(*(F.col(f"`{c}`") for c in kept))
    sides = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.struct(*(F.col(f"`{k}`") for k in keys)).alias("stream"), F.struct(*(F.col(f"`{o}`") for o in order)).alias("place"), F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("at"), F.col(f"`{ip}`").cast("string").alias("ip"), F.col(f"`{port}`").cast("int").alias("port"))
    numbered = sides.withColumn("stream", F.to_json("stream", {"ignoreNullFields": "false"})).repartition("stream").sortWithinPartitions("stream", "place").select("row", "stream", "at", "ip", "port")
    schema = T.StructType([T.StructField("row", numbered.schema["row"].dataType), *(T.StructField(n, t) for n, t, _ in _ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, slot = None, Slot()
        for batch in batches:
            found: tuple[list, ...] = tuple([] for _ in _ADDED)
            for owner, at, address, door in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                if owner != stream or stream is None:
                    stream, slot = owner, Slot(*(peer or (None, None)))
                outcome = slot.take(role, peer, None if after_ms is None else after_ms * 1000, at, address, door)
                for column, value in zip(found, (outcome, outcome == "ignored", slot.epoch, slot.timeouts, slot.ip, slot.port)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, _, k) in zip(found, _ADDED))], names=["row", *added])

    return numbered.mapInArrow(run, schema).select(*(F.col("row")[c].alias(c) for c in kept), *added)


def silences(frames: DataFrame, key: str, ts: str, role: str, configured_ms: int, until_ms: int | None = None) -> DataFrame:
    """(stream, last_ms, timeout_ms): each time a stream was silent for longer than its role's timeout.

    The last silence of a stream lasts until ``until_ms``, where observation ends, or, if that is not given, until the
    latest row of all streams. Rows without key or time are left out. Times are in whole milliseconds.
    """
    after = timeout_ms(role, configured_ms)
    rows = frames.select(F.col(key).cast("string").alias("stream"), F.unix_millis(F.col(ts).cast("timestamp")).alias("last_ms")).where("stream is not null and last_ms is not null")
    following = F.lead("last_ms").over(Window.partitionBy("stream").orderBy("last_ms"))
    ended = rows.withColumn("next_ms", following)
    end = rows.agg(F.max("last_ms").alias("end_ms")) if until_ms is None else rows.sparkSession.range(1).select(F.lit(until_ms).cast("long").alias("end_ms"))
    # the end is one row
    judged = ended.join(F.broadcast(end), F.lit(True)).where(F.coalesce("next_ms", "end_ms") - F.col("last_ms") > after)
    return judged.select("stream", "last_ms", (F.col("last_ms") + after).alias("timeout_ms"))


def peer_endpoint(admitted_rows: DataFrame, keys: list[str], order: list[str], kind: str, chunk: Column | None = None) -> DataFrame:
    """``peer_endpoint`` after each row of ``admitted``: the address and port that the state shows, null while there is none.

    A packet that takes or keeps the slot sets it, a goodbye or timeout (``kind``) clears it, though the slot may keep its
    peer after a goodbye; ignored and passed packets leave it. ``chunk`` as in ``asof.held``.
    """
    shown = F.when(F.col(kind).isin("goodbye", "timeout"), F.lit("")).when(F.col("outcome").isin("same", *RESTARTS), F.concat_ws(":", "peer_ip", "peer_port"))
    rows = held(admitted_rows, keys, order, {"peer_endpoint": shown}, chunk)
    return rows.withColumn("peer_endpoint", F.nullif("peer_endpoint", F.lit("")))
