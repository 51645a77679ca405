"""Streaming forms: loss, admission, connection and pairing with keyed state, windowed rates, sessions.

The state of a key is a few numbers. It is kept for ever, or, with ``forget_ms``, until nothing
has come for that long by the clock of the machine; the key then begins anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkspan.operators.slot import Slot
from linkspan.operators.telemetry import MAX_GAP


def read_events(spark, folder: str, schema, max_files: int = 1) -> DataFrame:
    """Parquet files of frame rows as a stream, few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def _stateful(frames: DataFrame, key: str, order: list[str], step: Callable, out: str, kept: str, mode: str, forget_ms: int | None) -> DataFrame:
    """Apply ``step(key, rows of a batch in order, state or None) -> (output, state)`` to each key."""

    def run(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        result, new = step(keys[0], pd.concat(list(chunks)).sort_values(order), state.get if state.exists else None)
        state.update(new)
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield result

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    return frames.groupBy(key).applyInPandasWithState(run, out, kept, mode, timeout)


def loss(frames: DataFrame, key: str, sequence: str, order: list[str], forget_ms: int | None = None) -> DataFrame:
    """Running (received, lost) of each key after each batch, in update mode.

    The state is the last sequence and two counters. Rows are taken in arrival order within a
    batch; a row of a later batch arrives later, whatever its time stamp says.
    """

    def step(owner: object, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        previous, rx, lost = state or (None, 0, 0)
        numbers = rows[sequence]
        gaps = numbers.diff() - 1
        if previous is not None:
            gaps.iloc[0] = numbers.iloc[0] - previous - 1
        lost += int(gaps[gaps.between(1, MAX_GAP)].sum())
        rx += len(numbers)
        return pd.DataFrame({key: [owner], "rx_packets": [rx], "lost": [lost]}), (int(numbers.iloc[-1]), rx, lost)

    return _stateful(frames, key, order, step, f"{key} long, rx_packets long, lost long", "previous long, rx long, lost long", "update", forget_ms)


def admitted(packets: DataFrame, key: str, order: str, ip: str, port: str, role: str, peer: tuple[str, int] | None = None, forget_ms: int | None = None, ts: str | None = None, after_ms: int | None = None) -> DataFrame:
    """Outcome of each packet at the peer slot, and the epoch, as the batch operators of this name have them.

    With ``ts`` and ``after_ms`` a slot that has admitted nothing for longer is empty, as in ``slot.admitted``.
    """
    columns = [key, order, ip, port] + ([ts] if ts else [])
    rows = packets.select(*columns).withColumn("at_us", F.unix_micros(F.col(ts).cast("timestamp")) if ts else F.lit(None).cast("long"))

    def step(owner: object, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        none = lambda x: None if pd.isna(x) else x
        now = Slot(*(none(x) for x in state)) if state else Slot(*(peer or (None, None)))
        outcomes, epochs = [], []
        for at, address, door in zip(rows["at_us"], rows[ip], rows[port]):
            at, door = none(at), none(door)
            outcomes.append(now.take(role, peer, None if after_ms is None else after_ms * 1000, None if at is None else int(at), none(address), None if door is None else int(door)))
            epochs.append(now.epoch)
        return pd.DataFrame({key: owner, order: rows[order].to_numpy(), "outcome": outcomes, "epoch": epochs}), (now.ip, now.port, now.last_us, now.epoch, now.timeouts)

    return _stateful(rows, key, [order], step, f"{key} long, {order} long, outcome string, epoch long", "ip string, port int, last_us long, epoch long, timeouts long", "append", forget_ms)


def connection_states(frames: DataFrame, key: str, order: str, role: str, forget_ms: int | None = None) -> DataFrame:
    """The state after each frame or timeout row, as the batch operator of this name has it."""
    live, control = ("ethernet", "keepalive", "hello", "status", "safety_probe"), ("hello", "status", "safety_probe")
    given = lambda x: not pd.isna(x) and x
    fields = ["connection", "laptop", "link_up", "awake", "message", "rtt_local", "rtt_peer", "reconnects"]

    def step(owner: object, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        now = dict(zip(fields, state or ("WaitingForPeer", False, False, False, "starting", 0.0, 0.0, 0)))
        out = []
        for row in rows.to_dict("records"):
            kind = row["kind"]
            if kind in live:
                now |= {"connection": "Connected", "laptop": True}
            if kind in control or kind == "ethernet":
                now["message"] = "connected"
            if kind == "keepalive" and given(row["is_reply"]) and given(row["rtt"]) and row["rtt"] > 0:
                now["rtt_local"] = float(row["rtt"])
            if kind in ("goodbye", "timeout"):
                now |= {"laptop": False, "message": "peer_disconnected" if kind == "goodbye" else "peer_timeout"}
                now["connection"] = "Failed" if kind == "timeout" and role != "gateway" else "Reconnecting"
                now["reconnects"] += kind == "timeout"
            if role == "gateway":
                if kind == "status":
                    # a flag that the status lacks stays as it was
                    now |= {name: bool(row[field]) for name, field in (("link_up", "vehicle_link"), ("awake", "vehicle_awake")) if not pd.isna(row[field])}
                    if given(row["peer_rtt"]) and 0 < row["peer_rtt"] < float("inf"):
                        now["rtt_peer"] = float(row["peer_rtt"])
                elif kind in ("goodbye", "timeout"):
                    now |= {"link_up": False, "awake": False}
                elif kind == "ethernet" and now["link_up"]:
                    now["awake"] = True
            out.append({key: owner, order: row[order], **now})
        return pd.DataFrame(out), tuple(now[f] for f in fields)

    kinds = "connection string, laptop boolean, link_up boolean, awake boolean, message string, rtt_local double, rtt_peer double, reconnects long"
    return _stateful(frames, key, [order], step, f"{key} long, {order} long, {kinds}", kinds, "append", forget_ms)


def rates(frames: DataFrame, key: str, ts: str, seconds: int, late: str) -> DataFrame:
    """Packets of fixed windows, emitted when the watermark has passed them."""
    timed = frames.withColumn("event_ts", F.col(ts).cast("timestamp")).withWatermark("event_ts", late)
    return timed.groupBy(key, F.window("event_ts", f"{seconds} seconds")).agg(F.count("*").alias("packets")).select(key, F.col("window.start").alias("window_start"), "packets")


def awake_sessions(frames: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after ``gap`` of silence; sessions still open at the end are not emitted."""
    timed = frames.withColumn("event_ts", F.col(ts).cast("timestamp")).withWatermark("event_ts", late)
    return timed.groupBy(key, F.session_window("event_ts", gap).alias("s")).agg(F.count("*").alias("frames")).select(key, F.col("s.start").alias("session_start"), "frames")


def pair_rooms(joins: DataFrame, room: str, role: str, order: str, forget_ms: int | None = None) -> DataFrame:
    """Outcomes of joins (waiting, duplicate, paired), with the waiting role of each room as state."""

    def step(owner: object, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        held, out = state[0] if state else "", []
        for role_now in rows[role]:
            if role_now not in ("gateway", "agent") or held == role_now:
                out.append("duplicate")
            elif held:
                held = ""
                out.append("paired")
            else:
                held = role_now
                out.append("waiting")
        return pd.DataFrame({room: owner, order: rows[order].to_numpy(), role: rows[role].to_numpy(), "outcome": out}), (held,)

    return _stateful(joins, room, [order], step, f"{room} long, {order} long, {role} string, outcome string", "held string", "append", forget_ms)
