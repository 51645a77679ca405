"""Streaming forms against their batch forms over the same rows."""

import pytest
from pyspark.sql import functions as F

from linkspan.operators import matching, slot, telemetry
from linkspan.streaming import telemetry as streams
from linkspan.streaming import timers


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    """The events in arrival order, dealt over files that are read one for each batch."""
    import os
    import time

    folder = tmp_path_factory.mktemp("events")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").toPandas()
    step = -(-len(rows) // 3)
    for k in range(3):
        rows.iloc[k * step : (k + 1) * step].to_parquet(folder / f"{k}.parquet", coerce_timestamps="us", index=False)
        os.utime(folder / f"{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    return str(folder)


def run(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_loss(spark, files, tmp_path):
    batch = spark.read.parquet(files)
    out = run(streams.loss(streams.read_events(spark, files, batch.schema), "user_id", "event_id", ["ts", "event_id"]), "update", tmp_path, "loss_out")
    lost = telemetry.lost_before(F.col("event_id"), telemetry.arrival(["user_id"], ["ts", "event_id"]))
    want = batch.select("user_id", lost.alias("l")).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("l").alias("l"))
    assert {tuple(r) for r in out.groupBy("user_id").agg(F.max("rx_packets"), F.max("lost")).collect()} == {tuple(r) for r in want.collect()}


def test_rates_and_sessions(spark, files, tmp_path):
    batch = spark.read.parquet(files)
    stream = streams.read_events(spark, files, batch.schema)
    hours = run(streams.rates(stream, "user_id", "ts", 3600, "0 seconds"), "append", tmp_path, "rates_out").collect()
    want = {(r.user_id, r.window_start): r.packets for r in telemetry.rates(batch, ["user_id"], "ts", F.lit(1), 3600).collect()}
    assert hours and all(want[(r.user_id, r.window_start)] == r.packets for r in hours)
    sessions = run(streams.awake_sessions(stream, "user_id", "ts", "6 hours", "0 seconds"), "append", tmp_path, "sessions_out").collect()
    closed = {(r.user_id, r.session_start): r.frames for r in telemetry.awake_sessions(batch, ["user_id"], "ts", "6 hours").collect()}
    assert sessions and all(closed[(r.user_id, r.session_start)] == r.frames for r in sessions)


def test_pairing(spark, files, tmp_path):
    batch = spark.read.parquet(files)
    role = F.when(F.col("event_type") == "view", "gateway").when(F.col("event_type") == "click", "agent").otherwise("other")
    joins = lambda df: df.select(F.col("user_id").alias("room"), F.col("event_id"), role.alias("role"))
    out = run(streams.pair_rooms(joins(streams.read_events(spark, files, batch.schema)), "room", "role", "event_id"), "append", tmp_path, "rooms_out")
    want = matching.pair_rooms(joins(batch), "room", "role", ["event_id"])
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize(("role", "peer"), [("agent", ("10.0.0.0", 47901)), ("gateway", ("10.0.0.0", 47901)), ("gateway", None), ("agent", None)])
def test_admission(spark, files, tmp_path, role, peer):
    """The stream's fold, row by row, against the batch operator's windows."""
    packets = lambda df: df.select("user_id", "event_id", F.concat(F.lit("10.0.0."), F.col("event_id") % 3).alias("ip"), (F.expr("event_id div 3 % 3") + 47900).cast("int").alias("port"))
    batch = spark.read.parquet(files)
    stream = packets(streams.read_events(spark, files, batch.schema))
    out = run(streams.admitted(stream, "user_id", "event_id", "ip", "port", role, peer), "append", tmp_path, f"admitted_{role}_{bool(peer)}")
    want = telemetry.admitted(packets(batch), ["user_id"], ["event_id"], "ip", "port", role, peer).select("user_id", "event_id", "outcome", "epoch")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()}
    assert len({r.outcome for r in want.select("outcome").distinct().collect()}) >= 3


@pytest.mark.parametrize("role", ["gateway", "agent"])
def test_connection(spark, files, tmp_path, role):
    kinds = F.array(*map(F.lit, ["ethernet", "keepalive", "hello", "status", "goodbye", "timeout", "ack", "safety_probe", "status"]))
    n = F.col("event_id")
    frames = lambda df: df.select(
        "user_id", "event_id", F.element_at(kinds, (F.expr("(event_id * 7 + event_id div 5) % 9") + 1).cast("int")).alias("kind"), (n % 2 == 0).alias("is_reply"), (n % 5).cast("double").alias("rtt"),
        (n % 3 > 0).alias("vehicle_link"), (n % 4 == 0).alias("vehicle_awake"), (n % 6).cast("double").alias("peer_rtt"),
    )
    batch = spark.read.parquet(files)
    out = run(streams.connection_states(frames(streams.read_events(spark, files, batch.schema)), "user_id", "event_id", role), "append", tmp_path, f"connection_{role}")
    want = telemetry.connection_states(frames(batch), ["user_id"], ["event_id"], role).select(*out.columns)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize(("role", "peer"), [("agent", ("10.0.0.0", 47901)), ("gateway", ("10.0.0.0", 47901)), ("gateway", None), ("agent", None)])
def test_admission_with_timeouts(spark, files, tmp_path, role, peer):
    """Slots that a day's silence empties, over several batches and in one; rows without address or port among them."""
    n = F.col("event_id")
    packets = lambda df: df.select("user_id", "ts", "event_id", F.when(n % 11 > 0, F.concat(F.lit("10.0.0."), n % 3)).alias("ip"), F.when(n % 13 > 0, (F.expr("event_id div 3 % 3") + 47900)).cast("int").alias("port"))
    batch = spark.read.parquet(files)
    stream = packets(streams.read_events(spark, files, batch.schema))
    out = run(streams.admitted(stream, "user_id", "event_id", "ip", "port", role, peer, ts="ts", after_ms=86_400_000), "append", tmp_path, f"slots_{role}_{bool(peer)}")
    want = slot.admitted(packets(batch), ["user_id"], ["event_id"], "ts", "ip", "port", role, peer, 86_400_000)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.select("user_id", "event_id", "outcome", "epoch").collect()}
    assert want.agg(F.max("timeouts")).first()[0] > 0


def test_silences(spark, files, tmp_path):
    """Every silence of over eight hours, the last of each stream included, which no frame ends."""
    timers.use_timers(spark)
    batch = spark.read.parquet(files)
    out = run(timers.silences(streams.read_events(spark, files, batch.schema), "user_id", "ts", "agent", 8 * 3_600_000), "append", tmp_path, "silences_out")
    want = slot.silences(batch, "user_id", "ts", "agent", 8 * 3_600_000)
    found = {tuple(r) for r in out.collect()}
    assert found == {tuple(r) for r in want.collect()} and found
    last = {str(r[0]): r[1] for r in batch.groupBy("user_id").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).collect()}
    assert any(last[s] == ms for s, ms, _ in found)


def test_ring(spark, files, tmp_path):
    """The ring of samples over several batches against the batch operator's window."""
    timers.use_timers(spark)
    batch = spark.read.parquet(files)
    out = run(timers.rtt_ring(streams.read_events(spark, files, batch.schema), "user_id", "ts", "event_id", "value", size=48), "append", tmp_path, "ring_out")
    want = telemetry.rtt_ring(batch, ["user_id"], ["ts", "event_id"], "value", ["event_id"])
    assert {(int(r[0]), *r[1:]) for r in out.collect()} == {tuple(r) for r in want.collect()}
