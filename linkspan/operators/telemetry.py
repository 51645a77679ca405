"""Loss, round trips, rates, epochs, sessions and timelines of frame logs.

Each takes the key of a stream and an arrival order. The windows shuffle once on the key;
no state beyond a window's frame is held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from linkspan.functions import wire
from linkspan.functions.safety import backoff_ms, loss_counts, valid_rtt
from linkspan.operators.asof import held, steps  # noqa: F401  steps is for callers' chunks

# Fixed values of the loss and round-trip statistics.
MAX_GAP = 64
RTT_RING = 48


def arrival(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def lost_before(sequence: Column, window: WindowSpec) -> Column:
    """Frames lost before this one: a forward gap of at most 64; anything else is a resync.

    Rows without a sequence, such as control frames, lose none and are passed over: a gap is
    counted from the last row that has one.
    """
    return gap_loss(sequence, F.last(sequence, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1)))


def loss_rate(rx: Column, lost: Column) -> Column:
    return lost / (F.greatest(rx, F.lit(1)) + lost)


def gap_loss(sequence: Column, previous: Column) -> Column:
    """Frames lost between two sequences: a forward gap of at most 64; anything else is a resync."""
    gap = sequence - previous - 1
    return F.when(gap.between(1, MAX_GAP), gap).otherwise(F.lit(0)).cast("bigint")


def link_quality(frames: DataFrame, keys: list[str], order: list[str], sequence: str, window: Column, chunk: Column | None = None) -> DataFrame:
    """Received, lost and loss rate of each stream and reporting window.

    The predecessor of a window's first frame is the stream's last frame before it. ``chunk``, a coarse step of
    the order, cuts a large stream into parts that are worked on apart.
    """
    if chunk is None:
        marked = frames.select(*keys, window.alias("day"), lost_before(F.col(sequence), arrival(keys, order)).alias("lost"))
    else:
        rows = frames.select(*keys, *order, window.alias("day"), F.col(sequence).alias("link_sequence"), chunk.alias("link_chunk"))
        before = held(rows, keys, order, {"previous": F.col("link_sequence")}, F.col("link_chunk"), past=True)
        marked = before.select(*keys, "day", gap_loss(F.col("link_sequence"), F.col("previous")).alias("lost"))
    totals = marked.groupBy(*keys, "day").agg(F.count("*").alias("rx_packets"), F.sum("lost").alias("lost"))
    return totals.withColumn("loss_rate", loss_rate(F.col("rx_packets"), F.col("lost")))


def nearest_rank(values: Column, p: float) -> Column:
    """Value at position round((n - 1) * p), halves upwards, of an array; 0 of an empty one."""
    place = F.floor((F.size(values) - 1) * p + 0.5).cast("int") + 1
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.element_at(F.array_sort(values), F.greatest(place, F.lit(1))))


def rtt_ring(frames: DataFrame, keys: list[str], order: list[str], rtt: str, keep: list[str]) -> DataFrame:
    """After each plausible sample: p50, p99 and last of the stream's last 48 plausible samples."""
    ring = F.collect_list(rtt).over(arrival(keys, order).rowsBetween(1 - RTT_RING, 0))
    return frames.where(valid_rtt(F.col(rtt))).select(*keys, *keep, ring.alias("ring"), F.col(rtt).alias("rtt_ms")).select(*keys, *keep, nearest_rank(F.col("ring"), 0.5).alias("rtt_p50_ms"), nearest_rank(F.col("ring"), 0.99).alias("rtt_p99_ms"), "rtt_ms")


def last_rtt(frames: DataFrame, keys: list[str], order: list[str], rtt: str) -> DataFrame:
    """One row of p50, p99 and last sample for each stream, from its last 48 plausible samples."""
    recent = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    ring = frames.where(valid_rtt(F.col(rtt))).withColumn("place", recent).where(F.col("place") <= RTT_RING)
    # at most 48 rows of a stream get here, so the list is bounded
    return ring.groupBy(*keys).agg(F.collect_list(rtt).alias("ring"), F.min_by(rtt, "place").alias("rtt_ms")).select(*keys, nearest_rank(F.col("ring"), 0.5).alias("rtt_p50_ms"), nearest_rank(F.col("ring"), 0.99).alias("rtt_p99_ms"), "rtt_ms")


def rates(frames: DataFrame, keys: list[str], ts: str, size: Column, seconds: int) -> DataFrame:
    """Packets and bits for each second of fixed windows."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")
    elapsed = max(float(seconds), 0.001)
    return frames.groupBy(*keys, start.alias("window_start")).agg(F.count("*").alias("packets"), F.sum(size).alias("bytes")).withColumn("pps", F.col("packets") / elapsed).withColumn("bps", F.col("bytes") * 8 / elapsed)


def both_rates(tx: DataFrame, rx: DataFrame, keys: list[str], ts: str, size: Column, seconds: int) -> DataFrame:
    """What went each way in fixed windows: packets, bytes, and packets and bits a second; nothing where one side has no frame.

    ``quality_counts`` says whether loss is judged, which takes more than half a packet a second both ways together.
    """
    way = lambda rows, name: rates(rows, keys, ts, size, seconds).select(*keys, "window_start", *(F.col(c).alias(f"{name}_{c}") for c in ("packets", "bytes", "pps", "bps")))
    both = way(tx, "tx").join(way(rx, "rx"), [*keys, "window_start"], "full_outer")
    out = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in both.columns if c not in (*keys, "window_start")})
    return out.withColumn("quality_counts", loss_counts(F.col("rx_pps"), F.col("tx_pps")))


def lifetime(frames: DataFrame, keys: list[str], direction: Column, size: Column, sequence: Column, order: list[str]) -> DataFrame:
    """Each stream's counters: tx and rx packets and bytes, dropped, errors, reconnects and seq_gaps.

    ``direction`` is tx, rx, dropped, error or timeout; other rows count nowhere. A dropped frame
    is neither sent nor received. Gaps are those between received rows with a sequence.
    """
    marked = frames.select(*keys, direction.alias("direction"), size.alias("size"), lost_before(F.when(direction == "rx", sequence), arrival(keys, order)).alias("lost"))
    of = lambda kind: F.count_if(F.col("direction") == kind)
    total = lambda kind: F.sum(F.when(F.col("direction") == kind, F.col("size")).otherwise(0)).cast("bigint")
    return marked.groupBy(*keys).agg(
        of("tx").alias("tx_packets"), of("rx").alias("rx_packets"), total("tx").alias("tx_bytes"), total("rx").alias("rx_bytes"), of("dropped").alias("dropped"), of("error").alias("errors"),
        of("timeout").alias("reconnects"), F.sum("lost").cast("bigint").alias("seq_gaps"),
    )


def drop_plaintext(frames: DataFrame, raw: str, required: Column) -> tuple[DataFrame, DataFrame]:
    """The frames that go on to decoding, and those that are dropped, to be counted, as encryption is required and they have none."""
    gone = wire.plaintext_dropped(F.col(raw), required)
    return frames.where(~gone), frames.where(gone)


def epochs(frames: DataFrame, keys: list[str], order: list[str], peer: str) -> DataFrame:
    """``epoch``: how often the stream's peer has changed so far."""
    w = arrival(keys, order)
    changed = F.coalesce((F.col(peer) != F.lag(peer).over(w)).cast("int"), F.lit(0))
    return frames.withColumn("changed", changed).withColumn("epoch", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("changed")


def epoch_loss(frames: DataFrame, keys: list[str], order: list[str], peer: str, sequence: str, chunk: Column | None = None) -> DataFrame:
    """Lifetime gaps, and the loss that counts: that of the last epoch, as a change of peer zeroes it.

    ``chunk``, a coarse step of the arrival order, cuts a large stream into parts that are worked
    on apart; a part's sums and its first and last frame are all that meets by stream.
    """
    rows = frames.select(*keys, *order, F.col(peer).alias("peer"), F.col(sequence).alias("seq"), (F.lit(0) if chunk is None else chunk).alias("chunk"))
    w = arrival([*keys, "chunk"], order)
    gap = lambda now, before: F.when((now - before - 1).between(1, MAX_GAP), now - before - 1).otherwise(0)
    changed = F.coalesce((F.col("peer") != F.lag("peer").over(w)).cast("int"), F.lit(0))
    marked = rows.withColumn("changed", changed).withColumn("lost", F.when(F.col("changed") == 0, F.coalesce(gap(F.col("seq"), F.lag("seq").over(w)), F.lit(0))).otherwise(0))
    marked = marked.withColumn("epoch", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at, ends = F.struct(*order), F.struct("peer", "seq")
    inner = marked.groupBy(*keys, "chunk", "epoch").agg(F.sum("lost").alias("lost"), F.min_by(ends, at).alias("first"), F.max_by(ends, at).alias("last"))
    parts = inner.groupBy(*keys, "chunk").agg(
        F.max("epoch").alias("changes"), F.sum("lost").alias("lost"), F.max_by("lost", "epoch").alias("tail"), F.min_by("first", "epoch").alias("first"), F.max_by("last", "epoch").alias("last"),
    )
    before = F.lag("last").over(arrival(keys, ["chunk"]))
    joined = parts.withColumn("before", before).withColumn("turned", F.coalesce((F.col("first.peer") != F.col("before.peer")).cast("int"), F.lit(0)))
    joined = joined.withColumn("between", F.when((F.col("turned") == 0) & F.col("before").isNotNull(), gap(F.col("first.seq"), F.col("before.seq"))).otherwise(0))
    # a part with a change in it counts from that change on; the last such part, and all after it, make the last epoch
    since = F.max(F.when(F.col("changes") + F.col("turned") > 0, F.col("chunk"))).over(Window.partitionBy(*keys))
    counted = F.when(since.isNull() | (F.col("chunk") > since), F.col("lost") + F.col("between")).when(F.col("chunk") == since, F.when(F.col("changes") > 0, F.col("tail")).otherwise(F.col("lost"))).otherwise(0)
    return joined.withColumn("counted", counted).groupBy(*keys).agg(
        (F.sum(F.col("changes") + F.col("turned")) + 1).alias("epochs"), F.sum(F.col("lost") + F.col("between")).cast("bigint").alias("seq_gaps"), F.sum("counted").cast("bigint").alias("window_loss"),
    )


def snapshot_windows(rows: DataFrame, keys: list[str], order: list[str], ts: str, is_snapshot: Column, sequence: str, size: Column, epoch: str | None = None) -> DataFrame:
    """What each snapshot reports of the frames since the one before it, which it closes.

    All frames count as received; those without a sequence take no part in loss. Rows are frames and snapshots in arrival order. A window's loss counts only its last epoch's
    frames, if ``epoch`` is given; a gap counts for the window of its later frame. Frames after
    the last snapshot are in none. The first window begins with the stream's first row.
    """
    w = arrival(keys, order)
    marked = rows.select(*keys, *order, F.col(ts).alias("at"), is_snapshot.alias("snapshot"), F.col(sequence).alias("seq"), size.alias("size"), (F.col(epoch) if epoch else F.lit(0)).alias("epoch"))
    marked = marked.withColumn("window", F.sum(F.col("snapshot").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("snapshot").cast("int"))
    frames = marked.where("not snapshot")
    lost = frames.withColumn("lost", lost_before(F.col("seq"), arrival([*keys, "epoch"], order)))
    by_epoch = lost.groupBy(*keys, "window", "epoch").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum("lost").alias("lost"))
    totals = by_epoch.groupBy(*keys, "window").agg(F.sum("n").alias("rx_packets"), F.sum("bytes").alias("bytes"), F.max_by("lost", "epoch").alias("lost"))
    began = F.min(F.when(F.col("window") == 0, F.unix_micros(F.col("at").cast("timestamp")))).over(Window.partitionBy(*keys))
    closed = F.unix_micros(F.col("at").cast("timestamp"))
    reads = marked.withColumn("began", began).where("snapshot").withColumn("began", F.coalesce(F.lag(closed).over(w), F.col("began")))
    both = reads.select(*keys, "window", F.greatest((closed - F.col("began")) / 1e6, F.lit(0.001)).alias("seconds")).join(totals, [*keys, "window"], "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("rx_packets", "bytes", "lost")}
    out = both.withColumns(counts)
    return out.withColumns({"pps": F.col("rx_packets") / F.col("seconds"), "bps": F.col("bytes") * 8 / F.col("seconds"), "loss_rate": loss_rate(F.col("rx_packets"), F.col("lost"))})


def admitted(packets: DataFrame, keys: list[str], order: list[str], ip: str, port: str, role: str, peer: tuple[str, int] | None = None) -> DataFrame:
    """``outcome`` of each packet at the peer slot, ``dropped``, and ``epoch``, how often loss tracking has restarted.

    Learned: the slot was empty. Same and port_changed: the slot's address, with or without its
    port. Of another address: switched, if an agent has a configured peer and the packet comes
    from that port; ignored and dropped, if a peer is configured otherwise; replaced, at a gateway
    without one; passed, at an agent without one, where the slot stays. All but same, ignored and
    passed restart loss tracking. The slot begins with ``peer`` if there is one.
    """
    w = arrival(keys, order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    slot = F.struct(F.col(ip).alias("ip"), F.col(port).alias("port"))
    begin = F.struct(F.lit(peer[0] if peer else None).cast("string").alias("ip"), F.lit(peer[1] if peer else None).cast("int").alias("port"))
    if peer and role == "agent":
        # a packet from the tunnel's port puts its address into the slot, whichever it is
        address = F.coalesce(F.last(F.when(F.col(port) == peer[1], F.col(ip)), ignorenulls=True).over(past), F.lit(peer[0]))
        taken = (F.col(ip) == F.col("slot_ip")) | (F.col(port) == peer[1])
    elif peer:
        address, taken = F.lit(peer[0]), F.col(ip) == F.col("slot_ip")
    elif role == "gateway":
        address, taken = F.lag(ip).over(w), F.lit(True)
    else:
        address, taken = F.first(ip).over(past), F.col("slot_ip").isNull() | (F.col(ip) == F.col("slot_ip"))
    rows = packets.withColumn("slot_ip", address).withColumn("taken", taken)
    rows = rows.withColumn("slot", F.coalesce(F.last(F.when(F.col("taken"), slot), ignorenulls=True).over(past), begin))
    other = F.col(ip) != F.col("slot_ip")
    outcome = (
        F.when(F.col("slot_ip").isNull(), "learned").when(other & F.col("taken"), F.lit("switched" if peer else "replaced")).when(other, F.lit("ignored" if peer else "passed"))
        .when(F.col(port) != F.col("slot.port"), "port_changed").otherwise("same")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("dropped", F.col("outcome") == "ignored")
    restarts = F.col("outcome").isin("learned", "switched", "replaced", "port_changed").cast("int")
    return rows.withColumn("epoch", F.sum(restarts).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("slot_ip", "slot", "taken")


def with_timeouts(frames: DataFrame, keys: list[str], order: list[str], ts: str, kind: str, seconds: int, chunk: Column | None = None) -> DataFrame:
    """The frames and, ahead of each that came after a longer silence, a row of the kind ``timeout``; ``step`` orders these two.

    A column ``step`` of the frames is replaced; others may have any names. ``chunk`` as in ``asof.held``.
    """
    kept = [c for c in frames.columns if c != "step"]
    now = lambda of: F.unix_micros(of.cast("timestamp"))
    rows = frames.select(*(F.col(f"`{c}`") for c in kept))
    packed = held(rows.select(F.struct(*kept).alias("row"), *(F.col(f"`{k}`").alias(f"stream{i}") for i, k in enumerate(keys)), *(F.col(f"`{o}`").alias(f"place{i}") for i, o in enumerate(order)), now(F.col(f"`{ts}`")).alias("now"), (F.lit(0) if chunk is None else chunk).alias("of_step")),
                  [f"stream{i}" for i in range(len(keys))], [f"place{i}" for i in range(len(order))], {"before": F.col("now")}, None if chunk is None else F.col("of_step"), past=True)
    own = F.col("row")[kind]
    silent = F.col("now") - F.col("before") > seconds * 1_000_000
    lines = packed.select("row", F.posexplode(F.when(silent, F.array(F.lit("timeout"), own)).otherwise(F.array(own))).alias("step", "line"))
    return lines.select(*(F.col("line").alias(c) if c == kind else F.col("row")[c].alias(c) for c in kept), "step")


def connection_states(rows: DataFrame, keys: list[str], order: list[str], role: str, chunk: Column | None = None) -> DataFrame:
    """The state after each row: connection, laptop, link_up, awake, message, rtt_local, rtt_peer, reconnects.

    Rows have kind (ethernet, keepalive, hello, status, safety_probe, goodbye, ack, timeout) and,
    for their kinds, is_reply, rtt, vehicle_link, vehicle_awake and peer_rtt. Each field holds
    what was last assigned to it: a window over the past, without any state but Spark's. A
    gateway takes the vehicle's flags from the laptop's status, and takes its data as a sign
    of life while the link is up; a goodbye or timeout clears them. ``chunk``, a coarse step of the order
    made of the rows' columns, cuts a large stream into parts that are worked on apart.
    """
    kind = F.col("kind")
    live, control = kind.isin("ethernet", "keepalive", "hello", "status", "safety_probe"), kind.isin("hello", "status", "safety_probe")
    lost, gateway = kind.isin("goodbye", "timeout"), F.lit(role == "gateway")
    timed_out = F.lit("Reconnecting" if role == "gateway" else "Failed")
    begin = {"connection": "WaitingForPeer", "laptop": False, "link_up": False, "message": "starting", "rtt_local": 0.0, "rtt_peer": 0.0}
    given = {
        "connection": F.when(live, "Connected").when(kind == "goodbye", "Reconnecting").when(kind == "timeout", timed_out),
        "laptop": F.when(live, True).when(lost, False),
        "link_up": F.when(gateway & (kind == "status"), F.col("vehicle_link")).when(gateway & lost, False),
        "message": F.when((kind == "ethernet") | control, "connected").when(kind == "goodbye", "peer_disconnected").when(kind == "timeout", "peer_timeout"),
        "rtt_local": F.when((kind == "keepalive") & F.col("is_reply") & (F.col("rtt") > 0), F.col("rtt")),
        "rtt_peer": F.when(gateway & (kind == "status") & (F.col("peer_rtt") > 0) & ~F.isnan("peer_rtt") & (F.col("peer_rtt") < float("inf")), F.col("peer_rtt")),
    }
    out = held(rows, keys, order, given, chunk, counts={"reconnects": kind == "timeout"})
    out = out.withColumns({name: F.coalesce(name, F.lit(first)) for name, first in begin.items()})
    awake = F.when(gateway & (kind == "status"), F.col("vehicle_awake")).when(gateway & lost, False).when(gateway & (kind == "ethernet") & F.col("link_up"), True)
    return held(out, keys, order, {"awake": awake}, chunk).withColumn("awake", F.coalesce("awake", F.lit(False)))


def timeouts(frames: DataFrame, keys: list[str], order: list[str], ts: str, seconds: int) -> DataFrame:
    """How often a stream was silent for longer than the timeout, and its longest silence."""
    silent = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(arrival(keys, order))
    return frames.select(*keys, silent.alias("silent")).groupBy(*keys).agg(F.count_if(F.col("silent") > seconds * 1_000_000).alias("reconnects"), F.coalesce(F.max("silent"), F.lit(0)).alias("longest_us"))


def reconnects(rows: DataFrame, keys: list[str], order: list[str], ts: str, kind: str, base_ms: int, most_ms: int, unset_ms: int = 2000) -> DataFrame:
    """``attempt`` of each row, the delay after it, when the next attempt is due, and whether this one came too early.

    Kinds: failed, an attempt that came to nothing; connected, one that did; dropped, the end of a
    connection; unset, an attempt that settings do not allow; changed, new settings, which end a connection
    and are tried at once. An attempt's number is how many failed, dropped and unset rows there
    are since the last connection; a connection begins it anew. What delays doubles from ``base_ms`` on up to ``most_ms``, and is
    ``unset_ms`` for unset. Attempts are all but dropped and changed rows.
    """
    w = arrival(keys, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    counts = F.col(kind).isin("failed", "dropped", "unset").cast("int")
    rows = rows.withColumn("attempt_run", F.sum((F.col(kind) == "connected").cast("int")).over(so_far))
    in_run = Window.partitionBy(*keys, "attempt_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("attempt", F.sum(counts).over(in_run).cast("bigint")).drop("attempt_run")
    wait = F.when(F.col(kind) == "unset", F.lit(unset_ms).cast("bigint")).when(F.col(kind).isin("failed", "dropped"), backoff_ms(F.lit(base_ms).cast("bigint"), F.lit(most_ms).cast("bigint"), F.col("attempt"))).otherwise(F.lit(0).cast("bigint"))
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = rows.withColumn("delay_ms", wait).withColumn("due_us", now + F.col("delay_ms") * 1000)
    tried = F.col(kind).isin("failed", "connected", "unset")
    return rows.withColumn("early", tried & F.coalesce(now < F.lag("due_us").over(w), F.lit(False)))


def awake_sessions(frames: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    """Sessions that end when nothing has come for ``gap``."""
    return frames.groupBy(*keys, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("frames"), F.max(ts).alias("last_ts")).select(*keys, F.col("s.start").alias("session_start"), "last_ts", "frames")


def timeline(states: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Activity rows (level, message code) from changes of connection, laptop, link, awake and peer.

    Before the first state the connection is Starting and the flags are false. An empty peer
    neither is a change nor is remembered.
    """
    w = arrival(keys, order)
    before = lambda c, first: F.lag(c, 1, first).over(w)
    peer = F.nullif(F.coalesce("peer", F.lit("")), F.lit(""))
    last_peer = F.last(peer, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    row = lambda level, code: F.struct(F.lit(level).alias("level"), code.alias("message"))

    def edge(flag: str, up: tuple[str, str], down: tuple[str, str]) -> Column:
        was = before(flag, False)
        return F.when(F.col(flag) & ~was, row(up[0], F.lit(up[1]))).when(~F.col(flag) & was, row(down[0], F.lit(down[1])))

    lines = F.array(
        F.when(F.col("connection") != before("connection", "Starting"), row("info", F.concat(F.lit("state:"), "connection"))), edge("laptop", ("info", "laptop_on"), ("warn", "laptop_off")),
        F.when(peer.isNotNull() & ~peer.eqNullSafe(last_peer), row("info", F.concat(F.lit("peer:"), peer))), edge("link_up", ("info", "link_on"), ("warn", "link_off")), edge("awake", ("info", "awake"), ("info", "asleep")),
    )
    return states.select(*keys, *order, lines.alias("lines")).select(*keys, *order, F.posexplode(F.array_compact("lines")).alias("line_no", "line")).select(*keys, *order, "line_no", "line.level", "line.message")


def changed_lines(rows: DataFrame, keys: list[str], order: list[str], line: str) -> DataFrame:
    """Rows whose line differs from the one before."""
    return rows.withColumn("before", F.lag(line).over(arrival(keys, order))).where(~F.col(line).eqNullSafe(F.col("before"))).drop("before")


def last_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key; Spark limits each task's rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def assign_sequence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``sequence`` from 1 on, one counter for all frame types of a sender."""
    return rows.withColumn("sequence", F.row_number().over(arrival(keys, order)))
