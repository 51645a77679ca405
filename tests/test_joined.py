"""As-of joins, slots, counters, adapters and attempts against plain replays."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkspan.functions import safety
from linkspan.operators import asof, matching, slot, telemetry

BEGIN = datetime(2024, 1, 1)


def stamps(rng, n, seconds=500):
    return [BEGIN + timedelta(seconds=rng.randrange(seconds)) for _ in range(n)]


@pytest.mark.parametrize("step", [None, 1, 60, 100_000])
@pytest.mark.parametrize("most", [None, 20])
def test_as_of(spark, step, most):
    rng = random.Random(1)
    left = [(k, t, i, f"x{i}", "old") for i, (k, t) in enumerate(zip(rng.choices([1, 2, 3, None], k=200), [*stamps(rng, 198), None, None]))]
    right = [(k, t, i, rng.choice([None, i])) for i, (k, t) in enumerate(zip(rng.choices([1, 2, None], k=120), stamps(rng, 120)))]
    # names that the operator uses itself, and one that it replaces
    a = spark.createDataFrame(left, "key long, ts timestamp_ntz, side long, row string, value string").repartition(3)
    b = spark.createDataFrame(right, "key long, ts timestamp_ntz, number long, value long")
    found = asof.as_of(a, b, ["key"], "ts", ["value"], ("number",), most, step)
    want = Counter()
    for k, t, i, x, _ in left:
        before = [(s, n, v) for m, s, n, v in right if m == k and t is not None and s <= t]
        best = max(before, key=lambda r: r[:2], default=None)
        want[k, t, i, x, best[2] if best and (most is None or (t - best[0]).total_seconds() <= most) else None] += 1
    assert found.columns == ["key", "ts", "side", "row", "value"]
    assert Counter(map(tuple, found.collect())) == want
    assert asof.as_of(a, b.limit(0), ["key"], "ts", ["value"], step_seconds=step).where("value is not null").count() == 0
    assert asof.as_of(a.limit(0), b, ["key"], "ts", ["value"], step_seconds=step).count() == 0


@pytest.mark.parametrize("step", [None, 30])
def test_agent_vehicle(spark, step):
    rng = random.Random(2)
    frames = sorted({(k, t): (k, t, i, rng.choice(["captured", "tick", "tick", "other"])) for i, (k, t) in enumerate(zip(rng.choices([1, 2, 3], k=300), stamps(rng, 300)))}.values(), key=lambda r: (r[1], r[2]))
    links = list({(k, t): (k, t, rng.random() < 0.7) for k, t in zip(rng.choices([1, 2], k=60), stamps(rng, 60))}.values())
    got = asof.agent_vehicle(spark.createDataFrame(frames, "k long, ts timestamp_ntz, n long, kind string"), spark.createDataFrame(links, "k long, ts timestamp_ntz, link_up boolean"), ["k"], ["ts", "n"], "ts", "kind", 10, step)
    state, want = {}, {}
    for k, t, n, kind in frames:
        up, awake, active = state.get(k, (False, False, None))
        if kind == "captured":
            awake, active = awake or up, t
        if kind == "tick":
            up = max(((s, u) for m, s, u in links if m == k and s <= t), default=(None, False))[1]
            if not up or active and (t - active).total_seconds() > 10:
                awake = False
        state[k] = up, awake, active
        want[n] = up, awake
    assert {r.n: (r.link_up, r.awake) for r in got.collect()} == want
    assert len(set(want.values())) >= 3


def test_silence_empties_the_slot(spark):
    """After hours the packet of the same peer is learned again; packets that are ignored do not break the silence."""
    at = lambda *minutes: [BEGIN + timedelta(minutes=m) for m in minutes]
    rows = [(1, t, i, ip, 5) for i, (t, ip) in enumerate(zip(at(0, 1, 200, 201), ["a", "a", "a", "b"]))]
    rows += [(2, t, i, ip, 5) for i, (t, ip) in enumerate(zip(at(0, 1, 30, 50, 70, 71), ["p", "p", "z", "z", "z", "p"]))]
    rows += [(3, None, 0, "a", 1), (3, BEGIN, 1, None, 1), (3, BEGIN, 2, "a", None), (3, BEGIN, 3, "a", 1), (None, BEGIN, 0, "a", 1)]
    table = spark.createDataFrame(rows, "stream long, ts timestamp_ntz, row long, ip string, port int").withColumn("outcome", F.lit("x"))
    take = lambda role, peer: {(r.stream, r.row): (r.outcome, r.epoch, r.timeouts, r.peer_ip) for r in slot.admitted(table, ["stream"], ["ts", "row"], "ts", "ip", "port", role, peer, 3_600_000).collect()}
    free, bound = take("gateway", None), take("gateway", ("p", 5))
    assert [free[1, i][0] for i in range(4)] == ["learned", "same", "learned", "replaced"] and free[1, 3][1:] == (3, 1, "b")
    # an hour after p's last packet the slot is empty: z, which was ignored before, is learned, and p is not
    assert [bound[2, i] for i in range(6)] == [("same", 0, 0, "p"), ("same", 0, 0, "p"), ("ignored", 0, 0, "p"), ("ignored", 0, 0, "p"), ("learned", 1, 1, "z"), ("ignored", 1, 1, "z")]
    assert [free[3, i][0] for i in range(4)] == ["learned", None, None, "same"] and free[None, 0][0] == "learned"
    same = slot.admitted(table, ["stream"], ["ts", "row"], "ts", "ip", "port", "agent", None)
    assert same.where("timeouts > 0").count() == 0 and same.columns[-6:] == ["outcome", "dropped", "epoch", "timeouts", "peer_ip", "peer_port"]
    assert slot.admitted(table.limit(0), ["stream"], ["ts", "row"], "ts", "ip", "port", "agent").count() == 0


def test_timeouts_by_role(spark):
    assert [slot.timeout_ms(r, ms) for r in ("agent", "gateway", "relay") for ms in (500, 60_000)] == [20_000, 60_000, 1_000, 60_000, 15_000, 60_000]
    rows = spark.createDataFrame([("a", BEGIN), ("a", BEGIN + timedelta(seconds=30)), ("b", BEGIN + timedelta(seconds=45)), (None, BEGIN), ("c", None)], "k string, ts timestamp_ntz")
    found = {(r.stream, r.timeout_ms - r.last_ms) for r in slot.silences(rows, "k", "ts", "relay", 5_000).collect()}
    assert found == {("a", 15_000)}
    last = BEGIN.timestamp() * 1000 + 3_600_000
    assert slot.silences(rows, "k", "ts", "relay", 5_000, int(last) + 10**9).count() == 3


def test_snapshot_passes_over_control_frames(spark):
    """1, control, 4, snapshot: three received, two lost; then 5, 6, snapshot: none lost."""
    rows = [(1, n, BEGIN + timedelta(seconds=n), s, q) for n, (s, q) in enumerate([(False, 1), (False, None), (False, 4), (True, None), (False, 5), (False, 6), (True, None)])]
    table = spark.createDataFrame(rows, "k long, n long, ts timestamp_ntz, snap boolean, seq long")
    got = telemetry.snapshot_windows(table, ["k"], ["n"], "ts", F.col("snap"), "seq", F.lit(10)).orderBy("window").collect()
    assert [(r.rx_packets, r.lost, r.bytes) for r in got] == [(3, 2, 30), (2, 0, 20)]


def test_both_directions(spark):
    rows = lambda *x: spark.createDataFrame([(k, BEGIN + timedelta(seconds=s), n) for k, s, n in x], "k long, ts timestamp_ntz, n long")
    tx, rx = rows((1, 0, 10), (1, 1, 10), (1, 25, 5)), rows((1, 2, 7), (1, 3, 7), (1, 4, 7), (1, 5, 7), (2, 0, 1))
    got = {(r.k, r.window_start): r for r in telemetry.both_rates(tx, rx, ["k"], "ts", F.col("n"), 10).collect()}
    first = got[1, BEGIN]
    assert (first.tx_packets, first.rx_packets, first.tx_bytes, first.rx_bytes, first.quality_counts) == (2, 4, 20, 28, True)
    assert (got[1, BEGIN + timedelta(seconds=20)].rx_packets, got[2, BEGIN].tx_pps, got[2, BEGIN].quality_counts) == (0, 0.0, False)
    # neither way alone has enough
    assert first.tx_pps < 0.5 and first.rx_pps < 0.5


def test_reasons_with_figures(spark):
    failed = safety.failed_checks(F.lit(True), F.lit(True), F.lit(True), F.lit(92.0), F.lit(0.05), F.lit(3.0), F.lit(91.04), F.lit(3))
    got = spark.range(1).select(safety.reasons(failed, F.lit(92.0), F.lit(0.05), F.lit(91.04), F.lit(3)).alias("x")).first().x
    assert got == ["rtt 92.00 > 20.00", "loss 5.0000 > 0.1000", "cpu 91.0 > 80.0", "samples 3 < 20"]


def test_devices_containing(spark):
    """Every adapter against every device, short, empty, repeated and null names among them."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abAB -é") for _ in range(rng.randrange(n)))
    devices = [(i, rng.choice([None, text(12)]), rng.choice([None, text(12)]), rng.random() < 0.2) for i in range(300)]
    devices += [(7, "ab", "ab", False)] * 3
    adapters = [(rng.randrange(40), rng.choice([None, text(6) or "ab"])) for _ in range(30)]
    for extra in ([], [(5, "")]):
        names = [*adapters, *extra]
        got = matching.devices_containing(spark.createDataFrame(devices, "device_key long, a string, b string, adapter boolean"), ["a", "b"], spark.createDataFrame(names, "place long, adapter string"), "adapter", "place")
        want = Counter()
        for key, a, b, _ in devices:
            hits = sorted((p, n) for p, n in names if n is not None and any(t is not None and n.lower() in t.lower() for t in (a, b)))
            # equal names in other case are one, by the first of them
            if hits:
                want[key, a, b, hits[0][1]] += 1
        assert Counter(map(tuple, got.collect())) == want and want
    none = spark.createDataFrame([], "place long, adapter string")
    assert matching.devices_containing(spark.createDataFrame(devices, "device_key long, a string, b string, adapter boolean"), ["a"], none, "adapter", "place").count() == 0


def test_adapter_devices_in_a_table(spark, tmp_path):
    """Names of one word and none, and devices that are not broadcast, however small their file."""
    import duckdb

    from linkspan.plans import catalog, joined  # noqa: F401  registers its queries

    names = ["large ring", "ring", "", "Rod  x", "hot bolt", None]
    rows = [(k, names[k % 6], ["LARGE", "BOLT d", None][k % 3], k % 50) for k in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    found = catalog.queries()["adapter_devices"](spark, str(tmp_path))
    want = Counter(con.execute(f"SELECT p_partkey, p_name, p_type, adapter FROM ({catalog.oracle_sql()['adapter_devices']})").fetchall())
    assert Counter(map(tuple, found.select("p_partkey", "p_name", "p_type", "adapter").collect())) == want and want
    above: list[tuple[int, str]] = []
    for line in found._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth] + [(depth, line)]
        assert "device_row" not in line or not any("BroadcastExchange" in x for _, x in above)


def test_release_choice_of_large_keys(spark, tmp_path):
    """Bodies do not grow with the keys without end."""
    import duckdb

    from linkspan.plans import catalog, folds  # noqa: F401  registers its queries

    keys = [*range(380, 420), *range(990, 1020), *range(1_200_000, 1_200_040), *range(2_000_000_000, 2_000_000_020), *range(3_000_000_000, 3_000_000_020)]
    spark.createDataFrame([(k, k % 50) for k in keys], "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    names = ["p_partkey", "version", "asset_url", "checksums_url", "notes"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()['release_choice']})").fetchall()
    assert Counter(map(tuple, catalog.queries()["release_choice"](spark, str(tmp_path)).select(*names).collect())) == Counter(want) and len(want) > 40


def test_reconnects(spark):
    """A plain replay of attempts: doubling delays, a fixed one where settings do not allow any, a new beginning with each connection."""
    rng = random.Random(6)
    rows = [(rng.randrange(3), i, BEGIN + timedelta(milliseconds=700 * i), rng.choice(["failed", "failed", "connected", "dropped", "unset", "changed"])) for i in range(300)]
    got = telemetry.reconnects(spark.createDataFrame(rows, "k long, n long, ts timestamp_ntz, kind string"), ["k"], ["n"], "ts", "kind", 500, 10_000)
    state, want = {}, {}
    for k, n, t, kind in rows:
        attempt, due = state.get(k, (0, None))
        early = kind in ("failed", "connected", "unset") and due is not None and t < due
        attempt = 0 if kind == "connected" else attempt + (kind in ("failed", "dropped", "unset"))
        delay = 2000 if kind == "unset" else min(500 << min(attempt, 10), 10_000) if kind in ("failed", "dropped") else 0
        state[k] = attempt, t + timedelta(milliseconds=delay)
        want[n] = attempt, delay, early
    assert {r.n: (r.attempt, r.delay_ms, r.early) for r in got.collect()} == want
    assert {e for _, _, e in want.values()} == {True, False}


def test_peer_endpoint(spark):
    """Goodbyes and timeouts clear what is shown; foreign packets, which are ignored, change nothing."""
    rows = [(1, n, BEGIN + timedelta(seconds=n), kind, ip, 5) for n, (kind, ip) in enumerate([("hello", "p"), ("ethernet", "z"), ("goodbye", "p"), ("ethernet", "z"), ("keepalive", "p"), ("timeout", None), ("keepalive", "p")])]
    table = spark.createDataFrame(rows, "k long, n long, ts timestamp_ntz, kind string, ip string, port int")
    taken = slot.admitted(table, ["k"], ["n"], "ts", "ip", "port", "gateway", ("p", 5))
    for chunk in (None, F.expr("n div 2")):
        got = slot.peer_endpoint(taken, ["k"], ["n"], "kind", chunk).orderBy("n").collect()
        assert [r.peer_endpoint for r in got] == ["p:5", "p:5", None, None, "p:5", None, "p:5"]


@pytest.mark.parametrize("role", ["gateway", "agent"])
def test_steps_change_nothing(spark, role):
    """Link quality, timeouts and connection states are the same however streams are cut, null flags and clashing names among them."""
    rng = random.Random(7)
    kinds = ["ethernet", "keepalive", "hello", "status", "safety_probe", "goodbye", "ack"]
    maybe = lambda x: rng.choice([None, x, x])
    rows = [(rng.choice([1, 1, 1, 2]), n, BEGIN + timedelta(seconds=n * 7), rng.choice(kinds), maybe(n % 2 == 0), maybe(float(n % 5)), maybe(n % 3 > 0), maybe(n % 4 == 0), maybe(float(n % 6)), "x", 5) for n in range(300)]
    table = spark.createDataFrame(rows, "k long, n long, ts timestamp_ntz, kind string, is_reply boolean, rtt double, vehicle_link boolean, vehicle_awake boolean, peer_rtt double, row string, part long").repartition(3)

    def found(chunk):
        lines = telemetry.with_timeouts(table, ["k"], ["n"], "ts", "kind", 20, chunk)
        states = telemetry.connection_states(lines, ["k"], ["n", "step"], role, chunk)
        quality = telemetry.link_quality(table, ["k"], ["n"], "n", F.col("n") < 100, chunk)
        return Counter(map(tuple, states.select(sorted(states.columns)).collect())), Counter(map(tuple, quality.collect()))

    whole = found(None)
    assert sum(whole[0].values()) > 300 and whole[1]
    for seconds in (1, 60, 10_000):
        assert found(telemetry.steps("ts", seconds)) == whole
