"""Vectors of the wire format, addresses, versions, loss, quantiles and the gate."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from linkspan.functions import net, safety, wire
from linkspan.operators import matching, settings, telemetry
from linkspan.plans import catalog
from linkspan.sources import frames as sources


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def over(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def losses(spark, sequences, per=None):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(sequences)], "k int, i int, s long")
    return rows.select(telemetry.lost_before(F.col("s"), telemetry.arrival(["k"], ["i"])).alias("x")).agg(F.sum("x")).first()[0]


def test_loss_vectors(spark):
    for sequences, want in (([1, 2, 5], 2), ([1, 10000], 0), ([1, 2, 4, 3, 5], 2), ([1, 66], 64), ([1, 67], 0), ([5, 5, 4], 0)):
        assert losses(spark, sequences) == want, sequences


def test_nearest_rank(spark):
    got = over(spark, lambda v: F.struct(telemetry.nearest_rank(v, 0.5).alias("a"), telemetry.nearest_rank(v, 0.99).alias("b")), [[1.0, 2.0], [], [5.0], [3.0, 1.0, 2.0]], "array<double>")
    assert got == [Row(a=2.0, b=2.0), Row(a=0.0, b=0.0), Row(a=5.0, b=5.0), Row(a=2.0, b=3.0)]


def test_rtt_filter_and_gate(spark):
    assert over(spark, safety.valid_rtt, [0.0, 2000.0, 2000.1, float("nan"), None], "double") == [False, True, False, False, False]
    assert one(spark, safety.gate_rtt(F.lit(10.0), F.lit(100.0), F.lit(50.0))) == 20.0
    assert one(spark, safety.gate_rtt(F.lit(1.0), F.lit(2.0), F.lit(5.0))) == 5.0
    assert one(spark, wire.rtt_from_low(F.lit(5), F.lit(4294967290))) == 11.0
    assert one(spark, wire.rtt_from_low(F.lit(70000), F.lit(1))) == 0.0
    delays = [one(spark, safety.backoff_ms(F.lit(500).cast("bigint"), F.lit(m).cast("bigint"), F.lit(a))) for m, a in ((10000, 0), (10000, 3), (1000, 20))]
    assert delays == [500, 4000, 1000]


def gate(spark, link=True, awake=True, connected=True, rtt=2.0, loss=0.0, pps=10.0, cpu=10.0, rx=1000):
    lit = F.lit
    return one(spark, safety.failed_checks(lit(link), lit(awake), lit(connected), lit(rtt), lit(loss), lit(pps), lit(cpu), lit(rx)))


def test_safety(spark):
    assert gate(spark) == []
    assert gate(spark, loss=0.05) == ["loss"] and gate(spark, loss=0.05, pps=0.5) == []
    assert gate(spark, link=False, rtt=92.0) == ["link"]
    assert gate(spark, awake=False, connected=False, cpu=99.0) == ["peer", "asleep"]
    assert gate(spark, rtt=21.0, cpu=81.0, rx=19) == ["rtt", "cpu", "samples"]


def frame(spark, sequence=42, payload=b"x" * 19, kind=1, flags=0):
    return one(spark, wire.encode_frame(F.lit(kind), F.lit(flags), F.lit(str(sequence)).cast("decimal(20,0)"), F.lit(payload), F.lit(123456)))


def decoded(spark, raw):
    return spark.createDataFrame([(raw,)], "raw binary").select(wire.decode_frame(F.col("raw")).alias("x")).first().x


@pytest.mark.parametrize("sequence", [0, 42, 2**32, 2**63, 2**64 - 1])
def test_frame_round_trip(spark, sequence):
    raw = bytes(frame(spark, sequence)) + b"trailing"
    got = decoded(spark, raw)
    assert (got.error, got.frame_type, int(got.sequence), got.timestamp_ms_lo, bytes(got.payload)) == (None, 1, sequence, 123456, b"x" * 19)
    assert raw[:4] == b"ENET" and int.from_bytes(raw[8:16], "big") == sequence


def test_decode_errors(spark):
    good = bytearray(frame(spark))
    changed = lambda i, b: bytes(good[:i]) + bytes([b]) + bytes(good[i + 1 :])
    cases = {bytes(good[:23]): "TooShort", changed(0, 0): "BadControl", changed(4, 2): "BadVersion", changed(5, 9): "BadFrameType", changed(5, 0): "BadFrameType", bytes(good[:-1]): "TooShort"}
    for raw, want in cases.items():
        got = decoded(spark, raw)
        assert got.error == want and got.sequence is None


def test_frame_predicates(spark):
    assert over(spark, wire.is_encrypted, [bytes(frame(spark, flags=1)), bytes(frame(spark)), b"short", b"y" * 30], "binary") == [True, False, None, None]
    assert over(spark, wire.fits_wire, [b"x" * 1518, b"x" * 1519], "binary") == [True, False]
    assert over(spark, wire.is_keepalive_reply, [b"\0" * 7 + b"\1", b"\0" * 8, b"\1"], "binary") == [True, False, False]
    got = over(spark, lambda v: wire.announcement(v, b"MAGIC123"), [b'MAGIC123{"type":"announce","hostname":"h"}', b'XAGIC123{"type":"announce"}'], "binary")
    assert got[0].hostname == "h" and got[0].lan_ips == [] and (got[1] is None or got[1].hostname is None)
    assert one(spark, wire.control(F.lit('{"kind":"status","packets_rx":5}'))).packets_rx == 5


def test_addresses(spark):
    pairs = [("192.168.1.50", "192.168.0.0/16", True), ("192.168.1.50", "10.0.0.0/8", False), ("192.168.1.50", "192.168.1.50", True), ("1.2.3.4", "0.0.0.0/0", True), ("1.2.3.4", "::/0", False), ("1.2.3.4", "1.2.3.4/33", False), ("1.2.3.4", "junk", False), ("fe80::1", "fe80::/10", True), ("2001:db8::5", "2001:db8::/32", True), ("2001:db9::5", "2001:db8::/32", False)]
    rows = spark.createDataFrame(pairs, "ip string, cidr string, want boolean")
    assert all(r.got == r.want for r in rows.withColumn("got", net.in_cidr(F.col("ip"), F.col("cidr"))).collect())
    assert over(spark, net.is_link_local, ["169.254.1.1", "192.168.1.1"]) == [True, False]
    assert over(spark, net.is_usable_lan, ["127.0.0.1", "0.0.0.0", "224.0.0.1", "255.255.255.255", "169.254.3.3", "10.1.1.1", "x"]) == [False] * 5 + [True, False]
    assert over(spark, net.relay_address, ["example.com", "example.com:1234", "tcp://a:9"]) == ["example.com:47910", "example.com:1234", "a:9"]
    assert over(spark, net.pair_code, ["  abc-7k2q ", "abc 7k2q"]) == ["ABC-7K2Q", "ABC7K2Q"]
    assert over(spark, lambda v: net.dotted(net.ipv4(v)), ["10.2.3.255", "1.2.3", "256.1.1.1"]) == ["10.2.3.255", None, None]


def test_allow_list(spark):
    packets = spark.createDataFrame([("10.1.2.3",), ("10.1.2.3",), ("192.168.1.7",), ("junk",)], "ip string")
    cidrs = lambda *x: spark.createDataFrame([(c,) for c in x], "cidr string")
    assert matching.allowed(packets, "ip", cidrs(), "cidr").count() == 4
    assert matching.allowed(packets, "ip", cidrs("10.0.0.0/8", "bad/99"), "cidr").count() == 2
    assert matching.allowed(packets, "ip", cidrs("192.168.1.7", "10.1.2.0/24"), "cidr").count() == 3
    assert matching.allowed(packets, "ip", cidrs("bad"), "cidr").count() == 0


def test_versions_and_slugs(spark):
    got = over(spark, net.semver, ["v0.1.19", "1.2.3", "nope", "vv1.2", "1.2.x", "1"])
    assert [tuple(g) if g else None for g in got] == [(0, 1, 19), (1, 2, 3), None, (1, 2, 0), (1, 2, 0), None]
    assert one(spark, net.semver(F.lit("v0.1.20")) > net.semver(F.lit("v0.1.19")))
    urls = ["https://github.com/acme/x", "https://github.com/acme/x.git", "acme/x", "https://tok@github.com/acme/x/", "http://other.org/a/b", "acme"]
    assert over(spark, net.repo_slug, urls) == ["acme/x"] * 4 + [None, None]


def test_interface_scores(spark):
    score = lambda name, description, up=True, local=False, preferred="": one(spark, net.interface_score(F.lit(name), F.lit(description), F.lit(up), F.lit(local), preferred))
    assert score("Ethernet 3", "Realtek USB", local=True) > score("Wi-Fi", "wireless")
    assert score("lo", "Software Loopback Interface 1") == -1000 and score("x", "KM-TEST adapter") == -1000
    assert score("car", "plain", preferred="CAR") == 110


def plain_rooms(roles):
    held, out = "", []
    for role in roles:
        if role not in ("gateway", "agent") or role == held:
            out.append("duplicate")
        elif held:
            held = ""
            out.append("paired")
        else:
            held = role
            out.append("waiting")
    return out


def test_pairing(spark, sf_dir):
    roles = ["gateway", "gateway", "agent", "agent", "gateway"]
    assert plain_rooms(roles) == ["waiting", "duplicate", "paired", "waiting", "paired"]
    assert plain_rooms([None, "gateway", "agent", "gateway"]) == ["duplicate", "waiting", "paired", "waiting"]
    rng = random.Random(1)
    drawn = [[rng.choice(["gateway", "agent", "agent", "other", None]) for _ in range(rng.randint(1, 40))] for _ in range(60)]
    drawn += [roles, [None, *roles, "other", None], ["gateway"] * 7, ["agent", "gateway"] * 5]
    joins = spark.createDataFrame([(k, i, r) for k, room in enumerate(drawn) for i, r in enumerate(room)], "room long, i long, role string")
    for chunk in (None, F.expr("i div 3"), F.col("i")):
        found = matching.pair_rooms(joins, "room", "role", ["i"], chunk).orderBy("room", "i").collect()
        assert [(r.room, r.outcome) for r in found] == [(k, x) for k, room in enumerate(drawn) for x in plain_rooms(room)]
    found = catalog.queries()["room_pairing"](spark, sf_dir).orderBy("room", "conv_id", "turn").collect()
    for room in {r.room for r in found}:
        own = [r for r in found if r.room == room]
        assert [r.outcome for r in own] == plain_rooms([r.role for r in own])


def test_deframe(spark, sf_dir):
    blob = b"\0\0\0\2hi\0\0\0\1x"
    rows = spark.createDataFrame([(1, blob), (2, blob + b"\0\0"), (3, b"\0\0\0\0zz"), (4, b"\0\0\7\0"), (5, b""), (6, blob[:5]), (7, None)], "k int, blob binary")
    found = Counter((r.k, bytes(r.body) if r.body is not None else None, r.error) for r in sources.deframe(rows, "blob", "k").collect())
    want = [(1, b"hi", None), (1, b"x", None), (2, b"hi", None), (2, b"x", None), (2, None, "cut"), (3, None, "bad_length"), (4, None, "bad_length"), (6, None, "cut")]
    assert found == Counter(want)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    query = catalog.queries()["deframe_udtf"](spark, sf_dir)
    # a line beyond the limit ends its blob with an error
    want = 0
    for d in docs:
        for line in (x for x in d.text.split("\n") if x):
            want += 1
            if len(line.encode()) > wire.MAX_STREAM_FRAME:
                break
    assert query.count() == want


def lab_traffic(spark, burst=200, stream=100):
    """Frames of one run: a discovery broadcast, a burst, a stream, and a wake frame."""
    body = F.concat(F.unhex(F.lit("ffffffffffff0200000000010800")), wire.big_endian(F.col("id"), 4))
    return spark.range(2 + burst + stream).select((F.col("id") + 1).alias("sequence"), body.alias("frame"))


def test_frame_logs(spark, tmp_path):
    frames = lab_traffic(spark).select(wire.length_prefixed(wire.encode_frame(F.lit(1), F.lit(0), F.col("sequence"), F.col("frame"), F.lit(5))).alias("x")).orderBy("sequence").collect()
    (tmp_path / "run.bin").write_bytes(b"".join(bytes(r.x) for r in frames) + b"\0\0\0\5BADXX\0\0\0\0")
    got = sources.read_frames(spark, str(tmp_path)).orderBy("frame_no").collect()
    assert len(got) == 304 and [int(r.frame.sequence) for r in got[:302]] == list(range(1, 303)) and not any(r.error for r in got[:302])
    assert [r.error for r in got[302:]] == ["TooShort", "bad_length"]


def test_sources(spark, tmp_path):
    defaults = {"port": 1, "name": "n", "on": True}
    assert sources.read_config(spark, str(tmp_path / "none.toml"), defaults).first().asDict() == defaults
    sources.write_config(spark.createDataFrame([{**defaults, "name": 'a"b'}]), str(tmp_path / "c.toml"))
    assert sources.read_config(spark, str(tmp_path / "c.toml"), {**defaults, "extra": 2}).first().asDict() == {**defaults, "name": 'a"b', "extra": 2}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "b.log").write_text("two\nlines")
    (tmp_path / "logs" / "a.log").write_text("one")
    logs = settings.log_bundle(sources.read_logs(spark, str(tmp_path / "logs")), ["path"]).collect()
    assert [r.text for r in logs] == ["one", "two\nlines"]
    (tmp_path / "sums").write_text("a" * 64 + "  *File.ZIP\nnot a line\n" + "B" * 64 + " other\n")
    sums = sources.read_sums(spark, str(tmp_path / "sums"))
    assert {tuple(r) for r in sums.collect()} == {("a" * 64, "File.ZIP"), ("B" * 64, "other"), ("not", "a")}  # any line's first two words
    files = spark.createDataFrame([("file.zip", "x"), ("none", "y")], "name string, content string")
    assert {r.name: r.status for r in settings.verified(files, sums).collect()} == {"file.zip": "mismatch", "none": "no_entry"}
    assert {r.status for r in settings.verified(files, None).collect()} == {"unchecked"}
    good = hashlib.sha256(b"x").hexdigest()
    twice = spark.createDataFrame([(1, good.upper(), "File.zip"), (2, "0" * 64, "file.ZIP")], "line int, sha string, file string")
    assert {r.name: r.status for r in settings.verified(files, twice).collect()}["file.zip"] == "ok"
    sources.write_daily_logs(spark.sql("select timestamp '2024-01-02 03:04:05' as ts, 'a line' as line union all select timestamp '2024-01-03 00:00:00', 'b'"), "ts", "line", str(tmp_path / "daily"))
    assert {p.name for p in (tmp_path / "daily").iterdir() if p.is_dir()} == {"day=2024-01-02", "day=2024-01-03"}


def test_numbers_that_do_not_fit(spark):
    fits = lambda n, size: one(spark, wire.big_endian(F.lit(str(n)).cast("decimal(22,0)"), size))
    for n, size in ((70000, 2), (-1, 2), (5 * 10**9, 4), (256, 1), (-1, 8)):
        assert fits(n, size) is None, (n, size)
    assert [bytes(fits(n, s)) for n, s in ((65535, 2), (0, 1), (2**32 - 1, 4), (2**64 - 1, 8))] == [b"\xff\xff", b"\0", b"\xff" * 4, b"\xff" * 8]
    assert frame(spark, payload=b"x" * 1519) is None and len(frame(spark, payload=b"x" * 1518)) == 1542 and frame(spark, kind=300) is None
    assert decoded(spark, None).error == "TooShort"
    assert one(spark, wire.derive_key(F.lit("pw"), "p:")) == hashlib.sha256(b"p:pw").hexdigest()
    long = b'MAGIC123{"type":"announce","hostname":"' + b"h" * (2 << 20) + b'"}'
    assert len(spark.createDataFrame([(long,)], "v binary").select(wire.announcement(F.col("v"), b"MAGIC123").alias("x")).first().x.hostname) == 2 << 20


def test_ipv6_allow_list(spark):
    packets = spark.createDataFrame([("fe80::1",), ("2001:db8::5",), ("2001:db9::5",), ("10.1.2.3",), ("::1",), (None,)], "ip string")
    passed = lambda *x: sorted(r.ip for r in matching.allowed(packets, "ip", spark.createDataFrame([(c,) for c in x], "cidr string"), "cidr").collect())
    assert passed("2001:db8::/32", "10.0.0.0/8") == ["10.1.2.3", "2001:db8::5"]
    assert passed("::/0") == ["2001:db8::5", "2001:db9::5", "::1", "fe80::1"] and passed("0.0.0.0/0") == ["10.1.2.3"]
    assert passed("::1", "fe80::/200") == ["::1"]


def test_settings_rules(spark):
    cases = [("", True, False, False), ("", False, True, False), ("pw", False, False, True), (None, False, True, True), ("", True, True, True)]
    rows = spark.createDataFrame(cases, "password string, remote boolean, before boolean, want boolean")
    assert all(r.got == r.want for r in rows.withColumn("got", settings.crypto_after(F.col("password"), F.col("remote"), F.col("before"))).collect())


def test_addresses_to_use(spark):
    offers = lambda *ips, source="10.0.0.1": spark.createDataFrame([(1, ip, source) for ip in ips], "gateway int, ip string, source string")
    local = lambda *ips: spark.createDataFrame(list(enumerate(ips)), "place int, ip string")
    use = lambda o, l: matching.same_subnet(o, l, "place").first().address
    assert use(offers("10.0.0.1", "192.168.1.187"), local("192.168.1.50")) == "192.168.1.187"
    assert use(offers("127.0.0.5", "10.0.0.1"), local("127.0.0.9")) == "10.0.0.1"
    assert use(offers("10.0.1.1", "10.0.2.2"), local("10.0.2.9", "10.0.1.9")) == "10.0.2.2"
    assert use(offers("127.0.0.5", source="127.0.0.7"), local("10.0.0.1")) == "127.0.0.7"
    both = matching.interfaces(spark.createDataFrame([("lo", "127.0.0.1"), ("lo", "::1"), ("lo2", "127.0.0.1"), ("a", "10.0.0.1")], "name string, ip string"), spark.createDataFrame([("lo2", "m")], "name string, mac string"))
    assert sorted(r.name for r in both.collect()) == ["a", "lo2"]
    pairs = matching.wildcard_pairs(spark.createDataFrame([("É",), ("ab",), (None,)], "q string"), spark.createDataFrame([("é",), ("AB",), ("",)], "a string"), "q", "a")
    assert {tuple(r) for r in pairs.collect()} == {("ab", "AB"), ("É", ""), ("ab", "")}


def test_texts_and_codes(spark):
    assert over(spark, net.pair_code_in, ['x = 1\n pair_code = "AB-12"\npair_code = "Z"', "pair_code =\npair_code = q", "none", None]) == ["AB-12", "q", None, None]
    assert over(spark, lambda v: net.pair_code_or(v, F.lit("GEN")), [" ab c", "  ", None]) == ["ABC", "GEN", "GEN"]
    assert one(spark, net.interface_score(F.lit("x"), F.lit("other virtual nic"), F.lit(True), F.lit(False), virtual_words=("other virtual",))) == -1000
    line = lambda *x: one(spark, safety.laptop_line(F.lit(x[0]).cast("string"), *map(F.lit, x[1:])))
    assert [line(None, False, False, False, False), line(None, True, False, False, False), line("Connected", True, True, True, False), line("Connected", True, True, True, True), line("Reconnecting", True, True, True, True), line("Stopped", True, False, True, True)] == ["searching", "dialing", "waiting_for_wake", "ready", "reconnecting", "waiting_for_desktop"]
    assert [one(spark, safety.slow_way_out(F.lit(True), F.lit(a), F.lit(b))) for a, b in ((41.0, 20.0), (41.0, 20.5), (40.0, 1.0), (90.0, 0.0))] == [True, False, False, False]


def test_snapshots_restart_loss(spark):
    """1, 4, snapshot, 5, 6, snapshot: loss in the first window only; and a new epoch forgets its window's loss."""
    rows = [(1, 1, 1, False, 0), (1, 2, 4, False, 0), (1, 3, None, True, 0), (1, 4, 5, False, 0), (1, 5, 6, False, 0), (1, 6, None, True, 0), (2, 1, 1, False, 0), (2, 2, 4, False, 0), (2, 3, 9, False, 1), (2, 4, 11, False, 1), (2, 5, None, True, 1)]
    table = spark.createDataFrame(rows, "k int, i int, seq long, snap boolean, epoch int").withColumn("ts", F.timestamp_seconds("i"))
    found = telemetry.snapshot_windows(table, ["k"], ["i"], "ts", F.col("snap"), "seq", F.lit(10), "epoch").orderBy("k", "window").collect()
    assert [(r.k, r.window, r.rx_packets, r.lost, r.seconds) for r in found] == [(1, 0, 2, 2, 2.0), (1, 1, 2, 0, 3.0), (2, 0, 4, 1, 4.0)]
    assert found[0].loss_rate == 0.5 and found[1].loss_rate == 0.0


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_epochs_by_parts(spark, step):
    rng = random.Random(step)
    rows = [(k, i, rng.choice("aaab"), rng.randrange(300) if rng.random() < 0.1 else i * 2) for k in range(6) for i in range(60)]
    want = []
    for key in range(6):
        gaps = tail = epochs = 0
        before = None
        for _, _, peer, seq in (r for r in rows if r[0] == key):
            if before and before[0] == peer:
                gap = seq - before[1] - 1
                gap = gap if 1 <= gap <= 64 else 0
                gaps, tail = gaps + gap, tail + gap
            else:
                epochs, tail = epochs + 1, 0
            before = (peer, seq)
        want.append((key, epochs, gaps, tail))
    table = spark.createDataFrame(rows, "k int, i int, peer string, seq long")
    found = telemetry.epoch_loss(table, ["k"], ["i"], "peer", "seq", F.expr(f"i div {step}")).orderBy("k").collect()
    assert [(r.k, r.epochs, r.seq_gaps, r.window_loss) for r in found] == want
