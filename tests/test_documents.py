"""Status documents, payload builders and their parts on small odd tables."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linkspan.functions import safety, wire
from linkspan.operators import documents, settings, telemetry

BEGIN = datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_adapter_choices(spark):
    rows = [(1, "USB Ethernet", "Realtek", True, True), (1, "Loopback Pseudo-Interface", "", True, False), (1, "b", None, None, None), (1, "b", None, None, None), (1, None, None, True, None), (2, "Wi-Fi", "wireless", True, False)]
    table = spark.createDataFrame(rows, "host long, name string, description string, is_up boolean, has_link_local boolean").withColumn("score", F.lit("x"))
    found = {r.host: [(a.name, a.score, a.usable) for a in r.adapters] for r in documents.adapter_choices(table, ["host"]).collect()}
    assert [n for n, _, _ in found[1]] == ["", "Loopback Pseudo-Interface", "USB Ethernet", "b", "b"]
    scores = {n: (s, u) for n, s, u in found[1]}
    assert scores["Loopback Pseudo-Interface"] == (-1000, False) and scores["USB Ethernet"][0] > scores[""][0] > 0 and scores["b"] == (0, False)
    assert found[2][0][1] < 0
    ranked = {r.host: [a.name for a in r.adapters] for r in documents.adapter_choices(table, ["host"], ranked=True).collect()}
    assert ranked[1] == ["USB Ethernet", "", "b", "b", "Loopback Pseudo-Interface"]
    assert documents.adapter_choices(table.limit(0), ["host"]).count() == 0
    names = [(1, f"if{n}") for n in (5, 3, 9, 1, 7, 2, 8, 8)]
    first = documents.first_by_name(spark.createDataFrame(names, "host long, name string"), ["host"])
    assert sorted(r.name for r in first.collect()) == ["if1", "if2", "if3", "if5", "if7", "if8"]


def test_usable_addresses(spark):
    local = spark.createDataFrame([(1, "10.0.0.20"), (1, "10.0.0.3"), (1, "10.0.0.3"), (1, "127.0.0.1"), (2, "169.254.0.9"), (2, None), (3, "junk")], "host long, ip string")
    out = spark.createDataFrame([(1, "10.9.9.9"), (2, "192.168.1.4"), (3, "127.0.0.1"), (4, "224.0.0.1"), (5, "172.16.0.1")], "host long, ip string")
    found = {r.host: r.lan_ips for r in documents.usable_addresses(local, ["host"], "ip", out).collect()}
    assert found == {1: ["10.0.0.3", "10.0.0.20"], 2: ["192.168.1.4"], 3: [], 4: [], 5: ["172.16.0.1"]}


def test_activity_json(spark):
    rows = [(1, n, BEGIN + timedelta(milliseconds=500 * n), "info", f'said "{n}"' if n else None) for n in range(6)] + [(2, 0, None, "warn", "x")]
    got = {r.host: json.loads(r.document) for r in documents.activity_json(spark.createDataFrame(rows, "host long, n long, ts timestamp_ntz, level string, message string"), ["host"], ["n"], "ts", 4).collect()}
    begin = (BEGIN - datetime(1970, 1, 1)).total_seconds()
    assert [(e["ts"], e["message"]) for e in got[1]["entries"]] == [(begin + n / 2, f'said "{n}"') for n in (2, 3, 4, 5)]
    assert got[2]["entries"] == [{"level": "warn", "message": "x"}]


def test_times_and_labels(spark):
    ts = lambda text: F.lit(text).cast("timestamp")
    assert one(spark, documents.unix_seconds(ts("1970-01-01 00:00:01.25"))) == 1.25 and one(spark, documents.unix_seconds(ts("1970-01-01 00:00:01.75"), whole=True)) == 1
    assert one(spark, documents.elapsed_ms(ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:02.5"))) == 2500.0
    assert one(spark, documents.elapsed_ms(ts("2024-01-01 00:00:01"), ts("2024-01-01 00:00:00"))) == 0.0
    assert one(spark, settings.mode_label(F.lit("relay"))).endswith("(Relay)") and one(spark, settings.mode_label(F.lit("other"))) is None


def test_payloads(spark):
    hello = json.loads(one(spark, wire.hello(F.lit("agent"), F.lit("1.2"), F.lit(""), F.lit(True))))
    assert hello == {"kind": "hello", "role": "agent", "version": "1.2", "hostname": "unknown", "require_crypto": True}
    made = lambda role: json.loads(one(spark, wire.status(F.lit(role), F.lit(True), F.lit(None).cast("boolean"), F.lit("Connected"), F.lit(3), F.lit(4), F.lit(0.5), F.lit(1.5))))
    assert made("agent") == {"kind": "status", "vehicle_link": True, "vehicle_awake": False, "peer_connected": True, "packets_tx": 3, "packets_rx": 4, "loss_rate": 0.5, "rtt_ms": 1.5}
    assert made("gateway")["vehicle_link"] is False


def test_plaintext_is_dropped(spark):
    frame = lambda flags: wire.encode_frame(F.lit(1), F.lit(flags), F.lit(1), F.lit(b"x"), F.lit(0))
    rows = spark.range(1).select(F.explode(F.array(frame(0), frame(1), F.lit(b"short"), F.lit(None).cast("binary"))).alias("raw"))
    kept, gone = telemetry.drop_plaintext(rows, "raw", F.lit(True))
    assert (kept.count(), gone.count()) == (1, 3)
    kept, gone = telemetry.drop_plaintext(rows, "raw", F.lit(False))
    assert (kept.count(), gone.count()) == (4, 0)


def test_lifetime(spark):
    rows = [(1, n, way, size, seq) for n, (way, size, seq) in enumerate([("rx", 10, 1), ("tx", 7, 9), ("rx", 10, None), ("rx", 10, 4), ("dropped", 99, 5), ("error", 0, None), ("timeout", 0, None), ("other", 1, 1), (None, 1, 1)])]
    got = telemetry.lifetime(spark.createDataFrame(rows, "k long, n long, way string, size long, seq long"), ["k"], F.col("way"), F.col("size"), F.col("seq"), ["n"]).first()
    assert (got.tx_packets, got.rx_packets, got.tx_bytes, got.rx_bytes, got.dropped, got.errors, got.reconnects, got.seq_gaps) == (1, 3, 7, 30, 1, 1, 1, 2)


def test_timeouts_with_clashing_names(spark):
    rows = [(1, n, BEGIN + timedelta(seconds=s), "a", "x", 7, "y") for n, s in enumerate((0, 5, 100))]
    table = spark.createDataFrame(rows, "k long, n long, ts timestamp_ntz, kind string, line string, step int, lines string")
    got = telemetry.with_timeouts(table, ["k"], ["n"], "ts", "kind", 30).orderBy("n", "step").collect()
    assert [(r.n, r.step, r.kind, r.line, r.lines) for r in got] == [(0, 0, "a", "x", "y"), (1, 0, "a", "x", "y"), (2, 0, "timeout", "x", "y"), (2, 1, "a", "x", "y")]


def test_figures_are_rounded_as_printf_does(spark):
    values = [0.0, 80.05, 80.15, 80.35, 85.25, 85.75, 99.95, 99.99995, 0.03125, 0.09375, 73.255813953, 12.5, 13.5, -2.25, 3.0, 1e12 + 0.25, 80.25]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", *(safety.fixed(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2, 4))).collect()
    assert [tuple(r)[1:] for r in found] == [tuple(f"{v:.{d}f}" for d in (0, 1, 2, 4)) for v in values]
    assert spark.range(1).select(safety.fixed(F.lit(float("nan")), 1), safety.fixed(F.lit(1e300), 0)).first()[0] == "NaN"


def test_host_document_of_hosts_beyond_the_first(spark, sf_dir, tmp_path):
    """Hosts with numbers above those that own addresses: all have a way out."""
    import duckdb

    from linkspan.plans import catalog, documents as plans  # noqa: F401  registers its queries

    con = duckdb.connect()
    for name in ("events", "part", "supplier"):
        shifted = ", user_id + 1000 * r AS user_id, event_id + 1000000 * r AS event_id" if name == "events" else ""
        con.execute(f"COPY (SELECT * {'EXCLUDE (user_id, event_id)' if shifted else ''} {shifted} FROM '{sf_dir}/{name}.parquet' {', range(3) t(r)' if shifted else ''}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(f"SELECT user_id, lan_ips, reasons, cpu_pct FROM ({catalog.oracle_sql()['host_document']})").fetchall()
    found = catalog.queries()["host_document"](spark, str(tmp_path)).select("user_id", "lan_ips", "reasons", "cpu_pct")
    assert sorted(map(tuple, found.collect())) == sorted(want) and max(r[0] for r in want) >= 2000
