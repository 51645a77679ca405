"""Registered queries of state folds, snapshots, status documents, releases and discovery, with their DuckDB counterparts.

The tables are mapped as in ``catalog``. Sources of packets, configurations, releases and joins
are made from keys, so that every outcome occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.functions import net, safety, wire
from linkspan.operators import matching, settings, telemetry
from linkspan.plans.catalog import _GAP, _GATE, _PPS, _RING, _SIP, _W, KEY, ORDER, day_rate, query, supplier_ip, table
from linkspan.sources import frames as sources

_OVER = "(PARTITION BY user_id ORDER BY ts, event_id"
_PAST = f"{_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_NOW = f"{_OVER} ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH m AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS snap FROM events), n AS (SELECT *, sum(snap) OVER {_NOW} - snap AS win FROM m),
    d AS (SELECT *, CASE WHEN event_type <> 'click' THEN event_id END AS seq FROM n WHERE snap = 0), f AS (SELECT user_id, win, length(props) AS size, seq - last_value(seq IGNORE NULLS) OVER {_PAST} - 1 AS gap FROM d),
    t AS (SELECT user_id, win, count(*) AS rx, sum(size) AS bytes, sum(CASE WHEN gap BETWEEN 1 AND 64 THEN gap ELSE 0 END) AS lost FROM f GROUP BY ALL),
    s AS (SELECT user_id, win, epoch_us(ts) AS closed, coalesce(lag(epoch_us(ts)) OVER {_OVER}), (SELECT min(epoch_us(e.ts)) FROM events e WHERE e.user_id = n.user_id)) AS began FROM n WHERE snap = 1),
    b AS (SELECT s.user_id, s.win, greatest((closed - began) / 1000000.0, 0.001) AS seconds, coalesce(rx, 0) AS rx, coalesce(bytes, 0) AS bytes, coalesce(lost, 0) AS lost FROM s LEFT JOIN t ON t.user_id = s.user_id AND t.win = s.win)
    SELECT user_id, CAST(win AS BIGINT) AS "window", CAST(rx AS BIGINT) AS rx_packets, CAST(bytes AS BIGINT) AS bytes, CAST(lost AS BIGINT) AS lost, round(seconds, 6) AS seconds, round(rx / seconds, 9) AS pps, round(lost / (greatest(rx, 1) + lost), 9) AS loss_rate FROM b""")
def snapshot_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and loss between snapshots (here error events), each of which begins a new window; clicks are control frames, which loss passes over."""
    rows = table(spark, sf_dir, "events").withColumn("sequence", F.when(F.col("event_type") != "click", F.col("event_id")))
    out = telemetry.snapshot_windows(rows, KEY, ORDER, "ts", F.col("event_type") == "error", "sequence", F.length("props"))
    return out.select("user_id", "window", "rx_packets", "bytes", "lost", F.round("seconds", 6).alias("seconds"), F.round("pps", 9).alias("pps"), F.round("loss_rate", 9).alias("loss_rate"))


_PEER = ("10.0.0.0", 47901)
#: Role and whether a peer is configured.
_CONFIGS = (("agent", True), ("gateway", True), ("gateway", False), ("agent", False))


def _admission_sql(role: str, configured: bool) -> str:
    port, other = _PEER[1], "ip IS DISTINCT FROM slot_ip AND slot_ip IS NOT NULL"
    if configured and role == "agent":
        address, taken = f"coalesce(last_value(CASE WHEN port = {port} THEN ip END IGNORE NULLS) OVER {_PAST}, '{_PEER[0]}')", f"ip = slot_ip OR port = {port}"
    elif configured:
        address, taken = f"'{_PEER[0]}'", "ip = slot_ip"
    elif role == "gateway":
        address, taken = f"lag(ip) OVER {_OVER})", "true"
    else:
        address, taken = f"first_value(ip) OVER {_PAST}", "slot_ip IS NULL OR ip = slot_ip"
    begin = str(port) if configured else "NULL"
    return f"""SELECT '{role}{"_peer" if configured else ""}' AS config, user_id, event_id, ts, CASE WHEN slot_ip IS NULL THEN 'learned' WHEN {other} AND taken THEN '{"switched" if configured else "replaced"}'
        WHEN {other} THEN '{"ignored" if configured else "passed"}' WHEN port <> slot_port THEN 'port_changed' ELSE 'same' END AS outcome
        FROM (SELECT *, coalesce(last_value(CASE WHEN taken THEN port END IGNORE NULLS) OVER {_PAST}, {begin}) AS slot_port
              FROM (SELECT *, {taken} AS taken FROM (SELECT *, {address} AS slot_ip FROM p)))"""


@query(f"""WITH p AS (SELECT user_id, ts, event_id, '10.0.0.' || CAST(event_id % 3 AS VARCHAR) AS ip, CAST(47900 + event_id // 3 % 3 AS INTEGER) AS port FROM events),
    o AS ({" UNION ALL ".join(_admission_sql(*c) for c in _CONFIGS)})
    SELECT config, user_id, event_id, outcome, outcome = 'ignored' AS dropped, CAST(sum(CASE WHEN outcome IN ('learned', 'switched', 'replaced', 'port_changed') THEN 1 ELSE 0 END)
        OVER (PARTITION BY config, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM o""")
def peer_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the peer slot makes of each packet, for gateways and agents with and without a configured peer."""
    packets = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.concat(F.lit("10.0.0."), F.col("event_id") % 3).alias("ip"), (F.expr("event_id div 3 % 3") + 47900).cast("int").alias("port"))
    found = [telemetry.admitted(packets, KEY, ORDER, "ip", "port", role, _PEER if peer else None).withColumn("config", F.lit(role + "_peer" * peer)) for role, peer in _CONFIGS]
    out = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return out.select("config", "user_id", "event_id", "outcome", "dropped", F.col("epoch").cast("bigint").alias("epoch"))


_KINDS = ["ethernet", "keepalive", "hello", "status", "safety_probe", "goodbye", "ack", "status"]


def frames_of(events: DataFrame) -> DataFrame:
    """Frames with the fields that the connection fold reads."""
    n = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.expr("(event_id * 7 + event_id div 5) % 8") + 1).cast("int"))
    return events.select("user_id", "ts", "event_id", kind.alias("kind"), (n % 2 == 0).alias("is_reply"), (n % 5).cast("double").alias("rtt"), (n % 3 > 0).alias("vehicle_link"), (n % 4 == 0).alias("vehicle_awake"), (n % 6).cast("double").alias("peer_rtt"))


def _states_sql(role: str) -> str:
    held = lambda value, begin: f"coalesce(last_value({value} IGNORE NULLS) OVER w, {begin})"
    gateway = role == "gateway"
    link = held("CASE WHEN kind = 'status' THEN vehicle_link WHEN kind IN ('goodbye', 'timeout') THEN false END", "false") if gateway else "false"
    awake = held("CASE WHEN kind = 'status' THEN vehicle_awake WHEN kind IN ('goodbye', 'timeout') THEN false WHEN kind = 'ethernet' AND link_up THEN true END", "false") if gateway else "false"
    window = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id, step ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT *, {awake} AS awake FROM (SELECT '{role}' AS role, *,
            {held("CASE WHEN kind IN ('ethernet', 'keepalive', 'hello', 'status', 'safety_probe') THEN 'Connected' WHEN kind = 'goodbye' THEN 'Reconnecting' WHEN kind = 'timeout' THEN '" + ("Reconnecting" if gateway else "Failed") + "' END", "'WaitingForPeer'")} AS connection,
            {held("CASE WHEN kind IN ('goodbye', 'timeout') THEN false WHEN kind <> 'ack' THEN true END", "false")} AS laptop, {link} AS link_up,
            {held("CASE WHEN kind IN ('ethernet', 'hello', 'status', 'safety_probe') THEN 'connected' WHEN kind = 'goodbye' THEN 'peer_disconnected' WHEN kind = 'timeout' THEN 'peer_timeout' END", "'starting'")} AS message,
            {held("CASE WHEN kind = 'keepalive' AND is_reply AND rtt > 0 THEN rtt END", "0.0")} AS rtt_local, {held("CASE WHEN kind = 'status' AND peer_rtt > 0 THEN peer_rtt END", "0.0") if gateway else "0.0"} AS rtt_peer,
            sum(CASE WHEN kind = 'timeout' THEN 1 ELSE 0 END) OVER w AS reconnects FROM lines {window}) {window}"""


_LINES_SQL = f"""f AS (SELECT user_id, ts, event_id, [{", ".join(f"'{k}'" for k in _KINDS)}][CAST((event_id * 7 + event_id // 5) % 8 AS INTEGER) + 1] AS kind, event_id % 2 = 0 AS is_reply, CAST(event_id % 5 AS DOUBLE) AS rtt,
        event_id % 3 > 0 AS vehicle_link, event_id % 4 = 0 AS vehicle_awake, CAST(event_id % 6 AS DOUBLE) AS peer_rtt, epoch_us(ts) - lag(epoch_us(ts)) OVER {_OVER}) > 14400000000 AS silent FROM events),
    lines AS (SELECT user_id, ts, event_id, CASE WHEN silent THEN 1 ELSE 0 END AS step, kind, is_reply, rtt, vehicle_link, vehicle_awake, peer_rtt FROM f
        UNION ALL SELECT user_id, ts, event_id, 0, 'timeout', is_reply, rtt, vehicle_link, vehicle_awake, peer_rtt FROM f WHERE silent)"""


@query(f"""WITH {_LINES_SQL}, s AS ({_states_sql("gateway")} UNION ALL {_states_sql("agent")})
    SELECT role, user_id, event_id, CAST(step AS INTEGER) AS step, kind, connection, laptop, link_up, awake, message, CAST(rtt_local AS DOUBLE) AS rtt_local, CAST(rtt_peer AS DOUBLE) AS rtt_peer, CAST(reconnects AS BIGINT) AS reconnects FROM s""")
def connection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connection's state after every frame and timeout (here silences of over four hours), on either side."""
    lines = telemetry.with_timeouts(frames_of(table(spark, sf_dir, "events")), KEY, ORDER, "ts", "kind", 4 * 3600, telemetry.steps("ts", 86_400))
    sides = [telemetry.connection_states(lines, KEY, [*ORDER, "step"], role).withColumn("role", F.lit(role)) for role in ("gateway", "agent")]
    return sides[0].unionByName(sides[1]).select("role", "user_id", "event_id", "step", "kind", "connection", "laptop", "link_up", "awake", "message", "rtt_local", "rtt_peer", "reconnects")


_MODES = ("lan", "relay", "wireguard")


def _mode() -> Column:
    return F.element_at(F.array(*map(F.lit, _MODES)), (F.col("user_id") % 3).cast("int") + 1)


@query(f"""WITH {_RING}, l AS (SELECT user_id, event_type, ts, {_GAP} AS lost FROM events {_W}),
    t AS (SELECT user_id, count(*) AS rx, min(ts) AS since, max(ts) AS until, CAST(sum(lost) AS BIGINT) AS lost, count(*) FILTER (event_type = 'purchase') > 5 AS awake, CAST(count(*) % 100 AS DOUBLE) AS cpu, ['lan', 'relay', 'wireguard'][user_id % 3 + 1] AS mode FROM l GROUP BY user_id),
    j AS (SELECT t.*, CASE WHEN r.user_id IS NULL THEN 0.0 ELSE {_GATE} END AS gate, t.lost / (greatest(t.rx, 1) + t.lost) AS loss, CASE mode WHEN 'lan' THEN 20.0 WHEN 'relay' THEN 80.0 ELSE 40.0 END AS most,
            CASE WHEN t.user_id % 2 = 0 THEN 0.95 ELSE 0.001 END AS most_loss FROM t LEFT JOIN (SELECT * FROM ranked WHERE back = 1) r ON r.user_id = t.user_id),
    f AS (SELECT *, list_filter([CASE WHEN NOT awake THEN 'asleep' END, CASE WHEN awake AND gate > most THEN 'rtt' END, CASE WHEN awake AND loss > most_loss AND {_PPS} > 0.5 THEN 'loss' END, CASE WHEN awake AND cpu > 80 THEN 'cpu' END, CASE WHEN awake AND rx < 20 THEN 'samples' END], lambda x: x IS NOT NULL) AS r FROM j),
    v AS (SELECT *, CASE WHEN len(r) = 0 THEN 'safe' WHEN NOT awake THEN 'not_ready' ELSE 'not_recommended' END || CASE WHEN len(r) > 0 THEN ': ' || array_to_string(r, '; ') ELSE '' END
            || CASE WHEN mode = 'lan' THEN '' WHEN len(r) = 0 THEN ' remote_safe' ELSE ' remote' END AS warning FROM f)
    SELECT user_id, mode, warning, '{{"user_id":' || CAST(user_id AS VARCHAR) || ',"state":{{"connection":"Connected","link_up":true,"awake":' || CAST(awake AS VARCHAR) || '}},"stats":{{"rx_packets":' || CAST(rx AS VARCHAR) || ',"seq_gaps":' || CAST(lost AS VARCHAR)
        || '}},"flash_safety":{{"safe":' || CAST(len(r) = 0 AS VARCHAR) || ',"warning":"' || warning || '"}},"network_mode":"' || mode || '","is_remote":' || CAST(mode <> 'lan' AS VARCHAR) || ',"password_set":' || CAST(user_id % 2 = 0 AS VARCHAR) || '}}' AS document FROM v
    UNION ALL SELECT -1, 'lan', 'not_recommended: no_status', '{{"user_id":-1,"flash_safety":{{"safe":false,"warning":"not_recommended: no_status"}},"network_mode":"lan","is_remote":false,"password_set":false}}'""")
def status_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each host as one JSON document: state, statistics, the gate by its mode's limits, and settings.

    A host (-1) of which nothing is known yet has the placeholder's verdict.
    """
    events = table(spark, sf_dir, "events")
    lost = events.select("user_id", "event_type", "ts", telemetry.lost_before(F.col("event_id"), telemetry.arrival(KEY, ORDER)).alias("lost"))
    totals = lost.groupBy("user_id").agg(F.count("*").alias("rx"), day_rate(F.count("*"), F.min("ts"), F.max("ts")).alias("pps"), F.sum("lost").alias("lost"), (F.count_if(F.col("event_type") == "purchase") > 5).alias("awake"))
    hosts = totals.select("user_id").union(spark.range(1).select(F.lit(-1).cast("bigint")))
    config = settings.with_mode_defaults(hosts.select("user_id", F.when(F.col("user_id") < 0, "lan").otherwise(_mode()).alias("mode"), F.lit(None).cast("double").alias("rtt_limit"), F.lit(None).cast("int").alias("timeout")), "mode")
    both = config.join(totals, "user_id", "left").join(telemetry.last_rtt(events, KEY, ORDER, "value"), "user_id", "left")
    rtt = F.coalesce(safety.gate_rtt(F.col("rtt_p50_ms"), F.col("rtt_p99_ms"), F.col("rtt_ms")), F.lit(0.0))
    most = safety.limits(rtt=F.col("rtt_limit_ms"), loss=F.when(F.col("user_id") % 2 == 0, 0.95))
    failed = safety.failed_checks(F.lit(True), F.col("awake"), F.lit(True), rtt, telemetry.loss_rate(F.col("rx"), F.col("lost")), F.col("pps"), (F.col("rx") % 100).cast("double"), F.col("rx"), most)
    judged = both.withColumn("failed", F.when(F.col("rx").isNull(), F.array(F.lit("no_status"))).otherwise(failed))
    code = F.when(F.col("rx").isNull(), "not_recommended").otherwise(safety.verdict(F.col("failed"), F.col("awake"), F.lit(True)))
    told = judged.withColumn("warning", safety.warning(code, F.col("failed"), F.col("mode") != "lan"))
    known = F.col("rx").isNotNull()
    document = F.to_json(
        F.struct(
            "user_id", F.when(known, F.struct(F.lit("Connected").alias("connection"), F.lit(True).alias("link_up"), "awake")).alias("state"), F.when(known, F.struct(F.col("rx").alias("rx_packets"), F.col("lost").alias("seq_gaps"))).alias("stats"),
            F.struct((F.size("failed") == 0).alias("safe"), "warning").alias("flash_safety"), F.col("mode").alias("network_mode"), (F.col("mode") != "lan").alias("is_remote"), ((F.col("user_id") >= 0) & (F.col("user_id") % 2 == 0)).alias("password_set"),
        )
    )
    return told.select("user_id", "mode", "warning", document.alias("document"))


@query("""WITH r AS (SELECT p_partkey AS k, 'v' || CAST(p_size % 4 AS VARCHAR) || '.' || CAST(p_partkey % 7 AS VARCHAR) || '.1' AS tag, p_size % 4 AS a, p_partkey % 7 AS b FROM part)
    SELECT k AS p_partkey, tag AS version, CASE WHEN k % 2 = 0 THEN 'api/' ELSE 'web/' END || 'app.zip' AS asset_url, CASE WHEN k % 3 = 0 THEN NULL ELSE CASE WHEN k % 2 = 0 THEN 'api/' ELSE 'web/' END || 'sums' END AS checksums_url,
        CASE WHEN k % 10 = 0 THEN '' ELSE repeat('n', CAST(least(k, 400) AS INTEGER)) END AS notes
    FROM r WHERE k % 11 > 0 AND k % 13 > 0 AND k % 5 > 0 AND (a > 1 OR (a = 1 AND b > 2) OR (a = 1 AND b = 2 AND 1 > 0))""")
def release_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases that update version 1.2.0: neither drafts nor pre-releases, with the wanted asset."""
    key = F.col("p_partkey")
    tag = F.concat(F.lit("v"), F.col("p_size") % 4, F.lit("."), key % 7, F.lit(".1"))
    asset = lambda name, file: F.struct(name.alias("name"), F.lit(f"web/{file}").alias("browser_download_url"), F.lit(f"api/{file}").alias("url"))
    assets = F.array(asset(F.lit("App.zip"), "other"), asset(F.when(key % 5 == 0, "none").otherwise("app.zip"), "app.zip"), asset(F.lit("app.zip"), "second"), asset(F.when(key % 3 == 0, "x").otherwise("Sha256Sums.TXT"), "sums"))
    assets = F.when(key % 5 == 0, F.slice(assets, 1, 2)).otherwise(assets)
    # as long as its number, but not without end: from 400 letters on, lengths of 400 to 1000 recur
    letters = F.least(key, F.lit(400) + F.pmod(key, F.lit(601))).cast("int")
    body = F.when(key % 10 > 0, F.repeat(F.lit("n"), letters))
    document = F.to_json(F.struct(tag.alias("tag_name"), body.alias("body"), (key % 11 == 0).alias("draft"), F.when(key % 13 == 0, True).alias("prerelease"), assets.alias("assets")))
    # a document takes far more work than the bytes of its row, of which a task reads megabytes
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey")
    return sources.newer_releases(parts.select("p_partkey", document.alias("json")), "json", F.lit("1.2.0"), F.lit("app.zip"), F.col("p_partkey") % 2 == 0)


@query("""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'gateway' WHEN 'assistant' THEN 'agent' ELSE role END AS role, upper('room' || CAST(conv_id % 50 AS VARCHAR)) AS code FROM conversations),
    e AS (SELECT conv_id, turn, CASE WHEN conv_id % 17 = 0 THEN NULL WHEN conv_id % 19 = 0 THEN NULL ELSE role END AS role, CASE WHEN conv_id % 17 = 0 OR conv_id % 13 = 0 THEN '' ELSE code END AS pair_code,
        CASE WHEN conv_id % 17 = 0 THEN 'bad_json' WHEN conv_id % 7 = 0 THEN 'bad_magic' WHEN conv_id % 13 = 0 OR conv_id % 19 = 0 OR role NOT IN ('gateway', 'agent') THEN 'need_role_and_code' END AS error FROM c) SELECT * FROM e""")
def relay_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join messages of a relay and what is wrong with them."""
    conv = F.col("conv_id")
    role = F.when(F.col("role") == "user", "gateway").when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
    hello = F.to_json(F.struct(F.when(conv % 7 == 0, "other").otherwise("RELAYJ01").alias("magic"), F.when(conv % 19 > 0, role).alias("role"), F.when(conv % 13 > 0, F.concat(F.lit("room"), conv % 50)).alias("pair_code")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(conv % 17 == 0, F.lit("{cut")).otherwise(hello).alias("hello"))
    return sources.parse_joins(rows, "hello", "RELAYJ01")


@query("""SELECT conv_id % 50 AS room, CAST(sum(CASE WHEN role = 'user' THEN strlen(text) ELSE 0 END) AS BIGINT) AS from_gateway, CAST(sum(CASE WHEN role = 'assistant' THEN strlen(text) ELSE 0 END) AS BIGINT) AS from_agent FROM conversations GROUP BY 1""")
def relay_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes each way through the rooms of a relay."""
    role = F.when(F.col("role") == "user", "gateway").when(F.col("role") == "assistant", "agent")
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("room"), role.alias("role"), "text")
    return matching.relayed_bytes(rows, "room", "role", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))


@query(f"""WITH a AS (SELECT c_nationkey AS client, c_custkey AS arrived, 0 AS socket, '10.1.' || CAST(c_custkey % 4 AS VARCHAR) || '.' || CAST(c_custkey % 9 AS VARCHAR) AS address, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Code' || CAST(c_custkey % 5 AS VARCHAR) END AS code FROM customer
        UNION ALL SELECT s_nationkey, s_suppkey, 1, '10.1.' || CAST(s_suppkey % 4 AS VARCHAR) || '.' || CAST(s_suppkey % 9 AS VARCHAR), 'CODE' || CAST(s_suppkey % 5 AS VARCHAR) FROM supplier),
    w AS (SELECT *, CASE WHEN client % 4 = 0 THEN '' ELSE 'code' || CAST(client % 5 AS VARCHAR) END AS wanted FROM a),
    f AS (SELECT *, row_number() OVER (PARTITION BY client, address ORDER BY arrived, socket) AS n FROM w WHERE wanted = '' OR code = '' OR lower(code) = lower(wanted))
    SELECT CAST(client AS INTEGER) AS client, address, arrived, CAST(socket AS INTEGER) AS socket FROM f WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY client ORDER BY CASE WHEN address = '10.1.1.5' THEN 0 ELSE 1 END, arrived, socket) = 1""")
def discovery_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gateway that each client takes: announcements on two sockets, by code and address, the cached hint first."""

    def announced(name: str, client: str, key: str, socket: int, code: Column) -> DataFrame:
        address = F.concat(F.lit("10.1."), F.col(key) % 4, F.lit("."), F.col(key) % 9)
        sent = wire.discovery_datagram(b"DISCOV01", "announce", hostname=F.lit("h"), pair_code=code)
        return table(spark, sf_dir, name).select(F.col(client).cast("int").alias("client"), F.col(key).alias("arrived"), F.lit(socket).alias("socket"), address.alias("address"), wire.announcement(sent, b"DISCOV01")["pair_code"].alias("pair_code"))

    key = F.col("c_custkey")
    heard = announced("customer", "c_nationkey", "c_custkey", 0, F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("Code"), key % 5)))
    both = heard.unionByName(announced("supplier", "s_nationkey", "s_suppkey", 1, F.concat(F.lit("CODE"), F.col("s_suppkey") % 5)))
    wanted = F.when(F.col("client") % 4 == 0, "").otherwise(F.concat(F.lit("code"), F.col("client") % 5))
    fitting = matching.discovered(both.withColumn("gateway", F.col("address")).withColumn("address", F.concat_ws("|", "client", "address")), wanted, ["arrived", "socket"])
    return matching.preferred(fitting.withColumn("address", F.col("gateway")), ["client"], F.lit("10.1.1.5"), ["arrived", "socket"]).select("client", "address", "arrived", "socket")


@query(f"SELECT DISTINCT substr({_SIP}, 1, length({_SIP}) - strpos(reverse({_SIP}), '.')) || '.255' AS target FROM supplier UNION SELECT '255.255.255.255'")
def broadcast_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a discovery query is sent."""
    local = table(spark, sf_dir, "supplier").select(supplier_ip().alias("ip")).union(spark.createDataFrame([("127.0.0.1",), ("169.254.1.1",)], "ip string"))
    return matching.broadcast_targets(local, "ip")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN 'new' WHEN c_custkey % 5 = 2 THEN '' ELSE 'old' END AS password_after,
    CASE WHEN c_custkey % 9 = 0 THEN false WHEN c_custkey % 4 = 0 OR c_custkey % 5 = 2 THEN CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 = 0 ELSE false END WHEN c_custkey % 5 = 1 THEN true ELSE c_custkey % 3 = 0 END AS crypto_after,
    CASE WHEN c_custkey % 6 = 0 THEN 'AB-1' WHEN c_custkey % 6 = 1 THEN 'NEW' || CAST(c_custkey AS VARCHAR) ELSE 'AB-1' END AS code_after, CASE c_custkey % 4 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' ELSE 'warn' END AS level_after,
    c_custkey % 4 = 0 OR c_custkey % 5 IN (1, 2) OR c_custkey % 9 = 0 OR c_custkey % 6 = 1 AS restart FROM customer""")
def settings_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial settings updates: passwords, encryption, pair codes and log levels."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("old").alias("password"), (key % 3 == 0).alias("require_crypto"), F.lit("AB-1").alias("pair_code"), F.lit("warn").alias("log_level"), F.when(key % 5 == 1, "new").when(key % 5 == 2, "").alias("new_password"),
        F.when(key % 4 == 0, True).alias("clear_password"), F.when(key % 9 == 0, False).alias("new_crypto"), F.when(key % 6 == 0, " ab-1 ").when(key % 6 == 1, F.concat(F.lit("new "), key)).when(key % 6 == 2, "  ").alias("new_code"),
        F.when(key % 4 == 0, "DEBUG").when(key % 4 == 1, "loud").alias("new_level"), (key % 2 == 0).alias("remote"),
    )
    return settings.updated(rows).select("c_custkey", "password_after", "crypto_after", "code_after", "level_after", "restart")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'hello' WHEN event_id % 3 = 1 THEN 'status' ELSE 'safety_probe' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'agent' END AS role, CASE WHEN event_id % 3 = 1 THEN event_id END AS packets_rx,
    CASE WHEN event_id % 3 = 1 THEN value > 250 END AS vehicle_link, CASE WHEN event_id % 3 = 2 THEN false END AS safe, CASE WHEN event_id % 3 = 2 THEN event_type || ',loss' END AS reasons, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS BOOLEAN) AS reply FROM events""")
def control_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control payloads and keepalives, encoded into frames and decoded again."""
    n = F.col("event_id")
    payload = F.when(n % 3 == 0, wire.control_json("hello", role=F.lit("agent"), version=F.lit("1"), hostname=F.lit("h"), require_crypto=F.lit(True)))
    payload = payload.when(n % 3 == 1, wire.control_json("status", vehicle_link=F.col("value") > 250, packets_rx=n, rtt_ms=F.col("value"))).otherwise(wire.control_json("safety_probe", safe=F.lit(False), reasons=F.array("event_type", F.lit("loss"))))
    raw = wire.encode_frame(F.lit(5), F.lit(0), n, payload.cast("binary"), wire.ms_low(F.col("ts")))
    alive = wire.decode_frame(wire.keepalive_frame(n, wire.ms_low(F.col("ts")), F.when(n % 2 == 0, 1).otherwise(0)))
    got = table(spark, sf_dir, "events").select("event_id", wire.control(wire.decode_frame(raw)["payload"].cast("string")).alias("c"), wire.is_keepalive_reply(alive["payload"]).alias("reply"))
    return got.select("event_id", "c.kind", "c.role", "c.packets_rx", "c.vehicle_link", "c.safe", F.array_join("c.reasons", ",").alias("reasons"), "reply")
