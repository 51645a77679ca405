"""Registered queries that join telemetry streams: as of a time, both directions, adapters and attempts, with their DuckDB counterparts.

The tables are mapped as in ``catalog``. Signups stand for probes of the link, errors for
samples of the host, views for captured frames, and all else for ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.functions import safety
from linkspan.operators import asof, matching, slot, telemetry
from linkspan.plans.catalog import KEY, ORDER, query, table
from linkspan.plans.folds import _CONFIGS, _PEER

_DAY = 86_400


@query("""WITH h AS (SELECT user_id % 10 AS host, ts, event_id, value AS cpu, event_id * 1000 AS memory FROM events WHERE event_type = 'error'),
    s AS (SELECT user_id, user_id % 10 AS host, ts, event_id FROM events WHERE event_type = 'purchase'),
    j AS (SELECT s.*, max({'ts': h.ts, 'id': h.event_id, 'cpu': h.cpu, 'memory': h.memory}) AS m FROM s LEFT JOIN h ON h.host = s.host AND h.ts <= s.ts GROUP BY ALL),
    a AS (SELECT user_id, event_id, CASE WHEN epoch_us(ts) - epoch_us(m.ts) <= 21600000000 THEN m.cpu END AS cpu_pct, CASE WHEN epoch_us(ts) - epoch_us(m.ts) <= 21600000000 THEN m.memory END AS memory FROM j)
    SELECT user_id, event_id, cpu_pct, memory, coalesce(cpu_pct, 0) > 80 AS too_busy FROM a""")
def host_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host's CPU and memory as of each status, from its own samples of the last six hours, and the gate's check of it."""
    events = table(spark, sf_dir, "events").withColumn("host", F.col("user_id") % 10)
    samples = events.where("event_type = 'error'").select("host", "ts", "event_id", F.col("value").alias("cpu_pct"), (F.col("event_id") * 1000).alias("memory"))
    statuses = events.where("event_type = 'purchase'").select("user_id", "host", "ts", "event_id")
    found = asof.as_of(statuses, samples, ["host"], "ts", ["cpu_pct", "memory"], ("event_id",), most_seconds=6 * 3600, step_seconds=_DAY)
    failed = safety.failed_checks(F.lit(True), F.lit(True), F.lit(True), F.lit(0.0), F.lit(0.0), F.lit(0), F.coalesce("cpu_pct", F.lit(0.0)), F.lit(100))
    return found.select("user_id", "event_id", "cpu_pct", "memory", F.array_contains(failed, "cpu").alias("too_busy"))


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'captured' WHEN 'signup' THEN 'probe' ELSE 'tick' END AS kind FROM events),
    p AS (SELECT f.user_id, f.ts, f.event_id, f.kind, arg_max(l.event_id % 3 > 0, l.ts) AS probe FROM e f LEFT JOIN e l ON l.kind = 'probe' AND l.user_id = f.user_id AND l.ts <= f.ts WHERE f.kind <> 'probe' GROUP BY ALL),
    k AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'tick' THEN coalesce(probe, false) END IGNORE NULLS) OVER w, false) AS link_up, last_value(CASE WHEN kind = 'captured' THEN epoch_us(ts) END IGNORE NULLS) OVER w AS active
        FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_id, kind, link_up, coalesce(last_value(CASE WHEN kind = 'captured' AND link_up THEN true WHEN kind = 'tick' AND (NOT link_up OR epoch_us(ts) - active > 14400000000) THEN false END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS awake FROM k""")
def agent_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent's link and awake flags after every frame and tick (here awake for four hours), from link probes of their own."""
    events = table(spark, sf_dir, "events")
    links = events.where("event_type = 'signup'").select("user_id", "ts", (F.col("event_id") % 3 > 0).alias("link_up"))
    kind = F.when(F.col("event_type") == "view", "captured").otherwise("tick")
    frames = events.where("event_type <> 'signup'").select("user_id", "ts", "event_id", kind.alias("kind"))
    out = asof.agent_vehicle(frames, links, KEY, ORDER, "ts", "kind", 4 * 3600, step_seconds=_DAY)
    return out.select("user_id", "event_id", "kind", "link_up", "awake")


_HOUR = 3600


@query(f"""WITH w AS (SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, count(*) FILTER (event_type IN ('click', 'purchase')) AS tx, count(*) FILTER (event_type NOT IN ('click', 'purchase')) AS rx,
        coalesce(sum(length(props)) FILTER (event_type IN ('click', 'purchase')), 0) AS tb, coalesce(sum(length(props)) FILTER (event_type NOT IN ('click', 'purchase')), 0) AS rb FROM events GROUP BY ALL)
    SELECT user_id, window_start, tx AS tx_packets, CAST(tb AS BIGINT) AS tx_bytes, rx AS rx_packets, CAST(rb AS BIGINT) AS rx_bytes, round(tx / {_HOUR}.0, 9) AS tx_pps, round(rx / {_HOUR}.0, 9) AS rx_pps,
        round(tb * 8 / {_HOUR}.0, 9) AS tx_bps, round(rb * 8 / {_HOUR}.0, 9) AS rx_bps, tx / {_HOUR}.0 + rx / {_HOUR}.0 > 0.5 AS quality_counts FROM w""")
def both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and bits a second each way (clicks and purchases are sent), in hours in which there is either."""
    events, sent = table(spark, sf_dir, "events"), F.col("event_type").isin("click", "purchase")
    out = telemetry.both_rates(events.where(sent), events.where(~sent), KEY, "ts", F.length("props"), _HOUR)
    return out.withColumns({c: F.round(c, 9) for c in ("tx_pps", "rx_pps", "tx_bps", "rx_bps")})


@query("""WITH d AS (SELECT *, CASE event_type WHEN 'click' THEN 'tx' WHEN 'purchase' THEN 'dropped' WHEN 'error' THEN 'error' ELSE 'rx' END AS way, CASE WHEN event_type IN ('view', 'signup') AND event_type = 'view' THEN event_id END AS seq FROM events),
    g AS (SELECT *, seq - last_value(seq IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS gap FROM d)
    SELECT user_id, count(*) FILTER (way = 'tx') AS tx_packets, count(*) FILTER (way = 'rx') AS rx_packets, CAST(coalesce(sum(length(props)) FILTER (way = 'tx'), 0) AS BIGINT) AS tx_bytes, CAST(coalesce(sum(length(props)) FILTER (way = 'rx'), 0) AS BIGINT) AS rx_bytes,
        count(*) FILTER (way = 'dropped') AS dropped, count(*) FILTER (way = 'error') AS errors, CAST(0 AS BIGINT) AS reconnects, CAST(coalesce(sum(gap) FILTER (gap BETWEEN 1 AND 64), 0) AS BIGINT) AS seq_gaps FROM g GROUP BY user_id""")
def direction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetime counters of both directions; only views have a sequence that loss is judged by."""
    kind = F.col("event_type")
    way = F.when(kind == "click", "tx").when(kind == "purchase", "dropped").when(kind == "error", "error").otherwise("rx")
    return telemetry.lifetime(table(spark, sf_dir, "events"), KEY, way, F.length("props"), F.when(kind == "view", F.col("event_id")), ORDER)


@query("""WITH a AS (SELECT upper(split_part(p_name, ' ', 1 + p_partkey % 2)) AS adapter, min(p_partkey) AS place FROM part WHERE p_partkey % 5 = 0 GROUP BY 1 UNION ALL SELECT 'zz', 1 UNION ALL SELECT 'd', 1000000),
    h AS (SELECT p_partkey, p_name, p_type, arg_min(adapter, place) AS adapter FROM part JOIN a ON contains(lower(p_name), lower(adapter)) OR contains(lower(p_type), lower(adapter)) WHERE p_size % 7 > 0 GROUP BY ALL) SELECT * FROM h""")
def adapter_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices whose name or description contains an adapter's, from a table of adapters in their order; loopback devices (some sizes) never do."""
    part = table(spark, sf_dir, "part")
    word = F.upper(F.split_part("p_name", F.lit(" "), (F.col("p_partkey") % 2 + 1).cast("int")))
    adapters = part.where("p_partkey % 5 = 0").groupBy(word.alias("adapter")).agg(F.min("p_partkey").alias("place"))
    adapters = adapters.union(spark.createDataFrame([("zz", 1), ("d", 1_000_000)], "adapter string, place bigint"))
    return matching.devices_containing(part.select("p_partkey", "p_name", "p_type", "p_size"), ["p_name", "p_type"], adapters, "adapter", "place", F.col("p_size") % 7 == 0).drop("p_size")


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'failed' WHEN 'click' THEN 'dropped' WHEN 'signup' THEN 'unset' WHEN 'purchase' THEN 'connected' ELSE 'changed' END AS kind FROM events),
    r AS (SELECT *, sum(CASE WHEN kind = 'connected' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
    a AS (SELECT *, CAST(sum(CASE WHEN kind IN ('failed', 'dropped', 'unset') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt FROM r),
    d AS (SELECT *, CAST(CASE WHEN kind = 'unset' THEN 2000 WHEN kind IN ('failed', 'dropped') THEN least(CAST(3600000 AS BIGINT) * (1 << CAST(least(attempt, 10) AS INTEGER)), 43200000) ELSE 0 END AS BIGINT) AS delay_ms FROM a)
    SELECT user_id, event_id, kind, attempt, delay_ms, kind IN ('failed', 'connected', 'unset') AND coalesce(epoch_us(ts) < lag(epoch_us(ts) + delay_ms * 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS early FROM d""")
def reconnect_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts since the last connection, their delays (here from one hour to twelve), and those that came too early."""
    kind = F.when(F.col("event_type") == "view", "failed").when(F.col("event_type") == "click", "dropped").when(F.col("event_type") == "signup", "unset").when(F.col("event_type") == "purchase", "connected").otherwise("changed")
    out = telemetry.reconnects(table(spark, sf_dir, "events").withColumn("kind", kind), KEY, ORDER, "ts", "kind", 3_600_000, 43_200_000)
    return out.select("user_id", "event_id", "kind", "attempt", "delay_ms", "early")


_SILENT_MS = 24 * 3600 * 1000


@query(f"""WITH RECURSIVE p AS (SELECT user_id, event_id, epoch_us(ts) AS us, '10.0.0.' || CAST(event_id % 3 AS VARCHAR) AS ip, CAST(47900 + event_id // 3 % 3 AS INTEGER) AS port, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    c AS (SELECT * FROM (VALUES {", ".join(f"('{role}{'_peer' * peer}', '{role}', {str(peer).lower()})" for role, peer in _CONFIGS)}) AS x(config, role, configured)),
    f AS (SELECT config, role, configured, user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome, CASE WHEN configured THEN '{_PEER[0]}' END AS slot_ip, CASE WHEN configured THEN {_PEER[1]} END AS slot_port, us AS last, CAST(0 AS BIGINT) AS epoch, CAST(0 AS BIGINT) AS timeouts FROM c, p WHERE n = 1
        UNION ALL
        SELECT config, role, configured, user_id, n, event_id, outcome, CASE WHEN outcome IN ('ignored', 'passed') THEN s_ip ELSE ip END, CASE WHEN outcome IN ('ignored', 'passed') THEN s_port ELSE port END, CASE WHEN outcome = 'ignored' THEN last ELSE us END,
            epoch + CASE WHEN outcome IN ('learned', 'switched', 'replaced', 'port_changed') THEN 1 ELSE 0 END, timeouts + CASE WHEN gone THEN 1 ELSE 0 END
        FROM (SELECT *, CASE WHEN s_ip IS NULL THEN 'learned' WHEN ip = s_ip THEN CASE WHEN port = s_port THEN 'same' ELSE 'port_changed' END WHEN configured THEN CASE WHEN role = 'agent' AND port = {_PEER[1]} THEN 'switched' ELSE 'ignored' END
                WHEN role = 'gateway' THEN 'replaced' ELSE 'passed' END AS outcome
            FROM (SELECT *, CASE WHEN gone THEN NULL ELSE slot_ip END AS s_ip, CASE WHEN gone THEN NULL ELSE slot_port END AS s_port
                FROM (SELECT f.config, f.role, f.configured, f.slot_ip, f.slot_port, f.last, f.epoch, f.timeouts, p.*, f.slot_ip IS NOT NULL AND p.us - f.last > {_SILENT_MS}000 AS gone FROM f JOIN p ON p.user_id = f.user_id AND p.n = f.n + 1))))
    SELECT config, user_id, event_id, outcome, outcome = 'ignored' AS dropped, epoch, timeouts, slot_ip || ':' || CAST(slot_port AS VARCHAR) AS peer FROM f WHERE n > 0""")
def peer_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the peer slot makes of each packet where a day's silence empties it, and the peer it then holds, for four configurations."""
    n = F.col("event_id")
    packets = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.concat(F.lit("10.0.0."), n % 3).alias("ip"), (F.expr("event_id div 3 % 3") + 47900).cast("int").alias("port"))
    found = [slot.admitted(packets, KEY, ORDER, "ts", "ip", "port", role, _PEER if peer else None, _SILENT_MS).withColumn("config", F.lit(role + "_peer" * peer)) for role, peer in _CONFIGS]
    out = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return out.select("config", "user_id", "event_id", "outcome", "dropped", "epoch", "timeouts", F.concat_ws(":", "peer_ip", "peer_port").alias("peer"))


@query("""WITH p AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'goodbye' ELSE 'ethernet' END AS kind, '10.0.0.' || CAST(event_id % 3 AS VARCHAR) || ':' || CAST(47900 + event_id // 3 % 3 AS VARCHAR) AS peer FROM events)
    SELECT user_id, event_id, kind, nullif(coalesce(last_value(CASE WHEN kind = 'goodbye' THEN '' ELSE peer END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), ''), '') AS peer_endpoint FROM p""")
def peer_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peer that a gateway's state shows after each packet; goodbyes (here errors) clear it."""
    n = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "goodbye").otherwise("ethernet")
    packets = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("kind"), F.concat(F.lit("10.0.0."), n % 3).alias("ip"), (F.expr("event_id div 3 % 3") + 47900).cast("int").alias("port"))
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (_DAY * 1_000_000))
    out = slot.peer_endpoint(slot.admitted(packets, KEY, ORDER, "ts", "ip", "port", "gateway"), KEY, ORDER, "kind", day)
    return out.select("user_id", "event_id", "kind", "peer_endpoint")
