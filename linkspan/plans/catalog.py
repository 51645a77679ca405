"""The registered queries and their DuckDB counterparts.

The tables hold no frames, so telemetry is mapped: a stream is a user of ``events``, arrival
order is (ts, event_id), the sequence is event_id, the round trip is value, the size is the
length of props, and event types stand for frame types, with ``error`` for an unknown one.
Customers, suppliers and parts stand for addresses, links and interfaces. Where the gate asks for
packets a second, a day of the events stands for a second.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.functions import net, safety, wire
from linkspan.operators import matching, settings, telemetry
from linkspan.sources import frames as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY, ORDER = ["user_id"], ["ts", "event_id"]
TYPES = {"view": 1, "click": 2, "signup": 3, "purchase": 5, "error": 9}
_TYPE_SQL = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 5 ELSE 9 END"
_GAP = "CASE WHEN event_id - lag(event_id) OVER w - 1 BETWEEN 1 AND 64 THEN event_id - lag(event_id) OVER w - 1 ELSE 0 END"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_RING = """
    ring AS (SELECT user_id, event_id, value, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)) AS r,
                    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back
             FROM events WHERE value > 0 AND value <= 2000),
    ranked AS (SELECT user_id, event_id, back, r[CAST(floor((len(r) - 1) * 0.5 + 0.5) AS INTEGER) + 1] AS p50, r[CAST(floor((len(r) - 1) * 0.99 + 0.5) AS INTEGER) + 1] AS p99, value AS last FROM ring)"""
#: Packets a second of all a stream's events, both ways together, from a row ``t`` of their number and time.
_PPS = "(rx / greatest((epoch_us(until) - epoch_us(since)) / 86400000000.0, 0.001))"
_GATE = "CASE WHEN p50 > 0 AND p99 > 3 * p50 AND p99 > 40 THEN greatest(p50, least(last, 2 * p50)) ELSE greatest(p99, last) END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_rate(packets: Column, since: Column, until: Column) -> Column:
    """Packets a second between two times, a day of which stands for a second."""
    days = (F.unix_micros(until.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 86_400_000_000
    return packets / F.greatest(days, F.lit(0.001))


def frame_type() -> Column:
    out = F.lit(TYPES["error"])
    for name, code in TYPES.items():
        out = F.when(F.col("event_type") == name, code).otherwise(out)
    return out


def customer_ip() -> Column:
    return net.dotted(F.lit(10 << 24) + F.col("c_custkey") * 3)


def supplier_ip() -> Column:
    return net.dotted(F.lit(10 << 24) + F.col("s_suppkey") * 21)


def _ip_sql(n: str) -> str:
    return f"('10.' || CAST((({n}) >> 16) & 255 AS VARCHAR) || '.' || CAST((({n}) >> 8) & 255 AS VARCHAR) || '.' || CAST(({n}) & 255 AS VARCHAR))"


_CIP, _SIP = _ip_sql("c_custkey * 3"), _ip_sql("s_suppkey * 21")


@query(f"""WITH l AS (SELECT user_id, CAST(ts AS DATE) AS day, {_GAP} AS lost FROM events {_W})
    SELECT user_id, day, count(*) AS rx_packets, CAST(sum(lost) AS BIGINT) AS lost, round(sum(lost) / (greatest(count(*), 1) + sum(lost)), 9) AS loss_rate FROM l GROUP BY ALL""")
def link_quality_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received, lost and loss rate of each stream and day."""
    out = telemetry.link_quality(table(spark, sf_dir, "events"), KEY, ORDER, "event_id", F.to_date("ts"), telemetry.steps("ts", 86_400))
    return out.withColumn("loss_rate", F.round("loss_rate", 9))


@query("""WITH s AS (SELECT user_id, event_id % 97 AS seq, ts, event_id FROM events), l AS (SELECT user_id, seq - lag(seq) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS gap FROM s)
    SELECT user_id, count(*) AS rx_packets, CAST(sum(CASE WHEN gap BETWEEN 1 AND 64 THEN gap ELSE 0 END) AS BIGINT) AS lost FROM l GROUP BY user_id""")
def loss_arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss with backward steps: arrival order counts, never sequence order."""
    rows = table(spark, sf_dir, "events").withColumn("seq", F.col("event_id") % 97)
    lost = telemetry.lost_before(F.col("seq"), telemetry.arrival(KEY, ORDER))
    return rows.select("user_id", lost.alias("lost")).groupBy("user_id").agg(F.count("*").alias("rx_packets"), F.sum("lost").alias("lost"))


@query("""SELECT user_id, count(*) FILTER (event_type <> 'error') AS rx_packets, CAST(sum(CASE WHEN event_type <> 'error' THEN length(props) ELSE 0 END) AS BIGINT) AS rx_bytes,
    count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS reconnects FROM events GROUP BY user_id""")
def lifetime_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetime counters of each stream."""
    ok = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(ok).alias("rx_packets"), F.sum(F.when(ok, F.length("props")).otherwise(0)).alias("rx_bytes"), F.count_if(~ok).alias("errors"), F.count_if(F.col("event_type") == "signup").alias("reconnects"))


@query("""SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS packets, CAST(sum(length(props)) AS BIGINT) AS bytes, round(count(*) / 3600.0, 9) AS pps, round(sum(length(props)) * 8 / 3600.0, 9) AS bps
    FROM events GROUP BY user_id, date_trunc('hour', ts)""")
def window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and bits a second of each stream and hour."""
    out = telemetry.rates(table(spark, sf_dir, "events"), KEY, "ts", F.length("props"), 3600)
    return out.withColumns({c: F.round(c, 9) for c in ("pps", "bps")})


@query(f"WITH {_RING} SELECT user_id, event_id, p50 AS rtt_p50_ms, p99 AS rtt_p99_ms, last AS rtt_ms FROM ranked")
def rtt_ring_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles of the last 48 samples after every sample."""
    return telemetry.rtt_ring(table(spark, sf_dir, "events"), KEY, ORDER, "value", ["event_id"])


@query(f"WITH {_RING} SELECT user_id, p50 AS rtt_p50_ms, p99 AS rtt_p99_ms, last AS rtt_ms, {_GATE} AS gate_ms, greatest({_GATE}, 100.0) AS worst_ms FROM ranked WHERE back = 1")
def rtt_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip to judge of each stream, and the worse of it and the other direction's (here 100)."""
    out = telemetry.last_rtt(table(spark, sf_dir, "events"), KEY, ORDER, "value")
    gate = safety.gate_rtt(F.col("rtt_p50_ms"), F.col("rtt_p99_ms"), F.col("rtt_ms"))
    return out.withColumn("gate_ms", gate).withColumn("worst_ms", F.greatest("gate_ms", F.lit(100.0)))


@query(f"""WITH {_RING}, l AS (SELECT user_id, event_type, ts, value, {_GAP} AS lost FROM events {_W}),
    t AS (SELECT user_id, count(*) AS rx, min(ts) AS since, max(ts) AS until, sum(lost) AS lost, count(*) FILTER (event_type = 'error') * 5 < count(*) AS link_up, count(*) FILTER (event_type = 'purchase') > 5 AS awake,
                 count(*) FILTER (event_type = 'signup') > 0 AS connected, CAST(count(*) % 100 AS DOUBLE) AS cpu FROM l GROUP BY user_id),
    j AS (SELECT t.*, CASE WHEN r.user_id IS NULL THEN 0.0 ELSE {_GATE} END AS gate, t.lost / (greatest(t.rx, 1) + t.lost) AS loss FROM t LEFT JOIN (SELECT * FROM ranked WHERE back = 1) r ON r.user_id = t.user_id),
    f AS (SELECT user_id, link_up AND awake AS ready, connected, list_filter([CASE WHEN NOT connected THEN 'peer' END, CASE WHEN NOT link_up THEN 'link' WHEN NOT awake THEN 'asleep' END, CASE WHEN link_up AND awake AND gate > 20 THEN 'rtt' END,
        CASE WHEN link_up AND awake AND loss > 0.001 AND {_PPS} > 0.5 THEN 'loss' END, CASE WHEN link_up AND awake AND cpu > 80 THEN 'cpu' END, CASE WHEN link_up AND awake AND rx < 20 THEN 'samples' END], lambda x: x IS NOT NULL) AS r FROM j)
    SELECT user_id, len(r) = 0 AS safe, array_to_string(r, ',') AS reasons, CASE WHEN len(r) = 0 THEN 'safe' WHEN NOT ready AND connected THEN 'not_ready' ELSE 'not_recommended' END AS verdict FROM f""")
def safety_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The safety gate of each stream."""
    events = table(spark, sf_dir, "events")
    share = lambda kind: F.count_if(F.col("event_type") == kind)
    lost = events.select("user_id", "event_type", "ts", telemetry.lost_before(F.col("event_id"), telemetry.arrival(KEY, ORDER)).alias("lost"))
    totals = lost.groupBy("user_id").agg(F.count("*").alias("rx"), day_rate(F.count("*"), F.min("ts"), F.max("ts")).alias("pps"), F.sum("lost").alias("lost"), (share("error") * 5 < F.count("*")).alias("link_up"), (share("purchase") > 5).alias("awake"), (share("signup") > 0).alias("connected"))
    both = totals.join(telemetry.last_rtt(events, KEY, ORDER, "value"), "user_id", "left")
    rtt = F.coalesce(safety.gate_rtt(F.col("rtt_p50_ms"), F.col("rtt_p99_ms"), F.col("rtt_ms")), F.lit(0.0))
    failed = safety.failed_checks(F.col("link_up"), F.col("awake"), F.col("connected"), rtt, telemetry.loss_rate(F.col("rx"), F.col("lost")), F.col("pps"), (F.col("rx") % 100).cast("double"), F.col("rx"))
    judged = both.withColumn("failed", failed)
    return judged.select("user_id", (F.size("failed") == 0).alias("safe"), F.array_join("failed", ",").alias("reasons"), safety.verdict(F.col("failed"), F.col("link_up") & F.col("awake"), F.col("connected")).alias("verdict"))


@query(f"WITH l AS (SELECT user_id, {_GAP} AS lost FROM events WHERE event_type = 'view' {_W}) SELECT user_id, count(*) AS rx_packets, CAST(sum(lost) AS BIGINT) AS lost FROM l GROUP BY user_id")
def data_plane_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss over data frames only: other frames draw numbers too, and leave phantom gaps."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    lost = telemetry.lost_before(F.col("event_id"), telemetry.arrival(KEY, ORDER))
    return rows.select("user_id", lost.alias("lost")).groupBy("user_id").agg(F.count("*").alias("rx_packets"), F.sum("lost").alias("lost"))


@query("""WITH c AS (SELECT *, CASE WHEN user_id <> lag(user_id) OVER w THEN 1 ELSE 0 END AS changed FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    e AS (SELECT *, sum(changed) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM c),
    g AS (SELECT event_type, epoch, event_id - lag(event_id) OVER (PARTITION BY event_type, epoch ORDER BY ts, event_id) - 1 AS gap FROM e),
    s AS (SELECT event_type, epoch, sum(CASE WHEN gap BETWEEN 1 AND 64 THEN gap ELSE 0 END) AS lost FROM g GROUP BY ALL)
    SELECT event_type, CAST(max(epoch) + 1 AS BIGINT) AS epochs, CAST(sum(lost) AS BIGINT) AS seq_gaps, CAST(max_by(lost, epoch) AS BIGINT) AS window_loss FROM s GROUP BY event_type""")
def peer_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of peer within a stream (here event_type) restart loss tracking."""
    return telemetry.epoch_loss(table(spark, sf_dir, "events"), ["event_type"], ORDER, "user_id", "event_id", F.expr("unix_seconds(cast(ts as timestamp)) div 86400"))


@query(f"""WITH l AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS silent FROM events {_W})
    SELECT user_id, count(*) FILTER (silent > 21600000000) AS reconnects, CAST(coalesce(max(silent), 0) AS BIGINT) AS longest_us FROM l GROUP BY user_id""")
def peer_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of over six hours."""
    return telemetry.timeouts(table(spark, sf_dir, "events"), KEY, ORDER, "ts", 6 * 3600)


@query(f"""WITH l AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opened FROM events {_W}),
    s AS (SELECT user_id, ts, sum(opened) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM l)
    SELECT user_id, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS frames FROM s GROUP BY user_id, n""")
def awake_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six hours of silence."""
    return telemetry.awake_sessions(table(spark, sf_dir, "events"), KEY, "ts", "6 hours")


_STATES = """st AS (SELECT user_id, ts, event_id, event_type AS connection, event_type <> 'error' AS laptop, value > 250 AS link_up, value > 100 AS awake,
    CASE WHEN event_type = 'purchase' THEN CAST(event_id % 3 AS VARCHAR) ELSE '' END AS peer FROM events)"""


@query(f"""WITH {_STATES}, p AS (SELECT *, lag(connection, 1, 'Starting') OVER w AS c0, lag(laptop, 1, false) OVER w AS l0, lag(link_up, 1, false) OVER w AS k0, lag(awake, 1, false) OVER w AS a0,
        last_value(nullif(peer, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p0 FROM st WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    x AS (SELECT user_id, ts, event_id, list_filter([CASE WHEN connection <> c0 THEN 'info state:' || connection END, CASE WHEN laptop AND NOT l0 THEN 'info laptop_on' WHEN NOT laptop AND l0 THEN 'warn laptop_off' END,
        CASE WHEN peer <> '' AND peer IS DISTINCT FROM p0 THEN 'info peer:' || peer END, CASE WHEN link_up AND NOT k0 THEN 'info link_on' WHEN NOT link_up AND k0 THEN 'warn link_off' END,
        CASE WHEN awake AND NOT a0 THEN 'info awake' WHEN NOT awake AND a0 THEN 'info asleep' END], lambda z: z IS NOT NULL) AS lines FROM p),
    y AS (SELECT user_id, ts, event_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS n FROM x)
    SELECT user_id, ts, event_id, CAST(n AS INTEGER) AS line_no, split_part(line, ' ', 1) AS level, split_part(line, ' ', 2) AS message FROM y""")
def state_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity rows from changes of state."""
    states = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", F.col("event_type").alias("connection"), (F.col("event_type") != "error").alias("laptop"), (F.col("value") > 250).alias("link_up"), (F.col("value") > 100).alias("awake"),
        F.when(F.col("event_type") == "purchase", (F.col("event_id") % 3).cast("string")).otherwise("").alias("peer"),
    )
    return telemetry.timeline(states, KEY, ORDER)


@query(f"WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before FROM events {_W}) SELECT user_id, event_id, event_type FROM l WHERE event_type IS DISTINCT FROM before")
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line only where it differs from the one before."""
    return telemetry.changed_lines(table(spark, sf_dir, "events"), KEY, ORDER, "event_type").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 48")
def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 48 rows of each stream."""
    return telemetry.last_n(table(spark, sf_dir, "events"), KEY, ORDER, 48).select("user_id", "event_id", "value")


@query(f"WITH n AS (SELECT user_id, event_id, row_number() OVER w AS s FROM events {_W}) SELECT user_id, event_id, CAST(s AS BIGINT) AS sequence, s % 5 = 1 AS hello, s % 4 = 0 AS status FROM n")
def sequence_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers, and the ticks at which hello and status are due."""
    s = F.col("sequence")
    return telemetry.assign_sequence(table(spark, sf_dir, "events"), KEY, ORDER).select("user_id", "event_id", s.cast("bigint").alias("sequence"), (s % 5 == 1).alias("hello"), (s % 4 == 0).alias("status"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NULL AS missing FROM events")
def control_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON payloads, read with a fixed schema."""
    got = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", got.alias("k"), got.isNull().alias("missing"))


@query(f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'BadFrameType' END AS error, CASE WHEN event_type <> 'error' THEN CAST({_TYPE_SQL} AS SMALLINT) END AS frame_type, CASE WHEN event_type <> 'error' THEN CAST(event_id * 1000003 AS BIGINT) END AS sequence,
    CASE WHEN event_type <> 'error' THEN CAST(strlen(props) AS INTEGER) END AS payload_len, CASE WHEN event_type <> 'error' THEN (epoch_us(ts) // 1000) % 4294967296 END AS timestamp_ms_lo, CASE WHEN event_type <> 'error' THEN props END AS payload FROM events""")
def header_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames encoded to bytes and decoded again."""
    rows = table(spark, sf_dir, "events")
    raw = wire.encode_frame(frame_type(), F.lit(0), F.col("event_id") * 1000003, F.col("props").cast("binary"), wire.ms_low(F.col("ts")))
    got = rows.select("event_id", wire.decode_frame(raw).alias("f"))
    return got.select("event_id", "f.error", "f.frame_type", F.col("f.sequence").cast("bigint").alias("sequence"), "f.payload_len", "f.timestamp_ms_lo", F.col("f.payload").cast("string").alias("payload"))


@query("""SELECT CASE event_type WHEN 'view' THEN 'ethernet' WHEN 'click' THEN 'keepalive' WHEN 'signup' THEN 'hello' WHEN 'purchase' THEN 'status' END AS frame_type, count(*) AS frames FROM events GROUP BY 1""")
def frame_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by type; unknown codes have none."""
    return table(spark, sf_dir, "events").groupBy(wire.frame_type_name(frame_type()).alias("frame_type")).agg(F.count("*").alias("frames"))


@query("SELECT source, count(*) FILTER (strlen(text) <= 1518 AND strlen(text) >= 14) AS accepted, count(*) FILTER (strlen(text) > 1518) AS dropped, count(*) FILTER (strlen(text) < 14) AS ignored FROM documents GROUP BY source")
def oversize_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by size: accepted, dropped as too long, ignored as too short."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(wire.fits_wire(text) & wire.is_capture(text)).alias("accepted"), F.count_if(~wire.fits_wire(text)).alias("dropped"), F.count_if(~wire.is_capture(text)).alias("ignored"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n FROM l WHERE line <> ''),
    e AS (SELECT *, coalesce(min(CASE WHEN strlen(line) > 1558 THEN n END) OVER (PARTITION BY doc_id), 2147483647) AS stop FROM k)
    SELECT doc_id, CAST(n AS INTEGER) AS frame_no, CASE WHEN n < stop THEN CAST(strlen(line) AS INTEGER) END AS bytes, CASE WHEN n < stop THEN md5(line) END AS digest, CASE WHEN n = stop THEN 'bad_length' END AS error FROM e WHERE n <= stop""")
def deframe_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, written length-prefixed into one blob, and split again; a line over the limit ends its blob."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    blob = F.unhex(F.array_join(F.transform(lines, lambda x: F.hex(wire.length_prefixed(x.cast("binary")))), ""))
    found = sources.deframe(table(spark, sf_dir, "documents").select("doc_id", blob.alias("blob")), "blob", "doc_id")
    return found.select("doc_id", "frame_no", F.octet_length("body").alias("bytes"), F.md5("body").alias("digest"), "error")


@query(f"""WITH l AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) % 4294967296 AS now, lag((epoch_us(ts) // 1000) % 4294967296) OVER w AS sent FROM events {_W}), g AS (SELECT *, (now - sent + 4294967296) % 4294967296 AS gone, (5 - (4294967290 - now % 50) + 4294967296) % 4294967296 AS wrapped FROM l)
    SELECT user_id, event_id, CASE WHEN sent IS NULL THEN NULL WHEN gone > 60000 THEN 0.0 ELSE CAST(gone AS DOUBLE) END AS rtt_ms, CAST(wrapped AS DOUBLE) AS wrapped_ms FROM g""")
def rtt_wraparound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips by wrapping subtraction, also across the wrap."""
    now = wire.ms_low(F.col("ts"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", now.alias("now"), F.lag(now).over(telemetry.arrival(KEY, ORDER)).alias("sent"))
    rtt = F.when(F.col("sent").isNotNull(), wire.rtt_from_low(F.col("now"), F.col("sent")))
    return rows.select("user_id", "event_id", rtt.alias("rtt_ms"), wire.rtt_from_low(F.lit(5), F.lit(4294967290) - F.col("now") % 50).alias("wrapped_ms"))


@query("SELECT event_id, CAST(least(500 * (1 << CAST(least(event_id % 20, 10) AS INTEGER)), 10000) AS BIGINT) AS delay_ms FROM events")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays of reconnect attempts."""
    return table(spark, sf_dir, "events").select("event_id", safety.backoff_ms(F.lit(500).cast("bigint"), F.lit(10000).cast("bigint"), F.col("event_id") % 20).alias("delay_ms"))


@query(f"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'fd00:' || CAST(c_custkey % 10 AS VARCHAR) || '::' || CAST(c_custkey % 100 AS VARCHAR) ELSE {_CIP} END AS ip, 167772160 + c_custkey * 3 AS n FROM customer), s AS (SELECT 167772160 + s_suppkey * 21 AS net, 22 + s_suppkey % 11 AS bits FROM supplier)
    SELECT c_custkey, ip FROM c WHERE CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 10 IN (2, 4) OR (c_custkey % 10 = 6 AND c_custkey % 100 = 16) ELSE EXISTS (SELECT 1 FROM s WHERE n >> (32 - bits) = net >> (32 - bits)) END""")
def cidr_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of customers, some of them IPv6, that suppliers' and a few other prefixes allow."""
    v6 = F.concat(F.lit("fd00:"), F.col("c_custkey") % 10, F.lit("::"), F.col("c_custkey") % 100)
    packets = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, v6).otherwise(customer_ip()).alias("ip"))
    bits = F.col("s_suppkey") % 11 + 22
    cidrs = table(spark, sf_dir, "supplier").select(F.when(bits == 32, supplier_ip()).otherwise(F.concat_ws("/", supplier_ip(), bits)).alias("cidr"))
    more = spark.createDataFrame([("fd00:2::/32",), ("fd00:4::/112",), ("fd00:6::16",), ("fd00::/129",), ("junk",)], "cidr string")
    return matching.allowed(packets, "ip", cidrs.union(more), "cidr")


@query(f"SELECT c_custkey, {_CIP} AS ip FROM customer WHERE {_CIP} NOT IN (SELECT {_SIP} FROM supplier)")
def own_address_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of customers that are no supplier's own."""
    own = table(spark, sf_dir, "supplier").select(supplier_ip().alias("ip"))
    return matching.not_own(table(spark, sf_dir, "customer").select("c_custkey", customer_ip().alias("ip")), own, "ip").select("c_custkey", "ip")


@query("""WITH n AS (SELECT n_nationkey, CASE n_nationkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'codeÉ' ELSE 'code' || CAST(n_regionkey AS VARCHAR) END AS q FROM nation), r AS (SELECT r_regionkey, CASE r_regionkey WHEN 4 THEN '' WHEN 3 THEN 'CODEé' ELSE 'CODE' || CAST(r_regionkey AS VARCHAR) END AS a FROM region)
    SELECT n_nationkey, r_regionkey, q, a FROM n JOIN r ON q = '' OR a = '' OR translate(q, 'CDEO', 'cdeo') = translate(a, 'CDEO', 'cdeo')""")
def wildcard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and announcements by pair code, with wildcards; only the case of ASCII letters is ignored."""
    asked = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 7 == 0, "").when(F.col("n_nationkey") % 7 == 1, "codeÉ").otherwise(F.concat(F.lit("code"), "n_regionkey")).alias("q"))
    offered = table(spark, sf_dir, "region").select("r_regionkey", F.when(F.col("r_regionkey") == 4, "").when(F.col("r_regionkey") == 3, "CODEé").otherwise(F.concat(F.lit("CODE"), "r_regionkey")).alias("a"))
    return matching.wildcard_pairs(asked, offered, "q", "a")


@query(f"""WITH a AS (SELECT 'if' || CAST(c_custkey % 40 AS VARCHAR) AS name, CASE WHEN c_custkey % 31 = 0 THEN '169.254.' || CAST(c_custkey % 200 AS VARCHAR) || '.1' ELSE {_CIP} END AS ip FROM customer), g AS (SELECT name, list_sort(list(DISTINCT ip)) AS ips FROM a GROUP BY name),
    m AS (SELECT 'if' || CAST(s_suppkey + 30 AS VARCHAR) AS name, s_name AS mac FROM supplier)
    SELECT coalesce(g.name, m.name) AS name, mac, coalesce(array_to_string(ips, ' '), '') AS ips, coalesce(len(list_filter(ips, lambda x: starts_with(x, '169.254.'))) > 0, false) AS has_link_local FROM g FULL OUTER JOIN m ON g.name = m.name""")
def interface_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces: addresses and links by name, neither lost."""
    ip = F.when(F.col("c_custkey") % 31 == 0, F.concat(F.lit("169.254."), F.col("c_custkey") % 200, F.lit(".1"))).otherwise(customer_ip())
    addresses = table(spark, sf_dir, "customer").select(F.concat(F.lit("if"), F.col("c_custkey") % 40).alias("name"), ip.alias("ip"))
    links = table(spark, sf_dir, "supplier").select(F.concat(F.lit("if"), F.col("s_suppkey") + 30).alias("name"), F.col("s_name").alias("mac"))
    return matching.interfaces(addresses, links).select("name", "mac", F.array_join("ips", " ").alias("ips"), "has_link_local")


@query(f"""WITH o AS (SELECT c_custkey % 60 AS gateway, 167772160 + c_custkey * 3 AS n FROM customer WHERE c_custkey % 9 > 0), src AS (SELECT DISTINCT c_custkey % 60 AS gateway, {_ip_sql('(c_custkey % 60) * 5')} AS source FROM customer),
    c AS (SELECT gateway, n FROM o UNION SELECT gateway, 167772160 + gateway * 5 FROM src), l AS (SELECT (167772160 + s_suppkey * 21 + 512) >> 8 AS subnet, min(-s_suppkey) AS turn FROM supplier GROUP BY 1),
    b AS (SELECT gateway, min(CASE WHEN turn IS NOT NULL THEN turn * 10000000000 + n END) AS best, min(n) AS lowest FROM c LEFT JOIN l ON n >> 8 = subnet GROUP BY gateway),
    h AS (SELECT gateway, lowest, CASE WHEN best IS NOT NULL THEN best - floor(best / 10000000000.0) * 10000000000 END AS hit FROM b)
    SELECT h.gateway, {_ip_sql('CAST(coalesce(hit, lowest) AS BIGINT) - 167772160')} AS address FROM h JOIN src ON src.gateway = h.gateway""")
def same_subnet_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each gateway the offered address that is on the first local subnet with one; loopback addresses are offered too."""
    gateway = F.col("c_custkey") % 60
    offered = F.when(F.col("c_custkey") % 9 == 0, "127.0.0.5").otherwise(customer_ip())
    offers = table(spark, sf_dir, "customer").select(gateway.alias("gateway"), offered.alias("ip"), net.dotted(F.lit(10 << 24) + gateway * 5).alias("source"))
    local = table(spark, sf_dir, "supplier").select(net.dotted(F.lit((10 << 24) + 512) + F.col("s_suppkey") * 21).alias("ip"), (-F.col("s_suppkey")).alias("place"))
    return matching.same_subnet(offers, local, "place")


@query("""SELECT p_partkey, p_name, CASE WHEN contains(lower(p_name), 'small') THEN 'Small' WHEN contains(lower(p_name), 'cold') THEN 'cold' WHEN contains(lower(p_name), 'gear') THEN 'GEAR' END AS adapter FROM part
    WHERE contains(lower(p_name), 'small') OR contains(lower(p_name), 'cold') OR contains(lower(p_name), 'gear')""")
def device_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices whose name contains an adapter's."""
    return matching.devices_named(table(spark, sf_dir, "part"), F.col("p_name"), ["Small", "cold", "GEAR"]).select("p_partkey", "p_name", "adapter")


_DESC = ["Realtek USB Ethernet", "Wi-Fi wireless", "Npcap Loopback Adapter", "Docker vEthernet", "AX88179 ENET", "plain"]
_DESC_SQL = "[" + ", ".join(f"'{d}'" for d in _DESC) + f"][CAST(p_partkey % {len(_DESC)} AS INTEGER) + 1]"
_SCORE_SQL = "".join(f" + CASE WHEN contains(lower(d), '{w}') OR contains(lower(p_name), '{w}') THEN {n} ELSE 0 END" for words, n in ((net.GOOD_WORDS, 5), (net.BAD_WORDS, -80)) for w in words)


@query(f"""WITH d AS (SELECT p_brand, p_partkey, p_name, {_DESC_SQL} AS d, p_size % 2 = 0 AS up, p_size % 3 = 0 AS ll FROM part),
    s AS (SELECT p_brand, p_partkey, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name, CASE WHEN contains(lower(d), 'loopback') THEN -1000 ELSE 0{_SCORE_SQL} + CASE WHEN ll THEN 50 ELSE 0 END + CASE WHEN up THEN 10 ELSE 0 END END AS score FROM d)
    SELECT p_brand, p_partkey, name, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, name) = 1""")
def interface_score_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best interface of each brand."""
    description = F.element_at(F.array(*map(F.lit, _DESC)), (F.col("p_partkey") % len(_DESC)).cast("int") + 1)
    score = net.interface_score(F.col("p_name"), description, F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0)
    scored = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("name"), score.cast("int").alias("score"))
    return matching.best_interface(scored, ["p_brand"])


@query("""WITH j AS (SELECT conv_id % 50 AS room, CASE role WHEN 'user' THEN 'gateway' WHEN 'assistant' THEN 'agent' ELSE role END AS role, conv_id, turn FROM conversations),
    k AS (SELECT *, lag(role) OVER (PARTITION BY room ORDER BY conv_id, turn) AS before FROM j WHERE role IN ('gateway', 'agent')),
    r AS (SELECT *, sum(CASE WHEN role IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY room ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING) AS run FROM k),
    n AS (SELECT *, row_number() OVER (PARTITION BY room, run ORDER BY conv_id, turn) AS nth, count(*) OVER (PARTITION BY room, run) AS length FROM r),
    b AS (SELECT *, max(CASE WHEN length > 1 THEN run END) OVER (PARTITION BY room ORDER BY run RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reset FROM n),
    h AS (SELECT *, CASE WHEN reset IS NULL THEN run % 2 = 0 ELSE (run - reset) % 2 = 1 END AS held FROM b)
    SELECT room, conv_id, turn, role, CASE WHEN held AND nth = 1 THEN 'paired' WHEN held AND nth = 2 OR NOT held AND nth = 1 THEN 'waiting' ELSE 'duplicate' END AS outcome FROM h
    UNION ALL SELECT room, conv_id, turn, role, 'duplicate' FROM j WHERE role IS NULL OR role NOT IN ('gateway', 'agent')""")
def room_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins of rooms (conversations; user is gateway, assistant agent) and their outcomes, in parts of 200 conversations."""
    role = F.when(F.col("role") == "user", "gateway").when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
    joins = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("room"), role.alias("role"), "conv_id", "turn")
    return matching.pair_rooms(joins, "room", "role", ["conv_id", "turn"], F.expr("conv_id div 200"))


@query("""WITH v AS (SELECT p_partkey, 'vv' || CAST(p_size % 3 AS VARCHAR) || '.' || CAST(p_partkey % 5 AS VARCHAR) || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '.' || CAST(p_size AS VARCHAR) || '-rc1' END AS version, p_size % 3 AS a, p_partkey % 5 AS b, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS c FROM part)
    SELECT p_partkey, version, a > 1 OR (a = 1 AND (b > 2 OR (b = 2 AND c > 9))) AS newer FROM v""")
def semver_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether versions are newer than 1.2.9."""
    patch = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("."), "p_size", F.lit("-rc1")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("vv"), F.col("p_size") % 3, F.lit("."), F.col("p_partkey") % 5, patch).alias("version"))
    return rows.select("p_partkey", "version", (net.semver(F.col("version")) > net.semver(F.lit("v1.2.9"))).alias("newer"))


@query("""SELECT page_id, 'own' || CAST(page_id % 9 AS VARCHAR) || '/' || 'repo' || CAST(page_id AS VARCHAR) AS slug, CAST(NULL AS VARCHAR) AS plain FROM pages""")
def slug_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner and name from repository URLs; other URLs have none."""
    prefix = F.element_at(F.array(*map(F.lit, ["https://github.com/", "http://github.com/", "https://token@github.com/", ""])), (F.col("page_id") % 4).cast("int") + 1)
    tail = F.when(F.col("page_id") % 4 < 3, F.element_at(F.array(*map(F.lit, ["", ".git", "/", "/tree/main"])), (F.shiftright(F.col("page_id"), 2) % 4).cast("int") + 1)).otherwise("")
    repo = F.concat(prefix, F.lit("own"), F.col("page_id") % 9, F.lit("/repo"), "page_id", tail)
    return table(spark, sf_dir, "pages").select("page_id", net.repo_slug(repo).alias("slug"), net.repo_slug(F.col("url")).alias("plain"))


@query("SELECT c_custkey, upper(replace(lower(c_mktsegment), ' ', '')) || '-' || CAST(c_custkey AS VARCHAR) AS code FROM customer")
def pair_code_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair codes without white space, in capitals."""
    raw = F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" -\t"), "c_custkey", F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", net.pair_code(raw).alias("code"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch' ELSE 'no_entry' END AS status, sha256(text) AS sha FROM documents")
def checksum_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a sums file that has a third of them right and a third wrong."""
    docs = table(spark, sf_dir, "documents")
    line = F.concat(F.sha2(F.concat("text", F.when(F.col("doc_id") % 3 == 1, "x").otherwise("")).cast("binary"), 256), F.lit("  *DOC-"), "doc_id")
    sums = sources.parse_sums(docs.where(F.col("doc_id") % 3 < 2).select(line.alias("value")))
    files = docs.select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("name"), F.col("text").alias("content"))
    return settings.verified(files, sums).select("doc_id", "status", "sha")


@query("""WITH m AS (SELECT n_nationkey, ['lan', 'relay', 'wireguard'][n_nationkey % 3 + 1] AS mode, CASE WHEN n_nationkey % 5 = 0 THEN 33.0 END AS r FROM nation)
    SELECT n_nationkey, mode, CAST(coalesce(r, CASE mode WHEN 'lan' THEN 20.0 WHEN 'relay' THEN 80.0 ELSE 40.0 END) AS DOUBLE) AS rtt_limit_ms, CAST(CASE mode WHEN 'lan' THEN 5000 WHEN 'relay' THEN 15000 ELSE 10000 END AS INTEGER) AS timeout_ms, mode <> 'lan' AS require_crypto, mode = 'lan' AS auto_discover FROM m""")
def mode_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits by network mode where none are given."""
    mode = F.element_at(F.array(F.lit("lan"), F.lit("relay"), F.lit("wireguard")), F.col("n_nationkey") % 3 + 1)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", mode.alias("mode"), F.when(F.col("n_nationkey") % 5 == 0, 33.0).alias("rtt_limit"), F.lit(None).cast("int").alias("timeout"))
    return settings.with_mode_defaults(rows, "mode")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS name, '' AS password, coalesce(CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'pw' END, c_name) <> '' AS password_set,
    CASE c_custkey % 4 WHEN 1 THEN true WHEN 0 THEN c_nationkey % 2 = 0 AND c_custkey % 8 = 0 ELSE c_custkey % 8 IN (0, 2) END AS crypto FROM customer""")
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial settings updates, with secrets redacted."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumns({"new_name": F.when(key % 3 == 0, "new"), "new_password": F.when(key % 4 == 0, "").when(key % 4 == 1, "pw")})
    out = rows.select("c_custkey", settings.merged("c_mktsegment", "new_name").alias("name"), settings.merged("c_name", "new_password").alias("password"), settings.crypto_after(F.col("new_password"), F.col("c_nationkey") % 2 == 0, (key % 8).isin(0, 2)).alias("crypto"))
    return settings.redacted(out, ["password"]).select("c_custkey", "name", "password", "password_set", "crypto")


@query("SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.log' AS path, '==== ' || source || '/' || CAST(doc_id AS VARCHAR) || '.log ====' AS header, md5(text) AS digest FROM documents")
def log_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the log bundle in order of their paths."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("/"), "doc_id", F.lit(".log")).alias("path"), "text")
    return settings.log_bundle(files, ["path"]).select("path", "header", F.md5("text").alias("digest"))


@query("""WITH s AS (SELECT event_id, event_id % 11 > 0 AS running, event_type = 'view' AS laptop, ['Stopped', 'Starting', 'WaitingForPeer', 'Connected', 'Reconnecting', 'Failed'][CAST(event_id % 6 AS INTEGER) + 1] AS connection, value > 250 AS link, value > 400 AS awake FROM events)
    SELECT event_id, CASE WHEN NOT running THEN 'gateway_stopped' WHEN laptop OR connection = 'Connected' THEN CASE WHEN awake THEN 'ready' WHEN link THEN 'waiting_for_wake' ELSE 'plug_in' END WHEN connection IN ('WaitingForPeer', 'Starting') THEN 'waiting_for_laptop'
        WHEN connection = 'Reconnecting' THEN 'reconnecting' WHEN connection = 'Failed' THEN 'failed' ELSE 'stopped' END AS host_status,
        CASE connection WHEN 'Connected' THEN 'connected' WHEN 'Reconnecting' THEN 'reconnecting' WHEN 'WaitingForPeer' THEN 'waiting' WHEN 'Starting' THEN 'starting' ELSE 'down' END AS laptop_label, laptop AND awake AS vehicle_awake FROM s""")
def status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the status lines; vehicle flags count only with a laptop."""
    names = F.array(*map(F.lit, ["Stopped", "Starting", "WaitingForPeer", "Connected", "Reconnecting", "Failed"]))
    connection, laptop, awake = F.element_at(names, (F.col("event_id") % 6).cast("int") + 1), F.col("event_type") == "view", F.col("value") > 400
    host = safety.host_status(F.col("event_id") % 11 > 0, laptop, connection, F.col("value") > 250, awake)
    return table(spark, sf_dir, "events").select("event_id", host.alias("host_status"), safety.laptop_label(connection).alias("laptop_label"), (laptop & awake).alias("vehicle_awake"))


@query(f"""SELECT s_nationkey, s_suppkey, {_SIP} AS ip, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey * 21) AS INTEGER) AS numeric_place, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY {_SIP}) AS INTEGER) AS text_place FROM supplier""")
def numeric_vs_text_ip_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of addresses by number and by text, within each nation."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", supplier_ip().alias("ip"))
    place = lambda by: F.row_number().over(telemetry.arrival(["s_nationkey"], [by]))
    return rows.withColumn("n", net.ipv4(F.col("ip"))).withColumn("numeric_place", place("n")).withColumn("text_place", place("ip")).drop("n")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
