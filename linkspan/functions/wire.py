"""The 24-byte frame header and its payloads as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the wire format.
MAGIC = "ENET"
VERSION = 1
HEADER_BYTES = 24
MAX_FRAME = 1518
MIN_CAPTURE = 14
MAX_STREAM_FRAME = 1558
FLAG_ENCRYPTED = 1
FRAME_TYPES = {"ethernet": 1, "keepalive": 2, "hello": 3, "goodbye": 4, "status": 5, "ack": 6, "safety_probe": 7}
CONTROL = (
    "kind string, role string, version string, hostname string, require_crypto boolean, vehicle_link boolean, vehicle_awake boolean,"
    " peer_connected boolean, packets_tx bigint, packets_rx bigint, loss_rate double, rtt_ms double, safe boolean, reasons array<string>, rtt_p99_ms double"
)
ANNOUNCE = "type string, hostname string, version string, pair_code string, tunnel_port int, api_port int, password_required boolean, lan_ips array<string>"
_U32 = 4294967296


def _digits(n: Column, size: int) -> Column:
    """A number of up to four bytes in hexadecimal, filled up with zeros."""
    return F.lpad(F.hex(n.cast("bigint")), 2 * size, "0")


def _fits(n: Column, size: int) -> Column:
    """Whether an unsigned number has ``size`` bytes at most."""
    return n.cast("decimal(20,0)").between(0, F.lit(str(2**64 - 1)).cast("decimal(20,0)")) if size == 8 else n.cast("bigint").between(0, 256**size - 1)


def _wide_digits(n: Column) -> Column:
    """The digits of a number of eight bytes, which is a decimal beyond a long's range."""
    wide, half = n.cast("decimal(20,0)"), F.lit(str(_U32)).cast("decimal(20,0)")
    return F.concat(_digits(F.floor(wide / half), 4), _digits(wide % half, 4))


def big_endian(n: Column, size: int) -> Column:
    """``size`` bytes of a number, up to eight, which need a decimal(20, 0); null for a number that does not fit."""
    return F.when(_fits(n, size), F.unhex(_wide_digits(n) if size == 8 else _digits(n, size)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names many times but that is to be evaluated, and planned, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unsigned(raw: Column, start: int, size: int) -> Column:
    """The number in bytes ``start`` (from 1) on: bigint, or decimal(20, 0) for eight bytes."""
    digits = F.conv(F.hex(F.substring(raw, start, size)), 16, 10)
    return digits.cast("decimal(20,0)" if size == 8 else "bigint")


def encode_frame(frame_type: Column, flags: Column, sequence: Column, payload: Column, timestamp_ms_lo: Column) -> Column:
    """Header and payload of one frame; null for a payload over 1518 bytes or a field that does not fit."""

    def encoded(x: Column) -> Column:
        size = F.octet_length(x["payload"])
        fields = ((x["type"], 1), (x["flags"], 2), (x["sequence"], 8), (x["ms"], 4))
        good = fits_wire(x["payload"])
        for value, width in fields:
            good = good & _fits(value, width)
        digits = F.concat(F.lit(f"{MAGIC.encode().hex()}{VERSION:02x}"), _digits(x["type"], 1), _digits(x["flags"], 2), _wide_digits(x["sequence"]), _digits(size, 2), F.lit("0000"), _digits(x["ms"], 4))
        return F.when(good, F.concat(F.unhex(digits), x["payload"]))

    parts = F.struct(frame_type.alias("type"), flags.alias("flags"), sequence.cast("decimal(20,0)").alias("sequence"), payload.alias("payload"), timestamp_ms_lo.alias("ms"))
    return once(parts, encoded)


def keepalive_frame(sequence: Column, timestamp_ms_lo: Column, cookie: Column) -> Column:
    """A keepalive of eight bytes of cookie: 0 asks for a reply, 1 is one."""
    return encode_frame(F.lit(FRAME_TYPES["keepalive"]), F.lit(0), sequence, big_endian(cookie, 8), timestamp_ms_lo)


def decode_frame(raw: Column) -> Column:
    """A struct of the header fields, payload and error; fields are null where there is an error.

    Errors in order of their checks: TooShort, BadControl, BadVersion, BadFrameType, and
    TooShort again for a cut payload. Bytes behind the payload are ignored; no bytes at all (null) are TooShort.
    """

    def fields(x: Column) -> Column:
        return F.struct(
            x.alias("raw"), F.coalesce(F.octet_length(x), F.lit(0)).alias("length"), (F.substring(x, 1, 4) == F.lit(MAGIC).cast("binary")).alias("known"), unsigned(x, 5, 1).cast("smallint").alias("version"),
            unsigned(x, 6, 1).cast("smallint").alias("frame_type"), unsigned(x, 7, 2).cast("int").alias("flags"), unsigned(x, 9, 8).alias("sequence"), unsigned(x, 17, 2).cast("int").alias("payload_len"), unsigned(x, 21, 4).alias("timestamp_ms_lo"),
        )

    def checked(x: Column) -> Column:
        error = (
            F.when(x["length"] < HEADER_BYTES, "TooShort").when(~x["known"], "BadControl").when(x["version"] != VERSION, "BadVersion")
            .when(~x["frame_type"].between(1, 7), "BadFrameType").when(x["length"] < HEADER_BYTES + x["payload_len"], "TooShort")
        )
        return F.struct(error.alias("error"), x.alias("x"))

    names = ("version", "frame_type", "flags", "sequence", "payload_len", "timestamp_ms_lo")

    def shown(c: Column) -> Column:
        good, x = c["error"].isNull(), c["x"]
        payload = F.substring(x["raw"], F.lit(HEADER_BYTES + 1), x["payload_len"])
        return F.struct(c["error"].alias("error"), *(F.when(good, x[n]).alias(n) for n in names), F.when(good, payload).alias("payload"))

    return once(once(once(raw, fields), checked), shown)


def is_encrypted(raw: Column) -> Column:
    """The encrypted flag of an undecoded frame; null if it is short or has another magic."""
    return F.when((F.octet_length(raw) >= HEADER_BYTES) & (F.substring(raw, 1, 4) == F.lit(MAGIC).cast("binary")), unsigned(raw, 7, 2).bitwiseAND(FLAG_ENCRYPTED) != 0)


def plaintext_dropped(raw: Column, required: Column) -> Column:
    """Whether a frame is dropped before it is decoded, as encryption is required and its header does not say that it is encrypted, or cannot be read."""
    return F.coalesce(required, F.lit(False)) & ~F.coalesce(is_encrypted(raw), F.lit(False))


def fits_wire(frame: Column) -> Column:
    return F.octet_length(frame) <= MAX_FRAME


def is_capture(frame: Column) -> Column:
    return F.octet_length(frame) >= MIN_CAPTURE


def is_keepalive_reply(payload: Column) -> Column:
    return (F.octet_length(payload) >= 8) & (F.substring(payload, 8, 1) == F.lit(b"\x01"))


def frame_type_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, n in FRAME_TYPES.items():
        out = F.when(code == n, name).otherwise(out)
    return out


def ms_low(ts: Column) -> Column:
    """Low 32 bits of a timestamp's milliseconds."""
    return F.pmod(F.unix_millis(ts.cast("timestamp")), F.lit(_U32))


def rtt_from_low(now_lo: Column, sent_lo: Column) -> Column:
    """Round trip by wrapping subtraction; 0 if over a minute."""
    gone = F.pmod(now_lo - sent_lo, F.lit(_U32))
    return F.when(gone > 60_000, F.lit(0)).otherwise(gone).cast("double")


def control(json: Column) -> Column:
    return F.from_json(json, CONTROL)


def control_json(kind: str, **fields: Column) -> Column:
    """A control payload: its kind and its own fields, in this order."""
    return F.to_json(F.struct(F.lit(kind).alias("kind"), *(c.alias(n) for n, c in fields.items())))


def hello(role: Column, version: Column, hostname: Column, require_crypto: Column) -> Column:
    """The payload that greets a peer; a host without a name is unknown."""
    return control_json("hello", role=role, version=version, hostname=F.coalesce(F.nullif(hostname, F.lit("")), F.lit("unknown")), require_crypto=require_crypto)


def status(role: Column, link_up: Column, awake: Column, connection: Column, packets_tx: Column, packets_rx: Column, loss_rate: Column, rtt_ms: Column) -> Column:
    """The payload of a status tick. Only an agent reports the vehicle; the other side sends false."""
    own = role == "agent"
    seen = lambda flag: own & F.coalesce(flag, F.lit(False))
    return control_json("status", vehicle_link=seen(link_up), vehicle_awake=seen(awake), peer_connected=connection == "Connected", packets_tx=packets_tx, packets_rx=packets_rx, loss_rate=loss_rate, rtt_ms=rtt_ms)


def announcement(datagram: Column, magic: bytes) -> Column:
    """A discovery datagram: a magic of eight bytes and JSON; a missing address list is empty."""
    json = F.substring(datagram, F.lit(9), F.octet_length(datagram)).cast("string")
    got = F.from_json(F.when(F.substring(datagram, 1, 8) == F.lit(magic), json), ANNOUNCE)
    return got.withField("lan_ips", F.coalesce(got["lan_ips"], F.array().cast("array<string>")))


def discovery_datagram(magic: bytes, kind: str, **fields: Column) -> Column:
    """A discovery message (query or announce) behind its magic."""
    return F.concat(F.lit(magic), F.to_json(F.struct(F.lit(kind).alias("type"), *(c.alias(n) for n, c in fields.items()))).cast("binary"))


def length_prefixed(body: Column) -> Column:
    """Stream framing: four bytes of length before the body."""
    return F.concat(big_endian(F.octet_length(body), 4), body)


def derive_key(password: Column, prefix: str) -> Column:
    """Key of a password, in hex; ``prefix`` separates uses."""
    return F.sha2(F.concat(F.lit(prefix), password).cast("binary"), 256)
