"""Link-safety gate, backoff and status texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the gate.
MAX_RTT_P99_MS = 20.0
MAX_LOSS_RATE = 0.001
MAX_CPU_PCT = 80.0
MIN_SAMPLES = 20
MAX_RTT_SAMPLE_MS = 2000.0


def valid_rtt(ms: Column) -> Column:
    return ms.isNotNull() & ~F.isnan(ms) & (ms > 0) & (ms <= MAX_RTT_SAMPLE_MS)


def gate_rtt(p50: Column, p99: Column, last: Column) -> Column:
    """The round trip to judge: the median's neighbourhood if p99 is a rare spike."""
    spiky = (p50 > 0) & (p99 > 3 * p50) & (p99 > 40)
    return F.when(spiky, F.greatest(p50, F.least(last, 2 * p50))).otherwise(F.greatest(p99, last))


def limits(rtt: Column | None = None, loss: Column | None = None, cpu: Column | None = None, samples: Column | None = None) -> dict[str, Column]:
    """The gate's limits; what a configuration leaves open has its default."""
    given = {"rtt": (rtt, MAX_RTT_P99_MS), "loss": (loss, MAX_LOSS_RATE), "cpu": (cpu, MAX_CPU_PCT), "samples": (samples, MIN_SAMPLES)}
    return {n: F.lit(default) if c is None else F.coalesce(c, F.lit(default)) for n, (c, default) in given.items()}


def loss_counts(rx_pps: Column, tx_pps: Column) -> Column:
    """Whether there is enough traffic, both ways together, to judge loss by."""
    return rx_pps + tx_pps > 0.5


def failed_checks(link_up: Column, awake: Column, connected: Column, rtt: Column, loss: Column, pps: Column, cpu: Column, rx: Column, most: dict[str, Column] | None = None) -> Column:
    """Codes of the failed checks in their fixed order; quality counts only when the vehicle is ready.

    ``pps`` are packets a second of both directions together. ``most`` is of ``limits``.
    """
    ready, most = link_up & awake, most or limits()
    return F.array_compact(
        F.array(
            F.when(~connected, "peer"), F.when(~link_up, "link").when(~awake, "asleep"), F.when(ready & (rtt > most["rtt"]) & (rtt > 0), "rtt"),
            F.when(ready & (loss > most["loss"]) & loss_counts(pps, F.lit(0.0)), "loss"), F.when(ready & (cpu > most["cpu"]), "cpu"), F.when(ready & (rx < most["samples"]), "samples"),
        )
    )


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, rounded from its exact binary value with ties to even, as printf does (``format_string`` rounds its shortest decimals, ties away from 0)."""
    value = value.cast("double")
    known = F.abs(value) < 2.0**53
    size = F.when(known, F.abs(value)).otherwise(0.0)
    # all bits of a fraction, of 2**-7 or more, as a whole number
    scaled = ((size - F.floor(size)) * 2.0**60).cast("bigint").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(7,0)")
    unit = F.lit(2**60).cast("decimal(20,0)")
    rest = scaled % unit
    down = ((scaled - rest) / unit).cast("bigint")
    odd = F.pmod(F.pmod(F.floor(size), F.lit(2)) * 10**digits + down, F.lit(2)) == 1
    units = down + ((rest > F.lit(2**59)) | ((rest == F.lit(2**59)) & odd)).cast("bigint")
    whole, part = F.floor(size) + F.floor(units / 10**digits), F.pmod(units, F.lit(10**digits))
    text = F.concat(F.when(value < 0, "-").otherwise(""), whole.cast("string"), *([F.lit("."), F.lpad(part.cast("string"), digits, "0")] if digits else []))
    return F.when(known, text).otherwise(F.format_string(f"%.{digits}f", value))


def reasons(failed: Column, rtt: Column, loss: Column, cpu: Column, rx: Column, most: dict[str, Column] | None = None) -> Column:
    """The failed checks with what was measured and the limit: ``rtt 92.00 > 20.00``, ``loss 5.0000 > 0.1000`` in percent, ``cpu 91.0 > 80.0``, ``samples 3 < 20``."""
    most = most or limits()
    told = lambda name, now, limit, digits, sign: F.concat(F.lit(f"{name} "), fixed(now, digits), F.lit(f" {sign} "), fixed(limit, digits))
    return F.transform(
        failed,
        lambda x: F.when(x == "rtt", told("rtt", rtt, most["rtt"], 2, ">")).when(x == "loss", told("loss", loss * 100, most["loss"] * 100, 4, ">")).when(x == "cpu", told("cpu", cpu, most["cpu"], 1, ">"))
        .when(x == "samples", told("samples", rx, most["samples"], 0, "<")).otherwise(x),
    )


def verdict(failed: Column, ready: Column, connected: Column) -> Column:
    """One of safe, not_ready and not_recommended."""
    return F.when(F.size(failed) == 0, "safe").when(~ready & connected, "not_ready").otherwise("not_recommended")


def warning(code: Column, failed: Column, remote: Column) -> Column:
    """The verdict with its reasons and, on a remote path, a mark: ``verdict: reasons [remote_safe or remote]``."""
    reasons = F.when(F.size(failed) > 0, F.concat(F.lit(": "), F.array_join(failed, "; "))).otherwise("")
    return F.concat(code, reasons, F.when(remote & (F.size(failed) == 0), " remote_safe").when(remote, " remote").otherwise(""))


def slow_way_out(connected: Column, local_ms: Column, peer_ms: Column) -> Column:
    """Whether the way out is much slower than the way back, as with a sleeping radio."""
    return connected & (local_ms > 40) & (peer_ms > 0) & (local_ms > 2 * peer_ms)


def backoff_ms(base: Column, most: Column, attempt: Column) -> Column:
    return F.least(base * F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(attempt, F.lit(10)).cast("int")), most)


def host_status(running: Column, laptop: Column, connection: Column, link_up: Column, awake: Column) -> Column:
    """Code of the host's status line."""
    inside = F.when(awake, "ready").when(link_up, "waiting_for_wake").otherwise("plug_in")
    outside = F.when(connection.isin("WaitingForPeer", "Starting"), "waiting_for_laptop").when(connection == "Reconnecting", "reconnecting").when(connection == "Failed", "failed").otherwise("stopped")
    return F.when(~running, "gateway_stopped").when(laptop | (connection == "Connected"), inside).otherwise(outside)


def laptop_label(connection: Column) -> Column:
    return F.when(connection == "Connected", "connected").when(connection == "Reconnecting", "reconnecting").when(connection == "WaitingForPeer", "waiting").when(connection == "Starting", "starting").otherwise("down")


def laptop_line(connection: Column, known_peer: Column, desktop: Column, link_up: Column, awake: Column) -> Column:
    """Code of the laptop's status line; ``connection`` is null before a tunnel is there."""
    inside = F.when(~desktop, "waiting_for_desktop").when(~link_up, "plug_in").when(~awake, "waiting_for_wake").otherwise("ready")
    label = laptop_label(connection)
    searching = F.when(known_peer, "dialing").otherwise("searching")
    return F.when(connection.isNull(), searching).when(label == "waiting", "waiting_for_reply").when(label == "reconnecting", "reconnecting").otherwise(inside)
