"""The last value or row at or before each row: as-of joins and the states that follow from them.

A stream's rows are sorted in one task, or, with ``chunk``, a coarse step of the order such as
an hour, in one task for each step; of a step, only its last values go on to the later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how long a vehicle counts as awake after its last traffic.
AWAKE_SECONDS = 10


def held(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], chunk: Column | None = None, past: bool = False, counts: dict[str, Column] | None = None) -> DataFrame:
    """The rows with, for each of ``values``, the last that was not null up to this row, or before it if ``past``, and, for each of ``counts``, how many rows so far have that flag.

    Rows with equal order columns come in any order. The names of ``values`` and ``counts`` replace columns of
    that name, and are evaluated on the rows as they are; other columns may have any names. With ``chunk``, a step
    begins with one more row, which holds what the earlier ones leave to it.
    """
    counts = counts or {}
    flags = [F.coalesce(f, F.lit(False)).cast("long") for f in counts.values()]
    by = [f"key{i}" for i in range(len(keys))]
    plain = rows.select(
        F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), *(F.col(f"`{k}`").alias(b) for k, b in zip(keys, by)), F.struct(*(F.col(f"`{o}`") for o in order)).alias("at"),
        *(v.alias(f"value{i}") for i, v in enumerate(values.values())), *(f.alias(f"count{i}") for i, f in enumerate(flags)), (F.lit(0) if chunk is None else chunk).alias("part"), F.lit(1).alias("real"),
    )
    if chunk is not None:
        last = [F.max_by(f"value{i}", F.when(F.col(f"value{i}").isNotNull(), F.col("at"))).alias(f"value{i}") for i in range(len(values))]
        # a row for each stream and step
        left = plain.groupBy(*by, "part").agg(*last, *(F.sum(f"count{i}").alias(f"count{i}") for i in range(len(flags))), F.lit(0).alias("real"))
        before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        carried = left.select(*by, "part", "real", *(F.last(f"value{i}", ignorenulls=True).over(before).alias(f"value{i}") for i in range(len(values))), *(F.sum(f"count{i}").over(before).alias(f"count{i}") for i in range(len(flags))))
        plain = plain.unionByName(carried, allowMissingColumns=True)
    now = Window.partitionBy(*by, "part").orderBy("real", "at")
    until = now.rowsBetween(Window.unboundedPreceding, -1 if past else 0)
    found = [F.last(f"value{i}", ignorenulls=True).over(until).alias(name) for i, name in enumerate(values)]
    found += [F.coalesce(F.sum(f"count{i}").over(now.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias(name) for i, name in enumerate(counts)]
    kept = [F.col("row")[c].alias(c) for c in rows.columns if c not in values and c not in counts]
    marked = plain.select("row", "real", F.struct(*found).alias("found")).where("real = 1")
    return marked.select(*kept, *(F.col("found")[name].alias(name) for name in (*values, *counts)))


def steps(ts: str, seconds: int) -> Column:
    """A time's step of so many seconds, for ``chunk``."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], right_order: tuple[str, ...] = (), most_seconds: float | None = None, step_seconds: int | None = None) -> DataFrame:
    """Each row of ``left`` with ``values`` of the last row of ``right`` at or before it in time, by equal keys; null where there is none.

    Of rows of ``right`` at one time the last by ``right_order`` counts. A value that is null
    in that row is null: the row counts as a whole. Rows older than ``most_seconds`` do not count. Null times come
    before all others; null keys are a stream like any other. ``step_seconds`` cuts streams into
    parts of that many seconds. ``values`` replace columns of ``left`` of these names.
    """
    order = [f"order{i}" for i in range(len(right_order))]
    key = [f"key{i}" for i in range(len(keys))]
    named = lambda df: [F.col(f"`{k}`").alias(n) for k, n in zip(keys, key)]
    at = F.col(f"`{ts}`").alias("at")
    given = right.select(*named(right), at, F.lit(0).alias("side"), *(F.col(f"`{c}`").alias(o) for c, o in zip(right_order, order)), F.lit(None).cast(left.select(F.struct(*(F.col(f"`{c}`") for c in left.columns))).schema[0].dataType).alias("row"), F.struct(at, *(F.col(f"`{v}`") for v in values)).alias("found"))
    asked = left.select(*named(left), at, F.lit(1).alias("side"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("row"))
    both = given.unionByName(asked, allowMissingColumns=True)
    chunk = steps("at", step_seconds) if step_seconds else None
    joined = held(both, key, ["at", "side", *order], {"found": F.col("found")}, None if chunk is None else F.coalesce(chunk, F.lit(-(2**62)))).where("side = 1")
    if most_seconds is not None:
        age = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("found.at").cast("timestamp"))
        joined = joined.withColumn("found", F.when(age <= int(most_seconds * 1_000_000), F.col("found")))
    kept = [F.col("row")[c].alias(c) for c in left.columns if c not in values]
    return joined.select(*kept, *(F.col("found")[v].alias(v) for v in values))


def agent_vehicle(frames: DataFrame, links: DataFrame, keys: list[str], order: list[str], ts: str, kind: str, awake_seconds: int = AWAKE_SECONDS, step_seconds: int | None = None) -> DataFrame:
    """The agent's own vehicle state after each row: link_up and awake.

    ``frames`` have captured frames (``kind`` captured), ticks (tick) and any others; ``links``
    are probes of the adapter (keys, ``ts``, link_up). A tick takes the last probe at or before
    it, and a link that was never probed is down. A captured frame wakes the vehicle if the
    link was up at the last tick. A tick puts it to sleep if the link is down, or if the last
    captured frame is longer ago than ``awake_seconds``.
    """
    chunk = steps(ts, step_seconds) if step_seconds else None
    probed = as_of(frames, links.select(*keys, ts, F.col("link_up").alias("probe")), keys, ts, ["probe"], step_seconds=step_seconds)
    tick, captured = F.col(kind) == "tick", F.col(kind) == "captured"
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    flagged = held(probed, keys, order, {"link_up": F.when(tick, F.coalesce("probe", F.lit(False))), "active": F.when(captured, micros)}, chunk)
    flagged = flagged.withColumn("link_up", F.coalesce("link_up", F.lit(False)))
    late = micros - F.col("active") > awake_seconds * 1_000_000
    awake = F.when(captured & F.col("link_up"), True).when(tick & (~F.col("link_up") | late), False)
    states = held(flagged, keys, order, {"awake": awake}, chunk)
    return states.withColumn("awake", F.coalesce("awake", F.lit(False))).drop("probe", "active")
