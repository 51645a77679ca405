"""Status documents: one row for each host, from its state, statistics, health, settings, adapters and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspan.functions import net

#: Rows of activity that a document has at most.
ACTIVITY_ROWS = 400
#: Interfaces that a setup page shows at most.
SHOWN_INTERFACES = 6


def adapter_choices(adapters: DataFrame, keys: list[str], preferred: str = "", ranked: bool = False) -> DataFrame:
    """(keys, adapters): each host's adapters with score and whether they are usable, by name, or, ``ranked``, the best first and ties by name.

    Takes name, description, is_up and has_link_local. Null texts count as empty, null flags as
    false; adapters that repeat are there as often. A host's list is in one row, as its document is.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    flag = lambda c: F.coalesce(c, F.lit(False))
    score = net.interface_score(text("name"), text("description"), flag("is_up"), flag("has_link_local"), preferred).cast("int")
    rows = adapters.select(*keys, text("name").alias("name"), score.alias("score"))
    order = F.struct((-F.col("score")).alias("order"), "name", "score") if ranked else F.struct(F.lit(0).alias("order"), "name", "score")
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("listed"))
    return listed.select(*keys, F.transform("listed", lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score"), (x["score"] > 0).alias("usable"))).alias("adapters"))


def first_by_name(interfaces: DataFrame, keys: list[str], n: int = SHOWN_INTERFACES) -> DataFrame:
    """The first ``n`` interfaces of each host in order of name; rows of one name in any order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("name"))
    return interfaces.withColumn("interface_place", place).where(F.col("interface_place") <= n).drop("interface_place")


def usable_addresses(local: DataFrame, keys: list[str], ip: str, outbound: DataFrame) -> DataFrame:
    """(keys, lan_ips): each host's usable IPv4 addresses, once, in the order of their numbers.

    A host without any has the usable ones of ``outbound`` (keys and ``ip``: the address it goes out by), and
    an empty list if there are none either. Hosts are those of both tables; a host's list is in one row.
    """
    usable = F.when(net.is_usable_lan(F.col(ip)), net.ipv4(F.col(ip)))
    both = local.select(*keys, usable.alias("own"), F.lit(None).cast("bigint").alias("way")).unionByName(outbound.select(*keys, F.lit(None).cast("bigint").alias("own"), usable.alias("way")))
    found = both.groupBy(*keys).agg(F.array_sort(F.collect_set("own")).alias("own"), F.array_sort(F.collect_set("way")).alias("way"))
    chosen = F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("way"))
    return found.select(*keys, F.transform(chosen, net.dotted).alias("lan_ips"))


def activity_json(rows: DataFrame, keys: list[str], order: list[str], ts: str, n: int = ACTIVITY_ROWS) -> DataFrame:
    """(keys, document): each host's last ``n`` activity rows (``ts``, level, message) in order, as JSON ``{"entries": [..]}``; times are seconds with fractions.

    Spark limits each host's rows before they meet in one row.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    last = rows.withColumn("activity_place", place).where(F.col("activity_place") <= n)
    entry = F.struct((-F.col("activity_place")).alias("turn"), F.struct(unix_seconds(F.col(ts)).alias("ts"), "level", "message").alias("entry"))
    listed = last.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("listed"))
    return listed.select(*keys, F.to_json(F.struct(F.transform("listed", lambda x: x["entry"]).alias("entries"))).alias("document"))


def unix_seconds(ts: Column, whole: bool = False) -> Column:
    """Seconds since 1970 with fractions of a microsecond at least, or whole ones."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.floor(micros / 1_000_000) if whole else micros / 1_000_000


def elapsed_ms(since: Column, now: Column) -> Column:
    """Milliseconds between two times, with fractions; not below 0."""
    return F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1000, F.lit(0.0))


def newest_release(releases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, update_available): the highest version of each host's offered updates, as ``sources.frames.newer_releases`` finds them."""
    return releases.groupBy(*keys).agg(F.max_by("version", net.semver(F.col("version"))).alias("update_available"))
