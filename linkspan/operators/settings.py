"""Settings, checksums and log bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan.functions import net

# Round-trip limit and peer timeout of each network mode, in ms.
MODE_DEFAULTS = {"lan": (20.0, 5000), "relay": (80.0, 15000), "wireguard": (40.0, 10000)}
# How the modes are shown.
MODE_LABELS = {"lan": "Same network (LAN)", "relay": "Different networks (Relay)", "wireguard": "Different networks (WireGuard / VPN)"}


def mode_label(mode: Column) -> Column:
    """How a network mode is shown; null for an unknown one."""
    out = F.lit(None).cast("string")
    for name, label in MODE_LABELS.items():
        out = F.when(mode == name, label).otherwise(out)
    return out


def with_mode_defaults(rows: DataFrame, mode: str) -> DataFrame:
    """Limits that a row leaves open come from its mode; remote modes need crypto and turn discovery off."""
    table = F.create_map(*(x for k, v in MODE_DEFAULTS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("rtt"), F.lit(v[1]).alias("timeout")))))
    got, remote = F.element_at(table, F.col(mode)), F.col(mode) != "lan"
    return rows.select("*", F.coalesce("rtt_limit", got["rtt"]).alias("rtt_limit_ms"), F.coalesce("timeout", got["timeout"]).alias("timeout_ms"), remote.alias("require_crypto"), (~remote).alias("auto_discover")).drop("rtt_limit", "timeout")


def merged(old: str, new: str) -> Column:
    """A partial update: only what is given replaces."""
    return F.coalesce(F.col(new), F.col(old))


def crypto_after(password: Column, remote: Column, before: Column) -> Column:
    """A password turns crypto on; an empty one turns it off, but in a remote mode leaves it, as none (null) does."""
    return F.when(F.length(password) > 0, True).when(password.isNotNull() & ~remote, False).otherwise(before)


def updated(rows: DataFrame) -> DataFrame:
    """A partial update of settings: password, require_crypto, pair_code and log_level after it, and whether the tunnel must restart.

    Takes these columns and new_password, clear_password, new_crypto, new_code, new_level, where
    null leaves things as they are, and remote. Clearing goes before a new password; an explicit
    require_crypto goes last. A code is normalised; an empty or the same one is none. An unknown
    level is info.
    """
    clear = F.coalesce("clear_password", F.lit(False))
    password = F.when(clear, F.lit("")).otherwise(F.col("new_password"))
    code = F.nullif(net.pair_code(F.col("new_code")), F.lit(""))
    changed = clear | F.col("new_password").isNotNull() | F.col("new_crypto").isNotNull() | F.coalesce(code != F.col("pair_code"), F.lit(False))
    level = F.lower("new_level")
    return rows.select(
        "*", F.coalesce(password, "password").alias("password_after"), F.coalesce("new_crypto", crypto_after(password, F.col("remote"), F.col("require_crypto"))).alias("crypto_after"),
        F.coalesce(code, "pair_code").alias("code_after"), F.when(level.isNull(), F.col("log_level")).when(level.isin("error", "warn", "debug", "trace"), level).otherwise("info").alias("level_after"), changed.alias("restart"),
    )


def redacted(rows: DataFrame, secrets: list[str]) -> DataFrame:
    """Secrets are blanked; ``<secret>_set`` says whether there was one."""
    flags = {f"{s}_set": F.coalesce(F.length(s) > 0, F.lit(False)) for s in secrets}
    return rows.withColumns(flags).withColumns({s: F.lit("") for s in secrets})


def verified(files: DataFrame, sums: DataFrame | None) -> DataFrame:
    """``status`` of files (name, content) by sums (sha, file): ok, mismatch or no_entry; names match in any ASCII case.

    Of several entries of a name the first counts, by ``line`` if sums has that column. Without
    sums (None) every file passes, as unchecked.
    """
    got = files.select("*", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))
    if sums is None:
        return got.withColumn("status", F.lit("unchecked"))
    line = F.col("line") if "line" in sums.columns else F.monotonically_increasing_id()
    wanted = sums.select(net.ascii_lower(F.col("file")).alias("key"), F.lower("sha").alias("sha"), line.alias("line")).groupBy("key").agg(F.min_by("sha", "line").alias("want"))
    status = F.when(F.col("want").isNull(), "no_entry").when(F.col("want") == F.col("sha"), "ok").otherwise("mismatch")
    return got.withColumn("key", net.ascii_lower(F.col("name"))).join(wanted, "key", "left").withColumn("status", status).drop("key", "want")


def log_bundle(files: DataFrame, by: list[str]) -> DataFrame:
    """Parts of a bundle: a header for each file, then its text, sorted by path and ready to be written.

    The parts stay rows, sorted across partitions, so that a bundle may be of any size.
    """
    header = F.concat(F.lit("==== "), F.col("path"), F.lit(" ===="))
    return files.withColumn("header", header).repartitionByRange(*by).sortWithinPartitions(*by)
