"""Frame streams, settings, sums files, releases, relay joins and logs."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspan.functions import net, wire
from linkspan.sources import frame_log


def split_frames(blob: bytes | None) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(number, body, error) of a blob's length-prefixed frames; a length of 0 or above the limit, or a cut frame, ends it."""
    at, n, view = 0, 0, memoryview(blob or b"")
    while at < len(view):
        size = int.from_bytes(view[at : at + 4], "big")
        if len(view) - at < 4 or (0 < size <= wire.MAX_STREAM_FRAME and len(view) - at - 4 < size):
            yield n, None, "cut"
            return
        if not 0 < size <= wire.MAX_STREAM_FRAME:
            yield n, None, "bad_length"
            return
        yield n, bytes(view[at + 4 : at + 4 + size]), None
        at, n = at + 4 + size, n + 1


def deframe(blobs: DataFrame, blob: str, key: str) -> DataFrame:
    """(``key``, frame_no, body, error): one row for each frame of ``blob``, batch by batch of the input.

    A null or empty blob has no frames. Other columns are left out.
    """
    of = blobs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, raw in zip(batch.column(0), batch.column(1)):
                found = list(split_frames(raw.as_py()))
                for a in range(0, len(found), 4096):
                    n, body, error = zip(*found[a : a + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array([owner] * len(n), batch.schema.field(0).type), pa.array(n, pa.int32()), pa.array(body, pa.binary()), pa.array(error, pa.string())], names=[key, "frame_no", "body", "error"])

    return blobs.select(key, blob).mapInArrow(run, T.StructType([T.StructField(key, of), T.StructField("frame_no", T.IntegerType()), T.StructField("body", T.BinaryType()), T.StructField("error", T.StringType())]))


def read_frames(spark: SparkSession, path: str, split: int = frame_log.SPLIT_BYTES, numbered: bool = True) -> DataFrame:
    """(path, offset, frame_no, error, and the header's fields and payload as ``frame``) of recorded frame logs, up to each log's first error.

    Logs are read in blocks by several tasks, see ``frame_log``. ``frame_no`` is a frame's place in its log; without
    ``numbered`` it is left out, and a log's rows need not meet. A frame whose header is refused is a row with
    that error, and does not end its log.
    """
    rows = frame_log.whole_logs(frame_log.read_log(spark, path, split))
    if numbered:
        # a part of a log is numbered by itself; only the parts' sizes meet by log
        step = F.expr(f"offset div {split}")
        sizes = rows.groupBy("path", step.alias("part")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.select("path", "part", before.alias("before"))
        own = F.row_number().over(Window.partitionBy("path", "part").orderBy("offset")) - 1
        rows = rows.withColumn("part", step).withColumn("own", own).join(starts, ["path", "part"]).withColumn("frame_no", (F.col("before") + F.col("own")).cast("long"))
    number = ["frame_no"] if numbered else []
    decoded = rows.select("path", "offset", *number, F.col("error").alias("cut"), wire.decode_frame(F.col("body")).alias("frame"))
    return decoded.select("path", "offset", *number, F.coalesce("cut", "frame.error").alias("error"), "frame")


def read_config(spark: SparkSession, path: str, defaults: dict) -> DataFrame:
    """A TOML file of settings as one row; what it lacks, or all if there is none, has its default."""
    try:
        with open(path, "rb") as file:
            given = tomllib.load(file)
    except FileNotFoundError:
        given = {}
    return spark.createDataFrame([{**defaults, **{k: v for k, v in given.items() if k in defaults}}])


def write_config(row: DataFrame, path: str) -> None:
    """The first row as a TOML file on the driver; nulls are left out."""
    values = row.first().asDict()
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
    with open(path, "w") as file:
        file.writelines(f"{k} = {text(v)}\n" for k, v in values.items() if v is not None)


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """(sha, file) of a sums file: hash, white space, an optional asterisk, name."""
    return parse_sums(spark.read.text(path))


def parse_sums(lines: DataFrame) -> DataFrame:
    """Hash and name are a line's first two words; a name's leading asterisks are a mark."""
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return lines.select(F.get(words, F.lit(0)).alias("sha"), F.regexp_replace(F.get(words, F.lit(1)), r"^\*+", "").alias("file")).where("file <> ''")


_RELEASE = "tag_name string, body string, draft boolean, prerelease boolean, assets array<struct<name: string, browser_download_url: string, url: string>>"


def newer_releases(documents: DataFrame, json: str, current: Column, asset: Column, api_url: Column) -> DataFrame:
    """Release documents that offer an update: version, asset_url, checksums_url and notes beside the other columns.

    Neither a draft nor a pre-release, with a version above ``current`` and an asset of exactly
    the name ``asset``, the first of several. The sums file's name matches in any ASCII case; a
    release may lack it. ``api_url`` chooses the assets' API addresses. Notes are cut to 400 characters.
    """

    def offer(release: Column) -> Column:
        named = lambda test: F.get(F.filter(release["assets"], test), F.lit(0))
        hit, sums = named(lambda a: a["name"] == asset), named(lambda a: net.ascii_lower(a["name"]) == "sha256sums.txt")
        url = lambda a: F.when(api_url, a["url"]).otherwise(a["browser_download_url"])
        good = ~F.coalesce(release["draft"], F.lit(False)) & ~F.coalesce(release["prerelease"], F.lit(False)) & hit.isNotNull() & (net.semver(release["tag_name"]) > net.semver(current))
        notes = F.left(F.coalesce(release["body"], F.lit("")), F.lit(400))
        return F.when(good, F.struct(release["tag_name"].alias("version"), url(hit).alias("asset_url"), url(sums).alias("checksums_url"), notes.alias("notes")))

    # an array of one, so that each document is parsed once
    offers = F.array_compact(F.transform(F.array(F.from_json(json, _RELEASE)), offer))
    return documents.select(*(c for c in documents.columns if c != json), F.inline(offers))


def parse_joins(hellos: DataFrame, json: str, magic: str) -> DataFrame:
    """Relay joins: role, pair_code in capitals, and error (bad_json, bad_magic, need_role_and_code) beside the other columns."""
    got = F.from_json(json, "magic string, role string, pair_code string, version string")
    code = F.upper(F.coalesce(got["pair_code"], F.lit("")))
    error = (
        F.when(F.get_json_object(json, "$").isNull(), "bad_json")
        .when(~got["magic"].eqNullSafe(F.lit(magic)), "bad_magic")
        .when((code == "") | ~F.coalesce(got["role"].isin("gateway", "agent"), F.lit(False)), "need_role_and_code")
    )
    return hellos.select(*(c for c in hellos.columns if c != json), got["role"].alias("role"), code.alias("pair_code"), error.alias("error"))


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every file of a folder."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_daily_logs(lines: DataFrame, ts: str, line: str, path: str) -> None:
    """Log lines as text, a folder for each day."""
    lines.select(F.to_date(ts).alias("day"), F.col(line).alias("value")).write.mode("append").partitionBy("day").text(path)
