"""Registered queries of frame logs and bundles, which are written to the shared folder and read back, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.functions import wire
from linkspan.plans.catalog import _TYPE_SQL, frame_type, query, table
from linkspan.sources import bundle, frame_log
from linkspan.sources.shared import fresh_path

#: Bytes of a block: small, so that a log of these tables is read by several tasks.
_SPLIT = 1 << 16


@query(f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'BadFrameType' END AS error, CASE WHEN event_type <> 'error' THEN CAST({_TYPE_SQL} AS SMALLINT) END AS frame_type,
    CASE WHEN event_type <> 'error' THEN props END AS payload, CAST(24 + strlen(props) AS INTEGER) AS frame_bytes FROM events""")
def frame_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames, written as frame logs, read in blocks and decoded; a frame's number is in its clock field too, in case its header is refused."""
    raw = wire.encode_frame(frame_type(), F.lit(0), F.col("event_id"), F.col("props").cast("binary"), F.col("event_id"))
    at = fresh_path(spark, "frame-log")
    frame_log.write_log(table(spark, sf_dir, "events").select(raw.alias("body")), at)
    got = frame_log.read_log(spark, at, _SPLIT).select(wire.decode_frame(F.col("body")).alias("f"), F.octet_length("body").alias("frame_bytes"), wire.unsigned(F.col("body"), 21, 4).alias("event_id"))
    return got.select("event_id", "f.error", "f.frame_type", F.col("f.payload").cast("string").alias("payload"), "frame_bytes")


@query("""WITH f AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.log' AS path, coalesce(text, '') AS text FROM documents),
    p AS (SELECT path, '===== ' || path || ' =====' || chr(10) || text || chr(10) AS piece FROM f)
    SELECT path, CAST(sum(strlen(piece)) OVER (ORDER BY encode(path), encode(piece) ROWS UNBOUNDED PRECEDING) - strlen(piece) AS BIGINT) AS start, CAST(strlen(piece) AS BIGINT) AS length, md5(piece) AS digest FROM p""")
def bundle_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one bundle of log files: the place of each in the whole text, and the digest of what is read back there."""
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".log"))
    at = fresh_path(spark, "bundle")
    bundle.write_bundle(table(spark, sf_dir, "documents").select(path.alias("path"), "text"), at)
    found = bundle.read_pieces(bundle.index(spark, at), at)
    return found.select("path", "start", "length", F.md5("content").alias("digest"))
