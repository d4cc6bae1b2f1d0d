"""The record shapes the operators expect, made from the given tables; each with the same thing in SQL.

frames        one row a time-stamped record of a video (a user is a video)
candidates    scored frames of a day's query for the ordered events view, click, purchase
segments      transcript turns with start and end seconds
annotations   texts of a video by kind of source
text_queries  whole benchmark passages
objects       an inventory of stored objects
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"


#: Rows of a part, about, where rows are dealt by a key.
PART_ROWS = 500_000
#: Bytes of an Arrow batch, or one row if that is larger: bounds what Python workers hold, however long texts are.
BATCH_BYTES = str(4 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str, part_rows: int | None = None) -> DataFrame:
    """Rows dealt by key over as many parts as their number asks for, so that parts don't grow with the table; as they are
    where the session's number of parts is enough."""
    parts = -(-rows.count() // (part_rows or PART_ROWS))
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def frames(spark: SparkSession, sf_dir: str, part_rows: int | None = None) -> DataFrame:
    """With part_rows, whole videos in parts of about so many rows."""
    e = table(spark, sf_dir, "events")
    if part_rows:
        e = dealt(e, "user_id", part_rows=part_rows)
    ms = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(ORIGIN).cast("timestamp"))) / 1000)
    return e.select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("keyframe_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("frame_idx"),
        ms.alias("timestamp_ms"), "event_type", "value",
    )


FRAMES = f"""frames AS (SELECT user_id AS video_id, event_id AS keyframe_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_idx,
  (epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) // 1000 AS timestamp_ms, event_type, value FROM events)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).where(F.col("event_type").isin("view", "click", "purchase"))
    day = F.floor(F.col("timestamp_ms") / 86_400_000)
    index = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    q = f.select(day.cast("long").alias("query_id"), index.alias("event_index"), "keyframe_id", "video_id", "frame_idx", "timestamp_ms", "value")
    top = q.groupBy("query_id").agg(F.max("value").alias("top"))
    return q.join(top, "query_id").select("query_id", "event_index", "keyframe_id", "video_id", "frame_idx", "timestamp_ms", (F.col("value") / F.col("top")).alias("score"))


CANDIDATES = (
    FRAMES
    + """, scored AS (SELECT CAST(floor(timestamp_ms / 86400000) AS BIGINT) AS query_id,
  CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS event_index,
  keyframe_id, video_id, frame_idx, timestamp_ms, value FROM frames WHERE event_type IN ('view', 'click', 'purchase')),
candidates AS (SELECT query_id, event_index, keyframe_id, video_id, frame_idx, timestamp_ms,
  value / max(value) OVER (PARTITION BY query_id) AS score FROM scored)"""
)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn lasts eight seconds from ten times its number."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("segment_id"), (F.col("turn") * 10.0).alias("start_seconds"), (F.col("turn") * 10.0 + 8.0).alias("end_seconds"), "role", "text")


SEGMENTS = """segments AS (SELECT conv_id AS video_id, turn AS segment_id, CAST(turn * 10.0 AS DOUBLE) AS start_seconds,
  CAST(turn * 10.0 + 8.0 AS DOUBLE) AS end_seconds, role, text FROM conversations)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "fr", "ocr").when(F.col("lang") == "de", "asr").otherwise("caption")
    return d.select(F.col("doc_id").alias("keyframe_id"), F.col("source").alias("video_id"), kind.alias("source_type"), "text")


ANNOTATIONS = """annotations AS (SELECT doc_id AS keyframe_id, source AS video_id,
  CASE lang WHEN 'fr' THEN 'ocr' WHEN 'de' THEN 'asr' ELSE 'caption' END AS source_type, text FROM documents)"""


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


TEXT_QUERIES = "text_queries AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    key = F.regexp_replace("url", r"^https?://", "")
    return p.select("page_id", F.regexp_replace(key, r"[?#].*$", "").alias("object_key"), F.length("html").cast("long").alias("size"))


OBJECTS = r"""objects AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS object_key,
  CAST(length(html) AS BIGINT) AS size FROM pages)"""
