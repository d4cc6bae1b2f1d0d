"""Joins of records by id, position, time interval and nearness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_frames(candidates: DataFrame, frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Inner: candidates whose frame, and whose frame's video, are known. Spark broadcasts the videos if small."""
    return candidates.join(frames, "keyframe_id").join(videos, "video_id")


def ordinal_to_frame(vectors: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vectors: video_id, index (from 0); maps: video_id, n (from 1), keyframe_id. Matched rows, and failed ones with a reason."""
    joined = vectors.withColumn("n", F.col("index") + 1).join(maps, ["video_id", "n"], "left")
    failed = joined.where("keyframe_id is null").select("video_id", "index", F.lit("no map row for this vector").alias("reason"))
    return joined.where("keyframe_id is not null"), failed


def bridge_by_ratio(vectors: DataFrame, frames: DataFrame) -> DataFrame:
    """Vectors and frames of a video in unlike numbers: vector i goes to frame round-half-even(i * (F - 1) / (V - 1)).

    vectors: video_id, index; frames: video_id, frame_idx. One vector or one frame meet the first frame.
    """
    w = Window.partitionBy("video_id")
    placed = frames.withColumn("position", F.row_number().over(w.orderBy("frame_idx")) - 1)
    n_frames = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("f"))
    counted = vectors.withColumn("v", F.count(F.lit(1)).over(w)).join(n_frames, "video_id")
    exact = F.col("index").cast("double") * (F.col("f") - 1) / (F.col("v") - 1)
    target = F.when((F.col("v") <= 1) | (F.col("f") == 1), F.lit(0)).otherwise(F.least(F.greatest(F.bround(exact, 0), F.lit(0.0)), F.col("f") - 1)).cast("int")
    return counted.withColumn("position", target).join(placed, ["video_id", "position"]).select("video_id", "index", "frame_idx")


def align_interval(segments: DataFrame, frames: DataFrame, pad_ms: int = 1_000, most: int = 8, bucket_ms: int = 600_000) -> DataFrame:
    """segments: video_id, segment_id, start_ms, end_ms; frames: video_id, keyframe_id, frame_idx, timestamp_ms.

    Frames within the padded interval, at most the `most` nearest to its midpoint; a segment with none takes the one
    frame of its video nearest to the midpoint. Time buckets are part of the join key, so a long video is many keys.
    """
    s = segments.withColumns({"low": F.col("start_ms") - pad_ms, "high": F.col("end_ms") + pad_ms, "middle": (F.col("start_ms") + F.col("end_ms")) / 2})
    bucket = lambda c: F.floor(F.col(c) / bucket_ms)
    keyed = s.withColumn("bucket", F.explode(F.sequence(bucket("low"), bucket("high"))))
    f = frames.select("video_id", "keyframe_id", "frame_idx", "timestamp_ms", bucket("timestamp_ms").alias("bucket"))
    inside = keyed.join(f, ["video_id", "bucket"]).where("timestamp_ms between low and high")
    segment = ["video_id", "segment_id"]
    nearest = Window.partitionBy(*segment).orderBy(F.abs(F.col("timestamp_ms") - F.col("middle")), "frame_idx")
    chosen = inside.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= most)
    bare = s.join(inside.select(*segment).distinct(), segment, "left_anti")
    lone = around(bare.select(F.col("segment_id").alias("request_id"), "video_id", F.col("middle").alias("at")), frames, bucket_ms)
    lone = lone.select("video_id", F.col("request_id").alias("segment_id"), "nearest.keyframe_id", "nearest.frame_idx")
    columns = [*segment, "keyframe_id", "frame_idx"]
    return chosen.select(*columns, F.lit(True).alias("covered")).unionByName(lone.select(*columns, F.lit(False).alias("covered")))


def align_propagate(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Each frame takes the segment that covers its time, else the last one that began before it (propagated), else none.

    One pass over frames and segments of a video in order of time instead of a range join. The segments of a video
    don't overlap. segments: video_id, segment_id, start_ms, end_ms.
    """
    none = F.lit(None)
    f = frames.select("video_id", F.col("timestamp_ms").alias("t"), F.lit(1).alias("kind"), "keyframe_id", none.cast("struct<segment_id:bigint,end_ms:bigint>").alias("s"))
    s = segments.select("video_id", F.col("start_ms").alias("t"), F.lit(0).alias("kind"), none.cast("long").alias("keyframe_id"), F.struct(F.col("segment_id").cast("long").alias("segment_id"), F.col("end_ms").cast("long").alias("end_ms")).alias("s"))
    w = Window.partitionBy("video_id").orderBy("t", "kind", "s.segment_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = f.unionByName(s).withColumn("last", F.last("s", ignorenulls=True).over(w)).where("kind = 1")
    return seen.select("video_id", "keyframe_id", F.col("last.segment_id").alias("segment_id"), F.coalesce(F.col("t") > F.col("last.end_ms"), F.lit(False)).alias("propagated"))


def frame_context(anchors: DataFrame, frames: DataFrame, around: int) -> DataFrame:
    """anchors: video_id, keyframe_id. The `around` (1 to 24) frames before, the frame, and those after it."""
    n = min(max(around, 1), 24)
    w = Window.partitionBy("video_id").orderBy("frame_idx", "keyframe_id")
    placed = frames.select("video_id", "keyframe_id", "frame_idx", F.row_number().over(w).alias("position"))
    own = placed.join(anchors, ["video_id", "keyframe_id"], "left_semi").select("video_id", F.col("keyframe_id").alias("anchor_id"), F.col("position").alias("at"))
    near = own.withColumn("position", F.explode(F.sequence(F.col("at") - n, F.col("at") + n)))
    return near.join(placed, ["video_id", "position"]).select("anchor_id", "video_id", "keyframe_id", "frame_idx", (F.col("position") - F.col("at")).alias("step"))


def around(requests: DataFrame, frames: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """requests: request_id, video_id, at (time in ms); frames: video_id, keyframe_id, frame_idx, timestamp_ms.

    Adds nearest (distance, frame_idx, keyframe_id; ties: lower index), next_id and previous_id (strictly later and
    earlier). Requests without time, or whose video has no frame with a time, are left out.

    No request meets the frames of its video: both are put in order of time within a video's time buckets, and what
    lies beyond a bucket's edge is its neighbours' last or first frame, so a long video is many keys.
    """
    bucket = F.floor(F.col("t") / bucket_ms)
    entry = F.struct("frame_idx", "keyframe_id")
    f = frames.where("timestamp_ms is not null").groupBy("video_id", F.col("timestamp_ms").cast("double").alias("t")).agg(F.min(entry).alias("low"), F.max(entry).alias("high"))
    f = f.withColumn("bucket", bucket).withColumn("p", F.struct("t", "low", "high"))
    within = Window.partitionBy("video_id", "bucket")
    f = f.withColumn("s", F.struct("p", F.lag("p").over(within.orderBy("t")).alias("before")))
    r = requests.where("at is not null").withColumn("t", F.col("at").cast("double")).select("video_id", "t", bucket.alias("bucket"), F.struct("request_id", "at").alias("r"))
    rows = f.select("video_id", "t", "bucket", "s").unionByName(r, allowMissingColumns=True)
    # At one time a request comes after the frame in rising order, and before it in falling order.
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    asked = F.col("r").isNotNull()
    rising, falling = so_far(within.orderBy("t", asked)), so_far(within.orderBy(F.desc("t"), ~asked))
    placed = rows.withColumns({"upto": F.last("s", ignorenulls=True).over(rising), "later": F.last("s.p", ignorenulls=True).over(falling)}).where(asked)
    ends = rows.groupBy("video_id", "bucket").agg(F.min("s.p").alias("first"), F.max("s.p").alias("last"))  # one row a bucket
    by_bucket = Window.partitionBy("video_id")
    beside = ends.select(
        "video_id", "bucket", F.last("last", ignorenulls=True).over(so_far(by_bucket.orderBy("bucket"))).alias("left"),
        F.last("first", ignorenulls=True).over(so_far(by_bucket.orderBy(F.desc("bucket")))).alias("right"),
    )
    d = placed.join(beside, ["video_id", "bucket"])
    same = F.coalesce(F.col("upto.p.t") == F.col("t"), F.lit(False))
    d = d.select(
        "video_id", "t", "r", F.when(same, F.col("upto.p")).alias("same"), F.coalesce(F.when(same, F.col("upto.before")).otherwise(F.col("upto.p")), "left").alias("earlier"),
        F.coalesce("later", "right").alias("later"),
    )
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("t")).alias("distance"), f"{c}.low.frame_idx", f"{c}.low.keyframe_id"))
    nearest = F.array_min(F.array_compact(F.array(near("same"), near("earlier"), near("later"))))
    return d.select("r.request_id", "video_id", "r.at", nearest.alias("nearest"), F.col("later.low.keyframe_id").alias("next_id"), F.col("earlier.high.keyframe_id").alias("previous_id")).where("nearest is not null")


def seek_frame(requests: DataFrame, frames: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """requests: request_id, video_id, timestamp_ms. The nearest frame (ties: lower index), the next and the one before."""
    found = around(requests.withColumnRenamed("timestamp_ms", "at"), frames, bucket_ms)
    return found.select("request_id", F.col("nearest.keyframe_id").alias("nearest_id"), "next_id", "previous_id")


def nearest_between(gaps: DataFrame, frames: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """gaps: request_id, video_id, a, b. The frame strictly between both times that is nearest to their middle, if any.

    The nearest of all frames is between them, or none is.
    """
    half = (F.col("b") - F.col("a")) / 2
    asked = gaps.select(F.struct("request_id", half.alias("half")).alias("request_id"), "video_id", ((F.col("a") + F.col("b")) / 2).alias("at"))
    found = around(asked, frames, bucket_ms).where(F.col("nearest.distance") < F.col("request_id.half"))
    return found.select("request_id.request_id", "video_id", "nearest.keyframe_id", "nearest.frame_idx")


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of rows whose key is unique on both sides; rows of repeated keys are left out (see repeated_keys)."""
    return a.join(repeated_keys(a, keys), keys, "left_anti").join(b.join(repeated_keys(b, keys), keys, "left_anti"), keys, "left")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(*keys)


def coverage(frames: DataFrame, notes: DataFrame, key: str, fill: dict[str, Column]) -> DataFrame:
    """Every frame once, with defaults where it has no note."""
    joined = frames.join(notes.withColumn("matched", F.lit(True)), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in fill.items()} | {"matched": F.coalesce("matched", F.lit(False))})


def reconcile_presence(frames: DataFrame, listed: DataFrame) -> DataFrame:
    """frames: key, present; listed: key. What the listing says and whether the flag changes."""
    seen = frames.join(listed.select("key").distinct().withColumn("found", F.lit(True)), "key", "left")
    found = F.coalesce("found", F.lit(False))
    return seen.withColumn("found", found).withColumn("change", F.when(found & ~F.col("present"), "appeared").when(~found & F.col("present"), "vanished").otherwise("same"))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work not yet done without error. done: keys and error (null if it went well)."""
    return work.join(done.where("error is null").select(*keys).distinct(), keys, "left_anti")


def enrich(objects: DataFrame, manifest: DataFrame, key: str, order: str) -> DataFrame:
    """Objects with their manifest row, the last by `order` where there are several, blanks where there is none."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = manifest.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return objects.join(last, key, "left")
