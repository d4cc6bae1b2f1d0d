"""Operators on rows in order of time within a video."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calibrate(candidates: DataFrame) -> DataFrame:
    """Adds relative = (1 + ln 2) / (1 + ln(1 + rank)), with ranks by hybrid, and calibrated: 0.6 relative + 0.2 score +
    0.2 hybrid, both scores within 0 and 1.

    candidates: query_id, event_index, keyframe_id, score (semantic; null: the other weights are scaled up), hybrid.
    """
    w = Window.partitionBy("query_id", "event_index").orderBy(F.desc("hybrid"), "keyframe_id")
    rank = F.row_number().over(w)
    d = candidates.withColumn("relative", (1 + F.log(F.lit(2.0))) / (1 + F.log(1.0 + rank)))
    within = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))))
    part = 0.6 * F.col("relative") + 0.2 * within("hybrid")
    full, part = part + 0.2 * within("score"), part / 0.8
    return d.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(full, part))))


def boundaries_to_shots(boundaries: DataFrame, videos: DataFrame, least: int = 5) -> DataFrame:
    """boundaries: video_id, boundary; videos: video_id, n_frames. Inclusive frame ranges of at least `least` frames.

    A range begins behind the boundary before it even where that one's range was too short; a video without any
    range is one shot.
    """
    last = F.col("n_frames") - 1
    b = boundaries.join(videos, "video_id").select("video_id", F.greatest(F.lit(0), F.least("boundary", last)).alias("end")).distinct()
    b = b.unionByName(videos.select("video_id", last.alias("end"))).distinct()
    before = F.lag("end").over(Window.partitionBy("video_id").orderBy("end"))
    ranges = b.select("video_id", F.coalesce(before + 1, F.lit(0)).alias("start"), "end").where(F.col("end") - F.col("start") + 1 >= least)
    whole = videos.join(ranges, "video_id", "left_anti").where("n_frames > 0").select("video_id", F.lit(0).cast("long").alias("start"), last.alias("end"))
    return ranges.select("video_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).unionByName(whole.select("video_id", "start", F.col("end").cast("long").alias("end")))


def histogram_boundaries(histograms: DataFrame, least: float = 0.40) -> DataFrame:
    """histograms: video_id, frame_idx, histogram. Frames whose correlation with the one before is below 1 - least."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    p = histograms.withColumn("before", F.lag("histogram").over(w)).where("before is not null")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    d = p.withColumns({"ma": mean(F.col("before")), "mb": mean(F.col("histogram"))})
    d = d.withColumns({"a": F.transform("before", lambda x: x - F.col("ma")), "b": F.transform("histogram", lambda x: x - F.col("mb"))})
    norm = F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))
    change = 1 - F.when(norm > 0, dot(F.col("a"), F.col("b")) / norm).otherwise(1.0)
    return d.select("video_id", "frame_idx", change.alias("change")).where(F.col("change") > least)


def merge_shots(shots: DataFrame, least: int = 3, gap: int = 2) -> DataFrame:
    """shots: video_id, start, end. Ranges of end - start >= least, joined where the next begins at most `gap` later."""
    w = Window.partitionBy("video_id").orderBy("start", "end")
    kept = shots.where(F.col("end") - F.col("start") >= least)
    far = F.coalesce(F.col("start") - F.lag("end").over(w) > gap, F.lit(True))
    return kept.withColumn("island", F.sum(far.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("video_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def pick_keyframes(shots: DataFrame) -> DataFrame:
    """The first, middle (rounded down) and last frame of each range; shorter ranges have fewer."""
    one = lambda n, c: F.struct(F.lit(n).alias("role"), c.cast("long").alias("frame_idx"))
    first, last = one("first", F.col("start")), one("last", F.col("end"))
    middle = one("middle", F.floor((F.col("start") + F.col("end")) / 2))
    size = F.col("end") - F.col("start") + 1
    roles = F.when(size <= 1, F.array(first)).when(size == 2, F.array(first, last)).otherwise(F.array(first, middle, last))
    return shots.select("video_id", "start", "end", F.explode(roles).alias("k")).select("video_id", "start", "end", "k.role", "k.frame_idx")


def _units(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A batch's vectors as rows of unit length, shorter ones filled up with zeros, and their lengths.

    Null vectors have length 0; those with a null or non-finite part are of nan.
    """
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    rows = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1)))
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows[~np.isfinite(rows).all(1)] = np.nan
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(norm == 0, 1.0, norm)[:, None], sizes


def segment_events(keyframes: DataFrame, centroid: bool = False, gap: float = 6.0, alike: float = 0.72, span: float = 45.0) -> DataFrame:
    """keyframes: video_id, keyframe_id, seconds, embedding. Runs of neighbouring keyframes that are one event.

    A keyframe extends the event while the time gap, the cosine to the one before (or to the event's mean so far) and
    the span from the event's start allow it. Returns video_id, event_no (from 0), first and
    last keyframe, seconds, and n. A keyframe without time or vector, with null or non-finite parts of it, or with
    another length than its neighbour, is like none. Rows come to the fold run by run in order, and only the running
    event is held. Cosines to the row before are one product a batch; only the event's mean goes row by row.
    """
    w = Window.partitionBy("video_id").orderBy(F.asc_nulls_last("seconds"), "keyframe_id")
    apart = F.coalesce((F.col("seconds") - F.lag("seconds").over(w)) > gap, F.lit(True))
    cut = keyframes.select("video_id", "keyframe_id", F.col("seconds").cast("double").alias("seconds"), "embedding", apart.cast("int").alias("apart"))
    # No event crosses a gap over the limit, so runs between such gaps are folded apart.
    runs = cut.select("video_id", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), "seconds", "keyframe_id", "embedding")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        event: list | None = None  # video, first, last keyframe, first, last second, rows
        own: tuple | None = None  # video and run of the last row
        last, last_size, mean = np.zeros(1), 0, np.zeros(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, sizes = _units(batch.column("embedding"))
            videos, runs_, ids, times = (batch.column(c).to_pylist() for c in ("video_id", "run", "keyframe_id", "seconds"))
            before = np.zeros_like(x)
            before[1:] = x[:-1]
            k = min(len(last), x.shape[1])
            before[0, :k] = last[:k]
            same_size = (sizes == np.concatenate(([last_size], sizes[:-1]))) & (sizes > 0)
            to_last = np.where(same_size, np.einsum("ij,ij->i", x, before), np.nan)
            done: list[list] = []
            for i, row in enumerate(zip(videos, runs_, strict=True)):
                near = row == own and times[i] is not None and bool(same_size[i]) and times[i] - event[3] <= span
                if near and centroid:
                    near = float(mean @ x[i, : len(mean)]) >= alike * (np.sqrt(mean @ mean) or 1.0)
                elif near:
                    near = bool(to_last[i] >= alike)
                if near:
                    event[2], event[4], event[5] = ids[i], times[i], event[5] + 1
                    mean = mean + x[i, : len(mean)] if centroid else mean
                else:
                    if event:
                        done.append(event)
                    event, mean = [row[0], ids[i], ids[i], times[i], times[i], 1], x[i, : max(int(sizes[i]), 1)]
                own = row
            last, last_size = x[-1].copy(), int(sizes[-1])
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, e, strict=True)) for e in done], schema)
        if event:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, event, strict=True))], schema)

    integer, real = pa.int64(), pa.float64()
    schema = pa.schema([("video_id", integer), ("first_keyframe", integer), ("last_keyframe", integer), ("start_seconds", real), ("end_seconds", real), ("n", pa.int32())])
    dealt = runs.repartition("video_id", "run").sortWithinPartitions("video_id", "run", F.asc_nulls_last("seconds"), "keyframe_id")
    events = dealt.mapInArrow(fold, "video_id long, first_keyframe long, last_keyframe long, start_seconds double, end_seconds double, n int")
    number = F.row_number().over(Window.partitionBy("video_id").orderBy(F.asc_nulls_last("start_seconds"), "first_keyframe")) - 1
    return events.select("video_id", number.cast("int").alias("event_no"), "first_keyframe", "last_keyframe", "start_seconds", "end_seconds", "n")


def mean_pool(vectors: DataFrame, key: str) -> DataFrame:
    """The mean vector of each group, of unit length unless it is zero. Sums by position, so no group is gathered."""
    cells = vectors.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = cells.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).select(key, F.when(F.col("norm") > 0, F.transform("mean", lambda x: x / F.col("norm"))).otherwise(F.col("mean")).alias("mean"))


def sequence_deltas(members: DataFrame, keys: list[str]) -> DataFrame:
    """members: keys, position, frame_idx. The steps between members and whether all rise."""
    w = Window.partitionBy(*keys).orderBy("position")
    d = members.withColumn("delta", F.col("frame_idx") - F.lag("frame_idx").over(w))
    steps = F.transform(F.sort_array(F.collect_list(F.struct("position", "delta"))), lambda x: x["delta"])
    return d.groupBy(*keys).agg(F.filter(steps, lambda x: x.isNotNull()).alias("deltas"), F.coalesce(F.bool_and(F.col("delta") > 0), F.lit(True)).alias("rising"))


def sample_evenly(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """k rows of each group (all, if fewer) at evenly spaced places, the first and the last among them."""
    w = Window.partitionBy(key)
    d = rows.withColumns({"position": F.row_number().over(w.orderBy(*order)) - 1, "size": F.count(F.lit(1)).over(w)})
    step = lambda i: F.floor(i * (F.col("size") - 1) / F.lit(max(k - 1, 1)))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), step)
    return d.where((F.col("size") <= k) | F.array_contains(places, F.col("position").cast("long"))).drop("size")


def monotonic(rows: DataFrame) -> DataFrame:
    """rows: video_id, n, timestamp_ms, frame_idx. Whether time and index never fall in order of n."""
    w = Window.partitionBy("video_id").orderBy("n")
    ok = lambda c: F.coalesce(F.col(c) >= F.lag(c).over(w), F.lit(True))
    return rows.select("video_id", ok("timestamp_ms").alias("t"), ok("frame_idx").alias("i")).groupBy("video_id").agg(F.bool_and("t").alias("time_rises"), F.bool_and("i").alias("index_rises"))
