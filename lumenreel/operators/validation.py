"""Set operations, checks and reconciliation. Violations are rows, with a code or rule name, never exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_parity(stored: DataFrame, extracted: DataFrame, sample: int = 10) -> DataFrame:
    """stored, extracted: video_id, id. Missing and extra ids of each video with samples; nothing stored yet passes."""
    both = stored.select("video_id", "id", F.lit(1).alias("s"), F.lit(0).alias("e")).unionByName(extracted.select("video_id", "id", F.lit(0).alias("s"), F.lit(1).alias("e")))
    one = both.groupBy("video_id", "id").agg(F.max("s").alias("s"), F.max("e").alias("e"))
    missing, extra = (F.col("s") == 0), (F.col("e") == 0)
    first = lambda c: F.slice(F.sort_array(F.collect_set(F.when(c, F.col("id")))), 1, sample)
    g = one.groupBy("video_id").agg(
        F.sum("s").alias("stored"), F.sum(missing.cast("long")).alias("missing"), F.sum(extra.cast("long")).alias("extra"), first(missing).alias("missing_sample"), first(extra).alias("extra_sample")
    )
    return g.withColumn("passed", (F.col("stored") == 0) | ((F.col("missing") == 0) & (F.col("extra") == 0)))


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each key and rule whose condition holds; one pass however many rules."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return df.select(*keys, F.explode(broken).alias("rule"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, stage: str) -> DataFrame:
    """Child rows whose parent isn't there, with stage and reason."""
    p = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.join(p, child[child_key] == p["_parent"], "left_anti").withColumns({"stage": F.lit(stage), "reason": F.lit(f"no {parent_key} for this {child_key}")})


def metrics_row(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of one count each, as rows metric and value."""
    return reduce(DataFrame.unionByName, (d.agg(F.count(F.lit(1)).alias("value")).select(F.lit(n).alias("metric"), "value") for n, d in parts.items()))


def map_table_issues(maps: DataFrame, counts: DataFrame) -> DataFrame:
    """maps: video_id, n, timestamp_ms, frame_idx, fps; counts: video_id, frames. Issue codes and PASS or FAIL of each video."""
    w = Window.partitionBy("video_id").orderBy("n")
    d = maps.withColumns({"dt": F.col("timestamp_ms") - F.lag("timestamp_ms").over(w), "di": F.col("frame_idx") - F.lag("frame_idx").over(w)})
    g = d.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("n").alias("ns"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("dt").alias("dt"), F.min("di").alias("di"),
        F.min("timestamp_ms").alias("t"), F.min("frame_idx").alias("i"), F.min("fps").alias("f0"), F.max("fps").alias("f1"),
    )
    j = g.join(counts, "video_id", "full")
    codes = {
        "no_map": F.col("rows").isNull(), "no_frames": F.col("frames").isNull(), "count": F.col("rows") != F.col("frames"), "n_repeats": F.col("ns") != F.col("rows"), "n_start": F.col("low") != 1,
        "n_gap": F.col("high") - F.col("low") + 1 != F.col("ns"), "time_falls": F.col("dt") < 0, "index_falls": F.col("di") < 0, "time_negative": F.col("t") < 0, "index_negative": F.col("i") < 0,
        "fps_low": F.col("f0") <= 0, "fps_varies": F.col("f0") != F.col("f1"),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in codes.items())))
    return j.select("video_id", F.concat_ws(",", found).alias("issues"), F.when(F.size(found) == 0, "PASS").otherwise("FAIL").alias("status"))


def check_transcripts(rows: DataFrame) -> DataFrame:
    """rows: line, video_id, position, segment_id, segment_video_id, text, start_seconds, end_seconds; a record (line)
    without segments is one row without position. Adds rule, the first that a row breaks; null if it is good.

    Of records of one video the one of the least line counts. Of segments of one id, among records that count, the first
    by line and position does, even if it breaks a later rule. A segment that names no video is its record's.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    first_line = rows.where(~blank("video_id")).groupBy("video_id").agg(F.min("line").alias("_first_line"))
    d = rows.join(first_line, "video_id", "left")
    counts = ~blank("video_id") & (F.col("line") == F.col("_first_line"))
    place = F.struct("line", "position")
    first_place = d.where(counts & ~blank("segment_id")).groupBy("segment_id").agg(F.min(place).alias("_first_place"))
    d = d.join(first_place, "segment_id", "left")
    rules = {
        "missing_video": blank("video_id"), "duplicate_video": ~counts, "": F.col("position").isNull(), "missing_segment": blank("segment_id"), "duplicate_segment": place != F.col("_first_place"),
        "other_video": ~blank("segment_video_id") & (F.trim(F.col("segment_video_id").cast("string")) != F.trim(F.col("video_id").cast("string"))), "empty_text": blank("text"),
        "no_time": F.col("start_seconds").isNull() | F.col("end_seconds").isNull(), "bad_range": (F.col("start_seconds") < 0) | (F.col("end_seconds") < F.col("start_seconds")),
    }
    rule = F.coalesce(*(F.when(broken, name) for name, broken in rules.items()))
    return d.select(*rows.columns, F.nullif(rule, F.lit("")).alias("rule"))


def submission_violations(rows: DataFrame) -> DataFrame:
    """rows: query_name, query_type, rank, video_code, frame_indices (array), answer. Codes of each broken row."""
    frames, kind = F.col("frame_indices"), F.col("query_type")
    rising = F.forall(F.zip_with(F.expr("slice(frame_indices, 1, greatest(size(frame_indices) - 1, 0))"), F.expr("slice(frame_indices, 2, size(frame_indices))"), lambda a, b: b > a), lambda x: x)
    n = F.count(F.lit(1)).over(Window.partitionBy("query_name"))
    same = F.count(F.lit(1)).over(Window.partitionBy("query_name", "rank"))
    return violations(
        rows.withColumns({"_n": n, "_same": same}), ["query_name", "rank"],
        {
            "too_many_rows": F.col("_n") > 100, "rank_range": ~F.col("rank").between(1, 100), "rank_repeats": F.col("_same") > 1, "video_empty": F.trim("video_code") == "", "video_suffix": F.col("video_code").endswith(".mp4"),
            "frame_missing": F.size(frames) == 0, "frame_count": kind.isin("KIS", "QA") & (F.size(frames) > 1), "frame_negative": F.exists(frames, lambda f: f < 0), "answer_missing": (kind == "QA") & (F.trim(F.coalesce("answer", F.lit(""))) == ""),
            "answer_long": (kind == "QA") & (F.length("answer") > 100), "answer_extra": (kind != "QA") & F.col("answer").isNotNull(), "order": (kind == "TRAKE") & ~F.coalesce(rising, F.lit(True)),
        },
    )


def collisions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new, existing: video_id, dataset, uri, version; existing: complete. What to do with each new video."""
    e = existing.select("video_id", *(F.col(c).alias(f"e_{c}") for c in ("dataset", "uri", "version", "complete")))
    j = new.join(e, "video_id", "left")
    action = (
        F.when(F.col("e_dataset").isNull(), "create").when(F.col("e_dataset") != F.col("dataset"), "fail_dataset").when(F.col("e_uri") != F.col("uri"), "fail_uri")
        .when(F.col("e_version") != F.col("version"), "fail_version").when(F.col("e_complete"), "skip").otherwise("resume")
    )
    return j.select("video_id", action.alias("action"))


def compare_manifests(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Both: metric, key, rows. Side by side, with whether the counts are equal."""
    a, e = actual.withColumnRenamed("rows", "actual"), expected.withColumnRenamed("rows", "expected")
    return a.join(e, ["metric", "key"], "full").withColumn("equal", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))


def key_sync(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows on either side, and the source's keys that the target has and lacks."""
    marks = source.select(key, F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(target.select(key, F.lit(0).alias("s"), F.lit(1).alias("t")))
    one = marks.groupBy(key).agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    flag = lambda c: F.sum(c.cast("long"))
    return one.agg(F.sum("s").alias("source_rows"), F.sum("t").alias("target_rows"), flag((F.col("s") > 0) & (F.col("t") > 0)).alias("existing"), flag((F.col("s") > 0) & (F.col("t") == 0)).alias("missing"))


def list_digest(results: DataFrame, keys: list[str]) -> DataFrame:
    """results: keys, rank, id. One hash of each ordered list."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))), lambda x: x["id"])
    return results.groupBy(*keys).agg(F.sha2(F.concat_ws(",", ordered), 256).alias("digest"))


def paired_parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    x, y = list_digest(a, keys).withColumnRenamed("digest", "a"), list_digest(b, keys).withColumnRenamed("digest", "b")
    return x.join(y, keys, "full").select(*keys, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def vector_report(vectors: DataFrame, by: str, dim: int, tolerance: float = 1e-3) -> DataFrame:
    """vectors: by, index, embedding. Per group: rows, wrong sizes, values that aren't finite, zero vectors, norms off 1,
    and whether the indices are dense."""
    v = F.col("embedding")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    d = vectors.withColumn("norm", norm)
    n = lambda c: F.sum(F.coalesce(c, F.lit(True)).cast("long"))
    return d.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), n(F.size(v) != dim).alias("wrong_size"), n(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"), n(F.col("norm") == 0).alias("zero"),
        n(F.abs(F.col("norm") - 1) > tolerance).alias("off_unit"), F.max(F.abs(F.col("norm") - 1)).alias("largest_error"), (F.max("index") - F.min("index") + 1 == F.count(F.lit(1))).alias("dense"),
    )


def pad_vectors(vectors: DataFrame, frames: DataFrame, dim: int) -> DataFrame:
    """Frames without a vector of their index get a zero one; vectors beyond the frames are cut."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return frames.join(vectors, ["video_id", "index"], "left").withColumn("embedding", F.coalesce("embedding", zero))
