"""Roll-ups of records by video, shot, keyframe, folder and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def video_rollup(rows: DataFrame) -> DataFrame:
    """rows: video_id, row_id, end_frame, fps, total_frames. The first positive fps is that of the smallest row_id."""
    good = F.when(F.col("fps") > 0, F.col("row_id"))
    return rows.groupBy("video_id").agg(F.max("end_frame").alias("end_frame"), F.min_by("fps", good).alias("fps"), F.max("total_frames").alias("total_frames"), F.count(F.lit(1)).alias("rows"))


def shot_rollup(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in ("frame_idx", "timestamp_ms") for n, f in (("min", F.min), ("max", F.max))))


def infer_fps(frames: DataFrame, first: int = 24) -> DataFrame:
    """The median of frame_idx per second over each video's first positive rows, kept from 1 to 240."""
    w = Window.partitionBy("video_id").orderBy("frame_idx", "keyframe_id")
    some = frames.where("frame_idx > 0 and timestamp_ms > 0").withColumn("n", F.row_number().over(w)).where(F.col("n") <= first)
    rate = some.groupBy("video_id").agg(F.percentile(F.col("frame_idx") / (F.col("timestamp_ms") / 1000.0), F.lit(0.5)).alias("fps"))
    return rate.withColumn("fps", F.when(F.col("fps").between(1, 240), F.col("fps")))


#: One fact about a keyframe: its caption, a label, the count of a label or its embedding. first and last are places in the rows.
STATE = (
    "keyframe_id string, kind string, label string, first struct<row_id:long,place:int>, last struct<row_id:long,place:int>, "
    "caption string, n int, embedding array<double>"
)


def annotation_states(rows: DataFrame) -> DataFrame:
    """rows: keyframe_id, row_id, caption, labels (array), counts (map), embedding (array) or not. Merged facts, STATE.

    A keyframe's facts are rows of their own, so one with very many annotations is merged by many tasks. Rows without
    keyframe_id are left out.
    """
    d = rows.where("keyframe_id is not null").withColumn("keyframe_id", F.col("keyframe_id").cast("string"))
    place = lambda n: F.struct(F.col("row_id").cast("long").alias("row_id"), n.cast("int").alias("place"))
    none = {"label": F.lit(""), "caption": F.lit(None).cast("string"), "n": F.lit(None).cast("int"), "embedding": F.lit(None).cast("array<double>")}

    def facts(df: DataFrame, kind: str, at: Column = F.lit(0), **own: Column) -> DataFrame:
        return df.select("keyframe_id", F.lit(kind).alias("kind"), (none | own)["label"].alias("label"), place(at).alias("first"), place(at).alias("last"),
                         *((none | own)[c].alias(c) for c in ("caption", "n", "embedding")))

    every = facts(d.where("trim(caption) <> ''"), "caption", caption=F.col("caption"))
    every = every.unionByName(facts(d, "seen"))
    listed = d.select("keyframe_id", "row_id", F.posexplode("labels").alias("at", "of")).where("of is not null")
    every = every.unionByName(facts(listed, "label", F.col("at"), label=F.col("of")))
    counted = d.select("keyframe_id", "row_id", F.explode("counts").alias("of", "much"))
    every = every.unionByName(facts(counted, "count", label=F.col("of"), n=F.col("much").cast("int")))
    if "embedding" in rows.columns:
        every = every.unionByName(facts(d.where("embedding is not null"), "embedding", embedding=F.col("embedding").cast("array<double>")))
    return merge_states(every)


def merge_states(states: DataFrame) -> DataFrame:
    """One row of each fact: first and last place, what stood at the last one, and the largest count. Associative and
    commutative, and a state merged with itself is itself."""
    return states.groupBy("keyframe_id", "kind", "label").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max_by("caption", F.struct("last", "caption")).alias("caption"), F.max("n").alias("n"),
        F.max_by("embedding", F.struct("last", "embedding")).alias("embedding"),
    )


def annotations_of(states: DataFrame) -> DataFrame:
    """Merged states as keyframe_id, caption, labels in order of their first place, counts by label, and embedding."""
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    labels = F.sort_array(F.collect_list(of("label", F.struct("first", "label"))))
    counts = F.sort_array(F.collect_list(of("count", F.struct("label", "n"))))
    return states.groupBy("keyframe_id").agg(
        F.max(of("caption", F.col("caption"))).alias("caption"), F.transform(labels, lambda x: x["label"]).alias("labels"),
        F.when(F.size(counts) > 0, F.map_from_entries(counts)).alias("counts"), F.max(of("embedding", F.col("embedding"))).alias("embedding"),
    )


def merge_annotations(rows: DataFrame) -> DataFrame:
    """rows: keyframe_id, row_id, caption, labels (array), counts (map). The last caption that isn't blank, distinct
    labels in order of their first row, and the largest count of each label."""
    merged = annotations_of(annotation_states(rows)).select("keyframe_id", "caption", "labels", "counts")
    return merged.withColumn("keyframe_id", F.col("keyframe_id").cast(dict(rows.dtypes)["keyframe_id"]))


def object_counts(frames: DataFrame) -> DataFrame:
    """frames: keyframe_id, labels (array). The sorted distinct labels and how often each occurs."""
    n = frames.select("keyframe_id", F.explode("labels").alias("label")).groupBy("keyframe_id", "label").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("label", "n")))
    return n.groupBy("keyframe_id").agg(F.transform(pairs, lambda p: p["label"]).alias("labels"), F.map_from_entries(pairs).alias("counts"))


def top_mean(candidates: DataFrame, most: int) -> DataFrame:
    """Best score of each video and the mean of its `most` best; a frame counts once."""
    frame = candidates.groupBy("query_id", "video_id", "keyframe_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id", "video_id").orderBy(F.desc("score"), "keyframe_id")
    some = frame.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return some.groupBy("query_id", "video_id").agg(F.max("score").alias("best"), F.avg("score").alias("mean"))


def cross_event_scores(candidates: DataFrame, importance: DataFrame, diagnostic: DataFrame) -> DataFrame:
    """A video's score over the events of a query: 0.55 mean of diagnostic events + 0.35 weighted mean of all
    + 0.10 coverage. importance: query_id, event_index, weight; diagnostic: query_id, event_index."""
    best = candidates.groupBy("query_id", "video_id", "event_index").agg(F.max("score").alias("score"))
    events = importance.join(diagnostic.withColumn("d", F.lit(1)), ["query_id", "event_index"], "left")
    total = events.groupBy("query_id").agg(F.sum("weight").alias("weights"), F.count("d").alias("ds"), F.count(F.lit(1)).alias("events"))
    scored = best.join(events, ["query_id", "event_index"])
    sums = scored.groupBy("query_id", "video_id").agg(
        F.sum(F.col("score") * F.col("weight")).alias("weighted"), F.sum(F.when(F.col("d") == 1, F.col("score")).otherwise(0.0)).alias("hit"), F.count(F.lit(1)).alias("seen")
    )
    j = sums.join(total, "query_id")
    part = F.when(F.col("ds") > 0, F.col("hit") / F.col("ds")).otherwise(0.0)
    score = 0.55 * part + 0.35 * F.col("weighted") / F.col("weights") + 0.10 * F.col("seen") / F.col("events")
    return j.select("query_id", "video_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def event_probe(candidates: DataFrame, k: int) -> DataFrame:
    """Of the k best of each event: selectivity 1 - videos / rows, margin of the best over the mean of the next five."""
    w = Window.partitionBy("query_id", "event_index").orderBy(F.desc("score"), "keyframe_id")
    some = candidates.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    next_five = F.coalesce(F.avg(F.when(F.col("n").between(2, 6), F.col("score"))), F.lit(0.0))
    return some.groupBy("query_id", "event_index").agg(
        (1 - F.countDistinct("video_id") / F.count(F.lit(1))).alias("selectivity"), (F.max("score") - next_five).alias("margin"), F.max("score").alias("top")
    )


def diagnostic_events(probes: DataFrame, priors: DataFrame, n: int) -> DataFrame:
    """The n events of each query that tell most: 0.55 prior + 0.45 (0.4 selectivity + 0.3 margin + 0.3 top)."""
    score = 0.55 * F.col("prior") + 0.45 * (0.4 * F.col("selectivity") + 0.3 * F.col("margin") + 0.3 * F.col("top"))
    s = probes.join(priors, ["query_id", "event_index"]).withColumn("score", score)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "event_index")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("query_id", "event_index", "score", "place")


def describe_levels(objects: DataFrame) -> DataFrame:
    """objects: object_key, size. Adds extension, level (the folder named L and a number, else <not_detected>), direct folder and depth."""
    key, name = F.col("object_key"), F.element_at(F.split("object_key", "/"), -1)
    level = F.nullif(F.regexp_extract(key, r"(?:^|/)(L\d+)/", 1), F.lit(""))
    return objects.withColumns(
        {
            "extension": F.regexp_extract(F.lower(name), r"\.([^.]+)$", 1), "level": F.coalesce(level, F.lit("<not_detected>")),
            "folder": F.regexp_extract(key, r"^(.*)/[^/]*$", 1), "depth": F.size(F.split(key, "/")).cast("long"),
        }
    )


def inventory(objects: DataFrame, approximate: bool = False) -> DataFrame:
    """objects: object_key, size. The whole, and by extension, level, direct folder and depth, in one pass of grouping sets.

    Gives grouping, key, objects, bytes, mean_bytes, largest, distinct folders and extensions, levels, deepest, and
    place (levels in the order of their numbers, the rest last; depths by themselves). Objects are added up by all
    four first, so grouping sets meet rows for folders, not for objects. approximate: distinct numbers by sketches.
    """
    by = ["extension", "level", "folder", "depth"]
    sums = describe_levels(objects).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_bytes"), F.max("size").alias("_most"))
    sums = sums.withColumns({f"_{c}": F.col(c) for c in by})
    number = F.approx_count_distinct if approximate else F.count_distinct
    detected = F.when(F.col("_level") != "<not_detected>", F.col("_level"))
    g = sums.groupingSets([[], *([c] for c in by)], *by).agg(
        F.grouping_id(*by).alias("_id"), F.sum("_n").alias("objects"), F.sum("_bytes").alias("bytes"), F.max("_most").alias("largest"), number("_folder").alias("folders"),
        number("_extension").alias("extensions"), number(detected).alias("levels"), F.max("_depth").alias("deepest"),
    )
    which = lambda k: F.col("_id") == 15 - (8 >> k)
    grouping = F.when(which(0), "extension").when(which(1), "level").when(which(2), "folder").when(which(3), "depth").otherwise("overview")
    order = F.when(which(1), F.coalesce(F.regexp_extract("level", r"^L(\d+)$", 1).try_cast("long"), F.lit(9999))).when(which(3), F.col("depth"))
    return g.select(
        grouping.alias("grouping"), F.coalesce("extension", "level", "folder", F.col("depth").cast("string")).alias("key"), "objects", "bytes",
        (F.col("bytes") / F.col("objects")).alias("mean_bytes"), "largest", "folders", "extensions", "levels", "deepest", order.cast("long").alias("place"),
    )


def folder_rollup(objects: DataFrame) -> DataFrame:
    """Each object counts in every folder above it."""
    parts = F.split("object_key", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return objects.where(F.size(parts) > 1).select(F.explode(above).alias("folder"), "size").groupBy("folder").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))


def keyword_audit(objects: DataFrame, words: list[str]) -> DataFrame:
    """Per keyword (a short list) the objects whose key holds it."""
    hit = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("object_key"), w))
    return objects.select("object_key", "size", F.explode(hit).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"), F.min("object_key").alias("sample"))


def coverage_summary(rows: DataFrame) -> DataFrame:
    """rows: video_id and flags caption, ocr, asr. Per video, and in total where video_id is null."""
    return rows.rollup("video_id").agg(F.count(F.lit(1)).alias("frames"), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("caption", "ocr", "asr")))


def counts_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by each value of each column: metric, key, rows. One pass by grouping sets."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("key")) for c in columns))).alias("x")
    return rows.select(each).groupBy("x.metric", "x.key").agg(F.count(F.lit(1)).alias("rows"))


def run_status(results: DataFrame, by: list[str]) -> DataFrame:
    """results: status (completed, failed, skipped). Any failure fails the run."""
    n = {s: F.sum((F.col("status") == s).cast("long")) for s in ("completed", "failed", "skipped")}
    state = F.when(n["failed"] > 0, "failed").when(n["completed"] > 0, "completed").otherwise("skipped")
    return results.groupBy(*by).agg(*(e.alias(s) for s, e in n.items()), state.alias("state"))


def throughput(timings: DataFrame, by: list[str]) -> DataFrame:
    """timings: items, seconds. Rates, and interpolated percentiles of the seconds."""
    rate = F.when(F.sum("seconds") > 0, F.sum("items") / F.sum("seconds"))
    return timings.groupBy(*by).agg(F.sum("items").alias("items"), F.sum("seconds").alias("seconds"), rate.alias("per_second"), *(F.percentile("seconds", F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)))
