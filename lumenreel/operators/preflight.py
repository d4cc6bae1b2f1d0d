"""Checks before and after an ingest: counts of everything in one pass, the quality gate, and the switch of a pointer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.operators.validation import compare_manifests, violations

# Reconciliation of what should be there with what is

#: Sides on which a key is met, as bits of a mask: what is planned or stored as rows, files of rows, files of vectors.
PLANNED, ROWS, VECTORS = 1, 2, 4


def presence(shots: DataFrame, media: DataFrame, annotations: DataFrame, videos: DataFrame, maps: DataFrame, vectors: DataFrame, event_maps: DataFrame, event_vectors: DataFrame) -> DataFrame:
    """One row for each key of each space, with the mask of its sides and counts.

    shots: video_id, shot, frame, saved, image. media: image. annotations: file, line. videos: video_id. maps: video_id, line, n.
    vectors: video_id (a row a vector). event_maps, event_vectors: name (a row a row). All rows are tagged and meet in one
    exchange, where each task has added up its own first; a key with very many rows arrives as one row a task.
    """

    def tagged(df: DataFrame, space: str, key: Column, side: int, n: Column = F.lit(1), wrong: Column = F.lit(0)) -> DataFrame:
        return df.select(F.lit(space).alias("space"), key.cast("string").alias("key"), F.lit(side).alias("side"), n.cast("long").alias("n"), wrong.cast("long").alias("wrong"))

    named = F.trim(F.coalesce(F.col("video_id").cast("string"), F.lit(""))) != ""
    saved = F.coalesce(F.col("saved"), F.lit(False))
    at = lambda space, key: F.struct(F.lit(space).alias("space"), key.cast("string").alias("key"), F.lit(PLANNED).alias("side"))
    own = F.array(
        at("shot_row", F.lit("")), F.when(named, at("frame", F.concat_ws("|", "video_id", "frame"))), F.when(named, at("shot", F.concat_ws("|", "video_id", "shot"))),
        F.when(named & saved, at("image", F.col("image"))),
    )
    parts = [shots.select(F.explode(F.array_compact(own)).alias("t")).select("t.*", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("wrong"))]
    parts.append(tagged(media, "image", F.col("image"), ROWS))
    parts.append(tagged(annotations, "part", F.col("file"), ROWS, F.when(F.trim(F.coalesce("line", F.lit(""))) != "", 1).otherwise(0)))
    parts.append(tagged(videos, "video", F.coalesce(F.trim(F.col("video_id").cast("string")), F.lit("")), PLANNED))
    parts.append(tagged(maps, "video", F.col("video_id"), ROWS, wrong=F.when(F.col("n").eqNullSafe(F.col("line")), 0).otherwise(1)))
    parts.append(tagged(vectors, "video", F.col("video_id"), VECTORS))
    parts += [tagged(event_maps, "event", F.col("name"), ROWS), tagged(event_vectors, "event", F.col("name"), VECTORS)]
    n = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    return reduce(DataFrame.unionByName, parts).groupBy("space", "key").agg(
        F.bit_or("side").alias("mask"), n(PLANNED).alias("planned"), n(ROWS).alias("rows"), n(VECTORS).alias("vectors"), F.sum("wrong").alias("wrong")
    )


def _missing() -> dict[str, Column]:
    """What is missing, by the keys' spaces and masks."""
    space, mask = F.col("space"), F.col("mask")
    video = (space == "video") & (mask.bitwiseAND(PLANNED) > 0) & (F.col("key") != "")
    return {
        "missing_media": (space == "image") & (mask == PLANNED), "missing_map_files": video & (mask.bitwiseAND(ROWS) == 0),
        "missing_feature_files": video & (mask == PLANNED + ROWS), "missing_event_feature_files": (space == "event") & (mask == ROWS),
    }


def preflight_metrics(present: DataFrame) -> DataFrame:
    """Eighteen metrics in one row. Maps count for planned videos that have both a map and vectors; parity is of event rows."""
    space, gone = F.col("space"), _missing()
    total = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
    count = lambda c: F.count(F.when(c, 1))
    both = (space == "video") & (F.col("mask") == PLANNED + ROWS + VECTORS) & (F.col("key") != "")
    event = space == "event"
    whole = {
        "per_video_rows": total(space == "video", "planned"), "shot_rows": total(space == "shot_row", "planned"), "saved_keyframe_rows": total(space == "image", "planned"),
        "unique_shots": count(space == "shot"), "unique_keyframes": count(space == "frame"), "media_files": total(space == "image", "rows"),
        "missing_media_count": total(gone["missing_media"], "planned"), "annotations_rows": total(space == "part", "rows"), "annotations_files_count": count(space == "part"),
        "map_rows_total": total(both, "rows"), "vector_rows_total": total(both, "vectors"), "map_n_sequential_mismatch_rows": total(both, "wrong"),
        "missing_map_files_count": total(gone["missing_map_files"], "planned"), "missing_feature_files_count": total(gone["missing_feature_files"], "planned"),
        "event_mapping_rows": total(event & (F.col("rows") > 0), "rows"), "event_embedding_rows": total(event & (F.col("rows") > 0), "vectors"),
        "missing_event_feature_files_count": count(gone["missing_event_feature_files"]),
    }
    row = present.agg(*(x.cast("long").alias(n) for n, x in whole.items()))
    return row.withColumn("event_embedding_parity", F.col("event_mapping_rows") == F.col("event_embedding_rows"))


def preflight_samples(present: DataFrame, most: int = 20) -> DataFrame:
    """what and key of the first missing ones of each kind, in order of the key."""
    kinds = reduce(lambda x, n: x.when(_missing()[n], n), _missing(), F)
    w = Window.partitionBy("what").orderBy("key")
    return present.select(kinds.alias("what"), "key").where("what is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


# The quality gate

#: What a broken rule means; others than these don't stop a run.
FATAL = ("missing_result", "error_row", "no_rows", "profile", "unsaved", "duplicate_keyframe", "bad_integer", "duplicate_frame", "outside_shot")


def outside_intervals(points: DataFrame, intervals: DataFrame, by: str, at: str, start: str, end: str) -> DataFrame:
    """points that lie in no interval of their group: behind the furthest end of the intervals that began before them or there.

    Both sides are one sorted pass over their union; no point meets an interval row. Points without a place are left out.
    """
    name = [c for c in points.columns if c not in (by, at)]
    p = points.where(F.col(at).isNotNull()).select(by, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), F.struct(*name).alias("_row"))
    i = intervals.where(F.col(start) <= F.col(end)).groupBy(by, start).agg(F.max(end).cast("long").alias("_end"))
    i = i.select(by, F.col(start).alias("_at"), F.lit(0).alias("_kind"), "_end", F.lit(None).cast(p.schema["_row"].dataType).alias("_row"))
    reach = F.max("_end").over(Window.partitionBy(by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    out = p.unionByName(i).withColumn("_reach", reach).where("_kind = 1 and coalesce(_reach < _at, true)")
    return out.select(by, F.col("_at").alias(at), "_row.*")


def quality_violations(planned: DataFrame, shots: DataFrame, errors: DataFrame, profile: str, intervals: DataFrame | None = None) -> DataFrame:
    """rule, video_id and row_id of everything the gate objects to.

    planned: video_id. errors: video_id. shots: row_id, video_id, keyframe_id, profile_version, saved, frame_idx, shot_start,
    shot_end, the last five as text. Of rows that repeat a keyframe or a frame all but the first are told. A frame is held against
    its own row's shot, or against all `intervals` (video_id, start, end) of its video where these are given.
    """
    frame, start, end = (F.col(c).try_cast("long") for c in ("frame_idx", "shot_start", "shot_end"))
    d = shots.withColumns({"_frame": frame, "_start": start, "_end": end})
    d = d.withColumn("_whole", F.col("_frame").isNotNull() & F.col("_start").isNotNull() & F.col("_end").isNotNull())
    key = F.row_number().over(Window.partitionBy("keyframe_id").orderBy("row_id"))
    place = F.row_number().over(Window.partitionBy("video_id", "_frame", "_whole").orderBy("row_id"))
    d = d.withColumns({"_key": key, "_place": place})
    rules = {
        "profile": ~F.col("profile_version").eqNullSafe(F.lit(profile)), "unsaved": ~F.coalesce(F.lower("saved").isin("true", "1"), F.lit(False)),
        "duplicate_keyframe": F.col("_key") > 1, "bad_integer": ~F.col("_whole"), "duplicate_frame": F.col("_whole") & (F.col("_place") > 1),
    }
    if intervals is None:
        rules["outside_shot"] = F.col("_whole") & ~F.col("_frame").between(F.col("_start"), F.col("_end"))
    found = violations(d, ["video_id", "row_id"], rules)
    if intervals is not None:
        lone = outside_intervals(d.where("_whole").select("video_id", "_frame", "row_id"), intervals, "video_id", "_frame", "start", "end")
        found = found.unionByName(lone.select("video_id", "row_id", F.lit("outside_shot").alias("rule")))
    none = F.lit(None).cast(dict(shots.dtypes)["row_id"]).alias("row_id")
    done = shots.select("video_id").unionByName(errors.select("video_id")).where("video_id is not null").distinct()
    missing = planned.select("video_id").distinct().join(done, "video_id", "left_anti").select("video_id", none, F.lit("missing_result").alias("rule"))
    failed = errors.select("video_id", none, F.lit("error_row").alias("rule"))
    empty = shots.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast(dict(shots.dtypes)["video_id"]).alias("video_id"), none, F.lit("no_rows").alias("rule"))
    return found.unionByName(missing).unionByName(failed).unionByName(empty).select("rule", "video_id", "row_id")


def quality_verdict(planned: DataFrame, shots: DataFrame, errors: DataFrame, found: DataFrame, fatal: tuple[str, ...] = FATAL) -> DataFrame:
    """One row: passed, the numbers of failures and warnings, each rule's number, and counts of videos, rows and keyframes."""
    tag = lambda df, what, key: df.select(F.lit(what).alias("what"), key.cast("string").alias("key"))
    every = tag(planned, "planned", F.col("video_id")).unionByName(tag(shots.where("video_id is not null"), "succeeded", F.col("video_id")))
    every = every.unionByName(tag(errors.where("video_id is not null"), "failed", F.col("video_id"))).unionByName(tag(shots, "keyframe", F.col("keyframe_id")))
    every = every.unionByName(tag(found, "rule", F.col("rule")))
    one = every.groupBy("what", "key").agg(F.count(F.lit(1)).alias("n"))
    of = lambda what: F.count(F.when(F.col("what") == what, 1))
    rule = (F.col("what") == "rule") & F.col("key").isin(*fatal)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    row = one.agg(
        total(rule).alias("failures"), total((F.col("what") == "rule") & ~F.col("key").isin(*fatal)).alias("warnings"),
        *(total((F.col("what") == "rule") & (F.col("key") == r)).alias(r) for r in FATAL),
        of("planned").alias("planned_videos"), of("succeeded").alias("succeeded_videos"), of("failed").alias("failed_videos"), total(F.col("what") == "keyframe").alias("shot_rows"), of("keyframe").alias("unique_keyframes"),
    )
    return row.select((F.col("failures") == 0).alias("passed"), "*")


# Promotion of index versions


def review_manifests(actual: DataFrame, expected: DataFrame, required: tuple[str, ...] = ("ocr", "asr", "caption")) -> DataFrame:
    """Both: version, metric, key, rows; metric `documents` has the whole number, `source` one row a source.

    Per version of either side: documents, how many counts differ, how many required sources have no rows, and the verdict:
    ok, or the first of not_reviewed, gone, changed, empty, no_coverage.
    """
    named = lambda df: df.select(F.concat_ws("\u0001", F.col("version").cast("string"), "metric").alias("metric"), "key", "rows")
    both = compare_manifests(named(actual), named(expected)).withColumns({"version": F.split_part("metric", F.lit("\u0001"), F.lit(1)), "metric": F.split_part("metric", F.lit("\u0001"), F.lit(2))})
    have = (F.col("metric") == "source") & (F.col("actual") > 0)
    g = both.groupBy("version").agg(
        F.coalesce(F.max(F.when(F.col("metric") == "documents", F.col("actual"))), F.lit(0)).alias("documents"), F.count(F.when(~F.col("equal"), 1)).alias("different"),
        (F.lit(len(required)) - F.sum(F.when(have & F.col("key").isin(*required), 1).otherwise(0))).alias("uncovered"), F.count("expected").alias("_asked"), F.count("actual").alias("_there"),
    )
    verdict = (
        F.when(F.col("_asked") == 0, "not_reviewed").when(F.col("_there") == 0, "gone").when(F.col("different") > 0, "changed").when(F.col("documents") <= 0, "empty")
        .when(F.col("uncovered") > 0, "no_coverage").otherwise("ok")
    )
    return g.select("version", "documents", "different", F.col("uncovered").cast("long").alias("uncovered"), verdict.alias("verdict"))


def decide_promotions(pointers: DataFrame, requests: DataFrame, reviews: DataFrame) -> DataFrame:
    """What becomes of each request to move an alias to another version: request_id, alias, version, decision.

    pointers: alias, version, previous. requests: request_id, alias, action (promote or rollback), version, expected (what the
    requester saw the alias at; null: nothing). It is a compare-and-set: a request whose `expected` isn't the alias's present
    version is stale, and of several that aren't, the one of the smallest request_id moves the alias and makes the
    others stale. A rollback goes to the previous version. The target must have passed its review; an alias may not be the name of a version.
    """
    names = reviews.select(F.col("version").alias("alias")).unionByName(requests.select("version").where("version is not null").toDF("alias")).distinct()
    p = pointers.select("alias", F.col("version").alias("_now"), F.col("previous").alias("_back"))
    d = requests.join(p, "alias", "left").join(names.withColumn("_name", F.lit(True)), "alias", "left")
    d = d.withColumn("version", F.when(F.col("action") == "rollback", F.col("_back")).otherwise(F.col("version")))
    d = d.join(reviews.select("version", "verdict"), "version", "left")
    decision = (
        F.when(F.col("_name"), "alias_is_version").when(~F.col("_now").eqNullSafe(F.col("expected")), "stale").when(F.col("version").isNull(), "nothing_before")
        .when(F.coalesce("verdict", F.lit("not_reviewed")) != "ok", F.coalesce("verdict", F.lit("not_reviewed"))).otherwise("apply")
    )
    d = d.withColumn("decision", decision)
    first = d.where("decision = 'apply'").groupBy("alias").agg(F.min("request_id").alias("_first"))
    d = d.join(first, "alias", "left")
    late = (F.col("decision") == "apply") & (F.col("request_id") != F.col("_first"))
    return d.select("request_id", "alias", "action", "version", F.when(late, "stale").otherwise(F.col("decision")).alias("decision"))


def move_pointers(pointers: DataFrame, decisions: DataFrame) -> DataFrame:
    """The pointers after the requests that apply: alias, version, previous."""
    moved = decisions.where("decision = 'apply'").select("alias", F.col("version").alias("_to"))
    j = pointers.join(moved, "alias", "full")
    return j.select("alias", F.coalesce("_to", "version").alias("version"), F.when(F.col("_to").isNotNull(), F.col("version")).otherwise(F.col("previous")).alias("previous"))
