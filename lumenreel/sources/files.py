"""Readers and writers of manifests, annotations, transcripts, vectors, submissions and ground truth."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BOM = "﻿"


def _first_of(df: DataFrame, names: list[str], kind: str) -> Column:
    """The first of the alternative columns that isn't blank, cast without errors."""
    have = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have).try_cast(kind) if have else F.lit(None).cast(kind)


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    """CSV shot manifests with header; alternative column names, a byte-order mark and bad numbers are tolerated.

    A row that names no video takes it from the video's file name, else from the folder of its image.
    """
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.replace(_BOM, "").strip() for c in raw.columns))
    whole = lambda names: _first_of(raw, names, "double").cast("long")
    parts = F.split(_first_of(raw, ["image_path", "image_rel_path", "image_name", "image_storage_key", "image_uri"], "string"), "/")
    name = F.regexp_replace(F.element_at(F.split(_first_of(raw, ["video_name"], "string"), "/"), -1), r"(?<=.)\.[^.]*$", "")
    video = F.coalesce(_first_of(raw, ["video_id", "video"], "string"), name, F.get(parts, F.size(parts) - 2))
    return raw.select(
        video.alias("video_id"), whole(["shot_start_frame", "start_frame"]).alias("start_frame"), whole(["shot_end_frame", "end_frame"]).alias("end_frame"),
        whole(["frame_idx", "frame"]).alias("frame_idx"), F.element_at(parts, -1).alias("image_name"), _first_of(raw, ["fps"], "double").alias("fps"),
    )


def read_map_keyframes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One CSV for each video (n, pts_time, fps, frame_idx); the video is the file's name. Good rows, and failed ones."""
    raw = spark.read.schema("n string, pts_time string, fps string, frame_idx string").option("header", True).csv(path, recursiveFileLookup=True)
    row = raw.select(
        F.regexp_replace("_metadata.file_name", r"\.csv$", "").alias("video_id"), F.col("n").try_cast("long").alias("n"), F.col("pts_time").try_cast("double").alias("seconds"),
        F.col("fps").try_cast("double").alias("fps"), F.col("frame_idx").try_cast("double").cast("long").alias("frame_idx"),
    )
    good = F.col("n").isNotNull() & F.col("frame_idx").isNotNull()
    return row.where(good), row.where(~good).withColumn("reason", F.lit("n or frame_idx is no number"))


ANNOTATION = "keyframe_id string, video_id string, caption string, texts array<string>, objects array<string>, object_counts map<string,int>, detections array<struct<label:string,confidence:double>>"


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines; lines that can't be parsed come back as text in the second table."""
    raw = spark.read.text(path)
    row = raw.select("value", F.from_json("value", ANNOTATION + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).where(F.trim("value") != "")
    return row.where("r._bad is null").select("r.*").drop("_bad"), row.where("r._bad is not null").select("value")


def transcript_segments(videos: DataFrame) -> DataFrame:
    """videos: video_id, segments (array of segment_id, start_seconds, end_seconds, text, raw_text). One row a segment.

    The first text that isn't blank counts, segments without any are left out, and an end before the start is the start.
    """
    s = videos.select("video_id", F.explode("segments").alias("s")).select("video_id", "s.*")
    text = F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("text", "raw_text") if c in s.columns))
    return s.select("video_id", "segment_id", "start_seconds", F.greatest("start_seconds", "end_seconds").alias("end_seconds"), text.alias("text")).where("text is not null")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Two-dimensional .npy arrays, one for each video: video_id, index, embedding. Other shapes give no rows."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in frames:
            for name, content in zip(files["path"], files["content"], strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.ndim == 2:
                    yield pd.DataFrame({"video_id": name.rsplit("/", 1)[-1].removesuffix(".npy"), "index": np.arange(len(x)), "embedding": list(x.astype(np.float32))})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(parse, "video_id string, index long, embedding array<float>")


def vector_matrices(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vectors: video_id, index, embedding. The rows of videos whose vectors make a matrix, and the other videos with a reason.

    A matrix has no missing vector, one length above zero, and each index from 0 to one less than its rows once.
    """
    size = F.coalesce(F.size("embedding"), F.lit(0))
    shape = vectors.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min(size).alias("least"), F.max(size).alias("most"), F.countDistinct("index").alias("places"), F.min("index").alias("first"), F.max("index").alias("last")
    )
    places = (F.col("places") != F.col("rows")) | (F.col("first") != 0) | (F.col("last") != F.col("rows") - 1)
    reason = F.when(F.col("least") < 1, "vector missing").when(F.col("least") != F.col("most"), "lengths differ").when(F.coalesce(places, F.lit(True)), "index gaps")
    judged = shape.select("video_id", "rows", reason.alias("reason"))
    return vectors.join(judged.where("reason is null").select("video_id"), "video_id", "left_semi"), judged.where("reason is not null")


def list_objects(spark: SparkSession, path: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Names, sizes and times of all files below path; contents aren't read. Filters are patterns on the lower-case key."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("object_key"), F.col("length").alias("size"), F.col("modificationTime").alias("updated"))
    return describe_objects(found, include, exclude)


def describe_objects(objects: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Adds extension, depth and parent to object_key and keeps what the patterns allow."""
    key, name = F.col("object_key"), F.element_at(F.split("object_key", "/"), -1)
    d = objects.withColumns({"extension": F.regexp_extract(F.lower(name), r"\.([^.]+)$", 1), "depth": F.size(F.split(key, "/")), "parent": F.regexp_extract(key, r"^(.*)/[^/]*$", 1)})
    if include:
        d = d.where(F.lower(key).rlike(include))
    return d.where(~F.lower(key).rlike(exclude)) if exclude else d


def parse_object_key(objects: DataFrame) -> DataFrame:
    """key=value folders as a map, the parent folder, the number in the name, and the kind of frame (default key)."""
    key, name = F.col("object_key"), F.element_at(F.split("object_key", "/"), -1)
    pairs = F.filter(F.split(key, "/"), lambda p: p.contains("="))
    kind = F.regexp_extract(F.lower(name), r"(first|middle|last)", 1)
    return objects.withColumns(
        {
            "partitions": F.when(F.size(pairs) > 0, F.str_to_map(F.array_join(pairs, ";"), F.lit(";"), F.lit("="))),
            "folder": F.regexp_extract(key, r"([^/]+)/[^/]*$", 1), "number": F.regexp_extract(name, r"(\d+)", 1).try_cast("long"), "kind": F.when(kind == "", "key").otherwise(kind),
        }
    )


def build_manifest(rows: DataFrame, group: str, within: str, order: list[str]) -> DataFrame:
    """Adds global_index in order of group, within and `order`: a running count of groups plus the place within one.

    No window holds more than the rows of one `within`, or one count for each of them.
    """
    place = F.row_number().over(Window.partitionBy(group, within).orderBy(*order))
    sizes = rows.groupBy(group, within).agg(F.count(F.lit(1)).alias("_size"))
    totals = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_total"))
    before_group = totals.select(group, (F.sum("_total").over(Window.orderBy(group)) - F.col("_total")).alias("_before_group"))  # one row a group
    before = sizes.select(group, within, (F.sum("_size").over(Window.partitionBy(group).orderBy(within)) - F.col("_size")).alias("_before"))
    d = rows.withColumn("_place", place).join(before, [group, within]).join(before_group, group)
    return d.withColumn("global_index", F.col("_before_group") + F.col("_before") + F.col("_place") - 1).drop("_place", "_before", "_before_group")


def shards(manifest: DataFrame, size: int) -> DataFrame:
    if size < 1:
        raise ValueError("a shard holds one row at least")
    i = F.col("global_index")
    return manifest.withColumns({"shard_index": F.floor(i / size), "local_index": i % size})


def write_shards(manifest: DataFrame, size: int, path: str, together: int = 100) -> None:
    """Folders of `together` shards each (shard_group), one file in each, whose rows name their shard and lie in order.

    A group's rows meet in one task before they are written, so files grow with the rows, not with tasks times shards.
    """
    rows = shards(manifest, size).withColumn("shard_group", F.floor(F.col("shard_index") / together))
    rows.repartition("shard_group").sortWithinPartitions("shard_group", "shard_index", "local_index").write.partitionBy("shard_group").json(path)


def latest_successful_run(objects: DataFrame, data_name: str = "data.csv") -> DataFrame:
    """objects: batch, run, name, updated. The newest run of each batch that has both _SUCCESS and the data file."""
    runs = objects.groupBy("batch", "run").agg(F.max((F.col("name") == "_SUCCESS").cast("int")).alias("done"), F.max((F.col("name") == data_name).cast("int")).alias("data"), F.max("updated").alias("updated"))
    return runs.where("done = 1 and data = 1").groupBy("batch").agg(F.max_by("run", F.struct("updated", "run")).alias("run"))


#: Fields of a pointer document that name annotation files: fixed values of its format.
_POINTER_FIELDS = ("annotations_uri", "recommended_import_annotations_uri", "gcs_annotations")
_POINTER_LISTS = ("artifacts", "import_artifacts")
_ITEM_FIELDS = ("uri", "annotations_uri", "gcs_annotations")


def artifact_paths(pointers: DataFrame) -> DataFrame:
    """pointers: value, a JSON document that names parts under one of several fields, in `outputs`, or in lists of texts
    or objects. Distinct paths of .jsonl files.

    Nested values are read as text first, so that one of another kind than expected hides nothing beside it. Values
    that are no JSON object name nothing.
    """
    names = (*_POINTER_FIELDS, "outputs", *_POINTER_LISTS)
    doc = pointers.select(F.from_json("value", ", ".join(f"{n} string" for n in names)).alias("d"))
    nested = F.from_json("d.outputs", "gcs_annotations string")["gcs_annotations"]
    found = F.array(*(F.col(f"d.{n}") for n in _POINTER_FIELDS), nested)
    for name in _POINTER_LISTS:
        items = F.when(F.col(f"d.{name}").startswith("["), F.from_json(f"d.{name}", "array<string>"))
        objects = F.transform(items, lambda x: F.when(x.startswith("{"), F.from_json(x, ", ".join(f"{n} string" for n in _ITEM_FIELDS))))
        own = F.flatten(F.transform(objects, lambda o: F.array(*(o[n] for n in _ITEM_FIELDS))))
        found = F.concat(found, *(F.coalesce(c, F.array().cast("array<string>")) for c in (items, own)))
    return doc.select(F.explode(F.transform(found, lambda x: F.trim(x))).alias("path")).where(F.col("path").endswith(".jsonl") & ~F.col("path").startswith("{")).distinct()


def _csv_cell(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)


def submission_lines(rows: DataFrame) -> DataFrame:
    """rows: query_name, query_type, rank, video_code, frame_indices, answer. The CSV line of each row."""
    cells = F.concat(F.array(_csv_cell(F.col("video_code"))), F.transform("frame_indices", lambda f: f.cast("string")), F.when(F.col("query_type") == "QA", F.array(_csv_cell(F.coalesce("answer", F.lit(""))))).otherwise(F.array().cast("array<string>")))
    return rows.select("query_name", "rank", F.array_join(cells, ",").alias("line"))


def write_submissions(rows: DataFrame, path: str) -> None:
    """One folder of text for each query (at most 100 rows), lines in order of rank. Names that aren't safe are left out;
    the checks report them."""
    lines = submission_lines(rows).where(F.col("query_name").rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,119}$"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    whole = lines.groupBy("query_name").agg(F.array_join(ordered, "\n").alias("value"))
    whole.write.partitionBy("query_name").text(path)


#: A cell of a CSV line: quoted, with doubled quotes inside, or plain; and the comma before it.
_CELL = r'(?:^|,)(?:"((?:[^"]|"")*)"|([^",]*))'


def _cells(line: Column) -> Column:
    """The cells of one CSV line, without their quotes."""
    quoted, plain = (F.regexp_extract_all(line, F.lit(_CELL), F.lit(k)) for k in (1, 2))
    return F.zip_with(quoted, plain, lambda q, p: F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(p))


def _records(text: Column) -> Column:
    """The lines of a CSV text; a line feed inside quotes ends none, as it comes behind an odd number of quotes."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")

    def step(state: Column, part: Column) -> Column:
        open_ = F.pmod(F.length(state["last"]) - F.length(F.replace(state["last"], F.lit('"'), F.lit(""))), F.lit(2)) == 1
        longer = F.concat(state["last"], F.lit("\n"), part)
        done = F.when(open_, state["done"]).otherwise(F.concat(state["done"], F.array(state["last"])))
        return F.struct(done.alias("done"), F.when(open_, longer).otherwise(part).alias("last"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.element_at(parts, 1).alias("last"))
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda s: F.concat(s["done"], F.array(s["last"])))


def read_submissions(spark: SparkSession, path: str, kinds: DataFrame | None = None) -> DataFrame:
    """query_name, rank (record number; blank ones count but give no row), video, frames and answer.

    kinds: query_name, query_type. A QA record has one frame and then its answer, blank where it is missing; all
    others have frames only and no answer. Queries whose kind isn't told are QA if their name says so. A frame that
    is no whole number is null, so that the checks see it.
    """
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", r"query_name=([^/]+)/", 1)
    lines = whole.select(name.alias("query_name"), F.posexplode(_records(F.col("value"))).alias("i", "line")).where(F.trim("line") != "")
    if kinds is None:
        lines = lines.withColumn("query_type", F.when(F.lower("query_name").rlike("(^|[-_0-9])qa([-_0-9]|$)"), "QA"))
    else:
        lines = lines.join(kinds.select("query_name", "query_type"), "query_name", "left")
    d = lines.withColumns({"cells": _cells(F.col("line")), "qa": F.coalesce(F.col("query_type") == "QA", F.lit(False))})
    frames = F.transform(F.slice("cells", F.lit(2), F.when(F.col("qa"), 1).otherwise(F.size("cells"))), lambda x: F.trim(x).try_cast("long"))
    answer = F.when(F.col("qa"), F.coalesce(F.get("cells", F.lit(2)), F.lit("")))
    return d.select("query_name", (F.col("i") + 1).alias("rank"), F.get("cells", F.lit(0)).alias("video_code"), frames.alias("frame_indices"), answer.alias("answer"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """CSV with answers over several lines: query_id, kind, target (from 1), video and frame of each target.

    The query is in `query_id` or `original query id`. Its targets are the video,frame pairs of `answer`, or the one of
    `gt video id` and `gt frame id`; without any it is one row with nulls. The kind is `task type`, else what the id
    says. A file without these columns is an error.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*(c.replace(_BOM, "").strip().lower() for c in raw.columns))
    one = {"gt video id", "gt frame id"} <= set(raw.columns)
    if not {"query_id", "original query id"} & set(raw.columns) or not (one or "answer" in raw.columns):
        raise ValueError(f"no query or no targets among the columns {raw.columns}")
    query = _first_of(raw, ["query_id", "original query id"], "string")
    answer = F.concat_ws(",", "gt video id", "gt frame id") if one else F.col("answer")
    pair = lambda k: F.regexp_extract_all(answer, F.lit(r"([A-Za-z0-9_]+)\s*,\s*(\d+)"), F.lit(k))
    kind = F.upper(F.coalesce(_first_of(raw, ["task type"], "string"), F.regexp_extract(F.lower(query), r"(kis|qa|trake)", 1)))
    each = raw.select(query.alias("query_id"), kind.alias("kind"), F.posexplode_outer(F.arrays_zip(pair(1).alias("video"), pair(2).alias("frame"))).alias("i", "t"))
    return each.select("query_id", "kind", (F.col("i") + 1).alias("target"), F.upper("t.video").alias("video"), F.col("t.frame").cast("long").alias("frame"))


def publish(current: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of both; for each key the current one. Rows without key all stay."""
    both = current.withColumn("_new", F.lit(1)).unionByName(existing.withColumn("_new", F.lit(0)))
    best = both.where(F.col(key).isNotNull()).withColumn("_n", F.max("_new").over(Window.partitionBy(key))).where("_new = _n")
    return best.drop("_n", "_new").unionByName(both.where(F.col(key).isNull()).drop("_new"))


def upsert(target: DataFrame, updates: DataFrame, key: str, order: str, insert_only: bool = False) -> DataFrame:
    """The target with updates put in; of several updates of a key the last by `order` counts. Adds state: kept, updated, inserted."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = updates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", order)
    t, u = target.alias("t"), last.withColumn("_u", F.lit(1)).alias("u")
    j = t.withColumn("_t", F.lit(1)).alias("t").join(u, key, "full")
    old = F.col("_t").isNotNull() & (F.lit(insert_only) | F.col("_u").isNull())
    values = [F.when(old, F.col(f"t.{c}")).otherwise(F.col(f"u.{c}")).alias(c) for c in target.columns if c != key]
    state = F.when(F.col("_t").isNull(), "inserted").when(old, "kept").otherwise("updated")
    return j.select(key, *values, state.alias("state"))


#: Names of sources that are sent to all tasks; more are joined by a shuffle.
SOURCES = 100_000


def replace_by_source(target: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """All rows of the sources that the updates have are replaced. Few sources go to the target's rows where these are
    read, as a source that holds a share of all rows would else meet in one task."""
    given = updates.select(column).distinct()
    given = F.broadcast(given) if given.limit(SOURCES + 1).count() <= SOURCES else given
    return target.join(given, column, "left_anti").unionByName(updates.select(target.columns))


def text_records(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """frames: keyframe_id, video_id, and texts (array) or text; segments: segment_id, video_id, text. Of texts, those that
    aren't blank are joined, and a frame without any has no record; a text stands as it is, blank or null. Blank segments have none."""
    if "texts" in frames.columns:
        joined = F.concat_ws(" ", F.filter(F.transform("texts", lambda t: F.trim(t)), lambda t: t != ""))
        frames = frames.withColumn("text", joined).where("text <> ''")
    f = frames.select(F.concat(F.lit("frame:"), "keyframe_id").alias("id"), F.col("video_id").cast("string").alias("video_id"), F.lit("frame").alias("doc_type"), "text")
    s = segments.select(F.concat(F.lit("segment:"), "video_id", F.lit(":"), "segment_id").alias("id"), F.col("video_id").cast("string").alias("video_id"), F.lit("transcript").alias("doc_type"), F.trim("text").alias("text"))
    return f.unionByName(s.where("text <> ''"))


def persist_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("run_id").parquet(path)


def load_run(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    """Only the run's own partition is read."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def mark_selected(results: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    mark = chosen.select(key).distinct().withColumn("selected", F.lit(True))
    return results.join(mark, key, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
