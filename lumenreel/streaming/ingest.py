"""Incremental ingest of annotation parts that arrive over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenreel.operators import aggregates as a


def ingest_stream(spark: SparkSession, source: str, schema: str, key: str, order: str, target: str, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """Each part file under `source` (JSON lines) is taken in once; per key the row of largest `order` stays.

    A micro-batch is appended to `target` in a folder of its own number, so a batch that is run again after a failure
    overwrites only itself; `current` gives the table. There is no watermark: state is the target.
    """

    def take(batch: DataFrame, number: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _stream(spark, source, schema, checkpoint, files_per_trigger, take)


def _stream(spark: SparkSession, source: str, schema: str, checkpoint: str, files_per_trigger: int, take: Callable[[DataFrame, int], None]) -> StreamingQuery:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(source)
    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def current(spark: SparkSession, target: str, key: str, order: str) -> DataFrame:
    return latest(spark.read.parquet(target), key, order).drop("batch")


# Annotations: their merge is a maximum or a minimum in every part, so it takes parts in any order and any number of times.

PART = "keyframe_id string, row_id long, caption string, labels array<string>, counts map<string,int>, embedding array<double>"


def ingest_annotations(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = PART, files_per_trigger: int = 100, compact_after: int = 16, parts: int = 8
) -> StreamingQuery:
    """Each part file of annotations under `source` (JSON lines) is taken in once and merged; `merged_annotations` is the table.

    A micro-batch leaves its merged state in target/batch=<number>. Every `compact_after` batches all states up to then are
    merged into target/upto=<number>, in `parts` files, so a reader meets one snapshot and at most that many batches. A
    folder counts when it has been committed whole. Folders that a snapshot holds are removed one snapshot later; a
    batch that runs again after a failure writes the same folders again, and merging a state twice changes nothing.
    """

    def take(batch: DataFrame, number: int) -> None:
        a.annotation_states(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if (number + 1) % compact_after == 0:
            have = _folders(spark, target)
            a.merge_states(_states(spark, target, have, number)).repartition(parts, "keyframe_id").write.mode("overwrite").parquet(f"{target}/upto={number}")
            _remove_before(spark, target, have, max((n for n in have["upto"] if n < number), default=-1))

    return _stream(spark, source, schema, checkpoint, files_per_trigger, take)


def merged_annotations(spark: SparkSession, target: str) -> DataFrame:
    """keyframe_id, caption, labels, counts and embedding of all parts taken in so far."""
    return a.annotations_of(a.merge_states(_states(spark, target, _folders(spark, target))))


def _folders(spark: SparkSession, target: str) -> dict[str, list[int]]:
    """The numbers of the committed folders, by kind. One listing on the driver, of as many names as there are folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {"batch": [], "upto": []}
    if files.exists(path):
        for status in files.listStatus(path):
            kind, _, number = status.getPath().getName().partition("=")
            if kind in out and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out[kind].append(int(number))
    return out


def _states(spark: SparkSession, target: str, have: dict[str, list[int]], last: int | None = None) -> DataFrame:
    """The last snapshot (before `last`) and the batches behind it (to `last`)."""
    base = max((n for n in have["upto"] if last is None or n < last), default=-1)
    paths = [f"{target}/upto={base}"] * (base >= 0) + [f"{target}/batch={n}" for n in sorted(have["batch"]) if n > base and (last is None or n <= last)]
    return spark.read.schema(a.STATE).parquet(*paths) if paths else spark.createDataFrame([], a.STATE)


def _remove_before(spark: SparkSession, target: str, have: dict[str, list[int]], number: int) -> None:
    """Removes what the snapshot of that number holds, but not itself: readers that started before the newest one still use it."""
    files = spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f"batch={n}" for n in have["batch"] if n <= number] + [f"upto={n}" for n in have["upto"] if n < number]
    for name in old:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}"), True)
