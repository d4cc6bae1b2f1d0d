"""Writes into stored tables that touch only the partitions concerned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.sources.files import upsert
from lumenreel.sources.scratch import shared_path


def replace_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """The partitions that rows have become these rows; all others keep their files. Nothing of the table is read."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert_partitions(spark: SparkSession, path: str, updates: DataFrame, key: str, partition: str, order: str, insert_only: bool = False) -> DataFrame:
    """Puts updates into the table at path (Parquet by `partition`): partition, state (kept, updated, inserted) and rows of what was written.

    updates: the table's columns and `order`; of several updates of a key the last one counts. Only partitions that hold a
    key of the updates, or get one, are read and written: their values are the only rows the driver sees. The new rows are
    stored before the first old file goes, so a job that fails can be run again; a partition all of whose keys moved
    away is removed. Rows without key are left out.
    """
    table = spark.read.parquet(path)
    updates = updates.where(F.col(key).isNotNull()).withColumn(partition, F.col(partition).cast(dict(table.dtypes)[partition]))
    holding = table.select(key, partition).join(updates.select(key).distinct(), key, "left_semi").select(partition)
    touched = [r[0] for r in holding.unionByName(updates.select(partition)).distinct().collect()]
    values = [x for x in touched if x is not None]
    concerned = F.col(partition).isin(values) if values else F.lit(False)
    old = table.where(concerned | F.col(partition).isNull() if None in touched else concerned)
    staged = shared_path(spark, "upsert")
    upsert(old, updates, key, order, insert_only).write.parquet(staged)
    new = spark.read.parquet(staged)
    emptied = old.select(partition, F.regexp_extract("_metadata.file_path", "^(.*)/[^/]+$", 1).alias("folder")).distinct()
    have = new.select(F.col(partition).alias("_have")).distinct()
    gone = [r["folder"] for r in emptied.join(have, F.col(partition).eqNullSafe(F.col("_have")), "left_anti").collect()]
    replace_partitions(new.select(table.columns), path, partition)
    for folder in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark.catalog.refreshByPath(path)
    return new.groupBy(partition, "state").agg(F.count(F.lit(1)).alias("rows"))
