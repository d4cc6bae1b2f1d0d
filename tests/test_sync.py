"""Copies of related tables: order, normal forms, new keys, rejected rows, and running again."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lumenreel.operators import sync
from lumenreel.operators.sync import Table

TABLES = {
    "frame": Table("frame_id", parents={"video_id": "video"}, times=("seen",), order="part"),
    "video": Table("video_id", natural=(("code",), ("name", "version")), json={"extra": "{}"}, booleans=("here",), prefix="name"),
}
VIDEO, FRAME = "video_id long, code string, name string, version int, extra string, here {}", "frame_id string, video_id long, seen {}"


def tables(spark, videos, frames, there=(), frames_there=()):
    source = {"video": spark.createDataFrame(videos, VIDEO.format("string")), "frame": spark.createDataFrame(frames, FRAME.format("string") + ", part int")}
    target = {"video": spark.createDataFrame(there, VIDEO.format("boolean")), "frame": spark.createDataFrame(frames_there, FRAME.format("timestamp"))}
    return source, target


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_order_of_tables():
    assert sync.table_order(TABLES) == ["video", "frame"]
    with pytest.raises(ValueError, match="circle"):
        sync.table_order({"a": Table("k", parents={"b": "b"}), "b": Table("k", parents={"a": "a"})})


def test_keys_follow_the_target(spark):
    videos = [(1, "c1", "L21_a", 1, '{"b": 1}', "YES"), (2, "c2", "L21_b", 2, "{", "no"), (3, "zz", "L22_c", 3, None, None), (4, "c4", "L22_d", 4, " ", "1"), (None, "c5", "L21_e", 5, "[]", "t")]
    there = [(3, "c1", "old", 9, "{}", False), (9, "yy", "L22_c", 3, "{}", False), (50, "c50", "kept", 1, "{}", True)]
    frames = [("f1", 1, "2024-01-02T03:04:05Z", 1), ("f2", 3, "soon", 1), ("f3", 77, None, 1), ("f4", None, "2024-01-02", 1), ("f2", 3, "2024-05-06 00:00:00", 2)]
    got = sync.sync_tables(*tables(spark, videos, frames, there), TABLES)
    # 1 is the target's 3 by its code, 3 is 9 by name and version; 2 and 4 keep their numbers.
    assert rows(got.tables["video"], "video_id", "name", "extra", "here", "state") == sorted(
        [(3, "L21_a", '{"b":1}', True, "updated"), (2, "L21_b", "{}", False, "inserted"), (9, "L22_c", "{}", False, "updated"), (4, "L22_d", "{}", True, "inserted"), (50, "kept", "{}", True, "kept")], key=str
    )
    utc = lambda *x: datetime.datetime(*x)
    assert rows(got.tables["frame"], "frame_id", "video_id", "seen") == [("f1", 3, utc(2024, 1, 2, 3, 4, 5)), ("f2", 9, utc(2024, 5, 6)), ("f4", None, utc(2024, 1, 2))]
    assert rows(got.rejected, "table_name", "row_key", "reason") == sorted([("frame", "f3", "no_parent:video_id"), ("video", None, "no_key")], key=str)
    assert rows(got.counts, "table_name", "source_rows", "rejected", "inserted", "updated", "kept") == [("frame", 5, 1, 3, 0, 0), ("video", 5, 1, 2, 2, 1)]


def test_taken_numbers_are_moved_and_a_second_run_changes_nothing(spark):
    videos = [(0, "a", "L21", 1, "{}", "1"), (5, "b", "L21", 2, "{}", "0")]
    there = [(0, "other", "x", 1, "{}", True), (5, "another", "y", 1, "{}", True)]
    frames = [("f", 0, None, 1), ("g", 5, None, 1)]
    source, target = tables(spark, videos, frames, there)
    first = sync.sync_tables(source, target, TABLES).tables
    assert rows(first["video"], "video_id", "code") == sorted([(0, "other"), (5, "another"), (6, "a"), (11, "b")], key=str)
    assert rows(first["frame"], "frame_id", "video_id") == [("f", 6), ("g", 11)]
    again = sync.sync_tables(source, {k: d.drop("state") for k, d in first.items()}, TABLES)
    for name in TABLES:
        assert rows(again.tables[name].drop("state"), "*") == rows(first[name].drop("state"), "*")
    assert rows(again.counts, "table_name", "inserted") == [("frame", 0), ("video", 0)]


def test_prefixes_and_insert_only(spark):
    videos = [(1, "a", "L21_1", 1, "{}", "1"), (2, "b", "l22_2", 2, "{}", "1"), (3, "c", "L30_3", 3, "{}", "1")]
    there = [(1, "a", "old", 9, "{}", False)]
    got = sync.sync_tables(*tables(spark, videos, [("f", 3, None, 1)], there), TABLES, prefixes=("L21", "L22"), insert_only=True)
    assert rows(got.tables["video"], "video_id", "name", "state") == [(1, "old", "kept"), (2, "l22_2", "inserted")]
    assert rows(got.rejected, "row_key") == [("f",)]


def test_text_keys_that_are_taken_are_rejected(spark):
    one = {"t": Table("k", natural=(("n",),))}
    source, target = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, n string"), spark.createDataFrame([("a", "other")], "k string, n string")
    got = sync.sync_tables({"t": source}, {"t": target}, one)
    assert rows(got.rejected, "row_key", "reason") == [("a", "key_taken")] and rows(got.tables["t"], "k", "state") == [("a", "kept"), ("b", "inserted")]


def test_empty_tables(spark):
    got = sync.sync_tables(*tables(spark, [], []), TABLES)
    assert got.tables["frame"].count() == got.tables["video"].count() == got.rejected.count() == 0


def test_normal_forms(spark):
    df = spark.createDataFrame([('{"a": [1,  2]}',), ("nope",), ("",), (None,), ("3",)], "x string")
    assert [r[0] for r in df.select(sync.as_json(F.col("x"), "[]")).collect()] == ['{"a":[1,2]}', "[]", "[]", "[]", "3"]
    df = spark.createDataFrame([(" On ",), ("0",), (None,), ("y",)], "x string")
    assert [r[0] for r in df.select(sync.as_boolean(F.col("x"))).collect()] == [True, False, False, True]
