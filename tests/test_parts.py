"""Tasks that don't grow with the table: rows dealt over parts by their number, few sources sent to where rows are read."""

from __future__ import annotations

from lumenreel.operators import sync
from lumenreel.plans import records, upkeep
from lumenreel.plans import views as v
from lumenreel.sources import files
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_annotations_are_dealt_by_their_number(spark, monkeypatch):
    rows = v.table(spark, SMALL, "events").count()
    few = {tuple(map(str, r)) for r in records.a04_merge_annotations(spark, SMALL).collect()}
    monkeypatch.setattr(records, "ANNOTATED_ROWS", rows // 9)
    many = records.a04_merge_annotations(spark, SMALL)
    assert "REPARTITION_BY_NUM" in plan(many)
    assert {tuple(map(str, r)) for r in many.collect()} == few


def test_few_sources_are_sent_to_the_rows(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        target = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "k int, source string")
        updates = spark.createDataFrame([(7, "b"), (8, "d")], "k int, source string")
        found = files.replace_by_source(target, updates, "source")
        assert "BroadcastHashJoin" in plan(found)
        expected = {(1, "a"), (3, None), (4, "c"), (7, "b"), (8, "d")}
        assert {tuple(r[c] for c in ("k", "source")) for r in found.collect()} == expected
        monkeypatch.setattr(files, "SOURCES", 1)
        by_shuffle = files.replace_by_source(target, updates, "source")
        assert "BroadcastHashJoin" not in plan(by_shuffle)
        assert {tuple(r[c] for c in ("k", "source")) for r in by_shuffle.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_copied_tables_are_dealt_by_their_number(spark, monkeypatch):
    few = {tuple(r) for r in upkeep.s20_sync_counts(spark, SMALL).collect()}
    monkeypatch.setattr(sync, "PART_ROWS", 100, raising=False)
    many = upkeep.s20_sync_counts(spark, SMALL)
    assert "REPARTITION_BY_NUM" in plan(many)
    assert {tuple(r) for r in many.collect()} == few
