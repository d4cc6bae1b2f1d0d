"""How many Python workers the stages of the pipeline hold at a time."""

from __future__ import annotations

from lumenreel.llm import secrets, shingle_join


def test_an_empty_ledger_starts_no_python_workers(spark, tmp_path):
    empty = secrets.read_ledger(spark, str(tmp_path / "none"))
    assert empty.count() == 0
    assert empty.dtypes == [tuple(f.split()) if not f.endswith("long") else (f.split()[0], "bigint") for f in secrets.FINDINGS.split(", ")]
    assert "ExistingRDD" not in empty._jdf.queryExecution().toString()


def test_links_are_contracted_in_tasks_of_their_own(spark, monkeypatch):
    seen, components = [], shingle_join.components
    monkeypatch.setattr(shingle_join, "components", lambda links: seen.append(links._jdf.queryExecution().toString()) or components(links))
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = spark.createDataFrame([(1, base), (2, base + " more"), (3, base + " else"), (4, "another text of its own here")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in shingle_join.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}
    assert seen and not any("MapInArrow" in plan for plan in seen)
