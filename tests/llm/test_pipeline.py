"""The pipeline's stages and its whole run, on the small tables and on odd ones."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from lumenreel.llm import quality, secrets, shingle_join, toxicity
from tests.conftest import SMALL
from tests.llm.test_shingle_join import brute
from tests.llm.test_tokens import WORD

PACKED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SMALL).cache()
        seen[name] = (docs, out)
        if name != p.STAGES[-1][0]:
            assert out.columns == columns and out.join(docs, "doc_id", "left_anti").count() == 0
            docs = out
    before, after = seen["shingle_jaccard_join"]
    found = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(found.values()))
    before, after = seen["secret_scans"]
    dirty = secrets.scan_documents(before).where(F.col("spans") != "").select("doc_id")
    assert before.join(after, ["doc_id", "text"], "left_anti").count() == dirty.count()
    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def plain_run(spark, docs, labels):
    """What the pipeline keeps, with plain Python in place of its stages; only fitted models and found spans are the library's."""
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int") if labels else spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(df, marks)
    docs = [d for d, s in zip(docs, model.score([t for _, t in docs]), strict=True) if s >= 0.3]
    model = toxicity.train(spark.createDataFrame(docs, df.schema), marks)
    if model.trees.trees:
        docs = [d for d, s in zip(docs, model.score([t for _, t in docs]), strict=True) if s < 0.5]
    smallest = {component for _, component in brute(sorted(docs)).values()}
    docs = [d for d in docs if d[0] in smallest]
    found = {r.doc_id: r.spans for r in secrets.scan_documents(spark.createDataFrame(docs, df.schema)).collect()}
    return {d: secrets.masked(t, found[d], "[secret]") if found[d] else t for d, t in docs}


def check_packed(rows, kept):
    """Every id of every kept text in one piece, pieces of at most 2048, and sequences without gaps."""
    tokenizer, own, places = Tokenizer.from_file(WORD), {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(own) == set(kept)
    for d, pieces in own.items():
        ids = [*tokenizer.encode(kept[d] or "", add_special_tokens=False).ids, 0]
        pieces.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, a, min(2048, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 2048))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces)
    for at in places.values():
        ends = np.cumsum([n for _, n in sorted(at)])
        assert [a for a, _ in sorted(at)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_run_equals_a_plain_version(spark):
    rows = p.run(spark, SMALL)
    assert rows.columns == PACKED
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    check_packed(rows.collect(), plain_run(spark, docs, labels))


A = "a clean text about rivers and bridges with words enough to be told from any other one"
ROWS = [
    (1, A, "s"), (2, A + " ", "s"), (3, None, "s"), (4, "", None), (5, "password = hunter2hunter2", "s"), (None, "no id but a text of its own", "s"), (6, "word " * 30_000, "s"), (6, "word " * 30_000, "s"), (7, " \n ", "s"),
]
DOCS = "doc_id long, text string, source string, lang string, n_chars long, _key string, _text int"


def tables(spark, folder, rows, labels):
    df = spark.createDataFrame([(i, t, s, "en", len(t or ""), f"k{i}", 7) for i, t, s in rows], DOCS)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0), (5, 1, 0)], [(None, None, None), (1, None, 1)]])
def test_odd_rows_and_missing_labels_lose_nothing(spark, tmp_path, labels):
    """Without labels of both kinds nothing is rejected; nulls, blanks, repeats and clashing columns go through."""
    rows = p.run(spark, tables(spark, tmp_path, ROWS, labels)).collect()
    assert {r.doc_id for r in rows} == {1, 3, 4, 5, 6, 7, None}
    ids = Tokenizer.from_file(WORD).encode("word " * 30_000, add_special_tokens=False).ids
    assert sum(r.length for r in rows if r.doc_id == 6) == len(ids) + 1  # one of the two
    masked = Tokenizer.from_file(WORD).encode("[secret]", add_special_tokens=False).ids
    assert [r.length for r in rows if r.doc_id == 5] == [len(masked) + 1]


def test_empty_tables(spark, tmp_path):
    assert p.run(spark, tables(spark, tmp_path, [], [])).collect() == []


def test_stages_keep_extra_columns(spark, tmp_path):
    folder = tables(spark, tmp_path, ROWS, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert [f.simpleString() for f in docs.schema.fields] == [x.replace(" ", ":").replace("long", "bigint") for x in DOCS.split(", ")]
        assert all(r["_key"] == f"k{r.doc_id}" and r["_text"] == 7 for r in docs.collect())
