"""Annotations taken in as a stream: any order, restarts, replays and snapshots give the merge of one batch."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest

from lumenreel.operators import aggregates as a
from lumenreel.streaming import ingest


def rows(seed, n=60):
    r = random.Random(seed)
    return [
        {
            "keyframe_id": f"k{r.randrange(6)}", "row_id": i, "caption": r.choice([None, " ", f"caption {i}"]), "labels": r.choices(["car", "dog", "sign", "tree"], k=r.randrange(4)),
            "counts": {x: r.randrange(9) for x in r.sample(["car", "dog", "sign"], r.randrange(3))}, "embedding": r.choice([None, [float(i), 0.5]]),
        }
        for i in range(n)
    ]


def plain(every):
    """The surveyed merge, row by row."""
    out: dict = {}
    for x in sorted(every, key=lambda x: x["row_id"]):
        caption, labels, counts, embedding = out.get(x["keyframe_id"], (None, [], {}, None))
        caption = x["caption"] if (x["caption"] or "").strip() else caption
        labels = labels + [y for k, y in enumerate(x["labels"]) if y not in labels and y not in x["labels"][:k]]
        counts = counts | {k: max(n, counts.get(k, 0)) for k, n in x["counts"].items()}
        out[x["keyframe_id"]] = caption, labels, counts, x["embedding"] or embedding
    return out


def found(df):
    return {r.keyframe_id: (r.caption, r.labels, r.counts or {}, r.embedding) for r in df.collect()}


def put(folder: Path, name: str, part) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(x) + "\n" for x in part))


@pytest.mark.parametrize("seed", range(3))
def test_parts_in_any_order(spark, tmp_path, seed):
    every = rows(seed)
    random.Random(seed).shuffle(every)
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    for k in range(6):
        put(source, f"{k}.json", every[k::6])
        if k % 2:
            ingest.ingest_annotations(spark, str(source), target, checkpoint, files_per_trigger=1, compact_after=2).awaitTermination()
            assert found(ingest.merged_annotations(spark, target)) == plain([x for j in range(k + 1) for x in every[j::6]])
    # Snapshots hold what they replace, and old folders are gone.
    names = {p.name for p in Path(target).iterdir()}
    assert names == {"batch=4", "batch=5", "upto=3", "upto=5"}
    ingest.ingest_annotations(spark, str(source), target, checkpoint, compact_after=2).awaitTermination()  # nothing new
    assert {p.name for p in Path(target).iterdir()} == names


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    every = rows(9)
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), tmp_path / "ck"
    for k in range(4):
        put(source, f"{k}.json", every[k::4])
    ingest.ingest_annotations(spark, str(source), target, str(checkpoint), files_per_trigger=1, compact_after=2).awaitTermination()
    want = found(ingest.merged_annotations(spark, target))
    assert want == plain(every)
    for name in ("3", ".3.crc"):  # the last batch did its work, but its commit was lost
        (checkpoint / "commits" / name).unlink()
    put(source, "again.json", every[:7])  # and parts are sent once more
    ingest.ingest_annotations(spark, str(source), target, str(checkpoint), files_per_trigger=1, compact_after=2).awaitTermination()
    assert found(ingest.merged_annotations(spark, target)) == want


def test_a_half_written_folder_does_not_count(spark, tmp_path):
    every = rows(4)
    source, target, checkpoint = tmp_path / "in", tmp_path / "out", str(tmp_path / "ck")
    put(source, "0.json", every)
    ingest.ingest_annotations(spark, str(source), str(target), checkpoint).awaitTermination()
    (target / "upto=7").mkdir()
    (target / "upto=7" / "part-0.parquet").write_bytes(b"PAR1")
    assert found(ingest.merged_annotations(spark, str(target))) == plain(every)


def test_nothing_taken_in_yet(spark, tmp_path):
    assert ingest.merged_annotations(spark, str(tmp_path / "none")).count() == 0


def test_states_merge_like_sets(spark):
    every = rows(11)
    df = spark.createDataFrame(every, ingest.PART)
    states = a.annotation_states(df)
    twice = a.merge_states(states.unionByName(states))
    assert sorted(map(str, twice.collect())) == sorted(map(str, states.collect()))
    assert found(a.annotations_of(states)) == plain(every)
    empty = spark.createDataFrame([{"keyframe_id": "k", "row_id": 1}, {"keyframe_id": None, "row_id": 2, "caption": "x"}], ingest.PART)
    assert found(a.annotations_of(a.annotation_states(empty))) == {"k": (None, [], {}, None)}
