"""Which labelled documents models are fitted on."""

from __future__ import annotations

import zlib

from lumenreel.llm.common import training_labels


def test_repeated_rows_dont_pass_the_bound(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(3000)] + [(k, "other") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), *((k, k % 2) for k in range(2, 40)), (None, 1), (50, 7)], "doc_id long, toxic int")
    got = training_labels(docs, labels, "toxic", 1000).collect()
    used = {k for k in range(1, 40) if zlib.crc32(str(k).encode()) % 5}
    assert {r.doc_id for r in got} == used and len(got) == len(used)
    if 1 in used:
        assert [(r.text, r.label) for r in got if r.doc_id == 1] == [("text 0", 1)]
    assert len(training_labels(docs, labels, "toxic", 5).collect()) <= 10
