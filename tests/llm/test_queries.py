"""The registered queries of the numbered operators, by name, on the smallest tables."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenreel.llm import queries
from tests.conftest import SMALL
from tests.llm.test_harmonic import check
from tests.llm.test_shingle_join import brute
from tests.llm.test_tokens import BYTE, WORD

COLUMNS = {
    "op1_shingle_join": "doc_id n_shingles component_id", "op2_private_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op3_nearest": "query_id rank vec_id score",
    "op4_vector_links": "vec_id n_links component_id kept", "op5_token_files": "doc_id start n_tokens ids_crc32", "op6_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op8_quality": "doc_id held_out score predicted", "op9_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op10_toxicity": "doc_id held_out score predicted",
    "op11_harmonic_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, texts, name):
    df = queries.queries()[name](spark, SMALL)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    rows = df.collect()
    if "doc_id" in df.columns and name not in ("op6_packing", "op11_harmonic_packing"):
        assert sorted(r.doc_id for r in rows) == sorted(texts)
    if name == "op1_shingle_join":
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(sorted(texts.items()))
    elif name == "op5_token_files":
        ids = {i: [*e.ids, 0] for i, e in zip(texts, Tokenizer.from_file(BYTE).encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
        start = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
            start += r.n_tokens
    elif name == "op6_packing":
        ids = {i: [*e.ids, 0] for i, e in zip(texts, Tokenizer.from_file(WORD).encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in rows)
        places: dict = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in places.values():
            ends = np.cumsum([n for _, n in sorted(own)])
            assert [a for a, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
        assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    elif name == "op11_harmonic_packing":
        ids = {i: [*e.ids, 0] for i, e in zip(texts, Tokenizer.from_file(BYTE).encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
        tokens, padded = check(rows, ids, 1024)
        assert tokens == padded == sum(map(len, ids.values()))
    elif name in ("op8_quality", "op10_toxicity"):
        least = 0.3 if name == "op8_quality" else 0.5
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= least) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    df, want = queries.queries()[name](spark, SMALL), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
