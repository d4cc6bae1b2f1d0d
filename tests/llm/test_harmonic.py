"""Harmonic packing against a plain cut, and round trips of its sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenreel.llm import harmonic
from tests.llm.test_tokens import BYTE


def plain_cut(n: int, capacity: int, least: int) -> list[int]:
    out, rest = [capacity] * (n // capacity), n % capacity
    for k in range(capacity.bit_length() - 2, -1, -1):
        if 1 << k >= least and rest >> k & 1:
            out.append(1 << k)
    low = rest % least
    if low and rest >= least:
        out[-1] += low
    elif low:
        out.append(low)
    return out


@given(st.lists(st.integers(1, 400), max_size=30), st.sampled_from([16, 64, 128]), st.sampled_from([1, 4, 16]))
@settings(max_examples=150, deadline=None)
def test_cut_and_bins(tokens, capacity, least):
    tokens = np.array(tokens, np.int64)
    docs, starts, lengths = harmonic.cut_points(tokens, capacity, least)
    want = [(d, n) for d, t in enumerate(tokens.tolist()) for n in plain_cut(t, capacity, least)]
    assert list(zip(docs.tolist(), lengths.tolist(), strict=True)) == want
    assert all(starts[k] == (0 if not k or docs[k] != docs[k - 1] else starts[k - 1] + lengths[k - 1]) for k in range(len(docs)))
    bins, placed = harmonic.Bins(capacity), []
    for a in range(0, len(lengths), 7):  # in several batches
        size, number, offset = bins.place(lengths[a : a + 7])
        placed += zip(size.tolist(), number.tolist(), offset.tolist(), lengths[a : a + 7].tolist(), strict=True)
    own = defaultdict(list)
    for size, number, offset, n in placed:
        assert size == capacity // n
        own[size, number].append((offset, n))
    for (size, number), pieces in own.items():
        assert len(pieces) == size or number == bins.count[size] // size and len(pieces) == bins.count[size] % size
        ends = np.cumsum([n for _, n in pieces])
        assert [a for a, _ in pieces] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity


def test_unfit_capacities():
    for capacity, least in ((1000, 1), (64, 3), (16, 32)):
        with pytest.raises(ValueError):
            harmonic.cut_points(np.array([5]), capacity, least)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, length int, _bin string, offset string").repartition(3, "doc_id")


def ids_of(texts):
    tokenizer = Tokenizer.from_file(BYTE)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def check(pieces, ids, capacity):
    """Every id in one piece, sequences gapless and within the capacity; gives tokens and padded length in all."""
    own, places = defaultdict(list), defaultdict(list)
    for r in pieces:
        own[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for d, rows in own.items():
        want = ids[d]
        assert all(r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes()) for r in rows)
    tokens = padded = 0
    for pieces_of in places.values():
        pieces_of.sort()
        ends = np.cumsum([n for _, n in pieces_of])
        assert [a for a, _ in pieces_of] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
        n = int(ends[-1])
        tokens, padded = tokens + n, padded + (n if n & (n - 1) == 0 else capacity)
    return tokens, padded


def test_pack_documents(spark):
    texts = [None, "", "a", "word " * 4000, "tail é  \n\n x", *(f"Document {k} " + "the and of " * (k * 7 % 90) for k in range(120))]
    rows = [(k, t, 1, "x", "y") for k, t in enumerate(texts)]
    ids = dict(enumerate(ids_of(texts)))
    got = harmonic.pack_documents(table(spark, rows), BYTE).collect()
    assert check(got, ids, 1024) == (sum(map(len, ids.values())),) * 2  # no padding at all
    per = defaultdict(list)
    for r in got:
        per[r.doc_id].append((r.start, r.length))
    assert {d: [n for _, n in sorted(x)] for d, x in per.items()} == {d: plain_cut(len(x), 1024, 1) for d, x in ids.items()}
    # Longer pieces cost some padding, but nothing is lost.
    got = harmonic.pack_documents(table(spark, rows), BYTE, capacity=256, least=32).collect()
    tokens, padded = check(got, ids, 256)
    assert tokens == sum(map(len, ids.values())) and padded >= tokens
    lengths = harmonic.sequence_lengths(spark.createDataFrame(got), 256).agg(F.sum("n_tokens"), F.sum("padded")).first()
    assert tuple(lengths) == (tokens, padded)


def test_repeated_rows_and_empty_table(spark):
    rows = [(7, "the same text", 1, "", "")] * 5 + [(None, "no id", 1, "", "")]
    got = harmonic.pack_documents(table(spark, rows), BYTE).collect()
    own, lone = ids_of(["the same text", "no id"])
    assert sum(r.length for r in got if r.doc_id == 7) == 5 * len(own) and sum(r.length for r in got if r.doc_id is None) == len(lone)
    assert harmonic.pack_documents(table(spark, []), BYTE).count() == 0


def test_sequences(spark):
    texts = ["the and of " * (k * 13 % 200) + str(k) for k in range(60)]
    docs = table(spark, [(k, t, 1, "", "") for k, t in enumerate(texts)])
    got = harmonic.packed_sequences(docs, BYTE, capacity=128, least=8, pad_id=50256).collect()
    assert all(len(r.ids) in {128, *(1 << k for k in range(8))} and set(r.ids[r.n_tokens :]) <= {50256} for r in got)
    every = sorted(x for r in got for x in r.ids[: r.n_tokens])
    assert every == sorted(x for ids in ids_of(texts) for x in ids)
