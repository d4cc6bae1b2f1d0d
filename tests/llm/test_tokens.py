"""Token files, packing and BPE against the tokenizers library, exact round trips and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenreel.llm import bpe, chunks, packing, token_files
from lumenreel.llm.chunks import library_coder
from lumenreel.llm.common import scratch_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  a", " a ", "a  b", "a\n b", "a \nb", "x\x1c y", "it's  <|endoftext|> foo<|endoftext|>", "foo <|endoftext|>bar", "\0 a \0b", "don't 's", "á ́b", "Σ ΟΔΟΣ A", "日本 語 12 3", "\x85 a", "a\t b",
    "a  b", "a  b", "　a　 b", "a\n\nb", "\na", "é.\nÈ", "a.b.c!?d", "A̸ ≮ b", "end…. b", "<|ENDOFTEXT|>", "aaaa aaaaa" * 3, "abababab", "!!!!!!!!", "-" * 77, "x" * 3000, "ab " * 5000,
]
SCHEMA = "doc_id long, text string, ids string"


def noise(n=400, seed=3):
    rng = random.Random(seed)
    parts = [*" \n\t .,'|abAé日 　%1", "<|endoftext|>", "'s", "  ", "aa", "́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + noise(60)
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(3, "", "x"), (9, "  a", "x")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def library(path, texts):
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("path", "blanks"), [(BYTE, True), (WORD, False)])
def test_chunks_give_the_library_ids(path, blanks):
    texts = ODD + noise()
    assert [x.tolist() for x in library_coder(path, blanks).ids(texts)] == library(path, texts)


def thue_morse(n=1024):
    """Two different words that are equal to any polynomial hash of 64 bits."""
    one = "a"
    while len(one) < n:
        one += one.translate({97: "b", 98: "a"})
    return [one, one.translate({97: "b", 98: "a"})]


@pytest.mark.parametrize("odd", [0, 97])
def test_unlike_chunks_with_equal_hashes(monkeypatch, odd):
    """With few hash values nearly all chunks share one with others: bytes are compared, so ids stay right."""
    if odd:
        real = chunks.run_hashes
        monkeypatch.setattr(chunks, "run_hashes", lambda *a: real(*a) % np.uint64(odd))
    texts = [*thue_morse(), *ODD, *noise(80)]
    for path, blanks in ((BYTE, True), (WORD, False)):
        coder = library_coder(path, blanks)
        coder._clear()
        assert [x.tolist() for t in (texts[:40], texts[40:], texts) for x in coder.ids(t)] == library(path, texts + texts)
        coder._clear()
    coder = bpe.coder(BYTE)[1]
    coder._clear()
    assert [x.tolist() for x in coder.ids(texts)] == library(BYTE, texts)
    coder._clear()


def test_pair_index_gives_the_library_ids():
    texts = ODD + noise()
    model, coder = bpe.coder(BYTE)
    ids = coder.ids(texts)
    assert [x.tolist() for x in ids] == library(BYTE, texts)
    t = Tokenizer.from_file(BYTE)
    assert [model.decode(x) for x in ids] == [t.decode(x.tolist(), skip_special_tokens=False) for x in ids]
    broken = [[128], [5, 255, 300], []]
    assert [model.decode(np.array(x, int)) for x in broken] == [t.decode(x, skip_special_tokens=False) for x in broken]


def test_round_trip(docs):
    rows, df = docs
    got = sorted(tuple(r) for r in bpe.round_trip(df, BYTE).collect())
    want = sorted((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t, _), x in zip(rows, library(BYTE, [r[1] for r in rows]), strict=True))
    assert got == want
    back = bpe.decode_documents(bpe.encode_documents(df, BYTE), BYTE)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t or "") for i, t, _ in rows)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    rng = np.random.default_rng(1)
    for top in (1, 2, 255, 70_000, 2**32 - 1):
        ids = rng.integers(0, top, 1000, dtype=np.uint64).astype(np.uint32)
        assert (token_files.from_planes(token_files.to_planes(ids, kind), 1000, kind) == ids).all()
    assert token_files.to_planes(np.zeros(5, np.uint32), kind) == []


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_token_files(spark, docs, block):
    rows, df = docs
    path = scratch_path(spark, "test-tokens")
    token_files.write_token_files(df, BYTE, path, block=block)
    got = sorted(tuple(r) for r in token_files.document_digests(spark, path).collect())
    ids = {}
    for (i, _, _), x in zip(rows, library(BYTE, [r[1] for r in rows]), strict=True):
        ids.setdefault(i, []).append(np.array([*x, 0], "<u4"))
    want, start = [], 0
    for i in sorted(ids):
        for x in ids[i]:
            want.append((i, start, len(x), zlib.crc32(x.tobytes())))
            start += len(x)
    assert got == sorted(want)
    index = token_files.chunk_index(spark, path).collect()
    assert sum(r.n_ids for r in index) == start and sorted(r.first_id for r in index)[0] == 0
    pieces = token_files.read_token_files(spark, path).orderBy("shard", "block", "at").collect()
    assert sum((list(p.ids) for p in pieces if p.doc_id == 6), []) == ids[6][0].tolist()


def test_crc_of_joined_runs():
    rng = random.Random(0)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(300)), rng.randbytes(rng.randrange(300))
        assert token_files.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_plan_places_every_piece_once():
    rng = random.Random(0)
    for capacity in (1, 7, 100, 2048):
        for _ in range(30):
            counts = {}
            for _ in range(rng.randrange(1, 400)):
                n = min(capacity, max(1, int(rng.expovariate(3 / capacity))))
                counts[n] = counts.get(n, 0) + rng.randrange(1, 5)
            plan = packing.plan_sequences(counts, capacity)
            seen = {}
            for pattern, times in plan:
                assert sum(pattern) <= capacity and times > 0
                assert sum(3 * n > capacity for n in pattern) <= 2
                for n in pattern:
                    seen[n] = seen.get(n, 0) + times
            assert seen == counts
            bins, total = sum(t for _, t in plan), sum(n * c for n, c in counts.items())
            assert bins <= 1.3 * -(-total // capacity) + 2


def test_packing(docs):
    rows, df = docs
    got = packing.pack_documents(df, WORD, capacity=64).collect()
    want = {}
    for (i, _, _), x in zip(rows, library(WORD, [r[1] for r in rows]), strict=True):
        x = np.array([*x, 0], "<u4")
        for k, a in enumerate(range(0, len(x), 64)):
            want.setdefault((i, k), []).append((a, min(64, len(x) - a), zlib.crc32(x[a : a + 64].tobytes())))
    have, place = {}, {}
    for r in got:
        have.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for spots in place.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 64
    whole = packing.packed_sequences(df.where("doc_id not in (3, 9)"), WORD, capacity=64).collect()
    assert sum(len(r.ids) for r in whole) == sum(n for k, v in want.items() if k[0] not in (3, 9) for _, n, _ in v) and max(len(r.ids) for r in whole) <= 64


def test_empty_tables(spark, docs):
    none = docs[1].limit(0)
    path = scratch_path(spark, "test-none")
    token_files.write_token_files(none, BYTE, path)
    assert token_files.document_digests(spark, path).count() == 0
    assert packing.pack_documents(none, WORD).count() == 0 and bpe.round_trip(none, BYTE).count() == 0
