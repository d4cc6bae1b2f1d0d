"""Operator 9: byte-level BPE by a pair occurrence index, encoding and decoding.

A partition's distinct pieces lie behind each other in one array of symbols. An index maps each pair of
neighbouring symbols that has a rank to all its positions. Ranks are applied in ascending order, each to all its
positions at once, and the lists of the pairs that appear are extended. A merge never makes a pair of lower rank,
as its symbol first exists then, so one pass over the active ranks is what BPE does to every piece.

Defined results: a null or empty text has no tokens; strings of special tokens are tokens, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumenreel.llm.chunks import ChunkCoder, byte_letters
from lumenreel.llm.common import as_documents, slices

#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHIFT = np.int64(32)


class PairIndexBpe:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab = told["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = (left << _SHIFT) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first_symbol = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = (a << _SHIFT) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_of[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece (a run that the pre-tokenizer doesn't cut)."""
        if not pieces:
            return []
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        symbol = self.first_symbol[data]
        symbol[ends] = -1  # a wall between pieces
        n = len(symbol)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(positions: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks >= 0
            positions, ranks = positions[keep], ranks[keep]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, own in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(own)

        add(np.arange(n - 1), self.ranks(symbol[:-1], symbol[1:]))
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            at = at[symbol[at] == a]
            at = at[symbol[after[at]] == b]
            if not len(at):
                continue
            if a == b:  # in a run of equal symbols every other position merges, from the left
                follows = np.concatenate(([False], after[at[:-1]] == at[1:]))
                run = np.flatnonzero(~follows)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            gone = after[at]
            symbol[at] = self.made[r]
            symbol[gone] = -2
            nxt = after[gone]
            after[at] = nxt
            inside = nxt < n
            before[nxt[inside]] = at[inside]
            prior = before[at]
            has = prior >= 0
            add(prior[has], self.ranks(symbol[prior[has]], symbol[at[has]]))
            add(at[inside], self.ranks(symbol[at[inside]], symbol[nxt[inside]]))
        left = symbol >= 0
        ids = symbol[left].astype(np.uint32)
        counts = np.concatenate(([0], np.cumsum(left)))[ends]
        return np.split(ids, counts[:-1])

    def encode_chunks(self, chunks: list[bytes]) -> list[np.ndarray]:
        pieces = [self.pattern.findall(c.decode()) for c in chunks]
        distinct = list(dict.fromkeys(p for own in pieces for p in own))
        ids = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct]), strict=True))
        return [ids[own[0]] if len(own) == 1 else np.concatenate([ids[p] for p in own]) if own else np.zeros(0, np.uint32) for own in pieces]

    def encode_whole(self, text: str) -> np.ndarray:
        """For texts that hold strings of special tokens."""
        parts = self.split_special.split(text) if self.split_special else [text]
        out = [np.array([self.special[p]], np.uint32) if p in self.special else self.encode_chunks([p.encode()])[0] for p in parts if p]
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[str, tuple[PairIndexBpe, ChunkCoder]] = {}


def coder(path: str) -> tuple[PairIndexBpe, ChunkCoder]:
    if path not in _loaded:
        bpe = PairIndexBpe(path)
        _loaded[path] = bpe, ChunkCoder(bpe.encode_chunks, bpe.encode_whole, True, tuple(s.lower().encode() for s in bpe.special) + tuple(s.encode() for s in bpe.special))
    return _loaded[path]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array of int) of every document. Null texts have no ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, chunk_coder = coder(vocabulary)
        for part in slices(batches):
            ids = chunk_coder.ids(part.column("text").to_pylist())
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    return as_documents(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text from doc_id and ids. Null ids give an empty text; bytes that aren't UTF-8 become U+FFFD."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = coder(vocabulary)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes and decodes each document in one pass: doc_id, n_tokens, and SHA-256 of its ids and of its decoded text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, chunk_coder = coder(vocabulary)
        number = [str(i) for i in range(len(bpe.bytes_of))]
        for part in slices(batches):
            ids = [x.tolist() for x in chunk_coder.ids(part.column("text").to_pylist())]
            joined = [",".join(map(number.__getitem__, x)).encode() for x in ids]
            decoded = [b"".join(map(bpe.bytes_of.__getitem__, x)).decode("utf-8", "replace").encode() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return as_documents(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
