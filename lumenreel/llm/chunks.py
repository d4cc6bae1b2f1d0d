"""Tokenising whole texts by way of their distinct chunks.

A text is cut where neither byte-level nor word-level BPE can join characters: before a single blank between two
characters that aren't white space, around such a line feed, and between an ASCII letter and the punctuation
behind it. The ids of a text are then the ids of its chunks in order. Chunks are found and hashed (64 bits) with
numpy over whole slices; each distinct one is encoded once in a task. Equal hashes only propose a known chunk: its
bytes are compared, and a text with a chunk whose bytes differ is encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np

from lumenreel.llm.common import BLOCK_PAD, LOWER, byte_blocks, run_hashes

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if b != 39 and not chr(b).isalnum()]] = True
#: Lead bytes of the characters among which all other white space lies.
_LEAD3 = np.zeros(256, bool)
_LEAD3[[0xE1, 0xE2, 0xE3]] = True
_LEAD = _LEAD3.copy()
_LEAD[0xC2] = True
_GAP = b"\n\n\n"


class ChunkCoder:
    """Ids of texts, by a table of distinct chunks that is emptied when it would pass `most` entries.

    encode_chunks: gets distinct chunks (bytes of UTF-8), gives a list or array of ids for each.
    blanks: whether white space belongs to chunks (byte-level BPE) or vanishes, as does the case of A-Z (word BPE).
    whole: encodes one whole text; used for texts that contain one of `special`, the strings of special tokens, and
    for texts with a chunk that has the hash of another one.
    """

    def __init__(self, encode_chunks: Callable, whole: Callable, blanks: bool = True, special: tuple[bytes, ...] = (), most: int = 2_000_000):
        self.encode_chunks, self.whole, self.blanks, self.special, self.most = encode_chunks, whole, blanks, special, most
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, _U)
        self.place = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.offset = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        #: The bytes of the known chunks as blocks, by place.
        self.blocks = np.zeros(1 << 12, _U)
        self.first_block = np.zeros(0, np.int64)
        self.bytes = np.zeros(0, np.int64)
        self.n_blocks = 0

    def spans(self, raw: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """All bytes; start and end of each chunk in them; the number of chunks of each text."""
        joined = _GAP + _GAP.join(raw) + _GAP
        if not self.blanks:
            joined = joined.translate(LOWER)
        data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        text_ends = np.cumsum(sizes + len(_GAP))
        text_starts = text_ends - sizes
        white = _WHITE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = _LETTER[data[:-1]] & _PUNCTUATION[data[1:]]
        if self.blanks:
            at = np.flatnonzero((data == 32) | (data == 10))
            at = at[(at >= 3) & (at < len(data) - 1)]
            left, right = data[at - 1], data[at + 1]
            solid = ~white[at - 1] & ~white[at + 1] & ~_LEAD[right]
            solid &= (left < 128) | ~((data[at - 2] == 0xC2) | _LEAD3[data[at - 3]])
            at = at[solid]
            cut[at] = True
            cut[at[data[at] == 10] + 1] = True
            cut[text_starts] = True
            gaps = (text_ends[:, None] + np.arange(len(_GAP))).ravel()
            cut[gaps] = False
            cut[: len(_GAP)] = False
            full = sizes > 0
            cut[text_starts[~full]] = False
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], 0)
            first = np.searchsorted(starts, text_starts)
            last = np.append(first[1:], len(starts)) - 1
            ends[last[full]] = text_ends[full]
        else:
            white = _BLANK[data]
            solid = ~white
            cut[1:-1] &= solid[1:] & solid[:-1]
            begins = solid.copy()
            begins[1:] &= white[:-1] | cut[1:-1]
            starts = np.flatnonzero(begins)
            stops = solid.copy()
            stops[:-1] &= white[1:] | cut[1:-1]
            ends = np.flatnonzero(stops) + 1
        counts = np.searchsorted(starts, text_ends) - np.searchsorted(starts, text_starts)
        return joined, starts, ends, counts

    def lookup(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all chunks in order, the number of chunks of each text, and which chunks only share another's hash."""
        joined, starts, ends, counts = self.spans(raw)
        data = np.frombuffer(joined + b"\n" * BLOCK_PAD, np.uint8)
        lengths = ends - starts
        blocks, first_block, number = byte_blocks(data, starts, ends)
        distinct, first, back = np.unique(run_hashes(blocks, first_block, number, lengths), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        have = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        have[inside] = self.known[at[inside]] == distinct[inside]
        if not have.all():
            if len(self.known) + (~have).sum() > self.most:
                self._clear()
                have[:] = False
            new = first[~have]
            places = self._learn([joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            per = np.diff(np.append(first_block, len(blocks)))[new]
            before = np.cumsum(per) - per
            own = blocks[np.repeat(first_block[new] - before, per) + np.arange(int(per.sum()))]
            while self.n_blocks + len(own) > len(self.blocks):
                self.blocks = np.concatenate((self.blocks, np.zeros_like(self.blocks)))
            self.blocks[self.n_blocks : self.n_blocks + len(own)] = own
            self.first_block = np.concatenate((self.first_block, self.n_blocks + before))
            self.bytes = np.concatenate((self.bytes, lengths[new]))
            self.n_blocks += len(own)
            spot = np.searchsorted(self.known, distinct[~have])
            self.known = np.insert(self.known, spot, distinct[~have])
            self.place = np.insert(self.place, spot, places)
            at = np.searchsorted(self.known, distinct)
        places = (self.place[at] if len(distinct) else at)[back]
        false = self.bytes[places] != lengths
        if len(places):
            per = np.diff(np.append(first_block, len(blocks)))
            shift = np.where(false, 0, self.first_block[places] - first_block)
            unlike = self.blocks[np.minimum(np.repeat(shift, per) + np.arange(len(blocks)), len(self.blocks) - 1)] != blocks
            false |= np.logical_or.reduceat(unlike, first_block)
        return places, counts, false

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        begin = len(self.offset)
        for a in range(0, len(chunks), 50_000):
            ids = self.encode_chunks(chunks[a : a + 50_000])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.flat[self.used : self.used + len(flat)] = flat
            self.offset = np.concatenate((self.offset, self.used + np.cumsum(lengths) - lengths))
            self.length = np.concatenate((self.length, lengths))
            self.used += len(flat)
        return np.arange(begin, len(self.offset))

    def ids(self, texts: list[str | None], end: int | None = None) -> list[np.ndarray]:
        """The ids (uint32) of each text, with `end` behind them if it is given."""
        raw = [(t or "").encode() for t in texts]
        odd = [i for i, r in enumerate(raw) if any(s in r for s in self.special)]
        for i in odd:
            raw[i] = b""
        places, counts, false = self.lookup(raw)
        if false.any():
            odd += np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(false)))[np.concatenate(([0], np.cumsum(counts)))])).tolist()
        lengths = self.length[places]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.offset[places] - (ends - lengths), lengths) + np.arange(total)]
        text_ends = np.concatenate(([0], ends))[np.cumsum(counts)]
        out, a = [], 0
        for b in text_ends.tolist():
            out.append(flat[a:b])
            a = b
        for i in odd:
            out[i] = np.asarray(self.whole(texts[i] or ""), np.uint32)
        return out if end is None else [np.append(x, np.uint32(end)) for x in out]


_loaded: dict = {}
#: Words of these letters alone are one piece for either pre-tokenizer, and neither NFC nor case folding splits them.
_PLAIN = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """Byte to the letter that stands for it in byte-level vocabularies: printable ones themselves, the rest from U+0100 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", []))


def library_coder(path: str, blanks: bool) -> ChunkCoder:
    """A coder backed by the tokenizers library; one for each Python worker and file."""
    key = (path, blanks)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        model, letters = tokenizer.model, byte_letters()

        def encode_chunks(chunks: list[bytes]) -> list[list[int]]:
            texts = [c.decode() for c in chunks]
            out: list = [None] * len(texts)
            rest = []
            for k, t in enumerate(texts):
                if _PLAIN.fullmatch(t):
                    piece = t if blanks else t.strip().lower()
                    out[k] = [x.id for x in model.tokenize(piece.encode().decode("latin-1").translate(letters))]
                else:
                    rest.append(k)
            for k, e in zip(rest, tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = e.ids
            return out

        special = tuple(s.lower().encode() for s in special_strings(path))
        _loaded[key] = ChunkCoder(encode_chunks, lambda text: tokenizer.encode(text, add_special_tokens=False).ids, blanks, special)
    return _loaded[key]
