"""Operator 8: a quality classifier by a factorisation machine.

Inputs of a document are its hashed words (weights of unit length together), statistics of its structure, and its
length as metadata. The score is a logistic of bias + linear terms + pairwise terms of rank RANK, the latter by the
identity 2 * sum_{i<j} <v_i, v_j> x_i x_j = sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), so in linear time.
It is fitted on at most about SAMPLE_DOCS labelled documents.

Defined results: null and empty texts are scored by their structure (all zero); without any labels the score is 0.5,
with labels of one class it is that class's smoothed rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import Words, as_documents, held_out, slices, training_labels

SAMPLE_DOCS = 6_000
SLOTS = 1 << 15
RANK = 6
THRESHOLD = 0.3
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 1 if _b >= 128 or _c.isalpha() else 2 if _c.isdigit() else 3 if _c in " \t\r\v\f" else 4 if _c == "\n" else 5 if _c in ".,;:!?'\"()-" else 6
STATISTICS = (
    "any", "log_bytes", "log_words", "word_length", "short_words", "long_words", "digits", "stops", "symbols", "symbol_words",
    "capitals", "distinct_words", "top_word", "log_lines", "words_per_line", "repeated_neighbours", "lone_symbols", "sentence_ends",
)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words as (text, slot, weight) sorted by text, and the statistics of each text."""
    words = Words(texts)
    first, n = words.first, len(texts)
    counts = np.diff(first)
    text = np.repeat(np.arange(n), counts)
    slot = (words.hashes % np.uint64(SLOTS)).astype(np.int64)
    key, times = np.unique(text * SLOTS + slot, return_counts=True)
    of, slot = key // SLOTS, key % SLOTS
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(of, value**2, n))
    value = (value / norm[of]).astype(np.float32)

    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    kind = _CLASS[data]
    by_kind = np.bincount(owner * 8 + kind, minlength=8 * n).reshape(n, 8)
    capitals = np.bincount(owner[(data >= 65) & (data <= 90)], minlength=n)
    size, count = np.maximum(sizes, 1), np.maximum(counts, 1)
    length = words.ends - words.starts
    # whether a word has a symbol: by the running count of symbols in the joined bytes
    marks = np.concatenate(([0], np.cumsum(_CLASS[words.data] == 6)))
    has = marks[words.ends] > marks[words.starts]
    alone = marks[words.ends] - marks[words.starts] == length
    last = words.data[words.ends - 1] if len(length) else np.zeros(0, np.uint8)
    per = lambda flag: np.bincount(text[flag], minlength=n) / count
    same = np.zeros(len(text), bool)
    if len(text):
        same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])
    top = np.zeros(n)
    np.maximum.at(top, of, times)
    stats = np.stack(
        [
            (counts > 0).astype(float),
            np.log1p(sizes) / 10,
            np.log1p(counts) / 10,
            np.bincount(text, length, n) / count / 10,
            per(length <= 2),
            per(length >= 15),
            by_kind[:, 2] / size * 5,
            by_kind[:, 5] / size * 5,
            by_kind[:, 6] / size * 5,
            per(has),
            capitals / size * 5,
            np.bincount(of, minlength=n) / count,
            top / count,
            np.log1p(by_kind[:, 4]) / 5,
            count / (1 + by_kind[:, 4]) / 100,
            per(same),
            per(alone),
            per((last == 46) | (last == 33) | (last == 63)),
        ],
        axis=1,
    )
    return of, slot, value, np.minimum(stats, 3.0)


class FactorisationMachine:
    """Weights of hashed words (slots from 0) and statistics (slots from SLOTS)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = SLOTS + len(STATISTICS)
        self.bias = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.02, (size, RANK)).astype(np.float32)

    def _join(self, of, slot, value, stats):
        n, m = stats.shape
        every = np.concatenate((of, np.repeat(np.arange(n), m)))
        return every, np.concatenate((slot, np.tile(SLOTS + np.arange(m), n))), np.concatenate((value, stats.ravel())).astype(np.float32)

    def raw(self, of, slot, value, stats) -> np.ndarray:
        n = len(stats)
        of, slot, x = self._join(of, slot, value, stats)
        out = self.bias + np.bincount(of, self.w[slot] * x, n)
        for f in range(RANK):
            vx = self.v[slot, f] * x
            out += 0.5 * (np.bincount(of, vx, n) ** 2 - np.bincount(of, vx * vx, n))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(texts)), -30, 30)))

    def fit(self, rows: list[tuple], rounds: int = 12, batch: int = 256, rate: float = 0.05, decay: float = 2e-5, seed: int = 7) -> FactorisationMachine:
        """rows: (slots, values, statistics, label). Adagrad over shuffled batches."""
        labels = np.array([r[3] for r in rows], float)
        if not len(rows):
            return self
        rate_of_ones = (labels.sum() + 1) / (len(labels) + 2)
        self.bias = float(np.log(rate_of_ones / (1 - rate_of_ones)))
        if labels.min() == labels.max():
            self.v[:] = 0
            return self
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                own = [rows[i] for i in order[a : a + batch]]
                sizes = [len(r[0]) for r in own]
                of, slot, x = self._join(np.repeat(np.arange(len(own)), sizes), np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own]), np.stack([r[2] for r in own]))
                n = len(own)
                sums = np.stack([np.bincount(of, self.v[slot, f] * x, n) for f in range(RANK)], axis=1).astype(np.float32)
                square = np.stack([np.bincount(of, (self.v[slot, f] * x) ** 2, n) for f in range(RANK)], axis=1)
                z = self.bias + np.bincount(of, self.w[slot] * x, n) + 0.5 * (sums**2 - square).sum(1)
                miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[order[a : a + batch]]) / n
                mx = (miss[of] * x).astype(np.float32)
                slots, back = np.unique(slot, return_inverse=True)
                dw = np.bincount(back, mx, len(slots)) + decay * self.w[slots]
                gw[slots] += dw**2
                self.w[slots] -= rate * dw / np.sqrt(gw[slots])
                for f in range(RANK):
                    dv = np.bincount(back, mx * (sums[of, f] - self.v[slot, f] * x), len(slots)) + decay * self.v[slots, f]
                    gv[slots, f] += dv**2
                    self.v[slots, f] -= 0.5 * rate * dv / np.sqrt(gv[slots, f])
                gb += miss.sum() ** 2
                self.bias -= rate * float(miss.sum()) / gb**0.5
        return self


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> FactorisationMachine:
    """Fit on at most about sample_docs labelled documents; only their hashed features reach the driver."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            of, slot, value, stats = features(part.column("text").to_pylist())
            offsets = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.ListArray.from_arrays(offsets, pa.array(slot.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(value)),
                    pa.array(list(stats), pa.list_(pa.float64())),
                    part.column("label"),
                ],
                ["doc_id", "slots", "values", "stats", "label"],
            )

    chosen = training_labels(docs, labels, "quality", sample_docs)
    found = chosen.mapInArrow(take, "doc_id long, slots array<int>, values array<float>, stats array<double>, label int").toArrow().sort_by("doc_id")
    rows = [(np.asarray(r["slots"], np.int64), np.asarray(r["values"], np.float32), np.asarray(r["stats"]), r["label"]) for b in found.to_batches(500) for r in b.to_pylist()]
    return FactorisationMachine().fit(rows)


def score_documents(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(part.column("text").to_pylist()))], ["doc_id", "score"])

    scored = as_documents(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(model.score(part.column("text").to_pylist()) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
