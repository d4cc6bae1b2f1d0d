"""Operator 10: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are the density of a learned lexicon (plain, and after undoing look-alike characters), how near its words
are to second-person pronouns, and rates of capitals, punctuation and obfuscation. The lexicon holds the words whose
presence most raises the odds of the label. All is fitted on at most about SAMPLE_DOCS labelled documents: trees on
two thirds of them, the calibration on the rest.

Defined results: null and empty texts are scored by their features (all zero); without any labels the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import LOWER, Words, as_documents, held_out, slices, stored, training_labels

SAMPLE_DOCS = 9_000
LEXICON_WORDS = 300
LEAST_DOCS = 6
THRESHOLD = 0.5
NEAR = 6
#: Bytes left out of words before they are compared.
_DROP = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "@$!")
_DROP_PLAIN = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Look-alike characters and the letters they stand for (fixed values).
_LOOK_ALIKE = bytearray(LOWER)
for _a, _b in zip(b"013457@$", b"oieastas", strict=True):
    _LOOK_ALIKE[_a] = _b
_LOOK_ALIKE = bytes(_LOOK_ALIKE)
#: Second-person pronouns in English, German, French and Spanish (fixed values).
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "usted ustedes vosotros tus ti contigo vuestro"
).split()
NAMES = (
    "lexicon", "lexicon_log", "folded", "hidden", "weight", "near_second", "second", "capitals", "capital_words",
    "exclaims", "questions", "stops", "symbols", "mixed_words", "log_words",
)


def _hashes_of(words: list[str]) -> np.ndarray:
    return np.sort(Words(words).hashes)


def _folded(texts: list[str | None]) -> Words:
    return Words([t and t.replace("!", "") for t in texts], _LOOK_ALIKE, _DROP)


def features(texts: list[str | None], lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """lexicon: sorted hashes of folded words, and the weight of each."""
    n = len(texts)
    known, weight = lexicon
    plain, folded = Words(texts, LOWER, _DROP_PLAIN), _folded(texts)

    def hits(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, words.hashes), max(len(known) - 1, 0))
        hit = known[at] == words.hashes if len(known) else np.zeros(len(words.hashes), bool)
        text = np.repeat(np.arange(n), np.diff(words.first))
        return hit, at, text

    hit_plain, _, text_plain = hits(plain)
    hit, at, text = hits(folded)
    count = np.maximum(np.diff(folded.first), 1)
    per = lambda flag, of=text: np.bincount(of[flag], minlength=n)
    second = np.isin(folded.hashes, _SECOND)
    place = np.flatnonzero(second)
    hit_place = np.flatnonzero(hit)
    if len(place) and len(hit_place):
        right = np.searchsorted(place, hit_place)
        near = np.zeros(len(hit_place), bool)
        for k in (np.minimum(right, len(place) - 1), np.maximum(right - 1, 0)):
            near |= (np.abs(place[k] - hit_place) <= NEAR) & (text[place[k]] == text[hit_place])
        near_second = np.bincount(text[hit_place[near]], minlength=n)
    else:
        near_second = np.zeros(n)
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    size = np.maximum(sizes, 1)
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    upper, letter, digit = (data >= 65) & (data <= 90), ((data | 32) >= 97) & ((data | 32) <= 122), (data >= 48) & (data <= 57)
    rate = lambda flag: np.bincount(owner[flag], minlength=n) / size
    ascii_mark = (data > 32) & (data < 127) & ~letter & ~digit
    words = Words(texts, bytes(range(256)))
    of_word = np.repeat(np.arange(n), np.diff(words.first))
    run = lambda flag: np.concatenate(([0], np.cumsum(flag)))
    w = words.data
    w_upper, w_letter = run((w >= 65) & (w <= 90)), run((((w | 32) >= 97) & ((w | 32) <= 122)) | (w >= 128))
    w_other = run(((w >= 48) & (w <= 57)) | np.isin(w, np.frombuffer(b"@$*!", np.uint8)))
    inside = lambda r: r[words.ends] - r[words.starts]
    n_words = np.maximum(np.diff(words.first), 1)
    capital = (inside(w_upper) == words.ends - words.starts) & (words.ends - words.starts >= 3)
    mixed = (inside(w_letter) >= 2) & (inside(w_other) >= 1)
    lexicon_hits, folded_hits = per(hit_plain, text_plain), per(hit)
    return np.stack(
        [
            lexicon_hits / count,
            np.log1p(lexicon_hits),
            folded_hits / count,
            np.maximum(folded_hits - lexicon_hits, 0) / count,
            np.bincount(text[hit], weight[at[hit]] if len(known) else None, n) / count,
            near_second / count,
            per(second) / count,
            rate(upper),
            np.bincount(of_word[capital], minlength=n) / n_words,
            rate(data == 33),
            rate(data == 63),
            rate((data == 46) | (data == 44)),
            rate(ascii_mark),
            np.bincount(of_word[mixed], minlength=n) / n_words,
            np.log1p(np.diff(words.first)),
        ],
        axis=1,
    )


_SECOND = _hashes_of(SECOND_PERSON)


class BoostedTrees:
    """Trees of fixed depth over quantile bins, for log loss, then a monotone step from raw sums to rates."""

    def __init__(self, depth: int = 3, trees: int = 80, rate: float = 0.15, bins: int = 32, least: float = 5.0, ridge: float = 1.0):
        self.depth, self.n_trees, self.rate, self.bins, self.least, self.ridge = depth, trees, rate, bins, least, ridge
        self.base, self.trees = 0.0, []
        self.at, self.value = np.zeros(1), np.array([0.5])

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, check_x: np.ndarray, check_y: np.ndarray) -> BoostedTrees:
        if not len(y):
            return self
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned, raw = self._bin(x), np.full(len(y), self.base)
        if y.min() < y.max():
            for _ in range(self.n_trees):
                p = 1 / (1 + np.exp(-raw))
                tree = self._grow(binned, p - y, p * (1 - p))
                self.trees.append(tree)
                raw += self._one(tree, binned)
        self.at, self.value = isotonic(self.raw(check_x), check_y) if len(check_y) else isotonic(raw, y)
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and bin of each inner node, in order of levels, and the values of the leaves."""
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64)
        node = np.zeros(len(g), np.int64)
        wide = self.bins + 1
        for level in range(self.depth):
            start, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for k in range(binned.shape[1]):
                key = (node - start) * wide + binned[:, k]
                left_g = np.cumsum(np.bincount(key, g, n * wide).reshape(n, wide), axis=1)
                left_h = np.cumsum(np.bincount(key, h, n * wide).reshape(n, wide), axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - all_g**2 / (all_h + self.ridge)
                gain[(left_h < self.least / 4) | (right_h < self.least / 4)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(n), top] > best
                best[better] = gain[np.arange(n), top][better]
                feature[start + np.flatnonzero(better)], cut[start + np.flatnonzero(better)] = k, top[better]
            node = 2 * node + 1 + (binned[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        total_g, total_h = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
        return feature, cut, -self.rate * total_g / (total_h + self.ridge)

    def _one(self, tree: tuple, binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return value[node - (2**self.depth - 1)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.trees:
            binned = self._bin(x)
            for tree in self.trees:
                out += self._one(tree, binned)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.value) if self.trees else np.full(len(x), 1 / (1 + np.exp(-self.base)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the least-squares rising fit of y by x, as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, size, lowest x, highest x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    value = np.array([(b[0] + 0.02) / (b[1] + 0.04) for b in blocks for _ in range(2)])
    return at, np.maximum.accumulate(value)


class Model:
    def __init__(self, lexicon: tuple[np.ndarray, np.ndarray], trees: BoostedTrees):
        self.lexicon, self.trees = lexicon, trees

    def score(self, texts: list[str | None]) -> np.ndarray:
        return np.clip(self.trees.score(features(texts, self.lexicon)), 0.0, 1.0)


def learn_lexicon(sample: DataFrame, most: int = LEXICON_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The words (hashes) of the sample whose presence raises the odds of the label most; at most `most` rows return."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = _folded(part.column("text").to_pylist())
            text = np.repeat(np.arange(part.num_rows), np.diff(words.first))
            label = part.column("label").to_numpy(zero_copy_only=False)
            pair = np.unique(np.stack([text.astype(np.uint64), words.hashes]), axis=1) if len(text) else np.zeros((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64)), pa.array(label[pair[0].astype(np.int64)], pa.int32())], ["word", "label"])

    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    ones, zeros = totals["ones"], totals["n"] - totals["ones"]
    counted = sample.select("text", "label").mapInArrow(distinct, "word long, label int").groupBy("word").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("a") + 0.5) / (ones + 1.0)) - F.log((F.col("n") - F.col("a") + 0.5) / (zeros + 1.0))
    # the lower end of the log odds, so that rare words need a strong lean
    low = odds - 1.64 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("n") - F.col("a") + 0.5))
    top = counted.where(F.col("n") >= LEAST_DOCS).withColumn("low", low).where("low > 0.7").orderBy(F.desc("low"), "word").limit(most).collect()
    found = sorted((r["word"] & (2**64 - 1), r["low"]) for r in top)
    return np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found], float)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most about sample_docs labelled documents; only their dense features reach the driver.

    Two thirds of them, by the hash of doc_id, teach words and trees; the rest calibrate.
    """
    grows = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) < 2
    sample = stored(training_labels(docs, labels, "toxic", sample_docs).withColumn("grows", grows), "toxicity-sample")
    lexicon = learn_lexicon(sample.where("grows"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = features(part.column("text").to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64())), part.column("label"), part.column("grows")], ["doc_id", "x", "label", "grows"])

    found = sample.select("doc_id", "text", "label", "grows").mapInArrow(take, "doc_id long, x array<double>, label int, grows boolean").toPandas().sort_values("doc_id")
    x = np.array(found["x"].tolist(), float).reshape(-1, len(NAMES))
    y = found["label"].to_numpy(float)
    part = found["grows"].to_numpy(bool)
    return Model(lexicon, BoostedTrees().fit(x[part], y[part], x[~part], y[~part]))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(part.column("text").to_pylist()))], ["doc_id", "score"])

    scored = as_documents(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold.

    A model that has seen no labels, or only one kind of them, can reject nothing: all rows stay.
    """
    if not model.trees.trees:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(model.score(part.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(keep, docs.schema)
