"""Operator 2: personal data by base patterns and a skip-chain conditional random field.

Candidates are the words of a text that hold a digit or an at sign. Each is a node with a label (none or a kind).
Neighbouring candidates share a transition potential; a candidate also shares a skip potential with the last one
before it that is the same or similar (same letters, or same last seven digits), however far apart. Loopy sum-product
message passing over all texts of a slice gives marginals; words outside base spans that are surely of a kind, and from
which same or similar words of that kind lead to a base span of the text, add spans. The weights are learned by
pseudo-likelihood from a bounded sample whose labels are the base spans.

Defined results: null and empty texts have no spans; every row gets one result row.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenreel.llm.common import as_documents, bounded_sample, slices, span_string

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 4_000
#: Of a sampled document: candidates, and characters of them with their surroundings.
SAMPLE_CANDIDATES = 200
SAMPLE_CHARS = 20_000
#: Least marginal of a word that adds a span.
SURE = 0.9
ROUNDS = 6
#: Where the skip potential of equal labels starts from and is drawn to.
CONSISTENT = 6.0
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Contract spans by kind as listed, then start. Linear in the text."""
    found = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


#: Features of a node are hashed into so many slots.
SLOTS = 1 << 12
_CANDIDATE = re.compile(r"[0-9@]")
_EDGES = ".,;:!?\"'()[]{}<>|*%&#$"
_RUN = re.compile(r"[0-9]+|[^\W\d_]+", re.UNICODE)


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of each word that holds a digit or an at sign."""
    out, end = [], 0
    m = _CANDIDATE.search(text)
    while m:
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.start() + 1
        while end < len(text) and not text[end].isspace():
            end += 1
        out.append((start, end))
        m = _CANDIDATE.search(text, end)
    return out


def _shape(word: str) -> str:
    return _RUN.sub(lambda m: ("9" if m[0][0].isdigit() else "a") + str(min(len(m[0]), 20)), word)[:40]


def _slot(*parts) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode()) % SLOTS


class Graph:
    """The candidates of several texts as one graph."""

    def __init__(self, texts: list[str]):
        self.text_of, self.start, self.end = [], [], []
        slots: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        for t, text in enumerate(texts):
            last: dict[str, int] = {}
            before = -1
            for a, b in candidates(text):
                node = len(slots)
                core_a, core_b = a, b
                while core_a < core_b and text[core_a] in _EDGES and text[core_a] != "(":
                    core_a += 1
                while core_b > core_a and text[core_b - 1] in _EDGES and text[core_b - 1] != ")":
                    core_b -= 1
                word = text[core_a:core_b]
                digits = "".join(c for c in word if "0" <= c <= "9")
                left = text[max(0, a - 24) : a].split()
                right = text[b : b + 24].split()
                slots.append(
                    [
                        _slot("shape", _shape(word)),
                        _slot("digits", min(len(digits), 24), "@" in word, word.count(".")),
                        _slot("first", word[:1] if word[:1] in "+(" else "-", word[-1:] == ")"),
                        _slot("left", _shape(left[-1]) if left else "", len(left) and any(c.isdigit() for c in left[-1])),
                        _slot("right", _shape(right[0]) if right else "", len(right) and any(c.isdigit() for c in right[0])),
                    ]
                )
                self.text_of.append(t)
                self.start.append(core_a)
                self.end.append(core_b)
                if before >= 0 and text[self.end[before] : core_a].isspace():
                    self.chain.append((before, node))
                keys = {word.lower()}
                if len(digits) >= 7:
                    keys.add("#" + digits[-7:])
                if "@" in word:
                    keys.add("@" + word.split("@")[0].lower())
                # one edge a pair, however many keys it shares
                self.skip.extend((other, node) for other in sorted({last[key] for key in keys if key in last}))
                last.update(dict.fromkeys(keys, node))
                before = node
        self.slots = np.array(slots, np.int64).reshape(-1, 5)

    def labels(self, spans: list[list[tuple[str, int, int]]]) -> np.ndarray:
        """The kind of the base span that each node lies in, 0 for none; of several kinds the first listed.

        Spans of a kind don't overlap, so of those that begin before a node's end the last one decides: one sorted
        search for each kind, however many spans a text has.
        """
        out = np.zeros(len(self.slots), np.int64)
        text, start, end = (np.array(c, np.int64) for c in (self.text_of, self.start, self.end))
        for kind in reversed(KINDS):
            own = np.array([(t, x, y) for t, found in enumerate(spans) for k, x, y in found if k == kind], np.int64)
            if not len(own) or not len(out):
                continue
            own = own[np.lexsort((own[:, 1], own[:, 0]))]
            at = np.searchsorted((own[:, 0] << 40) + own[:, 1], (text << 40) + end) - 1
            last = own[np.maximum(at, 0)]
            out[(at >= 0) & (last[:, 0] == text) & (last[:, 2] > start)] = 1 + KINDS.index(kind)
        return out


N_LABELS = 1 + len(KINDS)


def fit(graph: Graph, labels: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Weights by pseudo-likelihood: each node's label given its features and its neighbours' labels.

    Base patterns say for sure what is of a kind, not what is of none: a node outside their spans that is the same as or
    similar to one inside has no known label. It and its edges take no part, else the fit would learn that twins disagree.
    """
    w = {"node": np.zeros((SLOTS, N_LABELS)), "bias": np.zeros(N_LABELS), "chain": np.zeros((N_LABELS, N_LABELS)), "skip": CONSISTENT * np.eye(N_LABELS)}
    prior = {k: v.copy() for k, v in w.items()}
    chain, skip = (np.array(e, np.int64).reshape(-1, 2) for e in (graph.chain, graph.skip))
    inside = labels > 0
    seen = np.ones(len(labels), bool)
    twins = skip[inside[skip[:, 0]] != inside[skip[:, 1]]].ravel()
    seen[twins[~inside[twins]]] = False
    chain, skip = (e[seen[e].all(1)] for e in (chain, skip))
    n = seen.sum()
    if not n:
        return w
    square = {k: np.full_like(v, 1e-8) for k, v in w.items()}
    hot = np.eye(N_LABELS)[labels]
    for _ in range(rounds):
        score = w["node"][graph.slots].sum(1) + w["bias"]
        for edges, m in ((chain, w["chain"]), (skip, w["skip"])):
            np.add.at(score, edges[:, 1], m[labels[edges[:, 0]]])
            np.add.at(score, edges[:, 0], m.T[labels[edges[:, 1]]])
        p = np.exp(score - score.max(1, keepdims=True))
        miss = seen[:, None] * (hot - p / p.sum(1, keepdims=True)) / n
        step = {"node": np.zeros_like(w["node"]), "bias": miss.sum(0)}
        for k in range(graph.slots.shape[1]):
            np.add.at(step["node"], graph.slots[:, k], miss)
        for name, edges in (("chain", chain), ("skip", skip)):
            g = np.zeros_like(w[name])
            np.add.at(g, labels[edges[:, 0]], miss[edges[:, 1]])
            np.add.at(g.T, labels[edges[:, 1]], miss[edges[:, 0]])
            step[name] = g
        for k, g in step.items():
            g = g - decay * (w[k] - prior[k])
            square[k] += g * g
            w[k] += rate * g / np.sqrt(square[k])
    return w


def marginals(graph: Graph, w: dict[str, np.ndarray], clamped: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product with damping. Nodes with clamped > 0 keep that label (base spans are certain)."""
    n = len(graph.slots)
    node = w["node"][graph.slots].sum(1) + w["bias"]
    node = node - node.max(1, keepdims=True)
    sure = clamped > 0
    node[sure] = -30.0
    node[sure, clamped[sure]] = 0.0
    edges = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
    if not len(edges):
        p = np.exp(node)
        return p / p.sum(1, keepdims=True)
    kind = np.repeat([0, 1], [len(graph.chain), len(graph.skip)])
    table = np.exp(np.stack([w["chain"], w["skip"]]))
    source = np.concatenate((edges[:, 0], edges[:, 1]))
    target = np.concatenate((edges[:, 1], edges[:, 0]))
    pair = np.concatenate((table[kind], table[kind].transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))))
    message = np.zeros((2 * len(edges), N_LABELS))
    for _ in range(rounds):
        belief = node.copy()
        np.add.at(belief, target, message)
        out = belief[source] - message[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", out, pair) + 1e-30)
        new -= new.max(1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    belief = node.copy()
    np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], w: dict[str, np.ndarray]) -> list[list[tuple[str, int, int]]]:
    """Spans beyond the base ones, for each text; neighbouring sure words of a kind are one span."""
    out: list[list] = [[] for _ in texts]
    graph = Graph(texts)
    if not len(graph.slots):
        return out
    known = graph.labels(base)
    p = marginals(graph, w, known)
    best = p[:, 1:].argmax(1) + 1
    take = (known == 0) & (p[np.arange(len(p)), best] >= SURE)
    joined = set(graph.chain)
    # A word alone is no evidence, nor are two that only resemble each other: a way over same or similar words of
    # its label must lead to a base span.
    label = np.where(known > 0, known, np.where(take, best, 0))
    ways = [(x, y) for x, y in graph.skip if label[x] and label[x] == label[y]]
    agreed = known > 0
    before = -1
    while before != (before := int(agreed.sum())):
        for x, y in ways:
            agreed[y] |= agreed[x]
        for x, y in reversed(ways):
            agreed[x] |= agreed[y]
    take &= agreed
    last = -2
    for k in np.flatnonzero(take).tolist():
        kind, t = KINDS[best[k] - 1], graph.text_of[k]
        if last == k - 1 and (last, k) in joined and out[t] and out[t][-1][0] == kind:
            out[t][-1] = (kind, out[t][-1][1], graph.end[k])
        elif graph.end[k] > graph.start[k]:
            out[t].append((kind, graph.start[k], graph.end[k]))
        last = k
    return out


def surroundings(text: str, most: int = SAMPLE_CANDIDATES, chars: int = SAMPLE_CHARS) -> list[tuple[int, int]]:
    """Stretches (start, end) round candidates with up to 40 characters on each side, in order and apart from each other.

    All candidates, or those of the least hashes of word and place: at most `most` of them, and of at most `chars`
    characters together; what doesn't fit is left out, not cut. Stretches that meet are one, and none begins or ends
    within a word, so that every node of the sample is a whole word and no word is there twice.
    """
    found = [(zlib.crc32(f"{a}:{text[a:b]}".encode(errors="replace")), a, b) for a, b in candidates(text)]
    taken, left = [], chars
    for _, a, b in sorted(found):
        first, last = max(0, a - 40), min(b + 40, len(text))
        if len(taken) < most and last - first + 3 <= left:
            left -= last - first + 3
            while 0 < first < a and not text[first - 1].isspace():
                first += 1
            while b < last < len(text) and not text[last].isspace():
                last -= 1
            taken.append((first, last))
    out: list[tuple[int, int]] = []
    for first, last in sorted(taken):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


#: Between stretches: no blank alone, as words on both sides of one would be neighbours.
_APART = "\n|\n"


def sample_of(text: str, most: int = SAMPLE_CANDIDATES, chars: int = SAMPLE_CHARS) -> tuple[str, list[tuple[str, int, int]]]:
    """The stretches of a text as one text, and in its places the parts there of the whole text's base spans."""
    kept = surroundings(text, most, chars)
    if not kept:
        return "", []
    starts = np.array([a for a, _ in kept])
    at = np.concatenate(([0], np.cumsum([b - a + len(_APART) for a, b in kept])))
    spans = []
    for kind, x, y in base_spans(text):
        k = max(int(np.searchsorted(starts, x, side="right")) - 1, 0)
        while k < len(kept) and kept[k][0] < y:
            a, b = max(x, kept[k][0]), min(y, kept[k][1])
            if a < b:
                move = int(at[k]) - kept[k][0]
                spans.append((kind, a + move, b + move))
            k += 1
    return _APART.join(text[a:b] for a, b in kept), spans


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES, sample_chars: int = SAMPLE_CHARS) -> dict[str, np.ndarray]:
    """Fit the weights on at most about sample_docs documents, however many there are.

    Of each at most sample_candidates candidates, of sample_chars characters with their surroundings, from all over the text.
    """
    import pandas as pd

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # only the surroundings of candidates reach the driver
            kept = [sample_of(t, sample_candidates, sample_chars) for t in f["text"].fillna("")]
            yield pd.DataFrame([(t, span_string(s)) for t, s in kept if t], columns=["text", "spans"])

    found = bounded_sample(as_documents(docs), sample_docs).mapInPandas(take, "text string, spans string").toPandas()
    rows = sorted(zip(found["text"], found["spans"], strict=True))
    graph = Graph([t for t, _ in rows])
    spans = [[(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)] for _, s in rows]
    return fit(graph, graph.labels(spans))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_private(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans of every document."""
    w = train(docs) if weights is None else weights
    order = {k: i for i, k in enumerate(KINDS)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, w)
            rows = []
            for own, extra in zip(base, more, strict=True):
                kinds = [s[0] for s in own]
                every = sorted(own + extra, key=lambda s: (order[s[0]], s[1])) if extra else own
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(span_string(own).encode()).hexdigest(), span_string(every)))
            columns = list(zip(*rows, strict=True))
            kept = [part.column("doc_id")] + [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays(kept, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return as_documents(docs).mapInArrow(find, SCHEMA)
