"""Operator 13: ranked lexical search by the Best Position Algorithm.

Documents are read once: each becomes its number of terms and the counts of those terms that queries have. That index
is written to the shared folder; the numbers of documents, terms and documents by term are counted over it.

Then every task goes through its part of the index in shards. A shard has a list for each query term, by falling impact
(what one occurrence of the term in a query adds to a document's score there), and the position of every document
in every list. A query reads its lists a few positions at a time behind their best positions. Each document met is
looked up in all the query's lists at once (direct access), which gives its whole score and marks its positions as
seen everywhere; the best position of a list is the end of its run of seen positions from the top, often far behind
what was read. A document not seen yet lies behind every best position, so it scores at most the sum of the impacts
there. The query leaves the shard when that sum is strictly below its kth best score, over all the task's shards so
far; at equality it reads on, as a smaller doc_id may win a tie. A task gives k rows a query, which are then ranked.

Queries are taken in blocks of a bounded number of terms, so what tasks get of them is bounded.

Defined results: null texts and texts without terms are no documents and no matches; rows that repeat, or share a
doc_id, are documents of their own; documents without doc_id come last among equal scores; rows that share an
item_id are one item with the terms of all; items without terms or matches give no rows; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import BLOCK_PAD, Words, as_documents, byte_blocks, slices, stored

#: Fixed values of the score: share of the length normalisation in hundredths, its weight, the scale of a term.
SHARE, WEIGHT, SCALE = 75, 8, 1_000_000_000
#: Rows (item, term) of one block of queries, about.
BLOCK_ROWS = 200_000
#: Cells of a shard's table of positions (terms times documents), and documents of a shard at most.
SHARD_CELLS, SHARD_DOCS = 12_000_000, 8192
#: Positions of each list that a query reads first; doubled each time.
FIRST_READ = 16
#: Groups in which an item's candidates of all tasks are ranked before the last ranking.
RANK_PARTS = 32

_NO_ID = np.iinfo(np.int64).max
#: A-Z in lower case, other letters and digits of ASCII and all bytes above as they are, the rest a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Vocabulary:
    """The terms of a block of queries, found in texts by their hash and then by their bytes."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        joined = np.frombuffer(b" ".join(raw) + b" " * BLOCK_PAD, np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes + 1) - 1
        self.blocks, self.first, _ = byte_blocks(joined, ends - sizes, ends)
        self.lengths = sizes
        hashes = Words(terms, TERM_BYTES).hashes
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are terms, and their terms."""
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == words.hashes)
        term = self.order[at[hit]]
        starts, ends = words.starts[hit], words.ends[hit]
        same = ends - starts == self.lengths[term]
        hit, term, starts, ends = hit[same], term[same], starts[same], ends[same]
        if len(hit):
            blocks, first, number = byte_blocks(words.data, starts, ends)
            per = np.diff(np.append(first, len(blocks)))
            unlike = self.blocks[np.repeat(self.first[term], per) + number] != blocks
            same = ~np.logical_or.reduceat(unlike, first)
            hit, term = hit[same], term[same]
        return hit, term


def index_documents(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of query terms, ascending) and counts; documents without terms are left out."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(terms)
        for part in slices(batches):
            words = Words(part.column("text").to_pylist(), TERM_BYTES)
            n = np.diff(words.first)
            hit, term = known.find(words)
            doc = np.searchsorted(words.first, hit, side="right") - 1
            pairs, counts = np.unique(doc * len(terms) + term, return_counts=True)
            kept = np.flatnonzero(n > 0)
            offsets = np.append(0, np.searchsorted(pairs, (kept + 1) * len(terms))).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id").cast(pa.int64()).take(pa.array(kept)),
                    "n": pa.array(n[kept], pa.int64()),
                    "terms": pa.ListArray.from_arrays(offsets, pa.array((pairs % len(terms)).astype(np.int32))),
                    "counts": pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
                }
            )

    return as_documents(docs).mapInArrow(index, "doc_id long, n long, terms array<int>, counts array<int>")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a batch, and where each list begins (and the last one ends) in them."""
    return column.flatten().to_numpy(), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))


def document_frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents by term; each task adds up its own first, so that a task gives a row a term at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch.column("terms"))[0], minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "df": pa.array(df[some], pa.int64())})

    out = np.zeros(n_terms, np.int64)
    for r in index.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term of the block
        out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class Shard:
    """Impact lists of some documents: by term, falling impact first, and each document's position in each list."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, ordered = doc[order], impact[order], term[order]
        self.first = np.searchsorted(ordered, np.arange(n_terms + 1))
        self.position = np.full((n_terms, n_docs), -1, np.int32)
        self.position[ordered, self.doc] = np.arange(len(ordered)) - self.first[ordered]
        self.n_docs = n_docs

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, ids: np.ndarray, top: list[tuple[int, int]]) -> int:
        """Brings the best k of this shard into top, a heap of (score, -doc_id); gives the number of documents looked up."""
        first, sizes = self.first[terms], self.first[terms + 1] - self.first[terms]
        some = sizes > 0
        terms, times, first, sizes = terms[some], times[some], first[some], sizes[some]
        if not len(terms):
            return 0
        seen = [np.zeros(n + 1, bool) for n in sizes.tolist()]  # the last mark stays unset and ends every run
        best = np.zeros(len(terms), np.int64)  # positions from the top that are all seen
        met = np.zeros(self.n_docs, bool)
        padded, read, looked = np.append(self.impact, 0), FIRST_READ, 0
        while True:
            ahead = np.where(best < sizes, padded[np.minimum(first + best, len(self.impact))], 0)
            bound = int((times * ahead).sum())
            if not bound or len(top) == k and bound < top[0][0]:
                return looked
            found = np.unique(np.concatenate([self.doc[a + b : a + min(b + read, n)] for a, b, n in zip(first.tolist(), best.tolist(), sizes.tolist(), strict=True)]))
            read *= 2
            found = found[~met[found]]
            met[found] = True
            looked += len(found)
            at = self.position[np.ix_(terms, found)]
            there = at >= 0
            scores = (np.where(there, self.impact[first[:, None] + np.maximum(at, 0)], 0) * times[:, None]).sum(axis=0)
            for i in range(len(terms)):
                marks, b = seen[i], int(best[i])
                marks[at[i][there[i]]] = True
                best[i] = b + int(np.argmin(marks[b:]))
            better = np.arange(len(found)) if len(top) < k else np.flatnonzero(scores >= top[0][0])
            if len(better) > k:
                better = better[np.lexsort((ids[found[better]], -scores[better]))[:k]]
            for s, d in zip(scores[better].tolist(), ids[found[better]].tolist(), strict=True):
                if s > 0 and len(top) < k:
                    heapq.heappush(top, (s, -d))
                elif s > 0 and (s, -d) > top[0]:
                    heapq.heapreplace(top, (s, -d))


def _search_block(docs: DataFrame, block: list, k: int) -> DataFrame:
    """block: rows (item_id, term, times)."""
    terms = sorted({r["term"] for r in block})
    number = {t: i for i, t in enumerate(terms)}
    by_item: dict = {}
    for r in block:
        by_item.setdefault(r["item_id"], []).append((number[r["term"]], r["times"]))
    index = stored(index_documents(docs, terms), "term-index")
    whole = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_all = int(whole[0]), max(int(whole[1]), 1)
    weight = weights(document_frequencies(index, len(terms)), n_docs)
    items = []
    for item, own in sorted(by_item.items(), key=lambda x: (x[0] is None, x[0])):
        own = np.array([x for x in sorted(own) if weight[x[0]] > 0], np.int64).reshape(-1, 2)
        items.append((item, own[:, 0], own[:, 1]))
    most_docs = max(1, min(SHARD_DOCS, SHARD_CELLS // len(terms)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[list] = [[] for _ in items]
        held: list[pa.RecordBatch] = []

        def rank() -> None:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            n, (term, at), (count, _) = rows.column("n").to_numpy(), _flat(rows.column("terms")), _flat(rows.column("counts"))
            ids = rows.column("doc_id").fill_null(_NO_ID).to_numpy()
            m = np.array([100 - SHARE + SHARE * x * n_docs // n_all for x in n.tolist()], np.int64)
            doc = np.repeat(np.arange(len(n)), np.diff(at))
            times = count.astype(np.int64)
            shard = Shard(doc, term, weight[term] * (SCALE * times // (1000 * times + WEIGHT * m[doc])), len(n), len(terms))
            for top, (_, own, repeats) in zip(tops, items, strict=True):
                shard.best(own, repeats, k, ids, top)

        size = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most_docs - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == most_docs:
                    rank()
                    size = 0
        if held:
            rank()
        rows = [(i, s, None if d == -_NO_ID else -d) for i, top in enumerate(tops) for s, d in top]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "score", "doc_id"])

    found = index.mapInArrow(search, "item int, score long, doc_id long")
    names = docs.sparkSession.createDataFrame([(i, x[0]) for i, x in enumerate(items)], "item int, item_id long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(RANK_PARTS))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block has at most about BLOCK_ROWS items


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and times of each item's terms."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(_TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best documents (doc_id, text) for each item (item_id, text): item_id, rank, doc_id, score."""
    asked = stored(item_terms(items), "item-terms")
    blocks = 1 + asked.count() // block_rows
    dealt = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "item_id"), F.lit(blocks)))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        block = dealt.where(F.col("block") == b).drop("block").collect()  # about block_rows rows
        if block:
            found = _search_block(docs, block, k)
            out = found if blocks == 1 else out.unionByName(stored(found, "ranked"))
    return out
