"""Operator 6: best-fit packing of documents into sequences, by large-item matching.

Only lengths matter for the plan, and there are at most `capacity` of them: the plan is made from the counts of
pieces by length. Pieces above one third of the capacity meet at most twice in a sequence, so they are matched in
pairs first, the longest with the longest partner that fits; shorter ones then go, longest first, where they leave
the least room. The plan is a list of patterns with multiplicities. Each piece finds its place by its length and
its rank among the pieces of that length, which a bucketed count gives without any large window.

Defined results: null and empty texts are one piece (the end id); repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.llm.chunks import library_coder
from lumenreel.llm.common import as_documents, slices, stored

#: Pieces that one ranking window holds, about.
BUCKET_ROWS = 50_000


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and how many sequences follow each; every piece is in exactly one."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths are from 1 to {capacity}")
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in open_by_gap:
            open_by_gap[gap] = []
            bisect.insort(gaps, gap)
        open_by_gap[gap].append((pattern, times))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            k = bisect.bisect_right(large, min(n, capacity - n)) - 1
            while k >= 0 and left[large[k]] < 1 + (large[k] == n):
                k -= 1
            if k < 0:
                put((n,), left[n])
                left[n] = 0
                break
            m = large[k]
            times = left[n] // 2 if m == n else min(left[n], left[m])
            put((n, m), times)
            left[n] -= times
            left[m] -= times
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            k = bisect.bisect_left(gaps, n)
            if k < len(gaps):
                gap = gaps[k]
                pattern, times = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    del open_by_gap[gap]
                    gaps.pop(k)
            else:
                gap, pattern, times = capacity, (), -(-count // (capacity // n))
            each = min(gap // n, count)
            filled = min(times, count // each)
            if filled < times and pattern:
                put(pattern, times - filled)
            put(pattern + (n,) * each, filled)
            count -= filled * each
    return [x for own in open_by_gap.values() for x in own]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, number of places, first sequence, offset), sorted by length and rank."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for n in pattern:
            rows.append((n, seen.get(n, 0), times, sequence, offset))
            seen[n] = seen.get(n, 0) + times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32, and on request their ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(vocabulary, False)
        for part in slices(batches):
            every = coder.ids(part.column("text").to_pylist(), end_id)
            rows = [(d, k, a, x[a : a + capacity]) for d, x in zip(part.column("doc_id").to_pylist(), every, strict=True) for k, a in enumerate(range(0, len(x), capacity))]
            data = {
                "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                "piece": pa.array([r[1] for r in rows], pa.int32()),
                "start": pa.array([r[2] for r in rows], pa.int64()),
                "length": pa.array([len(r[3]) for r in rows], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(r[3].astype("<u4").tobytes()) for r in rows], pa.int64()),
            }
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows]))).astype(np.int32)
                data["ids"] = pa.ListArray.from_arrays(offsets, np.concatenate([r[3] for r in rows]).astype(np.int32))
            yield pa.RecordBatch.from_pydict(data)

    return as_documents(docs).mapInArrow(cut, schema)


def place_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces that have doc_id, piece and length. `pieces` is read several times.

    The counts by length (at most `capacity` rows) are all that the driver sees; the plan it sends back has a few
    places for each length, however many pieces there are.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan_sequences(counts, capacity))
    buckets = 1 + sum(counts.values()) // BUCKET_ROWS
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("length", "bucket", (F.sum("rows").over(Window.partitionBy("length").orderBy("bucket")) - F.col("rows")).alias("before"))
    ranked = (
        dealt.withColumn("own_rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("own_rank"))
        .select(*pieces.columns, "rank")
    )
    key = (table[:, 0] << 44) + table[:, 1]
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(key, (n << 44) + rank, side="right") - 1] if len(n) else table[:0]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cuts and places all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(cut_documents(docs, vocabulary, capacity, end_id), "pieces")
    return place_pieces(pieces, capacity)


def packed_sequences(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id and ids (at most `capacity`)."""
    pieces = stored(cut_documents(docs, vocabulary, capacity, end_id, with_ids=True), "pieces")
    placed = place_pieces(pieces.select("doc_id", "piece", "length"), capacity)
    whole = placed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return whole.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
