"""Operator 11: harmonic packing of documents into sequences of at most `capacity` tokens.

A piece of length n belongs to the class j = capacity div n, those of lengths above capacity / (j + 1) and at most
capacity / j, and a sequence of class j holds exactly j pieces of that class. So a task fills its sequences from its
own counts by class, whatever other tasks do: there is no shuffle, no plan and nothing for the driver to see.

What harmonic packing wastes is the room between a piece and the top of its class. As documents may be cut freely,
they are cut at the tops that divide the capacity: full pieces first, then the rest of the document by powers of
two, longest first. Then each full sequence is full to the last token. The last sequence of a class in a task may
have fewer pieces; it is split into sequences of a power-of-two number of pieces, which need no padding either. A
larger `least` leaves rests below it with the piece before them: fewer and longer pieces, and a little padding.

Defined results: null and empty texts are one piece (the end id); repeated rows are packed as often as they occur;
an empty table gives no rows; only doc_id and text are read, so extra columns of any name don't matter. Numbers of
sequences are unique, with gaps, and the same when a lost task runs again on the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.chunks import library_coder
from lumenreel.llm.common import as_documents, slices, stored

#: Sequence numbers: the task's above these bits, then the bin's number, then the part of a bin that was split.
_TASK_BIT, _PART_BITS = 43, 5


def _power(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def cut_points(tokens: np.ndarray, capacity: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which document each piece is of, its start and its length; documents in order, pieces in order.

    tokens: the number of tokens of each document, at least 1. Both capacity and least are powers of two.
    """
    if not (_power(capacity) and _power(least) and least <= capacity):
        raise ValueError("capacity and least are powers of two, and least is at most capacity")
    full = tokens // capacity
    doc = np.repeat(np.arange(len(tokens)), full)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    bits = np.arange(capacity.bit_length() - 2, least.bit_length() - 2, -1)
    rest_doc, which = np.nonzero((tokens[:, None] >> bits) & 1)
    level = bits[which]
    above = (tokens[rest_doc] >> (level + 1)) << (level + 1)
    low = tokens % least
    lone = np.flatnonzero((low > 0) & (tokens % capacity < least))
    docs = np.concatenate((doc, rest_doc, lone))
    starts = np.concatenate((number * capacity, above, tokens[lone] - low[lone]))
    lengths = np.concatenate((np.full(len(doc), capacity), np.left_shift(1, level), low[lone]))
    order = np.lexsort((starts, docs))
    docs, starts, lengths = docs[order], starts[order], lengths[order]
    last = np.append(docs[1:] != docs[:-1], True) if len(docs) else np.zeros(0, bool)
    lengths[last] = tokens[docs[last]] - starts[last]
    return docs, starts, lengths


class Bins:
    """The bins of one task: places for pieces by class, and the pieces of bins that are still open."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.fill = np.zeros(capacity + 1, np.int64)

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, bin (numbered within the class) and offset of each piece."""
        size = self.capacity // lengths
        order = np.argsort(size, kind="stable")
        ordered, own = size[order], lengths[order]
        classes, first, counts = np.unique(ordered, return_index=True, return_counts=True)
        rank = np.arange(len(own)) - np.repeat(first, counts) + self.count[ordered]
        ends = np.cumsum(own)
        before = ends - own
        # What lies in a bin before a piece: counted from the bin's first piece here, or from what was there already.
        opens = (rank % ordered == 0) | (np.arange(len(own)) == np.repeat(first, counts))
        at = np.maximum.accumulate(np.where(opens, np.arange(len(own)), 0)) if len(own) else rank
        held = np.where(rank[at] % ordered[at] == 0, 0, self.fill[ordered[at]])
        offset = before - before[at] + held
        last = first + counts - 1
        self.fill[classes] = np.where((rank[last] + 1) % classes == 0, 0, offset[last] + own[last])
        self.count[classes] += counts
        back = np.empty(len(own), np.int64)
        back[order] = np.arange(len(own))
        return size, (rank // ordered)[back], offset[back]

    def closed(self, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which of the pieces are in bins that have all their pieces."""
        return number < self.count[size] // size


def split_open(size: np.ndarray, lengths: np.ndarray, offset: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the open bins, and offsets in them: powers of two, where all pieces of a bin have one power of two."""
    part = np.zeros(len(size), np.int64)
    for j in np.unique(size).tolist():
        own = np.flatnonzero(size == j)
        if not _power(j) or (lengths[own] * j != capacity).any():
            continue
        own = own[np.argsort(offset[own])]
        number, begin = 0, 0
        for bit in range(len(own).bit_length() - 1, -1, -1):
            if len(own) >> bit & 1:
                part[own[begin : begin + (1 << bit)]] = number
                offset[own[begin : begin + (1 << bit)]] -= begin * (capacity // j)
                number, begin = number + 1, begin + (1 << bit)
    return part, offset


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, least: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on request ids."""
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    levels = capacity + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bins = library_coder(vocabulary, True), Bins(capacity)
        base = TaskContext.get().partitionId() << _TASK_BIT
        held: pa.Table | None = None

        def numbered(table: pa.Table, part: np.ndarray | int = 0, offset: np.ndarray | None = None) -> list[pa.RecordBatch]:
            number = table.column("_bin").to_numpy() * levels + table.column("_size").to_numpy()
            own = table.column("_offset").to_numpy() if offset is None else offset
            out = table.drop_columns(["_bin", "_size", "_offset"]).append_column("sequence_id", pa.array(base + (number << _PART_BITS) + part, pa.int64()))
            return out.append_column("offset", pa.array(own, pa.int64())).combine_chunks().to_batches()

        for piece in slices(batches):
            every = coder.ids(piece.column("text").to_pylist(), end_id)
            tokens = np.fromiter(map(len, every), np.int64, len(every))
            doc, start, length = cut_points(tokens, capacity, least)
            cut = [every[d][a : a + n].astype("<u4", copy=False) for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            data = {
                "doc_id": piece.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(np.ascontiguousarray(x)) for x in cut], pa.int64()),
                "doc_tokens": pa.array(tokens[doc], pa.int64()),
            }
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                data["ids"] = pa.ListArray.from_arrays(offsets, np.concatenate(cut).astype(np.int32))
            size, number, offset = bins.place(length)
            placed = pa.table(data | {"_bin": pa.array(number), "_size": pa.array(size), "_offset": pa.array(offset)})
            placed = placed if held is None else pa.concat_tables([held, placed])
            closed = bins.closed(placed.column("_size").to_numpy(), placed.column("_bin").to_numpy())
            held = placed.filter(pa.array(~closed)).combine_chunks()
            yield from numbered(placed.filter(pa.array(closed)))
        if held is not None and held.num_rows:
            size, length = held.column("_size").to_numpy(), held.column("length").to_numpy()
            yield from numbered(held, *split_open(size, length, held.column("_offset").to_numpy().copy(), capacity))

    return as_documents(docs).mapInArrow(pack, kinds + ", sequence_id long, offset long").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids
    )


def padded_length(tokens: str, capacity: int = 1024) -> F.Column:
    """How long a sequence of so many tokens is with its padding: itself at a power of two, else the capacity."""
    n = F.col(tokens)
    return F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(F.lit(capacity)).cast("long")


def sequence_lengths(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Per sequence: sequence_id, n_pieces, n_tokens and padded (its length with padding)."""
    sums = pieces.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("n_tokens"))
    return sums.withColumn("padded", padded_length("n_tokens", capacity))


def packed_sequences(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, least: int = 1, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens and ids, padded with pad_id; at most `capacity` pieces meet in a group."""
    pieces = stored(pack_documents(docs, vocabulary, capacity, end_id, least, with_ids=True), "harmonic-pieces")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
    padding = F.array_repeat(F.lit(pad_id), (padded_length("n_tokens", capacity) - F.col("n_tokens")).cast("int"))
    return whole.select("sequence_id", "n_tokens", F.concat("ids", padding).alias("ids"))
