"""Operator 5: token ids in bit- or byte-plane files.

Documents are dealt by ranges of doc_id and encoded in that order; each range is a shard, a run of ids cut into
blocks of BLOCK ids. A block is transposed into planes (byte k, or bit k, of all its ids), each plane is compressed
with zstandard, and the blocks' table carries a chunk index: where each block and each document in it begins.
Spark's Parquet writer commits the table, so a lost executor leaves no half-written file, and any store will do.

Defined results: null and empty texts have the end id alone; repeated rows are written as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.llm.chunks import library_coder
from lumenreel.llm.common import as_documents, slices

BLOCK = 1 << 16
SCHEMA = (
    "shard int, block int, first_id long, n_ids int, kind string, planes array<binary>, "
    "docs array<struct<doc_id:long,shard_start:long,n_tokens:long,at:int,length:int>>"
)


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The compressed planes of one block of uint32 ids, lowest first; planes above the highest set one are left out."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        wide = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
        planes = [wide[:, k].tobytes() for k in range((top + 7) // 8)]
    elif kind == "bit":
        planes = [np.packbits((ids >> np.uint32(k)) & np.uint32(1) != 0).tobytes() for k in range(top)]
    else:
        raise ValueError(f"kind is byte or bit, not {kind}")
    press = zstandard.ZstdCompressor(level=3)
    return [press.compress(p) for p in planes]


def from_planes(planes: list[bytes], n_ids: int, kind: str = "byte") -> np.ndarray:
    ids = np.zeros(n_ids, np.uint32)
    press = zstandard.ZstdDecompressor()
    for k, plane in enumerate(planes):
        raw = np.frombuffer(press.decompress(plane), np.uint8)
        if kind == "byte":
            ids |= raw.astype(np.uint32) << np.uint32(8 * k)
        else:
            ids |= np.unpackbits(raw, count=n_ids).astype(np.uint32) << np.uint32(k)
    return ids


_DOC = pa.struct([("doc_id", pa.int64()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("at", pa.int32()), ("length", pa.int32())])


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, kind: str = "byte", block: int = BLOCK) -> None:
    """Encode every document, append end_id, and write the blocks in ascending doc_id order to `path`."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = library_coder(vocabulary, True), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        entries: list[tuple] = []  # doc_id, start in the shard, tokens in all
        size = begin = number = 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal held, entries, size, begin, number
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            own, rest = ids[:n], ids[n:]
            inside = [(d, s, t, max(s - begin, 0), min(s + t, begin + n) - max(s, begin)) for d, s, t in entries if s < begin + n]
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([begin], pa.int64()),
                    pa.array([n], pa.int32()),
                    pa.array([kind]),
                    pa.array([to_planes(own, kind)], pa.list_(pa.binary())),
                    pa.array([[dict(zip(("doc_id", "shard_start", "n_tokens", "at", "length"), x, strict=True)) for x in inside]], pa.list_(_DOC)),
                ],
                ["shard", "block", "first_id", "n_ids", "kind", "planes", "docs"],
            )
            entries = [x for x in entries if x[1] + x[2] > begin + n]
            held, size, begin, number = [rest], len(rest), begin + n, number + 1
            return row

        total = 0
        for part in slices(batches):
            ids = coder.ids(part.column("text").to_pylist(), end_id)
            for d, x in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                entries.append((d, total, len(x)))
                held.append(x)
                total += len(x)
                size += len(x)
                while size >= block:
                    yield cut(block)
        if size:
            yield cut(size)

    ordered = as_documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, SCHEMA).write.option("compression", "uncompressed").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """Per block: shard, block, first_id in the whole corpus, n_ids, number of planes and compressed bytes."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    return blocks.join(F.broadcast(_shard_starts(blocks)), "shard").select(
        "shard", "block", (F.col("first_id") + F.col("before")).alias("first_id"), "n_ids", F.size("planes").alias("n_planes"),
        F.aggregate("planes", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p)).alias("bytes"),
    )


def _shard_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard; one row a shard, so the ordering window holds as many rows as tasks wrote."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    return sizes.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of documents as stored: doc_id, shard, shard_start, n_tokens, block, at, length and ids of the piece."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n_ids"], row["kind"])
                docs = row["docs"]
                lengths = [d["length"] for d in docs]
                flat = np.concatenate([ids[d["at"] : d["at"] + d["length"]] for d in docs]) if docs else ids[:0]
                fixed = {c: pa.array([row[c]] * len(docs), pa.int32()) for c in ("shard", "block")}
                own = {c: pa.array([d[c] for d in docs], pa.int64()) for c in ("doc_id", "shard_start", "n_tokens")}
                at = {c: pa.array([d[c] for d in docs], pa.int32()) for c in ("at", "length")}
                listed = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), flat.astype(np.int32))
                yield pa.RecordBatch.from_pydict(fixed | own | at | {"ids": listed})

    blocks = spark.read.schema(SCHEMA).parquet(path).select("shard", "block", "n_ids", "kind", "planes", "docs")
    return blocks.mapInArrow(unpack, "shard int, block int, doc_id long, shard_start long, n_tokens long, at int, length int, ids array<int>")


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


def join_crc(first: int, second: int, n_second: int) -> int:
    """CRC-32 of two byte runs behind each other, from the CRC-32 of each and the length of the second.

    Appending a zero bit is a linear map over GF(2); its powers by squaring give the shift by the second run.
    """
    one_bit = [0xEDB88320] + [1 << k for k in range(31)]
    n, power = n_second * 8, one_bit
    while n:
        if n & 1:
            first = _times(power, first)
        n >>= 1
        power = [_times(power, x) for x in power]
    return first ^ second


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n_ids"], row["kind"]).astype("<u4")
                docs = row["docs"]
                data = {c: pa.array([d[c] for d in docs], pa.int64()) for c in ("doc_id", "shard_start", "n_tokens", "length")}
                crc = [zlib.crc32(ids[d["at"] : d["at"] + d["length"]].tobytes()) for d in docs]
                fixed = {c: pa.array([row[c]] * len(docs), pa.int32()) for c in ("shard", "block")}
                yield pa.RecordBatch.from_pydict(fixed | data | {"crc": pa.array(crc, pa.int64())})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for pieces in batch.column("pieces").to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = join_crc(crc, p["crc"], 4 * p["length"])
                values.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "shard", "shard_start", "n_tokens")] + [pa.array(values, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "crc"])

    blocks = spark.read.schema(SCHEMA).parquet(path)
    pieces = blocks.select("shard", "block", "n_ids", "kind", "planes", "docs").mapInArrow(
        digest, "shard int, block int, doc_id long, shard_start long, n_tokens long, length long, crc long"
    )
    names = ("doc_id", "shard", "shard_start", "n_tokens", "crc")
    within = pieces.where("length = n_tokens").select(*names)
    across = (
        pieces.where("length < n_tokens")
        .groupBy("doc_id", "shard", "shard_start", "n_tokens")
        .agg(F.sort_array(F.collect_list(F.struct("block", "length", "crc"))).alias("pieces"))
        .mapInArrow(joined, "doc_id long, shard int, shard_start long, n_tokens long, crc long")
    )
    return (
        within.unionByName(across)
        .join(F.broadcast(_shard_starts(blocks)), "shard")
        .select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))
    )
