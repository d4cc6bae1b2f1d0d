"""Operator 7: secret scans with an incremental blob ledger.

Every version of every document is a blob, named by the SHA-256 of its text; rows that repeat a doc_id are its versions.
The ledger is a Parquet table at a path of the user's choice. It holds the pairs of blob and rule version that have
been scanned, with their findings. A run scans one copy of each blob whose pair isn't in the ledger, appends what it
found, and joins findings back to every document (path) that holds the blob. A later run on the same path, or one that
goes on where another broke off, scans only what is new.

Defined results: a null text is the empty blob; repeated rows are joined back as often as they occur; a pair that two
runs appended at once counts once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import as_documents, scratch_path, slices, span_string

RULE_VERSION = "1"
#: The kinds of the contract, in its order, and their least lengths.
BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds beyond the contract: private key blocks, signed web tokens, provider tokens, passwords in addresses.
MORE = {
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]*PRIVATE KEY-----"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    "provider": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"),
    "address": re.compile(r"://[^\s:/@]+:[^\s:/@]{3,}@[^\s/]+"),
}
#: The scheme before an address, read from its end.
_SCHEME = re.compile(r"[a-z0-9+.-]+", re.ASCII)
_HINT = {"pem": "-----BEGIN", "jwt": "eyJ", "address": "://"}
_ORDER = {k: i for i, k in enumerate((*BASE_KINDS, *MORE))}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Contract spans by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]]))


def all_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    more = [(k, m.start(), m.end()) for k, p in MORE.items() if _HINT.get(k, "") in text for m in p.finditer(text)]
    if more:
        more = [(k, _scheme_start(text, a) if k == "address" else a, b) for k, a, b in more]
    return sorted(base + [s for s in more if s[1] >= 0], key=lambda s: (s[1], _ORDER[s[0]])) if more else base


def _scheme_start(text: str, end: int) -> int:
    """Where the scheme that ends at `end` begins (at a letter), or -1 without one."""
    start = end
    while start and _SCHEME.match(text[start - 1]):
        start -= 1
    while start < end and not "a" <= text[start] <= "z":
        start += 1
    return start if start < end else -1


FINDINGS = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_blobs(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """The findings of blobs (columns blob and text), one row each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                base = base_spans(text)
                kinds = [s[0] for s in base]
                rows.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(span_string(base).encode()).hexdigest(), span_string(all_spans(text, base))))
            columns = list(zip(*rows, strict=True))
            kept = [part.column("blob"), pa.array([rule_version] * len(rows), pa.string())]
            kept += [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.string()) for c in columns[3:]]
            yield pa.RecordBatch.from_arrays(kept, ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return blobs.select("blob", "text").mapInArrow(scan, FINDINGS)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at the path; empty where there is none yet."""
    try:
        found = spark.read.schema(FINDINGS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # not made from Python rows, which would start a second set of Python workers beside that of the scans
        return spark.range(0).select(*(F.lit(None).cast(kind).alias(c) for c, kind in (f.split() for f in FINDINGS.split(", "))))
    return found


def update_ledger(docs: DataFrame, path: str, rule_version: str = RULE_VERSION) -> tuple[DataFrame, int]:
    """Scan what the ledger at the path lacks and append it. Returns the paths (doc_id, blob) and the number of pairs scanned."""
    texts = as_documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    paths = texts.select("doc_id", F.sha2("text", 256).alias("blob"))
    seen = read_ledger(docs.sparkSession, path).where(F.col("rule_version") == rule_version).select("blob")
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen, "blob", "left_anti")
    # The doc_id and the blob together name the copy, also where a doc_id has several versions.
    named = texts.withColumn("own", F.sha2("text", 256))
    on = named["doc_id"].eqNullSafe(blobs["doc_id"]) & (named["own"] == blobs["blob"])
    unseen = named.join(blobs.hint("shuffle_merge"), on).select("blob", "text")
    scanned = Observation()
    fresh = scan_blobs(unseen, rule_version).dropDuplicates(["blob"]).observe(scanned, F.count(F.lit(1)).alias("n"))
    fresh.write.mode("append").parquet(path)
    return paths, scanned.get["n"]


def findings(docs: DataFrame, path: str, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """The ledger's findings of one rule version, one row a blob, once it is up to date with docs; and the paths (doc_id, blob)."""
    paths, _ = update_ledger(docs, path, rule_version)
    known = read_ledger(docs.sparkSession, path).where(F.col("rule_version") == rule_version).drop("rule_version")
    return known.dropDuplicates(["blob"]), paths


def scan_documents(docs: DataFrame, path: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document. Without a path the ledger is a new one."""
    known, paths = findings(docs, path or scratch_path(docs.sparkSession, "ledger"), rule_version)
    return paths.join(known, "blob").drop("blob")


def masked_documents(docs: DataFrame, path: str | None = None, mask: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced by the mask; overlapping spans are one. All columns stay.

    n_chars, if it is a column, follows the text of a document that is changed.
    """
    columns = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = batch.column("row"), batch.column("spans").to_pylist()
            data = {c: rows.field(k) for k, c in enumerate(columns)}
            hit = [k for k, s in enumerate(spans) if s]
            if hit:
                texts = data["text"].to_pylist()
                for k in hit:
                    texts[k] = masked(texts[k], spans[k], mask)
                data["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    counts = data["n_chars"].to_pylist()
                    for k in hit:
                        counts[k] = len(texts[k])
                    data["n_chars"] = pa.array(counts, data["n_chars"].type)
            yield pa.RecordBatch.from_pydict(data)

    known, _ = findings(docs, path or scratch_path(docs.sparkSession, "ledger"))
    dirty = known.where(F.col("spans") != "").select("blob", "spans")
    packed = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    return packed.join(dirty, "blob", "left").select("row", "spans").mapInArrow(rewrite, docs.schema)


def masked(text: str, spans: str, mask: str) -> str:
    out, end = [], 0
    for a, b in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(","))):
        if a >= end:
            out += [text[end:a], mask]
        end = max(end, b)
    return "".join(out) + text[end:]
