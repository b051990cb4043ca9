"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every document is addressed by the SHA-256 of its text. The ledger, a Parquet table, holds what each
(blob, rule version) pair was found to contain, nothing included. A run scans only pairs that the ledger lacks, each
blob once however many rows hold it, appends what it found, and joins findings back to all rows by their blob.
A native regular expression that every rule's match satisfies decides which texts reach the scanner at all, so that
only those cross an exchange. The join's hot side (one text in many rows) is a sort-merge join that adaptive execution splits.

Nulls: a null text is an empty one; null ids are passed on. Repeated rows get repeated results. Spans that start together are
ordered by kind. A very long text is scanned in one piece, in a batch of its own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, scratch_path, strings, written

#: Kinds in the order that ties of ``start`` follow; the first three are the base ones.
BASE = ("assign", "access", "hex")
#: kind -> (pattern, least length of the match, group that must have at least six characters or 0)
RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 0, 2),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    "hex": (re.compile(r"[0-9a-f]+"), 24, 0),
    "pem": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?"), 0, 0),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 0),
    "forge": (re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})"), 0, 0),
}
#: A number that changes with any rule.
RULE_VERSION = zlib.crc32("\n".join(f"{kind} {pattern.flags} {pattern.pattern} {least} {group}" for kind, (pattern, least, group) in RULES.items()).encode())
#: Java's pattern for texts that may hold any match of RULES.
MAYBE = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|-----BEGIN |eyJ[A-Za-z0-9_-]{8}|gh[pousr]_[A-Za-z0-9]{36}|glpat-|xox[abprs]-"""
#: The same test for one rule's long runs is done by repeating its class, which a search can reject faster.
FAST = RULES | {"access": (re.compile(r"AKIA[A-Z0-9]{16,}"), 20, 0), "hex": (re.compile(r"[0-9a-f]{24,}"), 24, 0)}

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans in code points, end exclusive, by start and then by kind as listed."""
    out = []
    for order, (kind, (pattern, least, group)) in enumerate(FAST.items()):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least and (not group or len(m[group]) >= 6):
                out.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Ledger rows of (blob, text) rows; a null text stands for one that MAYBE rules out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] if t else [] for t in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, SPANS_ARROW)], names=["blob", "spans"])

    return blobs.select("blob", "text").mapInArrow(task, f"blob binary, spans {SPANS}").withColumn("rule_version", F.lit(RULE_VERSION).cast("long"))


def seen(docs: DataFrame, ledger: str) -> DataFrame | None:
    """(blob, spans) of the ledger under these rules, each blob once; None if there is no ledger yet."""
    try:
        rows = docs.sparkSession.read.parquet(ledger).where(F.col("rule_version") == RULE_VERSION)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.groupBy("blob").agg(F.max("spans").alias("spans"))


def scan(docs: DataFrame, ledger: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, blob, spans) of all rows of ``docs``; the ledger at that path is extended by what it lacks."""
    ledger = ledger or scratch_path(docs.sparkSession, "ledger")
    text = F.coalesce("text", F.lit(""))
    blob = F.unhex(F.sha2(text, 256))
    blobs = docs.select(blob.alias("blob"), F.when(text.rlike(MAYBE), text).alias("text")).groupBy("blob").agg(F.max("text").alias("text"))
    if (known := seen(docs, ledger)) is not None:
        blobs = blobs.join(known.select("blob"), "blob", "left_anti")
    scan_blobs(blobs).write.mode("append").parquet(ledger)
    found = seen(docs, ledger).where(F.size("spans") > 0).select("blob", "spans")
    return docs.select(key, blob.alias("blob")).join(found, "blob", "left").select(key, "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))


def masked(text: str, spans: list[dict], mark: str) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans are replaced as one, n_chars follows the text."""
    text = F.coalesce("text", F.lit(""))
    found = scan(docs, ledger).where(F.size("spans") > 0).select("doc_id", "blob", "spans")
    ids = written(found.select(F.col("doc_id").alias("_gl_id"), F.col("blob").alias("_gl_blob"), F.col("spans").alias("_gl_spans")).dropDuplicates(["_gl_id", "_gl_blob"]), "found")
    # the table's size is known, so that a small one is broadcast and a large one isn't
    joined = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_gl_id")) & (F.unhex(F.sha2(text, 256)) == F.col("_gl_blob")), "left")
    names = docs.columns
    clean = joined.where(F.col("_gl_spans").isNull()).select(names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2 << 20):
            texts = [masked(t, spans, mark) for t, spans in zip(strings(batch.column("text")), batch.column("_gl_spans").to_pylist(), strict=True)]
            at = {n: i for i, n in enumerate(batch.schema.names)}
            columns = [pa.array(texts, pa.string()) if c == "text" else pa.array(list(map(len, texts)), batch.column(at[c]).type) if c == "n_chars" else batch.column(at[c]) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    hit = joined.where(F.col("_gl_spans").isNotNull()).select(*names, "_gl_spans").mapInArrow(task, docs.schema)
    return clean.union(hit)
