"""Substring deduplication by a log-structured index of window fingerprints.

A window is ``width`` consecutive words. Each task turns its documents into sorted, immutable runs: for every block of the
fingerprint space one row of packed, ascending fingerprints, each with the smallest document of the task that has it. Only
that document still has to be looked up; for the task's other documents with the window the verdict is known at once. So a
passage that a third of all rows share enters the index once per run and not once per row.

A block's runs, those of earlier batches from ``history`` with those of the new batch, are merge-joined; a window of the new
batch is a repeat if any run has its fingerprint under a smaller id. Fingerprints are 64 bits of one hash, verified by 8
more bits of another. ``compacted`` folds all runs into one whose entries keep the smallest document.

Verdicts go back to their documents by id, and each word under a repeated window is removed. Verdicts are judged on the
input alone, so the order of tasks doesn't matter.

Nulls: a null text has no words; a null id counts as larger than all others. Rows of one id never repeat each other.
An empty table gives an empty result; other columns are ignored. Texts of under ``width`` words are kept whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import chunks, partitions_for, utf8
from gridloom.llm.shingles import mixed, window_hashes, window_places, word_hashes

NO_ID = np.int64(2**63 - 1)
BLOCK_BYTES = 12e6  # of text, for each block of the fingerprint space
CHUNK_BYTES = 8 << 20

#: Rows of negative blocks -1 - b hold verdicts for the documents of bucket b: which of their fingerprints are repeats.
RUNS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("new", T.BooleanType()), T.StructField("payload", T.BinaryType())])
RUNS_ARROW = pa.schema([("block", pa.int32()), ("new", pa.bool_()), ("payload", pa.binary())])


def packed(prints: np.ndarray, check: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> bytes:
    """Ascending fingerprints as differences of their upper 56 bits in 5 bytes each (8 if one needs more), their lower byte, the check byte and a document number."""
    upper = prints >> np.uint64(8)
    steps = np.diff(upper, prepend=np.uint64(0))
    first = int(upper[0]) if len(upper) else 0
    steps[:1] = 0
    wide = bool(len(steps) and int(steps.max()) >= 1 << 40)
    columns = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 if wide else 5]
    used, number = np.unique(doc, return_inverse=True)
    short = len(used) <= 65536
    table = zlib.compress(np.diff(ids[used], prepend=np.int64(0)).astype("<i8").tobytes(), 1)
    head = np.array([len(prints), first, wide, short, len(table)], "<u8").tobytes()
    return head + table + columns.T.tobytes() + (prints & np.uint64(255)).astype(np.uint8).tobytes() + check.tobytes() + number.astype("<u2" if short else "<u4").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, check bytes, document ids) of a packed run."""
    n, first, wide, short, table = (int(x) for x in np.frombuffer(data, "<u8", 5))
    at = 40
    ids = np.cumsum(np.frombuffer(zlib.decompress(data[at : at + table]), "<i8"))
    at += table
    w = 8 if wide else 5
    columns = np.zeros((n, 8), np.uint8)
    columns[:, :w] = np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T
    at += n * w
    upper = columns.view("<u8").ravel().astype(np.uint64)
    if n:
        upper[0] = first
    low, check = np.frombuffer(data, np.uint8, n, at), np.frombuffer(data, np.uint8, n, at + n)
    number = np.frombuffer(data, "<u2" if short else "<u4", n, at + 2 * n)
    return np.cumsum(upper) << np.uint64(8) | low, check, ids[number]


def verdicts(doc: np.ndarray, prints: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, documents with how many fingerprints each and these), for each bucket of documents."""
    bucket = ((mixed(doc.view(np.uint64)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((doc, bucket))
    doc, prints, bucket = doc[order], prints[order], bucket[order]
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(doc)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            own, n = np.unique(doc[a:b], return_counts=True)
            yield int(bucket[a]), np.array([len(own)], "<i8").tobytes() + own.tobytes() + n.astype("<u4").tobytes() + prints[a:b].tobytes()


def gathered(table: pa.Table) -> pa.Table:
    """(doc, prints) of one bucket's verdicts, a row for each document."""
    docs, prints = [], []
    for data in table["payload"].to_pylist():
        n = int(np.frombuffer(data, "<i8", 1)[0])
        docs.append(np.repeat(np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<u4", n, 8 + 8 * n)))
        prints.append(np.frombuffer(data, np.uint64, -1, 8 + 12 * n))
    doc, prints = np.concatenate(docs), np.concatenate(prints)
    order = np.argsort(doc, kind="stable")
    own, starts = np.unique(doc[order], return_index=True)
    return pa.table({"doc": pa.array(own, pa.int64()), "prints": pa.array([x.tobytes() for x in np.split(prints[order], starts[1:])], pa.binary())})


def smallest(prints: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts entries by fingerprint, and for each entry in it the smallest document with the same fingerprint and check."""
    order = np.argsort(prints, kind="stable")
    p, c, d = prints[order], check[order], doc[order]
    same = p[1:] == p[:-1]
    if (odd := np.flatnonzero(same & (c[1:] != c[:-1]))).size:  # equal fingerprints of different windows
        order = np.lexsort((check, prints))
        p, c, d = prints[order], check[order], doc[order]
        same = (p[1:] == p[:-1]) & (c[1:] == c[:-1])
    if not len(p):
        return order, d
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    return order, np.repeat(np.minimum.reduceat(d, starts), np.diff(starts, append=len(p)))


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RUNS_ARROW)], schema=RUNS_ARROW)


def runs(docs: DataFrame, width: int, blocks: int) -> DataFrame:
    """Sorted runs of the documents' windows, and what verdicts each task already knows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            ids = np.array([NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            by_id = np.argsort(ids, kind="stable")
            ids, texts = ids[by_id], utf8(batch.column("text").take(pa.array(by_id)))
            words = [t.split() for t in texts]
            lengths = np.array([len(w) for w in words], np.int64)
            hashes = word_hashes([w for ws in words for w in ws])
            del texts, words
            places, owner = window_places(lengths, width)
            prints = window_hashes(hashes, width)[places]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
            check = ((total[places + width] - total[places]) >> np.uint64(56)).astype(np.uint8)
            order, least = smallest(prints, check, ids[owner])
            prints, check, owner = prints[order], check[order], owner[order]
            own = ids[owner]
            later = own > least
            out = [(-1 - b, True, payload) for b, payload in verdicts(own[later], prints[later], blocks)]
            once = np.concatenate([[True], (prints[1:] != prints[:-1]) | (check[1:] != check[:-1])])[: len(prints)]
            # the first of each group stands for it, under the group's smallest id
            prints, check, least = prints[once], check[once], least[once]
            number = np.searchsorted(ids, least)
            block = ((prints >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(block, np.arange(blocks + 1))
            for b in np.flatnonzero(np.diff(edges)):
                cut = slice(edges[b], edges[b + 1])
                out.append((int(b), True, packed(prints[cut], check[cut], number[cut], ids)))
            if out:
                yield rows_of(out)

    return docs.select("doc_id", "text").mapInArrow(task, RUNS)


def merger(blocks: int):
    def merged(table: pa.Table) -> pa.Table:
        """Of one block: the verdicts on the new batch, by bucket; what is a verdict already passes."""
        block, new, payload = (table[c].to_pylist() for c in ("block", "new", "payload"))
        told = [(-1 - b, p) for b, p in zip(block, payload, strict=True) if b < 0]
        entries = [(n, *unpacked(p)) for b, n, p in zip(block, new, payload, strict=True) if b >= 0]
        if len(entries) > 1:
            prints, check, doc = (np.concatenate([e[i] for e in entries]) for i in (1, 2, 3))
            new = np.repeat([e[0] for e in entries], [len(e[1]) for e in entries])
            order, least = smallest(prints, check, doc)
            later = (doc[order] > least) & new[order]
            told += list(verdicts(doc[order][later], prints[order][later], blocks))
        return pa.table({"bucket": pa.array([b for b, _ in told], pa.int32()), "payload": pa.array([p for _, p in told], pa.binary())})

    return merged


def compacted(all_runs: DataFrame) -> DataFrame:
    """One run per block of all runs, the smallest document for each fingerprint; it takes their place in the index."""

    def fold(table: pa.Table) -> pa.Table:
        entries = [unpacked(p) for p in table["payload"].to_pylist()]
        prints, check, doc = (np.concatenate([e[i] for e in entries]) for i in range(3))
        order, least = smallest(prints, check, doc)
        prints, check = prints[order], check[order]
        once = np.concatenate([[True], (prints[1:] != prints[:-1]) | (check[1:] != check[:-1])])[: len(prints)]
        ids, number = np.unique(least[once], return_inverse=True)
        return rows_of_table([(table["block"][0].as_py(), False, packed(prints[once], check[once], number, ids))])

    return all_runs.where("block >= 0").groupBy("block").applyInArrow(fold, RUNS)


def rows_of_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([rows_of(rows)])


def blocks_for(docs: DataFrame) -> int:
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(partitions_for(docs.sparkSession, total, BLOCK_BYTES), 2**31 - 1)


def repeats(docs: DataFrame, width: int = 13, history: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """(doc, prints): the repeated fingerprints of each document that has any. ``history`` has runs made with the same ``blocks``."""
    blocks = blocks or blocks_for(docs)
    all_runs = runs(docs, width, blocks)
    if history is not None:
        all_runs = all_runs.unionByName(history.where("block >= 0").withColumn("new", F.lit(False)))
    told = all_runs.groupBy("block").applyInArrow(merger(blocks), "bucket int, payload binary")
    return told.groupBy("bucket").applyInArrow(gathered, "doc bigint, prints binary")


def removed(docs: DataFrame, width: int = 13, history: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) for every row; ``kept`` is the remaining words joined by a space."""
    found = repeats(docs, width, history, blocks)
    joined = docs.select("doc_id", "text").join(found, F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("doc"), "left").select("doc_id", "text", "prints")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            rows = []
            for doc_id, text, prints in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("prints").to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                if prints:
                    dup = np.isin(window_hashes(word_hashes(words), width), np.frombuffer(prints, np.uint64))
                    edge = np.zeros(n + 1, np.int64)
                    at = np.flatnonzero(dup)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                kept = b" ".join(words)
                rows.append((doc_id, n, n - len(words), kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64()))] + [pa.array([r[3] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[4] for r in rows])], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return joined.mapInArrow(task, "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
