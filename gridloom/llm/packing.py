"""Harmonic packing of tokenised documents into fixed-capacity sequences.

A document is cut into pieces whose lengths fall into reciprocal-capacity classes: class k holds
lengths above capacity/(k+1) and up to capacity/k, and each of its bins takes exactly k pieces.
Because documents may be cut freely, long remainders are cut to the exact sizes capacity/1, /2, /4, ...
(classes without any padding) and only what is below ``smallest_cut`` enters a class as it is.
Every task packs its own rows and needs no exchange; when its rows end, the pieces of its unfilled bins
are packed together first-fit by falling length.

Nulls: a null text is empty and yields one piece with the end id alone; a null doc_id is passed on.
Repeated rows are packed once each. An empty table yields no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.common import chunks, small_batches, strings

END_ID = 0

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("piece_class", T.IntegerType()),
    T.StructField("ids", T.BinaryType()),
])


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder(dict):
    """Ids (little-endian unsigned 32-bit) of a space and the word after it, kept for words seen before.

    In a byte-level tokenizer's splitting pattern a single space always begins a new pre-token, so a text may be
    encoded piece by piece between single spaces; anything else that is white space goes to the tokenizer together
    with its neighbours. A word of letters alone is one pre-token, and its merges run without the splitting pattern.
    At most ``most_kept`` words are held; how many changes no result.
    """

    def __init__(self, path: str, most_kept: int = 100_000):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_kept = most_kept
        told = json.loads(self.tokenizer.to_str())
        self.whole = (told["pre_tokenizer"] or {}).get("type") != "ByteLevel" or bool(told["normalizer"])  # then only whole texts are encoded
        added, of = {x["content"] for x in told["added_tokens"]}, byte_characters()
        ranks = {} if self.whole else {bytes(map(of.__getitem__, w)): i for w, i in told["model"]["vocab"].items() if w not in added}
        self.merge = None if self.whole else tiktoken.Encoding("piece", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise LookupError(word)
        if word.isalpha():
            ids = array("I", self.merge((" " + word).encode())).tobytes()
        elif word[-1] in ".," and word[:-1].isalpha():
            return self[word[:-1]] + array("I", self.merge(word[-1].encode())).tobytes()
        else:
            ids = self.encode(" " + word)
        if len(word) <= 64:
            if len(self) >= self.most_kept:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.whole:
            return self.encode(text)
        words = text.split(" ")
        try:  # the usual text: words with single spaces between
            return self.encode(words[0]) + b"".join(map(self.__getitem__, words[1:]))
        except LookupError:
            pass
        out, held = [], words[0]  # held: the text since the last place where it may be cut
        for word in words[1:]:
            if held and not held[-1].isspace() and word and not word[0].isspace():
                out.append(self[held[1:]] if out and held[0] == " " and not held[1].isspace() else self.encode(held))
                held = " " + word
            else:
                held += " " + word
        out.append(self.encode(held))
        return b"".join(out)


def cut(n: int, capacity: int, smallest_cut: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids, all of them positive."""
    out, k = [capacity] * (n // capacity), 2
    n %= capacity
    while n and capacity % k == 0 and capacity // k >= smallest_cut:
        if n >= (size := capacity // k):
            out.append(size)
            n -= size
        k *= 2
    return out + [n] * (n > 0)


class Bins:
    """Bins of one task. ``put`` returns the piece's sequence and offset once they are known, for itself and those that waited."""

    def __init__(self, task: int, capacity: int):
        self.base, self.capacity, self.next = task << 36, capacity, 0
        self.waiting: dict[int, list[tuple]] = {}

    def sequence(self, pieces: list[tuple]) -> list[tuple]:
        out, offset, number = [], 0, self.base + self.next
        self.next += 1
        for piece in pieces:
            out.append((*piece, number, offset))
            offset += piece[2]
        return out

    def put(self, piece: tuple) -> list[tuple]:
        """piece: (doc_id, start, length, ...)."""
        k = self.capacity // piece[2]
        held = self.waiting.setdefault(k, [])
        held.append(piece)
        return self.sequence(self.waiting.pop(k)) if len(held) == k else []

    def rest(self) -> list[tuple]:
        """Pieces of unfilled bins, first-fit by falling length."""
        bins: list[list] = []  # free length, pieces
        for piece in sorted((x for held in self.waiting.values() for x in held), key=lambda x: -x[2]):
            for b in bins:
                if b[0] >= piece[2]:
                    b[0] -= piece[2]
                    b[1].append(piece)
                    break
            else:
                bins.append([self.capacity - piece[2], [piece]])
        self.waiting = {}
        return [row for _, pieces in bins for row in self.sequence(pieces)]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, smallest_cut: int = 128, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places in sequences; ``ids`` is null unless ``keep_ids``."""
    if capacity < 1 or smallest_cut < 1:
        raise ValueError("capacity and smallest_cut must be positive")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, bins = Encoder(tokenizer_path), Bins(TaskContext.get().partitionId(), capacity)
        end = array("I", [END_ID]).tobytes()

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([x[i] for x in placed], kind) for i, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()), (7, pa.int64()), (8, pa.int64()), (5, pa.int32()), (6, pa.binary()))
            ], names=SCHEMA.names)

        for batch in chunks(batches, "text", 1 << 20):
            placed: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True):
                ids = encoder.ids(text) + end
                total, start = len(ids) // 4, 0
                for n in cut(total, capacity, smallest_cut):
                    piece = ids[4 * start : 4 * (start + n)]
                    placed += bins.put((doc_id, start, n, zlib.crc32(piece), total, capacity // n, piece if keep_ids else None))
                    start += n
            yield rows(placed)
        yield rows(bins.rest())

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)
