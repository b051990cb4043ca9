"""Logistic mixing of hashed-context bit predictors over the words of whole texts.

A token is coded bit by bit: its code is a path in a Huffman tree over the commonest tokens, whose last leaf stands for all others. Five predictors say how likely a one is:
the node alone, the node in texts of one kind, and the node after the last one, two and three tokens. Each has counts of zeros and ones in a hashed table, taken from every occurrence in
all training texts. Their logits are combined by weights that two gates choose (how often the last two and three tokens were seen; how often the last one was, and the place of the bit), and
an adaptive map, indexed by the first gate and the mixed probability, refines the result. Weights and map are learned online in one pass over all training texts, by partition, every bit
without its own count; weights are averaged by bits, and maps summed. When texts are scored the model stands still.

Tokens are numbers in the tree; the last is the leaf of all others. Tables have a fixed size.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import chunks, packed, unpacked, written

TABLE_BITS = (18, 21, 22, 22, 22)  # of the node alone, with the kind, and after one, two and three tokens
STARTS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])])
BLOCK = 1 << 17  # counters in a row of an exchange
TASKS = 6  # that count or learn side by side, at least
TAUGHT = 10_000_000  # tokens of each, about
COUNTERS = 64  # and at most; so many tables are added for each block
CHUNK = 1 << 18  # bytes of numbers at a time
WINDOW = 8192  # tokens whose bits are at hand at once
LEVELS = 10  # of how often a context was seen
PLACES = 16
MAP_CELLS = 33
STEP = 0.1
PRIOR = 0.4  # zeros and ones that a context has before any is counted: what was seen once is weighed by its gates, which learn how much it says
#: Counts as one byte: exact up to 63, then in steps of about 14 per cent.
COUNTS = np.concatenate([np.arange(64), 63 * (1e13 / 63) ** (np.arange(1, 193) / 192)]).astype(np.float32)


def looked_up(own: int | None) -> tuple[np.ndarray, np.ndarray]:
    """By the codes of both counts of a slot, zeros in the lower byte: the logit, and the level of their sum; without one bit ``own``, if given."""
    codes = np.arange(1 << 16)
    zeros, ones = COUNTS[codes & 255], COUNTS[codes >> 8]
    if own is not None:
        zeros, ones = np.maximum(zeros - (1 - own), 0), np.maximum(ones - own, 0)
    seen = zeros + ones
    return (np.log((ones + PRIOR) / (zeros + PRIOR)) * (seen > 0)).astype(np.float32), np.minimum(np.ceil(np.log2(seen + 1)), LEVELS - 1).astype(np.uint8)


#: Without an own zero, without an own one, and in full.
LOGITS, LEVEL = (np.concatenate(x) for x in zip(looked_up(0), looked_up(1), looked_up(None), strict=True))


@dataclass
class Codes:
    """Of each token: where its path begins, and its bits; the paths are nodes times two plus the bit."""

    start: np.ndarray
    length: np.ndarray
    path: np.ndarray

    def __getstate__(self) -> dict:
        """Small to send, and on the disks of all executors."""
        return {"start": self.start, "length": self.length.astype(np.uint8), "path": zlib.compress(self.path.tobytes(), 1)}

    def __setstate__(self, x: dict) -> None:
        self.start, self.length, self.path = x["start"], x["length"].astype(np.int64), np.frombuffer(zlib.decompress(x["path"]), np.int32)

    @staticmethod
    def of(counts: np.ndarray) -> Codes:
        """Huffman codes of the tokens, by their counts; ties go by number."""
        n = len(counts)
        heap = [(int(c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side, made = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64), n
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i], parent[j], side[j] = made, made, 1
            heapq.heappush(heap, (a + b, made))
            made += 1
        root = made - 1
        at, own, depth = np.arange(n), np.arange(n), 0
        owners, depths, steps = [], [], []
        while len(at := at[keep := at != root]):
            own = own[keep]
            owners.append(own)
            depths.append(np.full(len(own), depth))
            steps.append((parent[at] - n) * 2 + side[at])
            at, depth = parent[at], depth + 1
        if not owners:
            return Codes(np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(0, np.int32))
        owners, depths, steps = (np.concatenate(x) for x in (owners, depths, steps))
        length = np.bincount(owners, minlength=n)
        order = np.lexsort((-depths, owners))  # from the root down
        return Codes(np.cumsum(length) - length, length, steps[order].astype(np.int32))


def before(ids: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """One more than the token k places earlier in the same text; 0 before its start."""
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(starts, append=len(ids)))
    out = np.zeros(len(ids), np.uint32)
    out[k:] = ids[:-k] + 1 if k < len(ids) else 0
    out[place < k] = 0
    return out


@dataclass
class Model:
    codes: Codes
    table: np.ndarray  # (slot) x (zeros, ones), as places in COUNTS
    first: np.ndarray  # (levels of three and two tokens) x predictor
    second: np.ndarray  # (level of one token, place of the bit) x predictor
    map: np.ndarray  # (first gate, cell) x (ones, all)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": zlib.compress(self.table.tobytes(), 1)}

    def __setstate__(self, x: dict) -> None:
        self.__dict__.update(x, table=np.frombuffer(zlib.decompress(x["table"]), np.uint8).reshape(-1, 2))

    @staticmethod
    def fresh(codes: Codes) -> Model:
        k = len(TABLE_BITS)
        return Model(codes, np.zeros((int(STARTS[-1]), 2), np.uint8), np.full((LEVELS * LEVELS, k), 0.08, np.float32), np.full((LEVELS * PLACES, k), 0.08, np.float32), np.zeros((LEVELS * LEVELS * MAP_CELLS, 2)))

    def events(self, ids: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(token of each bit, bit, place of the bit, slots by predictor) of WINDOW tokens at a time; ``kinds``: of each text."""
        last, two, three = (before(ids, starts, k) for k in (1, 2, 3))
        kind = np.repeat(kinds.astype(np.uint32), np.diff(starts, append=len(ids)))
        pair = (last * np.uint32(0x9E3779B1)) ^ ((two + np.uint32(1)) * np.uint32(0x85EBCA77))
        pair ^= pair >> np.uint32(15)
        triple = (pair * np.uint32(0xC2B2AE3D)) ^ ((three + np.uint32(7)) * np.uint32(0x27D4EB2F))
        triple ^= triple >> np.uint32(13)
        contexts = ((kind + np.uint32(1)) * np.uint32(0x165667B1), last * np.uint32(0x85EBCA6B) + np.uint32(1), pair, triple)
        for low in range(0, len(ids), WINDOW):
            own = ids[low : low + WINDOW]
            length = self.codes.length[own]
            owner = np.repeat(np.arange(len(own)), length)
            place = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(length) - length).astype(np.int32), length)
            step = np.take(self.codes.path, np.repeat(self.codes.start[own].astype(np.int32), length) + place)
            node = (step >> 1).astype(np.uint32)
            slots = np.empty((len(TABLE_BITS), len(owner)), np.int32)
            slots[0] = node  # a tree has fewer nodes than the table
            node *= np.uint32(0x9E3779B1)
            node ^= node >> np.uint32(16)
            for i, context in enumerate(contexts, 1):
                h = np.repeat(context[low : low + WINDOW], length)
                h += node
                h *= np.uint32(0xC2B2AE35)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                h >>= np.uint32(32 - TABLE_BITS[i])
                h += np.uint32(STARTS[i])
                slots[i] = h
            yield owner + low, (step & 1).astype(np.int32), place, slots

    def predicted(self, slots: np.ndarray, place: np.ndarray, own: np.ndarray | int) -> tuple:
        """Logits by predictor, both gates, the mixed probability and the map's cell. ``own``: the bit whose own count is left out, 2 for none."""
        codes = np.take(self.table.view("<u2").ravel(), slots).astype(np.int32)
        codes += own << 16
        inputs = np.take(LOGITS, codes)
        one, two, three = (np.take(LEVEL, codes[k]) for k in (2, 3, 4))
        gate1, gate2 = three * np.int32(LEVELS) + two, one * np.int32(PLACES) + np.minimum(place, PLACES - 1)
        logit = np.zeros(len(place), np.float32)
        for x, first, second in zip(inputs, self.first.T.copy(), self.second.T.copy(), strict=True):
            weight = np.take(first, gate1)
            weight += np.take(second, gate2)
            weight *= x
            logit += weight
        np.clip(logit, -11, 11, out=logit)
        cell = gate1 * np.int32(MAP_CELLS) + np.round((logit + np.float32(11)) * np.float32((MAP_CELLS - 1) / 22)).astype(np.int32)
        return inputs, gate1, gate2, 1 / (1 + np.exp(-logit)), cell

    def learn(self, ids: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> int:
        total = 0
        for _, bit, place, slots in self.events(ids, starts, kinds):
            inputs, gate1, gate2, p, cell = self.predicted(slots, place, bit)
            wrong, sure = bit - p.astype(float), p * (1 - p)
            for x, first, second in zip(inputs, self.first.T, self.second.T, strict=True):
                slope, bend = wrong * x, (sure * x * x).astype(float)
                for gate, weights in ((gate1, first), (gate2, second)):
                    weights += STEP * np.bincount(gate, slope, len(weights)) / (np.bincount(gate, bend, len(weights)) + 20)
            self.map[:, 0] += np.bincount(cell, bit, len(self.map))
            self.map[:, 1] += np.bincount(cell, minlength=len(self.map))
            total += len(bit)
        return total

    def cost(self, ids: np.ndarray, starts: np.ndarray, kinds: np.ndarray, trained: np.ndarray) -> np.ndarray:
        """log10 of each text's probability, given its kind. Bits of a training text are predicted without their own counts."""
        text, out = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(ids))), np.zeros(len(starts))
        ones, seen = self.map.T.copy()
        for owner, bit, place, slots in self.events(ids, starts, kinds):
            of = text[owner]
            _, _, _, p, cell = self.predicted(slots, place, np.where(trained[of], bit, np.int32(2)))
            p = p.astype(float)
            refined = (np.take(ones, cell) + 8 * p) / (np.take(seen, cell) + 8)
            p = np.clip((p + refined) / 2, 1e-5, 1 - 1e-5)
            np.subtract(1, p, out=p, where=bit == 0)
            out += np.bincount(of, np.log10(p), len(starts))
        return out


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of bounded size, with the tokens of their texts, where each text starts, and the texts' kinds."""
    for batch in chunks(batches, "ids", CHUNK):
        own = [np.frombuffer(x, np.int32) for x in batch.column("ids").to_pylist()]
        yield batch, np.concatenate(own), np.cumsum([0, *map(len, own)])[:-1], batch.column("kind").to_numpy()


def trained(rows: DataFrame, counts: np.ndarray) -> Callable[[], Model]:
    """What gives the model in a task: learned in two passes from all of ``rows``: their number ``row``, ``ids``, four bytes for each token, never none, and the ``kind`` of the text. ``counts`` are those of all tokens."""
    spark = rows.sparkSession
    model = Model.fresh(Codes.of(counts))
    # the order of learning, and with it the weights, doesn't hang on how the table lies in files
    tasks = int(min(max(TASKS, counts.sum() // TAUGHT), COUNTERS))
    rows = written(rows.select("row", "ids", "kind").repartition(tasks, "row").sortWithinPartitions("row"), "taught").coalesce(COUNTERS)
    shared = spark.sparkContext.broadcast(model.codes)
    size = 2 * int(STARTS[-1])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = np.zeros(size, np.uint32), Model(shared.value, *[None] * 4)
        for _, ids, starts, kinds in texts(batches):
            for _, bit, _, slots in own.events(ids, starts, kinds):
                for s in slots:
                    np.add.at(table, s * 2 + bit, np.uint32(1))
        for i in range(0, size, BLOCK):
            if (part := table[i : i + BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int64()), pa.array([packed(part)], pa.binary())], names=["block", "counts"])

    def added(found: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in found["counts"]:
            one = unpacked(x.as_py())
            total[: len(one)] += one
        codes = np.searchsorted(COUNTS, total).clip(0, 255).astype(np.uint8)
        return pa.table({"block": found["block"].combine_chunks()[:1], "codes": pa.array([zlib.compress(codes.tobytes(), 1)], pa.binary())})

    table = model.table.reshape(-1)
    for r in rows.mapInArrow(counted, "block bigint, counts binary").groupBy("block").applyInArrow(added, "block bigint, codes binary").collect():  # of fixed size
        part = table[r["block"] * BLOCK : (r["block"] + 1) * BLOCK]
        part[:] = np.frombuffer(zlib.decompress(r["codes"]), np.uint8)[: len(part)]
    begun = spark.sparkContext.broadcast(model)

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = begun.value
        m, n = Model(m.codes, m.table, m.first.copy(), m.second.copy(), m.map.copy()), 0
        for _, ids, starts, kinds in texts(batches):
            n += m.learn(ids, starts, kinds)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (m.first, m.second, m.map))], names=["n", "first", "second", "map"])

    total, first, second = 0, 0, 0
    for r in rows.mapInArrow(taught, "n bigint, first binary, second binary, map binary").collect():  # a row of fixed size for each of at most COUNTERS tasks
        total, first, second = total + r["n"], first + np.frombuffer(r["first"], np.float32) * float(r["n"]), second + np.frombuffer(r["second"], np.float32) * float(r["n"])
        model.map += np.frombuffer(r["map"]).reshape(model.map.shape)
    if total:
        model.first, model.second = ((x / total).astype(np.float32).reshape(-1, len(TABLE_BITS)) for x in (first, second))
    weights = spark.sparkContext.broadcast((model.first, model.second, model.map))  # the tables have been sent
    return lambda: Model(begun.value.codes, begun.value.table, *weights.value)
