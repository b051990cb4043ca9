"""Language-model scores by logistic context mixing of hashed-context bit predictors.

A text is a sequence of tokens: its words, in lower case, and one end. Every token of a whole text is coded bit by bit, by a code over the CODED commonest tokens that stand twice at least
in training texts, with a code for all others (``contexts``). Predictors with hashed contexts of up to three tokens before, and of the text's kind, are counted over every occurrence in
training texts, mixed by gated weights and refined by an adaptive map. So the order of words counts.

What the code for all others leaves open, which token it is, is an absolutely discounted share of its count among those and, with what the discount leaves, the probability of its spelling:

    P(token) = max(c - D, 0) / N  +  D * V / N * P(spelling)

The spelling is coded bit by bit in the same way. Its contexts (the last 1, 2, 3, 4, 6 bytes of the word; the place in the word) end where the word begins, so each distinct token is spelled
once. Its gates are how many contexts were seen before together with the bit's place, and how often the longest was. Counts are taken over all distinct training words. The weights are then learned
online, in one pass over all training words, by partition, every word with its own counts left out; what the partitions learned is averaged.

Texts fall into a few kinds (languages, styles) that their commonest words tell apart. Kinds are a mixture of multinomials over
all training texts: it begins from one of ``most_sampled`` texts, then shares and probabilities are re-estimated by aggregations over
all of them. A text's likeliest kind is coded first, by its share.

Training texts are scored as if a token's own occurrence hadn't been counted; so they aren't better known than held-out ones.

A corpus also says of whole texts how often they occur. With the share of training texts that have a copy among the others as its
weight, a text's share of all training texts, itself left out, is mixed with the probability above. So texts that stand twice score apart
from those that stand once, in either fold.

The vocabulary, with its counts, is one Spark table that grows with the corpus. Counts of the ``most_common`` commonest coded tokens are broadcast, those of all others, and spellings, are
joined. The predictors' tables have a fixed size (TABLE_BITS).

``bits_per_byte`` divides by the bytes of the text as coded: its words, a space after each.

Ties among telling and common tokens are broken by the token's bytes. A very long text is scored in one piece, in a batch of its own.
Nulls: a null text is empty and has the end alone; a null id is hashed as an empty text and passed on. Repeated rows count as often
as they stand. Without training rows (an empty table, or all rows in the held-out fold) all counts are 0, and the score is that of
untrained predictors. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from gridloom.llm import contexts
from gridloom.llm.common import chunks, fold_of, packed, unpacked, utf8, written

END = b"\n"  # no word has it
ORDERS = (1, 2, 3, 4, 6)
TABLE_BITS = (16, 19, 21, 22, 22, 20)  # of the five orders and of the place in the word
STARTS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])])
BLOCK = 1 << 17  # counters in a row of an exchange
BATCH = 4096  # words at a time
KINDS = 5
CODED = 200_000  # commonest tokens that have a code of bits; all others are spelled
TELLING = 300  # so many of the commonest tokens tell kinds apart
RATE = 0.25
MAP_CELLS = 33
TEACHERS = 12  # tasks that learn weights side by side, at least
TAUGHT = 500_000  # words of each, about
MOST_TEACHERS = 256  # and at most; each sends a row of fixed size to the driver
COUNTERS = 64  # tasks that count spellings; so many tables are added for each block
ROUNDS = 4  # re-estimations of the kinds over all training texts
#: Counts as one byte: exact up to 63, then in steps of about 14 per cent.
LEVELS = np.concatenate([np.arange(64), 63 * (1e13 / 63) ** (np.arange(1, 193) / 192)]).astype(np.float32)
#: By the codes of both counts of a slot, zeros in the lower byte: the logit, and the rounded binary logarithm of their sum.
LOGITS = (np.log((LEVELS[:, None] + np.float32(0.02)) / (LEVELS + np.float32(0.02))) * (LEVELS[:, None] + LEVELS > 0)).astype(np.float32).ravel()
SEEN = np.minimum(np.log2(LEVELS[:, None] + LEVELS + 1), 9).astype(np.int64).ravel()

#: The same without the bit's own count, for zeros first.
_FEWER = np.maximum(LEVELS - 1, 0)
_PAIRS = ((LEVELS[:, None], _FEWER), (_FEWER[:, None], LEVELS))  # ones, zeros
LESS = np.concatenate([(np.log((a + np.float32(0.02)) / (b + np.float32(0.02))) * (a + b > 0)).astype(np.float32).ravel() for a, b in _PAIRS])
SEEN_LESS = np.concatenate([np.minimum(np.log2(a + b + 1), 9).astype(np.int8).ravel() for a, b in _PAIRS])


def bits_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word of each bit, bit, place of the bit in its byte, slots by predictor, last byte); each word ends with a space."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8) if words else np.zeros(0, np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    context, contexts, last = np.zeros(len(data), np.uint64), [], np.zeros(len(data), np.uint8)
    for k in range(1, max(ORDERS) + 1):
        before = np.zeros(len(data), np.uint8)
        before[k:] = np.where(place[k:] >= k, data[:-k], 0) if k < len(data) else 0
        if k == 1:
            last = before
        context = (context + before.astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)
        if k in ORDERS:
            contexts.append(context)
    contexts.append((np.minimum(place, 30).astype(np.uint64) + np.uint64(77)) * np.uint64(0xD6E8FEB86659FD93))
    at = np.arange(8, dtype=np.uint8)
    bit = (data[:, None] >> (7 - at)) & 1
    partial = (np.uint64(1) << at.astype(np.uint64)) | (data.astype(np.uint64)[:, None] >> (np.uint64(8) - at.astype(np.uint64)))
    partial *= np.uint64(0x9E3779B97F4A7C15)
    slots = np.empty((len(contexts), len(data), 8), np.uint64)
    for c, own, b, start in zip(contexts, slots, TABLE_BITS, STARTS, strict=False):
        c ^= c >> np.uint64(31)
        np.add(c[:, None], partial, out=own)
        own *= np.uint64(0x94D049BB133111EB)
        own >>= np.uint64(64 - b)
        own += np.uint64(start)
    slots = slots.view(np.int64).reshape(len(contexts), -1)
    return np.repeat(owner, 8), bit.ravel().astype(np.float32), np.tile(at, len(data)), slots, np.repeat(last, 8)


@dataclass
class Mixer:
    """Weights by gate, and the adaptive map's counts of bits and ones."""

    first: np.ndarray  # (contexts seen, place of the bit) x predictor
    second: np.ndarray  # how often the longest was seen x predictor
    map: np.ndarray  # (last byte, cell) x (ones, all)

    @staticmethod
    def fresh() -> Mixer:
        k = len(TABLE_BITS)
        return Mixer(np.full(((k + 1) * 8, k), 0.15, np.float32), np.full((10, k), 0.15, np.float32), np.zeros((256 * MAP_CELLS, 2)))

    def run(self, table: np.ndarray, words: list[bytes], learn: bool) -> np.ndarray:
        """log10 of the probability of each word's spelling. With ``learn``, adapts to the words, whose own counts are left out, and gives nothing."""
        owner, bit, at, slots, last = bits_of(words)
        if learn:
            codes = table.view("<u2")[slots] + (bit.astype(np.int32) << 16)
            inputs, seen = LESS[codes], SEEN_LESS[codes[: len(ORDERS)]]
            known, often = (seen > 0).sum(0, dtype=np.uint8), seen[len(ORDERS) - 1].astype(np.int64)
        else:
            codes = table.view("<u2")[slots]
            inputs, often = LOGITS[codes], SEEN[codes[len(ORDERS) - 1]]
            known = (codes[: len(ORDERS)] > 0).sum(0, dtype=np.uint8)
        gate1 = known.astype(np.int64) * 8 + at
        gate2 = often
        both = (self.first[:, None] + self.second).reshape(-1, len(inputs))  # of each pair of gates
        logit = np.einsum("ki,ki->i", inputs, np.take(both, gate1 * len(self.second) + gate2, 0).T)
        logit = np.clip(logit, -11, 11)
        p = 1 / (1 + np.exp(-logit))
        cell = last.astype(np.int64) * MAP_CELLS + np.round((logit + 11) * ((MAP_CELLS - 1) / 22)).astype(np.int64)
        if learn:
            wrong = bit - p
            for gate, weights in ((gate1, self.first), (gate2, self.second)):
                n = np.bincount(gate, minlength=len(weights)) + 50
                for k in range(len(inputs)):
                    weights[:, k] += RATE / (1 + np.abs(inputs[k]).max()) * np.bincount(gate, wrong * inputs[k], len(weights)) / n
            self.map[:, 0] += np.bincount(cell, bit, len(self.map))
            self.map[:, 1] += np.bincount(cell, minlength=len(self.map))
            return np.zeros(0)
        refined = (np.take(self.map[:, 0], cell) + 8 * p) / (np.take(self.map[:, 1], cell) + 8)
        final = np.clip((p + refined) / 2, 1e-5, 1 - 1e-5)
        cost = np.log10(np.where(bit > 0, final, 1 - final))
        return np.bincount(owner, cost, len(words))


def batches_of(words: list[bytes], most_bytes: int = 1 << 17) -> Iterator[list[bytes]]:
    """Words in batches of bounded size; a word longer than that is a batch of its own."""
    batch, size = [], 0
    for w in words:
        if batch and (len(batch) >= BATCH or size + len(w) > most_bytes):
            yield batch
            batch, size = [], 0
        batch.append(w)
        size += len(w) + 1
    if batch:
        yield batch


@dataclass
class Kinds:
    """Telling tokens by number, the logarithms of the kinds' shares, and (token x kind) of their tokens' probabilities; the last row is for others."""

    number: dict[bytes, int]
    share: np.ndarray
    tokens: np.ndarray


def kinds(docs: DataFrame, held: int, most_sampled: int) -> Kinds:
    """Kinds of texts. They begin from the ``most_sampled`` training texts of smallest hash; telling tokens, shares and probabilities come from all training texts."""
    spark = docs.sparkSession
    texts = docs.where(fold_of() != held).select("doc_id", "text")

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        for batch in chunks(batches, "text", 4 << 20):
            for t in utf8(batch.column("text")):
                found.update(set(t.lower().split()))
            if len(found) > 700_000:
                yield rows()
                found.clear()
        yield rows()

    common = texts.select("text").mapInArrow(telling, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TELLING).collect()
    number = {bytes(r["word"]): i for i, r in enumerate(common)}
    shared = spark.sparkContext.broadcast(number)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.get
        for batch in chunks(batches, "text", 4 << 20):
            found = [Counter(i for i in map(of, t.lower().split()) if i is not None) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], names=["doc_id", "at", "n"])

    told = written(texts.mapInArrow(counted, "doc_id bigint, at array<int>, n array<int>").where("size(at) > 0"), "told")
    ids = told.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_sampled)
    sample = told.join(F.broadcast(ids.distinct()), "doc_id").select("at", "n").limit(2 * most_sampled)  # an id may stand on many rows
    sample = sorted((tuple(r["at"]), tuple(r["n"])) for r in sample.collect())
    x = matrix([r[0] for r in sample], [r[1] for r in sample], len(number))
    if len(x) < KINDS:
        return Kinds(number, np.zeros(1), np.zeros((len(number) + 1, 1)))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    seeds = [int(np.argmax(x.sum(1)))]
    while len(seeds) < KINDS:  # the text that is farthest from all seeds so far
        seeds.append(int(np.argmin((unit @ unit[seeds].T).max(1))))
    weight = (unit @ unit[seeds].T) * 30
    for _ in range(40):
        weight = belonging(weight)
        share, tokens = estimated(weight.sum(0), weight.T @ x, len(x))
        weight = share + x @ tokens.T
    for _ in range(ROUNDS):
        model = spark.sparkContext.broadcast((share, tokens))

        def summed(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            share, tokens = model.value
            n, shares, sums = 0, np.zeros(KINDS), np.zeros(tokens.shape)
            for batch in batches:
                for start in range(0, len(batch), 2000):
                    own = batch.slice(start, 2000)
                    x = matrix(own.column("at").to_pylist(), own.column("n").to_pylist(), tokens.shape[1])
                    weight = belonging(share + x @ tokens.T)
                    n, shares, sums = n + len(x), shares + weight.sum(0), sums + weight.T @ x
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (shares, sums))], names=["n", "shares", "sums"])

        rows = told.select("at", "n").mapInArrow(summed, "n bigint, shares binary, sums binary").collect()  # a row of fixed size for each task
        share, tokens = estimated(
            sum(np.frombuffer(r["shares"]) for r in rows), sum(np.frombuffer(r["sums"]) for r in rows).reshape(tokens.shape), sum(r["n"] for r in rows)
        )
    return Kinds(number, share, np.vstack([tokens.T, np.zeros(KINDS)]))


def matrix(at: list, n: list, width: int) -> np.ndarray:
    """Texts x telling tokens; a text that repeats one word isn't a kind."""
    x = np.zeros((len(at), width))
    rows = np.repeat(np.arange(len(at)), np.fromiter(map(len, at), np.int64, len(at)))
    x[rows, np.fromiter(chain.from_iterable(at), np.int64, len(rows))] = np.fromiter(chain.from_iterable(n), np.float64, len(rows))
    return np.minimum(x, 20)


def belonging(weight: np.ndarray) -> np.ndarray:
    weight = np.exp(weight - weight.max(1, keepdims=True))
    return weight / weight.sum(1, keepdims=True)


def estimated(shares: np.ndarray, sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the kinds' shares and of their tokens' probabilities."""
    tokens = sums + 0.05
    return np.log((shares + 1) / (n + KINDS)), np.log(tokens / tokens.sum(1, keepdims=True))


def vocabulary(docs: DataFrame, held: int) -> DataFrame:
    """(word, c): every token of the corpus with its count in training rows (0 for those of held-out rows alone)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, others = Counter(), set()

        def rows() -> pa.RecordBatch:
            words = list(others.union(counts))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.fromiter(map(counts.get, words, repeat(0)), np.int64, len(words)))], names=["word", "c"])

        for batch in chunks(batches, "text", 4 << 20):
            for text, fold in zip(utf8(batch.column("text")), batch.column("fold").to_pylist(), strict=True):
                words = text.lower().split()
                words.append(END)
                (others if fold == held else counts).update(words)
            if len(counts) + len(others) > 700_000:
                yield rows()
                others.clear()
                counts.clear()
        yield rows()

    return docs.select("text", fold_of().alias("fold")).mapInArrow(task, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def spelling_counts(words: DataFrame) -> np.ndarray:
    """The predictors' counters as one byte each, over all training words; their size is fixed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * STARTS[-1], np.uint32)
        for batch in batches:
            for own in batches_of(batch.column("word").to_pylist()):
                _, bit, _, slots, _ = bits_of(own)
                for i in range(len(TABLE_BITS)):
                    low, high = 2 * STARTS[i], 2 * STARTS[i + 1]
                    found = slots[i] * 2 + bit.astype(np.int64) - low
                    if high - low > 4 * len(found):
                        np.add.at(table[low:high], found, np.uint32(1))
                    else:
                        table[low:high] += np.bincount(found, minlength=high - low).astype(np.uint32)
        used = [i for i in range(0, len(table), BLOCK) if table[i : i + BLOCK].any()]
        for i in used:
            yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int64()), pa.array([packed(table[i : i + BLOCK])], pa.binary())], names=["block", "counts"])

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in rows["counts"]:
            one = unpacked(x.as_py())
            total[: len(one)] += one
        codes = np.searchsorted(LEVELS, total, "left").clip(0, 255).astype(np.uint8)
        return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int64()), "codes": pa.array([zlib.compress(codes.tobytes(), 1)], pa.binary())})

    out = np.zeros(-(-2 * STARTS[-1] // BLOCK) * BLOCK, np.uint8)
    for r in words.coalesce(COUNTERS).mapInArrow(task, "block bigint, counts binary").groupBy("block").applyInArrow(added, "block bigint, codes binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["codes"]), np.uint8)
    return out


def learned(words: DataFrame, table) -> Mixer:
    """Weights learned online from all words by each partition, averaged by their words; the maps' counts are added."""
    words = words.repartition(min(max(TEACHERS, words.count() // TAUGHT), MOST_TEACHERS), "word")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, n = Mixer.fresh(), 0
        for batch in batches:
            for own in batches_of(batch.column("word").to_pylist()):
                mixer.run(table.value, own, True)
                n += len(own)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (mixer.first, mixer.second, mixer.map))], names=["n", "first", "second", "map"])

    out = Mixer.fresh()
    rows = words.mapInArrow(task, "n bigint, first binary, second binary, map binary")
    total, sums = 0, None
    for r in rows.collect():  # a row of fixed size for each partition
        own = [np.frombuffer(r["first"], np.float32) * r["n"], np.frombuffer(r["second"], np.float32) * r["n"], np.frombuffer(r["map"])]
        sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
        total += r["n"]
    if not total:
        return out
    return Mixer((sums[0] / total).astype(np.float32).reshape(out.first.shape), (sums[1] / total).astype(np.float32).reshape(out.second.shape), sums[2].reshape(out.map.shape))


def discounted(c: np.ndarray, back: np.ndarray, total: int, discount: float, distinct: int) -> np.ndarray:
    """log10 of max(c - D, 0) / N + D * V / N * 10 ** back, in logarithms, since a long word's spelling may be rarer than a double can say."""
    if not total:
        return back
    left = math.log10(discount * distinct / total) + back
    kept = np.log10(np.maximum(c - discount, 1e-300) / total)
    return np.where(c > discount, np.maximum(kept, left) + np.log10(1 + 10 ** -np.abs(kept - left)), left)


def spelled(words: DataFrame, coded: DataFrame) -> DataFrame:
    """(word, c, s, less) of all tokens but the ``coded`` ones: log10 of a token's probability among these, and the same without one occurrence in training texts."""
    spark = words.sparkSession
    trained = words.where("c > 0").select("word")
    rest = written(words.join(F.broadcast(coded.select("word")), "word", "left_anti"), "rest")
    total, distinct, once, twice = (x or 0 for x in rest.where("c > 0").agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first())
    discount = once / (once + 2 * twice) if once else 0.5
    table = spark.sparkContext.broadcast(spelling_counts(trained))
    shared = spark.sparkContext.broadcast(learned(trained, table))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, c = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
            back = np.concatenate([shared.value.run(table.value, b, False) for b in batches_of(own)]) if own else np.zeros(0)
            out = [discounted(n, back, total, discount, distinct) for n in (c, np.maximum(c - 1, 0))]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), *(pa.array(x.astype(np.float32)) for x in out)], names=["word", "c", "s", "less"])

    out = written(rest.mapInArrow(task, "word binary, c bigint, s float, less float"), "spelled")
    table.destroy()  # its copies lie on the disks of the driver and of all executors
    return out


def scores(docs: DataFrame, held: int = 1, most_common: int = 200_000, most_sampled: int = 3000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    found = kinds(docs, held, most_sampled)
    words = written(vocabulary(docs, held), "vocabulary")
    total, distinct = (x or 0 for x in words.where("c > 0").agg(F.sum("c"), F.count("*")).first())
    coded = written(words.where("c > 1").orderBy(F.desc("c"), "word").limit(CODED), "coded")
    rest = spelled(words, coded)
    head = coded.orderBy(F.desc("c"), "word").toArrow()  # at most CODED rows
    counts = head["c"].to_numpy()
    n_coded = len(counts)
    spaced = np.array([found.number.get(w, len(found.number)) for w in head["word"].to_pylist()] + [len(found.number)])  # the telling tokens' places by code
    of_kind, share = found.tokens[spaced].astype(np.float32), found.share
    shared = spark.sparkContext.broadcast((head["word"].combine_chunks(), np.log10(counts[:most_common] + 0.5), of_kind))
    del head

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bases, of_kind = shared.value
        number = {w: i for i, w in enumerate(words.to_pylist())}.get
        bases = np.append(bases, 0.0)
        known = np.append(np.ones(len(bases) - 1, np.int64), 0)
        for batch in chunks(batches, "text", 1 << 20):
            about, own = [], [text.lower().split() for text in utf8(batch.column("text"))]
            for x in own:
                digest = xxh3_128_digest(b" ".join(x))
                size = sum(map(len, x)) + len(x)
                x.append(END)
                about.append((len(x), size, digest))
            starts = np.cumsum([0, *map(len, own)])
            tokens = list(chain.from_iterable(own))
            ids = np.fromiter(map(number, tokens, repeat(n_coded)), np.int32, len(tokens))
            at = np.minimum(ids, len(bases) - 1)
            kind = np.argmax(share + np.stack([np.add.reduceat(c[ids].astype(float), starts[:-1]) for c in of_kind.T], 1), 1)
            rare = np.flatnonzero(ids >= len(bases) - 1)
            rare = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(rare, starts[:-1]), len(rare)).astype(np.int32)), pa.array([tokens[i] for i in rare], pa.binary()))
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("fold"), pa.array([r[0] for r in about], pa.int64()), pa.array(np.add.reduceat(known[at], starts[:-1])), rare, pa.array([r[1] for r in about], pa.int64()),
                 pa.array([r[2] for r in about], pa.binary()), pa.array(np.add.reduceat(bases[at], starts[:-1])), packed, pa.array(kind.astype(np.int32))],
                names=["row", "doc_id", "fold", "n_tokens", "known", "rest", "size", "words", "base", "ids", "kind"],
            )

    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", fold_of().alias("fold"))
    rows = written(source.mapInArrow(numbered, "row bigint, doc_id bigint, fold int, n_tokens bigint, known bigint, rest array<binary>, size bigint, words binary, base double, ids binary, kind int"), "rows")
    model = contexts.trained(rows.where(F.col("fold") != held), np.append(counts, max(total - counts.sum(), 0) + 1))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = model()
        for batch, ids, starts, kind in contexts.texts(batches):
            told = now.cost(ids, starts, kind, batch.column("fold").to_numpy() != held) + share[kind] / math.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "doc_id", "fold", "n_tokens", "known", "size", "words", "base")), pa.array(told)], names=["row", "doc_id", "fold", "n_tokens", "known", "size", "words", "base", "told"])

    out = rows.drop("rest").mapInArrow(task, "row bigint, doc_id bigint, fold int, n_tokens bigint, known bigint, size bigint, words binary, base double, told double")
    table = rest
    if n_coded > most_common:
        table = rest.unionByName(coded.orderBy(F.desc("c"), "word").offset(most_common).select("word", "c", F.lit(0.0).cast("float").alias("s"), F.lit(0.0).cast("float").alias("less")))
    rare = rows.select("row", "fold", F.explode("rest").alias("word")).join(table, "word")
    rare = rare.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("more_known"), F.sum(F.log10(F.col("c") + 0.5)).alias("more_base"), F.sum(F.when(F.col("fold") == held, F.col("s")).otherwise(F.col("less"))).alias("more"))
    out = out.join(rare, "row", "left").fillna(0, ["more_known", "more_base", "more"])
    base = F.col("base") + F.col("more_base") - F.col("n_tokens") * math.log10(total + 0.5 * (distinct + 1))
    out = out.withColumn("mixed", F.col("told") + F.col("more"))
    # texts as wholes: how many other training texts say the same
    copies = rows.where(F.col("fold") != held).groupBy("words").agg(F.count("*").alias("copies"))
    copies = written(copies, "copies")
    facts = copies.agg(F.sum("copies"), F.sum(F.when(F.col("copies") > 1, F.col("copies")))).first()
    n_texts, doubled = facts[0] or 0, facts[1] or 0
    weight = (doubled + 0.5) / (n_texts + 1)
    out = out.join(copies, "words", "left").withColumn("others", F.coalesce("copies", F.lit(0)) - (F.col("fold") != held).cast("long"))
    said = F.log10(F.col("others") * (weight / max(n_texts - 1, 1)))
    new = F.col("mixed") + math.log10(1 - weight)
    out = out.withColumn("score", F.when(F.col("others") > 0, F.greatest(said, new) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(said - new)))).otherwise(new))
    return out.select(
        "doc_id", (F.col("fold") == held).alias("held_out"), "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.greatest("size", F.lit(1))).alias("bits_per_byte"),
    )
