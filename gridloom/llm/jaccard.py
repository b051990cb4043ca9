"""N-gram Jaccard join by a blocked sparse product of the document x n-gram incidence matrix.

Equal sets are one node. A node's n-grams are ordered globally, rare ones first (the order comes from counts on a sample
of documents, ties by hash; any order gives the same result), and only its prefix takes part in the product: two sets
with a similarity of at least ``percent`` must meet in their first n - ceil(percent*n/100) + 1 n-grams.

The columns of the matrix are dealt into blocks by n-gram. A task packs its nodes' n-grams of a block into one row of bytes, so that
what crosses the exchange is six bytes for each. Each block multiplies its columns and counts the n-grams that a pair of
nodes has in common; counts are added over all blocks, and a pair is discarded if its sizes, or its count and the most
n-grams that it may share beyond its prefixes, can't come to the overlap that its sizes ask for, or if its sketches differ too much. For
the pairs that are left the overlap of whole sets is counted, on 64 bits of each n-gram.

Large groups of near copies are never multiplied out. First each n-gram counts its nodes only against two picked ones; a node's best pairs
of those, once verified, join most copies into components, and ROUNDS rounds of pairs picked by hash most that these missed. Then only nodes of
different components are multiplied. Pairs inside one component can't change any result, so no link between components is lost.

Sets are told apart by 128 bits of their content. Nulls: a null text has no n-grams and no links; a null id takes part in links, and
a component's id is the smallest that isn't null. Rows with equal ids are linked only if their texts are. Repeated rows are one node. Ties
in the order of n-grams, and between picked nodes, are broken by hash and number and change no result. An empty table gives an empty
result; a very long text is one set like any other, in a batch of its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from gridloom.llm.common import chunks, partitions_for, utf8, written
from gridloom.llm.components import components
from gridloom.llm.shingles import mixed, window_hashes, window_places, word_hashes

CHUNK_BYTES = 2 << 20
SAMPLE = 32  # one document of so many is counted for the order of n-grams
MOST_COMMON = 200_000  # so many of the commonest n-grams are ordered by count, all others by hash
MOST_BROADCAST = 1_000_000  # ids (16 MB) that may be sent to all executors; more are joined by an exchange of the texts
BLOCK_ENTRIES = 400_000  # n-grams in a block of columns, about
SKETCH = 1024  # bits
ROUNDS = 2  # of picked pairs with sketches, before all pairs that are left
CELLS = 4_000_000  # pairs that a block counts at a time

ROWS = "row bigint, doc_id bigint, high bigint, low bigint, n bigint, prefix binary, bits binary"
PAIRS = "a bigint, b bigint"
BLOCKS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("payload", T.BinaryType())])


def sets_of(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The ascending distinct n-gram hashes of each text, signed; a text of fewer words is one n-gram."""
    words = [t.lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    hashes = word_hashes([w for ws in words for w in ws])
    del words
    places, _ = window_places(lengths, k)
    grams = window_hashes(hashes, k)[places].view(np.int64)
    at = first = 0
    for n in lengths.tolist():
        whole = max(0, n - k + 1)
        yield np.unique(grams[at : at + whole]) if whole else window_hashes(hashes[first : first + n], n).view(np.int64) if n else grams[:0]
        at += whole
        first += n


def identity(grams: np.ndarray) -> tuple[int, int]:
    digest = xxh3_128_digest(grams.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def least_overlap(n: int, percent: int) -> int:
    """ceil(percent * n / 100)."""
    return (n * percent + 99) // 100


def common(docs: DataFrame, k: int) -> DataFrame:
    """(gram, n) of the commonest n-grams in a sample of documents, at most MOST_COMMON."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            sets = list(sets_of(utf8(batch.column("text")), k))
            grams, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n.astype(np.int64))], names=["gram", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counted = sample.mapInArrow(task, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where("n >= 3")
    return counted.orderBy(F.desc("n"), "gram").limit(MOST_COMMON)


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(row, doc_id, high, low, n, prefix, bits) of every row: a number, its set's identity, size, first n-grams in the global order and sketch.

    A sketch has a bit for each class of hashes, the parity of how many n-grams fall into it. Where two sketches differ,
    so do the sets: the number of differing bits is at most that of n-grams that only one set has.
    """
    rows = common(docs, k).collect()  # bounded by MOST_COMMON
    rows.sort()
    grams, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    maybe = np.zeros(1 << 20, bool)
    maybe[grams & 0xFFFFF] = True
    shared = docs.sparkSession.sparkContext.broadcast((grams, counts, maybe))

    def prefix(s: np.ndarray, keep: int) -> np.ndarray:
        grams, counts, maybe = shared.value
        hot = np.flatnonzero(maybe[s & 0xFFFFF])
        if len(hot):
            at = np.minimum(np.searchsorted(grams, s[hot]), len(grams) - 1)
            real = grams[at] == s[hot]
            hot, at = hot[real], at[real]
        if len(hot):
            rare = np.delete(s, hot)
            s = rare if len(rare) >= keep else np.concatenate([rare, s[hot][np.lexsort((s[hot], counts[at]))]])
        return s[:keep]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            out = []
            for s in sets_of(utf8(batch.column("text")), k):
                n = len(s)
                out.append((*identity(s), n, prefix(s, n - least_overlap(n, percent) + 1 if n else 0).tobytes(), np.packbits((np.bincount((s >> 20) & (SKETCH - 1), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))], names=["row", "doc_id", "high", "low", "n", "prefix", "bits"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(task, ROWS)


def blocks_of(nodes: DataFrame, blocks: int) -> DataFrame:
    """(block, payload): for each task and block of columns, its nodes' (node, n, label, sketch if there is one) and an ascending list of (n-gram, node)."""
    sketched = "bits" in nodes.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "prefix", CHUNK_BYTES):
            about = np.stack([np.asarray(batch.column(c)) for c in ("node", "n", "label")])
            if sketched:
                about = np.vstack([about, np.frombuffer(b"".join(batch.column("bits").to_pylist()), "<i8").reshape(len(batch), -1).T])
            each = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
            owner = np.repeat(np.arange(len(each)), list(map(len, each)))
            gram = mixed(np.concatenate(each)) if each else np.zeros(0, np.uint64)
            block = ((gram >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            short = gram.astype(np.uint32)
            order = np.lexsort((short, block))
            owner, short, edges = owner[order], short[order], np.searchsorted(block[order], np.arange(blocks + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)):
                own, grams = owner[edges[b] : edges[b + 1]], short[edges[b] : edges[b + 1]]
                used, number = np.unique(own, return_inverse=True)
                kind = "<u2" if len(used) <= 65536 else "<u4"
                rows.append((int(b), np.array([len(about), len(used), len(grams)], "<i8").tobytes() + about[:, used].astype("<i8").tobytes() + grams.tobytes() + number.astype(kind).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "payload"])

    return nodes.select("node", "n", "label", "prefix", *["bits"] * sketched).mapInArrow(task, BLOCKS)


def columns_of(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: (node, n, label, sketch if any) of its nodes; its entries that share their n-gram with others: column number and node, by column."""
    about, grams, owner, first = [], [], [], 0
    for data in payloads:
        facts, nodes, n = np.frombuffer(data, "<i8", 3).tolist()
        about.append(np.frombuffer(data, "<i8", facts * nodes, 24).reshape(facts, nodes))
        at = 24 + 8 * facts * nodes
        grams.append(np.frombuffer(data, "<u4", n, at))
        owner.append(np.frombuffer(data, "<u2" if nodes <= 65536 else "<u4", n, at + 4 * n).astype(np.int64) + first)
        first += nodes
    about, gram, owner = np.concatenate(about, 1), np.concatenate(grams), np.concatenate(owner)
    _, one, number = np.unique(about[0], return_index=True, return_inverse=True)  # a node may stand in several payloads
    about, owner = about[:, one], number[owner]
    order = np.lexsort((owner, gram))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    return about, np.unique(column, return_inverse=True)[1] if len(column) else column, owner


def sized_alike(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(x, y) * 100 >= np.maximum(x, y) * percent


def counted(pairs: list[tuple[np.ndarray, np.ndarray]], about: np.ndarray, buckets: int, percent: int, by_first: bool, most: int | None = None, seed: int = 0) -> pa.Table:
    """(bucket, payload): how often each pair (a, b) of the block's nodes stands in ``pairs``, packed (a, b, size of a, of b, count) by bucket of a or of the pair.

    Pairs whose sketches differ in more bits than their sizes allow are left out; of the others, ``most`` for each a are picked by hash if that is given.
    """
    node, n = about[0], about[1]
    a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    pair, shared = np.unique(a * len(node) + b, return_counts=True)
    a, b = pair // max(len(node), 1), pair % max(len(node), 1)
    if len(about) > 3:
        differing = sum((np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in about[3:].view(np.uint64)), np.zeros(len(a), np.int64))
        both = n[a] + n[b]
        alike = differing <= both - 2 * ((both * percent + 99 + percent) // (100 + percent))
        a, b, shared = a[alike], b[alike], shared[alike]
    if most:
        order = np.lexsort((mixed((node[a] * 31 + node[b] + seed).view(np.uint64)), a))
        a, b, shared = a[order], b[order], shared[order]
        few = np.arange(len(a)) - np.repeat(x := np.flatnonzero(np.diff(a, prepend=-1)), np.diff(x, append=len(a))) < most
        a, b, shared = a[few], b[few], shared[few]
    rows = np.stack([node[a], node[b], n[a], n[b], shared]).astype("<i8")
    bucket = (mixed(rows[0].view(np.uint64) if by_first else (rows[0] * 31 + rows[1]).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[:, order], bucket[order]
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    out = [np.ascontiguousarray(rows[:, x:y]).tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"block": pa.array(bucket[edges[:-1]], pa.int32()), "payload": pa.array(out, pa.binary())})


def added(table: pa.Table) -> np.ndarray:
    """Counts of a bucket by pair, in order of a, then b; counts of all blocks are summed."""
    rows = np.concatenate([np.frombuffer(x, "<i8").reshape(5, -1) for x in table["payload"].to_pylist()], 1)
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    starts = np.flatnonzero((np.diff(rows[0], prepend=-1) != 0) | (np.diff(rows[1], prepend=-1) != 0))
    return np.vstack([rows[:4, starts], np.add.reduceat(rows[4], starts)])


def picked(percent: int, buckets: int):
    def of_block(table: pa.Table) -> pa.Table:
        """Each column's nodes against those two of them that have the smallest and the largest hash; a is the other node, b the picked one."""
        about, column, owner = columns_of(table["payload"].to_pylist())
        node, n = about[0], about[1]
        place = np.argsort(np.argsort(mixed(node.view(np.uint64)), kind="stable"), kind="stable")
        order = np.lexsort((place[owner], column))
        column, owner = column[order], owner[order]
        starts = np.flatnonzero(np.diff(column, prepend=-1))
        ends = np.append(starts[1:], len(column)) - 1
        pairs = []
        for edge in (starts, ends) if len(column) else ():
            to = np.repeat(owner[edge], ends - starts + 1)
            good = (to != owner) & sized_alike(n[to], n[owner], percent)
            pairs.append((owner[good], to[good]))
        return counted(pairs, about, buckets, percent, True)

    return of_block


def possible(n_a: np.ndarray, n_b: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """Whether so many n-grams shared by two prefixes leave the overlap possible that the sizes ask for.

    An n-gram that both sets have, but not both prefixes, lies behind the prefix that ends first, so there are at most as
    many as n-grams behind the longer rest.
    """
    rest = np.maximum((n_a * percent + 99) // 100, (n_b * percent + 99) // 100) - 1
    return shared + rest >= ((n_a + n_b) * percent + 99 + percent) // (100 + percent)


def best(percent: int, sure: bool = True):
    def of_bucket(table: pa.Table) -> pa.Table:
        """Of each node of a bucket, the two pairs of most shared n-grams, if these are enough (``sure``) though only columns of the picked node count."""
        rows = added(table)
        a, b, n_a, n_b, shared = rows[:, possible(rows[2], rows[3], rows[4], percent)] if sure else rows
        order = np.lexsort((b, -shared, a))
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        place = np.arange(len(a)) - np.repeat(starts, np.diff(starts, append=len(a)))
        return pa.table({"a": np.maximum(a, b)[place < 2], "b": np.minimum(a, b)[place < 2]})

    return of_bucket


def partners(n: np.ndarray, label: np.ndarray, column: np.ndarray, owner: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one column with different labels, and some others, CELLS at a time at most (or one entry's).

    Of each column either those of sizes alike are listed or those of different labels, whichever are fewer.
    """
    span = int(n.max(initial=0)) * 100 // percent + 2
    ways = []
    for by in (n[owner], label[owner]):
        order = np.lexsort((owner, by, column))
        ways.append((order, column[order], by[order]))
    (by_size, c, size), (by_label, d, name) = ways
    key = c * span
    first = [np.arange(len(c)) + 1, np.repeat(x := np.append(np.flatnonzero((np.diff(d) != 0) | (np.diff(name) != 0)) + 1, len(d)), np.diff(x, prepend=0))]
    last = [np.searchsorted(key + size, key + np.minimum(size * 100 // percent, span - 1), "right"), np.searchsorted(d, d, "right")]
    reach = [np.maximum(y - x, 0) for x, y in zip(first, last, strict=True)]
    fewer = np.bincount(c, reach[0]) <= np.bincount(d, reach[1])
    for order, at, begin, many in ((by_size, c, first[0], np.where(fewer[c], reach[0], 0)), (by_label, d, first[1], np.where(fewer[d], 0, reach[1]))):
        total, start = np.cumsum(many), 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + CELLS, "right")))
            lengths = many[start:stop]
            own = np.repeat(np.arange(start, stop), lengths)
            to = np.repeat(begin[start:stop], lengths) + np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield owner[order[own]], owner[order[to]]
            start = stop


def multiplied(percent: int, buckets: int, both_ways: bool, most: int | None = None, seed: int = 0):
    def of_block(table: pa.Table) -> pa.Table:
        """All pairs of each column's nodes that have different labels and sizes alike, with how many columns they share."""
        about, column, owner = columns_of(table["payload"].to_pylist())
        _, n, label = about[:3]
        if len(column):  # columns of one label alone have no pair
            low, high = np.full(column[-1] + 1, 2**63 - 1), np.full(column[-1] + 1, -(2**63))
            np.minimum.at(low, column, label[owner])
            np.maximum.at(high, column, label[owner])
            several = (low < high)[column]
            column, owner = np.unique(column[several], return_inverse=True)[1], owner[several]
        pairs, out, held = [], [], 0
        for x, y in partners(n, label, column, owner, percent) if len(column) else ():
            good = (label[x] != label[y]) & sized_alike(n[x], n[y], percent)
            x, y = x[good], y[good]
            pairs.append((np.minimum(x, y), np.maximum(x, y)))
            if both_ways:
                pairs.append(pairs[-1][::-1])
            held += len(x)
            if held > CELLS:
                out.append(counted(pairs, about, buckets, percent, both_ways, most, seed))
                pairs, held = [], 0
        return pa.concat_tables([*out, counted(pairs, about, buckets, percent, both_ways, most, seed)])

    return of_block


def concerned(percent: int):
    def of_bucket(table: pa.Table) -> pa.Table:
        """The nodes of a bucket that have a pair whose count may do."""
        rows = added(table)
        return pa.table({"node": np.unique(rows[0][possible(rows[2], rows[3], rows[4], percent)])})

    return of_bucket


def enough(percent: int):
    def of_bucket(table: pa.Table) -> pa.Table:
        a, b, n_a, n_b, shared = added(table)
        good = possible(n_a, n_b, shared, percent)
        return pa.table({"a": np.maximum(a, b)[good], "b": np.minimum(a, b)[good]})

    return of_bucket


def small(table: DataFrame) -> DataFrame:
    """A written table of two or three numbers a row, sent to all executors if it has at most MOST_BROADCAST rows; beyond, an exchange joins it."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, grams) of the wanted nodes, one row each: their ascending n-grams. wanted: (node, doc_id, high, low), an id with that set."""
    n = wanted.count()
    named = wanted.where("doc_id is not null").select("doc_id", "node", "high", "low")
    found = docs.select("doc_id", "text").join(F.broadcast(named) if n <= MOST_BROADCAST else named, "doc_id").select("text", "node", "high", "low")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            nodes, out, names = [], [], []
            for node, high, low, s in zip(*(batch.column(c).to_pylist() for c in ("node", "high", "low")), sets_of(utf8(batch.column("text")), k), strict=True):
                own = identity(s)
                if high is None or own == (high, low):  # an id may stand for several texts
                    nodes.append(node)
                    names.append(own)
                    out.append(s.tobytes())
            columns = [pa.array(nodes, pa.int64()), *(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "high", "low", "grams"])

    schema = "node bigint, high bigint, low bigint, grams binary"
    out = found.mapInArrow(task, schema).select("node", "grams")
    unnamed = wanted.where("doc_id is null").select(F.col("node").alias("_gl_node"), "high", "low")  # only rows without an id have these sets
    if not unnamed.isEmpty():
        others = docs.where("doc_id is null").select("text", *[F.lit(None).cast("bigint").alias(c) for c in ("node", "high", "low")])
        out = out.union(others.mapInArrow(task, schema).join(unnamed, ["high", "low"]).select("_gl_node", "grams"))
    return out.dropDuplicates(["node"])


def verified(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Only a's sets and, once per b, b's cross an exchange."""
    of_a = grams.select(F.col("node").alias("a"), F.col("grams").alias("of_a")).join(small(pairs.select("a", "b")), "a")
    both = of_a.join(grams.select(F.col("node").alias("b"), F.col("grams").alias("of_b")), "b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(task, "a bigint, b bigint")


def join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and node (equal for equal sets) of every row."""
    spark = docs.sparkSession
    rows = written(prefixes(docs, k, percent), "prefixes")
    nodes = written(rows.where("n > 0").groupBy("high", "low").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id")), "nodes")
    entries = rows.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    blocks = min(partitions_for(spark, entries / 8, BLOCK_ENTRIES), 2**31 - 1)
    own = rows.select(F.col("row").alias("node"), "n", "prefix").join(nodes.select("node"), "node")

    # each node's two best pairs with picked nodes; most copies are linked by these
    deal = lambda of, count, choose, schema: blocks_of(of, blocks).groupBy("block").applyInArrow(count, BLOCKS).groupBy("block").applyInArrow(choose, schema)
    stars = written(deal(own.withColumn("label", F.col("node")), picked(percent, blocks), best(percent), PAIRS).distinct(), "stars")
    links = written(verified(stars, sets_in(docs, stars, nodes, k), percent), "links")
    labels = components(links)

    # then nodes of different components are multiplied: first for the nodes that may have a pair,
    labelled = own.join(labels, "node", "left").select("node", "n", "prefix", F.coalesce("label", "node").alias("label"))
    left = written(deal(labelled, multiplied(percent, blocks, True), concerned(percent), "node bigint"), "concerned")
    left = written(rows.select(F.col("row").alias("node"), "n", "prefix", "bits").join(small(left), "node"), "sketched")
    closer = lambda: left.join(labels, "node", "left").select("node", "n", "prefix", "bits", F.coalesce("label", "node").alias("label"))
    # for some of their pairs, picked by hash, so that a group of copies that missed the picked nodes grows together as well,
    for seed in range(1, ROUNDS + 1):
        more = deal(closer(), multiplied(percent, blocks, True, 2, seed), best(percent, False), PAIRS).distinct()
        more = written(more.join(stars, ["a", "b"], "left_anti"), "stars")
        found = written(verified(more, sets_in(docs, more, nodes, k), percent), "links")
        stars = stars.union(more)
        if found.isEmpty():
            break
        links = links.union(found)
        labels = components(links)
    # and for all that are left
    pairs = deal(closer(), multiplied(percent, blocks, False), enough(percent), PAIRS)
    pairs = written(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        more = written(verified(pairs, sets_in(docs, pairs, nodes, k), percent), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    smallest = nodes.select("node", "doc_id").join(labels, "node").groupBy("label").agg(F.min("doc_id").alias("component"))
    placed = nodes.join(labels, "node", "left").join(smallest, "label", "left")
    placed = written(placed.select("high", "low", "node", F.coalesce("component", "doc_id").alias("component")), "placed")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = rows.select("doc_id", "high", "low", "n").join(placed, ["high", "low"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "node")


def sets_in(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The sets of all nodes that stand in ``pairs``."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return written(sets(docs, written(nodes.join(wanted, "node").select("node", "doc_id", "high", "low"), "wanted"), k), "sets")
