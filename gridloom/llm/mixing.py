"""Mixing sources to target weights, with DataFrame operations alone.

Words are packed into fixed-length blocks inside each source. A source's target, in words, becomes a number of slots. Each
output shard draws the source of every one of its slots at random by the targets' shares, so that its counts by source are a multinomial
draw. A source's slots are numbered through all shards; those beyond its number are left out and those that it lacks
are added, spread over the shards. So shards vary as random draws do, while their sum comes to the targets on any input, and
no source overshoots its limit. (Multinomial draws alone miss small sources by several per cent on small inputs.)
Slot k of a source is mapped through the source's own permutation of block indices, another one for each pass over
the source, and blocks are joined by (source, index). No block is taken more than ``limit`` times.

Blocks are numbered without a global sort: documents are hashed into buckets of about ``bucket_rows`` documents of one
source, packed inside their bucket, and a running sum over the buckets gives each its first block. So a source that
holds most rows is spread over many tasks. A document's place follows its id and text, and of equal rows their number, so reruns
agree under any partitioning, whichever of equal rows gets which share.

Nulls: a null text has size 0 and is never taken; a null source is a source of its own, the last; null ids are passed
on. Repeated rows are mixed as rows of their own. A very long text is spread over many blocks. Ties of ids are ordered by text, equal
ratios of sources by their number. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, written

#: Primes for index permutations; at least one of them doesn't divide a length, and their product with a length fits a long.
PRIMES = (1_000_003, 998_244_353)


def permuted(index: Column, length: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. length-1 that depends on ``key``.

    Two rounds, each of which is one-to-one: a multiplication modulo the length, by a prime that doesn't divide it, and a
    rotation of each row of 4096 indices (of what the last row has) by a hash of the row's number.
    """
    for turn in (1, 2):
        prime = F.when(length % PRIMES[0] == 0, F.lit(PRIMES[1])).otherwise(F.lit(PRIMES[0])).cast("long")
        index = F.pmod(F.pmod(index * prime, length) + F.pmod(F.xxhash64(key, F.lit(turn)), length), length)
        row = F.shiftright(index, 12)
        width = F.least(F.lit(4096).cast("long"), length - row * 4096)
        index = row * 4096 + F.pmod(index - row * 4096 + F.pmod(F.xxhash64(key, row, F.lit(turn)), width), width)
    return index


@dataclass
class Mixture:
    sized: DataFrame  # row, doc_id, source, size: one row per document
    sources: DataFrame  # source_no, source, source_size, n_rows, weight, target
    parts: DataFrame  # source_no, block, row, first_word, words: what each block holds of a document
    slots: DataFrame  # shard, k, source_no, block: a table, so that its size is known where it is joined

    def taken(self) -> DataFrame:
        """(row, taken): words of each document that the mixture takes, repeats counted; rows without any are absent."""
        return self.rows().groupBy("row").agg(F.sum("words").alias("taken"))

    def rows(self) -> DataFrame:
        """The mixture itself: (shard, source_no, k, row, first_word, words)."""
        return self.slots.join(self.parts, ["source_no", "block"]).select("shard", "source_no", "k", "row", "first_word", "words")

    def result(self) -> DataFrame:
        """doc_id, size, source_size, target, taken (and row, source, content: a hash of the text) of every document."""
        of_source = self.sources.select(F.col("source").alias("_source"), "source_size", "target")
        out = self.sized.join(self.taken(), "row", "left").join(of_source, F.col("source").eqNullSafe(F.col("_source")))
        return out.select("row", "doc_id", "source", "content", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def targets(sized: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """Sources by code point, null last, with repeating ``weights``; what is above limit x size is reshared by weight."""
    one = Window.partitionBy(F.lit(0))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    out = sums.withColumn("source_no", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")))
    out = out.withColumn("most", F.col("source_size") * limit).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = one.orderBy("ratio", "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    out = out.withColumn("level", level)
    out = out.withColumn("at", F.row_number().over(by_ratio))
    chosen = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("at", "level"))).over(one)["level"]
    return out.withColumn("target", F.least(F.col("most").cast("double"), chosen * F.col("weight"))).select("source_no", "source", "source_size", "n_rows", "weight", "target")


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` (with a number ``row``) with ``nth``, which counts rows of equal ``key``; a key that a third of all rows have is counted in parts."""
    part = F.shiftright("row", 33)  # the partition that made the row's number
    parts = rows.withColumn("_part", part)
    many = parts.groupBy(*key, "_part").agg(F.count("*").alias("_many"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    many = many.withColumn("_before", F.coalesce(F.sum("_many").over(before), F.lit(0))).where("_before > 0").drop("_many")
    own = Window.partitionBy(*key, "_part").orderBy("row")
    same = lambda a, b: [a[c].eqNullSafe(b[f"_{c}"]) for c in key]
    many = many.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("_part").alias("_of"), "_before")
    out = parts.withColumn("_local", F.row_number().over(own) - 1)
    out = out.join(many, [*same(out, many), out["_part"] == many["_of"]], "left")
    return out.select(*rows.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("nth"))


def dealt(counted: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, source_no, k) of all slots of ``counted``: source_no, n_slots."""
    spark, long = counted.sparkSession, lambda x: F.lit(x).cast("long")
    one = Window.partitionBy(F.lit(0)).orderBy("source_no")
    ends = counted.where("n_slots > 0").select("source_no", "n_slots", F.sum("n_slots").over(one).alias("upto"))
    ends = written(ends, "ends")
    total = ends.agg(F.max("upto")).first()[0] or 0
    shards = spark.range(-(-total // shard_slots)).withColumnRenamed("id", "shard").repartition("shard")
    # each slot draws one of ``total`` numbers; the source in whose range it falls is the slot's
    drawn = shards.withColumn("slot", F.explode(F.sequence(long(0), F.least(long(shard_slots), long(total) - F.col("shard") * shard_slots) - 1)))
    drawn = drawn.select("shard", F.pmod(F.xxhash64("shard", "slot", F.lit(seed)), long(max(total, 1))).alias("at"))
    cells = 4096  # of equal width; most lie inside one source's range, and the others are few
    width = -(-max(total, 1) // cells)
    ranges = ends.select("source_no", (F.col("upto") - F.col("n_slots")).alias("from"), "upto")
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.expr(f"from div {width}"), F.expr(f"(upto - 1) div {width}"))))
    drawn = drawn.withColumn("cell", F.expr(f"at div {width}")).join(ranges, "cell").where("at >= from and at < upto")
    counts = written(drawn.groupBy("shard", "source_no").agg(F.count("*").alias("n")), "counts")
    # a source's slots are numbered through the shards, those up to its number count
    of_source = counts.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    before = Window.partitionBy("source_no").orderBy("shard")
    placed = counts.withColumn("first", F.sum("n").over(before) - F.col("n")).join(ends.select("source_no", "n_slots"), "source_no")
    placed = placed.withColumn("last", F.least(F.col("first") + F.col("n"), "n_slots") - 1).where("first <= last")
    slots = placed.select("shard", "source_no", F.explode(F.sequence("first", "last")).alias("k"))
    lacking = ends.join(of_source, "source_no", "left").select("source_no", F.coalesce("drawn", long(0)).alias("drawn"), "n_slots").where("drawn < n_slots")
    lacking = lacking.withColumn("run", F.explode(F.sequence(F.expr(f"drawn div {shard_slots}"), F.expr(f"(n_slots - 1) div {shard_slots}"))))
    lacking = lacking.select("source_no", F.explode(F.sequence(F.greatest(F.col("run") * shard_slots, "drawn"), F.least((F.col("run") + 1) * shard_slots, "n_slots") - 1)).alias("k"))
    return slots.union(lacking.select(F.pmod(F.xxhash64("source_no", "k", F.lit(seed)), long(max(-(-total // shard_slots), 1))), "source_no", "k"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, block_words: int = 64, shard_slots: int = 4096, bucket_rows: int = 1024, seed: int = 7) -> Mixture:
    long = lambda x: F.lit(x).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size"), F.xxhash64("text").alias("content")), "sized")
    sources = written(targets(sized, weights, limit), "targets")

    # documents in buckets of one source, with the words before them in the bucket
    of_source = sources.select(F.col("source").alias("_source"), "source_no", "n_rows")
    placed = sized.where("size > 0").join(of_source, F.col("source").eqNullSafe(F.col("_source")))
    placed = numbered(placed.select("source_no", "n_rows", "row", "doc_id", "content", "size"), ["source_no", "doc_id", "content"])
    n_buckets = F.ceil(F.col("n_rows") / bucket_rows).cast("long")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "content", "nth", F.lit(seed)), n_buckets))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "content", "nth")
    placed = written(placed.select("source_no", "bucket", "row", "size", (F.sum("size").over(inside) - F.col("size")).alias("before")), "placed")

    # the first block of every bucket
    blocks = placed.groupBy("source_no", "bucket").agg(F.ceil(F.sum("size") / block_words).cast("long").alias("n_blocks"))
    blocks = written(blocks.withColumn("first_block", F.sum("n_blocks").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("n_blocks")), "blocks")
    first, last = F.expr(f"before div {block_words}"), F.expr(f"(before + size - 1) div {block_words}")
    parts = placed.join(blocks, ["source_no", "bucket"]).select("source_no", "first_block", "row", "size", "before", F.explode(F.sequence(first, last)).alias("local"))
    begin = F.greatest("before", F.col("local") * long(block_words))
    end = F.least(F.col("before") + F.col("size"), (F.col("local") + 1) * long(block_words))
    parts = parts.select("source_no", (F.col("first_block") + F.col("local")).alias("block"), "row", (begin - F.col("before")).alias("first_word"), (end - begin).alias("words"))

    # slots: so many of each source that their words come to its target
    counted = sources.join(blocks.groupBy("source_no").agg(F.sum("n_blocks").alias("n_blocks")), "source_no")
    slots_of = F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"), F.col("n_blocks") * limit)
    counted = written(counted.select("source_no", "n_blocks", slots_of.alias("n_slots")), "counted")
    slots = dealt(counted, shard_slots, seed).join(counted.select("source_no", "n_blocks"), "source_no")
    turn = F.expr("k div n_blocks")
    block = permuted(F.col("k") - turn * F.col("n_blocks"), F.col("n_blocks"), F.xxhash64("source_no", turn, F.lit(seed)))
    return Mixture(sized, sources, parts, written(slots.select("shard", "k", "source_no", block.alias("block")), "slots"))
