"""Groups of ranges that overlap each other, directly or by way of others, without comparing all pairs.

Ranges are cut at blocks of 64 rows and columns. Ranges that look alike inside a block overlap there, so each block sees each look once, of which there is a fixed number; a
block's looks are painted one over another on a grid of its cells, which tells what meets what. That leaves at most one link a range and block, and links are joined
to groups over all blocks in rounds of DataFrame joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import cells as C
from gridloom.sources.scratch import written

SIDE = 64
RANGE = ["sheet", "r0", "c0", "r1", "c1"]


def _painted(block: pa.Table) -> pa.Table:
    """Links (a, b) between looks of a block (id, r0, c0, r1, c1), a spanning tree of each group."""
    ids, *sides = (block.column(c).to_numpy() for c in ("id", "r0", "c0", "r1", "c1"))
    grid, out = np.full((SIDE, SIDE), -1, np.int64), []
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (r0, c0, r1, c1) in enumerate(zip(*(s.tolist() for s in sides), strict=True)):
        area = grid[r0 : r1 + 1, c0 : c1 + 1]
        for j in np.unique(area[area >= 0]).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((int(ids[i]), int(ids[j])))
        area[:] = i
    return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def links(ranges: DataFrame) -> DataFrame:
    """(a, b): links between ids of ranges (id, sheet, r0, c0, r1, c1) that connect exactly those that overlap directly or by way of others."""
    at = lambda c, b: F.floor(F.col(c) / SIDE) if b is None else F.sequence(F.floor(F.col(b[0]) / SIDE), F.floor(F.col(b[1]) / SIDE))
    cut = ranges.select("*", F.explode(at("r0", ("r0", "r1"))).alias("_r")).select("*", F.explode(at("c0", ("c0", "c1"))).alias("_c"))
    inside = lambda c, b: F.greatest(F.lit(0), F.least(F.lit(SIDE - 1), F.col(c) - F.col(b) * SIDE)).cast("int").alias(c)
    looks = cut.select("id", "sheet", "_r", "_c", inside("r0", "_r"), inside("c0", "_c"), inside("r1", "_r"), inside("c1", "_c"))
    look = ["sheet", "_r", "_c", "r0", "c0", "r1", "c1"]
    held = written(looks, "looks")
    firsts = written(held.groupBy(look).agg(F.min("id").alias("first")), "firsts")
    alike = held.join(firsts, look).where("id > first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    painted = firsts.withColumnRenamed("first", "id").groupBy("sheet", "_r", "_c").applyInArrow(_painted, "a bigint, b bigint")
    return alike.union(painted)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches.

    Stars are built in turns: every node hands its larger neighbours to its smallest one, then its smaller neighbours. The number of
    edges never grows, and both sides of a join are tables, which Spark may split where a node has many.
    """
    edge = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now = written(edge(edges), "edges")
    nodes = written(now.select("a").union(now.select("b")).distinct(), "nodes")
    told = None
    while True:
        both = written(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = written(edge(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        now = written(edge(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == told:
            return nodes.join(now.withColumnsRenamed({"a": "node", "b": "root"}), F.col("a") == F.col("node"), "left").select(F.col("a").alias("node"), F.coalesce("root", "a").alias("root"))
        told = state


def overlap_groups(ranges: DataFrame) -> DataFrame:
    """Distinct ranges (sheet, r0, c0, r1, c1) with ``group_row`` and ``group_col``, the corner of the first range of their group by row and column."""
    ids = C.numbered(ranges.select(RANGE).distinct(), RANGE, "id")
    ids = written(ids.withColumn("id", F.col("id").cast("bigint")), "ranges")
    found = written(connected(links(ids)), "groups")
    out = ids.join(found, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    first = ids.select(F.col("id").alias("_id"), F.col("r0").alias("group_row"), F.col("c0").alias("group_col"))
    return out.join(first, F.col("root") == F.col("_id")).select(*RANGE, "group_row", "group_col")
