"""Rectangles of cells as rows (r0, c0, r1, c1), and joins of cells with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("r0", "c0", "r1", "c1")
BUCKET = 64  # rows that share a key of a range join


def union(a: str, b: str) -> Column:
    """The smallest range that has both."""
    pick = lambda f, side: f(f"{a}.{side}", f"{b}.{side}").alias(side)
    return F.struct(pick(F.least, "r0"), pick(F.least, "c0"), pick(F.greatest, "r1"), pick(F.greatest, "c1"))


def intersection(a: str, b: str) -> Column:
    """What both ranges have; null if they have nothing in common."""
    pick = lambda f, side: f(f"{a}.{side}", f"{b}.{side}")
    r0, c0, r1, c1 = pick(F.greatest, "r0"), pick(F.greatest, "c0"), pick(F.least, "r1"), pick(F.least, "c1")
    return F.when((r0 <= r1) & (c0 <= c1), F.struct(r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1")))


def contains(outer: str, inner: str) -> Column:
    return (F.col(f"{outer}.r0") <= F.col(f"{inner}.r0")) & (F.col(f"{outer}.c0") <= F.col(f"{inner}.c0")) & (F.col(f"{outer}.r1") >= F.col(f"{inner}.r1")) & (F.col(f"{outer}.c1") >= F.col(f"{inner}.c1"))


def disjoint(a: str, b: str) -> Column:
    return intersection(a, b).isNull()


def size() -> Column:
    return (F.col("r1") - F.col("r0") + 1).cast("long") * (F.col("c1") - F.col("c0") + 1)


def shifted(rows: int | Column = 0, columns: int | Column = 0) -> Column:
    """The range moved; null if it would begin before the first row or column."""
    r0, c0 = F.col("r0") + rows, F.col("c0") + columns
    return F.when((r0 > 0) & (c0 > 0), F.struct(r0.alias("r0"), c0.alias("c0"), (F.col("r1") + rows).alias("r1"), (F.col("c1") + columns).alias("c1")))


def grown(right: int = 0, down: int = 0, left: int = 0, up: int = 0) -> Column:
    """The range with so many more cells at each side; negative numbers shrink it."""
    return F.struct((F.col("r0") - up).alias("r0"), (F.col("c0") - left).alias("c0"), (F.col("r1") + down).alias("r1"), (F.col("c1") + right).alias("c1"))


def covers(held: Column, r0: Column, c0: Column, r1: Column | None = None, c1: Column | None = None) -> Column:
    """Whether one of an array of ranges has the whole range, or the cell, in it."""
    r1, c1 = r0 if r1 is None else r1, c0 if c1 is None else c1
    return F.exists(held, lambda r: (r["r0"] <= r0) & (r["c0"] <= c0) & (r["r1"] >= r1) & (r["c1"] >= c1))


def added(held: Column, one: Column) -> Column:
    """An array of ranges with one more, unless it has that already."""
    return F.when(covers(held, *[one[s] for s in SIDES]), held).otherwise(F.array_append(held, one))


def removed(held: Column, one: Column) -> Column:
    """An array of ranges without one of them; null if it isn't one of them."""
    return F.when(F.array_contains(held, one), F.array_remove(held, one))


def ordered(held: Column) -> Column:
    """Ranges by first column, first row, last column, last row."""
    turned = F.transform(held, lambda r: F.struct(r["c0"], r["r0"], r["c1"], r["r1"], r.alias("r")))
    return F.transform(F.sort_array(turned), lambda t: t["r"])


def offset(rows: int = 0, columns: int = 0) -> Column:
    """(row, col) so many places from a cell; null before the first row or column."""
    row, col = F.col("row") + rows, F.col("col") + columns
    return F.when((row > 0) & (col > 0), F.struct(row.alias("row"), col.alias("col")))


def edge(ranges: DataFrame, side: str) -> DataFrame:
    """The cells (row, col) of the top, bottom, left or right line of each range."""
    line = {"top": ("r0", "c0", "r0", "c1"), "bottom": ("r1", "c0", "r1", "c1"), "left": ("r0", "c0", "r1", "c0"), "right": ("r0", "c1", "r1", "c1")}[side]
    lines = ranges.select(F.explode(F.sequence(line[0], line[2])).alias("row"), *[F.col(x).alias(f"_{i}") for i, x in enumerate((line[1], line[3]))])
    return lines.select("row", F.explode(F.sequence("_0", "_1")).alias("col"))


def expanded(ranges: DataFrame) -> DataFrame:
    """The distinct cells (row, col) of all ranges."""
    lines = ranges.select(F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1")
    return lines.select("row", F.explode(F.sequence("c0", "c1")).alias("col")).distinct()


def collapsed(cells: DataFrame) -> DataFrame:
    """One vertical range for each column, from its first cell to its last; gaps between are covered too."""
    return cells.groupBy("col").agg(F.min("row").alias("r0"), F.max("row").alias("r1")).select("r0", F.col("col").alias("c0"), "r1", F.col("col").alias("c1"))


def merged_intervals(lines: DataFrame, first: str = "first", last: str = "last", by: list[str] | None = None) -> DataFrame:
    """Intervals with those joined that overlap or touch."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(first, last)
    reach = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    held = lines.withColumn("_new", (F.col(first) > F.coalesce(reach + 1, F.col(first) - 1)).cast("int")).withColumn("_group", F.sum("_new").over(w))
    return held.groupBy(*by, "_group").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_group")


def in_ranges(cells: DataFrame, ranges: DataFrame, how: str = "inner") -> DataFrame:
    """Cells joined with the ranges that hold them: an equality join on blocks of 64 rows, then the exact test."""
    held = ranges.select("*", F.explode(F.sequence(F.floor(F.col("r0") / BUCKET), F.floor(F.col("r1") / BUCKET))).alias("_block"))
    keyed = cells.withColumn("_at", F.floor(F.col("row") / BUCKET))
    on = (F.col("_at") == F.col("_block")) & F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    return keyed.join(held, on, how).drop("_at", "_block")


def first_anchor(cells: DataFrame, ranges: DataFrame, order: str) -> DataFrame:
    """For each cell in a merged range, the corner of the first range by ``order`` that holds it."""
    found = in_ranges(cells.select("row", "col"), ranges)
    return found.groupBy("row", "col").agg(F.min_by(F.struct("r0", "c0"), order).alias("a")).select("row", "col", F.col("a.r0").alias("anchor_row"), F.col("a.c0").alias("anchor_col"))
