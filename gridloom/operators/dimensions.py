"""Settings of rows and columns, dictionaries of values and of styles: as relations, with counts that combine before exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import cells as C

BLOCK = 4096  # rows that one task joins to stretches before these are joined over blocks


def stretches(rows: DataFrame, settings: list[str]) -> DataFrame:
    """(sheet, first, last, settings): consecutive rows of equal settings as one line.

    Rows are joined inside blocks first; only stretches that touch a block's edge meet in a second window, at most two for
    each block and setting. Repeated rows count once, nulls are equal to each other.
    """
    rows = rows.select("sheet", "row", *settings).distinct().withColumn("_block", F.floor(F.col("row") / BLOCK))
    inside = Window.partitionBy("sheet", "_block", *settings).orderBy("row")
    runs = rows.withColumn("_run", F.col("row") - F.row_number().over(inside)).groupBy("sheet", "_block", "_run", *settings)
    runs = runs.agg(F.min("row").alias("first"), F.max("row").alias("last"))
    touches = (F.col("first") % BLOCK == 0) | (F.col("last") % BLOCK == BLOCK - 1)
    along = Window.partitionBy("sheet", *settings).orderBy("first")
    edge = runs.where(touches).withColumn("_new", (F.col("first") != F.coalesce(F.lag("last").over(along), F.lit(-1)) + 1).cast("int"))
    edge = edge.withColumn("_group", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy("sheet", "_group", *settings).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    names = ["sheet", "first", "last", *settings]
    return runs.where(~touches).select(names).unionByName(joined.select(names))


def outlined(dims: DataFrame, first: int, last: int, level: int = 1, hidden: bool = False) -> DataFrame:
    """Settings (sheet, row, outline_level, hidden) after rows first to last of every sheet were put into an outline."""
    lines = dims.select("sheet").distinct().select("sheet", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("row"))
    put = lines.select("sheet", "row", F.lit(level).alias("outline_level"), F.lit(hidden).alias("hidden"))
    return dims.where(~F.col("row").between(first, last)).select(put.columns).unionByName(put)


def column_groups(col_dims: DataFrame) -> DataFrame:
    """Column settings (min, max) that hold for more than one column."""
    return col_dims.where(F.col("max") > F.col("min"))


def dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, place): distinct values numbered from 0 by their first appearance along ``order``; nulls aren't values."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))
    return C.numbered(firsts, ["_first"], "place", 0).select(value, "place")


def canonical(styles: DataFrame, style: str, keys: list[str]) -> DataFrame:
    """``styles`` with ``canonical``: the smallest style that has equal values in ``keys``, nulls being equal."""
    firsts = styles.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(style).alias("canonical"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return styles.join(firsts, same).select(*styles.columns, "canonical")


def usage(cells: DataFrame, style: str) -> DataFrame:
    """(style, n): the styles that cells use, and how often."""
    return cells.where(F.col(style).isNotNull()).groupBy(style).agg(F.count("*").alias("n"))


def outside_strides(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Cells that no span (r0, c0, r1, c1, step) of their sheet covers, whatever the spans are of.

    A span becomes one row for each of its rows, not for each of its cells; a row of a sheet and a block of columns is where cells and spans meet. Both are
    dealt out and sorted: the rows of spans are many more than the file of spans lets expect, too many for each task to hold.
    """
    block = 256
    met = spans.select("sheet", F.explode(F.sequence("r0", "r1", "step")).alias("row"), "c0", "c1")
    met = met.withColumn("_b", F.explode(F.sequence(F.floor(F.col("c0") / block), F.floor(F.col("c1") / block)))).withColumnsRenamed({"sheet": "_s", "row": "_r"})
    own = cells.withColumn("_c", F.floor(F.col("col") / block))
    inside = (F.col("sheet") == F.col("_s")) & (F.col("row") == F.col("_r")) & (F.col("_c") == F.col("_b")) & F.col("col").between(F.col("c0"), F.col("c1"))
    return own.join(met.hint("merge"), inside, "left_anti").drop("_c")
