"""The text form of sheets, as lines in a DataFrame, and its decoder.

A document is (sheet, part, line_no, text): "grid" lines are rows with bars between fields, "index" and "block" lines are a token after
its spans. Lines of a grid know their row by their label or by the line before, so the decoder needs one running value:
the last label and the lines since. That is found per range of lines and carried over by a join, not by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import coords
from gridloom.operators import cover
from gridloom.operators.cells import numbered
from gridloom.sources.scratch import written

QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"')
SPAN = re.compile(r"([A-Z]{1,3})(\d+)(?::([A-Z]{1,3})(\d+))?(?:/(\d+))?")
CHUNK = 1000  # lines of a running value's range


def encoded(cells: DataFrame, encoding: str = "grid", choice: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """(sheet, part, line_no, text) of all sheets in one encoding, or with "auto" of each sheet in the one that costs least.

    "hybrid" has lines of blocks, ranges of one token that cost less so, and grid lines of all other cells. What is known of the cells need not be found again:
    ``choice`` (sheet, encoding) for "auto", and their ``spans`` (``cover.strides(cover.rectangles(cells))``).
    """
    if encoding not in ("auto", "grid", "index", "hybrid"):
        raise ValueError(f"{encoding} isn't an encoding")
    if encoding != "grid" and spans is None:
        cells = written(cells.select("sheet", "row", "col", "token"), "cells")  # a hybrid reads them three times
        spans = written(cover.strides(cover.rectangles(cells)), "spans")
    elif encoding == "auto":
        cells = written(cells.select("sheet", "row", "col", "token"), "cells")
    if encoding == "auto":
        choice = written(cover.costs(cells, spans=spans), "choice") if choice is None else choice
        chosen = F.broadcast(choice.select("sheet", F.col("encoding").alias("_encoding")))  # a row a sheet
        used = {r[0] for r in choice.select("encoding").distinct().collect()}  # three at most
        of = lambda df, e: df.join(chosen, "sheet").where(F.col("_encoding") == e).drop("_encoding")
        return reduce(DataFrame.unionByName, [encoded(of(cells, e), e, spans=of(spans, e)) for e in ("grid", "index", "hybrid") if e in used or e == "grid"])
    start = cells.groupBy("sheet").agg(F.min("col").alias("start"))
    head = start.select("sheet", F.lit("start").alias("part"), F.lit(0).alias("line_no"), coords.column_letters(F.col("start")).alias("text"))
    if encoding == "grid":
        return head.unionByName(_grid(cells, start))
    if encoding == "index":
        return _index(cover.index_lines(spans), "index")
    spans = written(cover.block_gains(spans), "blocks")
    return head.unionByName(_index(cover.index_lines(spans), "block")).unionByName(_grid(cover.residual(cells, spans), start))


def _grid(cells: DataFrame, start: DataFrame) -> DataFrame:
    return cover.grid_lines(cells, start=start).select("sheet", F.lit("grid").alias("part"), F.col("row").alias("line_no"), F.col("line").alias("text"))


def _index(lines: DataFrame, part: str) -> DataFrame:
    """Numbered in the order of their first cells, over all sheets."""
    return numbered(lines, ["sheet", "first_row", "first_col"], "line_no").select("sheet", F.lit(part).alias("part"), "line_no", F.col("line").alias("text"))


def fields(line: str, start: int) -> tuple[int | None, list[tuple[int, str]]]:
    """(label, fields) of a grid line: (column, token) pairs, runs expanded."""
    label, at = None, 0
    if m := re.match(r"(\d+):", line):
        label, at = int(m[1]), m.end()
    col, out = start, []
    while at < len(line):
        if line[at] == "|":
            col, at = col + 1, at + 1
            continue
        if m := re.compile(r"([A-Z]{1,3})=").match(line, at):
            col, at = coords.index(m[1]), m.end()
        m = QUOTED.match(line, at)
        end = m.end() if m else at
        if not m and line.startswith("@", at) and (q := QUOTED.search(line, at)) and line.find("|", at, q.start()) < 0:
            end = q.end()
        stop = line.find("|", end)
        stop = len(line) if stop < 0 else stop
        token, at, n = line[at:stop], stop + 1, 1
        if m := re.search(r"\*(\d+)$", token):
            token, n = token[: m.start()], int(m[1])
        out += [(col + i, token) for i in range(n)]
        col += n
    return label, out


def decoded(lines: DataFrame) -> DataFrame:
    """(sheet, row, col, token) of a document."""
    grid, index = lines.where("part = 'grid'"), lines.where("part in ('index', 'block')")
    start = lines.where("part = 'start'").select("sheet", F.col("text").alias("start"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, n, *fields(t, coords.index(c))) for s, n, t, c in zip(*(batch.column(x).to_pylist() for x in ("sheet", "line_no", "text", "start")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([[{"col": c, "token": t} for c, t in r[3]] for r in rows], pa.list_(pa.struct([("col", pa.int32()), ("token", pa.string())])))], names=["sheet", "line_no", "label", "fields"])

    held = grid.join(F.broadcast(start), "sheet").select("sheet", "line_no", "text", "start").mapInArrow(split, "sheet string, line_no int, label int, fields array<struct<col:int,token:string>>")
    held = written(held, "fields")  # read twice, and lines may be dear to make
    # lines are numbered by their order; a row is the last label plus the lines since it
    held = held.withColumn("chunk", F.floor(F.col("line_no") / CHUNK))
    inside = Window.partitionBy("sheet", "chunk").orderBy("line_no")
    held = held.withColumn("n", F.row_number().over(inside)).withColumn("base", F.last(F.col("label") - F.col("n"), ignorenulls=True).over(inside))
    ends = held.groupBy("sheet", "chunk").agg(F.max("n").alias("size"), F.max_by("base", "n").alias("base"))
    over = Window.partitionBy("sheet").orderBy("chunk")
    ends = ends.withColumn("end", F.col("base") + F.col("size")).withColumn("total", F.sum("size").over(over))
    carried = F.last(F.col("end") - F.col("total"), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)) + F.col("total") - F.col("size")
    held = held.join(ends.select("sheet", "chunk", carried.alias("carry")), ["sheet", "chunk"])
    rows = held.select("sheet", F.coalesce(F.col("base") + F.col("n"), F.col("carry") + F.col("n")).alias("row"), F.explode("fields").alias("f")).select("sheet", "row", "f.col", "f.token")
    # a ditto stands for the last token above in its column, less than one label interval away
    block = Window.partitionBy("sheet", "col", "chunk").orderBy("row")
    filled = rows.withColumn("chunk", F.floor(F.col("row") / 10)).withColumn("token", F.last(F.when(F.col("token") != "^", F.col("token")), ignorenulls=True).over(block)).drop("chunk")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sheet, text in zip(batch.column("sheet").to_pylist(), batch.column("text").to_pylist(), strict=True):
                head, _, token = text.partition("=")
                for m in SPAN.finditer(head):
                    r0, c0 = int(m[2]), coords.index(m[1])
                    out.append((sheet, r0, c0, int(m[4] or r0), coords.index(m[3]) if m[3] else c0, int(m[5] or 1), token))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), *[pa.int32()] * 5, pa.string()))], names=["sheet", "r0", "c0", "r1", "c1", "step", "token"])

    found = index.select("sheet", "text").mapInArrow(spans, "sheet string, r0 int, c0 int, r1 int, c1 int, step int, token string")
    found = found.select("sheet", F.explode(F.sequence("r0", "r1", "step")).alias("row"), "c0", "c1", "token").select("sheet", "row", F.explode(F.sequence("c0", "c1")).alias("col"), "token")
    return filled.withColumn("row", F.col("row").cast("int")).unionByName(found)
