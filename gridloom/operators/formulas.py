"""The formula section of a document: filled formulas as one line for all their cells, and its decoder.

A cell's formula is written relative to the cell. Cells whose relative forms are equal, which give each cell's formula back, make one
line with the formula of its first cell and the ranges over which that is to be filled: exact rectangles and strided spans. Formulas that a fill to the side or downwards
would change otherwise than a copy are never joined in that direction. Everything else stands alone: texts with line breaks, array formulas, data tables.

Lines are (sheet, first_row, first_col, line) and have their order from their first cell. A line holds the ranges of one block of rows, so that no line
grows with the sheet; a formula of a long column is one range for each block at least.

Cells are dealt out by strips of rows, and a task reads each of its strips once, by rows. Only what a strip can't settle meets what other strips left: rectangles at
its edges, and the ends of progressions of lone cells. The decoder cuts spans and deals them out before it fills them, as one line may be a whole column.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import coords, formula, tokens
from gridloom.operators import strides
from gridloom.operators.document import SPAN
from gridloom.sources.scratch import written

BLOCK = 65536  # rows of a line
STRIP = 8192  # rows that are dealt out together
MOST_HELD = 1 << 17  # lone cells that a task holds before it looks for their spans
MOST_CELLS = 1 << 14  # of a piece of a span
FEW = 24  # cells of a column that are filled one by one
LINE, SPREAD, PIECE, EDGE = range(4)  # finished lines, finished spans, pieces of lone cells, rectangles at a strip's edge
FOUND = "what int, sheet string, key string, r0 int, c0 int, r1 int, c1 int, step int, n int, flush boolean, loose boolean, line string"
SPANS = "sheet string, key string, r0 int, c0 int, r1 int, c1 int, step int"
LINES = "sheet string, first_row int, first_col int, line string"
CELLS = "sheet string, row int, col int, formula string, formula_kind string, formula_ref string"
SECTION = "sheet string, row int, col int, kind string, attributes string, text string, r0 int, c0 int, r1 int, c1 int, step int"
_HEAD = re.compile(r"[A-Z]{1,3}\d+(?::[A-Z]{1,3}\d+)?(?:/\d+)?(?:,[A-Z]{1,3}\d+(?::[A-Z]{1,3}\d+)?(?:/\d+)?)*")
_ONE = r'^(?P<c>[A-Z]{1,3})(?P<r>[0-9]+)(?:\[(?P<k>array|dataTable)(?: (?P<a>[^"\]]*))?\])?(?P<t>[=~](?s:.*))?$'
COLUMNS = {
    LINE: ("sheet", "r0", "c0", "line"), SPREAD: ("sheet", "key", "r0", "c0", "r1", "c1", "step"), PIECE: ("sheet", "key", "r0", "c0", "c1", "step", "n", "flush"),
    EDGE: ("sheet", "key", "r0", "c0", "r1", "c1", "loose"),
}
letters, column = lru_cache(coords.MAX_COLUMN)(coords.letters), lru_cache(coords.MAX_COLUMN)(coords.index)


@lru_cache(None)
def _schema(fields: str) -> pa.Schema:
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(n, types[t]) for n, t in (f.split() for f in fields.split(", "))])


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    schema = _schema(fields)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of columns of texts, which may be null, and of numbers, which may not."""
    return zip(*[batch.column(n).to_numpy(zero_copy_only=False).tolist() for n in names], strict=True)


def area(r0: int, c0: int, r1: int, c1: int) -> str:
    """A6 or A6:Q9."""
    return f"{letters(c0)}{r0}" if r0 == r1 and c0 == c1 else f"{letters(c0)}{r0}:{letters(c1)}{r1}"


class Strip:
    """Formulas of a sheet in the order of rows and columns, a strip of rows at a time, as rows of ``FOUND``.

    Finished lines have r0, c0 and line. Of other formulas it finds the rectangles with equal relative forms: such as touch an edge of the strip, with loose if they
    may be joined to spans; finished spans; and, for each key and pair of columns, the first and last rows of lone cells, whose spans depend on other strips.
    """

    def __init__(self) -> None:
        self.sheet, self.strip, self.row = None, None, None
        self.open: dict[tuple[str, int, int], tuple[int, str]] = {}  # rectangles that reach the row before, with their first row and formula
        self.runs: list[tuple[str, int, int, str]] = []
        self.run: list | None = None  # key, first and last column, formula, whether it's locked
        self.points: dict[tuple[str, int, int], list[int]] = {}
        self.held = 0
        self.out: dict[int, list[tuple]] = {k: [] for k in COLUMNS}

    def end_run(self) -> None:
        if self.run is not None:
            key, c0, c1, formula_, lock = self.run
            if lock:
                self.out[LINE].append((self.sheet, self.row, c0, area(self.row, c0, self.row, c1) + formula_))
            else:
                self.runs.append((key, c0, c1, formula_))
            self.run = None

    def end_row(self, row: int | None) -> None:
        """Joins the runs of a row to the rectangles above, and ends those that don't go on."""
        self.end_run()
        now, before, last = {}, self.open, self.row
        for key, c0, c1, formula_ in self.runs:
            now[key, c0, c1] = before.pop((key, c0, c1), None) or (last, formula_)
        if before:
            self.end(before, last - 1)
        self.open, self.runs = now, []
        if now and row != last + 1:
            self.end(now, last)
            self.open = {}
        if self.held > MOST_HELD:
            self.settle()

    def end(self, rectangles: dict, r1: int) -> None:
        for (key, c0, c1), (r0, formula_) in rectangles.items():
            loose = key.endswith("\x03")
            if r0 % STRIP == 0 or r1 % STRIP == STRIP - 1:
                self.out[EDGE].append((self.sheet, key, r0, c0, r1, c1, loose))
            elif not loose:
                self.out[LINE].append((self.sheet, r0, c0, area(r0, c0, r1, c1) + formula_))
            elif r0 < r1:
                self.out[SPREAD].append((self.sheet, key, r0, c0, r1, c1, 1))
            else:
                self.points.setdefault((key, c0, c1), []).append(r0)
                self.held += 1

    def settle(self) -> None:
        for (key, c0, c1), rows in self.points.items():
            spans, pieces = strides.settled(rows)
            self.out[SPREAD] += [(self.sheet, key, r0, c0, r1, c1, step) for r0, r1, step in spans]
            self.out[PIECE] += [(self.sheet, key, first, c0, c1, step, n, flush) for first, step, n, flush in pieces]
        self.points, self.held = {}, 0

    def finish(self) -> None:
        if self.row is not None:
            self.end_row(None)
            self.settle()

    def add(self, sheet: str | None, row: int, col: int, text: str, kind: str | None, ref: str | None) -> None:
        if row != self.row or sheet != self.sheet:
            strip = row // STRIP
            if strip != self.strip or sheet != self.sheet:
                self.finish()
                self.sheet, self.strip, self.open = sheet, strip, {}
            else:
                self.end_row(row)
            self.row = row
        plain = kind is None or kind in ("normal", "shared")
        form, sideways, lock = formula.relative(text, row, col) if plain else (None, False, False)
        if form is None:
            body = "~" + tokens.json_text(text) if "\n" in text or "\r" in text or not text.startswith("=") else text
            mark = f"[array{'' if ref is None else ' ' + ref}]{body}" if kind == "array" else f"[dataTable {text}]" if kind == "dataTable" else body
            self.out[LINE].append((sheet, row, col, f"{letters(col)}{row}{mark}"))
            return
        # a formula that isn't safe to fill to the side gets a key of its own in each column, and so never joins another one
        key, run = f"{form}\x03{col}" if sideways else form + "\x03", self.run
        if run is not None and run[2] == col - 1 and run[0] == key and run[4] == lock:
            run[2] = col
        else:
            if run is not None:
                self.end_run()
            self.run = [key, col, col, text, lock]

    def taken(self) -> Iterator[pa.RecordBatch]:
        """What was found since, a batch for each kind of row."""
        for kind, names in COLUMNS.items():
            if rows := self.out[kind]:
                held = dict(zip(names, zip(*rows, strict=True), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()) if f.name == "what" else pa.array(held[f.name], f.type) if f.name in held else pa.nulls(len(rows), f.type) for f in _schema(FOUND)], schema=_schema(FOUND))
                self.out[kind] = []


def strips(cells: DataFrame) -> DataFrame:
    """Rows of ``FOUND``: strips of rows are dealt out, and each is read once, in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = Strip()
        for batch in batches:
            for held in _rows(batch, "sheet", "row", "col", "formula", "formula_kind", "formula_ref"):
                strip.add(*held)
            yield from strip.taken()
        strip.finish()
        yield from strip.taken()

    cells = cells.where("formula is not null").select("sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "formula", "formula_kind", "formula_ref")
    return cells.repartition("sheet", F.floor(F.col("row") / STRIP)).sortWithinPartitions("sheet", "row", "col").mapInArrow(read, FOUND)


def edges(found: DataFrame) -> DataFrame:
    """Rectangles that touch an edge of a strip, at most two a strip, key and pair of columns, joined over strips."""
    by = ["sheet", "key", "c0", "c1", "loose"]
    along = Window.partitionBy(*by).orderBy("r0")
    edge = found.where(F.col("what") == EDGE).select(*by, "r0", "r1").withColumn("_new", (F.col("r0") != F.coalesce(F.lag("r1").over(along), F.lit(-1)) + 1).cast("int"))
    edge = edge.withColumn("_g", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return edge.groupBy(*by, "_g").agg(F.min("r0").alias("r0"), F.max("r1").alias("r1")).drop("_g")


def seams(pieces: DataFrame) -> DataFrame:
    """Spans (sheet, key, r0, c0, r1, c1, step) of lone cells that strips left open. A strip gives a few pieces for each key and pair of columns, whatever its rows."""
    by = ["sheet", "key", "c0", "c1"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, greedy, out = None, strides.Greedy(), []
        end = lambda: [(place[0], place[1], a, place[2], z, place[3], step) for a, z, step in greedy.taken()]
        for batch in batches:
            for *at, first, step, n, flush in _rows(batch, *by, "r0", "step", "n", "flush"):
                if at != place:
                    if place is not None:
                        greedy.flush()
                        out += end()
                    place = at
                greedy.add(first, step, n)
                if flush:
                    greedy.flush()
            if place is not None:
                out += end()
            yield _batch(out, SPANS)
            out = []
        if place is not None:
            greedy.flush()
            yield _batch(end(), SPANS)

    return pieces.repartition(*by).sortWithinPartitions(*by, "r0").mapInArrow(read, SPANS)


def wide_lines(spans: DataFrame) -> DataFrame:
    """(sheet, first_row, first_col, line): a line for each key and block of rows, with its spans."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, begun, texts, out = None, None, [], []

        def end() -> None:
            # a relative form was tested to give its formula back, so the first cell's formula needs no join with the cells
            if place is not None:
                out.append((place[0], *begun, ",".join(texts) + formula.rendered(place[1][:-1], *begun)))

        for batch in batches:
            for sheet, key, block, r0, c0, r1, c1, step in _rows(batch, "sheet", "key", "_block", "r0", "c0", "r1", "c1", "step"):
                if place != (sheet, key, block):
                    end()
                    place, begun, texts = (sheet, key, block), (r0, c0), []
                texts.append(area(r0, c0, r1, c1) if step == 1 else f"{area(r0, c0, r1, c1)}/{step}")
            yield _batch(out, LINES)
            out.clear()
        end()
        yield _batch(out, LINES)

    by = ["sheet", "key", "_block"]
    return spans.withColumn("_block", F.floor(F.col("r0") / BLOCK)).repartition(*by).sortWithinPartitions(*by, "r0", "c0").mapInArrow(read, LINES)


def lines(cells: DataFrame) -> DataFrame:
    """(sheet, first_row, first_col, line) of all formulas."""
    found = written(strips(cells), "formulas")
    joined = written(edges(found), "edges")
    done = found.where(F.col("what") == LINE).select("sheet", F.col("r0").alias("first_row"), F.col("c0").alias("first_col"), "line")
    lone = (F.col("r0") == F.col("r1")) & F.col("loose")
    pieces = found.where(F.col("what") == PIECE).select("sheet", "key", "c0", "c1", "r0", "step", "n", "flush")
    pieces = pieces.unionByName(joined.where(lone).select("sheet", "key", "c0", "c1", "r0", F.lit(0).alias("step"), F.lit(1).alias("n"), F.lit(False).alias("flush")))
    sides = ["sheet", "key", "r0", "c0", "r1", "c1"]
    spans = found.where(F.col("what") == SPREAD).select(*sides, "step").unionByName(joined.where(F.col("loose") & ~lone).select(*sides, F.lit(1).alias("step")))
    wide = wide_lines(spans.unionByName(seams(pieces)))
    first = formula.formula_rendered(F.regexp_replace("key", "\x03[0-9]*$", ""), F.col("r0"), F.col("c0"))
    alone = joined.where(~F.col("loose")).select("sheet", F.col("r0").alias("first_row"), F.col("c0").alias("first_col"), F.concat(coords.range_text(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1")), first).alias("line"))
    return done.unionByName(written(wide.unionByName(alone), "lines"))


def parsed(line: str) -> tuple[list[tuple[int, int, int, int, int]], str | None, str, str | None]:
    """(spans, kind, attributes, text) of a line; a span is (r0, c0, r1, c1, step)."""
    head = _HEAD.match(line)
    if not head:
        raise ValueError(f"bad formula line {line[:40]!r}")
    spans, at, kind, attributes = [], head.end(), None, ""
    for m in SPAN.finditer(head[0]):
        r0, c0 = int(m[2]), coords.index(m[1])
        spans.append((r0, c0, int(m[4] or r0), coords.index(m[3]) if m[3] else c0, int(m[5] or 1)))
    if line.startswith("[", at):
        stop = at
        while stop < len(line) and line[stop] != "]":
            stop = json.decoder.scanstring(line, stop + 1)[1] if line[stop] == '"' else stop + 1
        if stop >= len(line):
            raise ValueError(f"missing ] in {line[:40]!r}")
        kind, _, attributes = line[at + 1 : stop].partition(" ")
        if kind not in ("array", "dataTable"):
            raise ValueError(f"{kind!r} isn't a kind of formula")
        at = stop + 1
    rest = line[at:]
    return spans, kind, attributes, json.loads(rest[1:]) if rest.startswith("~") else rest if rest.startswith("=") else None


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of lines that begin with one cell."""
    for batch in batches:
        found = pc.extract_regex(batch.column("line"), _ONE)
        known = found.is_valid()
        if known.true_count:
            sheet, found = batch.column("sheet").filter(known), found.filter(known)
            letters_, row, kind, attributes, text = found.flatten()
            names = letters_.dictionary_encode()
            col = pa.array([column(c) for c in names.dictionary.to_pylist()], pa.int32()).take(names.indices)
            quoted = pc.starts_with(text, "~")
            if quoted.true_count:
                text = pc.replace_with_mask(text, quoted, pa.array([json.loads(t[1:]) for t in text.filter(quoted).to_pylist()], text.type))
            none = pa.scalar(None, pa.string())
            text = pc.if_else(pc.or_(pc.not_equal(text, ""), quoted), text, none)
            text = pc.if_else(pc.equal(kind, "dataTable"), attributes, text)
            ref = pc.if_else(pc.and_(pc.equal(kind, "array"), pc.not_equal(attributes, "")), attributes, none)
            kind = pc.if_else(pc.equal(kind, ""), "normal", kind)
            yield pa.RecordBatch.from_arrays([sheet, row.cast(pa.int32()), col, text, kind, ref], schema=_schema(CELLS))
        out = []
        for sheet, line in _rows(batch.filter(pc.invert(known)), "sheet", "line"):
            spans, kind, attributes, text = parsed(line)
            out.append((sheet, *spans[0][:2], attributes if kind == "dataTable" else text, kind or "normal", attributes or None if kind == "array" else None))
        yield _batch(out, CELLS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of lines as rows of ``SECTION``, cut to at most ``MOST_CELLS`` cells or one row."""
    for batch in batches:
        out = []
        for sheet, line in _rows(batch, "sheet", "line"):
            spans, kind, attributes, text = parsed(line)
            for r0, c0, r1, c1, step in spans if kind is None else spans[:1]:
                if r1 < r0 or c1 < c0:
                    raise ValueError(f"bad range in {line[:40]!r}")
                by = step * max(1, MOST_CELLS // (c1 - c0 + 1))
                for r in range(r0, r1 + 1, by):
                    out.append((sheet, *spans[0][:2], kind, attributes, text, r, c0, min(r1, r + by - step), c1, step))
                    if len(out) >= 10_000:
                        yield _batch(out, SECTION)
                        out = []
        yield _batch(out, SECTION)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of rows of ``SECTION``."""
    names = _schema(SECTION).names
    for batch in batches:
        out: list[tuple] = []
        for sheet, row, col, kind, attributes, text, r0, c0, r1, c1, step in _rows(batch, *names):
            rows, ref = range(r0, r1 + 1, step), attributes or None if kind == "array" else None
            for c in range(c0, c1 + 1):
                if kind is not None:
                    out += zip(repeat(sheet), rows, repeat(c), repeat(attributes if kind == "dataTable" else text), repeat(kind), repeat(ref))
                elif text is None or len(rows) < FEW:
                    texts = [None] * len(rows) if text is None else formula.fills(text, [x - row for x in rows], c - col)
                    out += zip(repeat(sheet), rows, repeat(c), texts, repeat("normal"), repeat(None))
                else:
                    at = np.arange(r0, r1 + 1, step, dtype="int32")
                    same = lambda v, type_: pa.repeat(pa.scalar(v, type_), len(at))
                    texts = formula.filled(text, at.astype("int64") - row, c - col)
                    yield pa.RecordBatch.from_arrays([same(sheet, pa.string()), pa.array(at), same(c, pa.int32()), texts, same("normal", pa.string()), pa.nulls(len(at), pa.string())], schema=_schema(CELLS))
                if len(out) >= 10_000:
                    yield _batch(out, CELLS)
                    out = []
        yield _batch(out, CELLS)


def decoded(section: DataFrame) -> DataFrame:
    """(sheet, row, col, formula, formula_kind, formula_ref) of lines (sheet, line): the first cell's formula filled to the others. Data tables have their settings as formula.

    A line's spans may have as many cells as the sheet, so they are cut and dealt out before they are filled.
    """
    section = section.select("sheet", "line")
    wide = F.coalesce(F.col("line").rlike("^[A-Z]{1,3}[0-9]+[:,/]"), F.lit(False))
    tasks = int(section.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = section.where(wide).mapInArrow(_cut, SECTION).repartition(tasks).mapInArrow(_filled, CELLS)
    return section.where(~wide).mapInArrow(_single, CELLS).unionByName(cells)
