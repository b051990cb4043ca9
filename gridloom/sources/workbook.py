"""Workbooks as DataFrames, of any size and on any store that Spark reads: sheets are split, and written by all tasks.

Reading: ``cells`` takes the compressed parts out of the archives, inflates each part once and cuts it between rows, deals the pieces out evenly and parses
them in Arrow batches; shared strings are joined by their number. ``relation`` reads the rest (see ``xlsx.SCHEMAS``), for which no cell is parsed.

Writing: ``save`` makes every line of XML a row (part, section, k1, k2, xml), orders these by ranges, and has each task compress its stretch of a part
and take its checksum. Then one task a workbook strings the compressed pieces together behind each other, writes the directory and
renames the file. Neither cells nor pieces pass through the driver; a failed or repeated task leaves no half-written workbook under the path.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, groupby
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import compact, coords, dates
from gridloom.sources import package, scan, xlsx
from gridloom.sources.scratch import written

_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
MEMBERS = "file string, sheet string, sheet_no int, method int, dates array<int>, number bigint, data binary"
PIECES = "file string, sheet string, sheet_no int, dates array<int>, number bigint, before int, masters array<struct<si: string, row: int, col: int, text: string>>, data binary"
#: XML of shared strings up to which all tasks get them all; beyond, an exchange joins them to cells.
MOST_BROADCAST = 32 << 20
PIECE = 1 << 20
LINES = 256  # of XML, that are Python texts at once


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split(" ", 1) for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


# reading


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the workbooks at a path, in a folder, or at several with commas between. The content is null where tasks can read parts of the file themselves."""
    paths = [p.strip() for p in path.split(",")]
    if old := [p for p in paths if p.lower().endswith((".xls", ".xlsb"))]:
        raise ValueError(f"{', '.join(old)}: only .xlsx, .xlsm, .xltx and .xltm are read")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sStT][xXmM]").load(paths)
    near = all(p.startswith("file:") for p in found.inputFiles())
    return found.select("path", F.lit(None).cast("binary").alias("content") if near else "content")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[xlsx.Package]:
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            if content.is_valid:
                yield xlsx.Package(path.as_py(), pa.BufferReader(content.as_buffer()))
            else:
                with open("/" + path.as_py().removeprefix("file:").lstrip("/"), "rb") as file:
                    yield xlsx.Package(path.as_py(), file)


def relation(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A relation of ``xlsx.SCHEMAS`` but cells and strings."""
    if name in ("cells", "strings"):
        return cells(spark, path) if name == "cells" else strings(spark, path)
    schema = xlsx.SCHEMAS[name]
    of_book = name in xlsx.OF_BOOK

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book in opened(batches):
            sheets = [None] if of_book else [i for i, s in enumerate(book.sheets) if s[3] == "worksheet"]
            for i in sheets:
                held = []
                for row in xlsx.book_rows(book, name) if of_book else xlsx.sheet_rows(book, i, name):
                    held.append(row)
                    if len(held) >= 10_000:
                        yield batch(held, schema)
                        held = []
                yield batch(held, schema)

    return archives(spark, path).mapInArrow(read, schema)


def xml_bytes(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes of XML of all sheets, and of all shared strings, by the archives' directories."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book in opened(batches):
            size = lambda names, z=book.zip: sum(z.getinfo(n).file_size for n in names)
            yield batch([(size({book.names[s[2].lower()] for s in book.sheets}), size({book.names[n.lower()] for n in book.related(book.main, "sharedStrings")}))], "sheets bigint, strings bigint")

    found = archives(spark, path).mapInArrow(read, "sheets bigint, strings bigint").agg(F.sum("sheets"), F.sum("strings")).first()
    return found[0] or 0, found[1] or 0


def members(spark: SparkSession, path: str, sheet: str | None, of_strings: bool) -> DataFrame:
    """Compressed parts as they stand in the archives, worksheets or shared strings, in numbered chunks: no part is ever held whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book in opened(batches):
            if of_strings:
                for name in book.related(book.main, "sharedStrings")[:1]:
                    method, chunks = book.compressed(name, PIECE)
                    for n, data in enumerate(chunks):
                        yield batch([(book.path, None, None, method, [], n, data)], MEMBERS)
                continue
            dates_ = sorted(book.date_styles())
            for i, (name, _, part, kind) in enumerate(book.sheets):
                if kind == "worksheet" and sheet in (None, name):
                    method, chunks = book.compressed(part, PIECE)
                    for n, data in enumerate(chunks):
                        yield batch([(book.path, name, i, method, dates_, n, data)], MEMBERS)

    found = archives(spark, path).mapInArrow(read, MEMBERS)
    return found.repartition("file", "sheet_no").sortWithinPartitions("file", "sheet_no", "number")


class Inflated(io.RawIOBase):
    """A compressed part, given in chunks, as a stream."""

    def __init__(self, method: int, chunks: Iterable[bytes]):
        self.chunks, self.held, self.ahead = iter(chunks), b"", b""
        self.z = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
        if method not in (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED):
            raise ValueError(f"parts of compression method {method} aren't read")

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        n = 1 << 30 if n < 0 else n
        if self.ahead:
            data, self.ahead = self.ahead[:n], self.ahead[n:]
            return data
        if self.z is None:
            self.held = self.held or next(self.chunks, b"")
            data, self.held = self.held[:n], self.held[n:]
            return data
        out = b""
        while not out and not self.z.eof:
            self.held = self.held or next(self.chunks, b"")
            if not self.held:
                break
            out = self.z.decompress(self.held, n)
            self.held = self.z.unconsumed_tail
        return out or self.z.flush()

    def begin(self, n: int) -> bytes:
        """The first bytes, which are still to be read."""
        while len(self.ahead) < n and (data := Inflated.read_on(self, n)):
            self.ahead += data
        return self.ahead[:n]

    def read_on(self, n: int) -> bytes:
        held, self.ahead = self.ahead, b""
        data = self.read(n)
        self.ahead = held
        return data


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.list_(pa.struct([("si", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string())])), pa.binary()]
    names = ["file", "sheet", "sheet_no", "dates", "number", "before", "masters", "data"]
    rows = ([b.column(c)[i].as_py() for c in ("file", "sheet", "sheet_no", "method", "dates", "data")] for b in batches for i in range(b.num_rows))
    for (file, sheet, at), chunks in groupby(rows, key=lambda r: tuple(r[:3])):
        first = next(chunks)
        method, dates_ = first[3:5]
        stream = Inflated(method, chain(first[5:], (r[5] for r in chunks)))
        if at is None:
            found = ((n, 0, [], piece) for n, piece in scan.string_pieces(stream, PIECE))
        else:
            found = ((p.number, p.before, [dict(zip(("si", "row", "col", "text"), m, strict=True)) for m in p.masters], p.data) for p in sheet_pieces(stream))
        for n, before, masters, piece in found:
            row = (file, sheet, at, dates_, n, before, masters, piece)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


def sheet_pieces(stream: Inflated) -> Iterator[scan.Piece]:
    """Sheets whose names have prefixes are told by their beginning, without the zeros of UTF-16."""
    odd = re.search(rb"<\w+:worksheet\b", stream.begin(1 << 16).replace(b"\0", b""))
    yield from (scan.rewritten_pieces if odd else scan.pieces)(stream, PIECE)


def strings(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, text) of all shared strings."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, first, data in zip(*[b.column(c).to_pylist() for c in ("file", "number", "data")], strict=True):
                found = scan.strings_of(data)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array(range(first, first + len(found)), pa.int32()), pa.array(found, pa.string())], names=["file", "idx", "text"])

    return members(spark, path, None, True).mapInArrow(_cut, PIECES).repartition("file", "number").mapInArrow(read, xlsx.SCHEMAS["strings"])


def cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The relation cells. A missing address is the next one; shared formulas are shifted from their master; kind ``date`` has the serial as value.

    ``seq`` orders the cells of a sheet as they stand in the file, which need not be by row. Of sheets of one name all are read.
    """
    sheets, of_strings = xml_bytes(spark, path)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sheets // (32 << 20) + 1)
    schema = f"file string, {scan.CELLS}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, name, at, dates_, number, before, masters, data = (b.column(c)[i].as_py() for c in ("file", "sheet", "sheet_no", "dates", "number", "before", "masters", "data"))
                piece = scan.Piece(number, before, data, [(m["si"], m["row"], m["col"], m["text"]) for m in masters])
                columns = scan.cell_columns(piece, frozenset(dates_))
                rows = len(columns[0])
                same = [pa.array([file] * rows, pa.string()), pa.array([name] * rows, pa.string()), pa.array([at] * rows, pa.int32())]
                yield pa.RecordBatch.from_arrays([*same, *columns], names=[c.split()[0] for c in schema.split(", ")])

    found = members(spark, path, sheet, False).mapInArrow(_cut, PIECES).repartition(n).mapInArrow(read, schema)
    names = [c.split()[0] for c in xlsx.SCHEMAS["cells"].split(", ")]
    if of_strings:
        held = strings(spark, path).select(F.col("file").alias("_file"), F.col("idx").alias("_idx"), "text")
        held = F.broadcast(held) if of_strings <= MOST_BROADCAST else held
        found = found.join(held, (F.col("file") == F.col("_file")) & (F.col("string_no") == F.col("_idx")), "left").withColumn("value", F.coalesce("value", "text"))
    return found.select(names)


# writing

PARTS = "part string, section int, k1 bigint, k2 bigint, xml string"
FRAGMENTS = "part string, number bigint, crc bigint, size bigint, data binary"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
OF = "http://schemas.openxmlformats.org/package/2006"
#: Places of elements in a sheet; the schema demands this order.
ROOT, VIEWS, FORMAT, COLS, _, DATA, _, FILTER, MERGED, FORMATS, VALIDATIONS, LINKS, MARGINS, DRAWING, TABLES, END = range(16)
#: Settings of sheets by place: a section, and a place in it.
PLACES = {
    "sheetPr": (ROOT, 1), "sheetViews": (VIEWS, 0), "sheetFormatPr": (FORMAT, 0), "sheetProtection": (FILTER, 0), "scenarios": (FILTER, 1), "autoFilter": (FILTER, 2), "printOptions": (MARGINS, 0), "pageMargins": (MARGINS, 1),
    "pageSetup": (MARGINS, 2), "headerFooter": (MARGINS, 3), "rowBreaks": (MARGINS, 4), "colBreaks": (MARGINS, 5),
}
#: Styles that ``save`` knows by itself: general, date, date and time, duration.
GENERAL, DATE, DATETIME, DURATION = range(4)
STYLES = (
    f'{HEAD}<styleSheet xmlns="{scan.MAIN[1:-1]}"><fonts count="1"><font><sz val="11"/><name val="Calibri"/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
    '<borders count="1"><border><left/><right/><top/><bottom/><diagonal/></border></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
    '<cellXfs count="4"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>' + "".join(f'<xf numFmtId="{n}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for n in (14, 22, 46))
    + '</cellXfs><cellStyles count="1"><cellStyle name="Normal" xfId="0" builtinId="0"/></cellStyles></styleSheet>'
)
LONGEST_TEXT = 32_767  # fixed value: the format holds no more characters in a cell


_BAD = r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]"


def _marked(s: Column) -> Column:
    """What would read as _xHHHH_ gets its own line marked so."""
    return F.when(s.contains("_x"), F.regexp_replace(s, "_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")).otherwise(s)


def _allowed(s: Column) -> Column:
    """What XML can't hold becomes _xHHHH_."""
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(_BAD), F.lit(0)))
    return F.when(s.rlike(_BAD), F.aggregate(found, s, lambda out, c: F.replace(out, c, F.concat(F.lit("_x"), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit("_"))))).otherwise(s)


def xml_text(s: Column) -> Column:
    """Character data of a text."""
    return xml_escaped(_allowed(_marked(s)))


def with_xml_text(df: DataFrame, **texts: Column) -> DataFrame:
    """The same for columns of many rows, a step at a time, so that no step is computed twice."""
    for step in (lambda c: texts[c], lambda c: _marked(F.col(c)), lambda c: _allowed(F.col(c)), lambda c: xml_escaped(F.col(c))):
        df = df.withColumns({c: step(c) for c in texts})
    return df


def xml_escaped(s: Column) -> Column:
    out = F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(s.rlike("[&<>]"), out).otherwise(s)


def xml_attribute(name: str, value: Column) -> Column:
    """An attribute, or nothing for null."""
    told = F.replace(F.regexp_replace(xml_escaped(value.cast("string")), "\n", "&#10;"), F.lit('"'), F.lit("&quot;"))
    return F.coalesce(F.concat(F.lit(f' {name}="'), told, F.lit('"')), F.lit(""))


def xml_flag(name: str, value: Column) -> Column:
    return F.when(value, f' {name}="1"').otherwise("")


@F.udf(T.StringType())
def _setting(name, text):
    """XML of a setting in compact form, without links to parts that aren't written. There are a few a sheet."""
    x = compact.decode_items(name, text or "")
    for y in x.iter():
        for k in [k for k in y.attrib if k.startswith(xlsx.REL)]:
            del y.attrib[k]
    return ET.tostring(x, encoding="unicode")


def cells_xml(cells_: DataFrame, date1904: bool = False) -> DataFrame:
    """With a column xml, ``<c>``, for each row (row, col, kind, value, and if there: formula, formula_kind, formula_ref, formula_group, style).

    Text stands inline, cut at the length that the format allows; dates are serials: a date's value is a serial or ISO text, and its style one that shows dates unless
    another is given. A cell without a value has its style and formula.
    """
    given = {"formula": "string", "formula_kind": "string", "formula_ref": "string", "formula_group": "string", "style": "int"}
    df = cells_.withColumns({c: F.lit(None).cast(t) for c, t in given.items() if c not in cells_.columns})
    value, kind = F.col("value"), F.col("kind")
    df = df.withColumn("kind", F.coalesce("kind", F.lit("number")))
    df = with_xml_text(df, _text=F.when(kind == "text", F.substring(value, 1, LONGEST_TEXT)).otherwise(value), _formula=F.regexp_replace("formula", "^=", ""))
    serial = F.when(kind == "date", F.coalesce(value.try_cast("double"), dates.to_serial(value.try_cast("timestamp_ntz"), date1904)))
    df = df.withColumn("_serial", serial)
    shown = F.when(F.col("_serial") == F.floor("_serial"), F.floor("_serial").cast("string")).otherwise(F.col("_serial").cast("string"))
    style = F.when((kind == "date") & (F.coalesce("style", F.lit(0)) == 0), F.when(value.rlike("[0-9]:[0-9]"), DATETIME).otherwise(DATE)).otherwise(F.coalesce("style", F.lit(0)))
    table = F.concat(F.lit('<f t="dataTable" '), F.regexp_replace("_formula", r"(\w+)=(\S+)", '$1="$2"'), F.lit("/>"))
    told = F.concat(F.lit("<f"), xml_attribute("t", F.when(F.col("formula_kind") != "normal", F.col("formula_kind"))), xml_attribute("ref", F.col("formula_ref")), xml_attribute("si", F.col("formula_group")), F.when(F.col("_formula") == "", "/>").otherwise(F.concat(F.lit(">"), F.col("_formula"), F.lit("</f>"))))
    content = F.when(kind == "date", shown).when(kind == "bool", F.when(F.upper(value).isin("TRUE", "1"), "1").otherwise("0")).otherwise(F.col("_text"))
    inline = (kind == "text") & F.col("formula").isNull()
    df = df.withColumns({"_style": style, "_told": F.when(F.col("formula_kind") == "dataTable", table).when(F.col("formula").isNotNull(), told).otherwise(""), "_content": content, "_inline": inline})
    space = F.when(value.rlike(r"^\s|\s$|\n"), ' xml:space="preserve"').otherwise("")
    body = F.when(F.col("_content").isNull(), F.col("_told")).when(F.col("_inline"), F.concat(F.lit("<is><t"), space, F.lit(">"), F.col("_content"), F.lit("</t></is>"))).otherwise(F.concat(F.col("_told"), F.lit("<v>"), F.col("_content"), F.lit("</v>")))
    mark = F.when(F.col("_content").isNull(), "").when(F.col("_inline"), ' t="inlineStr"').when(kind == "text", ' t="str"').when(kind == "bool", ' t="b"').when(kind == "error", ' t="e"').otherwise("")
    df = df.withColumns({"_body": body, "_mark": mark})
    at = F.concat(F.lit('<c r="'), coords.coordinate(F.col("row"), F.col("col")), F.lit('"'), F.when(F.col("_style") != 0, F.concat(F.lit(' s="'), F.col("_style").cast("string"), F.lit('"'))).otherwise(""))
    return df.withColumn("xml", F.concat(at, "_mark", F.when(F.col("_body") == "", "/>").otherwise(F.concat(F.lit(">"), F.col("_body"), F.lit("</c>")))))


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered lines of XML to compressed pieces of about a megabyte each. Rows get their elements here, since one row is never in two tasks.

    Pieces of a part are numbered by section, task and place; sections of one run of tasks follow each other, so those that others stand between are cut.
    """
    from pyspark import TaskContext

    base, n, at = TaskContext.get().partitionId() << 24, 0, 0
    part: str | None = None
    row: int | None = None
    out: list[str] = []
    size = 0

    def cut() -> Iterator[pa.RecordBatch]:
        nonlocal out, size, n
        if out:
            crc, length, data = package.deflated("".join(out).encode())
            yield batch([(part, (at << 56) + base + n, crc, length, data)], FRAGMENTS)
            out, size, n = [], 0, n + 1

    for b in (b.slice(i, LINES) for b in batches for i in range(0, b.num_rows, LINES)):
        for name, section, k1, k2, xml in zip(*[c.to_pylist() for c in b.columns], strict=True):
            inside = section == DATA and k2 is not None
            if row is not None and (name != part or not inside or k1 != row):
                out.append("</row>")
                row = None
            if name != part or size > PIECE or section != at:
                yield from cut()
                part, at = name, section
            if inside and row is None:
                row = k1
                out.append(f'<row r="{k1}"{xml if k2 < 0 else ""}>')
                xml = "" if k2 < 0 else xml
            out.append(xml)
            size += len(xml)
    if row is not None:
        out.append("</row>")
    yield from cut()


def save(
    cells_: DataFrame, path: str, *, sheets: list[str] | None = None, states: dict[str, str] | None = None, merged: DataFrame | None = None, hyperlinks: DataFrame | None = None, comments: DataFrame | None = None,
    row_dims: DataFrame | None = None, col_dims: DataFrame | None = None, validations: DataFrame | None = None, cond_formats: DataFrame | None = None, tables: DataFrame | None = None,
    defined_names: DataFrame | None = None, properties: DataFrame | None = None, styles: str | None = None, pivot_cache: DataFrame | None = None, pivot_order: list[str] | None = None,
    pivot_source: tuple[str, str] | None = None, settings: DataFrame | None = None, date1904: bool = False, overwrite: bool = False,
) -> int:
    """Write a workbook, and return its bytes. All relations are in the columns of ``xlsx.SCHEMAS`` without the file; see ``cells_xml`` for cells.

    ``sheets`` gives the order of sheets, else they stand by name; cells of other sheets aren't allowed. Of cells with one address the one that sorts last by its XML
    is written last. ``pivot_cache`` are the records of a pivot cache, in the order of ``pivot_order``, of a source (sheet, range). Rows of no sheet, row or column are refused. Driver-side is only what a workbook has few of: names of sheets and parts, defined names, properties.
    """
    spark = cells_.sparkSession
    names = sheets or sorted(r[0] for r in cells_.select("sheet").distinct().collect()) or ["Sheet1"]
    if len({n.lower() for n in names}) < len(names) or any(n is None or not 1 <= len(n) <= 31 or set(n) & set("[]:*?/\\") for n in names):
        raise ValueError("sheets need different names of 1 to 31 characters without []:*?/\\")
    book = F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(names, 1)], "sheet string, sheet_no int"))  # a row for each sheet
    part = lambda kind: F.concat(F.lit(kind[0]), F.col("sheet_no").cast("string"), F.lit(kind[1]))
    sheet_part, rels_part = part(("xl/worksheets/sheet", ".xml")), part(("xl/worksheets/_rels/sheet", ".xml.rels"))
    comment_part, shape_part = part(("xl/comments", ".xml")), part(("xl/drawings/vmlDrawing", ".vml"))
    none, nothing = F.lit(None).cast("bigint"), F.lit("")
    ref = coords.range_text(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"))
    lines: list[DataFrame] = []
    fixed: list[tuple[str, int, int | None, int | None, str]] = []

    def add(df: DataFrame, where: Column, section: int, k1: Column, k2: Column, *xml: Column | str) -> None:
        lines.append(df.select(where.alias("part"), F.lit(section).alias("section"), k1.cast("bigint").alias("k1"), k2.cast("bigint").alias("k2"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xml]).alias("xml")))

    def around(df: DataFrame, section: int, first: str, last: str) -> set[int]:
        """Marks of an element, in those sheets that have it."""
        have = {r[0] for r in df.select("sheet_no").distinct().collect()}
        for i in have:
            fixed.append((f"xl/worksheets/sheet{i}.xml", section, None, None, first))
            fixed.append((f"xl/worksheets/sheet{i}.xml", section, 1 << 62, None, last))
        return have

    def known(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else df.join(book, "sheet")

    for i in range(1, len(names) + 1):
        where = f"xl/worksheets/sheet{i}.xml"
        fixed += [(where, ROOT, None, None, f'{HEAD}<worksheet xmlns="{scan.MAIN[1:-1]}" xmlns:r="{LINK}">'), (where, DATA - 1, None, None, "<sheetData>"), (where, DATA + 1, None, None, "</sheetData>"), (where, END, None, None, "</worksheet>")]
    rows = known(cells_.withColumn("_row_xml", F.lit(None).cast("string")))
    related: set[int] = set()
    if (df := known(row_dims)) is not None:
        height = F.when(F.col("height").isNotNull(), F.concat(xml_attribute("ht", F.col("height")), F.lit(' customHeight="1"'))).otherwise("")
        given = F.concat(height, xml_flag("hidden", F.col("hidden")), F.when(F.col("outline") > 0, xml_attribute("outlineLevel", F.col("outline"))).otherwise(""))
        rows = rows.unionByName(df.select("sheet", "sheet_no", "row", F.lit(-1).alias("col"), given.alias("_row_xml")), allowMissingColumns=True)
    if (df := known(col_dims)) is not None:
        around(df, COLS, "<cols>", "</cols>")
        width = F.when(F.col("width").isNotNull(), F.concat(xml_attribute("width", F.col("width")), F.lit(' customWidth="1"'))).otherwise("")
        add(df, sheet_part, COLS, F.col("first"), F.col("last"), "<col", xml_attribute("min", F.col("first")), xml_attribute("max", F.col("last")), width, xml_flag("hidden", F.col("hidden")), F.when(F.col("outline") > 0, xml_attribute("outlineLevel", F.col("outline"))).otherwise(""), "/>")
    if (df := known(merged)) is not None:
        around(df, MERGED, "<mergeCells>", "</mergeCells>")
        add(df, sheet_part, MERGED, F.col("r0"), F.col("c0"), "<mergeCell", xml_attribute("ref", ref), "/>")
    if cond_formats is not None:
        every = {"type": "type", "operator": "operator", "priority": "priority", "dxfId": "style", "text": "text", "rank": "rank", "stdDev": "deviations", "timePeriod": "period"}
        flags = {"stopIfTrue": "stop", "percent": "percent", "bottom": "bottom", "aboveAverage": "above", "equalAverage": "equal_average"}
        df = known(cond_formats)
        df = df.withColumns({c: F.lit(None).cast("string") for c in [*every.values(), *flags.values()] if c not in df.columns})
        rule = F.concat(F.lit("<cfRule"), *[xml_attribute(n, F.col(c)) for n, c in every.items()], *[xml_attribute(n, F.col(c).cast("boolean").cast("int")) for n, c in flags.items()])
        formulas = F.array_join(F.transform(F.coalesce("formulas", F.array().cast("array<string>")), lambda f: F.concat(F.lit("<formula>"), xml_text(f), F.lit("</formula>"))), "")
        add(df, sheet_part, FORMATS, F.col("priority"), F.lit(0), "<conditionalFormatting", xml_attribute("sqref", F.col("ranges")), ">", rule, ">", formulas, "</cfRule></conditionalFormatting>")
    if (df := known(validations)) is not None:
        around(df, VALIDATIONS, "<dataValidations>", "</dataValidations>")
        told = lambda n: F.coalesce(F.concat(F.lit(f"<{n}>"), xml_text(F.col(n)), F.lit(f"</{n}>")), nothing)
        add(df, sheet_part, VALIDATIONS, F.xxhash64("ranges") % (1 << 40), F.lit(0), "<dataValidation", xml_attribute("type", F.col("type")), xml_attribute("operator", F.col("operator")), xml_flag("allowBlank", F.col("allow_blank")), xml_attribute("sqref", F.col("ranges")), ">", told("formula1"), told("formula2"), "</dataValidation>")
    if (df := known(hyperlinks)) is not None:
        around(df, LINKS, "<hyperlinks>", "</hyperlinks>")
        name = F.concat(F.lit("h"), F.replace(ref, F.lit(":"), F.lit("_")))
        add(df, sheet_part, LINKS, F.col("r0"), F.col("c0"), "<hyperlink", xml_attribute("ref", ref), xml_attribute("r:id", F.when(F.col("target").isNotNull(), name)), xml_attribute("location", F.col("location")), xml_attribute("tooltip", F.col("tooltip")), "/>")
        out = df.where("target is not null")
        related |= {r[0] for r in out.select("sheet_no").distinct().collect()}
        add(out, rels_part, 1, F.col("r0"), F.col("c0"), "<Relationship", xml_attribute("Id", name), f' Type="{LINK}/hyperlink"', xml_attribute("Target", F.col("target")), ' TargetMode="External"/>')
    overrides: list[tuple[str, str]] = []
    if (df := known(comments)) is not None:
        who = df.select("sheet_no", F.coalesce("author", nothing).alias("author")).distinct().withColumn("author_no", F.row_number().over(Window.partitionBy("sheet_no").orderBy("author")) - 1)
        have = {r[0] for r in df.select("sheet_no").distinct().collect()}
        related |= have
        for i in have:
            where, shapes = f"xl/comments{i}.xml", f"xl/drawings/vmlDrawing{i}.vml"
            fixed += [(where, 0, None, None, f'{HEAD}<comments xmlns="{scan.MAIN[1:-1]}"><authors>'), (where, 2, None, None, "</authors><commentList>"), (where, 4, None, None, "</commentList></comments>")]
            fixed += [(shapes, 0, None, None, '<xml xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:x="urn:schemas-microsoft-com:office:excel"><v:shapetype id="_x0000_t202" coordsize="21600,21600" o:spt="202" path="m,l,21600r21600,l21600,xe"/>'), (shapes, 4, None, None, "</xml>")]
            fixed += [(f"xl/worksheets/sheet{i}.xml", DRAWING, None, None, '<legacyDrawing r:id="notes"/>')]
            fixed += [(f"xl/worksheets/_rels/sheet{i}.xml.rels", 2, None, None, f'<Relationship Id="texts" Type="{LINK}/comments" Target="/{where}"/><Relationship Id="notes" Type="{LINK}/vmlDrawing" Target="/{shapes}"/>')]
            overrides.append((where, f"{KIND}.comments+xml"))
        add(who, comment_part, 1, F.col("author_no"), F.lit(0), "<author>", xml_text(F.col("author")), "</author>")
        df = df.withColumn("author", F.coalesce("author", nothing)).join(who, ["sheet_no", "author"])
        add(df, comment_part, 3, F.col("row"), F.col("col"), '<comment ref="', coords.coordinate(F.col("row"), F.col("col")), '" authorId="', F.col("author_no").cast("string"), '"><text><t xml:space="preserve">', xml_text(F.coalesce("text", nothing)), "</t></text></comment>")
        add(df, shape_part, 3, F.col("row"), F.col("col"), '<v:shape type="#_x0000_t202" style="position:absolute;visibility:hidden" fillcolor="#ffffe1" o:insetmode="auto"><v:textbox/><x:ClientData ObjectType="Note"><x:MoveWithCells/><x:SizeWithCells/><x:Row>', (F.col("row") - 1).cast("string"), "</x:Row><x:Column>", (F.col("col") - 1).cast("string"), "</x:Column></x:ClientData></v:shape>")
    if (df := known(tables)) is not None:  # a few a sheet: their numbers are dealt here
        found = df.select("sheet_no", "name", "ref", "columns", "totals_row").orderBy("sheet_no", "ref").collect()
        for i, own_ in groupby(enumerate(found, 1), key=lambda x: x[1]["sheet_no"]):
            own_ = list(own_)
            related.add(i)
            fixed.append((f"xl/worksheets/sheet{i}.xml", TABLES, None, None, "<tableParts>" + "".join(f'<tablePart r:id="table{n}"/>' for n, _ in own_) + "</tableParts>"))
            for n, t in own_:
                columns = "".join(f'<tableColumn id="{k}" name={quoteattr(c)}/>' for k, c in enumerate(t["columns"], 1))
                totals = ' totalsRowCount="1"' if t["totals_row"] else ' totalsRowShown="0"'
                fixed.append((f"xl/tables/table{n}.xml", 0, None, None, f'{HEAD}<table xmlns="{scan.MAIN[1:-1]}" id="{n}" name={quoteattr(t["name"])} displayName={quoteattr(t["name"])} ref="{t["ref"]}"{totals}><tableColumns count="{len(t["columns"])}">{columns}</tableColumns></table>'))
                fixed.append((f"xl/worksheets/_rels/sheet{i}.xml.rels", 3, n, None, f'<Relationship Id="table{n}" Type="{LINK}/table" Target="/xl/tables/table{n}.xml"/>'))
                overrides.append((f"xl/tables/table{n}.xml", f"{KIND}.table+xml"))
    if (df := known(settings)) is not None:  # a few a sheet
        for (name, (section, place)) in PLACES.items():
            add(df.where(F.col("name") == name), sheet_part, section, F.lit(place), F.lit(0), _setting(F.col("name"), F.col("text")))
    if pivot_cache is not None:
        from gridloom.sources import pivots

        told, marks, kinds = pivots.cache_lines(pivot_cache, pivot_order or pivot_cache.columns, *(pivot_source or (names[0], "A1:A1")))
        lines += told
        fixed += marks
        overrides += kinds
    for i in related:
        where = f"xl/worksheets/_rels/sheet{i}.xml.rels"
        fixed += [(where, 0, None, None, f'{HEAD}<Relationships xmlns="{OF}/relationships">'), (where, 4, None, None, "</Relationships>")]
    fixed += [(name, 0, None, None, text) for name, text in book_parts(names, states or {}, overrides, defined_names, properties, styles or STYLES, date1904).items()]
    lines.append(spark.createDataFrame(fixed, PARTS))
    ordered = reduce(DataFrame.unionByName, lines)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names_ = [c.split()[0] for c in PARTS.split(", ")]
    others = ordered.repartitionByRange(n, "part", "section", F.asc_nulls_first("k1")).sortWithinPartitions("part", "section", F.asc_nulls_first("k1"), "k2", "xml")
    # cells are dealt out as they are, and become XML where they are compressed
    rows = rows.repartitionByRange(n, "sheet_no", "row").sortWithinPartitions("sheet_no", "row", "col", *(c for c in ("kind", "value") if c in rows.columns))
    lines_ = cells_xml(rows, date1904).select(sheet_part.alias("part"), F.lit(DATA).alias("section"), F.col("row").cast("bigint").alias("k1"), F.col("col").cast("bigint").alias("k2"), F.coalesce("_row_xml", "xml").alias("xml"))
    fragments = written(lines_.mapInArrow(_compress, FRAGMENTS).union(others.select(names_).mapInArrow(_compress, FRAGMENTS)), "fragments")
    large = written(fragments.groupBy("part").agg((F.sum("size") > (1 << 32) - (1 << 26)).alias("large")), "parts")
    found = fragments.join(F.broadcast(large), "part").repartition(1).sortWithinPartitions(F.col("part") != "[Content_Types].xml", "part", "number")
    return found.select("part", "large", "crc", "size", "data").mapInArrow(_assembler(path, overwrite), "bytes bigint").first()[0]


def _assembler(path: str, overwrite: bool):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))
        if not overwrite and store.get_file_info(where).type != fs.FileType.NotFound:
            raise FileExistsError(path)
        archive, new = package.Archive(), f"{where}.{uuid.uuid4().hex}"
        each = ([c[i].as_py() for c in b.columns] for b in batches for i in range(b.num_rows))  # one piece at a time
        rows = ((name, large, (crc, size, data)) for name, large, crc, size, data in each)
        with store.open_output_stream(new) as out:
            for (name, large), own in groupby(rows, key=lambda r: r[:2]):
                for data in archive.part(name, (r[2] for r in own), large):
                    out.write(data)
            for data in archive.directory():
                out.write(data)
            size = out.tell()
        store.move(new, where)
        yield batch([(size,)], "bytes bigint")

    return assemble


def book_parts(names: list[str], states: dict[str, str], overrides: list[tuple[str, str]], defined_names: DataFrame | None, properties: DataFrame | None, styles: str, date1904: bool) -> dict[str, str]:
    """The parts of which a workbook has one each."""
    pivoted = any("pivotCacheDefinition" in n for n, _ in overrides)
    sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}"' + (f' state="{states[n]}"' if states.get(n, "visible") != "visible" else "") + f' r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    kinds = [("xl/workbook.xml", f"{KIND}.sheet.main+xml"), ("xl/styles.xml", f"{KIND}.styles+xml"), ("docProps/core.xml", "application/vnd.openxmlformats-package.core-properties+xml")]
    kinds += [*((f"xl/worksheets/sheet{i}.xml", f"{KIND}.worksheet+xml") for i in range(1, len(names) + 1)), *overrides]
    links = "".join(f'<Relationship Id="rId{i}" Type="{LINK}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + f'<Relationship Id="rIdS" Type="{LINK}/styles" Target="styles.xml"/>'
    links += f'<Relationship Id="rIdP" Type="{LINK}/pivotCacheDefinition" Target="pivotCache/pivotCacheDefinition1.xml"/>' if pivoted else ""
    told = ""
    if defined_names is not None:
        scope = {n: i for i, n in enumerate(names)}
        told = "".join(
            f"<definedName name={quoteattr(r['name'])}" + (f' localSheetId="{scope[r["scope"]]}"' if r["scope"] is not None else "") + (' hidden="1"' if r["hidden"] else "") + f">{escape(r['refers_to'])}</definedName>"
            for r in sorted(defined_names.select("name", "scope", "refers_to", "hidden").collect(), key=lambda r: (r["name"].lower(), r["scope"] or ""))
        )
        told = f"<definedNames>{told}</definedNames>" if told else ""
    prefixes = {"title": "dc", "creator": "dc", "subject": "dc", "description": "dc", "keywords": "cp", "category": "cp", "lastModifiedBy": "cp"}  # fixed values: properties of a package by name space
    given = [] if properties is None else [(r["name"], r["value"]) for r in properties.select("name", "value").orderBy("name").collect()]
    core = "".join(f"<{prefixes[k]}:{k}>{escape(v)}</{prefixes[k]}:{k}>" for k, v in given if k in prefixes)
    custom = [(k, v) for k, v in given if k not in prefixes]
    parts = {
        "_rels/.rels": f'{HEAD}<Relationships xmlns="{OF}/relationships"><Relationship Id="rId1" Type="{LINK}/officeDocument" Target="xl/workbook.xml"/><Relationship Id="rId2" Type="{OF}/relationships/metadata/core-properties" Target="docProps/core.xml"/>' + (f'<Relationship Id="rId3" Type="{LINK}/custom-properties" Target="docProps/custom.xml"/>' if custom else "") + "</Relationships>",
        "xl/workbook.xml": f'{HEAD}<workbook xmlns="{scan.MAIN[1:-1]}" xmlns:r="{LINK}"><workbookPr{" date1904=" + chr(34) + "1" + chr(34) if date1904 else ""}/><sheets>{sheets}</sheets>{told}{'<pivotCaches><pivotCache cacheId="1" r:id="rIdP"/></pivotCaches>' if pivoted else ""}</workbook>',
        "xl/_rels/workbook.xml.rels": f'{HEAD}<Relationships xmlns="{OF}/relationships">{links}</Relationships>',
        "xl/styles.xml": styles,
        "docProps/core.xml": f'{HEAD}<cp:coreProperties xmlns:cp="{OF}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">{core}</cp:coreProperties>',
    }
    if custom:
        kinds.append(("docProps/custom.xml", "application/vnd.openxmlformats-officedocument.custom-properties+xml"))
        each = "".join(f'<property fmtid="{{D5CDD505-2E9C-101B-9397-08002B2CF9AE}}" pid="{i}" name={quoteattr(k)}><vt:lpwstr>{escape(v)}</vt:lpwstr></property>' for i, (k, v) in enumerate(custom, 2))
        parts["docProps/custom.xml"] = f'{HEAD}<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/custom-properties" xmlns:vt="http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes">{each}</Properties>'
    types = "".join(f'<Override PartName="/{n}" ContentType="{k}"/>' for n, k in kinds)
    parts["[Content_Types].xml"] = f'{HEAD}<Types xmlns="{OF}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="vml" ContentType="application/vnd.openxmlformats-officedocument.vmlDrawing"/>{types}</Types>'
    return parts
