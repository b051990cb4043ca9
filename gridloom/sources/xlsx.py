"""Workbooks (.xlsx, .xlsm) as a Python data source, read and written with zipfile and ElementTree alone.

``spark.read.format("gridloom_xlsx").option("relation", R).load(path)`` reads one relation of one or more workbooks (a path, or
several with commas between): cells, sheets, merged, hyperlinks, comments, row_dims, col_dims, defined_names, validations,
cond_formats, tables, properties or strings. Here each sheet of each file is a partition of its own; ``gridloom.sources.workbook`` splits sheets, reads
from any store that Spark reads and writes whole workbooks. ``df.write.format("gridloom_xlsx").option("path", P).save()`` writes cells
(sheet, row, col, token) of a small workbook on a local folder: tasks write row fragments, the commit puts them together in row order.

Only members of the archive itself are read, by their names; documents with a DOCTYPE are refused.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom.functions.compact import encode_items
from gridloom.functions.coords import bounds, letters
from gridloom.functions.formats import BUILTIN
from gridloom.sources import scan
from gridloom.sources.scan import MAIN, number, parse, text_of

REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats that workbooks use without defining them and that show dates or durations.
BUILTIN_DATES = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])

SCHEMAS = {
    "cells": "file string, sheet string, sheet_no int, row int, col int, seq bigint, kind string, value string, formula string, formula_kind string, formula_ref string, style int, is_date boolean",
    "sheets": "file string, sheet string, sheet_no int, state string, dimension string, date1904 boolean",
    "merged": "file string, sheet string, r0 int, c0 int, r1 int, c1 int",
    "hyperlinks": "file string, sheet string, r0 int, c0 int, r1 int, c1 int, target string, location string, tooltip string",
    "comments": "file string, sheet string, row int, col int, author string, text string",
    "row_dims": "file string, sheet string, row int, height double, hidden boolean, outline int",
    "col_dims": "file string, sheet string, first int, last int, width double, hidden boolean, outline int",
    "defined_names": "file string, name string, scope string, refers_to string, hidden boolean",
    "validations": "file string, sheet string, ranges string, type string, operator string, formula1 string, formula2 string, allow_blank boolean",
    "cond_formats": "file string, sheet string, ranges string, type string, operator string, priority int, formulas array<string>, style int",
    "rules": "file string, sheet string, ranges string, type string, operator string, priority int, formulas array<string>, style int, stop boolean, text string, rank int, percent boolean, bottom boolean, above boolean, equal_average boolean, deviations int, period string",
    "settings": "file string, sheet string, name string, text string",
    "tables": "file string, sheet string, name string, ref string, columns array<string>, totals_row boolean",
    "properties": "file string, name string, value string",
    "strings": "file string, idx int, text string",
    "style_parts": "file string, kind string, id int, text string",
    "cell_styles": "file string, style int, font int, fill int, border int, num_fmt string, alignment string, protection string, quote_prefix boolean, pivot_button boolean, name string",
    "rule_styles": "file string, id int, text string",
    "rich_strings": "file string, idx int, run int, text string, font string",
}


#: Elements of a sheet that say how it is shown, protected, filtered and printed.
SETTINGS = ("sheetPr", "sheetViews", "sheetFormatPr", "sheetProtection", "scenarios", "autoFilter", "printOptions", "pageMargins", "pageSetup", "headerFooter", "rowBreaks", "colBreaks")
OF_STYLES = ("style_parts", "cell_styles", "rule_styles")
#: Relations of a workbook as a whole.
OF_BOOK = ("sheets", "defined_names", "properties", "strings", "rich_strings", *OF_STYLES)


class Package:
    """A workbook's archive: parts by name, and what its main part says of the sheets."""

    def __init__(self, path: str, content=None):
        """``content``: the archive as a file that is open; else it is read at the path."""
        if path.lower().endswith((".xls", ".xlsb")):
            raise ValueError(f"{path}: only .xlsx, .xlsm, .xltx and .xltm are read")
        self.path, self.zip = path, zipfile.ZipFile(path if content is None else content)
        self.names = {n.lower(): n for n in self.zip.namelist()}
        types = self.part("[Content_Types].xml")
        kinds = {x.get("PartName", "").lstrip("/"): x.get("ContentType", "") for x in types if x.tag.endswith("Override")}
        self.main = next((n for n, k in kinds.items() if re.search(r"(sheet|template)\.(macroEnabled\.)?main\+xml$", k)), "xl/workbook.xml")
        self.book = self.part(self.main)
        self.links = self.relations(self.main)
        props = self.book.find(f"{MAIN}workbookPr")
        self.date1904 = props is not None and props.get("date1904") in ("1", "true")
        self.sheets = []
        for x in self.book.iterfind(f"{MAIN}sheets/{MAIN}sheet"):
            target = self.links.get(x.get(f"{REL}id"), ("", ""))
            if target[1] and target[1].lower() in self.names:
                self.sheets.append((x.get("name", ""), x.get("state", "visible"), target[1], target[0].rsplit("/", 1)[-1]))

    def bytes(self, name: str) -> bytes:
        return self.zip.read(self.names[name.lower()])

    def has(self, name: str) -> bool:
        return name.lower() in self.names

    def part(self, name: str) -> ET.Element:
        return parse(self.bytes(name))

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (type, target): members of the archive with their whole names, external targets as they are."""
        folder, name = posixpath.split(part)
        where = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
        out: dict[str, tuple[str, str]] = {}
        if self.has(where):
            for x in self.part(where):
                target = x.get("Target", "")
                if x.get("TargetMode") != "External":
                    target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out.setdefault(x.get("Id"), (x.get("Type", ""), target))
        return out

    def related(self, part: str, kind: str) -> list[str]:
        return [t for k, t in self.relations(part).values() if k.endswith(f"/{kind}") and self.has(t)]

    def strings(self) -> list[str]:
        for name in self.related(self.main, "sharedStrings"):
            return [s for _, data in scan.string_pieces(self.open(name)) for s in scan.strings_of(data)]
        return []

    def open(self, name: str):
        return self.zip.open(self.names[name.lower()])

    def pieces(self, part: str, size: int = 2 << 20) -> Iterator[scan.Piece]:
        """Pieces of a sheet, whatever its XML is like."""
        try:
            yield from scan.pieces(self.open(part), size)
        except scan.Odd:
            yield from scan.rewritten_pieces(self.open(part), size)

    def compressed(self, name: str, size: int) -> tuple[int, Iterator[bytes]]:
        """(method, chunks of so many bytes) of a member as it stands in the archive."""
        found = self.zip.getinfo(self.names[name.lower()])
        self.zip.fp.seek(found.header_offset + 26)
        begin = found.header_offset + 30 + sum(int.from_bytes(self.zip.fp.read(2), "little") for _ in range(2))

        def chunks() -> Iterator[bytes]:
            for at in range(0, found.compress_size, size):
                self.zip.fp.seek(begin + at)
                yield self.zip.fp.read(min(size, found.compress_size - at))

        return found.compress_type, chunks()

    def stylesheet(self) -> ET.Element | None:
        return next((self.part(name) for name in self.related(self.main, "styles")), None)

    def date_styles(self) -> frozenset[int]:
        """The cell styles whose number format shows a date or a duration."""
        root = self.stylesheet()
        if root is not None:
            formats = {int(x.get("numFmtId", -1)): x.get("formatCode", "") for x in root.iter(f"{MAIN}numFmt")}
            ids = [int(x.get("numFmtId", 0)) for x in root.iterfind(f"{MAIN}cellXfs/{MAIN}xf")]
            return frozenset(k for k, i in enumerate(ids) if (shows_date(formats[i]) if i in formats else i in BUILTIN_DATES))
        return frozenset()


def shows_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0].lower())
    return code.lower() != "general" and bool(re.search("[dmhys]", bare))


def cells(package: Package, at: int) -> Iterator[pa.RecordBatch]:
    """Batches of the relation cells, a piece of the sheet at a time."""
    name, _, part, _ = package.sheets[at]
    strings, dates = package.strings(), package.date_styles()
    for piece in package.pieces(part):
        columns = scan.cell_columns(piece, dates, strings)
        n = len(columns[0])
        same = [pa.array([package.path] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array([at] * n, pa.int32())]
        yield pa.RecordBatch.from_arrays([*same, *columns[:5], *columns[6:]], names=[c.split()[0] for c in SCHEMAS["cells"].split(", ")])


def flag(x: ET.Element, name: str) -> bool:
    return x.get(name) in ("1", "true")


def elements(stream, *names: str) -> Iterator[ET.Element]:
    """The elements of these names in a part that is read as a stream; each is forgotten when the next one is asked for."""
    tags, reader, open_ = {f"{MAIN}{n}" for n in names}, ET.XMLPullParser(("start", "end")), []
    for data in scan.utf8_stream(stream):
        if b"<!ENTITY" in data:
            raise ValueError("documents with a DOCTYPE aren't read")
        reader.feed(data)
        for event, x in reader.read_events():
            if event == "start":
                open_.append(x)
            else:
                open_.pop()
                if x.tag in tags:
                    yield x
                    open_[-1].remove(x) if open_ else None
    reader.close()


def sheet_rows(package: Package, at: int, relation: str) -> Iterator[tuple]:
    """Rows of a sheet's other relations; the cells themselves are passed over."""
    name, _, part, _ = package.sheets[at]
    where, links = (package.path, name), package.relations(part)
    if relation == "comments":
        for target in package.related(part, "comments"):
            authors: list[str] = []
            for c in elements(package.open(target), "author", "comment"):
                if c.tag == f"{MAIN}author":
                    authors.append(c.text or "")
                    continue
                r0, c0, _, _ = bounds(c.get("ref"))
                who, text = int(c.get("authorId") or 0), c.find(f"{MAIN}text")
                yield *where, r0, c0, authors[who] if who < len(authors) else None, text_of(text) if text is not None else ""
        return
    if relation == "tables":
        for target in package.related(part, "table"):
            t = package.part(target)
            yield *where, t.get("displayName"), t.get("ref"), [c.get("name") for c in t.iter(f"{MAIN}tableColumn")], int(t.get("totalsRowCount") or 0) > 0
        return
    rest = None
    for piece in package.pieces(part):
        if relation == "row_dims":
            for row, given in scan.row_settings(piece):
                if any(given.get(k) for k in ("ht", "hidden", "outlineLevel")):
                    yield *where, row, float(given["ht"]) if given.get("ht") else None, given.get("hidden") in ("1", "true"), number(given.get("outlineLevel"))
        rest = piece.rest or rest
    if relation == "row_dims":
        return
    for x in parse(rest) if relation == "settings" else parse(rest).iter():
        tag = x.tag.removeprefix(MAIN)
        if relation == "settings":
            if tag in SETTINGS:
                yield *where, tag, encode_items(x)
        elif relation == "merged" and tag == "mergeCell":
            yield *where, *bounds(x.get("ref"))
        elif relation == "hyperlinks" and tag == "hyperlink":
            yield *where, *bounds(x.get("ref")), links.get(x.get(f"{REL}id"), (None, None))[1], x.get("location"), x.get("tooltip")
        elif relation == "col_dims" and tag == "col":
            yield *where, number(x.get("min")), number(x.get("max")), float(x.get("width")) if x.get("width") else None, flag(x, "hidden"), number(x.get("outlineLevel"))
        elif relation == "validations" and tag == "dataValidation":
            text = lambda n, x=x: (y.text if (y := x.find(f"{MAIN}{n}")) is not None else None)
            yield *where, x.get("sqref"), x.get("type", "none"), x.get("operator", "between"), text("formula1"), text("formula2"), flag(x, "allowBlank")
        elif relation in ("cond_formats", "rules") and tag == "conditionalFormatting":
            for rule in x.iterfind(f"{MAIN}cfRule"):
                told = (x.get("sqref"), rule.get("type"), rule.get("operator"), number(rule.get("priority")), [f.text or "" for f in rule.iterfind(f"{MAIN}formula")], number(rule.get("dxfId")) if rule.get("dxfId") else None)
                maybe = lambda n, of, rule=rule: of(rule.get(n)) if rule.get(n) is not None else None
                truth = lambda v: v in ("1", "true")
                more = (maybe("stopIfTrue", truth), rule.get("text"), maybe("rank", number), maybe("percent", truth), maybe("bottom", truth), maybe("aboveAverage", truth), maybe("equalAverage", truth), maybe("stdDev", number), rule.get("timePeriod"))
                yield (*where, *told, *more) if relation == "rules" else (*where, *told)


def style_rows(package: Package, relation: str) -> Iterator[tuple]:
    """Pools of styles: parts and rules in compact XML, cell formats with the ids of their parts."""
    root = package.stylesheet()
    if root is None:
        return
    if relation == "rule_styles":
        for i, x in enumerate(root.iterfind(f"{MAIN}dxfs/{MAIN}dxf")):
            yield package.path, i, encode_items(x)
    elif relation == "style_parts":
        for kind in ("font", "fill", "border"):
            for i, x in enumerate(root.iterfind(f"{MAIN}{kind}s/{MAIN}{kind}")):
                yield package.path, kind, i, encode_items(x)
    else:
        codes = BUILTIN | {number(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter(f"{MAIN}numFmt") if x.get("numFmtId")}
        names = {number(x.get("xfId")): x.get("name") for x in root.iterfind(f"{MAIN}cellStyles/{MAIN}cellStyle")}
        for i, x in enumerate(root.iterfind(f"{MAIN}cellXfs/{MAIN}xf")):
            told = [encode_items(y) or None if (y := x.find(f"{MAIN}{k}")) is not None else None for k in ("alignment", "protection")]
            at = number(x.get("numFmtId"))
            yield package.path, i, *[number(x.get(f"{k}Id")) for k in ("font", "fill", "border")], codes.get(at, f"format {at}"), *told, flag(x, "quotePrefix"), flag(x, "pivotButton"), names.get(number(x.get("xfId")))


def rich_rows(package: Package) -> Iterator[tuple]:
    """Runs of shared strings that have any: their text, and their font in compact XML."""
    for name in package.related(package.main, "sharedStrings")[:1]:
        for first, data in scan.string_pieces(package.open(name)):
            for i, x in enumerate(y for y in parse(data) if y.tag == f"{MAIN}si"):
                for k, run in enumerate(x.iterfind(f"{MAIN}r")):
                    font = run.find(f"{MAIN}rPr")
                    yield package.path, first + i, k, scan.unescape("".join(t.text or "" for t in run.iterfind(f"{MAIN}t"))), encode_items(font) if font is not None else None


def book_rows(package: Package, relation: str) -> Iterator[tuple]:
    if relation in OF_STYLES:
        yield from style_rows(package, relation)
        return
    names = [s[0] for s in package.sheets]
    if relation == "rich_strings":
        yield from rich_rows(package)
    elif relation == "strings":
        yield from ((package.path, i, s) for i, s in enumerate(package.strings()))
    elif relation == "sheets":
        for number, (name, state, part, _) in enumerate(package.sheets):
            found = re.search(rb'<(?:\w+:)?dimension[^>]*ref="([^"]*)"', package.open(part).read(8192))
            yield package.path, name, number, state, found[1].decode() if found else None, package.date1904
    elif relation == "defined_names":
        for x in package.book.iterfind(f"{MAIN}definedNames/{MAIN}definedName"):
            scope = x.get("localSheetId")
            yield package.path, x.get("name"), names[int(scope)] if scope and int(scope) < len(names) else None, x.text or "", flag(x, "hidden")
    elif relation == "properties":
        for kind in ("core", "app", "custom"):
            if package.has(f"docProps/{kind}.xml"):
                for x in package.part(f"docProps/{kind}.xml"):
                    text = "".join(x.itertext())
                    if text:
                        yield package.path, x.get("name") or re.sub(r"\{.*\}", "", x.tag), text


@dataclass
class SheetPartition(InputPartition):
    path: str
    number: int | None


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.relation = options.get("relation", "cells")
        self.sheet = options.get("sheet")
        self.paths = []
        for p in options["path"].split(","):
            path = Path(p.removeprefix("file://"))
            self.paths += [str(x) for x in sorted(path.glob("*.xls[xm]"))] if path.is_dir() else [str(path)]

    def partitions(self) -> list[InputPartition]:
        if self.relation in OF_BOOK:
            return [SheetPartition(p, None) for p in self.paths]
        out = []
        for p in self.paths:
            out += [SheetPartition(p, i) for i, s in enumerate(Package(p).sheets) if s[3] == "worksheet" and self.sheet in (None, s[0])]
        return out

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        package = Package(partition.path)
        if partition.number is None:
            return book_rows(package, self.relation)
        return cells(package, partition.number) if self.relation == "cells" else sheet_rows(package, partition.number, self.relation)


@dataclass
class Fragment(WriterCommitMessage):
    name: str


class XlsxWriter(DataSourceWriter):
    """Tasks write their rows' XML, one JSON line for each row part; the commit merges lines by sheet and row."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        os.makedirs(self.parts)

    def write(self, rows) -> Fragment:
        name = f"{self.parts}/{uuid.uuid4().hex}"
        held: dict[tuple[str, int], list[tuple[int, str]]] = {}
        for r in rows:
            held.setdefault((r["sheet"], r["row"]), []).append((r["col"], cell_xml(r["row"], r["col"], r["token"])))
        with open(name, "w", encoding="utf-8") as f:
            for (sheet, row), found in sorted(held.items()):
                f.write(json.dumps([sheet, row, found]) + "\n")
        return Fragment(name)

    def commit(self, messages) -> None:
        import heapq
        from itertools import groupby

        files = [open(m.name, encoding="utf-8") for m in messages if m]  # noqa: SIM115
        lines = heapq.merge(*[(json.loads(x) for x in f) for f in files], key=lambda x: (x[0], x[1]))
        names: list[str] = []
        with zipfile.ZipFile(f"{self.path}.new", "w", zipfile.ZIP_DEFLATED) as z:
            for sheet, own in groupby(lines, key=lambda x: x[0]):
                names.append(sheet)
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as out:
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                    for row, parts in groupby(own, key=lambda x: x[1]):
                        cells_ = sorted((c, x) for p in parts for c, x in p[2])
                        out.write(f'<row r="{row}">{"".join(x for _, x in cells_)}</row>'.encode())
                    out.write(b"</sheetData></worksheet>")
            for name, text in package_parts(names or ["Sheet1"]).items():
                z.writestr(name, text)
            if not names:
                z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData/></worksheet>')
        for f in files:
            f.close()
        os.replace(f"{self.path}.new", self.path)
        self.abort(messages)

    def abort(self, messages) -> None:
        import shutil

        shutil.rmtree(self.parts, ignore_errors=True)


def cell_xml(row: int, col: int, token: str | None) -> str:
    """A cell of a token: numbers, booleans and errors by type, all else as inline text."""
    ref = f"{letters(col)}{row}"
    if token is None:
        return ""
    if re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", token):
        return f'<c r="{ref}"><v>{token}</v></c>'
    if token in ("TRUE", "FALSE"):
        return f'<c r="{ref}" t="b"><v>{int(token == "TRUE")}</v></c>'
    if token.startswith("#"):
        return f'<c r="{ref}" t="e"><v>{escape(token)}</v></c>'
    text = json.loads(token) if token.startswith('"') else token
    text = re.sub(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)", lambda m: f"_x{ord(m[0]):04X}_", text[:32_767])
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def package_parts(names: list[str]) -> dict[str, str]:
    head, rel = '<?xml version="1.0" encoding="UTF-8"?>', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, len(names) + 1))
    links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    of = "http://schemas.openxmlformats.org/package/2006"
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="{of}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{parts}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{of}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{of}/relationships">{links}</Relationships>',
    }


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_xlsx"

    def schema(self) -> str:
        relation = self.options.get("relation", "cells")
        if relation not in SCHEMAS:
            raise ValueError(f"{relation} isn't one of {', '.join(SCHEMAS)}")
        return SCHEMAS[relation]

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return XlsxWriter(dict(self.options), overwrite)


def register(spark) -> None:
    spark.dataSource.register(XlsxSource)
