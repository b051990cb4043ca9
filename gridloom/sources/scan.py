"""Sheets and shared strings as bytes: cut between rows without parsing them, then parsed piece by piece.

A sheet's part is inflated once, as a stream, and cut where a row begins. Each piece knows what it needs of the ones before it: the number of
the last row, and the shared formulas that its cells refer to. So pieces can be parsed anywhere, in any order. What surrounds the rows is a
small document of its own.

Rows are recognised by their bytes, which is right for UTF-8 without name prefixes; other encodings are converted, and sheets with prefixes, comments or
CDATA sections are rewritten by an XML parser first. Documents with a DOCTYPE are refused.
"""

from __future__ import annotations

import codecs
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa

from gridloom.functions.coords import index
from gridloom.functions.formula import translate

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

CELLS = "sheet string, sheet_no int, row int, col int, seq bigint, kind string, value string, string_no int, formula string, formula_kind string, formula_ref string, style int, is_date boolean"

_ATTRIBUTE = re.compile(rb"""([\w:]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ROW_NUMBER = re.compile(rb"""\sr\s*=\s*["']([0-9]+)["']""")
#: A cell with its address first and nothing but a value; any other cell; a row.
_CELL = re.compile(rb'<c r="([A-Z]{1,3})([0-9]+)"([^>]*?)(?:/>|>(?:<v>([^<]*)</v></c>|(.*?)</c>))|<row\b([^>]*)>|<c\b([^>]*?)(?:/>|>(.*?)</c>)', re.S)
_FORMULA = re.compile(rb"<f\b([^>]*?)(?:/>|>(.*?)</f>)", re.S)
#: A formula with a text that other cells share, and the names by which cells refer to such ones.
_MASTER = re.compile(rb"<f\b(?=[^>]*shared)[^>]*(?<!/)>(?!</f>)")
_SHARED_NAME = re.compile(rb"""si=["']([^"']*)["']""")
_VALUE = re.compile(rb"<v\b[^>]*?(?:/>|>(.*?)</v>)", re.S)
_ENTITY = re.compile(r"&(?:#(\d+)|#x([0-9A-Fa-f]+)|(\w+));")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def parse(data: bytes) -> ET.Element:
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError("documents with a DOCTYPE aren't read")
    return ET.fromstring(data)


def text(data: bytes) -> str:
    """Character data of an element without child elements."""
    out = data.decode()
    if "&" in out:
        out = _ENTITY.sub(lambda m: chr(int(m[1])) if m[1] else chr(int(m[2], 16)) if m[2] else _NAMED.get(m[3], m[0]), out)
    return out.replace("\r\n", "\n").replace("\r", "\n") if b"\r" in data else out


def unescape(value: str) -> str:
    """Characters that stand as _xHHHH_ in workbooks."""
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), value) if "_x" in value else value


def text_of(x: ET.Element) -> str:
    """The text of a shared or inline string, its runs joined, without phonetic hints."""
    out = []
    for child in x:
        if child.tag == f"{MAIN}t":
            out.append(child.text or "")
        elif child.tag == f"{MAIN}r":
            out += [t.text or "" for t in child.iterfind(f"{MAIN}t")]
    return unescape("".join(out))


@lru_cache(4096)
def attributes(data: bytes) -> dict[str, str]:
    return {m[1].decode(): text(m[2] if m[2] is not None else m[3]) for m in _ATTRIBUTE.finditer(data)}


def number(value: str | None, default: int = 0) -> int:
    """A whole number of an attribute, which some writers give as 3.0."""
    return int(float(value)) if value else default


def utf8_stream(stream: io.BufferedIOBase, block: int = 1 << 20) -> Iterator[bytes]:
    head = stream.read(block)
    if b"<!DOCTYPE" in head[:4096]:
        raise ValueError("documents with a DOCTYPE aren't read")
    told = re.match(rb"""\s*<\?xml[^>]*encoding=["']([\w.-]+)["']""", head.removeprefix(codecs.BOM_UTF8))
    name = "utf-16" if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else told[1].decode() if told else "utf-8"
    if codecs.lookup(name).name in ("utf-8", "ascii"):
        yield head.removeprefix(codecs.BOM_UTF8)
        while data := stream.read(block):
            yield data
        return
    decoder = codecs.getincrementaldecoder(name)()
    first = decoder.decode(head)
    yield re.sub(r"^\s*<\?xml[^>]*\?>", "", first).encode()
    while data := stream.read(block):
        yield decoder.decode(data).encode()
    yield decoder.decode(b"", True).encode()


@dataclass
class Piece:
    """Whole rows of a sheet; ``rest`` is set on the last one: the sheet's document without its rows."""

    number: int
    before: int  # the row number that the first row follows
    data: bytes
    masters: list[tuple[str, int, int, str]] = field(default_factory=list)  # shared formulas from before: name, row, column, text
    rest: bytes | None = None


class Odd(Exception):
    """The rows can't be told by their bytes."""


def last_row(before: int, data: bytes) -> int:
    """The number of the last row: the last that is given, and those after it."""
    at, more = len(data), 0
    while (at := data.rfind(b"<row", 0, at)) >= 0:
        if found := _ROW_NUMBER.search(data[at : data.find(b">", at)]):
            return int(found[1]) + more
        more += 1
    return before + more


def pieces(stream: io.BufferedIOBase, size: int = 2 << 20) -> Iterator[Piece]:
    """Pieces of about ``size`` bytes of the rows of a sheet that is read as a stream."""
    blocks = utf8_stream(stream)
    held = b""
    for data in blocks:
        held += data
        if found := re.search(rb"<sheetData\b[^>]*>", held):
            break
    else:
        if re.search(rb"<\w+:worksheet\b", held):
            raise Odd
        yield Piece(0, 0, b"", [], held)
        return
    head, rows = held[: found.start()], bytearray(held[found.end() :])
    root = re.search(rb"<worksheet\b[^>]*>", head)[0]  # with the name spaces that rows may use
    if found[0].endswith(b"/>"):
        yield Piece(0, 0, b"", [], head + found[0] + bytes(rows) + b"".join(blocks))
        return
    before = n = 0
    masters: dict[str, tuple[int, int, str]] = {}

    def cut(data: bytes, rest: bytes | None = None) -> Piece:
        nonlocal before, n
        needed = []
        if b"shared" in data:
            names = {m.decode() for m in set(_SHARED_NAME.findall(data))}
            needed = [(si, *masters[si]) for si in sorted(names & masters.keys())]
            for si, place in own_masters(data, before).items():
                masters.setdefault(si, place)
        piece = Piece(n, before, data, needed, rest)
        before, n = last_row(before, data), n + 1
        return piece

    searched, rest = 0, None
    while True:
        end = rows.find(b"</sheetData>", max(0, searched - 12))
        if rest is None and any(0 <= rows.find(mark, max(0, searched - 1), end if end >= 0 else len(rows)) for mark in (b"<!", b"<?")):
            # comments and CDATA may hold what looks like rows: what is left of the sheet is parsed and written anew
            whole = ET.fromstring(root + b"<sheetData>" + bytes(rows) + b"".join(blocks))
            rest = head + b"<sheetData/>" + b"".join(map(ET.tostring, whole[1:])) + b"</worksheet>"
            rows = bytearray(b"".join(map(plain, whole[0])) + b"</sheetData>")
            searched = 0
            continue
        searched = len(rows)
        have = end if end >= 0 else searched
        while have > size:
            at = rows.rfind(b"<row", 1, size)
            at = at if at > 0 else rows.find(b"<row", max(1, size - 3), have)
            if at < 0:
                break
            yield cut(bytes(rows[:at]))
            del rows[:at]
            have, searched, end = have - at, searched - at, end - at
        if have < searched:
            yield cut(bytes(rows[:have]), rest or head + b"<sheetData/>" + bytes(rows[have + 12 :]) + b"".join(blocks))
            return
        data = next(blocks, None)
        if data is None:
            raise ValueError("a sheet ends before its rows do")
        rows += data


def plain(x: ET.Element) -> bytes:
    """An element with its name and its attributes of no namespace, in UTF-8 and without prefixes."""
    name = re.sub(r"\{.*\}", "", x.tag)
    given = "".join(f" {k}={quoteattr(v)}" for k, v in x.attrib.items() if "{" not in k)
    return f"<{name}{given}>{escape(x.text or '')}".encode() + b"".join(map(plain, x)) + f"</{name}>".encode()


def rewritten_pieces(stream: io.BufferedIOBase, size: int = 2 << 20) -> Iterator[Piece]:
    """The same for a sheet that an XML parser must rewrite, since its names have prefixes."""
    rows: list[bytes] = []
    open_: list[ET.Element] = []
    for event, x in ET.iterparse(io.BytesIO(b"".join(utf8_stream(stream))), ("start", "end")):
        if event == "start":
            open_.append(x)
        elif open_.pop().tag == f"{MAIN}row":
            rows.append(plain(x))
            open_[-1].remove(x)
    rest = ET.tostring(x)  # the last element that ended is the root
    for piece in pieces(io.BytesIO(b'<worksheet xmlns="%b"><sheetData>%b</sheetData></worksheet>' % (MAIN[1:-1].encode(), b"".join(rows))), size):
        piece.rest = rest if piece.rest is not None else None
        yield piece


def own_masters(data: bytes, before: int) -> dict[str, tuple[int, int, str]]:
    """Shared formulas that rows define, by name: row, column and text. Only the rows that define some are parsed, since one task cuts a sheet."""
    out: dict[str, tuple[int, int, str]] = {}
    done = 0
    for m in _MASTER.finditer(data):
        if m.start() < done:
            continue
        begin, end = max(done, data.rfind(b"<row", done, m.start())), data.find(b"<row", m.end())
        end = end if end >= 0 else len(data)
        before = last_row(before, data[done:begin])
        for row, col, _, body in cells_of(data[begin:end], before):
            if b"shared" in body and (f := _FORMULA.search(body)) and f[2]:
                given = attributes(f[1])
                if given.get("t") == "shared" and "si" in given:
                    out.setdefault(given["si"], (row, col, "=" + text(f[2])))
        before, done = last_row(before, data[begin:end]), end
    return out


def cells_of(data: bytes, before: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(row, column, attributes, content) of all cells. One without an address stands beside the last one."""
    row, col = before, 0
    columns: dict[bytes, int] = {}
    for m in _CELL.finditer(data):
        letters, digits, more, value, body, row_given, given, inside = m.groups()
        if letters is not None:
            col = columns.get(letters) or columns.setdefault(letters, index(letters.decode()))
            yield int(digits), col, attributes(more), b"<v>%b</v>" % value if value is not None else body or b""
        elif row_given is not None:
            found = _ROW_NUMBER.search(row_given) if row_given else None
            row, col = int(found[1]) if found else row + 1, 0
        else:
            known = attributes(given)
            place = re.fullmatch(r"([A-Z]{1,3})(\d+)", known.get("r", ""))
            col = index(place[1]) if place else col + 1
            yield int(place[2]) if place else row, col, known, inside or b""


def inline_text(body: bytes) -> str | None:
    at = body.find(b"<is")
    if at < 0:
        return None
    end = body.find(b"</is>", at)
    return text_of(ET.fromstring(b'<is xmlns="' + MAIN[1:-1].encode() + b'">' + body[body.find(b">", at) + 1 : end] + b"</is>")) if end > 0 else ""


_KINDS = {"n": "number", "d": "date", "b": "bool", "e": "error"}
_ARROW = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_())


def cell_columns(piece: Piece, dates: frozenset[int], strings: list[str] | None = None) -> list[pa.Array]:
    """Arrow columns of the cells of a piece: row, col, seq, kind, value, string_no, formula, formula_kind, formula_ref, style, is_date.

    Cells without value, formula and style are left out. ``strings`` resolves shared strings here; without it string_no says which one it is.
    """
    masters = {si: (row, col, formula) for si, row, col, formula in piece.masters}
    out: tuple[list, ...] = tuple([] for _ in _ARROW)
    rows, cols, seqs, kinds, values, numbers, formulas, formula_kinds, refs, styles, is_dates = out
    seq = piece.number << 32
    for row, col, given, body in cells_of(piece.data, piece.before):
        seq += 1
        kind, style = given.get("t", "n"), number(given.get("s"))
        value = string_no = formula = formula_kind = ref = None
        if body:
            if kind == "inlineStr":
                value = inline_text(body)
            elif body.startswith(b"<v>") and body.count(b"<") == 2:
                value = text(body[3:-4])
            elif v := _VALUE.search(body):
                value = text(v[1] or b"")
            if (b"<f" in body) and (f := _FORMULA.search(body)):
                told = attributes(f[1])
                formula_kind, ref, si = told.get("t", "normal"), told.get("ref"), told.get("si")
                formula = "=" + text(f[2] or b"")
                if formula_kind == "dataTable":  # it has no text, but settings
                    formula = " ".join(f"{k}={v}" for k, v in told.items() if k != "t")
                if formula_kind == "shared" and si is not None:
                    if f[2]:
                        masters.setdefault(si, (row, col, formula))
                    elif si in masters:
                        r, c, master = masters[si]
                        formula = translate(master, row - r, col - c)
        if kind == "s" and value is not None:
            string_no = number(value)
            value = strings[string_no] if strings is not None and string_no < len(strings) else None
        elif kind == "str" and value:
            value = unescape(value)
        elif kind == "b" and value:
            value = "TRUE" if value.strip() in ("1", "true") else "FALSE"
        elif value == "" and kind in ("n", "b", "e", "d"):
            value = None
        is_date = kind == "n" and style in dates
        empty = value is None and string_no is None
        if empty and formula is None and not style:
            continue
        rows.append(row)
        cols.append(col)
        seqs.append(seq)
        kinds.append(None if empty and formula is None else "date" if is_date else _KINDS.get(kind, "text"))
        values.append(value)
        numbers.append(string_no)
        formulas.append(formula)
        formula_kinds.append(formula_kind)
        refs.append(ref)
        styles.append(style)
        is_dates.append(is_date)
    return [pa.array(x, t) for x, t in zip(out, _ARROW, strict=True)]


def row_settings(piece: Piece) -> Iterator[tuple[int, dict[str, str]]]:
    """Numbers and attributes of rows that have more than a number and spans."""
    row = piece.before
    for m in re.finditer(rb"<row\b([^>]*)>", piece.data):
        given = attributes(m[1])
        row = number(given.get("r"), row + 1)
        if given.keys() - {"r", "spans"}:
            yield row, given


def string_pieces(stream: io.BufferedIOBase, size: int = 2 << 20) -> Iterator[tuple[int, bytes]]:
    """(number of the first string, a document of some strings) of a part of shared strings."""
    return element_pieces(stream, b"sst", b"si", size)


def element_pieces(stream: io.BufferedIOBase, root: bytes, element: bytes, size: int = 2 << 20) -> Iterator[tuple[int, bytes]]:
    """(number of the first element, a document of some elements) of a part that is a list of them."""
    held, n, mark = bytearray(), 0, None
    begins = re.compile(rb"<" + element + rb"[\s/>]")
    for data in utf8_stream(stream):
        held += data
        if mark is None and (found := re.search(rb"<" + root + rb"\b[^>]*>", held)):
            mark = found[0]
            del held[: found.end()]
        while mark and not mark.endswith(b"/>") and len(held) > size:
            at = held.rfind(b"<" + element, 1, size)
            while at > 0 and not begins.match(held, at):
                at = held.rfind(b"<" + element, 1, at)
            if at <= 0:
                later = begins.search(held, max(1, size - len(element)))
                at = later.start() if later else -1
            if at < 0:
                break
            piece = bytes(held[:at])
            yield n, mark + piece + b"</" + root + b">"
            n += len(begins.findall(piece))
            del held[:at]
    if mark is None and held.strip():  # names with prefixes
        yield 0, bytes(held)
    elif mark and not mark.endswith(b"/>"):
        yield n, mark + bytes(held)


def strings_of(data: bytes) -> list[str]:
    return [text_of(x) for x in parse(data) if x.tag == f"{MAIN}si"]
