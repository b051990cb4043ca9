"""Spreadsheet addresses as column expressions. Columns run from A (1) to ZZZ (18278); rows from 1."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_COLUMN, MAX_ROW, LAST_COLUMN = 18278, 1_048_576, 16_384
LAST_ROW = (1 << 31) - 1  # of a sheet as a relation, which may have more rows than a file's sheet
#: $A$1, A1:C3, A:C and 2:5, with or without dollar signs.
COORDINATE = r"^\$?([A-Za-z]{1,3})\$?(\d+)$"
RANGE = r"^\$?([A-Za-z]{1,3})?\$?(\d+)?(?::\$?([A-Za-z]{1,3})?\$?(\d+)?)?$"


def column_letters(c: Column) -> Column:
    """Letters of a column number; null outside 1..18278."""
    c = c.cast("int")
    digit = lambda x: F.chr(F.lit(65) + x)
    one = digit(c - 1)
    two = F.concat(digit(F.expr("0") + F.floor((c - 27) / 26).cast("int")), digit(F.pmod(c - 27, F.lit(26))))
    three = F.concat(digit(F.floor((c - 703) / 676).cast("int")), digit(F.pmod(F.floor((c - 703) / 26).cast("int"), F.lit(26))), digit(F.pmod(c - 703, F.lit(26))))
    return F.when(c.between(1, 26), one).when(c.between(27, 702), two).when(c.between(703, MAX_COLUMN), three)


def column_index(s: Column) -> Column:
    """Number of column letters; null if they aren't one to three letters."""
    u = F.upper(s)
    at = lambda i: F.ascii(F.substring(u, i, 1)) - 64
    return F.when(u.rlike("^[A-Z]$"), at(1)).when(u.rlike("^[A-Z]{2}$"), at(1) * 26 + at(2)).when(u.rlike("^[A-Z]{3}$"), at(1) * 676 + at(2) * 26 + at(3))


def coordinate(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def absolute(s: Column) -> Column:
    """$A$1 of A1, and the same for both ends of a range."""
    return F.regexp_replace(F.upper(s), r"\$?([A-Z]{1,3})\$?(\d+)", r"\$$1\$$2")


def split_coordinate(s: Column) -> Column:
    """struct(row, col) of a coordinate; null if it isn't one or has row 0."""
    row, col = F.regexp_extract(s, COORDINATE, 2), column_index(F.regexp_extract(s, COORDINATE, 1))
    return F.when(s.rlike(COORDINATE) & (F.expr("0") < F.coalesce(row.try_cast("int"), F.lit(0))), F.struct(row.try_cast("int").alias("row"), col.alias("col")))


def range_bounds(s: Column) -> Column:
    """struct(r0, c0, r1, c1) of a range; open sides (A:C, 2:5) are null."""
    part = lambda i: F.nullif(F.regexp_extract(s, RANGE, i), F.lit(""))
    c0, r0 = column_index(part(1)), part(2).try_cast("int")
    c1, r1 = column_index(part(3)), part(4).try_cast("int")
    single = ~s.contains(":")
    return F.when(s.rlike(RANGE), F.struct(r0.alias("r0"), c0.alias("c0"), F.when(single, r0).otherwise(r1).alias("r1"), F.when(single, c0).otherwise(c1).alias("c1")))


def range_text(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    one = coordinate(r0, c0)
    return F.when((r0 == r1) & (c0 == c1), one).otherwise(F.concat(one, F.lit(":"), coordinate(r1, c1)))


def column_interval(first: Column, last: Column) -> Column:
    """Letters of all columns from one to another, both as letters."""
    return F.transform(F.sequence(column_index(first), column_index(last)), column_letters)


def quote_sheet(name: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_")


# the same for a few values that the driver has


def letters(c: int) -> str:
    out = ""
    while c:
        c, d = divmod(c - 1, 26)
        out = chr(65 + d) + out
    return out


def index(s: str) -> int:
    if not re.fullmatch("[A-Za-z]{1,3}", s):
        raise ValueError(f"{s!r} isn't a column")
    n = 0
    for ch in s.upper():
        n = n * 26 + ord(ch) - 64
    return n


def bounds(text: str, last_row: int = MAX_ROW) -> tuple[int, int, int, int]:
    """(r0, c0, r1, c1) of a range; open sides reach to the sheet's edge, that of a file unless ``last_row`` is given."""
    m = re.fullmatch(RANGE, text.strip())
    if not m or not any(m.groups()) or (":" in text and not (m[3] or m[4])):
        raise ValueError(f"{text!r} isn't a range")
    c0, r0 = index(m[1]) if m[1] else 1, int(m[2]) if m[2] else 1
    if ":" not in text:
        return r0, c0, int(m[2]) if m[2] else last_row, index(m[1]) if m[1] else LAST_COLUMN
    r1, c1 = int(m[4]) if m[4] else last_row, index(m[3]) if m[3] else LAST_COLUMN
    return min(r0, r1), min(c0, c1), max(r0, r1), max(c0, c1)
