"""Texts that stand for values or settings: numbers, percentages and times as typed, sheet names, print settings, headers and footers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^-?(\d|\d+\.\d*|\.\d+|[1-9]\d+\.?\d*)([Ee][-+]?\d+)?$"
PERCENT = r"^(-?\d*\.?\d*\s?)%$"
CLOCK = r"^([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?$"
MINUTES = r"^([0-5]\d):([0-5]\d)\.(\d{6}|\d{1,5}$)"
TITLES = r"(?:'((?:[^']|'')*)'|([^'^ !]*))!(\$?\d+:\$?\d+)?,?(\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3})?,?"
AREA = r"(?:(?:'(?:[^']|'')*'|[^'^ !,]*)!)?(\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?|\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}|\$?\d+:\$?\d+)"
PARTS = r"(?s)^(?:&L(.+?))?(?:&C(.+?))?(?:&R(.+?))?$"
CODES = r'&"(.+)"|&K([A-F0-9]{6})|&(\d+\s?)'


def number(text: Column) -> Column:
    """A number as typed; null for anything else, also for whole numbers of several digits that begin with 0."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def percentage(text: Column) -> Column:
    """12.5% as 0.125; null for anything else."""
    return F.trim(F.nullif(F.regexp_extract(text, PERCENT, 1), F.lit(""))).try_cast("double") / 100


def time_of_day(text: Column) -> Column:
    """Microseconds since midnight of hh:mm, hh:mm:ss or mm:ss.ffffff; null for anything else."""
    part = lambda pattern, i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("long"), F.lit(0))
    clock = (part(CLOCK, 1) * 3600 + part(CLOCK, 2) * 60 + part(CLOCK, 3)) * 1_000_000
    fine = (part(MINUTES, 1) * 60 + part(MINUTES, 2)) * 1_000_000 + F.rpad(F.regexp_extract(text, MINUTES, 3), 6, "0").try_cast("long")
    return F.when(text.rlike(CLOCK), clock).when(text.rlike(MINUTES), fine)


def free_name(names: Column, wanted: Column) -> Column:
    """``wanted``, or with a number behind it if ``names`` (an array: the sheets of one workbook) has it in any case.

    The number is one more than the largest that follows ``wanted`` anywhere in ``names``.
    """
    low, name = F.transform(names, lambda n: F.lower(n)), F.lower(wanted)
    counts = F.regexp_extract_all(F.array_join(low, ","), F.concat(F.lit(r"\Q"), name, F.lit(r"\E(\d*)")), F.lit(1))
    highest = F.coalesce(F.array_max(F.transform(counts, lambda n: n.try_cast("long"))), F.lit(0))
    return F.when(F.array_contains(low, name), F.concat(wanted, (highest + 1).cast("string"))).otherwise(wanted)


def last_group(text: Column, pattern: str, group: int) -> Column:
    """What the group holds in the last match in which it isn't empty; else null."""
    found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: x != "")
    return F.try_element_at(found, F.lit(-1))


def print_titles(text: Column) -> Column:
    """(sheet, first_row, last_row, first_col, last_col) of a definition such as 'A b'!$1:$2,'A b'!$A:$C; null if it is none."""
    rows, cols = (F.split(F.replace(last_group(text, TITLES, i), F.lit("$"), F.lit("")), ":") for i in (3, 4))
    sheet = F.coalesce(last_group(text, TITLES, 1), last_group(text, TITLES, 2))
    made = F.struct(sheet.alias("sheet"), rows[0].cast("int").alias("first_row"), rows[1].cast("int").alias("last_row"), cols[0].alias("first_col"), cols[1].alias("last_col"))
    return F.when(rows.isNotNull() | cols.isNotNull() | sheet.isNotNull(), made)


def print_areas(text: Column) -> Column:
    """The ranges of a print area, without their sheet's name and dollar signs."""
    return F.transform(F.regexp_extract_all(text, F.lit(AREA), F.lit(1)), lambda x: F.replace(x, F.lit("$"), F.lit("")))


def header_parts(text: Column) -> Column:
    """(left, center, right) of a header or footer; empty where a part is missing or the text can't be split."""
    return F.struct(*[F.regexp_extract(text, PARTS, i).alias(name) for i, name in enumerate(("left", "center", "right"), 1)])


def header_codes(part: Column) -> Column:
    """(text, font, color, size) of one part; of several codes the last counts."""
    size = F.trim(last_group(part, CODES, 3)).cast("int")
    return F.struct(F.regexp_replace(part, CODES, "").alias("text"), last_group(part, CODES, 1).alias("font"), last_group(part, CODES, 2).alias("color"), size.alias("size"))
