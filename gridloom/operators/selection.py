"""What of a workbook is looked at: sheets, rows, columns, ranges, print areas, and what isn't hidden.

A selection is one value for all sheets or a dictionary of values by sheet; sheets that it doesn't name aren't restricted, and a name that is no sheet is a KeyError. Values are what
a caller writes down, so they become part of the plan; settings of rows, columns and merged ranges come from the workbook's own relations and are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import coords
from gridloom.operators import cells as C

ROWS = 64
TITLES, AREA = "_xlnm.Print_Titles", "_xlnm.Print_Area"  # fixed values: names that workbooks give to them


def by_sheet(spec, sheets: list[str]) -> dict[str, object]:
    """Values of a selection by sheet."""
    if spec is None:
        return {}
    if not isinstance(spec, dict):
        return dict.fromkeys(sheets, spec)
    for name in spec:
        if name not in sheets:
            raise KeyError(name)
    return {s: v for s, v in spec.items() if v is not None}


def rectangles(spec: str | list[str]) -> list[tuple[int, int, int, int]]:
    """Bounds of A1:D20, B:D, 3:7, K2, several with commas between, or a list of these. References to other sheets, row 0, columns past the last and an empty list are refused."""
    found = [x.strip().replace("$", "") for item in ([spec] if isinstance(spec, str) else spec) for x in item.split(",")]
    if not found or "!" in "".join(found):
        raise ValueError(f"{spec!r} isn't a selection of ranges")
    out = []
    for x in found:
        try:
            r0, c0, r1, c1 = coords.bounds(x)
        except (TypeError, ValueError, AttributeError) as error:
            raise ValueError(f"{x!r} isn't a range") from error
        first, _, last = x.partition(":")
        place = lambda end: (int("".join(filter(str.isdigit, end)) or 0), coords.index(letters) if (letters := "".join(filter(str.isalpha, end))) else 0)
        if last and any(a > b for a, b in zip(place(first), place(last), strict=True)):
            raise ValueError(f"{x!r} ends before it begins")
        if not (1 <= r0 <= r1 <= coords.MAX_ROW and 1 <= c0 <= c1 <= coords.LAST_COLUMN):
            raise ValueError(f"{x!r} isn't on a sheet")
        out.append((r0, c0, r1, c1))
    return out


def lines(spec, columns: bool = False) -> list[tuple[int, int]]:
    found = C.segments(spec, columns)
    if not found or found[0][0] < 1 or found[-1][1] > (coords.LAST_COLUMN if columns else coords.MAX_ROW):
        raise ValueError(f"{spec!r} isn't a selection of {'columns' if columns else 'rows'}")
    return found


def overlapping(a: list[tuple[int, int, int, int]], b: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Rectangles that two sets have in common."""
    met = ((max(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), min(x[3], y[3])) for x in a for y in b)
    return sorted({m for m in met if m[0] <= m[2] and m[1] <= m[3]})


def chosen_sheets(book: dict[str, DataFrame], sheets: str | list[str] | None = None, skip_hidden_sheets: bool = False) -> list[str]:
    """Names of the sheets that are looked at, in the workbook's order: a workbook has few."""
    there = book["sheets"].select("sheet", "state").orderBy("sheet_no").collect()
    names = [r["sheet"] for r in there]
    wanted = names if sheets is None else [sheets] if isinstance(sheets, str) else sheets
    for name in wanted:
        if name not in names:
            raise KeyError(name)
    return [r["sheet"] for r in there if r["sheet"] in wanted and not (skip_hidden_sheets and r["state"] != "visible")]


def print_ranges(book: dict[str, DataFrame], sheets: list[str]) -> dict[str, list[tuple[int, int, int, int]]]:
    """Print areas and titles of sheets: the title rows along the areas' columns, the title columns along their rows. One name of each kind a sheet comes to the driver."""
    told = book["defined_names"].where(F.col("name").isin(AREA, TITLES) & F.col("scope").isin(sheets)).select("scope", "name", "refers_to").collect()
    bare = lambda text: [x.rpartition("!")[2].replace("$", "") for x in text.split(",")]
    areas = {r["scope"]: [coords.bounds(x) for x in bare(r["refers_to"])] for r in told if r["name"] == AREA}
    titles = {r["scope"]: bare(r["refers_to"]) for r in told if r["name"] == TITLES}
    out = {}
    for sheet, rects in areas.items():
        more = list(rects)
        for x in titles.get(sheet, []):
            r0, c0, r1, c1 = coords.bounds(x)
            across = x.replace(":", "").isdigit()
            more.append((r0, min(r[1] for r in rects), r1, max(r[3] for r in rects)) if across else (min(r[0] for r in rects), c0, max(r[2] for r in rects), c1))
        out[sheet] = more
    return out


def selected(
    book: dict[str, DataFrame], sheets: str | list[str] | None = None, skip_hidden_sheets: bool = False, skip_hidden: bool = False, print_area_only: bool = False, rows=None, columns=None, ranges=None,
) -> dict[str, DataFrame]:
    """The relations of a workbook with the cells, and merged ranges, that all given conditions keep; links, comments and settings of chosen sheets stay whole.

    A merged range is kept if it holds a kept cell. ``skipped`` (sheet, skipped_cells) counts what was left out of each chosen sheet.
    """
    names = chosen_sheets(book, sheets, skip_hidden_sheets)
    everywhere = chosen_sheets(book)
    of_rows, of_columns, of_ranges = ({s: v for s, v in by_sheet(spec, everywhere).items() if s in names} for spec in (rows, columns, ranges))
    rects = {s: rectangles(v) for s, v in of_ranges.items()}
    if print_area_only:
        for s, area in print_ranges(book, names).items():
            rects[s] = overlapping(rects[s], area) if s in rects else area
    kept = F.lit(True)
    inside = lambda c, found: reduce(lambda a, b: a | b, (F.col(c).between(a, b) for a, b in found))
    for s in names:
        tests: list[Column] = []
        if s in of_rows:
            tests.append(inside("row", lines(of_rows[s])))
        if s in of_columns:
            tests.append(inside("col", lines(of_columns[s], True)))
        if s in rects:
            tests.append(C.in_rects(rects[s]))
        if tests:
            kept = kept & ((F.col("sheet") != s) | reduce(lambda a, b: a & b, tests))
    whole = book["cells"].where(F.col("sheet").isin(names))
    left = whole.where(kept)
    if skip_hidden:
        left = left.join(book["row_dims"].where("hidden").select("sheet", "row").distinct(), ["sheet", "row"], "left_anti")
        hidden = book["col_dims"].where("hidden").select("sheet", F.explode(F.sequence("first", "last")).alias("col")).distinct()  # at most as many as a sheet has columns
        left = left.join(F.broadcast(hidden) if hidden.count() <= 100_000 else hidden, ["sheet", "col"], "left_anti")
    counted = lambda df, name: df.where("value is not null or formula is not null").groupBy("sheet").agg(F.count("*").alias(name))
    skipped = counted(whole, "_all").join(counted(left, "_left"), "sheet", "left").select("sheet", (F.col("_all") - F.coalesce("_left", F.lit(0))).alias("skipped_cells"))
    out = {k: d.where(F.col("sheet").isin(names)) if "sheet" in d.columns and k != "sheets" else d for k, d in book.items()}
    return out | {"cells": left, "merged": holding(out["merged"], left), "skipped": skipped}


def holding(ranges: DataFrame, cells: DataFrame) -> DataFrame:
    """Ranges (sheet, r0, c0, r1, c1) that hold at least one of the cells: an equality join on blocks of rows, of which cells are told once for each column."""
    at = cells.select(F.col("sheet").alias("_sheet"), "row", "col", F.floor(F.col("row") / ROWS).alias("_at"))
    cut = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("r0") / ROWS), F.floor(F.col("r1") / ROWS))))
    met = (F.col("sheet") == F.col("_sheet")) & (F.col("_block") == F.col("_at")) & F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    return cut.join(at, met, "left_semi").drop("_block").distinct()
