"""Selections of sheets, rows, columns, ranges, print areas and what isn't hidden."""

import pytest

from gridloom.operators import selection

ALL = {(s, r, c) for s in ("A", "B", "H") for r in range(1, 101) for c in range(1, 6)}


@pytest.fixture(scope="module")
def book(spark):
    frame = spark.createDataFrame
    return {
        "cells": frame([(s, r, c, "v", None) for s, r, c in sorted(ALL)], "sheet string, row int, col int, value string, formula string").repartition(3).persist(),
        "sheets": frame([("A", 0, "visible"), ("B", 1, "visible"), ("H", 2, "hidden")], "sheet string, sheet_no int, state string"),
        "row_dims": frame([("A", 2, True), ("A", 3, False), ("B", 4, True)], "sheet string, row int, hidden boolean"),
        "col_dims": frame([("A", 4, 5, True), ("B", 1, 1, False)], "sheet string, first int, last int, hidden boolean"),
        "merged": frame([("A", 1, 1, 2, 2), ("A", 60, 3, 99, 4), ("B", 5, 1, 5, 2), ("A", 200, 1, 300, 1)], "sheet string, r0 int, c0 int, r1 int, c1 int"),
        "defined_names": frame([(selection.AREA, "A", "'A'!$B$3:$C$9,'A'!$E$20"), (selection.TITLES, "A", "'A'!$A:$A,'A'!$1:$2"), ("other", None, "A!$A$1")], "name string, scope string, refers_to string"),
    }


def kept(book, **options):
    out = selection.selected(book, **options)
    return {tuple(r) for r in out["cells"].select("sheet", "row", "col").collect()}, sorted(tuple(r) for r in out["merged"].select("sheet", "r0", "c0", "r1", "c1").collect()), {r["sheet"]: r["skipped_cells"] for r in out["skipped"].collect()}


def test_lines_and_ranges_of_all_sheets(book):
    cells, merged, skipped = kept(book, rows="50:70,2", columns=["B:C", 5])
    assert cells == {x for x in ALL if (50 <= x[1] <= 70 or x[1] == 2) and x[2] in (2, 3, 5)} and merged == [("A", 1, 1, 2, 2), ("A", 60, 3, 99, 4)] and skipped == {s: 500 - 66 for s in "ABH"}


def test_selections_by_sheet_and_hidden_things(book):
    cells, merged, skipped = kept(book, ranges={"A": ["A1:B3", "D90:F95"], "H": "B:B"}, skip_hidden=True, skip_hidden_sheets=True)
    assert cells == {x for x in ALL if x[0] == "A" and (x[1] in (1, 3) and x[2] <= 2)} | {x for x in ALL if x[0] == "B" and x[1] != 4}
    assert merged == [("A", 1, 1, 2, 2), ("B", 5, 1, 5, 2)] and skipped == {"A": 496, "B": 5}


def test_print_areas_with_titles(book):
    cells, _, _ = kept(book, print_area_only=True, sheets="A")
    area = lambda r, c: 3 <= r <= 9 and c in (2, 3) or (r, c) == (20, 5) or c == 1 and 3 <= r <= 20 or r <= 2 and 2 <= c <= 5
    assert cells == {x for x in ALL if x[0] == "A" and area(*x[1:])}
    assert kept(book, print_area_only=True, sheets="A", ranges="A5:B6")[0] == {("A", r, c) for r in (5, 6) for c in (1, 2)}


@pytest.mark.parametrize(("options", "error"), [({"sheets": "no"}, KeyError), ({"rows": {"no": 1}}, KeyError), ({"rows": 0}, ValueError), ({"columns": "XFE"}, ValueError), ({"ranges": "A!B1"}, ValueError), ({"ranges": []}, ValueError), ({"ranges": "B2:A1"}, ValueError), ({"ranges": "A0"}, ValueError)])
def test_what_is_refused(book, options, error):
    with pytest.raises(error):
        selection.selected(book, **options)
