"""Documents of whole workbooks: text and JSON read back to the relations that were written, with chosen sections and sheets."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import sections, styles
from gridloom.sources import workbook

SHEETS = ["Sales & co", "Ledger", 'odd "name" #', "Empty"]
WORDS = ["USD", "EU", "plain text", "12", "a|b", "line\nbreak", "=x", "## no head", "### values", "é", "^", "#N/A!", "2024-01-01", '"', "5:z", "x*3"]


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    rng, rows = random.Random(8), []
    for s in SHEETS[:3]:
        for r in range(1, 260 if s == "Ledger" else 40):
            for c in range(1, 6):
                if rng.random() < 0.8:
                    kind, value = rng.choice([("text", rng.choice(WORDS)), ("number", str(rng.randint(0, 5))), ("number", "1.5"), ("bool", "TRUE"), ("date", "45292"), ("date", "45292.5"), ("error", "#DIV/0!"), ("text", "USD"), ("text", "USD")])
                    formula = f"=A{r}*2" if c == 5 else None
                    rows.append((s, r, c, "number" if formula else kind, value if not formula else "3", formula, "b" if r % 9 == 0 else None))
    raw = spark.createDataFrame(rows, "sheet string, row int, col int, kind string, value string, formula string, font string").repartition(3)
    cells, parts, formats = styles.pooled(raw)
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    path = str(tmp_path_factory.mktemp("books") / "all.xlsx")
    workbook.save(
        cells, path, sheets=SHEETS, states={"Ledger": "hidden"}, styles=styles.stylesheet(parts, formats),
        merged=frame([("Ledger", 300 + 2 * i, 1, 301 + 2 * i, 3) for i in range(90)] + [(SHEETS[2], 1, 7, 2, 8)], "sheet string, r0 int, c0 int, r1 int, c1 int"),
        hyperlinks=frame([("Ledger", 2, 2, 2, 3, "https://x.example/?a=1 b", None, 'say "hi"'), (SHEETS[0], 1, 1, 1, 1, None, "Ledger!A1", None)], "sheet string, r0 int, c0 int, r1 int, c1 int, target string, location string, tooltip string"),
        comments=frame([("Ledger", 3, 3, "Ann (x)", "two\nlines"), (SHEETS[0], 9, 1, "", "")], "sheet string, row int, col int, author string, text string"),
        row_dims=frame([("Ledger", r, 20.5 if r < 9 else None, r > 7, 1 if r > 10 else 0) for r in (1, 2, 3, 8, 9, 11, 12)], "sheet string, row int, height double, hidden boolean, outline int"),
        col_dims=frame([("Ledger", 2, 4, 12.5, True, 2)], "sheet string, first int, last int, width double, hidden boolean, outline int"),
        validations=frame([("Ledger", "A1:A9 C3", "list", "between", '"a,b c"', None, True)], "sheet string, ranges string, type string, operator string, formula1 string, formula2 string, allow_blank boolean"),
        cond_formats=frame([("Ledger", "A1:A9 C3", "cellIs", "between", 1, ["1", 'A1&"(x)"'], None), ("Ledger", "B1", "duplicateValues", None, 2, [], None)], "sheet string, ranges string, type string, operator string, priority int, formulas array<string>, style int"),
        tables=frame([("Ledger", "T_1", "A1:B9", ["a b", "c"], True)], "sheet string, name string, ref string, columns array<string>, totals_row boolean"),
        defined_names=frame([("n1", None, "'Ledger'!$A$1", False), ("n2", "Ledger", "1+1", True)], "name string, scope string, refers_to string, hidden boolean"),
        settings=frame([("Ledger", "sheetViews", sections.frozen(3, 2)), ("Ledger", "pageMargins", "left=0.5 right=0.5 top=1 bottom=1 header=0.3 footer=0.3"), ("Ledger", "sheetPr", "tabColor(rgb=FF00FF00)"), ("Ledger", "headerFooter", 'oddHeader("&C(x) & co")'), (SHEETS[0], "autoFilter", "ref=A1:B9 filterColumn(colId=0 filters(filter:x))")], "sheet string, name string, text string"),
        properties=frame([("title", "A title"), ("own", "v (1)")], "name string, value string"),
    )
    return {k: d.persist() for k, d in sections.opened(spark, path).items()}


@pytest.fixture(scope="module")
def whole(book):
    return sections.encoded(book, "all.xlsx").persist()


def test_frozen_panes():
    assert sections.frozen(2, 1) == "sheetView(workbookViewId=0 pane(ySplit=1 topLeftCell=A2 activePane=bottomLeft state=frozen))" and sections.frozen(1, 1) == "sheetView(workbookViewId=0)"
    assert "xSplit=2 topLeftCell=C1 activePane=topRight" in sections.frozen(1, 3) and "xSplit=1 ySplit=2 topLeftCell=B3 activePane=bottomRight" in sections.frozen(3, 2)


def rows(df, columns):
    return sorted((tuple(map(str, r)) for r in df.select(columns).collect()))


def check(book, got):
    for name in ("merged", "hyperlinks", "comments", "row_dims", "col_dims", "validations", "cond_formats", "tables", "defined_names", "properties", "settings"):
        assert rows(got[name], book[name].columns) == rows(book[name], book[name].columns), name
    assert rows(got["sheets"], ["sheet", "sheet_no", "state"]) == rows(book["sheets"], ["sheet", "sheet_no", "state"])
    assert rows(got["values"], ["sheet", "row", "col", "token"]) == rows(sections.cell_tokens(book["cells"]), ["sheet", "row", "col", "token"])
    assert rows(got["formulas"], ["sheet", "row", "col", "formula"]) == rows(book["cells"].where("formula is not null"), ["sheet", "row", "col", "formula"])
    assert rows(got["styles"], ["sheet", "row", "col", "style"]) == rows(book["cells"].where("style > 0"), ["sheet", "row", "col", "style"])
    columns = ["style", *styles.PARTS, *styles.VALUES]
    assert rows(got["cell_styles"], columns) == rows(book["cell_styles"], columns)


@pytest.mark.parametrize("form", ["text", "json"])
def test_documents_read_back(spark, book, whole, tmp_path, form):
    path, doc = str(tmp_path / form), whole
    (sections.save_text if form == "text" else sections.save_json)(doc, path)
    lines = (sections.load_text if form == "text" else sections.load_json)(spark, path).persist()
    texts = [r["text"] for r in lines.orderBy("line_no").collect()]
    assert texts[0].startswith('#gridloom/1 source="all.xlsx" sections=analysis,values,') and texts[1] == "## workbook" and texts == [r["text"] for r in doc.orderBy(sections.ORDER).collect()]
    assert [t for t in texts if t.startswith("## sheet")] == [f"## sheet {i} {n} dim={d}" for i, n, d in ((1, '"Sales & co"', "A1:E39"), (2, '"Ledger"', "A1:E259"), (3, '"odd \\"name\\" #"', "A1:E39"), (4, '"Empty"', "A1:A1"))]
    check(book, sections.decoded(lines))


def test_chunks_carry_heads(spark, book, monkeypatch):
    monkeypatch.setattr(sections, "CHUNK", 7)
    doc = sections.encoded(book, include="cells", encoding="grid").persist()
    lines = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(doc.orderBy(sections.ORDER).collect(), 1)], "line_no int, text string").repartition(5)
    got = sections.decoded(lines)
    assert rows(got["values"], ["sheet", "row", "col", "token"]) == rows(sections.cell_tokens(book["cells"]), ["sheet", "row", "col", "token"])
    assert got["merged"].count() == 0 and got["sheets"].count() == 0


def test_chosen_sections_and_sheets(spark, book):
    assert sections.chosen("cells", "styles") == ["values", "formulas"] and "workbook" in sections.chosen("metadata") and sections.chosen("all", ["cells", "metadata"]) == ["analysis"]
    with pytest.raises(ValueError, match="isn't a section"):
        sections.chosen("everything")
    with pytest.raises(KeyError, match="nowhere"):
        sections.encoded(book, sheets=["nowhere"])
    one = [r["text"] for r in sections.encoded(book, include=["values", "analysis", "workbook"], sheets=["Ledger"]).orderBy(sections.ORDER).collect()]
    assert [t for t in one if t.startswith("## sheet")] == ['## sheet 2 "Ledger" dim=A1:E259'] and sum(t.startswith("sheet(name=") for t in one) == 4
    told = next(t for t in one if t.startswith("cells="))
    assert told.startswith(f"cells={book['cells'].where(F.col('sheet') == 'Ledger').where('value is not null').count()} rows=259 values=A1:E259 density=") and "kinds=number:" in told and "est_tokens=grid:" in told


def test_empty_workbook(spark, tmp_path):
    path = str(tmp_path / "e.xlsx")
    workbook.save(spark.createDataFrame([], "sheet string, row int, col int, kind string, value string"), path, sheets=["S"])
    doc = sections.encoded(sections.opened(spark, path))
    sections.save_text(doc, str(tmp_path / "e"))
    got = sections.decoded(sections.load_text(spark, str(tmp_path / "e")))
    assert got["values"].count() == 0 and [tuple(r) for r in got["sheets"].collect()] == [("S", 0, "visible")]
