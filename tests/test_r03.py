"""What a review of larger tables found."""

import io
import zipfile

from gridloom.functions import formula
from gridloom.operators import cells as C
from gridloom.operators import cover, dimensions, formulas
from gridloom.sources import scan, workbook, xlsx

FORMULAS = "sheet string, row int, col int, formula string, formula_kind string, formula_ref string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_take_first_formulas_from_templates(spark):
    rows = [("s", r, 1, f"=B{r}*2", None, None) for r in range(1, 40)] + [("s", r, 3, f"=SUM(A:A)+B{r}", None, None) for r in range(1, 9)] + [("s", 50, 1, '=A50&"\x03"', None, None)]
    lines = formulas.lines(spark.createDataFrame(rows, FORMULAS))
    assert "SUM(A:A)" in str(lines.collect()) and sorted(map(tuple, formulas.decoded(lines).select("row", "col", "formula").collect())) == sorted((r, c, f) for _, r, c, f, _, _ in rows)
    # no join with the cells, which a small file lets look small enough for a broadcast
    assert plan(lines).count("Join ") == plan(lines).count("strategy=merge")


def test_open_ranges_reach_the_last_row_of_a_relation(spark):
    cells = spark.createDataFrame([("s", r, c, "x") for r in (1, 1_048_576, 1_048_577, 9_000_000) for c in (1, 3)], "sheet string, row int, col int, token string")
    assert C.select_range(cells, "A:B").count() == 4 and C.select_range(cells, "1048577:1048577").count() == 2
    assert sorted(r[0] for r in C.merged(cells, "A:C").select("row").collect()) == [1]
    assert C.moved(cells, "A:A", 1, 1).where("col = 2").count() == 4


def test_formulas_beyond_the_rows_of_a_file(spark):
    assert formula.fill("=F2*$E2+SUM(A:A)", 1_048_576, 0) == "=F1048578*$E1048578+SUM(A:A)" and formula.fill("=A54000000", 1, 0) == "=A54000001"
    assert formula.fill("=A2147483647", 1, 0) is None and formula.fill("=A1", -1, 0) is None
    rows = [("s", r, 1, f"=B{r}*2", None, None) for r in (*range(1_048_570, 1_048_590), *range(53_999_990, 54_000_010))]
    got = formulas.lines(spark.createDataFrame(rows, FORMULAS)).orderBy("first_row").select("line").collect()
    assert [r[0] for r in got] == ["A1048570:A1048589=B1048570*2", "A53999990:A54000009=B53999990*2"]


def test_whole_lines_of_an_index(spark):
    spans = spark.createDataFrame([("s", "x", r, 1, r, 1, 1) for r in (200_000, 3, 65_536, 65_535)] + [("s", "y", 1, 2, 70_000, 2, 1)], "sheet string, token string, r0 int, c0 int, r1 int, c1 int, step int")
    assert sorted(map(tuple, cover.whole_lines(spans).collect())) == [("s", "x", "A3,A65535,A65536,A200000"), ("s", "y", "B1:B70000")]


def test_parts_of_archives_come_in_chunks(tmp_path):
    path, sheet = str(tmp_path / "a.xlsx"), "<worksheet><sheetData>" + "".join(f'<row r="{i}"><c r="A{i}"><v>{i * 7919 % 1009}</v></c></row>' for i in range(1, 500)) + "</sheetData></worksheet>"
    for kind in (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED):
        with zipfile.ZipFile(path, "w", kind) as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr("xl/workbook.xml", "<workbook/>")
            z.writestr("s.xml", sheet)
        method, chunks = xlsx.Package(path).compressed("s.xml", 100)
        held = list(chunks)
        assert len(held) > 9 and max(map(len, held)) == 100
        assert sum(len(scan.cell_columns(p, frozenset())[0]) for p in workbook.sheet_pieces(workbook.Inflated(method, held))) == 499


def test_comments_are_read_as_a_stream():
    asked, one = [], f'<comment xmlns="{scan.MAIN[1:-1]}" ref="A1"/>'.encode()

    class Endless(io.RawIOBase):
        def read(self, n=-1):
            asked.append(n)
            return (b"<comments><commentList>" if len(asked) == 1 else b"") + one * 100

    found = xlsx.elements(Endless(), "comment")
    assert [next(found).get("ref") for _ in range(1000)] == ["A1"] * 1000 and len(asked) < 12


def test_cells_outside_spans_are_joined_without_broadcast(spark):
    cells = spark.createDataFrame([("s", 1, 1, "x"), ("s", 2, 1, "y")], "sheet string, row int, col int, token string")
    spans = spark.createDataFrame([("s", 1, 1, 9, 1, 2)], "sheet string, r0 int, c0 int, r1 int, c1 int, step int")
    out = dimensions.outside_strides(cells, spans)
    assert [r["token"] for r in out.collect()] == ["y"] and "strategy=merge" in plan(out)


def test_a_cut_parses_only_rows_that_define_shared_formulas(monkeypatch):
    cell = lambda c, r, si: f'<c r="{c}{r}"><f t="shared" si="{si}"/><v>1</v></c>'
    rows = [f'<row r="{r}">{cell("A", r, 0)}{cell("B", r, 1)}</row>' for r in range(1, 400)]
    rows[4] = "<row r=\"5\"><c r='A5'><f t='shared' ref='A5:A9' si='0'>B5/2</f></c><c><f t=\"shared\" si=\"1\">$A5&lt;1</f></c></row>"
    rows[200] = '<row><c><f>"shared"</f></c><c><f t="shared" si="0">C7</f></c><c r="D201"><f t="shared" si="2"></f></c></row>'
    parsed, cells_of = [], scan.cells_of
    monkeypatch.setattr(scan, "cells_of", lambda data, before: parsed.append(len(data)) or cells_of(data, before))
    data = "".join(rows).encode()
    assert scan.own_masters(data, 0) == {"0": (5, 1, "=B5/2"), "1": (5, 2, "=$A5<1")}
    assert scan.own_masters(data[data.index(rows[200].encode()) :], 200) == {"0": (201, 2, "=C7")}
    assert sum(parsed) < len(data) / 50
    found = list(scan.pieces(io.BytesIO(b"<worksheet><sheetData>" + data + b"</sheetData></worksheet>"), 2000))
    assert [m[0] for m in found[-1].masters] == ["0", "1"] and b"".join(p.data for p in found) == data


def test_forms_of_a_sheet_read_the_row_above_without_joins(spark):
    rows = [("s", r, c, "long text" if r % 7 else f"t{c}") for r in (*range(1, 60), *range(cover.STRIP - 3, cover.STRIP + 4), 3 * cover.STRIP) for c in (1, 2, 3, 4, 9) if (r + c) % 5]
    cells = spark.createDataFrame([*rows, *(("t", *x[1:]) for x in rows[::2])], "sheet string, row int, col int, token string")
    at = {(x["sheet"], x["row"], x["col"]): x["token"] for x in cells.collect()}
    lines = {(s, r) for s, r, _ in at}
    got = {(x["sheet"], x["row"], x["col"]): (x["labelled"], x["ditto"]) for x in cover.dittos(cells).collect()}
    for (s, r, c), token in at.items():
        labelled = (s, r - 1) not in lines or r % 10 == 0
        assert got[s, r, c] == (labelled, not labelled and at.get((s, r - 1, c)) == token == "long text")
    assert len(got) == len(at) and any(d for _, d in (got["s", cover.STRIP, c] for c in (1, 2, 3, 4) if ("s", cover.STRIP, c) in got))
    told = cover.grid_lines(cells)
    assert plan(told).count("Join ") == 1  # the start of each sheet
    physical = told._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") <= 2


def test_mismatches_count_each_difference(spark):
    from gridloom.plans.catalog import mismatches

    of = lambda *rows: spark.createDataFrame(list(rows), "sheet string, row int, col int, token string")
    a = of(("s", 1, 1, "x"), ("s", 1, 1, "x"), ("s", 1, 2, None), ("s", 2, 1, "y"))
    b = of(("s", 1, 1, "x"), ("s", 1, 2, None), ("s", 2, 1, "z"))
    assert mismatches(a, b).first()[0] == 3 and mismatches(a, a).first()[0] == 0 and mismatches(a.limit(0), b.limit(0)).first()[0] == 0


def test_decoding_makes_lines_once(spark):
    from gridloom.operators import document

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    cells = spark.createDataFrame([("s", r, c, f"v{r % 3}") for r in range(1, 50) for c in (1, 2)], "sheet string, row int, col int, token string")
    lines = document.encoded(cells, "grid").where("part = 'grid'").mapInArrow(counted, "sheet string, part string, line_no int, text string")
    start = document.encoded(cells, "grid").where("part = 'start'")
    assert document.decoded(start.unionByName(lines)).count() == 98
    assert made.value <= 4 * 49  # each of a document's three parts reads it at most once, grid lines not twice


def test_batches_of_texts_are_bounded_by_bytes(spark):
    from gridloom.llm import packing
    from gridloom.llm.queries import tokenizer_path

    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 200000) AS text")
    packing.pack(docs, tokenizer_path())
    firsts = docs.mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 1) for b in batches), "doc_id bigint")
    assert firsts.count() >= 8  # 40 MB of texts came in one batch


def test_documents_read_comments_once(spark, tmp_path):
    from gridloom.operators import sections

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    notes = spark.createDataFrame([("s", r, 1, "me", f"note {r}") for r in range(1, 21)], "sheet string, row int, col int, author string, text string")
    book = {
        "cells": spark.createDataFrame([("s", 1, 1, "text", "x")], "sheet string, row int, col int, kind string, value string"),
        "sheets": spark.createDataFrame([("s", 0, "visible")], "sheet string, sheet_no int, state string"), "comments": notes.mapInArrow(counted, notes.schema),
    }
    sections.save_json(sections.encoded(book, include=["comments"]), str(tmp_path / "d"))
    got = "\n".join(r["text"] for r in spark.read.json(str(tmp_path / "d")).orderBy("sheet_no", "section", "part").collect())
    assert read.value == 20 and got.count("author=me") == 20  # not for heads, lines and bounds each
