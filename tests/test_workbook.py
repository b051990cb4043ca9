"""Split sheets against whole ones, odd XML, and written archives against Python's own reader."""

import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.sources import package, scan, workbook, xlsx

S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def sheet(body, before="", after="", root=f"<worksheet {S}>", head=""):
    return f"{head}{root}{before}<sheetData>{body}</sheetData>{after}</worksheet>".encode()


def parsed(data, size):
    out = []
    try:
        found = list(scan.pieces(io.BytesIO(data), size))
    except scan.Odd:
        found = list(scan.rewritten_pieces(io.BytesIO(data), size))
    for piece in found:
        columns = [c.to_pylist() for c in scan.cell_columns(piece, frozenset({1}), ["zero", "one"])]
        out += [r[:2] + r[3:5] + r[6:] for r in zip(*columns, strict=True)]
    return found, out


def test_pieces_of_any_size_give_the_same_cells():
    rng, rows = random.Random(3), []
    for i in range(1, 400):
        number = f' r="{i + i // 50 * 7}"' if rng.random() < 0.6 else ""
        cells = [rng.choice([f"<c><v>{i}</v></c>", '<c t="s"><v>1</v></c>', '<c s="1"><v>43831</v></c>', "<c s='2'/>", '<c t="inlineStr"><is><t>a &lt; b</t></is></c>', "<c t='b'><v>1</v></c>", '<c t="str"><f>1&gt;2</f><v>x</v></c>', '<c><f t="shared" si="0"/><v>5</v></c>', '<c t="e"><v>#N/A</v></c>']) for _ in range(rng.randint(0, 6))]
        if i in (3, 200):
            cells.append(f'<c><f t="shared" ref="A1:Z999" si="{i // 200}">B{i}+$C$1</f><v>2</v></c>')
        rows.append(f'<row{number}{" hidden=" + chr(34) + "1" + chr(34) if i % 90 == 0 else ""}>{"".join(cells)}</row>')
    data = sheet("".join(rows), '<dimension ref="A1"/>', '<mergeCells><mergeCell ref="A1:B2"/></mergeCells>')
    one, want = parsed(data, 1 << 30)
    assert len(one) == 1 and b"mergeCell" in one[0].rest and len({w[0] for w in want}) > 200
    for size in (1, 100, 1_000, 7_777):
        found, got = parsed(data, size)
        assert got == want and [p.number for p in found] == list(range(len(found))) and found[-1].rest == one[0].rest and (size > 1_000 or len(found) > 10)
        assert [x for p in found for x in scan.row_settings(p)] == list(scan.row_settings(one[0]))


def test_shared_formulas_are_stitched_at_the_cuts():
    rows = '<row r="1"><c r="A1"><f t="shared" ref="A1:A900" si="0">B1*$C$1</f><v>1</v></c></row>' + "".join(f'<row r="{i}"><c r="A{i}"><f t="shared" si="0"/><v>{i}</v></c></row>' for i in range(2, 900))
    found, got = parsed(sheet(rows), 2_000)
    assert len(found) > 10 and [g[4] for g in got] == [f"=B{i}*$C$1" for i in range(1, 900)]


@pytest.mark.parametrize(
    "data",
    [
        sheet('<row r="2"><!-- <row r="9"> --><c r="B2" t="str"><v><![CDATA[a<b]]></v></c></row>'),
        f'<x:worksheet xmlns:x="{scan.MAIN[1:-1]}"><x:sheetData><x:row r="2"><x:c r="B2" t="str"><x:v>a&lt;b</x:v></x:c></x:row></x:sheetData></x:worksheet>'.encode(),
        b"\xef\xbb\xbf" + sheet('<row r="2"><c r="B2" t="str"><v>a&#60;b</v></c></row>', head='<?xml version="1.0" encoding="UTF-8"?>'),
        sheet('<row r="2"><c r="B2" t="str"><v>a&#x3c;b</v></c></row>', head='<?xml version="1.0" encoding="UTF-16"?>').decode().encode("utf-16"),
        sheet('<row r="2" y:d="1"><c t="str" r="B2"><v>a&lt;b</v></c></row>', root=f'<worksheet {S} xmlns:y="y">'),
        sheet("<row r='2'>\n<c r='B2' t='inlineStr'><is><r><rPr><b/></rPr><t>a</t></r><r><t>&lt;b</t></r><rPh><t>no</t></rPh></is></c>\n</row>"),
    ],
)
def test_odd_xml(data):
    for size in (1, 1 << 20):
        assert [g[:4] for g in parsed(data, size)[1]] == [(2, 2, "text", "a<b")]


def test_sheets_without_rows_and_refused_documents():
    for data in (f"<worksheet {S}><sheetData/><mergeCells/></worksheet>", f"<worksheet {S}><mergeCells/></worksheet>", f"<worksheet {S}><sheetData></sheetData><mergeCells/></worksheet>"):
        found, got = parsed(data.encode(), 100)
        assert got == [] and b"mergeCells" in found[0].rest
    with pytest.raises(ValueError, match="DOCTYPE"):
        list(scan.pieces(io.BytesIO(b"<!DOCTYPE x>" + sheet("")), 100))
    with pytest.raises(ValueError, match="ends"):
        list(scan.pieces(io.BytesIO(f"<worksheet {S}><sheetData><row>".encode()), 100))


def test_shared_strings_in_pieces():
    texts = [f"t{i} &amp; x" for i in range(500)]
    data = f"<sst {S} count='500'>{''.join(f'<si><t>{t}</t></si>' for t in texts)}</sst>".encode()
    for size in (1, 300, 1 << 20):
        found = list(scan.string_pieces(io.BytesIO(data), size))
        assert [s for _, d in found for s in scan.strings_of(d)] == [t.replace("&amp;", "&") for t in texts]
        assert all(first == sum(len(scan.strings_of(d)) for _, d in found[:i]) for i, (first, _) in enumerate(found))
    assert list(scan.string_pieces(io.BytesIO(f"<sst {S}/>".encode()), 5)) == []


def test_checksums_join_and_archives_open():
    rng = random.Random(1)
    texts = [rng.randbytes(rng.randint(0, 5_000)) for _ in range(8)] + [b""]
    crc = 0
    for t in texts:
        crc = package.crc_joined(crc, zlib.crc32(t), len(t))
    assert crc == zlib.crc32(b"".join(texts))
    for large in (False, True):
        archive = package.Archive()
        data = b"".join([*archive.part("a/ü.xml", map(package.deflated, texts), large), *archive.part("empty", [], large), *archive.directory()])
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and z.read("a/ü.xml") == b"".join(texts) and z.read("empty") == b""


AWKWARD = ["_x0041_", "_x000D_ and \r\n", "a\x01b\x1f", "  both  ", "<&>\"'", "", "\n", "日本 é \U0001f600", "x" * 40_000, "=not a formula", "#N/A", "￾"]


def test_round_trip_of_all_kinds(spark, tmp_path):
    rows = [("One & <two>", i, 1, "text", t, None, None) for i, t in enumerate(AWKWARD, 1)]
    rows += [("One & <two>", 3, 2, "number", "-1.5E-7", None, None), ("One & <two>", 3, 3, "bool", "TRUE", None, None), ("One & <two>", 3, 4, "error", "#REF!", None, None), ("One & <two>", 3, 5, "date", "1999-12-31 18:00:00", None, None)]
    rows += [("One & <two>", 90, 1, "number", None, "=SUM(A1:A2)", None), ("One & <two>", 90, 2, "text", "cached <", '="a"&"<"', None), ("One & <two>", 90, 3, None, None, None, 2), ("Other", 1_048_576, 16_384, "number", "7", None, None)]
    df = spark.createDataFrame(rows, "sheet string, row int, col int, kind string, value string, formula string, style int").repartition(3).withColumns({c: F.lit("clash") for c in ("part", "sheet_no", "xml", "number")}).drop("sheet_no")
    path = str(tmp_path / "a b.xlsx")
    size = workbook.save(df, path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and sum(len(z.read(n)) for n in z.namelist()) and (tmp_path / "a b.xlsx").stat().st_size == size
    got = {(r["sheet"], r["row"], r["col"]): (r["kind"], r["value"], r["formula"], r["style"]) for r in workbook.cells(spark, path).collect()}
    want = {("One & <two>", i, 1): ("text", t[:32_767], None, 0) for i, t in enumerate(AWKWARD, 1)}
    want |= {("One & <two>", 3, 2): ("number", "-1.5E-7", None, 0), ("One & <two>", 3, 3): ("bool", "TRUE", None, 0), ("One & <two>", 3, 4): ("error", "#REF!", None, 0), ("One & <two>", 3, 5): ("date", "36525.75", None, 2)}
    want |= {("One & <two>", 90, 1): ("number", None, "=SUM(A1:A2)", 0), ("One & <two>", 90, 2): ("text", "cached <", '="a"&"<"', 0), ("One & <two>", 90, 3): (None, None, None, 2), ("Other", 1_048_576, 16_384): ("number", "7", None, 0)}
    assert got == want
    xlsx.register(spark)  # the data source reads the same
    names = ["sheet", "row", "col", "seq", "kind", "value", "formula", "style", "is_date"]
    assert sorted(map(str, spark.read.format("gridloom_xlsx").load(path).select(names).collect())) == sorted(map(str, workbook.cells(spark, path).select(names).collect()))
    assert workbook.cells(spark, path, sheet="Other").count() == 1
    with pytest.raises(Exception, match="FileExists"):
        workbook.save(df, path)
    assert workbook.save(df.limit(0), path, sheets=["Empty"], overwrite=True) and workbook.cells(spark, path).count() == 0
    assert [tuple(r)[1:4] for r in workbook.relation(spark, path, "sheets").collect()] == [("Empty", 0, "visible")]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a b.xlsx"]


def test_several_workbooks_and_shared_strings(spark, tmp_path, monkeypatch):
    parts = xlsx.package_parts(["S"])
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace("</Relationships>", f'<Relationship Id="s" Type="{workbook.LINK}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
    for name in "ab":
        parts["xl/sharedStrings.xml"] = f"<sst {S}><si><t>{name}0</t></si><si><t>{name}1</t></si></sst>"
        parts["xl/worksheets/sheet1.xml"] = f"<worksheet {S}><sheetData>{''.join(f'<row><c t={chr(34)}s{chr(34)}><v>{i % 3}</v></c></row>' for i in range(300))}</sheetData></worksheet>"
        with zipfile.ZipFile(tmp_path / f"{name}.xlsx", "w", zipfile.ZIP_DEFLATED if name == "a" else zipfile.ZIP_STORED) as z:
            for n, text in parts.items():
                z.writestr(n, text)
    (tmp_path / "note.txt").write_text("not a workbook")
    monkeypatch.setattr(workbook, "PIECE", 500)
    for most in (0, 1 << 20):
        monkeypatch.setattr(workbook, "MOST_BROADCAST", most)
        got = workbook.cells(spark, str(tmp_path))
        assert sorted((r["value"] or "-", r["n"]) for r in got.groupBy("value").agg(F.count("*").alias("n")).collect()) == [("-", 200), ("a0", 100), ("a1", 100), ("b0", 100), ("b1", 100)]
        assert got.agg(F.max("row")).first()[0] == 300
    with pytest.raises(ValueError, match="only .xlsx"):
        workbook.cells(spark, f"{tmp_path}/a.xlsx,{tmp_path}/b.xlsb")


def test_bad_sheet_names(spark, tmp_path):
    df = spark.createDataFrame([("S", 1, 1, "text", "x")], "sheet string, row int, col int, kind string, value string")
    for names in (["a", "A"], ["x" * 32], ["a/b"], [""]):
        with pytest.raises(ValueError, match="names"):
            workbook.save(df, str(tmp_path / "x.xlsx"), sheets=names)
