"""Workbooks built from raw XML, and the writer's round trip."""

import zipfile

import pytest

from gridloom.sources import xlsx
from gridloom.streaming import events

S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("books") / "b.xlsx")
    parts = xlsx.package_parts(["One & two", "Hidden"])
    parts["xl/workbook.xml"] = f'<workbook {S}><workbookPr date1904="1"/><sheets><sheet name="One &amp; two" sheetId="1" r:id="rId1"/><sheet name="Hidden" sheetId="2" state="hidden" r:id="rId2"/></sheets><definedNames><definedName name="x" localSheetId="1">Hidden!$A$1</definedName></definedNames></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace("</Relationships>", f'<Relationship Id="rId8" Type="{REL}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="rId9" Type="{REL}/styles" Target="/xl/styles.xml"/></Relationships>')
    parts["xl/sharedStrings.xml"] = f"<sst {S}><si><t>zero</t></si><si><r><t>th</t></r><r><rPr><b/></rPr><t>ree</t></r><rPh><t>no</t></rPh></si></sst>"
    parts["xl/styles.xml"] = f'<styleSheet {S}><numFmts><numFmt numFmtId="164" formatCode="[h]:mm:ss"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    parts["xl/worksheets/sheet1.xml"] = f"""<worksheet {S}><dimension ref="A1:D9"/><cols><col min="2" max="3" width="20" hidden="1"/></cols><sheetData>
<row r="1" ht="30" hidden="1"><c r="A1" t="s"><v>0</v></c><c t="s"><v>1</v></c><c r="D1"><v>1.5</v></c></row>
<row><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c s="1"><v>43831</v></c><c t="inlineStr"><is><t> in </t></is></c></row>
<row r="5"><c r="A5"><f t="shared" ref="A5:A6" si="0">B5*$C$1</f><v>2</v></c><c r="B5" t="str"><f>"a"&amp;"b"</f><v>ab</v></c></row><row r="6"><c r="A6"><f t="shared" si="0"/><v>3</v></c><c r="B6" s="2"/></row>
</sheetData><mergeCells><mergeCell ref="A8:B9"/></mergeCells><conditionalFormatting sqref="A1:A9"><cfRule type="cellIs" operator="greaterThan" priority="1" dxfId="0"><formula>3</formula></cfRule></conditionalFormatting>
<dataValidations><dataValidation type="whole" allowBlank="1" sqref="D1:D9"><formula1>1</formula1><formula2>9</formula2></dataValidation></dataValidations><hyperlinks><hyperlink ref="A1" r:id="rId1" tooltip="t"/></hyperlinks></worksheet>"""
    parts["xl/worksheets/sheet2.xml"] = f'<worksheet {S}><sheetData><row r="3"><c r="B3"><v>7</v></c></row></sheetData></worksheet>'
    parts["xl/worksheets/_rels/sheet1.xml.rels"] = f'<Relationships><Relationship Id="rId1" Type="{REL}/hyperlink" Target="http://x.example/" TargetMode="External"/><Relationship Id="rId2" Type="{REL}/comments" Target="../comments1.xml"/><Relationship Id="rId3" Type="{REL}/table" Target="../tables/table1.xml"/></Relationships>'
    parts["xl/comments1.xml"] = f'<comments {S}><authors><author>Ann</author></authors><commentList><comment ref="B2" authorId="0"><text><r><t>hey</t></r></text></comment></commentList></comments>'
    parts["xl/tables/table1.xml"] = f'<table {S} displayName="T" ref="A1:B3" totalsRowCount="1"><tableColumns count="2"><tableColumn id="1" name="p"/><tableColumn id="2" name="q"/></tableColumns></table>'
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return path


def load(spark, path, relation, **options):
    xlsx.register(spark)
    return spark.read.format("gridloom_xlsx").option("relation", relation).options(**options).load(path)


def test_cells(spark, book):
    got = {(r["sheet"], r["row"], r["col"]): r for r in load(spark, book, "cells").collect()}
    one = lambda r, c: got["One & two", r, c]
    assert [(one(1, c)["kind"], one(1, c)["value"]) for c in (1, 2, 4)] == [("text", "zero"), ("text", "three"), ("number", "1.5")]
    assert [(one(2, c)["kind"], one(2, c)["value"]) for c in (1, 2, 3, 4)] == [("bool", "TRUE"), ("error", "#N/A"), ("date", "43831"), ("text", " in ")]
    assert one(5, 1)["formula"] == "=B5*$C$1" and one(6, 1)["formula"] == "=B6*$C$1" and one(6, 1)["value"] == "3" and one(5, 2)["formula"] == '="a"&"b"'
    assert one(6, 2)["value"] is None and one(6, 2)["style"] == 2
    assert load(spark, book, "cells", sheet="Hidden").select("row", "col", "value").collect() == [(3, 2, "7")]


def test_other_relations(spark, book):
    rows = lambda relation: [tuple(r)[1:] for r in load(spark, book, relation).collect()]
    assert rows("sheets") == [("One & two", 0, "visible", "A1:D9", True), ("Hidden", 1, "hidden", None, True)]
    assert rows("merged") == [("One & two", 8, 1, 9, 2)]
    assert rows("hyperlinks") == [("One & two", 1, 1, 1, 1, "http://x.example/", None, "t")]
    assert rows("comments") == [("One & two", 2, 2, "Ann", "hey")]
    assert rows("row_dims") == [("One & two", 1, 30.0, True, 0)] and rows("col_dims") == [("One & two", 2, 3, 20.0, True, 0)]
    assert rows("defined_names") == [("x", "Hidden", "Hidden!$A$1", False)]
    assert rows("validations") == [("One & two", "D1:D9", "whole", "between", "1", "9", True)]
    assert rows("cond_formats") == [("One & two", "A1:A9", "cellIs", "greaterThan", 1, ["3"], 0)]
    assert rows("tables") == [("One & two", "T", "A1:B3", ["p", "q"], True)] and rows("strings") == [(0, "zero"), (1, "three")]
    assert rows("rich_strings") == [(1, 0, "th", None), (1, 1, "ree", "b")] and rows("settings") == []
    with pytest.raises(Exception, match="isn't one of"):
        rows("nothing")


def test_written_workbooks_read_back(spark, tmp_path):
    data = [("S1", r, c, t) for r in range(1, 40) for c, t in ((1, str(r)), (2, "text & <more>"), (4, "TRUE"), (5, '"12"'), (6, "1.5"))] + [("Other", 2, 3, "#REF!")]
    df = spark.createDataFrame(data, "sheet string, row int, col int, token string").repartition(4)
    xlsx.register(spark)
    path = str(tmp_path / "out.xlsx")
    df.write.format("gridloom_xlsx").mode("append").option("path", path).save()
    got = {(r["sheet"], r["row"], r["col"]): (r["kind"], r["value"]) for r in load(spark, path, "cells").collect()}
    kinds = {"TRUE": ("bool", "TRUE"), '"12"': ("text", "12"), "text & <more>": ("text", "text & <more>"), "#REF!": ("error", "#REF!")}
    assert got == {(s, r, c): kinds.get(t, ("number", t)) for s, r, c, t in data}


def test_bad_packages(tmp_path):
    with pytest.raises(ValueError, match="only .xlsx"):
        xlsx.Package(str(tmp_path / "a.xls"))
    with pytest.raises(ValueError, match="DOCTYPE"):
        xlsx.parse(b'<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')


def test_streamed_windows_equal_static_ones(spark, tmp_path):
    import datetime

    rows = [(i, datetime.datetime(2024, 1, 1 + i // 20, i % 20), i % 3, "ab"[i % 2], float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = events.tumbling(source).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(spark.table("windows").collect()) == sorted(events.tumbling(df).collect())
    assert events.sessions(df, "2 hours").count() > 0 and events.appended_cells(df).count() == 300
