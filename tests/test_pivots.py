"""Pivot caches read back as written and from hand-made XML; filters, orders and rules of items against plain Python."""

import datetime
import io
import random
import zipfile

import pytest

from gridloom.operators import pivot
from gridloom.sources import pivots, scan, workbook, xlsx

S = f'xmlns="{scan.MAIN[1:-1]}"'


def test_caches_read_back(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a & b", '"q"', "é", "", None, "x<y"]), rng.choice([1.5, -2.0, None]), rng.choice([True, False, None]), rng.choice([datetime.datetime(2024, 1, 2, 3, 4, 5), None])) for i in range(700)]
    df = spark.createDataFrame(rows, "k bigint, t string, n double, b boolean, d timestamp_ntz").repartition(3)
    path = str(tmp_path / "p.xlsx")
    cell = spark.createDataFrame([("S", 1, 1, "text", "x")], "sheet string, row int, col int, kind string, value string")
    workbook.save(cell, path, pivot_cache=df, pivot_order=["k"], pivot_source=("S", "A1:E701"))
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
    assert [tuple(r)[1:] for r in pivots.caches(spark, path).collect()] == [(1, "S", "A1:E701", ["k", "t", "n", "b", "d"])]
    assert sorted(r["value"] for r in pivots.shared_items(spark, path).collect()) == sorted({t for _, t, *_ in rows if t is not None})
    plain = lambda v: ("blank", None) if v is None else ("bool", str(int(v))) if isinstance(v, bool) else ("number", str(v)) if isinstance(v, int | float) else ("date", v.isoformat()) if isinstance(v, datetime.datetime) else ("text", v)
    want = {(r, f): plain(v) for r, row in enumerate(rows) for f, v in enumerate(row)}
    for most, piece in ((1 << 20, 1 << 20), (0, 900)):
        monkeypatch.setattr(pivots, "MOST_BROADCAST", most)
        monkeypatch.setattr(workbook, "PIECE", piece)
        assert {(r["record"], r["field"]): (r["kind"], r["value"]) for r in pivots.records(spark, path).collect()} == want
    assert workbook.cells(spark, path).count() == 1 and pivots.tables(spark, path).count() == 0


def test_pivot_tables_know_their_caches(spark, tmp_path):
    parts = xlsx.package_parts(["S"])
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts["xl/workbook.xml"] = parts["xl/workbook.xml"].replace("</workbook>", '<pivotCaches><pivotCache cacheId="7" r:id="p"/></pivotCaches></workbook>')
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace("</Relationships>", f'<Relationship Id="p" Type="{rel}/pivotCacheDefinition" Target="pivotCache/d.xml"/></Relationships>')
    parts["xl/pivotCache/d.xml"] = f'<pivotCacheDefinition {S}><cacheFields><cacheField name="f"><sharedItems><s v="u"/><n v="2"/><m/></sharedItems></cacheField><cacheField name="g"/></cacheFields></pivotCacheDefinition>'
    parts["xl/pivotCache/_rels/d.xml.rels"] = f'<Relationships><Relationship Id="r" Type="{rel}/pivotCacheRecords" Target="r.xml"/></Relationships>'
    parts["xl/pivotCache/r.xml"] = f'<pivotCacheRecords {S}><r><x v="0"/><n v="5"/></r><r><x v="2"/><e v="#N/A"/></r><r><x v="1"/><s v="a &amp; b"/></r></pivotCacheRecords>'
    parts["xl/worksheets/sheet1.xml"] = f"<worksheet {S}><sheetData/></worksheet>"
    parts["xl/worksheets/_rels/sheet1.xml.rels"] = f'<Relationships><Relationship Id="t" Type="{rel}/pivotTable" Target="../pivotTables/t.xml"/></Relationships>'
    parts["xl/pivotTables/t.xml"] = f'<pivotTableDefinition {S} name="PT" cacheId="7"><location ref="A3:B9"/></pivotTableDefinition>'
    path = str(tmp_path / "t.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    assert [tuple(r)[1:] for r in pivots.tables(spark, path).collect()] == [("S", "PT", "A3:B9", 7)]
    told = pivots.tables(spark, path).select("file", "cache_id", "location").join(pivots.records(spark, path), ["file", "cache_id"]).orderBy("record", "field").collect()
    assert [(r["location"], r["name"], r["kind"], r["value"]) for r in told] == [("A3:B9", "f", "text", "u"), ("A3:B9", "g", "number", "5"), ("A3:B9", "f", "blank", None), ("A3:B9", "g", "error", "#N/A"), ("A3:B9", "f", "number", "2"), ("A3:B9", "g", "text", "a & b")]


def test_elements_in_pieces():
    data = f"<root {S}><ref/><r a='1'/><r><rx/></r><r/></root>".encode()
    for size in (1, 12, 1 << 20):
        found = list(scan.element_pieces(io.BytesIO(data), b"root", b"r", size))
        assert sum(len([x for x in scan.parse(d) if x.tag.endswith("}r")]) for _, d in found) == 3 and [n for n, _ in found] == sorted(n for n, _ in found)


def test_filters_of_items(spark):
    rng = random.Random(3)
    rows = [(f"{rng.choice(['North', 'south', 'East'])} {i}", rng.randint(0, 30), datetime.date(2024, 1, 1) + datetime.timedelta(days=i * 3)) for i in range(120)]
    items = spark.createDataFrame(rows, "item string, n int, day date").repartition(3)
    of = lambda *args, **more: sorted(r["item"] for r in pivot.filtered(items, *args, **more).collect())

    def until(descending, target):
        out, total = [], 0
        for item, n, _ in sorted(rows, key=lambda r: (-r[1] if descending else r[1], r[0])):
            if total >= target:
                break
            out.append(item)
            total += n
        return sorted(out)

    whole = sum(n for _, n, _ in rows)
    assert of("count", "item", "n", 7) == sorted(x[0] for x in sorted(rows, key=lambda r: (-r[1], r[0]))[:7]) and of("percent", "item", "n", 40) == until(True, whole * 0.4) and of("sum", "item", "n", 55, bottom=True) == until(False, 55)
    assert of("captionBeginsWith", "item", None, "NORTH") == sorted(i for i, *_ in rows if i.startswith("North")) and of("captionBetween", "item", None, "east 2", "north 5") == sorted(i for i, *_ in rows if "east 2" <= i.lower() <= "north 5")
    assert of("valueGreaterThanOrEqual", "item", "n", 25) == sorted(i for i, n, _ in rows if n >= 25) and of("dateNewerThan", "day", None, "2024-11-01") == sorted(i for i, _, d in rows if d > datetime.date(2024, 11, 1))
    assert of("Q2", "day") == sorted(i for i, _, d in rows if 4 <= d.month <= 6) and of("thisMonth", "day", as_of="2024-02-10") == sorted(i for i, _, d in rows if (d.year, d.month) == (2024, 2))
    with pytest.raises(ValueError, match="isn't"):
        of("captionWhatever", "item", None, "x")
    by_hand = [r["item"] for r in pivot.arranged(items, "item", manual=[rows[5][0], rows[2][0]]).orderBy("place").collect()]
    assert by_hand == [rows[5][0], rows[2][0], *sorted(i for i, *_ in rows if i not in (rows[5][0], rows[2][0]))]


def test_rules_of_data_fields_and_shares(spark):
    formats = spark.createDataFrame([(2, 0, "a"), (2, 0, "a"), (1, 0, "b"), (3, 1, "c")], "priority int, field int, area string")
    fields = spark.createDataFrame([(0, "Sum"), (1, "Count"), (2, "None")], "field int, name string")
    assert {r["name"]: list(r["priorities"]) for r in pivot.rules_by_priority(formats, fields).collect()} == {"Sum": [1, 2], "Count": [3], "None": []}
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 4.0)], "r string, c string, v double")
    assert sorted(r["shown"] for r in pivot.shown_as(df, "v", "percentOfTotal", "r").collect()) == [0.125, 0.375, 0.5]
    assert {(r["r"], r["c"]): r["shown"] for r in pivot.shown_as(df, "v", "index", "r", "c").collect()} == {("a", "x"): 8 / 20, ("a", "y"): 24 / 12, ("b", "x"): 32 / 20}
