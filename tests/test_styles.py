"""Compact XML, pools of styles, their projection, and sections that decode to what was encoded."""

import random
from xml.etree import ElementTree as ET

import pytest

from gridloom.functions import compact
from gridloom.operators import styles
from gridloom.sources import workbook


def random_element(rng, depth=0):
    x = ET.Element(rng.choice(["font", "b", "left", "gradient-stop", f"{{{compact.SPACES['r']}}}id", "{urn:other}x"]))
    for _ in range(rng.randint(0, 3)):
        x.set(rng.choice(["val", "rgb", "a.b", f"{{{compact.SPACES['r']}}}id", "{urn:other}k"]), rng.choice(["", "1", "a b", 'q"', "(", "é", "A1:B2", "x=y", "\n", "\\"]))
    if rng.random() < 0.3:
        x.text = rng.choice(["text", ' "quoted" ', "a(b)", "1"])
    elif depth < 3:
        x.extend(random_element(rng, depth + 1) for _ in range(rng.randint(0, 3)))
    return x


def same(a, b):
    return a.tag == b.tag and a.attrib == b.attrib and (a.text or "") == (b.text or "") and len(a) == len(b) and all(map(same, a, b))


def test_compact_xml_reads_back():
    rng = random.Random(1)
    for _ in range(3_000):
        x = random_element(rng)
        line = compact.encode_items(x)
        assert same(compact.decode_items(x.tag, line), x) and "\n" not in line
    assert compact.encode_items(ET.fromstring('<font><b/><sz val="11"/><color theme="1" tint="0.5"/><name val="Times New Roman"/></font>')) == 'b sz:11 color(theme=1 tint=0.5) name:"Times New Roman"'
    for bad in ("a(b", "a)b", "=", "a(b))"):
        with pytest.raises(ValueError):
            compact.decode_items("x", bad)


def test_choices():
    assert styles.chosen(["font.b", "font.i", "fill", "fill.fgColor", "numFmt"]) == {"font": {"b", "i"}, "fill": None, "num_fmt": None}
    for bad in ("what", "fill.color", "numFmt.x"):
        with pytest.raises(ValueError, match="isn't a key"):
            styles.chosen(bad)
    assert styles.kept("fill", "patternFill(patternType=solid fgColor(rgb=FF) bgColor(rgb=00))", frozenset(["fgColor"])) == "patternFill(fgColor(rgb=FF))"
    assert styles.kept("alignment", "horizontal=center wrapText=1", frozenset(["wrapText"])) == "wrapText=1" and styles.kept("font", None, frozenset()) is None


CELLS = "sheet string, row int, col int, kind string, value string, font string, fill string, num_fmt string, alignment string, quote_prefix boolean, name string"


def styled(spark, n=120, seed=2):
    rng = random.Random(seed)
    rows = [
        ("S", r, c, "number", "1", rng.choice([None, "b sz:11 name:Calibri", "i name:Arial", styles.DEFAULT["font"]]), rng.choice([None, styles.SECOND_FILL, "patternFill(patternType=solid fgColor(rgb=FF00FF00))"]), rng.choice([None, "0.00%", '"a b" 0']),
         rng.choice([None, "horizontal=left"]), rng.choice([None, True, False]), rng.choice([None, "Good one"]))
        for r in range(1, n) for c in (1, 2)
    ]
    return rows, spark.createDataFrame(rows, CELLS).repartition(3)


def test_pools_are_dense_and_resolve(spark):
    rows, df = styled(spark)
    cells, parts, formats = styles.pooled(df)
    assert sorted(cells.columns) == sorted([*df.columns, "style"])
    found = {r["style"]: r for r in formats.collect()}
    assert sorted(found) == list(range(len(found))) and found[0]["font"] == found[0]["fill"] == found[0]["border"] == 0 and found[0]["num_fmt"] == "General"
    pool = {(r["kind"], r["id"]): r["text"] for r in parts.collect()}
    assert len(set(pool.items())) == len(pool) and len({(k, t) for (k, _), t in pool.items()}) == len(pool) and pool["fill", 1] == styles.SECOND_FILL
    for r in cells.collect():
        f = found[r["style"]]
        assert pool["font", f["font"]] == (r["font"] or styles.DEFAULT["font"]) and pool["fill", f["fill"]] == (r["fill"] or styles.DEFAULT["fill"]) and f["num_fmt"] == (r["num_fmt"] or "General") and f["alignment"] == r["alignment"]
        assert f["quote_prefix"] == bool(r["quote_prefix"]) and f["name"] == (r["name"] or "Normal")


def test_workbooks_and_sections_keep_styles(spark, tmp_path):
    rows, df = styled(spark)
    cells, parts, formats = styles.pooled(df)
    path = str(tmp_path / "s.xlsx")
    workbook.save(cells, path, styles=styles.stylesheet(parts, formats))
    told = lambda d: {r["style"]: tuple(r)[1:] for r in d.collect()}
    columns = ["style", *styles.PARTS, *styles.VALUES]
    assert told(workbook.relation(spark, path, "cell_styles").select(columns)) == told(formats.select(columns))
    assert sorted(map(tuple, workbook.relation(spark, path, "style_parts").select("kind", "id", "text").collect())) == sorted(map(tuple, parts.select("kind", "id", "text").collect()))
    formats_, parts_ = styles.decoded_table(styles.style_table(formats, parts))
    need = {(k, r[k]) for r in formats.collect() for k in styles.PARTS}
    assert told(formats_.select(columns)) == told(formats.select(columns)) and {(r["kind"], r["id"]) for r in parts_.collect()} == need
    lines = styles.style_table(formats, parts, cells.where("style = 0").select("style")).orderBy("place").select("line").collect()
    assert [r[0] for r in lines] == ["font f0: sz:11 name:Calibri", "fill p0: patternFill(patternType=none)", "border b0: left right top bottom diagonal", "s0: font=f0 fill=p0 border=b0 numFmt=General alignment protection style=Normal"]


def test_projection_writes_equal_styles_once(spark):
    rows, df = styled(spark)
    cells, parts, formats = styles.pooled(df)
    kept, pool, canonical = styles.projected(formats, parts, ["font.b", "numFmt"])
    assert kept.count() == 6 and {r["text"] for r in pool.where("kind = 'font'").collect()} == {"", "b"}
    look = {r["style"]: r["canonical"] for r in canonical.collect()}
    assert len(look) == formats.count() and all(look[c] == c <= s for s, c in look.items())


def test_unstyled_cells_and_rules_of_workbooks(spark, tmp_path):
    df = spark.createDataFrame([("S", 1, 1, "text", "x")], "sheet string, row int, col int, kind string, value string")
    cells, parts, formats = styles.pooled(df)
    assert [r["style"] for r in cells.collect()] == [0] and formats.count() == 1
    empty, parts, formats = styles.pooled(df.limit(0))
    assert empty.count() == 0 and [r["style"] for r in formats.collect()] == [0]
    rules = spark.createDataFrame([(0, "font(b color(rgb=FFFF0000))"), (1, "fill(patternFill(bgColor(rgb=FF00FF00)))")], "id int, text string")
    path = str(tmp_path / "r.xlsx")
    workbook.save(cells, path, styles=styles.stylesheet(parts, formats, rules))
    assert [tuple(r)[1:] for r in workbook.relation(spark, path, "rule_styles").orderBy("id").collect()] == [tuple(r) for r in rules.collect()]
    assert styles.style_map(cells).count() == 0
    with pytest.raises(Exception, match="bad styles line"):
        styles.decoded_table(spark.createDataFrame([("what",)], "line string"))
