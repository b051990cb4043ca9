"""Formula sections of random sheets read back, and lines as they must look."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import formula
from gridloom.operators import formulas
from gridloom.sources import workbook

SCHEMA = "sheet string, row int, col int, formula string, formula_kind string, formula_ref string"


def test_templates_render_back():
    rng = random.Random(2)
    parts = ["A1", "$B2", "C$3", "$D$4", "XFD1048576", "'a!b'!A1", '"A1"', "LOG10(A1)", "A1.B2", "Table1[A1]", "+", "(", "é", "a1", "$AAAA1", "1:1", "A:A", "_A1", "A0", "A01"]
    for _ in range(5_000):
        text, row, col = "=" + "".join(rng.choice(parts) for _ in range(rng.randint(1, 5))), rng.randint(1, 9), rng.randint(1, 9)
        found = formula.template(text, row, col)
        assert found is None or formula.rendered(found, row, col) == text
        if found is not None and (there := formula.rendered(found, row + 3, col + 2)) is not None and formula.fill(text, 3, 2) is not None:
            assert formula.fill(text, 3, 2) == there
    assert formula.template("no", 1, 1) is None and formula.template("=1\n", 1, 1) is None and formula.template("=\x01c0r0\x02", 1, 1) is None
    assert formula.rendered(formula.template("=A1", 5, 5), 1, 1) is None


def random_sheet(seed, n=400):
    rng, cells = random.Random(seed), {}
    shapes = [lambda r, c: f"=A{r}+{'BCD'[c % 3]}$1", lambda r, c: f"=SUM($A{r}:B{r + 1})", lambda r, c: "=SUM(A:A)", lambda r, c: f"=1:1+A{r}", lambda r, c: f"=T[x]+B{r}", lambda r, c: f'="q""A1"&C{r}', lambda r, c: f"=a{r}", lambda r, c: f"=X{r}*{rng.randint(0, 99)}", lambda r, c: "=1\r\n+2", lambda r, c: "text", lambda r, c: "="]
    for _ in range(n):
        shape, r0, c0, h, w, step = rng.choice(shapes), rng.randint(1, 90), rng.randint(1, 12), rng.randint(1, 9), rng.randint(1, 3), rng.choice([1, 1, 2, 5])
        cells |= {(r, c): (shape(r, c), "normal", None) for r in range(r0, r0 + h * step, step) for c in range(c0, c0 + w)}
    cells[200, 1], cells[201, 2], cells[202, 3] = ('=A1:A3*"]"', "array", "A200:A202"), ("ref=B2:C3 dt2D=1 r1=A1", "dataTable", None), ("=1\n", "array", "C202")
    return [(s, r, c, *v) for s in ("one", "two") for (r, c), v in cells.items()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sections_read_back(spark, seed):
    rows = random_sheet(seed)
    lines = formulas.lines(spark.createDataFrame(rows, SCHEMA).repartition(4)).cache()
    assert sorted(map(tuple, formulas.decoded(lines.select("sheet", "line")).collect()), key=str) == sorted(rows, key=str)
    assert lines.count() < 0.8 * len(rows) and lines.groupBy("sheet", "first_row", "first_col").count().where("count > 1").isEmpty()
    lines.unpersist()


def test_lines(spark):
    rows = [("s", r, c, f"={'AB'[c - 3]}{r}*2", None, None) for r in range(2, 5) for c in (3, 4)] + [("s", 9, 1, "=1\n2", "normal", None), ("s", 9, 2, "=A1", "array", None)]
    got = formulas.lines(spark.createDataFrame(rows, SCHEMA)).orderBy("first_row", "first_col").select("line").collect()
    assert [r[0] for r in got] == ["C2:D4=A2*2", 'A9~"=1\\n2"', "B9[array]=A1"]
    assert formulas.lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bad_lines():
    assert formulas.parsed('A1[array "a]" B1]=2') == ([(1, 1, 1, 1, 1)], "array", '"a]" B1', "=2")
    for line in ("=A1", "A1[what]=1", "A1[array"):
        with pytest.raises(ValueError):
            formulas.parsed(line)


def test_data_tables_and_arrays_of_workbooks(spark, tmp_path):
    rows = [("S", 1, 1, "number", "3", "ref=A1:B2 dt2D=1 dtr=1 r1=C1", "dataTable", None), ("S", 3, 1, "number", "4", "=A1*2", "array", "A3:A4")]
    df = spark.createDataFrame(rows, "sheet string, row int, col int, kind string, value string, formula string, formula_kind string, formula_ref string")
    path = str(tmp_path / "f.xlsx")
    workbook.save(df, path)
    got = workbook.cells(spark, path).orderBy("row").select("row", "value", "formula", "formula_kind", F.coalesce("formula_ref", F.lit("-"))).collect()
    assert [tuple(r) for r in got] == [(1, "3", "ref=A1:B2 dt2D=1 dtr=1 r1=C1", "dataTable", "A1:B2"), (3, "4", "=A1*2", "array", "A3:A4")]
