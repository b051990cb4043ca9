"""Texts as typed, names, print settings and header texts; settings of rows, dictionaries and sets of ranges."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import texts
from gridloom.operators import cells, dimensions, ranges

V = F.col("v")


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_typed_texts(spark):
    assert column(spark, ["1", "-2.5", ".5", "10e3", "01", "1,5", "", "+1", "1e", None], "string", texts.number(V)) == [1.0, -2.5, 0.5, 10000.0, None, None, None, None, None, None]
    assert column(spark, ["5%", "-1.5 %", ".5%", "%", "5", "5%%", None], "string", texts.percentage(V)) == [0.05, -0.015, 0.005, None, None, None, None]
    got = column(spark, ["23:59", "01:02:03", "24:00", "1:00", "12:3045", "59:01.5", "00:01.123456", "00:01.1x", "00:01.123456x", None], "string", texts.time_of_day(V))
    assert got == [86_340_000_000, 3_723_000_000, None, None, None, 3_541_500_000, 1_123_456, None, 1_123_456, None]


def test_names(spark):
    named = lambda names, v: column(spark, [v], "string", texts.free_name(F.array(*map(F.lit, names)), V))[0]
    assert named(["Sheet", "sheet1"], "Other") == "Other" and named(["Sheet"], "sheet") == "sheet1" and named(["Sheet", "SHEET9", "Sheetx"], "Sheet") == "Sheet10"
    assert named(["a.b", "axb7"], "a.b") == "a.b1"


def test_print_settings(spark):
    got = column(spark, ["'it''s'!$1:$2,'it''s'!$A:$C", "S!$B:$D", "S!1:1", "none", None], "string", texts.print_titles(V))
    assert [g and tuple(g) for g in got] == [("it''s", 1, 2, "A", "C"), ("S", None, None, "B", "D"), ("S", 1, 1, None, None), None, None]
    assert column(spark, ["S!$A$1:$B$2,S!$D:$E", "A1", "", None], "string", texts.print_areas(V)) == [["A1:B2", "D:E"], ["A1"], [], None]


def test_header_texts(spark):
    got = column(spark, ["&La&Cb\nc&Rd", "&Rx", "no parts", "", None], "string", texts.header_parts(V))
    assert [tuple(g) for g in got] == [("a", "b\nc", "d"), ("", "", "x"), ("", "", ""), ("", "", ""), (None, None, None)]
    got = column(spark, ['&"Arial"&12 &K00FF00x', "plain", "&8&9y"], "string", texts.header_codes(V))
    assert [tuple(g) for g in got] == [("x", "Arial", "00FF00", 12), ("plain", None, None, None), ("y", None, None, 9)]


@pytest.mark.parametrize("block", [3, 4096])
def test_stretches(spark, monkeypatch, block):
    monkeypatch.setattr(dimensions, "BLOCK", block)
    rng = random.Random(block)
    rows = {(s, r): rng.choice(["a", None, "b"]) for s in "xy" for r in range(60) if rng.random() < 0.9}
    df = spark.createDataFrame([(s, r, v) for (s, r), v in rows.items()] * 2, "sheet string, row int, v string")
    want = []
    for s in "xy":
        for (_, v), held in itertools.groupby(((r, rows[s, r]) for r in range(60) if (s, r) in rows), key=lambda x, n=itertools.count(): (x[0] - next(n), x[1])):
            held = list(held)
            want.append((s, held[0][0], held[-1][0], v))
    assert sorted(map(tuple, dimensions.stretches(df, ["v"]).collect()), key=str) == sorted(want, key=str)
    assert dimensions.stretches(df.limit(0), ["v"]).count() == 0


def test_dictionaries(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", 1), (3, "b", None), (4, None, 1), (5, "a", 1)], "id int, name string, size int")
    assert sorted(map(tuple, dimensions.dictionary(df, "name", "id").collect())) == [("a", 1), ("b", 0)]
    assert sorted((r["id"], r["canonical"]) for r in dimensions.canonical(df, "id", ["name", "size"]).collect()) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 2)]
    groups = spark.createDataFrame([(1, 1), (2, 4)], "min int, max int")
    assert [tuple(r) for r in dimensions.column_groups(groups).collect()] == [(2, 4)]


def test_range_sets(spark):
    kind = "array<struct<r0:int,c0:int,r1:int,c1:int>>"
    one = lambda *s: F.struct(*[F.lit(x).alias(n) for x, n in zip(s, ranges.SIDES, strict=True)])
    held = [(5, 2, 6, 3), (1, 1, 4, 4), (1, 2, 9, 2)]
    assert [tuple(r) for r in column(spark, [held], kind, ranges.ordered(V))[0]] == [held[1], held[2], held[0]]
    assert column(spark, [held], kind, F.size(ranges.added(V, one(2, 2, 3, 3)))) == [3] and column(spark, [held], kind, F.size(ranges.added(V, one(2, 2, 5, 5)))) == [4]
    assert column(spark, [held], kind, F.size(ranges.removed(V, one(1, 1, 4, 4)))) == [2] and column(spark, [held], kind, ranges.removed(V, one(1, 1, 4, 5))) == [None]


def test_unmerge(spark):
    merges = spark.createDataFrame([(1, 1, 2, 2), (4, 4, 5, 5)], "r0 int, c0 int, r1 int, c1 int")
    sheet = spark.createDataFrame([("s", 1, 1, "a"), ("s", 1, 2, ""), ("s", 2, 2, ""), ("s", 3, 3, "b")], "sheet string, row int, col int, token string")
    left, kept = cells.unmerged(merges, sheet, "A1:B2")
    assert [tuple(r) for r in left.collect()] == [(4, 4, 5, 5)] and sorted((r["row"], r["col"]) for r in kept.collect()) == [(1, 1), (3, 3)]
    with pytest.raises(ValueError, match="isn't merged"):
        cells.unmerged(merges, sheet, "A1:B3")
