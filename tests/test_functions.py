"""Addresses, dates, tokens and formulas, each against values known to be right or a plain model."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import coords, dates, formula, tokens
from gridloom.operators import cells, cover, document, filters


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


V = F.col("v")


def test_addresses(spark):
    assert column(spark, [1, 26, 27, 702, 703, 18278, 0, 18279], "int", coords.column_letters(V)) == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", None, None]
    assert column(spark, ["a", "zz", "XFD", "A1", "", None], "string", coords.column_index(V)) == [1, 702, 16384, None, None, None]
    assert column(spark, ["A1", "$b$12", "A0", "1A", None], "string", coords.split_coordinate(V)) == [(1, 1), (12, 2), None, None, None]
    assert column(spark, ["B2:C5", "A:C", "2:5", "D4", "x y"], "string", coords.range_bounds(V)) == [(2, 2, 5, 3), (None, 1, None, 3), (2, None, 5, None), (4, 4, 4, 4), None]
    assert column(spark, ["it's"], "string", coords.quote_sheet(V)) == ["'it''s'"]
    assert coords.bounds("A:C") == (1, 1, coords.MAX_ROW, 3) and coords.bounds("C3:A1") == (1, 1, 3, 3) and [coords.letters(coords.index(x)) for x in ("A", "AZ", "XFD")] == ["A", "AZ", "XFD"]
    with pytest.raises(ValueError, match="isn't a range"):
        coords.bounds("A1:")


def test_serials(spark):
    ts = lambda *a: datetime.datetime(*a)
    assert column(spark, [1.0, 59.0, 60.0, 61.0, 43831.5, 2.25], "double", dates.from_serial(V)) == [ts(1900, 1, 1), ts(1900, 2, 28), ts(1900, 2, 28), ts(1900, 3, 1), ts(2020, 1, 1, 12), ts(1900, 1, 2, 6)]
    assert column(spark, [0.0, 1.5], "double", dates.from_serial(V, True)) == [ts(1904, 1, 1), ts(1904, 1, 2, 12)]
    assert column(spark, [ts(1900, 1, 1), ts(1900, 2, 28), ts(1900, 3, 1), ts(2020, 1, 1, 12)], "timestamp_ntz", dates.to_serial(V)) == [1.0, 59.0, 61.0, 43831.5]
    got = column(spark, ["2024-01-02", "2024-01-02T03:04:05.5", "10:30", "PT1H2M3.25S", "x", "PT"], "string", dates.parse_iso(V))
    assert [g and g["kind"] for g in got] == ["date", "datetime", "time", "duration", None, None] and got[3]["us"] == 3_723_250_000 and got[2]["us"] == 37_800_000_000
    assert column(spark, ["General", "yyyy-mm-dd", "[h]:mm:ss", "0.00", '"d"0', "[Red]0", None], "string", dates.is_date_format(V)) == [False, True, True, False, False, False, False]
    assert column(spark, ["[h]:mm", "hh:mm"], "string", dates.is_duration_format(V)) == [True, False]


def test_tokens(spark):
    texts = ["a", "", " a", "12", "1.5e3", "TRUE", "a|b", "=x", "#N/A", "x*3", "AB=1", "2024-01-02", "10:00:00", 'say "hi"', '"q', "tab\t", "^", "é", "1-URGENT"]
    want = ["a", '""', '" a"', '"12"', '"1.5e3"', '"TRUE"', '"a|b"', '"=x"', '"#N/A"', '"x*3"', '"AB=1"', '"2024-01-02"', '"10:00:00"', 'say "hi"', '"\\"q"', '"tab\\t"', '"^"', "é", "1-URGENT"]
    assert column(spark, texts, "string", tokens.text_token(V)) == want
    assert [tokens.float_text(x) for x in (1.0, -0.0, 1e16, 1e-5, 1.5e300, float("nan"), float("-inf"), 0.1)] == ["1.0", "-0.0", "1.0e+16", "1.0e-05", "1.5e+300", "@float:nan", "@float:-inf", "0.1"]
    assert column(spark, ["#N/A", "#x y", "bad"], "string", tokens.error_token(V)) == ["#N/A", '@err:"#x y"', '@err:"bad"']
    assert column(spark, [3_723_250_000, -1_000_000], "bigint", tokens.duration_token(V)) == ["@td:1:02:03.250000", "@td:-0:00:01"]
    assert column(spark, ['"1"', "1", "TRUE", "#REF!", "2024-01-02 00:00:00", "@date:2024-01-01", "abc", "@float:inf"], "string", tokens.token_kind(V)) == ["text", "number", "bool", "error", "date", "date", "text", "number"]
    assert column(spark, ["", "hello", "internationalization", "1234", "a b", "a  b", "---", "日本"], "string", tokens.token_cost(V)) == [0, 1, 4, 2, 2, 3, 1, 2]


def test_formula_tokens_keep_the_text():
    for f in ("=SUM(A1:B2,-3)*\"x\"\"y\"+Sheet1!$A$1%", "={1,2;3,4}", "='a b'!C3 & [1]Sheet!A1", "=IF(A1>=2,TRUE,#N/A)", "=-A1^2", "=T[[#All],[x]]+1.5E+3"):
        assert "=" + "".join(t[0] for t in formula.tokenize(f)) == f
    assert formula.tokenize("text") == [("text", "LITERAL", "")]
    assert [t[1:] for t in formula.tokenize("=-F(1;2)%")] == [("OPERATOR-PREFIX", ""), ("FUNC", "OPEN"), ("OPERAND", "NUMBER"), ("SEP", "ROW"), ("OPERAND", "NUMBER"), ("FUNC", "CLOSE"), ("OPERATOR-POSTFIX", "")]


def test_formula_shifts():
    assert formula.translate('=A1+$B2+C:C+1:1+Sheet2!a5&"A1"', 2, 1) == '=B3+$B4+D:D+3:3+Sheet2!B7&"A1"'
    assert formula.translate("=A1", -1, 0) == "=#REF!" and formula.translate("=LOG10(A1)", 1, 0) == "=LOG10(A2)"
    assert formula.fill("=A1+$B$2+SUM(A:A)+a1+LOG10(3)", 1, 1) == "=B2+$B$2+SUM(A:A)+a1+LOG10(3)" and formula.fill("=A1", 0, -1) is None
    assert formula.fill_flags("=SUM(A:A)") == (True, False) and formula.fill_flags("=SUM(1:2)") == (False, True) and formula.fill_flags("=A1+B2") == (False, False)
    rng = random.Random(3)
    for _ in range(300):
        r, c, dr, dc = rng.randint(5, 50), rng.randint(5, 50), rng.randint(0, 40), rng.randint(0, 40)
        f = f"={coords.letters(c)}{r}*$C{r}+D$4&\"A1\""
        assert formula.canonical(f, r, c) == formula.canonical(formula.fill(f, dr, dc), r + dr, c + dc)


def brute_cover(found):
    """Rectangles of (row, col) -> token, row by row."""
    rows, done, live = {}, [], {}
    for (r, c), t in sorted(found.items()):
        runs = rows.setdefault(r, [])
        if runs and runs[-1][1] == c - 1 and runs[-1][2] == t:
            runs[-1][1] = c
        else:
            runs.append([c, c, t])
    for r in sorted(rows):
        now = {}
        for a, b, t in rows[r]:
            now[a, b, t] = live[a, b, t] if (a, b, t) in live and (r - 1) in rows else r
        done += [(k[2], r0, k[0], last, k[1]) for k, r0 in live.items() for last in [prev] if k not in now or now[k] != r0]
        live, prev = now, r
    return sorted(done + [(k[2], r0, k[0], prev, k[1]) for k, r0 in live.items()])


@pytest.mark.parametrize("seed", range(3))
def test_cover_and_documents_of_random_sheets(spark, seed):
    rng = random.Random(seed)
    found = {(r, c): rng.choice(["x", "yy", "long words here", '"quo|ted"', "7", "TRUE"]) for r in range(1, 60) for c in range(2, 12) if rng.random() < (0.9, 0.3, 0.6)[seed]}
    for r in range(20, 40):
        found[r, 3] = "same value"
    df = spark.createDataFrame([("S", r, c, "text", t) for (r, c), t in found.items()], "sheet string, row int, col int, kind string, token string")
    got = sorted((x["token"], x["r0"], x["c0"], x["r1"], x["c1"]) for x in cover.rectangles(df).collect())
    covered = [(r, c) for t, r0, c0, r1, c1 in got for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]
    assert sorted(covered) == sorted(found) and all(found[r0, c0] == t for t, r0, c0, _, _ in got)
    assert got == brute_cover(found)
    for encoding in ("grid", "index"):
        back = {(x["row"], x["col"]): x["token"] for x in document.decoded(document.encoded(df, encoding)).collect()}
        assert back == found, encoding


def test_strides(spark):
    def model(rows):
        out, i = [], 0
        while i < len(rows):
            j = i + 1
            step = rows[j] - rows[i] if j < len(rows) else 0
            while j < len(rows) and step > 1 and rows[j] - rows[j - 1] == step:
                j += 1
            if step > 1 and j - i >= 3:
                out.append((rows[i], rows[j - 1], step))
                i = j
            else:
                out.append((rows[i], rows[i], 1))
                i += 1
        return out

    rng = random.Random(5)
    for _ in range(4):
        rows = sorted(rng.sample(range(1, 60, rng.choice([1, 2])), 18))
        rows = [r for i, r in enumerate(rows) if i == 0 or r - rows[i - 1] > 1]
        df = spark.createDataFrame([("S", r, 1, "t") for r in rows], "sheet string, row int, col int, token string")
        got = sorted((x["r0"], x["r1"], x["step"]) for x in cover.strides(cover.rectangles(df)).collect())
        assert got == sorted(model(rows))


def test_strides_over_edges_of_blocks(spark):
    rng, rects, want = random.Random(3), [], []
    for k in range(60):
        rows = [rng.randint(1, 5)]
        for _ in range(rng.randint(0, 25)):
            rows.append(rows[-1] + rng.choice([1, 2, 2, 3, 4] if k % 2 else [2, 2, 2, 3]))
        rects += [("S", k or None, 1, 1, r, r) for r in rows]
        i = 0
        while i < len(rows):
            j = i + 1
            while j < len(rows) and rows[j] - rows[j - 1] == rows[i + 1] - rows[i] > 1:
                j += 1
            j = j if j - i >= 3 else i + 1
            want.append((k, rows[i], rows[j - 1], rows[i + 1] - rows[i] if j - i >= 3 else 1, j - i))
            i = j
    df = spark.createDataFrame(rects, "sheet string, token int, c0 int, c1 int, r0 int, r1 int")
    assert sorted((x["token"] or 0, *x[4:]) for x in cover.strides(df, block=7).collect()) == sorted(want)
    assert not cover.strides(df.limit(0)).collect()


def test_locked_cells_stay_alone(spark):
    df = spark.createDataFrame([("S", r, 1, "t", r in (3, 4)) for r in range(1, 7)], "sheet string, row int, col int, token string, l boolean")
    assert sorted((x["r0"], x["r1"]) for x in cover.rectangles(df, lock=F.col("l")).collect()) == [(1, 2), (3, 3), (4, 4), (5, 6)]


def test_segments():
    assert cells.segments("1:10,8:12,20") == [(1, 12), (20, 20)] and cells.segments([(5, 3), 6]) == [(3, 6)] and cells.segments("A:C,D", True) == [(1, 4)]
    assert cells.complement([(1, 12), (20, 20)], 1, 30) == [(13, 19), (21, 30)]


def test_wildcards_and_blanks(spark):
    names = ["abc", "a*c", "", None, "xbz", "a?"]
    assert column(spark, names, "string", filters.custom(V, [("equal", "a*")])) == [True, True, False, False, False, True]
    assert column(spark, names, "string", filters.custom(V, [("equal", "a~*c")])) == [False, True, False, False, False, False]
    assert column(spark, names, "string", filters.values(V, ["xbz"], blank=True)) == [False, False, True, True, True, False]
    assert column(spark, [1, 5, 12, None], "int", filters.valid(V, "whole", "notBetween", 2, 9)) == [True, False, True, True]


def test_row_numbers_over_many_partitions(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k")).repartition(9)
    assert cells.numbered(df, ["k"]).where("row != k + 1").count() == 0
