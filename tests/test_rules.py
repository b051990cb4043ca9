"""Conditional formats and validations over ranges against evaluating each rule on each of its cells."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridloom.operators import rules
from gridloom.sources import workbook

TYPES = ["cellIs", "containsText", "notContainsText", "beginsWith", "endsWith", "containsBlanks", "notContainsBlanks", "containsErrors", "notContainsErrors", "duplicateValues", "uniqueValues", "aboveAverage", "top10", "timePeriod", "colorScale", "expression"]
OPERATORS = ["equal", "notEqual", "greaterThan", "greaterThanOrEqual", "lessThan", "lessThanOrEqual", "between", "notBetween"]
PERIODS = ["today", "yesterday", "tomorrow", "last7Days", "thisMonth", "lastMonth", "nextMonth", "thisWeek", "lastWeek", "nextWeek"]
TODAY = datetime.date(2024, 3, 1)
RULE = ", ".join(f"{c} {t}" for c, t in rules.RULE.items())


def cells_of(seed):
    rng, out = random.Random(seed), {}
    for s in "xy":
        for r in range(1, 150):
            for c in range(1, 4):
                kind = rng.choice(["number", "number", "text", "date", "error", "bool", None])
                day = (TODAY + datetime.timedelta(days=rng.randint(-50, 50)) - datetime.date(1899, 12, 30)).days
                value = {"number": str(rng.choice([1, 2.5, -3, rng.randint(0, 40)])), "text": rng.choice(["Abc", "abcd", "xab", " ", "", "b"]), "date": str(day + rng.choice([0, 0.5])), "error": "#N/A", "bool": "TRUE", None: None}[kind]
                if rng.random() < 0.8:
                    out[s, r, c] = (kind, value)
    return out


def rules_of(seed, n=60):
    rng, out = random.Random(seed), []
    for i in range(1, n):
        kind = TYPES[i % len(TYPES)]
        rects = [(a, b, a + rng.randint(0, 80), b + rng.randint(0, 2)) for a, b in ((rng.randint(1, 140), rng.randint(1, 3)) for _ in range(rng.randint(1, 3)))]
        ranges = " ".join(f"{'ABCDEF'[b - 1]}{a}:{'ABCDEF'[d - 1]}{c}" for a, b, c, d in rects)
        first, second = rng.choice([("3", "10"), ("10", "=3"), ('"abc"', '"B"'), ("SUM(A1)", "2"), ("2", "A1"), ("TRUE", "1")])
        out.append({"sheet": rng.choice("xy"), "ranges": ranges, "type": kind, "operator": rng.choice(OPERATORS), "priority": i, "formulas": [first, second], "style": i % 5 or None, "stop": rng.choice([None, False, True]) if i % 7 == 0 else None,
                    "text": rng.choice(["ab", "B", "xa"]), "rank": rng.choice([1, 3, 10, 50]), "percent": rng.choice([None, True]), "bottom": rng.choice([None, True]), "above": rng.choice([None, True, False]), "equal_average": rng.choice([None, True]),
                    "deviations": rng.choice([None, 1]), "period": PERIODS[i % 10], "rects": rects})
    return out


def constant(text):
    text = text.removeprefix("=")
    return text[1:-1].lower() if text.startswith('"') else 1.0 if text == "TRUE" else float(text) if text.replace(".", "").isdigit() else None


def holds(rule, kind, value, own):
    number = float(value) if kind in ("number", "date") and value is not None else None
    numbers = [float(v) for k, v in own if k in ("number", "date") and v is not None]
    text, needle, t = (value or "").lower(), rule["text"].lower(), rule["type"]
    if t == "cellIs":
        a, b = map(constant, rule["formulas"])
        if a is None or rule["operator"] in ("between", "notBetween") and b is None:
            return None
        x = (value.lower() if kind == "text" and value is not None else None) if isinstance(a, str) else number
        if rule["operator"] in ("between", "notBetween"):
            inside = x is not None and type(a) is type(b) and min(a, b) <= x <= max(a, b)
            return inside == (rule["operator"] == "between")
        if rule["operator"] == "notEqual":
            return x != a
        return x is not None and {"equal": x == a, "greaterThan": x > a, "greaterThanOrEqual": x >= a, "lessThan": x < a, "lessThanOrEqual": x <= a}[rule["operator"]]
    if t in ("duplicateValues", "uniqueValues"):
        n = sum((v or "").lower() == text for _, v in own)
        return bool(text) and ((n > 1) if t == "duplicateValues" else n == 1)
    if t == "aboveAverage":
        if number is None:
            return False
        up = rule["above"] is not False
        edge = statistics.fmean(numbers) + (1 if up else -1) * (rule["deviations"] or 0) * statistics.pstdev(numbers)
        return bool(rule["equal_average"] and abs(number - edge) < 1e-9) or ((number - edge > 1e-9) if up else (edge - number > 1e-9))
    if t == "top10":
        if number is None:
            return False
        n = max(1, len(numbers) * rule["rank"] // 100) if rule["percent"] else rule["rank"]
        edge = sorted(numbers, reverse=not rule["bottom"])[: n][-1]
        return number <= edge if rule["bottom"] else number >= edge
    if t == "timePeriod":
        if kind != "date":
            return False
        day = datetime.date(1899, 12, 30) + datetime.timedelta(days=int(number))
        week = lambda d: d - datetime.timedelta(days=(d.weekday() + 1) % 7)
        gap, months = (day - TODAY).days, (day.year - TODAY.year) * 12 + day.month - TODAY.month
        weeks = (week(day) - week(TODAY)).days // 7
        return {"today": gap == 0, "yesterday": gap == -1, "tomorrow": gap == 1, "last7Days": -6 <= gap <= 0, "thisMonth": months == 0, "lastMonth": months == -1, "nextMonth": months == 1, "thisWeek": weeks == 0, "lastWeek": weeks == -1, "nextWeek": weeks == 1}[rule["period"]]
    return {
        "containsText": needle in text, "notContainsText": needle not in text, "beginsWith": text.startswith(needle), "endsWith": text.endswith(needle), "containsBlanks": not text.strip(), "notContainsBlanks": bool(text.strip()),
        "containsErrors": None if kind is None else kind == "error", "notContainsErrors": None if kind is None else kind != "error", "colorScale": number is not None, "expression": None,
    }[t]


def inside(rects, r, c):
    return any(a <= r <= x and b <= c <= y for a, b, x, y in rects)


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_evaluating_each_cell(spark, seed):
    cells, given = cells_of(seed), rules_of(seed)
    table = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "sheet string, row int, col int, kind string, value string").repartition(3)
    specs = spark.createDataFrame([tuple(g[c] for c in rules.RULE) for g in given], RULE)
    found = rules.hits(table, specs, TODAY.isoformat()).persist()
    got = {(r["sheet"], r["row"], r["col"], r["priority"]): r["hit"] for r in found.collect()}
    want = {}
    for g in given:
        own = {k: v for k, v in cells.items() if k[0] == g["sheet"] and inside(g["rects"], *k[1:])}
        for k, (kind, value) in own.items():
            want[*k, g["priority"]] = holds(g, kind, value, list(own.values()))
    assert got == want and {g["type"] for g in given if any(want[k] for k in want if k[3] == g["priority"])} >= set(TYPES) - {"expression"}
    texts = spark.createDataFrame([(i, f"font(b) {i}") for i in range(1, 5)], "id int, text string")
    won = {(r["sheet"], r["row"], r["col"]): (r["priority"], r["style"], list(r["applied"]), r["style_text"]) for r in rules.winners(found, specs, texts).collect()}
    by = {g["priority"]: g for g in given}
    expected = {}
    for *k, p in sorted(k for k, hit in want.items() if hit):
        applied = expected.setdefault(tuple(k), [])
        if not any(by[q]["stop"] for q in applied):
            applied.append(p)
    assert won == {k: (a[0], by[a[0]]["style"], a, by[a[0]]["style"] and f"font(b) {by[a[0]]['style']}") for k, a in expected.items()}
    found.unpersist()


def test_pairs_of_cells_and_rules_cross_no_exchange(spark):
    rows = [("S", r, c, "number", str(r)) for r in range(1, 200) for c in (1, 2)]
    table = spark.createDataFrame([*rows, *rows[:9]], "sheet string, row int, col int, kind string, value string")
    given = spark.createDataFrame([("S", "A1:A100 A50:B150 A50:B150", 1), ("S", "B:B", 2)], "sheet string, ranges string, priority int")
    found = rules.held(table, given, ["priority"])
    want = [(*x, p) for x in rows for p, holds in ((1, x[1] <= 100 and x[2] == 1 or 50 <= x[1] <= 150), (2, x[2] == 2)) if holds]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    told = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in told.splitlines()[1] and "strategy=merge" in told  # nothing but a projection stands above the join


def test_validations(spark):
    cells = [("S", 1, 1, "number", "5"), ("S", 2, 1, "number", "5.5"), ("S", 3, 1, "text", "abc"), ("S", 4, 1, None, None), ("S", 5, 1, "text", "b"), ("S", 6, 1, "date", "45000"), ("My S", 1, 2, "text", "b"), ("My S", 2, 2, "number", "5")]
    table = spark.createDataFrame(cells, "sheet string, row int, col int, kind string, value string")
    spec = [("whole", "between", "9", "1", True), ("decimal", "greaterThan", "5", None, False), ("textLength", "lessThanOrEqual", "2", None, True), ("list", None, '"abc, 5"', None, False), ("list", None, "='My S'!$B$1:$B$2", None, False), ("date", "between", "44000", "45000", True), ("custom", None, "A1>1", None, True), ("decimal", "equal", "A1", None, True)]
    given = spark.createDataFrame([(i, "S", "A1:A6 A1:A2", *x) for i, x in enumerate(spec)], "validation int, sheet string, ranges string, type string, operator string, formula1 string, formula2 string, allow_blank boolean")
    got = {(r["validation"], r["row"]): r["valid"] for r in rules.validated(table, given).collect()}
    want = [
        [True, False, False, True, False, False], [False, True, False, False, False, True], [True, False, False, True, True, False], [True, False, True, False, False, False],
        [True, False, False, False, True, False], [False, False, False, True, False, True], [None, None, None, True, None, None], [None, None, False, True, False, None],
    ]
    assert [[got[v, r] for r in range(1, 7)] for v in (0, 1, 2, 3, 4, 5, 6)] == want[:7] and len(got) == 48
    assert [got[7, r] for r in (1, 2, 4)] == [None, None, True]


def test_rules_of_workbooks_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("S", 1, 1, "number", "5")], "sheet string, row int, col int, kind string, value string")
    none = spark.createDataFrame([], RULE)
    assert rules.hits(df, none, "2024-01-01").count() == 0 and rules.winners(rules.hits(df.limit(0), none, "2024-01-01"), none).count() == 0
    one = spark.createDataFrame([("S", "A1:B2", "top10", 1, 3, True)], "sheet string, ranges string, type string, priority int, rank int, stop boolean").withColumn("formulas", F.lit(None).cast("array<string>"))
    path = str(tmp_path / "r.xlsx")
    workbook.save(df, path, cond_formats=one)
    back = workbook.relation(spark, path, "rules").drop("file")
    assert [(r["type"], r["rank"], r["stop"], r["ranges"]) for r in back.collect()] == [("top10", 3, True, "A1:B2")]
    assert [tuple(r) for r in rules.winners(rules.hits(workbook.cells(spark, path), back, "2024-01-01"), back).collect()] == [("S", 1, 1, 1, None, [1])]
