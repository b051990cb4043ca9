"""Costs, the choice of blocks and the hybrid form against a plain model, and round trips of random sheets in every encoding."""

import random

import pytest

from gridloom.functions import coords
from gridloom.operators import cover, dimensions, document


def tokens_of(text):
    """The estimate for texts of letters, digits and single signs, whose spaces stand before letters."""
    out, at, text = 0, 0, text.replace(" ", "\0")
    while at < len(text):
        if text[at] == "\0":
            at += 1
            continue
        kind = 6 if text[at].isalpha() else 3 if text[at].isdigit() else 0
        end = at
        while kind and end < len(text) and (text[end].isalpha() if kind == 6 else text[end].isdigit()):
            end += 1
        out, at = (out + -(-(end - at) // kind), end) if kind else (out + 1, at + 1)
    return out


def spans_of(cells):
    """(token, r0, c0, r1, c1, step, n) of a sheet: runs, rectangles, greedy progressions of three or more."""
    runs = []
    for (r, c), t in sorted(cells.items()):
        if runs and runs[-1][:2] == [t, r] and runs[-1][3] == c - 1:
            runs[-1][3] = c
        else:
            runs.append([t, r, c, c])
    groups = {}
    for t, r, c0, c1 in runs:
        groups.setdefault((t, c0, c1), []).append(r)
    out = []
    for (t, c0, c1), rows in groups.items():
        rects = []
        for r in rows:
            if rects and rects[-1][1] == r - 1:
                rects[-1][1] = r
            else:
                rects.append([r, r])
        out += [(t, a, c0, b, c1, 1, b - a + 1) for a, b in rects if a < b]
        ones, i = [a for a, b in rects if a == b], 0
        while i < len(ones):
            j = i
            while j + 2 < len(ones) and ones[j + 2] - ones[j + 1] == ones[i + 1] - ones[i]:
                j += 1
            if j > i and ones[i + 1] - ones[i] > 1:
                out.append((t, ones[i], c0, ones[j + 1], c1, ones[i + 1] - ones[i], j + 2 - i))
                i = j + 2
            else:
                out.append((t, ones[i], c0, ones[i], c1, 1, 1))
                i += 1
    return out


def span_text(s):
    one = lambda r, c: f"{coords.letters(c)}{r}"
    text = one(s[1], s[2]) + ("" if s[1:3] == s[3:5] else ":" + one(s[3], s[4]))
    return text + (f"/{s[5]}" if s[5] > 1 else "")


def model(cells, anchor=10):
    grid, last, above = 0, None, {}
    for row in sorted({r for r, _ in cells}):
        line = {c: t for (r, c), t in cells.items() if r == row}
        labelled = last is None or row != last + 1 or row % anchor == 0
        fields = [(c, "^" if not labelled and tokens_of(t) > 1 and above.get(c) == t else t) for c, t in sorted(line.items())]
        grid += 1 + (tokens_of(str(row)) + 1 if labelled else 0)
        i, before = 0, None
        while i < len(fields):
            j = i
            while j < len(fields) and fields[j] == (fields[i][0] + j - i, fields[i][1]):
                j += 1
            n, c = j - i, 1 if fields[i][1] == "^" else tokens_of(fields[i][1])
            gap = 0 if before is None else fields[i][0] - before - 1
            grid += (3 if gap >= 4 else -(-gap // 4)) + (2 if n >= 3 else n * (c + 1))
            before, i = fields[j - 1][0], j
        last, above = row, line
    spans = spans_of(cells)
    index = sum(tokens_of(span_text(s)) + 1 for s in spans) + sum(tokens_of(t) + 1 for t in {s[0] for s in spans})
    chosen, gain = [], 0
    for s in spans:
        n, w, c = s[6], s[4] - s[2] + 1, tokens_of(s[0])
        if n < 3:
            continue
        per_row = lambda x, w=w: x + 3 if w >= 3 else w * (x + 1)
        full = min(1 + n // anchor, n) if s[5] == 1 and c > 1 else n
        in_grid, as_block = full * per_row(c) + (n - full) * per_row(1), tokens_of(span_text(s)) + c + 2
        if in_grid > as_block + 2:
            chosen.append(s)
            gain += in_grid - as_block
    return grid, index, max(0, grid - gain) if chosen else None, sorted(chosen)


def random_cells(seed):
    rng, cells = random.Random(seed), {}
    for _ in range(rng.randint(5, 40)):
        token, r0, c0 = rng.choice(["x", "1", "USD", "longer word-1", "EU-1234567", "2024"]), rng.randint(1, 60), rng.randint(1, 12)
        h, w, step = rng.choice([1, 2, 3, 12, 30]), rng.choice([1, 1, 2, 4]), rng.choice([1, 1, 2, 7])
        cells |= {(r, c): token for r in range(r0, r0 + h * step, step) for c in range(c0, c0 + w)}
    return cells


SHEETS = {f"s{i}": random_cells(i) for i in range(12)} | {
    "same": {(r, c): "same" for r in range(1, 60) for c in (1, 2, 3)} | {(r, 4): str(r * 15) for r in range(1, 60)} | {(r, 5): f"t{r}" for r in range(1, 60) if r % 7},
    "one": {(7, 3): "x"}, "all": {(r, c): "EU-12" for r in range(1, 40) for c in range(1, 5)},
}


@pytest.fixture(scope="module")
def sheets(spark):
    rows = [(s, r, c, t) for s, cells in SHEETS.items() for (r, c), t in cells.items()]
    return spark.createDataFrame(rows, "sheet string, row int, col int, token string").repartition(4).persist()


def test_spans_and_blocks_equal_the_model(sheets):
    spans = cover.strides(cover.rectangles(sheets)).persist()
    columns = ["token", "r0", "c0", "r1", "c1", "step", "n"]
    got, chosen = {}, {}
    for r in spans.collect():
        got.setdefault(r["sheet"], []).append(tuple(r[c] for c in columns))
    for r in cover.block_gains(spans).collect():
        chosen.setdefault(r["sheet"], []).append(tuple(r[c] for c in columns))
    for name, cells in SHEETS.items():
        assert sorted(got[name]) == sorted(spans_of(cells)), name
        assert sorted(chosen.get(name, [])) == model(cells)[3], name
    left = {(r["sheet"], r["row"], r["col"]): r["token"] for r in cover.residual(sheets, cover.block_gains(spans)).collect()}
    covered = {(s, r, c) for s, cells in SHEETS.items() for x in model(cells)[3] for r in range(x[1], x[3] + 1, x[5]) for c in range(x[2], x[4] + 1)}
    assert left == {(s, r, c): t for s, cells in SHEETS.items() for (r, c), t in cells.items() if (s, r, c) not in covered}


def test_costs_equal_the_model(sheets):
    found = {r["sheet"]: r for r in cover.costs(sheets).collect()}
    for name, cells in SHEETS.items():
        grid, index, hybrid, chosen = model(cells)
        choice = "index" if index < 0.85 * grid and (hybrid is None or index < hybrid) else "hybrid" if hybrid is not None and hybrid < 0.92 * grid else "grid"
        r = found[name]
        assert (r["grid"], r["index"], r["hybrid"], r["blocks"], r["encoding"]) == (grid, index, hybrid, len(chosen), choice), name
    assert {r["encoding"] for r in found.values()} == {"grid", "index", "hybrid"}


@pytest.mark.parametrize("encoding", ["grid", "index", "hybrid", "auto"])
def test_documents_read_back(sheets, encoding):
    lines = document.encoded(sheets, encoding).persist()
    got = sorted(map(tuple, document.decoded(lines).select("sheet", "row", "col", "token").collect()))
    assert got == sorted((s, r, c, t) for s, cells in SHEETS.items() for (r, c), t in cells.items())
    if encoding == "hybrid":
        told = {r["sheet"]: r["text"] for r in lines.where("part = 'grid'").orderBy("line_no", ascending=False).collect()}
        assert all(t[:1].isdigit() and ":" in t for t in told.values())  # the first grid line has its number
        assert lines.where("sheet = 'all' and part = 'grid'").isEmpty() and [r["text"] for r in lines.where("sheet = 'all' and part = 'block'").collect()] == ["A1:D39=EU-12"]
    lines.unpersist()


def test_unknown_encoding(sheets):
    with pytest.raises(ValueError, match="isn't an encoding"):
        document.encoded(sheets, "xml")


def test_cells_outside_of_spans(spark, sheets):
    rng = random.Random(9)
    spans = [(f"s{rng.randint(0, 11)}", a, b, a + rng.randint(0, 30), b + rng.choice([0, 2, 600]), rng.randint(1, 5)) for a, b in ((rng.randint(1, 60), rng.randint(1, 14)) for _ in range(80))]
    got = dimensions.outside_strides(sheets, spark.createDataFrame(spans, "sheet string, r0 int, c0 int, r1 int, c1 int, step int"))
    covered = lambda s, r, c: any(x[0] == s and x[1] <= r <= x[3] and (r - x[1]) % x[5] == 0 and x[2] <= c <= x[4] for x in spans)
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted((s, r, c) for s, cells in SHEETS.items() for r, c in cells if not covered(s, r, c))
