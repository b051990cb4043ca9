"""Exact covers of a sheet's equal cells by runs, rectangles and strided spans, and the lines of its text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import coords, tokens
from gridloom.sources.scratch import written


BLOCK = 65536  # rows that one task joins before what touches is joined over blocks
STRIP = 1024  # rows that are dealt out together where each needs the one above


def runs(cells: DataFrame, key: str = "token") -> DataFrame:
    """(sheet, row, key, c0, c1): adjacent columns with equal keys."""
    island = F.col("col") - F.row_number().over(Window.partitionBy("sheet", "row", key).orderBy("col"))
    return cells.withColumn("_i", island).groupBy("sheet", "row", key, "_i").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("_i")


def rectangles(cells: DataFrame, key: str = "token", lock: Column | None = None) -> DataFrame:
    """(sheet, key, r0, c0, r1, c1): equal runs of consecutive rows as one rectangle; locked cells' runs stay alone.

    Runs are joined inside blocks of rows first; only rectangles that touch a block's edge meet over blocks, at most two a block, key and pair of
    columns. So no task has all runs of a common key.
    """
    if lock is not None:
        cells = cells.withColumn("_lock", F.when(lock, F.col("row")).otherwise(0))
        by = ["sheet", key, "c0", "c1", "_lock"]
        found = runs(cells.withColumn("_key", F.struct(key, "_lock")), "_key").select("sheet", "row", F.col(f"_key.{key}").alias(key), F.col("_key._lock").alias("_lock"), "c0", "c1")
    else:
        by = ["sheet", key, "c0", "c1"]
        found = runs(cells, key)
    island = F.col("row") - F.row_number().over(Window.partitionBy(*by, "_b").orderBy("row"))
    parts = found.withColumn("_b", F.floor(F.col("row") / BLOCK)).withColumn("_i", island).groupBy(*by, "_b", "_i").agg(F.min("row").alias("r0"), F.max("row").alias("r1"))
    touches = (F.col("r0") % BLOCK == 0) | (F.col("r1") % BLOCK == BLOCK - 1)
    along = Window.partitionBy(*by).orderBy("r0")
    edge = parts.where(touches).withColumn("_new", (F.col("r0") != F.coalesce(F.lag("r1").over(along), F.lit(-1)) + 1).cast("int"))
    edge = edge.withColumn("_g", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy(*by, "_g").agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"))
    names = ["sheet", key, "r0", "c0", "r1", "c1"]
    return parts.where(~touches).select(names).unionByName(joined.select(names))


def before(df: DataFrame, by: list[str], order: str, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, block: int = 65536) -> DataFrame:
    """``df`` with what its rows before in the order of ``order`` gave: the last value that isn't null of each in ``last``, the sum of each in ``total``.

    Windows run over blocks of ``order`` and then over one row a block, so that no task has all rows of a group. Groups may be null.
    """
    last, total = last or {}, total or {}
    names = {f"_v{i}": v for i, v in enumerate([*last.values(), *total.values()])}
    held = df.withColumns({"_k": F.struct(*by), "_b": F.floor(F.col(order) / block), **names})
    held = written(held, "running")
    inside = Window.partitionBy("_k", "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    kept, summed = list(names)[: len(last)], list(names)[len(last) :]
    ends = held.groupBy("_k", "_b").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in kept], *[F.sum(v).alias(v) for v in summed])
    ends = ends.select("_k", "_b", *[F.last(v, ignorenulls=True).over(over).alias("e" + v) for v in kept], *[F.coalesce(F.sum(v).over(over), F.lit(0)).alias("e" + v) for v in summed])
    own = {n: F.last(v, ignorenulls=True).over(inside) for n, v in zip(last, kept, strict=True)} | {n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in zip(total, summed, strict=True)}
    out = held.withColumns(own).join(ends.hint("merge"), ["_k", "_b"])  # groups may be as many as rows
    out = out.withColumns({n: F.coalesce(n, "e" + v) for n, v in zip(last, kept, strict=True)} | {n: F.col(n) + F.col("e" + v) for n, v in zip(total, summed, strict=True)})
    return out.select(*df.columns, *last, *total)


def strides(rects: DataFrame, key: str = "token", block: int = 65536) -> DataFrame:
    """(sheet, key, c0, c1, r0, r1, step, n): rectangles of one row, in greedy progressions of three or more with a step over 1; others alone.

    Rows with the same distance to the one before form a stretch of ``m`` such distances, and the greedy choice passes from stretch to
    stretch only whether the first row is still free. A stretch of three or more always takes its last row, one of two does so if its
    first row was free, all others leave it. So it follows from the last stretch not of two, and the number of those of two since.
    """
    by = ["sheet", key, "c0", "c1"]
    rects = written(rects, "rects")
    points = before(rects.where("r0 = r1").select(*by, F.col("r0").alias("x")), by, "x", {"prev": F.col("x")}, {"i": F.lit(1)}, block)
    points = before(points.withColumn("d", F.col("x") - F.col("prev")), by, "x", {"d_before": F.col("d")}, None, block)
    points = points.withColumn("start", F.when(~F.coalesce(F.col("d") == F.col("d_before"), F.lit(False)), F.col("x")))
    points = before(points, by, "x", {"start_before": F.col("start")}, None, block)
    stretch = F.coalesce("start", "start_before").alias("stretch")
    found = points.groupBy(*by, stretch).agg(F.min(F.coalesce("prev", "x")).alias("a"), F.max("x").alias("z"), F.count("d").cast("int").alias("m"), F.max("d").alias("d"), F.max("i").alias("i")).drop("stretch")
    two = (F.col("m") == 2) & (F.col("d") > 1)
    taken = F.when(~F.coalesce(two, F.lit(False)), F.struct(F.coalesce((F.col("m") > 2) & (F.col("d") > 1), F.lit(False)).cast("int").alias("v"), F.col("i").alias("i")))
    found = before(found, by, "z", {"told": taken}, None, block)
    # 1 if the first row is taken: as the last stretch that settles it says, turned at each stretch of two distances since
    used = F.coalesce((F.col("told.v") + (F.col("i") - F.col("m") - F.col("told.i")) / 2) % 2, F.lit(0)).cast("int")
    found = found.withColumn("o", used).withColumn("long", F.coalesce((F.col("d") > 1) & (F.col("m") - F.col("o") >= 2), F.lit(False)))
    ends = rects.where("r0 = r1").groupBy(F.struct(*by).alias("_k")).agg(F.max("r0").alias("end"))
    found = found.withColumn("_k", F.struct(*by)).join(ends.hint("merge"), "_k")
    first, span = F.col("a") + F.coalesce(F.col("d") * F.col("o"), F.lit(0)), lambda r0, r1, step, n: F.struct(r0.cast("int").alias("r0"), r1.cast("int").alias("r1"), step.cast("int").alias("step"), n.cast("int").alias("n"))
    one = F.lit(1)
    alone = F.when(F.col("m") > F.col("o"), F.transform(F.sequence(first, F.col("z") - F.col("d"), F.col("d")), lambda x: span(x, x, one, one)))
    tail = F.when(F.col("z") == F.col("end"), F.array(span(F.col("z"), F.col("z"), one, one)))
    none = F.array().cast("array<struct<r0:int,r1:int,step:int,n:int>>")
    spans = F.when(F.col("long"), F.array(span(first, F.col("z"), F.col("d"), F.col("m") - F.col("o") + 1))).otherwise(F.concat(F.coalesce(alone, none), F.coalesce(tail, none)))
    out = found.select(*by, F.explode(spans).alias("s")).select(*by, "s.r0", "s.r1", "s.step", "s.n")
    tall = rects.where("r0 < r1").select(*by, "r0", "r1", F.lit(1).alias("step"), (F.col("r1") - F.col("r0") + 1).alias("n"))
    return out.unionByName(tall)


def span_text() -> Column:
    """A6, A6:Q9 or A6:Q98/4 of a span."""
    text = coords.range_text(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"))
    return F.when(F.col("step") > 1, F.concat(text, F.lit("/"), F.col("step").cast("string"))).otherwise(text)


def index_lines(spans: DataFrame, key: str = "token") -> DataFrame:
    """The inverted index: (sheet, line, first_row, first_col), a line for each key and block of rows with its spans, to be ordered by its first cell.

    Sheets of up to ``BLOCK`` rows have one line a key; beyond, no line grows with the sheet.
    """
    each = F.struct("r0", "c0", span_text().alias("text"))
    out = spans.groupBy("sheet", key, F.floor(F.col("r0") / BLOCK)).agg(F.sort_array(F.collect_list(each)).alias("spans"))
    line = F.concat(F.array_join(F.transform("spans", lambda s: s["text"]), ","), F.lit("="), F.col(key))
    return out.select("sheet", line.alias("line"), F.col("spans")[0]["r0"].alias("first_row"), F.col("spans")[0]["c0"].alias("first_col"))


def whole_lines(spans: DataFrame, key: str = "token") -> DataFrame:
    """(sheet, key, spans): one line for each key of a sheet, whatever its rows.

    Spans become text by blocks of rows; only finished texts of blocks meet, one for each block and key. A line is one value, so it must stay below 2 GB.
    """
    each = F.struct("r0", "c0", span_text().alias("text"))
    parts = spans.groupBy("sheet", key, F.floor(F.col("r0") / BLOCK).alias("_block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda s: s["text"]), ",").alias("_text"))
    told = F.transform(F.sort_array(F.collect_list(F.struct("_block", "_text"))), lambda s: s["_text"])
    return parts.groupBy("sheet", key).agg(F.array_join(told, ",").alias("spans"))


def labels(cells: DataFrame, anchor: int = 10) -> DataFrame:
    """(sheet, row, labelled) of each row with values: the first, those after a gap and multiples of ``anchor`` carry their number.

    A row's number suffices to know whether the row before exists, so this is a self-join on row - 1 and not a window over the sheet.
    """
    lines = cells.select("sheet", "row").distinct()
    before = lines.select("sheet", (F.col("row") + 1).alias("row"), F.lit(True).alias("follows"))
    return lines.join(before, ["sheet", "row"], "left").select("sheet", "row", (F.col("follows").isNull() | (F.col("row") % anchor == 0)).alias("labelled"))


def _marked(cells: DataFrame, anchor: int) -> DataFrame:
    """``dittos``, dealt out by ``_strip``: some rows of a sheet, which have the row above them in the same task. What goes on by rows needs no exchange if it keeps the strip."""
    strip = F.floor(F.col("row") / STRIP)
    both = F.when(F.col("row") % STRIP == STRIP - 1, F.array(strip, strip + 1)).otherwise(F.array(strip))  # the last row of a strip is above the first of the next
    dealt = cells.withColumn("_strip", F.explode(both))
    inside, along = Window.partitionBy("sheet", "_strip"), Window.partitionBy("sheet", "_strip", "col").orderBy("row")
    follows = F.max("row").over(inside.orderBy("row").rangeBetween(-1, -1)).isNotNull()
    above = F.when(F.lag("row").over(along) == F.col("row") - 1, F.lag("token").over(along))
    out = dealt.withColumns({"_follows": follows, "_above": above}).where(F.col("_strip") == strip)
    labelled = ~F.col("_follows") | (F.col("row") % anchor == 0)
    ditto = ~labelled & (tokens.token_cost(F.col("token")) > 1) & F.coalesce(F.col("_above") == F.col("token"), F.lit(False))
    return out.withColumns({"labelled": labelled, "ditto": ditto}).drop("_follows", "_above")


def dittos(cells: DataFrame, anchor: int = 10) -> DataFrame:
    """Cells with ``ditto``: the line has no label, the token costs more than one, and the cell above in the line before has an equal token."""
    return _marked(cells, anchor).drop("_strip")


def fields(cells: DataFrame, anchor: int = 10) -> DataFrame:
    """(sheet, row, labelled, col, n, field): runs of equal adjacent fields, as v*n where that is shorter; dealt out by ``_strip``."""
    marked = _marked(cells, anchor).withColumn("field", F.when(F.col("ditto"), "^").otherwise(F.col("token")))
    island = F.col("col") - F.row_number().over(Window.partitionBy("sheet", "_strip", "row", "field").orderBy("col"))
    out = marked.withColumn("_i", island).groupBy("sheet", "_strip", "row", "labelled", "field", "_i").agg(F.min("col").alias("col"), F.count("*").cast("int").alias("n")).drop("_i")
    cost = F.when(F.col("field") == "^", 1).otherwise(tokens.token_cost(F.col("field")))
    short = (F.col("n") >= 3) & (cost * F.col("n") + F.col("n") - 1 > cost + 2)
    text = F.when(short, F.concat("field", F.lit("*"), F.col("n").cast("string"))).otherwise(F.array_join(F.array_repeat("field", F.col("n")), "|"))
    return out.withColumn("text", text)


def grid_lines(cells: DataFrame, anchor: int = 10, jump: int = 4, start: DataFrame | None = None) -> DataFrame:
    """(sheet, row, line): the sheet's grid form, fields from the smallest column (or ``start`` of its sheet) on, a bar for each step, COL= after a jump."""
    start = cells.groupBy("sheet").agg(F.min("col").alias("start")) if start is None else start
    ordered = F.sort_array(F.collect_list(F.struct("col", "n", "text")))
    lines = fields(cells, anchor).groupBy("sheet", "_strip", "row", "labelled").agg(ordered.alias("f")).join(F.broadcast(start), "sheet")
    body = F.expr(f"""aggregate(f, struct('' as text, start as at, true as first), (s, x) -> struct(concat(s.text, if(s.first, '', '|'),
        if(x.col - s.at >= {jump}, concat(gridloom_letters(x.col), '='), repeat('|', x.col - s.at)), x.text) as text, x.col + x.n as at, false as first), s -> s.text)""".replace("gridloom_letters(x.col)", _LETTERS))  # fmt: skip
    lines = lines.withColumn("body", body)
    labelled = F.col("labelled") | F.col("body").rlike("^[0-9]+:")
    return lines.select("sheet", "row", F.when(labelled, F.concat(F.col("row").cast("string"), F.lit(":"), "body")).otherwise(F.col("body")).alias("line"))


_LETTERS = "(case when x.col <= 26 then chr(64 + x.col) when x.col <= 702 then concat(chr(65 + floor((x.col - 27) / 26)), chr(65 + (x.col - 27) % 26)) else concat(chr(65 + floor((x.col - 703) / 676)), chr(65 + floor((x.col - 703) / 26) % 26), chr(65 + (x.col - 703) % 26)) end)"


def block_gains(spans: DataFrame, anchor: int = 10, min_block_rows: int = 3) -> DataFrame:
    """Those of spans (n rows of one token) that cost less as ranges than in a grid by more than two, with what they gain.

    In a grid the rows of a block below its first are ditto marks, unless they are labelled or the token costs no more than a mark.
    """
    cost = tokens.token_cost
    spans = spans.withColumn("text", span_text()).withColumns({"_t": cost(F.col("text")), "_c": cost(F.col("token"))})
    width = F.col("c1") - F.col("c0") + 1
    per_row = lambda c: F.when(width >= 3, c + 3).otherwise(width * (c + 1))
    n = F.col("n").cast("long")
    full = F.when((F.col("step") == 1) & (F.col("_c") > 1), F.least(1 + F.floor(n / anchor), n)).otherwise(n)
    in_grid = full * per_row(F.col("_c")) + (n - full) * per_row(F.lit(1))
    tall = (n >= 3) & ((F.col("step") > 1) | (n >= min_block_rows))
    return spans.where(tall).withColumn("gain", in_grid - (F.col("_t") + F.col("_c") + 2)).where("gain > 2").drop("text", "_t", "_c")


def residual(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, token) that none of the spans covers; the spans must be of ``strides(rectangles(cells))``.

    Spans are made of whole runs, so runs are taken out by their first cell, and no cell of a span is made.
    """
    covered = spans.select("sheet", F.explode(F.sequence("r0", "r1", "step")).alias("row"), "c0")
    left = runs(cells).join(covered, ["sheet", "row", "c0"], "left_anti")
    return left.select("sheet", "row", F.explode(F.sequence("c0", "c1")).alias("col"), "token")


def costs(cells: DataFrame, anchor: int = 10, jump: int = 4, min_block_rows: int = 3, spans: DataFrame | None = None) -> DataFrame:
    """(sheet, grid, index, hybrid, encoding): estimated tokens of the three text forms, and the one to choose. ``spans``: those of the cells, if they are known."""
    cost = tokens.token_cost
    cells = written(cells.select("sheet", "row", "col", "token"), "cells")  # three plans read them
    marked = _marked(cells, anchor).withColumn("c", F.when(F.col("ditto"), F.lit(1).cast("long")).otherwise(cost(F.col("token")))).withColumn("f", F.when(F.col("ditto"), "^").otherwise(F.col("token")))
    row = Window.partitionBy("sheet", "_strip", "row").orderBy("col")
    same = (F.lag("f").over(row) == F.col("f")) & (F.lag("col").over(row) == F.col("col") - 1)
    marked = marked.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("gap", F.col("col") - F.lag("col").over(row) - 1).withColumn("run", F.sum("new").over(row))
    marked = marked.withColumn("at", F.row_number().over(Window.partitionBy("sheet", "_strip", "row", "run").orderBy("col")))
    gap = F.when(F.col("gap") >= jump, 3).otherwise(F.ceil(F.coalesce("gap", F.lit(0)) / 4))
    cell = F.when(F.col("at") == 1, F.col("c") + 1 + gap).when(F.col("at") == 2, F.col("c") + 1).when(F.col("at") == 3, -2 * F.col("c")).otherwise(0)
    label = F.when(F.col("labelled"), cost(F.col("row").cast("string")) + 1).otherwise(0)
    grid = marked.groupBy("sheet", "_strip", "row", "labelled").agg(F.sum(cell).alias("cells")).withColumn("g", F.col("cells") + 1 + label).groupBy("sheet").agg(F.sum("g").cast("long").alias("grid"))
    spans = (strides(rectangles(cells)) if spans is None else spans).withColumn("text", span_text()).withColumn("text_cost", cost(F.col("text"))).withColumn("c", cost(F.col("token")))
    spans = written(spans.drop("text"), "spans")
    index = spans.groupBy("sheet", "token").agg(F.sum(F.col("text_cost") + 1).alias("t"), F.first("c").alias("c")).groupBy("sheet").agg(F.sum(F.col("t") + F.col("c") + 1).cast("long").alias("index"))
    chosen = block_gains(spans, anchor, min_block_rows).groupBy("sheet").agg(F.sum("gain").alias("gain"), F.count("*").alias("blocks"))
    out = grid.join(index, "sheet").join(chosen, "sheet", "left").withColumn("hybrid", F.when(F.col("blocks") > 0, F.greatest(F.col("grid") - F.col("gain"), F.lit(0)).cast("long")))
    choice = (
        F.when((F.col("index") < 0.85 * F.col("grid")) & (F.col("hybrid").isNull() | (F.col("index") < F.col("hybrid"))), "index")
        .when(F.col("hybrid") < 0.92 * F.col("grid"), "hybrid").otherwise("grid")
    )
    return out.select("sheet", "grid", "index", "hybrid", F.coalesce("blocks", F.lit(0)).alias("blocks"), choice.alias("encoding"))
