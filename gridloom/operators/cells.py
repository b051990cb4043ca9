"""Sheets as a relation of cells (row, col, kind, token), and what is done to them.

A cell exists only where there is a value. Row numbers come from a range partitioning and a running sum over the partitions'
counts, so no task ever holds a whole sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import coords, tokens
from gridloom.sources.scratch import written


def numbered(df: DataFrame, order: list[str | Column], name: str = "row", first: int = 1) -> DataFrame:
    """``df`` with its place in the order of ``order``, from ``first``; ties are placed by all other columns. Sort columns such as ``F.desc("a")`` may be keys."""
    keys = [*order, *(c for c in df.columns if c not in [o for o in order if isinstance(o, str)])]
    ranged = df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).sortWithinPartitions(*keys)
    held = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    out = held.join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_in") + first).cast("int")).drop("_part", "_in", "_before")


def sheetify(df: DataFrame, order: list[str], columns: list[str] | None = None, header: bool = False, sheet: str = "Sheet1") -> DataFrame:
    """Cells (sheet, row, col, kind, token) of a DataFrame: a row for each of its rows, from 2 if there is a header, a column for each of ``columns``."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    rows = numbered(df.select(*dict.fromkeys([*order, *columns])), order, "_row", 2 if header else 1)
    packed = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(tokens.kind_of_type(kinds[c])).alias("kind"), tokens.token(F.col(c), kinds[c]).alias("token")) for i, c in enumerate(columns, 1)])
    cells = rows.select(F.col("_row").alias("row"), F.explode(packed).alias("c")).select(F.lit(sheet).alias("sheet"), "row", "c.col", "c.kind", "c.token").where("token is not null")
    if header:
        names = df.sparkSession.createDataFrame([(sheet, 1, i, "text", c) for i, c in enumerate(columns, 1)], cells.schema)
        cells = names.unionByName(cells)
    return cells


def plain_value(c: Column, kind: str) -> Column:
    """The text of a value that a workbook's cell holds: texts as they are, dates and times in ISO form."""
    return c if kind == "string" else tokens.datetime_token(c) if kind.startswith("timestamp") else F.date_format(c, "yyyy-MM-dd") if kind == "date" else tokens.token(c, kind)


def value_cells(df: DataFrame, order: list[str], columns: list[str] | None = None, header: bool = False, sheet: str = "Sheet1") -> DataFrame:
    """Like ``sheetify``, with plain values (sheet, row, col, kind, value) as ``workbook.save`` takes them."""
    columns, kinds = columns or df.columns, dict(df.dtypes)
    rows = numbered(df.select(*dict.fromkeys([*order, *columns])), order, "_row", 2 if header else 1)
    packed = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(tokens.kind_of_type(kinds[c])).alias("kind"), plain_value(F.col(c), kinds[c]).alias("value")) for i, c in enumerate(columns, 1)])
    cells = rows.select(F.col("_row").alias("row"), F.explode(packed).alias("c")).select(F.lit(sheet).alias("sheet"), "row", "c.col", "c.kind", "c.value").where("value is not null")
    if header:
        cells = df.sparkSession.createDataFrame([(sheet, 1, i, "text", c) for i, c in enumerate(columns, 1)], cells.schema).unionByName(cells)
    return cells


def in_rects(rects: list[tuple[int, int, int, int]]) -> Column:
    out = F.lit(False)
    for r0, c0, r1, c1 in rects:
        out = out | (F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return out


def select_range(cells: DataFrame, spec: str) -> DataFrame:
    """Cells of A1:C3, A:D, 4:10, or of several with commas between."""
    return cells.where(in_rects([coords.bounds(x, coords.LAST_ROW) for x in spec.split(",")]))


def segments(spec: int | str | tuple | list, columns: bool = False) -> list[tuple[int, int]]:
    """Merged intervals of 5, "1:10,20:30", (1, 10) or a list of such; with ``columns``, letters count as well."""
    one = lambda x: x if isinstance(x, int) else coords.index(x) if columns and x.strip().isalpha() else int(x)
    if isinstance(spec, int):
        found = [(spec, spec)]
    elif isinstance(spec, str):
        found = [tuple(one(y) for y in (x.split(":") * 2)[:2]) if ":" not in x else tuple(map(one, x.split(":"))) for x in spec.split(",")]
    elif isinstance(spec, tuple):
        found = [(one(spec[0]), one(spec[1]))]
    else:
        found = [s for x in spec for s in segments(x, columns)]
    out: list[tuple[int, int]] = []
    for a, b in sorted((min(s), max(s)) for s in found):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def complement(found: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    out, at = [], low
    for a, b in found:
        if a > at:
            out.append((at, min(a - 1, high)))
        at = max(at, b + 1)
    return [*out, (at, high)] if at <= high else out


def select_lines(cells: DataFrame, rows=None, columns=None) -> DataFrame:
    """Cells of given rows and columns (as ``segments`` takes them)."""
    for name, spec in (("row", rows), ("col", columns)):
        if spec is not None:
            held = F.lit(False)
            for a, b in segments(spec, name == "col"):
                held = held | F.col(name).between(a, b)
            cells = cells.where(held)
    return cells


def without_hidden(cells: DataFrame, hidden: DataFrame, line: str = "row") -> DataFrame:
    """Cells whose row (or column) isn't in ``hidden`` (first, last): intervals are expanded to lines, which are joined by equality."""
    lines = hidden.select(F.explode(F.sequence("first", "last")).alias(line)).distinct()
    return cells.join(lines, line, "left_anti")


def hidden_rows(cells: DataFrame, row_dims: DataFrame, sheet_formats: DataFrame | None = None) -> DataFrame:
    """(sheet, row) of rows with cells that are hidden: by their own settings, or, in sheets of ``sheet_formats`` (sheet, zero_height), by default unless they have settings."""
    rows = cells.select("sheet", "row").distinct()
    out = rows.join(row_dims.select("sheet", "row", F.coalesce("hidden", F.lit(False)).alias("_own")), ["sheet", "row"], "left")
    if sheet_formats is None:
        return out.where("_own").select("sheet", "row")
    zero = sheet_formats.select("sheet", F.coalesce("zero_height", F.lit(False)).alias("_zero"))  # a row a sheet
    return out.join(F.broadcast(zero), "sheet", "left").where(F.coalesce("_own", "_zero", F.lit(False))).select("sheet", "row")


def linked(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, value) with ``link``: links (sheet, r0, c0, r1, c1, target, location) hold for all cells of their range, of several the one that sorts first. A cell
    that isn't there, or has no value, takes the link as its value."""
    each = links.select("sheet", F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1", F.coalesce("target", F.concat(F.lit("#"), "location")).alias("link"))
    each = each.select("sheet", "row", F.explode(F.sequence("c0", "c1")).alias("col"), "link").groupBy("sheet", "row", "col").agg(F.min("link").alias("link"))
    return cells.select("sheet", "row", "col", "value").join(each, ["sheet", "row", "col"], "full").select("sheet", "row", "col", F.coalesce("value", "link").alias("value"), "link")


def dense(cells: DataFrame, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """Every position of a window, with a null token where no cell is. Rows are dealt over tasks before columns are added."""
    width = F.explode(F.sequence(F.lit(c0), F.lit(c1))).alias("col")
    places = cells.sparkSession.range(r0, r1 + 1).select(F.col("id").cast("int").alias("row"), width)
    return places.join(cells.select("row", "col", "token").where(in_rects([(r0, c0, r1, c1)])), ["row", "col"], "left")


def rows(cells: DataFrame, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """(row, tokens): the window's rows as arrays."""
    packed = F.sort_array(F.collect_list(F.struct("col", "token")))
    return dense(cells, r0, c0, r1, c1).groupBy("row").agg(F.transform(packed, lambda x: x["token"]).alias("tokens"))


def columns(cells: DataFrame, r0: int, c0: int, r1: int, c1: int, block_rows: int = 10_000) -> DataFrame:
    """(col, block, tokens): the window's columns as arrays, in blocks of so many rows, so that no array grows with the sheet."""
    packed = F.sort_array(F.collect_list(F.struct("row", "token")))
    block = F.expr(f"(row - {r0}) div {block_rows}").alias("block")
    return dense(cells, r0, c0, r1, c1).groupBy("col", block).agg(F.transform(packed, lambda x: x["token"]).alias("tokens"))


def bounds(cells: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """(sheet, r0, c0, r1, c1, dimension) of each sheet with cells, and of each of ``sheets`` (sheet): those without cells are A1:A1."""
    out = cells.groupBy("sheet").agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    if sheets is not None:
        out = sheets.select("sheet").distinct().join(out, "sheet", "left").na.fill(1, ["r0", "c0", "r1", "c1"])
    return out.withColumn("dimension", F.concat(coords.coordinate(F.col("r0"), F.col("c0")), F.lit(":"), coords.coordinate(F.col("r1"), F.col("c1"))))


def statistics(cells: DataFrame) -> DataFrame:
    """Counts, density, distinct tokens and token costs of each sheet, in one pass of aggregates."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("number", "text", "bool", "error", "date")]
    out = cells.groupBy("sheet").agg(
        F.count("*").alias("cells"), F.countDistinct("row").alias("rows"), *kinds, F.countDistinct("token").alias("distinct_values"), F.sum(tokens.token_cost(F.col("token"))).alias("token_cost"),
        ((F.max("row") - F.min("row") + 1).cast("long") * (F.max("col") - F.min("col") + 1)).alias("area"),
    )
    return out.select("*", F.round(F.col("cells") / F.col("area"), 4).alias("density"), F.round(F.col("distinct_values") / F.col("cells"), 4).alias("distinct_ratio"))


def last_wins(cells: DataFrame, seq: str = "seq") -> DataFrame:
    """One cell for each coordinate, the last by ``seq``; an aggregate that combines before the exchange."""
    others = [c for c in cells.columns if c not in ("sheet", "row", "col")]
    return cells.groupBy("sheet", "row", "col").agg(F.max_by(F.struct(*others), seq).alias("c")).select("sheet", "row", "col", "c.*")


def overlay(cells: DataFrame, notes: DataFrame, name: str) -> DataFrame:
    """Cells with a comment or link of their place; places without a cell appear with a null token."""
    return cells.join(notes.select("sheet", "row", "col", name), ["sheet", "row", "col"], "full_outer")


def shifted(cells: DataFrame, line: str, at: int, by: int) -> DataFrame:
    """Insert ``by`` rows or columns before ``at``; if negative, delete as many from ``at`` on. Formulas aren't changed."""
    c = F.col(line)
    if by >= 0:
        return cells.withColumn(line, F.when(c >= at, c + by).otherwise(c).cast("int"))
    return cells.where(~c.between(at, at - by - 1)).withColumn(line, F.when(c >= at, c + by).otherwise(c).cast("int"))


def moved(cells: DataFrame, spec: str, by_rows: int, by_cols: int) -> DataFrame:
    """A range moved elsewhere; it overwrites what is there, with empty places as well."""
    r0, c0, r1, c1 = coords.bounds(spec, coords.LAST_ROW)
    target = (r0 + by_rows, c0 + by_cols, r1 + by_rows, c1 + by_cols)
    kept = cells.where(~in_rects([(r0, c0, r1, c1)]) & ~in_rects([target]))
    return kept.unionByName(cells.where(in_rects([(r0, c0, r1, c1)])).withColumn("row", F.col("row") + by_rows).withColumn("col", F.col("col") + by_cols))


def merged(cells: DataFrame, spec: str) -> DataFrame:
    """Of a merged range only the upper left cell keeps its value."""
    r0, c0, r1, c1 = coords.bounds(spec, coords.LAST_ROW)
    return cells.where(~in_rects([(r0, c0, r1, c1)]) | ((F.col("row") == r0) & (F.col("col") == c0)))


def unmerged(merges: DataFrame, cells: DataFrame, spec: str) -> tuple[DataFrame, DataFrame]:
    """Merged ranges without one of them, and the cells without what it covered but its upper left cell."""
    r0, c0, r1, c1 = coords.bounds(spec)
    is_it = (F.col("r0") == r0) & (F.col("c0") == c0) & (F.col("r1") == r1) & (F.col("c1") == c1)
    if merges.where(is_it).isEmpty():
        raise ValueError(f"{spec} isn't merged")
    return merges.where(~is_it), merged(cells, spec)


def printed(cells: DataFrame, area: str, rows: str | None = None, columns: str | None = None) -> DataFrame:
    """Cells of a print area such as A1:C9,E1:F9, of its title rows (1:2) along its columns and title columns (A:B) along its rows."""
    rects = [coords.bounds(x) for x in area.split(",")]
    (top, left), (bottom, right) = ([f(r[i] for r in rects) for i in at] for f, at in ((min, (0, 1)), (max, (2, 3))))
    if rows:
        rects.append((coords.bounds(rows)[0], left, coords.bounds(rows)[2], right))
    if columns:
        rects.append((top, coords.bounds(columns)[1], bottom, coords.bounds(columns)[3]))
    return cells.where(in_rects(rects))


def appended(cells: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` (cells with rows from 1) below the last row of its sheet."""
    last = cells.groupBy("sheet").agg(F.max("row").alias("_last"))
    below = more.join(last, "sheet", "left").withColumn("row", (F.col("row") + F.coalesce("_last", F.lit(0))).cast("int")).drop("_last")
    return cells.unionByName(below)


def upserted(cells: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of ``new`` in place of those at their coordinates; a null token removes."""
    return cells.join(new, ["sheet", "row", "col"], "left_anti").unionByName(new.where("token is not null"))


def copied(cells: DataFrame, sheet: str, name: str) -> DataFrame:
    return cells.unionByName(cells.where(F.col("sheet") == sheet).withColumn("sheet", F.lit(name)))


def unpadded_rows(cells: DataFrame) -> DataFrame:
    """(sheet, row, n, tokens by column): rows as maps, for sparse sheets."""
    return cells.groupBy("sheet", "row").agg(F.count("*").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", "token")))).alias("tokens"))
