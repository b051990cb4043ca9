"""Rules over ranges: conditional formats and data validations of a sheet, joined with the cells they hold and evaluated.

Workbooks only store rules. Here a cell meets the rules of its sheet by an equality join on blocks of rows; what a rule needs to know of all its cells (average, counts of
values, the n-th largest) is aggregated once a rule, and joined back. Of the rules that hold for a cell, those after the first one that stops are dropped, and the
smallest priority wins.

Cells are (sheet, row, col, kind, value): numbers, and dates as serials, as text. Operands are constants: numbers, "texts" and TRUE or FALSE. A rule whose operand is a formula or
a reference isn't evaluated and never holds (``hit`` is null), except lists of validations, which may be ranges of a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import coords, dates
from gridloom.operators import cells as C
from gridloom.sources.scratch import written

ROWS = 64
#: Columns of a conditional format; those that it doesn't use may be missing.
RULE = {
    "sheet": "string", "ranges": "string", "type": "string", "operator": "string", "priority": "int", "formulas": "array<string>", "style": "int", "stop": "boolean", "text": "string", "rank": "int",
    "percent": "boolean", "bottom": "boolean", "above": "boolean", "equal_average": "boolean", "deviations": "int", "period": "string",
}
CELL = ["sheet", "row", "col", "kind", "value"]


def rectangles(rules: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each rectangle of ``ranges`` ("A1:B2 D4"), with its bounds."""
    each = rules.select(*keep, F.explode(F.split(F.trim("ranges"), r"\s+")).alias("_range")).withColumn("_b", coords.range_bounds(F.col("_range")))
    open_ = {"r0": 1, "c0": 1, "r1": coords.MAX_ROW, "c1": coords.LAST_COLUMN}
    return each.select(*keep, *[F.coalesce(F.col(f"_b.{k}"), F.lit(v)).alias(k) for k, v in open_.items()])


def held(cells: DataFrame, rules: DataFrame, keep: list[str]) -> DataFrame:
    """(cells, ``keep``): each cell with each rule that holds it, once, whatever rectangles of the rule do so. ``keep`` must tell rules apart.

    A rule's rectangles in a block of rows are one row, so no pair is found twice, and equal cells are told apart where they meet the rules: no exchange sees the pairs. The
    rectangles' rows by block are many more than the file of rules lets expect, so both sides are dealt out and sorted.
    """
    rects = rectangles(rules, ["sheet", *keep]).withColumnRenamed("sheet", "_sheet")
    rects = rects.withColumn("_block", F.explode(F.sequence(F.floor(F.col("r0") / ROWS), F.floor(F.col("r1") / ROWS))))
    bounds = F.array_sort(F.collect_set(F.struct("r0", "c0", "r1", "c1"))).alias("_rects")
    rects = rects.groupBy("_sheet", "_block", *keep).agg(bounds).select("_sheet", "_block", *keep, F.col("_rects")[0].alias("_rect"), F.when(F.size("_rects") > 1, F.col("_rects")).alias("_rects"))
    own = cells.select(CELL).withColumn("_at", F.floor(F.col("row") / ROWS)).repartition("sheet", "_at").distinct()
    inside = lambda x: F.col("row").between(x["r0"], x["r1"]) & F.col("col").between(x["c0"], x["c1"])
    on = (F.col("sheet") == F.col("_sheet")) & (F.col("_at") == F.col("_block")) & (inside(F.col("_rect")) | (F.col("_rects").isNotNull() & F.exists("_rects", inside)))
    return own.join(rects.hint("merge"), on).select(*CELL, *keep)


def constant(text: Column) -> Column:
    """struct(number, text) of a constant operand; nulls of both for anything else."""
    bare = F.trim(F.regexp_replace(text, "^=", ""))
    number = F.when(F.upper(bare) == "TRUE", F.lit(1.0)).when(F.upper(bare) == "FALSE", F.lit(0.0)).otherwise(F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double")))
    quoted = F.when(bare.rlike('^"(?:[^"]|"")*"$'), F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"')))
    return F.struct(number.alias("number"), quoted.alias("text"))


def compared(operator: Column, number: Column, text: Column, first: Column, second: Column) -> Column:
    """One of eight operators; texts compare without case, and only with texts. Null if an operand isn't constant."""
    low, a, b = F.lower(text), F.lower(first["text"]), F.lower(second["text"])
    of_texts = first["text"].isNotNull()
    pair = lambda f: F.when(of_texts, f(low, a)).otherwise(f(number, first["number"]))
    between = F.when(of_texts, low.between(F.least(a, b), F.greatest(a, b))).otherwise(number.between(F.least(first["number"], second["number"]), F.greatest(first["number"], second["number"])))
    known = first["text"].isNotNull() | first["number"].isNotNull()
    both = known & (second["text"].isNotNull() | second["number"].isNotNull())
    one = (
        F.when(operator == "equal", pair(lambda x, y: x == y)).when(operator == "notEqual", ~F.coalesce(pair(lambda x, y: x == y), F.lit(False))).when(operator == "greaterThan", pair(lambda x, y: x > y))
        .when(operator == "greaterThanOrEqual", pair(lambda x, y: x >= y)).when(operator == "lessThan", pair(lambda x, y: x < y)).when(operator == "lessThanOrEqual", pair(lambda x, y: x <= y))
    )
    spread = F.when(operator == "between", F.coalesce(between, F.lit(False))).when(operator == "notBetween", ~F.coalesce(between, F.lit(False)))
    return F.when(operator.isin("between", "notBetween"), F.when(both, spread)).otherwise(F.when(known, F.coalesce(one, F.lit(False))))


def in_period(day: Column, period: Column, today: Column) -> Column:
    """Whether a date is in one of ten periods; weeks begin on Sundays."""
    week = lambda d: F.date_sub(d, F.dayofweek(d) - 1)
    month = lambda n: F.trunc(day, "month") == F.trunc(F.add_months(today, n), "month")
    return (
        F.when(period == "today", day == today).when(period == "yesterday", day == F.date_add(today, -1)).when(period == "tomorrow", day == F.date_add(today, 1))
        .when(period == "last7Days", day.between(F.date_add(today, -6), today)).when(period == "thisMonth", month(0)).when(period == "lastMonth", month(-1)).when(period == "nextMonth", month(1))
        .when(period == "thisWeek", week(day) == week(today)).when(period == "lastWeek", week(day) == F.date_add(week(today), -7)).when(period == "nextWeek", week(day) == F.date_add(week(today), 7))
    )


def complete(rules: DataFrame) -> DataFrame:
    return rules.select(*[(F.col(c) if c in rules.columns else F.lit(None)).cast(t).alias(c) for c, t in RULE.items()])


def hits(cells: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """(sheet, row, col, priority, hit) of all cells with the rules that hold them, 18 types; priorities tell rules of a sheet apart. ``as_of``: the date of today."""
    # what rules say is read once a rule
    said = {"_first": constant(F.try_element_at("formulas", F.lit(1))), "_second": constant(F.try_element_at("formulas", F.lit(2))), "text": F.lower(F.coalesce("text", F.lit("")))}
    said |= {c: F.coalesce(c, F.lit(c == "above")) for c in ("above", "percent", "bottom", "equal_average")} | {"deviations": F.coalesce("deviations", F.lit(0))}
    rules = written(complete(rules).withColumns(said).drop("formulas"), "rules")
    rule = ["sheet", "priority"]
    told = F.broadcast if small(rules) else lambda df: df
    cells = written(cells.select(CELL), "cells")
    number = F.when(F.col("kind").isin("number", "date"), F.col("value").try_cast("double"))
    # the pairs of cells and rules aren't written: what only some types ask of all cells is asked for these, and each pair is judged where it is found
    met = lambda which: held(cells, rules.where(which), ["priority"]).withColumn("_number", number)
    repeats = F.coalesce(F.col("type").isin("duplicateValues", "uniqueValues"), F.lit(False))
    # ranks: place of each number among those of its rule, over ranges of rows and not in one task
    ranked = met(F.col("type") == "top10").where("_number is not null").join(told(rules.select(*rule, "rank", "percent", "bottom")), rule)
    steps = written(ranked.withColumn("_key", F.when(F.col("bottom"), F.col("_number")).otherwise(-F.col("_number"))).groupBy(*rule, "rank", "percent", "_key").agg(F.count("*").alias("_n")), "steps")
    edges = written(nth(steps, rule), "edges")
    stats = met(F.col("type") == "aboveAverage").groupBy(rule).agg(F.avg("_number").alias("_mean"), F.stddev_pop("_number").alias("_spread"))
    shown = met(repeats).where("value is not null and value != ''")
    same = shown.groupBy(*rule, F.lower("value").alias("_value")).agg(F.count("*").alias("_same"))
    pairs = lambda which: met(which).withColumn("_value", F.lower("value"))
    out = pairs(~repeats).withColumn("_same", F.lit(None).cast("bigint")).unionByName(pairs(repeats).join(same, [*rule, "_value"], "left"))
    out = out.join(told(rules.drop("ranges", "style", "stop")), rule).join(told(stats), rule, "left").join(told(edges), rule, "left")
    first, second = F.col("_first"), F.col("_second")
    text, kind, number, needle, low = F.coalesce("value", F.lit("")), F.col("type"), F.col("_number"), F.col("text"), F.coalesce("_value", F.lit(""))
    edge = F.col("_mean") + F.when(F.col("above"), F.col("deviations")).otherwise(-F.col("deviations")) * F.col("_spread")
    out = out.withColumns({"_bound": edge, "_rank_key": F.when(F.col("bottom"), number).otherwise(-number), "_day": F.to_date(dates.from_serial(F.when(F.col("kind") == "date", number)))})
    bound, key, day = F.col("_bound"), F.col("_rank_key"), F.col("_day")
    equal = F.col("equal_average") & (number == bound)
    blank = F.trim(text) == ""
    hit = (
        F.when(kind == "cellIs", compared(F.col("operator"), number, F.when(F.col("kind") == "text", F.col("value")), first, second))
        .when(kind == "containsText", low.contains(needle)).when(kind == "notContainsText", ~low.contains(needle)).when(kind == "beginsWith", low.startswith(needle)).when(kind == "endsWith", low.endswith(needle))
        .when(kind == "containsBlanks", blank).when(kind == "notContainsBlanks", ~blank).when(kind == "containsErrors", F.col("kind") == "error").when(kind == "notContainsErrors", F.col("kind") != "error")
        .when(kind == "duplicateValues", F.coalesce(F.col("_same") > 1, F.lit(False))).when(kind == "uniqueValues", F.coalesce(F.col("_same") == 1, F.lit(False)))
        .when(kind == "aboveAverage", F.coalesce(F.when(F.col("above"), number > bound).otherwise(number < bound) | equal, F.lit(False)))
        .when(kind == "top10", F.coalesce(key <= F.col("_edge"), F.lit(False))).when(kind == "timePeriod", F.coalesce(in_period(day, F.col("period"), F.to_date(F.lit(as_of))), F.lit(False)))
        .when(kind.isin("colorScale", "dataBar", "iconSet"), number.isNotNull())
    )
    return out.select("sheet", "row", "col", "priority", hit.alias("hit"))


def small(rules: DataFrame, most: int = 100_000) -> bool:
    return rules.limit(most + 1).count() <= most


def nth(steps: DataFrame, rule: list[str]) -> DataFrame:
    """(rule, _edge): the key up to which ``rank`` cells of a rule come, or that many per cent of them, at least one. Of steps (rule, rank, percent, _key, _n)."""
    placed = C.numbered(steps, [*rule, "_key"], "_place")
    # running counts: inside blocks of places, then over one row a block and rule
    placed = written(placed.withColumn("_b", F.floor(F.col("_place") / 4096)), "placed")
    ends = placed.groupBy(*rule, "_b").agg(F.sum("_n").alias("_sum"))
    over = Window.partitionBy(*rule).orderBy("_b")
    ends = ends.withColumn("_before", F.sum("_sum").over(over) - F.col("_sum")).withColumn("_all", F.sum("_sum").over(Window.partitionBy(*rule)))
    own = F.sum("_n").over(Window.partitionBy(*rule, "_b").orderBy("_place")) - F.col("_n")
    found = placed.withColumn("_own", own).join(ends.drop("_sum"), [*rule, "_b"])
    n = F.when(F.col("percent"), F.greatest(F.lit(1), F.floor(F.col("_all") * F.col("rank") / 100))).otherwise(F.col("rank"))
    return found.where(F.col("_before") + F.col("_own") < n).groupBy(rule).agg(F.max("_key").alias("_edge"))


def winners(found: DataFrame, rules: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """(sheet, row, col, priority, style, applied): the rule that wins in each cell where one holds, and the priorities of all that apply.

    ``found`` is of ``hits``. Rules apply by priority up to the first that holds and stops. With ``styles`` (id, text), the winner's style in full.
    """
    rules = written(complete(rules).select("sheet", "priority", "style", F.coalesce("stop", F.lit(False)).alias("stop")), "rules")
    held_ = found.where("hit").join(F.broadcast(rules) if small(rules) else rules, ["sheet", "priority"])
    stop = F.min(F.when(F.col("stop"), F.col("priority"))).alias("_stop")
    out = held_.groupBy("sheet", "row", "col").agg(F.min("priority").alias("priority"), F.min_by("style", "priority").alias("style"), F.sort_array(F.collect_list("priority")).alias("applied"), stop)
    out = out.withColumn("applied", F.filter("applied", lambda p: F.col("_stop").isNull() | (p <= F.col("_stop")))).drop("_stop")
    if styles is None:
        return out
    return out.join(styles.select(F.col("id").alias("style"), F.col("text").alias("style_text")), "style", "left").select("sheet", "row", "col", "priority", "style", "applied", "style_text")


def validated(cells: DataFrame, validations: DataFrame) -> DataFrame:
    """(sheet, row, col, value, validation, valid): cells that validations (validation, sheet, ranges, type, operator, formula1, formula2, allow_blank) hold.

    whole, decimal, date, time and textLength compare by eight operators; a list is "a,b,c" or a range of a sheet, whose values are joined. Custom formulas aren't
    evaluated: ``valid`` is null. Dates and times are serials. Empty cells are valid where blanks are allowed.
    """
    given = written(validations.select("validation", "sheet", "ranges", "type", "operator", "formula1", "formula2", F.coalesce("allow_blank", F.lit(False)).alias("allow_blank")), "validations")
    met = written(held(cells, given, ["validation"]), "validated")
    lists = given.where("type = 'list'").withColumn("_source", F.regexp_replace(F.trim("formula1"), "^=", ""))
    written_out = lists.where("_source like '\"%'").select("validation", F.explode(F.split(F.regexp_replace("_source", '^"|"$', ""), ",")).alias("_value")).withColumn("_value", F.trim("_value"))
    sheet = F.regexp_replace(F.regexp_extract("_source", r"^(.*)!", 1), r"^'|'$", "")
    refs = lists.where("_source not like '\"%'").select(F.col("validation"), F.when(sheet == "", F.col("sheet")).otherwise(F.replace(sheet, F.lit("''"), F.lit("'"))).alias("sheet"), F.regexp_replace("_source", r"^.*!|\$", "").alias("ranges"))
    listed = written(written_out.union(held(cells, refs, ["validation"]).select("validation", F.col("value").alias("_value"))).where("_value is not null").distinct(), "listed")
    allowed = listed.select(F.col("validation").alias("_validation"), "_value", F.lit(True).alias("_in"))
    out = met.join(given.drop("sheet", "ranges"), "validation").join(allowed, (F.col("validation") == F.col("_validation")) & (F.col("value") == F.col("_value")), "left")
    number = F.when(F.col("kind").isin("number", "date"), F.col("value").try_cast("double"))
    length = F.length("value").cast("double")
    shown = F.when(F.col("type") == "textLength", length).otherwise(number)
    first, second = constant(F.col("formula1")), constant(F.col("formula2"))
    ok = compared(F.coalesce("operator", F.lit("between")), shown, F.lit(None).cast("string"), first, second) & shown.isNotNull()
    ok = F.when(F.col("type") == "whole", ok & (number == F.floor(number))).when(F.col("type").isin("decimal", "date", "time", "textLength"), ok).when(F.col("type") == "list", F.coalesce("_in", F.lit(False))).when(F.col("type") != "custom", F.lit(True))
    valid = F.when(F.coalesce("value", F.lit("")) == "", F.col("allow_blank")).otherwise(ok)
    return out.select("sheet", "row", "col", "value", "validation", valid.alias("valid"))
