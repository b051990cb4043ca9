"""Totals rows and pivot tables, from their specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import filters
from gridloom.operators.cells import numbered
from gridloom.sources.scratch import written

AGGREGATES = {
    "sum": F.sum, "average": F.avg, "avg": F.avg, "count": F.count, "countNums": F.count, "max": F.max, "min": F.min, "product": F.product,
    "stdDev": F.stddev_samp, "stdDevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop,
}


def totals(df: DataFrame, functions: dict[str, str]) -> DataFrame:
    """One row with the totals of a table's columns."""
    return df.agg(*[AGGREGATES[f](c).alias(f"{c}_{f}") for c, f in functions.items()])


def pivot(df: DataFrame, rows: list[str], column: str, value: str, function: str = "sum", items: list | None = None) -> DataFrame:
    """Row items by column items; giving the items saves a pass over the data."""
    grouped = df.groupBy(*rows)
    return (grouped.pivot(column, items) if items else grouped.pivot(column)).agg(AGGREGATES[function](value))


def with_totals(df: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """Groups with subtotals of each prefix of ``by`` and the grand total; ``level`` tells how many keys are left out."""
    return df.rollup(*by).agg(F.grouping_id().alias("_g"), *[AGGREGATES[f](c).alias(f"{c}_{f}") for c, f in values.items()]).withColumn("level", F.bit_count(F.col("_g"))).drop("_g")


def shown_as(df: DataFrame, value: str, kind: str, row: str, column: str | None = None, base=None) -> DataFrame:
    """A pivot's aggregate ``value`` shown as another figure, in ``shown``. df has a row for each pair of items."""
    v = F.col(value)
    whole = F.col("_whole")
    over = lambda *keys: F.sum(value).over(Window.partitionBy(*keys)) if keys else whole
    if kind in ("percentOfTotal", "index"):
        df = df.join(F.broadcast(df.agg(F.sum(value).alias("_whole"))))  # one row

    def of_base() -> Column:
        key = [column] if column else [F.lit(0)]
        return F.max(F.when(F.col(row) == base, v)).over(Window.partitionBy(*key))

    shown = {
        "percentOfTotal": lambda: v / over(), "percentOfRow": lambda: v / over(row), "percentOfCol": lambda: v / over(column),
        "runTotal": lambda: F.sum(value).over(Window.partitionBy(*([column] if column else [F.lit(0)])).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)),
        "difference": lambda: v - of_base(), "percent": lambda: v / of_base(), "percentDiff": lambda: (v - of_base()) / of_base(),
        "index": lambda: v * over() / (over(row) * over(column)),
    }[kind]()
    return df.withColumn("shown", shown).drop("_whole")


def range_group(c: Column, start: float, end: float, interval: float) -> Column:
    """The lower end of a value's interval; what is below the start or from the end on are groups of their own."""
    inside = F.lit(float(start)) + F.floor((c - start) / interval) * interval
    return F.when(c < start, F.concat(F.lit("<"), F.lit(str(start)))).when(c >= end, F.concat(F.lit(">="), F.lit(str(end)))).otherwise(inside.cast("long").cast("string"))


def date_group(ts: Column, unit: str) -> Column:
    return {"years": F.year, "quarters": F.quarter, "months": F.month, "days": F.dayofyear, "hours": F.hour, "minutes": F.minute, "seconds": F.second}[unit](ts).cast("int")


def item_flags(df: DataFrame, column: str) -> DataFrame:
    """What a cache says of a column's shared items: how many, blanks, numbers, texts, and the extremes."""
    c = F.col(column)
    number = c.cast("string").try_cast("double")
    return df.agg(F.count_distinct(column).alias("items"), F.bool_or(c.isNull()).alias("contains_blank"), F.bool_or(number.isNotNull()).alias("contains_number"), F.bool_or(c.isNotNull() & number.isNull()).alias("contains_string"), F.min(number).alias("min_value"), F.max(number).alias("max_value"))


# what is done with items after they were aggregated


def running(items: DataFrame, order: list, value: str) -> DataFrame:
    """Items with ``place`` in an order, and ``before``: the sum of ``value`` of those before. Sums run in blocks of places, and over one row a block."""
    placed = written(numbered(items, order, "place").withColumn("_b", F.floor(F.col("place") / 4096)), "placed")
    ends = placed.groupBy("_b").agg(F.sum(value).alias("_sum"))
    ends = ends.select("_b", (F.sum("_sum").over(Window.orderBy("_b")) - F.col("_sum")).alias("_prior"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_b").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_own", own).join(F.broadcast(ends), "_b").withColumn("before", F.col("_own") + F.col("_prior")).drop("_b", "_own", "_prior")


def filtered(items: DataFrame, kind: str, item: str, measure: str | None = None, first=None, second=None, bottom: bool = False, as_of: str | None = None) -> DataFrame:
    """Items that a pivot filter keeps, of its four families.

    ``count``, ``percent`` and ``sum`` keep the largest (or smallest) items by their measure: so many, as many as make up a share of the total, or as reach a sum; equal
    measures are in the order of the items. ``caption...`` compare the items as text without case, ``value...`` the measure, ``date...`` and periods the items as dates.
    """
    if kind in ("count", "percent", "sum"):
        m = F.col(measure)
        if kind == "count":
            order = [m.asc() if bottom else m.desc(), item]
            return items.orderBy(*order).limit(int(first))
        total = items.agg(F.sum(measure)).first()[0] or 0
        target = total * first / 100 if kind == "percent" else first
        return running(items, [m.asc() if bottom else m.desc(), F.col(item)], measure).where(F.col("before") < target).drop("place", "before")
    family = next((f for f in ("caption", "value", "date") if kind.startswith(f)), None)
    if family is None:
        return filters.dynamic(items, item, kind, as_of)
    op = kind.removeprefix(family)
    c = F.lower(F.col(item).cast("string")) if family == "caption" else F.col(measure) if family == "value" else F.to_date(F.col(item))
    lit = (lambda v: F.lower(F.lit(str(v)))) if family == "caption" else F.lit if family == "value" else (lambda v: F.to_date(F.lit(v)))
    tests = {
        "Equal": lambda: c == lit(first), "NotEqual": lambda: c != lit(first), "BeginsWith": lambda: c.startswith(lit(first)), "NotBeginsWith": lambda: ~c.startswith(lit(first)), "EndsWith": lambda: c.endswith(lit(first)),
        "NotEndsWith": lambda: ~c.endswith(lit(first)), "Contains": lambda: c.contains(lit(first)), "NotContains": lambda: ~c.contains(lit(first)), "GreaterThan": lambda: c > lit(first), "GreaterThanOrEqual": lambda: c >= lit(first),
        "LessThan": lambda: c < lit(first), "LessThanOrEqual": lambda: c <= lit(first), "Between": lambda: c.between(lit(first), lit(second)), "NotBetween": lambda: ~c.between(lit(first), lit(second)),
        "OlderThan": lambda: c < lit(first), "OlderThanOrEqual": lambda: c <= lit(first), "NewerThan": lambda: c > lit(first), "NewerThanOrEqual": lambda: c >= lit(first),
    }
    if op not in tests:
        raise ValueError(f"{kind} isn't a pivot filter")
    return items.where(F.coalesce(tests[op](), F.lit(False)))


def arranged(items: DataFrame, item: str, by: str | None = None, descending: bool = False, manual: list | None = None) -> DataFrame:
    """Items with ``place``: in an order given by hand (others behind), by a measure, or by themselves; equal measures in the order of the items."""
    return numbered(items, [*filters.sort_keys([(item, descending, manual)] if by is None else [(by, descending, None)]), F.col(item)], "place")


def rules_by_priority(formats: DataFrame, fields: DataFrame) -> DataFrame:
    """(field, name, priorities): data fields (field, name) with the priorities of the conditional formats (priority, field, area) on them, each priority and area once."""
    once = formats.select("priority", "field", "area").dropDuplicates(["priority", "area"])
    told = once.groupBy("field").agg(F.sort_array(F.collect_set("priority")).alias("priorities"))
    return fields.join(told, "field", "left").select("field", "name", F.coalesce("priorities", F.array().cast("array<int>")).alias("priorities"))
