"""Filter, sort, validation and conditional-format specifications as Spark predicates and columns.

Spreadsheet files only store these specifications; here they are evaluated over DataFrames. Statistics over a whole column
(averages, percentiles, extremes, ranks near the top) are aggregates of one row, joined back, so no column passes through one task.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    "equal": lambda c, v: c == v, "notEqual": lambda c, v: (c != v) | c.isNull(), "greaterThan": lambda c, v: c > v, "greaterThanOrEqual": lambda c, v: c >= v,
    "lessThan": lambda c, v: c < v, "lessThanOrEqual": lambda c, v: c <= v,
}
UNITS = ("year", "month", "day", "hour", "minute", "second")


def values(c: Column, allowed: list, blank: bool = False) -> Column:
    held = c.isin(allowed) if allowed else F.lit(False)
    return F.coalesce(held, F.lit(False)) | (c.isNull() | (c.cast("string") == "")) if blank else F.coalesce(held, F.lit(False))


def wildcard(pattern: str) -> str:
    """Java's regular expression of a pattern with * and ?, which ~ takes literally."""
    out = re.sub(r"~([*?~])|([*?])|(.)", lambda m: re.escape(m[1]) if m[1] else {"*": ".*", "?": "."}[m[2]] if m[2] else re.escape(m[3]), pattern, flags=re.DOTALL)
    return f"(?is)^{out}$"


def custom(c: Column, conditions: list[tuple[str, object]], both: bool = False) -> Column:
    """One or two comparisons; texts with wildcards are patterns for (not) equal."""

    def one(op: str, v) -> Column:
        if isinstance(v, str) and op in ("equal", "notEqual"):
            if v.strip() == "":
                blank = c.isNull() | (F.trim(c.cast("string")) == "")
                return blank if op == "equal" else ~blank
            hit = F.coalesce(c.cast("string").rlike(wildcard(v)), F.lit(False))
            return hit if op == "equal" else ~hit
        return F.coalesce(COMPARE[op](c, F.lit(v)), F.lit(False))

    return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), (one(op, v) for op, v in conditions))


def date_group(ts: Column, **parts: int) -> Column:
    """year=2024, month=5, ... down to the second: a prefix of units."""
    given = [u for u in UNITS if u in parts]
    if given != list(UNITS[: len(given)]) or not given:
        raise ValueError("give year, month, ... without gaps")
    read = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    return reduce(lambda a, b: a & b, (read[u](ts).cast("int") == parts[u] for u in given))


def dynamic(df: DataFrame, column: str, kind: str, as_of: str | None = None) -> DataFrame:
    """Rows above or below the average, of a quarter or month of any year (Q1, M5), or of a period relative to the date ``as_of``."""
    c = F.col(column)
    if kind in ("aboveAverage", "belowAverage"):
        mean = df.agg(F.avg(column).alias("_mean"))
        out = df.join(F.broadcast(mean))  # one row
        return out.where(c > F.col("_mean") if kind == "aboveAverage" else c < F.col("_mean")).drop("_mean")
    if m := re.fullmatch(r"Q([1-4])", kind):
        return df.where(F.quarter(c) == int(m[1]))
    if m := re.fullmatch(r"M(\d+)", kind):
        return df.where(F.month(c) == int(m[1]))
    day = F.to_date(F.lit(as_of))
    if kind in ("today", "yesterday", "tomorrow"):
        return df.where(F.to_date(c) == F.date_add(day, {"today": 0, "yesterday": -1, "tomorrow": 1}[kind]))
    if kind == "yearToDate":
        return df.where((F.year(c) == F.year(day)) & (F.to_date(c) <= day))
    m = re.fullmatch(r"(this|last|next)(Week|Month|Quarter|Year)", kind)
    if not m:
        raise ValueError(f"{kind} isn't known")
    by = {"this": 0, "last": -1, "next": 1}[m[1]]
    if m[2] == "Week":  # from Sunday on
        sunday = lambda d: F.date_sub(d, F.dayofweek(d) - 1)
        return df.where(sunday(F.to_date(c)) == F.date_add(sunday(day), 7 * by))
    months = by * {"Month": 1, "Quarter": 3, "Year": 12}[m[2]]
    return df.where(F.trunc(F.to_date(c), m[2].lower()) == F.trunc(F.add_months(day, months), m[2].lower()))


def top(df: DataFrame, column: str, n: int, percent: bool = False, bottom: bool = False) -> DataFrame:
    """The rows with the n largest values, or n per cent of the rows, ties at the edge included.

    The edge value comes from counts by value with a sort that stops at n, not from a rank over all rows.
    """
    c = F.col(column)
    if percent:
        n = max(1, -(-df.where(c.isNotNull()).count() * n // 100))
    edge = df.where(c.isNotNull()).select(column).orderBy(c.asc() if bottom else c.desc()).limit(n).agg((F.max if bottom else F.min)(column).alias("_edge"))
    out = df.join(F.broadcast(edge))  # one row
    return out.where(c <= F.col("_edge") if bottom else c >= F.col("_edge")).drop("_edge")


def sort_keys(keys: list[tuple]) -> list[Column]:
    """Sort columns of (column, descending, custom list): members of the list first, in its order, then all others; nulls last."""
    out = []
    for name, descending, listed in keys:
        c = F.col(name)
        if listed:
            at = F.array_position(F.array(*map(F.lit, listed)), c)
            at = F.when(at == 0, len(listed) + 1).otherwise(at)
            out.append(at.desc_nulls_last() if descending else at.asc_nulls_last())
        out.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
    return out


def valid(c: Column, kind: str, operator: str = "between", first=None, second=None, listed: list | None = None, blank: bool = True) -> Column:
    """Whether values meet a data validation: whole, decimal, date, time, textLength (8 operators) or list."""
    if kind == "list":
        held = c.cast("string").isin(listed or [])
    else:
        v = F.length(c.cast("string")) if kind == "textLength" else c
        lit = (lambda x: F.to_date(F.lit(x))) if kind == "date" else F.lit
        if operator in ("between", "notBetween"):
            held = v.between(lit(first), lit(second))
            held = held if operator == "between" else ~held
        else:
            held = COMPARE[operator](v, lit(first))
        if kind == "whole":
            held = held & (c.cast("double") == F.floor(c.cast("double")))
    return F.when(c.isNull(), F.lit(blank)).otherwise(F.coalesce(held, F.lit(False)))


# conditional formats: each gives a boolean column "hit", or a value


def duplicated(df: DataFrame, column: str, unique: bool = False) -> DataFrame:
    """duplicateValues, or uniqueValues: counts combine before the exchange and are joined back."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n")).select(F.col(column).alias("_v"), "_n")
    out = df.join(counts, F.col(column).eqNullSafe(F.col("_v")))
    return out.withColumn("hit", F.col(column).isNotNull() & ((F.col("_n") == 1) if unique else (F.col("_n") > 1))).drop("_v", "_n")


def above_average(df: DataFrame, column: str, above: bool = True, equal: bool = False, deviations: int = 0) -> DataFrame:
    stats = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    c, edge = F.col(column), F.col("_m") + (deviations if above else -deviations) * F.col("_s")
    hit = ((c >= edge) if equal else (c > edge)) if above else ((c <= edge) if equal else (c < edge))
    return df.join(F.broadcast(stats)).withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_m", "_s")  # one row


def text_rule(c: Column, kind: str, text: str) -> Column:
    low, t = F.lower(c), text.lower()
    return {"containsText": low.contains(t), "notContains": ~low.contains(t), "beginsWith": low.startswith(t), "endsWith": low.endswith(t)}[kind]


def thresholds(df: DataFrame, column: str, points: list[tuple[str, float | None]]) -> DataFrame:
    """One row _t0, _t1, ...: points as (min | max | num | percent | percentile, value)."""
    low, high = F.min(column), F.max(column)
    of = {"min": lambda v: low, "max": lambda v: high, "num": lambda v: F.lit(float(v)), "percent": lambda v: low + (high - low) * (v / 100), "percentile": lambda v: F.percentile(column, F.lit(v / 100))}
    return df.agg(*[of[kind](v).cast("double").alias(f"_t{i}") for i, (kind, v) in enumerate(points)])


def color_scale(df: DataFrame, column: str, points: list[tuple[str, float | None]], colors: list[str]) -> DataFrame:
    """``color`` (RRGGBB) between two or three colours, in proportion to where the value lies between the points."""
    c = F.col(column).cast("double")
    rgb = [[int(x[i : i + 2], 16) for i in (0, 2, 4)] for x in colors]

    def mixed(i: int) -> Column:
        a, b = F.col(f"_t{i}"), F.col(f"_t{i + 1}")
        share = F.when(b == a, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - a) / (b - a))))
        return F.concat(*[F.lpad(F.hex(F.round(F.lit(rgb[i][k]) + share * (rgb[i + 1][k] - rgb[i][k])).cast("int")), 2, "0") for k in range(3)])

    color = mixed(0) if len(colors) == 2 else F.when(c <= F.col("_t1"), mixed(0)).otherwise(mixed(1))
    return df.join(F.broadcast(thresholds(df, column, points))).withColumn("color", F.when(c.isNotNull(), color)).drop(*[f"_t{i}" for i in range(len(points))])


def icon_set(df: DataFrame, column: str, points: list[tuple[str, float | None]]) -> DataFrame:
    """``icon``: how many of the points the value reaches, less one."""
    c = F.col(column).cast("double")
    n = reduce(lambda a, b: a + b, ((c >= F.col(f"_t{i}")).cast("int") for i in range(len(points))))
    return df.join(F.broadcast(thresholds(df, column, points))).withColumn("icon", F.greatest(n - 1, F.lit(0))).drop(*[f"_t{i}" for i in range(len(points))])


def data_bar(df: DataFrame, column: str, low: int = 10, high: int = 90) -> DataFrame:
    """``bar``: the length in per cent, from ``low`` at the smallest value to ``high`` at the largest."""
    c = F.col(column).cast("double")
    share = F.when(F.col("_t1") == F.col("_t0"), 1.0).otherwise((c - F.col("_t0")) / (F.col("_t1") - F.col("_t0")))
    return df.join(F.broadcast(thresholds(df, column, [("min", None), ("max", None)]))).withColumn("bar", F.round(F.lit(low) + share * (high - low), 4)).drop("_t0", "_t1")
