"""Styles as nested pools: fonts, fills and borders by number, cell formats that name them, cells that name formats.

*Parts* are (kind, id, text), the text in compact XML. *Formats* are (style, font, fill, border, num_fmt, alignment, protection, quote_prefix, pivot_button,
name); the first three are ids of parts, the others texts and flags, and style 0 is what cells without one have. Both are small against cells, but only joins whose small side was
counted broadcast them.

``pooled`` numbers bottom-up: equal parts first, then formats that name equal parts. ``projected`` keeps chosen keys only and renumbers again what has become equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree as ET
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import compact, coords, tokens
from gridloom.functions.formats import BUILTIN
from gridloom.operators import cells as C
from gridloom.operators import cover
from gridloom.operators.document import SPAN
from gridloom.sources.scratch import written

PARTS = ("font", "fill", "border")
VALUES = ("num_fmt", "alignment", "protection", "quote_prefix", "pivot_button", "name")
FORMAT = "style int, font int, fill int, border int, num_fmt string, alignment string, protection string, quote_prefix boolean, pivot_button boolean, name string"
PREFIX = {"font": "f", "fill": "p", "border": "b"}
MOST_FORMATS = 65_490  # fixed value: the format allows no more
#: Style 0 of a new workbook, and the second fill that every workbook has.
DEFAULT = {"font": "sz:11 name:Calibri", "fill": "patternFill(patternType=none)", "border": "left right top bottom diagonal"}
SECOND_FILL = "patternFill(patternType=gray125)"

def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast if it has few rows; else an exchange joins it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)))


def complete(cells: DataFrame) -> DataFrame:
    """Cells with all columns of a style: texts of parts, values. What isn't there or null is as in style 0."""
    flags, texts = ("quote_prefix", "pivot_button"), {"num_fmt": "General", "name": "Normal"}
    has = set(cells.columns)
    given = {p: F.coalesce(F.col(p), F.lit(DEFAULT[p])) if p in has else F.lit(DEFAULT[p]) for p in PARTS}
    given |= {k: F.coalesce(F.col(k), F.lit(v)) if k in has else F.lit(v) for k, v in texts.items()}
    given |= {k: F.coalesce(F.col(k), F.lit(False)) if k in has else F.lit(False) for k in flags}
    given |= {k: F.col(k) if k in has else F.lit(None).cast("string") for k in ("alignment", "protection")}
    return cells.withColumns(given)


def pooled(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells with ``style``, parts, formats) of cells that carry their style as texts: font, fill, border in compact XML, num_fmt and so on.

    Distinct styles are counted before anything is numbered; parts and formats are in the order of their texts after those of style 0.
    """
    spark = cells.sparkSession
    wide = complete(cells)
    keys = [*PARTS, *VALUES]
    used = written(wide.select(keys).distinct(), "styles")
    first = complete(spark.range(1).select(F.lit(0).alias("_zero"))).select(keys)
    numbered = []
    for kind in PARTS:
        fixed = [DEFAULT[kind], *([SECOND_FILL] if kind == "fill" else [])]
        more = C.numbered(used.select(F.col(kind).alias("text")).where(~F.col(kind).isin(fixed)).distinct(), ["text"], "id", len(fixed))
        numbered.append(spark.createDataFrame([(t, i) for i, t in enumerate(fixed)], "text string, id int").unionByName(more).select(F.lit(kind).alias("kind"), "id", "text"))
    parts = written(reduce(DataFrame.unionByName, numbered), "parts")
    ids = used
    for kind in PARTS:
        pool = parts.where(F.col("kind") == kind).select(F.col("text").alias("_text"), F.col("id").alias(f"{kind}_id"))
        ids = ids.join(small(pool), F.col(kind) == F.col("_text")).drop("_text")
    plain = F.coalesce(same(keys, [f"_{k}" for k in keys]), F.lit(False))
    ids = ids.join(F.broadcast(first.withColumnsRenamed({k: f"_{k}" for k in keys})), plain, "left").withColumn("plain", F.col("_font").isNotNull()).drop(*[f"_{k}" for k in keys])
    order = [f"{k}_id" for k in PARTS] + [k for k in VALUES]
    rest = C.numbered(ids.where("not plain").drop("plain"), order, "style", 1)
    zero = ids.where("plain").drop("plain").withColumn("style", F.lit(0))
    found = written(rest.unionByName(zero), "formats")
    # style 0 is there even if no cell has it
    missing = first.where(F.lit(zero.isEmpty())).withColumns({f"{k}_id": F.lit(0) for k in PARTS}).withColumn("style", F.lit(0))
    formats = found.unionByName(missing).select("style", *[F.col(f"{k}_id").cast("int").alias(k) for k in PARTS], *VALUES)
    look = small(found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("style").alias("_style")))
    styled = wide.join(look, same(keys, [f"_{k}" for k in keys])).drop(*[f"_{k}" for k in keys], *[c for c in keys if c not in cells.columns]).withColumn("style", F.col("_style").cast("int")).drop("_style")
    return styled, parts, formats


def stylesheet(parts: DataFrame, formats: DataFrame, dxfs: DataFrame | None = None) -> str:
    """The part of a workbook that holds its styles; at most ``MOST_FORMATS`` formats, which the format of workbooks allows, come to the driver."""
    found = formats.orderBy("style").limit(MOST_FORMATS + 1).collect()
    if len(found) > MOST_FORMATS:
        raise ValueError(f"a workbook holds {MOST_FORMATS} formats at most")
    if [r["style"] for r in found] != list(range(len(found))):
        raise ValueError("formats must be numbered from 0 without gaps")
    pools = {k: [r["text"] for r in parts.where(F.col("kind") == k).orderBy("id").limit(MOST_FORMATS).collect()] for k in PARTS}
    codes, names = {v: k for k, v in BUILTIN.items()}, {"Normal": 0}
    custom: dict[str, int] = {}
    xfs = []
    for r in found:
        number = codes.get(r["num_fmt"])
        number = custom.setdefault(r["num_fmt"], 164 + len(custom)) if number is None else number
        inside = "".join(f"<{k} {' '.join(f'{a}={quoteattr(v)}' for a, v in compact.decode_items(k, r[k]).attrib.items())}/>" for k in ("alignment", "protection") if r[k] is not None)
        flags = "".join(f' {n}="1"' for n, c in (("quotePrefix", "quote_prefix"), ("pivotButton", "pivot_button")) if r[c])
        xf = names.setdefault(r["name"], len(names))
        xfs.append(f'<xf numFmtId="{number}" fontId="{r["font"]}" fillId="{r["fill"]}" borderId="{r["border"]}" xfId="{xf}" applyNumberFormat="1" applyFont="1" applyFill="1" applyBorder="1"{flags}' + (f">{inside}</xf>" if inside else "/>"))
    plain = '<xf numFmtId="0" fontId="0" fillId="0" borderId="0"/>'
    told = [] if dxfs is None else [compact.to_xml("dxf", r["text"]) for r in dxfs.orderBy("id").limit(MOST_FORMATS).collect()]
    block = lambda tag, items: f'<{tag} count="{len(items)}">{"".join(items)}</{tag}>' if items else ""
    return (
        f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<styleSheet xmlns="{compact.MAIN}">'
        + block("numFmts", [f'<numFmt numFmtId="{i}" formatCode={quoteattr(c)}/>' for c, i in custom.items()])
        + "".join(block(f"{k}s", [compact.to_xml(k, t) for t in pools[k]]) for k in PARTS)
        + block("cellStyleXfs", [plain] * len(names)) + block("cellXfs", xfs)
        + block("cellStyles", [f'<cellStyle name={quoteattr(n)} xfId="{i}"' + (' builtinId="0"' if n == "Normal" else "") + "/>" for n, i in names.items()]) + block("dxfs", told) + "</styleSheet>"
    )


def resolved(cells: DataFrame, formats: DataFrame, parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cells with their style in full: texts of font, fill and border, and values. ``by``: columns that tell workbooks apart, such as file."""
    by, out = by or [], formats
    for kind in PARTS:
        pool = parts.where(F.col("kind") == kind).select(*by, F.col("id").alias(kind), F.col("text").alias(f"{kind}_text"))
        out = out.join(pool, [*by, kind], "left")
    out = written(out.select(*by, "style", *[F.col(f"{k}_text").alias(k) for k in PARTS], *VALUES), "resolved")
    return cells.join(small(out), [*by, "style"], "left")


# keys of styles


def kept(kind: str, text: str | None, names: frozenset[str] | None) -> str | None:
    """A part, or an alignment or protection, with the chosen names alone: children of fonts and borders, pieces of a pattern, attributes."""
    if text is None or names is None:
        return text
    x = compact.decode_items(kind, text)
    if kind in ("alignment", "protection"):
        for k in [k for k in x.attrib if k not in names]:
            del x.attrib[k]
        return compact.encode_items(x)
    if kind in ("font", "border"):
        x.attrib.clear()
    for child in list(x):
        if kind == "fill" and child.tag == "patternFill":
            if "patternType" not in names:
                child.attrib.pop("patternType", None)
            for c in [c for c in child if c.tag not in names]:
                child.remove(c)
        elif child.tag not in names:
            x.remove(child)
    return compact.encode_items(x)


KEYS = {"font": None, "fill": ("patternType", "fgColor", "bgColor", "gradientFill"), "border": None, "numFmt": (), "alignment": None, "protection": None, "quotePrefix": (), "pivotButton": (), "style": ()}
_COLUMNS = {"numFmt": "num_fmt", "quotePrefix": "quote_prefix", "pivotButton": "pivot_button", "style": "name"}


def chosen(spec: str | list[str]) -> dict[str, frozenset[str] | None]:
    """Columns of a choice such as ["font.b", "fill", "numFmt"], each with its parts, or None for all."""
    out: dict[str, set[str] | None] = {}
    for item in [spec] if isinstance(spec, str) else spec:
        key, _, part = item.partition(".")
        if key not in KEYS or part and KEYS[key] is not None and part not in KEYS[key]:
            raise ValueError(f"{item!r} isn't a key of styles")
        column = _COLUMNS.get(key, key)
        if not part:
            out[column] = None
        elif out.setdefault(column, set()) is not None:
            out[column].add(part)
    return {k: None if v is None else frozenset(v) for k, v in out.items()}


def projected(formats: DataFrame, parts: DataFrame, keys: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(formats, parts, canonical (style, canonical)) with the chosen keys alone: what has become equal is written once, under the smallest number.

    Columns that aren't chosen are as in style 0 of a new workbook.
    """
    names = chosen(keys)
    spark = formats.sparkSession

    @F.pandas_udf("string")
    def trimmed(kind, text):
        return text.combine(kind, lambda t, k: kept(k, t, names.get(k)))

    pool = parts.where(F.col("kind").isin([k for k in PARTS if k in names])).withColumn("text", trimmed("kind", "text"))
    firsts = pool.groupBy("kind", "text").agg(F.min("id").alias("first"))
    ids = written(pool.join(firsts, ["kind", "text"]).select("kind", "id", "first", "text"), "pool")
    out = formats
    for kind in PARTS:
        if kind in names:
            out = out.join(small(ids.where(F.col("kind") == kind).select(F.col("id").alias(kind), F.col("first").alias("_first"))), kind, "left").withColumn(kind, F.coalesce("_first", kind)).drop("_first")
        else:
            out = out.withColumn(kind, F.lit(0))
    for column in ("alignment", "protection"):
        out = out.withColumn(column, trimmed(F.lit(column), F.col(column)) if column in names else F.lit(None).cast("string"))
    plain = {"num_fmt": F.lit("General"), "name": F.lit("Normal"), "quote_prefix": F.lit(False), "pivot_button": F.lit(False)}
    out = out.withColumns({k: v for k, v in plain.items() if k not in names})
    whole = [*PARTS, *VALUES]
    same_ = out.groupBy(whole).agg(F.min("style").alias("canonical"))
    found = written(out.join(same_.withColumnsRenamed({k: f"_{k}" for k in whole}), same(whole, [f"_{k}" for k in whole])).select("style", "canonical", *whole), "projected")
    rest = [(k, 0, DEFAULT[k]) for k in PARTS if k not in names]
    kept_parts = ids.where("id = first").select("kind", "id", "text").unionByName(spark.createDataFrame(rest, "kind string, id int, text string"))
    return found.where("style = canonical").drop("canonical"), kept_parts, found.select("style", "canonical")


# sections of documents


def style_map(cells: DataFrame) -> DataFrame:
    """(sheet, first_row, first_col, line): ``RANGES=sN`` of all cells whose style isn't 0, a line for each style and block of rows."""
    styled = cells.where("style > 0").select("sheet", "row", "col", F.col("style").cast("string").alias("key"))
    spans = cover.strides(cover.rectangles(styled, "key"), "key").withColumn("_block", F.floor(F.col("r0") / 65536))
    lines = spans.groupBy("sheet", "key", "_block").agg(F.sort_array(F.collect_list(F.struct("r0", "c0", cover.span_text().alias("text")))).alias("s"))
    return lines.select("sheet", F.col("s")[0]["r0"].alias("first_row"), F.col("s")[0]["c0"].alias("first_col"), F.concat(F.array_join(F.transform("s", lambda x: x["text"]), ","), F.lit("=s"), "key").alias("line"))


def style_table(formats: DataFrame, parts: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(place, line) of the styles ``used`` (style), or all, and of style 0: the parts they need, then the formats. s0 has every key, others only those that differ from it."""
    if used is not None:
        formats = formats.join(small(used.select("style").distinct().union(formats.sparkSession.createDataFrame([(0,)], "style int")).distinct()), "style", "left_semi")
    formats = written(formats, "formats")
    need = reduce(DataFrame.unionByName, [formats.select(F.lit(k).alias("kind"), F.col(k).alias("id")).distinct() for k in PARTS])
    order = F.when(F.col("kind") == "font", 0).when(F.col("kind") == "fill", 1).otherwise(2)
    mark = F.when(F.col("kind") == "font", "f").when(F.col("kind") == "fill", "p").otherwise("b")
    lines = parts.join(need, ["kind", "id"]).select(F.struct(order.alias("kind"), F.col("id").cast("long").alias("id")).alias("place"), F.concat("kind", F.lit(" "), mark, F.col("id").cast("string"), F.lit(":"), F.when(F.col("text") != "", F.concat(F.lit(" "), "text")).otherwise("")).alias("line"))
    base = formats.where("style = 0").select(*[F.col(c).alias(f"_{c}") for c in (*PARTS, *VALUES)])
    shown = {
        **{k: F.concat(F.lit(f"{k}={PREFIX[k]}"), F.col(k).cast("string")) for k in PARTS}, "num_fmt": F.concat(F.lit("numFmt="), tokens.scalar(F.col("num_fmt"))),
        **{k: F.when(F.col(k).isNull() | (F.col(k) == ""), k).otherwise(F.concat(F.lit(f"{k}("), F.col(k), F.lit(")"))) for k in ("alignment", "protection")},
        "quote_prefix": F.concat(F.lit("quotePrefix="), F.col("quote_prefix").cast("int")), "pivot_button": F.concat(F.lit("pivotButton="), F.col("pivot_button").cast("int")), "name": F.concat(F.lit("style="), tokens.scalar(F.col("name"))),
    }
    first = lambda k: F.col(k) if k in ("quote_prefix", "pivot_button") else F.lit(True)
    items = F.array(*[F.when(F.when(F.col("style") == 0, first(k)).otherwise(~F.col(k).eqNullSafe(F.col(f"_{k}"))), text) for k, text in shown.items()])
    told = formats.join(F.broadcast(base)).select(F.struct(F.lit(3).alias("kind"), F.col("style").cast("long").alias("id")).alias("place"), F.concat(F.lit("s"), F.col("style").cast("string"), F.lit(": "), F.array_join(F.array_compact(items), " ")).alias("line"))
    return lines.unionByName(told)


_PART_LINE, _STYLE_LINE = re.compile(r"(font|fill|border) [fpb](\d+):(?: |$)"), re.compile(r"s(\d+): ?")


def decoded_table(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(formats, parts) of a style table's lines (line): what a format doesn't say it has from style 0."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "text", *PARTS, *VALUES, "said"]
        kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 3, *[pa.string()] * 3, *[pa.bool_()] * 2, pa.string(), pa.list_(pa.string())]
        for batch in batches:
            out = []
            for line in batch.column("line").to_pylist():
                if m := _PART_LINE.match(line):
                    out.append((m[1], int(m[2]), line[m.end() :], *[None] * 9, []))
                elif m := _STYLE_LINE.match(line):
                    out.append(("style", int(m[1]), None, *_format(line[m.end() :])))
                else:
                    raise ValueError(f"bad styles line {line[:40]!r}")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    schema = f"kind string, id int, text string, {FORMAT.partition(', ')[2]}, said array<string>"
    found = written(lines.select("line").mapInArrow(read, schema), "table")
    raw = found.where("kind = 'style'").drop("kind", "text").withColumnRenamed("id", "style")
    whole = [*PARTS, *VALUES]
    base = raw.where("style = 0").select(*[F.col(c).alias(f"_{c}") for c in whole])
    formats = raw.join(F.broadcast(base), how="left").select("style", *[F.when(F.array_contains("said", c) | (F.col("style") == 0), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in whole])
    formats = formats.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quote_prefix", "pivot_button")})
    return formats, found.where("kind != 'style'").select("kind", "id", "text")


def _format(line: str) -> tuple:
    x: ET.Element = compact.decode_items("xf", line)
    a, inside = x.attrib, {c.tag: compact.encode_items(c) for c in x}
    said = [c for c, n in ((*((p, p) for p in PARTS), *((v, k) for k, v in _COLUMNS.items()))) if n in a] + [c for c in ("alignment", "protection") if c in inside]
    flag = lambda n: a[n] == "1" if n in a else None
    return (*[int(a[p][1:]) if p in a else None for p in PARTS], a.get("numFmt"), inside.get("alignment") or None, inside.get("protection") or None, flag("quotePrefix"), flag("pivotButton"), a.get("style"), said)


def decoded_map(lines: DataFrame) -> DataFrame:
    """(sheet, row, col, style) of a style map's lines (sheet, line)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sheet, line in zip(batch.column("sheet").to_pylist(), batch.column("line").to_pylist(), strict=True):
                head, _, style = line.rpartition("=s")
                for m in SPAN.finditer(head):
                    r0, c0 = int(m[2]), coords.index(m[1])
                    out.append((sheet, r0, c0, int(m[4] or r0), coords.index(m[3]) if m[3] else c0, int(m[5] or 1), int(style)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), *[pa.int32()] * 6))], names=["sheet", "r0", "c0", "r1", "c1", "step", "style"])

    found = lines.select("sheet", "line").mapInArrow(read, "sheet string, r0 int, c0 int, r1 int, c1 int, step int, style int")
    return found.withColumn("row", F.explode(F.sequence("r0", "r1", "step"))).withColumn("col", F.explode(F.sequence("c0", "c1"))).select("sheet", "row", "col", "style")
