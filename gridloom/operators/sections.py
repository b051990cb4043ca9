"""Whole workbooks as documents of sections, in lines of text or in JSON, and their decoder.

A document is a DataFrame of lines (sheet_no, section, a, b, text) whose order is that of its first four columns: the head, the workbook, its styles (sheet 0), then
each sheet's sections. ``save_text`` and ``save_json`` write it to files in that order, a stretch of the document each; ``load_text`` and ``load_json`` number the lines
again. ``decoded`` gives each line its section: the last head before it, found inside chunks of lines, and carried over the chunks by one row each.

Sections are those of ``NAMES``. Metadata are in compact XML, one item a line.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import compact, coords, dates, tokens
from gridloom.operators import cells as C
from gridloom.operators import cover, dimensions, document, formulas, styles
from gridloom.sources import workbook, xlsx
from gridloom.sources.scratch import written

NAMES = ("analysis", "values", "formulas", "styles", "merged", "hyperlinks", "comments", "dimensions", "validations", "conditional_formatting", "tables", "sheet")
GROUPS = {"all": (*NAMES, "workbook"), "cells": ("values", "formulas", "styles"), "metadata": (*NAMES[4:], "workbook")}
#: Relations that a document of a workbook is made of.
RELATIONS = ("cells", "sheets", "merged", "hyperlinks", "comments", "row_dims", "col_dims", "validations", "cond_formats", "tables", "defined_names", "properties", "cell_styles", "style_parts", "settings")
LINES = "sheet_no int, section int, a bigint, b bigint, text string"
CHUNK = 4096  # lines
HEAD = "#gridloom/1"


def chosen(include: str | list[str] = "all", exclude: str | list[str] = ()) -> list[str]:
    """Names of sections, by name or group."""

    def names(spec) -> set[str]:
        out: set[str] = set()
        for item in [spec] if isinstance(spec, str) else spec:
            if item not in GROUPS and item not in GROUPS["all"]:
                raise ValueError(f"{item!r} isn't a section; sections are {', '.join(GROUPS['all'])}")
            out |= set(GROUPS.get(item, (item,)))
        return out

    kept = names(include) - names(exclude)
    return [n for n in GROUPS["all"] if n in kept]


def opened(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All relations of one workbook."""
    return {name: (workbook.cells(spark, path) if name == "cells" else workbook.relation(spark, path, name)).drop("file") for name in RELATIONS}


def cell_tokens(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, token) of cells with values; dates in ISO form."""
    value, kind = F.col("value"), F.col("kind")
    ts = dates.from_serial(F.when(kind == "date", value.try_cast("double")))
    moment = F.regexp_replace(tokens.datetime_token(ts), " 00:00:00$", "")
    token = F.when(kind == "text", tokens.text_token(value)).when(kind == "error", tokens.error_token(value)).when(kind == "date", F.coalesce(moment, value)).otherwise(value)
    return cells.where("value is not null").select("sheet", "row", "col", token.alias("token"))


def frozen(row: int, col: int) -> str:
    """Text of ``sheetViews`` in which the rows above and the columns left of a cell stay in view."""
    down, right = row - 1, col - 1
    pane = "bottomRight" if down and right else "bottomLeft" if down else "topRight"
    split = " ".join(f"{k}={n}" for k, n in (("xSplit", right), ("ySplit", down)) if n)
    return f"sheetView(workbookViewId=0 pane({split} topLeftCell={coords.letters(col)}{row} activePane={pane} state=frozen))" if split else "sheetView(workbookViewId=0)"


def item(name: str, *parts: Column) -> Column:
    """``name(a=1 b=2 "text")`` of attributes and texts, nulls left out."""
    return F.concat(F.lit(f"{name}("), F.array_join(F.array_compact(F.array(*parts)), " "), F.lit(")"))


def attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), tokens.scalar(value.cast("string")))


def flag(name: str, value: Column) -> Column:
    return F.when(value, f"{name}=1")


def child(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"{name}("), tokens.json_literal(text), F.lit(")"))


def encoded(book: dict[str, DataFrame], source: str = "", include: str | list[str] = "all", exclude: str | list[str] = (), encoding: str = "auto", sheets: list[str] | None = None) -> DataFrame:
    """The document of a workbook's relations. ``sheets`` chooses some of its sheets; a name that isn't there is a KeyError.

    The names of sheets come to the driver: a workbook has few of them.
    """
    names = chosen(include, exclude)
    spark = book["cells"].sparkSession
    all_sheets = book["sheets"].select("sheet", F.col("sheet_no") + 1, "state").orderBy("sheet_no").collect()
    known = {r[0] for r in all_sheets}
    for s in sheets or []:
        if s not in known:
            raise KeyError(s)
    numbers = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in all_sheets if sheets is None or r[0] in sheets], "sheet string, sheet_no int"))
    own = {k: d.drop("sheet_no").join(numbers, "sheet") for k, d in book.items() if k in ("cells", "merged", "hyperlinks", "comments", "row_dims", "col_dims", "validations", "cond_formats", "tables", "settings")}
    cells = own["cells"]  # written where more than their bounds is asked
    if not {"analysis", "values", "styles", "formulas"}.isdisjoint(names):
        cells = written(cells, "cells")
    if "analysis" in names or "values" in names:
        valued = written(cell_tokens(cells), "tokens")
    for name, section in (("comments", "comments"), ("row_dims", "dimensions")):  # heads and lines are made of them
        if section in names:
            own[name] = written(own[name], name)
    lines: list[DataFrame] = []
    heads: list[tuple] = []

    def add(df: DataFrame, section: str, a: Column, b: Column, text: Column) -> None:
        number = NAMES.index(section) + 1
        df = df if "sheet_no" in df.columns else df.join(numbers, "sheet")
        lines.append(df.select("sheet_no", F.lit(number).alias("section"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), text.alias("text")))

    def headed(df: DataFrame, section: str, text: Column | None = None) -> None:
        """The section's head, in sheets that have a line of it."""
        df = df if "sheet_no" in df.columns else df.join(numbers, "sheet")
        first = df.select("sheet_no", (F.lit(f"### {section}") if text is None else text).alias("text")).distinct()
        lines.append(first.select("sheet_no", F.lit(NAMES.index(section) + 1).alias("section"), F.lit(-2).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "text"))

    def both(df: DataFrame, section: str, a: Column, b: Column, text: Column) -> None:
        headed(df, section)
        add(df, section, a, b, text)

    heads.append((0, 0, 0, 0, f"{HEAD} source={json.dumps(source, ensure_ascii=False)} sections={','.join(names)}"))
    if "workbook" in names:
        heads.append((0, 1, 0, 0, "## workbook"))
        heads += [(0, 1, 1, i, f"sheet({' '.join([f'name={compact.scalar(s)}'] + ([f'state={state}'] if state != 'visible' else []))})") for i, (s, _, state) in enumerate(all_sheets)]
        scope = F.col("_at") - 1
        defined = book["defined_names"].join(F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in all_sheets], "scope string, _at int")), "scope", "left")
        told = item("definedName", attribute("name", F.col("name")), attribute("localSheetId", scope), flag("hidden", F.col("hidden")), tokens.json_literal(F.col("refers_to")))
        said = item("property", attribute("name", F.col("name")), tokens.json_literal(F.col("value")))
        for at, df, text in ((2, defined, told), (3, book["properties"], said)):
            lines.append(df.select(F.lit(0).alias("sheet_no"), F.lit(1).alias("section"), F.lit(at).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), text.alias("text")))
    if "styles" in names:
        heads.append((0, 2, -1, 0, "## styles"))
        table = styles.style_table(book["cell_styles"], book["style_parts"], cells)
        lines.append(table.select(F.lit(0).alias("sheet_no"), F.lit(2).alias("section"), F.col("place.kind").cast("bigint").alias("a"), F.col("place.id").cast("bigint").alias("b"), F.col("line").alias("text")))
        if not cells.where("style > 0").isEmpty():
            both(styles.style_map(cells), "styles", F.col("first_row"), F.col("first_col"), F.col("line"))
    box = cells.groupBy("sheet_no").agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    of = F.when(F.col("r0").isNull(), "A1:A1").otherwise(coords.range_text(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1")))
    title = numbers.join(box, "sheet_no", "left").select("sheet_no", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.concat(F.lit("## sheet "), F.col("sheet_no").cast("string"), F.lit(" "), tokens.json_literal(F.col("sheet")), F.lit(" dim="), of).alias("text"))
    lines.append(title)
    measured = "analysis" in names or "values" in names and encoding == "auto"
    spans = written(cover.strides(cover.rectangles(valued)), "spans") if measured or "values" in names and encoding != "grid" else None
    choice = written(cover.costs(valued, spans=spans), "costs") if measured else None
    if "analysis" in names:
        facts = analysis(cells, valued, choice)
        both(facts, "analysis", F.lit(0), F.lit(0), F.col("text"))
    if "values" in names:
        doc = written(document.encoded(valued, encoding, choice, spans), "values")
        start = doc.where("part = 'start'").select("sheet", F.col("text").alias("_start"))
        forms = doc.groupBy("sheet").agg(F.max(F.col("part") == "grid").alias("g"), F.max(F.col("part") == "block").alias("k"), F.max(F.col("part") == "index").alias("i"))
        form = F.when(F.col("i"), "index").when(F.col("k"), "hybrid").otherwise("grid")
        headed(forms.join(start, "sheet", "left").withColumn("text", F.concat(F.lit("### values "), form, F.coalesce(F.concat(F.lit(" start="), "_start"), F.lit("")))), "values", F.col("text"))
        body = doc.where("part != 'start'")
        add(body, "values", F.when(F.col("part") == "grid", 1).otherwise(0), F.col("line_no"), F.col("text"))
    if "formulas" in names and not cells.where("formula is not null").isEmpty():
        both(formulas.lines(cells), "formulas", F.col("first_row"), F.col("first_col"), F.col("line"))
    area = coords.range_text(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"))
    if "merged" in names:
        stretch = own["merged"].withColumn("text", area).groupBy("sheet_no", F.floor(F.col("r0") / 64).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r0", "c0", "r1", "c1", "text"))), lambda x: x["text"]), ",").alias("text"))
        both(stretch, "merged", F.col("k"), F.lit(0), F.col("text"))
    if "hyperlinks" in names:
        parts = F.array_join(F.array_compact(F.array(area, *[attribute(k, F.col(k)) for k in ("target", "location", "tooltip")])), " ")
        both(own["hyperlinks"], "hyperlinks", F.col("r0"), F.col("c0"), parts)
    if "comments" in names:
        both(own["comments"], "comments", F.col("row"), F.col("col"), F.array_join(F.array_compact(F.array(coords.coordinate(F.col("row"), F.col("col")), attribute("author", F.col("author")), tokens.json_literal(F.col("text")))), " "))
    if "dimensions" in names:
        level = attribute("outlineLevel", F.when(F.col("outline") > 0, F.col("outline")))
        columns = item("col", attribute("min", F.col("first")), attribute("max", F.col("last")), attribute("width", F.col("width")), flag("hidden", F.col("hidden")), level)
        rows = dimensions.stretches(own["row_dims"], ["height", "hidden", "outline"])
        span = F.concat(F.col("first").cast("string"), F.when(F.col("last") > F.col("first"), F.concat(F.lit(":"), F.col("last").cast("string"))).otherwise(""))
        told = item("row", attribute("r", span), attribute("ht", F.col("height")), flag("hidden", F.col("hidden")), level)
        headed(own["row_dims"].select("sheet_no").union(own["col_dims"].select("sheet_no")), "dimensions")
        add(own["col_dims"], "dimensions", F.lit(0), F.col("first"), columns)
        add(rows, "dimensions", F.lit(1), F.col("first"), told)
    if "validations" in names:
        told = item("dataValidation", attribute("type", F.col("type")), attribute("operator", F.col("operator")), flag("allowBlank", F.col("allow_blank")), attribute("sqref", F.col("ranges")), child("formula1", F.col("formula1")), child("formula2", F.col("formula2")))
        both(own["validations"], "validations", F.lit(0), F.lit(0), told)
    if "conditional_formatting" in names:
        given = F.array_join(F.transform("formulas", lambda f: F.concat(F.lit("formula("), tokens.json_literal(f), F.lit(")"))), " ")
        rule = item("cfRule", attribute("type", F.col("type")), attribute("operator", F.col("operator")), attribute("priority", F.col("priority")), attribute("dxfId", F.col("style")), F.when(F.size("formulas") > 0, given))
        both(own["cond_formats"], "conditional_formatting", F.col("priority"), F.lit(0), F.concat(F.translate("ranges", " ", ","), F.lit(" "), rule))
    if "tables" in names:
        columns = F.array_join(F.transform("columns", lambda c: F.concat(F.lit("tableColumn(name="), tokens.scalar(c), F.lit(")"))), " ")
        both(own["tables"], "tables", F.lit(0), F.lit(0), item("table", attribute("displayName", F.col("name")), attribute("ref", F.col("ref")), flag("totalsRowCount", F.col("totals_row")), columns))
    if "sheet" in names:
        place = F.array_position(F.array(*map(F.lit, xlsx.SETTINGS)), F.col("name"))
        both(own["settings"], "sheet", place, F.lit(0), F.concat("name", F.lit("("), "text", F.lit(")")))
    lines.append(spark.createDataFrame(heads, LINES))
    return reduce(DataFrame.unionByName, lines)


def analysis(cells: DataFrame, valued: DataFrame, choice: DataFrame) -> DataFrame:
    """(sheet, text): what was measured of a sheet's values, and which encoding that led to."""
    kinds = cells.where("value is not null").groupBy("sheet", "kind").agg(F.count("*").alias("n")).groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind", "n"))), lambda x: F.concat(x["kind"], F.lit(":"), x["n"].cast("string"))), ",").alias("kinds"))
    box = valued.groupBy("sheet").agg(F.count("*").alias("cells"), F.countDistinct("row").alias("rows"), F.countDistinct("token").alias("d"), F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    area = (F.col("r1") - F.col("r0") + 1).cast("double") * (F.col("c1") - F.col("c0") + 1)
    of = cells.groupBy("sheet").agg(F.count("formula").alias("formulas"), F.count(F.when(F.col("style") > 0, 1)).alias("styled"))
    told = box.join(kinds, "sheet").join(of, "sheet").join(choice, "sheet")
    share = lambda c: F.round(c, 4).cast("string")
    text = F.concat(
        F.lit("cells="), F.col("cells").cast("string"), F.lit(" rows="), F.col("rows").cast("string"), F.lit(" values="), coords.range_text(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1")), F.lit(" density="), share(F.col("cells") / area),
        F.lit(" distinct_ratio="), share(F.col("d") / F.col("cells")), F.lit(" kinds="), "kinds", F.lit(" formulas="), F.col("formulas").cast("string"), F.lit(" styled_cells="), F.col("styled").cast("string"), F.lit(" est_tokens=grid:"), F.col("grid").cast("string"),
        F.lit(",index:"), F.col("index").cast("string"), F.coalesce(F.concat(F.lit(",hybrid:"), F.col("hybrid").cast("string")), F.lit("")), F.lit(" encoding="), "encoding",
    )
    return told.select("sheet", text.alias("text"))


# files

ORDER = ["sheet_no", "section", "a", "b", "text"]


def ordered(doc: DataFrame) -> DataFrame:
    return doc.repartitionByRange(*ORDER[:4]).sortWithinPartitions(*ORDER)


def save_text(doc: DataFrame, path: str) -> None:
    """Lines in the document's order; each task writes its stretch to a file, whose names are in that order."""
    ordered(doc).select("text").write.text(path)


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) of a saved document: files in the order of their names, and lines in that of the file, however files are split."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    return C.numbered(written(lines, "lines"), ["_file", "_block", "_id"], "line_no").select("line_no", "text")


def save_json(doc: DataFrame, path: str) -> None:
    """One object a line: the texts of a section, cut at ``CHUNK`` lines: {"sheet_no", "section", "part", "text"}."""
    held = C.numbered(written(doc, "document"), ORDER[:4], "line_no")  # else its lines are made twice: for the ranges' bounds, and again
    parts = held.groupBy("sheet_no", "section", F.floor(F.col("line_no") / CHUNK).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    parts.repartitionByRange("sheet_no", "section", "part").sortWithinPartitions("sheet_no", "section", "part").write.json(path)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.schema("sheet_no int, section int, part bigint, text string").json(path)
    each = parts.select("sheet_no", "section", "part", F.posexplode(F.split("text", "\n")).alias("_at", "text"))
    return C.numbered(each, ["sheet_no", "section", "part", "_at"], "line_no").select("line_no", "text")


# decoding


def placed(lines: DataFrame) -> DataFrame:
    """(line_no, text, sheet, section, head): each line with the heads that hold for it; heads themselves are left out."""
    marks = lines.select("line_no", "text", F.floor(F.col("line_no") / CHUNK).alias("_chunk"), F.when(F.col("text").rlike("^## "), F.col("text")).alias("_sheet"), F.when(F.col("text").rlike("^###? "), F.col("text")).alias("_head"))
    held = written(marks, "marks")
    inside = Window.partitionBy("_chunk").orderBy("line_no")
    names = ("_sheet", "_head")
    ends = held.groupBy("_chunk").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c) for c in names])
    over = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    carried = ends.select("_chunk", *[F.last(c, ignorenulls=True).over(over).alias(f"{c}_before") for c in names])
    out = held.withColumns({f"{c}_own": F.last(c, ignorenulls=True).over(inside) for c in names}).join(carried, "_chunk")
    out = out.where("_head is null").select("line_no", "text", *[F.coalesce(f"{c}_own", f"{c}_before").alias(c) for c in names]).where(~F.col("text").startswith(HEAD))
    quoted = F.regexp_extract("_sheet", r'^## sheet \d+ ("(?:[^"\\]|\\.)*")', 1)
    name = F.from_json(F.concat(F.lit('{"n":'), quoted, F.lit("}")), "n string")["n"]
    section = F.when(F.col("_head").startswith("### "), F.regexp_extract("_head", r"^### (\w+)", 1)).otherwise(F.regexp_extract("_head", r"^## (\w+)", 1))
    return out.select("line_no", "text", F.when(quoted != "", name).alias("sheet"), section.alias("section"), F.col("_head").alias("head"))


ITEM = "line_no bigint, sheet string, section string, ranges string, name string, attributes map<string,string>, text string, children array<struct<name: string, attributes: map<string,string>, text: string>>"


def items(lines: DataFrame) -> DataFrame:
    """Metadata lines as elements with their attributes, text and children."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), kind, pa.string(), pa.list_(pa.struct([("name", pa.string()), ("attributes", kind), ("text", pa.string())])))
        for batch in batches:
            out = []
            for no, sheet, section, text in zip(*[batch.column(c).to_pylist() for c in ("line_no", "sheet", "section", "text")], strict=True):
                ranges = None
                if section in ("hyperlinks", "comments", "conditional_formatting"):
                    ranges, _, text = text.partition(" ")
                x = compact.decode_items("item", text)
                if section not in ("hyperlinks", "comments") and len(x):
                    x = x[0]
                out.append((no, sheet, section, ranges, x.tag, list(x.attrib.items()), x.text, [{"name": c.tag, "attributes": list(c.attrib.items()), "text": c.text} for c in x]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[re.split(" ", c)[0] for c in ITEM.split(", ")[:5]] + ["attributes", "text", "children"])

    return lines.select(F.col("line_no").cast("bigint").alias("line_no"), "sheet", "section", "text").mapInArrow(read, ITEM)


def decoded(lines: DataFrame) -> dict[str, DataFrame]:
    """Relations of a document's lines (line_no, text): values (sheet, row, col, token), formulas, styles and formats, and the metadata in the columns of ``xlsx.SCHEMAS``."""
    held = written(placed(lines), "placed")
    of = lambda name: held.where(F.col("section") == name)
    values = of("values")
    form, start = F.regexp_extract("head", r"^### values (\w+)", 1), F.regexp_extract("head", r"start=([A-Z]+)", 1)
    first = values.where(F.col("text").rlike("^[0-9]+:")).groupBy("sheet").agg(F.min("line_no").alias("_first"))
    part = F.when(form == "index", "index").when((form == "hybrid") & (F.col("_first").isNull() | (F.col("line_no") < F.col("_first"))), "block").otherwise("grid")
    body = values.join(F.broadcast(first), "sheet", "left").select("sheet", part.alias("part"), F.col("line_no").cast("int").alias("line_no"), "text")  # a row a sheet
    begin = values.where(start != "").select("sheet", F.lit("start").alias("part"), F.lit(0).alias("line_no"), start.alias("text")).distinct()
    style_lines = of("styles")
    formats, parts = styles.decoded_table(style_lines.where("sheet is null").select(F.col("text").alias("line")))
    meta = written(items(held.where(F.col("section").isin("hyperlinks", "comments", "dimensions", "validations", "conditional_formatting", "tables", "workbook"))), "items")
    get = lambda k: F.col("attributes")[k]
    box = coords.range_bounds(F.col("ranges"))
    kids = lambda name: F.filter("children", lambda c: c["name"] == name)
    yes = lambda k: F.coalesce(get(k) == "1", F.lit(False))
    sides = [box[k].alias(k) for k in ("r0", "c0", "r1", "c1")]
    in_ = lambda section, name=None: meta.where((F.col("section") == section) & (F.lit(True) if name is None else F.col("name") == name))
    merged = of("merged").select("sheet", F.explode(F.split("text", ",")).alias("ranges")).select("sheet", *sides)
    outline = F.coalesce(get("outlineLevel").cast("int"), F.lit(0)).alias("outline")
    ends = F.split(get("r"), ":")
    rows = in_("dimensions", "row").select("sheet", F.explode(F.sequence(ends[0].cast("int"), F.coalesce(F.try_element_at(ends, F.lit(2)), ends[0]).cast("int"))).alias("row"), get("ht").cast("double").alias("height"), yes("hidden").alias("hidden"), outline)
    listed = in_("workbook", "sheet").select("line_no", get("name").alias("sheet"), F.coalesce(get("state"), F.lit("visible")).alias("state"))
    listed = listed.withColumn("sheet_no", F.row_number().over(Window.orderBy("line_no")) - 1)  # a row a sheet
    scoped = in_("workbook", "definedName").select(get("name").alias("name"), get("localSheetId").cast("int").alias("_at"), F.col("text").alias("refers_to"), yes("hidden").alias("hidden"))
    return {
        "values": document.decoded(body.unionByName(begin)), "formulas": formulas.decoded(of("formulas").select("sheet", F.col("text").alias("line"))),
        "styles": styles.decoded_map(style_lines.where("sheet is not null").select("sheet", F.col("text").alias("line"))), "cell_styles": formats, "style_parts": parts,
        "merged": merged, "hyperlinks": in_("hyperlinks").select("sheet", *sides, *[get(k).alias(k) for k in ("target", "location", "tooltip")]),
        "comments": in_("comments").select("sheet", box["r0"].alias("row"), box["c0"].alias("col"), get("author").alias("author"), F.coalesce("text", F.lit("")).alias("text")), "row_dims": rows,
        "col_dims": in_("dimensions", "col").select("sheet", get("min").cast("int").alias("first"), get("max").cast("int").alias("last"), get("width").cast("double").alias("width"), yes("hidden").alias("hidden"), outline),
        "validations": in_("validations").select("sheet", get("sqref").alias("ranges"), get("type").alias("type"), get("operator").alias("operator"), *[F.get(kids(k), 0)["text"].alias(k) for k in ("formula1", "formula2")], yes("allowBlank").alias("allow_blank")),
        "cond_formats": meta.where("section = 'conditional_formatting'").select("sheet", F.translate("ranges", ",", " ").alias("ranges"), get("type").alias("type"), get("operator").alias("operator"), get("priority").cast("int").alias("priority"), F.transform(kids("formula"), lambda c: F.coalesce(c["text"], F.lit(""))).alias("formulas"), get("dxfId").cast("int").alias("style")),
        "tables": in_("tables").select("sheet", get("displayName").alias("name"), get("ref").alias("ref"), F.transform(kids("tableColumn"), lambda c: c["attributes"]["name"]).alias("columns"), yes("totalsRowCount").alias("totals_row")),
        "settings": of("sheet").select("sheet", F.regexp_extract("text", r"^(\w+)\(", 1).alias("name"), F.regexp_extract("text", r"(?s)^\w+\((.*)\)$", 1).alias("text")),
        "sheets": listed.select("sheet", "sheet_no", "state"), "defined_names": scoped.join(F.broadcast(listed.select(F.col("sheet_no").alias("_at"), F.col("sheet").alias("scope"))), "_at", "left").select("name", "scope", "refers_to", "hidden"),
        "properties": in_("workbook", "property").select(get("name").alias("name"), F.col("text").alias("value")),
    }
