"""Queries over workbooks: each writes one from the given tables, and reads it back; SQL says what was written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import dates
from gridloom.operators import cells as C
from gridloom.operators import formulas, overlaps, pivot, rules, sections, selection, styles
from gridloom.plans.catalog import table
from gridloom.sources import pivots, workbook
from gridloom.sources.scratch import new_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def saved(cells: DataFrame, **relations) -> str:
    path = f"{new_path(cells.sparkSession, 'book')}.xlsx"
    workbook.save(cells, path, **relations)
    return path


def first_cell(spark: SparkSession, sheet: str = "S") -> DataFrame:
    """A sheet for what needs no cells."""
    return spark.createDataFrame([(sheet, 1, 1, "text", "x")], "sheet string, row int, col int, kind string, value string")


def read(spark: SparkSession, path: str, relation: str) -> DataFrame:
    return workbook.relation(spark, path, relation).drop("file")


_PARTS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(
    "WITH rows AS (SELECT CAST(1 + row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS row, * FROM part) "
    + " UNION ALL ".join(f"SELECT row, {i} AS col, '{'number' if i in (1, 5, 6) else 'text'}' AS kind, CAST({c} AS VARCHAR) AS value FROM rows" for i, c in enumerate(_PARTS, 1))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT 1, {i}, 'text', '{c}'" for i, c in enumerate(_PARTS, 1))
)
def workbook_cells(spark, sf_dir):
    """All cells of a sheet of parts, with a header."""
    return workbook.cells(spark, saved(C.value_cells(table(spark, sf_dir, "part"), ["p_partkey"], header=True))).select("row", "col", "kind", "value")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS row, o_orderkey AS key, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders")
def workbook_dates(spark, sf_dir):
    """Dates are written as serials in a date style, told by that style when they are read, and turned back."""
    found = workbook.cells(spark, saved(C.value_cells(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey", "o_orderdate"])))
    days = found.where("kind = 'date'").select("row", dates.from_serial(F.col("value").cast("double")).cast("timestamp_ntz").alias("day"))
    return found.where("col = 1").select("row", F.col("value").cast("long").alias("key")).join(days, "row").select("row", "key", "day")


@query("""WITH r AS (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS row, o_totalprice AS p FROM orders)
SELECT row, 2 AS col, '=A' || row || '*2' AS formula, 'shared' AS formula_kind, CAST(p * 2 AS VARCHAR) AS value FROM r
UNION ALL SELECT row, 3, '=IF(A' || row || '>1000,"a<b & c",A$1)', 'normal', CASE WHEN p > 1000 THEN 'a<b & c' ELSE 'no' END FROM r""")
def workbook_formulas(spark, sf_dir):
    """A shared formula over all rows of a sheet, of which only the first row has the text, a formula of its own in each row, and their cached values."""
    rows = C.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    price, none = F.col("o_totalprice"), F.lit(None).cast("string")
    last = rows.agg(F.max("row")).first()[0] or 1
    shared = F.when(F.col("row") == 1, "=A1*2").otherwise("=")
    cell = lambda col, kind, value, formula=none, of=none, ref=none, group=none: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("kind"), C.plain_value(value, "double" if kind == "number" else "string").alias("value"), formula.alias("formula"), of.alias("formula_kind"), ref.alias("formula_ref"), group.alias("formula_group"))
    own = F.concat(F.lit("=IF(A"), F.col("row").cast("string"), F.lit('>1000,"a<b & c",A$1)'))
    each = F.array(
        cell(1, "number", price), cell(2, "number", price * 2, shared, F.lit("shared"), F.when(F.col("row") == 1, f"B1:B{last}"), F.lit("0")),
        cell(3, "text", F.when(price > 1000, "a<b & c").otherwise("no"), own, F.lit("normal")),
    )
    sheet = rows.select("row", F.explode(each).alias("c")).select(F.lit("S").alias("sheet"), "row", "c.*")
    return workbook.cells(spark, saved(sheet)).where("formula is not null").select("row", "col", "formula", "formula_kind", "value")


@query("SELECT CAST(doc_id + 1 AS INTEGER) AS row, left(text, 32767) AS value FROM documents WHERE length(text) > 0")
def workbook_documents(spark, sf_dir):
    """Whole texts with line breaks, control characters and what looks like escapes; only the format's longest text cuts them."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    sheet = docs.select(F.lit("S").alias("sheet"), (F.col("doc_id") + 1).cast("int").alias("row"), F.lit(1).alias("col"), F.lit("text").alias("kind"), F.col("text").alias("value"))
    return workbook.cells(spark, saved(sheet)).select("row", "value")


@query("""SELECT r_name AS sheet, CAST(count(*) AS BIGINT) AS cells, CAST(count(DISTINCT row) AS BIGINT) AS rows, CAST(sum(length(value)) AS BIGINT) AS characters FROM
(SELECT r_name, row, unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment]) AS value FROM (SELECT r_name, c_custkey + 1 AS row, c.* FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)) GROUP BY r_name""")
def workbook_sheet_union(spark, sf_dir):
    """A sheet for each region, and statistics over the union of all sheets."""
    of = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    who = table(spark, sf_dir, "customer").join(of, F.col("c_nationkey") == F.col("n_nationkey"))
    each = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for i, (c, k) in enumerate((("c_custkey", "number"), ("c_name", "text"), ("c_mktsegment", "text")), 1)])
    sheets = who.select(F.col("r_name").alias("sheet"), (F.col("c_custkey") + 1).cast("int").alias("row"), F.explode(each).alias("c")).select("sheet", "row", "c.*")
    found = workbook.cells(spark, saved(sheets))
    return found.groupBy("sheet").agg(F.count("*").alias("cells"), F.countDistinct("row").alias("rows"), F.sum(F.length("value")).alias("characters"))


@query("SELECT r_name AS sheet, CAST(row_number() OVER (ORDER BY r_name DESC) - 1 AS INTEGER) AS sheet_no, CASE WHEN r_regionkey % 2 = 1 THEN 'hidden' ELSE 'visible' END AS state, false AS date1904 FROM region")
def workbook_sheets(spark, sf_dir):
    """Sheets in a given order, some hidden."""
    regions = table(spark, sf_dir, "region")
    names = {r["r_name"]: r["r_regionkey"] for r in regions.collect()}  # names of sheets: a few
    cells = regions.select(F.col("r_name").alias("sheet"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("text").alias("kind"), F.col("r_name").alias("value"))
    path = saved(cells, sheets=sorted(names, reverse=True), states={n: "hidden" for n, k in names.items() if k % 2 == 1})
    return read(spark, path, "sheets").drop("dimension")


@query("SELECT 'S' AS sheet, CAST(2 * c_custkey + 1 AS INTEGER) AS r0, 1 AS c0, CAST(2 * c_custkey + 2 AS INTEGER) AS r1, CAST(2 + c_nationkey AS INTEGER) AS c1 FROM customer")
def workbook_merged(spark, sf_dir):
    ranges = table(spark, sf_dir, "customer").selectExpr("'S' AS sheet", "int(2 * c_custkey + 1) AS r0", "1 AS c0", "int(2 * c_custkey + 2) AS r1", "int(2 + c_nationkey) AS c1")
    return read(spark, saved(first_cell(spark), merged=ranges), "merged")


@query("""SELECT 'S' AS sheet, CAST(s_suppkey + 1 AS INTEGER) AS r0, 2 AS c0, CAST(s_suppkey + 1 AS INTEGER) AS r1, CAST(2 + s_suppkey % 2 AS INTEGER) AS c1, CASE WHEN s_nationkey > 5 THEN 'https://example.org/?a=1&b=' || s_suppkey END AS target,
CASE WHEN s_nationkey <= 5 THEN 'S!A' || (s_suppkey + 1) END AS location, s_name || ' <"' || s_nationkey || '">' AS tooltip FROM supplier""")
def workbook_hyperlinks(spark, sf_dir):
    """Links to the outside by relationship, and to places in the workbook, over one or two cells."""
    of = table(spark, sf_dir, "supplier").selectExpr(
        "'S' AS sheet", "int(s_suppkey + 1) AS r0", "2 AS c0", "int(s_suppkey + 1) AS r1", "int(2 + s_suppkey % 2) AS c1", "CASE WHEN s_nationkey > 5 THEN 'https://example.org/?a=1&b=' || s_suppkey END AS target",
        "CASE WHEN s_nationkey <= 5 THEN 'S!A' || (s_suppkey + 1) END AS location", "s_name || ' <\"' || s_nationkey || '\">' AS tooltip",
    )
    return read(spark, saved(first_cell(spark), hyperlinks=of), "hyperlinks")


@query("SELECT 'S' AS sheet, CAST(p_partkey + 1 AS INTEGER) AS row, CAST(3 + p_size % 2 AS INTEGER) AS col, p_brand AS author, ' ' || p_name || chr(10) || p_type || ' <&> ' AS text FROM part")
def workbook_comments(spark, sf_dir):
    notes = table(spark, sf_dir, "part").selectExpr("'S' AS sheet", "int(p_partkey + 1) AS row", "int(3 + p_size % 2) AS col", "p_brand AS author", "' ' || p_name || chr(10) || p_type || ' <&> ' AS text")
    return read(spark, saved(first_cell(spark), comments=notes), "comments")


@query("SELECT 'S' AS sheet, CAST(p_partkey + 1 AS INTEGER) AS row, CASE WHEN p_size > 10 THEN p_size + 0.5 END AS height, p_size % 7 = 0 AS hidden, CAST(p_size % 3 AS INTEGER) AS outline FROM part WHERE p_size > 10 OR p_size % 7 = 0 OR p_size % 3 > 0")
def workbook_row_settings(spark, sf_dir):
    """Heights, hidden rows and outlines, of rows that have no cells as well."""
    rows = table(spark, sf_dir, "part").selectExpr("'S' AS sheet", "int(p_partkey + 1) AS row", "CASE WHEN p_size > 10 THEN double(p_size + 0.5) END AS height", "p_size % 7 = 0 AS hidden", "int(p_size % 3) AS outline")
    return read(spark, saved(first_cell(spark), row_dims=rows.where("height is not null or hidden or outline > 0")), "row_dims")


@query("SELECT 'S' AS sheet, CAST(2 * n_nationkey + 1 AS INTEGER) AS first, CAST(2 * n_nationkey + 2 AS INTEGER) AS last, CAST(10 + n_regionkey AS DOUBLE) AS width, n_regionkey = 2 AS hidden, CAST(n_regionkey % 3 AS INTEGER) AS outline FROM nation")
def workbook_column_settings(spark, sf_dir):
    columns = table(spark, sf_dir, "nation").selectExpr("'S' AS sheet", "int(2 * n_nationkey + 1) AS first", "int(2 * n_nationkey + 2) AS last", "double(10 + n_regionkey) AS width", "n_regionkey = 2 AS hidden", "int(n_regionkey % 3) AS outline")
    return read(spark, saved(first_cell(spark), col_dims=columns), "col_dims")


@query("SELECT 'Nation_' || n_nationkey AS name, CASE WHEN n_regionkey > 2 THEN 'S' END AS scope, '''S''!$A$' || (n_nationkey + 1) || ':$C$' || (n_nationkey + 1) AS refers_to, n_regionkey = 1 AS hidden FROM nation")
def workbook_names(spark, sf_dir):
    """Names of the workbook and of a sheet."""
    names = table(spark, sf_dir, "nation").selectExpr("'Nation_' || n_nationkey AS name", "CASE WHEN n_regionkey > 2 THEN 'S' END AS scope", "'\\'S\\'!$A$' || (n_nationkey + 1) || ':$C$' || (n_nationkey + 1) AS refers_to", "n_regionkey = 1 AS hidden")
    return read(spark, saved(first_cell(spark), defined_names=names), "defined_names")


@query("""SELECT 'S' AS sheet, 'A' || min(p_partkey) || ':B' || max(p_partkey) AS ranges, 'whole' AS type, 'between' AS operator, CAST(min(p_size) AS VARCHAR) AS formula1, CASE WHEN p_brand LIKE '%1' THEN 'MAX(1,2)&"<"' ELSE CAST(max(p_size) AS VARCHAR) END AS formula2, p_brand LIKE '%2' AS allow_blank
FROM part WHERE p_partkey > 0 GROUP BY p_brand""")
def workbook_validations(spark, sf_dir):
    rules = table(spark, sf_dir, "part").where("p_partkey > 0").groupBy("p_brand").agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"), F.min("p_size").alias("x"), F.max("p_size").alias("y"))
    rules = rules.selectExpr("'S' AS sheet", "'A' || a || ':B' || b AS ranges", "'whole' AS type", "'between' AS operator", "string(x) AS formula1", "CASE WHEN p_brand LIKE '%1' THEN 'MAX(1,2)&\"<\"' ELSE string(y) END AS formula2", "p_brand LIKE '%2' AS allow_blank")
    return read(spark, saved(first_cell(spark), validations=rules), "validations")


@query("SELECT 'S' AS sheet, 'C' || (s_suppkey + 1) || ':D' || (s_suppkey + 9) AS ranges, CASE WHEN s_nationkey > 9 THEN 'cellIs' ELSE 'expression' END AS type, CASE WHEN s_nationkey > 9 THEN 'greaterThan' END AS operator, CAST(s_suppkey + 1 AS INTEGER) AS priority, 'A1>' || s_nationkey AS formula FROM supplier")
def workbook_rules(spark, sf_dir):
    """Conditional formats by priority."""
    rules = table(spark, sf_dir, "supplier").selectExpr("'S' AS sheet", "'C' || (s_suppkey + 1) || ':D' || (s_suppkey + 9) AS ranges", "CASE WHEN s_nationkey > 9 THEN 'cellIs' ELSE 'expression' END AS type", "CASE WHEN s_nationkey > 9 THEN 'greaterThan' END AS operator", "int(s_suppkey + 1) AS priority", "array('A1>' || s_nationkey) AS formulas", "int(null) AS style")
    return read(spark, saved(first_cell(spark), cond_formats=rules), "cond_formats").withColumn("formula", F.array_join("formulas", ";")).drop("formulas", "style")


@query("SELECT 'S' AS sheet, 'T_' || r_regionkey AS name, 'A' || (10 * r_regionkey + 1) || ':C' || (10 * r_regionkey + 5) AS ref, 'key~' || r_name || '~a <&> \"b\"' AS columns, r_regionkey % 2 = 1 AS totals_row FROM region")
def workbook_tables(spark, sf_dir):
    tables = table(spark, sf_dir, "region").selectExpr("'S' AS sheet", "'T_' || r_regionkey AS name", "'A' || (10 * r_regionkey + 1) || ':C' || (10 * r_regionkey + 5) AS ref", "array('key', r_name, 'a <&> \"b\"') AS columns", "r_regionkey % 2 = 1 AS totals_row")
    return read(spark, saved(first_cell(spark), tables=tables), "tables").withColumn("columns", F.array_join("columns", "~"))


@query("SELECT 'Region ' || r_regionkey AS name, r_name || ' & co' AS value FROM region UNION ALL SELECT 'title', CAST(count(*) AS VARCHAR) || ' regions' FROM region")
def workbook_properties(spark, sf_dir):
    """Core and custom properties."""
    of = table(spark, sf_dir, "region")
    told = of.selectExpr("'Region ' || r_regionkey AS name", "r_name || ' & co' AS value").union(of.selectExpr("'title' AS name", "count(*) || ' regions' AS value"))
    return read(spark, saved(first_cell(spark), properties=told), "properties")


# formulas


def order_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of many shapes over all orders: filled down and to the side, anchored, periodic, of whole columns, one of a kind, with line breaks, arrays and data tables."""
    rows = C.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    row = F.col("row").cast("string")
    of = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    one = lambda col, text, kind="normal", ref=None: F.struct(F.lit(col).alias("col"), text.alias("formula"), F.lit(kind).alias("formula_kind"), (ref if ref is not None else F.lit(None).cast("string")).alias("formula_ref"))
    periodic = F.when(F.col("row") % 4 == 0, of("=C", row, "/4")).when(F.col("row") % 4 == 1, of("=C", row, "&\"it's C1\"")).otherwise(of("=C", row, "+", F.col("o_orderkey").cast("string")))
    odd = F.when(F.col("o_orderstatus") == "F", of("=1+\n", row)).when(F.col("o_orderstatus") == "O", of("no formula ", row)).otherwise(of("='S 1'!A", row, "+$B", row, "+C$1+$D$2"))
    each = F.array(
        one(1, of("=C", row, "*D", row)), one(2, of("=D", row, "*E", row)), one(6, periodic), one(7, of("=SUM(A:A)+C", row)), one(8, of("=SUM(B:B)+D", row)), one(9, of("=SUM(1:1)+1")), one(11, odd),
        one(12, of("=SUM(A", row, ":B", row, "*2)"), "array", of("L", row, ":M", row)), one(14, of("ref=N", row, ":O", row, " dt2D=1 r1=A1 r2=B", row), "dataTable"),
    )
    return rows.select(F.lit("S").alias("sheet"), "row", F.explode(each).alias("c")).select("sheet", "row", "c.*")


_FORMULAS = """WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS row, o_orderkey AS k, o_orderstatus AS s FROM orders),
f AS (SELECT row, 1 AS col, '=C' || row || '*D' || row AS formula, 'normal' AS formula_kind, NULL AS formula_ref FROM r UNION ALL SELECT row, 2, '=D' || row || '*E' || row, 'normal', NULL FROM r
UNION ALL SELECT row, 6, CASE row % 4 WHEN 0 THEN '=C' || row || '/4' WHEN 1 THEN '=C' || row || '&"it''s C1"' ELSE '=C' || row || '+' || k END, 'normal', NULL FROM r
UNION ALL SELECT row, 7, '=SUM(A:A)+C' || row, 'normal', NULL FROM r UNION ALL SELECT row, 8, '=SUM(B:B)+D' || row, 'normal', NULL FROM r UNION ALL SELECT row, 9, '=SUM(1:1)+1', 'normal', NULL FROM r
UNION ALL SELECT row, 11, CASE s WHEN 'F' THEN '=1+' || chr(10) || row WHEN 'O' THEN 'no formula ' || row ELSE '=''S 1''!A' || row || '+$B' || row || '+C$1+$D$2' END, 'normal', NULL FROM r
UNION ALL SELECT row, 12, '=SUM(A' || row || ':B' || row || '*2)', 'array', 'L' || row || ':M' || row FROM r UNION ALL SELECT row, 14, 'ref=N' || row || ':O' || row || ' dt2D=1 r1=A1 r2=B' || row, 'dataTable', NULL FROM r) """


@query(_FORMULAS + "SELECT CAST(row AS INTEGER) AS row, col, formula, formula_kind, coalesce(formula_ref, '-') AS formula_ref FROM f")
def formula_section(spark, sf_dir):
    """All formulas, decoded from the section's lines."""
    found = formulas.decoded(formulas.lines(order_formulas(spark, sf_dir)))
    return found.select("row", "col", "formula", "formula_kind", F.coalesce("formula_ref", F.lit("-")).alias("formula_ref"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS row FROM orders), n AS (SELECT count(*) AS n FROM orders), b AS (SELECT DISTINCT row // 65536 AS b FROM r),
c AS (SELECT CASE WHEN n > 1 THEN 'A1:B' || n ELSE 'A1:B1' END || '=C1*D1' AS line FROM n
UNION ALL SELECT 'G1' || CASE WHEN n > 1 THEN ':G' || n ELSE '' END || '=SUM(A:A)+C1' FROM n UNION ALL SELECT 'H1' || CASE WHEN n > 1 THEN ':H' || n ELSE '' END || '=SUM(B:B)+D1' FROM n
UNION ALL SELECT 'I' || row || '=SUM(1:1)+1' FROM r
UNION ALL SELECT CASE WHEN n < 4 THEN NULL WHEN n < 8 THEN 'F4' WHEN n < 12 THEN 'F4,F8' ELSE 'F4:F' || (n - n % 4) || '/4' END || '=C4/4' FROM n
UNION ALL SELECT CASE WHEN n < 5 THEN 'F1' WHEN n < 9 THEN 'F1,F5' ELSE 'F1:F' || (n - (n - 1) % 4) || '/4' END || '=C1&"it''s C1"' FROM n)
SELECT line FROM c WHERE line IS NOT NULL""")
def formula_lines(spark, sf_dir):
    """The lines of formulas that are filled, periodic, or not safe to be filled in a direction."""
    cells = order_formulas(spark, sf_dir).where("col in (1, 2, 7, 8, 9) or (col = 6 and row % 4 < 2)")
    return formulas.lines(cells).select("line")


# styles


def styled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cells a part: keys in fonts by brand, prices in fills, borders and number formats by size and type; many combinations occur."""
    rows = C.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type", "p_retailprice"), ["p_partkey"])
    none = "string(null)"
    keys = rows.selectExpr(
        "row", "1 AS col", "string(p_partkey) AS value", "concat(if(p_size > 25, 'b ', ''), 'color(rgb=FF', substr(md5(p_brand), 1, 6), ') sz:11 name:Calibri') AS font", f"{none} AS fill",
        f"{none} AS border", "if(p_size % 5 = 0, '0000', 'General') AS num_fmt", "if(p_size % 4 = 0, 'horizontal=center wrapText=1', null) AS alignment",
    )
    prices = rows.selectExpr(
        "row", "2 AS col", "string(p_retailprice) AS value", f"{none} AS font", "if(p_size > 40, concat('patternFill(patternType=solid fgColor(rgb=FF', substr(md5(p_type), 1, 6), '))'), null) AS fill",
        "if(p_size % 3 = 0, 'left right top(style=thin color(auto=1)) bottom diagonal', null) AS border", "case p_size % 4 when 0 then '#,##0.00' when 1 then '#,##0.00 \"EUR (net)\"' else 'General' end AS num_fmt", f"{none} AS alignment",
    )
    return keys.union(prices).selectExpr("'S' AS sheet", "row", "col", "'number' AS kind", "value", "font", "fill", "border", "num_fmt", "alignment")


_STYLED = """WITH r AS (SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS row, * FROM part),
c AS (SELECT row, 1 AS col, CASE WHEN p_size > 25 THEN 'b ' ELSE '' END || 'color(rgb=FF' || left(md5(p_brand), 6) || ') sz:11 name:Calibri' AS font, 'patternFill(patternType=none)' AS fill, 'left right top bottom diagonal' AS border,
CASE WHEN p_size % 5 = 0 THEN '0000' ELSE 'General' END AS num_fmt, CASE WHEN p_size % 4 = 0 THEN 'horizontal=center wrapText=1' ELSE '-' END AS alignment FROM r
UNION ALL SELECT row, 2, 'sz:11 name:Calibri', CASE WHEN p_size > 40 THEN 'patternFill(patternType=solid fgColor(rgb=FF' || left(md5(p_type), 6) || '))' ELSE 'patternFill(patternType=none)' END,
CASE WHEN p_size % 3 = 0 THEN 'left right top(style=thin color(auto=1)) bottom diagonal' ELSE 'left right top bottom diagonal' END, CASE p_size % 4 WHEN 0 THEN '#,##0.00' WHEN 1 THEN '#,##0.00 "EUR (net)"' ELSE 'General' END, '-' FROM r) """
_SHOWN = ["row", "col", "font", "fill", "border", "num_fmt"]


@query(_STYLED + "SELECT * FROM c")
def workbook_styles(spark, sf_dir):
    """Styles of a written workbook in full for each cell: pools are numbered, written, read back and joined."""
    cells, parts, formats = styles.pooled(styled_parts(spark, sf_dir))
    path = saved(cells, styles=styles.stylesheet(parts, formats))
    found = styles.resolved(workbook.cells(spark, path), workbook.relation(spark, path, "cell_styles"), workbook.relation(spark, path, "style_parts"), ["file"])
    return found.select(*_SHOWN, F.coalesce("alignment", F.lit("-")).alias("alignment"))


@query(_STYLED + "SELECT * FROM c")
def style_sections(spark, sf_dir):
    """The same by way of a document: the style table's and the style map's lines are decoded, and joined; cells that the map doesn't name have style 0."""
    cells, parts, formats = styles.pooled(styled_parts(spark, sf_dir))
    cells = written(cells, "styled")
    formats_, parts_ = styles.decoded_table(styles.style_table(formats, parts, cells))
    mapped = styles.decoded_map(styles.style_map(cells)).withColumnRenamed("style", "_style")
    found = cells.select("sheet", "row", "col").join(mapped, ["sheet", "row", "col"], "left").withColumn("style", F.coalesce("_style", F.lit(0)))
    return styles.resolved(found, formats_, parts_).select(*_SHOWN, F.coalesce("alignment", F.lit("-")).alias("alignment"))


@query(_STYLED + """SELECT DISTINCT CASE WHEN font LIKE 'b %' THEN 'b' ELSE '' END AS font, CASE WHEN fill LIKE '%solid%' THEN 'patternFill(patternType=solid)' ELSE 'patternFill(patternType=none)' END AS fill, num_fmt,
CAST(count(*) OVER (PARTITION BY font LIKE 'b %', fill LIKE '%solid%', num_fmt) AS BIGINT) AS cells FROM c""")
def style_projection(spark, sf_dir):
    """Bold, pattern and number format alone: what remains different, and how many cells have it."""
    cells, parts, formats = styles.pooled(styled_parts(spark, sf_dir))
    kept, parts, canonical = styles.projected(formats, parts, ["font.b", "fill.patternType", "numFmt"])
    cells = cells.select("row", "col", "style").join(F.broadcast(canonical), "style").select("row", "col", F.col("canonical").alias("style"))  # a row a style
    return styles.resolved(cells, kept, parts).groupBy("style", "font", "fill", "num_fmt").agg(F.count("*").alias("cells")).drop("style")


@query(_STYLED + """SELECT font, fill, border, num_fmt, alignment, CAST(count(*) AS BIGINT) AS cells FROM c
WHERE (font, fill, border, num_fmt, alignment) <> ('sz:11 name:Calibri', 'patternFill(patternType=none)', 'left right top bottom diagonal', 'General', '-') GROUP BY ALL""")
def style_usage_of_workbook(spark, sf_dir):
    """How many cells of a written workbook use each style but the first."""
    cells, parts, formats = styles.pooled(styled_parts(spark, sf_dir))
    path = saved(cells, styles=styles.stylesheet(parts, formats))
    used = workbook.cells(spark, path).where("style > 0").groupBy("file", "style").agg(F.count("*").alias("cells"))
    found = styles.resolved(used, workbook.relation(spark, path, "cell_styles"), workbook.relation(spark, path, "style_parts"), ["file"])
    return found.select(*_SHOWN[2:], F.coalesce("alignment", F.lit("-")).alias("alignment"), "cells")


# rules and ranges that overlap


@query("""WITH RECURSIVE g AS (SELECT DISTINCT CAST(p_partkey * 3 + 1 AS INTEGER) AS r0, CAST(1 + p_size % 4 AS INTEGER) AS c0, CAST(p_partkey * 3 + 1 + p_size % 5 AS INTEGER) AS r1, CAST(1 + p_size % 4 + p_size % 2 AS INTEGER) AS c1 FROM part),
n AS (SELECT *, row_number() OVER (ORDER BY r0, c0, r1, c1) AS id FROM g), l AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON b.r0 BETWEEN a.r0 - 4 AND a.r1 AND b.r1 >= a.r0 AND a.c0 <= b.c1 AND b.c0 <= a.c1),
w AS (SELECT id, id AS m FROM n UNION SELECT w.id, l.b FROM w JOIN l ON w.m = l.a), f AS (SELECT id, min(m) AS m FROM w GROUP BY id)
SELECT n.r0, n.c0, n.r1, n.c1, o.r0 AS group_row, o.c0 AS group_col FROM n JOIN f USING (id) JOIN n o ON o.id = f.m""")
def overlapping_ranges(spark, sf_dir):
    """Groups of ranges that overlap, with the corner of each group's first range."""
    ranges = table(spark, sf_dir, "part").selectExpr("'S' AS sheet", "int(p_partkey * 3 + 1) AS r0", "int(1 + p_size % 4) AS c0", "int(p_partkey * 3 + 1 + p_size % 5) AS r1", "int(1 + p_size % 4 + p_size % 2) AS c1")
    return overlaps.overlap_groups(ranges).drop("sheet")


def part_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and types of parts in two columns."""
    return C.value_cells(table(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_type"])


#: Three rules on each of a few windows of rows that overlap, by brand: a comparison, a text, and one that knows its whole range.
_RULES = """WITH r AS (SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS row, * FROM part),
b AS (SELECT CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER) AS k, min(row) AS a, max(row) // 2 + min(row) AS z, min(p_size) AS low FROM r GROUP BY p_brand) """


def brand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_partkey"])
    of = C.numbered(rows.groupBy("p_brand").agg(F.min("row").alias("a"), F.floor(F.max("row") / 2).alias("half"), F.min("p_size").alias("low")), ["p_brand"], "k").selectExpr("k", "a", "half + a AS z", "low")
    size = of.selectExpr("'Sheet1' AS sheet", "concat('A', a, ':A', z) AS ranges", "'cellIs' AS type", "'between' AS operator", "int(3 * k) AS priority", "array(string(low + 5), string(low + 12)) AS formulas", "int(k % 3) AS style", "k % 2 = 0 AS stop", "string(null) AS text", "int(null) AS rank", "false AS bottom")
    text = of.selectExpr("'Sheet1'", "concat('B', a, ':B', z, ' A1:B1')", "'containsText'", "string(null)", "int(3 * k + 1)", "array()", "int(k % 3)", "false", "'AN'", "int(null)", "false")
    whole = of.selectExpr("'Sheet1'", "concat('A', a, ':B', z)", "case k % 3 when 0 then 'top10' when 1 then 'aboveAverage' else 'duplicateValues' end", "string(null)", "int(3 * k + 2)", "array()", "int(k % 3)", "false", "string(null)", "int(7)", "k % 2 = 1")
    return size.union(text).union(whole)


@query(_RULES + """, c AS (SELECT row, 1 AS col, CAST(p_size AS DOUBLE) AS num, CAST(p_size AS VARCHAR) AS value FROM r UNION ALL SELECT row, 2, NULL, p_type FROM r),
m AS (SELECT b.*, c.* FROM b JOIN c ON c.row BETWEEN a AND z),
h AS (SELECT row, col, 3 * k AS priority, k % 2 = 0 AS stop, k FROM m WHERE col = 1 AND num BETWEEN low + 5 AND low + 12
UNION ALL SELECT row, col, 3 * k + 1, false, k FROM (SELECT DISTINCT k, row, col, value FROM b JOIN c ON (col = 2 AND row BETWEEN a AND z) OR row = 1) WHERE contains(lower(value), 'an')
UNION ALL SELECT row, col, 3 * k + 2, false, k FROM (SELECT *, avg(num) OVER (PARTITION BY k) AS mean, count(*) OVER (PARTITION BY k, lower(value)) AS same,
 rank() OVER (PARTITION BY k ORDER BY CASE WHEN num IS NULL THEN NULL WHEN k % 2 = 1 THEN num ELSE -num END NULLS LAST) AS place FROM m)
 WHERE CASE k % 3 WHEN 0 THEN num IS NOT NULL AND place <= 7 WHEN 1 THEN num > mean ELSE same > 1 END),
s AS (SELECT *, min(CASE WHEN stop THEN priority END) OVER (PARTITION BY row, col) AS stopped FROM h)
SELECT row, col, CAST(min(priority) AS INTEGER) AS priority, CAST(arg_min(k % 3, priority) AS INTEGER) AS style, string_agg(CAST(priority AS VARCHAR), ',' ORDER BY priority) FILTER (stopped IS NULL OR priority <= stopped) AS applied FROM s GROUP BY row, col""")
def rule_winners(spark, sf_dir):
    """Conditional formats over ranges that overlap: the rule that wins in each cell, and all that apply."""
    rules_ = brand_rules(spark, sf_dir)
    found = rules.winners(rules.hits(part_sheet(spark, sf_dir), rules_, "2024-01-01"), rules_)
    return found.select("row", "col", "priority", "style", F.array_join("applied", ",").alias("applied"))


@query(_RULES + """SELECT row, 1 AS col, k AS validation, CASE k % 3 WHEN 0 THEN p_size BETWEEN low + 5 AND low + 12 WHEN 1 THEN length(CAST(p_size AS VARCHAR)) <> 1 ELSE p_size IN (7, 12, 30) END AS valid FROM b JOIN r ON row BETWEEN a AND z
UNION ALL SELECT row, 2, 1000 + k, p_type IN (SELECT p_type FROM r WHERE row <= 9) FROM b JOIN r ON row BETWEEN a AND z""")
def range_validations(spark, sf_dir):
    """Validations over ranges: bounds, lengths, written lists, and lists that are a range of the sheet."""
    rows = C.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_partkey"])
    of = C.numbered(rows.groupBy("p_brand").agg(F.min("row").alias("a"), F.floor(F.max("row") / 2).alias("half"), F.min("p_size").alias("low")), ["p_brand"], "k").selectExpr("k", "a", "half + a AS z", "low")
    size = of.selectExpr("k AS validation", "'Sheet1' AS sheet", "concat('A', a, ':A', z) AS ranges", "case k % 3 when 0 then 'whole' when 1 then 'textLength' else 'list' end AS type", "if(k % 3 = 1, 'notEqual', 'between') AS operator", "case k % 3 when 0 then string(low + 5) when 1 then '1' else '\"7, 12,30\"' end AS formula1", "string(low + 12) AS formula2", "true AS allow_blank")
    types = of.selectExpr("1000 + k", "'Sheet1'", "concat('B', a, ':B', z)", "'list'", "string(null)", "'=$B$1:$B$9'", "string(null)", "true")
    return rules.validated(part_sheet(spark, sf_dir), size.union(types)).select("row", "col", "validation", "valid")


# documents of whole workbooks


def region_book(spark: SparkSession, sf_dir: str) -> str:
    """A workbook with a sheet of customers for each region, notes on some of them and settings of rows."""
    of = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    who = written(table(spark, sf_dir, "customer").join(of, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("r_name AS sheet", "int(c_custkey + 1) AS row", "*"), "customers")
    each = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for i, (c, k) in enumerate((("c_name", "text"), ("c_mktsegment", "text"), ("c_nationkey", "number")), 1)])
    return saved(
        who.select("sheet", "row", F.explode(each).alias("c")).select("sheet", "row", "c.*"),
        comments=who.where("c_custkey % 3 = 0").selectExpr("sheet", "row", "1 AS col", "c_mktsegment AS author", "concat('nation ', c_nationkey, chr(10), '\"', c_name, '\"') AS text"),
        row_dims=who.where("c_nationkey % 2 = 0").selectExpr("sheet", "row", "double(10 + c_nationkey) AS height", "c_nationkey > 20 AS hidden", "0 AS outline"),
    )


_REGIONS = "WITH w AS (SELECT r_name AS sheet, CAST(c_custkey + 1 AS INTEGER) AS row, c.* FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "


@query(_REGIONS + "SELECT sheet, row, 1 AS col, c_name AS token FROM w UNION ALL SELECT sheet, row, 2, c_mktsegment FROM w UNION ALL SELECT sheet, row, 3, CAST(c_nationkey AS VARCHAR) FROM w")
def document_text(spark, sf_dir):
    """A workbook as a document in text files, each sheet in the encoding that costs least, and its values read back."""
    path = new_path(spark, "document")
    sections.save_text(sections.encoded(sections.opened(spark, region_book(spark, sf_dir)), "regions"), path)
    return sections.decoded(sections.load_text(spark, path))["values"].select("sheet", "row", "col", "token")


@query(_REGIONS + """SELECT sheet, row, 'comment' AS what, c_mktsegment || ': nation ' || c_nationkey || chr(10) || '"' || c_name || '"' AS told FROM w WHERE c_custkey % 3 = 0
UNION ALL SELECT sheet, row, 'height', CAST(CAST(10 + c_nationkey AS DOUBLE) AS VARCHAR) || CASE WHEN c_nationkey > 20 THEN ' hidden' ELSE '' END FROM w WHERE c_nationkey % 2 = 0""")
def document_json(spark, sf_dir):
    """The metadata of a workbook as a document in JSON, read back."""
    path = new_path(spark, "document")
    sections.save_json(sections.encoded(sections.opened(spark, region_book(spark, sf_dir)), "regions", include=["comments", "dimensions", "workbook"]), path)
    got = sections.decoded(sections.load_json(spark, path))
    notes = got["comments"].select("sheet", "row", F.lit("comment").alias("what"), F.concat("author", F.lit(": "), "text").alias("told"))
    heights = got["row_dims"].select("sheet", "row", F.lit("height").alias("what"), F.concat(F.col("height").cast("string"), F.when(F.col("hidden"), " hidden").otherwise("")).alias("told"))
    return notes.union(heights)


# pivot caches, and filters of their items


def order_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a cache of orders, written into a workbook and read back."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate", "o_custkey")
    path = saved(first_cell(spark), pivot_cache=orders, pivot_order=["o_orderkey"], pivot_source=("S", "A1:F9"))
    found = pivots.records(spark, path)
    fields = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate", "o_custkey"]
    return found.groupBy("record").pivot("name", fields).agg(F.first("value"))


@query("""SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS record, o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice ELSE -1.0 END AS o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate FROM orders""")
def pivot_cache_records(spark, sf_dir):
    found = order_cache(spark, sf_dir)
    return found.select("record", F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", "o_orderpriority", F.coalesce(F.col("o_totalprice").cast("double"), F.lit(-1.0)).alias("o_totalprice"), "o_orderdate")


@query("""WITH a AS (SELECT o_custkey AS item, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS total FROM a),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY n DESC, item) AS place, coalesce(sum(n) OVER (ORDER BY n, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a)
SELECT 'count' AS filter, CAST(item AS BIGINT) AS item, CAST(n AS BIGINT) AS n FROM r WHERE place <= 25 UNION ALL SELECT 'percent', item, n FROM r, t WHERE before < total * 30 / 100.0 UNION ALL SELECT 'sum', item, n FROM r WHERE below < 90
UNION ALL SELECT 'caption', item, n FROM r WHERE contains(CAST(item AS VARCHAR), '12') UNION ALL SELECT 'value', item, n FROM r WHERE n NOT BETWEEN 5 AND 15""")
def pivot_filters(spark, sf_dir):
    """Items of a cache after aggregation: the largest by number, by share and by sum, by caption and by value."""
    items = written(order_cache(spark, sf_dir).groupBy(F.col("o_custkey").cast("long").alias("item")).agg(F.count("*").alias("n")), "items")
    of = lambda name, *args, **more: pivot.filtered(items, *args, **more).select(F.lit(name).alias("filter"), "item", "n")
    kept = of("count", "count", "item", "n", 25).union(of("percent", "percent", "item", "n", 30)).union(of("sum", "sum", "item", "n", 90, bottom=True))
    return kept.union(of("caption", "captionContains", "item", None, "12")).union(of("value", "valueNotBetween", "item", "n", 5, 15))


@query("""WITH a AS (SELECT o_custkey AS item, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS price FROM orders GROUP BY 1)
SELECT item, CAST(row_number() OVER (ORDER BY price DESC NULLS LAST, item) AS INTEGER) AS place FROM a""")
def pivot_sort(spark, sf_dir):
    """Customers by what one column of a pivot says of them: the sum of finished orders, added exactly to ten places."""
    items = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(38,10)"))).alias("price"))
    return pivot.arranged(items, "item", "price", descending=True).select("item", "place")


@query(_REGIONS + """, c AS (SELECT sheet, row, 1 AS col, c_name AS value, c_nationkey FROM w UNION ALL SELECT sheet, row, 2, c_mktsegment, c_nationkey FROM w UNION ALL SELECT sheet, row, 3, CAST(c_nationkey AS VARCHAR), c_nationkey FROM w)
SELECT sheet, row, col, value FROM c WHERE c_nationkey <> 22 AND c_nationkey <> 24 AND CASE sheet WHEN 'ASIA' THEN (row BETWEEN 5 AND 300 OR row >= 900) AND col <= 2 WHEN 'EUROPE' THEN col <> 2 AND ((row <= 700 AND col = 1) OR (row BETWEEN 200 AND 1000 AND col = 3)) WHEN 'AFRICA' THEN false ELSE col <> 2 END""")
def selected_cells(spark, sf_dir):
    """Rows, columns and ranges of some sheets of a workbook, without what is hidden."""
    book = sections.opened(spark, region_book(spark, sf_dir))
    names = [r["sheet"] for r in book["sheets"].select("sheet").collect()]
    there = lambda spec: {k: v for k, v in spec.items() if k in names}
    kept = selection.selected(
        book, sheets=[n for n in names if n != "AFRICA"], skip_hidden=True, rows=there({"ASIA": ["5:300", (900, 1_000_000)]}), columns={n: "A,C:D" if n != "ASIA" else "A:B" for n in names},
        ranges=there({"EUROPE": ["A1:B700", "C200:C1000"]}),
    )
    return kept["cells"].select("sheet", "row", "col", "value")
