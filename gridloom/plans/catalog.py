"""The registered queries of the spreadsheet operators, each with DuckDB's SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import coords, dates, formula, texts, tokens, units
from gridloom.operators import cells as C
from gridloom.operators import cover, dimensions, document, filters, pivot, ranges
from gridloom.sources.scratch import written
from gridloom.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# sheets that several queries use, in both languages


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sheetify(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


ORDERS = """WITH rows AS (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS row, o_orderstatus, o_orderpriority FROM orders),
cells AS (SELECT row, 1 AS col, o_orderstatus AS token FROM rows UNION ALL SELECT row, 2, o_orderpriority FROM rows) """


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sheetify(table(spark, sf_dir, "part"), ["p_partkey"], header=True)


_PARTS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
PARTS = (
    "WITH rows AS (SELECT CAST(1 + row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS row, * FROM part), cells AS ("
    + " UNION ALL ".join(f"SELECT row, {i} AS col, '{'number' if i in (1, 5, 6) else 'text'}' AS kind, CAST({c} AS VARCHAR) AS token FROM rows" for i, c in enumerate(_PARTS, 1))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT 1, {i}, 'text', '{c}'" for i, c in enumerate(_PARTS, 1)) + ") "
)

RUNS = """, runs AS (SELECT row, token, min(col) AS c0, max(col) AS c1 FROM (SELECT *, col - row_number() OVER (PARTITION BY row, token ORDER BY col) AS i FROM cells) GROUP BY row, token, i),
rects AS (SELECT token, c0, c1, min(row) AS r0, max(row) AS r1 FROM (SELECT *, row - row_number() OVER (PARTITION BY token, c0, c1 ORDER BY row) AS i FROM runs) GROUP BY token, c0, c1, i) """


# projection and addressing


@query(PARTS + "SELECT row, col, kind, token FROM cells")
def sheetify_cells(spark, sf_dir):
    return part_cells(spark, sf_dir).select("row", "col", "kind", "token")


@query(PARTS + "SELECT row, col, token FROM cells WHERE row BETWEEN 2 AND 40 AND col BETWEEN 2 AND 4")
def range_slice(spark, sf_dir):
    return C.select_range(part_cells(spark, sf_dir), "B2:D40").select("row", "col", "token")


@query(PARTS + "SELECT row, col, token FROM cells WHERE col BETWEEN 1 AND 2")
def column_slice(spark, sf_dir):
    return C.select_range(part_cells(spark, sf_dir), "A:B").select("row", "col", "token")


@query(PARTS + "SELECT row, array_to_string(list(token ORDER BY col), '~') AS line FROM cells WHERE col <= 3 GROUP BY row")
def iter_rows_dense(spark, sf_dir):
    cells = part_cells(spark, sf_dir)
    return C.rows(cells, 1, 1, C.bounds(cells).first()["r1"], 3).select("row", F.array_join("tokens", "~").alias("line"))


@query(PARTS + "SELECT col, CAST((row - 1) // 1000 AS BIGINT) AS block, array_to_string(list(token ORDER BY row), '~') AS line FROM cells GROUP BY ALL")
def iter_columns(spark, sf_dir):
    cells = part_cells(spark, sf_dir)
    return C.columns(cells, 1, 1, C.bounds(cells).first()["r1"], 6, 1000).select("col", "block", F.array_join("tokens", "~").alias("line"))


@query("""WITH e AS (SELECT CAST(event_id + 1 AS INTEGER) AS row, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS col, CAST(user_id AS VARCHAR) AS token FROM events)
SELECT r.row, c.col, token FROM (SELECT CAST(unnest(range(1, (SELECT max(event_id) FROM events) + 22)) AS INTEGER) AS row) r CROSS JOIN (SELECT CAST(range AS INTEGER) AS col FROM range(1, 4)) c LEFT JOIN e ON e.row = r.row AND e.col = c.col""")
def pad_to_bounds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = (e.agg(F.max("event_id")).first()[0] or 0) + 21  # twenty rows below the last event
    col = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return C.dense(e.select((F.col("event_id") + 1).cast("int").alias("row"), col.alias("col"), F.col("user_id").cast("string").alias("token")), 1, 1, last, 3)


# filters on lines and rectangles


@query(ORDERS + "SELECT row, col, token FROM cells WHERE (row BETWEEN 1 AND 10 OR row BETWEEN 15 AND 30 OR row = 77)")
def row_segments(spark, sf_dir):
    return C.select_lines(order_cells(spark, sf_dir), rows=["1:10", "15:20,18:30", 77]).select("row", "col", "token")


@query(ORDERS + "SELECT row, col, token FROM cells WHERE row < 5 OR row > 100 AND row <= 200")
def complement_filter(spark, sf_dir):
    kept = C.complement(C.segments("5:100"), 1, 200)
    return C.select_lines(order_cells(spark, sf_dir), rows=kept).select("row", "col", "token")


@query(ORDERS + "SELECT row, col, token FROM cells WHERE col = 2")
def column_selection(spark, sf_dir):
    return C.select_lines(order_cells(spark, sf_dir), columns="B").select("row", "col", "token")


@query(ORDERS + "SELECT row, col, token FROM cells WHERE (row BETWEEN 1 AND 20 AND col = 1) OR (row BETWEEN 10 AND 60 AND col = 2)")
def rect_selection(spark, sf_dir):
    return C.select_range(order_cells(spark, sf_dir), "A1:A20,B10:B60").select("row", "col", "token")


HIDDEN = "SELECT CAST(100 * k AS INTEGER) AS first, CAST(100 * k + 20 AS INTEGER) AS last FROM range(1, 100) t(k)"


def hidden_lines(spark):
    return spark.range(1, 100).select((F.col("id") * 100).cast("int").alias("first"), (F.col("id") * 100 + 20).cast("int").alias("last"))


@query(ORDERS + f", hidden AS ({HIDDEN}) SELECT row, col, token FROM cells WHERE NOT EXISTS (SELECT 1 FROM hidden WHERE row BETWEEN first AND last)")
def hidden_rows_anti(spark, sf_dir):
    return C.without_hidden(order_cells(spark, sf_dir), hidden_lines(spark)).select("row", "col", "token")


@query(ORDERS + f", hidden AS ({HIDDEN}) SELECT row, col, token, first AS r0 FROM cells JOIN hidden ON row BETWEEN first AND last AND col BETWEEN 1 AND 1")
def merged_range_join(spark, sf_dir):
    held = hidden_lines(spark).select(F.col("first").alias("r0"), F.lit(1).alias("c0"), F.col("last").alias("r1"), F.lit(1).alias("c1"))
    return ranges.in_ranges(order_cells(spark, sf_dir), held).select("row", "col", "token", "r0")


@query(ORDERS + f", hidden AS ({HIDDEN}) SELECT row, col, min(first) AS anchor_row, 1 AS anchor_col FROM cells JOIN hidden ON row BETWEEN first AND last + 90 GROUP BY row, col")
def link_first_anchor(spark, sf_dir):
    held = hidden_lines(spark).select(F.col("first").alias("r0"), F.lit(1).alias("c0"), (F.col("last") + 90).alias("r1"), F.lit(2).alias("c1"), F.col("first").alias("ord"))
    return ranges.first_anchor(order_cells(spark, sf_dir), held, "ord")


# aggregates


@query(ORDERS + "SELECT 'Sheet1' AS sheet, min(row) AS r0, min(col) AS c0, max(row) AS r1, max(col) AS c1, 'A' || min(row) || ':B' || max(row) AS dimension FROM cells")
def bounds(spark, sf_dir):
    return C.bounds(order_cells(spark, sf_dir))


@query(PARTS + """SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(DISTINCT row) AS BIGINT) AS rows, CAST(count(*) FILTER (kind = 'number') AS BIGINT) AS n_number, CAST(count(*) FILTER (kind = 'text') AS BIGINT) AS n_text,
CAST(count(DISTINCT token) AS BIGINT) AS distinct_values, round(count(*) / CAST(max(row) * 6 AS DOUBLE), 4) AS density, round(count(DISTINCT token) / CAST(count(*) AS DOUBLE), 4) AS distinct_ratio FROM cells""")
def sheet_stats(spark, sf_dir):
    return C.statistics(part_cells(spark, sf_dir)).select("cells", "rows", "n_number", "n_text", "distinct_values", "density", "distinct_ratio")


@query(PARTS + "SELECT kind, CAST(count(*) AS BIGINT) AS n FROM cells GROUP BY kind")
def kind_histogram(spark, sf_dir):
    return part_cells(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


# covers


@query(ORDERS + RUNS + "SELECT row, token, c0, c1 FROM runs")
def runs(spark, sf_dir):
    return cover.runs(order_cells(spark, sf_dir)).select("row", "token", "c0", "c1")


@query(ORDERS + RUNS + "SELECT token, r0, c0, r1, c1 FROM rects")
def index_cover(spark, sf_dir):
    return cover.rectangles(order_cells(spark, sf_dir)).select("token", "r0", "c0", "r1", "c1")


@query(ORDERS + RUNS + """SELECT token, string_agg(CASE WHEN r0 = r1 AND c0 = c1 THEN chr(CAST(64 + c0 AS INTEGER)) || r0 ELSE chr(CAST(64 + c0 AS INTEGER)) || r0 || ':' || chr(CAST(64 + c1 AS INTEGER)) || r1 END, ',' ORDER BY r0, c0) AS spans FROM rects GROUP BY token""")
def inverted_index(spark, sf_dir):
    return cover.whole_lines(cover.rectangles(order_cells(spark, sf_dir)).withColumn("step", F.lit(1))).select("token", "spans")


#: Spans of rects: greedy progressions of three or more, all others alone; needs WITH RECURSIVE.
SPANS = """, p AS (SELECT *, row_number() OVER w AS i, lead(r0) OVER w - r0 AS d FROM rects WHERE r0 = r1 WINDOW w AS (PARTITION BY token, c0, c1 ORDER BY r0)),
q AS (SELECT *, coalesce(d = lag(d) OVER (PARTITION BY token, c0, c1 ORDER BY i), false) AS same FROM p), g AS (SELECT *, count(*) FILTER (NOT same) OVER (PARTITION BY token, c0, c1 ORDER BY i) AS g FROM q),
e AS (SELECT *, CASE WHEN d > 1 AND max(i) OVER x - i >= 1 THEN max(i) OVER x + 1 ELSE i END AS stop FROM g WINDOW x AS (PARTITION BY token, c0, c1, g)),
walk AS (SELECT token, c0, c1, CAST(1 AS BIGINT) AS i FROM e WHERE i = 1 UNION ALL SELECT w.token, w.c0, w.c1, e.stop + 1 FROM walk w JOIN e USING (token, c0, c1, i) WHERE e.d IS NOT NULL),
spans AS (SELECT token, e.r0, z.r1, c0, c1, CASE WHEN e.stop > e.i THEN e.d ELSE 1 END AS step, CAST(z.i - e.i + 1 AS INTEGER) AS n FROM walk JOIN e USING (token, c0, c1, i) JOIN e AS z ON z.token = e.token AND z.c0 = e.c0 AND z.c1 = e.c1 AND z.i = e.stop
UNION ALL SELECT token, r0, r1, c0, c1, 1, CAST(r1 - r0 + 1 AS INTEGER) FROM rects WHERE r0 < r1) """


def sql_cost(x: str) -> str:
    """Estimated tokens of a text of letters, digits and single signs, whose spaces stand before letters or digits."""
    share = lambda pattern, per: f"coalesce(list_sum(list_transform(regexp_extract_all({x}, '{pattern}'), lambda w: CAST(ceil(length(w) / {per}.0) AS BIGINT))), 0)"
    return f"CAST({share('[A-Za-z]+', 6)} + {share('[0-9]+', 3)} + len(regexp_extract_all({x}, '[^A-Za-z0-9 ]')) AS BIGINT)"


_ADDRESS = "chr(CAST(64 + c0 AS INTEGER)) || r0 || CASE WHEN r0 = r1 AND c0 = c1 THEN '' ELSE ':' || chr(CAST(64 + c1 AS INTEGER)) || r1 END || CASE WHEN step > 1 THEN '/' || step ELSE '' END"
#: What spans cost as ranges, and what those gain that cost less so than as at most two columns of a grid.
GAINS = f""", priced AS (SELECT *, {sql_cost("token")} AS c, {sql_cost(_ADDRESS)} AS t FROM spans),
full_ AS (SELECT *, CASE WHEN step = 1 AND c > 1 THEN least(1 + n // 10, n) ELSE n END AS whole FROM priced),
gains AS (SELECT *, (c1 - c0 + 1) * (whole * (c + 1) + (n - whole) * 2) - (t + c + 2) AS gain FROM full_ WHERE n >= 3), chosen AS (SELECT * FROM gains WHERE gain > 2) """


@query("WITH RECURSIVE cells AS (SELECT CAST(event_id + 1 AS INTEGER) AS row, 1 AS col, event_type AS token FROM events)" + RUNS + SPANS + "SELECT token, r0, r1, c0, c1, step, n FROM spans")
def stride_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("s").alias("sheet"), (F.col("event_id") + 1).cast("int").alias("row"), F.lit(1).alias("col"), F.col("event_type").alias("token"))
    return cover.strides(cover.rectangles(e)).select("token", "r0", "r1", "c0", "c1", "step", "n")


@query(ORDERS + "SELECT DISTINCT row, row = 1 OR row % 10 = 0 AS labelled FROM cells")
def row_labels(spark, sf_dir):
    return cover.labels(order_cells(spark, sf_dir)).select("row", "labelled")


@query(ORDERS + """SELECT a.row, a.col, NOT (a.row = 1 OR a.row % 10 = 0) AND length(a.token) > 1 AND coalesce(a.token = b.token, false) AS ditto FROM cells a LEFT JOIN cells b ON b.row = a.row - 1 AND b.col = a.col""")
def ditto_marks(spark, sf_dir):
    return cover.dittos(order_cells(spark, sf_dir)).select("row", "col", "ditto")


@query(ORDERS + """, m AS (SELECT a.row, a.col, a.row = 1 OR a.row % 10 = 0 AS labelled, CASE WHEN NOT (a.row = 1 OR a.row % 10 = 0) AND length(a.token) > 1 AND a.token = b.token THEN '^' ELSE a.token END AS f FROM cells a LEFT JOIN cells b ON b.row = a.row - 1 AND b.col = a.col)
SELECT row, CASE WHEN any_value(labelled) THEN row || ':' ELSE '' END || string_agg(f, '|' ORDER BY col) AS line FROM m GROUP BY row""")
def grid_lines(spark, sf_dir):
    return cover.grid_lines(order_cells(spark, sf_dir)).select("row", "line")


@query("WITH RECURSIVE " + ORDERS[5:] + RUNS + SPANS + GAINS + f""", marked AS (SELECT row, col, {sql_cost("token")} AS c, row = 1 OR row % 10 = 0 AS labelled, coalesce(lag(token) OVER (PARTITION BY col ORDER BY row) = token, false) AS same FROM cells),
lines AS (SELECT row, 1 + sum(CASE WHEN same AND NOT labelled AND c > 1 THEN 2 ELSE c + 1 END) + max(CASE WHEN labelled THEN {sql_cost("CAST(row AS VARCHAR)")} + 1 ELSE 0 END) AS g FROM marked GROUP BY row),
x AS (SELECT (SELECT sum(g) FROM lines) AS grid, (SELECT sum(t + 1) FROM priced) + (SELECT sum(c + 1) FROM (SELECT DISTINCT token, c FROM priced)) AS index, (SELECT sum(gain) FROM chosen) AS gain, (SELECT count(*) FROM chosen) AS blocks),
y AS (SELECT *, CASE WHEN blocks > 0 THEN greatest(grid - gain, 0) END AS hybrid FROM x)
SELECT 'Sheet1' AS sheet, CAST(grid AS BIGINT) AS grid, CAST(index AS BIGINT) AS index, CAST(hybrid AS BIGINT) AS hybrid, CAST(blocks AS BIGINT) AS blocks,
CASE WHEN index < 0.85 * grid AND (hybrid IS NULL OR index < hybrid) THEN 'index' WHEN hybrid < 0.92 * grid THEN 'hybrid' ELSE 'grid' END AS encoding FROM y""")
def encoding_costs(spark, sf_dir):
    return cover.costs(order_cells(spark, sf_dir))


@query("WITH RECURSIVE " + ORDERS[5:] + RUNS + SPANS + GAINS + "SELECT token, r0, r1, c0, c1, step, n, CAST(gain AS BIGINT) AS gain FROM chosen")
def hybrid_blocks(spark, sf_dir):
    """The blocks of a hybrid document, with what they gain."""
    return cover.block_gains(cover.strides(cover.rectangles(order_cells(spark, sf_dir)))).select("token", "r0", "r1", "c0", "c1", "step", "n", "gain")


@query("WITH RECURSIVE " + ORDERS[5:] + RUNS + SPANS + GAINS + ", covered AS (SELECT CAST(unnest(range(r0, r1 + 1, step)) AS INTEGER) AS row, c0, c1 FROM chosen) SELECT row, col, token FROM cells c WHERE NOT EXISTS (SELECT 1 FROM covered x WHERE x.row = c.row AND c.col BETWEEN c0 AND c1)")
def hybrid_residual(spark, sf_dir):
    """What a hybrid document writes as a grid."""
    cells = written(order_cells(spark, sf_dir), "cells")
    return cover.residual(cells, cover.block_gains(cover.strides(cover.rectangles(cells)))).select("row", "col", "token")


@query(ORDERS + "SELECT row, col, token FROM cells")
def decoded_hybrid(spark, sf_dir):
    """Cells read back from blocks and grid lines."""
    return document.decoded(document.encoded(order_cells(spark, sf_dir), "hybrid")).select("row", "col", "token")


@query(ORDERS + "SELECT row, col, token FROM cells")
def decoded_index(spark, sf_dir):
    return document.decoded(document.encoded(order_cells(spark, sf_dir), "index")).select("row", "col", "token")


@query(ORDERS + "SELECT row, col, token FROM cells")
def decoded_grid(spark, sf_dir):
    return document.decoded(document.encoded(order_cells(spark, sf_dir), "grid")).select("row", "col", "token")


def mismatches(cells: DataFrame, back: DataFrame) -> DataFrame:
    """How many cells are in one of two relations but not in the other, repeated ones counted; each is read once."""
    cell = ["sheet", "row", "col", "token"]
    both = cells.select(*cell, F.lit(1).alias("n")).unionAll(back.select(*cell, F.lit(-1).alias("n")))
    return both.groupBy(cell).agg(F.abs(F.sum("n")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("mismatches"))


@query("SELECT CAST(0 AS BIGINT) AS mismatches")
def encode_decode_roundtrip(spark, sf_dir):
    cells = written(part_cells(spark, sf_dir), "cells")
    return mismatches(cells, document.decoded(document.encoded(cells, "grid")))


@query("SELECT CAST(0 AS BIGINT) AS mismatches")
def index_decode_roundtrip(spark, sf_dir):
    cells = written(order_cells(spark, sf_dir), "cells")
    return mismatches(cells, document.decoded(document.encoded(cells, "index")))


# scalar functions


@query("""WITH n AS (SELECT o_orderkey, CAST(1 + o_orderkey % 18278 AS INTEGER) AS c FROM orders) SELECT o_orderkey, c, CASE WHEN c <= 26 THEN chr(64 + c) WHEN c <= 702 THEN chr(65 + (c - 27) // 26) || chr(65 + (c - 27) % 26)
ELSE chr(65 + (c - 703) // 676) || chr(65 + ((c - 703) // 26) % 26) || chr(65 + (c - 703) % 26) END AS letters, c AS back FROM n""")
def column_letters(spark, sf_dir):
    out = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 18278).cast("int").alias("c")).withColumn("letters", coords.column_letters(F.col("c")))
    return out.withColumn("back", coords.column_index(F.col("letters")))


@query("SELECT o_orderkey, CAST(o_orderkey + 1 AS INTEGER) AS row, 3 AS col, 'C' || (o_orderkey + 1) AS coord, '$C$' || (o_orderkey + 1) AS absolute FROM orders")
def coordinate_split(spark, sf_dir):
    out = table(spark, sf_dir, "orders").select("o_orderkey", coords.coordinate(F.col("o_orderkey") + 1, F.lit(3)).alias("coord"))
    at = coords.split_coordinate(F.col("coord"))
    return out.select("o_orderkey", "coord", at["row"].alias("row"), at["col"].alias("col"), coords.absolute(F.col("coord")).alias("absolute"))


@query("SELECT p_partkey, CAST(p_partkey + 1 AS INTEGER) AS r0, CAST(p_partkey % 26 + 1 AS INTEGER) AS c0, CAST(p_partkey + p_size AS INTEGER) AS r1, CAST(p_partkey % 26 + 27 AS INTEGER) AS c1 FROM part")
def range_parse(spark, sf_dir):
    a = coords.coordinate(F.col("p_partkey") + 1, F.col("p_partkey") % 26 + 1)
    b = coords.coordinate(F.col("p_partkey") + F.col("p_size"), F.col("p_partkey") % 26 + 27)
    return table(spark, sf_dir, "part").select("p_partkey", coords.range_bounds(F.concat(a, F.lit(":"), b)).alias("b")).select("p_partkey", "b.r0", "b.c0", "b.r1", "b.c1")


@query("SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS us, CAST(epoch_us(ts) AS BIGINT) // 1000 AS back_ms FROM events")
def serial_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), dates.to_serial(F.col("ts")).alias("serial"))
    e = e.withColumn("whole", dates.to_serial(F.timestamp_millis(F.floor(F.col("us") / 1000))))
    return e.select("event_id", "us", F.expr("0L + bround((whole - 25569) * 86400000)").cast("long").alias("back_ms"))


@query("""SELECT o_orderkey, CAST(o_orderkey % 50000 AS INTEGER) AS serial, CAST(epoch_us(TIMESTAMP '1899-12-30' + to_days(CAST(o_orderkey % 50000 AS INTEGER) + CASE WHEN o_orderkey % 50000 > 0 AND o_orderkey % 50000 < 60 THEN 1 ELSE 0 END)) AS BIGINT) AS us,
CAST(epoch_us(TIMESTAMP '1904-01-01' + to_days(CAST(o_orderkey % 50000 AS INTEGER))) AS BIGINT) AS us1904 FROM orders""")
def serial_to_timestamp(spark, sf_dir):
    """Serials of both epochs, with the day that the 1900 system has too many."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 50000).cast("int").alias("serial"))
    return o.withColumns({"us": dates.serial_micros(F.col("serial").cast("double")), "us1904": dates.serial_micros(F.col("serial").cast("double"), True)})


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') ELSE '' END AS iso,
CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS days, CAST(hour(ts) * 3600000000 + minute(ts) * 60000000 + epoch_us(ts) % 60000000 AS BIGINT) AS time_us FROM events""")
def iso_and_civil_dates(spark, sf_dir):
    """Timestamps as ISO text, as civil dates and back, and times of parts of days."""
    ts, us = F.col("ts"), F.unix_micros(F.col("ts").cast("timestamp"))
    civil = dates.civil_from_days(F.floor(us / 86_400_000_000))
    out = table(spark, sf_dir, "events").select("event_id", dates.iso_text(ts).alias("iso"), civil.alias("c"), dates.days_to_time(F.pmod(us, F.lit(86_400_000_000)) / 86_400_000_000).alias("time_us"))
    return out.select("event_id", "iso", "c.year", "c.month", "c.day", dates.days_from_civil(F.col("c.year"), F.col("c.month"), F.col("c.day")).alias("days"), "time_us")


@query("""SELECT p_partkey, 'number' AS kind, CAST(p_partkey AS DOUBLE) AS number, '-' AS text, CAST(p_retailprice AS VARCHAR) AS written FROM part UNION ALL SELECT p_partkey, 'text', -1.0, p_type, printf('%.16g', p_retailprice / 8.0) FROM part""")
def token_values(spark, sf_dir):
    """Tokens read back as typed values, and numbers as they are written into cells."""
    p = table(spark, sf_dir, "part")
    key = p.select("p_partkey", tokens.token_value(tokens.token(F.col("p_partkey"), "bigint")).alias("v"), tokens.token(F.col("p_retailprice"), "double").alias("written"))
    kind = p.select("p_partkey", tokens.token_value(tokens.token(F.col("p_type"), "string")).alias("v"), tokens.number_text(F.col("p_retailprice") / 8).alias("written"))
    return key.union(kind).select("p_partkey", "v.kind", F.coalesce("v.number", F.lit(-1.0)).alias("number"), F.coalesce("v.text", F.lit("-")).alias("text"), "written")


@query("""SELECT n_name AS sheet, CASE WHEN count(c_custkey) = 0 THEN 'A1:A1' ELSE 'A' || min(c_custkey + 1) || ':B' || max(c_custkey + 1) END AS dimension FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name""")
def bounds_of_all_sheets(spark, sf_dir):
    """Bounding boxes of sheets, some without cells."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("sheet"))
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return C.bounds(rich.select("sheet", (F.col("c_custkey") + 1).cast("int").alias("row"), F.explode(F.array(F.lit(1), F.lit(2))).alias("col")), nations).select("sheet", "dimension")


@query("""WITH l AS (SELECT CAST(s_suppkey + 1 AS INTEGER) AS r0, CAST(s_suppkey + 1 + s_nationkey % 3 AS INTEGER) AS r1, 'https://example.org/' || s_suppkey AS link FROM supplier),
x AS (SELECT CAST(unnest(range(r0, r1 + 1)) AS INTEGER) AS row, link FROM l), y AS (SELECT row, c AS col, min(link) AS link FROM x, (SELECT unnest([1, 2]) AS c) GROUP BY ALL),
s AS (SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS row, 2 AS col, p_name AS value FROM part)
SELECT coalesce(s.row, y.row) AS row, coalesce(s.col, y.col) AS col, coalesce(value, link) AS value, coalesce(link, '-') AS link FROM s FULL JOIN y ON s.row = y.row AND s.col = y.col""")
def linked_cells(spark, sf_dir):
    """Links over ranges, given to each of their cells; cells without a value take the link."""
    links = table(spark, sf_dir, "supplier").selectExpr("'Sheet1' AS sheet", "int(s_suppkey + 1) AS r0", "1 AS c0", "int(s_suppkey + 1 + s_nationkey % 3) AS r1", "2 AS c1", "'https://example.org/' || s_suppkey AS target", "string(null) AS location")
    cells = C.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"]).select(F.lit("Sheet1").alias("sheet"), "row", F.lit(2).alias("col"), F.col("p_name").alias("value"))
    return C.linked(cells, links).select("row", "col", "value", F.coalesce("link", F.lit("-")).alias("link"))


@query("""WITH r AS (SELECT n_name AS sheet, n_regionkey % 2 = 1 AS zero, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT sheet, CAST(c_custkey + 1 AS INTEGER) AS row FROM r WHERE CASE WHEN c_custkey % 3 = 0 THEN c_acctbal < 0 ELSE zero END""")
def hidden_by_default(spark, sf_dir):
    """Rows hidden by their settings, or by the default of their sheet if they have none."""
    nations = table(spark, sf_dir, "nation")
    who = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("sheet"), (F.col("c_custkey") + 1).cast("int").alias("row"), "c_custkey", "c_acctbal")
    own = who.where("c_custkey % 3 = 0").select("sheet", "row", (F.col("c_acctbal") < 0).alias("hidden"))
    return C.hidden_rows(who, own, nations.select(F.col("n_name").alias("sheet"), (F.col("n_regionkey") % 2 == 1).alias("zero_height")))


@query("SELECT event_id, 'datetime' AS kind, CAST(epoch_us(ts) AS BIGINT) AS us FROM events")
def iso_parse(spark, sf_dir):
    text = F.replace(tokens.datetime_token(F.col("ts")), F.lit(" "), F.lit("T"))
    return table(spark, sf_dir, "events").select("event_id", dates.parse_iso(text).alias("p")).select("event_id", "p.kind", "p.us")


@query(r"""SELECT doc_id, md5(CASE WHEN text = '' OR regexp_matches(text, '^["#@=\s]|\s$|[|\x00-\x1F\x7F]') THEN '"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r') || '"' ELSE text END) AS digest FROM documents""")
def text_token_quoting(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tokens.text_token(F.col("text")).cast("binary")).alias("digest"))


@query("""WITH c AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS ch FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS x FROM documents)),
k AS (SELECT *, unicode(ch) AS u, lead(unicode(ch)) OVER w AS following, lag(unicode(ch)) OVER w AS before FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT *, CASE WHEN u BETWEEN 65 AND 90 OR u BETWEEN 97 AND 122 THEN 'L' WHEN u BETWEEN 48 AND 57 THEN 'D' WHEN u <= 127 THEN ch END AS kind FROM k),
runs AS (SELECT doc_id, kind, count(*) AS n, arg_max(following, i) AS following FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS g FROM t WHERE kind IS NOT NULL) GROUP BY doc_id, kind, g),
a AS (SELECT doc_id, sum(CASE WHEN kind = 'L' THEN ceil(n / 6.0) WHEN kind = 'D' THEN ceil(n / 3.0) WHEN kind = ' ' AND n = 1 AND coalesce(following BETWEEN 48 AND 57 OR following BETWEEN 65 AND 90 OR following BETWEEN 97 AND 122, false) THEN 0 ELSE ceil(n / 4.0) END) AS cost FROM runs GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS cost FROM t WHERE u >= 2048 OR (u BETWEEN 128 AND 2047 AND NOT coalesce(before BETWEEN 65 AND 90 OR before BETWEEN 97 AND 122, false)) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(a.cost, 0) + coalesce(b.cost, 0) AS BIGINT) AS cost FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def text_token_costs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.token_cost(F.col("text")).alias("cost"))


@query(r"""SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n, CAST(any_value(CAST(ceil(len(regexp_extract(o_orderpriority, '[A-Z]+')) / 6.0) AS BIGINT)) AS BIGINT) AS letters FROM orders GROUP BY 1""")
def priority_costs(spark, sf_dir):
    letters = tokens.token_cost(F.regexp_extract("o_orderpriority", "[A-Z]+", 0))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"), F.max(letters).alias("letters"))


@query("SELECT p_partkey, '=F' || (p_partkey + 1) || '*$E' || (p_partkey + 1) || '+SUM(A:A)' AS filled, '=F' || (p_partkey + 1) || '*$E' || (p_partkey + 1) || '+SUM(A:A)' AS translated, true AS sideways, false AS downwards FROM part")
def formula_fill(spark, sf_dir):
    base, by = F.lit("=F2*$E2+SUM(A:A)"), (F.col("p_partkey") - 1).cast("int")
    out = table(spark, sf_dir, "part").select("p_partkey", formula.formula_fill(base, by, F.lit(0)).alias("filled"), formula.formula_translate(base, by, F.lit(0)).alias("translated"), formula.formula_fill_flags(base).alias("f"))
    return out.select("p_partkey", "filled", "translated", "f.sideways", "f.downwards")


@query("SELECT 'FUNC' AS type, CAST(2 * count(*) AS BIGINT) AS n FROM part UNION ALL SELECT 'OPERAND', CAST(3 * count(*) AS BIGINT) FROM part UNION ALL SELECT 'OPERATOR-INFIX', CAST(count(*) AS BIGINT) FROM part UNION ALL SELECT 'SEP', CAST(count(*) AS BIGINT) FROM part")
def formula_tokens(spark, sf_dir):
    text = F.concat(F.lit("=ROUND(E"), F.col("p_partkey"), F.lit("*F"), F.col("p_partkey"), F.lit(",2)"))
    return table(spark, sf_dir, "part").select(F.explode(formula.formula_tokens(text)).alias("t")).groupBy("t.type").agg(F.count("*").alias("n"))


@query("SELECT CAST(1 AS BIGINT) AS templates, CAST(count(*) AS BIGINT) AS formulas FROM part")
def formula_groups(spark, sf_dir):
    row = (F.col("p_partkey") + 1).cast("int")
    text = F.concat(F.lit("=E"), row, F.lit("*F"), row, F.lit('&"E2"'))
    held = table(spark, sf_dir, "part").select(formula.formula_canonical(text, row, F.lit(7)).alias("template"))
    return held.agg(F.count_distinct("template").alias("templates"), F.count("*").alias("formulas"))


# mutations

_NATION = "WITH rows AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS row, * FROM nation), cells AS (SELECT row, 1 AS col, CAST(n_nationkey AS VARCHAR) AS token FROM rows UNION ALL SELECT row, 2, n_name FROM rows UNION ALL SELECT row, 3, CAST(n_regionkey AS VARCHAR) FROM rows) "


def nation_cells(spark, sf_dir):
    return C.sheetify(table(spark, sf_dir, "nation"), ["n_nationkey"])


@query(_NATION + "SELECT CASE WHEN row >= 5 THEN row + 3 ELSE row END AS row, col, token FROM cells")
def insert_rows(spark, sf_dir):
    return C.shifted(nation_cells(spark, sf_dir), "row", 5, 3).select("row", "col", "token")


@query(_NATION + "SELECT row, CASE WHEN col >= 2 THEN col - 1 ELSE col END AS col, token FROM cells WHERE col <> 2")
def delete_columns(spark, sf_dir):
    return C.shifted(nation_cells(spark, sf_dir), "col", 2, -1).select("row", "col", "token")


@query(_NATION + "SELECT row + 4 AS row, col, token FROM cells WHERE row BETWEEN 2 AND 3 AND col <= 2 UNION ALL SELECT row, col, token FROM cells WHERE NOT (row BETWEEN 2 AND 3 AND col <= 2) AND NOT (row BETWEEN 6 AND 7 AND col <= 2)")
def move_range(spark, sf_dir):
    return C.moved(nation_cells(spark, sf_dir), "A2:B3", 4, 0).select("row", "col", "token")


@query(_NATION + "SELECT row, col, token FROM cells WHERE NOT (row BETWEEN 2 AND 4 AND col BETWEEN 1 AND 2) OR row = 2 AND col = 1")
def merge_cells(spark, sf_dir):
    return C.merged(nation_cells(spark, sf_dir), "A2:B4").select("row", "col", "token")


@query(_NATION + "SELECT row, col, token FROM cells UNION ALL SELECT row + (SELECT max(row) FROM rows), col, token FROM cells")
def append_rows(spark, sf_dir):
    cells = nation_cells(spark, sf_dir)
    return C.appended(cells, cells).select("row", "col", "token")


@query("SELECT 'Sheet1' AS sheet, CAST(user_id AS INTEGER) AS row, 1 AS col, arg_max(event_type, event_id) AS token FROM events GROUP BY user_id")
def last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("Sheet1").alias("sheet"), F.col("user_id").cast("int").alias("row"), F.lit(1).alias("col"), F.col("event_type").alias("token"), F.col("event_id").alias("seq"))
    return C.last_wins(e).select("sheet", "row", "col", "token")


@query(_NATION + ", notes AS (SELECT CAST(10 * k AS INTEGER) AS row, 2 AS col, 'note ' || k AS comment FROM range(1, 6) t(k)) SELECT coalesce(c.row, n.row) AS row, coalesce(c.col, n.col) AS col, token, comment FROM cells c FULL JOIN notes n ON c.row = n.row AND c.col = n.col")
def overlay_outer_join(spark, sf_dir):
    notes = spark.range(1, 6).select(F.lit("Sheet1").alias("sheet"), (F.col("id") * 10).cast("int").alias("row"), F.lit(2).alias("col"), F.concat(F.lit("note "), F.col("id")).alias("comment"))
    return C.overlay(nation_cells(spark, sf_dir), notes, "comment").select("row", "col", "token", "comment")


# ranges

_RANGES = "WITH r AS (SELECT p_partkey AS k, CAST(p_partkey % 50 + 1 AS INTEGER) AS r0, CAST(p_size AS INTEGER) AS c0, CAST(p_partkey % 50 + p_size AS INTEGER) AS r1, CAST(p_size + 3 AS INTEGER) AS c1 FROM part) "


def part_ranges(spark, sf_dir):
    p = F.col("p_partkey") % 50
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (p + 1).cast("int").alias("r0"), F.col("p_size").cast("int").alias("c0"), (p + F.col("p_size")).cast("int").alias("r1"), (F.col("p_size") + 3).cast("int").alias("c1"))


@query(_RANGES + "SELECT a.k, least(a.r0, b.r0) AS r0, least(a.c0, b.c0) AS c0, greatest(a.r1, b.r1) AS r1, greatest(a.c1, b.c1) AS c1, greatest(a.r0, b.r0) <= least(a.r1, b.r1) AND greatest(a.c0, b.c0) <= least(a.c1, b.c1) AS meet FROM r a JOIN r b ON b.k = a.k + 1")
def range_union_intersect(spark, sf_dir):
    r = part_ranges(spark, sf_dir)
    a = r.select("k", F.struct(*ranges.SIDES).alias("a"))
    b = r.select((F.col("k") - 1).alias("k"), F.struct(*ranges.SIDES).alias("b"))
    return a.join(b, "k").select("k", ranges.union("a", "b").alias("u"), ranges.intersection("a", "b").isNotNull().alias("meet")).select("k", "u.r0", "u.c0", "u.r1", "u.c1", "meet")


@query(_RANGES + "SELECT DISTINCT CAST(rr AS INTEGER) AS row, CAST(cc AS INTEGER) AS col FROM r, unnest(range(r0, r1 + 1)) t(rr), unnest(range(c0, c1 + 1)) u(cc)")
def ranges_to_cells(spark, sf_dir):
    return ranges.expanded(part_ranges(spark, sf_dir))


@query(_RANGES + "SELECT c0, min(r0) AS r0, max(r0) AS r1, c0 AS c1 FROM r GROUP BY c0")
def collapse_addresses(spark, sf_dir):
    return ranges.collapsed(part_ranges(spark, sf_dir).select(F.col("r0").alias("row"), F.col("c0").alias("col")))


@query(_RANGES + """, n AS (SELECT c0, r0, r1, CASE WHEN r0 > coalesce(max(r1) OVER (PARTITION BY c0 ORDER BY r0, r1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, r0 - 1) THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY c0 ORDER BY r0, r1 ROWS UNBOUNDED PRECEDING) AS grp FROM n) SELECT c0, min(r0) AS r0, max(r1) AS r1 FROM g GROUP BY c0, grp""")
def interval_merge(spark, sf_dir):
    return ranges.merged_intervals(part_ranges(spark, sf_dir), "r0", "r1", ["c0"]).select("c0", "r0", "r1")


# filters, validations, conditional formats


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def autofilter_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(filters.values(F.col("o_orderstatus"), ["F", "P"])).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000")
def custom_filter_between(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(filters.custom(F.col("o_totalprice"), [("greaterThanOrEqual", 100000), ("lessThan", 200000)], both=True)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_type FROM part WHERE upper(p_type) LIKE '%BRASS' OR regexp_matches(p_name, '(?i)^.a.*$')")
def custom_filter_wildcards(spark, sf_dir):
    held = filters.custom(F.col("p_type"), [("equal", "*brass")]) | filters.custom(F.col("p_name"), [("equal", "?a*")])
    return table(spark, sf_dir, "part").where(held).select("p_partkey", "p_type")


@query("SELECT event_id FROM events WHERE year(ts) = 2024 AND month(ts) = 1 AND day(ts) = 7")
def date_group_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(filters.date_group(F.col("ts"), year=2024, month=1, day=7)).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def dynamic_above_average(spark, sf_dir):
    return filters.dynamic(table(spark, sf_dir, "orders"), "o_totalprice", "aboveAverage").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE quarter(o_orderdate) = 2")
def dynamic_quarter(spark, sf_dir):
    return filters.dynamic(table(spark, sf_dir, "orders"), "o_orderdate", "Q2").select("o_orderkey")


@query("SELECT event_id FROM events WHERE date_trunc('week', ts + INTERVAL 1 DAY) = date_trunc('week', TIMESTAMP '2024-01-17' + INTERVAL 1 DAY)")
def dynamic_this_week(spark, sf_dir):
    return filters.dynamic(table(spark, sf_dir, "events"), "ts", "thisWeek", "2024-01-17").select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, rank() OVER (ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 10")
def top_ten(spark, sf_dir):
    return filters.top(table(spark, sf_dir, "orders"), "o_totalprice", 10).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM (SELECT *, rank() OVER (ORDER BY p_retailprice) AS r FROM part) WHERE r <= (SELECT ceil(count(*) * 5 / 100.0) FROM part)")
def bottom_percent(spark, sf_dir):
    return filters.top(table(spark, sf_dir, "part"), "p_retailprice", 5, percent=True, bottom=True).select("p_partkey")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderstatus, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def sort_custom_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return C.numbered(o, [*filters.sort_keys([("o_orderstatus", False, ["P", "O"]), ("o_totalprice", True, None)]), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@query("SELECT CAST(count(*) FILTER (l_quantity BETWEEN 1 AND 30 AND l_quantity = floor(l_quantity)) AS BIGINT) AS whole, CAST(count(*) FILTER (l_shipdate >= DATE '2024-03-01') AS BIGINT) AS late, CAST(count(*) FILTER (l_returnflag IN ('A', 'R')) AS BIGINT) AS listed FROM lineitem")
def validations(spark, sf_dir):
    v = lambda name, *args, **more: F.count_if(filters.valid(F.col(name), *args, **more))
    return table(spark, sf_dir, "lineitem").agg(v("l_quantity", "whole", "between", 1, 30).alias("whole"), v("l_shipdate", "date", "greaterThanOrEqual", "2024-03-01").alias("late"), v("l_returnflag", "list", listed=["A", "R"]).alias("listed"))


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1 AS hit FROM customer")
def cf_duplicate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("pair", F.concat_ws("/", "c_nationkey", "c_mktsegment"))
    return filters.duplicated(c, "pair").select("c_custkey", "hit")


@query("SELECT c_custkey, c_acctbal > (SELECT avg(c_acctbal) + stddev_pop(c_acctbal) FROM customer) AS hit FROM customer")
def cf_above_average(spark, sf_dir):
    return filters.above_average(table(spark, sf_dir, "customer"), "c_acctbal", deviations=1).select("c_custkey", "hit")


@query("SELECT p_partkey, CAST(CAST(p_size >= 1 + 49 * 0.33 AS INTEGER) + CAST(p_size >= 1 + 49 * 0.67 AS INTEGER) AS INTEGER) AS icon FROM part WHERE (SELECT min(p_size) = 1 AND max(p_size) = 50 FROM part)")
def icon_set(spark, sf_dir):
    return filters.icon_set(table(spark, sf_dir, "part"), "p_size", [("percent", 0), ("percent", 33), ("percent", 67)]).select("p_partkey", "icon")


@query("SELECT p_partkey, round(10 + 80 * (p_size - (SELECT min(p_size) FROM part)) / CAST((SELECT max(p_size) - min(p_size) FROM part) AS DOUBLE), 4) AS bar FROM part")
def data_bar(spark, sf_dir):
    return filters.data_bar(table(spark, sf_dir, "part"), "p_size").select("p_partkey", "bar")


@query("SELECT p_partkey, printf('%02X00%02X', CAST(round(255.0 * (p_size - (SELECT min(p_size) FROM part)) / (SELECT max(p_size) - min(p_size) FROM part)) AS INTEGER), CAST(round(255.0 - 255.0 * (p_size - (SELECT min(p_size) FROM part)) / (SELECT max(p_size) - min(p_size) FROM part)) AS INTEGER)) AS color FROM part")
def color_scale(spark, sf_dir):
    return filters.color_scale(table(spark, sf_dir, "part"), "p_size", [("min", None), ("max", None)], ["0000FF", "FF0000"]).select("p_partkey", "color")


# totals and pivots


@query("SELECT CAST(count(l_quantity) AS BIGINT) AS l_quantity_count, round(sum(l_extendedprice), 2) AS price_sum, round(avg(l_discount), 6) AS discount_avg, max(l_tax) AS l_tax_max FROM lineitem")
def totals_row(spark, sf_dir):
    out = pivot.totals(table(spark, sf_dir, "lineitem"), {"l_quantity": "count", "l_extendedprice": "sum", "l_discount": "average", "l_tax": "max"})
    return out.select("l_quantity_count", F.round("l_extendedprice_sum", 2).alias("price_sum"), F.round("l_discount_average", 6).alias("discount_avg"), "l_tax_max")


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY 1")
def pivot_sum(spark, sf_dir):
    out = pivot.pivot(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", "sum", ["F", "O"])
    return out.select("l_returnflag", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


_FLAGS = "WITH g AS (SELECT l_returnflag AS flag, l_linestatus AS status, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2) "


def flag_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(l_quantity) AS BIGINT) AS n, CAST(2 - (l_returnflag IS NOT NULL)::INT - (l_linestatus IS NOT NULL)::INT AS INTEGER) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def pivot_rollup(spark, sf_dir):
    return pivot.with_totals(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"l_quantity": "count"}).select("l_returnflag", "l_linestatus", F.col("l_quantity_count").alias("n"), "level")


@query(_FLAGS + "SELECT flag, status, round(n / sum(n) OVER (), 8) AS shown FROM g")
def pivot_percent_of_total(spark, sf_dir):
    return pivot.shown_as(flag_counts(spark, sf_dir), "n", "percentOfTotal", "flag", "status").select("flag", "status", F.round("shown", 8).alias("shown"))


@query(_FLAGS + "SELECT flag, status, CAST(sum(n) OVER (PARTITION BY status ORDER BY flag) AS BIGINT) AS shown FROM g")
def pivot_running_total(spark, sf_dir):
    return pivot.shown_as(flag_counts(spark, sf_dir), "n", "runTotal", "flag", "status").select("flag", "status", "shown")


@query(_FLAGS + "SELECT flag, status, round(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY flag) * sum(n) OVER (PARTITION BY status)), 8) AS shown FROM g")
def pivot_index(spark, sf_dir):
    return pivot.shown_as(flag_counts(spark, sf_dir), "n", "index", "flag", "status").select("flag", "status", F.round("shown", 8).alias("shown"))


@query(_FLAGS + "SELECT flag, status, CAST(n - max(n) FILTER (flag = 'A') OVER (PARTITION BY status) AS BIGINT) AS shown FROM g")
def pivot_difference(spark, sf_dir):
    return pivot.shown_as(flag_counts(spark, sf_dir), "n", "difference", "flag", "status", "A").select("flag", "status", "shown")


@query("SELECT CAST(month(o_orderdate) AS INTEGER) AS grp, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def pivot_group_months(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(pivot.date_group(F.col("o_orderdate"), "months").alias("grp")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT CASE WHEN p_size < 10 THEN '<10' WHEN p_size >= 40 THEN '>=40' ELSE CAST(CAST(10 + floor((p_size - 10) / 10.0) * 10 AS BIGINT) AS VARCHAR) END AS grp, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def pivot_group_range(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(pivot.range_group(F.col("p_size"), 10, 40, 10).alias("grp")).agg(F.count("*").alias("n"))


@query("SELECT CAST(count(DISTINCT p_brand) AS BIGINT) AS items, false AS contains_blank, false AS contains_number, true AS contains_string FROM part")
def shared_item_flags(spark, sf_dir):
    return pivot.item_flags(table(spark, sf_dir, "part"), "p_brand").select("items", "contains_blank", "contains_number", "contains_string")


@query("""SELECT o_orderkey, c.c_name, n.n_name, r.r_name FROM orders JOIN customer c ON c_custkey = o_custkey JOIN nation n ON n_nationkey = c_nationkey JOIN region r ON r_regionkey = n_regionkey""")
def star_style_join(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


# events


@query("SELECT date_trunc('day', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    return stream.tumbling(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH b AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 DAY OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM b) SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, grp""")
def session_windows(spark, sf_dir):
    return stream.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# units, colours, passwords


@query("""SELECT p_partkey, CAST(trunc(p_retailprice * 9525) AS BIGINT) AS pixel_emu, CAST(trunc(p_size * 360000) AS BIGINT) AS emu, round_even(p_size * 1000 / 360000, 4) AS cm, CAST(p_size * 1440 AS BIGINT) AS dxa,
p_size * 72 / 96 AS points, CAST(ceil(p_size * 96 / 72) AS BIGINT) AS pixels, CAST(p_size * 60000 AS BIGINT) AS angle, round_even(p_size * 1001 / 60000, 2) AS degrees FROM part""")
def unit_conversions(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", units.to_emu(F.col("p_retailprice"), units.EMU_PIXEL).alias("pixel_emu"), units.to_emu(size, units.EMU_CM).alias("emu"), units.from_emu(size * 1000, units.EMU_CM).alias("cm"),
        units.inch_to_dxa(size).alias("dxa"), units.pixels_to_points(size).alias("points"), units.points_to_pixels(size).alias("pixels"), units.degrees_to_angle(size).alias("angle"), units.angle_to_degrees(size * 1001).alias("degrees"),
    )


@query("SELECT p_partkey, right(printf('FF%06X', p_partkey * 7919 % 16777216), 6) AS short FROM part")
def short_colours(spark, sf_dir):
    colour = F.concat(F.lit("FF"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", units.short_colour(colour).alias("short"))


@query("""WITH p AS (SELECT p_partkey, p_name, [CAST(ascii(p_name[i]) AS BIGINT) << i FOR i IN range(1, length(p_name) + 1)] AS v FROM part)
SELECT p_partkey, CASE WHEN length(p_name) <= 40 THEN printf('%X', xor(xor(coalesce(list_reduce([(x & 32767) | (x >> 15) FOR x IN v], lambda a, b: xor(a, b)), 0), length(p_name)), 52811)) END AS hash FROM p""")
def password_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", units.password_hash(F.col("p_name")).alias("hash"))


@query("""WITH r AS (SELECT p_partkey AS k, CAST(p_partkey AS INTEGER) AS r0, p_size AS c0, CAST(p_partkey + p_size AS INTEGER) AS r1, p_size + 3 AS c1 FROM part)
SELECT k, CASE WHEN r0 - 9 > 0 AND c0 - 2 > 0 THEN concat_ws(',', r0 - 9, c0 - 2, r1 - 9, c1 - 2) END AS shifted, concat_ws(',', r0, c0 - 1, r1 + 2, c1 + 1) AS grown FROM r""")
def range_shift(spark, sf_dir):
    key = F.col("p_partkey")
    r = table(spark, sf_dir, "part").select(key.alias("k"), key.cast("int").alias("r0"), F.col("p_size").alias("c0"), (key + F.col("p_size")).cast("int").alias("r1"), (F.col("p_size") + 3).alias("c1"))
    told = lambda x: F.concat_ws(",", *[x[s].cast("string") for s in ranges.SIDES])
    moved = ranges.shifted(-9, -2)
    return r.select("k", F.when(moved.isNotNull(), told(moved)).alias("shifted"), told(ranges.grown(1, 2, 1, 0)).alias("grown"))


@query("""WITH r AS (SELECT CAST(p_partkey AS INTEGER) AS r0, p_size AS c0, CAST(p_partkey + p_size AS INTEGER) AS r1, p_size + 3 AS c1 FROM part)
SELECT 'bottom' AS side, r1 AS row, CAST(unnest(range(c0, c1 + 1)) AS INTEGER) AS col FROM r UNION ALL SELECT 'left', CAST(unnest(range(r0, r1 + 1)) AS INTEGER), c0 FROM r""")
def range_edges(spark, sf_dir):
    key = F.col("p_partkey")
    r = table(spark, sf_dir, "part").select(key.cast("int").alias("r0"), F.col("p_size").alias("c0"), (key + F.col("p_size")).cast("int").alias("r1"), (F.col("p_size") + 3).alias("c1"))
    return ranges.edge(r, "bottom").select(F.lit("bottom").alias("side"), "row", "col").union(ranges.edge(r, "left").select(F.lit("left"), "row", "col"))


# texts as typed, names, print settings


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_retailprice WHEN 1 THEN -p_size WHEN 3 THEN p_size * 100.0 WHEN 4 THEN p_size END AS number,
CASE p_partkey % 7 WHEN 5 THEN (p_size + 0.5) / 100 WHEN 6 THEN p_size / 100 END AS percentage FROM part""")
def text_numbers(spark, sf_dir):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    forms = [F.col("p_retailprice").cast("string"), F.concat(F.lit("-"), size), F.concat(F.lit("0"), size), F.concat(size, F.lit("e2")), F.concat(size, F.lit(".")), F.concat(size, F.lit(".5%")), F.concat(size, F.lit(" %"))]
    typed = F.coalesce(*[F.when(kind == i, form) for i, form in enumerate(forms)])
    return table(spark, sf_dir, "part").select("p_partkey", texts.number(typed).alias("number"), texts.percentage(typed).alias("percentage"))


@query("SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN ((hour(ts) * 60 + minute(ts)) * 60 + second(ts)) * 1000000 WHEN 1 THEN (hour(ts) * 60 + minute(ts)) * 60000000 ELSE -1 END AS BIGINT) AS clock, CAST(minute(ts) * 60000000 + microsecond(ts) AS BIGINT) AS fine FROM events")
def text_times(spark, sf_dir):
    ts, kind = F.col("ts"), F.col("event_id") % 3
    clock = F.when(kind == 0, F.date_format(ts, "HH:mm:ss")).when(kind == 1, F.date_format(ts, "HH:mm")).otherwise(F.date_format(ts, "HH:mm:"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(texts.time_of_day(clock), F.lit(-1)).cast("long").alias("clock"), texts.time_of_day(F.date_format(ts, "mm:ss.SSSSSS")).alias("fine"))


@query("""WITH b AS (SELECT DISTINCT p_type, p_brand FROM part), w AS (SELECT DISTINCT p_type, 'brand#' || (p_partkey % 9) AS wanted FROM part)
SELECT p_type, wanted, wanted || CASE WHEN bool_or(lower(p_brand) = wanted) THEN CAST(1 + max(coalesce(TRY_CAST(substr(p_brand, length(wanted) + 1) AS BIGINT), 0)) FILTER (starts_with(lower(p_brand), wanted)) AS VARCHAR) ELSE '' END AS name
FROM w JOIN b USING (p_type) GROUP BY p_type, wanted""")
def free_sheet_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.groupBy("p_type").agg(F.collect_set("p_brand").alias("names"))  # a few brands
    wanted = part.select("p_type", F.concat(F.lit("brand#"), (F.col("p_partkey") % 9).cast("string")).alias("wanted")).distinct()
    return wanted.join(names, "p_type").select("p_type", "wanted", texts.free_name(F.col("names"), F.col("wanted")).alias("name"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN replace(p_name, '''', '''''') END AS sheet, CASE WHEN p_partkey % 4 IN (1, 3) THEN p_size || ':' || (p_size + 3) END AS rows,
CASE WHEN p_partkey % 4 IN (2, 3) THEN 'A' END AS first_col, CASE WHEN p_partkey % 4 IN (2, 3) THEN 'BC' END AS last_col, 'A' || p_size || ':C' || (p_size + 9) || ' E2 7:9' AS areas FROM part""")
def print_settings(spark, sf_dir):
    n, size = F.col("p_partkey") % 4, F.col("p_size")
    sheet = F.concat(coords.quote_sheet(F.col("p_name")), F.lit("!"))
    rows, cols = F.concat(sheet, F.format_string("$%d:$%d", size, size + 3)), F.concat(sheet, F.lit("$A:$BC"))
    titles = F.when(n == 1, rows).when(n == 2, cols).when(n == 3, F.concat_ws(",", rows, cols)).otherwise(F.lit("no titles"))
    area = F.concat(sheet, F.format_string("$A$%d:$C$%d,", size, size + 9), sheet, F.lit("$E$2,"), sheet, F.lit("$7:$9"))
    return table(spark, sf_dir, "part").select("p_partkey", texts.print_titles(titles).alias("t"), F.array_join(texts.print_areas(area), " ").alias("areas")).select("p_partkey", "t.sheet", F.when(F.col("t.first_row").isNotNull(), F.concat_ws(":", F.col("t.first_row").cast("string"), F.col("t.last_row").cast("string"))).alias("rows"), "t.first_col", "t.last_col", "areas")


@query("""SELECT p_partkey, p_name AS left_text, 'Arial,Bold' AS left_font, p_size AS left_size, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS center_text,
CASE WHEN p_partkey % 2 = 0 THEN 'FF00A1' END AS center_color, p_type AS right_text FROM part""")
def header_footers(spark, sf_dir):
    center = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("&C&KFF00A1"), "p_brand")).otherwise("")
    parts = texts.header_parts(F.concat(F.lit('&L&"Arial,Bold"&'), F.col("p_size").cast("string"), F.lit(" "), "p_name", center, F.lit("&R"), "p_type"))
    left, middle, right = (texts.header_codes(parts[x]) for x in ("left", "center", "right"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", left["text"].alias("left_text"), left["font"].alias("left_font"), left["size"].alias("left_size"), middle["text"].alias("center_text"), middle["color"].alias("center_color"), right["text"].alias("right_text"),
    )


@query("""SELECT p_partkey, 'a' || p_size || ':3' AS sorted, CASE WHEN p_partkey % 70 BETWEEN 1 AND p_size THEN true ELSE p_partkey % 70 BETWEEN p_size + 2 AND p_size + 9 END AS held,
CAST(CASE WHEN p_partkey % 70 BETWEEN 1 AND p_size OR p_partkey % 70 BETWEEN p_size + 2 AND p_size + 9 THEN 2 ELSE 3 END AS INTEGER) AS n_added, CAST(1 AS INTEGER) AS n_removed FROM part""")
def range_sets(spark, sf_dir):
    size, row = F.col("p_size"), (F.col("p_partkey") % 70).cast("int")
    made = lambda *sides: F.struct(*[(s if not isinstance(s, int) else F.lit(s)).cast("int").alias(n) for s, n in zip(sides, ranges.SIDES, strict=True)])
    low, high = made(size + 2, 2, size + 9, 8), made(1, 1, size, 5)
    held, cell = F.array(low, high), made(row, 3, row, 3)
    told = F.array_join(F.transform(ranges.ordered(held), lambda r: F.when(r["c0"] == 1, F.concat(F.lit("a"), r["r1"].cast("string"))).otherwise((r["c0"] + 1).cast("string"))), ":")
    return table(spark, sf_dir, "part").select(
        "p_partkey", told.alias("sorted"), ranges.covers(held, row, F.lit(3)).alias("held"), F.size(ranges.added(held, cell)).alias("n_added"), F.size(ranges.removed(held, low)).alias("n_removed")
    )


@query(ORDERS + "SELECT row, col, CASE WHEN row > 3 THEN concat_ws(',', row - 3, col + 2) END AS there FROM cells")
def offset_cells(spark, sf_dir):
    to = ranges.offset(-3, 2)
    return order_cells(spark, sf_dir).select("row", "col", F.when(to.isNotNull(), F.concat_ws(",", to["row"].cast("string"), to["col"].cast("string"))).alias("there"))


@query(PARTS + "SELECT row, col, token FROM cells WHERE row BETWEEN 5 AND 90 AND col BETWEEN 2 AND 3 OR row BETWEEN 40 AND 60 AND col = 5 OR row = 1 AND col BETWEEN 2 AND 5 OR row BETWEEN 5 AND 90 AND col = 1")
def print_area_cells(spark, sf_dir):
    return C.printed(part_cells(spark, sf_dir), "B5:C90,E40:E60", "1:1", "A:A").select("row", "col", "token")


# settings of rows, dictionaries, styles


@query("""WITH r AS (SELECT o_orderkey AS row, o_orderstatus = 'P' AS hidden FROM orders), i AS (SELECT *, row - row_number() OVER (PARTITION BY hidden ORDER BY row) AS i FROM r)
SELECT hidden, min(row) AS first, max(row) AS last FROM i GROUP BY hidden, i""")
def row_stretches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.lit("s").alias("sheet"), F.col("o_orderkey").alias("row"), (F.col("o_orderstatus") == "P").alias("hidden"))
    return dimensions.stretches(rows, ["hidden"]).select("hidden", "first", "last")


@query("""SELECT p_type AS sheet, p_partkey AS row, 0 AS outline_level, p_size > 40 AS hidden FROM part WHERE p_partkey NOT BETWEEN 20 AND 60
UNION ALL SELECT DISTINCT p_type, CAST(unnest(range(20, 61)) AS BIGINT), 2, true FROM part""")
def outline_rows(spark, sf_dir):
    dims = table(spark, sf_dir, "part").select(F.col("p_type").alias("sheet"), F.col("p_partkey").alias("row"), F.lit(0).alias("outline_level"), (F.col("p_size") > 40).alias("hidden"))
    return dimensions.outlined(dims, 20, 60, 2, True)


@query("SELECT p_size, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS place FROM (SELECT p_size, min(p_partkey) AS f FROM part GROUP BY p_size)")
def value_dictionary(spark, sf_dir):
    return dimensions.dictionary(table(spark, sf_dir, "part"), "p_size", "p_partkey")


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, s) AS canonical FROM (SELECT *, nullif(p_size, 1) AS s FROM part)")
def canonical_styles(spark, sf_dir):
    styles = table(spark, sf_dir, "part").withColumn("s", F.nullif(F.col("p_size"), F.lit(1)))
    return dimensions.canonical(styles, "p_partkey", ["p_brand", "s"]).select("p_partkey", "canonical")


@query("SELECT l_partkey AS style, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def style_usage(spark, sf_dir):
    return dimensions.usage(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("style")), "style")


@query(ORDERS + """, spans AS (SELECT unnest(range(p_partkey * 10, p_partkey * 10 + 9, 1 + p_size % 4)) AS row, 1 + p_size % 2 AS c0, 2 AS c1 FROM part)
SELECT row, col, token FROM cells c WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.row = c.row AND c.col BETWEEN c0 AND c1)""")
def outside_strides(spark, sf_dir):
    key = (F.col("p_partkey") * 10).cast("int")
    spans = table(spark, sf_dir, "part").select(F.lit("Sheet1").alias("sheet"), key.alias("r0"), (1 + F.col("p_size") % 2).alias("c0"), (key + 8).alias("r1"), F.lit(2).alias("c1"), (1 + F.col("p_size") % 4).alias("step"))
    return dimensions.outside_strides(order_cells(spark, sf_dir), spans).select("row", "col", "token")


# further kinds of filters, formats, totals and pivots


@query("SELECT p_partkey, contains(lower(p_type), 'a') AS has, NOT contains(lower(p_name), 're') AS lacks, starts_with(lower(p_name), 'red') AS begins, ends_with(lower(p_type), 's') AS ends FROM part")
def cf_text_rules(spark, sf_dir):
    rule = lambda name, kind, text: filters.text_rule(F.col(name), kind, text)
    return table(spark, sf_dir, "part").select("p_partkey", rule("p_type", "containsText", "A").alias("has"), rule("p_name", "notContains", "RE").alias("lacks"), rule("p_name", "beginsWith", "Red").alias("begins"), rule("p_type", "endsWith", "S").alias("ends"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_retailprice) = 1 AS hit FROM part")
def cf_unique(spark, sf_dir):
    return filters.duplicated(table(spark, sf_dir, "part"), "p_retailprice", unique=True).select("p_partkey", "hit")


_PERIODS = {
    "M5": "month(o_orderdate) = 5", "today": "CAST(o_orderdate AS DATE) = DATE '1997-03-14'", "yesterday": "CAST(o_orderdate AS DATE) = DATE '1997-03-13'", "tomorrow": "CAST(o_orderdate AS DATE) = DATE '1997-03-15'",
    "yearToDate": "year(o_orderdate) = 1997 AND CAST(o_orderdate AS DATE) <= DATE '1997-03-14'", "thisMonth": "strftime(o_orderdate, '%Y%m') = '199703'", "lastMonth": "strftime(o_orderdate, '%Y%m') = '199702'",
    "nextMonth": "strftime(o_orderdate, '%Y%m') = '199704'", "thisQuarter": "year(o_orderdate) = 1997 AND quarter(o_orderdate) = 1", "lastQuarter": "year(o_orderdate) = 1996 AND quarter(o_orderdate) = 4",
    "nextQuarter": "year(o_orderdate) = 1997 AND quarter(o_orderdate) = 2", "thisYear": "year(o_orderdate) = 1997", "lastYear": "year(o_orderdate) = 1996", "nextYear": "year(o_orderdate) = 1998",
    "lastWeek": "CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-02' AND DATE '1997-03-08'", "nextWeek": "CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-16' AND DATE '1997-03-22'",
    "belowAverage": "o_totalprice < (SELECT avg(o_totalprice) FROM orders)",
}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, o_orderkey FROM orders WHERE {held}" for kind, held in _PERIODS.items()))
def dynamic_periods(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = [filters.dynamic(orders, "o_totalprice" if kind == "belowAverage" else "o_orderdate", kind, "1997-03-14").select(F.lit(kind).alias("kind"), "o_orderkey") for kind in _PERIODS]
    return reduce(DataFrame.union, found)


@query("""SELECT l_returnflag, CAST(count(l_discount) AS BIGINT) AS nums, min(l_quantity) AS least, round(stddev_samp(l_tax), 8) AS dev, round(stddev_pop(l_tax), 8) AS dev_p, round(var_samp(l_tax), 8) AS var_s, round(var_pop(l_tax), 8) AS var_p,
round(product(1 + l_discount / 1000000), 8) AS prod FROM lineitem GROUP BY 1""")
def pivot_aggregates(spark, sf_dir):
    named = {"nums": ("countNums", "l_discount"), "least": ("min", "l_quantity"), "dev": ("stdDev", "l_tax"), "dev_p": ("stdDevp", "l_tax"), "var_s": ("var", "l_tax"), "var_p": ("varp", "l_tax"), "prod": ("product", "near_one")}
    lines = table(spark, sf_dir, "lineitem").withColumn("near_one", 1 + F.col("l_discount") / 1000000)
    out = lines.groupBy("l_returnflag").agg(*[pivot.AGGREGATES[f](c).alias(name) for name, (f, c) in named.items()])
    return out.select("l_returnflag", "nums", "least", *[F.round(x, 8).alias(x) for x in named if x not in ("nums", "least")])


@query(_FLAGS + """, b AS (SELECT *, max(n) FILTER (flag = 'N') OVER (PARTITION BY status) AS of FROM g) SELECT flag, status, round(n / sum(n) OVER (PARTITION BY flag), 8) AS of_row, round(n / sum(n) OVER (PARTITION BY status), 8) AS of_col,
round(n / of, 8) AS of_base, round((n - of) / of, 8) AS beyond_base FROM b""")
def pivot_shown_as(spark, sf_dir):
    out = flag_counts(spark, sf_dir)
    for name, kind in (("of_row", "percentOfRow"), ("of_col", "percentOfCol"), ("of_base", "percent"), ("beyond_base", "percentDiff")):
        out = pivot.shown_as(out, "n", kind, "flag", "status", "N").withColumnRenamed("shown", name)
    return out.select("flag", "status", *[F.round(x, 8).alias(x) for x in ("of_row", "of_col", "of_base", "beyond_base")])
