"""What a review of odd inputs and larger tables found."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import formula, tokens
from gridloom.operators import formulas, strides
from gridloom.plans import books

FORMULAS = "sheet string, row int, col int, formula string, formula_kind string, formula_ref string"


def test_pivot_sort_keeps_parts_of_cents(spark, tmp_path):
    rows = [(i, i % 5, "FO"[i % 7 == 0], [0.004, 0.001, 0.003, 12.3456, 12.3449][i % 5]) for i in range(40)] + [(40, 9, "O", 5.0)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted(map(tuple, books.pivot_sort(spark, str(tmp_path)).select("item", "place").collect()))
    assert got == sorted(duck.sql(books.SQL["pivot_sort"]).fetchall())


def test_one_line_is_filled_by_several_tasks(spark):
    lines = spark.createDataFrame([("s", "A1:B40000=C1*$D2"), ("s", "F5,F9:F90009/4=G5")], "sheet string, line string").coalesce(1)
    got = formulas.decoded(lines).withColumn("part", F.spark_partition_id()).cache()
    tall, stepped = got.where("col < 3"), got.where("col = 6")
    assert tall.count() == 80_000 and stepped.count() == 1 + 22_501
    assert tall.select("part").distinct().count() > 1
    assert tall.where(F.col("formula") != F.concat(F.lit("="), F.when(F.col("col") == 1, "C").otherwise("D"), "row", F.lit("*$D"), F.col("row") + 1)).isEmpty()
    assert stepped.where(F.col("formula") != F.concat(F.lit("=G"), "row")).isEmpty() and stepped.where("row % 4 <> 1").isEmpty()
    got.unpersist()


def test_formulas_of_many_rows_are_dealt_out_once(spark):
    n = 3 * formulas.STRIP + 10
    cells = spark.range(1, n + 1).select(F.lit("s").alias("sheet"), F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("col"))
    lone = F.when(F.pmod(F.hash("row"), F.lit(3)) == 0, F.concat(F.lit("=A"), "row")).when(F.col("row") % 2 == 0, F.concat(F.lit("=B"), "row", F.lit("+"), "row"))
    text = F.when(F.col("col") < 3, F.concat(F.lit("="), F.when(F.col("col") == 1, "E").otherwise("F"), "row")).otherwise(lone)
    cells = cells.select("sheet", "row", "col", text.alias("formula"), F.lit("normal").alias("formula_kind"), F.lit(None).cast("string").alias("formula_ref")).cache()
    lines = formulas.lines(cells)
    assert [r[0] for r in lines.where("first_col = 1").select("line").collect()] == [f"A1:B{n}=E1"]
    want = cells.where("formula is not null")
    got = formulas.decoded(lines)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    cells.unpersist()


def greedy(rows):
    out, i = [], 0
    while i < len(rows):
        j = min(i + 1, len(rows) - 1)
        while j + 1 < len(rows) and rows[j + 1] - rows[j] == rows[i + 1] - rows[i]:
            j += 1
        j = j if j - i > 1 and rows[i + 1] - rows[i] > 1 else i
        out.append((rows[i], rows[j], rows[i + 1] - rows[i] if j > i else 1))
        i = j + 1
    return out


def test_progressions_in_chunks():
    rng, alone = random.Random(3), 0
    for _ in range(20_000):
        rows, at = [], 0
        for _ in range(rng.randint(1, 20)):
            step = rng.choice([2, 2, 3, 4])
            rows += range(at + step, at + step * rng.choice([2, 3, 3, 3, 4, 6]), step)
            at = rows[-1]
        run, spans, i = strides.Greedy(), [], 0
        while i < len(rows):
            n = rng.choice([1, 2, 3, 5, 9, 30])
            done, pieces = strides.settled(rows[i : i + n])
            spans, alone, i = spans + done, alone + len(done), i + n
            for *piece, flush in pieces:
                run.add(*piece)
                if flush:
                    run.flush()
        run.flush()
        assert sorted(spans + run.taken()) == greedy(rows)
    assert alone > 20_000


def test_shapes_of_formulas():
    rng = random.Random(5)
    parts = ["A1", "$B2", "C$3", "XFD1048576", "XFE1", "ZZZ1", "'a!b'!A1", '"A1"', "LOG10(A1)", "Table1[A1]", "é", "a1", "1:1", "A:A", "A01", "0", "9999999999", "99999999999", "2147483648", "A٣", "A1٣", "'", '"', "[", "]", "\x02", "%", "A12345678901", ":", "$"]
    for _ in range(20_000):
        text, row, col = "=" + "".join(rng.choice(parts) for _ in range(rng.randint(1, 6))), rng.randint(1, 20), rng.randint(1, 20)
        want = formula.template(text, row, col)
        assert formula.relative(text, row, col)[0] == want
        assert want is None or formula.relative(text, row, col)[1:] == formula.fill_flags(text)
        by, cols = np.array([rng.choice([-3, 0, 1, 50, 2_147_483_640]) for _ in range(4)]), rng.choice([-2, 0, 3])
        moved = [text if r == cols == 0 else formula.fill(text, int(r), cols) for r in by]
        assert formula.fills(text, by.tolist(), cols) == formula.filled(text, by, cols).to_pylist() == moved


def test_texts_in_quotes_are_alike(spark):
    texts = ["", "plain", 'a"b\\c', "".join(map(chr, range(1, 256))), "\u2028\u2029é𝄞", "\x00"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.json_literal(F.col("t"))).collect()
    assert [(t, tokens.json_text(t)) for t in texts] == [tuple(r) for r in got]
