"""The stream of workbooks: each once over restarts and failures, with notes and links on its cells."""

import pytest
from pyspark.sql import functions as F

from gridloom.sources import workbook
from gridloom.streaming import books


def book(spark, path, first, n, **more):
    cells = spark.range(first, first + n).select(F.lit("S").alias("sheet"), (F.col("id") + 1).cast("int").alias("row"), F.lit(2).alias("col"), F.lit("number").alias("kind"), F.col("id").cast("string").alias("value"))
    workbook.save(cells, str(path), **more)


def run(spark, folder, out, checkpoint, fail=None, **options):
    books.register(spark)
    stream = spark.readStream.format("gridloom_books").options(**options).load(str(folder))
    if fail is not None:
        stream = stream.withColumn("value", F.when(F.col("value") == fail, F.raise_error(F.lit("stop here"))).otherwise(F.col("value")))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(out)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_each_row_once_over_restarts(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    folder.mkdir()
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    book(spark, folder / "2024-01.xlsx", 0, 500)
    run(spark, folder, out, checkpoint)
    book(spark, folder / "2024-02.xlsx", 500, 300, comments=frame([("S", 501, 2, "Ann", "first"), ("S", 9, 9, "Ann", "alone")], "sheet string, row int, col int, author string, text string"))
    with pytest.raises(Exception, match="stop here"):
        run(spark, folder, out, checkpoint, fail="700")
    book(spark, folder / "2024-03.xlsx", 800, 10, hyperlinks=frame([("S", 801, 1, 801, 2, "https://x.example/", None, None), ("S", 801, 2, 802, 2, None, "S!A1", None)], "sheet string, r0 int, c0 int, r1 int, c1 int, target string, location string, tooltip string"))
    run(spark, folder, out, checkpoint, maxFilesPerBatch=1)
    run(spark, folder, out, checkpoint)
    got = spark.read.parquet(str(out))
    assert sorted(int(r["value"]) for r in got.where("value is not null").collect()) == list(range(810))
    marked = {(r["row"], r["col"]): (r["value"], r["note"], r["link"]) for r in got.where("note is not null or link is not null").collect()}
    assert marked == {(501, 2): ("500", "first", None), (9, 9): (None, "alone", None), (801, 1): (None, None, "https://x.example/"), (801, 2): ("800", None, "https://x.example/"), (802, 2): ("801", None, "#S!A1")}
