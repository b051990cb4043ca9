"""Pivot caches of workbooks: the records behind pivot tables, whose texts are numbers in a dictionary for each field.

``records`` cuts the part of records between them, parses the pieces in Arrow batches, and joins the dictionaries, by a broadcast if these are small. ``cache_lines`` is what
``workbook.save`` writes of a cache: texts as numbers of shared items, all other values as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import dates
from gridloom.operators import cells as C
from gridloom.sources import scan, workbook, xlsx
from gridloom.sources.scan import MAIN, number
from gridloom.sources.scratch import written

CACHES = "file string, cache_id int, sheet string, ref string, fields array<string>"
ITEMS = "file string, cache_id int, field int, idx int, kind string, value string"
TABLES = "file string, sheet string, name string, location string, cache_id int"
RAW = "file string, cache_id int, record bigint, field int, kind string, value string, idx int"
PIECES = "file string, cache_id int, first bigint, data binary"
_KINDS = {"s": "text", "n": "number", "d": "date", "b": "bool", "e": "error", "m": "blank"}
_VALUE = re.compile(rb'<([xsndbem])\b(?:[^>]*?\bv="([^"]*)")?[^>]*?/?>')
MOST_BROADCAST = 500_000  # items


def parts(book: xlsx.Package) -> list[tuple[int, str]]:
    """(cache id, name of the definition's part) of a workbook."""
    out = []
    for x in book.book.iterfind(f"{MAIN}pivotCaches/{MAIN}pivotCache"):
        target = book.links.get(x.get(f"{xlsx.REL}id"), ("", ""))[1]
        if target and book.has(target):
            out.append((number(x.get("cacheId")), target))
    return out


def _relation(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book in workbook.opened(batches):
            held = []
            for row in rows(book):
                held.append(row)
                if len(held) >= 10_000:
                    yield workbook.batch(held, schema)
                    held = []
            yield workbook.batch(held, schema)

    return workbook.archives(spark, path).mapInArrow(read, schema)


def caches(spark: SparkSession, path: str) -> DataFrame:
    """Caches with their source and the names of their fields."""

    def rows(book: xlsx.Package) -> Iterator[tuple]:
        for i, part in parts(book):
            root = book.part(part)
            source = root.find(f"{MAIN}cacheSource/{MAIN}worksheetSource")
            told = source.attrib if source is not None else {}
            yield book.path, i, told.get("sheet"), told.get("ref"), [x.get("name") for x in root.iterfind(f"{MAIN}cacheFields/{MAIN}cacheField")]

    return _relation(spark, path, CACHES, rows)


def shared_items(spark: SparkSession, path: str) -> DataFrame:
    def rows(book: xlsx.Package) -> Iterator[tuple]:
        for i, part in parts(book):
            for f, x in enumerate(book.part(part).iterfind(f"{MAIN}cacheFields/{MAIN}cacheField")):
                for k, y in enumerate(x.find(f"{MAIN}sharedItems") if x.find(f"{MAIN}sharedItems") is not None else ()):
                    kind = y.tag.removeprefix(MAIN)
                    yield book.path, i, f, k, _KINDS.get(kind, "text"), y.get("v")

    return _relation(spark, path, ITEMS, rows)


def tables(spark: SparkSession, path: str) -> DataFrame:
    """Pivot tables of all sheets with the id of their cache."""

    def rows(book: xlsx.Package) -> Iterator[tuple]:
        for name, _, part, _ in book.sheets:
            for target in book.related(part, "pivotTable"):
                x = book.part(target)
                at = x.find(f"{MAIN}location")
                yield book.path, name, x.get("name"), at.get("ref") if at is not None else None, number(x.get("cacheId"))

    return _relation(spark, path, TABLES, rows)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, cache_id, record, field, name, kind, value): a row for each value, texts looked up in the dictionaries. Records are numbered from 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book in workbook.opened(batches):
            for i, part in parts(book):
                for target in book.related(part, "pivotCacheRecords")[:1]:
                    for first, data in scan.element_pieces(book.open(target), b"pivotCacheRecords", b"r", workbook.PIECE):
                        yield workbook.batch([(book.path, i, first, data)], PIECES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, i, first, data in zip(*[b.column(c).to_pylist() for c in ("file", "cache_id", "first", "data")], strict=True):
                out = []
                for n, record in enumerate(re.split(rb"<r(?=[\s/>])", data)[1:]):
                    for f, m in enumerate(_VALUE.finditer(record)):
                        kind, value = m[1].decode(), None if m[2] is None else scan.text(m[2])
                        out.append((file, i, first + n, f, _KINDS.get(kind), None if kind == "x" else value, int(value) if kind == "x" else None))
                yield workbook.batch(out, RAW)

    raw = workbook.archives(spark, path).mapInArrow(cut, PIECES).repartition("file", "cache_id", "first").mapInArrow(read, RAW)
    items = written(shared_items(spark, path), "items").withColumnsRenamed({"kind": "_kind", "value": "_value"})
    items = F.broadcast(items) if items.count() <= MOST_BROADCAST else items
    names = caches(spark, path).select("file", "cache_id", F.posexplode("fields").alias("field", "name"))
    found = raw.join(items, ["file", "cache_id", "field", "idx"], "left").join(F.broadcast(names), ["file", "cache_id", "field"], "left")  # a row a field
    return found.select("file", "cache_id", "record", "field", "name", F.coalesce("_kind", "kind").alias("kind"), F.coalesce("_value", "value").alias("value"))


def cache_lines(df: DataFrame, order: list[str], sheet: str, ref: str) -> tuple[list[DataFrame], list[tuple], list[tuple[str, str]]]:
    """Lines of the parts of a cache of ``df``, marks around them, and the kinds of the parts; in the form of ``workbook.save``."""
    spark, kinds = df.sparkSession, dict(df.dtypes)
    definition, body = "xl/pivotCache/pivotCacheDefinition1.xml", "xl/pivotCache/pivotCacheRecords1.xml"
    held = written(C.numbered(df, order, "_record"), "records")
    lines, values = [], held
    text = lambda c: workbook.xml_attribute("v", c)
    fixed = [
        (definition, 0, None, None, f'{workbook.HEAD}<pivotCacheDefinition xmlns="{MAIN[1:-1]}" xmlns:r="{workbook.LINK}" r:id="rId1" refreshOnLoad="1" recordCount="{held.count()}"><cacheSource type="worksheet"><worksheetSource ref={quoteattr(ref)} sheet={quoteattr(sheet)}/></cacheSource><cacheFields count="{len(df.columns)}">'),
        (definition, len(df.columns) + 1, None, None, "</cacheFields></pivotCacheDefinition>"), (body, 0, None, None, f'{workbook.HEAD}<pivotCacheRecords xmlns="{MAIN[1:-1]}">'), (body, 2, None, None, "</pivotCacheRecords>"),
        ("xl/pivotCache/_rels/pivotCacheDefinition1.xml.rels", 0, None, None, f'{workbook.HEAD}<Relationships xmlns="{workbook.OF}/relationships"><Relationship Id="rId1" Type="{workbook.LINK}/pivotCacheRecords" Target="/{body}"/></Relationships>'),
    ]
    shown = []
    for i, c in enumerate(df.columns, 1):
        fixed += [(definition, i, None, None, f'<cacheField name={quoteattr(c)} numFmtId="0"><sharedItems>'), (definition, i, 1 << 62, None, "</sharedItems></cacheField>")]
        if kinds[c] == "string":
            items = written(C.numbered(held.where(F.col(c).isNotNull()).select(F.col(c).alias("_v")).distinct(), ["_v"], "_i", 0), "items")
            lines.append(items.select(F.lit(definition).alias("part"), F.lit(i).alias("section"), F.col("_i").cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.concat(F.lit("<s"), text(F.col("_v")), F.lit("/>")).alias("xml")))
            look = items.withColumnsRenamed({"_v": f"_v{i}", "_i": f"_i{i}"})
            values = values.join(F.broadcast(look) if look.count() <= MOST_BROADCAST else look, F.col(c) == F.col(f"_v{i}"), "left")
            shown.append(F.concat(F.lit("<x"), text(F.col(f"_i{i}")), F.lit("/>")))
        elif kinds[c].startswith(("timestamp", "date")):
            shown.append(F.concat(F.lit("<d"), text(dates.iso_text(F.col(c).cast("timestamp_ntz"))), F.lit("/>")))
        else:
            shown.append(F.concat(F.lit("<b" if kinds[c] == "boolean" else "<n"), text(F.col(c).cast("int") if kinds[c] == "boolean" else C.plain_value(F.col(c), kinds[c])), F.lit("/>")))
    each = F.concat(F.lit("<r>"), *[F.when(F.col(c).isNull(), "<m/>").otherwise(x) for c, x in zip(df.columns, shown, strict=True)], F.lit("</r>"))
    lines.append(values.select(F.lit(body).alias("part"), F.lit(1).alias("section"), F.col("_record").cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), each.alias("xml")))
    return lines, fixed, [(definition, f"{workbook.KIND}.pivotCacheDefinition+xml"), (body, f"{workbook.KIND}.pivotCacheRecords+xml")]
