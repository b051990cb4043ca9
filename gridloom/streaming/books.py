"""Workbooks as a stream of cells: a folder is watched, and each workbook that appears is read once.

``spark.readStream.format("gridloom_books").load(folder)`` gives the relation cells with ``note`` and ``link``, the comment on a cell and the target of the first link that holds
it; a cell that isn't there but has either comes after the others of its sheet. An offset is the name of the last workbook that was taken, so workbooks must appear under
names that sort after those before, as dated ones do, and complete, as a rename makes them. Each sheet is a partition, read as a stream of pieces whose batches don't grow with the sheet.
A batch that failed is read again from its offsets; with a checkpoint a restarted query goes on behind the last batch that was finished.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from gridloom.sources import xlsx

SCHEMA = f"{xlsx.SCHEMAS['cells']}, note string, link string"


@dataclass
class Sheet(InputPartition):
    path: str
    number: int


class BookReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = Path(options["path"].removeprefix("file://").replace("file:", "", 1))
        self.most = int(options.get("maxfilesperbatch", options.get("maxFilesPerBatch", 0)))
        self.told: str | None = None

    def names(self) -> list[str]:
        return sorted(p.name for p in self.folder.iterdir() if p.suffix.lower() in (".xlsx", ".xlsm"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        """All that is there, or some more than at the last call; a smaller step never skips a file."""
        there = self.names()
        if self.most and self.told is not None:
            there = [n for n in there if n <= self.told] + [n for n in there if n > self.told][: self.most]
        elif self.most:
            there = there[: self.most]
        self.told = there[-1] if there else self.told or ""
        return {"file": self.told}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.told = max(self.told or "", end["file"])
        out = []
        for name in self.names():
            if start["file"] < name <= end["file"]:
                path = str(self.folder / name)
                out += [Sheet(path, i) for i, s in enumerate(xlsx.Package(path).sheets) if s[3] == "worksheet"]
        return out

    def commit(self, end: dict) -> None:
        """Workbooks stay where they are."""

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        book = xlsx.Package(partition.path)
        name = book.sheets[partition.number][0]
        notes = {(r[2], r[3]): r[5] for r in xlsx.sheet_rows(book, partition.number, "comments")}
        links: dict[tuple[int, int], str] = {}
        for _, _, r0, c0, r1, c1, target, location, _ in xlsx.sheet_rows(book, partition.number, "hyperlinks"):
            for r in range(r0, r1 + 1):
                for c in range(c0, c1 + 1):
                    links.setdefault((r, c), target or f"#{location}")
        left = set(notes) | set(links)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in xlsx.cells(book, partition.number):
            places = list(zip(batch.column("row").to_pylist(), batch.column("col").to_pylist(), strict=True))
            left.difference_update(places)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(notes.get, places), pa.string()), pa.array(map(links.get, places), pa.string())], names=names)
        rest = sorted(left)
        if rest:
            n, kinds = len(rest), [f.type for f in batch_schema()]
            known = {"file": [partition.path] * n, "sheet": [name] * n, "sheet_no": [partition.number] * n, "row": [r for r, _ in rest], "col": [c for _, c in rest], "note": [notes.get(p) for p in rest], "link": [links.get(p) for p in rest]}
            yield pa.RecordBatch.from_arrays([pa.array(known.get(c, [None] * n), k) for c, k in zip(names, kinds, strict=True)], names=names)


def batch_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])


class BookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_books"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return BookReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(BookSource)
