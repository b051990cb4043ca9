"""What several operators share: words, bytes of Arrow columns, scratch tables."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six characters (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8, null as empty. ``bytes.split`` then gives its words."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir; a local session without that setting gets one of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, units: float, per_partition: float) -> int:
    """Partitions of bounded size: their number follows the input, and is never under the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(units // per_partition) + 1)


def small_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """From now on Arrow batches that Spark sends to Python end at about so many bytes: else 10,000 whole texts stand in an executor's memory, and again in that of its workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of one text column, so that memory follows bytes and not rows."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def packed(counts: np.ndarray) -> bytes:
    """Counters, compressed, in the fewest bytes that hold the largest; the first byte says how many."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if counts.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x[1:]), f"<u{x[0]}")
