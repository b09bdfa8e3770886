"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark needs to reach."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called that, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes in column ``text``, one row at least; memory follows ``most``."""
    for batch in batches:
        n, start = batch.num_rows, 0
        if not n:
            continue
        lengths = batch.column(text).cast(pa.large_binary()).fill_null(b"")
        sizes = pa.compute.binary_length(lengths).to_numpy(zero_copy_only=False)
        total = 0
        for i in range(n):
            total += int(sizes[i])
            if total >= most or i == n - 1:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
