"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrahac.runtime import shared_dir, ship

__all__ = ["column_bytes", "drop_path", "drop_table", "held_out", "new_path", "shared_dir", "ship", "small_batches", "sorted_groups", "spread", "table", "tidy"]


#: Folders made in the shared folder, and not deleted, by application.
_MADE: dict[str, set[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def tidy(spark: SparkSession) -> None:
    """Delete all intermediate tables and archives of this application, once results have been written or read."""
    for path in list(_MADE.get(spark.sparkContext.applicationId, ())):
        drop_path(spark, path)


def table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df into the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if it has fewer partitions than there are cores: files of one row group are one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    made = _MADE.get(spark.sparkContext.applicationId, set())
    made -= {x for x in made if x.rpartition("/")[2] == path.rstrip("/").rpartition("/")[2]}


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table() that nothing will read any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


def held_out(column: str, modulus: int) -> "F.Column":
    """True where crc32 of the id as text leaves remainder 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == 2


def column_bytes(column: pa.Array) -> list[bytes | None]:
    """The values of a string or binary column as bytes, without decoding them."""
    kind = column.type
    if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        column = column.view(pa.large_binary())
    elif pa.types.is_string(kind) or pa.types.is_binary(kind):
        column = column.view(pa.binary())
    else:
        column = column.cast(pa.string()).view(pa.binary())
    return column.to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``most`` bytes of the text column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if batch.nbytes <= most:
            yield batch
            continue
        sizes = np.array([len(x) if x is not None else 0 for x in column_bytes(column)], dtype=np.int64)
        total = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    now: tuple | None = None
    rows: dict[str, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        data = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in {*keys, *columns}}
        marks = list(zip(*(data[k] for k in keys)))
        start, n = 0, len(marks)
        while start < n:
            key, end = marks[start], start + 1
            while end < n and marks[end] == key:
                end += 1
            if key != now:
                if now is not None:
                    yield now, rows
                now, rows = key, {c: [] for c in columns}
            for c in columns:
                rows[c].extend(data[c][start:end])
            start = end
    if now is not None:
        yield now, rows
