"""What the operators share: tables in the shared folder (from :mod:`gaitprint.sources.staging`), and Arrow helpers for the tasks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitprint.sources.staging import drop_tables, new_folder, stage_table

__all__ = ["bounded_batches", "drop_tables", "free_name", "mix64", "new_folder", "own_columns", "ship_package", "slices", "stage_table", "utf8_bytes"]

#: Text of one Arrow batch that is worked on at a time; a longer single text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Bytes after which Spark closes an Arrow batch for a Python worker, and the setting that says so (its default is 64 MB).
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package where neither PYTHONPATH nor the working folder leads them to it."""
    package = Path(__file__).resolve().parents[1]
    known = {*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()}
    sc = spark.sparkContext
    if str(package.parent) in {os.path.abspath(p) for p in known if p} or any(package.name in f for f in getattr(sc, "_python_includes", [])):
        return
    file = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(file))


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``limit`` bytes of ``column``, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        col = batch.column(i)
        if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
            width = np.int64
        else:
            width = np.int32
        ends = np.frombuffer(col.buffers()[1], dtype=width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@contextmanager
def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs that run within hand Python batches of about ``limit`` bytes (a longer single row is one of its own), so that neither side of a task holds 10,000 texts at once."""
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, limit)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one after the other, and where each row starts (one more than rows); null is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
