"""Tables in the folder that driver and executors share, written once and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none (tests, one machine) a temporary folder is set once.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Folders and catalog tables made since the innermost :func:`staged` began.
_MADE: list[list[tuple[str, str | None]]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append((path, None))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """What is staged within, folders and catalog entries, is deleted at the end; results must have been written by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for path, table in _MADE.pop():
            if table is not None:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            _delete(spark, path)


def data_version(spark: SparkSession, path: str) -> tuple:
    """Number, total length and a digest of the files under ``path``: the same for the same files, another once one is written anew.

    Paths, lengths and times are listed and reduced by Spark; no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return tuple(files.agg(F.count("path"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not the work before it, and a table that two
    branches use is computed once.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def bucketed_table(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """As :func:`stage_table`, but hashed by ``key`` into ``buckets``, by default as many as shuffles have partitions.

    What groups, joins or orders by ``key`` later finds its rows in place and shuffles nothing.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"{name}_{uuid.uuid4().hex}".replace("-", "_"), new_folder(spark, name)
    df.repartition(buckets, key).write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    if _MADE:
        _MADE[-1].append((path, table))
    return spark.table(table)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables of :func:`stage_table` whose last reader has been written."""
    for table in tables:
        _delete(table.sparkSession, table.staged_at)
