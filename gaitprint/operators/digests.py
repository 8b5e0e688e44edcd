"""Comparing large tables by digests: per bucket of keys and group of columns, then only the cells of what differs.

A digest of a (bucket, column group) is the xor and the sum of its rows' hashes, so it is a partial aggregate
that no order changes.  Two tables are joined only in buckets whose digests differ, on the columns of groups
whose digests differ; equal tables are never joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitprint.sources.staging import new_folder

BUCKETS, GROUP = 64, 32
BUCKET = "key_bucket"


def _groups(columns: list[str], size: int) -> list[list[str]]:
    return [columns[k : k + size] for k in range(0, len(columns), size)]


def _values(df: DataFrame, columns: list[str], decimals: int | None) -> list:
    """Columns as they are hashed: doubles to so many decimals, nulls as themselves (a hash passes over nulls, so each has a mark)."""
    kinds = dict(df.dtypes)
    plain = lambda c: F.round(F.col(c), decimals) + F.lit(0.0) if decimals is not None and kinds[c] in ("double", "float") else F.col(c)
    return [x for c in columns for x in (F.col(c).isNull(), plain(c))]


def digests(table: DataFrame, key: str, buckets: int = BUCKETS, group: int = GROUP, decimals: int | None = None) -> DataFrame:
    """bucket, columns (the group's number), xor, total and rows; one pass, ``buckets`` times groups rows."""
    names = [c for c in sorted(table.columns) if c not in (key, BUCKET)]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    hashed = table.select(bucket, *[F.xxhash64(F.col(key), *_values(table, own, decimals)).alias(f"h{i}") for i, own in enumerate(_groups(names, group))])
    wide = [c for c in hashed.columns if c != "bucket"]
    per = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), *[x for c in wide for x in (F.bit_xor(c).alias(f"{c}_x"), F.sum(F.pmod(F.col(c), F.lit(1 << 31))).alias(f"{c}_s"))])
    each = F.array(*[F.struct(F.lit(i).alias("columns"), F.col(f"{c}_x").alias("xor"), F.col(f"{c}_s").alias("total")) for i, c in enumerate(wide)])
    return per.select("bucket", "rows", F.inline(each))


def root(told: DataFrame) -> DataFrame:
    """One row: xor, total and rows of a whole table from its digests; one changed cell or key changes it."""
    h = F.xxhash64("bucket", "columns", "xor", "total")
    return told.agg(F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("total"), F.sum(F.when(F.col("columns") == 0, F.col("rows"))).alias("rows"))


def write_bucketed(table: DataFrame, key: str, buckets: int = BUCKETS, name: str = "digested") -> DataFrame:
    """The table with a folder per bucket of keys, read back; a read of some buckets opens only their files."""
    path = new_folder(table.sparkSession, name)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    table.withColumn(BUCKET, bucket).repartition(BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(path)
    out = table.sparkSession.read.parquet(path)
    out.staged_at = path
    return out


def parts_that_differ(a: DataFrame, b: DataFrame) -> tuple[list[int], list[int]]:
    """Buckets and column groups in which two tables' digests differ (at most BUCKETS, and a table's width by GROUP)."""
    same = ["xor", "total", "rows"]
    left = a.select("bucket", "columns", F.struct(*same).alias("x"))
    right = b.select("bucket", "columns", F.struct(*same).alias("y"))
    found = left.join(right, ["bucket", "columns"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("bucket", "columns").collect()
    return sorted({r["bucket"] for r in found}), sorted({r["columns"] for r in found})


def changed_cells(a: DataFrame, b: DataFrame, key: str, buckets: int = BUCKETS, group: int = GROUP, decimals: int | None = None) -> DataFrame:
    """key, column, was, now (as text) of every cell in which two tables of the same columns differ; column is null where one side lacks the key.

    Keys are unique and not null.  With ``decimals`` doubles count as equal if they agree to so many.
    """
    if sorted(a.drop(BUCKET).columns) != sorted(b.drop(BUCKET).columns):
        raise ValueError("columns differ")
    names = [c for c in sorted(a.columns) if c not in (key, BUCKET)]
    at, groups = parts_that_differ(digests(a, key, buckets, group, decimals), digests(b, key, buckets, group, decimals))
    own = [c for i, part in enumerate(_groups(names, group)) if i in groups for c in part]
    kinds = dict(a.dtypes)

    def side(df: DataFrame, to: str) -> DataFrame:
        # A table of write_bucketed is read in those buckets alone.
        some = df.where(F.col(BUCKET).isin(at)) if BUCKET in df.columns else df.where(F.pmod(F.xxhash64(key), F.lit(buckets)).isin(at))
        return some.select(key, F.struct(*own).alias(to) if own else F.struct(F.lit(1).alias("none")).alias(to))

    met = side(a, "was").join(side(b, "now"), key, "full_outer")

    def differs(c: str):
        x, y = F.col(f"was.`{c}`"), F.col(f"now.`{c}`")
        if decimals is not None and kinds[c] in ("double", "float"):
            x, y = F.round(x, decimals) + F.lit(0.0), F.round(y, decimals) + F.lit(0.0)
        return ~x.eqNullSafe(y)

    text = lambda side_, c: F.col(f"{side_}.`{c}`").cast("string").alias(side_)
    cell = "struct<column: string, was: string, now: string>"
    lone = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("was"), F.lit(None).cast("string").alias("now")).cast(cell))
    cells = F.array_compact(F.array(*[F.when(differs(c), F.struct(F.lit(c).alias("column"), text("was", c), text("now", c)).cast(cell)) for c in own])) if own else F.array().cast(f"array<{cell}>")
    return met.select(key, F.inline(F.when(F.col("was").isNull() | F.col("now").isNull(), lone).otherwise(cells)))
