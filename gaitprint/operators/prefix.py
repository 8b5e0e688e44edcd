"""Places and running sums within groups of any size, by prefix sums over parts that are cut by value.

Rows are dealt by range of (group, order), numbered where they lie, and each part's totals are summed over the
parts before it.  The windows here hold one part of a group, or one row per part; never a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitprint.sources.staging import stage_table


def in_parts(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` as a table in parts: ``part``, and ``place``, which ascends by ``group`` and ``order`` within a part and over parts.

    Rows that agree in both are told apart by a number of their own, so that they too can be in several parts.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c).asc() for c in group], *order, F.col("row_").asc()]
    dealt = rows.withColumn("row_", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return stage_table(dealt.drop("row_").withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), name)


def _offsets(placed: DataFrame, group: Sequence[str], sums: dict[str, str], totals: dict[str, str]) -> DataFrame:
    """Per part and group: what the group's parts before it sum to, and the group's totals; as many rows as parts and groups."""
    each = placed.groupBy("part", *group).agg(F.min("place").alias("first_place"), *[F.sum(F.expr(x)).alias(f"own_{n}") for n, x in {**sums, **totals}.items()])
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(
        F.col("part").alias("of_part"), *[F.col(c).alias(f"of_{c}") for c in group], "first_place",
        *[F.coalesce(F.sum(f"own_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in sums], *[F.sum(f"own_{n}").over(whole).alias(n) for n in totals],
    )


def _with_offsets(placed: DataFrame, offsets: DataFrame, group: Sequence[str]) -> DataFrame:
    same = F.col("part") == F.col("of_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return placed.join(offsets, same).drop("of_part", *[f"of_{c}" for c in group])


def positions(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, number: str = "rn", parts: int | None = None) -> DataFrame:
    """``rows`` with each one's place within its group, from 1, and its ``part``; nulls in ``group`` are a group."""
    placed = in_parts(rows, group, order, name, parts)
    found = _with_offsets(placed, _offsets(placed, group, {"rows": "1"}, {}), group)
    return found.withColumn(number, F.col("before_rows") + F.col("place") - F.col("first_place") + 1).drop("place", "first_place", "before_rows")


def running(rows: DataFrame, group: Sequence[str], order: Sequence[Column], sums: dict[str, str], totals: dict[str, str], name: str) -> DataFrame:
    """``rows`` with running sums (column: SQL expression) down to each row of its group and the group's ``totals``."""
    placed = in_parts(rows, group, order, name)
    here = Window.partitionBy("part", *group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({n: F.sum(F.expr(x)).over(here) for n, x in sums.items()})
    found = _with_offsets(local, _offsets(placed, group, sums, totals), group)
    return found.withColumns({n: F.col(n) + F.col(f"before_{n}") for n in sums}).drop("part", "place", "first_place", *[f"before_{n}" for n in sums])
