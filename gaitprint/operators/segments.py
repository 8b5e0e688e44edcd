"""Visitors with very many events: their ordered logs are cut into chunks, and what a chunk needs of those before it is carried.

Sequence columns look back: the last row, the last view, the session so far.  Over a chunk they are windows as
for any other visitor.  Of every chunk the last values and the sums are kept (one row per chunk), combined over
the chunks before it, and joined to the chunk's rows.  So no task orders or holds more than a chunk, and the
columns are those of :func:`gaitprint.operators.sequences.sequence_columns`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitprint.operators import clean, prefix, sequences
from gaitprint.sources.staging import bucketed_table, drop_tables, stage_table

#: Events from which a visitor's log is cut, and rows of a chunk, about.
HEAVY_ROWS = 1_000_000
_CHUNK = ["cookie_id", "part"]


def heavy_visitors(events: DataFrame, rows: int = HEAVY_ROWS) -> DataFrame:
    """cookie_id and n of visitors with more than ``rows`` raw events: at most one of every ``rows`` rows of the log."""
    return events.groupBy("cookie_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)


def carried(rows: DataFrame, lasts: dict[str, str], sums: dict[str, str]) -> DataFrame:
    """``rows`` (cookie_id, part, rn) with the last values before each row, nulls passed over, and the sums down to it, whole visitors' both."""
    inside = Window.partitionBy(*_CHUNK).orderBy("rn")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*_CHUNK).agg(
        *[F.expr(f"max_by({x}, CASE WHEN {x} IS NOT NULL THEN rn END)").alias(n) for n, x in lasts.items()], *[F.sum(F.expr(x)).alias(n) for n, x in sums.items()]
    )
    chunks_before = Window.partitionBy("cookie_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    entry = ends.select(
        *_CHUNK, *[F.last(n, ignorenulls=True).over(chunks_before).alias(f"entry_{n}") for n in lasts], *[F.coalesce(F.sum(n).over(chunks_before), F.lit(0)).alias(f"entry_{n}") for n in sums]
    )
    local = {n: F.last(F.expr(x), ignorenulls=True).over(before) for n, x in lasts.items()} | {n: F.sum(F.expr(x)).over(so_far) for n, x in sums.items()}
    met = rows.withColumns(local).join(entry, _CHUNK)
    whole = {n: F.coalesce(n, f"entry_{n}") for n in lasts} | {n: F.col(n) + F.col(f"entry_{n}") for n in sums}
    return met.withColumns(whole).drop(*[f"entry_{n}" for n in (*lasts, *sums)])


def chunked_events(events: DataFrame, meta: DataFrame, rows: int = HEAVY_ROWS) -> DataFrame:
    """As :func:`clean.clean_events`, of visitors of any size: ``part`` is the chunk; no visitor's rows are one task's."""
    distinct = clean.normal(clean.in_window(events, meta).dropDuplicates(list(clean.EVENT_COLUMNS)))
    distinct = stage_table(distinct, "heavy-events")
    chunks = max(2, -(-distinct.count() // rows))
    ordered = prefix.positions(distinct, ["cookie_id"], [F.asc_nulls_last(c) for c in clean.ORDER], "heavy-in-order", parts=chunks)
    return ordered.withColumn("rn", F.col("rn").cast("int") if chunks * rows < 1 << 31 else F.col("rn"))


def sequence_columns(described: DataFrame) -> DataFrame:
    """The columns of :func:`sequences.sequence_columns`, of chunked events; a table."""
    first = stage_table(carried(described, sequences.last_of(sequences.SPARK), {}), "heavy-looked-back")
    derived = first.withColumns({n: F.expr(x) for n, x in sequences.derived(sequences.SPARK).items()})
    out = stage_table(carried(derived, sequences.LAST_DERIVED, sequences.COUNTED), "heavy-sequences")
    drop_tables(first)
    return out


def log_features(events: DataFrame, meta: DataFrame, families: str = "all", heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """One row of features per visitor of ``meta`` from a raw log, whatever share of it one visitor has.

    Most visitors' logs are hashed by visitor once and lie together; those with more than ``heavy_rows`` events are cut
    into chunks.  Both ways give the same features.
    """
    tasks = clean.tasks_for(events.sparkSession, events.count())
    heavy = stage_table(heavy_visitors(events, heavy_rows).select("cookie_id"), "heavy-visitors")
    some = bool(heavy.limit(1).count())
    light, light_meta = (events.join(heavy, "cookie_id", "left_anti"), meta.join(heavy, "cookie_id", "left_anti")) if some else (events, meta)
    log = clean.clean_events(light, light_meta, tasks)
    table = bucketed_table(sequences.sequence_columns(clean.describe_events(log)), "cookie_id", "sequence-columns", tasks)
    found = sequences.feature_table(light_meta, table, families, buckets=tasks)
    if not some:
        return found
    own_meta = meta.join(heavy, "cookie_id", "left_semi")
    chunks = sequence_columns(clean.describe_events(chunked_events(events.join(heavy, "cookie_id", "left_semi"), own_meta, heavy_rows)))
    return found.unionByName(sequences.feature_table(own_meta, chunks, families, spread=True))
