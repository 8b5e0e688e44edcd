"""Schemas, readers and writers of visitor tables, event logs, features and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitprint.operators.prefix import positions
from gaitprint.operators.pruning import within_bounds

# The columns of the input tables, in their order.
EVENT_COLUMNS = (
    "cookie_id", "event_ts", "eid", "event_name", "platform", "user_agent", "item_id", "item_category",
    "item_location", "seller_type", "search_query", "search_page", "pointer_x", "pointer_y",
)
META_TIMES = ("cookie_created_at", "window_start_ts", "window_end_ts")
NUMBERS = ("item_id", "search_page", "pointer_x", "pointer_y")
#: Formats of timestamps besides the ISO form.
FORMATS = ("yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss")


def parse_time(name: str) -> Column:
    """A zone-less timestamp from text in any known format; other text fails the job."""
    text = F.trim(F.col(name).cast("string"))
    known = [F.expr(f"try_cast(trim(cast(`{name}` as string)) as timestamp_ntz)")]
    known += [F.expr(f"cast(try_to_timestamp(trim(cast(`{name}` as string)), '{f}') as timestamp_ntz)") for f in FORMATS]
    bad = F.raise_error(F.concat(F.lit(f"{name}: not a timestamp: "), text)).cast("timestamp_ntz")
    return F.when(text.isNull() | (text == ""), F.lit(None)).otherwise(F.coalesce(*known, bad)).alias(name)


def parse_number(name: str) -> Column:
    """A double from text; blank and NaN are null, other text fails the job."""
    text = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
    number = F.when(F.lower(text).isin("nan", "na", "null"), F.lit(None)).otherwise(text).cast("double")
    return F.nullif(number, F.lit(float("nan"))).alias(name)


def read_cookies(spark: SparkSession, path: str, labeled: bool, ordered: bool = False) -> DataFrame:
    """A visitor table from CSV: cookie_id as text, three times, target (0/1) if labeled, and on request row_ord, the row's place in the files.

    Places come from where a row's file split starts and from counts per task; no task sees all rows.
    """
    names = ("cookie_id", *META_TIMES, *(("target",) if labeled else ()))
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    target = (F.col("target").cast("int").alias("target"),) if labeled else ()
    if not ordered:
        return rows.select("cookie_id", *map(parse_time, META_TIMES), *target)
    # A task reads its splits one after the other, each from its start to its end.
    where = (F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("line_"))
    placed = positions(rows.select("cookie_id", *map(parse_time, META_TIMES), *target, *where), [], [F.asc("file_"), F.asc("block_"), F.asc("line_")], "visitors", "row_ord")
    return placed.withColumn("row_ord", F.col("row_ord") - 1).drop("file_", "block_", "line_", "part")


def read_events(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """An event log from (gzipped) CSV or from Parquet; spread by visitor, as one gzip file is one task."""
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path)
    else:
        rows = spark.read.schema(", ".join(f"{n} string" for n in EVENT_COLUMNS)).csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    if set(rows.columns) != set(EVENT_COLUMNS):
        raise ValueError(f"unexpected event columns: {sorted(rows.columns)}")
    typed = rows.select("cookie_id", parse_time("event_ts"), F.col("eid").cast("long").alias("eid"), *EVENT_COLUMNS[3:6], parse_number("item_id"), *EVENT_COLUMNS[7:11], *map(parse_number, NUMBERS[1:]))
    return typed.repartition(partitions, "cookie_id") if partitions else typed.repartition("cookie_id")


def write_log(events: DataFrame, path: str) -> None:
    """The log as Parquet, a folder per day, so that a read of some days lists and reads only those."""
    events.withColumn("event_day", F.to_date("event_ts")).repartition("event_day", F.pmod(F.xxhash64("cookie_id"), F.lit(64))).write.partitionBy("event_day").parquet(path)


def read_log(spark: SparkSession, path: str, meta: DataFrame) -> DataFrame:
    """The part of a log of :func:`write_log` that lies in the days and times of any visitor's window."""
    return within_bounds(spark.read.parquet(path), meta).select(*EVENT_COLUMNS)


def write_scores(scores: DataFrame, path: str, order: str = "row_ord") -> None:
    """cookie_id and score as CSV with a header, in the order of ``order``; doubles keep every digit."""
    scores.orderBy(order).select("cookie_id", "score").write.csv(path, header=True)


def write_predictions(long: DataFrame, path: str, recipes: list[str]) -> None:
    """One row per validated visitor, a column per recipe (``long``: cookie_id, window_start_ts, target, recipe, score)."""
    long.groupBy("cookie_id", "window_start_ts", "target").pivot("recipe", recipes).agg(F.first("score")).write.csv(path, header=True)


def write_reports(folder: str, **tables: DataFrame) -> None:
    """Feature tables, audits and importances, each a Parquet table of its name."""
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
