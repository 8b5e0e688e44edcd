"""From a raw log to clean, canonically ordered events, with checks and an audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from gaitprint.functions import text
from gaitprint.operators import pruning
from gaitprint.sources.tables import EVENT_COLUMNS, META_TIMES

#: Events of one task, about: a visitor's rows stay together, each becomes dozens of values, and their counts are held in memory.
TASK_EVENTS = 50_000
#: Tasks of a short log for each core, about.
TASKS_PER_CORE = 3
LABELS = ("event_name", "item_category", "item_location", "seller_type")
# The canonical order of a visitor's events (nulls come last), and the names of the audit's counters below.
ORDER = ("event_ts", "event_name", "item_id", "search_page", "platform", "user_agent", "pointer_x", "pointer_y", "item_category", "item_location", "seller_type", "search_query", "eid")


def cookie_violations(cookies: DataFrame, labeled: bool) -> DataFrame:
    """One row of counts that must all be 0: bad or repeated ids, missing times, bad windows, bad targets."""
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in META_TIMES])
    checks = {
        "missing_ids": F.count_if(F.col("cookie_id").isNull()),
        "repeated_ids": F.count("cookie_id") - F.count_distinct("cookie_id"),
        "missing_times": F.count_if(missing),
        "empty_windows": F.count_if(F.col("window_end_ts") <= F.col("window_start_ts")),
        "created_late": F.count_if(F.col("cookie_created_at") > F.col("window_end_ts")),
    }
    if labeled:
        checks["bad_targets"] = F.count_if(F.col("target").isNull() | ~F.col("target").isin(0, 1))
    return cookies.agg(*[v.alias(k) for k, v in checks.items()])


def overlapping_cookies(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("cookie_id").intersect(test.select("cookie_id"))


def unknown_cookies(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Visitors of the log that the metadata don't have, with their events."""
    return events.join(meta.select("cookie_id"), "cookie_id", "left_anti").groupBy("cookie_id").agg(F.count(F.lit(1)).alias("n"))


def require(violations: DataFrame) -> None:
    """Fail if a row of counts has any above 0."""
    bad = {k: v for k, v in violations.first().asDict().items() if v}
    if bad:
        raise ValueError(f"checks failed: {bad}")


def check_inputs(train: DataFrame, test: DataFrame, events: DataFrame) -> None:
    """All checks on what is read; raises on the first that fails."""
    check_visitors(train, test)
    if set(events.columns) != set(EVENT_COLUMNS):
        raise ValueError("unexpected event columns")
    require(events.agg(*[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("cookie_id", "event_ts", "event_name")]))
    require(unknown_cookies(events, all_cookies(train, test)).agg(F.count(F.lit(1)).alias("unknown_cookies")))


def check_visitors(train: DataFrame, test: DataFrame) -> None:
    """All checks on the visitor tables; raises on the first that fails."""
    if "target" in test.columns:
        raise ValueError("test visitors must not have a target")
    require(cookie_violations(train, True))
    require(cookie_violations(test, False))
    require(overlapping_cookies(train, test).agg(F.count(F.lit(1)).alias("shared_ids")))
    late = train.agg(F.max("window_end_ts").alias("a")).crossJoin(test.agg(F.min("window_start_ts").alias("b")))  # one row each
    require(late.select((F.col("a") > F.col("b")).cast("int").alias("train_ends_after_test_starts")))


def all_cookies(train: DataFrame, test: DataFrame) -> DataFrame:
    """The metadata of both tables; targets and places stay out, so that no feature can see them."""
    return train.select("cookie_id", *META_TIMES).unionByName(test.select("cookie_id", *META_TIMES))


def in_window(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Each event with its visitor's times, from the window's start on and before its end."""
    joined = events.select(*EVENT_COLUMNS).join(meta.select("cookie_id", *META_TIMES), "cookie_id")
    return joined.where("event_ts >= window_start_ts AND event_ts < window_end_ts")


def normal(events: DataFrame) -> DataFrame:
    """Text columns in their normal forms."""
    return events.withColumns({c: text.label(c) for c in LABELS} | {"platform": text.platform(), "search_query": text.query(), "user_agent": text.user_agent()})


def tasks_for(spark: SparkSession, events: int) -> int:
    """Tasks that a log of so many events is hashed into: one for about :data:`TASK_EVENTS`, and for short logs a few per core, if shuffles have as many.

    A task costs a few tenths of a second and hundreds of megabytes of first pages however few its events are.  Never
    the very number that shuffles have: a join's shuffle would then stand for it, whose parts adaptive execution
    puts together by their compressed bytes, a handful of tasks whatever their events become.
    """
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(shuffles, TASKS_PER_CORE * spark.sparkContext.defaultParallelism) + 1, -(-events // TASK_EVENTS))
    return tasks + (tasks == shuffles)


def clean_events(events: DataFrame, meta: DataFrame, partitions: int | None = None) -> DataFrame:
    """Window, exact duplicates, normal forms, and ``rn``: each event's place in its visitor's canonical order.

    The log is hashed by visitor once, into ``partitions`` (by default as many as its events ask for), and stays so.
    """
    hashed = in_window(events, meta).repartition(partitions or tasks_for(events.sparkSession, events.count()), "cookie_id")
    plain = normal(hashed.dropDuplicates(list(EVENT_COLUMNS)))
    w = Window.partitionBy("cookie_id").orderBy(*[F.asc_nulls_last(c) for c in ORDER])
    return plain.withColumn("rn", F.row_number().over(w))


def describe_events(clean: DataFrame) -> DataFrame:
    """Clean events with relative time, calendar parts, time buckets and what the user agent tells."""
    ua = F.col("user_agent")
    t = F.expr("timestampdiff(MICROSECOND, window_start_ts, event_ts) / 1e6D")
    base = clean.withColumns({"t": t, "hour": F.hour("event_ts"), "second": F.second("event_ts"), "ua_family": text.family(ua), "ua_os": text.system(ua), "ua_automated": text.automated(ua)})
    mismatch = F.expr("coalesce((platform = 'ios' AND ua_os <> 'ios') OR (platform = 'android' AND ua_os <> 'android') OR (platform = 'web' AND ua_os IN ('android', 'ios')), false)")
    return base.withColumns({"minute_bucket": F.floor(F.col("t") / 60), "five_minute_bucket": F.floor(F.col("t") / 300), "mismatch": mismatch, "nn": F.coalesce("event_name", F.lit("<NA>"))})


def audit(events: DataFrame, meta: DataFrame) -> DataFrame:
    """key, value: what the window and the duplicates removed.

    Rows are counted where they lie; whole rows are compared only where fingerprints meet (:func:`pruning.exact_copies`).
    """
    joined = events.select(*EVENT_COLUMNS).join(meta.select("cookie_id", *META_TIMES), "cookie_id")
    inside = (F.col("event_ts") >= F.col("window_start_ts")) & (F.col("event_ts") < F.col("window_end_ts"))
    # Sums per visitor first: visitors without events then come from one row per visitor, and the log is read once.
    per_visitor = joined.groupBy("cookie_id").agg(
        F.count(F.lit(1)).alias("raw_events"),
        F.count_if(F.col("event_ts") < F.col("window_start_ts")).alias("events_before_window"),
        F.count_if(F.col("event_ts") >= F.col("window_end_ts")).alias("events_at_or_after_window_end"),
        F.count_if(inside).alias("in_window_events_before_deduplication"),
        F.count_if(inside & (F.col("event_ts") < F.col("cookie_created_at"))).alias("events_before_cookie_creation_in_window"),
    )
    names = per_visitor.columns[1:]
    all_ = meta.select("cookie_id").join(per_visitor, "cookie_id", "left")
    counters = all_.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.count_if(F.coalesce("in_window_events_before_deduplication", F.lit(0)) == 0).alias("cookies_without_events"))
    extra = pruning.exact_copies(joined, [*EVENT_COLUMNS, *META_TIMES]).withColumn("more", F.col("c") - 1)
    copies = extra.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("raw_exact_duplicates"), F.coalesce(F.sum(F.when(inside, F.col("more"))), F.lit(0)).alias("in_window_exact_duplicates"))
    both = counters.crossJoin(copies).withColumn("usable_events", F.col("in_window_events_before_deduplication") - F.col("in_window_exact_duplicates"))  # one row each
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in both.columns])).alias("x")).select("x.key", "x.value")


def observed_events(events: DataFrame, meta: DataFrame) -> tuple[DataFrame, Observation]:
    """The events in their visitors' windows, and what the one pass over the log sees besides: checks, audit and null fractions.

    The observation is filled by the first action on the events.  Copies are still in; who cleans them knows how many.
    """
    seen = Observation("log")
    joined = events.select(*EVENT_COLUMNS).join(meta.select("cookie_id", *META_TIMES), "cookie_id", "left")
    ts, start, end = F.col("event_ts"), F.col("window_start_ts"), F.col("window_end_ts")
    told = joined.observe(
        seen, F.count(F.lit(1)).alias("raw_events"), F.count_if(start.isNull()).alias("unknown_events"), F.count_if(ts < start).alias("events_before_window"),
        F.count_if(ts >= end).alias("events_at_or_after_window_end"), F.count_if((ts >= start) & (ts < end)).alias("in_window_events_before_deduplication"),
        F.count_if((ts >= start) & (ts < end) & (ts < F.col("cookie_created_at"))).alias("events_before_cookie_creation_in_window"),
        F.min(F.when((ts >= start) & (ts < end), ts)).alias("first_ts"), F.max(F.when((ts >= start) & (ts < end), ts)).alias("last_ts"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in EVENT_COLUMNS],
    )
    return told.where((ts >= start) & (ts < end)).select(*EVENT_COLUMNS), seen


def check_observed(seen: Observation) -> dict:
    """What was observed; fails if events lack a key, time or name, or are of unknown visitors."""
    found = seen.get
    bad = {k: found[k] for k in ("missing_cookie_id", "missing_event_ts", "missing_event_name", "unknown_events") if found[k]}
    if bad:
        raise ValueError(f"checks failed: {bad}")
    return found


def null_fractions(events: DataFrame) -> DataFrame:
    """column, null_fraction (6 decimals) of the raw log."""
    row = events.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(c) for c in EVENT_COLUMNS])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_fraction")) for c in EVENT_COLUMNS])).alias("x")).select("x.column", "x.null_fraction")


def value_counts(clean: DataFrame) -> DataFrame:
    """column, value, n of event names and normal platforms, without nulls."""
    long = clean.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("event_name", "platform")])).alias("x")).select("x.*")
    return long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def time_range(clean: DataFrame) -> DataFrame:
    return clean.agg(F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))
