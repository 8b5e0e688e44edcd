"""Reading less of a log: time bounds that reach the scan, and a filter of fixed size for members of a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a member filter; its words are at most a 64th as many rows (262,144, 4 MB), whatever the set.
FILTER_BITS = 24


def within_bounds(events: DataFrame, meta: DataFrame) -> DataFrame:
    """The events from the first window's start to the last one's end; of a log laid out by day, only days of any window.

    The bounds are literals, so a Parquet scan skips what lies outside; days are met in a join that prunes partitions.
    Visitors' own windows are for :func:`gaitprint.operators.clean.in_window` to apply.  Without visitors nothing is left.
    """
    lo, hi = meta.agg(F.min("window_start_ts"), F.max("window_end_ts")).first()
    if lo is None or hi is None:
        return events.where("false").drop("event_day")
    stamp = lambda t: F.expr(f"TIMESTAMP_NTZ'{t.isoformat(sep=' ')}'")
    some = events.where((F.col("event_ts") >= stamp(lo)) & (F.col("event_ts") < stamp(hi)))
    if "event_day" not in events.columns:
        return some
    day = lambda t: F.to_date(F.lit(t.date().isoformat()))
    some = some.where((F.col("event_day") >= day(lo)) & (F.col("event_day") <= day(hi)))
    # As many rows as calendar days, so small enough to send to every task.
    days = meta.select(F.explode(F.expr("sequence(to_date(window_start_ts), to_date(window_end_ts), interval 1 day)")).alias("event_day")).distinct()
    return some.join(F.broadcast(days), "event_day", "left_semi").drop("event_day")


def _place(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def member_filter(keys: DataFrame, columns: list[str]) -> DataFrame:
    """The filter of a set as 64-bit words (filter_word, filter_bits), merged by Spark."""
    place = _place(columns)
    return keys.select(F.shiftright(place, 6).alias("filter_word"), _bit(place).alias("bit")).groupBy("filter_word").agg(F.bit_or("bit").alias("filter_bits"))


def may_be_in(rows: DataFrame, columns: list[str], words: DataFrame) -> DataFrame:
    """Rows whose key may be in the set: all that are, and few others.  Nothing is shuffled."""
    place = _place(columns)
    met = rows.withColumns({"filter_word": F.shiftright(place, 6), "filter_own": _bit(place)}).join(F.broadcast(words), "filter_word")
    return met.where(F.col("filter_bits").bitwiseAND(F.col("filter_own")) != 0).drop("filter_word", "filter_own", "filter_bits")


def events_of(events: DataFrame, cookies: DataFrame) -> DataFrame:
    """The events of some visitors (``cookie_id``); most others' are left out before anything is shuffled."""
    return may_be_in(events, ["cookie_id"], member_filter(cookies, ["cookie_id"])).join(cookies.select("cookie_id").distinct(), "cookie_id", "left_semi")


def exact_copies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each distinct row that is there more than once, with its count c.

    128-bit fingerprints are counted; whole rows are moved and compared only where fingerprints meet.
    """
    prints = rows.select(F.xxhash64(*columns).alias("f"), F.xxhash64(F.lit(1), *columns).alias("g"))
    met = prints.groupBy("f", "g").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    marked = rows.select(*columns, F.xxhash64(*columns).alias("f"), F.xxhash64(F.lit(1), *columns).alias("g"))
    some = may_be_in(marked, ["f", "g"], member_filter(met, ["f", "g"]))
    return some.groupBy(*columns).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
