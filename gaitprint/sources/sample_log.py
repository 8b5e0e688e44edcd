"""Visitors and an event log derived from the driver's ``events`` table, for queries and tests.

The expressions are SQL text; what differs between engines comes from a dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "micros": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)",
    "time": lambda x: f"timestampadd(SECOND, cast({x} as int), TIMESTAMP_NTZ'2024-01-01 00:00:00')",
}
DUCKDB = {
    "micros": "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))",
    "time": lambda x: f"(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(cast({x} as bigint)))",
}
DAY = 86_400


def meta_columns(dialect: dict) -> list[str]:
    """Of a relation (name, u, d): name is the cookie, u its number, d its day."""
    time = dialect["time"]
    start = f"(d * {DAY} + (u % 3) * 3600)"
    return [
        "name AS cookie_id",
        time(f"{start} + CASE WHEN u % 11 = 0 THEN 3600 ELSE -((u * 37) % 400) * 3600 END") + " AS cookie_created_at",
        time(start) + " AS window_start_ts",
        time(f"{start} + 22 * 3600") + " AS window_end_ts",
        "CAST(CASE WHEN substr(name, 1, 1) = 'u' AND u % 5 = 0 THEN 1 ELSE 0 END AS int) AS target",
        "d < 11 AS is_train",
    ]


def base_columns(dialect: dict) -> list[str]:
    return [
        "user_id AS u", "event_id AS id", "event_type AS kind", "value",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k",
        f"CAST(floor({dialect['micros']} / 30000000.0) AS bigint) AS s",
    ]


NAME = """CASE kind WHEN 'view' THEN CASE WHEN k % 3 < 2 THEN 'item_view' ELSE 'search_results_view' END
 WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'photo_swipe' WHEN 1 THEN 'search_results_view' ELSE 'seller_page_view' END
 WHEN 'purchase' THEN CASE k % 3 WHEN 0 THEN 'contact_phone_show' WHEN 1 THEN 'contact_chat_open' ELSE 'contact_message_sent' END
 WHEN 'signup' THEN CASE k % 3 WHEN 0 THEN 'favorite_add' WHEN 1 THEN 'login' ELSE 'item_view' END
 ELSE CASE WHEN k % 3 = 0 THEN 'captcha_shown' ELSE 'item_view' END END AS base"""


def event_columns(dialect: dict) -> list[str]:
    """Of a relation with base_columns and base; has tells whether the event has an item."""
    has = "base NOT IN ('search_results_view', 'login', 'captcha_shown')"
    search = "base = 'search_results_view'"
    pointed = "u % 4 >= 2 AND id % 5 <> 0"
    seconds = f"(u % 14) * {DAY} + CASE WHEN u % 5 = 0 THEN s - s % 600 ELSE s END"
    return [
        "concat('u', CAST(u AS string)) AS cookie_id",
        dialect["time"](seconds) + " AS event_ts",
        "k AS eid",
        "CASE WHEN id % 7 = 0 THEN concat('  ', upper(base), ' ') ELSE base END AS event_name",
        "CASE u % 4 WHEN 0 THEN 'android' WHEN 1 THEN 'iPhone' WHEN 2 THEN 'Desktop' ELSE 'WEB' END AS platform",
        """CASE WHEN id % 31 = 0 THEN NULL ELSE CASE (u + id % 2) % 6 WHEN 0 THEN 'Mozilla/5.0 (Windows) Chrome/126.0'
 WHEN 1 THEN 'Mozilla/5.0 (iPhone) Safari/604' WHEN 2 THEN 'Mozilla/5.0 (Android) Chrome/118.0' WHEN 3 THEN 'Mozilla/5.0 (X11; Linux) Firefox/120'
 WHEN 4 THEN 'HeadlessChrome/120.0 Linux' ELSE 'python-requests/2.31' END END AS user_agent""",
        f"CASE WHEN {has} THEN CAST(k % 12 AS double) END AS item_id",
        f"CASE WHEN {has} THEN concat(' Cat', CAST(k % 4 AS string), ' ') END AS item_category",
        f"CASE WHEN {has} AND id % 9 <> 0 THEN concat('loc', CAST(k % 5 AS string)) END AS item_location",
        f"CASE WHEN {has} THEN CASE WHEN k % 2 = 0 THEN 'private' ELSE 'PRO' END END AS seller_type",
        f"CASE WHEN {search} THEN CASE WHEN id % 13 = 0 THEN '   ' ELSE CASE k % 3 WHEN 0 THEN '  Used   VAN ' WHEN 1 THEN 'boat 42' ELSE 'дом у моря' END END END AS search_query",
        f"CASE WHEN {search} THEN CAST(1 + id % 4 AS double) END AS search_page",
        f"CASE WHEN {pointed} THEN CAST(CAST(floor(value) AS bigint) % 40 * 10 AS double) END AS pointer_x",
        f"CASE WHEN {pointed} THEN CAST(CAST(floor(value * 7) AS bigint) % 300 AS double) END AS pointer_y",
    ]


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(visitors, events): all users of ``events`` and three visitors without events; every 50th event twice."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = rows.select("user_id").distinct().selectExpr("concat('u', CAST(user_id AS string)) AS name", "user_id AS u", "user_id % 14 AS d")
    quiet = spark.range(3).selectExpr("concat('empty', CAST(id AS string)) AS name", "CAST(0 AS bigint) AS u", "id * 6 AS d")
    meta = users.unionByName(quiet).selectExpr(*meta_columns(SPARK))
    events = (
        rows.selectExpr(*base_columns(SPARK))
        .selectExpr("*", NAME)
        .selectExpr("*", "explode(sequence(0, CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END)) AS copy")
        .selectExpr(*event_columns(SPARK))
    )
    return meta, events


#: The same two relations, ``meta`` and ``raw``, for DuckDB.
CTES = f"""users AS (SELECT concat('u', CAST(user_id AS string)) AS name, user_id AS u, user_id % 14 AS d FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT concat('empty', CAST(i AS string)), CAST(0 AS bigint), i * 6 FROM (VALUES (0), (1), (2)) q(i)),
meta AS (SELECT {", ".join(meta_columns(DUCKDB))} FROM users),
raw0 AS (SELECT {", ".join(base_columns(DUCKDB))} FROM events),
raw1 AS (SELECT *, {NAME} FROM raw0),
raw2 AS (SELECT * FROM raw1 UNION ALL SELECT * FROM raw1 WHERE id % 50 = 0),
raw AS (SELECT {", ".join(event_columns(DUCKDB))} FROM raw2)"""
