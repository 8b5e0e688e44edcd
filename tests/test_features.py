"""A visit worked out by hand, and invariants of the feature table over random logs."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from gaitprint.operators import catalogue as C
from gaitprint.operators import clean, ensemble, sequences
from gaitprint.sources.staging import bucketed_table
from gaitprint.sources.tables import EVENT_COLUMNS

OPENS = dt.datetime(2031, 9, 15, 4, 30)
HOURS = 6
SCHEMA = "cookie_id string, event_ts timestamp_ntz, eid bigint, event_name string, platform string, user_agent string, item_id double, item_category string, item_location string, seller_type string, search_query string, search_page double, pointer_x double, pointer_y double"
META = "cookie_id string, cookie_created_at timestamp_ntz, window_start_ts timestamp_ntz, window_end_ts timestamp_ntz"
YANDEX = "Mozilla/5.0 (X11; Linux x86_64) YaBrowser/24.1"


def visitors(spark, ages=(("busy", 36.0), ("quiet", -0.5))):
    """Visitors and by how many hours each is older than its window."""
    return spark.createDataFrame([(c, OPENS - dt.timedelta(hours=h), OPENS, OPENS + dt.timedelta(hours=HOURS)) for c, h in ages], META)


def row(second, name, item=None, at=(None, None), page=None, query=None, who="busy", agent=YANDEX, platform="ANDROID", eid=1):
    category = None if item is None else "\tBikes "
    return (who, OPENS + dt.timedelta(seconds=second), eid, name, platform, agent, item, category, None, None, query, page, *at)


def visit():
    """Seconds 0 to 21,599 lie in the window; the login at -45 and the last row don't, and the second view of item 8 is there twice."""
    return [
        row(-45, "login"),
        row(0, "Login", agent="Scrapy/2.11", platform=" Desktop "),
        row(120, "search_results_view", page=2.0, query="Red \t bike"),
        row(150, "search_results_view", page=3.0, query=" red BIKE"),
        row(150, "item_view", 7.0, (3.0, 4.0)),
        row(400, "favorite_add", 7.0, (3.0, 4.0)),
        row(2500, "item_view", 8.0, (6.0, 8.0)),
        row(2500, "item_view", 8.0, (6.0, 8.0)),
        row(2560, "contact_chat_open", 8.0, (6.0, 16.0)),
        row(21_599, "captcha_shown"),
        row(21_600, "seller_page_view", 8.0),
    ]


def table(spark, rows, who=None, families="all"):
    who = who if who is not None else visitors(spark)
    log = clean.clean_events(spark.createDataFrame(rows, SCHEMA), who, 4)
    seq = bucketed_table(sequences.sequence_columns(clean.describe_events(log)), "cookie_id", "sequence-columns")
    return {r["cookie_id"]: r.asDict() for r in sequences.feature_table(who, seq, families).collect()}


@pytest.fixture(scope="module")
def visited(spark):
    return table(spark, visit())


def check(got, wanted):
    for name, value in wanted.items():
        assert got[name] == pytest.approx(value, abs=1e-9), name


def test_clean_log_and_audit(spark):
    events, who = spark.createDataFrame(visit(), SCHEMA), visitors(spark)
    log = clean.clean_events(events, who).orderBy("rn").collect()
    # At second 150 the view comes first, as its name does.
    assert [(r["rn"], r["event_name"]) for r in log] == list(enumerate("login search_results_view item_view search_results_view favorite_add item_view contact_chat_open captcha_shown".split(), 1))
    assert [r["platform"] for r in log] == ["web"] + ["android"] * 7 and {r["search_query"] for r in log} == {None, "red bike"} and {r["item_category"] for r in log} == {None, "bikes"}
    found = {r["key"]: r["value"] for r in clean.audit(events, who).collect()}
    assert found == {
        "raw_events": 11, "raw_exact_duplicates": 1, "events_before_window": 1, "events_at_or_after_window_end": 1, "in_window_events_before_deduplication": 9,
        "in_window_exact_duplicates": 1, "events_before_cookie_creation_in_window": 0, "usable_events": 8, "cookies_without_events": 1,
    }


def test_counts_shares_and_summaries(visited):
    check(visited["busy"], {
        "n_events": 8, "has_events": 1, "event_item_view_count": 2, "event_item_view_share": 2 / 8, "event_photo_swipe_count": 0, "event_photo_swipe_share": 0,
        # Seconds of the clock: 0 0 30 30 40 40 40 59.
        "second_nunique": 4, "second_top_share": 3 / 8, "second_entropy": 1 + 3 / 8 * math.log2(8 / 3) + 3 / 8, "second_concentration": 18 / 64,
        "seller_type_nunique": 0, "seller_type_top_share": -1, "item_id_nunique": 2, "item_id_entropy": 1, "item_id_present_share": 4 / 8, "search_query_present_share": 2 / 8,
        "platform_web_share": 1 / 8, "platform_android_share": 7 / 8, "ua_family_yandex_share": 7 / 8, "ua_family_other_share": 1 / 8, "ua_os_linux_share": 7 / 8,
        "ua_automated_share": 1 / 8, "ua_platform_mismatch_share": 7 / 8, "web_pointer_x_present_share": 0,
        "search_page_mean": 2.5, "search_page_std": math.sqrt(0.5), "search_page_min": 2, "search_page_max": 3, "search_page_median": 2.5, "search_page_nunique": 2, "search_page_range": 1,
        "search_first_page_share": 0, "search_deep_page_share": 0, "night_event_share": 7 / 8, "contact_event_share": 1 / 8, "engagement_event_share": 2 / 8,
        "query_length_mean": 8, "query_words_max": 2, "query_digits_mean": 0, "query_cyrillic_std": 0,
        # Hours 4 (five times), 5 (twice) and 10; minutes 0 2 2 2 6 41 42 359; fives of minutes 0 0 0 0 1 8 8 71.
        "hour_active_count": 3, "hour_events_max": 5, "hour_events_mean": 8 / 3, "hour_top_share": 5 / 8,
        "minute_bucket_active_count": 6, "minute_bucket_events_max": 3, "five_minute_bucket_active_count": 4, "five_minute_bucket_top_share": 4 / 8,
        "cookie_age_days": 1.5, "cookie_age_log1p": math.log(2.5), "cookie_created_within_window": 0, "window_weekday": 0,
        "unique_items_per_event": 2 / 8, "unique_queries_per_search": 1 / 2, "phone_per_item_view": 0, "favorites_per_item_view": 1 / 2, "messages_per_chat": 0,
        "log1p_events": math.log(9), "log1p_unique_items": math.log(3),
    })
    check(visited["quiet"], {
        "n_events": 0, "has_events": 0, "event_login_count": 0, "event_login_share": -1, "item_id_nunique": 0, "gap_median": -1, "cookie_created_within_window": 1, "cookie_age_days": 0,
        "v2_pointer_observation_count": 0, "v2_cadence_all_mean": -1, "v2_session_300_size_mean": -1, "log1p_events": 0, "messages_per_chat": -1,
    })


def test_gaps_sessions_runs_and_moves(visited):
    # Gaps 120 30 0 250 2100 60 19039; sessions of 5, 2 and 1 events, 400, 60 and 0 seconds long.
    check(visited["busy"], {
        "gap_mean": 21_599 / 7, "gap_median": 120, "gap_q10": 18, "gap_q90": 8875.6, "gap_max": 19_039, "gap_relative_iqr": (1175 - 45) / 120, "gap_le_0_share": 1 / 7, "gap_le_30_share": 2 / 7,
        "gap_le_60_share": 3 / 7, "gap_le_300_share": 5 / 7, "gap_le_1800_share": 5 / 7, "gap_top_share": 1 / 7, "gap_unique_share": 1, "within_session_gap_mean": 92, "within_session_gap_max": 250,
        "first_event_seconds": 0, "last_event_seconds": 21_599, "span_seconds": 21_599, "events_per_span_minute": 480 / 21_599,
        "session_count": 3, "session_events_max": 5, "session_events_mean": 8 / 3, "session_single_event_share": 1 / 3, "session_span_max": 400, "session_span_sum": 460,
        "same_action_share": 0, "action_run_max": 1, "action_run_mean": 1, "action_run_count": 8, "transition_entropy": math.log2(7),
        "transition_item_view_to_search_results_view_share": 1 / 7, "transition_item_view_to_contact_chat_open_share": 1 / 7, "transition_item_view_to_favorite_add_share": 0,
        "item_view_repeat_share": 0, "item_view_gap_mean": 2350, "item_category_switch_share": 4 / 7, "platform_switch_share": 1 / 7, "user_agent_switch_share": 1 / 7,
        "search_page_next_share": 1, "search_page_skip_share": 0, "search_gap_mean": 30,
        # Steps of the pointer: (0, 0) in 250 seconds, (3, 4) in 2100, (0, 8) in 60.
        "pointer_distance_mean": 13 / 3, "pointer_distance_max": 8, "pointer_stationary_share": 1 / 3, "pointer_axis_aligned_share": 2 / 3, "pointer_unique_share": 3 / 4,
        "pointer_speed_mean": (5 / 2100 + 8 / 60) / 3, "pointer_path_efficiency": math.hypot(3, 12) / 13,
    })


def test_rhythm_order_and_pointer_cloud(visited):
    # The rhythm of all: 120 30 0 250 60; neighbours deviate by 20 -70 -100 150 and -55 -85 165 -25 from their means.
    check(visited["busy"], {
        "v2_cadence_all_mean": 92, "v2_cadence_all_std": math.sqrt(7816), "v2_cadence_all_cv": math.sqrt(7816) / 92, "v2_cadence_all_mad_ratio": 1, "v2_cadence_all_iqr_ratio": 1.5,
        "v2_cadence_all_q90_q10_ratio": 198 / 12, "v2_cadence_all_entropy": math.log2(5), "v2_cadence_all_mode_share": 1 / 5, "v2_cadence_all_unique_share": 1,
        "v2_cadence_all_near_median_share": 1 / 5, "v2_cadence_all_autocorrelation": -15_400 / math.sqrt(37_800 * 38_100),
        "v2_cadence_views_mean": -1, "v2_cadence_searches_mean": 30, "v2_cadence_searches_autocorrelation": -1, "v2_views_unique_item_fraction": 1,
        "v2_views_category_entropy": 0, "v2_views_category_unique_fraction": 1 / 2, "v2_views_events_per_category": 2, "v2_searches_query_unique_fraction": 1 / 2, "v2_searches_events_per_category": 2,
        "v2_session_300_size_mean": 8 / 3, "v2_session_1800_span_max": 400, "v2_session_300_cv_mean": math.sqrt(9450) / 100, "v2_session_300_dominant_fraction": 5 / 8,
        "v2_session_300_activity_rate": 8 / 460, "v2_session_1800_short_fraction": 2 / 3,
        # The view and the search of one second follow each other in no order.
        "v2_ordered_transition_entropy": math.log2(6), "v2_ordered_same_action_fraction": 0, "v2_after_item_view_contact_chat_open_fraction": 1, "v2_after_item_view_search_results_view_fraction": 0,
        "v2_after_search_results_view_item_view_fraction": 1 / 2, "v2_after_search_results_view_favorite_add_fraction": 1 / 2, "v2_after_photo_swipe_item_view_fraction": -1,
        "v2_triple_entropy": 2, "v2_triple_unique_fraction": 1,
        "v2_viewed_items_with_favorite_fraction": 1 / 2, "v2_viewed_items_with_contact_fraction": 1 / 2, "v2_viewed_items_with_seller_fraction": 0, "v2_favorite_items_without_view_fraction": 0,
        "v2_photo_items_without_view_fraction": -1, "v2_per_item_events_mean": 2, "v2_per_item_action_types_max": 2, "v2_contact_latency_median": 60, "v2_items_with_multiple_actions_fraction": 1,
        "v2_same_query_page_next_fraction": 1, "v2_same_query_page_repeat_fraction": 0, "v2_search_query_switch_fraction": 0, "v2_per_query_depth_mean": 3, "v2_per_query_page_coverage_mean": 1,
        # Points (3, 4) twice, (6, 8) and (6, 16).
        "v2_pointer_present_given_item_view": 1, "v2_pointer_present_given_search_results_view": 0, "v2_pointer_present_given_photo_swipe": -1, "v2_pointer_observation_count": 4,
        "v2_pointer_x_entropy": 1, "v2_pointer_y_entropy": 1.5, "v2_pointer_y_unique_fraction": 3 / 4, "v2_pointer_xy_correlation": 6 / (1.5 * math.sqrt(24)), "v2_pointer_spread_anisotropy": 1.5 / math.sqrt(24),
        "v2_pointer_turn_cosine_mean": 0.8, "v2_pointer_direction_change_fraction": 0, "v2_pointer_step_mean": 13 / 3, "v2_pointer_step_max": 8,
    })


def test_pages_items_and_contacts_in_disorder(spark):
    rows = [
        row(10, "search_results_view", page=4.0, query="sofa"), row(20, "search_results_view", page=4.0, query="sofa"), row(35, "search_results_view", page=1.0, query="sofa"),
        row(36, "search_results_view", page=6.0, query=None), row(37, "search_results_view", page=7.0, query="лампа 5"),
        row(50, "contact_phone_show", 1.0), row(60, "item_view", 1.0), row(75, "photo_swipe", 1.0), row(75, "item_view", 2.0), row(95, "contact_message_sent", 1.0), row(100, "photo_swipe", 3.0),
    ]
    check(table(spark, rows)["busy"], {
        # Pages 4 4 1 6 7 whatever the query; within "sofa" 4 4 1.
        "search_page_repeat_share": 1 / 4, "search_page_back_share": 1 / 4, "search_page_skip_share": 1 / 4, "search_page_next_share": 1 / 4, "search_deep_page_share": 4 / 11, "search_first_page_share": 1 / 11,
        "v2_same_query_page_repeat_fraction": 1 / 2, "v2_same_query_page_back_fraction": 1 / 2, "v2_search_query_switch_fraction": 2 / 4, "v2_per_query_depth_max": 7, "v2_per_query_depth_mean": 5.5,
        "v2_per_query_page_coverage_mean": (2 / 4 + 1) / 2, "query_cyrillic_max": 5 / 7, "query_digits_max": 1 / 7, "query_words_mean": 5 / 4,
        # The first contact of item 1 came before it was seen, so the next one counts: 95 - 60.
        "v2_contact_latency_max": 35, "v2_viewed_items_with_contact_fraction": 1 / 2, "v2_viewed_items_with_photo_fraction": 1 / 2, "v2_photo_items_without_view_fraction": 1 / 2,
        "v2_contact_items_without_view_fraction": 0, "v2_items_with_multiple_actions_fraction": 1 / 3, "v2_per_item_events_max": 4, "v2_per_item_action_types_mean": 2,
        "v2_cadence_contacts_mean": 45, "v2_cadence_views_mean": 15, "phone_per_item_view": 1 / 2, "photos_per_item_view": 1, "action_run_max": 5, "v2_pointer_observation_count": 0,
    })


def random_log(seed, who=("busy", "quiet"), n=60):
    rng = random.Random(seed)
    return [
        row(
            rng.choice((0, 0, 5, 90, 400, 3000)) + rng.randrange(8000), rng.choice((*C.EVENT_TYPES, None)), rng.choice((None, 1.0, 2.0, 3.0)),
            rng.choice(((None, None), (1.0, 2.0), (float(rng.randrange(9)), 5.0))), rng.choice((None, 1.0, 2.0)), rng.choice((None, " ", "a b", "ж 1")), rng.choice(who), eid=rng.randrange(3),
        )
        for _ in range(n)
    ]


def test_invariants_of_random_logs(spark):
    rows = random_log(5)
    known = table(spark, rows)
    assert len(known["busy"]) == 473 and all(isinstance(v, float) and math.isfinite(v) for k, v in known["busy"].items() if k != "cookie_id")
    # Order, copies and rows outside of the window change nothing.
    again = rows + rows[::3] + [row(-1, "login"), row(HOURS * 3600, "login"), row(10**6, "item_view", 9.0)]
    random.Random(1).shuffle(again)
    assert table(spark, again) == known
    # Other names of visitors and items change nothing, nor does who else is there; base alone is the same base.
    named = {"busy": "x", "quiet": "y"}
    renamed = [(named[r[0]], *r[1:6], None if r[6] is None else 50 - r[6], *r[7:]) for r in rows]
    other = table(spark, renamed, visitors(spark, (("x", 36.0), ("y", -0.5))))
    for a, b in named.items():
        check({k: v for k, v in other[b].items() if k != "cookie_id"}, {k: v for k, v in known[a].items() if k != "cookie_id"})
    alone = table(spark, rows, visitors(spark, (("busy", 36.0),)), "base")["busy"]
    assert len(alone) == 251 and alone == {k: known["busy"][k] for k in alone}


def test_catalogue():
    base, v2 = C.features()
    assert len(base) == 250 and len(v2) == 222 and all(n.startswith("v2_") for n in v2) and not set(base) & {"cookie_id", "target"}


def test_bad_inputs_fail(spark):
    who, events = visitors(spark), spark.createDataFrame(visit(), SCHEMA)
    train, test = who.where("cookie_id = 'busy'").withColumn("target", F.lit(1)), who.where("cookie_id = 'quiet'")
    later = test.withColumns({"window_start_ts": F.expr("window_end_ts"), "window_end_ts": F.expr("window_end_ts + interval 6 hours")})
    clean.check_inputs(train, later, events)
    assert set(events.columns) == set(EVENT_COLUMNS)
    for a, b, c, what in (
        (train, later, events.union(spark.createDataFrame([row(5, "login", who="stranger")], SCHEMA)), "unknown_cookies"),
        (train.withColumn("target", F.lit(7)), later, events, "bad_targets"),
        (train, later.withColumn("cookie_id", F.lit("busy")), events, "shared_ids"),
        (train, test, events, "train_ends_after_test_starts"),
        (train.union(train), later, events, "repeated_ids"),
        (train, later.withColumn("window_end_ts", F.col("window_start_ts")), events, "empty_windows"),
        (train, later, events.withColumn("event_name", F.lit(None).cast("string")), "missing_event_name"),
        (train, later, events.drop("eid"), "event columns"),
        (train, later.withColumn("target", F.lit(0)), events, "must not have a target"),
    ):
        with pytest.raises(ValueError, match=what):
            clean.check_inputs(a, b, c)


def test_union_and_split_keep_places(spark):
    train = visitors(spark, (("b", 1.0), ("a", 2.0))).withColumns({"target": F.lit(1), "row_ord": F.when(F.col("cookie_id") == "b", 0).otherwise(1)})
    test = visitors(spark, (("c", 1.0),)).withColumn("row_ord", F.lit(0))
    both = clean.all_cookies(train, test)
    assert "target" not in both.columns and sorted(r["cookie_id"] for r in both.collect()) == ["a", "b", "c"]
    features = both.select("cookie_id", F.lit(1.0).alias("x"))
    ours, theirs = ensemble.split_back(features, train, test)
    assert [(r["row_ord"], r["cookie_id"], r["target"]) for r in ours.orderBy("row_ord").collect()] == [(0, "b", 1), (1, "a", 1)]
    assert [tuple(r) for r in theirs.select("row_ord", "cookie_id", "x").collect()] == [(0, "c", 1.0)] and "target" not in theirs.columns
    with pytest.raises(ValueError, match="features"):
        ensemble.split_back(features.where("cookie_id <> 'a'"), train, test)


def test_fingerprint_and_differences(spark):
    a = spark.createDataFrame([("x", 1.0, 2.0), ("y", 3.0, 4.0)], "cookie_id string, p double, q double")
    b = a.withColumn("q", F.when(F.col("cookie_id") == "y", 4.5).otherwise(F.col("q")))
    assert ensemble.fingerprint(a, "cookie_id").collect() == ensemble.fingerprint(a.orderBy(F.desc("cookie_id")), "cookie_id").collect() != ensemble.fingerprint(b, "cookie_id").collect()
    assert ensemble.differences(a, a).count() == 0 and [r[0] for r in ensemble.differences(a, b).collect()] == ["y"]
    assert [r[0] for r in ensemble.differences(a, a.where("cookie_id = 'x'")).collect()] == ["y"]
    with pytest.raises(ValueError):
        ensemble.differences(a, a.select("cookie_id", "q", "p"))


def test_fits_read_rows_written_once(spark, monkeypatch, capsys):
    """What a fit reads is neither joined nor shuffled again, and its tasks hold a bounded number of visitors."""
    monkeypatch.setattr(ensemble, "TASK_VISITORS", 5)
    specs = {"few": {"families": "base", "maxDepth": 1, "maxIter": 1, "stepSize": 0.1}, "most": {"families": "all", "maxDepth": 1, "maxIter": 1, "stepSize": 0.1}}
    table = spark.range(100).selectExpr("concat('c', id) AS cookie_id", "CAST(id % 2 AS int) AS target", "CAST(id % 2 AS double) AS a", "CAST(id AS double) AS v2_b")
    roles = spark.range(100).selectExpr("concat('c', id) AS cookie_id", "explode(array(1, 2)) AS fold", "CASE WHEN id < 40 * fold THEN 'fit' WHEN id < 80 + 10 * fold THEN 'valid' END AS role").where("role IS NOT NULL")
    written = ensemble.vector_table(table, specs)
    assert written.columns == ["cookie_id", "target", "vector_all", "vector_base"] and written.count() == 100
    files = written.selectExpr("input_file_name() AS f").groupBy("f").count().collect()
    assert len(files) >= 15 and max(r["count"] for r in files) < 20
    fits, at_once = [], ensemble.fit_at_once

    def watched(wanted):
        for key, (rows, _) in wanted.items():
            capsys.readouterr()
            rows.explain()
            plan = capsys.readouterr().out
            assert "Join" not in plan and "Exchange" not in plan, key
            fits.append((key, rows.count()))
        return at_once(wanted)

    monkeypatch.setattr(ensemble, "fit_at_once", watched)
    scores = ensemble.out_of_time_scores(table, roles, specs).collect()
    assert sorted(fits) == [((1, "few"), 40), ((1, "most"), 40), ((2, "few"), 80), ((2, "most"), 80)]
    assert len(scores) == 2 * (50 + 20) and all((r["score"] > 0.5) == (r["target"] == 1) for r in scores)
    assert set(ensemble.fit_models(table, specs)) == set(specs)
