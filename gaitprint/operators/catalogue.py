"""What the feature families are: rows they take, values they summarise, and the 472 features made of them.

Expressions are SQL text over the columns of :mod:`gaitprint.operators.sequences`.  ``fam__stat`` in a
feature's expression is that statistic of that family; other names are columns of the scalar families.
"""

from __future__ import annotations

# Fixed values of the feature definitions.
EVENT_TYPES = (
    "search_results_view", "item_view", "photo_swipe", "seller_page_view", "contact_phone_show", "contact_chat_open",
    "contact_message_sent", "favorite_add", "login", "captcha_shown",
)
GAP_LIMITS = (0, 1, 3, 10, 30, 60, 300, 1800)
LEVELS = {
    "platform": ("web", "android", "ios"),
    "ua_family": ("chrome", "firefox", "yandex", "edge", "safari", "headless", "other"),
    "ua_os": ("windows", "mac", "linux", "android", "ios", "other"),
    "seller_type": ("private", "pro"),
}
PAIRS = (
    ("item_view", "item_view"), ("search_results_view", "search_results_view"), ("search_results_view", "item_view"),
    ("item_view", "search_results_view"), ("item_view", "photo_swipe"), ("photo_swipe", "photo_swipe"),
    ("item_view", "contact_phone_show"), ("item_view", "contact_chat_open"), ("item_view", "seller_page_view"),
    ("item_view", "favorite_add"), ("contact_chat_open", "contact_message_sent"), ("captcha_shown", "item_view"),
)
SOURCES = ("item_view", "search_results_view", "photo_swipe")
DESTINATIONS = ("item_view", "search_results_view", "photo_swipe", "seller_page_view", "favorite_add", "contact_phone_show", "contact_chat_open")
SESSION = 1800
CUTOFFS = (300, 1800)
S6 = ("mean", "std", "median", "q10", "q90", "max")
C16 = (*S6, "cv", "mad_ratio", "iqr_ratio", "q90_q10_ratio", "log_std", "entropy", "mode_share", "unique_share", "near_median_share", "autocorrelation")

CONTACT = "substr(nn, 1, 8) = 'contact_'"
ACTIONS = {"views": "nn = 'item_view'", "searches": "nn = 'search_results_view'", "contacts": CONTACT}
SPREAD = ("item_id", "item_category", "item_location", "seller_type", "search_query", "event_name", "platform", "user_agent", "ua_family", "ua_os", "second")
BUCKETS = ("hour", "minute_bucket", "five_minute_bucket")
PRESENT = ("item_id", "item_category", "item_location", "seller_type", "search_query", "search_page", "pointer_x", "pointer_y")

#: Columns whose numbers are summarised as they are.
MEASURED = ("search_page", "pointer_x", "pointer_y")


def as_text(column: str) -> str:
    """A column's value as text; of numbers -0.0 is 0.0."""
    return f"CAST({column} + 0.0D AS string)" if column in ("item_id", *MEASURED) else f"CAST({column} AS string)"


#: Families of single values: the rows, and the value as text.
VALUES: dict[str, tuple[str, str]] = {c: (f"{c} IS NOT NULL", as_text(c)) for c in (*SPREAD, *BUCKETS, *MEASURED)}
#: Families of numbers in order: the rows, and the number.
NUMBERS: dict[str, tuple[str, str]] = {
    "gap": ("gap IS NOT NULL", "gap"),
    "within_session_gap": (f"gap <= {SESSION}", "gap"),
    "item_view_gap": (f"{ACTIONS['views']} AND lv IS NOT NULL", "t - lv"),
    "search_gap": ("search_page IS NOT NULL AND lp IS NOT NULL", "t - lp.t"),
    "pointer_distance": ("len IS NOT NULL", "len"),
    "pointer_speed": ("dt > 0", "len / dt"),
    "cadence_all": (f"gap <= {SESSION}", "gap"),
    "cadence_views": (f"{ACTIONS['views']} AND t - lv <= {SESSION}", "t - lv"),
    "cadence_searches": (f"{ACTIONS['searches']} AND t - ls.t <= {SESSION}", "t - ls.t"),
    "cadence_contacts": (f"{ACTIONS['contacts']} AND t - lc <= {SESSION}", "t - lc"),
    "pointer_step": ("dt > 0", "len"),
} | {c: (f"{c} IS NOT NULL", c) for c in MEASURED}
CADENCES = ("cadence_all", "cadence_views", "cadence_searches", "cadence_contacts", "pointer_step")
VALUES |= {
    "gap": ("gap IS NOT NULL", "CAST(gap AS string)"),
    "transition": ("pn IS NOT NULL", "concat(pn, '>', nn)"),
    "ordered": ("gap > 0", "concat(pn, '>', nn)"),
    "triple": ("gap > 0 AND pt - pt2 > 0", "concat(pn2, '>', pn, '>', nn)"),
    "pointer_px": ("has_xy", as_text("pointer_x")),
    "pointer_py": ("has_xy", as_text("pointer_y")),
    "pointer_xy": ("has_xy", f"concat({as_text('pointer_x')}, ' ', {as_text('pointer_y')})"),
}
for _a, _is in ACTIONS.items():
    for _f, _c in (("item", "item_id"), ("category", "item_category"), ("location", "item_location"), ("query", "search_query")):
        VALUES[f"{_a}_{_f}"] = (f"{_is} AND {_c} IS NOT NULL", as_text(_c))
for _f in CADENCES:
    VALUES[_f] = (NUMBERS[_f][0], f"CAST({NUMBERS[_f][1]} AS string)")
#: Value families whose values are numbers, written as text.
NUMBER_VALUES = ("item_id", "second", *BUCKETS, *MEASURED, "gap", "pointer_px", "pointer_py", *[f"{_a}_item" for _a in ACTIONS], *CADENCES)
SESSION_NUMBERS = tuple(f"session_{c}_{s}" for c in CUTOFFS for s in ("size", "span", "cv"))
ITEM_NUMBERS = ("per_item_events", "per_item_action_types", "contact_latency")
ALL_NUMBERS = (*NUMBERS, *SESSION_NUMBERS, *ITEM_NUMBERS, "per_query_depth")


def share(condition: str, of: str | None = None) -> str:
    """Mean of a condition (null counts as not met), over all rows or the rows of another."""
    hit = f"CASE WHEN {condition} THEN 1.0D ELSE 0.0D END"
    return f"avg({hit})" if of is None else f"avg(CASE WHEN {of} THEN {hit} END)"


def scalars() -> dict[str, str]:
    """Aggregates of a visitor's rows; none of them holds more than a few numbers."""
    out = {"n_events": "count(*)"}
    for e in EVENT_TYPES:
        out[f"event_{e}_count"] = f"sum(CASE WHEN event_name = '{e}' THEN 1 ELSE 0 END)"
        out[f"event_{e}_share"] = share(f"event_name = '{e}'")
    out |= {f"{c}_present_share": share(f"{c} IS NOT NULL") for c in PRESENT}
    out |= {f"{c}_{v}_share": share(f"{c} = '{v}'") for c, vs in LEVELS.items() for v in vs}
    out |= {"ua_automated_share": share("ua_automated"), "ua_platform_mismatch_share": share("mismatch")}
    out |= {f"web_{c}_present_share": share(f"{c} IS NOT NULL", "platform = 'web'") for c in ("pointer_x", "pointer_y")}
    for c in MEASURED:
        out |= {f"{c}_mean": f"avg({c})", f"{c}_std": f"stddev_samp({c})", f"{c}_min": f"min({c})", f"{c}_max": f"max({c})", f"{c}_range": f"max({c}) - min({c})"}
    out |= {
        "search_first_page_share": share("search_page = 1"), "search_deep_page_share": share("search_page > 3"), "night_event_share": share("hour < 6"),
        "contact_event_share": share("substr(event_name, 1, 8) = 'contact_'", "event_name IS NOT NULL"),
        "engagement_event_share": share("event_name IN ('favorite_add', 'photo_swipe', 'login', 'contact_message_sent')"),
    }
    for m in ("length", "words", "digits", "cyrillic"):
        out |= {f"query_{m}_mean": f"avg(q_{m})", f"query_{m}_std": f"stddev_samp(q_{m})", f"query_{m}_max": f"max(q_{m})"}
    out |= {"gap_le_%d_share" % g: share(f"gap <= {g}", "gap IS NOT NULL") for g in GAP_LIMITS}
    out |= {"first_event_seconds": "min(t)", "last_event_seconds": "max(t)", "span_seconds": "max(t) - min(t)", "events_per_span_minute": "count(*) / greatest((max(t) - min(t)) / 60, 1)"}
    out["same_action_share"] = share("pn = nn", "pn IS NOT NULL")
    out |= {f"transition_{a}_to_{b}_share": share(f"pn = '{a}' AND nn = '{b}'", "pn IS NOT NULL") for a, b in PAIRS}
    out |= {f"{c}_switch_share": share(f"{p} <> coalesce({c}, 'missing')", "pt IS NOT NULL") for c, p in (("item_category", "p_cat"), ("item_location", "p_loc"), ("platform", "p_plat"), ("user_agent", "p_ua"))}
    moves = {"next": "= 1", "repeat": "= 0", "back": "< 0", "skip": "> 1"}
    out |= {f"search_page_{m}_share": share(f"search_page - lp.page {x}", "search_page IS NOT NULL AND lp IS NOT NULL") for m, x in moves.items()}
    out |= {"pointer_stationary_share": share("len = 0", "len IS NOT NULL"), "pointer_axis_aligned_share": share("dx = 0 OR dy = 0", "len IS NOT NULL")}
    out["path_x0"], out["path_y0"] = "min_by(pointer_x, CASE WHEN has_xy THEN rn END)", "min_by(pointer_y, CASE WHEN has_xy THEN rn END)"
    out["path_x1"], out["path_y1"] = "max_by(pointer_x, CASE WHEN has_xy THEN rn END)", "max_by(pointer_y, CASE WHEN has_xy THEN rn END)"
    out["path_sum"] = "sum(len)"
    out |= {f"n_{a}": f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)" for a, c in ACTIONS.items()}
    out["v2_ordered_same_action_fraction"] = share("pn = nn", "gap > 0")
    out |= {f"v2_after_{a}_{b}_fraction": share(f"nn = '{b}'", f"gap > 0 AND pn = '{a}'") for a in SOURCES for b in DESTINATIONS}
    again = f"{ACTIONS['searches']} AND ls IS NOT NULL"
    same = f"{again} AND ls.q = coalesce(search_query, '') AND ls.q <> '' AND t - ls.t > 0 AND search_page - ls.page IS NOT NULL"
    out |= {f"v2_same_query_page_{m}_fraction": share(f"search_page - ls.page {x}", same) for m, x in moves.items()}
    out["v2_search_query_switch_fraction"] = share("ls.q <> coalesce(search_query, '')", again)
    out |= {f"v2_pointer_present_given_{e}": share("has_xy", f"nn = '{e}'") for e in SOURCES}
    out["v2_pointer_observation_count"] = "sum(CASE WHEN has_xy THEN 1 ELSE 0 END)"
    x, y = "CASE WHEN has_xy THEN pointer_x END", "CASE WHEN has_xy THEN pointer_y END"
    out |= {"cloud_sx": f"stddev_pop({x})", "cloud_sy": f"stddev_pop({y})", "cloud_cov": f"covar_pop({x}, {y})"}
    return out


SESSION_SCALARS = {
    "{p}count": "count(*)", "{p}events_max": "max(size)", "{p}events_mean": "avg(size)", "{p}single_event_share": share("size = 1"),
    "{p}span_max": "max(span)", "{p}span_sum": "sum(span)", "{p}short_fraction": share("size <= 2"),
}
RUN_SCALARS = {"action_run_max": "max(size)", "action_run_mean": "avg(size)", "action_run_count": "count(*)"}
ASSOCIATED = ("photo", "favorite", "contact", "seller")
ITEM_SCALARS = {"v2_items_with_multiple_actions_fraction": share("types > 1")}
for _a in ASSOCIATED:
    ITEM_SCALARS[f"v2_viewed_items_with_{_a}_fraction"] = share(f"{_a} = 1", "viewed = 1")
    ITEM_SCALARS[f"v2_{_a}_items_without_view_fraction"] = share("viewed = 0", f"{_a} = 1")
QUERY_SCALARS = {"v2_per_query_page_coverage_mean": "avg(coverage)"}
TURN_SCALARS = {"v2_pointer_turn_cosine_mean": "avg(cosine)", "v2_pointer_direction_change_fraction": share("cosine < 0", "cosine IS NOT NULL")}


def features() -> tuple[dict[str, str], dict[str, str]]:
    """(base, v2): each feature's name and expression, before the last fills."""
    by_name = scalars()
    base: dict[str, str] = {"n_events": "n_events"}
    for e in EVENT_TYPES:
        base |= {f"event_{e}_{s}": f"event_{e}_{s}" for s in ("count", "share")}
    for c in SPREAD:
        base |= {f"{c}_nunique": f"{c}__k", f"{c}_top_share": f"{c}__top / {c}__n", f"{c}_entropy": f"{c}__entropy", f"{c}_concentration": f"{c}__hhi"}
    start = list(by_name).index("item_id_present_share")
    end = list(by_name).index("gap_le_0_share")
    for n in list(by_name)[start:end]:
        base[n] = n
        for c in MEASURED:
            if n == f"{c}_max":
                base |= {f"{c}_median": f"{c}__median", f"{c}_nunique": f"{c}__k"}
    for c in BUCKETS:
        base |= {f"{c}_active_count": f"{c}__k", f"{c}_events_max": f"{c}__top", f"{c}_events_mean": f"{c}__n / {c}__k", f"{c}_top_share": f"{c}__top / n_events", f"{c}_entropy": f"{c}__entropy"}
    six = lambda fam, name=None: {f"{name or fam}_{s}": f"{fam}__{s}" for s in S6}
    cv = lambda fam: f"{fam}__std / greatest({fam}__mean, 1)"
    base |= six("gap") | six("within_session_gap")
    base |= {"within_session_gap_cv": cv("within_session_gap"), "gap_cv": cv("gap"), "gap_relative_iqr": "(gap__q75 - gap__q25) / greatest(gap__median, 1)"}
    base |= {f"gap_le_{g}_share": f"gap_le_{g}_share" for g in GAP_LIMITS}
    base |= {"gap_top_share": "gap__top / gap__n", "gap_unique_share": "gap__k / gap__n"}
    base |= {n: n for n in ("first_event_seconds", "last_event_seconds", "span_seconds", "events_per_span_minute")}
    base |= {f"session_{s}": f"s1800_{s}" for s in ("count", "events_max", "events_mean", "single_event_share", "span_max", "span_sum")}
    base["same_action_share"] = "same_action_share"
    base |= {n: n for n in RUN_SCALARS}
    base["transition_entropy"] = "transition__entropy"
    base |= {f"transition_{a}_to_{b}_share": f"transition_{a}_to_{b}_share" for a, b in PAIRS}
    base["item_view_repeat_share"] = "1 - views_item__k / views_item__n"
    base |= six("item_view_gap")
    base |= {f"{c}_switch_share": f"{c}_switch_share" for c in ("item_category", "item_location", "platform", "user_agent")}
    base |= {f"search_page_{m}_share": f"search_page_{m}_share" for m in ("next", "repeat", "back", "skip")}
    base |= six("search_gap") | six("pointer_distance")
    base |= {"pointer_unique_share": "pointer_xy__k / pointer_xy__n", "pointer_stationary_share": "pointer_stationary_share", "pointer_axis_aligned_share": "pointer_axis_aligned_share"}
    base |= six("pointer_speed")
    base["pointer_path_efficiency"] = "sqrt((path_x1 - path_x0) * (path_x1 - path_x0) + (path_y1 - path_y0) * (path_y1 - path_y0)) / nullif(path_sum, 0)"
    base |= {n: n for n in ("has_events", "cookie_age_days", "cookie_age_log1p", "cookie_created_within_window", "window_weekday")}
    for n, d, name in (
        ("item_id_nunique", "n_events", "unique_items_per_event"),
        ("search_query_nunique", "event_search_results_view_count", "unique_queries_per_search"),
        ("event_contact_phone_show_count", "event_item_view_count", "phone_per_item_view"),
        ("event_photo_swipe_count", "event_item_view_count", "photos_per_item_view"),
        ("event_favorite_add_count", "event_item_view_count", "favorites_per_item_view"),
        ("event_contact_message_sent_count", "event_contact_chat_open_count", "messages_per_chat"),
    ):
        base[name] = f"coalesce({base[n]}, 0) / nullif(coalesce({base[d]}, 0), 0)"
    base |= {"log1p_events": "ln(1 + coalesce(n_events, 0))", "log1p_unique_items": "ln(1 + coalesce(item_id__k, 0))"}

    v2: dict[str, str] = {}

    def cadence(fam: str) -> dict[str, str]:
        return six(fam, f"v2_{fam}") | {
            f"v2_{fam}_cv": cv(fam), f"v2_{fam}_mad_ratio": f"{fam}__mad / greatest({fam}__median, 1)",
            f"v2_{fam}_iqr_ratio": f"({fam}__q75 - {fam}__q25) / greatest({fam}__median, 1)", f"v2_{fam}_q90_q10_ratio": f"{fam}__q90 / greatest({fam}__q10, 1)",
            f"v2_{fam}_log_std": f"{fam}__log_std", f"v2_{fam}_entropy": f"{fam}__entropy", f"v2_{fam}_mode_share": f"{fam}__top / {fam}__n",
            f"v2_{fam}_unique_share": f"{fam}__k / {fam}__n", f"v2_{fam}_near_median_share": f"{fam}__near", f"v2_{fam}_autocorrelation": f"{fam}__autocorrelation",
        }

    v2 |= cadence("cadence_all")
    for a in ACTIONS:
        v2 |= cadence(f"cadence_{a}")
        v2[f"v2_{a}_unique_item_fraction"] = f"{a}_item__k / {a}_item__n"
        for f in ("category", "location", "query"):
            v2 |= {f"v2_{a}_{f}_entropy": f"{a}_{f}__entropy", f"v2_{a}_{f}_unique_fraction": f"{a}_{f}__k / {a}_{f}__n"}
        v2[f"v2_{a}_events_per_category"] = f"nullif(n_{a}, 0) / greatest(coalesce({a}_category__k, 0), 1)"
    for c in CUTOFFS:
        for s in ("size", "span", "cv"):
            v2 |= six(f"session_{c}_{s}", f"v2_session_{c}_{s}")
        v2 |= {
            f"v2_session_{c}_dominant_fraction": f"s{c}_events_max / n_events", f"v2_session_{c}_activity_rate": f"n_events / greatest(s{c}_span_sum, 1)",
            f"v2_session_{c}_short_fraction": f"s{c}_short_fraction",
        }
    v2 |= {"v2_ordered_transition_entropy": "ordered__entropy", "v2_ordered_same_action_fraction": "v2_ordered_same_action_fraction"}
    v2 |= {f"v2_after_{a}_{b}_fraction": f"v2_after_{a}_{b}_fraction" for a in SOURCES for b in DESTINATIONS}
    v2 |= {"v2_triple_entropy": "triple__entropy", "v2_triple_unique_fraction": "triple__k / triple__n"}
    for a in ASSOCIATED:
        v2 |= {n: n for n in (f"v2_viewed_items_with_{a}_fraction", f"v2_{a}_items_without_view_fraction")}
    for f in ITEM_NUMBERS:
        v2 |= six(f, f"v2_{f}")
    v2["v2_items_with_multiple_actions_fraction"] = "v2_items_with_multiple_actions_fraction"
    v2 |= {f"v2_same_query_page_{m}_fraction": f"v2_same_query_page_{m}_fraction" for m in ("next", "repeat", "back", "skip")}
    v2["v2_search_query_switch_fraction"] = "v2_search_query_switch_fraction"
    v2 |= six("per_query_depth", "v2_per_query_depth")
    v2["v2_per_query_page_coverage_mean"] = "v2_per_query_page_coverage_mean"
    v2 |= {f"v2_pointer_present_given_{e}": f"v2_pointer_present_given_{e}" for e in SOURCES}
    for a in ("x", "y"):
        v2 |= {f"v2_pointer_{a}_entropy": f"pointer_p{a}__entropy", f"v2_pointer_{a}_unique_fraction": f"pointer_p{a}__k / pointer_p{a}__n"}
    two = "CASE WHEN v2_pointer_observation_count >= 2 THEN {} END"
    v2 |= {
        "v2_pointer_observation_count": "coalesce(v2_pointer_observation_count, 0)",
        "v2_pointer_xy_correlation": two.format("cloud_cov / nullif(cloud_sx * cloud_sy, 0)"),
        "v2_pointer_spread_anisotropy": two.format("least(cloud_sx, cloud_sy) / greatest(cloud_sx, cloud_sy, 1)"),
        "v2_pointer_turn_cosine_mean": "v2_pointer_turn_cosine_mean",
        "v2_pointer_direction_change_fraction": "v2_pointer_direction_change_fraction",
    }
    v2 |= cadence("pointer_step")
    return base, v2


def filled(name: str, expression: str) -> str:
    """A feature with its fill: counts of absent things are 0, undefined statistics are -1."""
    absent = "0" if name == "n_events" or name.endswith(("_count", "_nunique")) and not name.startswith("v2_") else "-1"
    return f"CAST(coalesce({expression}, {absent}) AS double)"
