"""DuckDB SQL of the registered queries, over the driver's tables."""

from __future__ import annotations

import re

from gaitprint.operators import catalogue as C
from gaitprint.operators import sequences as S
from gaitprint.sources import sample_log
from gaitprint.sources.tables import EVENT_COLUMNS

_OVER = "OVER (PARTITION BY cookie_id ORDER BY rn)"
DUCK = {
    "struct": lambda **k: "struct_pack(" + ", ".join(f"{n} := {x}" for n, x in k.items()) + ")",
    "digits": "length(regexp_replace(search_query, '[^0-9]', '', 'g'))",
    "cyrillic": "length(regexp_replace(search_query, '[^а-яё]', '', 'g'))",
    "words": "(length(search_query) - length(replace(search_query, ' ', '')) + 1)",
}
_E = ", ".join(EVENT_COLUMNS)
_AT = lambda x, q: f"quantile_cont({x}, {q})"
#: The row before and the one before that; other last values are those of rows of a kind.
LAGS = {"pt": "lag(t)", "pn": "lag(nn)", "pt2": "lag(t, 2)", "pn2": "lag(nn, 2)"} | {
    p: f"lag(coalesce({c}, 'missing'))" for p, c in (("p_cat", "item_category"), ("p_loc", "item_location"), ("p_plat", "platform"), ("p_ua", "user_agent"))
}
LOOKED_BACK = {n: f"{x} {_OVER}" for n, x in LAGS.items()} | {n: f"last_value({x} IGNORE NULLS) {S._BEFORE}" for n, x in S.last_of(DUCK).items() if n not in LAGS}
RHYTHMS = {
    "near": C.share("abs(v - m) <= greatest(0.2D * m, 1)"),
    "autocorrelation": "CASE WHEN count(*) >= 3 THEN covar_pop(CASE WHEN nv IS NOT NULL THEN v END, nv) / nullif(stddev_pop(CASE WHEN nv IS NOT NULL THEN v END) * stddev_pop(nv), 0) END",
}
_MARKS = lambda table, other: "CASE " + " ".join("WHEN " + " OR ".join(f"contains(user_agent, '{m}')" for m in marks) + f" THEN '{n}'" for n, marks in table) + f" ELSE '{other}' END"


def _clean() -> str:
    from gaitprint.functions.text import AUTOMATED, FAMILIES, SYSTEMS
    from gaitprint.operators.clean import ORDER

    label = lambda c: f"nullif(lower(trim({c})), '')"
    order = ", ".join(f"{c} ASC NULLS LAST" for c in ORDER)
    return f"""{sample_log.CTES},
joined AS (SELECT raw.*, cookie_created_at, window_start_ts, window_end_ts FROM raw JOIN meta USING (cookie_id)),
dedup AS (SELECT DISTINCT * FROM joined WHERE event_ts >= window_start_ts AND event_ts < window_end_ts),
norm AS (SELECT cookie_id, event_ts, eid, {label('event_name')} AS event_name,
 CASE {label('platform')} WHEN 'desktop' THEN 'web' WHEN 'iphone' THEN 'ios' ELSE {label('platform')} END AS platform,
 lower(trim(coalesce(user_agent, ''))) AS user_agent, item_id, {label('item_category')} AS item_category, {label('item_location')} AS item_location, {label('seller_type')} AS seller_type,
 nullif(regexp_replace(lower(trim(search_query)), '\\s+', ' ', 'g'), '') AS search_query, search_page, pointer_x, pointer_y, cookie_created_at, window_start_ts, window_end_ts FROM dedup),
clean AS (SELECT *, row_number() OVER (PARTITION BY cookie_id ORDER BY {order}) AS rn FROM norm),
described0 AS (SELECT *, (epoch_us(event_ts) - epoch_us(window_start_ts)) / 1e6 AS t, hour(event_ts) AS hour, second(event_ts) AS second,
 {_MARKS(FAMILIES, 'other')} AS ua_family, {_MARKS(SYSTEMS, 'other')} AS ua_os, regexp_matches(user_agent, '{AUTOMATED}') AS ua_automated, coalesce(event_name, '<NA>') AS nn FROM clean),
described AS (SELECT *, floor(t / 60) AS minute_bucket, floor(t / 300) AS five_minute_bucket,
 coalesce((platform = 'ios' AND ua_os <> 'ios') OR (platform = 'android' AND ua_os <> 'android') OR (platform = 'web' AND ua_os IN ('android', 'ios')), false) AS mismatch FROM described0)"""


def _columns(stats: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {n}" for n, x in stats.items())


def _seq() -> str:
    return f"""{_clean()},
seq1 AS (SELECT *, {_columns(LOOKED_BACK)} FROM described),
seq2 AS (SELECT *, {_columns(S.derived(DUCK))} FROM seq1),
seq AS (SELECT *, {_columns({n: f"sum({x}) {S._SO_FAR}" for n, x in S.COUNTED.items()})} FROM seq2)"""


def _number_stats() -> dict[str, str]:
    return S.NUMBER_STATS | {n: _AT("v", q) for n, q in S.QUANTILES.items()}


def _families() -> str:
    values = " UNION ALL ".join(f"SELECT cookie_id, '{n}' AS fam, {v} AS value FROM seq WHERE {c}" for n, (c, v) in C.VALUES.items())
    numbers = [f"SELECT cookie_id, '{n}' AS fam, rn AS pos, CAST({v} AS double) AS v FROM seq WHERE {c}" for n, (c, v) in C.NUMBERS.items()]
    sessions, parts = [], []
    for c in C.CUTOFFS:
        inside = f"CASE WHEN new_{c} = 0 THEN gap END"
        sessions.append(
            f"session_{c} AS (SELECT cookie_id, sid_{c} AS sid, count(*) AS size, max(t) - min(t) AS span,"
            f" CASE WHEN count({inside}) >= 2 THEN stddev_pop({inside}) / greatest(avg({inside}), 1) END AS cv FROM seq GROUP BY ALL)"
        )
        numbers += [f"SELECT cookie_id, 'session_{c}_{s}', 0, CAST({s} AS double) FROM session_{c} WHERE {s} IS NOT NULL" for s in ("size", "span", "cv")]
        parts.append(f"s{c} AS (SELECT cookie_id, {_columns({n.format(p=f's{c}_'): x for n, x in C.SESSION_SCALARS.items()})} FROM session_{c} GROUP BY 1)")
    numbers += [f"SELECT cookie_id, '{n}', 0, CAST({c} AS double) FROM items WHERE {c} IS NOT NULL" for n, c in (("per_item_events", "events_n"), ("per_item_action_types", "types"), ("contact_latency", "latency"))]
    numbers.append("SELECT cookie_id, 'per_query_depth', 0, CAST(depth AS double) FROM queries")
    item_stats = {("events_n" if n == "events" else n): x for n, x in S.ITEM_STATS.items()}
    in_cadence = ", ".join(f"'{f}'" for f in C.CADENCES)
    mad = _AT("abs(v - m)", 0.5)
    return f"""{_seq()},
vals AS ({values}),
value_stats AS (SELECT cookie_id, fam, {_columns(S.VALUE_STATS)} FROM (SELECT cookie_id, fam, value, count(*) AS c FROM vals GROUP BY ALL) q GROUP BY ALL),
{", ".join(sessions)},
items AS (SELECT cookie_id, item_id, {_columns(item_stats)} FROM (SELECT *, {S.FIRST_VIEW} AS fv FROM seq WHERE item_id IS NOT NULL) q GROUP BY ALL),
queries AS (SELECT cookie_id, search_query, {_columns(S.QUERY_STATS)} FROM seq WHERE {S.QUERY_ROWS} GROUP BY ALL),
numbers AS ({" UNION ALL ".join(numbers)}),
number_stats AS (SELECT cookie_id, fam, {_columns(_number_stats())} FROM numbers GROUP BY ALL),
kept AS (SELECT *, lead(v) OVER (PARTITION BY cookie_id, fam ORDER BY pos) AS nv, {_AT("v", 0.5)} OVER (PARTITION BY cookie_id, fam) AS m FROM numbers WHERE fam IN ({in_cadence})),
rhythm_stats AS (SELECT cookie_id, fam, {mad} AS mad, {_columns(RHYTHMS)} FROM kept GROUP BY ALL),
scalars AS (SELECT cookie_id, {_columns(C.scalars())} FROM seq GROUP BY 1),
{", ".join(parts)},
runs AS (SELECT cookie_id, {_columns(C.RUN_SCALARS)} FROM (SELECT cookie_id, run, count(*) AS size FROM seq GROUP BY ALL) q GROUP BY 1),
item_scalars AS (SELECT cookie_id, {_columns(C.ITEM_SCALARS)} FROM items GROUP BY 1),
query_scalars AS (SELECT cookie_id, {_columns(C.QUERY_SCALARS)} FROM queries GROUP BY 1),
turned AS (SELECT *, {S.COSINE} AS cosine FROM (SELECT *, {", ".join(f"lag({c}) {_OVER} AS {n}" for n, c in (("back_x", "dx"), ("back_y", "dy"), ("back_len", "len")))} FROM seq WHERE dt > 0) q),
turn_scalars AS (SELECT cookie_id, {_columns(C.TURN_SCALARS)} FROM turned GROUP BY 1)"""


def _wide(families: str) -> str:
    def pivot(name: str, source: str, fams, stats) -> str:
        cells = ", ".join(f"max(CASE WHEN fam = '{f}' THEN {s} END) AS {f}__{s}" for f in fams for s in stats)
        return f"{name} AS (SELECT cookie_id, {cells} FROM {source} GROUP BY 1)"

    base, v2 = C.features()
    created = "((epoch_us(window_start_ts) - epoch_us(cookie_created_at)) / 1e6)"
    own = ", ".join(f"{x.format(created=created)} AS {n}" for n, x in S.META.items())
    joins = " ".join(f"LEFT JOIN {p} USING (cookie_id)" for p in ("scalars", "w1", "w2", "w3", "s300", "s1800", "runs", "item_scalars", "query_scalars", "turn_scalars"))
    wanted = base if families == "base" else base | v2
    return f"""{_families()},
{pivot("w1", "value_stats", C.VALUES, S.VALUE_STATS)}, {pivot("w2", "number_stats", C.ALL_NUMBERS, [s for s in _number_stats() if s != "n"])},
{pivot("w3", "rhythm_stats", C.CADENCES, ("mad", *S.RHYTHM_STATS))},
own AS (SELECT cookie_id, {own}, CAST(isodow(window_start_ts) - 1 AS double) AS window_weekday FROM meta),
wide AS (SELECT *, CASE WHEN n_events > 0 THEN 1.0 ELSE 0.0 END AS has_events FROM own {joins})
SELECT cookie_id, {", ".join(f"round({C.filled(n, x)}, 6) + 0.0 AS {n}" for n, x in wanted.items())} FROM wide"""


def _rebuilt() -> str:
    """The features of test visitors from the whole log, and again from their own events alone."""
    one = _wide("all")
    own = one.replace("FROM raw JOIN meta USING", "FROM (SELECT * FROM raw WHERE cookie_id IN (SELECT cookie_id FROM meta WHERE NOT is_train)) raw JOIN (SELECT * FROM meta WHERE NOT is_train) meta USING")
    own = own.replace("FROM meta),\nwide AS", "FROM meta WHERE NOT is_train),\nwide AS")
    base, v2 = C.features()
    apart = " + ".join(f"CASE WHEN abs(a.{n} - b.{n}) > 1e-9 THEN 1 ELSE 0 END" for n in base | v2)
    return f"""a AS (WITH {one}), b AS (WITH {own})
SELECT b.cookie_id, b.n_events, b.gap_mean, b.v2_cadence_all_entropy, CAST({apart} AS int) AS differing FROM b LEFT JOIN a ON a.cookie_id = b.cookie_id"""


def _r(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS double), 6) + 0.0 AS {n}" for n in names)


_SCORED = "scored AS (SELECT lang, l.toxic AS y, (n_chars % 100) / 100.0 AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_CURVE = f"""{_SCORED}, ties AS (SELECT lang, score, count(*) AS n, CAST(sum(y) AS bigint) AS pos FROM scored GROUP BY ALL),
c0 AS (SELECT *, CAST(sum(n) OVER w AS bigint) AS k, CAST(sum(pos) OVER w AS bigint) AS tp, CAST(sum(pos) OVER (PARTITION BY lang) AS bigint) AS p, CAST(sum(n) OVER (PARTITION BY lang) AS bigint) AS all_ FROM ties
 WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
curve AS (SELECT *, tp / k AS precision, tp / p AS recall FROM c0 WHERE p > 0)"""
_REPORT = f"""{_CURVE}, sizes AS (SELECT lang, count(*) AS n, CAST(sum(y) AS bigint) AS positives, avg(y) AS fraction FROM scored GROUP BY 1),
measures AS (SELECT lang, coalesce(max(CASE WHEN recall >= 0.7 THEN precision END), 0) AS precision_at_recall,
 CASE WHEN max(all_ - p) > 0 THEN coalesce(max(CASE WHEN k - tp <= 0.01 * (all_ - p) THEN recall END), 0) END AS recall_at_fpr,
 sum(pos / p * precision) AS average_precision, sum((n - pos) * (tp - pos + pos / 2.0)) / nullif(max(p) * max(all_ - p), 0) AS roc_auc FROM curve GROUP BY 1)"""


def oracle_sql() -> dict[str, str]:
    stats = tuple(_number_stats())
    counted = "n k top".split()
    out = {
        "clean_events": f"{_clean()} SELECT {_E}, CAST(rn AS int) AS rn FROM clean",
        "event_audit": f"""{_clean()}, each AS (SELECT *, count(*) AS c, event_ts >= window_start_ts AND event_ts < window_end_ts AS inside FROM joined GROUP BY ALL),
a AS (SELECT sum(c) AS raw_events, sum(c) - count(*) AS raw_exact_duplicates, sum(CASE WHEN event_ts < window_start_ts THEN c ELSE 0 END) AS events_before_window,
 sum(CASE WHEN event_ts >= window_end_ts THEN c ELSE 0 END) AS events_at_or_after_window_end, sum(CASE WHEN inside THEN c ELSE 0 END) AS in_window_events_before_deduplication,
 sum(CASE WHEN inside THEN c - 1 ELSE 0 END) AS in_window_exact_duplicates, sum(CASE WHEN inside AND event_ts < cookie_created_at THEN c ELSE 0 END) AS events_before_cookie_creation_in_window,
 (SELECT count(*) FROM clean) AS usable_events, (SELECT count(*) FROM meta WHERE cookie_id NOT IN (SELECT cookie_id FROM clean)) AS cookies_without_events FROM each) """
        + " UNION ALL ".join(
            f"SELECT '{k}' AS key, CAST({k} AS double) AS value FROM a"
            for k in ("raw_events", "raw_exact_duplicates", "events_before_window", "events_at_or_after_window_end", "in_window_events_before_deduplication", "in_window_exact_duplicates", "events_before_cookie_creation_in_window", "usable_events", "cookies_without_events")
        ),
        "observed_log": f"{_clean()}, a AS (SELECT count(*) AS raw_events, count(*) FILTER (window_start_ts IS NULL) AS unknown_events, count(*) FILTER (event_ts < window_start_ts) AS events_before_window,"
        " count(*) FILTER (event_ts >= window_end_ts) AS events_at_or_after_window_end, count(*) FILTER (event_ts >= window_start_ts AND event_ts < window_end_ts) AS in_window_events_before_deduplication,"
        " count(*) FILTER (event_ts >= window_start_ts AND event_ts < window_end_ts AND event_ts < cookie_created_at) AS events_before_cookie_creation_in_window, "
        + ", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in EVENT_COLUMNS)
        + " FROM raw LEFT JOIN meta USING (cookie_id)) "
        + " UNION ALL ".join(
            f"SELECT '{k}' AS key, CAST({k} AS double) AS value FROM a"
            for k in ("raw_events", "unknown_events", "events_before_window", "events_at_or_after_window_end", "in_window_events_before_deduplication", "events_before_cookie_creation_in_window", *(f"missing_{c}" for c in EVENT_COLUMNS))
        ),
        "pruned_log": f"{_clean()} SELECT cookie_id, CAST(event_ts AS date) AS day, count(*) AS n FROM joined WHERE event_ts >= window_start_ts AND event_ts < window_end_ts GROUP BY ALL",
        "repeated_events": f"{sample_log.CTES} SELECT {_E}, count(*) AS c FROM raw GROUP BY ALL HAVING count(*) > 1",
        "null_fractions": f"{sample_log.CTES} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_fraction FROM raw" for c in EVENT_COLUMNS),
        "event_value_counts": f"{_clean()} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM clean WHERE {c} IS NOT NULL GROUP BY ALL" for c in ("event_name", "platform")),
        "event_time_range": f"{_clean()} SELECT min(event_ts) AS first_ts, max(event_ts) AS last_ts FROM clean",
        "cookie_checks": f"""{sample_log.CTES} SELECT count(*) FILTER (cookie_id IS NULL) AS missing_ids, count(cookie_id) - count(DISTINCT cookie_id) AS repeated_ids,
 count(*) FILTER (cookie_created_at IS NULL OR window_start_ts IS NULL OR window_end_ts IS NULL) AS missing_times, count(*) FILTER (window_end_ts <= window_start_ts) AS empty_windows,
 count(*) FILTER (cookie_created_at > window_end_ts) AS created_late, count(*) FILTER (target IS NULL OR target NOT IN (0, 1)) AS bad_targets FROM meta WHERE is_train""",
        "cookie_overlap": f"{sample_log.CTES} SELECT cookie_id FROM meta WHERE is_train INTERSECT SELECT cookie_id FROM meta WHERE NOT is_train",
        "unknown_cookies": f"{sample_log.CTES} SELECT cookie_id, count(*) AS n FROM raw WHERE cookie_id NOT IN (SELECT cookie_id FROM meta WHERE is_train) GROUP BY 1",
        "scalar_features": f"{_families()} SELECT cookie_id, {_r(*C.scalars())} FROM scalars",
        "value_distributions": f"{_families()} SELECT cookie_id, fam, {', '.join(f'CAST({c} AS bigint) AS {c}' for c in counted)}, {_r('entropy', 'hhi')} FROM value_stats",
        "number_summaries": f"{_families()} SELECT cookie_id, fam, {_r(*stats)} FROM number_stats",
        "cadence_features": f"{_families()} SELECT cookie_id, fam, {_r('mad', 'near', 'autocorrelation')} FROM rhythm_stats",
        "sessions_300": f"{_families()} SELECT cookie_id, {_r(*[n.format(p='s300_') for n in C.SESSION_SCALARS])} FROM s300",
        "sessions_1800": f"{_families()} SELECT cookie_id, {_r(*[n.format(p='s1800_') for n in C.SESSION_SCALARS])} FROM s1800",
        "action_runs": f"{_families()} SELECT cookie_id, {_r(*C.RUN_SCALARS)} FROM runs",
        "item_activity": f"{_families()} SELECT cookie_id, item_id, {_r('events', 'types', 'viewed', 'contact', 'latency')} FROM (SELECT *, events_n AS events FROM items) q",
        "item_funnel": f"{_families()} SELECT cookie_id, {_r(*C.ITEM_SCALARS)} FROM item_scalars",
        "query_depth": f"{_families()} SELECT cookie_id, search_query, {_r('depth', 'coverage')} FROM queries",
        "pointer_turns": f"{_families()} SELECT cookie_id, {_r(*C.TURN_SCALARS)} FROM turn_scalars",
        "cookie_features_base": _wide("base"),
        "cookie_features": _wide("all"),
        "rebuild_difference": _rebuilt(),
        "all_cookies": f"{sample_log.CTES} SELECT cookie_id, cookie_created_at, window_start_ts, window_end_ts FROM meta",
        "pr_curve": f"{_CURVE} SELECT lang, n, pos, k, tp, {_r('score', 'precision', 'recall')} FROM curve",
        "precision_at_recall": f"{_REPORT} SELECT lang, {_r('precision_at_recall')} FROM measures",
        "recall_at_fpr": f"{_REPORT} SELECT lang, {_r('recall_at_fpr')} FROM measures",
        "operating_point": f"""{_CURVE}, best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY precision DESC, recall DESC) AS i FROM curve WHERE recall >= 0.7)
SELECT lang, {_r('threshold')}, tp, k - tp AS fp, p - tp AS fn, all_ - p - (k - tp) AS tn FROM (SELECT *, score AS threshold FROM best) q WHERE i = 1""",
        "ranking_report": f"{_REPORT} SELECT lang, n, positives, {_r('fraction', 'precision_at_recall', 'recall_at_fpr', 'average_precision', 'roc_auc')} FROM sizes LEFT JOIN measures USING (lang)",
        "weighted_precision": f"{_REPORT} SELECT 'all' AS recipe, {_r('weighted_precision')} FROM (SELECT sum(precision_at_recall * positives) / sum(positives) AS weighted_precision FROM sizes LEFT JOIN measures USING (lang)) q",
        "time_folds": f"""{sample_log.CTES}, folds AS (SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-06', TIMESTAMP '2024-01-08'), (2, TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-10'), (3, TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12')) f(fold, a, b))
SELECT cookie_id, fold, CASE WHEN window_start_ts < a THEN 'fit' ELSE 'valid' END AS role FROM meta JOIN folds ON window_start_ts < b WHERE is_train""",
        "blend": "x AS (SELECT doc_id, (n_chars % 100) / 100.0 AS a, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE (n_chars % 37) / 37.0 END AS b FROM documents) SELECT doc_id, round(CAST(a * 0.25 + b * 0.75 AS double), 6) AS score FROM x",
    }
    fix = lambda q: re.sub(r"\b(\d+(?:\.\d+)?)D\b", r"CAST(\1 AS DOUBLE)", q)
    return {k: fix("WITH " + q) for k, q in out.items()}
