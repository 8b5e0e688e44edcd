"""The feature families as Spark jobs: sequence columns, and one engine each for values and numbers.

Everything after the clean log is hashed by ``cookie_id`` and ordered by ``rn``.  Many small families share
one long table each: values are counted per (visitor, family, value), numbers are summarised per (visitor,
family), so adding a family adds rows, not joins.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitprint.operators import catalogue as C
from gaitprint.operators import prefix
from gaitprint.sources.staging import bucketed_table, stage_table

_BEFORE = "OVER (PARTITION BY cookie_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SO_FAR = "OVER (PARTITION BY cookie_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

SPARK = {
    "struct": lambda **k: "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in k.items()) + ")",
    "digits": r"regexp_count(search_query, '(?U)\\d')",
    "cyrillic": "regexp_count(search_query, '[а-яё]')",
    "words": "size(split(search_query, ' '))",
}


def last_of(d: dict) -> dict[str, str]:
    """What a row needs of the rows before it: each name is the last value, not null, of its expression."""
    return {
        "pt": "t", "pn": "nn", "p_cat": "coalesce(item_category, 'missing')", "p_loc": "coalesce(item_location, 'missing')",
        "p_plat": "coalesce(platform, 'missing')", "p_ua": "coalesce(user_agent, 'missing')",
        "lv": f"CASE WHEN {C.ACTIONS['views']} THEN t END", "lc": f"CASE WHEN {C.ACTIONS['contacts']} THEN t END",
        "ls": f"CASE WHEN {C.ACTIONS['searches']} THEN {d['struct'](t='t', q="coalesce(search_query, '')", page='search_page')} END",
        "lp": f"CASE WHEN search_page IS NOT NULL THEN {d['struct'](t='t', page='search_page')} END",
        "lx": f"CASE WHEN pointer_x IS NOT NULL AND pointer_y IS NOT NULL THEN {d['struct'](x='pointer_x', y='pointer_y', t='t')} END",
    }


def derived(d: dict) -> dict[str, str]:
    has = "(pointer_x IS NOT NULL AND pointer_y IS NOT NULL)"
    both = f"{has} AND lx IS NOT NULL"
    return {
        "gap": "t - pt", "has_xy": has,
        "dx": f"CASE WHEN {both} THEN pointer_x - lx.x END", "dy": f"CASE WHEN {both} THEN pointer_y - lx.y END", "dt": f"CASE WHEN {both} THEN t - lx.t END",
        "len": f"CASE WHEN {both} THEN sqrt((pointer_x - lx.x) * (pointer_x - lx.x) + (pointer_y - lx.y) * (pointer_y - lx.y)) END",
        "new_300": "CASE WHEN t - pt > 300 THEN 1 ELSE 0 END", "new_1800": "CASE WHEN t - pt > 1800 THEN 1 ELSE 0 END", "new_run": "CASE WHEN pn <> nn THEN 1 ELSE 0 END",
        "q_length": "CAST(length(search_query) AS double)", "q_words": f"CAST({d['words']} AS double)",
        "q_digits": f"{d['digits']} / CAST(greatest(length(search_query), 1) AS double)", "q_cyrillic": f"{d['cyrillic']} / CAST(greatest(length(search_query), 1) AS double)",
    }


#: As :func:`last_of`, of the derived columns: the time and name two rows back, the last pointer step that took time, the last kept rhythm.
LAST_DERIVED = {"pt2": "pt", "pn2": "pn", "back": f"CASE WHEN dt > 0 THEN {SPARK['struct'](dx='dx', dy='dy', len='len')} END"} | {
    f"pv_{f}": f"CASE WHEN {C.NUMBERS[f][0]} THEN CAST({C.NUMBERS[f][1]} AS double) END" for f in C.CADENCES
}
#: Numbers of sessions and runs: how many began down to a row.
COUNTED = {"sid_300": "new_300", "sid_1800": "new_1800", "run": "new_run"}
_NUMBER_AS_TEXT = re.compile(r"CAST\((.*) AS string\)")
VALUE_STATS = {"n": "sum(c)", "k": "count(*)", "top": "max(c)", "entropy": "log2(sum(c)) - sum(c * log2(c)) / sum(c)", "hhi": "sum(CAST(c AS double) * c) / (CAST(sum(c) AS double) * sum(c))"}


NUMBER_STATS = {"n": "count(*)", "mean": "avg(v)", "std": "stddev_pop(v)", "max": "max(v)", "log_std": "stddev_pop(CASE WHEN v >= 0 THEN ln(1 + v) END)"}
QUANTILES = {"median": 0.5, "q10": 0.1, "q25": 0.25, "q75": 0.75, "q90": 0.9}


#: Of the rows of a rhythm with the one before (pv), and of its distinct values with their counts (c) and distances (d) from the median m.
PAIR_STATS = {"autocorrelation": "CASE WHEN count(*) >= 3 THEN covar_pop(CASE WHEN pv IS NOT NULL THEN v END, pv) / nullif(stddev_pop(CASE WHEN pv IS NOT NULL THEN v END) * stddev_pop(pv), 0) END"}
NEAR_STATS = {"near": "sum(CASE WHEN d <= greatest(0.2D * m, 1) THEN c ELSE 0 END) / CAST(sum(c) AS double)"}
RHYTHM_STATS = ("near", "autocorrelation")


def sequence_columns(described: DataFrame) -> DataFrame:
    """Described clean events with everything the families need of a row and of what came before it.

    A visitor's rows are one window; :mod:`gaitprint.operators.segments` gives the same columns where they are too many.
    """
    before = lambda x: F.expr(f"last_value({x}) IGNORE NULLS {_BEFORE}")
    df = described.withColumns({n: before(x) for n, x in last_of(SPARK).items()})
    df = df.withColumns({n: F.expr(x) for n, x in derived(SPARK).items()})
    return df.withColumns({n: before(x) for n, x in LAST_DERIVED.items()} | {n: F.expr(f"sum({x}) {_SO_FAR}") for n, x in COUNTED.items()})


def _agg(df: DataFrame, keys: list[str], stats: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(x).alias(n) for n, x in stats.items()])


#: Aggregates of one pass over the rows; with more of them the generated code is too long to be compiled.
AT_ONCE = 32


def scalar_family(seq: DataFrame, names: set[str] | None = None) -> DataFrame:
    """One row per visitor with :func:`catalogue.scalars`, or some of them; a few passes over rows that lie together by visitor."""
    stats = [(n, x) for n, x in C.scalars().items() if names is None or n in names]
    parts = [_agg(seq, ["cookie_id"], dict(stats[lo : lo + AT_ONCE])) for lo in range(0, len(stats), AT_ONCE)]
    return reduce(lambda a, b: a.join(b, "cookie_id"), parts)


def value_statistics(seq: DataFrame, families: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """cookie_id, fam, and n, k (distinct), top (count of the most frequent), entropy (bits), hhi of each family's values."""
    families = families or C.VALUES
    names = list(families)

    def one(place: int) -> str:
        """A family's place and value; numbers are counted as numbers, as each has a text of its own."""
        rows, value = families[names[place]]
        of_number = _NUMBER_AS_TEXT.fullmatch(value) if names[place] in C.NUMBER_VALUES else None
        number, text = (f"CAST({of_number[1]} AS double)", "CAST(NULL AS string)") if of_number else ("CAST(NULL AS double)", value)
        return f"CASE WHEN {rows} THEN named_struct('place', {place + 1}, 'number', {number}, 'text', {text}) END"

    each = F.array(*[F.expr(one(k)) for k in range(len(names))])
    long = seq.select("cookie_id", F.explode(each).alias("x")).where("x IS NOT NULL").select("cookie_id", "x.place", "x.number", "x.text")
    found = _agg(_agg(long, ["cookie_id", "place", "number", "text"], {"c": "count(*)"}), ["cookie_id", "place"], VALUE_STATS)
    return found.select("cookie_id", F.element_at(F.array(*map(F.lit, names)), F.col("place")).alias("fam"), *VALUE_STATS)


def sessions(seq: DataFrame, cutoff: int) -> DataFrame:
    """cookie_id, sid, size, span, and cv of gaps inside (where there are two at least)."""
    inside = f"CASE WHEN new_{cutoff} = 0 THEN gap END"
    stats = {"size": "count(*)", "span": "max(t) - min(t)", "cv": f"CASE WHEN count({inside}) >= 2 THEN stddev_pop({inside}) / greatest(avg({inside}), 1) END"}
    return _agg(seq, ["cookie_id", f"sid_{cutoff}"], stats).withColumnRenamed(f"sid_{cutoff}", "sid")


def session_scalars(seq: DataFrame, cutoff: int) -> DataFrame:
    return _agg(sessions(seq, cutoff), ["cookie_id"], {n.format(p=f"s{cutoff}_"): x for n, x in C.SESSION_SCALARS.items()})


def run_scalars(seq: DataFrame) -> DataFrame:
    return _agg(_agg(seq, ["cookie_id", "run"], {"size": "count(*)"}), ["cookie_id"], C.RUN_SCALARS)


ITEM_STATS = {
    "events": "count(*)", "types": "count(DISTINCT nn)", "viewed": "max(CASE WHEN nn = 'item_view' THEN 1 ELSE 0 END)", "photo": "max(CASE WHEN nn = 'photo_swipe' THEN 1 ELSE 0 END)",
    "favorite": "max(CASE WHEN nn = 'favorite_add' THEN 1 ELSE 0 END)", "contact": f"max(CASE WHEN {C.CONTACT} THEN 1 ELSE 0 END)",
    "seller": "max(CASE WHEN nn = 'seller_page_view' THEN 1 ELSE 0 END)", "latency": f"min(CASE WHEN {C.CONTACT} AND t >= fv THEN t - fv END)",
}
FIRST_VIEW = "min(CASE WHEN nn = 'item_view' THEN t END) OVER (PARTITION BY cookie_id, item_id)"


def items(seq: DataFrame, spread: bool = False) -> DataFrame:
    """cookie_id, item_id: events, action types, which actions it had, and seconds from its first view to the next contact.

    With ``spread`` no window holds an item's rows: first views are aggregates that only contacts are joined with.
    """
    rows, keys = seq.where("item_id IS NOT NULL"), ["cookie_id", "item_id"]
    if not spread:
        return _agg(rows.withColumn("fv", F.expr(FIRST_VIEW)), keys, ITEM_STATS)
    views = _agg(rows.where("nn = 'item_view'"), keys, {"fv": "min(t)"})
    latency = _agg(rows.where(C.CONTACT).join(views, keys).where("t >= fv"), keys, {"latency": "min(t - fv)"})
    return _agg(rows, keys, {n: x for n, x in ITEM_STATS.items() if n != "latency"}).join(latency, keys, "left")


QUERY_ROWS = "nn = 'search_results_view' AND search_query IS NOT NULL AND search_page IS NOT NULL"
QUERY_STATS = {"depth": "max(search_page)", "coverage": "count(DISTINCT search_page) / greatest(max(search_page) - min(search_page) + 1, 1)"}


def query_depths(seq: DataFrame) -> DataFrame:
    return _agg(seq.where(QUERY_ROWS), ["cookie_id", "search_query"], QUERY_STATS)


COSINE = "(dx * back_x + dy * back_y) / nullif(len * back_len, 0)"


def turn_cosines(seq: DataFrame) -> DataFrame:
    """Cosine between neighbouring pointer steps, after steps without time are left out."""
    steps = seq.where("dt > 0").selectExpr("cookie_id", "dx", "dy", "len", "back.dx AS back_x", "back.dy AS back_y", "back.len AS back_len")
    return steps.select("cookie_id", F.expr(COSINE).alias("cosine"))


def turns(seq: DataFrame) -> DataFrame:
    return _agg(turn_cosines(seq), ["cookie_id"], C.TURN_SCALARS)


def numbers(seq: DataFrame, families: set[str] | None = None, spread: bool = False) -> DataFrame:
    """The long table of all number families, or of some: cookie_id, fam, v, and pv, the value before (of rhythms)."""
    wanted = set(C.ALL_NUMBERS) if families is None else families
    prior = lambda n: f"pv_{n}" if n in C.CADENCES else "CAST(NULL AS double)"
    each = F.array(*[F.expr(f"CASE WHEN {c} THEN named_struct('fam', '{n}', 'v', CAST({v} AS double), 'pv', {prior(n)}) END") for n, (c, v) in C.NUMBERS.items() if n in wanted])
    parts = [seq.select("cookie_id", F.explode(each).alias("x")).where("x IS NOT NULL").select("cookie_id", "x.fam", "x.v", "x.pv")]

    def unpivot(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
        each = F.array(*[F.expr(f"CASE WHEN {c} IS NOT NULL THEN named_struct('fam', '{n}', 'v', CAST({c} AS double)) END") for n, c in pairs.items()])
        return df.select("cookie_id", F.explode(each).alias("x")).where("x IS NOT NULL").select("cookie_id", "x.fam", "x.v", F.lit(None).cast("double").alias("pv"))

    more = [(lambda c=c: sessions(seq, c), {f"session_{c}_{s}": s for s in ("size", "span", "cv")}) for c in C.CUTOFFS]
    more.append((lambda: items(seq, spread), {"per_item_events": "events", "per_item_action_types": "types", "contact_latency": "latency"}))
    more.append((lambda: query_depths(seq), {"per_query_depth": "depth"}))
    for source, pairs in more:
        if own := {n: c for n, c in pairs.items() if n in wanted}:
            parts.append(unpivot(source(), own))
    return reduce(DataFrame.unionByName, parts)


def read_by_numbers(families: set[str] | None = None) -> set[str]:
    """The names in the expressions of :func:`numbers`: a superset of the columns that it reads."""
    own = [x for n, pair in C.NUMBERS.items() if families is None or n in families for x in pair]
    text = " ".join([*own, *ITEM_STATS.values(), FIRST_VIEW, QUERY_ROWS, *QUERY_STATS.values(), "cookie_id rn t gap"])
    return set(re.findall(r"[A-Za-z_]\w*", text)) | {f"{n}_{c}" for n in ("sid", "new") for c in C.CUTOFFS} | {f"pv_{n}" for n in C.CADENCES}


FAMILY = ["cookie_id", "fam"]


def frequencies(long: DataFrame) -> DataFrame:
    """cookie_id, fam, v, c: how often each number occurs (-0.0 is 0.0)."""
    return _agg(long.select(*FAMILY, (F.col("v") + F.lit(0.0)).alias("v")), [*FAMILY, "v"], {"c": "count(*)"})


def quantiles(counts: DataFrame, value: str, wanted: dict[str, float], spread: bool = False, stats: dict[str, str] | None = None) -> DataFrame:
    """cookie_id, fam and interpolated quantiles of ``value`` from counts (c), found where the running count passes their ranks, and ``stats``.

    No values are gathered: a window runs down the distinct ones, or, with ``spread``, down the parts of a family;
    then ``counts`` has the family's ``n`` on each row.
    """
    if spread:
        down = prefix.running(counts, FAMILY, [F.col(value).asc()], {"cum": "c"}, {}, "ranks")
    else:
        family = Window.partitionBy(*FAMILY)
        total = {} if "n" in counts.columns else {"n": F.sum("c").over(family)}
        down = counts.withColumns(total | {"cum": F.sum("c").over(family.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda q, f: f"{f}((n - 1) * {q}D)"
    ends = {f"{name}_{f}": f"min(CASE WHEN cum > {at(q, f)} THEN {value} END)" for name, q in wanted.items() for f in ("floor", "ceil")}
    stats = stats or {}
    found = _agg(down, FAMILY, {"n": "max(n)"} | stats | ends)
    return found.select(*FAMILY, *stats, *[F.expr(f"{name}_floor + ({name}_ceil - {name}_floor) * ((n - 1) * {q}D - {at(q, 'floor')})").alias(name) for name, q in wanted.items()])


#: As NUMBER_STATS, of a family's distinct numbers with their counts (c), how many there are (n, of which n_log have a log1p), and the two means.
COUNTED_STATS = {
    "n": "max(n)", "mean": "max(mean)", "std": "CASE WHEN min(v) = max(v) THEN max(v) - min(v) ELSE sqrt(sum(c * (v - mean) * (v - mean)) / max(n)) END", "max": "max(v)",
    "log_std": "CASE WHEN min(l) = max(l) THEN max(l) - min(l) ELSE sqrt(sum(c * (l - log_mean) * (l - log_mean)) / max(n_log)) END",
}


def number_statistics(long: DataFrame, counts: DataFrame | None = None, spread: bool = False) -> DataFrame:
    """cookie_id, fam: count, mean, population std, max, std of log1p, and interpolated quantiles, exact, from the numbers' counts.

    All of it comes from one pass down a family's counts, so that ``long`` isn't made or read for anything else; with
    ``spread`` no window may hold a family, and what needs no order are aggregates of ``long``.
    """
    counts = frequencies(long) if counts is None else counts
    if spread:
        plain = _agg(long, FAMILY, NUMBER_STATS)
        counts = counts.join(plain.select(*FAMILY, "n"), FAMILY)
        return plain.join(quantiles(counts, "v", QUANTILES, spread), FAMILY).select(*FAMILY, *NUMBER_STATS, *QUANTILES)
    family = Window.partitionBy(*FAMILY)
    logs = counts.withColumn("l", F.expr("CASE WHEN v >= 0 THEN ln(1 + v) END"))
    sums = {"n": "c", "n_log": "CASE WHEN v >= 0 THEN c END", "mean": "c * v", "log_mean": "c * l"}
    known = logs.withColumns({n: F.sum(F.expr(x)).over(family) for n, x in sums.items()}).withColumns({"mean": F.expr("mean / n"), "log_mean": F.expr("log_mean / n_log")})
    return quantiles(known, "v", QUANTILES, stats=COUNTED_STATS).select(*FAMILY, *NUMBER_STATS, *QUANTILES)


def rhythm_statistics(long: DataFrame, statistics: DataFrame | None = None, counts: DataFrame | None = None, spread: bool = False) -> DataFrame:
    """cookie_id, fam: median absolute deviation, share near the median and lag-1 autocorrelation of the cadence families.

    Medians come from ``statistics`` (:func:`number_statistics`), one row per visitor and family; distances from them
    are counted as the numbers are.
    """
    rhythms = F.col("fam").isin(*C.CADENCES)
    kept = long.where(rhythms)
    counts = frequencies(kept) if counts is None else counts.where(rhythms)
    medians = (number_statistics(kept, counts, spread) if statistics is None else statistics.where(rhythms)).select(*FAMILY, "n", F.col("median").alias("m"))
    if spread:
        met = counts.join(medians, FAMILY)
    else:
        # A visitor's few medians come as one row, so that the counts are joined where they lie.
        few = medians.groupBy("cookie_id").agg(F.map_from_entries(F.collect_list(F.struct("fam", "m"))).alias("medians"))
        met = counts.join(few, "cookie_id").withColumn("m", F.element_at("medians", F.col("fam"))).drop("medians")
    apart = met.withColumn("d", F.abs(F.col("v") - F.col("m")))
    mad = quantiles(apart.drop("v", "m"), "d", {"mad": 0.5}, spread)
    return mad.join(_agg(apart, FAMILY, NEAR_STATS), FAMILY).join(_agg(kept, FAMILY, PAIR_STATS), FAMILY)


def widened(long: DataFrame, cells: list[tuple[str, str]]) -> DataFrame:
    """One row per visitor: column fam__stat for each given family and statistic."""
    return long.groupBy("cookie_id").agg(*[F.max(F.when(F.col("fam") == f, F.col(s))).alias(f"{f}__{s}") for f, s in cells])


def side_by_side(parts: list[DataFrame]) -> tuple[DataFrame, dict[str, Column]]:
    """One row per visitor that any part has, and where in it each part's columns are, as doubles.

    Parts are stacked as arrays and picked up by visitor: each is made in tasks of its own, and only short rows meet.
    Joined one after the other, a task would hold what all of them need at once.
    """
    stacked = [p.select("cookie_id", F.lit(k).alias("part"), F.array(*[F.col(c).cast("double") for c in p.columns if c != "cookie_id"]).alias("found")) for k, p in enumerate(parts)]
    picked = reduce(DataFrame.unionByName, stacked).groupBy("cookie_id").agg(*[F.first(F.when(F.col("part") == k, F.col("found")), ignorenulls=True).alias(f"part_{k}") for k in range(len(parts))])
    return picked, {c: F.col(f"part_{k}")[i] for k, p in enumerate(parts) for i, c in enumerate(c for c in p.columns if c != "cookie_id")}


META = {
    "cookie_age_days": "greatest({created} / 86400.0D, 0.0D)",
    "cookie_age_log1p": "ln(1 + greatest({created} / 86400.0D, 0.0D))",
    "cookie_created_within_window": "CASE WHEN cookie_created_at >= window_start_ts THEN 1.0D ELSE 0.0D END",
}


def feature_table(meta: DataFrame, seq: DataFrame, families: str = "all", spread: bool = False, buckets: int | None = None) -> DataFrame:
    """One row per visitor of ``meta``: cookie_id and the 250 base features (``base``) or all 472 (``all``).

    Visitors without events have 0 in counts and -1 in statistics.  Only ids, times and events are read, so
    labels never reach a feature.  With ``spread`` a visitor's rows may be in many tasks, and no task or window
    gathers them; otherwise ``buckets`` is the number of buckets that ``seq`` has.
    """
    base, v2 = C.features()
    wanted = base if families == "base" else base | v2
    # Only what the wanted features read is computed.
    read = set(re.findall(r"[A-Za-z_]\w*", " ".join(wanted.values())))
    cells = [tuple(x.rsplit("__", 1)) for x in sorted(read) if "__" in x]
    of = lambda stats: [(f, s) for f, s in cells if s in stats]
    some = lambda stats: {n: x for n, x in stats.items() if n in read}
    created = "timestampdiff(MICROSECOND, cookie_created_at, window_start_ts) / 1e6D"
    wide = meta.select("cookie_id", *[F.expr(x.format(created=f"({created})")).alias(n) for n, x in META.items()], F.expr("CAST(weekday(window_start_ts) AS double)").alias("window_weekday"))
    value_cells, number_cells, rhythm_cells = of(VALUE_STATS), of((*NUMBER_STATS, *QUANTILES)), of(("mad", *RHYTHM_STATS))
    number_cells = [(f, s) for f, s in number_cells if s != "n"]  # the count of values
    # Numbers of all kinds come together here once; their table is read several times.
    long = numbers(seq, {f for f, _ in number_cells + rhythm_cells}, spread)
    long = stage_table(long, "numbers") if spread else bucketed_table(long, "cookie_id", "numbers", buckets)
    counts = frequencies(long)
    statistics = number_statistics(long, counts, spread)
    parts = [
        scalar_family(seq, read | {"n_events"}),
        widened(value_statistics(seq, {f: x for f, x in C.VALUES.items() if f in {f for f, _ in value_cells}}), value_cells),
        widened(statistics, number_cells),
    ]
    if rhythm_cells:
        parts.append(widened(rhythm_statistics(long, statistics, counts, spread), rhythm_cells))
    for source, stats in (
        *[(lambda c=c: sessions(seq, c), {n.format(p=f"s{c}_"): x for n, x in C.SESSION_SCALARS.items()}) for c in C.CUTOFFS],
        (lambda: _agg(seq, ["cookie_id", "run"], {"size": "count(*)"}), C.RUN_SCALARS),
        (lambda: items(seq, spread), C.ITEM_SCALARS),
        (lambda: query_depths(seq), C.QUERY_SCALARS),
        (lambda: turn_cosines(seq), C.TURN_SCALARS),
    ):
        if own := some(stats):
            parts.append(_agg(source(), ["cookie_id"], own))
    met, places = side_by_side(parts)
    wide = wide.join(met, "cookie_id", "left").select(*wide.columns, *[place.alias(n) for n, place in places.items()])
    wide = wide.withColumn("has_events", F.expr("CASE WHEN n_events > 0 THEN 1.0D ELSE 0.0D END"))
    return wide.select("cookie_id", *[F.expr(C.filled(n, x)).alias(n) for n, x in wanted.items()])
