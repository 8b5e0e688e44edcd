"""The registered queries of the behaviour features, over the log that :mod:`gaitprint.sources.sample_log` derives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitprint.operators import catalogue as C
from gaitprint.operators import clean, ensemble, prefix, pruning, ranking, segments, sequences
from gaitprint.sources import sample_log, tables
from gaitprint.sources.staging import bucketed_table, data_version, drop_tables, new_folder, stage_table
from gaitprint.sources.tables import EVENT_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]
FOLDS = "VALUES (1, TIMESTAMP_NTZ'2024-01-06 00:00:00', TIMESTAMP_NTZ'2024-01-08 00:00:00'), (2, TIMESTAMP_NTZ'2024-01-08 00:00:00', TIMESTAMP_NTZ'2024-01-10 00:00:00'), (3, TIMESTAMP_NTZ'2024-01-10 00:00:00', TIMESTAMP_NTZ'2024-01-12 00:00:00') AS f(fold, fold_start, fold_end)"


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """All columns but ``keep`` as doubles of 6 decimals, so that two engines' sums compare."""
    return df.select(*keep, *[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) for c in df.columns if c not in keep])


def _meta(spark, d):
    return sample_log.load(spark, d)[0].drop("is_train", "target")


def _clean(spark, d):
    meta, events = sample_log.load(spark, d)
    return clean.clean_events(events, meta)


def _seq(spark, d):
    return sequences.sequence_columns(clean.describe_events(_clean(spark, d)))


def _written(meta, events, tasks: int, read: set[str] | None = None):
    """The sequence columns, or those that are read, written once for what reads them several times, and hashed by visitor as they are."""
    seq = sequences.sequence_columns(clean.describe_events(clean.clean_events(events, meta, tasks)))
    return bucketed_table(seq.select(*[c for c in seq.columns if read is None or c in read]), "cookie_id", "sequence-columns", tasks)


def _seq_table(spark, d):
    meta, events = sample_log.load(spark, d)
    return _written(meta, events, clean.tasks_for(spark, events.count()))


def _numbers(spark, d, families: set[str] | None = None) -> tuple[DataFrame, int]:
    """The long table of number families, and into how many tasks its visitors should be hashed: as many as the log is."""
    meta, events = sample_log.load(spark, d)
    tasks = clean.tasks_for(spark, events.count())
    return sequences.numbers(_written(meta, events, tasks, sequences.read_by_numbers(families)), families), tasks


def _summaries(spark, d):
    """The numbers' statistics: hashed by visitor once, what counts and orders them shuffles nothing more."""
    long, tasks = _numbers(spark, d)
    return sequences.number_statistics(long.repartition(tasks, "cookie_id"))


def _rhythms(spark, d):
    """The rhythms' statistics; their numbers are written once, as they are read several times."""
    long, tasks = _numbers(spark, d, set(C.CADENCES))
    return sequences.rhythm_statistics(bucketed_table(long, "cookie_id", "rhythms", tasks))


def _features(spark, d, families="all", only: DataFrame | None = None):
    """The feature table of all visitors, or of some from their own events alone."""
    meta, events = sample_log.load(spark, d)
    if only is not None:
        meta, events = meta.join(only, "cookie_id", "left_semi"), pruning.events_of(events, only)
    return segments.log_features(events, meta, families)


_WRITTEN: dict[tuple, DataFrame | str] = {}


def _key(spark, d, name: str) -> tuple:
    return spark.sparkContext.applicationId, d, name, data_version(spark, f"{d}/events.parquet")


def _once(spark, d, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read: written once per application and state of the log's files."""
    key = _key(spark, d, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = stage_table(make(), name)
    return _WRITTEN[key]


def _checked_features(spark, d):
    table = _once(spark, d, "features", lambda: _features(spark, d))
    ensemble.check_features(table)
    return table


def _train(spark, d, is_train=True):
    return sample_log.load(spark, d)[0].where(F.col("is_train") == is_train).drop("is_train")


def _scored(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id").select("lang", F.col("toxic").alias("y"), (F.col("n_chars") % 100 / 100.0).alias("score"))


def _curve(spark, d):
    return ranking.pr_curve(_scored(spark, d), ["lang"])


def _roles(spark, d):
    return ensemble.fold_roles(_train(spark, d), spark.sql(f"SELECT * FROM {FOLDS}"))


def _two_scores(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.selectExpr("doc_id", "(n_chars % 100) / 100.0D AS a", "CASE WHEN n_chars % 7 = 0 THEN NULL ELSE (n_chars % 37) / 37.0D END AS b")


def _rebuild(spark, d):
    """Test visitors, each rebuilt from their own events alone: some of the rebuilt features, and how many of all 472 differ (none should)."""
    test = _train(spark, d, False).select("cookie_id")
    rebuilt = _once(spark, d, "rebuilt", lambda: _features(spark, d, only=test))
    whole = _once(spark, d, "features", lambda: _features(spark, d)).join(test, "cookie_id", "left_semi")
    told = rounded(rebuilt.select("cookie_id", "n_events", "gap_mean", "v2_cadence_all_entropy"), "cookie_id")
    return told.join(ensemble.compared(whole, rebuilt), "cookie_id", "full_outer")


def _placed(spark, d, is_train):
    """A visitor table with row_ord, the place that scores are written in."""
    placed = prefix.positions(_train(spark, d, is_train), [], [F.asc("window_start_ts"), F.asc("cookie_id")], "places", "row_ord")
    return placed.withColumn("row_ord", F.col("row_ord") - 1).drop("part")


def _observed(spark, d):
    """What one pass over the log tells: the audit's counters but for copies, the checks' counts, and nulls."""
    meta, events = sample_log.load(spark, d)
    inside, seen = clean.observed_events(events, meta)
    drop_tables(stage_table(inside, "inside"))
    rows = [(k, float(v)) for k, v in clean.check_observed(seen).items() if k not in ("first_ts", "last_ts")]
    return spark.createDataFrame(rows, "key string, value double")


def _pruned(spark, d):
    """Events in their windows per visitor and day, read from a log laid out by day."""
    meta, events = sample_log.load(spark, d)
    folder = new_folder(spark, "log-by-day")
    tables.write_log(events, folder)
    inside = clean.in_window(tables.read_log(spark, folder, meta), meta)
    return inside.groupBy("cookie_id", F.to_date("event_ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _labelled(spark, d):
    return _checked_features(spark, d).join(_train(spark, d).select("cookie_id", "target"), "cookie_id")


def _scores(spark, d):
    def make():
        roles = _roles(spark, d)
        ensemble.check_folds(roles)
        return ensemble.out_of_time_scores(_labelled(spark, d), roles)

    return _once(spark, d, "out-of-time-scores", make)


def _recipe_report(spark, d):
    """Ranking measures of every recipe, per fold and pooled."""
    scored = ensemble.recipe_scores(_scores(spark, d)).withColumnRenamed("target", "y")
    ranking.check_scores(scored, ["recipe", "fold"])
    return ranking.ranking_report(scored, ["recipe", "fold"])


def _models(spark, d):
    """The models of all specs, fitted on all labelled visitors, saved once and read back."""
    key = _key(spark, d, "models")
    if key not in _WRITTEN:
        _WRITTEN[key] = new_folder(spark, "models")
        ensemble.fit_models(_labelled(spark, d), folder=_WRITTEN[key])
    return ensemble.load_models(_WRITTEN[key])


def _final_scores(spark, d):
    """The scores of v2 for all test visitors, in their order."""

    def make():
        _, test = ensemble.split_back(_checked_features(spark, d), _placed(spark, d, True), _placed(spark, d, False))
        return ensemble.score_all(_models(spark, d), test, ensemble.RECIPES["v2"])

    return _once(spark, d, "final-scores", make)


def _importance(spark, d):
    """Weighted gains of the models of v2, each fitted on all labelled visitors."""
    table = _checked_features(spark, d)
    names = {m: ensemble.feature_columns(table, spec["families"]) for m, spec in ensemble.SPECS.items()}
    return rounded(ranking.importance(ensemble.gains(spark, _models(spark, d), names), ensemble.RECIPES["v2"]), "feature")


def _score_table(spark, d):
    """Checks of the final scores against the test visitors and their places: all counts are 0."""
    return ensemble.score_violations(_final_scores(spark, d), _placed(spark, d, False).select("cookie_id", "row_ord"))


def queries() -> dict[str, Query]:
    q = {}
    q["all_cookies"] = lambda s, d: clean.all_cookies(_train(s, d), _train(s, d, False))
    q["clean_events"] = lambda s, d: _clean(s, d).select(*EVENT_COLUMNS, "rn")
    q["event_audit"] = lambda s, d: clean.audit(*reversed(sample_log.load(s, d)))
    q["observed_log"] = _observed
    q["pruned_log"] = _pruned
    q["repeated_events"] = lambda s, d: pruning.exact_copies(stage_table(sample_log.load(s, d)[1].select(*EVENT_COLUMNS), "log"), list(EVENT_COLUMNS))
    q["null_fractions"] = lambda s, d: clean.null_fractions(sample_log.load(s, d)[1])
    q["event_value_counts"] = lambda s, d: clean.value_counts(_clean(s, d))
    q["event_time_range"] = lambda s, d: clean.time_range(_clean(s, d))
    q["cookie_checks"] = lambda s, d: clean.cookie_violations(_train(s, d), True)
    q["cookie_overlap"] = lambda s, d: clean.overlapping_cookies(_train(s, d), _train(s, d, False))
    q["unknown_cookies"] = lambda s, d: clean.unknown_cookies(sample_log.load(s, d)[1], _train(s, d))
    q["scalar_features"] = lambda s, d: rounded(sequences.scalar_family(_seq_table(s, d)).select("cookie_id", *C.scalars()), "cookie_id")
    q["value_distributions"] = lambda s, d: rounded(sequences.value_statistics(_seq(s, d)), "cookie_id", "fam", "n", "k", "top")
    q["number_summaries"] = lambda s, d: rounded(_summaries(s, d), "cookie_id", "fam")
    q["cadence_features"] = lambda s, d: rounded(_rhythms(s, d), "cookie_id", "fam")
    for c in C.CUTOFFS:
        q[f"sessions_{c}"] = lambda s, d, c=c: rounded(sequences.session_scalars(_seq(s, d), c), "cookie_id")
    q["action_runs"] = lambda s, d: rounded(sequences.run_scalars(_seq(s, d)), "cookie_id")
    q["item_activity"] = lambda s, d: rounded(sequences.items(_seq(s, d)).select("cookie_id", "item_id", "events", "types", "viewed", "contact", "latency"), "cookie_id", "item_id")
    q["item_funnel"] = lambda s, d: rounded(sequences._agg(sequences.items(_seq(s, d)), ["cookie_id"], C.ITEM_SCALARS), "cookie_id")
    q["query_depth"] = lambda s, d: rounded(sequences.query_depths(_seq(s, d)), "cookie_id", "search_query")
    q["pointer_turns"] = lambda s, d: rounded(sequences.turns(_seq(s, d)), "cookie_id")
    q["cookie_features_base"] = lambda s, d: rounded(_features(s, d, "base"), "cookie_id")
    q["cookie_features"] = lambda s, d: rounded(_features(s, d), "cookie_id")
    q["rebuild_difference"] = _rebuild
    q["feature_fingerprint"] = lambda s, d: ensemble.fingerprint(rounded(_once(s, d, "features", lambda: _features(s, d)), "cookie_id"), "cookie_id")
    q["pr_curve"] = lambda s, d: rounded(_curve(s, d).select("lang", "n", "pos", "k", "tp", "score", "precision", "recall"), "lang", "n", "pos", "k", "tp")
    q["precision_at_recall"] = lambda s, d: rounded(ranking.precision_at_recall(_curve(s, d), ["lang"]), "lang")
    q["recall_at_fpr"] = lambda s, d: rounded(ranking.recall_at_fpr(_curve(s, d), ["lang"]), "lang")
    q["operating_point"] = lambda s, d: rounded(ranking.operating_point(_curve(s, d), ["lang"]), "lang", "tp", "fp", "fn", "tn")
    q["ranking_report"] = lambda s, d: rounded(ranking.ranking_report(_scored(s, d), ["lang"]), "lang", "n", "positives")
    q["weighted_precision"] = lambda s, d: rounded(ranking.weighted_precision(ranking.ranking_report(_scored(s, d), ["lang"]).withColumn("recipe", F.lit("all")), ["recipe"]), "recipe")
    q["time_folds"] = lambda s, d: _roles(s, d).select("cookie_id", "fold", "role")
    q["blend"] = lambda s, d: ensemble.blend(_two_scores(s, d), {"a": 0.25, "b": 0.75}).select("doc_id", F.round("score", 6).alias("score"))
    q["final_scores"] = lambda s, d: rounded(_final_scores(s, d), "cookie_id", "row_ord")
    q["score_table"] = _score_table
    q["out_of_time_scores"] = lambda s, d: rounded(_scores(s, d), "cookie_id", "model", "fold", "target")
    q["recipe_report"] = lambda s, d: rounded(_recipe_report(s, d), "recipe", "fold", "n", "positives")
    q["recipe_precision"] = lambda s, d: rounded(ranking.weighted_precision(_recipe_report(s, d).where("fold <> 'all'"), ["recipe"]), "recipe")
    q["importance"] = _importance
    return q


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """One row of behaviour features per visitor."""
    return _features(spark, d)
