"""From files to files: visitors and a log in; features, models, scores and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitprint.operators import clean, digests, ensemble, ranking, segments
from gaitprint.sources import tables
from gaitprint.sources.staging import drop_tables, stage_table, staged


def audit_table(spark: SparkSession, seen: dict, usable: int) -> DataFrame:
    """key, value of what the one pass over the log saw, and of what was left after copies."""
    rows = [(k, float(v)) for k, v in seen.items() if k not in ("first_ts", "last_ts")]
    rows += [("usable_events", float(usable)), ("in_window_exact_duplicates", float(seen["in_window_events_before_deduplication"] - usable))]
    return spark.createDataFrame(rows, "key string, value double")


def run(
    spark: SparkSession, train_path: str, test_path: str, events_path: str, out: str, specs: dict = ensemble.SPECS, recipe=None, heavy_rows: int = segments.HEAVY_ROWS
) -> None:
    """Read, check, clean, build all 472 features, fit, score, check again and write; fails before anything is written if a check does.

    Below ``out``: ``scores`` (CSV in the test file's order), ``features``, ``audit``, ``importance`` (Parquet) and
    ``models``.  The log is read once: checks, audit and the events in their windows come from that pass.  A folder of
    :func:`tables.write_log` is read only in the days and times of any window.  Whatever was staged is deleted.
    """
    recipe = recipe or ensemble.RECIPES["v2"]
    with staged(spark):
        train, test = tables.read_cookies(spark, train_path, True, ordered=True), tables.read_cookies(spark, test_path, False, ordered=True)
        clean.check_visitors(train, test)
        meta = stage_table(clean.all_cookies(train, test), "visitors")
        raw = tables.read_log(spark, events_path, meta) if events_path.rstrip("/").endswith(".days") else tables.read_events(spark, events_path)
        inside, observation = clean.observed_events(raw, meta)
        log = stage_table(inside, "in-windows")
        seen = clean.check_observed(observation)
        features = stage_table(segments.log_features(log, meta, heavy_rows=heavy_rows), "features")
        ensemble.check_features(features)
        usable = int(features.agg(F.sum("n_events")).first()[0])
        labelled, scored = ensemble.split_back(features, train, test)
        models = ensemble.fit_models(labelled.drop("row_ord"), specs, f"{out}/models")
        scores = stage_table(ensemble.score_all(models, scored, recipe, specs), "scores")
        clean.require(ensemble.score_violations(scores, test.select("cookie_id", "row_ord")))
        names = {m: ensemble.feature_columns(features, spec["families"]) for m, spec in specs.items()}
        weights = ensemble.check_recipe(recipe)
        gains = ensemble.gains(spark, {m: model for m, model in models.items() if m in weights}, names)
        tables.write_reports(out, features=features, audit=audit_table(spark, seen, usable), importance=ranking.importance(gains, weights))
        tables.write_scores(scores, f"{out}/scores")


def rebuilt_differences(spark: SparkSession, test_path: str, train_path: str, events_path: str, out: str, decimals: int = 9) -> DataFrame:
    """Cells in which the written features of test visitors differ from those built anew from their own events alone."""
    test = clean.all_cookies(tables.read_cookies(spark, train_path, True).limit(0), tables.read_cookies(spark, test_path, False))
    raw = tables.read_events(spark, events_path)
    own = stage_table(clean.in_window(raw, test).select(*tables.EVENT_COLUMNS), "own-events")
    rebuilt = stage_table(segments.log_features(own, test), "rebuilt")
    drop_tables(own)
    written = spark.read.parquet(f"{out}/features").join(test.select("cookie_id"), "cookie_id", "left_semi")
    return digests.changed_cells(written, rebuilt, "cookie_id", decimals=decimals)
