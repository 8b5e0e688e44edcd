"""Ranking measures, folds, blends and the scoring flow, against plain Python and answers worked out by hand."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gaitprint.operators import ensemble, ranking

SCORED = "key string, y int, score double"


def thresholds(rows):
    """(tp, fp, threshold) at every distinct score, from the highest."""
    for t in sorted({s for _, s in rows}, reverse=True):
        yield sum(y for y, s in rows if s >= t), sum(1 - y for y, s in rows if s >= t), t


def plain(rows, recall=0.7, fpr=0.01):
    """The measures by their definitions; None where a class that they need is missing."""
    p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    if not p:
        return {"precision_at_recall": None, "recall_at_fpr": None, "average_precision": None, "roc_auc": None}
    steps = list(thresholds(rows))
    before, area = 0, 0.0
    for tp, fp, _ in steps:
        area += (tp - before) / p * tp / (tp + fp)
        before = tp
    wins = [(a > b) + (a == b) / 2 for (x, a), (z, b) in itertools.product(rows, rows) if x and not z]
    return {
        "precision_at_recall": max((tp / (tp + fp) for tp, fp, _ in steps if tp / p >= recall), default=0.0),
        "recall_at_fpr": max((tp / p for tp, fp, _ in steps if fp <= fpr * n), default=0.0) if n else None,
        "average_precision": area,
        "roc_auc": sum(wins) / len(wins) if n else None,
    }


def groups():
    rng = random.Random(77)
    out = {"worked": [(1, 0.8), (0, 0.8), (1, 0.6), (1, 0.4), (0, 0.4), (0, 0.2)], "no positives": [(0, 0.3), (0, 0.9)], "no negatives": [(1, 0.3), (1, 0.9)], "one row": [(1, 0.0)]}
    for k in range(25):
        n, levels = rng.randint(2, 70), rng.choice((1, 2, 5, 1000))
        out[f"random {k}"] = [(int(rng.random() < 0.3), rng.randrange(levels) / levels) for _ in range(n)]
    return out


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(k, *r) for k, rows in groups().items() for r in rows], SCORED).persist()


def test_measures_against_their_definitions(scored):
    report = {r["key"]: r.asDict() for r in ranking.ranking_report(scored, ["key"]).collect()}
    for key, rows in groups().items():
        assert report[key]["n"] == len(rows) and report[key]["positives"] == sum(y for y, _ in rows)
        for name, value in plain(rows).items():
            assert report[key][name] == (value if value is None else pytest.approx(value)), (key, name)
    # By hand: 0.4 is the only threshold but the lowest with enough recall, 3 of 5 are right; 5.5 + 0.5 of 9 pairs are in order.
    worked = report["worked"]
    assert worked["precision_at_recall"] == pytest.approx(3 / 5) and worked["roc_auc"] == pytest.approx(6 / 9) and worked["average_precision"] == pytest.approx((1 / 2 + 2 / 3 + 3 / 5) / 3)


def test_single_measures_keep_keys_without_a_class(scored):
    curve = ranking.pr_curve(scored, ["key"], complete=True)
    assert ranking.pr_curve(scored, ["key"]).where("key = 'no positives'").count() == 0
    point = {r["key"]: r for r in ranking.operating_point(curve, ["key"]).collect()}
    for name, found in (("precision_at_recall", ranking.precision_at_recall(curve, ["key"], 0.5)), ("recall_at_fpr", ranking.recall_at_fpr(curve, ["key"], 0.34))):
        got = {r["key"]: r[name] for r in found.collect()}
        assert set(got) == set(groups())
        for key, rows in groups().items():
            value = plain(rows, 0.5, 0.34)[name]
            assert got[key] == (value if value is None else pytest.approx(value)), (key, name)
    assert set(point) == set(groups()) and point["no positives"]["threshold"] is None
    for key, rows in groups().items():
        if sum(y for y, _ in rows):
            p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
            tp, fp, t = max((x for x in thresholds(rows) if x[0] / p >= 0.7), key=lambda x: (x[0] / (x[0] + x[1]), x[0]))
            assert tuple(point[key])[1:] == (t, tp, fp, p - tp, n - fp)


def test_scores_that_cannot_be_ranked_fail(spark):
    make = lambda *rows: spark.createDataFrame([("k", *r) for r in rows], SCORED)
    ranking.check_scores(make((0, 0.0), (1, 1.0)), ["key"])
    for rows in ([(0, 0.2), (0, 0.3)], [(1, 0.2)], [(0, 0.2), (1, math.inf)], [(0, -0.01), (1, 0.5)], [(0, None), (1, 0.5)], [(2, 0.1), (1, 0.5)], [(None, 0.1), (1, 0.5)]):
        with pytest.raises(ValueError):
            ranking.check_scores(make(*rows), ["key"])


def hourly(spark, n=9):
    """Visitors whose windows of 50 minutes start every hour."""
    start = "timestampadd(HOUR, cast(id as int), TIMESTAMP_NTZ'2030-01-31 20:00:00')"
    return spark.range(n).selectExpr("cast(id as string) AS cookie_id", f"{start} AS window_start_ts", f"timestampadd(MINUTE, 50, {start}) AS window_end_ts")


def test_folds_expand(spark):
    folds = spark.createDataFrame([("x", 2, 5), ("y", 5, 9)], "fold string, a int, b int").selectExpr("fold", *(f"timestampadd(HOUR, {c}, TIMESTAMP_NTZ'2030-01-31 20:00:00') AS {n}" for c, n in (("a", "fold_start"), ("b", "fold_end"))))
    roles = ensemble.fold_roles(hourly(spark), folds)
    got = {(r["fold"], r["role"], int(r["cookie_id"])) for r in roles.collect()}
    assert got == {("x", "fit", i) for i in (0, 1)} | {("x", "valid", i) for i in (2, 3, 4)} | {("y", "fit", i) for i in range(5)} | {("y", "valid", i) for i in range(5, 9)}
    ensemble.check_folds(roles)
    overlong = hourly(spark).withColumn("window_end_ts", F.when(F.col("cookie_id") == "1", F.expr("window_start_ts + interval 61 minutes")).otherwise(F.col("window_end_ts")))
    for bad in (overlong, hourly(spark).where("cookie_id > 1"), hourly(spark, 2)):
        with pytest.raises(ValueError, match="fold"):
            ensemble.check_folds(ensemble.fold_roles(bad, folds))


def test_blends(spark):
    wide = spark.createDataFrame([(0, 1.0, 0.5, 0.0), (1, 0.0, None, 1.0), (2, 0.1, 0.2, 0.9)], "i int, p double, q double, r double")
    got = [x["score"] for x in ensemble.blend(wide, {"p": 0.5, "q": 0.3, "r": 0.2}).orderBy("i").collect()]
    assert got == [pytest.approx(0.65), None, pytest.approx(0.29)]
    assert [x["s"] for x in ensemble.blend(wide, ["p", "r"], "s").orderBy("i").collect()] == [0.5, 0.5, 0.5]
    for bad in ({"p": 0.5, "q": 0.6}, {"p": 1.0, "q": 0.0}, {"p": math.inf}, {"p": 1.5, "r": -0.5}, ["p", "q", "p"], (), {}, {"p": 0.5, "none": 0.5}):
        with pytest.raises(ValueError):
            ensemble.blend(wide, bad)


def test_score_tables(spark):
    expected = spark.createDataFrame([("k", 0), ("l", 1), ("m", 2)], "cookie_id string, row_ord int")
    whole = expected.withColumn("score", F.col("row_ord") / 2)
    named = lambda df: {k: v for k, v in ensemble.score_violations(df, expected).first().asDict().items() if v}
    assert named(whole) == {}
    assert named(whole.withColumn("row_ord", 2 - F.col("row_ord"))) == {"misplaced": 2}
    assert named(whole.where("row_ord > 0")) == {"uncovered": 1}
    assert named(whole.union(whole.where("row_ord = 1"))) == {"repeated": 1}
    assert named(whole.withColumn("cookie_id", F.concat("cookie_id", F.lit("?")))) == {"uncovered": 6}
    for bad in (float("nan"), 1.01, -1e-9, None):
        assert named(whole.withColumn("score", F.when(F.col("row_ord") == 0, F.lit(bad)).otherwise(F.col("score")))) == {"bad_scores": 1}


def test_importance_is_weighted_over_models(spark):
    gains = spark.createDataFrame([("one", "f", 2.0), ("one", "g", 6.0), ("two", "g", 0.5), ("two", "h", 0.5), ("none", "f", 0.0)], "model string, feature string, gain double")
    got = {r["feature"]: r["importance"] for r in ranking.importance(gains, {"one": 0.6, "two": 0.4}).collect() if r["importance"] is not None}
    assert got == {"f": pytest.approx(0.15), "g": pytest.approx(0.65), "h": pytest.approx(0.2)}


def test_recipes_per_fold_and_pooled(spark):
    rows = [(c, fold, m, (i + k) / 10, i % 2) for i, (c, fold) in enumerate([("a", 1), ("b", 1), ("c", 2), ("d", 2)]) for k, m in enumerate(ensemble.SPECS)]
    scores = spark.createDataFrame(rows, "cookie_id string, fold int, model string, score double, target int")
    got = {(r["recipe"], r["fold"], r["cookie_id"]): r["score"] for r in ensemble.recipe_scores(scores).collect()}
    assert len(got) == 3 * 2 * 4 and got["constant", "all", "a"] == 0.5
    assert got["v1", "1", "b"] == pytest.approx(0.15) and got["v2", "2", "d"] == got["v2", "all", "d"] == pytest.approx(0.45)
    report = ranking.ranking_report(ensemble.recipe_scores(scores).withColumnRenamed("target", "y"), ["recipe", "fold"]).collect()
    assert {(r["recipe"], r["fold"], r["n"]) for r in report} == {(x, f, n) for x in ("v1", "v2", "constant") for f, n in (("1", 2), ("2", 2), ("all", 4))}


def labelled(spark, n=60):
    """Visitors of whom the odd ones have larger x; v2_z is noise."""
    return spark.range(n).selectExpr("concat('c', cast(id as string)) AS cookie_id", "cast(id as int) AS row_ord", "(id % 2) * 3.0D + (id * 7 % 5) / 5.0D AS x", "(id * 13 % 11) / 11.0D AS v2_z", "cast(id % 2 as int) AS target")


SMALL = {"a": {"families": "base", "maxDepth": 2, "maxIter": 2}, "b": {"families": "all", "maxDepth": 2, "maxIter": 2}}


def test_final_scoring_flow(spark, tmp_path):
    rows = labelled(spark)
    train, test = rows.where("row_ord < 40"), rows.where("row_ord >= 40").drop("target")
    models = ensemble.fit_models(train, SMALL, folder=f"file://{tmp_path}/models")
    scores = ensemble.score_all(models, test, {"a": 0.25, "b": 0.75}, SMALL)
    assert sum(ensemble.score_violations(scores, test).first()) == 0
    got = {r["row_ord"]: r["score"] for r in scores.collect()}
    assert min(v for k, v in got.items() if k % 2) > max(v for k, v in got.items() if not k % 2)
    # Models come back from their files with the same scores.
    again = ensemble.score_all(ensemble.load_models(f"file://{tmp_path}/models", SMALL), test, {"a": 0.25, "b": 0.75}, SMALL)
    assert {r["row_ord"]: r["score"] for r in again.collect()} == got
    names = {m: ensemble.feature_columns(train, SMALL[m]["families"]) for m in SMALL}
    assert names == {"a": ["x"], "b": ["x", "v2_z"]}
    weights = {r["feature"]: r["importance"] for r in ranking.importance(ensemble.gains(spark, models, names), {"a": 0.25, "b": 0.75}).collect()}
    assert weights["x"] > 0.9 and sum(weights.values()) == pytest.approx(1)


def test_out_of_time_scores(spark):
    rows = labelled(spark)
    roles = rows.selectExpr("cookie_id", "explode(array(1, 2)) AS fold", "row_ord").selectExpr("cookie_id", "fold", "CASE WHEN row_ord < 20 * fold THEN 'fit' WHEN row_ord < 20 * fold + 20 THEN 'valid' END AS role").where("role IS NOT NULL")
    got = ensemble.out_of_time_scores(rows.drop("row_ord"), roles, SMALL)
    counts = {(r["model"], r["fold"]): r["count"] for r in got.groupBy("model", "fold").count().collect()}
    assert counts == {(m, f): 20 for m in SMALL for f in (1, 2)}
    assert got.where("(target = 1) <> (score > 0.5)").count() == 0


def test_features_are_checked_before_training(spark):
    table = labelled(spark).drop("target")
    ensemble.check_features(table, 2)
    for bad in (table.drop("x"), table.withColumn("x", F.when(F.col("row_ord") == 3, F.lit(float("nan"))).otherwise(F.col("x"))), table.withColumn("x", F.when(F.col("row_ord") > 3, F.col("x"))), table.drop("x").withColumn("target", F.lit(1.0))):
        with pytest.raises(ValueError, match="features|feature columns"):
            ensemble.check_features(bad, 2)
