"""Time folds, tree ensembles, blends, score tables, and comparison of feature tables."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitprint.sources.staging import drop_tables, stage_table

SEED = 42
#: Fits whose jobs run side by side.
FITS_AT_ONCE = 6
#: Visitors of one task of a fit, about; each task keeps its visitors' binned features.
TASK_VISITORS = 20_000
#: Models: which features each sees, and its trees.
SPECS = {
    "base_shallow": {"families": "base", "maxDepth": 3, "maxIter": 20, "stepSize": 0.1},
    "base_deep": {"families": "base", "maxDepth": 5, "maxIter": 12, "stepSize": 0.1},
    "all_shallow": {"families": "all", "maxDepth": 3, "maxIter": 20, "stepSize": 0.1},
    "all_deep": {"families": "all", "maxDepth": 5, "maxIter": 12, "stepSize": 0.1},
}
#: Columns of the tables here that no model sees; vectors of features are others.
NO_FEATURES = ("cookie_id", "target", "row_ord", "fit_in", "valid_in")
RECIPES = {"v1": {"base_shallow": 0.5, "base_deep": 0.5}, "v2": dict.fromkeys(SPECS, 0.25)}


def fold_roles(cookies: DataFrame, folds: DataFrame) -> DataFrame:
    """cookie_id, fold, role: ``fit`` before a fold's start, ``valid`` within it (``folds``: fold, fold_start, fold_end; a handful of rows)."""
    role = F.when(F.col("window_start_ts") < F.col("fold_start"), "fit").when(F.col("window_start_ts") < F.col("fold_end"), "valid")
    return cookies.join(F.broadcast(folds), F.col("window_start_ts") < F.col("fold_end")).select("cookie_id", "fold", role.alias("role"), "window_start_ts", "window_end_ts", "fold_start")


def check_folds(roles: DataFrame) -> None:
    """Fail if a side of a fold is empty or a fit window ends after a valid window starts."""
    row = roles.groupBy("fold").agg(
        F.count_if(F.col("role") == "fit").alias("f"), F.count_if(F.col("role") == "valid").alias("v"),
        F.max(F.when(F.col("role") == "fit", F.col("window_end_ts"))).alias("e"), F.min(F.when(F.col("role") == "valid", F.col("window_start_ts"))).alias("s"),
    )
    if row.where("f = 0 OR v = 0 OR e > s").limit(1).count():
        raise ValueError("a fold has an empty side or overlapping windows")


def feature_columns(table: DataFrame, families: str) -> list[str]:
    names = [c for c in table.columns if c not in NO_FEATURES and not c.startswith("vector_")]
    return [c for c in names if families == "all" or not c.startswith("v2_")]


def check_features(table: DataFrame, columns: int = 472) -> None:
    """Fail unless the table has the expected number of finite features and no label among them."""
    names = [c for c in table.columns if c not in ("cookie_id", "row_ord")]
    if len(names) != columns or "target" in names:
        raise ValueError("unexpected feature columns")
    bad = table.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in names]).first()
    if any(bad):
        raise ValueError("features must be finite")


def vectors(rows: DataFrame, specs: dict = SPECS) -> DataFrame:
    """``rows`` with the features that the specs see as a column vector_<families> each, where it isn't there yet."""
    names = {families: feature_columns(rows, families) for families in sorted({spec["families"] for spec in specs.values()})}
    for families, columns in names.items():
        if f"vector_{families}" not in rows.columns:
            rows = VectorAssembler(inputCols=columns, outputCol=f"vector_{families}").transform(rows)
    return rows


def vector_table(rows: DataFrame, specs: dict = SPECS) -> DataFrame:
    """What of ``rows`` is no feature, and the vectors of :func:`vectors`, written once in order, for fits to read.

    A fit reads its rows several times: from here it neither joins them again nor reads hundreds of columns, and
    its tasks hold about :data:`TASK_VISITORS` visitors, whatever their number.
    """
    others = [c for c in rows.columns if c not in feature_columns(rows, "all")]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_VISITORS))
    found = vectors(rows, specs)
    found = found.select(*others, *[c for c in found.columns if c.startswith("vector_")])
    return stage_table(found.repartition(parts, "cookie_id").sortWithinPartitions("cookie_id"), "vectors")


def fit_model(rows: DataFrame, spec: dict):
    """A boosted ensemble of one spec on rows with target and features, or their vectors."""
    params = {k: v for k, v in spec.items() if k != "families"}
    seen = vectors(rows, {"": spec}).select(F.col(f"vector_{spec['families']}").alias("features"), F.col("target").cast("double").alias("target"))
    return GBTClassifier(labelCol="target", featuresCol="features", seed=SEED, maxBins=32, **params).fit(seen)


def fit_models(rows: DataFrame, specs: dict = SPECS, folder: str | None = None) -> dict:
    """One model per spec, fitted on all of ``rows`` (features and target); saved below ``folder`` if one is given."""
    rows = vector_table(rows, specs)
    models = {name: model for (_, name), model in fit_at_once({(0, name): (rows, spec) for name, spec in specs.items()}).items()}
    drop_tables(rows)
    for name, model in models.items() if folder else ():
        model.write().overwrite().save(f"{folder}/{name}")
    return models


def fit_at_once(wanted: dict[tuple, tuple[DataFrame, dict]]) -> dict[tuple, object]:
    """Models of (rows, spec) under their keys, fitted side by side: a boosting round of one fills the tasks that others leave idle.

    Each fit has a scheduling pool of its own (fair where the session schedules so) and does what it does alone, so
    models are the same.
    """

    def one(item):
        key, (rows, spec) = item
        sc = rows.sparkSession.sparkContext
        sc.setLocalProperty("spark.scheduler.pool", "-".join(map(str, key)))
        return key, fit_model(rows, spec)

    if not wanted:
        return {}
    spark = next(iter(wanted.values()))[0].sparkSession
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return dict(pool.map(inheritable_thread_target(spark)(one), wanted.items()))


def load_models(folder: str, specs: dict = SPECS) -> dict:
    return {name: GBTClassificationModel.load(f"{folder}/{name}") for name in specs}


def model_scores(models: dict, rows: DataFrame, specs: dict = SPECS) -> DataFrame:
    """``rows`` (features, or their vectors) with the features' place taken by each model's probability of class 1, in a column of its name; nothing is joined."""
    kept = [c for c in ("cookie_id", "row_ord", "target") if c in rows.columns]
    rows = vectors(rows, {m: specs[m] for m in models})
    rows = rows.select(*kept, *[c for c in rows.columns if c.startswith("vector_")])
    for name, model in models.items():
        scored = model.copy().setFeaturesCol(f"vector_{specs[name]['families']}").setProbabilityCol("p_").setRawPredictionCol("r_").setPredictionCol("c_").transform(rows)
        rows = scored.withColumn(name, vector_to_array("p_")[1]).drop("p_", "r_", "c_")
    return rows.select(*kept, *models)


def score_all(models: dict, rows: DataFrame, recipe, specs: dict = SPECS) -> DataFrame:
    """cookie_id, row_ord and score: a recipe's blend of the models' scores of every row."""
    return blend(model_scores(models, rows, specs), recipe).select("cookie_id", "row_ord", "score")


def split_back(features: DataFrame, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The features of train visitors with row_ord and target, and of test visitors with row_ord; fails if a visitor has none."""
    out = []
    for own in (train.select("cookie_id", "row_ord", "target"), test.select("cookie_id", "row_ord")):
        if own.join(features.select("cookie_id"), "cookie_id", "left_anti").limit(1).count():
            raise ValueError("visitors without features")
        out.append(own.join(features, "cookie_id"))
    return out[0], out[1]


def check_recipe(recipe) -> dict[str, float]:
    """A recipe as weights: a list is equal weights; names must differ, weights be positive, finite and sum to 1."""
    if isinstance(recipe, (list, tuple)):
        if not recipe or len(set(recipe)) != len(recipe):
            raise ValueError("models of a recipe must be given and differ")
        recipe = dict.fromkeys(recipe, 1 / len(recipe))
    if not recipe or any(not math.isfinite(w) or w <= 0 for w in recipe.values()) or abs(sum(recipe.values()) - 1) > 1e-9:
        raise ValueError("weights must be positive and sum to 1")
    return dict(recipe)


def blend(wide: DataFrame, recipe, name: str = "score") -> DataFrame:
    """``wide`` (a column of scores per model) with the weighted sum; a null score leaves it null."""
    weights = check_recipe(recipe)
    missing = set(weights) - set(wide.columns)
    if missing:
        raise ValueError(f"no scores of {sorted(missing)}")
    return wide.withColumn(name, blend_column(weights))


def blend_column(recipe):
    """The weighted sum of a recipe's columns."""
    total = None
    for m, w in check_recipe(recipe).items():
        total = F.col(m) * w if total is None else total + F.col(m) * w
    return total


def out_of_time_scores(table: DataFrame, roles: DataFrame, specs: dict = SPECS) -> DataFrame:
    """cookie_id, fold, model, score, target: each model fitted on a fold's fit rows and applied to its valid rows."""
    folds = [fold for (fold,) in roles.select("fold").distinct().orderBy("fold").collect()]  # a handful
    side = lambda role: F.collect_set(F.when(F.col("role") == role, F.col("fold"))).alias(f"{role}_in")
    rows = vector_table(table.join(roles.groupBy("cookie_id").agg(side("fit"), side("valid")), "cookie_id"), specs)
    own = lambda role, fold: rows.where(F.array_contains(f"{role}_in", F.lit(fold)))
    fitted = fit_at_once({(fold, name): (own("fit", fold), spec) for fold in folds for name, spec in specs.items()})
    parts = []
    for fold in folds:
        models = {name: fitted[fold, name] for name in specs}
        wide = model_scores(models, own("valid", fold), specs)
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])).alias("m")
        parts.append(wide.select("cookie_id", F.lit(fold).alias("fold"), "target", each).select("cookie_id", "fold", "m.model", "m.score", "target"))
    return reduce(DataFrame.unionByName, parts)


def recipe_scores(scores: DataFrame, recipes: dict = RECIPES) -> DataFrame:
    """recipe, fold, cookie_id, target, score: each recipe's blend of out-of-time scores and the constant score 0.5, per fold and pooled as fold ``all``."""
    models = sorted({m for r in recipes.values() for m in check_recipe(r)})
    wide = scores.groupBy("cookie_id", F.col("fold").cast("string").alias("fold"), "target").pivot("model", models).agg(F.first("score"))
    every = F.array(*[F.struct(F.lit(name).alias("recipe"), blend_column(r).alias("score")) for name, r in recipes.items()], F.struct(F.lit("constant").alias("recipe"), F.lit(0.5).alias("score")))
    folds = F.explode(F.array("fold", F.lit("all"))).alias("fold")
    return wide.select("cookie_id", "fold", "target", F.explode(every).alias("r")).select("r.recipe", folds, "cookie_id", "target", "r.score")


def gains(spark: SparkSession, models: dict, names: dict[str, list[str]]) -> DataFrame:
    """model, feature, gain of fitted models."""
    rows = [(m, names[m][int(i)], float(v)) for m, model in models.items() for i, v in zip(model.featureImportances.indices, model.featureImportances.values, strict=True)]
    return spark.createDataFrame(rows, "model string, feature string, gain double")


def score_violations(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of counts that must be 0: bad values, repeats, missing or extra visitors, places out of order (both with cookie_id, row_ord)."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1)
    own = scores.agg(F.count_if(bad).alias("bad_scores"), (F.count(F.lit(1)) - F.count_distinct("cookie_id")).alias("repeated"))
    both = scores.select("cookie_id", F.col("row_ord").alias("a")).join(expected.select("cookie_id", F.col("row_ord").alias("b")), "cookie_id", "full_outer")
    return own.crossJoin(both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("uncovered"), F.count_if(F.col("a") != F.col("b")).alias("misplaced")))


def fingerprint(table: DataFrame, order: str) -> DataFrame:
    """One row: xor and sum of hashes of all rows with their place; one changed cell or place changes it."""
    h = F.xxhash64(order, *[c for c in sorted(table.columns) if c != order])
    return table.agg(F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("total"), F.count(F.lit(1)).alias("rows"))


def compared(a: DataFrame, b: DataFrame, key: str = "cookie_id", tolerance: float = 1e-9) -> DataFrame:
    """key and differing: how many columns of its rows lie further apart than ``tolerance`` (null for keys on one side only)."""
    if a.columns != b.columns:
        raise ValueError("columns differ")
    names = [c for c in a.columns if c != key]
    left = a.select(key, F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    right = b.select(key, F.array(*[F.col(c).cast("double") for c in names]).alias("y"))
    apart = F.filter(F.zip_with("x", "y", lambda p, q: ~p.eqNullSafe(q) & ~F.coalesce(F.abs(p - q) <= tolerance, F.lit(False))), lambda z: z)
    return left.join(right, key, "full_outer").select(key, F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.size(apart)).alias("differing"))


def differences(a: DataFrame, b: DataFrame, key: str = "cookie_id", tolerance: float = 1e-9) -> DataFrame:
    """Keys on one side only, and keys with any column further apart than ``tolerance``."""
    return compared(a, b, key, tolerance).where("differing IS NULL OR differing > 0").select(key)
