"""Ranking measures per key, with equal scores kept together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitprint.operators import prefix

TARGET_RECALL, MAX_FPR = 0.70, 0.01


def check_scores(scored: DataFrame, keys: list[str]) -> None:
    """Fail unless every key has both classes, targets are 0/1 and scores are finite and in [0, 1]."""
    bad = F.col("y").isNull() | ~F.col("y").isin(0, 1) | F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1)
    row = scored.groupBy(*keys).agg(F.count_if(bad).alias("bad"), F.min("y").alias("lo"), F.max("y").alias("hi")).where("bad > 0 OR lo = hi OR lo IS NULL").limit(1).count()
    if row:
        raise ValueError("scores or targets are not valid for some key")


def pr_curve(scored: DataFrame, keys: list[str], complete: bool = False) -> DataFrame:
    """keys, score, n, pos (of the tie group), k, tp (down to it), p, total (in all), precision, recall.

    ``scored`` has y (0/1) and score.  Ties are collapsed first, so a tie group is one row; the rest is a running
    sum over parts cut by score (:mod:`gaitprint.operators.prefix`), so a key of any size is many tasks.  Keys without
    positives give no rows, or, if the curve is to be ``complete``, rows whose precision and recall are null.
    """
    ties = scored.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("pos"))
    curve = prefix.running(ties, keys, [F.desc("score")], {"k": "n", "tp": "pos"}, {"p": "pos", "total": "n"}, "curve")
    curve = curve.select(*keys, "score", "n", "pos", "k", "tp", "p", "total")
    curve = curve.withColumns({"precision": F.when(F.col("p") > 0, F.col("tp") / F.col("k")), "recall": F.try_divide("tp", "p")})
    return curve if complete else curve.where("p > 0")


def precision_at_recall(curve: DataFrame, keys: list[str], recall: float = TARGET_RECALL) -> DataFrame:
    """The best precision over all thresholds that reach the recall (null without positives)."""
    best = F.coalesce(F.max(F.when(F.col("recall") >= recall, F.col("precision"))), F.lit(0.0))
    return curve.groupBy(*keys).agg(F.when(F.max("p") > 0, best).alias("precision_at_recall"))


def recall_at_fpr(curve: DataFrame, keys: list[str], fpr: float = MAX_FPR) -> DataFrame:
    """The best recall over all thresholds whose false positives stay within the rate (null if a class is missing)."""
    within = (F.col("k") - F.col("tp")) <= fpr * (F.col("total") - F.col("p"))
    best = F.coalesce(F.max(F.when(within, F.col("recall"))), F.lit(0.0))
    return curve.groupBy(*keys).agg(F.when((F.max("p") > 0) & (F.max(F.col("total") - F.col("p")) > 0), best).alias("recall_at_fpr"))


def operating_point(curve: DataFrame, keys: list[str], recall: float = TARGET_RECALL) -> DataFrame:
    """threshold, tp, fp, fn, tn at the best precision that reaches the recall; of equals the larger recall (all null without positives)."""
    best = F.max_by(F.struct("score", "k", "tp", "p", "total"), F.when(F.col("recall") >= recall, F.struct("precision", "recall")))
    return (
        curve.groupBy(*keys)
        .agg(best.alias("b"))
        .selectExpr(*keys, "b.score AS threshold", "b.tp AS tp", "b.k - b.tp AS fp", "b.p - b.tp AS fn", "b.total - b.p - (b.k - b.tp) AS tn")
    )


def areas(curve: DataFrame, keys: list[str]) -> DataFrame:
    """average_precision (over tie groups; null without positives) and roc_auc (ties counted half; null if a class is missing)."""
    return curve.groupBy(*keys).agg(
        F.sum(F.try_divide("pos", "p") * F.col("precision")).alias("average_precision"),
        F.expr("sum((n - pos) * (tp - pos + pos / 2.0D)) / nullif(max(p) * max(total - p), 0)").alias("roc_auc"),
    )


def ranking_report(scored: DataFrame, keys: list[str]) -> DataFrame:
    """n, positives, fraction and all measures for each key; what needs a class that a key lacks is null."""
    curve = pr_curve(scored, keys, complete=True)
    size = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"), F.avg(F.col("y").cast("double")).alias("fraction"))
    for part in (precision_at_recall(curve, keys), recall_at_fpr(curve, keys), areas(curve, keys)):
        size = size.join(part, keys, "left")
    return size


def weighted_precision(report: DataFrame, keys: list[str]) -> DataFrame:
    """Mean precision over folds, weighted by positives."""
    return report.groupBy(*keys).agg((F.sum(F.col("precision_at_recall") * F.col("positives")) / F.sum("positives")).alias("weighted_precision"))


def importance(gains: DataFrame, weights: dict[str, float]) -> DataFrame:
    """feature, importance: each model's gains (model, feature, gain) as shares, times its weight, summed."""
    weight = F.create_map(*[x for m, w in weights.items() for x in (F.lit(m), F.lit(float(w)))])
    total = gains.groupBy("model").agg(F.sum("gain").alias("total"))
    shares = gains.join(total, "model").select("feature", (F.col("gain") / F.nullif("total", F.lit(0.0)) * weight[F.col("model")]).alias("x"))
    return shares.groupBy("feature").agg(F.sum("x").alias("importance"))
