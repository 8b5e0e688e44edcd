"""Mixing sources to target weights by entropy balancing (operator 3).

Each document gets a rate: how often the mix takes it.  Of all rates up to ``most`` that meet the token
constraints, those that stray least from "once each" (in relative entropy per token) are exponentially tilted,

    rate = min(most, exp(multiplier of the source + sum of multiplier * moment of the document)).

Constraints are each source's target, and, over all sources together, that the mix's mean log size and mean
squared log size of a token's document stay those of the corpus: sources are weighed anew, short and long
documents aren't.  The targets are met exactly, the moments as nearly as a small ridge on their multipliers
allows (a mix that must take all of some sources can't always keep them).

The multipliers solve a convex dual by damped Newton steps.  Slope and curvature of a step are aggregates
over the corpus: per source sums, which one more aggregate reduces to the few numbers that the moments need
(sources meet only through the moments, so their part of the curvature is eliminated source by source).
Nothing per source or per document reaches the driver.

Rates are rounded to whole copies: a document gets one copy more if its draw lies below the fraction, shifted
by one amount per source so that the source's tokens come just below its target; a few of the next documents
fill what is left.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitprint.llm.common import own_columns, stage_table

#: How many times its own size a source, and a document, may be taken.
MOST = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Newton steps at most, and the gap (of a source to its target, of a moment in standard deviations) at which they end.
STEPS, NEAR = 40, 1e-7
#: Ridge on the moments' multipliers, per token of the corpus, and standard deviations at which a log size counts as no further.
RIDGE, FARTHEST = 0.01, 3.0
#: Parts of the range of shifted draws, documents of a source that may fill what its shift leaves, and how many of those lie before it.
PARTS, FILLERS, BACK = 1 << 16, 64, 8
WORD = r"[^\x20\x09-\x0D]+"
#: Fractions below this are none: a rate this much above a whole number is that number.
_HAIR = 1e-9
#: A multiplier beyond every cap, for sources that are taken whole.
_WHOLE = 50.0


def _measured(text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 7) -> list[Column]:
    """source, size (words of the whole text; null: 0) and draw (a hash of id and text) of a row."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return [F.col(source).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(doc_id).cast("long"), text, F.lit(seed)).alias("draw")]


def sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size and draw of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_measured(seed=seed))


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``per_source`` (source, source_size) with target: each source's share of all sizes by weight.

    Sources in code-point order, null last, get the weights in turn.  A target stops at ``most`` times its
    source's size and the excess is shared out again by weight until none is above: that is
    min(most * size, level * weight) with the one level that uses everything.  Places in the order are
    prefix sums over the tasks of a range partitioning, and the level is found from totals.
    """
    order = F.asc_nulls_last("source")
    ranged = per_source.repartitionByRange(order).sortWithinPartitions(order)
    placed = stage_table(ranged.select("source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")), "source-order")
    # One row per task.
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", before.alias("before"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = placed.join(starts, "part").select("source", "source_size", F.get(table, (F.col("before") + F.col("nth")) % len(weights)).alias("weight"))
    weighed = stage_table(weighed, "source-weights")
    stop = most * F.col("source_size").cast("double")
    total, level = float(weighed.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:  # the level rises until no further source stops
        stopped = stop <= level * F.col("weight")
        used, rest = weighed.agg(F.sum(F.when(stopped, stop).otherwise(0.0)), F.sum(F.when(~stopped, F.col("weight")).otherwise(0.0))).first()
        found = (total - used) / rest if rest else level
        if found <= level:
            break
        level = found
    return weighed.select("source", "source_size", F.least(stop, level * F.col("weight")).alias("target"))


class Tilt:
    """What the dual solves to: per source a multiplier (``sources``: source, source_size, target, multiplier), and one per moment."""

    def __init__(self, sources: DataFrame, moments: np.ndarray, scaling: tuple[float, float, float, float], most: int):
        self.sources, self.moments, self.scaling, self.most = sources, moments, scaling, most

    def rated(self, rows: DataFrame) -> DataFrame:
        """``rows`` (size, multiplier) with the moments x and y, the exponent z and the rate (1 without words)."""
        powered = _powered(_with_moments(rows, self.scaling), self.moments)
        cap = math.log(self.most)
        return powered.withColumn("rate", F.when(F.col("size") < 1, 1.0).when(F.col("z") < cap, F.exp("z")).otherwise(float(self.most)))


def _log_size(center: float, scale: float) -> Column:
    """The log of ``size`` in standard deviations from its mean, FARTHEST at most."""
    return F.least(F.greatest((F.log("size") - center) / scale, F.lit(-FARTHEST)), F.lit(FARTHEST))


def _with_moments(rows: DataFrame, scaling: tuple[float, float, float, float]) -> DataFrame:
    center, scale, square, mean = scaling
    x = rows.withColumn("x", F.when(F.col("size") < 1, 0.0).otherwise(_log_size(center, scale)))
    return x.withColumns({"x": F.col("x") - mean, "y": F.col("x") * F.col("x") - square})


def _powered(rows: DataFrame, moments: np.ndarray) -> DataFrame:
    return rows.withColumn("z", F.col("multiplier") + float(moments[0]) * F.col("x") + float(moments[1]) * F.col("y"))


def balance(sized: DataFrame, goals: DataFrame, most: int = MOST, steps: int = STEPS, near: float = NEAR, ridge: float = RIDGE) -> Tilt:
    """Solve the dual for ``sized`` (source, size) and ``goals`` (source, source_size, target; targets up to most * source_size).

    Documents of one source and size have one rate, so sums are taken over those classes, with their tokens.
    """
    classes = sized.where("size > 0").groupBy("source", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("tokens"))
    classes = stage_table(classes, "classes")
    log, tokens = F.log("size"), F.col("tokens")
    total, first, second = classes.agg(F.sum("tokens"), F.sum(tokens * log), F.sum(tokens * log * log)).first()
    start = F.when((F.col("target") <= 0) | (F.col("source_size") <= 0), 0.0).when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), _WHOLE)
    own = goals.select("source", "source_size", "target", start.otherwise(F.log(F.col("target") / F.col("source_size"))).alias("multiplier"))
    if not total:
        return Tilt(stage_table(own, "multipliers"), np.zeros(2), (0.0, 1.0, 0.0, 0.0), most)
    center = first / total
    scale = max(math.sqrt(max(second / total - center * center, 0.0)), 1e-3)
    x = _log_size(center, scale)
    mean, square = classes.agg(F.sum(tokens * x) / total, F.sum(tokens * x * x) / total).first()
    scaling = (center, scale, float(square), float(mean))
    classes = stage_table(_with_moments(classes, scaling), "class-moments")
    moments, cap = np.zeros(2), math.log(most)
    pairs = [(0, 0), (0, 1), (1, 1)]

    def evaluate(sources: DataFrame, moments: np.ndarray):
        """Per source sums at these multipliers, and what of them the moments' step needs."""
        x = [F.col("x"), F.col("y")]
        joined = _powered(classes.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))), moments)
        joined = joined.withColumn("rate", F.when(F.col("z") < cap, F.exp("z")).otherwise(float(most)))
        joined = joined.withColumns({"mass": tokens * F.col("rate"), "free": F.when(F.col("z") < cap, tokens * F.col("rate")).otherwise(0.0)})
        height = F.when(F.col("z") < cap, F.col("mass")).otherwise(tokens * most * (1 + F.col("z") - cap))
        sums = [F.sum("mass").alias("mass"), F.sum("free").alias("free"), F.sum(height).alias("height")]
        sums += [F.sum(F.col("mass") * x[j]).alias(f"m{j}") for j in range(2)] + [F.sum(F.col("free") * x[j]).alias(f"b{j}") for j in range(2)]
        sums += [F.sum(F.col("free") * x[j] * x[k]).alias(f"c{j}{k}") for j, k in pairs]
        each = stage_table(joined.groupBy("s", "source_size", "target", "multiplier").agg(*sums).withColumnRenamed("s", "source"), "source-sums")
        gap, curve = F.col("mass") - F.col("target"), F.greatest("free", 1e-6 * F.col("target"))
        whole = F.col("multiplier") >= _WHOLE
        few = [F.sum(F.col("height") - F.col("target") * F.col("multiplier")), F.max(F.when(whole, 0.0).otherwise(F.abs(gap) / F.col("target")))]
        few += [F.sum(f"m{j}") for j in range(2)] + [F.sum(F.when(whole, 0.0).otherwise(F.col(f"b{j}") * gap / curve)) for j in range(2)]
        few += [F.sum(F.col(f"c{j}{k}") - F.when(whole, 0.0).otherwise(F.col(f"b{j}") * F.col(f"b{k}") / curve)) for j, k in pairs]
        few += [F.max(F.when(whole, 0.0).otherwise(F.abs(x) / curve)) for x in (gap, F.col("b0"), F.col("b1"))]
        dual, apart, m0, m1, r0, r1, c00, c01, c11, *parts = map(float, each.agg(*[f.alias(f"f{i}") for i, f in enumerate(few)]).first())
        slope = np.array([m0, m1]) + ridge * total * moments
        value = dual + ridge * total * float(moments @ moments) / 2
        left = np.array([[c00, c01], [c01, c11]]) + ridge * total * np.eye(2)
        turn = -np.linalg.solve(left, slope - np.array([r0, r1]))
        # No part of an exponent changes by more than 1 in a step; this bounds every source's change.
        widest = max(float(np.abs(turn).max()), parts[0] + float(np.abs(turn) @ parts[1:]))
        return each, value, max(apart, float(np.abs(slope).max()) / total), turn, min(1.0, 1.0 / max(widest, 1e-300))

    each, value, apart, turn, share = evaluate(own, moments)
    for _ in range(steps):
        if apart <= near:
            break
        gap, curve = F.col("mass") - F.col("target"), F.greatest("free", 1e-6 * F.col("target"))
        step = -(gap + float(turn[0]) * F.col("b0") + float(turn[1]) * F.col("b1")) / curve
        stepped = each.withColumn("step", F.when(F.col("multiplier") >= _WHOLE, 0.0).otherwise(step))
        for _ in range(12):
            tried = stepped.select("source", "source_size", "target", (F.col("multiplier") + share * F.col("step")).alias("multiplier"))
            new = evaluate(tried, moments + share * turn)
            if new[1] <= value + 1e-12 * abs(value):
                break
            share /= 2
        moments = moments + share * turn
        each, value, apart, turn, share = new
    # Sources without words have no classes.
    known = each.select(F.col("source").alias("s"), F.col("multiplier").alias("m"))
    solved = own.join(known, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", F.coalesce("m", "multiplier").alias("multiplier"))
    return Tilt(stage_table(solved, "multipliers"), moments, scaling, most)


def _rounded(rows: DataFrame) -> DataFrame:
    """``rows`` (rate, draw) with base (whole copies), some (whether a fraction is left), and the part of 0..PARTS that decides on one more."""
    rows = rows.withColumn("base", F.floor(F.col("rate") + _HAIR).cast("long"))
    rows = rows.withColumn("fraction", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    uniform = F.shiftrightunsigned("draw", 11) / float(1 << 53)
    return rows.withColumns({"some": F.col("fraction") > _HAIR, "part": F.floor((uniform - F.col("fraction") + 1) / 2 * PARTS).cast("int")})


def plan(sized: DataFrame, tilt: Tilt) -> DataFrame:
    """Per source how its rates are rounded: its multiplier, the last part of draws that gets one copy more, and the draws that fill the rest.

    A source's documents are counted by part, so no task holds them, and at most ``FILLERS`` of them are looked at
    one by one.  Rows of equal id and text have one draw and are taken equally often.
    """
    known = tilt.sources.select(F.col("source").alias("s"), "source_size", "target", "multiplier")
    rows = sized.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("s")))
    rows = _rounded(tilt.rated(rows)).select("s", "size", "draw", "target", "base", "some", F.when(F.col("some"), F.col("part")).otherwise(-1).alias("part"))
    each = rows.groupBy("s", "target", "part").agg(
        F.sum(F.when(F.col("some"), F.col("size")).otherwise(0)).alias("more"), F.sum(F.col("size") * F.col("base")).alias("sure"), F.count_if("some").alias("n")
    )
    source = Window.partitionBy("s")
    running = stage_table(each, "parts").withColumn("wanted", F.col("target") - F.sum("sure").over(source))
    running = running.withColumn("sum", F.sum("more").over(source.orderBy("part"))).withColumn("n", F.sum("n").over(source.orderBy("part")))
    # The last part whose sum stays below what is wanted, and then back by some documents, so that there is a choice of fillers.
    whole = running.withColumn("most", F.max(F.when(F.col("sum") <= F.col("wanted"), F.col("n"))).over(source)).where(F.col("n") <= F.col("most") - BACK)
    cut = running.groupBy("s", "wanted").agg(F.count(F.lit(1)).alias("c")).drop("c").join(
        whole.groupBy(F.col("s").alias("t")).agg(F.max("part").alias("last"), F.max("sum").alias("got")), F.col("s").eqNullSafe(F.col("t")), "left"
    )
    cut = stage_table(cut.select("s", F.coalesce("last", F.lit(-1)).alias("last"), (F.col("wanted") - F.coalesce("got", F.lit(0))).alias("left")), "cuts")
    # The next documents of each source, bounded before they are shuffled.
    next_ = rows.where("some").select("s", "size", "draw", "part").join(cut.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t"))).where("part > last AND left >= 0.5")
    next_ = next_.withColumn("nth", F.row_number().over(Window.partitionBy("s").orderBy("part", "draw"))).where(F.col("nth") <= FILLERS)
    # If the last one's equals may not all be here, it isn't used.
    per_draw = next_.groupBy("s", "left", "draw").agg(F.sum("size").alias("size"), F.max("nth").alias("nth")).where(F.col("nth") < FILLERS)
    listed = per_draw.groupBy("s", "left").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), "draw"))).alias("x"))
    none = F.array().cast("array<bigint>")

    def fill(acc: Column, x: Column) -> Column:  # largest first, each that fits
        fits = -x["minus"] <= acc["left"]
        return F.struct(
            F.when(fits, acc["left"] + x["minus"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["chosen"], F.array(x["draw"]))).otherwise(acc["chosen"]).alias("chosen"),
            F.when(fits, acc["smallest"]).otherwise(x).alias("smallest"),
        )

    begin = F.struct(F.col("left").alias("left"), none.alias("chosen"), F.lit(None).cast("struct<minus:bigint,draw:bigint>").alias("smallest"))
    # The smallest that didn't fit comes in if that leaves less over than there was missing.
    ended = lambda acc: F.when(-acc["smallest"]["minus"] < 2 * acc["left"], F.concat(acc["chosen"], F.array(acc["smallest"]["draw"]))).otherwise(acc["chosen"])
    fillers = listed.select(F.col("s").alias("t"), F.aggregate("x", begin, fill, ended).alias("fillers"))
    cuts = cut.join(fillers, F.col("s").eqNullSafe(F.col("t")), "left").select(F.col("s").alias("t"), "last", F.coalesce("fillers", none).alias("fillers"))
    whole = known.join(cuts, F.col("s").eqNullSafe(F.col("t")), "left")
    return stage_table(whole.select("s", "source_size", "target", "multiplier", F.coalesce("last", F.lit(-1)).alias("last"), F.coalesce("fillers", none).alias("fillers")), "mix-plan")


def _with_copies(rows: DataFrame, tilt: Tilt) -> DataFrame:
    """``rows`` (size, draw and their source's plan) with copies; one for a row without words."""
    more = F.col("some") & ((F.col("part") <= F.col("last")) | F.array_contains("fillers", F.col("draw")))
    return _rounded(tilt.rated(rows)).withColumn("copies", F.when(F.col("size") < 1, 1).otherwise(F.col("base") + F.when(more, 1).otherwise(0)).cast("int"))


def _planned(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> tuple[DataFrame, DataFrame, Tilt]:
    sized = stage_table(sizes(docs, seed), "sizes")
    goals = stage_table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    tilt = balance(sized, goals, most)
    return sized, plan(sized, tilt), tilt


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """How often the mix takes each row of ``docs`` (``doc_id``, ``text``, ``source``).

    Returns doc_id, source, size, source_size, target (its source's), copies and taken (size * copies).
    Rows without words have size 0 and take nothing away from others (copies 1, taken 0); a null source is a
    source of its own, after all others; null doc_ids are ids like others; rows of equal id and text are taken
    equally often; an empty table gives no rows.  Reruns agree: draws depend on doc_id, text and ``seed`` only.
    """
    sized, planned, tilt = _planned(docs, weights, most, seed)
    # The plan has a row per source: broadcast while its measured size is under Spark's threshold, hashed beyond.
    rows = sized.join(planned, F.col("source").eqNullSafe(F.col("s")))
    return _with_copies(rows, tilt).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def copy_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as :func:`mix` takes it, with the columns of ``docs``.

    Rows without words are neither repeated nor dropped.  Each row's copies follow from the row and its source's
    plan, so the texts stay where they are while the plan can be broadcast.
    """
    _, planned, tilt = _planned(docs, weights, most, seed)
    rows = docs.select(F.struct(*own_columns(docs)).alias("row"), *_measured(seed=seed)).join(planned, F.col("source").eqNullSafe(F.col("s")))
    copied = _with_copies(rows, tilt).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copied.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
