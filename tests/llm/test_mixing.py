"""The mixing dual against a dense solver, and what rounding makes of its rates."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitprint.llm import mixing

SIZED = "doc_id long, source string, size long, draw long"


def sized_rows(rng, sources):
    """Documents of log-normal sizes, some sources longer than others; ids in no order."""
    rows = []
    for k, (name, n) in enumerate(sources.items()):
        rows += [(rng.randrange(10**12), name, max(0, int(rng.lognormvariate(3 + k % 3, 1.2))), rng.randrange(-(2**63), 2**63)) for _ in range(n)]
    return rows


def dense(rows, goals, most, ridge):
    """Rates by full Newton steps on all multipliers at once, written for small data."""
    rows = [r for r in rows if r[2] > 0]
    names = sorted(goals, key=str)
    size = np.array([r[2] for r in rows], float)
    log = np.log(size)
    total = size.sum()
    center = (size * log).sum() / total
    scale = max(np.sqrt((size * log * log).sum() / total - center**2), 1e-3)
    x = np.clip((log - center) / scale, -mixing.FARTHEST, mixing.FARTHEST)
    y = x * x - (size * x * x).sum() / total
    x = x - (size * x).sum() / total
    own = np.array([[r[1] == n for n in names] for r in rows], float)
    free = np.array([goals[n] < most * (size @ own[:, i]) * (1 - 1e-12) for i, n in enumerate(names)])
    a = np.column_stack([own[:, free], x, y])
    whole = own[:, ~free].any(axis=1)
    wanted = np.concatenate([[goals[n] for i, n in enumerate(names) if free[i]], [0.0, 0.0]])
    keep = np.zeros(len(wanted))
    keep[-2:] = ridge * total
    m = np.zeros(len(wanted))
    rate_of = lambda m: np.where(whole, most, np.minimum(most, np.exp(np.minimum(a @ m, 50))))
    for _ in range(500):
        rate = rate_of(m)
        slope = a.T @ (size * rate) - wanted + keep * m
        if np.abs(slope).max() < 1e-9 * total:
            break
        live = np.where(rate < most, size * rate, 0.0)
        step = -np.linalg.lstsq(a.T @ (live[:, None] * a) + np.diag(keep) + 1e-9 * total * np.eye(len(m)), slope, rcond=None)[0]
        m = m + step * min(1.0, 0.5 / np.abs(step).max())
    rate = rate_of(m)
    return {(r[1], r[2]): v for r, v in zip(rows, rate, strict=True)}, np.array([(size * rate * x).sum(), (size * rate * y).sum()]) / total, m[-2:]


@pytest.mark.parametrize("sources", [{"a": 80, "b": 40, "c": 60, None: 30}, {"a": 300, "b": 2}, {"only": 25}])
def test_rates_are_the_dense_solution(spark, sources):
    rows = sized_rows(random.Random(3), sources)
    sized = spark.createDataFrame(rows, SIZED)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = mixing.targets(per).persist()
    told = {r["source"]: r["target"] for r in goals.collect()}
    tilt = mixing.balance(sized, goals)
    rated = tilt.rated(sized.join(tilt.sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))).collect()
    rates, moments, multipliers = dense(rows, told, mixing.MOST, mixing.RIDGE)
    for r in rated:
        assert r["rate"] == (1 if r["size"] < 1 else pytest.approx(rates[r["source"], r["size"]], rel=1e-4))
    # Every target is met, and the moments up to the ridge's share.
    for s, target in told.items():
        assert sum(r["size"] * r["rate"] for r in rated if r["source"] == s) == pytest.approx(target, rel=1e-5)
    assert np.allclose(moments, -mixing.RIDGE * multipliers, atol=1e-6) and np.allclose(tilt.moments, multipliers, atol=1e-4)
    if len(sources) > 2:  # documents of one source have different rates
        assert len({round(r["rate"], 6) for r in rated if r["source"] == "c"}) > 5


def test_rounding_meets_targets_and_draws_decide(spark):
    rng = random.Random(4)
    sources = {f"s{k}": 400 for k in range(5)} | {None: 300}
    texts = [(i, " ".join(["w"] * max(0, int(rng.lognormvariate(3.5, 1)))), s) for s, n in sources.items() for i in rng.sample(range(10**9), n)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    assert (got["taken"] == got["copies"] * got["size"]).all() and got["copies"].between(0, mixing.MOST).all()
    for _, own in got.groupby("source", dropna=False):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 10
    copied = mixing.copy_rows(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    wanted = got[got["size"] > 0].set_index("doc_id")["copies"]
    wanted = wanted[wanted > 0]
    assert copied.reindex(wanted.index).equals(wanted.astype("int64").rename("count")) and set(copied.index) - set(wanted.index) == set(got[got["size"] == 0]["doc_id"])


def test_targets_of_many_sources(spark):
    rng = random.Random(5)
    size = {(f"{k:03d}" if k else None): rng.choice((0, 1, 10, 1000, 10**6)) for k in range(300)}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    wanted, stopped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in stopped)
        wanted = {s: 3 * size[s] if s in stopped else weight[s] * rest / sum(weight[t] for t in names if t not in stopped) for s in names}
        over = {s for s in names if s not in stopped and wanted[s] > 3 * size[s]}
        if not over:
            break
        stopped |= over
    assert all(got[s] == pytest.approx(wanted[s]) for s in names)
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_repeated_rows_ties_and_nothing_to_mix(spark):
    rows = [(1, "one two three", "a")] * 5 + [(None, "x y", "a")] * 3 + [(2, None, "b"), (3, "", None), (4, " \n", "b"), (5, "word", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "copies": F.lit(1), "s": F.lit(2), "draw": F.lit(None).cast("int"), "rate": F.lit("r")})
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and len({r["copies"] for r in got if r["doc_id"] == 1}) == 1 and all(r["taken"] == 0 for r in got if r["size"] == 0)
    copies = mixing.copy_rows(docs)
    assert copies.columns == docs.columns and {r["size"] for r in copies.collect()} == {"clash"} and copies.where("text IS NULL").count() == 1
    nothing = docs.where("text IS NULL OR trim(text) = ''")
    assert mixing.mix(nothing).where("taken <> 0 OR target <> 0").count() == 0 and mixing.copy_rows(nothing).count() == 2
    assert mixing.copy_rows(docs.limit(0)).count() == 0 == mixing.mix(docs.limit(0)).count()
