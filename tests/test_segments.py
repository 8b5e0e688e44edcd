"""Visitors and keys of any size: chunks against whole windows, running sums and quantiles against plain Python."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitprint.operators import catalogue as C
from gaitprint.operators import clean, prefix, ranking, segments, sequences
from gaitprint.sources import sample_log
from gaitprint.sources.staging import bucketed_table
from plain_features import all_features
from test_features import HOURS, META, OPENS, SCHEMA


def lopsided_rows(heavy=540, light=60):
    """Nine of ten events are one visitor's, many in the same second and some in every column the same."""
    rng = random.Random(17)
    names = [*C.EVENT_TYPES, None, "  "]
    rows = []
    for i in range(heavy + light):
        who = "crawler" if i < heavy else f"v{i % 5}"
        item = rng.choice([None, *map(float, range(6))])
        query = rng.choice([None, "a b", "A  b", "дом 7", "дом", ""])
        second = rng.choice([rng.randint(0, 200), rng.randint(0, HOURS * 3600 - 1)]) if rng.random() < 0.8 else 77
        at = rng.choice([(None, None), (3.0, None), (-0.0, 0.0), (float(rng.randint(0, 5)), float(rng.randint(0, 5)))])
        rows.append((who, OPENS + dt.timedelta(seconds=second), i % 9, rng.choice(names), rng.choice([None, "WEB", "iphone"]), rng.choice([None, "curl/8", "Chrome/1 (Windows)", "Safari iPhone"]), item,
                     rng.choice([None, "x", " Y "]), rng.choice([None, "Riga", "Oslo "]), rng.choice([None, "pro"]), query, rng.choice([None, 1.0, 2.0, 5.0]), *at))
    rows += rows[:40]
    rng.shuffle(rows)
    who = [(c, OPENS - dt.timedelta(hours=5), OPENS, OPENS + dt.timedelta(hours=HOURS)) for c in ("crawler", "v0", "v1", "v2", "v3", "v4", "nobody")]
    return rows, who


def lopsided_log(spark):
    rows, who = lopsided_rows()
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(who, META)


def test_all_features_are_the_plain_ones_and_chunks_give_the_same(spark):
    events, meta = lopsided_log(spark)
    whole = {r["cookie_id"]: r.asDict() for r in segments.log_features(events, meta).collect()}
    rows, who = lopsided_rows()
    for visitor, created, start, end in who:
        plain = all_features([r for r in rows if r[0] == visitor], created, start, end)
        assert set(plain) == set(whole[visitor]) - {"cookie_id"} and len(plain) == 472
        wrong = {n: (whole[visitor][n], v) for n, v in plain.items() if whole[visitor][n] != pytest.approx(v, rel=1e-7, abs=1e-7)}
        assert not wrong, (visitor, wrong)
    cut = {r["cookie_id"]: r.asDict() for r in segments.log_features(events, meta, heavy_rows=50).collect()}
    assert set(whole) == set(cut) and len(cut) == 7 and whole["crawler"]["n_events"] > 400
    for who, row in whole.items():
        for name, value in row.items():
            assert cut[who][name] == pytest.approx(value, abs=1e-9), (who, name)


def test_chunks_are_bounded_and_their_columns_the_same(spark):
    events, meta = lopsided_log(spark)
    chunks = segments.chunked_events(events, meta, rows=50)
    sizes = [r["count"] for r in chunks.groupBy("part").count().collect()]
    assert max(sizes) <= 75 and sum(sizes) > 400
    names = ["rn", "pt", "pn", "pt2", "pn2", "p_cat", "p_ua", "lv", "lc", "ls", "lp", "lx", "dx", "len", "sid_300", "sid_1800", "run", "back", "pv_cadence_all", "pv_pointer_step"]
    cut = segments.sequence_columns(clean.describe_events(chunks)).where("cookie_id = 'crawler'").select(*names).orderBy("rn").collect()
    whole = sequences.sequence_columns(clean.describe_events(clean.clean_events(events, meta))).where("cookie_id = 'crawler'").select(*names).orderBy("rn").collect()
    assert cut == whole and len({r["sid_300"] for r in whole}) > 3


def test_positions_and_running_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"]), rng.randint(0, 5), rng.randint(1, 9)) for _ in range(300)] + [("a", 3, 1)] * 200
    df = spark.createDataFrame(rows, "g string, x int, w int")
    placed = prefix.positions(df, ["g"], [F.desc("x")], "test", parts=6).collect()
    assert len({r["part"] for r in placed}) >= 5
    for g in (None, "a", "b"):
        own = sorted((r for r in placed if r["g"] == g), key=lambda r: r["rn"])
        assert [r["rn"] for r in own] == list(range(1, len(own) + 1)) and [r["x"] for r in own] == sorted((x for k, x, _ in rows if k == g), reverse=True)
    ties = df.groupBy("g", "x").agg(F.sum("w").alias("w"))
    got = {(r["g"], r["x"]): (r["down"], r["whole"]) for r in prefix.running(ties, ["g"], [F.asc("x")], {"down": "w"}, {"whole": "w"}, "test").collect()}
    assert got == {(g, x): (sum(w for k, y, w in rows if k == g and y <= x), sum(w for k, _, w in rows if k == g)) for g, x, _ in rows}
    assert prefix.positions(df.limit(0), ["g"], [F.desc("x")], "test").count() == 0


@pytest.mark.parametrize("spread", [False, True])
def test_quantiles_are_interpolated_from_counts(spark, spread):
    rng = random.Random(9)
    numbers = {("a", "gap"): [rng.choice([0.0, -0.0, 1.5, 7.0, 1e9]) for _ in range(101)], ("a", "cadence_all"): [float(rng.randint(0, 2000)) for _ in range(64)], ("b", "cadence_all"): [5.0], ("b", "gap"): [1.0, 2.0]}
    long = spark.createDataFrame([(c, f, v, None) for (c, f), vs in numbers.items() for v in vs], "cookie_id string, fam string, v double, pv double")
    found = sequences.number_statistics(long, spread=spread)
    for r in found.collect():
        vs = np.array(numbers[r["cookie_id"], r["fam"]])
        for name, q in sequences.QUANTILES.items():
            assert r[name] == pytest.approx(float(np.quantile(vs, q)), rel=1e-12), name
        assert r["n"] == len(vs) and r["mean"] == pytest.approx(vs.mean())
    for r in sequences.rhythm_statistics(long, spread=spread).collect():
        vs = np.array(numbers[r["cookie_id"], r["fam"]])
        m = np.median(vs)
        assert r["mad"] == pytest.approx(float(np.median(np.abs(vs - m)))) and r["near"] == pytest.approx(float((np.abs(vs - m) <= max(0.2 * m, 1)).mean()))
    assert "percentile" not in found._jdf.queryExecution().toString().lower()
    counted = {(r["cookie_id"], r["v"]): r["c"] for r in sequences.frequencies(long).where("fam = 'gap'").collect()}
    assert counted == {("a", v): n for v, n in Counter(numbers["a", "gap"]).items()} | {("b", 1.0): 1, ("b", 2.0): 1}


def test_curve_of_one_key_is_many_tasks(spark):
    rng = random.Random(1)
    rows = [("k", rng.randint(0, 1), rng.randint(0, 400) / 401) for _ in range(3000)] + [(None, 1, 0.5), (None, 0, 0.5)]
    df = spark.createDataFrame(rows, "key string, y int, score double")
    curve = ranking.pr_curve(df, ["key"])
    got = {(r["key"], r["score"]): (r["k"], r["tp"], r["p"], r["total"]) for r in curve.collect()}
    for (key, score), (k, tp, p, total) in got.items():
        own = [(y, s) for g, y, s in rows if g == key]
        assert (k, tp, p, total) == (sum(s >= score for _, s in own), sum(y for y, s in own if s >= score), sum(y for y, _ in own), len(own))
    assert len(got) == len({(g, s) for g, _, s in rows})
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    holds = [line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition(key" in line and "score" in line]
    assert not holds  # windows are of parts, and of one row per part


def test_tasks_hold_a_bounded_number_of_events(spark, monkeypatch):
    """The log's tasks grow with its events, and aren't put together by their bytes."""
    meta, events = sample_log.load(spark, "/root/testdata/sf0.001")
    n = events.count()
    monkeypatch.setattr(clean, "TASK_EVENTS", 100)
    assert clean.clean_events(events, meta).rdd.getNumPartitions() == -(-n // 100)
    monkeypatch.setattr(clean, "TASK_EVENTS", 1 << 30)
    assert clean.tasks_for(spark, n) == int(spark.conf.get("spark.sql.shuffle.partitions")) + 1


def test_counts_of_numbers_are_not_shuffled(spark, capsys):
    """Quantiles are found where counts lie by visitor; parts of the features meet as short rows, by one key and without joins."""
    rows = spark.createDataFrame([("a", "gap", float(v), None) for v in (1, 1, 2, 5)] + [("b", "gap", 3.0, None)], "cookie_id string, fam string, v double, pv double")
    long = bucketed_table(rows, "cookie_id", "few-numbers", 3)
    counts = sequences.frequencies(long)
    found = sequences.quantiles(counts, "v", {"median": 0.5})
    capsys.readouterr()
    found.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert {(r.cookie_id, r.median) for r in found.collect()} == {("a", 1.5), ("b", 3.0)}
    one, two = rows.groupBy("cookie_id").agg(F.count("v").alias("n")), rows.where("v = 3").groupBy("cookie_id").agg(F.max("v").alias("top"), F.min("pv").alias("none"))
    met, places = sequences.side_by_side([one, two])
    both = met.select("cookie_id", *[c.alias(n) for n, c in places.items()])
    assert sorted(map(tuple, both.collect())) == [("a", 4.0, None, None), ("b", 1.0, 3.0, None)]
    capsys.readouterr()
    both.explain()
    assert "Join" not in capsys.readouterr().out


def test_numbers_are_summarised_in_one_pass(spark, capsys):
    """All statistics come from the counts: the numbers are made once and met by nothing."""
    values = {("a", "gap"): [1, 1, 2, 5], ("a", "len"): [0.1] * 3, ("b", "gap"): [-3, -2], ("b", "len"): [-1, 0, 7.5]}
    rows = spark.createDataFrame([(*key, float(v), None) for key, own in values.items() for v in own], "cookie_id string, fam string, v double, pv double")
    found = sequences.number_statistics(bucketed_table(rows, "cookie_id", "few-numbers", 3))
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Exchange" not in plan and plan.count("FileScan") == 1
    told = {(r["cookie_id"], r["fam"]): r for r in found.collect()}
    assert set(told) == set(values)
    for key, own in values.items():
        logs = np.log1p([v for v in own if v >= 0])
        want = {"n": len(own), "mean": np.mean(own), "std": np.std(own), "max": max(own), "median": np.median(own), "q90": np.quantile(own, 0.9)}
        assert all(told[key][n] == pytest.approx(v, abs=1e-12) for n, v in want.items()), key
        assert told[key]["log_std"] == (pytest.approx(np.std(logs), abs=1e-12) if len(logs) else None)
    assert told["a", "len"]["std"] == 0 == told["a", "len"]["log_std"]


def test_written_columns_are_those_that_numbers_read(spark):
    meta, events = sample_log.load(spark, "/root/testdata/sf0.001")
    seq = sequences.sequence_columns(clean.describe_events(clean.clean_events(events, meta, 2)))
    for families in (None, set(C.CADENCES)):
        read = sequences.read_by_numbers(families)
        some = seq.select(*[c for c in seq.columns if c in read])
        assert len(some.columns) < len(seq.columns) - 20 and "user_agent" not in some.columns
        assert sequences.numbers(some, families).columns == ["cookie_id", "fam", "v", "pv"]


def test_empty_log(spark):
    """A log without events gives its visitors' features."""
    meta, events = sample_log.load(spark, "/root/testdata/sf0.001")
    found = segments.log_features(spark.createDataFrame([], events.schema), meta.limit(3), "base").select("n_events", "has_events").collect()
    assert [tuple(r) for r in found] == [(0.0, 0.0)] * 3


def test_short_logs_are_few_tasks(spark):
    """However many partitions shuffles have, a short log is a few tasks per core, and never as many as shuffles have."""
    before, cores = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.defaultParallelism
    try:
        for shuffles in (1, clean.TASKS_PER_CORE * cores + 1, 600):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            for events in (0, 10, clean.TASK_EVENTS * 600):
                tasks = clean.tasks_for(spark, events)
                assert tasks != shuffles and -(-events // clean.TASK_EVENTS) <= tasks <= max(-(-events // clean.TASK_EVENTS), clean.TASKS_PER_CORE * cores + 1) + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_families_are_taken_apart_in_compiled_code(spark):
    """No function of arrays, which Spark interprets for each event, stands between a row and its families."""
    meta, events = sample_log.load(spark, "/root/testdata/sf0.001")
    seq = sequences.sequence_columns(clean.describe_events(clean.clean_events(events, meta, 2)))
    for found in (sequences.value_statistics(seq), sequences.numbers(seq)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "explode" in plan and "lambda" not in plan
