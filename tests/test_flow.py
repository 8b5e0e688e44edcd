"""Files to files, reads that are pruned, one checking pass, and comparison by digests."""

import datetime as dt
import glob
import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from gaitprint.operators import clean, digests, ensemble, pruning
from gaitprint.plans import flow
from gaitprint.sources import staging, tables

START = dt.datetime(2032, 3, 1)
SMALL = {"one": {"families": "base", "maxDepth": 2, "maxIter": 2, "stepSize": 0.3}, "two": {"families": "all", "maxDepth": 2, "maxIter": 2, "stepSize": 0.3}}


def made_log(visitors=24, per=14):
    rng = random.Random(8)
    people, rows = [], []
    for v in range(visitors):
        day = START + dt.timedelta(days=v * 8 // visitors)
        people.append((f"w{v:02}", day - dt.timedelta(hours=9), day, day + dt.timedelta(hours=20), v % 3 == 0))
        for i in range(per):
            name = rng.choice(["item_view", "photo_swipe", "login"]) if v % 3 else "contact_chat_open"
            at = day + dt.timedelta(seconds=rng.randint(-3000, 20 * 3600 + 3000))
            rows.append((f"w{v:02}", at, i, name, "WEB", "Firefox/1", float(i % 4), "c", "l", "s", None, None, float(i), 2.0 * i))
    return people, [*rows, *rows[:5]]


def files(folder, people, rows):
    """Visitors in an order of their own, test ones in two files of several splits; the log gzipped."""
    rng = random.Random(5)
    train, test = [p for p in people if p[2] < START + dt.timedelta(days=5)], [p for p in people if p[2] >= START + dt.timedelta(days=5)]
    rng.shuffle(train), rng.shuffle(test)
    text = lambda p, labeled: ",".join([p[0], *map(str, p[1:4])] + ([str(int(p[4]))] if labeled else []))
    head = "cookie_id,cookie_created_at,window_start_ts,window_end_ts"
    (folder / "train.csv").write_text("\n".join([f"{head},target", *[text(p, True) for p in train]]) + "\n")
    os.mkdir(folder / "test")
    for k, part in enumerate((test[:2], test[2:])):  # the second file is the longer one, so tasks don't come in the files' order
        (folder / "test" / f"part-{k}.csv").write_text("\n".join([head, *[text(p, False) for p in part]]) + "\n")
    lines = [",".join("" if x is None else str(x) for x in r) for r in rows]
    (folder / "events.csv.gz").write_bytes(gzip.compress("\n".join([",".join(tables.EVENT_COLUMNS), *lines]).encode()))
    return [p[0] for p in test]


def test_files_to_files(spark, tmp_path):
    people, rows = made_log()
    order = files(tmp_path, people, rows)
    at = [str(tmp_path / x) for x in ("train.csv", "test", "events.csv.gz", "out")]
    known, entries = set(os.listdir(staging.shared_folder(spark).removeprefix("file://"))), spark.catalog.listTables()
    flow.run(spark, *at, specs=SMALL, recipe=["one", "two"])
    assert set(os.listdir(staging.shared_folder(spark).removeprefix("file://"))) <= known and spark.catalog.listTables() == entries
    written = [line.split(",") for f in sorted(glob.glob(f"{at[3]}/scores/part-*.csv")) for line in open(f).read().splitlines()[1:]]
    assert [w[0] for w in written] == order and all(0 <= float(w[1]) <= 1 for w in written)
    audit = {r["key"]: r["value"] for r in spark.read.parquet(f"{at[3]}/audit").collect()}
    inside = [r for r in rows for p in people if p[0] == r[0] and p[2] <= r[1] < p[3]]
    assert audit["raw_events"] == len(rows) and audit["in_window_events_before_deduplication"] == len(inside) and audit["usable_events"] == len(set(inside)) and audit["missing_search_query"] == len(rows)
    features = spark.read.parquet(f"{at[3]}/features")
    assert features.count() == len(people) and len(features.columns) == 473
    gains = [r["importance"] for r in spark.read.parquet(f"{at[3]}/importance").collect()]
    assert sum(gains) == pytest.approx(1) and set(ensemble.load_models(f"{at[3]}/models", SMALL)) == set(SMALL)
    assert flow.rebuilt_differences(spark, at[1], at[0], at[2], at[3]).collect() == []
    # An unknown visitor in the log, a visitor of both tables, or one who trains after tests begin: nothing is written.
    bad = tmp_path / "bad"
    bad.mkdir()
    files(bad, people, [*rows, ("stranger", *rows[0][1:])])
    with pytest.raises(ValueError, match="unknown_events"):
        flow.run(spark, *[str(bad / x) for x in ("train.csv", "test", "events.csv.gz", "out")], specs=SMALL, recipe=["one", "two"])
    with pytest.raises(ValueError, match="shared_ids|train_ends"):
        flow.run(spark, at[0], str(bad / "train2.csv") if (bad / "train2.csv").write_text("\n".join((tmp_path / "train.csv").read_text().replace(",target", "").splitlines()[:1] + [",".join(x.split(",")[:4]) for x in (tmp_path / "train.csv").read_text().splitlines()[1:]])) else "", at[2], str(bad / "out"), specs=SMALL)
    assert not (bad / "out").exists()


def test_places_follow_files_and_splits(spark, tmp_path):
    names = [f"v{i:05}" for i in range(4000)]
    random.Random(2).shuffle(names)
    line = lambda n: f"{n},2032-03-01,2032-03-01,2032-03-02"
    os.mkdir(tmp_path / "many")
    for k, part in enumerate((names[:500], names[500:3600], names[3600:])):
        (tmp_path / "many" / f"{k}.csv").write_text("\n".join(["cookie_id,cookie_created_at,window_start_ts,window_end_ts", *map(line, part)]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        placed = tables.read_cookies(spark, str(tmp_path / "many"), False, ordered=True)
        got = [r["cookie_id"] for r in placed.orderBy("row_ord").collect()]
        assert got == names and sorted(r["row_ord"] for r in placed.collect()) == list(range(4000))
        assert set(placed.columns) == {"cookie_id", *tables.META_TIMES, "row_ord"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bounds_reach_the_scan(spark, tmp_path):
    people, rows = made_log()
    log = spark.createDataFrame(rows, "cookie_id string, event_ts timestamp_ntz, eid long, event_name string, platform string, user_agent string, item_id double, item_category string, item_location string, seller_type string, search_query string, search_page double, pointer_x double, pointer_y double")
    meta = spark.createDataFrame([p[:4] for p in people], "cookie_id string, cookie_created_at timestamp_ntz, window_start_ts timestamp_ntz, window_end_ts timestamp_ntz")
    tables.write_log(log, str(tmp_path / "log.days"))
    few = meta.where("cookie_id IN ('w00', 'w23')")  # the first and the last day
    some = tables.read_log(spark, str(tmp_path / "log.days"), few)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_ts), GreaterThanOrEqual(event_ts" in plan and "event_day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    days = {r["d"] for r in some.select(F.to_date("event_ts").alias("d")).distinct().collect()}
    assert days <= {(START + dt.timedelta(days=k)).date() for k in (0, 7, 8)} and len(days) >= 2
    key = lambda df: sorted(map(str, clean.in_window(df, few).collect()))
    assert key(some) == key(log) and key(some)
    assert pruning.within_bounds(log, meta.limit(0)).count() == 0
    own = pruning.events_of(log, few)
    assert sorted(map(str, own.collect())) == sorted(map(str, log.where("cookie_id IN ('w00', 'w23')").collect()))
    words = pruning.member_filter(few, ["cookie_id"])
    assert words.count() <= 2 and 0 < pruning.may_be_in(log, ["cookie_id"], words).count() < log.count()
    copies = pruning.exact_copies(log, list(tables.EVENT_COLUMNS)).collect()
    assert len(copies) == 5 and all(r["c"] == 2 for r in copies)


def test_only_what_differs_is_joined(spark):
    rows = [(f"k{i}", float(i), None if i % 3 else 1.0, i, "x") for i in range(400)]
    schema = "cookie_id string, a double, b double, c int, d string"
    old = digests.write_bucketed(spark.createDataFrame(rows, schema), "cookie_id")
    assert digests.changed_cells(old, digests.write_bucketed(spark.createDataFrame(rows[::-1], schema), "cookie_id"), "cookie_id").collect() == []
    changed = [(k, a, 7.0 if k == "k10" else b, c, d) for k, a, b, c, d in rows]
    new = digests.write_bucketed(spark.createDataFrame(changed, schema), "cookie_id")
    buckets, groups = digests.parts_that_differ(digests.digests(old, "cookie_id", group=1), digests.digests(new, "cookie_id", group=1))
    assert len(buckets) == 1 and groups == [1]
    found = digests.changed_cells(old, new, "cookie_id", group=1)
    assert [tuple(r) for r in found.collect()] == [("k10", "b", None, "7.0")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"PartitionFilters: [isnotnull({digests.BUCKET}") == 2 or plan.count(f"({digests.BUCKET}#") >= 2  # one bucket of each is read
    # Null and a value, swapped columns, lost and new keys, and what agrees to six decimals.
    other = [(k, a + 1e-9, b, c, d) for k, a, b, c, d in rows if k != "k5"] + [("new", 1.0, None, 1, "x")]
    got = {tuple(r) for r in digests.changed_cells(old, spark.createDataFrame(other, schema), "cookie_id", decimals=6).collect()}
    assert got == {("k5", None, None, None), ("new", None, None, None)}
    swapped = spark.createDataFrame([(k, b, a, c, d) for k, a, b, c, d in rows[:20]] + rows[20:], schema)
    assert len({r["cookie_id"] for r in digests.changed_cells(old, swapped, "cookie_id").collect()}) == 20
    assert digests.root(digests.digests(old, "cookie_id")).first() != digests.root(digests.digests(new, "cookie_id")).first()


def test_fits_at_once_are_the_fits_alone(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(f"v{i}", rng.random(), rng.random(), i % 2) for i in range(60)], "cookie_id string, x double, v2_y double, target int")
    both = ensemble.fit_models(rows, SMALL)
    trees = lambda model: model.toDebugString.split("\n", 1)[1]  # after the line with the model's own name
    for name, spec in SMALL.items():
        assert trees(both[name]) == trees(ensemble.fit_model(rows, spec))


def test_tables_that_queries_share_follow_their_files(spark, tmp_path):
    from gaitprint.plans import queries

    made = []

    def make():
        made.append(spark.read.parquet(f"{tmp_path}/events.parquet").agg(F.sum("id").alias("total")))
        return made[-1]

    for rows, runs in ((10, 1), (10, 1), (11, 2), (11, 2)):
        if len(made) < runs:
            spark.range(rows).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        assert queries._once(spark, str(tmp_path), "total", make).first()[0] == sum(range(rows)) and len(made) == runs
