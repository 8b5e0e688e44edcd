import gzip
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gaitprint.functions import text
from gaitprint.sources import tables


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "cookie_features" in entry.oracle_sql()


def test_readers_and_writers(spark, tmp_path):
    path = tmp_path / "events.csv.gz"
    rows = ["a,2026-04-06 00:00:01,1,item_view,WEB,ua,1,c,l,s,,,10,20", "a,2026/04/06 00:00:02,2,login,,,,,,,,,,"]
    path.write_bytes(gzip.compress("\n".join([",".join(tables.EVENT_COLUMNS), *rows]).encode()))
    got = tables.read_events(spark, str(path)).orderBy("eid").collect()
    assert [r["event_ts"].second for r in got] == [1, 2] and got[0]["item_id"] == 1.0 and got[1]["pointer_x"] is None
    path.write_bytes(gzip.compress("\n".join([",".join(tables.EVENT_COLUMNS), rows[0].replace("00:00:01", "noon")]).encode()))
    with pytest.raises(Exception, match="not a timestamp|noon"):
        tables.read_events(spark, str(path)).collect()
    scores = spark.createDataFrame([("b", 1, 0.1), ("a", 0, 1 / 3)], "cookie_id string, row_ord int, score double")
    tables.write_scores(scores, str(tmp_path / "scores"))
    back = spark.read.csv(str(tmp_path / "scores"), header=True, schema="cookie_id string, score double").collect()
    assert {r["cookie_id"]: r["score"] for r in back} == {"a": 1 / 3, "b": 0.1}


def test_visitor_tables_and_numbers(spark, tmp_path):
    text = tmp_path / "visitors.csv"
    text.write_text("cookie_id,cookie_created_at,window_start_ts,window_end_ts,target\n007,2030-01-01,01.02.2030 10:00:00,02/01/2030 22:30:00,1\n")
    one = tables.read_cookies(spark, str(text), labeled=True).first()
    assert one["cookie_id"] == "007" and one["target"] == 1 and (one["window_end_ts"] - one["window_start_ts"]).total_seconds() == 12.5 * 3600
    with pytest.raises(Exception, match="(?i)column|header|schema"):
        tables.read_cookies(spark, str(text), labeled=False).collect()
    rows = [("1.5",), (" ",), (None,), ("NaN",), ("-2e3",)]
    got = [r["x"] for r in spark.createDataFrame(rows, "x string").select(tables.parse_number("x")).collect()]
    assert got == [1.5, None, None, None, -2000.0]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("12 apples",)], "x string").select(tables.parse_number("x")).collect()
    log = tmp_path / "log.parquet"
    spark.createDataFrame([("a",)], "cookie_id string").write.parquet(str(log))
    with pytest.raises(ValueError, match="event columns"):
        tables.read_events(spark, str(log))


def test_predictions_and_reports(spark, tmp_path):
    long = spark.createDataFrame([("a", 1, "v1", 0.25), ("a", 1, "v2", 0.5), ("b", 0, "v1", 0.125)], "cookie_id string, target int, recipe string, score double").withColumn("window_start_ts", F.expr("timestamp_ntz'2030-01-01 00:00:00'"))
    tables.write_predictions(long, str(tmp_path / "predictions"), ["v1", "v2"])
    back = {r["cookie_id"]: (r["v1"], r["v2"]) for r in spark.read.csv(str(tmp_path / "predictions"), header=True, inferSchema=True).collect()}
    assert back == {"a": (0.25, 0.5), "b": (0.125, None)}
    tables.write_reports(str(tmp_path / "reports"), audit=long.limit(1), importance=long.select("score"))
    assert spark.read.parquet(str(tmp_path / "reports" / "importance")).count() == 3 and spark.read.parquet(str(tmp_path / "reports" / "audit")).count() == 1


def test_queries_do_not_depend_on_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "gaitprint.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = set(entry.queries())
    assert "cookie_features" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names) and set(entry.oracle_sql()) <= names


def test_user_agents(spark):
    df = spark.createDataFrame([("mozilla windows chrome/119",), ("mozilla windows chrome/200",), ("headlesschrome linux",), ("",)], "user_agent string")
    ua = df.user_agent
    got = [tuple(r) for r in df.select(text.family(ua), text.system(ua), text.automated(ua)).collect()]
    assert got[0] == got[1] == ("chrome", "windows", False) and got[2] == ("headless", "linux", True) and got[3] == ("other", "other", False)
