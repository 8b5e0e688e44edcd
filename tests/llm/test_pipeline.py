import random

import corpus_pipeline
from gaitprint.llm import language, near_copies
from gaitprint.llm.queries import queries


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    words = {"en": "the and that with have this from they would there some other words".split(), "de": "der und nicht sich auch werden eine über schon für andere worte".split()}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(30, 60))), k, f"s{i % 3}", 0) for i, k in enumerate(rng.choices(["en", "de"], k=120))]
    rows += [(200 + i, rows[i][1], rows[i][2], "s0", 0) for i in range(10)] + [(300, "### 123", None, "s1", 0), (301, "they have that other words from this and there would " * 2 + "some mail at some.body@mail.example.com please", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at.write.parquet(f"{tmp_path}/{name}.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        left[name] = at.collect()
    assert {r["doc_id"] for r in left["language"]} == {r[0] for r in rows} - {300}
    assert {r["doc_id"] for r in left["near copies"]} == {r[0] for r in rows if r[0] < 120 or r[0] == 301}
    assert [r["text"].endswith("[EMAIL] please") for r in left["personal data"] if r["doc_id"] == 301] == [True]
    assert {r["doc_id"] for r in left["mixing"]} <= {r["doc_id"] for r in left["personal data"]}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["sequence_id"] for r in packed) == list(range(len(packed))) and {r["doc_id"] for r in packed} == {r["doc_id"] for r in left["mixing"]}


def run_stages(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, at, folder)
        assert made.columns == docs.columns
        made.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
    return at, corpus_pipeline.run(spark, folder)


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, node string, text_a string, rate string, copies string, near_nth string, row string, pii_spans string, score string"


def test_nulls_repeats_clashes_and_no_labels(spark, tmp_path):
    odd = ["c"] * 8
    texts = [(1, "one and two and three and four", "s"), (1, "one and two and three and four", "s"), (2, None, "s"), (None, "no id but some words here", None), (None, "no id but some words here", None), (3, "", "t"), (4, "12 !", "t"), (5, "write to a@b.cd now please", None)]
    docs = spark.createDataFrame([(i, t, None, source, None, *odd) for i, t, source in texts], CLASHES)
    left, packed = run_stages(spark, docs, str(tmp_path))
    rows = left.collect()
    # The mix may take any row up to three times, but only those that the stages before kept, as they left them.
    assert {(r["doc_id"], r["text"]) for r in rows} <= {(1, texts[0][1]), (None, texts[3][1]), (5, "write to [EMAIL] now please")} and rows
    assert all(r[c] == "c" for r in rows for c in docs.columns[5:])
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in rows}


def test_empty_table(spark, tmp_path):
    left, packed = run_stages(spark, spark.createDataFrame([], CLASHES), str(tmp_path))
    assert left.count() == 0 and packed.count() == 0


def test_queries_are_registered():
    assert sorted(n.split("_")[0] for n in queries()) == sorted(f"op{k}" for k in range(1, 14))
    assert language.UNKNOWN == "und" and near_copies.THRESHOLD == 80
