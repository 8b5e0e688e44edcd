"""Operators 11 to 13 against plain versions, on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaitprint.llm import collocations, manifest, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a long, score double, digest string, rank int, branch string"
CLASH = (9, 0.5, "clash", 3, "clash")


def documents(spark, rows):
    """(doc_id, text, lang, source, n_chars) rows with further columns of names that the operators use themselves."""
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


# ---- phrases


def plain_collocations(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, sizes = {}, Counter()
    for _, text, lang, *_ in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang or "und"] += len(words)
            f.update(tuple(words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        some = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        scored = []
        for p, a in some.items():
            inside = lambda q, p=p: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            if any(100 * n >= 80 * a for q, n in some.items() if inside(q)):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, sizes[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    vocabulary = [*"abcdefg", "É", "naïve", "大", "\x1c", "x\x00y", "İ", "don't", "--"]
    texts = [None, "", " \t ", "...", "A b. c, d", "a b " * 4000, "\n".join(["New York City hall"] * 40), "x" * 5000, "a\rb\x0bc\x0cd e"]
    for _ in range(160):
        words = rng.choices(vocabulary, weights=[9, 8, 7, 3, 3, 2, 2, 2, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 60))
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for w in words).title() if rng.random() < 0.2 else " ".join(words))
    rows = [(i, t, ("en", "de", None, "und")[i % 4], "s", 1) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[6], (None, "a b c a b c", "en", None, None), (3, "of the house", "fr", "s", 1)]


def test_collocations_are_all_word_runs(spark):
    rows = phrase_rows()
    docs = documents(spark, rows)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=5, top=40).collect())
    assert got == plain_collocations(rows, 5, 40) and len(got) > 60
    assert [r[1] for r in got if r[0] == "en"] == list(range(1, sum(r[0] == "en" for r in got) + 1))
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_slices_of_many_languages_wait_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 4000)
    batch = pa.record_batch([pa.array([f"l{i % 50}" for i in range(200)]), pa.array(["a b c d"] * 200)], names=["lang", "text"])
    got = [(lang, len(words.hash)) for lang, words in collocations._by_language(iter([batch] * 5), 0)]
    assert len(got) > 50 and {lang for lang, _ in got} == {f"l{i}" for i in range(50)}
    assert all(sum(n for lang, n in got if lang == f"l{i}") == 5 * 4 * 4 for i in range(50))


def test_texts_of_phrases_reach_python_in_bounded_batches(spark, monkeypatch):
    rows = [(i, "a b c " * 10_000, "en", "s", 1) for i in range(400)]
    docs, setting, most = documents(spark, rows).coalesce(1), "spark.sql.execution.arrow.maxBytesPerBatch", {}
    before, stage = spark.conf.get(setting), collocations.stage_table

    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    def spied(df, name):
        if name in ("words", "stripes-of-one", "longer-stripes"):
            most[name] = docs.select("lang", "text").mapInArrow(told, "n long").agg(F.max("n")).first()[0]
        return stage(df, name)

    monkeypatch.setattr(collocations, "stage_table", spied)
    got = [tuple(r) for r in collocations.collocations(docs, least=5, top=9).collect()]
    assert {p: a for _, _, p, a, *_ in got} == {"a b c a": 400 * 9_999, "b c a b": 400 * 9_999, "c a b c": 400 * 9_999}
    assert set(most) == {"words", "stripes-of-one", "longer-stripes"} and max(most.values()) < 8 << 20 and spark.conf.get(setting) == before



def test_stripes_hold_totals_and_extensions():
    words = collocations.Words(pa.array(["a b a c. a b", None, "a"]), 0)
    assert words.text(np.arange(len(words.hash))).to_pylist() == ["a", "b", "a", "c", "a", "b", "a"]
    assert words.first.tolist() == [True, False, False, False, True, False, True]
    everything = collocations.Seen(np.full(1 << collocations.FILTER_BITS - 6, 0xFFFFFFFFFFFFFFFF, np.uint64))
    named = dict(zip(words.hash.view(np.int64).tolist(), "abacaba", strict=True)) | {0: ""}
    told = lambda batch: {tuple(named[r[p]] for p in ("p1", "p2", "p3")): {named[c["following"]]: c["n"] for c in r["cells"]} for r in batch.to_pylist()}
    assert told(collocations.short_stripes(words, "en", everything)) == {("a", "", ""): {"": 4, "b": 2, "c": 1}, ("b", "", ""): {"": 2, "a": 1}, ("c", "", ""): {"": 1}}
    two, three = map(told, collocations.long_stripes(words, "en", everything))
    assert two == {("a", "b", ""): {"": 2, "a": 1}, ("b", "a", ""): {"": 1, "c": 1}, ("a", "c", ""): {"": 1}}
    assert three == {("a", "b", "a"): {"": 1, "c": 1}, ("b", "a", "c"): {"": 1}}


def test_words_that_share_a_hash_are_hashed_anew(spark, monkeypatch):
    rows = [(i, "red car, blue boat, red car", "en", "s", 1) for i in range(4)]
    counts, seeds = collocations.word_counts, []

    def sharing(docs, seed, least):
        seeds.append(seed)
        found = counts(docs, seed, least)
        assert found.where("shared").count() == 0
        return found.withColumn("shared", F.lit(seed == 0))

    monkeypatch.setattr(collocations, "word_counts", sharing)
    got = sorted(tuple(r) for r in collocations.collocations(documents(spark, rows), least=2, top=9).collect())
    assert seeds == [0, 1] and got == plain_collocations(rows, 2, 9)


def test_large_counts_are_exact(spark):
    a, h, t = 2**62 + 1, 2**62 + 3, 2**63 - 1
    rows = spark.createDataFrame([("en", "p q", a, h, t, None), ("en", "r s", a, h, t, a - 1)], "lang string, phrase string, a long, h1 long, t1 long, longer long")
    got = collocations._scored(rows, 1).collect()
    assert [(r["phrase"], r["score"]) for r in got] == [("p q", 2_000_000 * a // (h + t))]


def test_phrase_joins_pass_nothing_through_the_driver(spark, capsys):
    """Copies for salts are made after a table's size is judged: however small the file, no lookup is a broadcast."""
    rows = collocations.stage_table(spark.range(400).selectExpr("'en' AS lang", "id % 20 AS w1", "id AS w2"), "rows")
    known = collocations.stage_table(spark.range(20).selectExpr("'en' AS lang", "id AS w1", "concat('w', id) AS head"), "known")
    found = collocations._looked_up(rows, known, ["lang", "w1"], "w2")
    assert {(r.w1, r.w2, r.head) for r in found.collect()} == {(i % 20, i, f"w{i % 20}") for i in range(400)} and found.count() == 400
    cells = spark.createDataFrame([("en", 1, 0, 0, 0, 40), ("en", 1, 0, 0, 2, 35)], "lang string, p1 long, p2 long, p3 long, following long, n long")
    for joined in (found, collocations.frequent_stripes(collocations.stage_table(cells, "cells"))):
        capsys.readouterr()
        joined.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


# ---- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(field, (r[0], r[3], r[2], r[4], text)))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def climb(nodes):
        """The root, and of each node what stands beside it on the way up (before, after)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
                paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            nodes = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
            at = [p // 8 for p in at]
        return nodes[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((own, *climb([leaf(r, r[1]) for r in own])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = leaf(r, r[1] if r[1] is None or not tampered else r[1].translate(lower))
            for before, after in [*path, *top]:
                fold = H(before, fold, after)
            out.append((r[0], leaf(r, r[1]), subroot, root, H(*[b + a for b, a in [*path, *top]]), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("langs", [("en",), ("en", None, "de", ""), tuple("abcdefghijkl")])
def test_manifest_is_the_plain_tree(spark, langs):
    rng = random.Random(len(langs))
    rows = [(i * 3 - 40, rng.choice([None, "", "Aa é 大", "all small", "X" * 9000]), langs[min(int(rng.expovariate(0.7)), len(langs) - 1)], rng.choice([None, "s1"]), rng.choice([None, i])) for i in range(75)]
    rows += [rows[4], rows[4], (rows[6][0], "another text of that id", rows[6][2], None, None), (None, "Null id", langs[0], None, None), (None, None, langs[-1], None, None)]
    docs = documents(spark, rows)
    got = sorted((tuple(r) for r in manifest.verified_leaves(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    assert got == plain_manifest(rows) and len({r[-1] for r in got}) == 2
    assert manifest.verified_leaves(docs.limit(0)).collect() == []


def test_one_leaf_and_some_requests(spark):
    row = (6, "One", "en", "s", 3)
    assert [tuple(r) for r in manifest.verified_leaves(documents(spark, [row])).collect()] == [tuple(r) for r in plain_manifest([row])]
    rows = [(i, f"text {i}", ("en", "de")[i % 10 == 0], "s", i) for i in range(150)]
    m = manifest.build(documents(spark, rows))
    some = spark.createDataFrame([("=en", 0), ("=en", 77), ("=de", 14)], "branch string, rank long")
    told = manifest.proofs(m, some).select("doc_id", manifest.proof_digest().alias("p"), (manifest.folded(F.col("digest")) == m.root).alias("good")).collect()
    plain = {r[0]: r[4] for r in plain_manifest(rows)}
    assert {r["doc_id"] for r in told} == {1, 86, 140} and all(r["good"] and r["p"] == plain[r["doc_id"]] for r in told)
    m.drop()


# ---- toxicity


def plain_features(text):
    found = set()
    letters = "".join(c.lower() if c.isalpha() else "\0" for c in text or "")
    padded = "\0" + letters + "\0"
    for order in toxicity.ORDERS:
        for i in range(len(padded) - order + 1):
            run = padded[i : i + order]
            if "\0" in run[1:-1]:
                continue
            h = order * 0x9E3779B1 & 0xFFFFFFFF
            for k, c in enumerate(run):
                h = ((h ^ ord(c) if c != "\0" else h) * 0x01000193 + k) & 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x85EBCA6B & 0xFFFFFFFF
            h ^= h >> 13
            found.add(h >> 32 - toxicity.BUCKET_BITS)
    return found


def toxic_corpus(n=400):
    rng = random.Random(3)
    clean, bad = "river stone garden window letter music paper forest bridge candle".split(), ["Awful", "nastyword", "vile"]
    rows, labels = [], []
    for i in range(n):
        words, y = rng.choices(clean, k=rng.randint(3, 60)), int(rng.random() < 0.2)
        for _ in range(y * rng.randint(1, 3)):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, y if i % 50 else None))
    rows += [(n, None, "en", "s", 1), (n + 1, "", "en", "s", 1), (n + 2, "vile " * 30000, "en", "s", 1), (None, "vile", "en", "s", 1), rows[7]]
    return rows, [*labels, (n + 900, 1), (None, 1), labels[3]]


def test_features_are_distinct_runs_of_padded_words(monkeypatch):
    texts = [None, "", "Ab", "naïve ΑΣ 12 x-yz", "the theme, the THEME", "大家好 hello", "a" * 50]
    monkeypatch.setattr(toxicity, "STEP", 7)  # texts longer than a step
    row, bucket = toxicity.features(pa.array(texts))
    for i, text in enumerate(texts):
        assert set(bucket[row == i].tolist()) == plain_features(text) and (row == i).sum() == len(plain_features(text)), text


def test_scales_and_regression_are_the_plain_ones():
    docs_with, docs = np.array([[0, 8], [40, 5], [1, 0], [30, 0]]), np.array([100, 10])
    for (n0, n1), got in zip(docs_with, toxicity.log_count_ratios(docs_with, docs), strict=True):
        r0, r1 = (n0 + 0.5) / 101, (n1 + 0.5) / 11
        ratio, error = math.log(r1 / r0), math.sqrt((1 - r0) / (n0 + 0.5) + (1 - r1) / (n1 + 0.5))
        assert got == pytest.approx(math.copysign(max(abs(ratio) - 2 * error - 0.4, 0), ratio))
    rng = np.random.default_rng(2)
    x = rng.random((300, 6)) < 0.4
    y = (x[:, 0] + 0.6 * x[:, 3] + 0.5 * rng.random(300) > 0.9).astype(float)
    row, bucket = np.nonzero(x)
    scale = np.zeros(1 << toxicity.BUCKET_BITS)
    scale[:6] = [2, -1, 0.5, 1, -0.2, 1]
    model = toxicity.regression(row, bucket, y, scale)
    dense, w = np.column_stack([x * scale[:6], np.ones(300)]), np.zeros(7)
    ridge = np.diag([toxicity.RIDGE] * 6 + [0])
    for _ in range(60):  # Newton's steps to the same optimum
        p = 1 / (1 + np.exp(-dense @ w))
        w -= np.linalg.solve((dense.T * (p * (1 - p))) @ dense / 300 + ridge, dense.T @ (p - y) / 300 + ridge @ w)
    assert np.allclose(model.weights[:6] * toxicity.UNIT, w[:6] * scale[:6], atol=0.05) and abs(model.bias - w[6]) < 0.05


def test_toxic_texts_are_told_from_others(spark):
    rows, labels = toxic_corpus()
    docs = documents(spark, rows)
    marks = spark.createDataFrame([(i, 0, y, "clash") for i, y in labels], "doc_id long, quality int, toxic int, text string")
    counts, sizes = toxicity.document_counts(toxicity.labelled(docs, marks))
    known = [(text, y) for i, y in labels for r in rows if i is not None and r[0] == i and y is not None and zlib.crc32(str(i).encode()) % 5 for text in [r[1]]]
    plain = Counter((b, y) for text, y in known for b in plain_features(text))
    assert sizes.tolist() == [sum(y == k for _, y in known) for k in (0, 1)]
    assert {(int(b), int(y)): int(counts[b, y]) for b, y in zip(*np.nonzero(counts), strict=True)} == dict(plain)
    model = toxicity.fit(docs, marks)
    told = toxicity.score(docs.withColumn("held_out", toxicity.held_out()), model)
    assert told.columns == [c for c in docs.columns if c != "score"] + ["held_out", "score", "predicted"]
    got = told.select("doc_id", "text", "held_out", "score", "predicted").collect()
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in got)
    truth = lambda t: int(any(w in (t or "") for w in ("Awful", "nastyword", "vile")))
    assert all(r["predicted"] == truth(r["text"]) == int(r["score"] >= 0.5) for r in got)
    by_text = {r["text"]: r["score"] for r in got}
    assert by_text[None] == by_text[""] and 0 <= by_text[None] < 0.5
    again = toxicity.fit(docs, marks)
    assert (again.weights == model.weights).all() and again.bias == model.bias
    assert sorted(r["doc_id"] for r in toxicity.drop_toxic(docs.where("doc_id IS NOT NULL"), model).select("doc_id").collect()) == sorted(r[0] for r in rows if r[0] is not None and not truth(r[1]))
    # One class, no labels, no rows.
    assert toxicity.score(docs, toxicity.fit(docs, marks.where("toxic = 0"))).agg(F.max("score")).first()[0] < 0.1
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).select("score").collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), marks)).count() == 0
