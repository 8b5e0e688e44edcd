"""Each corpus operator against a plain version, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaitprint.llm import language, mixing, near_copies, packing, page_text, personal_data, telephony, token_counts, token_files, tokens, vector_search
from gaitprint.llm.tokens import ColumnEncoder, public_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score int, component_id string"
WORDS = "the quick brown fox jumps over lazy dogs while seven wizards brew potions under pale moonlight near old stone bridges".split()
ODD = [None, "", " ", "\n\n", "a", "it's  'tis\tok\n", "x  y\n\n z ", "<|endoftext|> hi", "é" * 40 + "!!", "1234 5678.90, (a)", "\x1cfoo\x85bar", "ΑΣ. ΑΣ", "a　b ​.", "word " * 3000]


def corpus(spark, extra=()):
    rng = random.Random(5)
    texts = [*ODD, *(" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) + "." for _ in range(40)), *extra]
    rows = [(i, t, ("en", "de", None)[i % 3], (None, "b", "a", "a")[i % 4], None, "clash", 1, "clash") for i, t in enumerate(texts)]
    rows += [rows[20], (None, "no id at all here and more", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(name, text):
    """What the tokenizers library itself makes of a text."""
    return fresh(name).encode(text or "", add_special_tokens=False).ids


@cache
def fresh(name):
    return Tokenizer.from_file(public_path(name))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_column_encoder_is_the_tokenizer(name, monkeypatch):
    rng = random.Random(1)
    special = "<|endoftext|>"
    texts = [*ODD, *("".join(rng.choice("ab É'.,\n\t 12#$") for _ in range(rng.randint(0, 40))) for _ in range(400))]
    texts += [special, f"{special} hi", f"hi there{special}", f"a {special}{special} b\n{special}", special[:-1], special[:-1] + special, "x<|startoftext|>y", "W" * 100 + ".", "Z" * 70]
    coder = ColumnEncoder(public_path(name))
    for _ in range(2):  # new pieces, and pieces known before
        ids, at = coder.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == ids_of(name, t), t
    assert max(len(x) for x in coder.kept.names.to_pylist()) <= tokens.KEPT_LENGTH
    # A worker that has seen too many pieces starts anew.
    monkeypatch.setattr(tokens, "KEPT_PIECES", len(coder.kept.names) + 1)
    ids, at = coder.encode(pa.array(["quite new words, never seen: zqx", "a"]))
    assert ids.tolist() == ids_of(name, "quite new words, never seen: zqx") + ids_of(name, "a") and len(coder.kept.names) < 20
    assert coder.encode(pa.array([], pa.string()))[0].tolist() == []


def test_packing(spark):
    docs, rows = corpus(spark)
    got = packing.pack(docs).collect()
    whole = {}
    for r in got:
        assert r["length"] & (r["length"] - 1) == 0 and 1 <= r["length"] <= 2048 and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"]
        whole.setdefault(r["doc_id"], []).append(r)
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    for doc_id, text, *_ in rows:
        ids = [*ids_of(packing.VOCABULARY, text), 1]
        own = sorted(whole[doc_id], key=lambda r: (r["start"], r["sequence_id"]))[:: 2 if doc_id == 20 else 1]
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == ids and own[0]["doc_tokens"] == len(ids)
    assert packing.pack(empty(spark)).count() == 0
    doc, start, length = packing.binary_pieces(np.array([5000, 1, 0, 2048]))
    assert length.tolist() == [2048, 2048, 512, 256, 128, 8, 1, 2048] and doc.tolist() == [0] * 6 + [1, 3] and start[:7].tolist() == [0, 2048, 4096, 4608, 4864, 4992, 0]


def test_token_files(spark, tmp_path):
    docs, rows = corpus(spark)
    got = token_files.read_tokens(token_files.write_tokens(docs, f"file://{tmp_path}/x", shards=3), with_ids=True).orderBy("start").collect()
    at = 0
    for r, (doc_id, text, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*ids_of(token_files.VOCABULARY, text), 0]
        assert r["doc_id"] == doc_id and r["start"] == at and r["n_tokens"] == len(ids)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.read_tokens(token_files.write_tokens(empty(spark))).count() == 0


def test_token_counts(spark):
    docs, rows = corpus(spark)
    lengths = [len(ids_of(token_counts.VOCABULARY, r[1])) for r in rows]
    totals = token_counts.context_totals(token_counts.length_histogram(docs)).persist()
    for r in totals.collect():
        limit = r["n_tokens"]
        assert r["n_docs"] == lengths.count(limit) and r["docs_over"] == sum(n > limit for n in lengths)
        assert r["truncated_tokens"] == sum(min(n, limit) for n in lengths) and r["tokens_within"] == sum(n for n in lengths if n <= limit) and r["total_tokens"] == sum(lengths)
    for limit in (0, 3, 50, 10_000):
        assert token_counts.truncated_total(totals, limit).first()[0] == sum(min(n, limit) for n in lengths)
    assert token_counts.length_quantile(totals, 0.5).first()[0] == sorted(lengths)[(len(lengths) - 1) // 2]
    assert token_counts.context_totals(token_counts.length_histogram(empty(spark))).count() == 0


def test_telephony(spark, tmp_path):
    docs, rows = corpus(spark)
    got = {(r["doc_id"], r["n_bytes"]): r for r in telephony.store_and_describe(docs).collect()}
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[doc_id, len(raw)]
        assert r["payload_bytes"] == len(full) and r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-32:])
        media = telephony.wav(full, telephony.MULAW)
        assert r["media_sha256"] == hashlib.sha256(media).hexdigest() and r["media_bytes"] == len(media) and r["feature"].startswith("mulaw:")
    assert len({r["feature"] for r in got.values() if r["n_bytes"] == 0}) == 1
    assert telephony.store_and_describe(empty(spark)).count() == 0
    # Known points of both laws, and round trips.
    assert telephony.mulaw_table()[[0xFF, 0x7F, 0x80, 0x00]].tolist() == [0, 0, 32124, -32124]
    assert telephony.alaw_table()[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    wave = (8000 * np.sin(np.arange(3000) / 9)).astype(np.int16)
    back = telephony.decode_adpcm(telephony.encode_adpcm(wave)).ravel()[: len(wave)]
    assert np.sqrt(((back - wave.astype(float)) ** 2).mean()) < 300
    media = spark.createDataFrame([(1, telephony.wav(telephony.encode_adpcm(wave).tobytes(), telephony.ADPCM)), (2, telephony.wav(b"\xff\x80" * 50, telephony.ALAW)), (3, None)], "doc_id long, media binary")
    pcm = {r["doc_id"]: r["pcm"] for r in telephony.resampled(media).collect()}
    odd = [(1, b""), (2, b"RIFF"), (3, telephony.wav(b"\xff" * 8, telephony.MULAW)[:-3]), (4, telephony.wav(b"", telephony.ALAW)[:12]), (5, telephony.wav(b"\0" * 5, telephony.ADPCM)), (6, telephony.wav(b"\0" * 5, telephony.PCM)), (7, telephony.wav(b"ab", telephony.PCM)), (None, None)]
    bad = spark.createDataFrame([*odd, odd[0]], "doc_id long, media binary")
    telephony.store_resampled(bad, f"file://{tmp_path}/pcm")
    kept = {r["doc_id"]: (r["pcm"], r["error"]) for r in spark.read.parquet(f"file://{tmp_path}/pcm").collect()}
    assert len(kept) == 8 and all(kept[k][0] is None and kept[k][1] for k in range(1, 7)) and kept[7][0] and kept[7][1] is None and kept[None] == (None, None)
    samples, rate = telephony.to_pcm(pcm[1])
    assert rate == 16_000 and pcm[3] is None and np.array_equal(samples[0::2][:100], back[:100])
    assert np.abs(samples[1:2000:2].astype(float) - 8000 * np.sin((np.arange(1000) + 0.5) / 9))[20:].max() < 500


def plain_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def family(rng, n, words, changes):
    base = rng.choices([f"w{i}" for i in range(5000)], k=words)
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_copies(spark, monkeypatch, threshold):
    monkeypatch.setattr(near_copies, "SMALL", 6)  # so that blocks are used as well
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng = random.Random(2)
    extra = [*family(rng, 60, 200, 8), *family(rng, 30, 60, 1), *family(rng, 5, 200, 2), "A b c", "a B  c", "one two three four five", "One two three four FIVE"]
    docs, rows = corpus(spark, extra)
    sets = [plain_sets(r[1]) for r in rows]
    known = [i for i, r in enumerate(rows) if r[0] is not None]
    parent = {rows[i][0]: rows[i][0] for i in known}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in known:
        for b in known:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    got = near_copies.near_copies(docs, threshold).collect()
    assert len(got) == len(rows)
    wanted = sorted((rows[i][0], len(sets[i]), root(rows[i][0]), rows[i][0] == root(rows[i][0])) for i in known)
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == wanted
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    left = near_copies.drop_near_copies(docs, threshold)
    assert left.columns == docs.columns and left.count() == len({root(rows[i][0]) for i in known}) + 1
    assert near_copies.near_copies(empty(spark)).count() == 0


@pytest.mark.parametrize(("minor", "most"), [(10, 20_500), (10_000, 620_000)])
def test_a_large_bucket_meets_its_largest_component_once(spark, minor, most):
    n = 20_000
    nodes = spark.range(n).selectExpr("id AS node", *(f"xxhash64(id, {k}) AS s{k}" for k in range(8)))
    members = spark.range(n).selectExpr("1L AS key", f"{n}L AS n", "id AS node", "100L AS n_shingles", f"CASE WHEN id < {minor} THEN id ELSE {minor} END AS component", f"{minor}L AS bulk", f"{n - minor}L AS bulk_n")
    placed = near_copies._placed(members, nodes).persist()
    assert placed.count() <= most and placed.groupBy("key", "i", "j").count().agg(F.max("count")).first()[0] < 3 * near_copies.BLOCK
    # Every node outside meets every node, and none of them twice.
    few = placed.where("node < 2").select("i", "j", F.col("own").alias("mine"), F.col("node").alias("a")).join(placed, ["i", "j"]).where("i = j OR mine <> own")
    assert few.groupBy("a").agg(F.count_distinct("node").alias("d"), F.count("node").alias("c")).where(f"d <> {n} OR c <> {n}").count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_copies.components(links).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100


def test_personal_data(spark):
    texts = ["mail a.b@c.de, b@c", "ip 10.0.0.255 and 1.2.3.256", "card 4111 1111 1111 1111 or 4111 1111 1111 1112", "call +1 (743) 555-3824 now", "iban GB82 WEST 1234 5698 7654 32 x", "bad GB83 WEST 1234 5698 7654 32", "ssn 123-45-6789", "part 123-45-6789", "😀 é x@y.z", "a@b.c_d@e.f", None, ""]
    docs = spark.createDataFrame([(i, t, "keep", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, pii_spans string, n_chars long")
    got = [r["spans"] for r in personal_data.span_digest(docs).orderBy("doc_id").collect()]
    assert got == ["email:5:13", "ip:3:13", "card:5:24", "phone:5:22", "iban:5:32", "", "ssn:4:15", "", "email:4:9", "email:0:5,email:5:11", "", ""]
    masked = personal_data.mask(docs.drop("pii_spans")).orderBy("doc_id").collect()
    assert masked[0]["text"] == "mail [EMAIL], b@c" and masked[0]["n_chars"] == len(masked[0]["text"]) and masked[9]["text"] == "[EMAIL][EMAIL]" and masked[10]["text"] is None
    odd = personal_data.mask(docs.withColumn("a.b", F.lit(7)).withColumn("n_chars", F.col("n_chars").cast("int")))
    assert odd.columns == [*docs.columns, "a.b"] and {r["pii_spans"] for r in odd.collect()} == {"keep"} and odd.schema["n_chars"].dataType.simpleString() == "int"
    long = spark.createDataFrame([(1, "a@b.c " * 3000 + "1 " * 20_000)], "doc_id long, text string")
    row = personal_data.span_digest(long).first()
    assert row["n_email"] == 3000 and row["n_card"] == 0 and row["spans"].endswith("email:17994:17999")
    assert personal_data.span_digest(empty(spark)).count() == 0


def test_ibans_before_capitals_and_digits(spark):
    texts = ["DE89370400440532013000 Please pay", "GB82 WEST 1234 5698 7654 32 Bank of", "GB82WEST12345698765432 12 May", "GB82WEST12345698765432 EUR 500.", "NO93 8601 1117 947 NO", "FR14 2004 1010 0505 0001 3M02 606 I", "GB82WEST12345698765432X", "AB12 3456 7890 1234 GB82WEST12345698765432 A"]
    texts += ["MT84 MALT 0110 0001 2345 MTLC AST0 01S. A", "DE89370400440532013000 GB82WEST12345698765432"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["spans"] for r in personal_data.span_digest(docs).orderBy("doc_id").collect()]
    assert got[:8] == ["iban:0:22", "iban:0:27", "iban:0:22", "iban:0:22", "iban:0:18", "iban:0:33", "", "iban:20:42"]
    assert got[8] == "iban:0:38" and got[9] == "iban:0:22,iban:23:45"
    # Codes of no known country are still proposed.
    at = int("370400440532013000" + "3333" + "00")
    other = f"XX{98 - at % 97:02d}370400440532013000"
    one = spark.createDataFrame([(1, f"{other} x"), (2, f"{texts[1]} ")], "doc_id long, text string")
    assert [r["spans"] for r in personal_data.span_digest(one).orderBy("doc_id").collect()] == ["iban:0:22", "iban:0:27"]
    assert [r["text"] for r in personal_data.mask(docs).orderBy("doc_id").limit(2).collect()] == ["[IBAN] Please pay", "[IBAN] Bank of"]


def test_mixing(spark):
    docs, rows = corpus(spark, ["many " * 4000] * 3)
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    stopped = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in stopped)
        want = {s: 3 * size[s] if s in stopped else weight[s] * rest / sum(weight[t] for t in names if t not in stopped) for s in names}
        over = {s for s in names if s not in stopped and want[s] > 3 * size[s]}
        if not over:
            break
        stopped |= over
    for s in names:
        own = got[got["source"].isna() if s is None else got["source"] == s]
        assert own["target"].iloc[0] == pytest.approx(want[s]) and own["source_size"].iloc[0] == size[s]
        assert abs(own["taken"].sum() - want[s]) <= max(2, own["size"].max() / 2)  # whole copies can't come nearer for sure
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["source", "size", "doc_id", "taken"]
    assert again[key].sort_values(key).reset_index(drop=True).equals(got[key].sort_values(key).reset_index(drop=True))
    copies = mixing.copy_rows(docs)
    assert copies.columns == docs.columns and copies.where("source = 'a'").count() > 0
    assert mixing.mix(empty(spark)).count() == 0


def test_vector_search(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 24)).astype(np.float32)
    x[300:500] = x[300]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5050, [0.0] * 24, 0), (5100, [float("nan")] * 24, 0), (5150, [1.0] * 23, 0), (None, x[0].tolist(), 0), rows[7], rows[100]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = vector_search.nearest(table, every=50).toPandas()
    d = x.astype(np.float64)
    n = np.sqrt((d * d).sum(1))
    hits = 0
    for q in range(0, 900, 50):
        s = (d[q] * d).sum(axis=1) / (n[q] * n)
        s[q] = -9
        best = np.lexsort((np.arange(900), -s))[:5]
        own = got[got["query_id"] == q].sort_values("rank")
        assert len(own) == 5 and own["vec_id"].is_unique and own["score"].tolist() == s[own["vec_id"]].tolist()
        hits += len(set(best) & set(own["vec_id"]))
    assert hits / (18 * 5) >= 0.9 and set(got["query_id"]) == set(range(0, 900, 50))
    wide = vector_search.nearest(table.select("vec_id", F.transform("embedding", lambda e: e.cast("double") + 1e-12).alias("embedding")), every=300).where("query_id = 300").first()
    d = d + 1e-12
    assert wide["score"] == (d[300] * d[wide["vec_id"]]).sum() / (np.sqrt((d[300] * d[300]).sum()) * np.sqrt((d[wide["vec_id"]] * d[wide["vec_id"]]).sum()))
    # Ties go to the smaller id, and components may be of any size.
    made = [(0, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [5.0, 0.0]), (9, [0.0, -1.0]), (50, [1e200, 1e200]), (51, [1e200, 2e200]), (52, [1e-200, 1e-200]), (53, [-3e-310, 3e-310]), (54, [1.0, 1.0])]
    sized = vector_search.nearest(spark.createDataFrame(made, "vec_id long, embedding array<double>"), every=50).collect()
    asked = lambda q: [(r["vec_id"], round(r["score"], 12)) for r in sorted(sized, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert asked(0)[:2] == [(3, 1.0), (7, 1.0)] and [v for v, _ in asked(50)] == [52, 54, 51, 0, 3] and asked(50)[2][1] == round(3 / 10**0.5, 12)
    few = vector_search.nearest(table.where("vec_id < 3"), every=50)
    assert few.count() == 2 and vector_search.nearest(table.limit(0)).count() == 0


PAGE = '<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li>Home</li></ul></nav><!-- x --><div class="ad">Buy</div>%s<div id="comments"><p>first!</p></div><footer>&copy; me</footer></body></html>'


def test_page_text(spark):
    main = "<article><h1>A &amp; B</h1><p><b>One.<br>two<p>Three\n  &lt;4&gt;</p><aside>no</aside><form>no</form></article>"
    bare = '<div class="skin"><div class="box">Same words here</div><div class="body"><p>Own text number %s goes here and on and on.</p></div></div>'
    letters = "abcdefgh"
    pages = [(1, "http://x.y/1", PAGE % main), (2, None, None), (3, "http://x.y/2", ""), (4, "bad url", "plain <b>text</b>"), (5, "http://q.z/", "<p>open <!-- never closed")]
    pages += [(10 + i, f"http://host.example/{i}", PAGE % (bare % (c * 3))) for i, c in enumerate(letters)]
    got = {r["page_id"]: r for r in page_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A & B\n\nOne. two\n\nThree <4>" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "plain text" and got[5]["text"] == "open"
    # Hosts whose templates begin alike keep their own: both boilerplate texts go.
    twins = [(100 * h + i, f"http://h{h}.example/{i}", PAGE % (bare % (c * 3)).replace("Same words here", f"Words of host {chr(97 + h)} only")) for h in range(12) for i, c in enumerate(letters)]
    own = page_text.extract(spark.createDataFrame(twins, "page_id long, url string, html string")).collect()
    assert len(own) == len(twins) and all(r["text"] == f"Own text number {letters[r['page_id'] % 100] * 3} goes here and on and on." for r in own)
    for i, c in enumerate(letters):
        assert got[10 + i]["text"] == f"Own text number {c * 3} goes here and on and on."
    assert page_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts_of(spark, pages):
    return {r["page_id"]: r["text"] for r in page_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_page_template_within_articles(spark):
    article = "<article><h1>On %s</h1><p>You read this for free, tell others.</p><p>Own text of %s here.</p><p>%d</p></article>"
    pages = [(i, f"http://h.example/{i}", PAGE % (article % (c, c, 7 * i))) for i, c in enumerate("abcdefgh")]
    # A teaser in an article element isn't taken for a page whose text lies elsewhere.
    pages.append((50, "http://other.example/", "<body><article>Teaser.</article><div><p>" + "Much more text. " * 20 + "</p></div></body>"))
    got = texts_of(spark, pages)
    assert all(got[i] == f"On {c}\n\nOwn text of {c} here.\n\n{7 * i}" for i, c in enumerate("abcdefgh"))
    assert got[50].startswith("Teaser.\n\nMuch more text.")


def test_page_keeps_small_parts(spark):
    parts = "<blockquote>Quoted.</blockquote><ul><li>One</li><li>Two</li></ul><pre>x = 1</pre><table><tr><td>Cell</td></tr></table><section><p>Short section.</p></section>"
    small = "Quoted.\n\nOne\n\nTwo\n\nx = 1\n\nCell\n\nShort section."
    long = "Main paragraph. " * 60
    pages = [
        (1, "http://x.y/1", f"<body><nav>Go</nav><div class='w'><div><p>{long}</p>{parts}</div></div></body>"),
        (2, "http://x.y/2", f"<body><h2>Head</h2><p>{long}</p>{parts}</body>"),
        (3, "http://x.y/3", f"<body><div><p>{long}</p></div><section><p>Aside of the page</p></section></body>"),
    ]
    got = texts_of(spark, pages)
    assert got[1] == f"{long.strip()}\n\n{small}" and got[2] == f"Head\n\n{long.strip()}\n\n{small}" and got[3] == long.strip()


def test_page_template_of_copies(spark):
    bare = "<div><p>First part of %s.</p><p>Second part of %s.</p><p>Last part of %s.</p></div>"
    copies = [(i, f"http://h.example/{i}", PAGE % (bare % (("it",) * 3))) for i in range(9)]
    others = [(20 + i, f"http://h.example/o{i}", PAGE % (bare % ((c,) * 3))) for i, c in enumerate("abcd")]
    repeated = [(40, "http://r.example/", PAGE % (bare % (("one",) * 3)))] * 4
    # A copy in other surroundings is a copy, and an empty page has no tokens.
    copies[3] = (3, "http://h.example/3", copies[3][2].replace("Home", "Start"))
    got = texts_of(spark, [*copies, *others, *repeated, (50, "http://h.example/e", "")])
    text = lambda c: f"First part of {c}.\n\nSecond part of {c}.\n\nLast part of {c}."
    assert all(got[i] == text("it") for i in range(9)) and all(got[20 + i] == text(c) for i, c in enumerate("abcd")) and got[40] == text("one")
    articles = [(i, u, h.replace("<div><p>", "<article><p>").replace("</p></div>", "</p></article>")) for i, u, h in copies]
    assert all(x == text("it") for x in texts_of(spark, articles).values())


def plain_signal(name, x):
    """A signal's digest, one sample at a time."""
    turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    return f"{name}:{len(x)}:{(sum(v * v for v in x) / len(x)) ** 0.5:.3f}:{max(map(abs, x))}:{turns}:{zlib.crc32(b''.join(v.to_bytes(2, 'little', signed=True) for v in x)):08x}"


def plain_telephony(payload):
    """What the three decoders make of 8-bit samples, from the formats' definitions."""
    mulaw, alaw, adpcm = [], [], []
    for b in payload:
        c = 255 - b
        size = 4 * (((2 * (c % 16) + 33) << (c // 16 % 8)) - 33)
        mulaw.append(-size if c >= 128 else size)
        c = b ^ 0x55
        segment, m = c // 16 % 8, c % 16
        size = 8 * (2 * m + 1 if segment == 0 else (2 * m + 33) << (segment - 1))
        alaw.append(size if c >= 128 else -size)
    double = []
    for i, v in enumerate(mulaw):
        near = [mulaw[j] if 0 <= j < len(mulaw) else 0 for j in range(i - 3, i + 5)]
        between = sum(int(h) * n for h, n in zip(telephony.HALF_BAND, near, strict=True))
        double += [v, max(-32768, min(32767, (between + 16384) // 32768))]
    steps, moves = [int(s) for s in telephony.step_sizes()], [-1, -1, -1, -1, 2, 4, 6, 8]
    for at in range(0, len(payload), 192):
        block = payload[at : at + 192]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        adpcm.append(value)
        for byte in block[4:]:
            for code in (byte % 16, byte // 16):
                step = steps[index]
                diff = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + moves[code & 7]))
                adpcm.append(value)
    return "|".join([plain_signal("mulaw", double), plain_signal("alaw", alaw), plain_signal("adpcm", adpcm)])


def test_telephony_features_by_plain_decoders(spark):
    rng = random.Random(8)
    texts = ["", "Grüße, 日本 \x00\x7f", "a", "x" * 576, "y" * 577, "".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(0x80, 0x800), rng.randrange(0x10000, 0x10400)])) for _ in range(900))]
    docs = spark.createDataFrame([*enumerate(texts), (90, None), (5, texts[5])], "doc_id long, text string")
    got = telephony.store_and_describe(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        raw = b"" if r["doc_id"] == 90 else texts[r["doc_id"]].encode()
        assert r["feature"] == plain_telephony(raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))), r["doc_id"]


def test_language(spark):
    rng = random.Random(4)
    words = {"en": "the and that with have this from they would there".split(), "de": "der und nicht sich auch werden eine über schon für".split()}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(4, 40))), k, "x", 1) for i, k in enumerate(rng.choices(["en", "de"], k=400))]
    rows += [(1000, None, "en", "x", 1), (1001, "", None, "x", 1), (1002, "123 !!", "de", "x", 1), (None, "the and that", None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred int")
    got = language.identify(docs.withColumn("held_out", language.held_out()), language.fit(docs)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["lang"] and r["doc_id"] < 1000]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 for r in got) and {r["lang_pred"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {"und"}
    kept = language.keep_identified(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString() and {(r["score"], r["lang_pred"]) for r in kept.collect()} == {("x", 1)}
    long = spark.createDataFrame([(k, " ".join(words[lang] * 3000), lang) for k, lang in enumerate(["en", "de"] * 12)], "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == r["lang"] for r in language.identify(long).collect())
    assert kept.where("doc_id < 400").count() >= 398 and kept.where("doc_id >= 1000").count() == 0
    assert language.identify(docs.limit(0)).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_language_draws_the_lowest_hashes_in_slices(spark):
    rng = random.Random(3)
    rows = [("big", rng.randrange(-(2**63), 2**63)) for _ in range(9000)] + [("small", rng.randrange(-(2**63), 2**63)) for _ in range(700)] + [("one", 5)]
    drawn = spark.createDataFrame(rows, "lang string, draw long")
    for each in (1, 800, 1024, 4096):
        got = language.lowest_hashes(drawn, each)
        wanted = {(k, d) for k in ("big", "small", "one") for d in sorted(d for j, d in rows if j == k)[:each]}
        kept = [(r["lang"], r["draw"]) for r in got.collect()]
        assert len(kept) == len(wanted) and set(kept) == wanted, each
        # The cut comes before the shuffle by slice, so that a language's hashes never meet in one task.
        assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString(), each
    assert language.lowest_hashes(drawn.limit(0), 4).count() == 0


def plainly_scored(model, text):
    """A text's mean score per language, one run of letters at a time."""
    letters = [ord(c) if c.isalpha() else 0 for c in f"\n{text.lower()}\n"]
    total, n = [0] * len(model.languages), 0
    for order in language.ORDERS:
        for at in range(len(letters) - order + 1):
            run = letters[at : at + order]
            if not all(run[1:-1]) or (order == 2 and not any(run)):
                continue
            h = order * 0x9E3779B1 & 0xFFFFFFFF
            for k, c in enumerate(run):
                h = ((h ^ c) * 0x01000193 + k) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - language.BUCKET_BITS)
            n += 1
            total = [t + int(w[h]) for t, w in zip(total, model.weights, strict=True)]
    return [t * language.UNIT / max(n, 1) + b for t, b in zip(total, model.bias, strict=True)], n


def test_language_scores_are_plain_means_in_every_batch(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdeéñß 1.") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    model = language.train([t for t in texts], [("x", "y", "z")[i % 3] for i in range(60)])
    z, counts = model.logits(pa.array([*texts, "", "12"]))
    for i, t in enumerate([*texts, "", "12"]):
        wanted, n = plainly_scored(model, t)
        assert counts[i] == n and np.array_equal(z[i], np.array(wanted)), t
    for part in (texts[:1], texts[20:37], ["w" * 100 + " " + texts[0]] * 3 + texts[20:37]):
        again, _ = model.logits(pa.array(part))
        for row, t in zip(again, part, strict=True):
            assert np.array_equal(row, np.array(plainly_scored(model, t)[0]))


def test_language_without_labels_keeps_what_has_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (3, "12 !", None), (None, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r["text"] for r in language.keep_identified(docs).collect()) == ["some words", "é"]
    assert language.keep_identified(docs.limit(0)).count() == 0


def test_language_learns_every_label_and_copies_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, labels, seed: seen.append(list(zip(labels, texts, strict=True))))
    rows = [(4 * i, f"text {i} of {k}", f"l{k:03d}") for i, k in enumerate(list(range(150)) * 2)]
    rows += [(i, f"copied {i % 3}", "copied") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~language.held_out())
    language.fit(docs, max_rows=604)
    wanted = {(r["lang"], r["text"]) for r in docs.collect()}
    assert len(seen[0]) == len(set(seen[0])) and set(seen[0]) == wanted
    language.fit(docs, max_rows=10)
    assert sorted(k for k, _ in seen[1]) == sorted({k for k, _ in wanted})


def test_near_copies_of_a_doc_id_of_several_texts(spark):
    rng = random.Random(31)
    a, b = (" ".join(rng.choices(WORDS, k=200)) for _ in range(2))
    rows = [(5, a), (5, b), (9, a + " old"), (10, b + " old"), (11, "something else entirely is written here")]
    for order in (rows, rows[::-1]):
        got = {(r["doc_id"], r["component_id"]) for r in near_copies.near_copies(spark.createDataFrame(order, "doc_id long, text string")).collect()}
        assert got == {(5, 5), (9, 5), (10, 5), (11, 11)}
    # In a large bucket too: a node's other set is none of the bucket's.
    bands = [[1, 2], [3, 4], [1, 2]]
    group = dict(key=1, i=0, j=0, own=0, n_shingles=196, **{w: 0 for w in near_copies._words()})
    import pandas as pd

    frame = pd.DataFrame([{**group, "node": n, "component": c, "bands": np.array(x), "text": t} for n, c, x, t in zip((5, 5, 9), (5, 5, 9), bands, (a, b, a + " old"), strict=True)])
    assert near_copies._links_within(frame, 80).to_dict("records") == [{"a": 5, "b": 9}]


def test_token_files_in_a_store_without_a_mount(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "_local", lambda folder: None)
    folder = f"file://{tmp_path}/store"
    out = token_files.ShardWriter(folder, 3, 2)
    out.add(pa.array([7, None], pa.int64()), np.array([1, 2, 0, 9, 0], np.uint32), np.array([3, 2]))
    out.add(pa.array([8], pa.int64()), np.array([0], np.uint32), np.array([1]))
    assert not (tmp_path / "store").exists() or not list((tmp_path / "store").glob("0*"))  # nothing has its name before the shard is whole
    assert out.close() == (3, 6)
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == ["000003.bin", "000003.doc", "000003.idx"]
    assert token_files._map(folder, "000003.bin", "<u2").tolist() == [1, 2, 0, 9, 0, 0] and token_files._map(folder, "000003.idx", "<i8").tolist() == [0, 3, 5, 6]
    docs = token_files._map(folder, "000003.doc", token_files._DOC)
    assert docs["doc_id"].tolist() == [7, 0, 8] and docs["is_null"].tolist() == [0, 1, 0]
