"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaitprint.llm import collocations, language, manifest, mixing, near_copies, packing, page_text, personal_data, telephony, token_counts, token_files, toxicity, vector_search
from gaitprint.llm.common import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into power-of-two sequences of at most 2048 ids."""
    return packing.packed_digest(packing.pack(_table(spark, sf_dir, "documents")))


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as mu-law recordings, read back, decoded, resampled and described."""
    return telephony.store_and_describe(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document."""
    return near_copies.near_copies(_table(spark, sf_dir, "documents"), threshold=85)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token-id files and read back."""
    return token_files.read_tokens(token_files.write_tokens(_table(spark, sf_dir, "documents")))


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    return vector_search.nearest(_table(spark, sf_dir, "embeddings"))


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return page_text.extract(_table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact length histogram of all documents with the totals of every context limit."""
    return token_counts.context_totals(token_counts.length_histogram(_table(spark, sf_dir, "documents")))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data.span_digest(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.withColumn("held_out", language.held_out()), language.fit(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to four words of every language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof of every document against the root of a digest tree over all of them."""
    return manifest.verified_leaves(_table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.withColumn("held_out", toxicity.held_out()), model).select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_telephony, op3_mixing, op4_near_copies, op5_token_files, op6_vector_search, op7_page_text, op8_token_counts, op9_personal_data, op10_language, op11_collocations, op12_manifest, op13_toxicity)}


#: op4 by all pairs of shingles: sets, pairs that share a shingle, links, and what links reach.
_NEAR_COPIES = r"""WITH RECURSIVE words AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.other)
SELECT r.doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY 1"""


def _collocations(least: int = 30, top: int = 2000) -> str:
    """op11 by all word runs of all pieces."""
    cuts = []
    for m in (2, 3, 4):
        for k in range(1, m):
            first, rest = (f"array_to_string(w[{a}:{b}], ' ')" for a, b in ((1, k), (k + 1, m)))
            cuts.append(f"SELECT lang, phrase, w, a, {k} AS k, {first} AS head, {rest} AS tail FROM candidates WHERE len(w) = {m}")
    inside = [f"SELECT lang, array_to_string(w[{i}:{i + m - 1}], ' ') AS phrase, a FROM candidates WHERE len(w) = {n}" for n in (3, 4) for m in range(2, n) for i in range(1, n - m + 2)]
    runs = " UNION ALL ".join("SELECT lang, " + " || ' ' || ".join(("w0", "w1", "w2", "w3")[:m]) + f" AS phrase FROM followed WHERE w{m - 1} IS NOT NULL" for m in (1, 2, 3, 4))
    return rf"""WITH pieces AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
 SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) q),
sizes AS (SELECT lang, CAST(sum(len(w)) AS bigint) AS n FROM pieces GROUP BY 1),
places AS (SELECT lang, id, unnest(w) AS w0, unnest(range(len(w))) AS i FROM pieces),
followed AS (SELECT lang, w0, lead(w0) OVER p AS w1, lead(w0, 2) OVER p AS w2, lead(w0, 3) OVER p AS w3 FROM places WINDOW p AS (PARTITION BY lang, id ORDER BY i)),
counts AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, a FROM (SELECT lang, phrase, count(*) AS a FROM ({runs}) q GROUP BY ALL) q WHERE a >= {least}),
candidates AS (SELECT * FROM counts WHERE len(w) >= 2),
longer AS (SELECT lang, phrase, max(a) AS most FROM ({" UNION ALL ".join(inside)}) q GROUP BY ALL),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, CAST(2000000 AS hugeint) * c.a // (x.a + y.a) AS score FROM ({" UNION ALL ".join(cuts)}) c
 JOIN counts x ON x.lang = c.lang AND x.phrase = c.head JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM scored),
kept AS (SELECT s.* FROM lowest s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase WHERE i = 1 AND (o.most IS NULL OR CAST(100 AS hugeint) * o.most < CAST(80 AS hugeint) * s.a)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT p.lang, rank, phrase, a, l, r, n, CAST(score AS bigint) AS score FROM placed p JOIN sizes s ON s.lang = p.lang WHERE rank <= {top}"""


def _manifest(levels: int = 12, top: int = 3) -> str:
    """op12 from the leaves up: node by node, then each leaf's own digest beside its path (8 ** levels leaves of a language, 8 ** top languages at most)."""
    fields = lambda text: "concat(" + ", ".join(f"coalesce(concat(CAST(strlen(CAST({c} AS varchar)) AS varchar), ':', CAST({c} AS varchar)), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 bit by bit: every eighth step takes the next digit in.
    step = "xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(d, CAST(i // 8 AS int) + 1, 1))) ELSE c END) >> 1, CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(d, CAST(i // 8 AS int) + 1, 1))) ELSE c END) % 2 = 1 THEN 3988292384 ELSE 0 END)"
    crc = f"xor(list_reduce(range(0, 8 * CAST(length(d) AS bigint)), lambda c, i: {step}, CAST(4294967295 AS bigint)), 4294967295)"
    parts = [
        f"""WITH raw AS (SELECT doc_id, coalesce(concat('=', lang), '') AS b, sha256({fields('text')}) AS leaf, sha256({fields(lower)}) AS other, coalesce(CAST(doc_id AS varchar), '') AS d FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY b) AS n, CASE WHEN doc_id IS NOT NULL AND ({crc}) % 3 = 0 THEN other ELSE leaf END AS start FROM raw),
n0 AS (SELECT b, r, n, leaf AS h FROM leaves)"""
    ]

    def grow(prefix: str, count: int) -> None:
        for k in range(1, count + 1):
            parts.append(f"{prefix}{k} AS (SELECT b, r // 8 AS r, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY r)) AS h FROM {prefix}{k - 1} WHERE n > 1 GROUP BY b, r // 8, (n + 7) // 8)")

    def climb(name: str, prefix: str, count: int, first: str) -> str:
        """Each path's digest so far and the text of what stood beside it."""
        before = first
        for k in range(count):
            beside = lambda x, k=k: f"coalesce(string_agg(s.h, '' ORDER BY s.r) FILTER (WHERE {x}), '')"
            parts.append(
                f"{name}{k} AS (SELECT p.id, p.b, p.r // 8 AS r, (p.n + 7) // 8 AS n, CASE WHEN p.n > 1 THEN sha256(concat({beside('s.r < p.r')}, p.h, {beside('s.r > p.r')})) ELSE p.h END AS h,"
                f" concat(p.proof, CASE WHEN p.n > 1 THEN {beside('s.r <> p.r')} ELSE '' END) AS proof FROM {before} p LEFT JOIN {prefix}{k} s ON s.b = p.b AND s.r // 8 = p.r // 8 AND p.n > 1 GROUP BY p.id, p.b, p.r, p.n, p.h, p.proof)"
            )
            before = f"{name}{k}"
        return before

    grow("n", levels)
    roots = " UNION ALL ".join(f"SELECT b AS own, h FROM n{k} WHERE n = 1" for k in range(levels + 1))
    parts.append(f"subroots AS ({roots}), t0 AS (SELECT '' AS b, row_number() OVER (ORDER BY own) - 1 AS r, count(*) OVER () AS n, h, own FROM subroots)")
    grow("t", top)
    parts.append("roots AS (" + " UNION ALL ".join(f"SELECT h FROM t{k} WHERE n = 1" for k in range(top + 1)) + ")")
    parts.append("p AS (SELECT row_number() OVER (ORDER BY b, r) AS id, b, r, n, start AS h, '' AS proof FROM leaves), named AS (SELECT row_number() OVER (ORDER BY b, r) AS id, * FROM leaves)")
    last = climb("u", "n", levels, "p")
    parts.append(f"q AS (SELECT x.id, '' AS b, t.r, t.n, x.h, x.proof FROM {last} x JOIN t0 t ON t.own = x.b)")
    last = climb("v", "t", top, "q")
    return f"""{", ".join(parts)}
SELECT doc_id, leaf, s.h AS subroot, g.h AS root, sha256(x.proof) AS proof_sha256, x.h AS folded_root, x.h = g.h AS verified FROM {last} x JOIN named l ON l.id = x.id JOIN subroots s ON s.own = l.b CROSS JOIN roots g"""


def oracle_sql() -> dict[str, str]:
    """SQL of op4, op11 and op12; the others need tokenizers, training, codecs, drawn copies or regular expressions with context."""
    return {"op4_near_copies": _NEAR_COPIES, "op11_collocations": _collocations(), "op12_manifest": _manifest()}
