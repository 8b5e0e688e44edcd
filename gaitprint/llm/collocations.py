"""Phrase collocation mining (operator 11) by stripes.

A stripe belongs to a prefix of one to three words and counts the words that follow it; cell 0 holds how
often the prefix itself occurs.  Tasks build stripes of their texts; Spark merges them elementwise, cell by
cell, so that the stripe of a very common prefix is merged by many tasks.  Extensions, prefix totals and the
largest count of a longer phrase around a shorter one all come from the merged stripes.

A phrase is frequent only if all its parts are, so prefixes are grown: words are counted first, then stripes of
one word over frequent words, then stripes of two and three words over frequent pairs.  What may be frequent
is looked up in a filter of fixed size (:class:`Seen`), which never misses and whose mistakes the counts
remove.  Words travel as 64-bit hashes; if two words of a language share one, all is hashed anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitprint.llm.common import bounded_batches, drop_tables, mix64, slices, stage_table

MIN_COUNT, TOP = 30, 2000
#: A cut's score is SCALE times the phrase's count over the sum of its parts' counts.
SCALE = 2_000_000
#: A phrase goes if a longer candidate around it has so many hundredths of its count.
SUBSUMED = 80
UNKNOWN = "und"
#: Bits of a filter (8 MB, whatever the input).
FILTER_BITS = 26
#: Parts of a stripe, by the next word, so that none is kept as one row however many words follow; and copies of rows that many others look up.
PARTS, SALTS = 64, 16
#: Text of a language whose stripes a task builds at a time (in long stripes, neighbours share their prefix, and shuffles pack them better), and text of all languages that waits for that.
SLICE, HELD = 2 << 20, 8 << 20
#: Bytes whose words are hashed at a time.
STEP = 1 << 20
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _BREAKS.copy()
_GAPS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PREFIX = ["p1", "p2", "p3"]


@cache
def _hash_constants(seed: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    rng = np.random.default_rng([20240311, seed])
    base = int(rng.integers(1, 1 << 62, dtype=np.uint64)) * 4 + 1
    return rng.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False), np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    if seed not in _POWERS or len(_POWERS[seed][0]) < n:
        made = []
        for base in _hash_constants(seed)[1:]:
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _POWERS[seed] = tuple(made)
    return _POWERS[seed]


class Words:
    """The words of a column of texts, one after the other: hash, whether a piece begins there, and their bytes."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, seed: int):
        raw = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
        self.data = data = _LOWER[np.frombuffer(b"\n".join([b"", *raw, b""]), dtype=np.uint8)]
        gap = _GAPS[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.starts, self.ends = starts, ends = edge[0::2], edge[1::2]
        breaks = np.flatnonzero(_BREAKS[data])
        piece = np.searchsorted(breaks, starts)
        self.first = np.diff(piece, prepend=-1) > 0
        self.hash = np.zeros(len(starts), np.uint64)
        of_byte = _hash_constants(seed)[0]
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP, side="right")))
            lo, hi = int(starts[at]), int(ends[to - 1])
            power, inverse = _powers(max(hi - lo, STEP), seed)
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(of_byte[data[lo:hi]] * power[: hi - lo], out=sums[1:])
            a, b = starts[at:to] - lo, ends[at:to] - lo
            self.hash[at:to] = mix64((sums[b] - sums[a]) * inverse[a])
            at = to
        self.hash[self.hash == 0] = 1

    def text(self, at: np.ndarray) -> pa.Array:
        """The words at these places as strings."""
        lengths = self.ends[at] - self.starts[at]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        byte = np.repeat(self.starts[at] - offsets[:-1], lengths) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[byte].tobytes())).cast(pa.string())


def _by_language(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str, Words]]:
    """Slices of (lang, text) rows, one language at a time; texts wait until their language has a slice, or all of them HELD bytes."""
    waiting: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}

    def taken(name: str) -> Iterator[tuple[str, Words]]:
        del sizes[name]
        words = Words(pa.chunked_array(waiting.pop(name)), seed)
        if len(words.hash):
            yield name, words

    for batch in slices(batches, "text", SLICE):
        lang = batch.column(0)
        for name in pc.unique(lang).to_pylist():
            texts = batch.column(1).filter(pc.equal(lang, name))
            waiting.setdefault(name, []).append(texts)
            # A row counts as some bytes, so that empty texts don't wait without end.
            sizes[name] = sizes.get(name, 0) + texts.nbytes
            if sizes[name] >= SLICE:
                yield from taken(name)
        while sum(sizes.values()) >= HELD:
            yield from taken(max(sizes, key=sizes.get))
    for name in list(waiting):
        yield from taken(name)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each first occurs, and how often."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), ranked[1:] != ranked[:-1]]))
    return ranked[first], order[first], np.diff(np.append(first, len(keys)))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and each key's place among them."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.concatenate([np.zeros(min(1, len(keys)), bool), ranked[1:] != ranked[:-1]])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new)
    return ranked[np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), ranked[1:] != ranked[:-1]]))], place


class Seen:
    """A filter of fixed size: for (language, word, next word or 0) that were put in it always true, for others seldom."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(lang: str, word: np.ndarray, following: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        key = mix64(word ^ np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        if following is not None:
            key = mix64(key + mix64(following))
        return key >> np.uint64(64 - FILTER_BITS), key & np.uint64((1 << FILTER_BITS) - 1)

    def has(self, lang: str, word: np.ndarray, following: np.ndarray | None = None) -> np.ndarray:
        out = np.ones(len(word), bool)
        for place in self.places(lang, word, following):
            out &= (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
        return out


def filter_of(rows: DataFrame) -> Seen:
    """The filter of ``rows`` (lang, word, following; 0 for none); Spark merges its 64-bit parts, of which there are a fixed number."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0)
            for name in pc.unique(lang).to_pylist():
                own = batch.filter(pc.equal(lang, name))
                word, following = (own.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (1, 2))
                for pair in (False, True):
                    some = (following != 0) == pair
                    for place in Seen.places(name, word[some], following[some] if pair else None):
                        bit = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["at", "bit"])

    found = rows.select("lang", "word", "following").mapInArrow(places, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[found["at"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return Seen(bits)


def _stripes_batch(lang: str, prefixes: list[np.ndarray], of_cell: np.ndarray, following: np.ndarray, n: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    """Stripes as rows: lang, p1..p3, and cells (following, n) with the total first; cells are sorted by prefix."""
    ends = np.searchsorted(of_cell, np.arange(len(totals) + 1)) + np.arange(len(totals) + 1)
    words, counts = np.zeros(len(of_cell) + len(totals), np.int64), np.zeros(len(of_cell) + len(totals), np.int64)
    own = np.ones(len(words), bool)
    own[ends[:-1]] = False
    counts[ends[:-1]] = totals
    words[own], counts[own] = following.view(np.int64), n
    cells = pa.StructArray.from_arrays([pa.array(words), pa.array(counts)], names=["following", "n"])
    zero = np.zeros(len(totals), np.uint64)
    columns = [pa.array(p.view(np.int64)) for p in (*prefixes, *[zero] * (3 - len(prefixes)))]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(totals), pa.string()), *columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), cells)], names=["lang", *_PREFIX, "cells"])


_STRIPES = "lang string, p1 long, p2 long, p3 long, cells array<struct<following: long, n: long>>"


def _cells(prefix: np.ndarray, following: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, next word and count of each cell, from places (following is -1 for none)."""
    some = following >= 0
    key, _, n = _counted(prefix[some] * width + following[some])
    return key // width, key % width, n


def short_stripes(words: Words, lang: str, frequent: Seen) -> pa.RecordBatch:
    """Stripes of one word, of words and next words that may be frequent."""
    good = frequent.has(lang, words.hash)
    at = np.flatnonzero(good)
    names, place = _numbered(words.hash[at])
    of = np.full(len(good) + 1, -1, np.int64)
    of[at] = place
    following = np.where(np.append(words.first[1:], True), -1, of[1:])[at]
    prefix, nxt, n = _cells(place, following, len(names))
    return _stripes_batch(lang, [names], prefix, names[nxt], n, np.bincount(place, minlength=len(names)))


def long_stripes(words: Words, lang: str, frequent: Seen) -> Iterator[pa.RecordBatch]:
    """Stripes of two and three words, all of whose pairs, the one with the next word included, may be frequent."""
    h = words.hash
    pair = np.zeros(len(h), bool)
    inside = np.flatnonzero(~words.first[1:])
    pair[inside] = frequent.has(lang, h[inside], h[inside + 1])
    names, place = _numbered(h)
    width = len(names)
    after = lambda x, k, none: np.concatenate([x[k:], np.full(min(k, len(x)), none, x.dtype)])
    # Two words: the next one counts where the second pair holds too.
    at = np.flatnonzero(pair)
    codes, of_pair = _numbered(place[at] * width + place[at + 1]) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    third = np.where(after(pair, 1, False), after(place, 2, -1), -1)[at]
    prefix, nxt, n = _cells(of_pair, third, width)
    yield _stripes_batch(lang, [names[codes // max(1, width)], names[codes % max(1, width)]], prefix, names[nxt], n, np.bincount(of_pair, minlength=len(codes)))
    # Three words: two pairs that overlap.
    numbers = np.full(len(h) + 1, -1, np.int64)
    numbers[at] = of_pair
    both = np.flatnonzero(pair & after(pair, 1, False))
    triples, of_triple = _numbered(numbers[both] * len(codes) + numbers[both + 1]) if len(both) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    fourth = np.where(after(pair, 2, False), after(place, 3, -1), -1)[both]
    prefix, nxt, n = _cells(of_triple, fourth, width)
    head, tail = codes[triples // max(1, len(codes))], codes[triples % max(1, len(codes))]
    yield _stripes_batch(lang, [names[head // max(1, width)], names[tail // max(1, width)], names[tail % max(1, width)]], prefix, names[nxt], n, np.bincount(of_triple, minlength=len(triples)))


def word_counts(docs: DataFrame, seed: int, least: int) -> DataFrame:
    """lang, hash, word, n of words with ``least`` occurrences; hash 0 is the language's total; shared marks hashes of two words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _by_language(batches, seed):
            h, at, n = _counted(words.hash)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(h) + 1)), pa.array(np.append(h, np.uint64(0)).view(np.int64)), pa.concat_arrays([words.text(at), pa.array([""])]), pa.array(np.append(n, len(words.hash)))],
                names=["lang", "hash", "word", "n"],
            )

    each = docs.mapInArrow(count, "lang string, hash long, word string, n long")
    merged = each.groupBy("lang", "hash").agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other"))
    return merged.where((F.col("n") >= least) | (F.col("word") != F.col("other")) | (F.col("hash") == 0)).select("lang", "hash", "word", "n", (F.col("word") != F.col("other")).alias("shared"))


def merged_cells(stripes: DataFrame, least: int) -> DataFrame:
    """The stripes' cells (lang, p1..p3, following, n), merged elementwise; those with ``least`` occurrences."""
    cells = stripes.select("lang", *_PREFIX, F.inline("cells"))
    return cells.groupBy("lang", *_PREFIX, "following").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_stripes(cells: DataFrame) -> DataFrame:
    """lang, p1..p3, part, total of the prefix, best (largest count of a next word in the part) and the part's extensions (following, n)."""
    part = F.pmod("following", F.lit(PARTS))
    parts = cells.where("following <> 0").groupBy("lang", *_PREFIX, part.alias("part")).agg(F.max("n").alias("best"), F.collect_list(F.struct("following", "n")).alias("extensions"))
    totals = cells.where("following = 0").select("lang", *_PREFIX, F.col("n").alias("total"))
    return parts.join(_shuffled(totals), ["lang", *_PREFIX])


def _shuffled(table: DataFrame) -> DataFrame:
    """``table`` for a join that shuffles both sides: one side's size is judged by its compressed file, before copies are made, and a broadcast of it would pass through the driver."""
    return table.hint("merge")


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """``rows`` with ``table``'s columns (one row per key); a key of very many rows is spread over SALTS tasks by ``salt``."""
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(_shuffled(copies), [*keys, "salt"]).drop("salt")


def phrases(stripes: DataFrame, words: DataFrame) -> list[DataFrame]:
    """Frequent phrases of two, three and four words: lang, w1.., phrase, last word, a, and counts of first parts (h1..) and rests (t1..), by words before the cut."""
    ext = lambda k, *names: (
        stripes.where(" AND ".join(f"{p} {'<>' if i < k else '='} 0" for i, p in enumerate(_PREFIX)))
        .select("lang", *[F.col(p).alias(n) for p, n in zip(_PREFIX, names[:k], strict=False)], F.col("total").alias(f"h{k}"), F.inline("extensions"))
        .withColumnsRenamed({"following": names[k], "n": "a"})
    )
    known = words.where("hash <> 0").select("lang", "hash", "word", "n")
    two = ext(1, "w1", "w2")
    two = _looked_up(two, known.select("lang", F.col("hash").alias("w1"), F.col("word").alias("head")), ["lang", "w1"], "w2")
    two = _looked_up(two, known.select("lang", F.col("hash").alias("w2"), F.col("word").alias("last"), F.col("n").alias("t1")), ["lang", "w2"], "w1")
    two = stage_table(two.select("lang", "w1", "w2", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "h1", "t1"), "pairs-of-words")
    three = ext(2, "w1", "w2", "w3")
    three = _looked_up(three, two.select("lang", "w1", "w2", "h1", F.col("phrase").alias("head")), ["lang", "w1", "w2"], "w3")
    three = _looked_up(three, two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), "last", F.col("a").alias("t1"), F.col("t1").alias("t2")), ["lang", "w2", "w3"], "w1")
    three = stage_table(three.select("lang", "w1", "w2", "w3", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "h1", "h2", "t1", "t2"), "triples-of-words")
    four = ext(3, "w1", "w2", "w3", "w4")
    four = _looked_up(four, three.select("lang", "w1", "w2", "w3", "h1", "h2", F.col("phrase").alias("head")), ["lang", "w1", "w2", "w3"], "w4")
    tail = three.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), "last", F.col("a").alias("t1"), F.col("t1").alias("t2"), F.col("t2").alias("t3"))
    four = _looked_up(four, tail, ["lang", "w2", "w3", "w4"], "w1")
    four = stage_table(four.select("lang", "w1", "w2", "w3", "w4", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "h1", "h2", "h3", "t1", "t2", "t3"), "fours-of-words")
    return [two, three, four]


def _scored(rows: DataFrame, cuts: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the lowest-scoring cut (the first of equals), in exact arithmetic."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    each = [F.struct(F.expr(f"(CAST(a AS decimal(20,0)) * {SCALE}) div (CAST(h{k} AS decimal(20,0)) + CAST(t{k} AS decimal(20,0)))").alias("score"), F.lit(k).alias("k"), F.col(f"h{k}").alias("l"), F.col(f"t{k}").alias("r")) for k in range(1, cuts + 1)]
    kept = rows.where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * SUBSUMED))
    return kept.withColumn("cut", F.array_min(F.array(*each))).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def candidates(stripes: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Scored phrases, without those that a longer one stands for."""
    best = stripes.groupBy("lang", *_PREFIX).agg(F.max("best").alias("after"))
    out = None
    for k, rows in enumerate(found):
        names = [f"w{i}" for i in range(1, k + 3)]
        if k < 2:
            after = best.where(f"p{k + 2} <> 0" + ("" if k else " AND p3 = 0")).select("lang", *[F.col(p).alias(n) for p, n in zip(_PREFIX, names, strict=False)], "after")
            before = found[k + 1].groupBy("lang", *[F.col(f"w{i + 1}").alias(n) for i, n in enumerate(names, 1)]).agg(F.max("a").alias("before"))
            rows = rows.join(_shuffled(after), ["lang", *names], "left").join(_shuffled(before), ["lang", *names], "left").withColumn("longer", F.greatest("after", "before"))
        else:
            rows = rows.withColumn("longer", F.lit(None).cast("long"))
        scored = _scored(rows, k + 1)
        out = scored if out is None else out.unionByName(scored)
    return out


def _counted_stripes(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged: the words, the cells of stripes of one word, and those of two and three words."""
    for seed in range(8):
        words = stage_table(word_counts(texts, seed, least), "words")
        if not words.where("shared AND hash <> 0").limit(1).count():
            break
        drop_tables(words)
    else:
        raise ValueError("words share hashes under every seed")
    shared = texts.sparkSession.sparkContext.broadcast

    frequent = shared(filter_of(words.where("hash <> 0").select("lang", F.col("hash").alias("word"), F.lit(0).cast("long").alias("following"))))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in _by_language(batches, seed):
            yield short_stripes(own, lang, frequent.value)

    ones = stage_table(merged_cells(texts.mapInArrow(short, _STRIPES), least), "stripes-of-one")
    pairs = shared(filter_of(ones.where("following <> 0").select("lang", F.col("p1").alias("word"), "following")))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in _by_language(batches, seed):
            yield from long_stripes(own, lang, pairs.value)

    more = stage_table(merged_cells(texts.mapInArrow(long, _STRIPES), least), "longer-stripes")
    return words, ones, more


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two to four words.

    ``docs`` has ``lang`` (null: ``und``, which may also be a language's name) and ``text`` (null: empty); no other
    column is read.  ``a`` is the phrase's count, ``l`` and ``r`` those of the parts of its lowest-scoring cut, ``n``
    all words of the language.  Repeated rows count each; ties are ranked by a, then by the phrase's bytes; a
    language without a frequent phrase, and an empty table, give no rows.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    with bounded_batches(docs.sparkSession):
        words, ones, more = _counted_stripes(texts, least)
    stripes = stage_table(frequent_stripes(ones.unionByName(more)), "stripes")
    found = phrases(stripes, words)
    kept = stage_table(candidates(stripes, found), "phrases")
    sizes = stage_table(words.where("hash = 0").select("lang", "n"), "language-sizes")
    drop_tables(words, ones, more, stripes, *found)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Ranked within slices of a language first, so that its last ranking holds a bounded number of rows.
    slice_ = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    some = kept.withColumn("nth", F.row_number().over(slice_)).where(F.col("nth") <= top).drop("nth")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
