"""Language identification (operator 10): averaged hashed subword embeddings under a linear softmax.

The model is trained in numpy by stochastic gradient descent on a bounded sample of labelled rows and
calibrated on a part of that sample kept aside: a temperature for the scores, and the score below which a
prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitprint.llm.common import free_name, own_columns, slices

#: Distinct labelled texts that a model is fitted on at most; one of each language at least, so more if there are more languages.
MAX_ROWS = 4096
#: Hashes that a slice of a language's hashes gives at most; as many as Spark's ranked windows cut before they shuffle.
SLICE_ROWS = 1000
#: Characters of one labelled row that the sample holds at most; a longer text gives an excerpt from a drawn place.
#: So the sample is at most max(MAX_ROWS, languages) * SAMPLE_CHARS characters.  Predictions read whole texts.
SAMPLE_CHARS = 16_384
BUCKET_BITS, DIMENSIONS, EPOCHS, RATE = 16, 16, 6, 1.0
ORDERS = (2, 3, 4)
#: Share of right predictions that calibration may reject.
REJECTED_SHARE = 0.0005
UNKNOWN = "und"
#: Characters hashed at a time.
STEP = 1 << 20
#: A model's scores are whole multiples of this, so that their sums are exact however texts share a batch.
UNIT = 2.0**-18


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of a column as code points, all else as 0, a 0 around each text; where each text starts."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    joined = "\n" + "\n".join(texts.to_pylist()) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = np.where(_letters()[points], points, 0).astype(np.uint32)
    lengths = pc.utf8_length(texts).to_numpy() + 1
    return points, np.concatenate([[0], np.cumsum(lengths)])


def subwords(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the run of ``order`` code points from each place, and whether it lies within one padded word."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    inside = np.ones(n, bool)
    for k in range(order):
        c = points[k : k + n]
        h = (h ^ c) * np.uint32(0x01000193) + np.uint32(k)
        if 0 < k < order - 1:
            inside &= c > 0
    if order == 2:
        inside &= (points[:n] > 0) | (points[1 : 1 + n] > 0)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - BUCKET_BITS), inside


@dataclass
class Model:
    """Scores of a bucket for each language in UNITs (embedding and softmax weights in one), and the calibration."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean score per text and language, and how many subwords each text has."""
        points, starts = code_points(texts)
        sums, counts = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64)
        for lo in range(0, len(points), STEP):
            part = points[lo : lo + STEP + max(ORDERS) - 1]
            first = int(np.searchsorted(starts, lo, side="right")) - 1
            last = min(int(np.searchsorted(starts, lo + STEP)), len(texts))
            if first >= last:
                continue
            cuts = np.clip(starts[first : last] - lo, 0, None)
            for order in ORDERS:
                bucket, inside = subwords(part, order)
                bucket, inside = bucket[:STEP], inside[:STEP]
                at = np.concatenate([[0], np.cumsum(inside)])
                bucket = bucket[inside]
                edges = at[np.minimum(np.append(cuts, len(inside)), len(inside))]
                counts[first:last] += np.diff(edges)
                if len(bucket):
                    full = np.flatnonzero(np.diff(edges))
                    for k in range(len(self.languages)):
                        sums[first + full, k] += np.add.reduceat(self.weights[k][bucket], edges[full], dtype=np.int64)
        return sums * UNIT / np.maximum(counts, 1)[:, None] + self.bias, counts

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: place of its language (-1 without letters), calibrated score, and whether it is rejected."""
        z, counts = self.logits(texts)
        p = _softmax(z / self.temperature)
        own = np.where(counts > 0, p.argmax(axis=1), -1)
        score = np.where(counts > 0, p.max(axis=1), 0.0)
        return own, score, (counts == 0) | (score < self.reject_below)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct buckets and their shares."""
    bags = []
    for text in texts:
        points, _ = code_points(pa.array([text]))
        buckets = [b[i] for b, i in (subwords(points, order) for order in ORDERS)]
        ids, n = np.unique(np.concatenate(buckets), return_counts=True)
        bags.append((ids, n / max(1, n.sum())))
    return bags


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit and calibrate; every text also appears as one short run of its words, so that short texts are learnt too."""
    languages = sorted(set(labels))
    place = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = set(order[: len(order) // 5].tolist()) if len(order) >= 10 else set()
    fit, check = [], []
    for i in range(len(texts)):
        words = texts[i].split()
        n = int(rng.integers(3, 13))
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        for text in (texts[i], " ".join(words[at : at + n])):
            (check if i in held else fit).append((text, place[labels[i]]))
    bags = _bags([t for t, _ in fit])
    y = [k for _, k in fit]
    e = rng.standard_normal((1 << BUCKET_BITS, DIMENSIONS)) / DIMENSIONS
    w, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            h = share @ e[ids]
            g = _softmax(h @ w + bias)
            g[y[i]] -= 1
            back = w @ g
            w -= rate * np.outer(h, g)
            bias -= 0.1 * rate * g
            # Shares are small; scaled so that a text moves its subwords by about as much as a short one does.
            e[ids] -= rate * np.sqrt(len(ids)) * share[:, None] * back[None, :]
    model = Model(languages, np.ascontiguousarray(np.clip(np.round((e @ w).T / UNIT), -(2**31), 2**31 - 1).astype(np.int32)), bias)
    if check:
        column = pa.array([t for t, _ in check])
        truth = np.array([k for _, k in check])
        z, counts = model.logits(column)
        z, truth = z[counts > 0], truth[counts > 0]
        if len(z):
            grid = np.exp(np.linspace(np.log(0.05), np.log(20), 61))
            loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean() for t in grid]
            model.temperature = float(grid[int(np.argmin(loss))])
            p = _softmax(z / model.temperature)
            right = p.max(axis=1)[p.argmax(axis=1) == truth]
            chance = 1 / len(languages)
            if len(right):
                model.reject_below = float(min(np.quantile(right, REJECTED_SHARE, method="lower"), 0.5, (1 + chance) / 2))
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether a row is never learnt from: crc32 of its id as text, mod 4, is 2 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def lowest_hashes(drawn: DataFrame, each: int) -> DataFrame:
    """Of distinct rows (lang, draw) the ``each`` lowest draws of every language, or all it has.

    A language is many tasks: each slice of its draws gives its own lowest, cut before the shuffle, and only these
    are ranked over the language.  Slices are so many that about a hundred of a language's lowest fall in one, a tenth of
    what it may give.
    """
    n = max(64, each // 100)
    sliced = drawn.withColumn("slice", F.pmod("draw", F.lit(n)))
    first = Window.partitionBy("lang", "slice").orderBy("draw")
    few = sliced.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= min(each, SLICE_ROWS)).select("lang", "draw")
    return few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("nth") <= each).select("lang", "draw")


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, seed: int = 7) -> Model | None:
    """Train on ``max_rows`` distinct labelled texts at most, of each language an equal share or all it has (one at least), those of lowest hash.

    Only text and lang of rows that aren't :func:`held_out` are used.  None if no such row has both.
    """
    known = docs.select("text", "lang", held_out().alias("held")).where(~F.col("held") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.agg(F.count_distinct("lang")).first()[0]
    if not counts:
        return None
    each = max(1, max_rows // counts)
    start = F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    lowest = lowest_hashes(known.select("lang", F.xxhash64("text", F.lit(seed)).alias("draw")).distinct(), each)
    some = known.withColumn("draw", F.xxhash64("text", F.lit(seed))).join(F.broadcast(lowest), ["lang", "draw"], "left_semi").select(F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text"), "lang")
    rows = some.distinct().toPandas().sort_values(["lang", "text"])
    return train(rows["text"].tolist(), rows["lang"].tolist(), seed) if len(rows) else None


def identify(docs: DataFrame, model: Model | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` (``text``, and to fit a model ``doc_id``, ``lang``) with lang_pred, score and rejected added.

    lang_pred is a learnt value, or ``und`` with score 0 where the text is null, empty or has no letter (or
    nothing could be learnt).  score is the calibrated probability.  rejected marks ``und`` and scores below
    the calibrated bound.  ``names`` gives them other names.  Columns of those names are replaced; all others, repeated rows and order within a
    partition stay.
    """
    model = model or fit(docs)
    names_ = {x.lower() for x in names}
    kept = [c for c in docs.columns if c.lower() not in names_]
    base = docs.select(*[c for c, name in zip(own_columns(docs), docs.columns, strict=True) if name in kept])
    if model is None:
        return base.withColumns(dict(zip(names, (F.lit(UNKNOWN), F.lit(0.0), F.lit(True)), strict=True)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = kept.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        langs = pa.array([*m.languages, UNKNOWN])
        for batch in slices(batches, limit=1 << 20):
            own, score, rejected = m.predict(batch.column(place))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, langs.take(pa.array(np.where(own < 0, len(m.languages), own))), pa.array(np.clip(score, 0, 1)), pa.array(rejected)],
                names=[*batch.schema.names, *names],
            )

    schema = base.withColumns(dict(zip(names, (F.lit(""), F.lit(0.0), F.lit(True)), strict=True))).schema
    for f in schema.fields:
        f.nullable = True
    return base.mapInArrow(predict, schema)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their own columns.

    Rows without letters go, whatever is learnt.  Where no row has a text and a language to learn from, no
    language can be told from another, and all others stay.  Null doc_ids and repeated rows are rows like
    others; an empty table stays empty.
    """
    names = tuple(free_name(docs, x) for x in ("lang_pred", "score", "rejected"))
    model = model or fit(docs)
    if model is None:
        return docs.where(F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)))
    return identify(docs, model, names).where(~F.col(names[2])).select(*own_columns(docs))
