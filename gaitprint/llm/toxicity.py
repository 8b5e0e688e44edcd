"""Toxicity (operator 13): a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct runs of three to six characters of its padded words, hashed into buckets.
In how many toxic and in how many other texts each bucket occurs is counted over all labelled rows, as
Spark aggregates of one vector per task.  A bucket's scale is the logarithm of the two rates' ratio, drawn
towards 0 by a multiple of its standard error and a constant, so that what can't be told from chance, or tells
little however many texts there are, has no weight.  A
logistic regression over the scaled features is then fitted in numpy on a bounded sample of those rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitprint.llm.common import free_name, own_columns, slices
from gaitprint.llm.language import code_points

BUCKET_BITS, ORDERS = 18, (3, 4, 5, 6)
#: Labelled rows that the regression is fitted on, about (a row is drawn by a hash of its doc_id); counts are of all of them.
MAX_ROWS = 16_384
#: Added to the counts of each class; and by how many standard errors, and by how much besides, a ratio is drawn towards 0.
SMOOTHING, ERRORS, LEAST = 0.5, 2.0, 0.4
#: Weight of the squared coefficients, and steps of the fit.
RIDGE, STEPS = 0.001, 400
#: Characters hashed at a time.
STEP = 1 << 20
#: Weights are whole multiples of this, so that sums don't depend on the order of features.
UNIT = 2.0**-20


def _hashed(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the run of ``order`` code points from each place, and whether it lies within one padded word."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    inside = np.ones(n, bool)
    for k in range(order):
        c = points[k : k + n]
        h = (h ^ c) * np.uint32(0x01000193) + np.uint32(k)
        if 0 < k < order - 1:
            inside &= c > 0
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), inside


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct feature of every text, or of those in ``wanted`` (a mask of buckets), by row and bucket."""
    points, starts = code_points(texts)
    found = [np.zeros(0, np.int64)]
    for lo in range(0, len(points), STEP):
        part = points[lo : lo + STEP + max(ORDERS) - 1]
        for order in ORDERS:
            bucket, inside = _hashed(part, order)
            bucket, inside = bucket[:STEP], inside[:STEP]
            if wanted is not None:
                inside &= wanted[bucket]
            at = np.flatnonzero(inside)
            row = np.searchsorted(starts, at + lo, side="right") - 1
            found.append((row << BUCKET_BITS) | bucket[at])
    keys = np.sort(np.concatenate(found))
    keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
    return keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)


@dataclass
class Model:
    """What each bucket adds to a text's log-odds, in UNITs, and the log-odds of a text without features."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, bucket = features(texts, self.weights != 0)
        z = np.bincount(row, weights=self.weights[bucket].astype(np.float64), minlength=len(texts)) * UNIT + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label is never learnt from: crc32 of its id as text, mod 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def log_count_ratios(docs_with: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Each bucket's scale from counts of texts (``docs_with``: buckets x two classes; ``docs``: the classes' sizes)."""
    n0, n1 = docs_with[:, 0] + SMOOTHING, docs_with[:, 1] + SMOOTHING
    rate0, rate1 = n0 / (docs[0] + 2 * SMOOTHING), n1 / (docs[1] + 2 * SMOOTHING)
    ratio = np.log(rate1 / rate0)
    error = np.sqrt((1 - rate0) / n0 + (1 - rate1) / n1)
    return np.sign(ratio) * np.maximum(np.abs(ratio) - ERRORS * error - LEAST, 0)


def regression(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, scale: np.ndarray) -> Model:
    """Fit by accelerated gradient steps; row i has the features ``bucket[row == i]`` and class ``y[i]``."""
    used = np.flatnonzero(np.bincount(bucket, minlength=1 << BUCKET_BITS))
    place = np.zeros(1 << BUCKET_BITS, np.int32)
    place[used] = np.arange(len(used))
    column, own, n, k = place[bucket], scale[used], len(y), len(used)
    times = lambda w: np.bincount(row, weights=(w * own)[column], minlength=n)
    back = lambda g: np.bincount(column, weights=g[row], minlength=k) * own
    v, size = np.ones(k) / max(1, k) ** 0.5, 0.0
    for _ in range(20):
        v = back(times(v)) / n
        size = float(np.linalg.norm(v))
        if not size:
            break
        v /= size
    rate = 1 / (0.25 * (1.05 * size + 1) + RIDGE)
    share = min(max(float(y.mean()), 1 / (2 * n)), 1 - 1 / (2 * n))
    w, bias = np.zeros(k), float(np.log(share / (1 - share)))
    ahead, ahead_bias, t = w, bias, 1.0
    for _ in range(STEPS):
        gap = 1 / (1 + np.exp(-np.clip(times(ahead) + ahead_bias, -500, 500))) - y
        new, new_bias = ahead - rate * (back(gap) / n + RIDGE * ahead), ahead_bias - rate * float(gap.mean())
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        push = (t - 1) / t_new
        ahead, ahead_bias = new + push * (new - w), new_bias + push * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    weights = np.zeros(1 << BUCKET_BITS, np.int64)
    weights[used] = np.round(w * own / UNIT).astype(np.int64)
    return Model(weights, bias)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and y (0 or 1) of each row of ``docs`` with each label of its doc_id, held-out rows left out."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("y"))
    rows = docs.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(known.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "y")


def document_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts of each class every bucket occurs, and how many texts each class has; one vector per task is summed by Spark."""
    buckets = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * buckets + 2, np.int64)
        for batch in slices(batches, limit=1 << 20):
            y = batch.column(1).to_numpy()
            row, bucket = features(batch.column(0))
            seen[: 2 * buckets] += np.bincount(2 * bucket + y[row], minlength=2 * buckets)
            seen[2 * buckets :] += np.bincount(y, minlength=2)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["cell", "n"])

    cells = rows.select("text", "y").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    whole = np.zeros(2 * buckets + 2, np.int64)
    whole[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return whole[: 2 * buckets].reshape(buckets, 2), whole[2 * buckets :]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learn from all rows of ``docs`` (``doc_id``, ``text``) that ``labels`` (``doc_id``, ``toxic``) marks 0 or 1 and that aren't :func:`held_out`.

    Without any such row, or with one class only, every text has that class's smoothed share as its score (0.5
    without rows).  A null text is empty; a null doc_id has no label; a label of several rows, and several
    labels of a row, count each.
    """
    rows = labelled(docs, labels)
    docs_with, sizes = document_counts(rows)
    share = (sizes[1] + 0.5) / (sizes.sum() + 1)
    plain = Model(np.zeros(1 << BUCKET_BITS, np.int64), float(np.log(share / (1 - share))))
    if not sizes.all():
        return plain
    scale = log_count_ratios(docs_with, sizes)
    # Drawn by a hash below a bound, on both sides of the join, so that only about max_rows texts move.
    bound = int(min(1.0, max_rows / int(sizes.sum())) * (1 << 31))
    drawn = lambda df: df.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(13)), F.lit(1 << 31)) < bound)
    shared = docs.sparkSession.sparkContext.broadcast(scale != 0)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", limit=1 << 20):
            row, bucket = features(batch.column(1), shared.value)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32)))
            key = [zlib.crc32(bucket[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(key, pa.int64()), lists], names=["doc_id", "y", "key", "buckets"])

    sample = labelled(drawn(docs), drawn(labels)).mapInArrow(scaled, "doc_id long, y long, key long, buckets array<int>").toArrow()
    if not len(sample):
        return plain
    sample = sample.take(pc.sort_indices(sample, [(n, "ascending") for n in ("doc_id", "y", "key")])).combine_chunks()  # the same order in every run
    lengths, bucket = pc.list_value_length(sample["buckets"]).to_numpy(), pc.list_flatten(sample["buckets"]).to_numpy()
    return regression(np.repeat(np.arange(len(sample), dtype=np.int32), lengths), bucket, sample["y"].to_numpy().astype(np.float64), scale)


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` (``text``) with score (0 to 1, higher: more likely toxic) and predicted (1 from a score of 0.5 on) added.

    Null texts count as empty and get the score of a text without features.  Columns of the new names are
    replaced, all others and repeated rows stay; equal texts have equal scores; an empty table gives no rows.
    """
    names_ = {x.lower() for x in names}
    base = docs.select(*[c for c, name in zip(own_columns(docs), docs.columns, strict=True) if name.lower() not in names_])
    place = base.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            p = shared.value.scores(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, *names])

    schema = base.withColumns({names[0]: F.lit(0.0), names[1]: F.lit(0)}).schema
    for f in schema.fields:
        f.nullable = True
    return base.mapInArrow(predict, schema)


def drop_toxic(docs: DataFrame, model: Model, bound: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score lies below ``bound``, with their own columns."""
    names = (free_name(docs, "toxic_score"), free_name(docs, "toxic_predicted"))
    return score(docs, model, names).where(F.col(names[0]) < bound).select(*own_columns(docs))
