"""Nearest neighbours by adaptive dimension scan over inverted lists (operator 6).

Vectors are scaled to length one and rotated by a random orthogonal matrix, so that the first dimensions of
a difference are a random sample of it.  Every vector lies in the list of its nearest centroid.  Within a
probed list the squared distance is summed one block of columns at a time, and a candidate is dropped as
soon as a hypothesis test on the partial sum says that it can't beat the query's bound.  What survives all
blocks is scored exactly, in double precision, on the original vectors.

The centroids, the bounds to begin with and the number of probed lists come from a bounded sample
(``sample`` vectors, chosen by a hash of their ids); every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaitprint.llm.common import stage_table

#: Vectors that centroids, bounds and the number of probes are fitted on, and bytes they may take.
SAMPLE, SAMPLE_BYTES = 16_384, 16 << 20
#: Recall (of the sample's own neighbours) that the number of probes is chosen for.
AIM = 0.98
#: Columns of one block, and how many standard errors a partial distance must exceed the bound by.
COLUMNS, STRICTNESS = 16, 2.5
#: Vectors and queries that meet in one group of a task at most (on average).
BLOCK_VECTORS, BLOCK_QUERIES = 1024, 1024
#: Components gathered at a time for exact scores.
GATHERED = 1 << 22


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = scaled(np.asarray(x, dtype=np.float64))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component below one: squares neither over- nor underflow, and digits stay."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means over unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def probes_needed(x: np.ndarray, c: np.ndarray, k: int, aim: float, seed: int = 7) -> int:
    """How many lists must be probed for recall ``aim`` of the k nearest within the sample itself."""
    if len(x) <= k + 1:
        return len(c)
    own = (x @ c.T).argmax(axis=1)
    at = np.random.default_rng(seed).choice(len(x), min(512, len(x)), replace=False)
    s = x[at] @ x.T
    s[np.arange(len(at)), at] = -2
    near = np.argpartition(-s, k, axis=1)[:, :k]
    rank = np.empty((len(at), len(c)), dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-(x[at] @ c.T), axis=1), np.arange(len(c))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(aim * len(needed)) - 1)]) + 1


def scan(q: np.ndarray, v: np.ndarray, bound: np.ndarray, k: int, columns: int = COLUMNS, strictness: float = STRICTNESS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) of rotated unit rows that no hypothesis test dropped.

    ``bound`` is each query's squared distance that k candidates are known to reach; it is tightened by
    this block's own first vectors.  The nearest of those first ones are among the pairs whatever the
    tests say, so that a query never ends with fewer than k while there are as many.
    """
    dims = q.shape[1]
    # The first vectors in full; one neighbour more than k, as the query itself may be among them.
    head = ((q[:, None, :] - v[None, : 4 * k, :]) ** 2).sum(axis=2)
    sure = np.argpartition(head, k, axis=1)[:, : k + 1] if head.shape[1] > k + 1 else np.tile(np.arange(head.shape[1]), (len(q), 1))
    if head.shape[1] > k:
        bound = np.minimum(bound, np.partition(head, k, axis=1)[:, k] + 1e-9)
    first = min(columns, dims)
    part = (q[:, :first] ** 2).sum(1)[:, None] + (v[:, :first] ** 2).sum(1)[None, :] - 2 * q[:, :first] @ v[:, :first].T
    at = first
    limit = lambda n: bound * (n / dims) * (1 + strictness / math.sqrt(n)) ** 2 + 1e-9 if n < dims else bound + 1e-9
    i, j = np.nonzero(part <= limit(at)[:, None])
    part = part[i, j]
    while at < dims and len(i):
        to = min(at + columns, dims)
        diff = q[i, at:to] - v[j, at:to]
        part = part + (diff * diff).sum(axis=1)
        at = to
        stay = part <= limit(at)[i]
        i, j, part = i[stay], j[stay], part[stay]
    return np.concatenate([i, np.repeat(np.arange(len(q)), sure.shape[1])]), np.concatenate([j, sure.ravel()])


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best distinct vectors: highest score first, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    order = order[np.sort(np.unique(np.stack([query[order], vec[order]]), axis=1, return_index=True)[1])] if len(order) else order
    own = query[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return order[rank < k]


def valid_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int, int]:
    """vec_id and embedding of the rows that take part, their dimensions and their number (0 and 0 for none).

    Components keep single precision where they have it and are doubles otherwise.  Left out: null ids and vectors, zero vectors, vectors with a null or non-finite component, and vectors of
    another length than most.
    """
    x = F.col("embedding")
    kind = table.schema[embedding].dataType
    kind = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    good = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding")).where(
        F.col("vec_id").isNotNull()
        & x.isNotNull()
        & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
        & F.exists(x, lambda e: e != 0)
    )
    most = good.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims, n = (most["d"], most["count"]) if most else (0, 0)
    return good.where(F.size(x) == dims), dims, n


def nearest(table: DataFrame, k: int = 5, every: int = 50, sample: int = SAMPLE, aim: float = AIM) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: its k nearest other rows by cosine.

    Returns query_id, rank (from 1), vec_id, score (cosine in double precision on the original vectors),
    nearest first, ties to the smaller vec_id.  Rows of :func:`valid_vectors` take part; a repeated vec_id
    is one candidate (its best score) and one query; an empty table gives no rows; with fewer than k
    candidates all are returned.
    """
    spark = table.sparkSession
    out = "query_id long, vec_id long, score double"
    good, dims, n = valid_vectors(table)
    kind = good.schema["embedding"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(2 * k, min(sample, SAMPLE_BYTES // (4 * dims)))
    share = min(1.0, most / n)
    some = good if share == 1 else good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    x = np.stack(some.select("embedding").toPandas()["embedding"].to_numpy()) if n else np.zeros((0, dims))
    x = unit(x)
    lists = max(1, min(int(math.sqrt(n)), len(x) // 8, 1024))
    centroids = fit_centroids(x, lists)
    probes = probes_needed(x, centroids, k, aim)
    shared = spark.sparkContext.broadcast((centroids, x.astype(np.float32)))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), dims)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _ = shared.value
        for batch in batches:
            if batch.num_rows:
                own = (unit(matrix(batch.column(1))) @ c.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32))], names=["vec_id", "embedding", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, known = shared.value
        own_list = (known.astype(np.float64) @ c.T).argmax(axis=1)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                u = unit(matrix(batch.column(1)))
                near = np.argpartition(-(u @ c.T), probes - 1, axis=1)[:, :probes] if probes < len(c) else np.tile(np.arange(len(c)), (len(u), 1))
                probed = np.zeros((len(u), len(c)), bool)
                np.put_along_axis(probed, near, True, axis=1)
                # What the sample reaches within the probed lists; one neighbour more than k, as the query itself may be in it.
                s = np.where(probed[:, own_list], u @ known.T.astype(np.float64), -np.inf)
                bound = 2 - 2 * np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] if known.shape[0] > k else np.full(len(u), np.inf)
                rows = np.repeat(np.arange(len(u)), near.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(near.ravel().astype(np.int32)), pa.array(np.maximum(bound, 0)[rows] + 1e-6)],
                    names=["query_id", "query", "list", "bound"],
                )

    indexed = stage_table(good.mapInArrow(assign, f"vec_id long, embedding {kind}, list int"), "lists")
    queries = stage_table(
        indexed.where(F.col("vec_id") % every == 0).select("vec_id", "embedding").mapInArrow(probe, f"query_id long, query {kind}, list int, bound double"), "probes"
    )
    # A row per list, of which there are 1024 at most.
    parts = (
        indexed.groupBy("list")
        .agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("v_parts"))
        .join(queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("q_parts")), "list")
    )
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every_part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(F.broadcast(parts), "list").select("vec_id", "embedding", "list", spread("vec_id", "v_parts").alias("v"), every_part("q_parts").alias("q"))
    right = queries.join(F.broadcast(parts), "list").select("query_id", "query", "bound", "list", spread("query_id", "q_parts").alias("q"), every_part("v_parts").alias("v"))

    def search(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v, q = (np.stack(c.to_numpy()).astype(np.float64) for c in (vectors["embedding"], asked["query"]))
        vid, qid = vectors["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        turn = rotation(dims)
        i, j = scan(unit(q) @ turn, unit(v) @ turn, asked["bound"].to_numpy(), k)
        other = qid[i] != vid[j]
        i, j = i[other], j[other]
        score = np.empty(len(i))
        q, v = scaled(q), scaled(v)
        qn, vn = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
        step = max(1, GATHERED // dims)
        for lo in range(0, len(i), step):
            a, b = i[lo : lo + step], j[lo : lo + step]
            score[lo : lo + step] = (q[a] * v[b]).sum(axis=1) / (qn[a] * vn[b])
        top = best(qid[i], vid[j], score, k)
        return pd.DataFrame({"query_id": qid[i][top], "vec_id": vid[j][top], "score": score[top]})

    key = ["list", "v", "q"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, out)
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(nearest_first))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
