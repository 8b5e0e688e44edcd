"""Token counts (operator 8): an exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitprint.llm.common import slices, stage_table
from gaitprint.llm.tokens import encoder, public_path

VOCABULARY = "byte_bpe_50k.json"
#: Lengths of one block of the suffix sums.
BLOCK = 1024


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many rows of ``docs`` (``text``) have each encoded length.

    Each task counts its own lengths first, so what is shuffled grows with distinct lengths and tasks.
    Null and empty texts have length 0; repeated rows count each; an empty table gives no rows.
    """
    path = vocabulary or public_path(VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        seen = np.zeros(0, dtype=np.int64)
        for batch in slices(batches):
            _, at = encode(batch.column(0))
            n = np.diff(at)
            if n.max() < 1 << 20:
                more = np.bincount(n, minlength=len(seen)).astype(np.int64)
                more[: len(seen)] += seen
                seen = more
            else:  # very long texts are few: a row each
                large = n[n >= 1 << 20]
                yield pa.RecordBatch.from_arrays([pa.array(large), pa.array(np.ones(len(large), np.int64))], names=["n_tokens", "n_docs"])
                more = np.bincount(n[n < 1 << 20], minlength=len(seen)).astype(np.int64)
                more[: len(seen)] += seen
                seen = more
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own])], names=["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(count, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """Per length: what a context limit of exactly that length keeps.

    Columns: n_tokens (the length, and the limit), n_docs, docs_within and docs_over (documents at most
    and more than that long), tokens_within (their ids), truncated_tokens (all documents cut to the limit),
    total_tokens, quantile (share of documents at most that long).  Between two lengths truncated_tokens
    is linear, so these rows answer every limit (:func:`truncated_total`).

    The suffix sums are taken within blocks of lengths and then over the blocks, so no task holds all lengths.
    """
    hist = stage_table(histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "lengths")
    tokens = F.col("n_tokens") * F.col("n_docs")
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        hist.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
            F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
            F.sum("d").over(everything).alias("d_all"),
            F.sum("t").over(everything).alias("t_all"),
        )
    )
    over = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    docs_over = F.col("d_after") + F.coalesce(F.sum("n_docs").over(over), F.lit(0))
    tokens_over = F.col("t_after") + F.coalesce(F.sum(tokens).over(over), F.lit(0))
    return (
        hist.join(blocks, "block")
        .select("n_tokens", "n_docs", "d_all", "t_all", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"))
        .select(
            "n_tokens",
            "n_docs",
            (F.col("d_all") - F.col("docs_over")).alias("docs_within"),
            "docs_over",
            (F.col("t_all") - F.col("tokens_over")).alias("tokens_within"),
            (F.col("t_all") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_tokens"),
            F.col("t_all").alias("total_tokens"),
            ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("quantile"),
        )
    )


def truncated_total(totals: DataFrame, limit: int) -> DataFrame:
    """One row: ids that remain when every document is cut to ``limit`` (null if there are no documents)."""
    below = F.max(F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "tokens_within", "docs_over")))
    return totals.agg(below.alias("b"), F.sum("n_docs").alias("d")).select(
        F.when(F.col("b").isNull(), F.col("d") * limit).otherwise(F.col("b.tokens_within") + F.col("b.docs_over") * limit).alias("truncated_tokens")
    )


def length_quantile(totals: DataFrame, share: float) -> DataFrame:
    """One row: the shortest length that at least ``share`` of the documents don't exceed."""
    return totals.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
