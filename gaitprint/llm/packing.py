"""Packing by power-of-two decomposition (operator 1).

Each document's ids are cut into whole runs of the longest length and then the binary digits of the rest,
so every piece has a power-of-two length.  Equal lengths share a bucket, a piece is a sequence of its own,
no sequence crosses documents, and nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitprint.llm.common import slices, stage_table
from gaitprint.llm.tokens import encoder, public_path

LONGEST = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"

_PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("nth", T.LongType()),
    ]
)


def binary_pieces(totals: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of ``totals`` ids: each piece's document, start and length, long pieces first.

    ``longest`` must be a power of two.  A document of no ids has no pieces.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    bits = longest.bit_length() - 1
    whole, rest = totals // longest, totals % longest
    lengths = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
    has = (rest[:, None] & lengths[None, :]) > 0
    counts = whole + has.sum(axis=1)
    doc = np.repeat(np.arange(len(totals)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.full(len(doc), longest, dtype=np.int64)
    length[nth >= whole[doc]] = np.broadcast_to(lengths, has.shape)[has]
    ends = np.cumsum(length)
    first = np.cumsum(totals) - totals
    return doc, ends - length - first[doc], length


def pieces(docs: DataFrame, vocabulary: str | None = None, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each row of ``docs`` (``doc_id``, ``text``; other columns are not read).

    Returns doc_id, start, length, doc_tokens (with the end id), ids (little-endian unsigned 32-bit), and
    ``part``, ``nth``: the task that made the piece and its number among that task's pieces of this length.
    Null and empty texts are documents of the end id alone; a null doc_id stays null; repeated rows are
    documents of their own; an empty table gives no rows.
    """
    path = vocabulary or public_path(VOCABULARY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        part = TaskContext.get().partitionId()
        seen = np.zeros(longest.bit_length(), dtype=np.int64)
        for batch in slices(batches):
            ids, at = encode(batch.column(1))
            totals = np.diff(at) + 1
            whole = np.empty(len(ids) + len(totals), dtype="<u4")
            ends = np.cumsum(totals)
            mask = np.ones(len(whole), bool)
            mask[ends - 1] = False
            whole[mask], whole[ends - 1] = ids, end_id
            doc, start, length = binary_pieces(totals, longest)
            nth = np.empty(len(doc), dtype=np.int64)
            for bit in range(longest.bit_length()):
                own = np.flatnonzero(length == 1 << bit)
                nth[own] = seen[bit] + np.arange(len(own))
                seen[bit] += len(own)
            offsets = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(totals[doc]),
                    pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(whole)]),
                    pa.array(np.full(len(doc), part, dtype=np.int32)),
                    pa.array(nth),
                ],
                names=_PIECE.names,
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECE)


def pack(docs: DataFrame, vocabulary: str | None = None, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs`` (see :func:`pieces`) with sequence_id and offset.

    Sequences are numbered without gaps, longest bucket first.  A bucket's base is a prefix sum over the
    lengths, each task's base within it one over one small row per task.
    """
    cut = stage_table(pieces(docs, vocabulary, longest, end_id), "pieces")
    counts = stage_table(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    earlier = (Window.unboundedPreceding, -1)
    longer = counts.groupBy("length").agg(F.sum("n").alias("all")).withColumn("longer", F.coalesce(F.sum("all").over(Window.orderBy(F.desc("length")).rowsBetween(*earlier)), F.lit(0)))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(*earlier)), F.lit(0))
    bases = stage_table(counts.withColumn("own", own).join(longer, "length").select("length", "part", (F.col("longer") + F.col("own")).alias("base")), "bases")
    # One row per task and length (12 lengths at 2048). As a table of its own it is broadcast only while its measured
    # size is under Spark's threshold; beyond that both sides are hashed by task and length.
    return cut.join(bases, ["length", "part"]).select(
        "doc_id",
        "start",
        "length",
        "ids",
        "doc_tokens",
        (F.col("base") + F.col("nth")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def packed_digest(packed: DataFrame) -> DataFrame:
    """What :func:`pack` returns with the ids' checksum in place of the ids."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
