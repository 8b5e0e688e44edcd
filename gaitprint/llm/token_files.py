"""Token-id files (operator 5): flat unsigned integers with 64-bit document offsets, memory-mapped.

A corpus is a folder of shards.  Shard ``k`` is three files: ``k.bin`` (the ids, little-endian, 16 bits
where the vocabulary has at most 65,536 ids and 32 bits otherwise), ``k.idx`` (n + 1 offsets of its n
documents within the shard, little-endian signed 64-bit) and ``k.doc`` (for each document its doc_id,
64-bit, and one byte that is 1 where the doc_id is null).  A shard's base is the sum of the ids of all
shards before it, so a document's place in the corpus is base + offset.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitprint.llm.common import new_folder, slices, stage_table
from gaitprint.llm.tokens import encoder, public_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
_DOC = np.dtype([("doc_id", "<i8"), ("is_null", "u1")])
_SHARDS = "shard int, folder string, width int, n_docs long, n_tokens long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _local(folder: str) -> str | None:
    """The path of a folder that is mounted on every machine; None for a store with a scheme of its own."""
    parsed = urlparse(folder)
    return parsed.path if parsed.scheme in ("", "file") else None


def _put(folder: str, name: str, parts: list) -> None:
    """Write a file whole or not at all, so that a repeated or lost task leaves nothing half done."""
    place = _local(folder)
    if place is not None:
        os.makedirs(place, exist_ok=True)
        made = f"{place}/.{name}.{uuid.uuid4().hex}"
        with open(made, "wb") as f:
            for part in parts:
                f.write(part)
        os.replace(made, f"{place}/{name}")
        return
    fs, place = stores.FileSystem.from_uri(folder)
    fs.create_dir(place)
    made = f"{place}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(made) as f:
        for part in parts:
            f.write(part)
    fs.move(made, f"{place}/{name}")


def _map(folder: str, name: str, dtype) -> np.ndarray:
    """A file's numbers: memory-mapped where the folder is mounted, else read."""
    place = _local(folder)
    if place is not None:
        file = f"{place}/{name}"
        return np.memmap(file, dtype=dtype, mode="r") if os.path.getsize(file) else np.zeros(0, dtype)
    fs, place = stores.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{place}/{name}") as f:
        return np.frombuffer(f.read(), dtype=dtype)


class ShardWriter:
    """Writes one shard's ids as they come; the files get their names when the shard is whole."""

    def __init__(self, folder: str, shard: int, width: int):
        self.folder, self.shard, self.width = folder, shard, width
        place = _local(folder)
        self.held: list[bytes] = []
        self.place = place
        if place is not None:
            os.makedirs(place, exist_ok=True)
            self.made = f"{place}/.{shard:06d}.bin.{uuid.uuid4().hex}"
            self.file = open(self.made, "wb")
        self.lengths: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []

    def add(self, doc_id: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        self.file.write(raw) if self.place is not None else self.held.append(raw)
        docs = np.zeros(len(lengths), _DOC)
        docs["doc_id"] = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
        docs["is_null"] = doc_id.is_null().to_numpy(zero_copy_only=False)
        self.docs.append(docs)
        self.lengths.append(lengths)

    def close(self) -> tuple[int, int]:
        lengths = np.concatenate([np.zeros(1, np.int64), *self.lengths])
        offsets = np.cumsum(lengths).astype("<i8")
        if self.place is not None:
            self.file.close()
            os.replace(self.made, f"{self.place}/{self.shard:06d}.bin")
        else:
            _put(self.folder, f"{self.shard:06d}.bin", self.held)
        _put(self.folder, f"{self.shard:06d}.idx", [offsets.tobytes()])
        _put(self.folder, f"{self.shard:06d}.doc", [d.tobytes() for d in self.docs])
        return len(offsets) - 1, int(offsets[-1])


def write_tokens(
    docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = END_ID, shards: int | None = None
) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``) and write shards in ascending doc_id order; returns one row per shard.

    The row holds shard, folder, width (bytes of an id), n_docs, n_tokens and base.  ``folder`` must be one
    that every machine sees; a new one in the session's shared folder if none is given.  Nulls in doc_id
    come first, null and empty texts are documents of the end id alone, repeated rows are documents of
    their own (ties by a hash of the text, then the text), an empty table has no shards.  ``shards`` defaults
    to the session's shuffle partitions.
    """
    spark = docs.sparkSession
    path = vocabulary or public_path(VOCABULARY)
    folder = folder or new_folder(spark, "token-files")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        width = 2 if tokens.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
        out = None
        for batch in slices(batches):
            out = out or ShardWriter(folder, TaskContext.get().partitionId(), width)
            ids, at = tokens.encode(batch.column(1))
            lengths = np.diff(at) + 1
            whole = np.full(len(ids) + len(lengths), end_id, dtype=np.uint32)
            mask = np.ones(len(whole), bool)
            mask[np.cumsum(lengths) - 1] = False
            whole[mask] = ids
            out.add(batch.column(0), whole, lengths)
        if out is not None:
            n_docs, n_tokens = out.close()
            yield pa.RecordBatch.from_pylist([{"shard": out.shard, "folder": folder, "width": width, "n_docs": n_docs, "n_tokens": n_tokens}], schema=_schema(_SHARDS))

    # The hash lets a doc_id of very many rows (a null one, say) span shards.
    order = (F.asc_nulls_first("doc_id"), F.xxhash64("text").asc())
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, *order).sortWithinPartitions(*order, F.asc_nulls_first("text"))
    written = stage_table(ordered.mapInArrow(write, _SHARDS), "shards")
    # One row per shard: the window's single task grows with the number of files, not with documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def read_tokens(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of shards (as :func:`write_tokens` returns them), read back from the memory-mapped files.

    Returns doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers) and, on request, ids.
    """
    spark = shards.sparkSession
    rows = _ROWS + (", ids binary" if with_ids else "")
    schema = _schema(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                name = f"{s['shard']:06d}"
                ids, offsets, docs = _map(s["folder"], f"{name}.bin", f"<u{s['width']}"), _map(s["folder"], f"{name}.idx", "<i8"), _map(s["folder"], f"{name}.doc", _DOC)
                at = 0
                while at < len(docs):
                    to = max(at + 1, min(int(np.searchsorted(offsets, offsets[at] + (1 << 20))), len(docs)))
                    own = [np.asarray(ids[a:b], dtype="<u4").tobytes() for a, b in zip(offsets[at:to], offsets[at + 1 : to + 1], strict=True)]
                    arrays = [
                        pa.array(docs["doc_id"][at:to], pa.int64(), mask=docs["is_null"][at:to] > 0),
                        pa.array(offsets[at:to] + s["base"], pa.int64()),
                        pa.array(np.diff(offsets[at : to + 1]), pa.int64()),
                        pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays + ([pa.array(own, pa.binary())] if with_ids else []), schema=schema)
                    at = to

    return shards.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").mapInArrow(read, rows)
