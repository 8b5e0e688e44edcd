"""Telephony audio (operator 2): G.711 by lookup tables, IMA ADPCM by numpy across blocks, resampled PCM.

Media are WAV bytes in a binary column.  mu-law (format 7) and A-law (format 6) samples are expanded by
256-entry tables built from their definitions; ADPCM blocks (format 17) are decoded one nibble at a time for
all blocks of a batch at once.  PCM is resampled from 8 to 16 kHz by an integer half-band filter, so results
don't depend on how texts share a batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitprint.llm.common import slices, stage_table, utf8_bytes

PAYLOAD_UNIT, FILL = 576, 255
RATE = 8000
MULAW, ALAW, ADPCM, PCM = 7, 6, 17, 1
#: Bytes of one ADPCM block: a header of 4 and then two samples a byte.
BLOCK = 192
#: The odd taps of the half-band filter, in units of 2**-15; they sum to 2**15.
HALF_BAND = np.array([-512, 2048, -5376, 20224, 20224, -5376, 2048, -512], dtype=np.float64)
# Fixed values of the IMA ADPCM format: how a nibble moves the step index, and the quantizer's 89 steps.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int64)


@cache
def step_sizes() -> np.ndarray:
    """The 89 step sizes of the IMA format: 7 to 32767, each a tenth more than the one before."""
    # Fixed values of the format.
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        dtype=np.int64,
    )


@cache
def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte: complemented, sign, 3 bits of exponent, 4 of mantissa, bias 132."""
    b = ~np.arange(256) & 0xFF
    size = ((((b & 0x0F) << 3) + 132) << ((b >> 4) & 7)) - 132
    return np.where(b & 0x80, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    """PCM of each A-law byte: every other bit inverted, sign, 3 bits of segment, 4 of mantissa."""
    b = np.arange(256) ^ 0x55
    segment, mantissa = (b >> 4) & 7, (b & 0x0F) << 4
    size = np.where(segment == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(segment - 1, 0))
    return np.where(b & 0x80, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA blocks, one row of bytes each; a first step index over 88 counts as 88."""
    raw = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.clip(blocks[:, 2].astype(np.int64), 0, 88)
    body = blocks[:, 4:]
    nibbles = np.stack([body & 15, body >> 4], axis=2).reshape(len(blocks), -1)
    steps = step_sizes()
    out = np.empty((len(blocks), nibbles.shape[1] + 1), dtype=np.int16)
    out[:, 0] = raw
    for k in range(nibbles.shape[1]):
        code = nibbles[:, k]
        step = steps[index]
        diff = step >> 3
        diff = diff + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        raw = np.clip(np.where(code & 8, raw - diff, raw + diff), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[:, k + 1] = raw
    return out


def encode_adpcm(pcm: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """IMA blocks of PCM, padded with its last value to whole blocks: the nearest nibble for each sample."""
    per = (block - 4) * 2 + 1
    n = max(1, -(-len(pcm) // per))
    x = np.concatenate([pcm, np.full(n * per - len(pcm), pcm[-1] if len(pcm) else 0, pcm.dtype)]).reshape(n, per).astype(np.int64)
    out = np.zeros((n, block), dtype=np.uint8)
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    value, steps = x[:, 0].copy(), step_sizes()
    index = np.minimum(np.searchsorted(steps, np.abs(np.diff(x[:, :8], axis=1)).max(axis=1, initial=0)), 88)  # a step that fits the first samples
    out[:, 2] = index
    for k in range(per - 1):
        step = steps[index]
        off = x[:, k + 1] - value
        size = np.minimum((np.abs(off) * 4) // step, 7)
        code = size | np.where(off < 0, 8, 0)
        diff = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(off < 0, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[:, 4 + k // 2] |= (code << (4 * (k % 2))).astype(np.uint8)
    return out


def wav(body: bytes, kind: int, rate: int = RATE, samples: int | None = None) -> bytes:
    """A mono WAV file of coded bytes."""
    bits = {MULAW: 8, ALAW: 8, ADPCM: 4, PCM: 16}[kind]
    align = BLOCK if kind == ADPCM else bits // 8
    extra = struct.pack("<HH", 2, (BLOCK - 4) * 2 + 1) if kind == ADPCM else b"" if kind == PCM else struct.pack("<H", 0)
    per_second = rate * align // ((BLOCK - 4) * 2 + 1) if kind == ADPCM else rate * align
    fmt = struct.pack("<HHIIHH", kind, 1, rate, per_second, align, bits) + extra
    fact = b"" if kind == PCM else b"fact" + struct.pack("<II", 4, len(body) if samples is None else samples)
    pad = b"\0" * (len(body) % 2)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(body)) + body + pad
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwrap(media: bytes) -> tuple[int, int, int, memoryview]:
    """Format, rate, block size and coded bytes of a WAV file; a ValueError says what is wrong with it."""
    view, at, found = memoryview(media), 12, {}
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        found[name] = view[at + 8 : at + 8 + size]
        if len(found[name]) < size:
            raise ValueError("a chunk ends early")
        at += 8 + size + size % 2
    if len(found.get(b"fmt ", b"")) < 16 or b"data" not in found:
        raise ValueError("no format or no data")
    kind, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    if channels != 1 or not align:
        raise ValueError("not one channel, or no block size")
    return kind, rate, align, found[b"data"]


def to_pcm(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of a WAV file in any of the four formats."""
    kind, rate, align, body = unwrap(media)
    raw = np.frombuffer(body, np.uint8)
    if kind == MULAW:
        return mulaw_table()[raw], rate
    if kind == ALAW:
        return alaw_table()[raw], rate
    if kind == ADPCM:
        if align < 4 or len(raw) % align:
            raise ValueError("a block ends early")
        return decode_adpcm(raw.reshape(-1, align)).ravel(), rate
    if kind == PCM:
        if len(raw) % 2:
            raise ValueError("a sample ends early")
        return raw.view("<i2").astype(np.int16), rate
    raise ValueError(f"unknown format {kind}")


def double_rate(pcm: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Twice the samples: those given, and between them the half-band filter's; each run from ``starts`` is on its own.

    Beyond a run's ends the signal is silent.  ``starts`` has one entry more than there are runs.
    """
    gap = len(HALF_BAND)
    n = np.diff(starts)
    at = np.arange(len(pcm)) + np.repeat(np.arange(len(n)) * gap, n)
    spread = np.zeros(len(pcm) + gap * len(n) + gap)
    spread[at + gap // 2] = pcm
    between = np.convolve(spread, HALF_BAND, mode="full")[at + gap]  # exact: whole numbers below 2**53
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(np.floor((between + 16384) / 32768), -32768, 32767)
    return out


def _signal(name: str, pcm: np.ndarray, starts: np.ndarray) -> list[str]:
    """Per run: name, samples, root mean square, peak, sign changes and crc32 of the PCM bytes."""
    cuts = starts[:-1]
    x = pcm.astype(np.int64)
    power = np.add.reduceat(x * x, cuts)
    peak = np.maximum.reduceat(np.abs(x), cuts)
    turn = np.append((x[1:] < 0) != (x[:-1] < 0), False)
    turn[starts[1:] - 1] = False
    turns = np.add.reduceat(turn.astype(np.int64), cuts)
    n = np.diff(starts)
    raw = memoryview(np.ascontiguousarray(pcm.astype("<i2"))).cast("B")
    crc = [zlib.crc32(raw[2 * a : 2 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    return [f"{name}:{c}:{(p / c) ** 0.5:.3f}:{k}:{t}:{z:08x}" for c, p, k, t, z in zip(n.tolist(), power.tolist(), peak.tolist(), turns.tolist(), crc, strict=True)]


def payloads(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Payload bytes of a column (text as UTF-8, filled to a positive multiple of the unit), their starts, and unfilled sizes."""
    raw, at = utf8_bytes(texts)
    size = np.diff(at)
    full = np.maximum(1, -(-size // PAYLOAD_UNIT)) * PAYLOAD_UNIT
    starts = np.concatenate([[0], np.cumsum(full)])
    out = np.full(starts[-1], FILL, dtype=np.uint8)
    out[np.arange(len(raw)) + np.repeat(starts[:-1] - at[:-1], size)] = raw
    return out, starts, size


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (mu-law WAV at 8 kHz) of each row's whole text; null is empty.

    Repeated rows stay; an empty table gives no rows; a null doc_id stays null.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            raw, starts, size = payloads(batch.column(1))
            media = [wav(raw[a:b].tobytes(), MULAW) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def resampled(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, media) with ``pcm``, a 16-bit WAV at twice the rate of each recording, and ``error``.

    A null recording has a null pcm and no error; of one that can't be read pcm is null and error says why.
    Null doc_ids and repeated rows stay; an empty table gives no rows.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 2 << 20):
            out, errors = [], []
            for m in batch.column(1).to_pylist():
                made, error = None, None
                try:
                    if m is not None:
                        pcm, rate = to_pcm(m)
                        made = wav(double_rate(pcm, np.array([0, len(pcm)])).astype("<i2").tobytes(), PCM, 2 * rate)
                except ValueError as e:
                    error = str(e)
                out.append(made)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "pcm", "error"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(convert, "doc_id long, pcm binary, error string")


def store_resampled(media: DataFrame, path: str) -> None:
    """Write :func:`resampled` as Parquet at ``path``."""
    resampled(media).write.option("compression", "zstd").parquet(path)


_DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of stored 8-bit recordings (doc_id, n_bytes, media).

    Rows are what :func:`encode_media` stored: media is never null there, null doc_ids and repeated rows stay,
    an empty table gives no rows.  feature joins what each decoder makes of the stored bytes: mu-law resampled to 16 kHz, A-law at 8 kHz
    and ADPCM in blocks of 192 bytes, as name:samples:rms:peak:sign changes:crc32 of the PCM.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 2 << 20):
            media = batch.column(2).to_pylist()
            bodies = [unwrap(m)[3] for m in media]
            starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
            raw = np.frombuffer(b"".join(bodies), np.uint8)
            adpcm = decode_adpcm(raw.reshape(-1, BLOCK))
            parts = [
                _signal("mulaw", double_rate(mulaw_table()[raw], starts), 2 * starts),
                _signal("alaw", alaw_table()[raw], starts),
                _signal("adpcm", adpcm.ravel(), starts // BLOCK * adpcm.shape[1]),
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.diff(starts)),
                    pa.array([hashlib.sha256(b).hexdigest() for b in bodies]),
                    pa.array([zlib.crc32(b[-32:]) for b in bodies], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array(["|".join(x) for x in zip(*parts, strict=True)]),
                ],
                names=[x.split()[0] for x in _DESCRIBED.split(", ")],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, _DESCRIBED)


def store_and_describe(docs: DataFrame) -> DataFrame:
    """Store every text (null: empty) as a recording in the shared folder, read it back and describe it (:func:`describe`)."""
    return describe(stage_table(encode_media(docs), "media"))
