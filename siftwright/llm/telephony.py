"""Telephony audio as a media column: mu-law, A-law and IMA ADPCM in WAV containers, decoded and resampled to PCM.

`store_audio` writes bytes as the samples (or ADPCM blocks) of a WAV file without changing them; `decode_audio` reads
such files back: it expands mu-law and A-law by lookup tables, decodes ADPCM with numpy over all blocks of a batch at
once (one step for each position inside a block; blocks of one size together), resamples to 16-bit PCM at the wanted
rate with a windowed-sinc filter, and stores that as a WAV file too. Files of several channels are taken apart and
put together again; the channels of an ADPCM block are decoded as blocks of their own.

Defined cases: null bytes count as empty; the payload is padded with bytes 255 to a positive multiple of 576, which is
whole samples and whole ADPCM blocks (36 bytes); files that are no such WAV, of an unknown format, or whose data are
no whole blocks give null outputs; equal inputs give equal files; ids may be of any type; very long inputs are decoded
in slices of whole files.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import type_of

UNIT = 576
PAD = 255
RATE = 8000
#: WAV format tags. Fixed values.
ALAW, MULAW, IMA_ADPCM = 6, 7, 17
NAMES = {ALAW: "alaw", MULAW: "mulaw", IMA_ADPCM: "ima_adpcm"}
BLOCK = 36
SAMPLES = (BLOCK - 4) * 2 + 1
SLICE = 1 << 20

#: Step sizes and index changes of IMA ADPCM. Fixed values.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law byte."""
    b = ~np.arange(256) & 255
    size = (((b & 15) << 3) + 132 << ((b >> 4) & 7)) - 132
    return np.where(b & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law byte."""
    b = np.arange(256) ^ 85
    exponent = (b >> 4) & 7
    size = np.where(exponent == 0, ((b & 15) << 4) + 8, ((b & 15) << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(b & 128, size, -size).astype(np.int16)


EXPAND = {MULAW: mulaw_table(), ALAW: alaw_table()}


def adpcm_decode(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """PCM of one-channel IMA ADPCM blocks, (blocks, samples) int16; the loop runs over positions, numpy over blocks."""
    blocks = data.reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.empty((2 * (block - 4), len(blocks)), np.int32)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for i, code in enumerate(codes):
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0)
        change += np.where(code & 2, step >> 1, 0)
        change += np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + CHANGES[code], 0, 88)
        out[i + 1] = value
    return out.T


def _half_band(taps: int = 8) -> np.ndarray:
    """Weights of the samples around a point half-way between two of them; they sum to one."""
    at = np.arange(taps) - taps / 2 + 0.5
    weights = np.sinc(at) * (0.5 + 0.5 * np.cos(np.pi * at / (taps / 2)))
    return (weights / weights.sum()).astype(np.float32)


HALF = _half_band()


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate: the samples, and between each two the filtered value."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    padded = np.pad(pcm.astype(np.float32), (len(HALF) // 2 - 1, len(HALF) // 2), "edge")
    out[1::2] = np.clip(np.rint(np.convolve(padded, HALF, "valid")), -32768, 32767)
    return out


def resample(pcm: np.ndarray, rate: int, target: int, taps: int = 16) -> np.ndarray:
    """PCM at another rate: a filter for each phase of the new samples between the old ones, low-passed where the rate falls."""
    if target == rate or not len(pcm):
        return pcm
    if target == 2 * rate:
        return resample_double(pcm)
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    band = min(1.0, up / down)
    half = math.ceil(taps / 2 / band)
    padded = np.pad(pcm.astype(np.float32), half, "edge")
    n, out = -(-len(pcm) * up // down), []
    for a in range(0, n, 1 << 15):
        place = np.arange(a, min(n, a + (1 << 15)), dtype=np.int64) * down
        base, offset = place // up, (place % up) / up
        at = np.arange(1 - half, half + 1)[None, :] - offset[:, None]
        weights = np.sinc(band * at) * (0.5 + 0.5 * np.cos(np.pi * np.clip(at / half, -1, 1)))
        weights /= weights.sum(axis=1, keepdims=True)
        near = padded[np.minimum(base[:, None] + np.arange(1, 2 * half + 1)[None, :], len(padded) - 1)]
        out.append(np.clip(np.rint((near * weights).sum(axis=1)), -32768, 32767).astype(np.int16))
    return np.concatenate(out)


def split_channels(data: bytes, channels: int, block: int) -> np.ndarray:
    """The blocks of a file with several ADPCM channels as one-channel blocks, all channels of a block in a row."""
    groups = np.frombuffer(data, np.uint8).reshape(len(data) // block, block // (4 * channels), channels, 4)
    return groups.transpose(0, 2, 1, 3).reshape(-1)


def pad_payload(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % UNIT if data else UNIT)


def codec_of(payload: bytes) -> int:
    """The format in which a payload is stored, chosen by its content alone."""
    return (MULAW, ALAW, IMA_ADPCM)[zlib.crc32(payload) % 3]


def wav_file(data: bytes, codec: int, rate: int = RATE, channels: int = 1, block: int = BLOCK) -> bytes:
    """A WAV file; codec 1 is 16-bit PCM, block the size of an ADPCM block."""
    if codec == IMA_ADPCM:
        spoken = 2 * (block // channels - 4) + 1
        extra, align, bits, per_s, samples = struct.pack("<HH", 2, spoken), block, 4, rate * block // spoken, len(data) // block * spoken
    else:
        width = 2 if codec == 1 else 1
        extra, align, bits, per_s, samples = struct.pack("<H", 0), width * channels, 8 * width, rate * width * channels, len(data) // (width * channels)
    fmt = struct.pack("<HHIIHH", codec, channels, rate, per_s, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass(frozen=True)
class Wav:
    """A file of a known format whose data are whole blocks."""

    codec: int
    channels: int
    rate: int
    block: int
    data: bytes


def read_wav(media: bytes) -> Wav | None:
    """The parts of a telephony WAV file, or None if it is none."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            return None
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data":
            if form is None or form[0] not in NAMES or not form[1] or not form[2] or not size:
                return None
            codec, channels, rate, _, block, bits = form
            if codec == IMA_ADPCM:
                whole = block > 4 * channels and block % (4 * channels) == 0 and bits == 4
            else:
                whole = block == channels and bits == 8
            return Wav(codec, channels, rate, block, media[at + 8 : at + 8 + size]) if whole and size % block == 0 else None
        at += 8 + size + (size & 1)
    return None


def store_audio(rows: DataFrame, id_col: str = "doc_id", data_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the bytes (a text's UTF-8) of every row in a WAV file of the format codec_of names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column(0), batch.column(1)
            at, room, sizes, files = 0, 0, [], []
            for i, cell in enumerate(data):
                raw = cell.as_buffer().to_pybytes() if cell.is_valid else b""
                payload = pad_payload(raw)
                sizes.append(len(raw))
                files.append(wav_file(payload, codec_of(payload)))
                room += len(payload)
                if room >= SLICE or i == len(data) - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, i + 1 - at), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    at, room, sizes, files = i + 1, 0, [], []

    own = rows.select(F.col(id_col).alias("doc_id"), F.col(data_col).cast("binary").alias("data"))
    return own.mapInArrow(run, f"{type_of(own, 'doc_id')}, n_bytes long, media binary")


def _features(codec: int, pcm: np.ndarray) -> str:
    wide = pcm.astype(np.float64)
    crossings = int(np.count_nonzero(np.diff(np.signbit(pcm).view(np.int8))))
    return f"{NAMES[codec]};samples={len(pcm)};mean={wide.mean():.3f};rms={np.sqrt((wide * wide).mean()):.3f};peak={int(np.abs(pcm.astype(np.int32)).max())};crossings={crossings}"


def decode_files(files: list[Wav | None], target_rate: int) -> list[np.ndarray | None]:
    """(samples, channels) of each file at the target rate; ADPCM blocks of one size are decoded together."""
    by: dict[int, list[int]] = {}
    for i, f in enumerate(files):
        if f and f.codec == IMA_ADPCM:
            by.setdefault(f.block // f.channels, []).append(i)
    spoken: dict[int, np.ndarray] = {}
    for block, own in by.items():
        parts = [split_channels(files[i].data, files[i].channels, files[i].block) for i in own]
        pcm = adpcm_decode(np.concatenate(parts), block)
        for i, rows in zip(own, np.split(pcm, np.cumsum([len(p) // block for p in parts])[:-1]), strict=True):
            spoken[i] = rows.reshape(-1, files[i].channels, pcm.shape[1]).transpose(1, 0, 2).reshape(files[i].channels, -1)
    out = []
    for i, f in enumerate(files):
        if f is None:
            out.append(None)
            continue
        each = spoken[i] if i in spoken else EXPAND[f.codec][np.frombuffer(f.data, np.uint8).reshape(-1, f.channels).T]
        out.append(np.stack([resample(np.ascontiguousarray(c), f.rate, target_rate) for c in each], axis=1))
    return out


def decode_audio(stored: DataFrame, media_col: str = "media", target_rate: int = 2 * RATE) -> DataFrame:
    """Columns of stored other than the media stay; payload, pcm (a WAV file at the target rate) and feature are added."""
    rest = [c for c in stored.columns if c != media_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(batch.num_columns - 1)
            at = 0
            while at < len(media):
                end, room, files = at, 0, []
                while end < len(media) and (end == at or room < SLICE):
                    files.append(read_wav(media[end].as_buffer().to_pybytes()) if media[end].is_valid else None)
                    room += len(files[-1].data) if files[-1] else 0
                    end += 1
                payload, pcm, feature = [], [], []
                for f, samples in zip(files, decode_files(files, target_rate), strict=True):
                    payload.append(f and f.data)
                    pcm.append(f and wav_file(samples.astype("<i2").tobytes(), 1, target_rate, f.channels))
                    feature.append(f and _features(f.codec, samples.ravel()))
                own = [batch.column(i).slice(at, end - at) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(payload, pa.binary()), pa.array(pcm, pa.binary()), pa.array(feature, pa.string())], names=[*rest, "payload", "pcm", "feature"])
                at = end

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name != media_col] + ["payload binary", "pcm binary", "feature string"])
    return stored.select(*rest, media_col).mapInArrow(run, schema)


def audio_digests(docs: DataFrame, id_col: str = "doc_id", data_col: str = "text") -> DataFrame:
    """The digest columns of every row's stored file and of what is read back from it."""
    stored = store_audio(docs, id_col, data_col).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    read = decode_audio(stored)
    size = F.length("payload")
    return read.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", F.sha2("pcm", 256).alias("pcm_sha256"))
