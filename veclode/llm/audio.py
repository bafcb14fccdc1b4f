"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV files, expanded to resampled PCM.

encode_media stores each text's bytes, padded with 255 to a positive multiple of 576, unchanged as the
samples of one WAV file (8 kHz, mono): as 8-bit mu-law or A-law samples, or as the 4-bit samples of
ADPCM blocks of 288 bytes behind a neutral 4-byte header each. codec="mixed" takes one of the three by
the payload's CRC, so equal texts are stored alike. decode_media parses the stored file, returns its
payload, expands it (two 256-entry lookup tables, or one numpy step for each sample position over all
blocks of a batch), resamples to 16 kHz by linear interpolation and describes the PCM; with pcm=True
it also returns it as a WAV file.

Definitions: a null or empty text has n_bytes 0 and a payload of 576 bytes 255; rows never depend on
each other; other columns pass through and those named like an output are replaced; channels of mu-law and
A-law files are averaged, and files of any rate from 1 to 192 kHz are resampled; bytes that are no such WAV file
(ADPCM of several channels and files that are cut short included) decode to nulls. A file's own length bounds the memory of its row; rows are handled
about 2 MB at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bytesops as B
from .store import map_in_arrow

UNIT, BLOCK, RATE, TARGET = 576, 288, 8000, 16000
ALAW, MULAW, ADPCM = 6, 7, 17  # WAV format tags

#: The IMA ADPCM step sizes and index moves.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit PCM of each mu-law byte (G.711)."""
    x = ~np.arange(256, dtype=np.int32) & 255
    value = (((x & 15) << 3) + 132 << (x >> 4 & 7)) - 132
    return np.where(x & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of each A-law byte (G.711)."""
    x = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = x >> 4 & 7, (x & 15) << 4
    value = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(x & 128, value, -value).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def adpcm_pcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (rows of bytes with a 4-byte header): the header's sample, then two for each byte."""
    predictor = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((2 * (blocks.shape[1] - 4) + 1, len(blocks)), np.int16)
    out[0] = predictor
    for k, byte in enumerate(np.ascontiguousarray(blocks[:, 4:].T)):
        for half, nibble in ((0, byte & 15), (1, byte >> 4)):
            step = STEPS[index]
            move = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
            predictor = np.clip(np.where(nibble & 8, predictor - move, predictor + move), -32768, 32767)
            index = np.clip(index + MOVES[nibble], 0, 88)
            out[1 + 2 * k + half] = predictor
    return out.T


def wav(tag: int, payload: bytes) -> bytes:
    """A WAV file that holds the payload as samples of the format."""
    if tag == ADPCM:
        raw = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
        data = np.concatenate([np.zeros((len(raw), 4), np.uint8), raw], axis=1).tobytes()
        per_block = 2 * BLOCK + 1
        fmt = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * (BLOCK + 4) // per_block, BLOCK + 4, 4, 2, per_block)
        samples = len(raw) * per_block
    else:
        data, fmt, samples = payload, struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0), len(payload)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def pcm_wav(samples: np.ndarray, rate: int = TARGET) -> bytes:
    data = samples.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def chunks(media: bytes | None) -> dict[bytes, bytes]:
    """The chunks of a RIFF/WAVE file; {} if it is none or is cut short."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return {}
    found, at = {}, 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            return {}
        found[name] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return found


def resample(pcm: np.ndarray, rate: int = RATE) -> np.ndarray:
    """The samples at TARGET, by linear interpolation between neighbours (the last one is held)."""
    place = np.arange(len(pcm) * TARGET // rate) * rate
    at, part = place // TARGET, place % TARGET
    wide = pcm.astype(np.int64)
    return ((wide[at] * (TARGET - part) + wide[np.minimum(at + 1, len(pcm) - 1)] * part) // TARGET).astype(np.int16)


def describe(pcm: np.ndarray, tag: int) -> str:
    """Format, samples, loudness, peak and zero crossings of resampled PCM, from exact integer sums."""
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"fmt={tag};rate={TARGET};n={len(pcm)};sum={int(wide.sum())};energy={int((wide * wide).sum()) // len(pcm)};peak={int(np.abs(wide).max())};zc={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def _schema(df: DataFrame, more: str) -> tuple[T.StructType, list[str]]:
    fields = T._parse_datatype_string(more).fields
    names = [f.name for f in fields]
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + fields), names


def _out(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c.lower() not in names]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *arrays], names=[*kept, *names])


def encode_media(df: DataFrame, text: str = "text", codec: str = "mixed") -> DataFrame:
    """df with n_bytes long and media binary (a WAV file). codec: mulaw, alaw, adpcm or mixed."""
    tags = {"mulaw": [MULAW], "alaw": [ALAW], "adpcm": [ADPCM], "mixed": [MULAW, ALAW, ADPCM]}[codec]
    schema, names = _schema(df, "n_bytes long, media binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.pieces(batches, text, 2 << 20):
            data, at = B.utf8(batch.column(batch.schema.get_field_index(text)))
            raw, files = data.tobytes(), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                payload = raw[a:b] + b"\xff" * (-(b - a) % UNIT or UNIT * (a == b))
                files.append(wav(tags[zlib.crc32(payload) % len(tags)], payload))
            yield _out(batch, names, [pa.array(np.diff(at), pa.int64()), pa.array(files, pa.binary())])

    return map_in_arrow(df, run, schema)


def _decode(files: list[bytes | None]) -> list[tuple[bytes, int, np.ndarray, int] | None]:
    """(payload, format, mono PCM, rate) of each file; the ADPCM blocks of all files of a size are decoded together."""
    out: list = [None] * len(files)
    blocks: dict[int, list[tuple[int, np.ndarray, int]]] = {}
    for i, media in enumerate(files):
        found = chunks(media)
        fmt, data = found.get(b"fmt ", b""), found.get(b"data", b"")
        if len(fmt) < 16 or not data:
            continue
        tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", fmt)
        samples = np.frombuffer(data, np.uint8)
        if not 1000 <= rate <= 192_000:
            continue
        if tag in (MULAW, ALAW) and bits == 8 and channels and len(data) % channels == 0:
            pcm = (MULAW_PCM if tag == MULAW else ALAW_PCM)[samples]
            if channels > 1:
                pcm = (pcm.reshape(-1, channels).sum(axis=1, dtype=np.int64) // channels).astype(np.int16)
            out[i] = (data, tag, pcm, rate)
        elif tag == ADPCM and bits == 4 and channels == 1 and align > 4 and len(data) % align == 0:
            blocks.setdefault(align, []).append((i, samples.reshape(-1, align), rate))
    for group in blocks.values():
        pcm = adpcm_pcm(np.concatenate([b for _, b, _ in group]))
        at = 0
        for i, b, rate in group:
            out[i] = (b[:, 4:].tobytes(), ADPCM, pcm[at : at + len(b)].ravel(), rate)
            at += len(b)
    return out


def decode_media(df: DataFrame, media: str = "media", pcm: bool = False) -> DataFrame:
    """df with payload binary (the stored samples), feature string and, if asked for, pcm binary (a 16 kHz WAV file)."""
    schema, names = _schema(df, "payload binary, feature string" + ", pcm binary" * pcm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.pieces(batches, media, 2 << 20):
            found = _decode(batch.column(batch.schema.get_field_index(media)).to_pylist())
            sound = [resample(x[2], x[3]) if x else None for x in found]
            arrays = [pa.array([x[0] if x else None for x in found], pa.binary()), pa.array([describe(s, x[1]) if x else None for x, s in zip(found, sound)], pa.string())]
            if pcm:
                arrays.append(pa.array([pcm_wav(s) if x else None for x, s in zip(found, sound)], pa.binary()))
            yield _out(batch, names, arrays)

    return map_in_arrow(df, run, schema)
