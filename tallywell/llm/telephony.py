"""Telephony audio: mu-law, A-law and IMA ADPCM in WAV containers, decoded with numpy and resampled to PCM.

A payload of bytes is stored without loss as the 8-bit samples of a G.711 WAV file, or as the 4-bit samples of IMA ADPCM
blocks (192 payload bytes after a 4-byte block header). Reading parses the container, expands mu-law and A-law by table,
steps through all ADPCM blocks of a batch at once, and doubles the sample rate with an integer half-band filter, so
equal payloads give equal bytes on every machine.

Defined cases: a null or empty text is a payload of 192 blanks; a null doc_id stays null; repeated rows give equal
values; long texts are worked on alone; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import steps

UNIT = 192
BLOCK = UNIT + 4
RATE = 8_000
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}

# Fixed values of the IMA ADPCM format.
STEP_SIZES = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Half-band filter in units of 1/32768; it sums to 16384 on either side.
TAPS = (20_238, -5_160, 1_683, -377)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {7: mulaw_table(), 6: alaw_table()}


def padded(text: bytes) -> bytes:
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text.ljust(size, b" ")


def store(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A WAV file whose samples are the payload; its size must be a multiple of UNIT."""
    tag = CODECS[codec]
    if tag == 0x11:
        blocks = np.zeros((len(payload) // UNIT, BLOCK), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, samples = blocks.tobytes(), len(blocks) * (2 * UNIT + 1)
        extra = struct.pack("<HH", 2, 2 * UNIT + 1)
        form = struct.pack("<HHIIHH", tag, 1, rate, rate * BLOCK // (2 * UNIT + 1), BLOCK, 4) + extra
    else:
        data, samples = payload, len(payload)
        form = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def load(media: bytes) -> tuple[int, int, bytes]:
    """(format tag, rate, data chunk) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def payload_of(tag: int, data: bytes) -> bytes:
    if tag == 0x11:
        return np.frombuffer(data, np.uint8).reshape(-1, BLOCK)[:, 4:].tobytes()
    return data


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (n, BLOCK) as samples (n, 2 * UNIT + 1), one step over all blocks at a time."""
    codes = np.empty((2 * UNIT, len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    now = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((2 * UNIT + 1, len(blocks)), np.int16)
    out[0] = now
    for i, code in enumerate(codes, 1):
        step = STEP_SIZES[index]
        move = step >> 3
        move += np.where(code & 4, step, 0)
        move += np.where(code & 2, step >> 1, 0)
        move += np.where(code & 1, step >> 2, 0)
        now = np.clip(np.where(code & 8, now - move, now + move), -32768, 32767)
        out[i] = now
        index = np.clip(index + INDEX_MOVES[code], 0, 88)
    return out.T


def decode(stored: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """The 16-bit samples of each (tag, data); the ADPCM blocks of all of them are decoded together."""
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(stored)
    coded = [i for i, (tag, _) in enumerate(stored) if tag == 0x11]
    if coded:
        blocks = np.frombuffer(b"".join(stored[i][1] for i in coded), np.uint8).reshape(-1, BLOCK)
        ends = np.cumsum([len(stored[i][1]) // BLOCK for i in coded])
        for i, own in zip(coded, np.split(adpcm_blocks(blocks), ends[:-1]), strict=True):
            out[i] = own.reshape(-1)
    for i, (tag, data) in enumerate(stored):
        if tag != 0x11:
            out[i] = TABLES[tag][np.frombuffer(data, np.uint8)]
    return out


def doubled(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples, and between them the half-band filter's values; silence lies outside."""
    reach = len(TAPS)
    x = np.zeros(len(samples) + 2 * reach, np.int32)
    x[reach:-reach] = samples
    n = len(samples)
    between = np.full(n, 1 << 14, np.int32)
    for j, tap in enumerate(TAPS):
        between += tap * (x[reach - j : reach - j + n] + x[reach + 1 + j : reach + 1 + j + n])
    out = np.empty(2 * n, np.int16)
    out[0::2], out[1::2] = samples, np.clip(between >> 15, -32768, 32767)
    return out


def feature(codec: str, samples: np.ndarray, pcm: np.ndarray) -> str:
    wide = samples.astype(np.int64)
    crossings = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
    return (
        f"codec={codec};samples={len(samples)};peak={int(np.abs(wide).max())};energy={int((wide * wide).sum())};"
        f"crossings={crossings};pcm_samples={len(pcm)};pcm_crc32={zlib.crc32(pcm.tobytes())}"
    )


def transcoded(docs: DataFrame, codec: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Store each text as telephony audio, read it back, decode and resample it.

    codec None: one of the three by the payload's checksum. keep: of "media" (the WAV file) and "pcm" (16-bit samples at
    twice the rate), the binary columns to return beside the digests.
    """
    if unknown := set(keep) - {"media", "pcm"}:
        raise ValueError(f"cannot keep {sorted(unknown)}")
    names = list(CODECS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", 1 << 20):
                texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                chosen = [codec or names[zlib.crc32(padded(x)) % len(names)] for x in texts]
                media = [store(padded(x), c) for x, c in zip(texts, chosen, strict=True)]
                back = [(tag, data) for tag, _, data in map(load, media)]
                payloads = [payload_of(*x) for x in back]
                samples = decode(back)
                pcm = [doubled(x) for x in samples]
                columns = {
                    "doc_id": part.column(0),
                    "n_bytes": pa.array([len(x) for x in texts], pa.int64()),
                    "payload_bytes": pa.array([len(x) for x in payloads], pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in payloads], pa.string()),
                    "tail_crc32": pa.array([zlib.crc32(x[-16:]) for x in payloads], pa.int64()),
                    "media_bytes": pa.array([len(x) for x in media], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()),
                    "feature": pa.array([feature(*x) for x in zip(chosen, samples, pcm, strict=True)], pa.string()),
                }
                if "media" in keep:
                    columns["media"] = pa.array(media, pa.binary())
                if "pcm" in keep:
                    columns["pcm"] = pa.array([x.astype("<i2").tobytes() for x in pcm], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += "".join(f", {name} binary" for name in ("media", "pcm") if name in keep)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
