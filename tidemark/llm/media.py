"""Media columns: bytes as 8-bit WAV, short-time Fourier transforms and
spectral-peak pair fingerprints.

``to_wav``        a payload as an 8-bit mono WAV (the wave module writes it);
``from_wav``      the samples of such a file (the wave module reads it);
``stft``          magnitudes of Hann-windowed frames;
``fingerprint``   pairs of spectral peaks that stand near each other in time,
                  as an ascending array of 64-bit codes: time of the first
                  peak, its frequency, the second's, and the time between;
``media_columns`` documents -> media, payload and fingerprint columns, a row
                  at a time in each block, so memory is bounded by the longest
                  text.

Defined results: a null or empty text is 576 bytes 255; equal texts
give equal media and fingerprints; repeated rows and other columns pass
through untouched by each other.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, pick

#: Payloads are padded to a multiple of this many bytes.
UNIT = 576
#: Samples of a Fourier frame; half of it between frames.
FRAME = 288
RATE = 8000
#: Frequency bands (edges in bins) that give one peak each to a frame.
BANDS = (1, 12, 30, 60, 100, 145)
#: Frames after a peak in which its partners stand, and partners of a peak.
REACH = 3
FAN = 4

MEDIA = "doc_id long, n_bytes long, payload binary, media binary, fingerprint array<long>"


def payload(text: str | None) -> bytes:
    """UTF-8 with bytes 255 up to a positive multiple of ``UNIT``."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(rate)
        file.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        if file.getsampwidth() != 1 or file.getnchannels() != 1:
            raise ValueError("not an 8-bit mono WAV")
        return file.readframes(file.getnframes())


_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def stft(samples: bytes, hop: int = FRAME // 2, frame: int = FRAME) -> np.ndarray:
    """Magnitudes, a row a frame; frames start each ``hop`` samples."""
    wav = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    frames = np.lib.stride_tricks.sliding_window_view(wav, frame)[::hop]
    return np.abs(np.fft.rfft(frames * (_HANN if frame == FRAME else np.hanning(frame + 1)[:-1]), axis=1))


def peaks(spectrum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, bin): in each frame the largest bin of each band, where it is
    also larger than the frame's mean."""
    at = np.stack([low + spectrum[:, low:high].argmax(axis=1) for low, high in zip(BANDS[:-1], BANDS[1:], strict=True)], axis=1)
    strong = np.take_along_axis(spectrum, at, axis=1) > spectrum.mean(axis=1, keepdims=True)
    time, band = np.nonzero(strong)
    return time, at[time, band]


def fingerprint(samples: bytes) -> np.ndarray:
    """Ascending codes time << 32 | f1 << 20 | f2 << 8 | frames between, of each
    peak with the next ``FAN`` peaks within ``REACH`` later frames."""
    time, f = peaks(stft(samples))
    out = []
    later = np.searchsorted(time, time, side="right")  # first peak of a later frame
    for k in range(FAN):
        other = later + k
        ok = other < len(time)
        a, b = np.flatnonzero(ok), other[ok]
        ok = time[b] - time[a] <= REACH
        a, b = a[ok], b[ok]
        out.append(time[a].astype(np.int64) << 32 | f[a] << 20 | f[b] << 8 | (time[b] - time[a]))
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload (read back), media (WAV), fingerprint."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            media, back, codes, sizes = [], [], [], []
            for text in block.column("text").to_pylist():
                wav = to_wav(payload(text))
                media.append(wav)
                back.append(from_wav(wav))
                codes.append(fingerprint(back[-1]))
                sizes.append(len((text or "").encode()))
            ends = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(back, pa.binary()), pa.array(media, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(codes)))],
                names=["doc_id", "n_bytes", "payload", "media", "fingerprint"],
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(made, MEDIA)


def digests(media: DataFrame) -> DataFrame:
    """Small columns of ``media_columns``' rows; the payload is read out of the
    stored media once more."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pairs long"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, wav, codes in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"], batch["fingerprint"], strict=True):
                wav = wav.as_py()
                back = from_wav(wav)
                values = codes.values.to_numpy()
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(wav), hashlib.sha256(wav).hexdigest(), f"{len(values)}:{zlib.crc32(values.tobytes()):08x}", len(values)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media", "fingerprint").mapInArrow(made, schema)
