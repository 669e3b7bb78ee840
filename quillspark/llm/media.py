"""Media columns: WAV files by the wave module, short-time Fourier transforms and spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the 8-bit samples of a mono WAV file. The
stored bytes are read back with the wave module; all features come from what was read. Rows are independent, so a lost
executor costs the rows of its tasks and nothing is shuffled.

Null and empty texts: 64 zero bytes. Equal texts give equal values, since a file is a function of its text alone. Other
columns of the input are not read. Very long texts are transformed whole, by blocks of frames. Repeated rows are rows of their own. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import id_and_bytes, map_texts

UNIT = 64
RATE = 8000
FRAME, HOP = 256, 128
#: Frames that are transformed at once.
BLOCK = 4096
#: Peaks that a frame gives at most, and how many later peaks one is paired with, within so many frames.
PEAKS, FAN, ZONE = 2, 3, 63
#: A peak must reach so many times the mean magnitude of its frame.
PROMINENCE = 2.0


def to_wav(text: bytes) -> bytes:
    """The WAV file of a text."""
    payload = text + bytes(-len(text) % UNIT if text else UNIT)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequency bins of the peaks, by frame, then bin. A peak is the largest magnitude among its neighbours of
    two bins and one frame on either side, and prominent; a frame keeps the PEAKS largest, ties to the lower bin. Works
    through the frames in blocks that overlap by a frame, so memory doesn't grow with the text."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    window = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)
    times, bins = [], []
    for start in range(0, n, BLOCK):
        lo, hi = max(0, start - 1), min(n, start + BLOCK + 1)
        part = x[lo * HOP : (hi - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (hi - lo - 1) * HOP + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * window
        # whole steps of 1/16: what rounding does in the last bits of a transform stays without effect
        m = np.rint(np.abs(np.fft.rfft(frames, axis=1)[:, 1:-1]) * 16).astype(np.int64)
        near = np.pad(m, ((1, 1), (2, 2)), constant_values=-1)
        top = near[1:-1, 2:-2] >= PROMINENCE * m.mean(axis=1, keepdims=True)
        for dt in (0, 1, 2):
            for df in range(5):
                if (dt, df) != (1, 2):
                    top &= m >= near[dt : dt + len(m), df : df + m.shape[1]]
        top &= m > 0
        t, f = np.nonzero(top)
        order = np.lexsort((f, -m[t, f], t))
        t, f = t[order], f[order]
        first = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)
        rank = np.arange(len(t)) - np.maximum.accumulate(np.where(first, np.arange(len(t)), 0)) if len(t) else t
        own = (rank < PEAKS) & (t + lo >= start) & (t + lo < start + BLOCK)
        times.append(t[own] + lo)
        bins.append(f[own] + 1)
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def pair_fingerprints(samples: bytes) -> np.ndarray:
    """Time-coded pair fingerprints, sorted: frame << 24 | first bin << 14 | second bin << 6 | distance in frames."""
    t, f = spectral_peaks(samples)
    out = []
    for k in range(1, FAN + 1):
        d = t[k:] - t[:-k]
        use = d <= ZONE
        out.append((t[:-k] << 24 | f[:-k] << 14 | f[k:] << 6 | d)[use])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


COLUMNS = {
    "media": "binary", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long",
    "media_bytes": "long", "media_sha256": "string", "fingerprints": "array<long>", "feature": "string",
}


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """doc_id and the asked ``columns`` for each row: ``media`` is the WAV file; ``fingerprints`` the time-coded pairs;
    ``feature`` their number and SHA-256; the rest describe the text, the samples read back and the file."""

    def make():
        def work(ids: list, texts: list[bytes]) -> dict:
            out: dict = {"doc_id": ids} | {c: [] for c in columns}
            for text in texts:
                media = to_wav(text)
                payload = from_wav(media)
                prints = pair_fingerprints(payload) if {"fingerprints", "feature"} & out.keys() else None
                row = {
                    "media": lambda: media,
                    "n_bytes": lambda: len(text),
                    "payload_bytes": lambda: len(payload),
                    "payload_sha256": lambda: hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": lambda: zlib.crc32(payload[-UNIT:]),
                    "media_bytes": lambda: len(media),
                    "media_sha256": lambda: hashlib.sha256(media).hexdigest(),
                    "fingerprints": lambda: prints,
                    "feature": lambda: f"{len(prints)}:{hashlib.sha256(prints.astype('<i8').tobytes()).hexdigest()}",
                }
                for c in columns:
                    out[c].append(row[c]())
            return out

        return work

    return map_texts(id_and_bytes(df, id_col, text_col), "doc_id long, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns), make)
