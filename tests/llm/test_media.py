import hashlib
import zlib

import numpy as np

from quillspark.llm import media


def test_round_trip_and_digests(odd, documents):
    for df in (odd, documents):
        texts = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
        got = media.media_columns(df).collect()
        want = sorted(texts)
        assert sorted((r["doc_id"], r["n_bytes"]) for r in got) == [(i, len(t)) for i, t in want]
        by_id = dict(texts)
        for r in got:
            text = by_id[r["doc_id"]]
            padded = text + b"\0" * (64 if not text else -len(text) % 64)
            assert media.from_wav(bytes(r["media"])) == padded and r["payload_bytes"] == len(padded)
            assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
            assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
            assert r["feature"].startswith(f"{len(r['fingerprints'])}:")


def test_blocks_do_not_change_fingerprints(monkeypatch):
    import random

    samples = bytes(random.Random(3).choices(b"abcdefgh ijklm\n", k=40_000))
    whole = media.pair_fingerprints(samples).tolist()
    monkeypatch.setattr(media, "BLOCK", 37)
    assert media.pair_fingerprints(samples).tolist() == whole and len(whole) > 100


def test_a_tone_peaks_at_its_bin():
    import numpy as np

    tone = (128 + 100 * np.sin(2 * np.pi * 32 * np.arange(4096) / 256)).astype(np.uint8).tobytes()
    t, f = media.spectral_peaks(tone)
    assert set(f.tolist()) == {32}


def test_empty_table(none):
    assert media.media_columns(none).count() == 0


def plain_fingerprints(samples):
    """A transform by its definition, in doubles, and plain loops."""
    n = max(1, -(-(len(samples) - media.FRAME) // media.HOP) + 1)
    k = np.arange(media.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * k / media.FRAME)
    waves = np.exp(-2j * np.pi * np.outer(np.arange(1, media.FRAME // 2), k) / media.FRAME)
    rows = []
    for t in range(n):
        frame = np.zeros(media.FRAME)
        part = np.frombuffer(samples[t * media.HOP : t * media.HOP + media.FRAME], np.uint8)
        frame[: len(part)] = part.astype(float) - 128
        rows.append([round(16 * abs(z)) for z in waves @ (frame * window)])
    peaks = []
    for t, row in enumerate(rows):
        own = []
        for f, m in enumerate(row):
            near = [rows[a][b] for a in range(max(0, t - 1), min(n, t + 2)) for b in range(max(0, f - 2), min(len(row), f + 3))]
            if m > 0 and m >= max(near) and m >= media.PROMINENCE * sum(row) / len(row):
                own.append((-m, f + 1))
        peaks += sorted((t, f) for _, f in sorted(own)[: media.PEAKS])
    return [a[0] << 24 | a[1] << 14 | b[1] << 6 | b[0] - a[0] for i, a in enumerate(peaks) for b in peaks[i + 1 : i + 1 + media.FAN] if b[0] - a[0] <= media.ZONE]


def test_fingerprints_against_a_plain_transform():
    """The same pairs, but for what rounding in single precision moves across a half."""
    rng = np.random.default_rng(3)
    words = [b"the", b"quiet", b"river", b"runs", b"by", b"old", b"stones", b"\xc3\xa9t\xc3\xa9"]
    for size in (1, 60, 400, 3000):
        text = b" ".join(rng.choice(words, size))
        samples = media.from_wav(media.to_wav(text))
        got, want = set(media.pair_fingerprints(samples).tolist()), set(plain_fingerprints(samples))
        assert len(got & want) >= 0.97 * max(len(got | want), 1) - 1
