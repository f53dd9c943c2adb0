import hashlib
import io
import wave
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oddsmith.llm import audio


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip_with_another_reader(data):
    payload = audio.payload_of(data)
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload.startswith(data) and set(payload[len(data) :]) <= {255}
    media = audio.to_wav(payload)
    with wave.open(io.BytesIO(media)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, 16000) and w.readframes(10**6) == payload
    assert audio.from_wav(media) == (payload, 16000)


def test_damaged_files_are_errors():
    for bad in (b"", b"RIFF1234WAVE", audio.to_wav(b"abcd")[:-2], audio.to_wav(b"abcd").replace(b"data", b"dada")):
        with pytest.raises(ValueError):
            audio.from_wav(bad)


def test_polyphase_equals_filter_then_drop():
    x = np.random.default_rng(1).normal(size=1001)
    for down in (2, 3, 4):
        taps = audio._low_pass(down)
        assert np.allclose(audio.resample(x, down), np.convolve(x, taps, "same")[::down])
    tone = np.sin(2 * np.pi * 500 * np.arange(8000) / 16000)
    assert np.allclose(audio.resample(tone)[50:-50], np.sin(2 * np.pi * 500 * np.arange(4000) / 8000)[50:-50], atol=2e-2)


def test_mel_band_of_a_tone():
    f = audio.Features()
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)).astype(np.uint8).tobytes()
    centre = np.argmax(audio.mel_filters(f.rate)[:, round(1000 * audio.FFT / f.rate)])
    assert f.log_mel(tone).mean(axis=0).argmax() == centre


def brute_hysteresis(e, on, off):
    found, start = [], None
    for i, v in enumerate(e):
        if start is None and v >= on:
            start = i
        elif start is not None and v < off:
            found.append((start, i))
            start = None
    return found + ([(start, len(e))] if start is not None else [])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([-1.0, 0.0, 1.0]), max_size=20))
def test_hysteresis(e):
    assert audio.hysteresis(np.array(e), 0.5, -0.5) == brute_hysteresis(e, 0.5, -0.5)


def brute_feature(payload):
    """The feature string and spans of a payload by plain formulas over the whole recording."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    taps = audio._low_pass(2)
    x = np.convolve(np.pad(x, 16), taps, "same")[16 : 16 + len(x)][::2]
    n = max(1, int(np.ceil((len(x) - 200) / 80)) + 1)
    x = np.pad(x, (0, max(0, 200 + (n - 1) * 80 - len(x))))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(200) / 200)
    mel = np.log(np.abs(np.fft.rfft(np.array([x[80 * i : 80 * i + 200] * window for i in range(n)]), 256)) ** 2 @ audio.mel_filters(8000).T + 1e-6)
    energy = mel.mean(axis=1)
    spans = brute_hysteresis(energy - energy.mean(), audio.ON, audio.OFF)
    inside = np.concatenate([mel[a:b] for a, b in spans]) if spans else np.zeros((0, 24))
    shown = lambda v: ",".join(f"{y + 0.0:.2f}" for y in v)
    tensors = sum(-(-min(audio._BLOCK, b - s) // 32) for a, b in spans for s in range(a, b, audio._BLOCK))
    text = f"frames={n};segments={len(spans)};tensors={tensors};active={len(inside) / n:.4f};mel={shown(mel.mean(axis=0))};active_mel={shown(inside.mean(axis=0)) if len(inside) else ''}"
    return text, [(a * 80 / 8000, ((b - 1) * 80 + 200) / 8000) for a, b in spans]


def test_blocks_equal_the_whole(monkeypatch):
    rng, f = np.random.default_rng(3), audio.Features()
    for size in (576, 5760, 57600):
        payload = rng.integers(0, 256, size, np.uint8).tobytes()
        whole = f.log_mel(payload)
        kept = audio.Recording(payload, f)
        monkeypatch.setattr(audio, "_BLOCK", 32)
        parts = np.concatenate([b for _, b in f.blocks(payload)])
        assert np.allclose(whole, parts, atol=1e-9)
        again = audio.Recording(payload, f)
        assert again.spans == kept.spans and [t[:3] for t in again.tensors()] == [t[:3] for t in kept.tensors()]
        assert all(np.allclose(a[3], b[3]) for a, b in zip(again.tensors(), kept.tensors(), strict=True))
        monkeypatch.undo()


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é" * 300, None), (3, "é" * 300, "y"), (None, "loud and quiet " * 40 + "\0" * 3000, "z"), (5, "long text " * 60000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    media = audio.stored(docs)
    rows_found = audio.media_digests(media).collect()
    found = {(r.doc_id, r.n_bytes): r for r in rows_found}
    assert len(rows_found) == 6 and len(found) == 5
    for doc, text, _ in rows:
        data = (text or "").encode()
        r = found[doc, len(data)]
        payload = audio.payload_of(data)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(payload) + 44 and r.media_sha256 == hashlib.sha256(audio.to_wav(payload)).hexdigest()
    assert found[1, 0].feature == found[2, 0].feature and len({r.feature for r in found.values()}) == 4
    for r in found.values():
        assert (r.feature, [tuple(x) for x in r.spans]) == brute_feature(audio.payload_of(dict(((d, len((t or "").encode())), (t or "").encode()) for d, t, _ in rows)[r.doc_id, r.n_bytes]))
    tensors = audio.segment_tensors(media)
    table = audio.as_fixed_shape(tensors.toArrow())
    assert table.num_rows > 0 and table["log_mel"].chunk(0).to_numpy_ndarray().shape[1:] == (audio.FRAMES, audio.MELS)
    for r in tensors.collect():
        assert 0 <= r.start_s < r.end_s and 1 <= r.n_frames <= audio.FRAMES and len(r.log_mel) == audio.FRAMES * audio.MELS
    assert len({(r.doc_id, r.part) for r in tensors.collect() if r.doc_id == 5}) == int(found[5, 600000].feature.split("tensors=")[1].split(";")[0])
    assert audio.media_digests(audio.stored(docs.limit(0))).count() == 0
    assert audio.segment_tensors(media.where("doc_id = 1").withColumn("media", media.media.substr(1, 0).cast("binary")).where("media is null")).count() == 0


def test_every_sample_is_in_a_frame():
    f = audio.Features()
    for size in (1, 399, 400, 401, 559, 560, 561, 576, 2304):
        quiet = bytes([128]) * size
        frames = len(f.log_mel(quiet))
        n = -(-size // audio.DOWN)
        assert (frames - 1) * audio.HOP + audio.FRAME >= n and (frames == 1 or (frames - 2) * audio.HOP + audio.FRAME < n)
    end = audio.payload_of(b"text " * 460)
    other = end[:-40] + bytes(255 - b for b in end[-40:])
    assert not np.allclose(f.log_mel(end), f.log_mel(other), atol=1e-3)
