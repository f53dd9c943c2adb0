"""Media columns: 8-bit audio, its log-mel features and energy segments with time spans.

A payload is stored as mono unsigned 8-bit PCM in a RIFF container, in a column of a Parquet table. Everything else
comes from what is read back from there: polyphase resampling to half the rate, overlapped Hann frames, a triangular mel
filterbank and its logarithm, and segments found by hysteresis on frame energy. Each stretch of a segment becomes a
tensor of the fixed shape FRAMES x MELS with its time span.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import crc, materialize, small_batches, utf8_list

RATE, DOWN = 16000, 2
FRAME, HOP, FFT = 200, 80, 256
MELS, FRAMES = 24, 32
PAD_TO = 576
#: A segment starts above the upper and ends below the lower of these mean log energies relative to the recording's mean.
ON, OFF = 0.15, -0.05
FLOOR = 1e-6
_BLOCK = 4096


def payload_of(data: bytes | None) -> bytes:
    """The bytes, padded with 255 to a positive multiple of PAD_TO."""
    data = data or b""
    return data + b"\xff" * ((-len(data)) % PAD_TO if data else PAD_TO)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono unsigned 8-bit PCM; an odd payload gets the container's pad byte."""
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload))
    body = b"WAVE" + head + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of mono unsigned 8-bit PCM; other chunks are passed over, anything else is an error."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono unsigned 8-bit PCM")
        elif name == b"data":
            if rate is None or at + 8 + size > len(media):
                raise ValueError("truncated or without a format")
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _low_pass(down: int, width: int = 8):
    """Windowed-sinc taps, 2 * width * down + 1 of them, with unit gain."""
    import numpy as np

    n = np.arange(-width * down, width * down + 1)
    taps = np.sinc(n / down) * np.hanning(len(n) + 2)[1:-1]
    return taps / taps.sum()


def resample(samples, down: int = DOWN, taps=None):
    """Polyphase decimation of a whole signal, with silence before and after it."""
    import numpy as np

    taps = _low_pass(down) if taps is None else taps
    half = len(taps) // 2
    return _polyphase(np.pad(samples, (half, half + down)), down, taps, -(-len(samples) // down))


def _polyphase(padded, down: int, taps, n_out: int):
    """n_out outputs, the first over the first len(taps) samples: each phase of the filter meets its own phase of the samples, at the lower rate only."""
    import numpy as np

    out = np.zeros(n_out)
    for phase in range(down):
        own = taps[phase::down]
        lane = padded[phase::down][: n_out + len(own) - 1]
        lane = np.pad(lane, (0, n_out + len(own) - 1 - len(lane)))
        out += np.convolve(lane, own[::-1], "valid")
    return out


def mel_filters(rate: int, n_fft: int = FFT, n_mels: int = MELS):
    """Triangular filters, evenly spaced on the mel scale from 60 Hz to half the rate."""
    import numpy as np

    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), n_mels + 2) / 2595) - 1)
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    rise = (f[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall))


def hysteresis(energy, on: float, off: float) -> list[tuple[int, int]]:
    """Spans (first, end) that begin where energy reaches `on` and end where it next falls below `off`."""
    import numpy as np

    mark = np.where(energy >= on, 1, np.where(energy < off, -1, 0))
    at = np.flatnonzero(mark)
    if not len(at):
        return []
    state = np.zeros(len(energy), np.int8)
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(energy)), -1))
    state[last >= 0] = mark[last[last >= 0]] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], state, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


class Features:
    """Filters and windows made once; log_mel and segments of one recording after another."""

    def __init__(self, rate: int = RATE):
        import numpy as np

        self.rate = rate // DOWN
        self.taps, self.window = _low_pass(DOWN), np.hanning(FRAME + 1)[:-1]
        self.mel = mel_filters(self.rate).T.copy()

    def frames(self, samples: bytes) -> int:
        """Frames that cover all samples; the last frame, or the only one, is padded with silence."""
        return max(1, 1 - (FRAME - -(-len(samples) // DOWN)) // HOP)

    def log_mel(self, samples: bytes, first: int = 0, end: int | None = None):
        """(frames, MELS) log energies of the frames from first to end, from the samples that they need and no others."""
        import numpy as np

        end = self.frames(samples) if end is None else end
        half = len(self.taps) // 2
        lo, hi = DOWN * first * HOP, DOWN * ((end - 1) * HOP + FRAME)  # samples under the frames
        own = np.frombuffer(samples, np.uint8)[max(0, lo - half) : hi + half + DOWN]
        own = (own.astype(np.float64) - 128) / 128
        own = np.pad(own, (max(0, half - lo), max(0, hi + half + DOWN - max(len(samples), 0))))[: hi - lo + 2 * half + DOWN]
        n = end - first
        x = _polyphase(own, DOWN, self.taps, (n - 1) * HOP + FRAME)
        x[max(0, -(-len(samples) // DOWN) - first * HOP) :] = 0  # silence after the recording
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
        power = np.abs(np.fft.rfft(frames * self.window, FFT)) ** 2
        return np.log(power @ self.mel + FLOOR)

    def blocks(self, samples: bytes) -> Iterator:
        """(first frame, log_mel) in blocks of _BLOCK frames: bounded memory for recordings of any length."""
        n = self.frames(samples)
        for first in range(0, n, _BLOCK):
            yield first, self.log_mel(samples, first, min(n, first + _BLOCK))

    def segments(self, energy) -> list[tuple[int, int]]:
        return hysteresis(energy - energy.mean(), ON, OFF)


class Recording:
    """What was found in one stored recording: the energy of its frames, its band means and its segments.

    Log-mel frames are kept up to _BLOCK of them, and computed again from the samples beyond that.
    """

    def __init__(self, samples: bytes, features: Features):
        import numpy as np

        self.samples, self.features = samples, features
        energy, bands, self._kept = [], np.zeros(MELS), None
        for _, block in features.blocks(samples):
            energy.append(block.mean(axis=1).astype(np.float32))
            bands += block.sum(axis=0)
            self._kept = block if len(energy) == 1 else None
        self.n_frames = sum(map(len, energy))
        self.bands = bands / self.n_frames
        self.spans = features.segments(np.concatenate(energy))

    def tensors(self) -> Iterator:
        """(first second, last second, frames in it, FRAMES x MELS tensor) along each segment; the last is padded with the floor."""
        import numpy as np

        rate = self.features.rate
        for first, end in self.spans:
            for start in range(first, end, _BLOCK):
                stop = min(end, start + _BLOCK)
                block = self.features.log_mel(self.samples, start, stop) if self._kept is None else self._kept[start:stop]
                for at in range(0, stop - start, FRAMES):
                    own = block[at : at + FRAMES]
                    held = np.full((FRAMES, MELS), np.log(FLOOR), np.float32)
                    held[: len(own)] = own
                    yield (start + at) * HOP / rate, ((start + at + len(own) - 1) * HOP + FRAME) / rate, len(own), held

    def summary(self) -> str:
        """Frames, segments, tensors, the share of frames in segments, the mean of each band, and that over the tensors, to two places."""
        import numpy as np

        inside, count, real = np.zeros(MELS), 0, 0
        for _, _, n, tensor in self.tensors():
            inside += tensor[:n].sum(axis=0, dtype=np.float64)
            count, real = count + 1, real + n
        shown = lambda v: ",".join(f"{x + 0.0:.2f}" for x in v)
        active = shown(inside / real) if real else ""
        return f"frames={self.n_frames};segments={len(self.spans)};tensors={count};active={real / self.n_frames:.4f};mel={shown(self.bands)};active_mel={active}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the recording to store for every row, and the bytes of its text.

    Null and empty texts are one pad unit of 255. Equal texts give equal recordings; repeated rows stay; an empty table
    gives an empty one; other columns are dropped. Texts are handled one at a time.
    """

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in small_batches(batch, 1):
                texts = utf8_list(part.column(1))
                media = pa.array([to_wav(payload_of(x)) for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x or b"") for x in texts], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_column written to the shared folder as Parquet and read back."""
    return materialize(media_column(docs, id_col, text_col), "media")


def media_digests(recordings: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, spans) for every stored recording.

    All but n_bytes come from the stored bytes: the payload is what the container holds, feature summarises log-mel
    frames, segments and tensors, spans are the segments' first and last seconds. Null media have nulls; equal
    recordings give equal values; repeated rows stay; an empty table gives an empty result.
    """

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features()
        span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), span)
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "spans"]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in small_batches(batch, 2):
                out = []
                for cell in part.column(2):
                    media = cell.as_py()
                    if media is None:
                        out.append((None,) * len(kinds))
                        continue
                    payload, _ = from_wav(media)
                    r = Recording(payload, features)
                    seconds = [{"start_s": a * HOP / features.rate, "end_s": ((b - 1) * HOP + FRAME) / features.rate} for a, b in r.spans]
                    out.append((len(payload), sha(payload), crc(payload[-32:]), len(media), sha(media), r.summary(), seconds))
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "n_bytes", *names])

    rows = recordings.select("doc_id", "n_bytes", "media")
    found = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, spans array<struct<start_s:double,end_s:double>>"
    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, {found}")


def segment_tensors(recordings: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, part, start_s, end_s, n_frames, log_mel) per stretch of an energy segment of stored recordings.

    log_mel is a FRAMES x MELS tensor, row by row; n_frames of its rows are real, the rest are the floor. Null media
    have no rows; a recording of even energy has none either. Repeated recordings have their rows each; an empty table
    gives an empty result; other columns are dropped.
    """

    def each(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        features = Features()
        names = ["doc_id", "part", "start_s", "end_s", "n_frames", "log_mel"]
        for batch in batches:
            for part in small_batches(batch, 1):
                for doc, media in zip(part.column(0), part.column(1), strict=True):
                    if media.as_py() is None:
                        continue
                    found, at = Recording(from_wav(media.as_py())[0], features).tensors(), 0
                    while own := list(islice(found, 1024)):
                        flat = pa.array(np.concatenate([t.reshape(-1) for *_, t in own]))
                        tensors = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * FRAMES * MELS, flat)
                        ids = pa.array([doc.as_py()] * len(own), part.column(0).type)
                        start, end, n = (pa.array(c, k) for c, k in zip(list(zip(*own, strict=True))[:3], (pa.float64(), pa.float64(), pa.int64()), strict=True))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(range(at, at + len(own)), pa.int64()), start, end, n, tensors], names=names)
                        at += len(own)

    rows = recordings.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part bigint, start_s double, end_s double, n_frames bigint, log_mel array<float>")


def as_fixed_shape(table):
    """An Arrow table of segment_tensors (from toArrow or Parquet) with log_mel as Arrow's fixed-shape tensors."""
    import pyarrow as pa

    kind = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
    chunks = [pa.ExtensionArray.from_storage(kind, c.cast(kind.storage_type)) for c in table["log_mel"].chunks]
    at = table.column_names.index("log_mel")
    return table.set_column(at, pa.field("log_mel", kind), pa.chunked_array(chunks, kind))
