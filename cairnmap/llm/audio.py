"""Media columns, audio: polyphase resampling, log-mel filterbanks over overlapping frames and segments by hysteresis on
frame energy, with features as fixed-shape tensors and segments as time spans.

Samples are 8-bit unsigned mono in WAV.  A clip is worked through in pieces of fixed length, so memory does not follow
its length.  Each clip is computed by itself and on its own samples only: equal samples give equal features.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .work import table

RATE_IN, UP, DOWN, TAPS = 16_000, 2, 3, 8
FRAME, HOP, MELS = 256, 128, 16
ENTER, LEAVE = 0.08, 0.03
UNIT, PIECE = 192, 1 << 16
#: Bytes of text whose features go out together (a longer text goes by itself).
BATCH = 2 << 20


def wav(samples: bytes, rate: int = RATE_IN) -> bytes:
    """8-bit mono WAV; an odd length gets the pad byte that RIFF asks for."""
    pad = len(samples) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * pad


def samples_of(stored: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit mono WAV; chunks other than fmt and data are skipped."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack("<I", stored[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", stored[at + 8 : at + 24])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif name == b"data":
            if rate is None or at + 8 + size > len(stored):
                break
            return stored[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@functools.cache
def _low_pass(up: int, down: int, taps: int) -> tuple[np.ndarray, np.ndarray]:
    half = taps * max(up, down) // 2
    t = np.arange(-half, half + 1)
    low = np.sinc(t / max(up, down)) * np.hamming(2 * half + 1)
    return t, low * (up / low.sum())


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up / down: a windowed-sinc low-pass whose phase p makes the outputs k with k * down = p
    (mod up); only outputs that are kept are computed."""
    n = -(-len(x) * up // down)
    t, low = _low_pass(up, down, taps)
    half = len(t) // 2
    out, before = np.zeros(n), half // up + 1
    padded = np.concatenate([np.zeros(before), x, np.zeros(before + down + 1)])
    turn = up // math.gcd(up, down)  # outputs k and k + turn have the same phase
    for k in range(min(turn, n)):
        at, phase = divmod(k * down, up)
        count, step = -(-(n - k) // turn), turn * down // up
        mine = (phase - t) % up == 0
        for lag, weight in zip(((phase - t[mine]) // up).tolist(), low[mine].tolist()):
            start = at + lag + before
            out[k::turn] += weight * padded[start : start + (count - 1) * step + 1 : step]
    return out


@functools.cache
def mel_bank(rate: float, size: int = FRAME, mels: int = MELS) -> np.ndarray:
    """(size // 2 + 1, mels) triangular filters, evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edge = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    freq = np.arange(size // 2 + 1)[:, None] * rate / size
    rise, fall = (freq - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - freq) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def hysteresis(energy: np.ndarray, enter: float = ENTER, leave: float = LEAVE) -> list[tuple[int, int]]:
    """Frame spans that start at ``enter`` or more and last until below ``leave``."""
    state = np.where(energy >= enter, 1, np.where(energy < leave, -1, 0))
    known = np.flatnonzero(state)
    if not len(known):
        return []
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = (last >= 0) & (state[last] == 1)
    change = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(change[::2].tolist(), change[1::2].tolist()))


_window = np.hanning(FRAME)


def analyse(samples: bytes, rate: int = RATE_IN, up: int = UP, down: int = DOWN) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(log-mel tensor of shape (frames, MELS), time spans in seconds of segments with energy).  Frames of FRAME
    samples; the end is padded with silence to the next whole frame, and spans end with the clip at the latest."""
    out_rate = rate * up / down
    bank = mel_bank(out_rate)
    x = np.frombuffer(samples, np.uint8)
    mels, energy = [], []
    n_out = -(-len(x) * up // down)
    frames = max(1, 1 + -(-(n_out - FRAME) // HOP)) if n_out else 0
    per, margin = PIECE // HOP, TAPS * max(up, down) * 2
    for f in range(0, frames, per):
        upto = min(frames, f + per)
        lo_out, hi_out = f * HOP, min(n_out, (upto - 1) * HOP + FRAME)
        # Pieces begin at multiples of up and down, with the filter's reach on both sides.
        lo_in = max(0, (lo_out * down // up - margin) // down * down)
        hi_in = min(len(x), -(-hi_out * down // up) + margin)
        y = resample((x[lo_in:hi_in].astype(np.float64) - 128) / 128, up, down)[lo_out - lo_in * up // down :][: hi_out - lo_out]
        whole = (upto - 1 - f) * HOP + FRAME
        if len(y) < whole:
            y = np.concatenate([y, np.zeros(whole - len(y))])
        view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(view * _window)) ** 2
        mels.append(np.log(power @ bank + 1e-10).astype(np.float32))
        energy.append(np.sqrt((view**2).mean(1)))
    if not frames:
        return np.zeros((0, MELS), np.float32), []
    step = HOP / out_rate
    spans = [(a * step, min((b - 1) * step + FRAME / out_rate, n_out / out_rate)) for a, b in hysteresis(np.concatenate(energy))]
    return np.concatenate(mels), spans


def tensors(mels: list[np.ndarray], frames: int) -> pa.Array:
    """Arrow fixed-shape tensors (frames, MELS): each clip cut or padded with NaN to ``frames``."""
    flat = np.full((len(mels), frames, MELS), np.nan, np.float32)
    for i, m in enumerate(mels):
        flat[i, : len(m)] = m[:frames]
    kind = pa.fixed_shape_tensor(pa.float32(), (frames, MELS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), frames * MELS))


def blocks_of(mel: np.ndarray, frames: int = 64) -> pa.Array:
    """A clip's whole log-mel matrix as a column of fixed-shape tensors, the last padded with NaN."""
    return tensors([mel[i : i + frames] for i in range(0, len(mel), frames)], frames)


def feature_digest(mel: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """Frames, segments and their length in milliseconds, and a hash of the tensors to a hundredth."""
    tensor = blocks_of(mel)
    body = np.round(tensor.storage.flatten().to_numpy(zero_copy_only=False), 2) + 0.0 if len(mel) else np.zeros(0, np.float32)
    return f"frames={len(mel)};segments={len(spans)};ms={round(1000 * sum(b - a for a, b in spans))};logmel={hashlib.sha256(body.astype('<f4').tobytes()).hexdigest()[:16]}"


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
SPANS = "frames int, spans array<struct<start: double, end: double>>, tensors array<array<float>>"


def clip_features(docs: DataFrame) -> DataFrame:
    """(doc_id long, text) -> STORED and SPANS, a row for each row: the text's bytes stored as sound, read back, and its
    features.  ``tensors`` are the log-mel values in blocks_of(): fixed-shape tensors of 64 frames by MELS, row by row, the
    last padded with NaN after ``frames`` frames in all; tensor_column() makes Arrow tensors of them.  ``spans`` are seconds.

    A null or empty text is stored as 192 blanks.  Bytes are padded with blanks to a positive multiple of 192; the stored
    form is lossless, so any bytes come back as they were.  Equal texts give equal rows but for doc_id, repeated rows come
    out each.  A very long text is one clip, worked through in pieces; its tensors make one row.  An empty table gives an
    empty result; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for lo, hi in tokens.slices(tokens.byte_lengths(batch.column(1)), BATCH):
                out, blocks = [], []
                data, offs = tokens.buffer_of(batch.column(1).slice(lo, hi - lo))
                for doc, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                    stored = wav(data[a:b].tobytes() + b" " * ((a - b) % UNIT if b > a else UNIT))
                    payload, rate = samples_of(stored)
                    mel, spans = analyse(payload, rate)
                    blocks.append(blocks_of(mel).storage)
                    out.append((doc, b - a, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), len(mel), [{"start": x, "end": y} for x, y in spans]))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())])))
                values = pa.concat_arrays(blocks).cast(pa.list_(pa.float32()))
                tensor = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, blocks)]), pa.int32()), values)
                names = [c.split(" ")[0] for c in f"{STORED}, frames int, spans".split(", ")]
                yield pa.RecordBatch.from_arrays([*(pa.array([o[i] for o in out], t) for i, t in enumerate(types)), tensor], names=[*names, "tensors"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{STORED}, {SPANS}")


def tensor_column(stored: pa.Array, frames: int = 64) -> pa.Array:
    """The ``tensors`` of clip_features as one column of Arrow fixed-shape tensors, clip after clip."""
    kind = pa.fixed_shape_tensor(pa.float32(), (frames, MELS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(stored.flatten().flatten(), frames * MELS))


def media_features(docs: DataFrame) -> DataFrame:
    """clip_features with ``feature``, the feature_digest of tensors and spans."""

    def run(batches):
        for batch in batches:
            digests = []
            for i in range(batch.num_rows):
                frames, spans, stored = (batch.column(c)[i : i + 1] for c in ("frames", "spans", "tensors"))
                mel = stored.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, MELS)[: frames[0].as_py()]
                digests.append(feature_digest(mel, [(s["start"], s["end"]) for s in spans[0].as_py()]))
            yield batch.append_column("feature", pa.array(digests, pa.string()))

    return clip_features(docs).mapInArrow(run, f"{STORED}, {SPANS}, feature string").select(*[c.split(" ")[0] for c in STORED.split(", ")], "feature", "frames", "spans", "tensors")


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as 8-bit sound, read back, with its log-mel tensors and spans."""
    return media_features(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op5_audio_features": op5_audio_features}
