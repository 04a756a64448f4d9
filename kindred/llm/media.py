"""Audio features of byte payloads: WAV storage, polyphase resampling, log-mel frames and energy segments.

A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, are the 8-bit samples of a mono WAV file. Features
are computed from the samples read back from that file: a rational polyphase filter takes 16 kHz to 12 kHz, overlapped
windows of 32 ms go through a mel filterbank to a logarithm, and a two-threshold (hysteresis) rule over frame energy
gives active segments. Frames are stored as fixed-shape Arrow tensors of ``TENSOR_FRAMES`` x ``MELS`` with their time spans, as
an Arrow IPC stream in one binary column.

Every payload is computed by itself, in blocks of bounded size, so equal texts have equal features and a very long text
needs no more memory than a block and its features.

Defined results: a null or empty text is 576 bytes of 255; repeated rows have equal results; null ids pass through; an
empty table gives no rows; columns other than doc_id and text are not used.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.session import ship

UNIT = 576
RATE, UP, DOWN, TAPS = 16_000, 3, 4, 16
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, FFT, MELS, TENSOR_FRAMES = 384, 192, 512, 24, 64
#: Frames computed at once.
BLOCK = 2048


def pad_payload(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of UNIT."""
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def write_wav(samples: bytes) -> bytes:
    """A mono 8-bit PCM WAV file of the samples; an odd count is padded as the format asks."""
    pad = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def read_wav(stored: bytes) -> bytes:
    """The samples of a WAV file as written here; chunks other than data are skipped."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"data":
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@functools.cache
def _filters() -> np.ndarray:
    """The prototype low-pass (windowed sinc at the lower Nyquist rate) split into UP phases of TAPS."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.kaiser(n, 7.0)
    h *= UP / h.sum()
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, first: int, count: int) -> np.ndarray:
    """Outputs first .. first + count - 1 of the polyphase filter over samples x (zero outside); first is a multiple of UP."""
    out = np.zeros(count, np.float32)
    base = first // UP * DOWN
    span = -(-count // UP) * DOWN + TAPS + DOWN
    part = np.zeros(span, np.float32)
    lo, hi = base - TAPS // 2, base - TAPS // 2 + span
    a, b = max(lo, 0), min(hi, len(x))
    if b > a:
        part[a - lo : b - lo] = x[a:b]
    for p, h in enumerate(_filters()):
        n = len(out[p::UP])
        shift = p * DOWN // UP
        phase = _filters()[(p * DOWN) % UP]
        acc = np.zeros(n, np.float32)
        for k in range(TAPS):
            acc += phase[k] * part[shift + k : shift + k + (n - 1) * DOWN + 1 : DOWN]
        out[p::UP] = acc
    return out


@functools.cache
def _mel_bank() -> np.ndarray:
    """Triangular filters on the mel scale, (bins, MELS)."""
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(mel(20.0), mel(OUT_RATE / 2), MELS + 2) / 2595.0) - 1.0)
    f = np.arange(FFT // 2 + 1) * OUT_RATE / FFT
    up = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(up, down), 0.0, None).astype(np.float32)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log-mel values and the frames' log energies."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0) / 128.0
    total = len(x) * UP // DOWN
    frames = max(1, 1 + (total - FRAME) // HOP)
    mels, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    window = np.hanning(FRAME).astype(np.float32)
    for at in range(0, frames, BLOCK):
        n = min(BLOCK, frames - at)
        y = resample(x, at * HOP, (n - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * window
        power = np.abs(np.fft.rfft(cut, FFT, axis=1)) ** 2
        mels[at : at + n] = np.log(power.astype(np.float32) @ _mel_bank() + 1e-6)
        energy[at : at + n] = np.log((cut**2).mean(axis=1) + 1e-9)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Active runs of frames: one begins where the energy reaches the upper threshold and lasts until it falls below the lower."""
    centre, spread = float(energy.mean()), float(energy.std())
    mark = np.where(energy >= centre + 0.5 * spread, 1, np.where(energy < centre - 0.5 * spread, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)] > 0, False)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def to_tensors(mels: np.ndarray) -> bytes:
    """An Arrow IPC stream of fixed-shape tensors with start_s and end_s; the last one is filled up with its floor value."""
    n = -(-len(mels) // TENSOR_FRAMES)
    block = np.full((n * TENSOR_FRAMES, MELS), np.float32(np.log(1e-6)), np.float32)
    block[: len(mels)] = mels
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(block.reshape(n, TENSOR_FRAMES, MELS))
    start = np.arange(n) * TENSOR_FRAMES * HOP / OUT_RATE
    end = (np.minimum((np.arange(n) + 1) * TENSOR_FRAMES, len(mels)) - 1) * HOP / OUT_RATE + FRAME / OUT_RATE
    batch = pa.RecordBatch.from_arrays([tensors, pa.array(start), pa.array(end)], names=["mel", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_tensors(stored: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tensors, start_s, end_s) of a stored stream."""
    table = pa.ipc.open_stream(stored).read_all()
    return table.column("mel").combine_chunks().to_numpy_ndarray(), table.column("start_s").to_numpy(), table.column("end_s").to_numpy()


def audio_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a WAV file), tensors (an Arrow stream), n_frames, segments (start_s, end_s) for every row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "media", "tensors", "n_frames", "segments"]
        spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), spans]
        for batch in batches:
            at, held, rows = 0, 0, []
            for i in range(batch.num_rows):
                raw = (batch.column(1)[i].as_py() or "").encode()
                media = write_wav(pad_payload(raw))
                mels, energy = log_mel(read_wav(media))
                found = [{"start_s": a * HOP / OUT_RATE, "end_s": ((b - 1) * HOP + FRAME) / OUT_RATE} for a, b in segments(energy)]
                rows.append((len(raw), media, to_tensors(mels), len(mels), found))
                held += len(media)
                if held > 1 << 22 or i + 1 == batch.num_rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), *columns], names)
                    at, held, rows = i + 1, 0, []

    typed = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {typed}, n_bytes long, media binary, tensors binary, n_frames long, segments array<struct<start_s: double, end_s: double>>")


def media_digests(features: DataFrame) -> DataFrame:
    """Digest columns of stored media and tensors, from their bytes as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for media, stored, n, spans in zip(*(batch.column(c) for c in ("media", "tensors", "n_frames", "segments")), strict=True):
                whole = media.as_py()
                payload = read_wav(whole)
                mels, start, end = from_tensors(stored.as_py())
                levels = np.round(mels.reshape(-1, MELS)[: n.as_py()] * 64.0).astype("<i2")
                spans = spans.as_py()
                active = sum(s["end_s"] - s["start_s"] for s in spans)
                feature = f"{n.as_py()}x{MELS};{len(start)};{end[-1]:.3f};{len(spans)};{active:.3f};{hashlib.sha256(levels.tobytes()).hexdigest()[:32]}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(whole), hashlib.sha256(whole).hexdigest(), feature))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    typed = features.schema["doc_id"].dataType.simpleString()
    return features.mapInArrow(run, f"doc_id {typed}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media(spark, sf_dir: str) -> DataFrame:
    return media_digests(audio_features(spark.read.parquet(f"{sf_dir}/documents.parquet")))
