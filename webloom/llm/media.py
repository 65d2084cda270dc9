"""Media columns: texts as WAV payloads, read back and fingerprinted by pairs of spectral peaks.

A text's UTF-8 bytes, padded with spaces to a positive multiple of FRAME_BYTES, become the 8-bit mono samples of a WAV
file. The file is read back with the wave module, cut into overlapping windowed frames (silence fills the last), and transformed (short-time
Fourier transform). In each band of each frame the strongest bin that also beats the same band of both neighbour frames
is a peak; a peak is paired with the next FAN_OUT peaks of its band, and each pair (first bin, second bin, frames between) is a code
stored with the frame of its first peak.

Edge cases: null text is empty text (192 spaces); silence (no bin above zero) has empty arrays; rows are independent, so
repeated rows and equal texts get equal values; an empty table gives an empty result; other columns are not read. Long
texts are transformed BLOCK_FRAMES frames at a time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import map_slices

FRAME_BYTES = 192
RATE = 8000
WINDOW, HOP = 256, 128
BANDS = ((3, 12), (12, 28), (28, 60), (60, 129))
FAN_OUT, MAX_DT = 2, 15
BLOCK_FRAMES = 8192

SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, fp_time array<int>, fp_code array<int>, media binary"
)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the bytes padded with spaces to a positive multiple of FRAME_BYTES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // FRAME_BYTES)) * FRAME_BYTES
    return len(raw), raw.ljust(size, b" ")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


HANN = np.hanning(WINDOW).astype(np.float32)


def band_peaks(samples: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin and its magnitude, frames x bands, of the frames that start at the given samples."""
    bins, mags = np.empty((len(starts), len(BANDS)), np.int64), np.empty((len(starts), len(BANDS)), np.float32)
    span = np.arange(WINDOW)
    for at in range(0, len(starts), BLOCK_FRAMES):
        block = samples[starts[at : at + BLOCK_FRAMES, None] + span].astype(np.float32)
        block -= block.mean(axis=1, keepdims=True)
        block *= HANN / 128
        spectrum = np.abs(np.fft.rfft(block, axis=1))
        here = np.arange(len(block))
        for k, (lo, hi) in enumerate(BANDS):
            best = spectrum[:, lo:hi].argmax(axis=1) + lo
            bins[at : at + BLOCK_FRAMES, k], mags[at : at + BLOCK_FRAMES, k] = best, spectrum[here, best]
    return bins, mags


def fingerprints(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all payloads at once: offsets into, frame numbers and pair codes, in time order within a payload."""
    counts = np.array([1 + max(0, -(-(len(p) - WINDOW) // HOP)) for p in payloads], np.int64)
    sizes = WINDOW + (counts - 1) * HOP
    begins = np.concatenate(([0], np.cumsum(sizes)))
    samples = np.frombuffer(b"".join(p.ljust(n, b"\x80") for p, n in zip(payloads, sizes.tolist(), strict=True)), np.uint8)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(payloads)), counts)
    frame = np.arange(firsts[-1]) - firsts[owner]
    bins, mags = band_peaks(samples, begins[owner] + frame * HOP)
    mags = np.round(mags, 3)
    beside = np.zeros((1, len(BANDS)), np.float32)
    earlier, later = np.concatenate((beside, mags[:-1])), np.concatenate((mags[1:], beside))
    earlier[frame == 0] = 0
    later[frame == counts[owner] - 1] = 0
    at, band = np.nonzero((mags > 0) & (mags >= earlier) & (mags > later))
    order = np.lexsort((at, band, owner[at]))
    at, band = at[order], band[order]
    f, doc = bins[at, band], owner[at]
    places, codes = [], []
    for k in range(1, FAN_OUT + 1):
        dt = at[k:] - at[:-k]
        ok = (dt <= MAX_DT) & (doc[k:] == doc[:-k]) & (band[k:] == band[:-k])
        places.append(at[:-k][ok])
        codes.append(((f[:-k] << 12) | (f[k:] << 4) | dt)[ok])
    place, code = np.concatenate(places), np.concatenate(codes)
    order = np.lexsort((code, place))
    place, code = place[order], code[order]
    return np.searchsorted(place, firsts), frame[place].astype(np.int32), code.astype(np.int32)


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """One row per document with the stored form's digests and time-coded fingerprint arrays; media holds the file."""

    def make():
        def f(cols):
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            out = {x: [] for x in names}
            payloads = []
            for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
                n, payload = payload_of(text)
                media = to_wav(payload)
                back = from_wav(media)
                payloads.append(back)
                row = (
                    doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media),
                    hashlib.sha256(media).hexdigest(),
                )
                for name, v in zip(names, row, strict=False):
                    out[name].append(v)
                out["media"].append(media if keep_media else None)
            offsets, times, codes = fingerprints(payloads)
            offsets = pa.array(offsets, pa.int32())
            out["fp_time"] = pa.ListArray.from_arrays(offsets, pa.array(times))
            out["fp_code"] = pa.ListArray.from_arrays(offsets, pa.array(codes))
            return out

        return f

    return map_slices(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), "text", make, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: digests of the stored form; feature is the time-coded array as time.code pairs."""
    out = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_media=False)
    pairs = F.transform(F.arrays_zip("fp_time", "fp_code"), lambda p: F.concat_ws(".", p["fp_time"], p["fp_code"]))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.array_join(pairs, ",").alias("feature"),
    )
