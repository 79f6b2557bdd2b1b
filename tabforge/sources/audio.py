"""Audio folders: mean mel-frequency cepstral coefficients of every file."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions import text as X
from tabforge.functions.workspace import spread

# Suffixes read as audio, and the usual analysis settings.
AUDIO_SUFFIXES = (".wav", ".mp3", ".flac", ".ogg", ".m4a")
N_FFT = 2048
HOP = 512
N_MELS = 128
TOP_DB = 80.0
_BLOCK = 4096


def read_audio(spark: SparkSession, audio_dir: str, *, sample_rate: int = 22050, n_mfcc: int = 13,
               label_from_dir: bool = True, decoders=None) -> DataFrame:
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", X.suffix_glob(AUDIO_SUFFIXES)).load(audio_dir))
    return audio_mfcc(files, sample_rate=sample_rate, n_mfcc=n_mfcc,
                      label_from_dir=label_from_dir, decoders=decoders)


def audio_mfcc(files: DataFrame, *, sample_rate: int = 22050, n_mfcc: int = 13,
               label_from_dir: bool = True, decoders=None) -> DataFrame:
    """Feature rows of a (path, content) frame; unreadable audio gives NaN features.

    WAV is built in; ``decoders`` maps other suffixes to functions that return
    (samples, rate) for the file's bytes.
    """
    known = {".wav": wav_samples, **(decoders or {})}
    names = [f"mfcc_{i}" for i in range(n_mfcc)]

    def load(batches: Iterable[pd.DataFrame]):
        bank, basis = mel_bank(sample_rate), dct_rows(n_mfcc)
        for batch in batches:
            feats = np.full((len(batch), n_mfcc), np.nan)
            for i, (ext, blob) in enumerate(zip(batch["suffix"], batch["content"])):
                try:
                    samples, rate = known[ext](bytes(blob))
                    feats[i] = mean_mfcc(resample(mono(samples), rate, sample_rate), bank, basis)
                except Exception:  # unreadable: the row stays NaN
                    continue
            out = pd.DataFrame(feats, columns=names)
            out.insert(0, "audio_path", batch["path"].to_numpy())
            yield out

    path = F.col("path")
    kept = files.where(X.suffix(path).isin(*AUDIO_SUFFIXES)).select(
        X.plain_path(path).alias("path"), X.suffix(path).alias("suffix"), "content")
    # Decoding costs far more than moving the bytes.
    rows = spread(kept).mapInPandas(load, "audio_path string, " + ", ".join(f"{n} double" for n in names))
    label = [X.parent_name(F.col("audio_path")).alias("label")] if label_from_dir else []
    # Pandas has one missing value: what comes back null was NaN.
    values = [F.coalesce(n, F.lit(float("nan"))).alias(n) for n in names]
    return rows.select("audio_path", X.file_name(F.col("audio_path")).alias("filename"), *label, *values)


def wav_samples(blob: bytes) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1], one column per channel, and the sample rate."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, layout, data = 12, None, None
    while at + 8 <= len(blob):
        name, size = struct.unpack("<4sI", blob[at:at + 8])
        chunk = blob[at + 8:at + 8 + size]
        if name == b"fmt ":
            layout = struct.unpack("<HHIIHH", chunk[:16])
            if layout[0] == 0xFFFE:
                layout = (struct.unpack("<H", chunk[24:26])[0], *layout[1:])
        elif name == b"data":
            data = chunk
        at += 8 + size + size % 2
    if layout is None or data is None:
        raise ValueError("incomplete WAV file")
    code, channels, rate, _, _, bits = layout
    return _pcm(data, code, bits).reshape(-1, channels), rate


def _pcm(data: bytes, code: int, bits: int) -> np.ndarray:
    data = data[:len(data) // (bits // 8) * (bits // 8)]
    if code == 3:
        return np.frombuffer(data, "<f4" if bits == 32 else "<f8").astype(float)
    if code != 1:
        raise ValueError(f"unsupported WAV encoding {code}")
    if bits == 8:
        return (np.frombuffer(data, "u1").astype(float) - 128) / 128
    if bits == 24:
        wide = np.zeros((len(data) // 3, 4), "u1")
        wide[:, 1:] = np.frombuffer(data, "u1").reshape(-1, 3)
        return wide.view("<i4").ravel() / 2.0 ** 31
    return np.frombuffer(data, f"<i{bits // 8}") / 2.0 ** (bits - 1)


def mono(samples: np.ndarray) -> np.ndarray:
    return samples.mean(axis=1) if samples.ndim > 1 else samples


def resample(y: np.ndarray, have: int, want: int | None) -> np.ndarray:
    """Band-limited change of rate in the frequency domain."""
    if want is None or have == want or len(y) == 0:
        return y
    n = int(np.ceil(len(y) * want / have))
    spectrum = np.fft.rfft(y)
    bins = n // 2 + 1
    kept = np.zeros(bins, complex)
    m = min(bins, len(spectrum))
    kept[:m] = spectrum[:m]
    return np.fft.irfft(kept, n) * (n / len(y))


def _mel(hz):
    hz = np.asarray(hz, float)
    high = 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / np.log(6.4)
    return np.where(hz < 1000, hz * 3 / 200, high)


def _hz(mel):
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


def mel_bank(rate: int) -> np.ndarray:
    """Triangular filters of equal area, evenly spaced on the mel scale."""
    edges = _hz(np.linspace(_mel(0.0), _mel(rate / 2), N_MELS + 2))
    freqs = np.fft.rfftfreq(N_FFT, 1 / rate)
    left, centre, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rise = (freqs - left) / (centre - left)
    fall = (right - freqs) / (right - centre)
    return np.maximum(0, np.minimum(rise, fall)) * 2 / (right - left)


def dct_rows(n: int) -> np.ndarray:
    k = np.arange(n)[:, None]
    rows = np.cos(np.pi * k * (2 * np.arange(N_MELS) + 1) / (2 * N_MELS)) * np.sqrt(2 / N_MELS)
    rows[0] /= np.sqrt(2)
    return rows


def mean_mfcc(y: np.ndarray, bank: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Cepstral coefficients averaged over all frames of the signal."""
    if len(y) == 0:
        raise ValueError("no samples")
    padded = np.pad(y, N_FFT // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, N_FFT)[::HOP]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    power = np.concatenate([
        np.abs(np.fft.rfft(frames[i:i + _BLOCK] * window)) ** 2 @ bank.T
        for i in range(0, len(frames), _BLOCK)
    ])
    db = 10 * np.log10(np.maximum(power, 1e-10))
    db = np.maximum(db, db.max() - TOP_DB)
    return basis @ db.mean(axis=0)
