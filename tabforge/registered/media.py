"""Images and sound built from the embeddings: one file per vector."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.registered.base import query, spread_table
from tabforge.sources.audio import audio_mfcc
from tabforge.sources.images import image_metadata

RATE = 22050


@F.pandas_udf(T.BinaryType())
def png_bytes(embedding: pd.Series, rgb: pd.Series) -> pd.Series:
    """Each vector as a small grey or colour image."""
    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    def build(v, colour: bool) -> bytes:
        side = int(np.ceil(len(v) ** 0.5))
        square = np.pad(np.asarray(v, float), (0, side * side - len(v)))
        grey = (np.clip(square, -0.5, 0.5) * 254 + 127).astype("u1").reshape(side, side)
        px = np.repeat(grey, 3, axis=1) if colour else grey
        raw = b"".join(b"\0" + row.tobytes() for row in px)
        head = struct.pack(">IIBBBBB", side, side, 8, 2 if colour else 0, 0, 0, 0)
        return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw))
                + chunk(b"IEND", b""))

    return pd.Series([build(v, c) for v, c in zip(embedding, rgb)])


@query("image_metadata", """
SELECT '/images/' || label || '/' || vec_id || '.png' AS image_path, CAST(label AS VARCHAR) AS label,
       CASE WHEN vec_id % 10 = 9 THEN 0 ELSE 8 END AS width, CASE WHEN vec_id % 10 = 9 THEN 0 ELSE 8 END AS height,
       CASE WHEN vec_id % 10 = 9 THEN 'unknown' WHEN vec_id % 2 = 0 THEN 'RGB' ELSE 'L' END AS mode,
       vec_id || '.png' AS filename
FROM embeddings
""")
def images(spark, sf_dir):
    """Header data of the images; every tenth file is broken."""
    key = F.col("vec_id")
    path = F.concat(F.lit("file:/images/"), F.col("label").cast("string"), F.lit("/"), key.cast("string"), F.lit(".png"))
    content = F.when(key % 10 == 9, F.lit("broken").cast("binary")).otherwise(
        png_bytes("embedding", key % 2 == 0))
    files = spread_table(spark, sf_dir, "embeddings").select(path.alias("path"), content.alias("content"))
    return image_metadata(files)


@F.pandas_udf(T.BinaryType())
def wav_bytes(embedding: pd.Series) -> pd.Series:
    """Each vector as a tenth of a second of sound: one tone per component."""
    t = np.arange(RATE // 10) / RATE

    def build(v) -> bytes:
        tones = 200 * 2 ** (np.arange(len(v)) / 12)
        y = np.asarray(v, float) @ np.sin(2 * np.pi * np.outer(tones, t))
        pcm = (y / max(np.abs(y).max(), 1e-9) * 32000).astype("<i2").tobytes()
        return (b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt "
                + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE * 2, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm)

    return embedding.map(build)


@query("audio_mfcc")
def sounds(spark, sf_dir) -> DataFrame:
    """Cepstral features of the sounds; compressed files without a decoder give NaN."""
    key = F.col("vec_id")
    ext = F.when(key % 20 == 19, ".mp3").otherwise(".wav")
    path = F.concat(F.lit("file:/audio/"), F.col("label").cast("string"), F.lit("/"), key.cast("string"), ext)
    files = spread_table(spark, sf_dir, "embeddings").select(path.alias("path"), wav_bytes("embedding").alias("content"))
    return audio_mfcc(files)
