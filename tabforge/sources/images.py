"""Image folders: size and colour mode of every image, from its header."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions import text as X

# Suffixes read as images.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp")
UNREADABLE = (0, 0, "unknown")


def read_images(spark: SparkSession, image_dir: str, *, label_from_dir: bool = True) -> DataFrame:
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", X.suffix_glob(IMAGE_SUFFIXES)).load(image_dir))
    return image_metadata(files, label_from_dir=label_from_dir)


def image_metadata(files: DataFrame, *, label_from_dir: bool = True) -> DataFrame:
    """Metadata rows of a (path, content) frame; unreadable images give 0, 0, "unknown"."""
    def load(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            sizes = [image_header(bytes(blob)) for blob in batch["content"]]
            yield pd.DataFrame({
                "image_path": batch["path"],
                "width": [s[0] for s in sizes],
                "height": [s[1] for s in sizes],
                "mode": [s[2] for s in sizes],
            })

    path = F.col("path")
    kept = files.where(X.suffix(path).isin(*IMAGE_SUFFIXES))
    rows = kept.select(X.plain_path(path).alias("path"), "content").mapInPandas(
        load, "image_path string, width int, height int, mode string")
    label = [X.parent_name(F.col("image_path")).alias("label")] if label_from_dir else []
    return rows.select("image_path", *label, "width", "height", "mode",
                       X.file_name(F.col("image_path")).alias("filename"))


def image_header(blob: bytes) -> tuple[int, int, str]:
    """Width, height and mode of an encoded image."""
    readers = (
        (b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8", _jpeg), (b"GIF8", _gif), (b"BM", _bmp),
        (b"RIFF", _webp), (b"II*\x00", _tiff), (b"MM\x00*", _tiff),
    )
    for magic, reader in readers:
        if blob.startswith(magic):
            try:
                return reader(blob)
            except (struct.error, IndexError, KeyError, ValueError):
                return UNREADABLE
    return UNREADABLE


def _png(b: bytes):
    if b[12:16] != b"IHDR":
        return UNREADABLE
    width, height, depth, colour = struct.unpack(">IIBB", b[16:26])
    mode = {0: {1: "1", 16: "I;16"}.get(depth, "L"), 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[colour]
    return width, height, mode


def _jpeg(b: bytes):
    at = 2
    while True:
        while b[at] == 0xFF and b[at + 1] == 0xFF:
            at += 1
        if b[at] != 0xFF:
            return UNREADABLE
        marker = b[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", b[at + 5:at + 10])
            return width, height, {1: "L", 3: "RGB", 4: "CMYK"}[parts]
        if marker in (0x01, *range(0xD0, 0xD9)):
            at += 2
        else:
            at += 2 + struct.unpack(">H", b[at + 2:at + 4])[0]


def _gif(b: bytes):
    width, height = struct.unpack("<HH", b[6:10])
    return width, height, "P"


def _bmp(b: bytes):
    width, height, _, bits = struct.unpack("<iiHH", b[18:30])
    return width, abs(height), {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGB"}[bits]


def _webp(b: bytes):
    kind = b[12:16]
    if kind == b"VP8X":
        mode = "RGBA" if b[20] & 0x10 else "RGB"
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little"), mode
    if kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, ((bits >> 14) & 0x3FFF) + 1, "RGBA" if bits >> 28 & 1 else "RGB"
    if kind == b"VP8 ":
        width, height = struct.unpack("<HH", b[26:30])
        return width & 0x3FFF, height & 0x3FFF, "RGB"
    return UNREADABLE


def _tiff(b: bytes):
    order = "<" if b[:2] == b"II" else ">"
    at = struct.unpack(order + "I", b[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", b[at:at + 2])[0]):
        tag, kind, _ = struct.unpack(order + "HHI", b[at + 2 + 12 * i:at + 10 + 12 * i])
        value = b[at + 10 + 12 * i:at + 14 + 12 * i]
        tags[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[:2 if kind == 3 else 4])[0]
    samples = tags.get(277, 1)
    mode = {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}[samples]
    if tags.get(262) == 3:
        mode = "P"
    elif tags.get(262) == 5:
        mode = "CMYK"
    elif samples == 1 and tags.get(258, 1) == 1:
        mode = "1"
    return tags[256], tags[257], mode
