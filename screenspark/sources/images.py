"""Images of a folder as exploded pixels: ``.npy`` arrays and uncompressed TIFF files.

Files are read by Spark's binary reader, so they may lie in any store it knows; a row, and so a task's step, is one image.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: TIFF field types by code: size in bytes and struct letter; fixed values.
_FIELDS = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}
#: Tags of a TIFF page that are read here; fixed values.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _SIZES, _PLANAR, _TILES, _FORMAT = 256, 257, 258, 259, 273, 277, 279, 284, 322, 339
#: Kinds of samples by code; fixed values.
_KINDS = {1: "u", 2: "i", 3: "f"}


def _tags(content: bytes, at: int, order: str) -> tuple[dict[int, list], int]:
    """The tags of the page directory at ``at``, and where the next one is (0 after the last)."""
    (count,) = struct.unpack_from(order + "H", content, at)
    out = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * k)
        if kind not in _FIELDS:
            continue
        size, letter = _FIELDS[kind]
        where = at + 2 + 12 * k + 8
        if size * n > 4:
            (where,) = struct.unpack_from(order + "I", content, where)
        out[tag] = list(struct.unpack_from(f"{order}{n}{letter}", content, where))
    (following,) = struct.unpack_from(order + "I", content, at + 2 + 12 * count)
    return out, following


def _page(content: bytes, tags: dict[int, list], order: str) -> np.ndarray:
    if tags.get(_COMPRESSION, [1])[0] != 1 or _TILES in tags:
        raise ValueError("only TIFF pages of uncompressed strips can be read")
    height, width, samples = tags[_HEIGHT][0], tags[_WIDTH][0], tags.get(_SAMPLES, [1])[0]
    bits = tags.get(_BITS, [1])[0]
    kind = np.dtype(f"{order}{_KINDS[tags.get(_FORMAT, [1])[0]]}{bits // 8}") if bits % 8 == 0 else None
    if kind is None:
        raise ValueError(f"samples of {bits} bits cannot be read")
    raw = b"".join(content[a : a + n] for a, n in zip(tags[_OFFSETS], tags[_SIZES], strict=True))
    apart = tags.get(_PLANAR, [1])[0] == 2 and samples > 1
    image = np.frombuffer(raw, dtype=kind, count=height * width * samples).reshape((samples, height, width) if apart else (height, width, samples))
    return image[..., 0] if samples == 1 else image


def decode_tiff(content: bytes, first_only: bool = True) -> np.ndarray:
    """The first page, or all pages stacked, of a TIFF file."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack_from(order + "H", content, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", content, 4)
    pages = []
    while at and not (first_only and pages):
        tags, at = _tags(content, at, order)
        pages.append(_page(content, tags, order))
    return pages[0] if len(pages) == 1 else np.stack(pages)


def decode_image(path: str, content: bytes, image_type: str) -> np.ndarray:
    """An image with its channels first, from a file that stores them last (``hwc``) or first (``chw``).

    A TIFF file with channels last is read from its first page; an image of one channel has no channel axis to move.
    """
    if image_type not in ("hwc", "chw"):
        raise ValueError(f"unknown order of axes {image_type}")
    if path.lower().endswith(".npy"):
        image = np.load(io.BytesIO(content), allow_pickle=False)
    elif path.lower().endswith((".tif", ".tiff")):
        image = decode_tiff(content, first_only=image_type == "hwc")
    else:
        raise ValueError(f"unsupported file format {path}")
    if image.ndim == 2:
        return image[None]
    if image.ndim != 3:
        raise ValueError(f"an image of {image.ndim} axes")
    return np.moveaxis(image, -1, 0) if image_type == "hwc" else image


_PIXELS = pa.schema([("path", pa.string()), ("ch", pa.int64()), ("y", pa.int64()), ("x", pa.int64()), ("v", pa.float64())])
_STEP = 1 << 20


def _pixels(image_type: str):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                image = decode_image(path, content.as_py(), image_type)
                flat = image.reshape(-1)
                for at in range(0, len(flat), _STEP):
                    part = flat[at : at + _STEP]
                    ch, y, x = np.unravel_index(np.arange(at, at + len(part)), image.shape)
                    yield pa.record_batch([pa.array([path] * len(part)), pa.array(ch), pa.array(y), pa.array(x), pa.array(part.astype(np.float64))], schema=_PIXELS)

    return run


def read_images(spark: SparkSession, path: str, image_type: str = "hwc") -> DataFrame:
    """``path, ch, y, x, v`` of all images in a folder; a file of another format raises when it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_pixels(image_type), "path string, ch long, y long, x long, v double")


def write_features(df: DataFrame, path: str, by: str = "plate_well") -> None:
    """Features as Parquet with their column names as text, in a folder per ``by``; writing some of its values again replaces those folders alone."""
    named = df.toDF(*map(str, df.columns))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def wide_features(df: DataFrame, size: int, vector: str = "features") -> DataFrame:
    """``vector`` as ``size`` columns named by their place."""
    return df.select(*(c for c in df.columns if c != vector), *(F.get(F.col(vector), F.lit(k)).alias(str(k)) for k in range(size)))
