"""Images as files: a PNG writer that runs in tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from turnloom.sources.files import publish_files


def png(rgb: np.ndarray) -> bytes:
    """A PNG file of (height, width, 3) samples. Each row is filtered by its left or upper neighbour or not at all, whichever leaves the least sum of absolute differences."""
    height, width, _ = rgb.shape
    rows = rgb.reshape(height, width * 3).astype(np.int16)
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 3:], up[1:] = rows[:, :-3], rows[:-1]
    forms = np.stack([rows, rows - left, rows - up]).astype(np.uint8)
    cost = np.minimum(forms.astype(np.int32), 256 - forms.astype(np.int32)).sum(axis=2)
    kind = cost.argmin(axis=0)
    lines = np.concatenate([kind[:, None].astype(np.uint8), forms[kind, np.arange(height)]], axis=1)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(images: DataFrame, folder: str, spread: int = 256) -> DataFrame:
    """(path, bytes, crc32) of a PNG file published for each row (name, width, height, rgb binary), as by files.publish_files."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pixels = (np.frombuffer(rgb, dtype=np.uint8).reshape(h, w, 3) for w, h, rgb in zip(batch["width"], batch["height"], batch["rgb"], strict=True))
            yield pd.DataFrame({"name": batch["name"] + ".png", "content": [png(p) for p in pixels]})

    return publish_files(images.select("name", "width", "height", "rgb").mapInPandas(encode, "name string, content binary"), folder, spread)
