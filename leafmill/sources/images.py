"""Pictures without a decoder's help: plain PNG pixels, a blank-page guard, and reading equal pictures once."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below this deviation of its grey values a page is blank (a fixed value).
BLANK = 1.0
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def png_pixels(content: bytes) -> np.ndarray | None:
    """Grey values of an 8-bit PNG that isn't interlaced; None for anything else."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, head = 8, b"", None
    while at + 8 <= len(content):
        (n,), kind = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += n + 12
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        return None
    wide, high, channels = head[0], head[1], _CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(high, 1 + wide * channels)
    except (zlib.error, ValueError):
        return None
    out, above = np.zeros((high, wide * channels), np.uint8), np.zeros(wide * channels, np.uint8)
    for y in range(high):
        above = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, channels)
    pixels = out.reshape(high, wide, channels).astype(float)
    return pixels[:, :, 0] if channels < 3 else pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = line.astype(int)
    for i in range(len(out)):
        left, up, corner = (int(out[i - step]) if i >= step else 0), int(above[i]), (int(above[i - step]) if i >= step else 0)
        if kind == 3:
            add = (left + up) // 2
        else:
            guess = left + up - corner
            add = min((left, up, corner), key=lambda v: (abs(guess - v), (left, up, corner).index(v)))
        out[i] = (out[i] + add) & 255
    return out.astype(np.uint8)


def is_blank(content: bytes) -> bool:
    """Whether a page image is one grey all over; a picture that can't be decoded here isn't called blank."""
    pixels = png_pixels(content)
    return pixels is not None and (pixels.size == 0 or float(pixels.std()) < BLANK)


def read_once(images: DataFrame, reader: Callable[[DataFrame], DataFrame], content: str = "content") -> DataFrame:
    """Every picture with what a reader made of its content; equal ones are read once, and the reading goes to all.

    ``reader`` takes rows of ``digest`` and ``content`` and gives rows with ``digest``. A
    null content has no digest and is left out.
    """
    known = images.where(F.col(content).isNotNull()).withColumn("digest", F.sha2(F.col(content), 256))
    distinct = known.groupBy("digest").agg(F.min(content).alias("content"))
    return known.drop(content).join(reader(distinct), "digest")
