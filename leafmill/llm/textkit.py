"""Whole batches of text as flat numpy arrays: code points, character classes, word hashes.

An Arrow string column becomes one array of code points plus the offset of every
document in it; words are slices of that array, named by a 64-bit hash that is
computed for all of them at once from prefix sums of a polynomial.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points of Unicode's White_Space property (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points a chunk of documents is cut at.
CHUNK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE] = SPACE
    return out


@functools.cache
def lowers() -> np.ndarray:
    """Lower-case code point of every code point (those with a one-character lower case)."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x10FFFF):
        low = chr(c).lower()
        if len(low) == 1 and ord(low) != c:
            out[c] = ord(low)
    return out


def flatten(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all values, end to end, and ``n + 1`` offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    try:
        text = raw.tobytes().decode("utf-8")
    except UnicodeDecodeError:  # damaged bytes: value by value, with replacement characters
        texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) != len(raw):
        seen = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        offsets = seen[offsets]
    return points, offsets.astype(np.int64)


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Ranges of documents of about ``size`` code points; a larger document is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = b


class _Powers:
    """Powers of the polynomial's base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, CHUNK * 5 // 4)
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the polynomial's base and of its inverse."""
    up, down = _POWERS.upto(n)
    return up[:n], down[:n]


def mixed(points: np.ndarray) -> np.ndarray:
    """What each code point adds to a word's sum, before its place's power."""
    with np.errstate(over="ignore"):
        out = (points.astype(np.uint64) + np.uint64(1)) * _MULT
    out ^= out >> np.uint64(31)
    return out


def finish(sums: np.ndarray, length) -> np.ndarray:
    """The hash from a word's sum and length."""
    with np.errstate(over="ignore"):
        out = (sums ^ (sums >> np.uint64(32))) * _MULT
    return out ^ np.asarray(length).astype(np.uint64)


def hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every slice ``[start, end)`` of ``points``."""
    up, down = _POWERS.upto(len(points) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mixed(points) * up[: len(points)], out=total[1:])
        return finish((total[ends] - total[starts]) * down[starts], ends - starts)


def take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``[start, start + length)``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def strings(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The slices as Python strings; for the few that are looked at one by one."""
    return [points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts, ends, strict=True)]


class Lookup:
    """Maps 64-bit keys to row numbers of tables that grow with the keys; emptied at a bound."""

    def __init__(self, bound: int = 1 << 20) -> None:
        self.bound = bound
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of every key, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        merged, numbers = np.concatenate([self.keys, keys]), np.concatenate([self.rows, rows])
        order = np.argsort(merged, kind="stable")
        self.keys, self.rows = merged[order], numbers[order]
