"""Words of Arrow text columns as NumPy arrays, hashed without a Python object per word."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def once_per_worker(name: str, make: Callable[[], Any]) -> Any:
    """A value made once in a Python worker and kept for its later tasks.

    Functions travel to workers by value, so their own module's globals do not last from task to task."""
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))


def text_slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of a text column; null is the empty text."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + slice_bytes, "right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (a run free of `blank` bytes, ASCII white space), and words before each text."""
    solid = ~blank[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = solid[last]
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of a running polynomial, brought to a common exponent."""
    n = len(data)
    power = np.full(n + 1, _PRIME, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=running[1:])
    power[0], power[1:] = 1, _INVERSE
    np.cumprod(power, out=power)
    return mix64((running[ends] - running[starts]) * power[starts] + (ends - starts).astype(np.uint64))
