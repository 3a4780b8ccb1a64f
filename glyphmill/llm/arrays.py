"""Texts of an Arrow batch as one array of code points."""

from __future__ import annotations

import numpy as np


def code_points(texts: list[str], gap: str = "\x00") -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts with ``gap`` after each, start of each text)."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths + len(gap), out=starts[1:])
    joined = gap.join(texts) + gap if texts else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def slices(texts: list[str], most: int = 2_000_000):
    """(first, last) of runs of texts with about ``most`` code points in all."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
