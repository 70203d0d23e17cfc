"""64-bit hashes of word shingles of whole texts, in numpy.

Words are maximal runs of anything but ASCII white space, A-Z lower-cased. A text's set holds its
distinct runs of WIDTH words; a text with fewer words has one shingle, all its words; none has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .ngrams import mixed

WIDTH = 5
#: Bytes of normalised text hashed at once (a longer text alone).
GROUP_BYTES = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.Philox(key=20)).integers(1, 1 << 63, 256, dtype=np.uint64)


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, GROUP_BYTES + 1024)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)], dtype=np.uint64)
        return self.up, self.down


POWERS = _Powers()


def substring_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for arrays of bounds; equal bytes give equal hashes wherever they are."""
    up, down = POWERS.upto(len(data) + 1)
    c = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=c[1:])
    return mixed((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))


def sets(texts: list[bytes | None], width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct hashes) by text."""
    group: list[tuple[int, bytes, int]] = []
    size = 0
    for i, t in enumerate(texts):
        words = t.lower().split() if t else []
        norm = b" ".join(words)
        if group and size + len(norm) > GROUP_BYTES:
            yield from _group(group, width)
            group, size = [], 0
        group.append((i, norm, len(words)))
        size += len(norm) + 1
    if group:
        yield from _group(group, width)


def _group(group: list[tuple[int, bytes, int]], width: int) -> Iterator[tuple[int, np.ndarray]]:
    none = np.zeros(0, dtype=np.uint64)
    live = [g for g in group if g[2]]
    h = none
    counts = np.array([g[2] for g in live], dtype=np.int64)
    if live:
        data = np.frombuffer(b" ".join([g[1] for g in live]), dtype=np.uint8)
        gaps = np.flatnonzero(data == 32)
        start, end = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
        n = np.maximum(counts - width + 1, 1)
        first = np.cumsum(counts) - counts
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        last = np.minimum(at + width, np.repeat(first + counts, n)) - 1
        h = substring_hashes(data, start[at], end[last])
        stop = np.cumsum(n)
    k = 0
    for i, _, words in group:
        if words:
            yield i, np.unique(h[stop[k] - n[k] : stop[k]])
            k += 1
        else:
            yield i, none


def set_key(s: np.ndarray) -> int:
    """One 64-bit key of a set of hashes (signed)."""
    x = mixed(s ^ np.uint64(0x5851F42D4C957F2D))
    return int((mixed(np.array([x.sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64))).view(np.int64)[0])
