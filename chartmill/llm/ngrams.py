"""Hashed character n-grams of many words at once, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)


def stripped(chunk: str) -> str:
    """A chunk of text between white space without the punctuation around it."""
    return _EDGE.sub("", chunk)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes: high bits reach the low ones."""
    h = (h ^ (h >> np.uint64(32))) * _MUL
    h = (h ^ (h >> np.uint64(32))) * _MUL
    return h ^ (h >> np.uint64(32))


def word_ngrams(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, (word index, bucket) of the n-grams of <word>, words in order; with whole, the word itself last."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    lens = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), lens)
    ends = np.cumsum(lens)
    left = ends[owner] - np.arange(len(codes))  # characters from here to the word's end
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(sizes) + 1):
        shifted = np.zeros(len(codes), dtype=np.uint64)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        h = h * _MIX + shifted
        if n in sizes:
            ok = left >= n
            yield owner[ok], (mixed(h[ok] + np.uint64(n)) % np.uint64(buckets)).astype(np.int64)
    if whole:
        power = np.cumprod(np.full(int(lens.max()) if len(lens) else 1, _MIX, dtype=np.uint64))
        place = lens[owner] - left
        full = np.add.reduceat(codes * power[place], ends - lens) if len(words) else np.zeros(0, dtype=np.uint64)
        yield np.arange(len(words)), (mixed(full + np.uint64(77)) % np.uint64(buckets)).astype(np.int64)


def csr(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, buckets) of all n-grams by word; every word has at least one, itself."""
    parts = list(word_ngrams(words, sizes, buckets))
    owner = np.concatenate([p[0] for p in parts])
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return np.cumsum(counts) - counts, np.concatenate([p[1] for p in parts])[order]


class WordTable(dict):
    """word chunk -> row of `values`, filled in batches; emptied when it holds too many."""

    def __init__(self, compute, width: int, most: int = 400_000):
        super().__init__()
        self.compute, self.width, self.most = compute, width, most
        self.values = np.zeros((1024, width))

    def lookup(self, chunks_by_text: list[list[str]]) -> np.ndarray:
        """Values of all chunks of some texts, one after the other."""
        new = set().union(*chunks_by_text) - self.keys() if chunks_by_text else set()
        if len(self) + len(new) > self.most and len(self):
            self.clear()
            new = set().union(*chunks_by_text)
        if new:
            listed = sorted(new)
            got = self.compute(listed)
            at = len(self)
            if at + len(listed) > len(self.values):
                self.values = np.concatenate([self.values[:at], np.zeros((2 * len(listed) + at, self.width))])
            self.values[at : at + len(listed)] = got
            self.update(zip(listed, range(at, at + len(listed)), strict=True))
        get = self.__getitem__
        return self.values[np.array([i for c in chunks_by_text for i in map(get, c)], dtype=np.int64)]


def batches_of_words(texts: list[str | None], most: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Texts cut at white space, in groups of about `most` chunks (a longer text is a group alone)."""
    ids: list[int] = []
    group: list[list[str]] = []
    total = 0
    for i, t in enumerate(texts):
        chunks = t.lower().split() if isinstance(t, str) else []
        if group and total + len(chunks) > most:
            yield ids, group
            ids, group, total = [], [], 0
        ids.append(i)
        group.append(chunks)
        total += len(chunks)
    if group:
        yield ids, group
