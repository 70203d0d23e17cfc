"""Token ids of whole texts by the public word-level BPE, as little-endian unsigned 32-bit bytes.

The library's own encode() tracks offsets and runs normaliser and splitter over each character; here
texts are cut at white space, which no token crosses, and each distinct chunk is encoded once a worker.
Only texts whose characters behave alike in both (printable ASCII and Latin-1, no special tokens) go
this way; any other text goes through encode() itself, so ids are the library's in every case.
"""

from __future__ import annotations

import re

import regex

_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Chunks remembered by a worker; about 200 bytes each.
MOST_CHUNKS = 300_000


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Chunks(dict):
    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize
        self.alphabet = _byte_alphabet()

    def __missing__(self, chunk: str) -> bytes:
        a = self.alphabet
        ids = [t.id for p in _PIECE.findall(chunk) for t in self.tokenize("".join([a[b] for b in p.encode()]))]
        out = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(self) >= MOST_CHUNKS:
            self.clear()
        self[chunk] = out
        return out


class Encoder:
    """encode(text) -> bytes of its ids."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.chunks = _Chunks(self.whole.model)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One a worker process and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return b"".join([i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids])
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))
