"""Byte-level BPE ids by a public vocabulary file, and the pre-tokens they come from.

Ids are little-endian unsigned 32-bit bytes, ready to slice, join and checksum. Pre-tokens are kept
in a bounded dictionary per worker, so a frequent word is merged once; a text with characters outside
a plain set is given whole to the library. Both ways give the ids of the library.
"""

from __future__ import annotations

import array
import base64
import json
import os
import re
import sys

WIDTH = 4  # bytes of an id

#: The vocabulary's own split pattern, for texts made of PLAIN characters only, where Python's
#: classes and the library's agree.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ɏ‐-‧]*")
#: Words stand first, as most pre-tokens are words and no other branch before them can take one.
SPLIT = re.compile(r" ?[^\W\d_]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
SPLIT_ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")

CACHE_WORDS = 300_000  # entries a worker keeps, about 60 MB


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Pieces(dict):
    """Pre-token -> bytes of its ids. Past the bound new words are merged each time they come."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, word: str) -> bytes:
        ids = pack(self.encoding.encode_ordinary(word))
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a plain text."""
    return (SPLIT_ASCII if text.isascii() else SPLIT).findall(text)


def pack(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Encoder:
    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        path = path or default_path()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = Pieces(self.encoding)
        self.added = added_tokens(os.path.splitext(path)[0] + ".json")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def split(self, text: str) -> list[str] | None:
        """Pre-tokens whose ids, joined, are the ids of the text; None where only the library can split it."""
        return pre_tokens(text) if PLAIN.fullmatch(text) else None

    def ids(self, text: str | None) -> bytes:
        """Bytes of the ids of a text; a null text is empty."""
        if not text:
            return b""
        words = self.split(text)
        if words is None:
            return pack(self.encoding.encode_ordinary(text))
        return b"".join(map(self.pieces.__getitem__, words))

    def library_ids(self, text: str | None) -> bytes:
        """Bytes of the ids that the library gives a text: literals of added tokens are these tokens."""
        if not text or self.cut is None or not self.cut.search(text):
            return self.ids(text)
        return b"".join(self.added[part] if part in self.added else self.ids(part) for part in self.cut.split(text))


def added_tokens(path: str) -> dict[str, bytes]:
    """Literal -> bytes of its id, by the library's own vocabulary file beside the ranks, longest first; none where there is no such file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as lines:
        found = {token["content"]: pack([token["id"]]) for token in json.load(lines)["added_tokens"]}
    return dict(sorted(found.items(), key=lambda item: -len(item[0])))


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = path or ""
    if key not in _encoders:
        _encoders[key] = Encoder(path)
    return _encoders[key]
