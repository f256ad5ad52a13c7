"""Byte-level BPE encoders that work word by word with a bounded cache per Python worker."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: White space followed by a space: cutting before that space could change the matches.
UNSAFE = re.compile(r"\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit integers, equal to ``encode(text)``.

    A text is cut before each space that follows something else than white space. No match of
    the pattern spans such a place, so the ids of the parts are the ids of the text. The ids of
    at most ``limit`` different parts of at most 64 characters are kept; others are encoded anew.
    """

    def __init__(self, encode: Callable[[str], list[int]], limit: int = 300_000):
        self.encode, self.limit = encode, limit
        self.kept: dict[str, bytes] = {}

    def _fresh(self, part: str) -> bytes:
        ids = np.asarray(self.encode(" " + part), dtype="<u4").tobytes()
        if len(self.kept) < self.limit and len(part) <= 64:
            self.kept[part] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if UNSAFE.search(text):
            return np.asarray(self.encode(text), dtype="<u4").tobytes()
        head, *parts = text.split(" ")
        out = list(map(self.kept.get, parts))
        if None in out:
            out = [self._fresh(p) if x is None else x for x, p in zip(out, parts, strict=True)]
        first = np.asarray(self.encode(head), dtype="<u4").tobytes() if head else b""
        return first + b"".join(out)


def read_added(path: str) -> dict[str, int]:
    """Added tokens of a ``tokenizers`` file, such as the end of a text: string -> id."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class AddedEncoder:
    """Ids of whole texts in which added tokens stand for themselves, as ``tokenizers`` reads them.

    A text is cut at each added token, the longest first where two begin alike; what lies between is
    encoded on its own.
    """

    def __init__(self, encode: Callable[[str], bytes], added: dict[str, int]):
        self.encode, self.ids = encode, {t: np.asarray([i], dtype="<u4").tobytes() for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def __call__(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self.encode(text)
        return b"".join(self.ids[p] if i % 2 else self.encode(p) for i, p in enumerate(self.cut.split(text)))


@lru_cache(maxsize=2)
def json_tokenizer(path: str):
    """The tokenizer of a ``tokenizers`` file; special strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> WordEncoder:
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return WordEncoder(own.encode_ordinary)
