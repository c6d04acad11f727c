"""Byte-level BPE ids for whole texts, with a bounded memo of repeated words."""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from functools import cached_property, lru_cache
from pathlib import Path

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Words kept before the memo starts anew, and the longest word kept.
MEMO, MEMO_CHARS = 120_000, 32
#: White space around a blank where cutting at it could change how white space groups.
ODD = re.compile(r"\s \s|\s \Z")


def _bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def default_path() -> str:
    return str(public_tokenizers.path("byte_bpe_50k.json"))


class _Memo(dict):
    """Ids of words behind a blank. Two generations: when the young one is full it becomes the old one, out of which words that come up again are taken over."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(" " + word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """Encodes as the tokenizer file does, without added special tokens.

    The vocabulary's ranks beside the file drive a faster encoder of the same merges. The
    pre-tokenizer never joins a blank to what stands before it, so that a text can be cut
    before a blank unless white space runs on there. Texts that hold one of
    the file's special tokens go to the file's own tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.special = [t["content"] for t in json.loads(Path(path).read_bytes())["added_tokens"] if t["special"]]
        ranks_file = Path(path).with_suffix(".tiktoken")
        self.fast = None
        if ranks_file.exists():
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.open("rb"))}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo = _Memo(self._plain)

    @cached_property
    def own(self) -> Tokenizer:
        """The file's own tokenizer, loaded where a text needs it."""
        return Tokenizer.from_file(self.path)

    def _plain(self, text: str) -> bytes:
        return _bytes(self.fast.encode_ordinary(text))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.fast is None or any(s in text for s in self.special):
            return _bytes(self.own.encode(text, add_special_tokens=False).ids)
        if ODD.search(text):
            return self._plain(text)
        first, *rest = text.split(" ")
        return b"".join([self._plain(first), *map(self.memo.__getitem__, rest)])


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(path)
