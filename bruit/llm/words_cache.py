"""A bounded memo of what a tokenizer makes of chunks of text, one for each Python worker."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain


class ChunkCache(dict):
    """chunk -> encoded bytes.

    The unknown chunks of a group of texts are encoded together by
    ``encode_many``.  When the memo would hold more than ``limit`` chunks, it
    starts anew with those of the group at hand, among which are the frequent
    ones; chunks over ``max_chars`` aren't kept.  So its memory is bounded by
    ``limit`` and one group, whatever the texts.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 800_000, max_chars: int = 64):
        super().__init__()
        self.encode_many, self.limit, self.max_chars = encode_many, limit, max_chars

    def encode_texts(self, texts: list[list[str]]) -> list[bytes]:
        """The joined bytes of each text, given as its chunks."""
        have = set(chain.from_iterable(texts))
        new = [c for c in have if c not in self]
        if len(self) + len(new) > self.limit:
            kept = {c: self[c] for c in have if c in self}
            self.clear()
            self.update(kept)
        if new:
            self.update(zip(new, self.encode_many(new), strict=True))
        long = [c for c in new if len(c) > self.max_chars]
        out = [b"".join(map(self.__getitem__, chunks)) for chunks in texts]
        for c in long:
            del self[c]
        return out
