"""Byte-level BPE of whole texts, with the ids of recurring chunks remembered.

The pre-token pattern never lets a pre-token run over a white-space character that has no other white
space beside it, but for a single leading space.  So a text in which no two white-space characters are
adjacent, and which has only spaces and line feeds, falls apart into chunks (one white-space character and
what follows it) that can be encoded each alone.  Chunks recur far more often than they are new, so the
encoder sees only new ones.  Other texts go to the encoder whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

#: Unicode's White_Space property without space and line feed, and what Python takes for white space besides.
_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
_UNUSUAL = (*_SPACES, "  ", " \n", "\n ", "\n\n")

#: Longer chunks are not kept; with the number that are kept that bounds the table's memory.
LONGEST_KEPT, MOST_KEPT = 48, 400_000


def falls_apart(text: str) -> bool:
    """Whether each single space and line feed of ``text`` starts a chunk of its own."""
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in _UNUSUAL)


def packed(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


class ChunkTable(dict):
    """What an encoder gives for a chunk. A key is a word, which stands for a space and the word, or a line feed and a word.

    Two generations are kept: when the younger is full it becomes the older one, and what is asked for again comes back.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = MOST_KEPT):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self.encode(key if key[0] == "\n" else " " + key)
        if len(key) <= LONGEST_KEPT:
            self[key] = out
        return out

    def whole(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers; none for null."""
        if not text:
            return b""
        if not falls_apart(text):
            return self.encode(text)
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        first, *words = text.replace("\n", " \n").split(" ")
        return self.encode(first) + b"".join(map(self.__getitem__, words))
