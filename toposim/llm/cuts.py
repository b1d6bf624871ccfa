"""Cutting texts at spaces where a byte-level BPE's split pattern must cut.

The pattern lets a word take the one space before it, and white space
before that forms a match of its own.  So a text may be cut before every
space unless white space stands on both sides of it (or before it at the
end): there a run of three or more characters holds together.  Pieces
repeat, so their ids are kept in a bounded table per Python worker.
"""

from __future__ import annotations

import re
from typing import Callable, Iterable

_HELD = re.compile(r"\s (?:\s|\Z)")


class PieceTable:
    """Ids of pieces, as little-endian unsigned 32-bit bytes.

    ``encode`` maps a list of strings to their ids' bytes.  The table is
    emptied when it holds ``limit`` entries; that only costs time.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 300_000):
        self.encode, self.limit = encode, limit
        self.table: dict[str, bytes] = {}

    def lookup(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of every text, whole."""
        cut = []
        for t in texts:
            if _HELD.search(t):
                cut.append((t, ()))
            else:
                first, *rest = t.split(" ")
                cut.append((first, rest))
        if len(self.table) > self.limit:
            self.table.clear()
        table = self.table
        new = set().union(*(rest for _, rest in cut)).difference(table)
        missing = list(new)
        heads = [first for first, _ in cut]
        found = self.encode([" " + p for p in missing] + heads)
        table.update(zip(missing, found))
        get = table.__getitem__
        return [head + b"".join(map(get, rest)) if rest else head for head, (_, rest) in zip(found[len(missing):], cut)]
