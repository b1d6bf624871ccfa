"""Byte-level BPE encoding and decoding over a hierarchical-bitmap rank queue.

All new pre-tokens of a slice form one linked list of byte tokens, with
no link across their borders.  The queue has a bucket per merge rank
holding the list positions whose pair has that rank; a three-level bitmap
of 64-way words over the ranks finds the lowest filled bucket by
find-first-set.  A bucket is drained at once: positions whose pair has
changed meanwhile are stale and skipped, the leftmost of each pre-token
is merged (in numpy, or one by one where they are few), and the others go
back, since a merge may have made a pair of lower rank that goes first.
A push or pop costs the same at any rank.  A pre-token of over ``LONG``
bytes is merged by itself: its buckets are heaps, drained in order until a
merge makes a pair of lower rank, so a merge costs O(log n) and a million
equal letters a few seconds.  A pre-token that is itself in the vocabulary
is one id, as in tiktoken.

Defined cases: a null or empty text has no ids and decodes to nothing;
repeated rows are encoded each; an empty table gives no rows; other
columns are kept.  A file path must be readable on every executor.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.llm.common import slices, table, texts_of
from toposim.llm.cuts import PieceTable
from toposim.session import ship


class RankQueue:
    """Buckets of positions by rank; ``pop`` empties the lowest."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, positions) -> None:
        """Adds a position or an array of positions."""
        b = self.buckets.get(rank)
        if b is not None:
            b.append(positions)
            return
        self.buckets[rank] = [positions]
        i, j = rank >> 6, rank >> 12
        self.low[i] |= 1 << (rank & 63)
        self.mid[j] |= 1 << (i & 63)
        self.top |= 1 << j

    def pop(self) -> tuple[int, list] | None:
        top = self.top
        if not top:
            return None
        j = (top & -top).bit_length() - 1
        w = self.mid[j]
        i = j << 6 | (w & -w).bit_length() - 1
        w = self.low[i]
        rank = i << 6 | (w & -w).bit_length() - 1
        w &= w - 1
        self.low[i] = w
        if not w:
            self.mid[j] &= ~(1 << (i & 63))
            if not self.mid[j]:
                self.top &= ~(1 << j)
        return rank, self.buckets.pop(rank)


    def put(self, rank: int, bucket: list) -> None:
        """Gives back what is left of a popped bucket."""
        self.push(rank, 0)
        self.buckets[rank] = bucket


class Vocabulary:
    """Ranks of byte strings, and of all pairs of ids that may merge."""

    #: Up to so many positions a bucket is drained one by one.
    FEW = 6
    #: Pre-tokens of more bytes are merged by themselves, their buckets kept as heaps.
    LONG = 4096

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for b, r in ranks.items():
            self.bytes[r] = b
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs: dict[int, int] = {}
        for b, r in ranks.items():
            for k in range(1, len(b)):
                x, y = ranks.get(b[:k]), ranks.get(b[k:])
                if x is not None and y is not None:
                    self.pairs[x * self.size + y] = r
        keys = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs))
        by = np.argsort(keys)
        self.keys, self.values = keys[by], np.fromiter(self.pairs.values(), np.int32, len(keys))[by]

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 where they don't merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit bytes."""
        whole = [self.ranks.get(w) for w in words]
        open_words = [w for w, r in zip(words, whole) if r is None and len(w) <= self.LONG]
        merged = iter(self._merge(open_words)) if open_words else iter(())
        return [r.to_bytes(4, "little") if r is not None else self._merge_long(w) if len(w) > self.LONG else next(merged)
                for w, r in zip(words, whole)]

    def _merge_long(self, raw: bytes) -> bytes:
        """One long pre-token.  A bucket is a heap of positions: it is drained
        in order until a merge makes a pair of lower rank, and the rest is
        given back, so every merge costs O(log n)."""
        ids = self.single[np.frombuffer(raw, np.uint8)]
        n = len(ids)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[-1] = -1
        rank = np.full(n, -1, np.int32)
        rank[:-1] = self.of_pairs(ids[:-1], ids[1:])
        queue = RankQueue(self.size)
        by = np.argsort(rank, kind="stable")
        by = by[np.searchsorted(rank[by], 0):]
        cuts = np.flatnonzero(np.diff(rank[by])) + 1
        for pos in np.split(by, cuts) if len(by) else ():
            queue.put(int(rank[pos[0]]), pos.tolist())  # in order, so a heap
        v_ids, v_nxt, v_prv, v_rank = map(memoryview, (ids, nxt, prv, rank))
        get, size, buckets = self.pairs.get, self.size, queue.buckets

        def add(r: int, a: int) -> None:
            b = buckets.get(r)
            if b is None:
                queue.push(r, a)
            else:
                heappush(b, a)

        while (got := queue.pop()) is not None:
            r, heap = got
            while heap:
                a = heappop(heap)
                if v_rank[a] != r:
                    continue  # stale
                b = v_nxt[a]
                c = v_nxt[b]
                v_ids[a] = r
                v_ids[b] = v_rank[b] = v_rank[a] = -1
                v_nxt[a] = c
                x = y = -1
                if c >= 0:
                    v_prv[c] = a
                    v_rank[a] = x = get(r * size + v_ids[c], -1)
                    if x >= 0:
                        add(x, a)
                p = v_prv[a]
                if p >= 0:
                    v_rank[p] = y = get(v_ids[p] * size + r, -1)
                    if y >= 0:
                        add(y, p)
                if heap and (0 <= x < r or 0 <= y < r):
                    queue.put(r, heap)
                    break
        return ids[ids >= 0].astype("<u4").tobytes()

    def _merge(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[ends - sizes] = -1
        rank = np.full(n, -1, np.int32)  # of the pair that starts here, now
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self.of_pairs(ids[inner], ids[inner + 1])
        queue = RankQueue(self.size)
        push = queue.push

        def push_all(pos: np.ndarray) -> None:
            r = rank[pos]
            pos, r = pos[r >= 0], r[r >= 0]
            if not len(pos):
                return
            by = np.argsort(r, kind="stable")
            pos, r = pos[by], r[by]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, a, b in zip(r[np.concatenate(([0], cuts))].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(r)]):
                push(k, pos[a:b])

        push_all(inner)
        # plain views for the one-by-one drain
        v_ids, v_nxt, v_prv, v_rank, v_word = map(memoryview, (ids, nxt, prv, rank, word))
        get, size, few = self.pairs.get, self.size, self.FEW
        while (got := queue.pop()) is not None:
            r, chunks = got
            if len(chunks) <= few and all(type(c) is int or len(c) <= few for c in chunks):
                flat = [c for x in chunks for c in ((x,) if type(x) is int else x.tolist())]
            else:
                flat = None
            if flat is not None and len(flat) <= few:
                if len(flat) > 1:
                    flat = sorted(set(flat))
                seen = -1
                for a in flat:
                    if v_rank[a] != r:
                        continue  # stale
                    if v_word[a] == seen:
                        push(r, a)
                        continue
                    seen = v_word[a]
                    b = v_nxt[a]
                    c = v_nxt[b]
                    v_ids[a] = r
                    v_ids[b] = v_rank[b] = -1
                    v_nxt[a] = c
                    if c >= 0:
                        v_prv[c] = a
                        v_rank[a] = x = get(r * size + v_ids[c], -1)
                        if x >= 0:
                            push(x, a)
                    else:
                        v_rank[a] = -1
                    p = v_prv[a]
                    if p >= 0:
                        v_rank[p] = x = get(v_ids[p] * size + r, -1)
                        if x >= 0:
                            push(x, p)
                continue
            pos = np.unique(np.concatenate([np.atleast_1d(np.asarray(c, np.int32)) for c in chunks])) if len(chunks) > 1 else chunks[0]
            pos = pos[rank[pos] == r]  # the others are stale
            if not len(pos):
                continue
            w = word[pos]
            first = np.concatenate(([True], w[1:] != w[:-1]))
            if not first.all():
                push(r, pos[~first])
                pos = pos[first]
            b = nxt[pos]
            c = nxt[b]
            ids[pos] = r
            ids[b] = -1
            rank[b] = -1
            nxt[pos] = c
            on = c >= 0
            rank[pos] = -1
            left, right = pos[on], c[on]
            prv[right] = left
            p = prv[pos]
            some = p >= 0
            before, here = p[some], pos[some]
            rank[left] = self.of_pairs(ids[left], ids[right])
            rank[before] = self.of_pairs(ids[before], ids[here])
            push_all(np.concatenate((left, before)))
        alive = ids >= 0
        flat = ids[alive].astype("<u4").tobytes()
        cut = (4 * np.cumsum(alive)[ends - 1]).tolist()
        return [flat[a:b] for a, b in zip([0, *cut], cut)]


class Encoder:
    """Texts to id bytes, with tables of pre-tokens and of pieces."""

    def __init__(self, path: str, pattern: str, limit: int = 300_000):
        import regex

        self.vocabulary = Vocabulary.load(path)
        self.find = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.limit = limit
        self.pieces = PieceTable(self._pieces, limit)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.words) > self.limit:
            self.words.clear()
        split = [self._cut(p) for p in pieces]
        new = list(set().union(*split).difference(self.words))
        self.words.update(zip(new, self.vocabulary.encode([w.encode() for w in new])))
        get = self.words.__getitem__
        return [get(s[0]) if len(s) == 1 else b"".join(map(get, s)) for s in split]

    def _cut(self, piece: str) -> list[str] | tuple[str, ...]:
        """Pre-tokens of a piece.  Letters alone (after one space) are one match
        of the pattern, a stop after them another; the rest is searched."""
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha():
            return (piece,)
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return (piece[:-1], word[-1])
        return self.find(piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in slices([len(t) for t in texts]):
            out += self.pieces.lookup(texts[a:b])
        return out


_KEPT: dict[tuple, object] = {}


def _kept(make, *key):
    """One object per Python worker and key."""
    if (make, *key) not in _KEPT:
        _KEPT[(make, *key)] = make(*key)
    return _KEPT[(make, *key)]


def decoded(ids: bytes, vocabulary: Vocabulary) -> bytes:
    return b"".join(map(vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids as little-endian unsigned 32-bit integers (binary)."""
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(_kept(Encoder, path, pattern).encode(texts_of(s)), dtype=object)

    return docs.withColumn(out, ids(F.col(f"`{text}`")))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes of the ids (a null is read as no ids)."""
    ship(encoded.sparkSession)

    @F.pandas_udf("binary")
    def content(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vocabulary = _kept(Vocabulary.load, path)
            yield pd.Series([decoded(x or b"", vocabulary) for x in s], dtype=object)

    return encoded.withColumn(out, content(F.col(f"`{ids}`")))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` and ``decoded``, encoded and decoded in one worker."""
    ship(docs.sparkSession)

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _kept(Encoder, path, pattern)
        for s in batches:
            ids = encoder.encode(texts_of(s))
            yield pd.DataFrame({"ids": ids, "decoded": [decoded(x, encoder.vocabulary) for x in ids]})

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded")]
    d = docs.select(F.struct(*rest).alias("__row"), both(F.col(f"`{text}`")).alias("both"))
    return d.select("__row.*", "both.ids", "both.decoded")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    d = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, P.PATTERN)
    return d.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                    F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
