"""N-gram Jaccard join by T-occurrence search.

A document is the set of its five-word shingles; two documents link when
the sets' Jaccard similarity is at least 0.8.  Linked sets of n shingles
share at least T = ceil(0.8 n) of them, so a partner must occur on T of
the inverted lists of a document's shingles.

1. Equal sets collapse to one representative (128-bit digest of the set).
2. Long lists (the shingles of shared passages) are found by counting
   shingles over all documents; they come last in every document's order.
   Leaving the T - 1 longest of a document's lists out, a partner must be
   on one of the n - T + 1 short ones, so only those are merged into
   inverted lists, by Spark's shuffle.  Any order gives the same links.
3. Lists with two or more members give every member its list's pivot (per
   band of sizes, the member with the fewest lists of its own), never all
   pairs.  Pairs whose sizes, or the places of the shared shingle in their
   orders, rule the overlap out are dropped.  The rest is searched in
   buckets: an inverted index of a bucket's pivots is built, each query's
   short lists are heap-merged, its long ones probed by binary search
   (DivideSkip), and what reaches T is checked against the exact
   similarity.  A pivot with many queries is repeated in several buckets.
4. Links make components.  A list whose members lie in one component is
   finished; in the others the possible pairs of different components are
   listed block by block and searched in the same way.  So no link between
   different components is lost, and copies never meet in pairs.

Shingles are 64-bit hashes of words: within a pair of documents of
1,000 words a false match has a chance under 1e-13.

Defined cases: a null or empty text has an empty set and is its own
component; every row is judged by its own set, so equal rows get equal results; a null
doc_id is searched for nobody and has a null component unless its set has
a document with an id; an empty table gives no rows; other columns are
ignored by ``link`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from heapq import merge
from math import log2
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.llm.common import carried, materialize, slices, table, texts_of
from toposim.llm.components import connected
from toposim.session import ship

WORDS, PERCENT = 5, 80
#: Shingles counted at once in a task, and the least count that a task reports.
WINDOW, REPORT = 2_000_000, 2
#: Entries of the table of long lists (16 bytes each); it only orders lists.
LONG_LISTS = 1_000_000
#: Queries of a pivot in one bucket, members of a list in one block, rows in a bucket.
QUERIES, BLOCK, BUCKET = 4_000, 1_000, 2_000
#: Postings in a range of shingles (24 bytes each).
RANGE = 1_000_000
#: Ids that are broadcast at most (16 bytes each).
BROADCAST_IDS = 1_000_000
MU = 0.02
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _ODD
    x ^= x >> np.uint64(32)
    return x


#: A 64-bit value per byte, and the base of the word polynomial with its inverse.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2 ** 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words over so many bytes are digested one by one: only such words can be
#: built to collide in a polynomial modulo 2^64.
_LONG_WORD = 512
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(k: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the base (0) or its inverse (1)."""
    if len(_powers[k]) < n:
        f = np.full(max(n, 1 << 20), (_BASE, _INVERSE)[k], np.uint64)
        f[0] = 1
        _powers[k] = np.cumprod(f)
    return _powers[k][:n]


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of ``raw``, ASCII letters lower-cased."""
    buf = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(0, len(buf)), out=total[1:])
    h = (total[last] - total[first]) * _power(1, len(buf))[first]
    for i in np.flatnonzero(last - first > _LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[first[i]:last[i]].tobytes(), digest_size=8).digest(), "little")
    return _mix(h), first


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _cut(raw: bytes, limit: int = 1 << 21) -> Iterator[bytes]:
    """``raw`` in parts of about ``limit`` bytes that end at white space."""
    at = 0
    while len(raw) - at > limit:
        end = max(raw.rfind(c, at, at + limit) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end <= at:
            found = [i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := raw.find(c, at + limit)) >= 0]
            end = min(found, default=len(raw))
        yield raw[at:end]
        at = end
    yield raw[at:]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's shingles: distinct, ascending."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw)
    hashes, firsts, at = [], [], 0
    for part in _cut(joined):
        h, first = _words(part)
        hashes.append(h)
        firsts.append(first + at)
        at += len(part)
    flat, first = np.concatenate(hashes), np.concatenate(firsts)
    borders = np.searchsorted(first, np.cumsum([0, *(len(r) + 1 for r in raw)])).tolist()
    x = flat[:max(len(flat) - WORDS + 1, 0)].copy()
    for i in range(1, WORDS):
        x = _mix(x)
        x += flat[i:i + len(x)]
    x = _mix(x * _ODD)
    out = []
    for r, a, b in zip(raw, borders, borders[1:]):
        if b - a >= WORDS:
            out.append(_distinct(x[a:b - WORDS + 1]))
        elif b > a:
            whole = hashlib.blake2b(b" ".join(r.lower().split()), digest_size=8, person=b"short").digest()
            out.append(np.frombuffer(whole, "<u8"))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _sets(texts: list[str]) -> Iterator[np.ndarray]:
    for a, b in slices([len(t) for t in texts], 1_000_000):
        yield from shingle_sets(texts[a:b])


def needed(n: int) -> int:
    """Overlap that any partner of a set of ``n`` needs."""
    return -(-PERCENT * n // 100)


def links(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= PERCENT * (a + b - overlap)


# --- long lists ----------------------------------------------------------

def long_lists(docs: DataFrame, most: int = LONG_LISTS) -> tuple[np.ndarray, np.ndarray]:
    """(shingles ascending, their counts): the most frequent shingles, at most ``most``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def flush() -> pd.DataFrame:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= REPORT
            return pd.DataFrame({"h": h[often].view(np.int64), "n": c[often].astype(np.int64)})

        for pdf in batches:
            for s in _sets(texts_of(pdf["text"])):
                held.append(s)
                n += len(s)
                if n >= WINDOW:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    counts = materialize(docs.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    # the least power of two for which few enough are left; 64 rows at most
    tiers = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("bits")).collect()
    total, least = 0, None
    for r in tiers:
        total += r["k"]
        if total > most:
            break
        least = r["least"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counts.where(F.col("n") >= least).toArrow()  # at most ``most`` rows of 16 bytes
    h = rows["h"].to_numpy().view(np.uint64)
    by = np.argsort(h)
    return h[by], rows["n"].to_numpy()[by]


def short_lists(s: np.ndarray, long: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The shingles of ``s`` whose lists are merged: all but the T - 1 longest."""
    p = len(s) - needed(len(s)) + 1
    weight = np.zeros(len(s), np.int64)
    if len(long):
        at = np.minimum(np.searchsorted(long, s), len(long) - 1)
        hit = long[at] == s
        weight[hit] = count[at[hit]]
    return s[np.lexsort((s, weight))[:p]]


# --- search --------------------------------------------------------------

class Index:
    """Inverted lists of a few sets: ids by shingle, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        ids = np.repeat(np.arange(len(sets)), self.sizes)
        by = np.lexsort((ids, flat))
        self.keys, self.ids = flat[by], ids[by]

    def search(self, q: np.ndarray) -> list[int]:
        """Ids of the sets that link with ``q``, by DivideSkip."""
        lo, hi = np.searchsorted(self.keys, q, "left"), np.searchsorted(self.keys, q, "right")
        full = hi > lo
        t = needed(len(q))
        if not len(q) or int(full.sum()) < t:
            return []
        lists = sorted(zip((hi - lo)[full].tolist(), lo[full].tolist(), hi[full].tolist()))
        longest = lists[-1][0]
        n_long = min(t - 1, int(t / (MU * log2(longest + 1) + 1))) if longest > 1 else t - 1
        short, long = lists[:len(lists) - n_long], lists[len(lists) - n_long:]
        ids, found = self.ids, []
        counts: dict[int, int] = {}
        for i in merge(*(ids[a:b].tolist() for _, a, b in short)):
            counts[i] = counts.get(i, 0) + 1
        probes = None
        for i, c in counts.items():
            if c < t - n_long:
                continue
            if probes is None:
                probes = [ids[a:b].tolist() for _, a, b in long]
            left = len(probes)
            for p in probes:
                if c + left < t:
                    break
                left -= 1
                at = bisect_left(p, i)
                c += at < len(p) and p[at] == i
            if links(c, len(q), self.sizes[i]):
                found.append(i)
        return found


_LINKS = "a long, b long"


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (bucket, kind, id, set) sorted by bucket and kind: a bucket's
    index (0), then its queries (1).  Yields the links found."""
    bucket, index, ids, sets = None, None, [], []
    for pdf in batches:
        out = []
        for b, kind, i, raw in zip(pdf["bucket"].tolist(), pdf["kind"].tolist(), pdf["id"].tolist(), pdf["set"]):
            if b != bucket:
                bucket, index, ids, sets = b, None, [], []
            s = np.frombuffer(raw, "<u8")
            if kind == 0:
                ids.append(i)
                sets.append(s)
                continue
            if index is None:
                index, sets = Index(sets), []
            out += [(i, ids[k]) for k in index.search(s) if ids[k] != i]
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _members(reps: DataFrame, given) -> DataFrame:
    """(h, id, n, pos, p): the postings of short lists with two members or more.

    Postings travel as arrays, one row per range of shingles and batch.
    Those of known long lists travel as rows, so a list that a third of
    all documents are on is never gathered in one task.
    """
    total = reps.agg(F.sum(F.size("short")).alias("k")).first()["k"] or 0
    bits = max(4, (int(total) // RANGE).bit_length())

    def flat(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        sizes = pdf["short"].map(len).to_numpy(np.int64)
        h = np.concatenate([np.asarray(x, np.int64) for x in pdf["short"]]).view(np.uint64) if len(pdf) else np.empty(0, np.uint64)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        longest = given.value[0]
        known = np.zeros(len(h), bool)
        if len(longest):
            known = longest[np.minimum(np.searchsorted(longest, h), len(longest) - 1)] == h
        return h, np.repeat(pdf["id"].to_numpy(np.int64), sizes), np.repeat(pdf["n"].to_numpy(np.int64), sizes), pos, np.repeat(sizes, sizes), known

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, ids, n, pos, p, known = flat(pdf)
            yield pd.DataFrame({"h": h[known].view(np.int64), "id": ids[known], "n": n[known], "pos": pos[known], "p": p[known]})

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, ids, n, pos, p, known = flat(pdf)
            part = (h >> np.uint64(64 - bits)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            by = by[~known[by]]
            part = part[by]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
                k = by[a:b]
                out.append((int(part[a]), h[k].tobytes(), ids[k].astype("<i8").tobytes(), np.stack([n[k], pos[k], p[k]]).astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["part", "h", "ids", "places"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf["h"]), "<u8")
        ids = np.frombuffer(b"".join(pdf["ids"]), "<i8")
        places = np.concatenate([np.frombuffer(x, "<i4").reshape(3, -1) for x in pdf["places"]], axis=1)
        by = np.argsort(h, kind="stable")
        same = h[by][1:] == h[by][:-1]
        k = by[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        return pd.DataFrame({"h": h[k].view(np.int64), "id": ids[k], "n": places[0, k], "pos": places[1, k], "p": places[2, k]})

    schema = "h long, id long, n long, pos long, p long"
    source = reps.select("id", "n", "short")
    met = source.mapInPandas(scatter, "part long, h binary, ids binary, places binary").groupBy("part").applyInPandas(meet, schema)
    return met.unionByName(source.mapInPandas(rows, schema))


def verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links (a, b) among ``pairs`` (id, pivot), which may repeat.

    First the short lists: sets of n and m that overlap by T share at least
    T - max(needed(n), needed(m)) + 1 of them.  Then the whole sets: pivots
    are dealt over buckets, one with many queries over several; a bucket's
    pivots are indexed and its queries searched against them.  Only the
    texts that are still named are cut into sets again.
    """
    spark = docs.sparkSession
    side = lambda key, n, short: reps.select(F.col("id").alias(key), F.col("n").alias(n), F.col("short").alias(short))
    both = pairs.distinct().join(side("id", "n", "s"), "id").join(side("pivot", "m", "t"), "pivot")
    overlap = F.ceil(PERCENT * (F.col("n") + F.col("m")) / F.lit(100 + PERCENT))
    least = overlap - F.ceil(PERCENT * F.greatest("n", "m") / F.lit(100)) + 1
    pairs = materialize(both.where(F.size(F.array_intersect("s", "t")) >= least).select("id", "pivot").distinct(), "pairs")
    n = max(1, -(-pairs.count() // BUCKET)) * 8
    wanted = materialize(pairs.select("id").union(pairs.select("pivot")).distinct(), "wanted")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["doc_id"], "set": [s.tobytes() for s in _sets(texts_of(pdf["text"]))]})

    sets = by_id(docs, wanted, "doc_id", "left_semi").mapInPandas(gather, "id long, set binary")
    shares = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts"))
    dealt = pairs.join(shares, "pivot").select("id", "pivot", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"))
    bucket = F.pmod(F.xxhash64("pivot", "salt"), F.lit(n)).cast("int").alias("bucket")
    rows = dealt.select(bucket, F.lit(1).alias("kind"), "id").unionByName(
        dealt.select(bucket, F.lit(0).alias("kind"), F.col("pivot").alias("id"))).distinct()
    rows = materialize(rows, "dealt")
    if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    rows = sets.join(rows, "id").select("bucket", "kind", "id", "set")
    parts = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "id")
    return materialize(rows.mapInPandas(_search, _LINKS), "found")


def _possible(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Can two sets of n and m link whose first common shingle stands at
    ``pos`` and ``at`` of their orders?  What follows must reach the overlap."""
    most = F.least(n - pos, m - at)
    return 100 * most >= PERCENT * (n + m - most)


def _open_pairs(members: DataFrame) -> DataFrame:
    """(id, pivot) of members (h, id, n, pos, component, blocks) of one list
    that may link, of different components; lists are searched in blocks."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    m = members.select("*", block.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    m = m.select(F.xxhash64("h", F.least("x", "y"), F.greatest("x", "y")).alias("unit"), "h", (F.col("x") <= F.col("y")).alias("left"),
                 (F.col("x") >= F.col("y")).alias("right"), "id", "n", "pos", "component")

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            tail = pdf["unit"].to_numpy() == pdf["unit"].iloc[-1]
            rest = pdf[tail]
            if not tail.all():
                yield possible(pdf[~tail])
        if rest is not None:
            yield possible(rest)

    def possible(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[np.ndarray] = []
        unit, left, right, ids, n, pos, comp = (pdf[c].to_numpy() for c in ("unit", "left", "right", "id", "n", "pos", "component"))
        edges = np.flatnonzero(np.diff(unit)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(unit)]):
            i, j = a + np.flatnonzero(left[a:b]), a + np.flatnonzero(right[a:b])
            most = np.minimum((n[i] - pos[i])[:, None], (n[j] - pos[j])[None, :])
            ok = (100 * most >= PERCENT * (n[i][:, None] + n[j][None, :] - most)) & (comp[i][:, None] != comp[j][None, :])
            x, y = np.nonzero(ok)
            if len(x):
                out.append(np.unique(np.stack([ids[i[x]], ids[j[y]]], axis=1), axis=0))
        out = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame(out, columns=["id", "pivot"], dtype="int64")

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = m.repartition(parts, "unit").sortWithinPartitions("unit").mapInPandas(pair, "id long, pivot long")
    return d.select(F.greatest("id", "pivot").alias("id"), F.least("id", "pivot").alias("pivot"))


def by_id(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` to a written table of ids; broadcast only when counted small."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids.withColumnRenamed(ids.columns[0], "__id"), F.col(key) == F.col("__id"), how)


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long, weight = long_lists(docs)
    given = docs.sparkSession.sparkContext.broadcast((long, weight))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        longest, count = given.value
        for pdf in batches:
            n, digest, short = [], [], []
            for s in _sets(texts_of(pdf["text"])):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                short.append(short_lists(s, longest, count).view(np.int64) if len(s) else np.empty(0, np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": n, "digest": digest, "short": pd.Series(short, dtype=object)})

    marks = materialize(docs.mapInPandas(mark, "doc_id long, n long, digest binary, short array<long>"), "marks")
    # 1. representatives
    reps = materialize(marks.where("n > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("short").alias("short")), "reps")
    # 2. inverted lists with two members or more
    multi = materialize(_members(reps, given), "members")
    # 3. against the pivots: the member with the fewest lists of its own, per list and size band
    own = multi.groupBy("id").agg((F.first("p") - F.count("*")).alias("u"))
    ranked = multi.join(own, "id")
    stars = None
    for shift in (0.0, 0.5):
        band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / PERCENT)) + shift).alias("band")
        by = ranked.select("h", band, "id", "n", "pos", "u")
        pivots = by.groupBy("h", "band").agg(F.min(F.struct("u", "id", "n", "pos")).alias("p"), F.count("*").alias("k")).where("k > 1")
        got = by.join(pivots.select("h", "band", "p"), ["h", "band"]).where(
            (F.col("id") != F.col("p.id")) & _possible(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
        got = got.select("id", F.col("p.id").alias("pivot"))
        stars = got if stars is None else stars.unionByName(got)
    star = verify(docs, reps, stars)
    comp = connected(star)
    # 4. possible pairs in lists that still hold several components
    member = multi.join(comp, "id", "left").select("h", "id", "n", "pos", F.coalesce("component", "id").alias("component"))
    mixed = member.groupBy("h").agg(F.count("*").alias("k"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    mixed = member.join(mixed.select("h", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "h")
    rest = materialize(verify(docs, reps, _open_pairs(mixed)), "rest")
    if rest.limit(1).count():
        comp = connected(star.unionByName(rest))
    names = reps.select("digest", "id").join(comp, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    return marks.select("doc_id", "n", "digest").join(names, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their component."""
    gone = materialize(link(docs).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    rows = carried(docs).withColumn("doc_id", F.col("__row.doc_id"))
    return by_id(rows, gone, "doc_id", "left_anti").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
