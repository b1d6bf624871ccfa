"""Embedding near-duplicates by cross-polytope hashing.

Vectors of one length are padded to a power of two and turned by three
rounds of random signs and a fast Hadamard transform.  The hash is the
coordinate of largest size with its sign (a corner of the cross-polytope);
a table's bucket joins several such corners.  ``plan`` takes corners from
the number of vectors, so that a bucket holds about ``BUCKET`` of them, and
tables and probes from measured collision rates, so that a pair exactly at
the least similarity is found with probability ``FOUND``, closer ones
oftener.

1. Equal vectors collapse to one with a count.
2. Every vector goes to its bucket and to the next best ones of each table
   (multiprobe: one corner exchanged for the next largest coordinate).
3. A bucket of more than ``BLOCK`` rows is cut into blocks by hash, and
   pairs of blocks go to different tasks; no key is one task's.
4. In a task all candidates are compared in double precision.  A pair that
   meets in several buckets counts in the first of them only, which both
   vectors' hashes tell, so links are counted without a list of pairs: a
   task returns each vector's links and a spanning forest of what it saw.
5. Components are those of the forests' edges.

Comparing is quadratic within a dense group of different vectors (all of
them are links that the count must hold), in block pairs over all tasks;
the rows shuffled for such a group of m are m * m / BLOCK.

Defined cases: vectors that are null, zero, empty or hold a null or
non-finite component link with nothing; vectors of different lengths never
link; repeated rows are vectors of their own, linked with one another; a
null id is linked like others, and is no component's name unless no member
has an id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.llm.common import lookup_join, materialize, table
from toposim.llm.components import connected
from toposim.session import ship

LEAST = 0.95
#: Vectors a bucket holds on average, rows of a block, and the chance of finding a pair at the threshold.
BUCKET, BLOCK, FOUND = 1024, 8192, 0.995
SEED = 20240
_PROBES = (2, 3, 4, 6, 8)
_TRIALS = 4000


@dataclass(frozen=True)
class Plan:
    """Hash functions for vectors of length ``dim``: corners taken from
    ``sizes`` coordinates each, in ``tables`` tables, with ``probes``
    buckets a vector."""

    dim: int
    sizes: tuple[int, ...]
    tables: int
    probes: int

    @property
    def width(self) -> int:
        return 1 << max(0, self.dim - 1).bit_length()


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long)."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d)


def turned(x: np.ndarray, width: int, table_no: int, corner: int) -> np.ndarray:
    """Rows of ``x`` after the pseudo-random rotation of one corner."""
    signs = np.random.default_rng([SEED, table_no, corner]).integers(0, 2, (3, width)) * 2 - 1
    y = np.zeros((len(x), width))
    y[:, :x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
        y /= np.sqrt(width)
    return y


def buckets(x: np.ndarray, plan: Plan, table_no: int) -> np.ndarray:
    """(rows, probes) bucket numbers in one table, a row's own first; -1
    where a row has fewer other buckets."""
    n, most = len(x), plan.probes
    own = np.zeros(n, np.int64)
    losses, changes = [], []
    unit = 1
    for corner, size in enumerate(plan.sizes):
        y = turned(x, plan.width, table_no, corner)[:, :size]
        keep = min(most, size)
        far = np.abs(y)
        top = np.argsort(-far, axis=1, kind="stable")[:, :keep]
        value = np.take_along_axis(y, top, 1)
        digit = 2 * top + (value < 0)
        own += digit[:, 0] * unit
        far = np.abs(value)
        losses.append(far[:, :1] - far[:, 1:])
        changes.append((digit[:, 1:] - digit[:, :1]) * unit)
        unit *= 2 * size
    out = np.full((n, most), -1, np.int64)
    out[:, 0] = own
    losses, changes = np.concatenate(losses, 1), np.concatenate(changes, 1)
    pick = np.argsort(losses, axis=1, kind="stable")[:, :most - 1]
    out[:, 1:1 + pick.shape[1]] = own[:, None] + np.take_along_axis(changes, pick, 1)
    return out


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of two bucket arrays meet: one's own among the other's."""
    return (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)


def plan(dim: int, count: int, least: float = LEAST, bucket: int = BUCKET, found: float = FOUND) -> Plan:
    """Hash functions for ``count`` vectors of length ``dim``."""
    width = 1 << max(0, dim - 1).bit_length()
    want, sizes = count / bucket, []
    while want > 2 * width:
        sizes.append(width)
        want /= 2 * width
    sizes.append(int(min(width, max(1, round(want / 2)))))
    # pairs exactly at the threshold, in random directions
    rng = np.random.default_rng(SEED)
    a, b = rng.normal(size=(2, _TRIALS, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = least * a + np.sqrt(max(0.0, 1 - least * least)) * b / np.where(norm > 0, norm, 1)
    best = None
    for probes in _PROBES:
        p = Plan(dim, tuple(sizes), 1, probes)
        rate = meets(buckets(a, p, 10**6), buckets(b, p, 10**6)).mean()
        rate = min(max(rate - 0.02, 0.01), 1 - 1e-9)
        tables = int(np.ceil(np.log(1 - found) / np.log(1 - rate)))
        # rows shuffled, and per row the work of a look into its bucket
        if best is None or tables * probes < best[0]:
            best = (tables * probes, Plan(dim, tuple(sizes), tables, probes))
    return best[1]


def _hashed(plans: dict[int, Plan], sizes_only: bool):
    """A vector's row for every bucket it goes to; or just the buckets' row counts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for dim, part in df.groupby("dim"):
                p = plans[dim]
                x = np.stack(part["v"].to_numpy()).astype(float)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                ids, copies, v = part["id"].to_numpy(), part["copies"].to_numpy(), list(part["v"])
                for t in range(p.tables):
                    b = buckets(x, p, t)
                    if sizes_only:
                        names, n = np.unique(b[b >= 0], return_counts=True)
                        yield pd.DataFrame({"dim": dim, "tab": t, "bucket": names, "rows": n})
                        continue
                    for k in range(p.probes):
                        some = b[:, k] >= 0
                        if not some.any():
                            continue
                        yield pd.DataFrame({"dim": dim, "tab": t, "bucket": b[some, k], "own": k == 0, "id": ids[some],
                                            "copies": copies[some], "v": [w for w, s in zip(v, some) if s]})
    return run


def _links_in(dim: int, tab: int, cross: bool, g: dict, plans: dict[int, Plan], least: float):
    """Links of one bucket, or between two of its blocks: ids, links, edges."""
    p, own, side, ids, copies = plans[dim], g["own"], g["side"], g["id"], g["copies"]
    x = g["v"].reshape(len(ids), dim)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = []
    members = np.flatnonzero(own & (side == 0) if cross else own)
    others = np.flatnonzero(side == 1) if cross else np.arange(len(ids))
    jobs = [(members, others)]
    if cross:  # the other block's members against this block's probes
        jobs.append((np.flatnonzero(own & (side == 1)), np.flatnonzero(~own & (side == 0))))
    for m, o in jobs:
        for at in range(0, len(m), 512):
            rows = m[at:at + 512]
            i, j = np.nonzero(x[rows] @ x[o].T >= least)
            i, j = rows[i], o[j]
            # two members once; never a vector with itself
            ok = np.where(own[j], ids[i] < ids[j], ids[i] != ids[j]) if not cross else np.ones(len(i), bool)
            found.append((i[ok], j[ok]))
    i = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
    j = np.concatenate([f[1] for f in found]) if found else np.zeros(0, int)
    if not len(i):
        return None
    used, inv = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = inv[:len(i)], inv[len(i):]
    # the first place where the pair meets: an earlier table, or a lower bucket of this one
    new = np.ones(len(i), bool)
    for t in range(tab):
        h = buckets(x[used], p, t)
        new &= ~_meet_at(h, a, b)
    h = buckets(x[used], p, tab)
    for s in range(0, len(a), 1 << 18):
        q, r = a[s:s + (1 << 18)], b[s:s + (1 << 18)]
        mine, theirs = h[q, 0], h[r, 0]
        lower = (theirs < mine) & (h[q] == theirs[:, None]).any(1)
        new[s:s + (1 << 18)] &= (theirs == mine) | ~lower
    c = copies[used]
    links = np.bincount(a[new], c[b[new]], len(used)) + np.bincount(b[new], c[a[new]], len(used))
    return ids[used], links.astype(np.int64), _forest(ids[used], a, b)


def _meet_at(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), bool)
    for s in range(0, len(a), 1 << 18):
        out[s:s + (1 << 18)] = meets(h[a[s:s + (1 << 18)]], h[b[s:s + (1 << 18)]])
    return out


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(id, least id of its component) for the links a-b of one task."""
    name = np.arange(len(ids))
    order = np.argsort(ids)
    rank = np.empty(len(ids), int)
    rank[order] = name
    a, b = rank[a], rank[b]
    while True:
        low = name.copy()
        np.minimum.at(low, a, name[b])
        np.minimum.at(low, b, name[a])
        np.minimum.at(low, name, low.copy())
        low = low[low]
        if (low == name).all():
            break
        name = low
    moved = name != np.arange(len(ids))
    return np.stack((ids[order][moved], ids[order][name[moved]]), 1)


def _searched(plans: dict[int, Plan], least: float):
    out = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])
    fields = ("own", "side", "id", "copies")

    def parts(batches):
        """Neighbouring rows of one key, within each Arrow batch."""
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "tab", "bucket", "pair")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in fields}
            v, offsets = b.column("v").values.to_numpy(zero_copy_only=False), b.column("v").offsets.to_numpy()
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    g = {c: cols[c][s:e] for c in fields}
                    g["v"] = v[offsets[s]:offsets[e]].astype(float)
                    yield tuple(keys[s].tolist()), g

    def run(batches):
        for key, group in groupby(parts(batches), key=lambda kg: kg[0]):
            group = [g for _, g in group]
            g = {c: np.concatenate([x[c] for x in group]) for c in (*fields, "v")}
            if len(g["id"]) < 2:
                continue
            got = _links_in(key[0], key[1], key[3] >= 0, g, plans, least)
            if got:
                ids, links, edges = got
                n = len(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((ids, edges[:, 0]))), pa.array(np.concatenate((links, np.zeros(len(edges), np.int64)))),
                    pa.array(np.concatenate((np.full(n, -1), edges[:, 1])))], schema=out)

    return run


def near(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = LEAST,
         bucket: int = BUCKET, block: int = BLOCK, found: float = FOUND) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_links (other rows of cosine
    at least ``least``), component_id (least id reachable), kept."""
    spark = df.sparkSession
    ship(spark)
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = df.select(F.col(id_col).alias("name"), F.when(good, F.col(vector)).alias("v"))
    texts = rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("copies"), F.min("name").alias("first"))
    reps = materialize(texts.select(F.monotonically_increasing_id().alias("id"), F.size("v").alias("dim"), "copies", "first", "v"), "vectors")
    plans = {r.dim: plan(r.dim, r["count"], least, bucket, found) for r in reps.groupBy("dim").count().collect()}

    key = ["dim", "tab", "bucket"]
    vectors = reps.select("dim", "id", "copies", "v")
    sizes = vectors.mapInPandas(_hashed(plans, True), "dim int, tab int, bucket long, rows long").groupBy(*key).agg(F.sum("rows").alias("rows"))
    big = materialize(sizes.where(F.col("rows") > block).select(*key, F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "blocks")
    kind = reps.schema["v"].dataType.simpleString()
    dealt = vectors.mapInPandas(_hashed(plans, False), f"dim int, tab int, bucket long, own boolean, id long, copies long, v {kind}")
    dealt = lookup_join(dealt, big, key, F.col("id")).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    dealt = dealt.select(*key, F.when(low == high, -1 - low).otherwise(low * F.col("blocks") + high).cast("long").alias("pair"),
                         F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), "own", "id", "copies", "v")
    dealt = dealt.repartition(*key, "pair").sortWithinPartitions(*key, "pair", "id")
    seen = materialize(dealt.mapInArrow(_searched(plans, least), "id long, links long, to long"), "seen")

    comp = connected(seen.where("to >= 0").select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = seen.where("to < 0").groupBy("id").agg(F.sum("links").alias("links"))
    reps = reps.select("id", "copies", "first", "v").join(links, "id", "left").join(comp, "id", "left")
    reps = materialize(reps.select("v", "first", F.coalesce("component", "id").alias("component"),
                                   (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "reps")
    least_of = materialize(reps.where("n_links > 0").groupBy("component").agg(F.min("first").alias("least")), "least")
    reps = lookup_join(reps, least_of, ["component"], F.col("first"))
    reps = reps.select("v", "n_links", F.coalesce("least", "first").alias("least"))
    out = rows.join(reps, "v", "left")
    component = F.coalesce("least", "name")
    return out.select(F.col("name").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("name") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {LEAST}),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN comp USING (r) LEFT JOIN n USING (r)
"""
