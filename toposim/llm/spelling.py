"""Spelling variant grouping by k-d trees over letter-count vectors.

Two words are near when one inserted, deleted or replaced code point turns
one into the other.  Such an edit raises the count of at most one letter by
one and lowers at most one by one, so the letter-count vectors lie at an L1
distance of at most two.  Counts are held in unary (bit k of a letter: it
occurs at least k times, up to a cap), so the least and greatest counts of
a set of words, its box, are the AND and the OR of their bits, and the
distance to a box is a count of bits.

1. Words are counted over all documents.
2. Per word length, a bounded sample of words gives the top of a k-d tree:
   bits are split until a leaf stands for about ``LEAF`` words.  Every word
   is a point of one leaf, and a query in every leaf whose box is in reach,
   in the tree of its own length and in that of the next one.
3. A task takes a leaf, builds the rest of the tree over the leaf's words,
   and sends all its queries down at once, dropping those that a node's box
   rules out.  At the bottom the count vectors are compared, then the order
   of letters is verified.
4. A pair is met in one leaf only, so numbers of near words are sums and
   the best near word is a maximum; no list of pairs is made.
5. Forms are followed to the last by doubling; their counts rise tenfold,
   so a chain has at most 19 steps.

Defined cases: a null text has no words; a null doc_id is read as empty;
words of any length are taken whole; repeated rows count again; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.llm.common import materialize, sql_crc32, table
from toposim.session import ship

#: Code points a word has at least, and occurrences.
LETTERS, OCCURRENCES = 7, 2
#: A form occurs so many times as often as the word.
TIMES = 10
#: Every so manieth crc32 misspells a run.
MISSPELT = 31
#: Words of a leaf, and sampled words that the tops of the trees are cut by.
LEAF, SAMPLE = 16_384, 50_000
#: Points of a node that is not split further.
_SMALL = 32
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_FLUSH = 300_000
#: Unary bits: a-z up to four times each, then one bit for each other code point (mod 64).
_AZ, _CAP, _WORDS = 26, 4, 3
_BITS = _AZ * _CAP + 64


def _misspelt(doc_id: str, run: str) -> str:
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % MISSPELT:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    for df in batches:
        for doc_id, text in zip(df["doc_id"], df["text"]):
            if isinstance(text, str):
                for run, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
                    if len(run) >= LETTERS:
                        word = _misspelt(doc_id, run)
                        if len(word) >= LETTERS:
                            total[word] += n
                if len(total) > _FLUSH:
                    yield pd.DataFrame(total.items(), columns=["word", "n"])
                    total = Counter()
    yield pd.DataFrame(list(total.items()), columns=["word", "n"])


def words(docs: DataFrame) -> DataFrame:
    """The contract's words of ``docs`` (doc_id, text): word, n."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInPandas(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= OCCURRENCES)


def codes(ws: list[str]) -> np.ndarray:
    """(words, length) code points of words of one length."""
    return np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32).reshape(len(ws), -1)


def unary(c: np.ndarray) -> np.ndarray:
    """(words, 3) letter counts in unary bits of ``codes``."""
    n = len(c)
    counts = np.zeros((n, _AZ + 64), np.int32)
    cols = np.where((c >= 97) & (c < 97 + _AZ), c - 97, _AZ + c % 64).astype(np.int64)
    np.add.at(counts, (np.repeat(np.arange(n), c.shape[1]), cols.ravel()), 1)
    bits = np.zeros((n, 64 * _WORDS), bool)
    for k in range(_CAP):
        bits[:, k:_AZ * _CAP:_CAP] = counts[:, :_AZ] > k
    bits[:, _AZ * _CAP:_BITS] = counts[:, _AZ:] > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(n, _WORDS)


def _spread(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")[:, :_BITS]


def in_reach(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a box (or point) is reached by raising one count and lowering one."""
    up = down = np.uint8(0)
    for k in range(_WORDS):
        x = q[..., k]
        up = up + np.bitwise_count(low[..., k] & ~x)
        down = down + np.bitwise_count(x & ~high[..., k])
    return (up <= 1) & (down <= 1)


def _bit(k: int) -> np.ndarray:
    out = np.zeros(_WORDS, np.uint64)
    out[k // 64] = np.uint64(1) << np.uint64(k % 64)
    return out


def _unary_mates(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits that bit ``k`` implies when set, and that fall with it when not."""
    if k >= _AZ * _CAP:
        return _bit(k), _bit(k)
    first = k - k % _CAP
    return sum(_bit(b) for b in range(first, k + 1)), sum(_bit(b) for b in range(k, first + _CAP))


def top(sample: np.ndarray, leaves: float) -> list[tuple]:
    """k-d tree over sampled unary vectors: nodes (bit, left, right), or
    (-1, leaf number, 0).  The most even bit is split, ``leaves`` times."""
    nodes: list[tuple] = []
    names = iter(range(1 << 30))

    def build(rows: np.ndarray, share: float) -> int:
        at = len(nodes)
        nodes.append((-1, 0, 0))
        if share > 1 and len(rows) > 8:
            ones = _spread(rows).sum(0)
            k = int(np.abs(ones - len(rows) / 2).argmin())
            if 0 < ones[k] < len(rows):
                on = _spread(rows)[:, k].astype(bool)
                part = ones[k] / len(rows)
                left = build(rows[~on], share * (1 - part))
                nodes[at] = (k, left, build(rows[on], share * part))
                return at
        nodes[at] = (-1, next(names), 0)
        return at

    build(sample, leaves)
    return nodes


def leaves_in_reach(nodes: list[tuple], q: np.ndarray, exact: bool) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows of ``q``): the leaves whose boxes are in reach; with
    ``exact`` the one leaf that holds each row."""
    out = []

    def walk(at: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if not len(rows):
            return
        k, left, right = nodes[at]
        if k < 0:
            out.append((left, rows))
            return
        implied, fallen = _unary_mates(k)
        for child, lo, hi, on in ((left, low, high & ~fallen, False), (right, low | implied, high, True)):
            if exact:
                some = ((q[rows] & _bit(k)).any(1)) == on
            else:
                some = in_reach(q[rows], lo, hi)
            walk(child, rows[some], lo, hi)

    walk(0, np.arange(len(q)), np.zeros(_WORDS, np.uint64), np.full(_WORDS, ~np.uint64(0)))
    return out


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of codes differ by one replaced code point (equal
    lengths) or ``b`` by one more code point."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    head = np.cumprod(a == b[:, :n], axis=1).sum(1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= n


def near_pairs(p: np.ndarray, pc: np.ndarray, q: np.ndarray, qc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, points) one edit apart: k-d tree over the points ``p``
    (unary bits; codes ``pc``), all queries sent down at once."""
    found_q, found_p = [], []
    todo = [(np.arange(len(p)), np.arange(len(q)))]
    while todo:
        points, rows = todo.pop()
        box = p[points]
        rows = rows[in_reach(q[rows], np.bitwise_and.reduce(box), np.bitwise_or.reduce(box))]
        if not len(rows):
            continue
        if len(points) > _SMALL:
            bits = _spread(box)
            ones = bits.sum(0, dtype=np.int64)
            k = int(np.abs(ones - len(points) / 2).argmin())
            if 0 < ones[k] < len(points):
                on = bits[:, k].astype(bool)
                todo += [(points[~on], rows), (points[on], rows)]
                continue
        step = max(1, 2_000_000 // len(points))
        for s in range(0, len(rows), step):
            r = rows[s:s + step]
            i, j = np.nonzero(in_reach(q[r][:, None], box[None], box[None]))
            i, j = r[i], points[j]
            span = max(1, 8_000_000 // pc.shape[1])
            for t in range(0, len(i), span):
                ok = one_edit(qc[i[t:t + span]], pc[j[t:t + span]])
                found_q.append(i[t:t + span][ok])
                found_p.append(j[t:t + span][ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_q]), np.concatenate([none, *found_p])


def _best(ids: np.ndarray, others: np.ndarray, ws: np.ndarray, n: np.ndarray, names: np.ndarray) -> tuple:
    """Per word of ``names[ids]`` its near words among ``ws[others]``:
    word, n_near, best_n, best."""
    order = np.lexsort((ws[others], -n[others], ids))
    ids, others = ids[order], others[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return names[ids[first]], np.diff(np.r_[first, len(ids)]), n[others[first]], ws[others[first]]


def _routed(trees: dict[int, list[tuple]]):
    alone = [(-1, 0, 0)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for size, part in df.groupby(df["word"].str.len()):
                ws, n = part["word"].to_numpy(dtype=object), part["n"].to_numpy()
                bits = unary(codes(list(ws)))
                # 0: a point; 1: a query of the same length; 2: a query one code point shorter
                for kind, length in ((0, size), (1, size), (2, size + 1)):
                    for leaf, rows in leaves_in_reach(trees.get(length, alone), bits, kind == 0):
                        yield pd.DataFrame({"size": length, "leaf": leaf, "kind": kind, "word": ws[rows], "n": n[rows]})
    return run


def _searched(df: pd.DataFrame) -> pd.DataFrame:
    """The near words met in one leaf."""
    kind, ws, n = df["kind"].to_numpy(), df["word"].to_numpy(dtype=object), df["n"].to_numpy()
    out = [(np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object))]
    pw, pn = ws[kind == 0], n[kind == 0]
    if len(pw):
        pc = codes(list(pw))
        bits = unary(pc)
        for asked in (1, 2):
            qw, qn = ws[kind == asked], n[kind == asked]
            if len(qw):
                qc = codes(list(qw))
                i, j = near_pairs(bits, pc, unary(qc), qc)
                if len(i):
                    out.append(_best(i, j, pw, pn, qw))
                    if asked == 2:  # the longer word was not a query here
                        out.append(_best(j, i, qw, qn, pw))
    return pd.DataFrame(dict(zip(("word", "n_near", "best_n", "best"), map(np.concatenate, zip(*out)))))


def group(counts: DataFrame, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """``counts`` (word, n) -> word, form, root, n, n_near, form_n."""
    spark = counts.sparkSession
    ship(spark)
    counts = materialize(counts.select("word", F.col("n").cast("long").alias("n")), "words")
    sizes = {r.size: r["count"] for r in counts.groupBy(F.length("word").alias("size")).count().where(F.col("count") > leaf).collect()}
    total = sum(sizes.values())
    trees = {}
    if total:
        # the words of least hashes: about ``sample`` of them however many there are
        least = int(min(1.0, sample / total) * ((1 << 63) - 1))
        picked = counts.where(F.length("word").isin(list(sizes)) & (F.shiftrightunsigned(F.xxhash64("word"), 1) <= least))
        by: dict[int, list[str]] = {}
        for r in picked.select("word").collect():
            by.setdefault(len(r.word), []).append(r.word)
        trees = {size: top(unary(codes(ws)), sizes[size] / leaf) for size, ws in by.items()}
    routed = counts.mapInPandas(_routed(trees), "size int, leaf int, kind int, word string, n long")
    part = routed.groupBy("size", "leaf").applyInPandas(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    near = part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    rows = counts.join(near, "word", "left")
    is_form = F.coalesce(-F.col("b.m") >= TIMES * F.col("n"), F.lit(False))
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(is_form, F.col("b.w")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n")), "near")
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        far = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        roots = materialize(roots.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.select("word", "root")
    rows = rows.join(roots.select("word", "root"), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return group(words(table(spark, sf_dir, "documents")))


ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (
  SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {sql_crc32("d || ':' || run")} AS h FROM lowered WHERE length(run) >= {LETTERS}),
w AS (
  SELECT CASE WHEN h % {MISSPELT} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {LETTERS} AND sum(n) >= {OCCURRENCES}),
cut AS (SELECT word, k, left(word, k) || substr(word, k + 2) AS short FROM (SELECT word, unnest(range(length(word))) AS k FROM w)),
pairs AS (
  SELECT a.word AS word, b.word AS other FROM cut a JOIN cut b ON a.short = b.short AND a.k = b.k AND a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON w.word = cut.short
  UNION SELECT w.word, cut.word FROM cut JOIN w ON w.word = cut.short),
near AS (
  SELECT p.word, count(*) AS n_near, min({{'m': -o.n, 'w': p.other}}) AS b FROM pairs p JOIN w o ON o.word = p.other GROUP BY p.word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= {TIMES} * w.n THEN b.w END AS form,
         CASE WHEN -b.m >= {TIMES} * w.n THEN -b.m END AS form_n FROM w LEFT JOIN near USING (word)),
chain AS (
  SELECT word, word AS root FROM formed
  UNION SELECT chain.word, f.form FROM chain JOIN formed f ON f.word = chain.root AND f.form IS NOT NULL),
last AS (SELECT chain.word, chain.root FROM chain JOIN formed f ON f.word = chain.root AND f.form IS NULL)
SELECT f.word, f.form, last.root, f.n, f.n_near, f.form_n FROM formed f JOIN last USING (word)
"""
