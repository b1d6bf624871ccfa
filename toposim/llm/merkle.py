"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text is cut into paragraphs (lines) and these into leaves (sentences,
long ones by eight words);
every cut keeps its characters, so the leaves add up to the text.
Sections are runs of paragraphs that end where a paragraph's hash says
so (one in ``RUN``), so an insertion moves no later border.  A node's
hash covers its children's hashes; the root tests equality.

The fingerprint is ``root:section/section``, a section is
``paragraph;paragraph``, a paragraph ``leaf,leaf`` and a leaf ten hex
digits and its length.  ``compare`` walks two trees: equal roots end it,
equal sections and paragraphs are matched whole, and only differing
branches are opened, which yields the likeness (characters in matched
nodes, both sides, over all characters) and the ranges that differ.

``fingerprints`` pairs each row with its successor in descending doc_id.
Texts move once, to buckets cut at quantiles of doc_id; each bucket also
gets a copy of the next one's first row, and tasks stream sorted buckets.
Only the quantiles and each bucket's highest doc_id, one number per
bucket, pass through the driver.

Defined cases: a null text is empty; an empty text has one empty leaf
and likeness 1 to another empty text; equal doc_ids follow each other
by text, descending; null doc_ids come last; a single row is its own
successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.llm.common import table, texts_of
from toposim.session import ship

RUN = 6
_LINES = re.compile(r"[^\n]*\n|[^\n]+")
_SENTENCES = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
#: Sentences of more than LONG characters are cut after every eighth word.
_WORDS, LONG = re.compile(r"(?:\S+\s*){1,8}|\s+"), 80


#: Leaves are named once per text run; the table is emptied at this size.
_MEMO = 50_000
_named: dict[str, tuple[bytes, str]] = {}


def _leaf(s: str) -> tuple[bytes, str]:
    got = _named.get(s)
    if got is None:
        if len(_named) > _MEMO:
            _named.clear()
        d = hashlib.sha256(s.encode("utf-8", "surrogatepass")).digest()
        got = _named[s] = (d, f"{d[:5].hex()}{len(s)}")
    return got


def _leaves(line: str) -> list[str]:
    found = _SENTENCES.findall(line) or [line]
    return [w for s in found for w in (_WORDS.findall(s) if len(s) > LONG else (s,))]


def tree(text: str) -> tuple[str, list[list[list[str]]]]:
    """(root, sections of paragraphs of leaf names)."""
    sections: list[list[list[str]]] = [[]]
    root, section = hashlib.sha256(), []
    for line in _LINES.findall(text) or [""]:
        leaves = [_leaf(s) for s in _leaves(line)]
        d = hashlib.sha256(b"".join([x for x, _ in leaves])).digest()
        sections[-1].append([name for _, name in leaves])
        section.append(d)
        if d[0] % RUN == 0:
            root.update(hashlib.sha256(b"".join(section)).digest())
            section = []
            sections.append([])
    if sections[-1]:
        root.update(hashlib.sha256(b"".join(section)).digest())
    else:
        sections.pop()
    return root.hexdigest(), sections


def fingerprint(text: str) -> str:
    root, sections = tree(text)
    return root + ":" + "/".join(";".join(",".join(p) for p in s) for s in sections)


def _weight(node: str) -> int:
    return sum(int(leaf[10:]) for leaf in re.split("[,;/]", node))


def _opened(nodes: list[tuple[str, int]], sep: str) -> list[tuple[str, int]]:
    out = []
    for node, start in nodes:
        for child in node.split(sep):
            out.append((child, start))
            start += _weight(child)
    return out


def _unmatched(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> tuple[list, list]:
    common = Counter(n for n, _ in a) & Counter(n for n, _ in b)
    left = []
    for side in (a, b):
        free = common.copy()
        rest = []
        for n, s in side:
            if free[n] > 0:
                free[n] -= 1
            else:
                rest.append((n, s))
        left.append(rest)
    return left[0], left[1]


def compare(a: str, b: str) -> tuple[float, list[tuple[int, int]], list[tuple[int, int]]]:
    """(likeness, ranges only in a, ranges only in b), ranges as (start, length)."""
    (root_a, body_a), (root_b, body_b) = a.split(":", 1), b.split(":", 1)
    if root_a == root_b:
        return 1.0, [], []
    left, right = [(body_a, 0)], [(body_b, 0)]
    total = _weight(body_a) + _weight(body_b)
    for sep in "/;,":
        left, right = _unmatched(_opened(left, sep), _opened(right, sep))
    own = [[(s, _weight(n)) for n, s in side] for side in (left, right)]
    lost = sum(n for side in own for _, n in side)
    return (1.0 - lost / total if total else 1.0), own[0], own[1]


def likeness(a: str, b: str, chars_a: int | None = None, chars_b: int | None = None) -> float:
    """The likeness of ``compare``, without the ranges."""
    (root_a, body_a), (root_b, body_b) = a.split(":", 1), b.split(":", 1)
    if root_a == root_b:
        return 1.0
    total = (_weight(body_a) if chars_a is None else chars_a) + (_weight(body_b) if chars_b is None else chars_b)
    left, right, same = [body_a], [body_b], 0
    for sep in "/;,":
        left, right = Counter(c for n in left for c in n.split(sep)), Counter(c for n in right for c in n.split(sep))
        common = left & right
        if common:
            same += 2 * sum(_weight(n) * k for n, k in common.items())
            left, right = left - common, right - common
        left, right = left.elements(), right.elements()
    return same / total if total else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [x.split()[0] for x in _OUT.split(", ")]


def _row(doc_id, text: str, fp: str, following: str, next_fp: str) -> tuple:
    new = edited(text, following)
    new_fp = fingerprint(new)
    n = len(text)
    return (doc_id, n, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, new_fp,
            likeness(fp, new_fp, n, len(new)), likeness(fp, next_fp, n, len(following)))


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (bucket, kind, place): a bucket's rows (0), then the row that follows (1)."""
    bucket = last = None
    for pdf in batches:
        rows = []
        for b, kind, doc_id, text in zip(pdf["bucket"].tolist(), pdf["kind"].tolist(), pdf["doc_id"].astype(object), texts_of(pdf["text"])):
            if b != bucket:
                bucket, last = b, None
            cur = (None if pd.isna(doc_id) else int(doc_id), text, fingerprint(text))
            if last is not None:
                rows.append(_row(*last, cur[1], cur[2]))
            last = cur if kind == 0 else None
        out = pd.DataFrame(rows, columns=_FIELDS)
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """A fingerprint per row of ``docs`` (doc_id, text), its edited text's, and their likeness."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    n = max(2, buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a null doc_id is ordered as the least number
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                    F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63)).alias("place"))
    cuts = d.select(F.percentile_approx("place", F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(100 * n))).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(np.int64), "right"), dtype="int32")

    dealt = d.withColumn("bucket", of("place"))
    tops = {r["bucket"]: r["top"] for r in dealt.groupBy("bucket").agg(F.max("place").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    # the first row of each bucket (highest place, then text) goes to the one before it in this order
    before = spark.createDataFrame([(tops[b], a) for a, b in zip(order, [*order[1:], *order[:1]])], "place long, bucket int")
    firsts = d.join(F.broadcast(before), "place").groupBy("bucket", "place").agg(F.max(F.struct("text", "doc_id")).alias("r"))
    firsts = firsts.select("bucket", F.lit(1).alias("kind"), "place", F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"))
    rows = dealt.select("bucket", F.lit(0).alias("kind"), "place", "doc_id", "text").unionByName(firsts)
    rows = rows.repartition(max(1, n // 2), "bucket").sortWithinPartitions("bucket", "kind", F.desc("place"), F.desc("text"))
    return rows.mapInPandas(_stream, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
