"""Gram-set similarity measures (C1-C4) as native array expressions.

Row-local: no shuffle, no Python.  Grams of ``' ' + s + ' '`` are
"padded" grams; windows shorter than n produce nothing.

Catalyst does not share sub-expressions inside lambdas, so each gram
array is built once as a column (:func:`gram_columns`) and the measures
are written over those columns (``*_arrays``).  The string-level
wrappers do the same through a nested ``select``-free ``struct`` and
are meant for ad-hoc use; :func:`toposim.operators.scoring.score_pairs`
uses the column path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toposim.functions.text import c


def _windows(p: Column, width: int) -> Column:
    """Every window of ``width`` characters of ``p``, in order.

    One linear regex scan: a zero-width lookahead captures each window
    (``substring`` in a loop would re-walk the UTF-8 string for every
    position, which is quadratic on long texts)."""
    return F.regexp_extract_all(p, F.lit("(?s)(?=(.{%d}))" % width), 1)


def grams(s, n: int, padded: bool = True) -> Column:
    p = F.concat(F.lit(" "), c(s), F.lit(" ")) if padded else c(s)
    return _windows(p, n)


def skip_grams(s, k: int) -> Column:
    """Padded 2-grams with ``k`` skipped characters: first and last char of
    each window of ``2 + k`` characters (two lookahead scans, zipped)."""
    p = F.concat(F.lit(" "), c(s), F.lit(" "))
    first = F.regexp_extract_all(p, F.lit("(?s)(?=(.).{%d})" % (k + 1)), 1)
    last = F.regexp_extract_all(p, F.lit("(?s)(?=.{%d}(.))" % (k + 1)), 1)
    return F.zip_with(first, last, lambda x, y: F.concat(x, y))


# gram arrays every native measure needs, per side
def gram_columns(s, tag: str) -> list[Column]:
    return [
        F.concat(grams(s, 2), grams(s, 3)).alias(f"_g23{tag}"),
        grams(s, 2).alias(f"_g2{tag}"),
        F.array_distinct(grams(s, 2, padded=False)).alias(f"_bi{tag}"),
        skip_grams(s, 1).alias(f"_k1{tag}"),
        skip_grams(s, 2).alias(f"_k2{tag}"),
    ]


def _size_inter(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _hits(a: Column, b: Column) -> Column:
    """sum over x in multiset a of count of x in multiset b.

    The count is ``size(b) - size(array_remove(b, x))``: one native call
    per element instead of a nested lambda (lambdas are interpreted)."""
    return F.aggregate(a, F.lit(0).cast("bigint"),
                       lambda acc, x: acc + (F.size(b) - F.size(F.array_remove(b, x))))


def jaccard_arrays(a: Column, b: Column) -> Column:
    inter = _size_inter(a, b)
    return (inter / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - inter)).cast("double")


def cosine_arrays(a: Column, b: Column, s1: Column, s2: Column) -> Column:
    den = F.sqrt(_hits(a, a).cast("double")) * F.sqrt(_hits(b, b).cast("double"))
    return F.when(den == 0, F.when(s1 == s2, 1.0).otherwise(0.0)) \
        .otherwise(_hits(a, b).cast("double") / den)


def dice_arrays(a: Column, b: Column, s1: Column, s2: Column) -> Column:
    union = F.size(a) + F.size(b)
    return F.when(union == 0, F.when(s1 == s2, 1.0).otherwise(0.0)) \
        .otherwise((2.0 * _size_inter(a, b)) / union)


def skipgram_arrays(a1, a2, b1, b2, s1, s2) -> Column:
    num = _size_inter(a1, b1) + _size_inter(a2, b2)
    den = F.size(F.array_union(a1, b1)) + F.size(F.array_union(a2, b2))
    return F.when(den == 0, F.when(s1 == s2, 1.0).otherwise(0.0)).otherwise(num / den)


def native_from_columns(name: str, s1: Column, s2: Column, t1: str = "1", t2: str = "2",
                        symmetric: bool = False) -> Column:
    """Measure ``name`` over precomputed ``gram_columns(s1, t1)`` /
    ``gram_columns(s2, t2)``."""
    def g(kind, t):
        return F.col(f"_{kind}{t}")
    if name == "jaccard":
        return jaccard_arrays(g("g23", t1), g("g23", t2))
    if name == "cosine":
        return cosine_arrays(g("g23", t1), g("g23", t2), s1, s2)
    if name == "strike_a_match":
        return dice_arrays(g("bi", t1), g("bi", t2), s1, s2)
    if name == "skipgram":
        a2 = F.concat(g("k1", t1), g("k2", t1))
        b2 = F.concat(g("k1", t2), g("k2", t2) if symmetric else g("k2", t1))
        return skipgram_arrays(g("g2", t1), a2, g("g2", t2), b2, s1, s2)
    raise KeyError(name)


# ---- string-level wrappers ------------------------------------------------

def gram_jaccard(s1, s2) -> Column:
    """Jaccard of the sets of padded 2- and 3-grams."""
    return jaccard_arrays(F.concat(grams(s1, 2), grams(s1, 3)), F.concat(grams(s2, 2), grams(s2, 3)))


def gram_cosine(s1, s2) -> Column:
    """Cosine of padded 2/3-gram count vectors."""
    return cosine_arrays(F.concat(grams(s1, 2), grams(s1, 3)), F.concat(grams(s2, 2), grams(s2, 3)),
                         c(s1), c(s2))


def dice_bigrams(s1, s2) -> Column:
    """C3 (strike-a-match): unpadded bigram sets, 2*hits/(n1+n2)."""
    return dice_arrays(F.array_distinct(grams(s1, 2, padded=False)),
                       F.array_distinct(grams(s2, 2, padded=False)), c(s1), c(s2))


def skipgram_jaccard(s1, s2, symmetric: bool = False) -> Column:
    """C4.  By default b's skip set mixes b's 1-skips with a's 2-skips,
    as the specified behaviour does; ``symmetric=True`` uses b's own."""
    a2 = F.concat(skip_grams(s1, 1), skip_grams(s1, 2))
    b2 = F.concat(skip_grams(s2, 1), skip_grams(s2 if symmetric else s1, 2))
    return skipgram_arrays(grams(s1, 2), a2, grams(s2, 2), b2, c(s1), c(s2))
