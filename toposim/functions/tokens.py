"""Token-level measures.

The only Python step is the token-pair Jaro-Winkler matrix (a kernel
with a per-worker cache); maxima, sums and the abbreviation fold are
native array expressions, so each measure is row-local: no explode,
no shuffle, no join back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toposim.functions.kernels import jw_matrix, kernel
from toposim.functions.text import c, plain_sorted, split_space, strip_accents


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def _row_max_sum(m: Column) -> Column:
    """Sum over rows of the row maximum (empty row -> 0)."""
    return _sum(F.transform(m, lambda r: F.coalesce(F.array_max(r), F.lit(0.0))))


def sorted_winkler(s1, s2) -> Column:
    """Jaro-Winkler of the code-point sorted tokens."""
    return kernel("jaro_winkler", plain_sorted(s1), plain_sorted(s2))


def monge_elkan(s1, s2) -> Column:
    """Symmetric Monge-Elkan over single-space tokens."""
    a, b = split_space(s1), split_space(s2)
    ab = _row_max_sum(jw_matrix(a, b)) / F.size(a)
    ba = _row_max_sum(jw_matrix(b, a)) / F.size(b)
    return (ab + ba) / 2.0


def _soft_jaccard_sets(a: Column, b: Column) -> Column:
    inter = (_row_max_sum(jw_matrix(a, b)) + _row_max_sum(jw_matrix(b, a))) / 2.0
    return inter / (F.size(a) + F.size(b) - inter)


def soft_jaccard(s1, s2) -> Column:
    """Soft Jaccard over token sets."""
    return _soft_jaccard_sets(F.array_distinct(split_space(s1)),
                              F.array_distinct(split_space(s2)))


def _expand_dots(toks: Column, other: Column, other_len: Column) -> Column:
    """Abbreviation step: a token equal to '.' becomes the shortest
    following candidate of the other side (each candidate must start with
    the previous pick and be strictly shorter)."""
    def pick(t):
        folded = F.aggregate(
            other, F.struct(t.alias("cur"), other_len.alias("n")),
            lambda acc, y: F.when(F.startswith(y, F.replace(acc["cur"], F.lit("."), F.lit("")))
                                  & (F.length(y) < acc["n"]),
                                  F.struct(y.alias("cur"), F.length(y).alias("n")))
            .otherwise(acc))
        return F.when(t == F.lit("."), folded["cur"]).otherwise(t)
    return F.transform(toks, pick)


def davies(s1, s2) -> Column:
    """(sorted JW of the raw strings + soft Jaccard of normalised,
    abbreviation-expanded token sets) / 2."""
    def norm(s):
        return split_space(F.replace(strip_accents(F.lower(c(s))), F.lit("-"), F.lit(" ")))
    a0, b0 = norm(s1), norm(s2)
    a1 = _expand_dots(a0, b0, F.length(c(s2)))
    b1 = _expand_dots(b0, a1, F.length(c(s1)))
    aux2 = _soft_jaccard_sets(F.array_distinct(a1), F.array_distinct(b1))
    return (sorted_winkler(s1, s2) + aux2) / 2.0
