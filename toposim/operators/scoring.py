"""Pair scoring: add one double column per measure to a pairs DataFrame.

Character measures alone are one kernel call on columns of the row.
Where gram or token measures are asked for, one Arrow call scores all
string pairs of a row (``pairkernel``): equal string pairs of a batch,
and equal token pairs (E0), are scored once.  A dictionary of the whole
table's token pairs (``tokenpairs``) is not joined to the rows: its
shuffles, a row for each token pair of a row, cost more than the scores.
Gram arrays as native expressions (``grams``) say the same, at 25 times the
time: their multisets are walked by interpreted lambdas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toposim.functions import pairkernel
from toposim.functions.kernels import MEASURES as KERNELS
from toposim.functions.kernels import kernels
from toposim.functions.registry import NATIVE, base_name, measure
from toposim.functions.text import strip_accents


def _is_kernel(m: str) -> bool:
    return base_name(m) in KERNELS


def _kernel_names(ms: Sequence[str]) -> dict[int, tuple[str, ...]]:
    """Character kernels by direction (0: as is, 1: reversed)."""
    return {side: tuple(base_name(m) for m in ms if _is_kernel(m) and (m != base_name(m)) == bool(side)) for side in (0, 1)}


def _plain(s) -> Column:
    """A string as E3 compares it."""
    return F.replace(strip_accents(F.lower(s)), F.lit("-"), F.lit(" "))


def _score_together(df: DataFrame, jobs) -> DataFrame:
    cols = df.columns
    pairs = []
    for s1, s2, ms, _ in jobs:
        x, y = (F.coalesce(F.col(s), F.lit("")) for s in (s1, s2))
        p, q = (_plain(x), _plain(y)) if "davies" in ms else (F.lit(""), F.lit(""))
        pairs.append(F.struct(x.alias("a"), y.alias("b"), p.alias("pa"), q.alias("pb")))
    measures = [[m for m in ms if pairkernel.known(m)] for _, _, ms, _ in jobs]
    st = df.select(*cols, pairkernel.pair_scores(measures, F.array(*pairs)).alias("_v"))
    out, at = [], 0
    for (s1, s2, ms, prefix), mine in zip(jobs, measures):
        for m in ms:
            if m in mine:
                out.append(F.get("_v", F.lit(at)).alias(prefix + m))
                at += 1
            else:  # a measure that a user registered
                out.append(measure(m)(F.coalesce(F.col(s1), F.lit("")), F.coalesce(F.col(s2), F.lit(""))).alias(prefix + m))
    return st.select(*cols, *out)


def score_many(df: DataFrame, jobs: Sequence[tuple[str, str, Sequence[str], str]]) -> DataFrame:
    """``jobs`` = [(s1, s2, measures, prefix)]: adds ``prefix + measure``."""
    asked = {m for _, _, ms, _ in jobs for m in ms if pairkernel.known(m)}
    if asked & {*pairkernel.TOKEN, *NATIVE}:
        return _score_together(df, jobs)
    cols = df.columns
    strings = []
    for n, (s1, s2, _, _) in enumerate(jobs):
        strings += [F.coalesce(F.col(s1), F.lit("")).alias(f"_s1_{n}"),
                    F.coalesce(F.col(s2), F.lit("")).alias(f"_s2_{n}")]
    st = df.select("*", *strings)
    # all character kernels of a string pair in one call; reversed ones in another
    shared = []
    for n, (_, _, ms, _) in enumerate(jobs):
        x, y = F.col(f"_s1_{n}"), F.col(f"_s2_{n}")
        for side, names in _kernel_names(ms).items():
            if names:
                shared.append(kernels(names, *((F.reverse(x), F.reverse(y)) if side else (x, y))).alias(f"_k{side}_{n}"))
    if shared:
        st = st.select("*", *shared)
    out = []
    for n, (_, _, ms, prefix) in enumerate(jobs):
        x, y = F.col(f"_s1_{n}"), F.col(f"_s2_{n}")
        for m in ms:
            if _is_kernel(m):
                out.append(F.col(f"_k{int(m != base_name(m))}_{n}.{base_name(m)}").alias(prefix + m))
                continue
            out.append(measure(m)(x, y).alias(prefix + m))
    return st.select(*cols, *out)


def score_pairs(df: DataFrame, s1: str, s2: str, measures: Sequence[str],
                prefix: str = "") -> DataFrame:
    """``df`` + one column ``prefix + measure`` per measure."""
    return score_many(df, [(s1, s2, measures, prefix)])
