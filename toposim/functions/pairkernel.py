"""All measures of many string pairs of a row in one Arrow call.

A batch's string pairs, over all the pairs of a row, are reduced to the
distinct ones; each measure then works on columns of all of them: gram
measures (C1-C4) on gram numbers, character measures (D1-D7) by
``kernels.score``, token measures (E1-E3) on the weights of the
batch's distinct token pairs (E0).  The native expressions of ``grams`` and ``tokens`` say the same
for single columns; tests compare the two.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toposim.functions.kernels import MEASURES as CHARACTER
from toposim.functions.kernels import Strings, score

GRAM = ("jaccard", "cosine", "strike_a_match", "skipgram")
TOKEN = ("monge_elkan", "soft_jaccard", "davies")
_BITS = 21  # of a code point, counted from 1


def known(measure: str) -> bool:
    base = measure.removesuffix("_reversed")
    return base in CHARACTER or measure in (*GRAM, *TOKEN, "sorted_winkler")


class _Codes:
    """Code points of many strings in one array, with the string of each."""

    def __init__(self, strings: Sequence[str]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        self.of = np.repeat(np.arange(len(strings)), self.size)
        self.left = np.repeat(np.cumsum(self.size), self.size) - np.arange(len(self.codes))

    def grams(self, *steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(string, gram) of every window whose characters are ``steps`` apart."""
        at = np.flatnonzero(self.left > steps[-1])
        gram = np.zeros(len(at), np.int64)
        for s in steps:
            gram = (gram << _BITS) | self.codes[at + s]
        return self.of[at], gram


class _Sets:
    """Multisets of grams, one a string pair and side."""

    def __init__(self, n: int, *parts: tuple[np.ndarray, np.ndarray]):
        self.n = n
        self.pair, self.gram = (np.concatenate(x) for x in zip(*parts))

    @staticmethod
    def keyed(*sets: _Sets) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(sorted keys, counts, grams) of sets with common gram numbers."""
        names, number = np.unique(np.concatenate([s.gram for s in sets]), return_inverse=True)
        m, out, at = max(len(names), 1), [], 0
        for s in sets:
            keys, counts = np.unique(s.pair * m + number[at:at + len(s.gram)], return_counts=True)
            out.append((keys, counts, m))
            at += len(s.gram)
        return out


def _overlap(a: _Sets, b: _Sets) -> tuple[np.ndarray, ...]:
    """Per pair: common grams, distinct grams of a and b, dot product, squares."""
    (ka, ca, m), (kb, cb, _) = _Sets.keyed(a, b)
    common, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    per = lambda keys, w=None: np.bincount(keys // m, w, minlength=a.n)
    return per(common), per(ka), per(kb), per(common, ca[i] * cb[j]), per(ka, ca * ca), per(kb, cb * cb)


def gram_scores(pairs: Sequence[tuple[str, str]], names: Sequence[str]) -> dict[str, np.ndarray]:
    n, out = len(pairs), {}
    equal = np.array([float(x == y) for x, y in pairs])
    a, b = (_Codes([f" {p[k]} " for p in pairs]) for k in (0, 1))
    if "jaccard" in names or "cosine" in names:
        common, da, db, dot, sa, sb = _overlap(*(_Sets(n, s.grams(0, 1), s.grams(0, 1, 2)) for s in (a, b)))
        out["jaccard"] = common / (da + db - common)
        size = np.sqrt(sa) * np.sqrt(sb)
        out["cosine"] = np.where(size == 0, equal, dot / np.where(size == 0, 1, size))
    if "strike_a_match" in names:
        common, da, db, *_ = _overlap(*(_Sets(n, _Codes([p[k] for p in pairs]).grams(0, 1)) for k in (0, 1)))
        out["strike_a_match"] = np.where(da + db == 0, equal, 2.0 * common / np.maximum(da + db, 1))
    if "skipgram" in names:
        c1, a1, b1, *_ = _overlap(*(_Sets(n, s.grams(0, 1)) for s in (a, b)))
        # the published asymmetry: b's second skip comes from a
        c2, a2, b2, *_ = _overlap(_Sets(n, a.grams(0, 2), a.grams(0, 3)), _Sets(n, b.grams(0, 2), a.grams(0, 3)))
        union = a1 + b1 - c1 + a2 + b2 - c2
        out["skipgram"] = np.where(union == 0, equal, (c1 + c2) / np.maximum(union, 1))
    return {k: out[k] for k in names}


#: Cells (tokens of a x tokens of b, over all pairs) that are worked on together.
_CELLS = 2_000_000


class Vocabulary:
    """The distinct tokens of a batch, numbered, and the Jaro-Winkler weights
    (E0) of those that meet: equal pairs of tokens are scored once."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self._strings: Strings | None = None

    def lists(self, lists: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all tokens, tokens of each list)."""
        names = self.numbers
        flat = np.array([names.setdefault(t, len(names)) for ts in lists for t in ts], np.int64)
        return flat, np.array([len(ts) for ts in lists], np.int64)

    def weights(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Weights of tokens ``x`` against ``y``, by number."""
        if self._strings is None or len(self._strings.size) < len(self.numbers):
            self._strings = Strings(list(self.numbers))
        n = max(len(self.numbers), 1)
        met, at = np.unique(x * n + y, return_inverse=True)
        return self._strings.winkler(met // n, met % n)[at]

    def cross(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, last row, weights) a part of the rows: of every token of
        a's list against every one of b's, row by row and token by token of a."""
        (ta, la), (tb, lb) = a, b
        start_a, start_b, cells = np.cumsum(la) - la, np.cumsum(lb) - lb, la * lb
        ends, s = np.cumsum(cells), 0
        while s < len(cells):
            e = max(int(np.searchsorted(ends, ends[s] - cells[s] + _CELLS, side="right")), s + 1)
            k = cells[s:e]
            row = np.repeat(np.arange(s, e), k)
            within = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            i = within // lb[row]
            yield s, e, self.weights(ta[start_a[row] + i], tb[start_b[row] + within - i * lb[row]])
            s = e

    def best(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The best weight of every token of a's lists; no list is empty."""
        out = []
        for s, e, w in self.cross(a, b):
            k = np.repeat(b[1][s:e], a[1][s:e])
            out.append(np.maximum.reduceat(w, np.cumsum(k) - k))
        return np.concatenate(out) if out else np.zeros(0)


def _per_list(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(size)), size), values, minlength=len(size))


def _firsts(tokens: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 at a token's first place in its list, else 0."""
    flat, size = tokens
    keys = np.repeat(np.arange(len(size)), size) * (int(flat.max(initial=0)) + 1) + flat
    out = np.zeros(len(flat))
    out[np.unique(keys, return_index=True)[1]] = 1.0
    return out


def _expanded(tokens: list[str], other: list[str], limit: int) -> list[str]:
    """A lone dot becomes the shortest following candidate of the other side."""
    out = []
    for t in tokens:
        if t == ".":
            n = limit
            for y in other:
                if y.startswith(t.replace(".", "")) and len(y) < n:
                    t, n = y, len(y)
        out.append(t)
    return out


def _soft(vocabulary: Vocabulary, a, b, ab: np.ndarray, ba: np.ndarray) -> np.ndarray:
    """Soft Jaccard of the sets of tokens, from the best weights of the lists' tokens."""
    fa, fb = _firsts(a), _firsts(b)
    inter = (_per_list(ab * fa, a[1]) + _per_list(ba * fb, b[1])) / 2.0
    return inter / (_per_list(fa, a[1]) + _per_list(fb, b[1]) - inter)


def _sorted_winkler(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    return score([(" ".join(sorted(x.split(" "))), " ".join(sorted(y.split(" ")))) for x, y in pairs], ["jaro_winkler"])["jaro_winkler"]


def token_scores(pairs: Sequence[tuple[str, str]], plain: Sequence[tuple[str, str]], names: Sequence[str], in_order: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """``plain``: the pairs' strings as E3 compares them (lower, no accents);
    ``in_order``: D5 of the pairs, which E3 asks for."""
    out: dict[str, np.ndarray] = {}
    vocabulary = Vocabulary()
    # the weight is not quite symmetric: each side asks with its own token first
    if {"monge_elkan", "soft_jaccard"} & set(names):
        a, b = (vocabulary.lists([p[k].split(" ") for p in pairs]) for k in (0, 1))
        ab, ba = vocabulary.best(a, b), vocabulary.best(b, a)
        if "monge_elkan" in names:
            out["monge_elkan"] = (_per_list(ab, a[1]) / a[1] + _per_list(ba, b[1]) / b[1]) / 2.0
        if "soft_jaccard" in names:
            out["soft_jaccard"] = _soft(vocabulary, a, b, ab, ba)
    if "davies" in names:
        left, right = [], []
        for (x, y), (p, q) in zip(pairs, plain):
            left.append(_expanded(p.split(" "), q.split(" "), len(y)))
            right.append(_expanded(q.split(" "), left[-1], len(x)))
        a, b = vocabulary.lists(left), vocabulary.lists(right)
        soft = _soft(vocabulary, a, b, vocabulary.best(a, b), vocabulary.best(b, a))
        out["davies"] = ((_sorted_winkler(pairs) if in_order is None else in_order) + soft) / 2.0
    return out


def _measured(pairs: list[tuple[str, str]], plain: list[tuple[str, str]], names: Sequence[str]) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    if g := [m for m in names if m in GRAM]:
        out |= gram_scores(pairs, g)
    if {"sorted_winkler", "davies"} & set(names):
        out["sorted_winkler"] = _sorted_winkler(pairs)
    if t := [m for m in names if m in TOKEN]:
        out |= token_scores(pairs, plain, t, out.get("sorted_winkler"))
    if ch := [m for m in names if m in CHARACTER]:
        out |= score(pairs, ch)
    if rev := [m for m in names if m.removesuffix("_reversed") in CHARACTER and m not in CHARACTER]:
        got = score([(x[::-1], y[::-1]) for x, y in pairs], [m.removesuffix("_reversed") for m in rev])
        out |= {m: got[m.removesuffix("_reversed")] for m in rev}
    return out


def pair_scores(jobs: Sequence[Sequence[str]], pairs: Column) -> Column:
    """``pairs``: array of (a, b, pa, pb), one for each of ``jobs`` (lists of
    measures; pa and pb as E3 compares them).  Gives the measures of all jobs
    in order, as one array."""
    kinds = list(dict.fromkeys(tuple(j) for j in jobs))
    kind = np.array([kinds.index(tuple(j)) for j in jobs])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(a: pd.Series, b: pd.Series, pa: pd.Series, pb: pd.Series) -> pd.Series:
        numbers: dict[tuple, int] = {}
        ps, order = list(zip(a, b, pa, pb)), kind.tolist()
        at = np.array([[numbers.setdefault(key, len(numbers)) for key in zip(order, *r)] for r in ps], np.int64)
        keys = list(numbers)
        place = np.zeros(len(keys), np.int64)
        tables = []
        for k, names in enumerate(kinds):
            mine = [i for i, key in enumerate(keys) if key[0] == k]
            place[mine] = np.arange(len(mine))
            got = _measured([keys[i][1:3] for i in mine], [keys[i][3:5] for i in mine], names) if mine else {}
            tables.append([got.get(m, np.zeros(0)) for m in names])
        cols = [t[place[at[:, j]]] for j in range(len(jobs)) for t in tables[kind[j]]]
        return pd.Series(list(np.stack(cols, 1)) if len(ps) else [], dtype=object)

    # arrays of plain values: an array of structs would reach Python as a dict for each
    return run(*[pairs[k] for k in ("a", "b", "pa", "pb")])


def _merged(a: list[str], b: list[str], fits: list[bool], at: int) -> tuple[list[str], ...]:
    """two pointers over the tokens; ``fits[at:]`` says which pairs match."""
    i, j, n, m = 0, 0, len(a), len(b)
    base_a, base_b, mis_a, mis_b = [], [], [], []
    while i < n and j < m:
        if fits[at + i * m + j]:
            base_a.append(a[i])
            base_b.append(b[j])
            i += 1
            j += 1
        elif a[i] < b[j]:
            mis_a.append(a[i])
            i += 1
        else:
            mis_b.append(b[j])
            j += 1
    return base_a, base_b, mis_a + a[i:], mis_b + b[j:]


def merge_splits(a: Column, b: Column, thresholds: Sequence[float]) -> Column:
    """F2 of two arrays of tokens at every threshold, as a struct of arrays
    ``base_a0, base_b0, mis_a0, mis_b0, base_a1, ...``: tokens match where the
    Jaro-Winkler weight of the reversed ones reaches it."""
    parts = ("base_a", "base_b", "mis_a", "mis_b")
    fields = [T.StructField(f"{p}{k}", T.ArrayType(T.StringType())) for k in range(len(thresholds)) for p in parts]

    @F.pandas_udf(T.StructType(fields))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        sides = [[None if ts is None else ts.tolist() for ts in s] for s in (a, b)]
        rows = [(x, y) for x, y in zip(*sides) if x and y]
        vocabulary = Vocabulary()
        turned = [vocabulary.lists([[t[::-1] for t in r[k]] for r in rows]) for k in (0, 1)]
        found: list[list] = []
        for s, e, w in vocabulary.cross(*turned):
            fits, at = [(w >= t).tolist() for t in thresholds], 0
            for x, y in rows[s:e]:
                found.append([part for f in fits for part in _merged(x, y, f, at)])
                at += len(x) * len(y)
        whole, out = iter(found), []
        for x, y in zip(*sides):
            out.append(next(whole) if x and y else [[], [], x, y] * len(thresholds))
        return pd.DataFrame({f.name: pd.Series([r[k] for r in out], dtype=object) for k, f in enumerate(fields)})

    return run(a, b)
