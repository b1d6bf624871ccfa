"""Measure registry — name -> (column builder, feature groups, feature name).

A measure is any callable ``(Column, Column) -> Column``.  Users add
their own with :func:`register`; the feature builders and the
threshold learners read the registry in its insertion order.
"""

from __future__ import annotations

from collections import OrderedDict
from typing import Callable

from pyspark.sql import Column

from toposim.functions import grams, tokens
from toposim.functions.kernels import kernel
from toposim.functions.text import reverse

Measure = Callable[[Column, Column], Column]


def _k(name: str) -> Measure:
    return lambda a, b: kernel(name, a, b)


def _rev(fn: Measure) -> Measure:
    return lambda a, b: fn(reverse(a), reverse(b))


# name -> (builder, groups, feature column name).  Fixed values: the
# measure list, its order and the feature names.
MEASURES: "OrderedDict[str, tuple[Measure, tuple[str, ...], str]]" = OrderedDict([
    ("damerau_levenshtein", (_k("damerau_levenshtein"), ("basic", "sorted", "lgm"), "Damerau_Levenshtein")),
    ("jaro", (_k("jaro"), ("basic", "sorted", "lgm"), "Jaro")),
    ("jaro_winkler", (_k("jaro_winkler"), ("basic", "sorted", "lgm"), "Jaro_Winkler")),
    ("jaro_winkler_reversed", (_rev(_k("jaro_winkler")), ("basic", "sorted", "lgm"), "Jaro_Winkler_reversed")),
    ("sorted_winkler", (tokens.sorted_winkler, ("basic",), "Jaro_Winkler_sorted")),
    ("cosine", (grams.gram_cosine, ("basic", "sorted", "lgm"), "Cosine_ngrams")),
    ("jaccard", (grams.gram_jaccard, ("basic", "sorted", "lgm"), "Jaccard_ngrams")),
    ("strike_a_match", (grams.dice_bigrams, ("basic", "sorted", "lgm"), "Dice_bigrams")),
    ("skipgram", (grams.skipgram_jaccard, ("basic", "sorted", "lgm"), "Jaccard_skipgrams")),
    ("monge_elkan", (tokens.monge_elkan, ("basic", "sorted", "lgm"), "Monge_Elkan")),
    ("soft_jaccard", (tokens.soft_jaccard, ("basic", "sorted", "lgm"), "Soft_Jaccard")),
    ("davies", (tokens.davies, ("basic", "sorted", "lgm"), "Davis_and_De_Salles")),
    ("tuned_jaro_winkler", (_k("tuned_jaro_winkler"), ("basic", "sorted", "lgm"), "Tuned_Jaro_Winkler")),
    ("tuned_jaro_winkler_reversed", (_rev(_k("tuned_jaro_winkler")), ("basic", "sorted", "lgm"),
                                     "Tuned_Jaro_Winkler_reversed")),
])

NATIVE = ("cosine", "jaccard", "strike_a_match", "skipgram")


def register(name: str, fn: Measure, groups=("basic",), feature_name: str | None = None) -> None:
    MEASURES[name] = (fn, tuple(groups), feature_name or name)


def measure(name: str) -> Measure:
    return MEASURES[name][0]


def in_group(group: str) -> list[str]:
    return [m for m, (_, g, _) in MEASURES.items() if group in g]


def base_name(name: str) -> str:
    return name[:-len("_reversed")] if name.endswith("_reversed") else name
