"""Frequent-term mining (H1-H3, G5, G6, A3 set building).

Job shape: explode tokens -> drop stop words -> partial aggregate per
(stem, term) -> stem totals by a window over the *aggregated* table.  The
hash aggregate combines map-side, so a stem that holds a third of all
tokens still leaves one row per task before the shuffle.  Top-k uses
``orderBy().limit()`` (TakeOrderedAndProject: k rows per task, merged).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toposim.functions.text import canonical, c
from toposim.session import materialize

# Default English stop words (a common public list).
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very s t can will just don "
    "should now").split()

TOKEN_REGEX = r"\w+|[^\w\s]+"   # fixed value: words, or runs of other symbols
TERM_FILTER = r"^[a-zA-Z]+"     # fixed value: a kept term starts with ASCII letters
MIN_TERM_LEN = 3
FREQ_TERM_SIZE = 400            # fixed value: rows read from a frequent-term list


def tokenize(s) -> Column:
    return F.regexp_extract_all(c(s), F.lit(TOKEN_REGEX), 0)


def identity_stem(t: Column) -> Column:
    return t


def suffix_stem(t: Column) -> Column:
    """A light plural rule: drop one trailing 's' from words longer than 4."""
    return F.when((F.length(t) > 4) & t.endswith("s"),
                  F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def kept_terms(df: DataFrame, text_cols: Sequence[str], stop_words: Sequence[str], stem: Callable[[Column], Column],
               canonicalise: bool) -> DataFrame:
    """(term, stem) of every token that counts."""
    texts = F.array(*[canonical(t) if canonicalise else F.col(t) for t in text_cols])
    toks = df.select(F.explode(texts).alias("s")) \
        .select(F.explode(tokenize(F.col("s"))).alias("term"))
    kept = toks.where(~F.col("term").isin(*stop_words)   # bounded literal set, hashed once
                      & (F.length("term") >= MIN_TERM_LEN) & F.col("term").rlike(TERM_FILTER))
    return kept.select("term", stem(F.col("term")).alias("stem"))


def term_counts(df: DataFrame, text_cols: Sequence[str], stop_words: Sequence[str] = STOP_WORDS,
                stem: Callable[[Column], Column] = identity_stem, canonicalise: bool = True) -> DataFrame:
    """H1 + H2: one row per surface term with its stem's count:
    ``(gram, stem, count)``."""
    by_term = kept_terms(df, text_cols, stop_words, stem, canonicalise).groupBy("stem", "term").agg(F.count(F.lit(1)).alias("n"))
    return stem_totals(by_term)


def stem_totals(by_term: DataFrame) -> DataFrame:
    """``(gram, stem, count)`` from counts per (stem, term).  A window, as a
    join would count the terms twice; a stem's terms are few."""
    total = F.sum("n").over(Window.partitionBy("stem"))
    return by_term.where("stem IS NOT NULL").select(F.col("term").alias("gram"), "stem", total.alias("count"))


def ranked(terms: DataFrame) -> DataFrame:
    """H2 order: count desc, then stem, then term."""
    return terms.orderBy(F.desc("count"), "stem", "gram")


def top_terms(terms: DataFrame, k: int = FREQ_TERM_SIZE) -> DataFrame:
    """H3: the first ``k`` rows of the ranking."""
    return ranked(terms).limit(k)


def frequent_set(terms: DataFrame, k: int = FREQ_TERM_SIZE) -> DataFrame:
    """A3: top-k terms plus their reversals, distinct -> ``(term)``.
    Size is bounded by 2k, so it may be broadcast."""
    # both readings from one row: a union would count the terms twice
    return top_terms(terms, k).select(F.explode(F.array("gram", F.reverse("gram"))).alias("term")).distinct()


def remove_stop_words(tokens: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """G6 on an array column."""
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(tokens, lambda t: ~F.array_contains(stops, t))


#: Stems that a task's summary holds, and how much more after a failed certificate.
SUMMARY, GROWTH = 20_000, 8


def summaries(words: DataFrame, col: str, size: int) -> DataFrame:
    """(word, low, lost): mergeable summaries, one a task, of at most
    ``size`` words; the true count of a word in a task lies between its
    ``low`` (0 if absent) and that plus the task's ``lost`` (the row
    without a word)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        lost = 0
        for b in batches:
            held.update(b[col].value_counts().to_dict())
            if len(held) > 2 * size:
                cut = sorted(held.values(), reverse=True)[size]
                held, lost = Counter({w: n - cut for w, n in held.items() if n > cut}), lost + cut
        if len(held) > size:
            cut = sorted(held.values(), reverse=True)[size]
            held, lost = Counter({w: n - cut for w, n in held.items() if n > cut}), lost + cut
        yield pd.DataFrame({"word": [*held, None], "low": [*held.values(), 0], "lost": [0] * len(held) + [lost]})

    return words.select(col).mapInPandas(run, "word string, low long, lost long")


def certified_terms(df: DataFrame, text_cols: Sequence[str], k: int = FREQ_TERM_SIZE, stop_words: Sequence[str] = STOP_WORDS,
                    stem: Callable[[Column], Column] = identity_stem, canonicalise: bool = True, size: int = SUMMARY) -> DataFrame:
    """H1-H3: the first ``k`` rows of the ranking, exactly, with a shuffle
    that the vocabulary does not bound.

    Summaries (at most ``size`` stems a task) name the candidates: a stem's
    count is at most its merged ``low`` plus all that was ``lost``.  A
    second scan counts only candidates, exactly.  If the k-th candidate
    does not exceed what a stem outside them could have, the summaries are
    taken again, ``GROWTH`` times as large."""
    kept = kept_terms(df, text_cols, stop_words, stem, canonicalise)
    while True:
        merged = materialize(summaries(kept, "stem", size).groupBy("word").agg(F.sum("low").alias("low"), F.sum("lost").alias("lost")), "summaries")
        lost = merged.where("word IS NULL").agg(F.sum("lost")).first()[0] or 0
        named = merged.where("word IS NOT NULL")
        least = named.orderBy(F.desc("low")).limit(k).agg(F.min("low").alias("low"), F.count("*").alias("n")).first()
        # with fewer than k stems, or nothing lost, all are candidates
        if lost == 0 or least.n == k and least.low > lost:
            break
        size *= GROWTH
    bound = least.low - lost if lost else 0
    names = materialize(named.where(F.col("low") >= bound).select(F.col("word").alias("stem")), "candidates")
    some = kept.join(names, "stem", "left_semi") if lost else kept
    by_term = some.groupBy("stem", "term").agg(F.count(F.lit(1)).alias("n"))
    return top_terms(stem_totals(by_term), k)
