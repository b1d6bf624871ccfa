"""Grouped AUC and certified term counts against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from toposim.operators import terms
from toposim.operators.metrics import grouped_auc


def _auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


def test_grouped_auc(spark):
    rnd = random.Random(6)
    rows = [(g, rnd.randint(0, 1), rnd.choice([0.1, 0.25, 0.5, rnd.random(), -rnd.random()])) for g in ("a", "b", None) for _ in range(150)]
    rows += [("hot", i % 2, float(i % 50)) for i in range(900)] + [("one", 1, 0.5), ("one", 1, 0.7), ("odd", 1, None), ("odd", None, 0.5), ("odd", 0, 0.2), ("odd", 1, 0.9)]
    df = spark.createDataFrame(rows, "g string, y int, s double").repartition(6)
    got = {r.g: r for r in grouped_auc(df, ["g"], "y", "s").collect()}
    for g in {r[0] for r in rows}:
        mine = [(y, s) for h, y, s in rows if h == g and y is not None and s is not None]
        assert (got[g].n_pos, got[g].n_neg) == (sum(y for y, _ in mine), sum(1 - y for y, _ in mine))
        assert got[g].auc == (None if _auc(mine) is None else pytest.approx(_auc(mine), abs=1e-12))
    assert grouped_auc(df.where("false"), ["g"], "y", "s").count() == 0


@pytest.mark.parametrize("size", [30, 80, 5000])
def test_certified_terms(spark, size):
    """A skewed vocabulary far larger than the summaries: the same list as counting everything."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(800)]
    texts = [(" ".join(words[min(int(rnd.paretovariate(0.9)) - 1, 799)] for _ in range(30)),) for _ in range(400)]
    df = spark.createDataFrame(texts, "text string").repartition(5)
    want = terms.top_terms(terms.term_counts(df, ["text"], stem=terms.suffix_stem), 25).collect()
    got = terms.certified_terms(df, ["text"], 25, stem=terms.suffix_stem, size=size).collect()
    assert got == want


def test_summaries_bound_counts(spark):
    df = spark.range(4000).select(F.concat(F.lit("w"), F.least(F.col("id") % 97, F.col("id") % 11).cast("string")).alias("w")).repartition(3)
    true = {r.w: r.n for r in df.groupBy("w").agg(F.count("*").alias("n")).collect()}
    rows = terms.summaries(df, "w", 4).collect()
    lost = sum(r.lost for r in rows)
    low = {}
    for r in rows:
        if r.word is not None:
            low[r.word] = low.get(r.word, 0) + r.low
    assert all(low.get(w, 0) <= n <= low.get(w, 0) + lost for w, n in true.items())
