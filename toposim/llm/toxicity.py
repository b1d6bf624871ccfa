"""Toxicity by maximum-scoring segments.

A token's score is its log-odds between toxic and clean documents (each
counted once) under an informative Dirichlet prior (the training corpus's
own frequencies), kept when it is at least ``LEAST`` and ``Z_MIN``
standard errors above 0.  A word without a score takes that of its
longest scored beginning of 4 to 6 letters, which covers inflections;
every other token costs ``COST``.  The k-th time that a text uses a word
it counts 1/k, so a repeated word is no passage.  One linear scan finds all maximal scoring segments of a
text.  With lambda from the clean token distribution and K from the best
segments of clean documents, a segment of score S in a text of n tokens
has evidence lambda S - ln(K n): under the extreme-value law the chance
of one as good in clean text is 1 - exp(-exp(-evidence)).  Segments whose
chance is under ``ALPHA`` are the toxic passages.  A document's score is a
logistic curve over the evidence of its best passage, the sum over its
significant ones, and the share of its tokens inside them.

The model is fitted on at most ``TRAIN_DOCS`` labelled rows (those with
the least hashes of their ids), rows of the held-out fifth never among
them; all their tokens that pass both bounds are scored.  Language, source, id and label are never inputs of a score.

Defined cases: a null or empty text has no passages and gets the curve's
value at no evidence; without labels of both kinds every score is 0;
repeated rows are scored each; an empty table gives no rows; other
columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.llm.common import carried, materialize, table, texts_of
from toposim.session import ship

TRAIN_DOCS = 20_000
PRIOR, Z_MIN, LEAST, CAP, COST, ALPHA = 2_000.0, 2.5, 1.5, 8.0, 0.2, 0.05
STEMS = (6, 5, 4)
MEMO = 300_000
FOLDS = 5
_TOKEN = re.compile(r"\w+")


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, ...] = ()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def segments(hits: list[tuple[int, float]], cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score).

    ``hits`` are the positive tokens (place, score) in order; every token
    between two of them counts ``-cost``.
    """
    out: list[list[float]] = []  # first, last, sum before, sum after
    total, at = 0.0, -1
    for place, score in hits:
        total -= cost * (place - at - 1)
        cur = [place, place, total, total + score]
        total, at = total + score, place
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= cur[2]:
                j -= 1
            if j < 0 or out[j][3] >= cur[3]:
                out.append(cur)
                break
            cur = [out[j][0], cur[1], out[j][2], cur[3]]
            del out[j:]
    return [(int(a), int(b), r - left) for a, b, left, r in out]


class Scores(dict):
    """Scores by word, those of new words worked out once (None: no score)."""

    def __init__(self, known: dict[str, float]):
        super().__init__(known)
        self.known = known

    def __missing__(self, word: str) -> float | None:
        if len(self) > MEMO + len(self.known):
            self.clear()
            self.update(self.known)
        s = self[word] = next((self.known[k] for k in _stems(word) if k in self.known), None)
        return s


def _stems(word: str) -> list[str]:
    return [word[:n] + "*" for n in STEMS if len(word) > n]


def terms(text: str) -> set[str]:
    words = set(_TOKEN.findall(text.lower()))
    return words.union(*map(_stems, words))


def hits_of(text: str, scores: Scores) -> tuple[int, list[tuple[int, float]]]:
    words = _TOKEN.findall(text.lower())
    hits, seen = [], Counter()
    for i, s in enumerate(map(scores.__getitem__, words)):
        if s is not None:
            seen[words[i]] += 1
            hits.append((i, s / seen[words[i]]))
    return len(words), hits


def evidence(n: int, segs: list[tuple[int, int, float]], m: Model) -> list[float]:
    return [m.lam * s - m.log_k - math.log(max(n, 1)) for _, _, s in segs]


def features(n: int, segs: list[tuple[int, int, float]], m: Model) -> tuple[float, float, float]:
    ev = evidence(n, segs, m)
    limit = -math.log(-math.log1p(-ALPHA))
    strong = [(e, s) for e, s in zip(ev, segs) if e > limit]
    best = max(ev, default=-m.log_k - math.log(max(n, 1)))
    inside = sum(s[1] - s[0] + 1 for _, s in strong)
    return (max(min(best, 60.0), -20.0) / 10, math.log1p(sum(e for e, _ in strong)), inside / max(n, 1))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        tally = {0: Counter(), 1: Counter()}
        for text, toxic in zip(texts_of(pdf["text"]), pdf["toxic"].tolist()):
            tally[int(toxic)].update(terms(text))
        rows = [(w, tally[0][w], tally[1][w]) for w in tally[0].keys() | tally[1].keys()]
        yield pd.DataFrame(rows, columns=["token", "clean", "toxic"])


def _lambda(probability: list[float], scores: list[float], cost: float = COST) -> float:
    """The positive root of E[exp(lambda s)] = 1 over clean tokens."""
    p, s = np.asarray(probability), np.asarray(scores)
    f = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum() + (1 - p.sum()) * math.exp(-x * cost)) - 1
    lo, hi = 1e-3, 1.0
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-penalised logistic regression by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """The model, fitted on at most ``train_docs`` labelled rows."""
    ship(docs.sparkSession)
    ids = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    ids = materialize(ids.select(F.col("doc_id").alias("__id"), "toxic"), "train-ids")
    # at most train_docs ids are broadcast; rows that share an id count once
    train = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    train = materialize(train.groupBy("doc_id").agg(F.max(F.struct("text", "toxic")).alias("r")).select("r.text", "r.toxic"), "train")
    totals = train.groupBy("toxic").count().collect()
    if {r["toxic"] for r in totals} != {0, 1}:
        return Model()
    counts = materialize(train.mapInPandas(_count, "token string, clean long, toxic long").groupBy("token").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "tokens")
    sums = counts.agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).first()
    n0, n1 = float(sums["c"]), float(sums["t"])
    prior = PRIOR * (F.col("clean") + F.col("toxic")) / (n0 + n1)
    y0, y1 = F.col("clean") + F.col("a"), F.col("toxic") + F.col("a")
    odds = counts.withColumn("a", prior).select(
        "token", (y0 / (n0 + PRIOR)).alias("p0"),
        (F.ln(y1 / (n1 + PRIOR - y1)) - F.ln(y0 / (n0 + PRIOR - y0))).alias("d"), F.sqrt(1 / y0 + 1 / y1).alias("se"),
        "toxic")
    # a token no clean text has gets the variance of its prior alone: ask for a few occurrences too
    z = F.when(F.col("toxic") >= 5, F.col("d") / F.least("se", F.lit(1.5)))
    best = odds.select("token", "p0", "d", z.alias("z")).where((F.col("z") > Z_MIN) & (F.col("d") >= LEAST)).orderBy(F.desc("z"), "token").collect()
    model = Model({r["token"]: min(r["d"], CAP) for r in best})
    if not best:
        return Model()
    model.lam = _lambda([r["p0"] for r in best], [min(r["d"], CAP) for r in best])

    known = model.scores

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(known)
        for pdf in batches:
            rows = []
            for text in texts_of(pdf["text"]):
                n, hits = hits_of(text, scores)
                rows.append((n, max((s[2] for s in segments(hits)), default=0.0)))
            yield pd.DataFrame(rows, columns=["n", "top"])

    # mean of the Gumbel law: lambda S - ln(K n) has mean 0.5772
    clean = train.where("toxic = 0").mapInPandas(tops, "n long, top double").where("n > 0")
    mean = clean.agg(F.avg(model.lam * F.col("top") - F.ln("n"))).first()[0]
    model.log_k = mean - 0.5772156649 if mean is not None else 0.0

    def inputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(known)
        for pdf in batches:
            rows = []
            for text, toxic in zip(texts_of(pdf["text"]), pdf["toxic"].tolist()):
                n, hits = hits_of(text, scores)
                rows.append((toxic, *features(n, segments(hits), model)))
            yield pd.DataFrame(rows, columns=["toxic", "a", "b", "c"])

    # at most train_docs rows of four numbers
    seen = train.mapInPandas(inputs, "toxic int, a double, b double, c double").toPandas().sort_values(["toxic", "a", "b", "c"])
    model.weights = _logistic(seen[["a", "b", "c"]].to_numpy(float), seen["toxic"].to_numpy(float))
    return model


def judge(text: str, m: Model, scores: Scores) -> tuple[float, list[tuple[int, int, float]]]:
    """(score, passages): passages as (start, end, evidence) in code points
    of the lower-cased text, end exclusive."""
    if not m.weights:
        return 0.0, []
    n, hits = hits_of(text, scores)
    segs = segments(hits)
    x = sum(w * v for w, v in zip(m.weights, (*features(n, segs, m), 1.0)))
    limit = -math.log(-math.log1p(-ALPHA))
    strong = [(s, e) for s, e in zip(segs, evidence(n, segs, m)) if e > limit]
    passages = []
    if strong:
        at = [w.span() for w in _TOKEN.finditer(text.lower())]
        passages = [(at[int(s[0])][0], at[int(s[1])][1], float(e)) for s, e in strong]
    return 1 / (1 + math.exp(-max(min(x, 30.0), -30.0))), passages


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``toxicity`` (score double, passages array of start, end, evidence)."""
    ship(docs.sparkSession)

    @F.pandas_udf("score double, passages array<struct<start:int,end:int,evidence:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = Scores(model.scores)
        for s in batches:
            got = [judge(t, model, scores) for t in texts_of(s)]
            yield pd.DataFrame({"score": [g[0] for g in got],
                                "passages": [[{"start": a, "end": b, "evidence": e} for a, b, e in g[1]] for g in got]})

    return docs.withColumn("toxicity", run(F.col(f"`{text}`")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` scored under 0.5, with the same columns."""
    d = score(carried(docs, "text"), fit(docs.select("doc_id", "text"), labels))
    return d.where("toxicity.score < 0.5").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity.score").alias("score"),
                    (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.size("toxicity.passages").cast("long").alias("n_passages"))
