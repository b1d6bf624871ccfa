"""Threshold learning (H4, H5): accuracy of ``score >= t`` per measure.

One scan, one aggregation: the measures are unpivoted to
``(measure, score, label)`` and every threshold becomes a conditional
count in the same ``groupBy(measure)`` — thresholds never multiply
rows, and the aggregation is partial (map-side) so a skewed measure
key costs nothing extra.  Scores are compared after rounding to 9
decimals so float noise cannot flip a row at a threshold boundary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds .30, .35, ..., .90.
THRESHOLDS = [i / 100.0 for i in range(30, 91, 5)]


def unpivot_scores(df: DataFrame, label: str, measures: Sequence[str]) -> DataFrame:
    return df.unpivot([label], list(measures), "measure", "score") \
        .select("measure", F.col("score").cast("double").alias("score"), F.col(label).cast("int").alias("label"))


def correct(score, label, t) -> "F.Column":
    pred = F.round(score, 9) >= F.lit(t)
    return F.when(pred == (label == 1), 1).otherwise(0)


def accuracy_by_threshold(df: DataFrame, label: str, measures: Sequence[str],
                          thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """H4: (measure, threshold, accuracy) for every measure x threshold."""
    long = unpivot_scores(df, label, measures)
    aggs = [F.sum(correct(F.col("score"), F.col("label"), t)).alias(f"c{i}")
            for i, t in enumerate(thresholds)]
    wide = long.groupBy("measure").agg(F.count(F.lit(1)).alias("n"), *aggs)
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("hits"))
                      for i, t in enumerate(thresholds)])
    return wide.select("measure", "n", F.inline(pairs)) \
        .select("measure", "threshold",
                (F.col("hits").cast("double") / F.col("n")).alias("accuracy"))


def best_threshold(acc: DataFrame, keys: Sequence[str] = ("measure",),
                   extra: Sequence[str] = ()) -> DataFrame:
    """H5: arg-max accuracy per key; ties go to the smallest threshold
    (the first one tried), then to the earliest ``extra`` setting."""
    order = F.struct(F.col("accuracy"), (-F.col("threshold")).alias("nt"),
                     *[(-F.col(f"_ord_{e}")).alias(f"o{i}") for i, e in enumerate(extra)])
    pick = F.struct("threshold", "accuracy", *extra)
    out = acc.groupBy(*keys).agg(F.max_by(pick, order).alias("b"))
    return out.select(*keys, "b.*")
