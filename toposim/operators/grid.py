"""Split-threshold x weight x threshold grid for the term-split
measure (F5, F9, H6, G10).

F9 — for every pair, measure and split threshold: the three list scores
with their token and character lengths — is built once (all splits in
one split stage, all list scores in one scoring stage) and exploded to a
long table row-locally.  Each of its rows meets the 27 weightings, gives
the number of thresholds its score reaches, and is counted by (measure,
split, weighting, that number) with map-side combining; the hits of all
27 x 13 cells are sums over that small table.  No join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toposim.functions.registry import base_name
from toposim.functions.termsplit import hand_over, normalised, split_all
from toposim.operators.scoring import score_many
from toposim.operators.thresholds import THRESHOLDS
from toposim.session import materialize

SPLITS = [s / 100.0 for s in range(50, 91, 10)]   # fixed values: .5 .6 .7 .8 .9


# The (base, mismatch, special) weights tried, in search order.
WEIGHTS = [
    (0.33399999999999996, 0.333, 0.333),
    (0.2, 0.2, 0.6), (0.2, 0.3, 0.5), (0.2, 0.4, 0.4), (0.2, 0.5, 0.3), (0.2, 0.6, 0.2),
    (0.3, 0.1, 0.6), (0.3, 0.2, 0.5), (0.3, 0.3, 0.4), (0.3, 0.4, 0.3), (0.3, 0.5, 0.2), (0.3, 0.6, 0.1),
    (0.4, 0.1, 0.5), (0.4, 0.2, 0.4), (0.4, 0.3, 0.3), (0.4, 0.4, 0.2), (0.4, 0.5, 0.1),
    (0.5, 0.1, 0.4), (0.5, 0.2, 0.3), (0.5, 0.3, 0.2), (0.5, 0.4, 0.1), (0.5, 0.25, 0.25),
    (0.6, 0.1, 0.3), (0.6, 0.2, 0.2), (0.6, 0.3, 0.1),
    (0.7, 0.1, 0.2), (0.7, 0.2, 0.1),
]


def list_features(df: DataFrame, a: str, b: str, label: str, measures: Sequence[str],
                  frequent: Sequence[str], splits: Sequence[float] = SPLITS) -> DataFrame:
    """F9 long table ``(label, measure, split, bs, bl, bc, ms, ml, mc, ss, sl, sc)``."""
    dirs = sorted({m.endswith("_reversed") for m in measures})
    keys = {(s, rev): f"_g{i}{'r' if rev else 'f'}" for i, s in enumerate(splits) for rev in dirs}
    st = materialize(split_all(df.select(label, a, b), a, b, keys, frequent), "grid-split")
    jobs, strings = [], []
    for (s, rev), name in keys.items():
        ms = sorted({base_name(m) for m in measures if m.endswith("_reversed") == rev})
        for lst in ("base", "mis", "spec"):
            strings += [F.array_join(F.col(f"{name}_{lst}_a"), " ").alias(f"{name}_J{lst}_a"),
                        F.array_join(F.col(f"{name}_{lst}_b"), " ").alias(f"{name}_J{lst}_b")]
            jobs.append((f"{name}_J{lst}_a", f"{name}_J{lst}_b", ms, f"{name}_S{lst}_"))
    sc = score_many(st.select("*", *strings), jobs)
    rows = []
    for m in measures:
        bm = base_name(m)
        for (s, rev), name in keys.items():
            if rev != m.endswith("_reversed"):
                continue
            parts = [F.lit(m).alias("measure"), F.lit(s).alias("split")]
            for lst, k in (("base", "b"), ("mis", "m"), ("spec", "s")):
                n = F.col(f"{name}_{lst}_len")
                parts += [F.when(n > 0, F.col(f"{name}_S{lst}_{bm}")).otherwise(F.lit(0.0)).alias(f"{k}s"),
                          n.alias(f"{k}l"), F.col(f"{name}_{lst}_char_len").alias(f"{k}c")]
            rows.append(F.struct(*parts))
    return sc.select(F.col(label).cast("int").alias("label"), F.inline(F.array(*rows)))


def grid_accuracy(f9: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """H6: ``(measure, split, threshold, w_base, w_mis, w_special,
    accuracy, ord)``; ``ord`` is the position in the search order (split,
    threshold, weight) used to break ties."""
    ln = [F.col("bl"), F.col("ml"), F.col("sl")]
    cl = [F.col("bc"), F.col("mc"), F.col("sc")]
    weights = F.array(*[F.struct(*[F.lit(x).alias(k) for x, k in zip(w, ("w_base", "w_mis", "w_special"))]) for w in WEIGHTS])
    tried = f9.select("*", F.posexplode(weights).alias("wi", "w"))
    names = ["w0", "w1", "w2"]
    tried = tried.select(*f9.columns, "wi", *[F.col(f"w.{k}").alias(n) for k, n in zip(("w_base", "w_mis", "w_special"), names)])
    for empty in range(3):  # a projection each: the expressions of all three at once are too large to compile
        ws = hand_over(empty, [F.col(n) for n in names], ln)
        tried = tried.select(*f9.columns, "wi", *[w.alias(n) for w, n in zip(ws, names)])
    ws = normalised([F.col(n) for n in names], cl, True)
    total = F.col("bs") * ws[0] + F.col("ms") * ws[1] + F.col("ss") * ws[2]
    one = tried.select("measure", "split", "label", "wi", F.round(F.coalesce(total, F.lit(0.0)), 9).alias("score"))
    # how many thresholds the score reaches
    reached = sum(((F.col("score") >= F.lit(t)).cast("int") for t in thresholds), F.lit(0))
    bins = one.groupBy("measure", "split", "wi", reached.alias("bin")).agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n"))
    # at most measures x splits x weights x (thresholds + 1) rows from here on
    per = bins.groupBy("measure", "split", "wi").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("bin", "pos", (F.col("n") - F.col("pos")).alias("neg"))).alias("h"))

    def hits(ti: int):
        return F.aggregate("h", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["bin"] > ti, x["pos"]).otherwise(x["neg"]))

    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(ti).alias("ti"), hits(ti).alias("hits")) for ti, t in enumerate(thresholds)])
    long = per.select("measure", "split", "wi", "n", F.inline(cells))
    long = long.withColumn("w", F.get(weights, F.col("wi")))
    split_idx = F.round(F.col("split") * 10).cast("int")
    order = (split_idx * len(thresholds) + F.col("ti")) * len(WEIGHTS) + F.col("wi")
    return long.select("measure", "split", "threshold", "w.w_base", "w.w_mis", "w.w_special",
                       (F.col("hits").cast("double") / F.col("n")).alias("accuracy"), order.alias("ord"))


def best_params(acc: DataFrame) -> DataFrame:
    """H5 on the grid: best accuracy per measure, first in search order."""
    pick = F.struct("accuracy", "threshold", "split", "w_base", "w_mis", "w_special")
    best = acc.groupBy("measure").agg(F.max_by(pick, F.struct(F.col("accuracy"), (-F.col("ord")).alias("o")))
                                      .alias("b"))
    return best.select("measure", "b.*")
