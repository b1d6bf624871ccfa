"""Evaluation-side queries: metrics, fold summary, splits, sampling,
spatial pair features and scaling (H7-H9, I1-I3, B13, B14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposim.functions.geo import capped_distance, mercator
from toposim.functions.address import numbers_diff, street_numbers
from toposim.operators.metrics import binary_metrics, fold_summary, grouped_auc, minmax_scale
from toposim.operators.scoring import score_pairs
from toposim.operators.splits import balanced_sample, stratified_kfold, stratified_shuffle_split
from toposim.plans import sqlgen as Q
from toposim.plans import views as V
from toposim.plans.catalog import register, rnd

_M = ["Accuracy", "Precision", "mPrecision", "Recall", "mRecall", "F1_score", "mF1_score", "Roc_auc",
      "mRoc_auc", "accuracy_plain"]


def _metrics_sql(src: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""
conf AS (SELECT {k}CAST(sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
               CAST(sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
               CAST(sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
               CAST(sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
        FROM {src} {'GROUP BY ' + keys if keys else ''}),
r AS (SELECT {k}tp, fp, fn, tn,
        CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p1,
        CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS p0,
        CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r1,
        CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS r0,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
        CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f0,
        CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END AS acc
      FROM conf),
m AS (SELECT {k}tp, fp, fn, tn, (r1 + r0) / 2 AS Accuracy, p1 AS Precision, (p1 + p0) / 2 AS mPrecision,
        r1 AS Recall, (r1 + r0) / 2 AS mRecall, f1 AS F1_score, (f1 + f0) / 2 AS mF1_score,
        (r1 + r0) / 2 AS Roc_auc, (r1 + r0) / 2 AS mRoc_auc, acc AS accuracy_plain FROM r)"""


@register("metrics_by_lang", f"""
WITH src AS (SELECT d.lang, l.quality AS y, CAST(d.n_chars > 2000 AS INTEGER) AS p
             FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
{_metrics_sql('src', 'lang')}
SELECT lang, tp, fp, fn, tn, {', '.join(f'round({x}, 9) AS {x}' for x in _M)} FROM m""")
def q_metrics_by_lang(spark, sf_dir):
    """H7: a length rule scored against the quality labels, per language."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = V.table(spark, sf_dir, "labels").select("doc_id", "quality")
    src = d.join(lab, "doc_id").select("lang", F.col("quality").alias("y"),
                                      (F.col("n_chars") > 2000).cast("int").alias("p"))
    m = binary_metrics(src, "y", "p", ["lang"])
    return m.select("lang", "tp", "fp", "fn", "tn", *[rnd(F.col(x), 9).alias(x) for x in _M])


_KFOLD_SQL_CORE = """
kf AS (SELECT idx, Class,
         row_number() OVER (PARTITION BY Class ORDER BY idx) AS rk,
         count(*) OVER (PARTITION BY Class) AS n FROM pairs),
kf2 AS (SELECT idx, Class, rk, n, n // 5 AS q, n % 5 AS rem FROM kf),
folds AS (SELECT idx, Class, CAST(CASE WHEN rk <= rem * (q + 1) THEN (rk - 1) // (q + 1)
                  ELSE rem + (rk - 1 - rem * (q + 1)) // q END AS INTEGER) AS fold FROM kf2)"""


@register("kfold", V.with_views(f", {_KFOLD_SQL_CORE}\nSELECT idx, Class, fold FROM folds", "pairs"))
def q_kfold(spark, sf_dir):
    """Unshuffled stratified 5-fold assignment of the pairs."""
    p = V.pairs(spark, sf_dir).select("idx", "Class")
    return stratified_kfold(p, "Class", "idx", 5)


@register("kfold_metrics", V.with_views(f"""
, {_KFOLD_SQL_CORE},
src AS (SELECT f.fold, p.Class AS y,
          CAST(round({Q.jaccard('p.Name1', 'p.Name2')}, 9) >= 0.5 AS INTEGER) AS pr
        FROM pairs p JOIN folds f USING (idx)),
src2 AS (SELECT fold, y, pr AS p FROM src),
{_metrics_sql('src2', 'fold')}
SELECT 'jaccard@0.5' AS classifier, {', '.join(f'round(avg({x}), 9) AS {x}' for x in _M)},
       round(stddev_pop(F1_score), 9) AS F1_score_std, count(*) AS folds
FROM m""", "pairs"))
def q_kfold_metrics(spark, sf_dir):
    """H8 over I2 folds: a jaccard>=0.5 rule evaluated per fold, averaged."""
    p = V.pairs(spark, sf_dir).select("idx", "Name1", "Name2", "Class")
    f = stratified_kfold(p.select("idx", "Class"), "Class", "idx", 5)
    s = score_pairs(p, "Name1", "Name2", ["jaccard"]).join(f.select("idx", "fold"), "idx")
    s = s.select("fold", F.col("Class").alias("y"), (F.round("jaccard", 9) >= 0.5).cast("int").alias("p"))
    per_fold = binary_metrics(s, "y", "p", ["fold"]).withColumn("classifier", F.lit("jaccard@0.5"))
    summ = fold_summary(per_fold)
    return summ.select("classifier", *[rnd(F.col(x), 9).alias(x) for x in _M],
                       rnd(F.col("F1_score_std"), 9).alias("F1_score_std"), "folds")


@register("strat_split", V.with_views("""
, s AS (SELECT CAST(i AS INTEGER) AS split FROM range(1, 6) t(i)),
r AS (SELECT idx, Class, split,
        row_number() OVER (PARTITION BY Class, split
                           ORDER BY md5(CAST(idx AS VARCHAR) || '|2020|' || CAST(split AS VARCHAR))) AS rk,
        count(*) OVER (PARTITION BY Class, split) AS n
      FROM pairs CROSS JOIN s)
SELECT idx, Class, split, CAST(rk <= round(n * 0.2) AS INTEGER) AS is_test FROM r""", "pairs"))
def q_strat_split(spark, sf_dir):
    """5 stratified shuffle splits (20 % test) of the pairs."""
    p = V.pairs(spark, sf_dir).select("idx", "Class")
    return stratified_shuffle_split(p, "Class", "idx", 5, 0.2, 2020)


@register("balanced_sample", V.with_views("""
, r AS (SELECT idx, Class, row_number() OVER (PARTITION BY Class ORDER BY md5(CAST(idx AS VARCHAR) || '|2020')) AS pos
        FROM pairs),
m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM pairs GROUP BY Class))
SELECT idx, Class, pos FROM r, m WHERE pos <= m.m""", "pairs"))
def q_balanced_sample(spark, sf_dir):
    """As many pairs of each class as the smaller has, interleaving position ``pos``."""
    p = V.pairs(spark, sf_dir).select("idx", "Class")
    return balanced_sample(p, "Class", "idx", seed=2020)


def _merc_sql(lon, lat):
    ok = f"({lon} IS NOT NULL AND {lat} IS NOT NULL AND abs({lat}) < 90 AND abs({lon}) <= 180)"
    x = f"CASE WHEN {ok} THEN 6378137.0 * radians({lon}) ELSE 0.0 END"
    y = f"CASE WHEN {ok} THEN 6378137.0 * ln(tan(pi() / 4 + radians({lat}) / 2)) ELSE 0.0 END"
    return x, y


def _dist_sql():
    x1, y1 = _merc_sql("st_x1", "st_y1")
    x2, y2 = _merc_sql("st_x2", "st_y2")
    return f"coalesce(least(5000.0, sqrt(pow(({x1}) - ({x2}), 2) + pow(({y1}) - ({y2}), 2))), 5000.0)"


def _nums_sql(a):
    n = (f"list_transform(list_filter(list_distinct(regexp_extract_all({a}, '\\b\\d+')), "
         f"lambda x: length(x) <> 4), lambda x: CAST(x AS DECIMAL(38, 0)))")
    return f"CASE WHEN len({n}) = 0 THEN [0::DECIMAL(38, 0)] ELSE {n} END"


@register("spatial_scaled", V.with_views(f"""
, t AS (SELECT idx, {_dist_sql()} AS point_dist,
          CAST(list_min(flatten(list_transform({_nums_sql('Address1')}, lambda x:
               list_transform({_nums_sql('Address2')}, lambda y: abs(x - y))))) AS DOUBLE) AS street_numbers_diff
        FROM pairs),
mm AS (SELECT min(point_dist) AS pmin, max(point_dist) AS pmax,
              min(street_numbers_diff) AS smin, max(street_numbers_diff) AS smax FROM t)
SELECT idx, round(point_dist, 6) AS point_dist_raw,
       round(CASE WHEN pmax = pmin THEN 0.0 ELSE (point_dist - pmin) / (pmax - pmin) END, 9) AS point_dist,
       round(CASE WHEN smax = smin THEN 0.0 ELSE (street_numbers_diff - smin) / (smax - smin) END, 9)
         AS street_numbers_diff
FROM t, mm""", "pairs"))
def q_spatial_scaled(spark, sf_dir):
    """B13/B14 + B8 + H9: capped Mercator distance and street-number gap,
    min-max scaled over the whole table."""
    p = V.pairs(spark, sf_dir)
    x1, y1 = mercator("st_x1", "st_y1")
    x2, y2 = mercator("st_x2", "st_y2")
    t = p.select("idx", capped_distance(x1, y1, x2, y2).alias("point_dist"),
                 numbers_diff(street_numbers("Address1"), street_numbers("Address2")).cast("double")
                 .alias("street_numbers_diff"))
    t = t.cache()
    s = minmax_scale(t.withColumn("point_dist_raw", F.col("point_dist")), ["point_dist", "street_numbers_diff"])
    return s.select("idx", rnd(F.col("point_dist_raw")).alias("point_dist_raw"),
                    rnd(F.col("point_dist"), 9).alias("point_dist"),
                    rnd(F.col("street_numbers_diff"), 9).alias("street_numbers_diff"))


_AUC_MEASURES = {"jaccard": Q.jaccard, "cosine": Q.cosine, "strike_a_match": Q.dice, "skipgram": Q.skipgram}


@register("auc_by_fold", V.with_views(f"""
, {_KFOLD_SQL_CORE},
s AS ({" UNION ALL ".join(f"SELECT idx, Class AS y, '{m}' AS measure, round({fn('Name1', 'Name2')}, 9) AS s FROM pairs" for m, fn in _AUC_MEASURES.items())}),
c AS (SELECT measure, fold, s, sum(y) AS p, sum(1 - y) AS n FROM s JOIN folds USING (idx) GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY measure, fold ORDER BY s) - n AS below FROM c)
SELECT measure, fold, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg,
       round(sum(p * (2 * below + n)) / (2.0 * sum(p) * sum(n)), 9) AS auc
FROM w GROUP BY measure, fold""", "pairs"))
def q_auc_by_fold(spark, sf_dir):
    """Exact AUC of the gram measures' scores in every fold, in one pass."""
    p = V.pairs(spark, sf_dir).select("idx", "Name1", "Name2", "Class")
    f = stratified_kfold(p.select("idx", "Class"), "Class", "idx", 5)
    s = score_pairs(p, "Name1", "Name2", list(_AUC_MEASURES)).join(f.select("idx", "fold"), "idx")
    s = s.select("fold", "Class", *[F.round(m, 9).alias(m) for m in _AUC_MEASURES])
    long = s.unpivot(["fold", "Class"], list(_AUC_MEASURES), "measure", "s")
    a = grouped_auc(long, ["measure", "fold"], "Class", "s")
    return a.select("measure", "fold", "n_pos", "n_neg", rnd(F.col("auc"), 9).alias("auc"))
