"""Feature build and learning queries (N5, M1-M9, L1).  The feature table
has a SQL twin; the learning queries are checked rows-only and by unit
tests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from toposim.plans import views as V
from toposim.plans.catalog import register, rnd
from toposim.plans.features import build_features, feature_names
from toposim.plans.queries_lgm import FEATURES_SQL
from toposim.plans.models import evaluate, fit, importances, tune
from toposim.plans.views import fixture_frequent_terms
from toposim.session import checkpoint_dir


_FEATURES: dict = {}


def fixture_features(spark, sf_dir, group: str = "lgm"):
    """The feature table is checkpointed inside ``build_features``; the
    learning queries of one session reuse that stored table."""
    key = (spark.sparkContext.applicationId, sf_dir, group)
    if key not in _FEATURES:
        _FEATURES[key] = build_features(V.pairs(spark, sf_dir), fixture_frequent_terms(spark, sf_dir), group)
    return _FEATURES[key]


@register("features_lgm", FEATURES_SQL)
def q_features(spark, sf_dir):
    """The 59-column lgm feature table of the pairs."""
    f = fixture_features(spark, sf_dir)
    return f.select("index", *[rnd(F.col(n)).alias(n) for n in feature_names("lgm")], "class")


@register("eval_models")
def q_eval(spark, sf_dir):
    """M7: boosted trees over 5 stratified splits, averaged metrics."""
    f = fixture_features(spark, sf_dir)
    _, summary = evaluate(f, feature_names("lgm"), ["XGBoost"])
    return summary.drop("seconds", "fimportances")


@register("importances")
def q_importances(spark, sf_dir):
    """L1: top-10 feature importances of boosted trees on all pairs."""
    f = fixture_features(spark, sf_dir)
    names = feature_names("lgm")
    return importances(fit(f, names, "XGBoost"), names, 10)


@register("tune_dt")
def q_tune(spark, sf_dir):
    """M4/M9: grid search of a decision tree with 5 stratified folds."""
    f = fixture_features(spark, sf_dir)
    params, metrics = tune(f, feature_names("lgm"), "DecisionTree")
    return metrics.select(*[F.lit(v).alias(k) for k, v in sorted(params.items())], "*")


from toposim.operators.splits import stratified_kfold  # noqa: E402
from toposim.plans.models import evaluate_pre_split, select_model  # noqa: E402


@register("select_model")
def q_select_model(spark, sf_dir):
    """M5/L2: 5-fold ROC-AUC of three classifier families, best flagged."""
    f = fixture_features(spark, sf_dir)
    return select_model(f, feature_names("lgm"), ["DecisionTree", "ExtraTrees", "XGBoost"])


@register("eval_pre_split")
def q_eval_pre_split(spark, sf_dir):
    """M8: train on folds 0-3 (80 % stratified), test on fold 4."""
    f = fixture_features(spark, sf_dir)
    folds = stratified_kfold(f.select("index", "class"), "class", "index", 5).select("index", "fold")
    j = f.join(folds, "index")
    train, test = j.where("fold < 4").drop("fold"), j.where("fold = 4").drop("fold")
    return evaluate_pre_split(train, test, feature_names("lgm"), ["XGBoost", "DecisionTree"])


@register("svm_predictions")
def q_svm_predictions(spark, sf_dir):
    """M3/M7 with K2 and K3: a linear support vector machine on one
    stratified split, its test predictions with calibrated probabilities
    and its result row written, the predictions read back."""
    f = fixture_features(spark, sf_dir)
    base = f"{checkpoint_dir(spark).rstrip('/')}/toposim-{uuid.uuid4().hex}"
    evaluate(f, feature_names("lgm"), ["SVM"], n_splits=1, predictions_path=f"{base}/predictions", results_path=f"{base}/results")
    p = spark.read.parquet(f"{base}/predictions")
    return p.select("index", rnd(F.col("prob_class_0")).alias("prob_class_0"), rnd(F.col("prob_class_1")).alias("prob_class_1"), "pred_class", "class")


from toposim.plans.models import FAMILIES  # noqa: E402
from toposim.plans.search import search_and_test  # noqa: E402


@register("eval_families")
def q_eval_families(spark, sf_dir):
    """M7/M8/H8: all six families on one stratified split, fitted on its
    whole training part, predictions and results written and read back; metrics, and the feature of the largest
    mean importance or coefficient."""
    f, names = fixture_features(spark, sf_dir), feature_names("lgm")
    base = f"{checkpoint_dir(spark).rstrip('/')}/toposim-{uuid.uuid4().hex}"
    _, summary = evaluate(f, names, FAMILIES, n_splits=1, predictions_path=f"{base}/predictions", results_path=f"{base}/results")
    size = F.transform("fimportances", F.abs)
    top = F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(size, F.array_max(size)) - 1).cast("int"))
    saved = spark.read.parquet(f"{base}/predictions").groupBy("classifier").agg(F.count("*").alias("predictions"))
    results = spark.read.parquet(f"{base}/results").drop("seconds")
    return results.join(saved, "classifier").join(summary.select("classifier", top.alias("top_feature")), "classifier")


@register("search_models")
def q_search_models(spark, sf_dir):
    """M4/M5/M9: two drawn settings of each of the six families, scored by
    three folds of the whole training part; each family's winner on the test part, the best flagged.
    (The operator's default is 200 settings and five folds.)"""
    return search_and_test(fixture_features(spark, sf_dir), feature_names("lgm"), FAMILIES, draws=2, folds=3)
