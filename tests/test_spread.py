"""Work is dealt over the cores, and results are those of the plainer paths."""

import pytest
from pyspark.sql import functions as F

from toposim.functions import termsplit
from toposim.functions.grams import dice_bigrams, gram_cosine, gram_jaccard, skipgram_jaccard
from toposim.operators import pairgen, tokenpairs
from toposim.operators.scoring import score_pairs
from toposim.operators.terms import frequent_set, term_counts
from toposim.plans import views as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("view", [V.pairs, V.pois, V.gazetteer])
def test_a_small_file_is_dealt_over_the_cores(spark, sf_dir, view):
    assert view(spark, sf_dir).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_gram_measures_alone_are_one_arrow_call(spark):
    d = spark.createDataFrame([("ab cd", "ab ce"), ("", ""), ("a", None), ("éa a", "ea a")], "a string, b string")
    want = {"jaccard": gram_jaccard, "cosine": gram_cosine, "strike_a_match": dice_bigrams, "skipgram": skipgram_jaccard}
    got = score_pairs(d, "a", "b", list(want))
    assert "ArrowEvalPython" in plan(got) and "aggregate(" not in plan(got)
    a, b = (F.coalesce(F.col(x), F.lit("")) for x in "ab")
    for x, y in zip(got.collect(), d.select(*[f(a, b).alias(m) for m, f in want.items()]).collect()):
        assert all(x[m] == pytest.approx(y[m], abs=1e-12) for m in want)
    wide = spark.createDataFrame([("a\U0001f600b", "ab")], "a string, b string")  # windows of code points, not of halves
    assert score_pairs(wide, "a", "b", ["jaccard"]).first().jaccard == pytest.approx(2 / 10)


def test_the_dictionary_is_never_broadcast(spark):
    d = spark.createDataFrame([("a b", "b c")], "a string, b string")
    lists = [(F.split("a", " "), F.split("b", " "))]
    join = [x for x in plan(tokenpairs.attach(d, lists)).splitlines() if "Join" in x and "_rid" not in x]
    assert join and not any("Broadcast" in x for x in join)


def test_terms_are_counted_once(spark):
    d = spark.createDataFrame([("street main", "streets main"), ("main", None)], "a string, b string")
    counts = term_counts(d, ["a", "b"])
    assert {(r.gram, r["count"]) for r in counts.collect()} == {("street", 1), ("streets", 1), ("main", 3)}
    tops = frequent_set(counts, 1)
    assert {r.term for r in tops.collect()} == {"main", "niam"}
    assert tops._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_special_terms_from_a_set(spark):
    spec, cut = termsplit.special_terms(F.col("s"), ["st", "st.main", "a"])
    d = spark.createDataFrame([("a st x st.main a",), ("",), ("x",)], "s string").select(spec.alias("p"), cut.alias("c"))
    assert [(r.p, r.c.split()) for r in d.collect()] == [(["a", "st", "st.main"], ["x"]), ([], []), ([], ["x"])]
    spec, cut = termsplit.special_terms(F.lit("a"), [])
    assert spark.range(1).select(spec, cut).first()[:] == ([], "a")


def test_token_pairs_are_distinct_strings(spark):
    """Structs would be made distinct by comparing all with all."""
    lists = [(F.split("a", " ", -1), F.split("b", " ", -1)), (F.split("b", " ", -1), F.split("a", " ", -1))]
    d = spark.createDataFrame([("a  b", "b b"), ("", "x")], "a string, b string")
    met = d.select(tokenpairs.met(lists).alias("m"))
    assert met.schema["m"].dataType.simpleString() == "array<string>"
    got = [{(t["x"], t["y"]) for t in r[tokenpairs.WEIGHTS]} for r in tokenpairs.attach(d, lists).orderBy(F.desc("a")).collect()]
    assert got == [{("a", "b"), ("", "b"), ("b", "b"), ("b", "a"), ("b", "")}, {("", "x"), ("x", "")}]


def test_positive_and_hard_pairs_use_the_arrow_call(spark):
    rows = [(1, "Main Street", "main street", "Rue Main,MAIN STREET"), (2, "Main Road", "road", "Road Main,Strasse")]
    gaz = spark.createDataFrame(rows, "geonameid long, name string, asciiname string, alternate_names string").withColumn("country_code", F.lit("C1"))
    pl = pairgen.places(gaz)
    got = pairgen.positive_pairs(pl)
    assert "ArrowEvalPython" in plan(got) and got.columns == ["n1", "n2", "id", "country"]
    pairs = {(r.n1, r.n2) for r in got.where("id = 1").collect()}
    assert pairs == {("MAIN STREET", "Rue Main"), ("Main Street", "Rue Main"), ("Rue Main", "main street")}
    hard = pairgen.hard_pairs(gaz, per_place=100).where("status = 0")
    want = spark.createDataFrame([(x, y) for x in ("MAIN STREET", "Main Street", "Rue Main", "main street") for y in ("Main Road", "Road Main", "Strasse", "road")], "x string, y string")
    want = want.where((gram_jaccard("x", "y") > 0) & (F.lower("x") != F.lower("y")))
    assert {(r.s1, r.s2) for r in hard.collect()} == {(r.x, r.y) for r in want.collect()}
