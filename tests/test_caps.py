"""No length or type changes an answer."""

import math

from pyspark.sql import functions as F

from toposim.functions import text as T
from toposim.functions.address import numbers_diff, street_numbers
from toposim.operators.grid import WEIGHTS
from toposim.operators.splits import balanced_sample, stratified_kfold, stratified_shuffle_split


def test_natural_order_of_long_numbers(spark):
    a, b, c = "9" * 41, "1" + "0" * 41, "007"
    df = spark.createDataFrame([(f"x{b} x{a} x{c} x8",)], "s string")
    assert df.select(T.simple_sort("s")).first()[0] == f"x{c} x8 x{a} x{b}"


def test_long_house_numbers(spark):
    df = spark.createDataFrame([("Way " + "1" * 20, "Way " + "1" * 19 + "3", "Way " + "9" * 50)], "a string, b string, c string")
    r = df.select(numbers_diff(street_numbers("a"), street_numbers("b")).alias("d"), street_numbers("c").alias("n")).first()
    assert int(r.d) == 2 and int(r.n[0]) == 10 ** 38 - 1


def test_more_scripts_and_letters(spark):
    rows = [("বাংলা", "BENGALI"), ("தமிழ்", "TAMIL"), ("አማርኛ", "ETHIOPIC"), ("名", "CJK"), ("12", "UND")]
    df = spark.createDataFrame(rows, "s string, want string")
    assert all(r.got == r.want for r in df.select("want", T.detect_alphabet("s").alias("got")).collect())
    assert spark.createDataFrame([("が ế",)], "s string").select(T.strip_accents("s")).first()[0] == "か e"


def test_names_of_rare_scripts(spark):
    """Every letter's word is its name's first word, where no listed script claims the letter."""
    import unicodedata
    rows = [(chr(0x1401), "CANADIAN"), (chr(0x1720), "HANUNOO"), (chr(0xA90A), "KAYAH"), (chr(0x10400), "DESERET"),
            (chr(0x1E900) + "7", "ADLAM"), ("A" + chr(0x1401), "LATIN"), ("\u00a7 7", "UND"), ("", "UND")]
    assert all(unicodedata.name(s[0]).split()[0] == w for s, w in rows[:5])
    df = spark.createDataFrame(rows, "s string, want string")
    assert all(r.got == r.want for r in df.select("want", T.detect_alphabet("s").alias("got")).collect())
    got = df.select(T.only_alphabet("s", "canadian").alias("o"), T.any_alphabet("s", "canadian").alias("a"), T.any_alphabet("s", "latin").alias("l")).collect()
    assert [r.o for r in got] == [True, False, False, False, False, False, True, True]
    assert [r.a for r in got] == [True, False, False, False, False, True, False, False] and [r.l for r in got].index(True) == 5


def test_streets_that_meet_a_box(spark):
    from toposim.operators.osm import streets
    lines = {1: [(0, 0), (1, 1)], 2: [(-5, 5), (15, 5)], 3: [(-5, 8), (4, 20)], 4: [(10, 10), (20, 20)], 5: [(-1, 8), (3, 12)],
             6: [(-2, 9), (1, 12)], 7: [(-3, -3), (-1, 4), (-1, 9)], 8: [(5, -9), (5, 30)], 9: [(30, 30), (30, 30)], 10: [(3, 3)]}
    rows = [("way", k, [{"lon": float(x), "lat": float(y)} for x, y in pts], {"highway": "path"}) for k, pts in lines.items()]
    el = spark.createDataFrame(rows, "type string, id long, geometry array<struct<lat: double, lon: double>>, tags map<string, string>")
    assert sorted(r.id for r in streets(el, (0.0, 0.0, 10.0, 10.0)).collect()) == [1, 2, 4, 5, 8]
    assert streets(el).count() == 9


def test_splits_of_string_ids(spark):
    rows = [(f"id{i:04d}", i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, label boolean")
    folds = stratified_kfold(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    assert sorted((r["label"], r["count"]) for r in folds) == [(False, 40)] * 5 + [(True, 20)] * 5
    parts = stratified_shuffle_split(df, "label", "id", 3).groupBy("split", "label").agg(F.sum("is_test").alias("n"), F.count("*").alias("k")).collect()
    assert len(parts) == 6 and all(r["n"] == (20 if r["label"] else 40) and r["k"] == (100 if r["label"] else 200) for r in parts)
    assert balanced_sample(df, "label", "id").count() == 200
    assert balanced_sample(df, "label", "id", 30).count() == 60
    assert balanced_sample(df.where("label"), "label", "id").count() == 0


def test_weights_sum_to_one():
    assert len(WEIGHTS) == len(set(WEIGHTS)) == 27
    assert all(math.isclose(sum(w), 1, abs_tol=1e-9) for w in WEIGHTS)
