"""The dictionary of token pairs, and the one-call scorer that reads it,
against the native expressions of single columns."""

import random

import pytest
from pyspark.sql import functions as F

from toposim.functions import kernels, pairkernel
from toposim.functions.registry import MEASURES, measure
from toposim.functions.text import split_space
from toposim.operators import tokenpairs
from toposim.operators.scoring import score_many


@pytest.fixture(scope="module")
def pairs(spark):
    rnd, letters = random.Random(1), "abc d.-éÀ 1"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
    rows = [(word(), word()) for _ in range(150)] + [("", ""), ("a", ""), (".", "abc"), ("ab . c", "ab cd"), ("x", "x"), (None, "q"), ("a a a", "a a")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a string, b string")


def test_one_call_equals_single_measures(pairs):
    names = list(MEASURES)
    got = {r.id: r for r in score_many(pairs, [("a", "b", names, "")]).collect()}
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in "ab")
    want = pairs.select("id", *[measure(m)(a, b).alias(m) for m in names]).collect()
    assert len(got) == len(want)
    for r in want:
        for m in names:
            assert got[r.id][m] == pytest.approx(r[m], abs=1e-12), (m, r.id)


def test_every_token_pair_once(pairs):
    rows = pairs.na.fill("").repartition(4)
    lists = [(split_space("a"), split_space("b")), (split_space("b"), split_space("a"))]
    table = tokenpairs.dictionary(rows, lists).collect()
    keys = [(r.x, r.y) for r in table]
    assert len(keys) == len(set(keys))
    assert set(keys) == {p for r in rows.collect() for x in r.a.split(" ") for y in r.b.split(" ") for p in ((x, y), (y, x))}
    assert all(r.w == kernels.jaro_winkler(r.x, r.y) for r in table)
    for r in tokenpairs.attach(rows, lists[:1]).collect():
        assert {(t["x"], t["y"]) for t in r[tokenpairs.WEIGHTS]} == {(x, y) for x in r.a.split(" ") for y in r.b.split(" ")}


def test_hot_pair_and_empty_table(spark):
    hot = spark.range(30_000).selectExpr("id", "concat('main street ', id % 7) a", "if(id % 3 = 0, 'main street', concat('rue ', id % 11)) b")
    got = score_many(hot, [("a", "b", ["monge_elkan", "jaccard"], "x_")])
    assert got.count() == 30_000 and got.where("x_monge_elkan is null").count() == 0
    assert score_many(hot.where("false"), [("a", "b", ["monge_elkan", "jaccard"], "x_")]).count() == 0


def test_gram_numbers():
    got = pairkernel.gram_scores([("", ""), ("ab", "ab"), ("ab", "ba"), ("\x00a", "a")], pairkernel.GRAM)
    assert got["jaccard"].tolist()[:2] == [1.0, 1.0] and got["strike_a_match"].tolist() == [1.0, 1.0, 0.0, 0.0]
