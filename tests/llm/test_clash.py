"""Rows pass the stages whole, whatever their extra columns are called."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from toposim.llm import bpe, jaccard, quality, secrets, toxicity

NAMES = ["__row", "__doc", "__w", "__l", "__t", "__n", "__h", "__s", "__c", "__p", "__id", "__both", "__salt", "n_words", "n_upper", "n_lines",
         "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lang_key", "source_key", "max_symbols", "base_failed", "kept",
         "toxicity", "base", "cands", "spans", "component_id", "n_shingles", "digest", "size", "own", "both", "row", "metric", "out"]


@pytest.fixture(scope="module")
def wide(odd):
    good = odd.sparkSession.createDataFrame(
        [(100 + i, " ".join(f"word{i}x{k}" for k in range(90)), "en", "a", 9) for i in range(20)], odd.columns[:5]).withColumn("score", F.lit(1))
    d = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(good.select("doc_id", "text", "lang", "source", "n_chars"))
    for k in NAMES:
        d = d.withColumn(k, F.concat(F.lit(f"{k}="), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return d


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")


STEPS = {
    "keep": lambda d, _: quality.keep(d), "drop_toxic": toxicity.drop_toxic, "redact": lambda d, _: secrets.redact(d),
    "keep_one": lambda d, _: jaccard.keep_one(d),
    "round_trip": lambda d, _: bpe.round_trip(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
}


@pytest.mark.parametrize("step", STEPS)
def test_extra_columns_come_back(wide, labels, step):
    got = STEPS[step](wide, labels)
    assert [c for c in got.columns if c not in ("ids", "decoded")] == wide.columns
    plain = STEPS[step](wide.drop(*NAMES), labels)
    key = ["doc_id", "text", "n_chars"]
    assert sorted(map(repr, got.select(*key).collect())) == sorted(map(repr, plain.select(*key).collect()))
    rows = got.select("doc_id", *NAMES).collect()
    assert rows
    for r in rows:
        assert [r[c] for c in NAMES] == [f"{c}={'-' if r.doc_id is None else r.doc_id}" for c in NAMES]


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]
