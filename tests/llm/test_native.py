"""Chat formatting, quality rules and secret scans against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from toposim.llm import chat, quality, secrets

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_chat_round_trip(spark):
    texts = [chat.PLANTED, "\\", "a\\[INST]b", "[\\INST]", "</s></s>", "", None, "[/INST]\\\\[", "<\\/s>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    rows += [(2, 0, "user", "only"), (3, 0, None, "x"), (3, 0, None, "x"), (None, 1, "assistant", "r"), (4, None, "assistant", "n"), (4, 0, "[INST]", "y")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(9))
    got = {r["conv_id"]: r for r in chat.digest(chat.expand(conv)).collect()}
    assert len(got) == 5
    for key, r in got.items():
        turns = sorted(((t if t is not None else -1, ro or "", x or "") for c, t, ro, x in rows if c == key))
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for _, a, b in turns))
        said = "".join(b for _, a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), sha(said))


def test_chat_examples(spark):
    conv = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2")],
                                 "conv_id long, turn long, role string, text string")
    rows = sorted(chat.expand(conv).collect(), key=lambda r: r["example"])
    assert [r["formatted"][r["loss_start"]:r["loss_start"] + r["loss_chars"]] for r in rows] == ["a1", "a2"]
    assert rows[1]["formatted"].startswith(rows[0]["formatted"])
    assert chat.digest(chat.expand(conv.where("false"))).count() == 0


def counts(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [s for s in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(odd, none):
    rows = odd.select("doc_id", "text").collect()
    got = quality.judge(odd).collect()
    assert sorted(map(repr, ((r["doc_id"], *(r[c] for c in quality.COUNTS)) for r in got))) == sorted(
        map(repr, ((r["doc_id"], *counts(r["text"])) for r in rows)))
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.judge(none).count() == 0
    assert quality.keep(odd).columns == odd.columns


def test_quality_buckets(spark):
    vals = list(range(300)) + [10 ** 6, 10 ** 12]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v long").select(quality.bucket(F.col("v"))).collect()]
    assert got == sorted(got) and got[:64] == list(range(64))


def test_quality_thresholds_by_group(spark):
    """A cutoff is median + reach * (q90 - median) + slack of the merged sketches."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, text + " #" * (i % 4), "en", "s") for i in range(200)] + [(999, text + " #" * 60, "en", "s")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(999) and all(got.values())


@pytest.mark.parametrize("share", [15, 30])
def test_quality_junk_in_a_hot_source(spark, share):
    """Junk is rejected also where a third of all rows, and more than a tenth of their source, is such."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, text + (" #" * 150 if i % 100 < share else ""), "en", "hot") for i in range(3000)]
    rows += [(10_000 + i, text + " #" * (i % 4), "en", f"s{i % 20}") for i in range(6000)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {i: not (i < 3000 and i % 100 < share) for i, *_ in rows}
    one = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows[:90], "doc_id long, text string, lang string, source string")).collect()}
    assert len(one) == 90  # no others: its own spread


def test_quality_many_sources(spark):
    """The work of the thresholds grows with the sketches' rows: 16,000 groups are no join of groups and buckets."""
    import time
    rows = spark.range(64_000).selectExpr("concat('l', id % 3) lang_key", "concat('s', id % 16000) source_key", "explode(array('symbols', 'dup_lines')) metric",
                                          "cast(pmod(xxhash64(id), 500) as long) bucket").groupBy("lang_key", "source_key", "metric", "bucket").count().withColumnRenamed("count", "n")
    began = time.time()
    assert quality.thresholds(rows).count() == 48_000
    assert time.time() - began < 60


def found(x):
    pats = {k: (re.compile(p), g, n) for k, (p, g, n) in secrets.BASE.items()}
    out = [(m.start(), list(pats).index(k), m.end(), k) for k, (p, g, n) in pats.items() for m in p.finditer(x or "") if len(m[g]) >= n]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secret_spans(spark, odd, none):
    hexes, key = "0123456789abcdef" * 3, "AKIA" + "A1" * 8
    texts = [f"é😀 token: token: abcdefgh12 {key}x {hexes}", "PassWord='ab' secret=" + "z" * 9, key[:15], hexes[:31], f"api_key:{hexes}", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(df).collect():
        assert r["base_sha256"] == sha(found(texts[r["doc_id"]]))
    assert secrets.scan(none).count() == 0
    assert secrets.scan(odd).count() == odd.count()


def test_secret_battery(spark):
    import random
    r = random.Random(5)
    alphabet = secrets.ENCODINGS[6][1]
    rows = [(i, "see " + "".join(r.choices(alphabet, k=40)) + " there") for i in range(200)]
    rows += [(1000 + i, "see " + r.choice(["internationalizationandmore", "ThisIsALongCamelCaseNameInCode", "a/path/to/some/file/in/a/tree", "-" * 30]) + " there") for i in range(200)]
    got = {x["doc_id"]: x["spans"] for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("random:4:44" == got[i] for i in range(200)) >= 170
    assert not any(got[1000 + i] for i in range(200))


def test_redaction(spark, odd):
    rows = [(1, "a password=abcdefgh1234 b AKIA" + "Q" * 16 + "!", 3), (2, "clean", 5), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(df).collect()}
    assert got == {1: ("a [SECRET] b [SECRET]!", 22), 2: ("clean", 5), 3: (None, None)}
    assert secrets.redact(odd).columns == odd.columns


@pytest.mark.parametrize("fn", [lambda d: chat.digest(chat.expand(d.selectExpr("doc_id conv_id", "doc_id turn", "lang role", "text"))), quality.judge, quality.keep, secrets.scan, secrets.redact])
def test_no_python_on_the_executors(odd, fn):
    plan = fn(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
