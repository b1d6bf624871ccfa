"""Secret scans, in DataFrame functions.

Three fixed kinds (``assign``, ``access``, ``hex``) are found by pattern.
A battery of randomness tests adds ``random`` spans: every run of 20 or
more characters of the usual encodings is a candidate; its encoding is
inferred, its characters become numbers of that alphabet, and three
tests ask whether they look uniformly random:

* chi-squared of the alphabet's counts, with the exact mean and variance
  of a uniform multinomial, two-sided;
* runs above and below the middle of the alphabet;
* serial correlation of neighbours.

Fisher's method joins the three p-values.  Within each stratum
(encoding, length band) the Benjamini-Hochberg step-up rule at level
``alpha`` declares candidates not random, so the share of true secrets
among those dismissed is held to ``alpha`` whatever the length.  What
remains and carries at least ``MIN_BITS`` (below that the tests have no
power) is a secret.  The p-values meet in a histogram of whole
hundredths of -log10 p per stratum, at most STRATA x P_BUCKETS rows.

Positions are code points, end exclusive: a text split at a pattern
gives the gaps, whose lengths and the matches' add up.

Defined cases: a null text is empty; overlapping spans of different
fixed kinds all stay; a random span that overlaps a fixed one is left
out; repeated rows give a row each; an empty table gives no rows; other
columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from toposim.llm.common import carried, materialize, sha256_hex, table

#: Kind -> (pattern, group to measure, least length).  Fixed values.
BASE = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}
#: Cheap tests that every text with a kept match passes.
_GUARD = {"assign": BASE["assign"][0], "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
KINDS = [*BASE, "random"]
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: (test, alphabet), first fit wins.
ENCODINGS = [
    ("^(?=.*[0-9])[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^(?=.*[0-9])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^(?=.*[2-7])[A-Z2-7]+=*$", _UPPER + "234567"),
    ("^(?=.*[0-9])[a-z0-9]+$", _LOWER + _DIGITS),
    ("^(?=.*[0-9])[A-Z0-9]+$", _UPPER + _DIGITS),
    ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    (".", _UPPER + _LOWER + _DIGITS + "-_+/"),
]
BANDS = (32, 48, 96)
STRATA = len(ENCODINGS) * (len(BANDS) + 1)
P_BUCKETS = 3000
MIN_BITS = 95
ALPHA = 0.05


def _spans(text: Column, pattern: str, group: int, least: int, guard: str, kind: int) -> Column:
    """array of (start, kind, end, tok), in text order, of the long enough matches."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("tok"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    kept = F.array().cast("array<struct<start:int,kind:int,end:int,tok:string>>")
    start = F.struct(F.lit(0).alias("at"), kept.alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + F.coalesce(F.length(m["tok"]), F.lit(0))
        one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["tok"].alias("tok"))
        return F.struct(end.alias("at"), F.when(F.length(m["part"]) >= least, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(F.rlike(text, F.lit(guard)), F.aggregate(found, start, step, lambda a: a["out"])).otherwise(kept)


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _two_sided(z: Column) -> Column:
    return F.greatest(_erfc(F.abs(z) / (2 ** 0.5)), F.lit(1e-12))


def _add(col: str, **new) -> Column:
    """Adds fields to every struct of an array column."""
    def f(c: Column) -> Column:
        for name, make in new.items():
            c = c.withField(name, make(c))
        return c
    return F.transform(col, f)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` (array of start, kind, end) and ``cands`` (array of start,
    end, stratum, p_bucket, strong) to ``docs``."""
    cols = [F.col(f"`{c}`") for c in docs.columns if c not in ("base", "cands")]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(*cols, *[_spans(t, p, g, n, _GUARD[k], i).alias(f"__{k}") for i, (k, (p, g, n)) in enumerate(BASE.items())],
                    _spans(t, CANDIDATE, 0, 20, CANDIDATE, len(BASE)).alias("__c"))
    base = F.transform(F.array_sort(F.concat(*[f"__{k}" for k in BASE])), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    free = F.filter("__c", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    d = d.select(*cols, base.alias("base"), "__c").withColumn("__c", free)

    def encoding(c: Column) -> Column:
        out = F.lit(len(ENCODINGS) - 1)
        for i in reversed(range(len(ENCODINGS))):
            out = F.when(F.rlike(c["tok"], F.lit(ENCODINGS[i][0])), F.lit(i)).otherwise(out)
        return out

    alphabets = F.array(*[F.lit(a) for _, a in ENCODINGS])
    d = d.withColumn("__c", _add("__c", enc=encoding))
    d = d.withColumn("__c", _add("__c", xs=lambda c: F.transform(
        F.split(F.rtrim(c["tok"], F.lit("=")), ""), lambda ch: F.call_function("instr", F.get(alphabets, c["enc"]), ch) - 1)))
    d = d.withColumn("__c", _add(
        "__c", n=lambda c: F.size(c["xs"]).cast("double"),
        k=lambda c: F.length(F.get(alphabets, c["enc"])).cast("double"),
        mean=lambda c: F.aggregate(c["xs"], F.lit(0.0), lambda a, x: a + x) / F.size(c["xs"]),
        sq=lambda c: F.aggregate(F.array_distinct(c["xs"]), F.lit(0.0),
                                 lambda a, v: a + F.pow(F.size(F.filter(c["xs"], lambda x: x == v)).cast("double"), F.lit(2.0))),
        high=lambda c: F.size(F.filter(c["xs"], lambda x: 2 * (x + 0.5) > F.length(F.get(alphabets, c["enc"])))).cast("double"),
        runs=lambda c: 1.0 + F.size(F.filter(c["xs"], lambda x, i: (i > 0) & (
            (2 * (x + 0.5) > F.length(F.get(alphabets, c["enc"])))
            != (2 * (F.coalesce(F.get(c["xs"], F.greatest(i - 1, F.lit(0))), F.lit(0)) + 0.5) > F.length(F.get(alphabets, c["enc"]))))))))
    d = d.withColumn("__c", _add(
        "__c", var=lambda c: F.aggregate(c["xs"], F.lit(0.0), lambda a, x: a + (x - c["mean"]) * (x - c["mean"])),
        cov=lambda c: F.aggregate(F.transform(c["xs"], lambda x, i: F.when(
            i > 0, (x - c["mean"]) * (F.get(c["xs"], F.greatest(i - 1, F.lit(0))) - c["mean"])).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)))

    def z_chi(c: Column) -> Column:
        chi = c["sq"] * c["k"] / c["n"] - c["n"]
        return (chi - (c["k"] - 1)) / F.sqrt(2 * (c["k"] - 1) * (c["n"] - 1) / c["n"])

    def z_runs(c: Column) -> Column:
        both = 2 * c["high"] * (c["n"] - c["high"])
        mu = both / c["n"] + 1
        var = both * (both - c["n"]) / (c["n"] * c["n"] * (c["n"] - 1))
        return F.when(var > 0, (c["runs"] - mu) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(9.0)

    def z_serial(c: Column) -> Column:
        return F.when(c["var"] > 0, (c["cov"] / F.greatest(c["var"], F.lit(1e-9)) + 1 / c["n"]) * F.sqrt(c["n"])).otherwise(9.0)

    def fisher(c: Column) -> Column:
        h = -(F.ln(_two_sided(z_chi(c))) + F.ln(_two_sided(z_runs(c))) + F.ln(_two_sided(z_serial(c))))
        return F.exp(-h) * (1 + h + h * h / 2)

    band = lambda c: sum(((F.length(c["tok"]) >= b).cast("int") for b in BANDS), F.lit(0))
    d = d.withColumn("__c", _add("__c", p=fisher))
    out = F.transform("__c", lambda c: F.struct(
        c["start"], c["end"], (c["enc"] * (len(BANDS) + 1) + band(c)).alias("stratum"),
        F.least(F.floor(-100 * F.log10(F.greatest(c["p"], F.lit(1e-30)))), F.lit(P_BUCKETS - 1)).cast("int").alias("p_bucket"),
        (c["n"] * F.log2(c["k"]) >= MIN_BITS).alias("strong")))
    return d.select(*cols, "base", out.alias("cands"))


def dismissed_from(spans: DataFrame, alpha: float = ALPHA) -> dict[int, int]:
    """Stratum -> the p bucket from which on candidates are not random.

    Step-up over the histogram: the largest p at or under alpha times
    its rank over the stratum's size.  At most ``STRATA`` rows come back.
    """
    h = spans.select(F.explode("cands").alias("c")).groupBy("c.stratum", "c.p_bucket").agg(F.count("*").alias("n"))
    by = W.partitionBy("stratum")
    h = h.select("*", F.sum("n").over(by.orderBy(F.desc("p_bucket"))).alias("rank"), F.sum("n").over(by).alias("m"))
    low = h.where(F.pow(F.lit(10.0), -F.col("p_bucket") / 100.0) <= alpha * F.col("rank") / F.col("m"))
    return {r["stratum"]: r["b"] for r in low.groupBy("stratum").agg(F.min("p_bucket").alias("b")).collect()}


def all_spans(limits: dict[int, int]) -> Column:
    """Fixed and random spans (start, kind, end), by start, then kind."""
    cut = F.lit(P_BUCKETS)
    pairs = [F.lit(x) for kv in sorted(limits.items()) for x in kv]
    at = (lambda c: F.coalesce(F.try_element_at(F.create_map(*pairs), c["stratum"]), cut)) if pairs else (lambda c: cut)
    extra = F.transform(F.filter("cands", lambda c: c["strong"] & (c["p_bucket"] < at(c))),
                        lambda c: F.struct(c["start"].alias("start"), F.lit(len(BASE)).alias("kind"), c["end"].alias("end")))
    return F.array_sort(F.concat("base", extra))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    found = materialize(with_spans(docs.select("doc_id", "text")).drop("text"), "secrets")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
                        sha256_hex(_joined(F.col("base"))).alias("base_sha256"),
                        _joined(all_spans(dismissed_from(found))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[SECRET]`` and n_chars counted
    anew; overlapping spans become one.  Other rows stay as they are."""
    found = materialize(with_spans(carried(docs, "text")).drop("text"), "secrets").withColumn("text", F.col("__row.text"))
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring("text", acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit("[SECRET]"))).otherwise(acc["out"]).alias("out"))

    d = found.withColumn("spans", all_spans(dismissed_from(found)))
    clean = F.aggregate("spans", none, step, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    d = d.withColumn("text", text)
    row = F.col("__row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        row = row.withField("n_chars", F.when(F.size("spans") > 0, counted).otherwise(F.col("__row.n_chars")))
    return d.select(row.alias("__row")).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
