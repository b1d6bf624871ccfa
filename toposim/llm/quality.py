"""Quality rules with adaptive thresholds, in DataFrame functions.

Instead of fixed cutoffs, each (language, source) gets its own.  A
mergeable quantile sketch of every metric is kept per (language,
source): counts in logarithmic buckets of whole numbers (64 steps per
power of two, so a quantile is off by under 1/64 of itself).  Sketches
merge by adding counts, in any order and with the same result.  A
group's sketch is merged with its language's and the corpus's, the
wider ones scaled down to ``prior`` documents, so small groups borrow
from larger ones.  The upper cutoff of a metric is

    median + reach * min(q90 - median, the others' q90 - median) + slack

and a document is rejected when a metric lies above its cutoff.  The
others are the language's other sources and, scaled down to ``prior``
documents, all other groups; none counts for more than ``prior``
documents.  So a source full of junk, however large, widens neither its
own cutoff nor much those of the rest.  A fault that most groups share,
or more than half of a group, still counts as usual there, and a corpus
of one group has no others.

The three-word windows that a text repeats are found by sorting 64-bit
window hashes with their positions, and only the windows flagged by a
hash are compared as texts, so the count is exact.

Defined cases: a null or empty text has no words and fails the base
rule; null languages and sources are groups of their own; repeated rows
count and are judged each for itself; an empty table gives no rows;
other columns of the input are passed through by ``keep`` and ignored
by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from toposim.llm.common import carried, lookup_join, materialize, table

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Metric -> (slack above the adaptive part, as parts in 10,000).
METRICS = {"symbols": 200, "dup_lines": 2500, "repeats": 2500, "shouting": 2500}
REACH = 4.0
PRIOR = 2000
SCALE = 10_000
#: Weights are counted in millionths; a value of at most ``SCALE`` lies in bucket ``TOP`` or below.
UNIT, TOP = 1_000_000, 526
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _bits(v: Column) -> Column:
    return F.length(F.bin(v))


def bucket(v: Column) -> Column:
    """Bucket of a whole number >= 0: itself below 64, then 64 buckets per power of two."""
    shift = F.greatest(_bits(v) - 7, F.lit(0))
    return (shift * 64 + F.call_function("shiftright", v, shift)).cast("long")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts, the number of lines, and capital letters ("n_upper").

    The intermediate columns are dropped; the input's columns stay.
    """
    keep = [c for c in docs.columns if c not in (*COUNTS, "n_lines", "n_upper")]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(*[F.col(f"`{c}`") for c in keep], F.filter(F.split(t, SPACE, -1), lambda x: x != "").alias("__w"),
                    F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))).alias("__l"), t.alias("__t"))
    # windows as (hash, first position), in hash order
    d = d.select("*", F.size("__w").alias("__n"))
    hashes = F.when(F.col("__n") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("__n") - 3, F.lit(0))),
                    lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))))
    d = d.select("*", hashes.alias("__h"))
    d = d.select("*", F.when(F.size(F.array_distinct("__h")) < F.size("__h"),
                             F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
                 .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("__s"))
    d = d.drop("__h").select("*", _twins("__s", "h").alias("__c"))
    # the flagged ones again, by their words
    words = lambda i: F.concat_ws(" ", F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    d = d.drop("__s").select("*", F.array_sort(F.transform("__c", lambda i: F.struct(words(i).alias("h"), i.alias("i")))).alias("__s"))
    d = d.select("*", F.array_sort(_twins("__s", "h")).alias("__p"))
    covered = F.aggregate(
        F.transform("__p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__p", k + 1), F.lit(2 ** 31 - 1)) - p)),
        F.lit(0), lambda a, x: a + x)
    bare = F.length(F.array_join("__w", ""))
    return d.select(
        *[F.col(f"`{c}`") for c in keep], F.col("__n").cast("long").alias("n_words"), bare.cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.length("__t") - F.length(F.regexp_replace("__t", "[A-Z]", ""))).cast("long").alias("n_upper"))


def _twins(col: str, field: str) -> Column:
    """Positions of a sorted array of (key, position) whose key is also a neighbour's."""
    pairs = F.filter(col, lambda x, k: (x[field] == F.when(k > 0, F.get(col, k - 1)[field]))
                     | (x[field] == F.get(col, k + 1)[field]))
    return F.transform(pairs, lambda x: x["i"])


def metric_values() -> dict[str, Column]:
    """Each metric as a whole number of parts in 10,000.  ``more`` is added
    to the denominator, so one repeated line of three says little."""
    part = lambda a, b, more: F.floor(SCALE * F.col(a) / (F.col(b) + more)).cast("long")
    return {"symbols": part("n_symbols", "word_chars", 20), "dup_lines": part("n_dup_lines", "n_lines", 4),
            "repeats": part("n_repeat_words", "n_words", 30), "shouting": part("n_upper", "word_chars", 20)}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("null"))


def sketch(counted: DataFrame) -> DataFrame:
    """(lang, source) sketches of the documents that pass the base rule:
    lang_key, source_key, metric, bucket, n."""
    values = metric_values()
    d = counted.where(~base_failed()).select(_key("lang").alias("lang_key"), _key("source").alias("source_key"),
                                             F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in values.items()])).alias("m"))
    d = d.select("lang_key", "source_key", "m.metric", F.least(bucket(F.col("m.v")), F.lit(TOP)).alias("bucket"))
    return d.groupBy("lang_key", "source_key", "metric", "bucket").agg(F.count("*").alias("n"))


def _low(b: Column) -> Column:
    """The least value of a bucket."""
    shift = F.greatest(F.floor(b / 64) - 1, F.lit(0)).cast("int")
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - shift * 64, shift)).cast("long")


def _quantile(x: float, upto, total: Column) -> Column:
    """The least value whose bucket's cumulated weight ``upto(bucket)``
    reaches the share ``x`` of ``total``, by binary search."""
    def step(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        enough = upto(mid) >= total * x
        return F.struct(F.when(enough, at["lo"]).otherwise(F.least(mid + 1, at["hi"])).alias("lo"),
                        F.when(enough, mid).otherwise(at["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(TOP).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TOP.bit_length())), start, step, lambda at: _low(at["hi"]))


def _running(weights: DataFrame, by: list[str]) -> DataFrame:
    """Per key of ``by`` the running sums of n and c over all buckets, as
    arrays from bucket 0 to ``TOP``."""
    every = weights.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(TOP))).alias("bucket"))
    every = every.select(*by, F.col("bucket").cast("long").alias("bucket"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"))
    d = weights.select(*by, "bucket", "n", "c").unionByName(every).groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    run = W.partitionBy(*by).orderBy("bucket")
    d = d.select(*by, F.struct("bucket", F.sum("n").over(run).alias("n"), F.sum("c").over(run).alias("c")).alias("r"))
    d = d.groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return d.select(*by, F.col("r.n").alias(f"n_{len(by)}"), F.col("r.c").alias(f"c_{len(by)}"))


def thresholds(sk: DataFrame, reach: float = REACH, prior: int = PRIOR) -> DataFrame:
    """One row per (lang_key, source_key), an upper cutoff per metric.

    Weights are whole millionths of documents.  The language's and the
    corpus's sketches become arrays of running sums once; each group looks
    its quantiles up in them and in its own short list, so the work grows
    with the rows of the sketches.
    """
    group = ["lang_key", "source_key", "metric"]
    own = sk.groupBy(*group).agg(F.sum("n").alias("size"), F.collect_list(F.struct("bucket", "n")).alias("own"))
    # c: a group's documents, at most ``prior`` of them
    c = lambda n: F.when(F.col("size") <= prior, n * UNIT).otherwise(F.floor(n * F.lit(prior * UNIT).cast("decimal(20,0)") / F.col("size")).cast("long"))
    own = own.select(*group, "size", F.transform("own", lambda x: F.struct(x["bucket"].alias("b"), x["n"].alias("n"), c(x["n"]).alias("c"))).alias("own"))
    own = materialize(own, "quality-own")
    flat = own.select(*group, F.explode("own").alias("o")).select(*group, F.col("o.b").alias("bucket"), "o.n", "o.c")
    per_lang = flat.groupBy("lang_key", "metric", "bucket").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    langs = materialize(_running(per_lang, ["lang_key", "metric"]), "quality-langs")
    corpus = _running(per_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), ["metric"])
    # at most 2,000 rows of 8 KB are broadcast; a row for each of the four metrics in any case
    d = lookup_join(own, langs, ["lang_key", "metric"], F.col("source_key"), rows=2000).join(F.broadcast(corpus), "metric")

    def mine(field: str, b: Column) -> Column:
        return F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + F.when(x["b"] <= b, x[field]).otherwise(F.lit(0)))

    def share(arr: str, b: Column) -> Column:
        return F.floor(F.get(arr, b) * F.lit(prior * UNIT).cast("decimal(20,0)") / F.get(arr, F.lit(TOP))).cast("long")

    def merged(b: Column) -> Column:
        return mine("n", b) * UNIT + share("n_2", b) + share("n_1", b)

    last = F.lit(TOP)
    d = d.select("*", mine("c", last).alias("mine"), merged(last).alias("total"))
    d = d.select("*", (F.get("c_1", last) - F.col("mine")).alias("rest"))
    scale = F.least(F.lit(1.0), F.lit(float(prior * UNIT)) / F.greatest(F.col("rest"), F.lit(1)))

    def others(b: Column) -> Column:
        own_c = mine("c", b)
        return (F.get("c_2", b) - own_c).cast("double") + (F.get("c_1", b) - own_c).cast("double") * scale

    d = d.select("*", others(last).alias("other_total"))
    d = d.select("lang_key", "source_key", "metric",
                 _quantile(0.5, merged, F.col("total")).alias("q50"), _quantile(0.9, merged, F.col("total")).alias("q90"),
                 F.when(F.col("rest") > 0, _quantile(0.9, others, F.col("other_total")) - _quantile(0.5, others, F.col("other_total"))).alias("most"))
    cut = d.select("lang_key", "source_key", "metric", (F.col("q50") + reach * F.least(F.col("q90") - F.col("q50"), "most")).alias("cut"))
    return cut.groupBy("lang_key", "source_key").agg(
        *[(F.max(F.when(F.col("metric") == m, F.col("cut"))) + slack).alias(f"max_{m}") for m, slack in METRICS.items()])


def apply_thresholds(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept; a hot (language, source) is no hot task."""
    d = counted.select("*", _key("lang").alias("lang_key"), _key("source").alias("source_key"))
    d = lookup_join(d, limits, ["lang_key", "source_key"], F.col("doc_id"))
    above = F.lit(False)
    for m, v in metric_values().items():
        above = above | (v > F.coalesce(F.col(f"max_{m}"), F.lit(float(SCALE) * 1e6)))
    return d.select("*", base_failed().alias("base_failed"), (~(base_failed() | above)).alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept."""
    counted = materialize(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    limits = materialize(thresholds(sketch(counted)), "quality-cut")
    return apply_thresholds(counted, limits).select("doc_id", *COUNTS, "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns.

    The counted documents are written once, so texts are neither counted
    twice nor shuffled."""
    counted = materialize(with_counts(carried(docs, "doc_id", "text", "lang", "source")).drop("text"), "quality")
    limits = materialize(thresholds(sketch(counted)), "quality-cut")
    return apply_thresholds(counted, limits).where("kept").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    more = {"symbols": ("n_symbols", "word_chars", 20), "dup_lines": ("n_dup_lines", "n_lines", 4),
            "repeats": ("n_repeat_words", "n_words", 30), "shouting": ("n_upper", "word_chars", 20)}
    value = {m: f"CAST(floor({SCALE} * {a} / ({b} + {k})) AS BIGINT)" for m, (a, b, k) in more.items()}
    unpivot = " UNION ALL ".join(f"SELECT lk, sk, '{m}' AS metric, {v} AS v FROM c WHERE NOT base_failed" for m, v in value.items())
    q = lambda upto, total, x: f"min(low) FILTER ({upto}::DOUBLE >= {total}::DOUBLE * {x}::DOUBLE)"
    above = " OR ".join(f"{value[m]} > coalesce(max_{m}, 1e12)" for m in METRICS)
    cuts = ", ".join(f"max(cut) FILTER (metric = '{m}') + {slack} AS max_{m}" for m, slack in METRICS.items())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, 'null') AS lk, coalesce('=' || source, 'null') AS sk,
                  coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM w, unnest(range(1, len(ws) - 1)) u(i)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS k FROM tri) WHERE k > 1),
rep AS (SELECT rid, count(DISTINCT i + d) AS n FROM hit, unnest([0, 1, 2]) u(d) GROUP BY rid),
c0 AS (SELECT w.rid, doc_id, lk, sk, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
              length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
              coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
       FROM w LEFT JOIN rep ON w.rid = rep.rid),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c0),
b AS (SELECT lk, sk, metric, greatest(length(bin(v)) - 7, 0) AS s, v FROM ({unpivot})),
k AS (SELECT lk, sk, metric, least(s * 64 + (v >> s), {TOP}) AS bucket, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT lk, sk, metric, sum(n)::BIGINT AS size FROM k GROUP BY ALL),
grid AS (SELECT g.*, u.b AS bucket FROM g, range({TOP + 1}) u(b)),
o AS (SELECT grid.*, coalesce(n, 0) AS n,
             CASE WHEN size <= {PRIOR} THEN coalesce(n, 0) * {UNIT} ELSE (coalesce(n, 0)::HUGEINT * {PRIOR * UNIT}) // size END::BIGINT AS c
      FROM grid LEFT JOIN k USING (lk, sk, metric, bucket)),
r AS (SELECT lk, sk, metric, bucket, sum(n) OVER own AS n, sum(c) OVER own AS c FROM o WINDOW own AS (PARTITION BY lk, sk, metric ORDER BY bucket)),
e AS (SELECT r.*, l.n AS ln, l.c AS lc, a.n AS an, a.c AS ac FROM r
      JOIN (SELECT lk, metric, bucket, sum(n) AS n, sum(c) AS c FROM r GROUP BY ALL) l USING (lk, metric, bucket)
      JOIN (SELECT metric, bucket, sum(n) AS n, sum(c) AS c FROM r GROUP BY ALL) a USING (metric, bucket)),
f AS (SELECT *, max(ln) OVER w AS l_all, max(an) OVER w AS a_all, max(ac - c) OVER w AS rest FROM e WINDOW w AS (PARTITION BY lk, sk, metric)),
h AS (SELECT lk, sk, metric, CASE WHEN bucket < 64 THEN bucket ELSE (bucket - (bucket // 64 - 1) * 64) << CAST(bucket // 64 - 1 AS INTEGER) END AS low,
             n * {UNIT} + (ln * {PRIOR * UNIT}) // l_all + (an * {PRIOR * UNIT}) // a_all AS upto,
             CASE WHEN rest > 0 THEN (lc - c)::DOUBLE + (ac - c)::DOUBLE * least(1.0::DOUBLE, {float(PRIOR * UNIT)}::DOUBLE / greatest(rest, 1)::DOUBLE) END AS other FROM f),
t2 AS (SELECT *, max(upto) OVER w AS total, max(other) OVER w AS other_total FROM h WINDOW w AS (PARTITION BY lk, sk, metric)),
q AS (SELECT lk, sk, metric, {q('upto', 'total', 0.5)} AS q50, {q('upto', 'total', 0.9)} AS q90,
             {q('other', 'other_total', 0.9)} - {q('other', 'other_total', 0.5)} AS most FROM t2 GROUP BY ALL),
l AS (SELECT lk, sk, metric, q50 + {REACH} * least(q90 - q50, most) AS cut FROM q),
lim AS (SELECT lk, sk, {cuts} FROM l GROUP BY lk, sk)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR {above}) AS kept
FROM c LEFT JOIN lim USING (lk, sk)
"""


ORACLE_SQL = _oracle()
