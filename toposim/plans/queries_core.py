"""Core queries: threshold learning, pair measures, address and text
normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposim.functions import text as T
from toposim.functions.address import numbers_diff, street_name, street_numbers
from toposim.functions.registry import NATIVE
from toposim.operators.scoring import score_pairs
from toposim.operators.thresholds import accuracy_by_threshold, best_threshold
from toposim.plans import sqlgen as Q
from toposim.plans import views as V
from toposim.plans.catalog import register, rnd

# ---------------------------------------------------------------- H4/H5 ----

_NATIVE_SQL = {"cosine": Q.cosine, "jaccard": Q.jaccard, "strike_a_match": Q.dice,
               "skipgram": Q.skipgram}

_BEST_SQL = V.with_views(f"""
, s AS (SELECT Class, {', '.join(f'{fn("Name1", "Name2")} AS {m}' for m, fn in _NATIVE_SQL.items())}
        FROM pairs),
long AS (UNPIVOT s ON {', '.join(_NATIVE_SQL)} INTO NAME measure VALUE score),
th AS (SELECT CAST(i AS DOUBLE) / 100.0 AS threshold FROM range(30, 91, 5) r(i)),
acc AS (SELECT measure, threshold,
               CAST(sum(CASE WHEN (round(score, 9) >= threshold) = (Class = 1) THEN 1 ELSE 0 END) AS DOUBLE)
               / count(*) AS accuracy
        FROM long CROSS JOIN th GROUP BY measure, threshold)
SELECT measure, threshold, round(accuracy, 9) AS accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY measure ORDER BY accuracy DESC, threshold) AS rn FROM acc)
WHERE rn = 1""", "pairs")


@register("best_threshold", _BEST_SQL)
def q_best_threshold(spark, sf_dir):
    """J2 on native measures: best threshold per gram measure."""
    pairs = V.pairs(spark, sf_dir)
    scored = score_pairs(pairs.select("Name1", "Name2", "Class"), "Name1", "Name2", NATIVE)
    best = best_threshold(accuracy_by_threshold(scored, "Class", NATIVE))
    return best.select("measure", "threshold", rnd(F.col("accuracy"), 9).alias("accuracy"))


# ---------------------------------------------------------------- C1-C4 ----

@register("gram_scores", V.with_views(
    f"SELECT idx, {', '.join(f'{Q.r(fn("Name1", "Name2"))} AS {m}' for m, fn in _NATIVE_SQL.items())} "
    "FROM pairs", "pairs"))
def q_gram_scores(spark, sf_dir):
    p = V.pairs(spark, sf_dir).select("idx", "Name1", "Name2")
    s = score_pairs(p, "Name1", "Name2", NATIVE)
    return s.select("idx", *[rnd(F.col(m)).alias(m) for m in NATIVE])


# ---------------------------------------------------------------- D1-D5 ----

def _rev(x):
    return f"reverse({x})"


def _sorted(x):
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


_CHAR_SQL = V.with_views(f"""
, {Q.osa_ctes("pairs", "idx", "Name1", "Name2")}
SELECT idx,
  {Q.r(Q.osa_sim())} AS damerau_levenshtein,
  {Q.r(Q.jaro("Name1", "Name2"))} AS jaro,
  {Q.r(Q.jw_from_jaro("Name1", "Name2"))} AS jaro_winkler,
  {Q.r(Q.jw_from_jaro(_rev("Name1"), _rev("Name2")))} AS jaro_winkler_reversed,
  {Q.r(Q.jw_from_jaro(_sorted("Name1"), _sorted("Name2")))} AS sorted_winkler
FROM pairs JOIN osa USING (idx)""", "pairs", recursive=True)

_CHAR = ["damerau_levenshtein", "jaro", "jaro_winkler", "jaro_winkler_reversed", "sorted_winkler"]


@register("char_scores", _CHAR_SQL)
def q_char_scores(spark, sf_dir):
    p = V.pairs(spark, sf_dir).select("idx", "Name1", "Name2")
    s = score_pairs(p, "Name1", "Name2", _CHAR)
    return s.select("idx", *[rnd(F.col(m)).alias(m) for m in _CHAR])


# ---------------------------------------------------------------- E1-E2 ----

def _me_aux(a, b):
    return (f"(list_sum(list_transform({a}, lambda x: list_max(list_transform({b}, lambda y: "
            f"{Q.jw_from_jaro('x', 'y')})))) / len({a}))")


def _soft_sql(a, b):
    inter = (f"((list_sum(list_transform({a}, lambda x: list_max(list_transform({b}, lambda y: {Q.jw_from_jaro('x', 'y')}))))"
             f" + list_sum(list_transform({b}, lambda x: list_max(list_transform({a}, lambda y: {Q.jw_from_jaro('x', 'y')})))))"
             f" / 2.0)")
    return f"({inter} / (len({a}) + len({b}) - {inter}))"


_TOKEN_SQL = V.with_views(f"""
, t AS (SELECT idx, string_split(Name1, ' ') AS a, string_split(Name2, ' ') AS b FROM pairs)
SELECT idx,
  {Q.r(f"(({_me_aux('a', 'b')}) + ({_me_aux('b', 'a')})) / 2.0")} AS monge_elkan,
  {Q.r(_soft_sql('list_distinct(a)', 'list_distinct(b)'))} AS soft_jaccard
FROM t""", "pairs")


@register("token_scores", _TOKEN_SQL)
def q_token_scores(spark, sf_dir):
    p = V.pairs(spark, sf_dir).select("idx", "Name1", "Name2")
    s = score_pairs(p, "Name1", "Name2", ["monge_elkan", "soft_jaccard"])
    return s.select("idx", rnd(F.col("monge_elkan")).alias("monge_elkan"),
                    rnd(F.col("soft_jaccard")).alias("soft_jaccard"))


# ------------------------------------------------------------ E3, D5, D7 ----

def _norm_sql(s):
    return f"string_split(replace(strip_accents(lower({s})), '-', ' '), ' ')"


def _dots_sql(a, b, other_len):
    start = f"[{{'cur': t, 'n': {other_len}}}]"
    after = f"list_transform({b}, lambda y: {{'cur': y, 'n': length(y)}})"
    step = "lambda acc, y: CASE WHEN starts_with(y.cur, replace(acc.cur, '.', '')) AND y.n < acc.n THEN y ELSE acc END"
    return f"list_transform({a}, lambda t: CASE WHEN t = '.' THEN list_reduce(list_concat({start}, {after}), {step}).cur ELSE t END)"


def _sorted_sql(s):
    return f"array_to_string(list_sort(string_split({s}, ' ')), ' ')"


# names, some with tokens that are abbreviation dots
_DOTTED_SQL = """
, n AS (SELECT idx, CASE WHEN idx % 5 = 0 THEN Name1 || ' .' WHEN idx % 5 = 1 THEN '. ' || Name1 ELSE Name1 END AS s1,
               CASE WHEN idx % 7 = 0 THEN replace(Name2, ' ', ' . ') ELSE Name2 END AS s2 FROM pairs)"""

_DAVIES_SQL = V.with_views(f"""{_DOTTED_SQL},
a AS (SELECT *, {_norm_sql('s1')} AS a0, {_norm_sql('s2')} AS b0 FROM n),
b AS (SELECT *, {_dots_sql('a0', 'b0', 'length(s2)')} AS a1 FROM a),
d AS (SELECT *, {_dots_sql('b0', 'a1', 'length(s1)')} AS b1 FROM b),
e AS (SELECT idx, s1, s2, {_sorted_sql('s1')} AS o1, {_sorted_sql('s2')} AS o2, reverse(s1) AS r1, reverse(s2) AS r2,
             list_distinct(a1) AS ta, list_distinct(b1) AS tb FROM d),
v AS (SELECT *, {Q.jw_from_jaro('o1', 'o2')} AS sw, {_soft_sql('ta', 'tb')} AS sj FROM e)
SELECT idx, {Q.r('sw')} AS sorted_winkler, {Q.r('(sw + sj) / 2.0')} AS davies, {Q.r(Q.jw_from_jaro('r1', 'r2'))} AS jaro_winkler_reversed
FROM v""", "pairs")


@register("davies_scores", _DAVIES_SQL)
def q_davies_scores(spark, sf_dir):
    """E3 with its abbreviation step (B3's accents, D5), and D7."""
    i, a, b = F.col("idx"), F.col("Name1"), F.col("Name2")
    s1 = F.when(i % 5 == 0, F.concat(a, F.lit(" ."))).when(i % 5 == 1, F.concat(F.lit(". "), a)).otherwise(a)
    s2 = F.when(i % 7 == 0, F.replace(b, F.lit(" "), F.lit(" . "))).otherwise(b)
    ms = ["sorted_winkler", "davies", "jaro_winkler_reversed"]
    s = score_pairs(V.pairs(spark, sf_dir).select("idx", s1.alias("s1"), s2.alias("s2")), "s1", "s2", ms)
    return s.select("idx", *[rnd(F.col(m)).alias(m) for m in ms])


# ---------------------------------------------------------- D6, D7, N2 ----

_TUNED = f"""{Q.tuned_ctes('pairs', 'idx', 'Name1', 'Name2', 'tn')},
rv AS (SELECT idx, reverse(Name1) AS s1, reverse(Name2) AS s2 FROM pairs),
{Q.tuned_ctes('rv', 'idx', 's1', 's2', 'tr')}"""


@register("tuned_scores", V.with_views(f"""
, {_TUNED}
SELECT idx, {Q.r('tn.score')} AS tuned_jaro_winkler, {Q.r('tr.score')} AS tuned_jaro_winkler_reversed
FROM tn JOIN tr USING (idx)""", "pairs"))
def q_tuned_scores(spark, sf_dir):
    """D6 and its reversal."""
    ms = ["tuned_jaro_winkler", "tuned_jaro_winkler_reversed"]
    s = score_pairs(V.pairs(spark, sf_dir).select("idx", "Name1", "Name2"), "Name1", "Name2", ms)
    return s.select("idx", *[rnd(F.col(m)).alias(m) for m in ms])


def threshold_sql(scores: str) -> str:
    """CTEs and SELECT: each measure's best threshold over ``scores`` (Class, a column per measure)."""
    return f"""long AS (UNPIVOT {scores} ON COLUMNS(* EXCLUDE (Class)) INTO NAME measure VALUE score),
th AS (SELECT CAST(i AS DOUBLE) / 100.0 AS threshold FROM range(30, 91, 5) r(i)),
acc AS (SELECT measure, threshold,
               CAST(sum(CASE WHEN (round(score, 9) >= threshold) = (Class = 1) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy
        FROM long CROSS JOIN th GROUP BY measure, threshold)
SELECT measure, threshold, round(accuracy, 9) AS accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY measure ORDER BY accuracy DESC, threshold) AS rn FROM acc)
WHERE rn = 1"""


def measures_sql(src: str) -> str:
    """CTEs giving ``scores``: idx, Class and all 14 measures of the names s1 and s2 of ``src``."""
    return f"""{Q.osa_ctes(src, "idx", "s1", "s2")}, {Q.tuned_ctes(src, 'idx', 's1', 's2', 'tn')},
rv AS (SELECT idx, reverse(s1) AS r1, reverse(s2) AS r2 FROM {src}),
{Q.tuned_ctes('rv', 'idx', 'r1', 'r2', 'tr')},
a AS (SELECT idx, {_norm_sql('s1')} AS a0, {_norm_sql('s2')} AS b0, length(s1) AS l1, length(s2) AS l2 FROM {src}),
b AS (SELECT *, {_dots_sql('a0', 'b0', 'l2')} AS a1 FROM a),
d AS (SELECT *, {_dots_sql('b0', 'a1', 'l1')} AS b1 FROM b),
e AS (SELECT Class, idx, s1, s2, list_distinct(a1) AS ta, list_distinct(b1) AS tb, string_split(s1, ' ') AS a, string_split(s2, ' ') AS b,
             osa_d, osa_n, tn.score AS tuned, tr.score AS tuned_r
      FROM {src} JOIN d USING (idx) JOIN osa USING (idx) JOIN tn USING (idx) JOIN tr USING (idx)),
f AS (SELECT *, {Q.jw_from_jaro(_sorted('s1'), _sorted('s2'))} AS sw FROM e),
s AS (SELECT idx, Class, {Q.osa_sim('f')} AS damerau_levenshtein, {Q.jaro('s1', 's2')} AS jaro,
  {Q.jw_from_jaro('s1', 's2')} AS jaro_winkler, {Q.jw_from_jaro(_rev('s1'), _rev('s2'))} AS jaro_winkler_reversed,
  sw AS sorted_winkler, {', '.join(f'{fn("s1", "s2")} AS {m}' for m, fn in _NATIVE_SQL.items())},
  (({_me_aux('a', 'b')}) + ({_me_aux('b', 'a')})) / 2.0 AS monge_elkan, {_soft_sql('list_distinct(a)', 'list_distinct(b)')} AS soft_jaccard,
  (sw + {_soft_sql('ta', 'tb')}) / 2.0 AS davies, tuned AS tuned_jaro_winkler, tuned_r AS tuned_jaro_winkler_reversed FROM f),
scores AS (SELECT idx, Class, COLUMNS(* EXCLUDE (idx, Class))::DOUBLE FROM s)"""


#: The twin of the threshold query on the 14 measures of raw names.
BASIC_SQL = V.with_views(f"""
, src AS (SELECT idx, Class, Name1 AS s1, Name2 AS s2 FROM pairs),
{measures_sql('src')}, bare AS (SELECT * EXCLUDE (idx) FROM scores),
{threshold_sql('bare')}""", "pairs", recursive=True)


# ---------------------------------------------------------------- B7/B8 ----

from toposim.functions.address import HOUSE_NUMBER as _ADDR_RE  # noqa: E402


def _street_sql(a):
    return f"trim(regexp_replace({a}, '{_ADDR_RE}', '', 'g'))"


def _nums_sql(a):
    return (f"list_transform(list_filter(list_distinct(regexp_extract_all({a}, '\\b\\d+')), "
            f"lambda x: length(x) <> 4), lambda x: CAST(x AS DECIMAL(38, 0)))")


_ADDR_SQL = V.with_views(f"""
, t AS (SELECT idx, Address1, Address2,
          CASE WHEN len({_nums_sql('Address1')}) = 0 THEN [0::DECIMAL(38, 0)] ELSE {_nums_sql('Address1')} END AS n1,
          CASE WHEN len({_nums_sql('Address2')}) = 0 THEN [0::DECIMAL(38, 0)] ELSE {_nums_sql('Address2')} END AS n2
        FROM pairs)
SELECT idx, {_street_sql('Address1')} AS street_name1, {_street_sql('Address2')} AS street_name2,
       CAST(list_min(flatten(list_transform(n1, lambda x: list_transform(n2, lambda y: abs(x - y))))) AS DOUBLE) AS street_numbers_diff
FROM t""", "pairs")


@register("address_features", _ADDR_SQL)
def q_address(spark, sf_dir):
    p = V.pairs(spark, sf_dir).select("idx", "Address1", "Address2")
    return p.select("idx", street_name("Address1").alias("street_name1"),
                    street_name("Address2").alias("street_name2"),
                    numbers_diff(street_numbers("Address1"), street_numbers("Address2"))
                    .cast("double").alias("street_numbers_diff"))


# ---------------------------------------------------------------- B1/B2/B9 -

_canon_sql = Q.canon


_ALPHA_SQL = " ".join(
    [f"WHEN regexp_matches(text, '\\p{{{'Han' if s == 'CJK' else s.capitalize()}}}') THEN '{s}'" for s in T.SCRIPTS]
    + [f"WHEN regexp_matches(text, '{k}') THEN '{w}'" for w, k in T.NAMED.items()])


@register("normalize_text", f"""
SELECT doc_id, md5({_canon_sql('text')}) AS canon_md5, length({_canon_sql('text')}) AS canon_len,
       CASE {_ALPHA_SQL} ELSE 'UND' END AS alphabet,
       CAST(NOT regexp_matches(text, '[^\\p{{Latin}}\\P{{L}}]') AS INTEGER) AS only_latin
FROM documents""")
def q_normalize_text(spark, sf_dir):
    """B1/B2/B9/B10 over whole document texts."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    canon = T.canonical("text")
    return d.select("doc_id", F.md5(canon).alias("canon_md5"), F.length(canon).alias("canon_len"),
                    T.detect_alphabet("text").alias("alphabet"),
                    T.only_alphabet("text", "LATIN").cast("int").alias("only_latin"))


# ---------------------------------------------------------------- B4/B5 ----

def _nat_key_sql(t):
    segs = f"list_transform(regexp_extract_all({t}, '([0-9]+|[^0-9]+)', 1), lambda x: " \
           f"CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 10, '0') || ltrim(x, '0') ELSE x END)"
    return f"CASE WHEN regexp_matches({t}, '^[0-9]') THEN list_concat([''], {segs}) ELSE {segs} END"


def _natural_sql(col: str) -> str:
    return f"""array_to_string(list_transform(list_sort(list_transform(string_split({col}, ' '), lambda tok, i:
         {{'k': {_nat_key_sql('tok')}, 'p': i, 't': tok}})), lambda s: s.t), ' ')"""


@register("natural_sort", V.with_views(f"""
SELECT idx, {_natural_sql('Address1')} AS sorted_address, {_natural_sql('Address2')} AS sorted_address2,
       {_natural_sql('lower(Name1)')} AS sorted_name1 FROM pairs""", "pairs"))
def q_natural_sort(spark, sf_dir):
    """Address and name tokens in natural (digits-as-numbers) order."""
    p = V.pairs(spark, sf_dir).select("idx", "Address1", "Address2", F.lower("Name1").alias("n"))
    return p.select("idx", T.simple_sort("Address1").alias("sorted_address"), T.simple_sort("Address2").alias("sorted_address2"),
                    T.simple_sort("n").alias("sorted_name1"))


#: The twin of the threshold query on the 13 measures of sorted names.
SORTED_SQL = V.with_views(f"""
, canon AS (SELECT idx, Class, {Q.canon('Name1')} AS c1, {Q.canon('Name2')} AS c2 FROM pairs),
src AS (SELECT idx, Class, {_natural_sql('c1')} AS s1, {_natural_sql('c2')} AS s2 FROM canon),
{measures_sql('src')}, bare AS (SELECT * EXCLUDE (idx, sorted_winkler) FROM scores),
{threshold_sql('bare')}""", "pairs", recursive=True)


# ---------------------------------------------------------------- F1 -------

from toposim.functions.termsplit import special_terms  # noqa: E402

from toposim.plans.queries_terms import _NAMES_SRC, _terms_sql  # noqa: E402


def _special_sql(n: int) -> str:
    return f"""
t{n} AS (SELECT idx, lower(Name{n}) AS s FROM pairs),
sp{n} AS (SELECT idx, s, list_sort(list_filter(list_distinct(list_filter(regexp_split_to_array(trim(s), '\\s+'),
          lambda x: x <> '')), lambda x: list_contains(l, x))) AS spec FROM t{n}, often),
pat{n} AS (SELECT idx, s, spec,
          array_to_string(list_transform(list_sort(list_transform(spec, lambda x: {{'n': -length(x), 'x': x}})),
                          lambda e: e.x), '|') AS pattern FROM sp{n}),
o{n} AS (SELECT idx, array_to_string(spec, '|') AS special{n},
       CASE WHEN len(spec) > 0 THEN regexp_replace(s, pattern, ' ', 'g') ELSE s END AS remainder{n} FROM pat{n})"""


@register("special_terms", V.with_views(_terms_sql(_NAMES_SRC, "term") + f"""
, top AS (SELECT gram FROM res ORDER BY "count" DESC, stem, gram LIMIT 400),
often AS (SELECT list(term) AS l FROM (SELECT gram AS term FROM top UNION SELECT reverse(gram) FROM top)),
{_special_sql(1)}, {_special_sql(2)}
SELECT * FROM o1 JOIN o2 USING (idx)""", "pairs"))
def q_special_terms(spark, sf_dir):
    """frequent ('special') terms of both names, by the list mined from
    them, and the names with them cut out (unanchored, longest first)."""
    often = V.fixture_frequent_terms(spark, sf_dir)
    p = V.pairs(spark, sf_dir).select("idx", F.lower("Name1").alias("s1"), F.lower("Name2").alias("s2"))
    out = []
    for n in (1, 2):
        spec, cut = special_terms(F.col(f"s{n}"), often)
        out += [F.array_join(spec, "|").alias(f"special{n}"), cut.alias(f"remainder{n}")]
    return p.select("idx", *out)
