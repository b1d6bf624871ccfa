"""Term-split meta-similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposim.functions import params as P
from toposim.functions import text as T
from toposim.functions.registry import MEASURES, base_name, in_group
from toposim.functions.termsplit import align_pairs, lgm_scores
from toposim.plans import sqlgen as Q
from toposim.plans import views as V
from toposim.plans.catalog import register, rnd
from toposim.plans.queries_core import BASIC_SQL, SORTED_SQL, _natural_sql, _nums_sql, _street_sql, measures_sql
from toposim.plans.features import LIST_SCORE_COLS
from toposim.plans.queries_eval import _dist_sql
from toposim.plans.queries_terms import _NAMES_SRC, _terms_sql
from toposim.plans.views import fixture_frequent_terms

_LISTS = ("base", "mis", "spec")

#: Aligned names: ``al`` (idx, x1, x2).
_ALIGNED_SQL = f"""canon AS (SELECT idx, {Q.canon('Name1')} AS c1, {Q.canon('Name2')} AS c2 FROM pairs),
bare0 AS (SELECT idx, replace(c1, ' ', '') AS p1, replace(c2, ' ', '') AS p2 FROM canon),
{Q.osa_ctes('bare0', 'idx', 'p1', 'p2', 'dns')}, {Q.osa_ctes('canon', 'idx', 'c1', 'c2', 'dsp')},
al0 AS (SELECT idx, c1, c2, {Q.osa_sim('dns')} AS ns, {Q.osa_sim('dsp')} AS sp FROM canon JOIN dns USING (idx) JOIN dsp USING (idx)),
al AS (SELECT idx, CASE WHEN ns < {T.SORT_THRESHOLD} THEN {_natural_sql('c1')} WHEN ns > sp THEN replace(c1, ' ', '') ELSE c1 END AS x1,
              CASE WHEN ns < {T.SORT_THRESHOLD} THEN {_natural_sql('c2')} WHEN ns > sp THEN replace(c2, ' ', '') ELSE c2 END AS x2 FROM al0)"""


def _lgm_sql() -> str:
    """The twin of the meta-similarities: every list in rows, distinct pairs of lists scored once."""
    ms, listed = in_group("lgm"), "damerau_levenshtein"
    keys: dict = {}
    weights = []
    for m in ms:
        thr, w = P.lookup("latin", m, "avg", False)
        k = keys.setdefault((thr, m.endswith("_reversed")), len(keys))
        weights.append(f"('{m}', '{base_name(m)}', {k}, {', '.join(f'{x}::DOUBLE' for x in w)})")
    thr, _ = P.lookup("latin", listed, "avg", False)
    list_key = keys[thr, False]
    start = "{'i': 0::BIGINT, 'j': 0::BIGINT, 'ba': []::VARCHAR[], 'bb': []::VARCHAR[], 'ma': []::VARCHAR[], 'mb': []::VARCHAR[]}"

    def state(i, j, **changed):
        return f"{{'i': z.i + {i}, 'j': z.j + {j}, " + ", ".join(f"'{x}': {changed.get(x, 'z.' + x)}" for x in ("ba", "bb", "ma", "mb")) + "}"

    both = state(1, 1, ba="list_append(z.ba, A[z.i + 1])", bb="list_append(z.bb, B[z.j + 1])")
    left, right = state(1, 0, ma="list_append(z.ma, A[z.i + 1])"), state(0, 1, mb="list_append(z.mb, B[z.j + 1])")
    turned = "CASE WHEN rev THEN reverse({0}) ELSE {0} END"

    def terms(n, side):
        return f"""
sp{n} AS (SELECT idx, rev, {side} AS s, list_sort(list_filter(list_distinct(list_filter(regexp_split_to_array(trim({side}), '\\s+'),
          lambda p: p <> '')), lambda p: list_contains(l, p))) AS spec FROM dirs, often),
cut{n} AS (SELECT idx, rev, spec, list_filter(regexp_split_to_array(trim(CASE WHEN len(spec) > 0 THEN regexp_replace(s, array_to_string(list_transform(
          list_sort(list_transform(spec, lambda p: {{'n': -length(p), 'x': p}})), lambda q: q.x), '|'), ' ', 'g') ELSE s END), '\\s+'), lambda p: p <> '') AS toks FROM sp{n})"""

    lists = " UNION ALL ".join(
        f"SELECT idx, key, {i} AS lst, array_to_string({x}a, ' ') AS s1, array_to_string({x}b, ' ') AS s2, len({x}a) + len({x}b) AS n, "
        f"length(array_to_string({x}a, '')) + length(array_to_string({x}b, '')) AS c FROM split" for i, x in enumerate(_LISTS))
    step = []
    for e in range(3):  # the weight of an empty list goes to the other two
        x, y = (k for k in range(3) if k != e)
        share = f"(n{x}::DOUBLE / nullif(n{x} + n{y}, 0))"
        step.append(f"r{e + 1} AS (SELECT * REPLACE (CASE WHEN n{e} = 0 THEN w{x} + w{e} * {share} ELSE w{x} END AS w{x}, "
                    f"CASE WHEN n{e} = 0 THEN w{y} + w{e} * (1 - {share}) ELSE w{y} END AS w{y}, CASE WHEN n{e} = 0 THEN 0.0 ELSE w{e} END AS w{e}) FROM r{e})")
    at = lambda v: ", ".join(f"max({v}) FILTER (lst = {i}) AS {v[0]}{i}" for i in range(3))
    shown = ", ".join(f"round(max(score) FILTER (measure = '{m}'), 6) AS lgm_{m}" for m in ms)
    raw = ", ".join(f"round(max(CASE WHEN n > 0 THEN damerau_levenshtein ELSE 0 END) FILTER (lst = {i}), 6) AS LGM_{x}Score"
                    for i, x in enumerate(("base", "mismatch", "special")))
    return V.with_views(_terms_sql(_NAMES_SRC, "term") + f"""
, top AS (SELECT gram FROM res ORDER BY "count" DESC, stem, gram LIMIT 400),
often AS (SELECT list(term) AS l FROM (SELECT gram AS term FROM top UNION SELECT reverse(gram) FROM top)),
{_ALIGNED_SQL},
dirs AS MATERIALIZED (SELECT idx, rev, {turned.format('x1')} AS y1, {turned.format('x2')} AS y2 FROM al, (VALUES (false), (true)) v(rev)),
{terms(1, 'y1').strip()}, {terms(2, 'y2').strip()},
toks AS (SELECT idx, rev, cut1.toks AS A, cut2.toks AS B, cut1.spec AS speca, cut2.spec AS specb,
                list_transform(cut1.toks, lambda p: reverse(p)) AS ta, list_transform(cut2.toks, lambda p: reverse(p)) AS tb
         FROM cut1 JOIN cut2 USING (idx, rev)),
cells AS MATERIALIZED (SELECT idx, rev, c, ta[c // len(tb) + 1] AS p, tb[c % len(tb) + 1] AS q FROM (SELECT *, unnest(range(0, len(ta) * len(tb))) AS c FROM toks)),
tp AS MATERIALIZED (SELECT row_number() OVER () AS idx, p, q FROM (SELECT DISTINCT p, q FROM cells)),
{Q.tuned_ctes('tp', 'idx', 'p', 'q', 'tj')},
tw AS MATERIALIZED (SELECT p, q, CASE WHEN m = 0 THEN 0.0 ELSE (m / la + m / lb + (m - t // 2) / m) / 3.0 END AS jaro FROM tp JOIN tj_t ON tp.idx = tj_t.k),
mat AS MATERIALIZED (SELECT toks.*, M FROM toks LEFT JOIN (
  SELECT idx, rev, list({Q.jw_from_jaro('p', 'q', 'jaro')} ORDER BY c) AS M FROM cells JOIN tw USING (p, q) GROUP BY idx, rev) USING (idx, rev)),
folded AS (SELECT idx, key, A, B, speca, specb, list_reduce(list_transform(range(0, len(A) + len(B) + 2), lambda p: {start}), lambda z, u:
    CASE WHEN z.i >= len(A) OR z.j >= len(B) THEN z WHEN M[z.i * len(B) + z.j + 1] >= thr THEN {both} WHEN A[z.i + 1] < B[z.j + 1] THEN {left} ELSE {right} END) AS f
  FROM mat JOIN (VALUES {', '.join(f'({k}, {t}::DOUBLE, {str(r).lower()})' for (t, r), k in keys.items())}) kk(key, thr, rev) USING (rev)),
split AS MATERIALIZED (SELECT idx, key, f.ba AS basea, f.bb AS baseb, list_concat(f.ma, A[f.i + 1:]) AS misa, list_concat(f.mb, B[f.j + 1:]) AS misb, speca, specb FROM folded),
lists AS MATERIALIZED ({lists}),
texts AS MATERIALIZED (SELECT row_number() OVER () AS idx, 0 AS Class, s1, s2 FROM (SELECT DISTINCT s1, s2 FROM lists)),
{measures_sql('texts').replace('scores AS (', 'scores AS MATERIALIZED (')},
got AS MATERIALIZED (SELECT l.idx, key, lst, n, c, scores.* EXCLUDE (idx, Class) FROM lists l JOIN texts USING (s1, s2) JOIN scores ON scores.idx = texts.idx),
long AS (UNPIVOT got ON COLUMNS(* EXCLUDE (idx, key, lst, n, c)) INTO NAME base VALUE v),
r0 AS (SELECT idx, measure, any_value(a0) AS w0, any_value(a1) AS w1, any_value(a2) AS w2, {at('n')}, {at('c')},
              {', '.join(f'max(CASE WHEN n > 0 THEN v ELSE 0 END) FILTER (lst = {i}) AS v{i}' for i in range(3))}
       FROM long JOIN (VALUES {', '.join(weights)}) ww(measure, base, key, a0, a1, a2) USING (base, key) GROUP BY idx, measure),
{', '.join(step)},
w AS (SELECT *, w0 * c0 / 2 AS z0, w1 * c1 / 2 AS z1, w2 * c2 / 2 AS z2 FROM r3),
total AS (SELECT idx, measure, coalesce((v0 * z0 + v1 * z1 + v2 * z2) / nullif(z0 + z1 + z2, 0), 0.0) AS score FROM w),
raw AS (SELECT idx, {raw} FROM got WHERE key = {list_key} GROUP BY idx),
wide AS (SELECT idx, {shown} FROM total GROUP BY idx)
SELECT * FROM wide JOIN raw USING (idx)""", "pairs", recursive=True)


@register("lgm_sim", _lgm_sql())
def q_lgm_sim(spark, sf_dir):
    """F7 + F8 for the 13 measures of the lgm group on aligned names."""
    freq = fixture_frequent_terms(spark, sf_dir)
    p = align_pairs(V.pairs(spark, sf_dir).select("idx", "Name1", "Name2"), "Name1", "Name2")
    ms = in_group("lgm")
    out = lgm_scores(p, "a", "b", ms, freq, list_scores_for="damerau_levenshtein")
    cols = [f"lgm_{m}" for m in ms] + ["LGM_baseScore", "LGM_mismatchScore", "LGM_specialScore"]
    return out.select("idx", *[rnd(F.col(x)).alias(x) for x in cols])


from toposim.operators.grid import best_params, grid_accuracy, list_features  # noqa: E402
from toposim.operators.scoring import score_pairs  # noqa: E402
from toposim.operators.thresholds import accuracy_by_threshold, best_threshold  # noqa: E402


@register("grid_params")
def q_grid_params(spark, sf_dir):
    """Best (split threshold, weights, threshold) per lgm measure."""
    freq = fixture_frequent_terms(spark, sf_dir)
    p = align_pairs(V.pairs(spark, sf_dir).select("idx", "Name1", "Name2", "Class"), "Name1", "Name2")
    f9 = list_features(p, "a", "b", "Class", in_group("lgm"), freq)
    best = best_params(grid_accuracy(f9))
    return best.select("measure", rnd(F.col("accuracy"), 9).alias("accuracy"), "threshold", "split",
                       "w_base", "w_mis", "w_special")


@register("best_threshold_basic", BASIC_SQL)
def q_best_basic(spark, sf_dir):
    """J2 (basic): best threshold for each of the 14 basic measures on the
    raw names."""
    ms = in_group("basic")
    s = score_pairs(V.pairs(spark, sf_dir).select("Name1", "Name2", "Class"), "Name1", "Name2", ms)
    b = best_threshold(accuracy_by_threshold(s, "Class", ms))
    return b.select("measure", "threshold", rnd(F.col("accuracy"), 9).alias("accuracy"))


@register("best_threshold_sorted", SORTED_SQL)
def q_best_sorted(spark, sf_dir):
    """J2 (sorted): canonical, natural-sorted names, 13 measures."""
    ms = in_group("sorted")
    p = align_pairs(V.pairs(spark, sf_dir).select("Name1", "Name2", "Class"), "Name1", "Name2", mode="always")
    s = score_pairs(p, "a", "b", ms)
    b = best_threshold(accuracy_by_threshold(s, "Class", ms))
    return b.select("measure", "threshold", rnd(F.col("accuracy"), 9).alias("accuracy"))


def _features_sql() -> str:
    """The twin of the feature table: distinct pairs of street names, names
    and aligned names scored once, beside the meta-similarity's twin."""
    shown = []
    for job, group in enumerate(("basic", "basic", "sorted")):
        for m in in_group(group):
            name = MEASURES[m][2]
            shown.append(f"round(j{job}.{m}, 6) AS {[name + '_on_street_names', name, 'Sorted_' + name][job]}")
    shown += [f"lg.lgm_{m} AS LGM_{MEASURES[m][2]}" for m in in_group("lgm")] + [f"lg.{c}" for c in LIST_SCORE_COLS]
    scaled = ", ".join(f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 6) AS {c}"
                       for c in ("street_numbers_diff", "point_dist"))
    nums = lambda n: f"CASE WHEN len({_nums_sql(f'Address{n}')}) = 0 THEN [0::DECIMAL(38, 0)] ELSE {_nums_sql(f'Address{n}')} END AS n{n}"
    return V.with_views(f"""
, {_ALIGNED_SQL},
jobs AS MATERIALIZED (SELECT idx, 0 AS job, {_street_sql('Address1')} AS s1, {_street_sql('Address2')} AS s2 FROM pairs
  UNION ALL SELECT idx, 1, Name1, Name2 FROM pairs UNION ALL SELECT idx, 2, x1, x2 FROM al),
texts AS MATERIALIZED (SELECT row_number() OVER () AS idx, 0 AS Class, s1, s2 FROM (SELECT DISTINCT s1, s2 FROM jobs)),
{measures_sql('texts').replace('scores AS (', 'scores AS MATERIALIZED (')},
got AS MATERIALIZED (SELECT jobs.idx, job, scores.* EXCLUDE (idx, Class) FROM jobs JOIN texts USING (s1, s2) JOIN scores ON scores.idx = texts.idx),
lg AS MATERIALIZED ({_lgm_sql()}),
num AS (SELECT idx, {_dist_sql()} AS point_dist, {nums(1)}, {nums(2)} FROM pairs),
gap AS (SELECT idx, point_dist, CAST(list_min(flatten(list_transform(n1, lambda x: list_transform(n2, lambda y: abs(x - y))))) AS DOUBLE) AS street_numbers_diff FROM num),
scaled AS (SELECT idx, {scaled} FROM gap)
SELECT p.idx AS "index", street_numbers_diff, {', '.join(shown)}, point_dist, p.Class AS class
FROM pairs p JOIN scaled USING (idx) JOIN lg USING (idx) JOIN got j0 ON j0.idx = p.idx AND j0.job = 0
JOIN got j1 ON j1.idx = p.idx AND j1.job = 1 JOIN got j2 ON j2.idx = p.idx AND j2.job = 2""", "pairs", recursive=True)


#: The twin of the feature query.
FEATURES_SQL = _features_sql()
