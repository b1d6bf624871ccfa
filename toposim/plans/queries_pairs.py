"""Candidate-pair generation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposim.operators.gramjoin import exact_copies, similarity_join
from toposim.plans import views as V
from toposim.plans.catalog import register, rnd

GRAM_JOIN_T = 0.8


_SETS_SQL = """
WITH ch AS (SELECT doc_id, regexp_extract_all(' ' || coalesce(text, '') || ' ', '(?s).') AS c FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(list_concat(
        list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]),
        list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])))) AS g FROM ch),
r AS (SELECT min(doc_id) AS id, g, len(g) AS n FROM g GROUP BY g)"""

_JOIN_SQL = f"""{_SETS_SQL},
x AS (SELECT a.id AS id1, b.id AS id2, a.n + b.n AS s, len(list_intersect(a.g, b.g)) AS k
      FROM r a JOIN r b ON a.id < b.id AND 10 * b.n >= 8 * a.n AND 10 * a.n >= 8 * b.n)
SELECT id1, id2, round(CAST(k AS DOUBLE) / (s - k), 6) AS jaccard FROM x WHERE round(CAST(k AS DOUBLE) / (s - k), 9) >= 0.8"""

_COPIES_SQL = f"{_SETS_SQL} SELECT doc_id AS id, r.id AS rep FROM g JOIN r USING (g) WHERE doc_id <> r.id"


@register("gram_join", _JOIN_SQL)
def q_gram_join(spark, sf_dir):
    """Document pairs whose padded-gram Jaccard is >= 0.8 (whole
    texts; representatives of identical gram sets)."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs, _ = similarity_join(d, "doc_id", "text", GRAM_JOIN_T)
    return pairs.select("id1", "id2", rnd(F.col("jaccard")).alias("jaccard"))


@register("gram_copies", _COPIES_SQL)
def q_gram_copies(spark, sf_dir):
    """Rows whose gram set equals an earlier row's, with that row."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    copies = exact_copies(d, "doc_id", "text")
    return copies.where(F.col("id") != F.col("rep"))


from toposim.functions import text as _T  # noqa: E402
from toposim.operators.pairgen import build_dataset, places, positive_pairs  # noqa: E402
from toposim.plans import sqlgen as Q  # noqa: E402

_NAMES_SQL = """list_sort(list_distinct(list_filter(list_concat(
    list_transform(string_split(coalesce(alternate_names, ''), ','), lambda x: trim(x)),
    [trim(coalesce(name, '')), trim(coalesce(asciiname, ''))]), lambda x: length(x) > 2)))"""

_POS_SQL = f"""
, pl AS (SELECT geonameid AS id, coalesce(country_code, 'unknown') AS country, {_NAMES_SQL} AS names FROM gazetteer),
pl2 AS (SELECT * FROM pl WHERE len(names) >= 3),
cmb AS (SELECT id, country, unnest(flatten(list_transform(range(1, len(names) + 1), lambda i:
          list_transform(range(i + 1, len(names) + 1), lambda j: {{'n1': names[i], 'n2': names[j]}})))) AS p
        FROM pl2),
pos AS (SELECT p.n1 AS n1, p.n2 AS n2, id, country FROM cmb
        WHERE {Q.jaccard('lower(p.n1)', 'lower(p.n2)')} <> 1.0)"""


@register("pos_pairs", V.with_views(_POS_SQL + "\nSELECT n1, n2, id, country FROM pos", "gazetteer"))
def q_pos_pairs(spark, sf_dir):
    """G7 (+ B12): name pairs of the same place."""
    return positive_pairs(places(V.gazetteer(spark, sf_dir)))


def _alpha(col):
    whens = " ".join(f"WHEN regexp_matches({col}, '\\p{{{'Han' if s == 'CJK' else s.capitalize()}}}') THEN '{s}'"
                     for s in _T.SCRIPTS)
    return f"CASE {whens} ELSE 'UND' END"


_BUILD_SQL = V.with_views(_POS_SQL + f""",
pool AS (SELECT id, country, unnest(names) AS name FROM pl2),
ranked AS (SELECT id, country, name,
             row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '|2020') || '|' || CAST(id AS VARCHAR)
                                         || '|' || name) AS rank,
             count(*) OVER () AS P FROM pool),
span AS (SELECT id, min(rank) AS start, count(*) AS m, max(P) AS P FROM ranked GROUP BY id),
pu AS (SELECT pos.n1, pos.id, pos.country, span.start, span.m,
         CAST('0x' || substr(md5(pos.n1 || '|' || pos.n2 || '|' || CAST(pos.id AS VARCHAR) || '|2020'), 1, 12)
              AS BIGINT) % (span.P - span.m) AS u
       FROM pos JOIN span USING (id) WHERE span.P > span.m),
neg AS (SELECT pu.n1, r.name AS n2, pu.id AS id1, r.id AS id2, pu.country AS cc1, r.country AS cc2
        FROM pu JOIN ranked r ON r.rank = CASE WHEN pu.u + 1 < pu.start THEN pu.u + 1 ELSE pu.u + 1 + pu.m END),
both_ AS (SELECT DISTINCT * FROM (
          SELECT n1 AS s1, n2 AS s2, 1 AS status, CAST(id AS VARCHAR) AS id1, CAST(id AS VARCHAR) AS id2,
                 country AS cc1, country AS cc2 FROM pos
          UNION ALL
          SELECT n1, n2, 0, CAST(id1 AS VARCHAR), CAST(id2 AS VARCHAR), cc1, cc2 FROM neg)),
keyed AS (SELECT *, md5(s1 || chr(9) || s2 || chr(9) || CAST(status AS VARCHAR) || chr(9) || id1 || chr(9) || id2)
            AS k FROM both_),
rk AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY md5(k || '|2020')) AS pos FROM keyed),
mm AS (SELECT min(n) AS m, count(*) AS nc FROM (SELECT count(*) AS n FROM keyed GROUP BY status))
SELECT s1, s2, CAST(status AS INTEGER) AS status, id1, id2, {_alpha('s1')} AS alphabet1, {_alpha('s2')} AS alphabet2,
       cc1, cc2, pos
FROM rk, mm WHERE mm.nc = 2 AND pos <= mm.m""", "gazetteer")


@register("build_dataset", _BUILD_SQL)
def q_build_dataset(spark, sf_dir):
    """Positives + one exact hash-drawn negative each, de-duplicated,
    balanced and interleaved, in the 9-column layout (+ pos)."""
    out = build_dataset(V.gazetteer(spark, sf_dir))
    return out.select("s1", "s2", F.col("status").cast("int").alias("status"), "id1", "id2", "alphabet1",
                      "alphabet2", "cc1", "cc2", "pos")


from toposim.operators.pairgen import region_filter  # noqa: E402
from toposim.functions.text import only_alphabet  # noqa: E402


def _country_regions(spark, sf_dir):
    """(country, continent) from nation/region: country 'C<k>' lies in the
    region of nation k."""
    n = V.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = V.table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country"),
        F.col("r_name").alias("continent"))


@register("region_filter", V.with_views("""
, dim AS (SELECT 'C' || CAST(n.n_nationkey AS VARCHAR) AS country, r.r_name AS continent
          FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT g.geonameid, g.country_code FROM gazetteer g
WHERE g.country_code IN (SELECT country FROM dim WHERE continent IN ('AFRICA', 'EUROPE') AND country <> 'C5')
  AND NOT regexp_matches(g.alternate_names, '[^\\p{Latin}\\P{L}]')""", "gazetteer"))
def q_region_filter(spark, sf_dir):
    """B11 + B10: latin-only gazetteer rows of two continents, minus one country."""
    g = V.gazetteer(spark, sf_dir)
    kept = region_filter(g, "country_code", _country_regions(spark, sf_dir), ["AFRICA", "EUROPE"], ["C5"])
    return kept.where(only_alphabet(F.col("alternate_names"), "LATIN")).select("geonameid", "country_code")


from toposim.operators.pairgen import hard_pairs, similar_pairs  # noqa: E402

_NAMES3_SQL = """list_sort(list_distinct(list_concat(
    list_filter(list_transform(string_split(coalesce(alternate_names, ''), ','), lambda x: trim(x)), lambda x: length(x) > 3),
    list_filter([trim(coalesce(name, '')), trim(coalesce(asciiname, ''))], lambda x: length(x) > 2))))"""


@register("hard_pairs", V.with_views(f"""
, pl AS (SELECT geonameid AS id, coalesce(country_code, 'unknown') AS country, {_NAMES3_SQL} AS names
         FROM gazetteer),
pl2 AS (SELECT *, row_number() OVER (ORDER BY id) AS rk FROM pl WHERE len(names) >= 3),
nb AS (SELECT c.id, c.country, p.id AS pid, p.country AS pcountry,
              unnest(flatten(list_transform(p.names, lambda x: list_transform(c.names, lambda y:
                {{'x': x, 'y': y}})))) AS cc
       FROM pl2 c JOIN pl2 p ON p.rk + 1 = c.rk),
cand AS (SELECT id, country, pid, pcountry, cc.x AS x, cc.y AS y FROM nb
         WHERE {Q.jaccard('cc.x', 'cc.y')} > 0 AND lower(cc.x) <> lower(cc.y)),
neg AS (SELECT x AS s1, y AS s2, 0 AS status, CAST(pid AS VARCHAR) AS id1, CAST(id AS VARCHAR) AS id2,
               pcountry AS cc1, country AS cc2 FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(x || '|' || y || '|2020')) AS rn FROM cand)
        WHERE rn <= 2),
cmb AS (SELECT id, country, unnest(flatten(list_transform(range(1, len(names) + 1), lambda i:
          list_transform(range(i + 1, len(names) + 1), lambda j: {{'n1': names[i], 'n2': names[j]}})))) AS p
        FROM pl2),
pp AS (SELECT p.n1 AS n1, p.n2 AS n2, id, country FROM cmb WHERE {Q.jaccard('lower(p.n1)', 'lower(p.n2)')} <> 1.0),
pos AS (SELECT n1 AS s1, n2 AS s2, 1 AS status, CAST(id AS VARCHAR) AS id1, CAST(id AS VARCHAR) AS id2,
               country AS cc1, country AS cc2 FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(n1 || '|' || n2 || '|2020')) AS rn FROM pp)
        WHERE rn <= 2),
allp AS (SELECT * FROM pos UNION ALL SELECT * FROM neg)
SELECT s1, s2, CAST(status AS INTEGER) AS status, id1, id2, {_alpha('s1')} AS alphabet1,
       {_alpha('s2')} AS alphabet2, cc1, cc2 FROM allp""", "gazetteer"))
def q_hard_pairs(spark, sf_dir):
    """2 positives and 2 hard negatives (previous place, shared grams)
    per place."""
    out = hard_pairs(V.gazetteer(spark, sf_dir))
    return out.select("s1", "s2", F.col("status").cast("int").alias("status"), "id1", "id2", "alphabet1",
                      "alphabet2", "cc1", "cc2")


@register("similar_pairs")
def q_similar_pairs(spark, sf_dir):
    """Per place the 2 most similar name pairs with other places.  (All
    names against all names is too slow in SQL; tests compare by brute force.)"""
    out = similar_pairs(V.gazetteer(spark, sf_dir))
    return out.select("s1", "s2", "id1", "id2", rnd(F.col("jaccard")).alias("jaccard"))
