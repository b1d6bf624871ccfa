"""Spatial matching queries (G1-G4, B15, B16) on nation squares and
part points."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposim.operators.spatial import Step, attach, match_cascade, nearby_matches, within_matches
from toposim.plans import sqlgen as Q
from toposim.plans import views as V
from toposim.plans.catalog import register, rnd

_DIST = ("sqrt(pow(greatest(g.minx - p.x, 0.0, p.x - g.maxx), 2) + "
         "pow(greatest(g.miny - p.y, 0.0, p.y - g.maxy), 2))")
_INSIDE = "p.x > g.minx AND p.x < g.maxx AND p.y > g.miny AND p.y < g.maxy"


@register("within_match", V.with_views(f"""
SELECT p.poi_id, min(g.id) AS id, 0.0 AS distance FROM pois p JOIN polygons g ON {_INSIDE}
GROUP BY p.poi_id""", "pois", "polygons"))
def q_within(spark, sf_dir):
    """G1: polygon strictly containing each point."""
    return within_matches(V.pois(spark, sf_dir), V.polygons(spark, sf_dir)) \
        .select("poi_id", "id", "distance")


@register("nearby_match", V.with_views(f"""
, c AS (SELECT p.poi_id, g.id, round({_DIST}, 9) AS d FROM pois p, polygons g
        WHERE len(g.names) > 0 AND round({_DIST}, 9) < 5.0),
r AS (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY d, id) AS rn FROM c)
SELECT poi_id, id, round(d, 6) AS distance FROM r WHERE rn = 1""", "pois", "polygons"))
def q_nearby(spark, sf_dir):
    """G2 + B15: nearest named polygon closer than 5 units."""
    polys = V.polygons(spark, sf_dir).where(F.size("names") > 0)
    m = nearby_matches(V.pois(spark, sf_dir), polys, 5.0)
    return m.select("poi_id", "id", rnd(F.col("distance")).alias("distance"))


STEPS = [Step("within", named=True, area_max=1000.0, measure="jaccard", sim_min=0.05),
         Step("within"),
         Step("nearby", named=True, dist_max=5.0),
         Step("nearby", dist_max=3.0)]


def _sim_sql():
    return (f"(SELECT max({Q.jaccard('lower(p.name)', 'lower(nm)')}) "
            f"FROM (SELECT unnest(g.names) AS nm))")


@register("match_cascade", V.with_views(f"""
, s1 AS (SELECT poi_id, id, 1 AS step, 0.0 AS distance, sim FROM (
           SELECT p.poi_id, g.id, {_sim_sql()} AS sim,
                  row_number() OVER (PARTITION BY p.poi_id ORDER BY g.id) AS rn
           FROM pois p JOIN polygons g ON {_INSIDE} AND len(g.names) > 0 AND g.area < 1000.0)
         WHERE rn = 1 AND sim > 0.05),
s2 AS (SELECT poi_id, id, 2 AS step, 0.0 AS distance, CAST(NULL AS DOUBLE) AS sim FROM (
           SELECT p.poi_id, g.id, row_number() OVER (PARTITION BY p.poi_id ORDER BY g.id) AS rn
           FROM pois p JOIN polygons g ON {_INSIDE}
           WHERE p.poi_id NOT IN (SELECT poi_id FROM s1)) WHERE rn = 1),
s3 AS (SELECT poi_id, id, 3 AS step, d AS distance, CAST(NULL AS DOUBLE) AS sim FROM (
           SELECT p.poi_id, g.id, round({_DIST}, 9) AS d,
                  row_number() OVER (PARTITION BY p.poi_id ORDER BY round({_DIST}, 9), g.id) AS rn
           FROM pois p, polygons g
           WHERE len(g.names) > 0 AND round({_DIST}, 9) < 5.0
             AND p.poi_id NOT IN (SELECT poi_id FROM s1 UNION ALL SELECT poi_id FROM s2)) WHERE rn = 1),
s4 AS (SELECT poi_id, id, 4 AS step, d AS distance, CAST(NULL AS DOUBLE) AS sim FROM (
           SELECT p.poi_id, g.id, round({_DIST}, 9) AS d,
                  row_number() OVER (PARTITION BY p.poi_id ORDER BY round({_DIST}, 9), g.id) AS rn
           FROM pois p, polygons g
           WHERE round({_DIST}, 9) < 3.0
             AND p.poi_id NOT IN (SELECT poi_id FROM s1 UNION ALL SELECT poi_id FROM s2
                                  UNION ALL SELECT poi_id FROM s3)) WHERE rn = 1),
allm AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)
SELECT poi_id, id, step, round(distance, 6) AS distance, round(sim, 6) AS sim FROM allm""",
                                         "pois", "polygons"))
def q_cascade(spark, sf_dir):
    """Four-step cascade (named within + name check, any within,
    named nearby < 5, any nearby < 3)."""
    m = match_cascade(V.pois(spark, sf_dir), V.polygons(spark, sf_dir), STEPS)
    return m.select("poi_id", "id", F.col("step").cast("int").alias("step"),
                    rnd(F.col("distance")).alias("distance"), rnd(F.col("sim")).alias("sim"))


# ---- holes, several parts, concave, large and tiny polygons ---------------

_SEG = ("CASE WHEN (bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, "
        "((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) END")
#: every point against every shape: odd crossings of a ray, on an edge, distance to the nearest edge
_ALL_PAIRS = f"""
, pp AS (SELECT poi_id, name, names, area, id,
          sum(CASE WHEN (ay > y) <> (b_y > y) AND x < ax + (y - ay) * (bx - ax) / (b_y - ay) THEN 1 ELSE 0 END) % 2 = 1 AS odd,
          bool_or((bx - ax) * (y - ay) - (b_y - ay) * (x - ax) = 0 AND x BETWEEN least(ax, bx) AND greatest(ax, bx)
                  AND y BETWEEN least(ay, b_y) AND greatest(ay, b_y)) AS border,
          min(sqrt(pow(x - (ax + {_SEG} * (bx - ax)), 2) + pow(y - (ay + {_SEG} * (b_y - ay)), 2))) AS d
        FROM pois, shapes GROUP BY ALL),
c AS (SELECT poi_id, name, names, area, id, odd AND NOT border AS inside, CASE WHEN odd OR border THEN 0.0 ELSE d END AS d FROM pp)"""


@register("within_shapes", V.with_views(_ALL_PAIRS + """
SELECT poi_id, min(id) AS id, 0.0 AS distance FROM c WHERE inside GROUP BY poi_id""", "pois", "shapes"))
def q_within_shapes(spark, sf_dir):
    """G1 on polygons with holes, several parts, concave, large and tiny ones."""
    return within_matches(V.pois(spark, sf_dir), V.shapes(spark, sf_dir)).select("poi_id", "id", "distance")


@register("nearest_shapes", V.with_views(_ALL_PAIRS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY round(d, 9), id) AS rn FROM c)
SELECT poi_id, id, round(d, 6) AS distance FROM r WHERE rn = 1""", "pois", "shapes"))
def q_nearest_shapes(spark, sf_dir):
    """G2 without a bound: the nearest polygon of every point, however far."""
    m = nearby_matches(V.pois(spark, sf_dir), V.shapes(spark, sf_dir))
    return m.select("poi_id", "id", rnd(F.col("distance")).alias("distance"))


SHAPE_STEPS = [Step("within", named=True, area_max=300.0, measure="jaccard", sim_min=0.05),
               Step("within", area_max=1000.0),
               Step("nearby", named=True, area_max=400.0, dist_max=6.0),
               Step("nearby", area_max=200.0, measure="strike_a_match", sim_min=0.1),
               Step("nearby", named=True)]


def _shape_sim(m):
    return f"(SELECT max({m('lower(name)', 'lower(nm)')}) FROM (SELECT unnest(names) AS nm))"


@register("cascade_shapes", V.with_views(_ALL_PAIRS + f"""
, f AS (SELECT *, CASE WHEN area < 300 THEN {_shape_sim(Q.jaccard)} END AS s1, CASE WHEN area < 200 THEN {_shape_sim(Q.dice)} END AS s4 FROM c),
k AS (SELECT poi_id, any_value(name) AS name,
        arg_min({{'id': id, 'd': d, 's': s1, 'a': area}}, {{'d': 0.0, 'i': id}}) FILTER (inside AND len(names) > 0 AND area < 300) AS k1,
        arg_min({{'id': id, 'd': d, 's': NULL::DOUBLE, 'a': area}}, {{'d': 0.0, 'i': id}}) FILTER (inside AND area < 1000) AS k2,
        arg_min({{'id': id, 'd': d, 's': NULL::DOUBLE, 'a': area}}, {{'d': round(d, 9), 'i': id}}) FILTER (len(names) > 0 AND area < 400 AND round(d, 9) < 6) AS k3,
        arg_min({{'id': id, 'd': d, 's': s4, 'a': area}}, {{'d': round(d, 9), 'i': id}}) FILTER (area < 200) AS k4,
        arg_min({{'id': id, 'd': d, 's': NULL::DOUBLE, 'a': area}}, {{'d': round(d, 9), 'i': id}}) FILTER (len(names) > 0) AS k5
      FROM f GROUP BY poi_id),
m AS (SELECT poi_id, name, CASE WHEN k1.s > 0.05 THEN 1 WHEN k2 IS NOT NULL THEN 2 WHEN k3 IS NOT NULL THEN 3 WHEN k4.s > 0.1 THEN 4 ELSE 5 END AS step, k1, k2, k3, k4, k5 FROM k),
o AS (SELECT *, CASE step WHEN 1 THEN k1 WHEN 2 THEN k2 WHEN 3 THEN k3 WHEN 4 THEN k4 ELSE k5 END AS b FROM m)
SELECT poi_id, b.id AS id, step, round(b.d, 6) AS distance, round(b.s, 6) AS sim, name AS name_x, b.a AS area_y FROM o WHERE b IS NOT NULL""", "pois", "shapes"))
def q_cascade_shapes(spark, sf_dir):
    """G3 in one pass, with area filters that exclude, names that must be
    like, and nearby steps without a bound; G4 attaches both sides."""
    points, polys = V.pois(spark, sf_dir), V.shapes(spark, sf_dir)
    m = match_cascade(points, polys, SHAPE_STEPS)
    m = attach(m, points.select("poi_id", "name"), polys.select("id", "area"))
    return m.select("poi_id", "id", F.col("step").cast("int").alias("step"), rnd(F.col("distance")).alias("distance"),
                    rnd(F.col("sim")).alias("sim"), "name_x", "area_y")
