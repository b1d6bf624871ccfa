"""OSM queries (A5 shape, B17-B19) over element rows derived from
``part`` (the test data has no OSM file)."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposim.operators.osm import poi_filter, pois, streets
from toposim.plans import views as V
from toposim.plans.catalog import register, rnd


def elements(spark, sf_dir):
    """Element rows: type by key, node position / centre, 1-3 point way
    geometry, tags (name, name:en, amenity, access, highway); every 11th
    size has no tags."""
    p = V.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    k, sz = F.col("p_partkey"), F.col("p_size")
    typ = F.when(k % 3 == 0, "node").when(k % 3 == 1, "way").otherwise("relation")
    lon = (k * 7919 % 3600).cast("double") / 10 - 180
    lat = (k * 104729 % 1600).cast("double") / 10 - 80
    pt = F.struct(lat.alias("lat"), lon.alias("lon"))
    geom = F.transform(F.sequence(F.lit(0), sz % 3),
                       lambda i: F.struct((lat + i.cast("double") / 100.0).alias("lat"),
                                          (lon + i.cast("double") / 100.0).alias("lon")))
    amen = F.element_at(F.array(F.lit("bench"), F.lit("cafe"), F.lit("pub"), F.lit(""), F.lit(None)),
                        (sz % 5 + 1).cast("int"))
    entries = F.array(F.struct(F.lit("name").alias("k"), F.col("p_name").alias("v")),
                      F.struct(F.lit("name:en").alias("k"), F.when(sz % 2 == 0, F.upper("p_name")).alias("v")),
                      F.struct(F.lit("amenity").alias("k"), amen.alias("v")),
                      F.struct(F.lit("access").alias("k"),
                               F.when(sz % 7 == 0, F.lit("private")).otherwise(F.lit("yes")).alias("v")),
                      F.struct(F.lit("highway").alias("k"),
                               F.when(k % 3 == 1, F.lower("p_type")).alias("v")))
    tags = F.when(sz % 11 == 0, F.lit(None)).otherwise(
        F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())))
    return p.select(typ.alias("type"), k.alias("id"), F.when(k % 3 == 0, lat).alias("lat"),
                    F.when(k % 3 == 0, lon).alias("lon"), F.when(k % 3 != 0, pt).alias("center"),
                    F.when(k % 3 == 1, geom).alias("geometry"), tags.alias("tags"))


ELEMENTS_SQL = """
WITH base AS (
  SELECT p_partkey AS k, p_name, p_type, p_size AS sz,
         CAST((p_partkey * 7919) % 3600 AS DOUBLE) / 10 - 180 AS lon,
         CAST((p_partkey * 104729) % 1600 AS DOUBLE) / 10 - 80 AS lat FROM part)
SELECT CASE k % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS type, k AS id,
       CASE WHEN k % 3 = 0 THEN lat END AS lat, CASE WHEN k % 3 = 0 THEN lon END AS lon,
       CASE WHEN k % 3 <> 0 THEN {'lat': lat, 'lon': lon} END AS center,
       CASE WHEN k % 3 = 1 THEN list_transform(range(0, sz % 3 + 1),
            lambda i: {'lat': lat + CAST(i AS DOUBLE) / 100.0, 'lon': lon + CAST(i AS DOUBLE) / 100.0}) END
         AS geometry,
       CASE WHEN sz % 11 = 0 THEN NULL ELSE map_from_entries(list_filter([
            {'k': 'name', 'v': p_name},
            {'k': 'name:en', 'v': CASE WHEN sz % 2 = 0 THEN upper(p_name) END},
            {'k': 'amenity', 'v': (['bench', 'cafe', 'pub', '', NULL])[sz % 5 + 1]},
            {'k': 'access', 'v': CASE WHEN sz % 7 = 0 THEN 'private' ELSE 'yes' END},
            {'k': 'highway', 'v': CASE WHEN k % 3 = 1 THEN lower(p_type) END}], lambda e: e.v IS NOT NULL))
       END AS tags
FROM base"""


@register("osm_pois", f"""
WITH el AS ({ELEMENTS_SQL})
SELECT id, round(CASE WHEN type = 'node' THEN lon ELSE center.lon END, 6) AS lon,
       round(CASE WHEN type = 'node' THEN lat ELSE center.lat END, 6) AS lat,
       array_to_string(list_sort(list_distinct(list_transform(
         list_filter(map_entries(tags), lambda e: regexp_matches(e.key, 'name')), lambda e: e.value))), '|') AS name,
       CAST(cardinality(tags) AS INTEGER) AS n_tags
FROM el WHERE tags IS NOT NULL""")
def q_osm_pois(spark, sf_dir):
    """B18."""
    p = pois(elements(spark, sf_dir))
    return p.select("id", rnd(F.col("lon")).alias("lon"), rnd(F.col("lat")).alias("lat"),
                    F.array_join("name", "|").alias("name"), F.size("tags").cast("int").alias("n_tags"))


@register("osm_streets", f"""
WITH el AS ({ELEMENTS_SQL})
SELECT id, CAST(len(geometry) AS INTEGER) AS n_points, round(geometry[1].lon, 6) AS x0,
       round(geometry[len(geometry)].lat, 6) AS y1
FROM el WHERE type = 'way' AND tags['highway'] IS NOT NULL AND len(geometry) >= 2""")
def q_osm_streets(spark, sf_dir):
    """B17."""
    s = streets(elements(spark, sf_dir))
    return s.select("id", F.size("geometry").cast("int").alias("n_points"),
                    rnd(F.element_at("geometry", 1)["x"]).alias("x0"),
                    rnd(F.element_at("geometry", -1)["y"]).alias("y1"))


_KEYS = "'amenity', 'shop', 'building', 'leisure', 'sport', 'historic', 'tourism', 'man_made'"
_WKEYS = "'amenity', 'shop', 'leisure', 'sport', 'historic', 'tourism', 'man_made'"


@register("osm_filter", f"""
WITH el AS ({ELEMENTS_SQL}),
f AS (SELECT *, list_transform(list_filter(map_entries(tags), lambda e: e.value <> ''), lambda e: e.key) AS ks
      FROM el WHERE tags IS NOT NULL)
SELECT id, type FROM f
WHERE coalesce(tags['access'], '') <> 'private' AND coalesce(tags['amenity'], '') <> 'bench'
  AND (CASE WHEN type = 'way' THEN list_has_any(ks, [{_WKEYS}]) ELSE list_has_any(ks, [{_KEYS}]) END)
  AND coalesce(lat, center.lat) BETWEEN -40.0 AND 60.0 AND coalesce(lon, center.lon) BETWEEN -120.0 AND 150.0""")
def q_osm_filter(spark, sf_dir):
    """B19 with a bounding box (south, west, north, east)."""
    f = poi_filter(elements(spark, sf_dir), (-40.0, -120.0, 60.0, 150.0))
    return f.select("id", "type")


_BOX = (-40.0, -120.0, 60.0, 150.0)


@register("osm_streets_box", f"""
WITH el AS ({ELEMENTS_SQL}),
leg AS (SELECT id, len(geometry) AS n, unnest(list_transform(range(1, len(geometry)), lambda i:
          {{'x': geometry[i].lon, 'y': geometry[i].lat, 'dx': geometry[i + 1].lon - geometry[i].lon,
            'dy': geometry[i + 1].lat - geometry[i].lat}})) AS g
        FROM el WHERE type = 'way' AND tags['highway'] IS NOT NULL AND len(geometry) >= 2),
clip AS (SELECT id, n,
  CASE WHEN g.dx = 0 THEN CASE WHEN g.x BETWEEN {_BOX[1]} AND {_BOX[3]} THEN 0 ELSE 2 END
       ELSE least(({_BOX[1]} - g.x) / g.dx, ({_BOX[3]} - g.x) / g.dx) END AS x0,
  CASE WHEN g.dx = 0 THEN 1 ELSE greatest(({_BOX[1]} - g.x) / g.dx, ({_BOX[3]} - g.x) / g.dx) END AS x1,
  CASE WHEN g.dy = 0 THEN CASE WHEN g.y BETWEEN {_BOX[0]} AND {_BOX[2]} THEN 0 ELSE 2 END
       ELSE least(({_BOX[0]} - g.y) / g.dy, ({_BOX[2]} - g.y) / g.dy) END AS y0,
  CASE WHEN g.dy = 0 THEN 1 ELSE greatest(({_BOX[0]} - g.y) / g.dy, ({_BOX[2]} - g.y) / g.dy) END AS y1
  FROM leg)
SELECT id, CAST(max(n) AS INTEGER) AS n_points FROM clip GROUP BY id
HAVING bool_or(greatest(x0, y0, 0) <= least(x1, y1, 1))""")
def q_osm_streets_box(spark, sf_dir):
    """Streets that meet a bounding box."""
    s = streets(elements(spark, sf_dir), _BOX)
    return s.select("id", F.size("geometry").cast("int").alias("n_points"))
