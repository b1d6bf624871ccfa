"""OSM element shaping (B17-B19); the scan itself is
:func:`toposim.sources.readers.read_osm_elements`.

Element rows: ``type, id, lat, lon, center struct<lat,lon>,
geometry array<struct<lat,lon>>, tags map<string,string>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tag keys that make an element a place of interest.
POI_KEYS = ["amenity", "shop", "building", "leisure", "sport", "historic", "tourism", "man_made"]
WAY_POI_KEYS = [k for k in POI_KEYS if k != "building"]


def _meets(p, q, box):
    """Whether the segment p-q (structs x, y) meets the closed ``box`` (south,
    west, north, east): their ranges overlap, and the box's corners do not
    all lie on one side of the line."""
    s, w, n, e = map(F.lit, box)
    side = [(q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]) for x, y in ((w, s), (e, s), (e, n), (w, n))]
    overlap = (F.least(p["x"], q["x"]) <= e) & (F.greatest(p["x"], q["x"]) >= w) & (F.least(p["y"], q["y"]) <= n) & (F.greatest(p["y"], q["y"]) >= s)
    return overlap & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)


def streets(elements: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``highway`` ways as lines ``(id, geometry array<struct<x,y>>)``;
    lines with fewer than two points are dropped.  With ``bbox = (south,
    west, north, east)`` only lines that meet the box, a line that crosses
    it without a point inside included."""
    w = elements.where((F.col("type") == "way") & F.col("tags").getItem("highway").isNotNull())
    line = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    lines = w.select("id", line.alias("geometry")).where(F.size("geometry") >= 2)
    if bbox is None:
        return lines
    legs = F.arrays_zip(F.slice("geometry", F.lit(1), F.size("geometry") - 1).alias("p"), F.slice("geometry", F.lit(2), F.size("geometry") - 1).alias("q"))
    return lines.where(F.exists(legs, lambda leg: _meets(leg["p"], leg["q"], bbox)))


def pois(elements: DataFrame) -> DataFrame:
    """Elements with tags -> ``(id, tags, lon, lat, name)``; a node
    uses its own position, anything else its centre; ``name`` = distinct
    values of tags whose key contains 'name' (sorted)."""
    node = F.col("type") == "node"
    lon = F.when(node, F.col("lon")).otherwise(F.col("center.lon"))
    lat = F.when(node, F.col("lat")).otherwise(F.col("center.lat"))
    names = F.array_sort(F.array_distinct(F.map_values(F.map_filter("tags", lambda k, v: k.rlike("name")))))
    return elements.where(F.col("tags").isNotNull()) \
        .select("id", "tags", lon.alias("lon"), lat.alias("lat"), names.alias("name"))


def poi_filter(elements: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Access is not private, amenity is not a bench, some POI key
    has a non-empty value (ways: not ``building``), inside
    ``bbox = (south, west, north, east)``."""
    t = F.col("tags")
    keys_ok = F.when(F.col("type") == "way",
                     F.exists(F.map_keys(F.map_filter(t, lambda k, v: v != "")),
                              lambda k: k.isin(*WAY_POI_KEYS)))\
        .otherwise(F.exists(F.map_keys(F.map_filter(t, lambda k, v: v != "")), lambda k: k.isin(*POI_KEYS)))
    cond = t.isNotNull() & (F.coalesce(t.getItem("access"), F.lit("")) != "private") \
        & (F.coalesce(t.getItem("amenity"), F.lit("")) != "bench") & keys_ok
    out = elements.where(cond)
    if bbox is not None:
        s, w, n, e = bbox
        lat = F.coalesce(F.col("lat"), F.col("center.lat"))
        lon = F.coalesce(F.col("lon"), F.col("center.lon"))
        out = out.where(lat.between(s, n) & lon.between(w, e))
    return out
