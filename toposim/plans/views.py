"""Deterministic place views derived from the test tables.

The test data has no place table, so two "sources" of the same places
are derived from ``part`` and a labelled candidate-pair table is built
from them:

* source A: ``name = p_name + ' ' + lower(p_type)``, a street address
  with numbers, coordinates from the key;
* source B: a rendering of the same part that varies with the key
  (token order, case, hyphens, accents + abbreviation), a differently
  shaped address, coordinates shifted by a few metres;
* pairs: (A_k, B_k) labelled 1 and (A_k, B_k+1) labelled 0 — every
  part takes part in exactly two pairs, so the table is linear in
  ``part`` and is built with one equi-join on the key (no all-pairs
  blocking).

Every builder has its DuckDB twin (``*_SQL``) used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lon(k):
    return (F.col(k) * 7919 % 3600).cast("double") / 10 - 180


def _lat(k):
    return (F.col(k) * 104729 % 1600).cast("double") / 10 - 80


#: Digits of a number become the letters of a made-up word.
_LETTERS = "abdegilnor"


def _word(n: int, m: int):
    """A word that about one place in ``m`` has: names need rare words beside the frequent ones."""
    return F.translate(F.lpad((F.col("p_partkey") * n % m).cast("string"), 5, "0"), "0123456789", _LETTERS)


def _words():
    return _word(7919, 2003), _word(104729, 99991)


def places_a(part: DataFrame) -> DataFrame:
    w1, w2 = _words()
    return part.select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", F.col("p_name"), w1, F.lower("p_type"), w2).alias("name"),
        F.concat(F.col("p_brand"), F.lit(" street "), F.col("p_size").cast("string"), F.lit("-"),
                 (F.col("p_size") + 2).cast("string")).alias("address"),
        _lon("p_partkey").alias("lon"), _lat("p_partkey").alias("lat"))


def places_b(part: DataFrame) -> DataFrame:
    v = F.col("p_partkey") % 4
    w1, w2 = _words()
    name = (F.when(v == 0, F.concat_ws(" ", F.lower("p_type"), w2, F.col("p_name"), w1))
            .when(v == 1, F.concat_ws(" ", F.upper("p_name"), w1, F.lower("p_type"), w2))
            .when(v == 2, F.concat_ws(" ", F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), w1, F.lower("p_type")))
            .otherwise(F.concat_ws(" ", F.translate(F.col("p_name"), "aeo", "àéö"), F.substring(w1, 2, 4),
                                   F.concat(F.substring(F.lower("p_type"), 1, 3), F.lit(".")), w2)))
    return part.select(
        F.col("p_partkey").alias("id"), name.alias("name"),
        F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_brand"), F.lit(" st.")).alias("address"),
        (_lon("p_partkey") + (F.col("p_size") % 5).cast("double") / 1000.0).alias("lon"),
        (_lat("p_partkey") + (F.col("p_size") % 3).cast("double") / 1000.0).alias("lat"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs in the default column layout
    (idx, ID1, ID2, Name1, Name2, Address1, Address2, st_x1, st_y1,
    st_x2, st_y2, Class)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    a = places_a(part)
    b = places_b(part)
    b2 = (b.withColumn("k", F.col("id")).withColumn("Class", F.lit(1))
          .unionByName(b.withColumn("k", F.col("id") - 1).withColumn("Class", F.lit(0))))
    j = a.alias("a").join(b2.alias("b"), F.col("a.id") == F.col("b.k"))
    return spread(j.select(
        (F.col("a.id") * 2 + 1 - F.col("b.Class")).alias("idx"),
        F.concat(F.lit("a"), F.col("a.id").cast("string")).alias("ID1"),
        F.concat(F.lit("b"), F.col("b.id").cast("string")).alias("ID2"),
        F.col("a.name").alias("Name1"), F.col("b.name").alias("Name2"),
        F.col("a.address").alias("Address1"), F.col("b.address").alias("Address2"),
        F.col("a.lon").alias("st_x1"), F.col("a.lat").alias("st_y1"),
        F.col("b.lon").alias("st_x2"), F.col("b.lat").alias("st_y2"),
        F.col("b.Class").cast("int").alias("Class")))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square polygons (side 20) per nation; nations of region 0 are
    unnamed.  Ring is closed, counter-clockwise."""
    n = table(spark, sf_dir, "nation")
    cx, cy = _lon("n_nationkey"), _lat("n_nationkey")
    h = F.lit(10.0)
    ring = F.array(F.struct((cx - h).alias("x"), (cy - h).alias("y")),
                   F.struct((cx + h).alias("x"), (cy - h).alias("y")),
                   F.struct((cx + h).alias("x"), (cy + h).alias("y")),
                   F.struct((cx - h).alias("x"), (cy + h).alias("y")),
                   F.struct((cx - h).alias("x"), (cy - h).alias("y")))
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.when(F.col("n_regionkey") == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lower("n_name"), F.concat(F.lit("land "), F.col("n_nationkey").cast("string"))))
        .alias("names"),
        ring.alias("ring"), F.lit(400.0).alias("area"))


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    a = places_a(spread(part))
    return a.select(F.col("id").alias("poi_id"), "name", F.col("lon").alias("x"), F.col("lat").alias("y"))


#: Rings (offsets from the centre, closed) of the shapes by nation key mod 5, and their areas.
SHAPES = [
    ([[(-12, -12), (12, -12), (12, 12), (-12, 12)], [(-5, -5), (5, -5), (5, 5), (-5, 5)]], 476.0),  # with a hole
    ([[(-10, -10), (10, -10), (10, -4), (-4, -4), (-4, 10), (-10, 10)]], 204.0),  # an L
    ([[(-13, -4), (-5, -4), (-5, 4), (-13, 4)], [(4, -2), (14, -2), (14, 8), (4, 8)]], 164.0),  # two parts
    ([[(-30, -25), (30, -25), (30, -15), (-18, -15), (-18, 15), (30, 15), (30, 25), (-30, 25)]], 1560.0),  # a large C
    ([[(0, -0.25), (0.25, 0), (0, 0.25), (-0.25, 0)]], 0.125),  # tiny, around a point
]


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons with holes, several parts, concave, large and tiny ones; the
    named and unnamed as in ``polygons``."""
    n = table(spark, sf_dir, "nation")
    cx, cy = _lon("n_nationkey"), _lat("n_nationkey")
    rings, area = None, None
    for kind, (rs, a) in enumerate(SHAPES):
        is_kind = F.col("n_nationkey") % len(SHAPES) == kind
        made = F.array(*[F.array(*[F.struct((cx + float(x)).alias("x"), (cy + float(y)).alias("y")) for x, y in r + r[:1]]) for r in rs])
        rings = F.when(is_kind, made) if rings is None else rings.when(is_kind, made)
        area = F.when(is_kind, F.lit(a)) if area is None else area.when(is_kind, F.lit(a))
    return n.select(F.col("n_nationkey").cast("bigint").alias("id"),
                    F.when(F.col("n_regionkey") == 0, F.array().cast("array<string>"))
                    .otherwise(F.array(F.lower("n_name"), F.concat(F.lit("land "), F.col("n_nationkey").cast("string")))).alias("names"),
                    rings.alias("rings"), area.alias("area"))


# ---- DuckDB twins ---------------------------------------------------------

def _word_sql(n: int, m: int) -> str:
    return f"translate(lpad(CAST(p_partkey * {n} % {m} AS VARCHAR), 5, '0'), '0123456789', '{_LETTERS}')"


_W1, _W2 = _word_sql(7919, 2003), _word_sql(104729, 99991)

PLACES_A_SQL = f"""
SELECT p_partkey AS id, p_name || ' ' || {_W1} || ' ' || lower(p_type) || ' ' || {_W2} AS name,
       p_brand || ' street ' || CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 2 AS VARCHAR) AS address,
       CAST((p_partkey * 7919) % 3600 AS DOUBLE) / 10 - 180 AS lon,
       CAST((p_partkey * 104729) % 1600 AS DOUBLE) / 10 - 80 AS lat,
       p_size
FROM part"""

PLACES_B_SQL = f"""
SELECT p_partkey AS id,
       CASE p_partkey % 4
         WHEN 0 THEN lower(p_type) || ' ' || {_W2} || ' ' || p_name || ' ' || {_W1}
         WHEN 1 THEN upper(p_name) || ' ' || {_W1} || ' ' || lower(p_type) || ' ' || {_W2}
         WHEN 2 THEN replace(p_name, ' ', '-') || ' ' || {_W1} || ' ' || lower(p_type)
         ELSE translate(p_name, 'aeo', 'àéö') || ' ' || substr({_W1}, 2, 4) || ' ' || substr(lower(p_type), 1, 3) || '. ' || {_W2} END AS name,
       CAST(p_size AS VARCHAR) || ' ' || p_brand || ' st.' AS address,
       CAST((p_partkey * 7919) % 3600 AS DOUBLE) / 10 - 180 + CAST(p_size % 5 AS DOUBLE) / 1000.0 AS lon,
       CAST((p_partkey * 104729) % 1600 AS DOUBLE) / 10 - 80 + CAST(p_size % 3 AS DOUBLE) / 1000.0 AS lat
FROM part"""

PAIRS_SQL = f"""
WITH pa AS ({PLACES_A_SQL}),
     pb AS ({PLACES_B_SQL}),
     pb2 AS (SELECT *, id AS k, 1 AS Class FROM pb UNION ALL SELECT *, id - 1 AS k, 0 AS Class FROM pb)
SELECT pa.id * 2 + 1 - pb2.Class AS idx, 'a' || CAST(pa.id AS VARCHAR) AS ID1,
       'b' || CAST(pb2.id AS VARCHAR) AS ID2, pa.name AS Name1, pb2.name AS Name2,
       pa.address AS Address1, pb2.address AS Address2, pa.lon AS st_x1, pa.lat AS st_y1,
       pb2.lon AS st_x2, pb2.lat AS st_y2, CAST(pb2.Class AS INTEGER) AS Class
FROM pa JOIN pb2 ON pa.id = pb2.k"""

POLYGONS_SQL = """
SELECT CAST(n_nationkey AS BIGINT) AS id,
       CASE WHEN n_regionkey = 0 THEN []::VARCHAR[]
            ELSE [lower(n_name), 'land ' || CAST(n_nationkey AS VARCHAR)] END AS names,
       CAST((n_nationkey * 7919) % 3600 AS DOUBLE) / 10 - 180 - 10.0 AS minx,
       CAST((n_nationkey * 7919) % 3600 AS DOUBLE) / 10 - 180 + 10.0 AS maxx,
       CAST((n_nationkey * 104729) % 1600 AS DOUBLE) / 10 - 80 - 10.0 AS miny,
       CAST((n_nationkey * 104729) % 1600 AS DOUBLE) / 10 - 80 + 10.0 AS maxy,
       400.0::DOUBLE AS area
FROM nation"""

_SHAPE_EDGES = ", ".join(
    f"({kind}, {float(p[0])}::DOUBLE, {float(p[1])}::DOUBLE, {float(q[0])}::DOUBLE, {float(q[1])}::DOUBLE)"
    for kind, (rings, _) in enumerate(SHAPES) for r in rings for p, q in zip(r, r[1:] + r[:1]))

#: id, names, area, and one row per edge
SHAPES_SQL = f"""
SELECT CAST(n_nationkey AS BIGINT) AS id,
       CASE WHEN n_regionkey = 0 THEN []::VARCHAR[]
            ELSE [lower(n_name), 'land ' || CAST(n_nationkey AS VARCHAR)] END AS names,
       {[a for _, a in SHAPES]}[n_nationkey % {len(SHAPES)} + 1]::DOUBLE AS area,
       lon + v.ax AS ax, lat + v.ay AS ay, lon + v.bx AS bx, lat + v.b_y AS b_y
FROM (SELECT *, CAST((n_nationkey * 7919) % 3600 AS DOUBLE) / 10 - 180 AS lon,
             CAST((n_nationkey * 104729) % 1600 AS DOUBLE) / 10 - 80 AS lat FROM nation)
JOIN (VALUES {_SHAPE_EDGES}) v(kind, ax, ay, bx, b_y) ON n_nationkey % {len(SHAPES)} = v.kind"""

POIS_SQL = f"""
SELECT id AS poi_id, name, lon AS x, lat AS y FROM ({PLACES_A_SQL})"""


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """Prefix ``sql`` with the named derived views as CTEs."""
    defs = {"pairs": PAIRS_SQL, "polygons": POLYGONS_SQL, "shapes": SHAPES_SQL, "pois": POIS_SQL,
            "places_a": PLACES_A_SQL, "places_b": PLACES_B_SQL, "gazetteer": GAZETTEER_SQL}
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{sql}"


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer-shaped rows from ``part``: several alternate spellings
    per place (some too short to count), a country code from the size."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"))
    alts = F.concat_ws(",", F.upper("p_name"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
                       F.translate(F.col("p_name"), "aeo", "àéö"), F.substring("p_name", 1, 2),
                       F.concat(F.lit(" "), F.lower("p_type"), F.lit(" "), F.col("p_name")))
    return p.select(F.col("p_partkey").alias("geonameid"),
                    F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type")).alias("name"),
                    F.col("p_name").alias("asciiname"), alts.alias("alternate_names"),
                    F.concat(F.lit("C"), (F.col("p_size") % 25).cast("string")).alias("country_code"))


GAZETTEER_SQL = """
SELECT p_partkey AS geonameid, p_name || ' ' || lower(p_type) AS name, p_name AS asciiname,
       upper(p_name) || ',' || replace(p_name, ' ', '-') || ',' || translate(p_name, 'aeo', 'àéö') || ','
         || substr(p_name, 1, 2) || ',' || ' ' || lower(p_type) || ' ' || p_name AS alternate_names,
       'C' || CAST(p_size % 25 AS VARCHAR) AS country_code
FROM part"""


def fixture_frequent_terms(spark, sf_dir, k: int = 400) -> list[str]:
    """Frequent terms mined from the pair names (J1 -> A3).  The set holds
    at most 2k strings, so it is brought to the driver as a literal."""
    from toposim.operators.terms import frequent_set, term_counts

    p = pairs(spark, sf_dir).select("Name1", "Name2")
    terms = sorted(r.term for r in frequent_set(term_counts(p, ["Name1", "Name2"]), k).collect())
    assert len(terms) <= 2 * k
    return terms
