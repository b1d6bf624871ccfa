"""Sources (A1-A6): explicit schemas, no inference.

Every reader returns a DataFrame; projections and filters applied later
are pushed into the scan by Catalyst (``ReadSchema`` / ``PushedFilters``
on Parquet; column pruning on CSV).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default role -> column mapping of a labelled pair file (fixed values).
DEFAULT_ROLES = {"index": "idx", "ID1": "ID1", "ID2": "ID2", "s1": "Name1", "s2": "Name2",
                 "addr1": "Address1", "addr2": "Address2", "lon1": "st_x1", "lat1": "st_y1",
                 "lon2": "st_x2", "lat2": "st_y2", "status": "Class"}

_ROLE_TYPES = {"index": T.LongType(), "lon1": T.DoubleType(), "lat1": T.DoubleType(),
               "lon2": T.DoubleType(), "lat2": T.DoubleType(), "status": T.StringType()}

PAIR_FILE_FIELDS = ["s1", "s2", "status", "id1", "id2", "alphabet1", "alphabet2", "cc1", "cc2"]

# Gazetteer record layout.
GAZETTEER_FIELDS = ["geonameid", "name", "asciiname", "alternate_names", "latitude", "longitude",
                    "feature class", "feature_code", "country_code", "cc2", "admin1_code", "admin2_code",
                    "admin3_code", "admin4_code", "population", "elevation", "dem", "timezone",
                    "modification_date"]


def pair_schema(roles: dict | None = None, columns: Sequence[str] | None = None) -> T.StructType:
    r = dict(DEFAULT_ROLES, **(roles or {}))
    by_col = {v: _ROLE_TYPES.get(k, T.StringType()) for k, v in r.items()}
    cols = list(columns) if columns else list(r.values())
    return T.StructType([T.StructField(c, by_col.get(c, T.StringType()), True) for c in cols])


# Texts that stand for a missing value in a scanned column.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _label(col) -> "F.Column":
    s = F.upper(F.trim(col.cast("string")))
    return F.when(s.isin("TRUE", "1", "1.0", "T", "YES"), 1).when(s.isin("FALSE", "0", "0.0", "F", "NO"), 0) \
        .cast("int")


def read_pairs(spark: SparkSession, path: str, roles: dict | None = None, sep: str = ",",
               header: bool = True, fmt: str = "csv", keep_na_text: bool = False,
               columns: Sequence[str] | None = None) -> DataFrame:
    """A1 / A2: labelled candidate pairs projected to the mapped roles.

    Text columns get ``''`` for missing values, which the texts of
    ``MISSING`` also stand for; ``keep_na_text=True`` keeps those."""
    r = dict(DEFAULT_ROLES, **(roles or {}))
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        rd = spark.read.schema(pair_schema(r, columns)).option("sep", sep).option("header", header)
        rd = rd.option("nullValue", "\u0000") if keep_na_text else rd
        df = rd.csv(path)
    present = [v for v in r.values() if v in df.columns]
    text_roles = {r[k] for k in ("ID1", "ID2", "s1", "s2", "addr1", "addr2") if k in r}
    out = []
    for c in present:
        if c == r["status"]:
            out.append(_label(F.col(c)).alias(c))
        elif c in text_roles:
            text = F.col(c).cast("string")
            if not keep_na_text:
                text = F.when(~text.isin(*MISSING), text)
            out.append(F.coalesce(text, F.lit("")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def read_name_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The 9-column tab-separated name-pair layout (also K5's output)."""
    schema = T.StructType([T.StructField(f, T.StringType(), True) for f in PAIR_FILE_FIELDS])
    df = spark.read.schema(schema).option("sep", "\t").csv(path)
    return df.withColumn("status", _label(F.col("status")))


def read_frequent_terms(spark: SparkSession, path_glob: str, k: int = 400) -> DataFrame:
    """A3: ``*gram*_{encoding}.csv`` lists (``gram<TAB>count``, a header
    line, descending): the first k rows of each list, bucketed ``tokens``
    / ``chars`` by its name; returns ``(kind, term)`` with every term and
    its reversal, distinct.  A list is a file, or a folder of parts read
    by name.  Every task passes on k rows of a list at most (the rank's
    limit is pushed below the shuffle)."""
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("count", T.LongType())])
    df = spark.read.schema(schema).option("sep", "\t").option("header", False).csv(path_glob)
    df = df.where(~((F.col("gram") == "gram") & F.col("count").isNull()))  # header lines
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, r"^(.*gram[^/]*\.csv)/[^/]*$", 1)
    df = df.select("gram", "count", F.when(folder != "", folder).otherwise(path).alias("file"),
                   F.struct(path.alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("pos"))
    from pyspark.sql import Window
    w = Window.partitionBy("file").orderBy("pos")
    top = df.select("*", F.row_number().over(w).alias("rn")).where(F.col("rn") <= k)
    kind = F.when(F.regexp_extract("file", r"([^/]*)$", 1).contains("token"), "tokens").otherwise("chars")
    top = top.select(kind.alias("kind"), F.col("gram").alias("term"))
    return top.unionByName(top.select("kind", F.reverse("term").alias("term"))).distinct()


def read_gazetteer(spark: SparkSession, path: str, sep: str = "\t", header: bool = False) -> DataFrame:
    """A4: 19-column gazetteer records; alternate names as an array."""
    types = {"geonameid": T.LongType(), "latitude": T.DoubleType(), "longitude": T.DoubleType(),
             "population": T.LongType()}
    schema = T.StructType([T.StructField(f, types.get(f, T.StringType()), True) for f in GAZETTEER_FIELDS])
    df = spark.read.schema(schema).option("sep", sep).option("header", header).option("quote", "\u0000").csv(path)
    return df.withColumn("alternate_names", F.split(F.coalesce("alternate_names", F.lit("")), ","))


OSM_ELEMENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("center", T.StructType([T.StructField("lat", T.DoubleType()),
                                          T.StructField("lon", T.DoubleType())])),
    T.StructField("geometry", T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()),
                                                        T.StructField("lon", T.DoubleType())]))),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()))])


def read_osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """A5: Overpass-style JSON documents -> one row per element.

    A document of any size is read by all tasks: see ``jsonranges``."""
    from toposim.sources.jsonranges import elements

    return elements(spark, path, "elements").select(F.from_json("value", OSM_ELEMENT).alias("e")).select("e.*")


def read_features(spark: SparkSession, path: str, label: str = "class", index: str = "index",
                  fmt: str = "parquet") -> tuple[DataFrame, list[str]]:
    """A pre-built feature table; returns it and the feature columns
    (everything but the index and the label)."""
    df = spark.read.parquet(path) if fmt == "parquet" else \
        spark.read.option("header", True).option("inferSchema", False).csv(path)
    feats = [c for c in df.columns if c not in (label, index)]
    df = df.select(F.col(index).cast("long").alias("index"),
                   *[F.col(c).cast("double").alias(c) for c in feats], F.col(label).cast("int").alias("class"))
    return df, feats
