"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole test tables (or views Spark derives from them).  Doubles are
rounded in both engines so value hashes are comparable.
"""

from __future__ import annotations

from collections import OrderedDict
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.plans import sqlgen as Q
from toposim.plans import views as V

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: "OrderedDict[str, tuple[Builder, str | None]]" = OrderedDict()


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def rnd(col, d: int = 6):
    return F.round(col, d)


# --- modules that register queries ---------------------------------------
from toposim.plans import queries_core, queries_eval, queries_lgm, queries_ml, queries_osm, queries_pairs, queries_spatial, queries_terms  # noqa: E402,F401,E501
