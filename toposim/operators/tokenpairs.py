"""The dictionary of token pairs that the token measures and the term
split read.

Every pair of tokens that meets in a row is a row of one table over the
whole input; equal pairs are scored once, and the weights are joined
back, so the work of the character kernel grows with the vocabulary and
not with the pairs of names.  Tokens themselves are the keys: a name's
token is shorter than a number and the two shuffles that numbering
would cost.  A pair that many rows share is one row of the dictionary;
the rows that ask for it are split by AQE's skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toposim.functions.kernels import kernel
from toposim.session import materialize

WEIGHTS = "_tw"


#: Between the tokens of a pair.  Names are split at it, so no token holds it.
GAP = " "


def met(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """The distinct pairs of some pairs of token arrays, as ``x y``.

    One string a pair: strings are made distinct by a hash set, structs by
    comparing all with all, which took most of the time of a row."""
    def cross(a: Column, b: Column) -> Column:
        return F.flatten(F.transform(F.array_distinct(a), lambda x: F.transform(F.array_distinct(b), lambda y: F.concat(x, F.lit(GAP), y))))

    return F.array_distinct(F.concat(*[cross(a, b) for a, b in pairs]))


def _tokens(pair: str) -> list[Column]:
    return [F.substring_index(pair, GAP, 1).alias("x"), F.substring_index(pair, GAP, -1).alias("y")]


def dictionary(rows: DataFrame, pairs: Sequence[tuple[Column, Column]]) -> DataFrame:
    """(x, y, w): Jaro-Winkler of every distinct pair of tokens that meet."""
    every = rows.select(F.explode(met(pairs)).alias("p")).distinct().select(*_tokens("p"))
    return materialize(every.select("x", "y", kernel("jaro_winkler", "x", "y").alias("w")), "token-weights")


def attach(df: DataFrame, pairs: Sequence[tuple[Column, Column]], out: str = WEIGHTS) -> DataFrame:
    """``df`` and, per row, the array of (x, y, w) of its token pairs.

    ``df`` is written once: its rows are numbered for the way back."""
    rows = materialize(df.withColumn("_rid", F.monotonically_increasing_id()), "token-rows")
    weights = dictionary(rows, pairs).select(F.concat("x", F.lit(GAP), "y").alias("p"), "x", "y", "w")
    asked = rows.select("_rid", F.explode(met(pairs)).alias("p"))
    # never broadcast: the files are small, the table in memory is not
    got = asked.join(weights.hint("merge"), "p").groupBy("_rid").agg(F.collect_list(F.struct("x", "y", "w")).alias(out))
    return rows.join(got, "_rid", "left").drop("_rid")
