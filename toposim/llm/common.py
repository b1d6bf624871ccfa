"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.session import checkpoint_dir

#: Characters handed to a numpy kernel at once; longer texts form a slice of their own.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_stage(df: DataFrame, label: str) -> str:
    """Write ``df`` under the shared checkpoint folder; returns the path.

    Parquet in the shared folder cuts lineage and survives the loss of
    executors; the next step plans from a plain scan.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(write_stage(df, label))


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``write_stage`` made (never any other)."""
    if "/llm-" not in path:
        raise ValueError(f"not a stage folder: {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sha256_hex(col: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(col.cast("binary"), 256)


def slices(lengths, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut ``range(len(lengths))`` into runs whose lengths sum to about ``limit``."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def texts_of(s: pd.Series) -> list[str]:
    """The strings of a column, null read as the empty text."""
    return [x if isinstance(x, str) else "" for x in s]


def carried(df: DataFrame, *named: str) -> DataFrame:
    """``df`` as one struct column ``__row`` beside copies of the columns
    ``named``, so that no name of ``df`` can clash with a step's own;
    ``select("__row.*")`` gives the rows back."""
    return df.select(F.struct("*").alias("__row"), *[F.col(f"`{c}`") for c in named])


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, rows: int = 50_000, salts: int = 32) -> DataFrame:
    """Left join to ``right``, a written table with one row per key.

    ``right`` is broadcast when counting shows at most ``rows`` rows.
    Beyond that its rows are repeated per salt and ``spread`` (any column
    that differs within a key) deals a hot key over ``salts`` tasks.
    """
    if right.limit(rows + 1).count() <= rows:
        return left.join(F.broadcast(right), on, "left")
    salted = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return left.join(salted, [*on, "__salt"], "left").drop("__salt")


def sql_crc32(text: str) -> str:
    """DuckDB expression: the unsigned CRC-32 of a text's UTF-8 bytes, by the
    definition (reflected polynomial 0xEDB88320, bit by bit)."""
    bits = "list_reduce(list_prepend(xor(c, byte), range(8)::BIGINT[]), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
    octets = f"list_transform(range(octet_length(encode({text})))::BIGINT[], lambda k: ('0x' || hex(encode({text}))[2 * k + 1 : 2 * k + 2])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, byte: {bits}), 4294967295)"
