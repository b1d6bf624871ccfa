"""Scoring a stream of candidate pairs.

The published tool has no streaming side; this module only shows that
the pair scorer is row-local (no state, no shuffle), so it runs
unchanged on a Structured Streaming DataFrame.  Threshold learning and
feature scaling stay batch jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from toposim.functions.registry import NATIVE
from toposim.operators.scoring import score_pairs


def score_stream(pairs: DataFrame, s1: str, s2: str, measures: Sequence[str] = NATIVE) -> DataFrame:
    """Adds one score column per measure to a (streaming) pairs frame."""
    return score_pairs(pairs, s1, s2, list(measures))


def start_scoring(pairs: DataFrame, s1: str, s2: str, path: str, checkpoint: str,
                  measures: Sequence[str] = NATIVE, trigger_once: bool = False) -> StreamingQuery:
    """Append scored pairs to a Parquet sink; the checkpoint folder must be
    on shared storage so a restarted query resumes where it stopped."""
    w = score_stream(pairs, s1, s2, measures).writeStream.format("parquet") \
        .option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
