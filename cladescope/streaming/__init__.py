"""Incremental work: what is there already isn't made again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_outputs(wanted: DataFrame, done: DataFrame, fresh_before: str | None = None) -> DataFrame:
    """Rows of ``wanted`` (key, modified) without an output in ``done`` (key, modified) at least as new."""
    made = done.groupBy("key").agg(F.max("modified").alias("made"))
    rows = wanted.join(made, "key", "left")
    return rows.where("made is null or modified > made").drop("made")


def new_hits(stream: DataFrame, hits_per_query: str = "10 minutes") -> DataFrame:
    """A stream of hits (ts, strain_q, strain_s, q, s, score) without repeats within the watermark."""
    return stream.withWatermark("ts", hits_per_query).dropDuplicatesWithinWatermark(["strain_q", "strain_s", "q", "s"])


def best_so_far(stream: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Per window and query the best score of a stream of hits, for monitoring a running search."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "q").agg(F.max("score").alias("score"), F.count("*").alias("n"))
