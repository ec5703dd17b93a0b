"""Bars from ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars_from_ticks(ticks: DataFrame, interval: str) -> DataFrame:
    """Open/high/low/close per symbol and interval; ``volume`` counts ticks.

    ``seq`` orders the ticks and is unique. Every aggregate combines before the shuffle, so a hot symbol costs no
    more than its number of intervals. Works on batch and streaming input.
    """
    return (
        ticks.groupBy(F.window("ts", interval).alias("w"), "symbol")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
