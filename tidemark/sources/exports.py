"""Feature sets and replay records as text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.indicators import INDICATORS

REPLAY_COLUMNS = (
    "open", "high", "low", "close", "volume", "percent_change", "smoothed_close", *INDICATORS,
)
REPLAY_SCHEMA = "symbol string, trade_date date, " + ", ".join(f"{c} double" for c in REPLAY_COLUMNS)


def export_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def export_libsvm(df: DataFrame, path: str, columns: Sequence[str], label: str = "label") -> None:
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    vectors.select(F.col(label).cast("double").alias("label"), "features").write.mode("overwrite").format("libsvm").save(path)


def load_libsvm(spark: SparkSession, path: str, width: int) -> DataFrame:
    return spark.read.format("libsvm").option("numFeatures", width).load(path)


def export_replay(df: DataFrame, path: str) -> None:
    """The full daily record, gaps as 0, without a header."""
    export_csv(df.select("symbol", "trade_date", *REPLAY_COLUMNS).fillna(0), path, header=False)


def load_replay(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPLAY_SCHEMA).csv(path)
