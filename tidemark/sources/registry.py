"""Registry of trained models: one row per saved model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.ml import PipelineModel


def latest_models(registry: DataFrame) -> DataFrame:
    """Newest model per scope and type, and the number the next one gets.

    Single-symbol models count per scope, multi-symbol models count globally.
    """
    newest = registry.groupBy("scope", "type").agg(
        F.max("model_number").alias("latest_number"), F.max_by("path", "model_number").alias("latest_path")
    )
    # One row per scope and type by now, so the window over a type is small.
    overall = F.max("latest_number").over(Window.partitionBy("type"))
    following = F.when(F.col("type") == "SINGLE", F.col("latest_number")).otherwise(overall) + 1
    return newest.withColumn("next_number", following)


def register(spark: SparkSession, registry_path: str, model: PipelineModel, row: dict) -> None:
    """Save a model and append its row; ``row`` has scope, type, model_number, accuracy and path."""
    model.write().overwrite().save(row["path"])
    schema = "scope string, type string, model_number long, accuracy double, path string"
    spark.createDataFrame([row], schema).write.mode("append").parquet(registry_path)


def load_latest(spark: SparkSession, registry_path: str, scope: str, kind: str) -> PipelineModel:
    newest = latest_models(spark.read.parquet(registry_path)).filter(
        (F.col("scope") == scope) & (F.col("type") == kind)
    )
    return PipelineModel.load(newest.head()["latest_path"])
