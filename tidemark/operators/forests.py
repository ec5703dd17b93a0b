"""Forests per symbol as one table of trees, so that one join scores every symbol with its own model.

A row is one tree: its symbol, its number, the largest depth, and its nodes as an array in which a node's place is its
number and the root comes first. A feature row meets the trees of its symbol, walks each by array expressions, and adds
their votes in the order of the trees; the sums are those of the fitted model's own ``transform``.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import models as md

NODE = "feature int, categories int, bounds array<double>, left int, right int, votes array<double>"
FORESTS = f"symbol string, tree int, depth int, nodes array<struct<{NODE.replace(', ', ',').replace(' ', ':')}>>"


def store_forests(training: DataFrame, columns: Sequence[str], symbols: Sequence[str], path: str, **settings) -> DataFrame:
    """Fit one forest per symbol, a few side by side, and write their trees as one table below ``path``.

    ``training`` is a stored table partitioned by symbol, with ``label``; each fit reads its own part. A model is saved
    as soon as it is fitted and none is kept on the driver. A symbol without a complete row gets no forest.
    """
    spark = training.sparkSession
    settings = {**md.SINGLE, **settings}
    pipeline = Pipeline(stages=[md._assembler(columns), md._forest(**settings)])

    def fit(numbered: tuple[int, str]) -> None:
        number, symbol = numbered
        own = training.filter(F.col("symbol") == symbol).dropna(subset=list(columns))
        if not own.isEmpty():
            pipeline.fit(own).stages[-1].write().overwrite().save(f"{path}/models/fit={number}")

    with ThreadPoolExecutor(md.PARALLEL_FITS) as pool:
        list(pool.map(fit, enumerate(symbols)))
    names = spark.createDataFrame(list(enumerate(symbols)), "fit int, symbol string")
    trees = saved_trees(spark, f"{path}/models", settings["maxDepth"]).join(names, "fit")
    trees.select("symbol", "tree", "depth", "nodes").write.parquet(f"{path}/trees")
    return spark.read.schema(FORESTS).parquet(f"{path}/trees")


def saved_trees(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """Trees of the forests saved in the folders ``fit=…`` below ``path``: fit, tree, depth, nodes."""
    node, split = F.col("nodeData"), F.col("nodeData.split")
    stored = spark.read.option("basePath", path).parquet(f"{path}/fit=*/data").select(
        F.col("fit").cast("int").alias("fit"), F.col("treeID").alias("tree"), node["id"].alias("id"),
        F.struct(
            split["featureIndex"].alias("feature"), split["numCategories"].alias("categories"),
            split["leftCategoriesOrThreshold"].alias("bounds"), node["leftChild"].alias("left"),
            node["rightChild"].alias("right"), shares(node["impurityStats"]).alias("votes"),
        ).alias("node"),
    )
    # A group is one tree, which its depth bounds.
    ordered = F.array_sort(F.collect_list(F.struct("id", "node")))
    return stored.groupBy("fit", "tree").agg(F.lit(depth).alias("depth"), ordered["node"].alias("nodes"))


def shares(counts: Column) -> Column:
    """Class counts of a leaf as shares, zeros where it has none."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.transform(counts, lambda c: F.when(total == 0, 0.0).otherwise(c / total))


def leaf(nodes: Column, features: Column, depth: Column) -> Column:
    """The leaf that ``features`` reach: one step per level, standing still on a leaf."""

    def step(node: Column, _: Column) -> Column:
        value = features[node["feature"]]
        goes_left = F.when(node["categories"] < 0, value <= node["bounds"][0]).otherwise(F.array_contains(node["bounds"], value))
        return F.when(node["left"] < 0, node).otherwise(nodes[F.when(goes_left, node["left"]).otherwise(node["right"])])

    return F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), nodes[0], step)


def predict(forests: DataFrame, rows: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Votes and prediction of each row from the forest of its symbol.

    ``key`` holds ``symbol`` and tells rows apart; rows with a missing feature and those of symbols without a forest are
    left out. ``trees`` counts the trees asked, ``votes`` holds their shares per class; equal votes go to the lower class.
    """
    features = F.array(*[F.col(c).cast("double") for c in columns]).alias("features")
    # One row per symbol and tree comes from the forests, so a row's partial list holds at most its trees.
    met = rows.dropna(subset=list(columns)).select(*key, features).join(forests, "symbol")
    voted = met.select(*key, F.struct("tree", leaf(F.col("nodes"), F.col("features"), F.col("depth"))["votes"].alias("votes")).alias("vote"))
    cast = voted.groupBy(*key).agg(F.array_sort(F.collect_list("vote"))["votes"].alias("cast"))
    added = F.aggregate(
        F.slice("cast", 2, F.size("cast")), F.col("cast")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    )
    counted = cast.select(*key, F.size("cast").alias("trees"), added.alias("votes"))
    best = F.array_position("votes", F.array_max("votes")) - 1
    return counted.withColumn("prediction", best.cast("int"))
