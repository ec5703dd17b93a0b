"""Forests as a table of trees against the fitted models themselves."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import forests as fo
from tidemark.operators import models as md
from tidemark.session import shared_dir, written

COLUMNS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(7)
    rows = [
        (s, i, float(x), float(y), float(z), int((x + y > 12) != (s == "B and C") or z > 8))
        for s, n in (("A", 160), ("B and C", 90), ("D/E", 40))
        for i, (x, y, z) in enumerate(rng.integers(0, 12, (n, 3)))
    ]
    df = spark.createDataFrame(rows, "symbol string, id int, x double, y double, z double, label int")
    return written(spark, df, ("symbol",))


def test_votes_and_predictions_are_the_models_own(spark, training):
    symbols = ["A", "B and C", "D/E", "absent"]
    settings = {"numTrees": 7, "maxDepth": 5}
    forests = fo.store_forests(training, COLUMNS, symbols, shared_dir(spark), **settings)
    sizes = {r.symbol: r["count"] for r in forests.groupBy("symbol").count().collect()}
    assert sizes == {"A": 7, "B and C": 7, "D/E": 7}
    got = {(r.symbol, r.id): r for r in fo.predict(forests, training, COLUMNS, ["symbol", "id"]).collect()}
    assert len(got) == training.count()
    pipeline = md.Pipeline(stages=[md._assembler(COLUMNS), md._forest(**{**md.SINGLE, **settings})])
    for symbol in symbols[:3]:
        own = training.filter(F.col("symbol") == symbol)
        for r in pipeline.fit(own).transform(own).select("id", vector_to_array("rawPrediction").alias("raw"), "prediction").collect():
            found = got[symbol, r.id]
            assert (found.votes, found.prediction, found.trees) == (r.raw, int(r.prediction), 7)


def test_categories(spark, training):
    """The forest over all symbols splits on sets of symbols."""
    data = training.withColumn("name", F.lit("all"))
    model = md.multi_pipeline(COLUMNS, 3, numTrees=6, maxDepth=6).fit(data)
    path = shared_dir(spark)
    model.stages[-1].save(f"{path}/fit=0")
    trees = fo.saved_trees(spark, path, 6)
    assert trees.filter("exists(nodes, n -> n.categories > 0)").count() > 0
    scored = model.transform(data)
    rows = scored.select("id", F.col("symbol").alias("own"), F.lit("all").alias("symbol"), "symbol_index", *COLUMNS)
    got = fo.predict(trees.withColumn("symbol", F.lit("all")), rows, ["symbol_index", *COLUMNS], ["symbol", "own", "id"])
    want = {(r.symbol, r.id): r.raw for r in scored.select("symbol", "id", vector_to_array("rawPrediction").alias("raw")).collect()}
    assert {(r.own, r.id): r.votes for r in got.collect()} == want


def test_odd_rows(spark, training):
    forests = fo.store_forests(training, COLUMNS, ["A"], shared_dir(spark), numTrees=2, maxDepth=1)
    schema = "symbol string, id int, x double, y double, z double, tree string, nodes int"
    rows = spark.createDataFrame(
        [("A", 1, None, 1.0, 2.0, "a", 1), ("A", 2, 1.0, float("nan"), 2.0, "a", 1), (None, 3, 1.0, 1.0, 2.0, "a", 1),
         ("none", 4, 1.0, 1.0, 2.0, "a", 1), ("A", 5, 1.0, 1.0, 2.0, None, None)], schema)
    assert [r.id for r in fo.predict(forests, rows, COLUMNS, ["symbol", "id"]).collect()] == [5]
    assert fo.predict(forests, rows.limit(0), COLUMNS, ["symbol", "id"]).count() == 0
