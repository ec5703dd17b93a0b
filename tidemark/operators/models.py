"""Direction classifiers with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Normalizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import shared_forests
from tidemark.operators.features import split_rows

# Fixed values of the two forests and of the training share.
SEED = 12345
TRAIN_SHARE = 0.7
SINGLE = {"numTrees": 100, "maxDepth": 15, "maxBins": 32}
MULTI = {"numTrees": 500, "maxDepth": 10}
PARALLEL_FITS = 4


def _forest(**settings) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", impurity="gini", featureSubsetStrategy="auto", seed=SEED,
        cacheNodeIds=True, maxMemoryInMB=1024, **settings,  # fewer passes per level
    )


def _assembler(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip")


def accuracy(predicted: DataFrame) -> float:
    return MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label").evaluate(predicted)


def fit_and_measure(pipeline: Pipeline, rows: DataFrame) -> tuple[float, PipelineModel]:
    """Accuracy on the held-out share, and the model refitted on all rows."""
    split = split_rows(rows, TRAIN_SHARE, "symbol", "trade_date", "horizon")
    trial = pipeline.fit(split.filter("part = 'train'"))
    return accuracy(trial.transform(split.filter("part = 'test'"))), pipeline.fit(rows)


def forest_per_symbol(
    training: DataFrame, columns: Sequence[str], symbols: Sequence[str], **settings
) -> dict[str, tuple[float, PipelineModel]]:
    """One forest per symbol, a few fits at a time.

    ``training`` should be a stored table partitioned by symbol, so that each
    fit reads its own part only.
    """
    pipeline = Pipeline(stages=[_assembler(columns), _forest(**{**SINGLE, **settings})])

    def fit(symbol: str):
        return symbol, fit_and_measure(pipeline, training.filter(F.col("symbol") == symbol))

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return dict(pool.map(fit, symbols))


def multi_pipeline(columns: Sequence[str], n_symbols: int, **settings) -> Pipeline:
    """Forest over all symbols; the symbol is a categorical feature with one bin each."""
    indexer = StringIndexer(inputCol="symbol", outputCol="symbol_index", handleInvalid="keep", stringOrderType="alphabetAsc")
    bins = max(32, n_symbols + 1)
    return Pipeline(
        stages=[indexer, _assembler(["symbol_index", *columns]), _forest(**{**MULTI, "maxBins": bins, **settings})]
    )


def predict_direction(model: PipelineModel, latest: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Expected direction of each symbol over each horizon from its latest complete row."""
    rows = latest.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    predicted = model.transform(rows)
    return predicted.select("symbol", "trade_date", "horizon", F.col("prediction").cast("int").alias("prediction"))


# --- comparison of classifiers -------------------------------------------------------


def nominal_label(df: DataFrame, column: str = "label") -> DataFrame:
    """Last column as a nominal class: an index with its text as metadata."""
    text = df.withColumn("label_text", F.col(column).cast("string"))
    indexer = StringIndexer(inputCol="label_text", outputCol="label_index", stringOrderType="alphabetAsc")
    return indexer.fit(text).transform(text).drop("label_text")


def _scaled(columns: Sequence[str], *rest) -> Pipeline:
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    raw = VectorAssembler(inputCols=list(columns), outputCol="raw", handleInvalid="skip")
    return Pipeline(stages=[raw, scaler, *rest])


def logistic(columns: Sequence[str]) -> Pipeline:
    return _scaled(columns, LogisticRegression(regParam=1e-8))


def deep_forest(columns: Sequence[str], trees: int = 100, depth: int = 30) -> Pipeline:
    return Pipeline(stages=[_assembler(columns), _forest(numTrees=trees, maxDepth=depth)])


class GrownForest(Pipeline):
    """The deep forest, measured by trees that tasks grow by themselves and not by a fit; ``fit`` is that of its stages."""

    def __init__(self, columns: Sequence[str], trees: int = 100, depth: int = 30):
        super().__init__(stages=deep_forest(columns, trees, depth).getStages())
        self.columns, self.trees, self.depth = list(columns), trees, depth

    def held_out_accuracy(self, rows: DataFrame) -> float | None:
        one = rows.withColumn("variant", F.lit("all"))
        found = shared_forests.held_out_accuracies(rows.sparkSession, one, {"all": self.columns}, trees=self.trees, depth=self.depth)
        return found.first().accuracy


def perceptron(columns: Sequence[str], rate: float, hidden: int, epochs: int = 500) -> Pipeline:
    layers = [len(columns), hidden, 2]
    return _scaled(
        columns, MultilayerPerceptronClassifier(layers=layers, solver="gd", stepSize=rate, maxIter=epochs, seed=SEED)
    )


def margin_machine(columns: Sequence[str], normalised: bool = False, iterations: int = 100, calibrated: bool = True) -> Pipeline:
    """Linear support vector machine with its margin calibrated by a logistic regression, or with the margin's side as prediction."""
    vector = "unit" if normalised else "features"
    stages = [Normalizer(p=2.0, inputCol="features", outputCol="unit")] if normalised else []
    machine = LinearSVC(
        featuresCol=vector, maxIter=iterations, rawPredictionCol="margin", predictionCol="side" if calibrated else "prediction", regParam=1e-4
    )
    if not calibrated:
        return _scaled(columns, *stages, machine)
    calibration = LogisticRegression(featuresCol="margin", rawPredictionCol="log_odds", probabilityCol="chance")
    return _scaled(columns, *stages, machine, calibration)


def chance_of_rise(predicted: DataFrame, column: str = "chance") -> DataFrame:
    return predicted.withColumn("rise", vector_to_array(column)[1])


def classifiers(columns: Sequence[str]) -> dict[str, Callable[[], Pipeline]]:
    """The classifiers to compare, by name."""
    grid: dict[str, Callable[[], Pipeline]] = {
        "logistic": lambda: logistic(columns),
        "random_forest": lambda: deep_forest(columns),
        "svm_linear": lambda: margin_machine(columns),
        "svm_normalised": lambda: margin_machine(columns, normalised=True),
        # labelled RBF in the blueprint, with the linear kernel and a calibrator that is no classifier
        "svm_labelled_rbf": lambda: margin_machine(columns, calibrated=False),
    }
    for rate in (0.1, 0.3):
        for hidden in (1, 3):
            grid[f"perceptron_{rate}_{hidden}"] = lambda r=rate, h=hidden: perceptron(columns, r, h)
    return grid


def held_out_accuracy(pipeline: Pipeline, rows: DataFrame) -> float | None:
    if isinstance(pipeline, GrownForest):
        return pipeline.held_out_accuracy(rows)
    split = split_rows(rows, TRAIN_SHARE, "symbol", "trade_date", "horizon")
    model = pipeline.fit(split.filter("part = 'train'"))
    return accuracy(model.transform(split.filter("part = 'test'")))


def held_out_accuracies(pipelines: dict[str, Callable[[], Pipeline]], rows: DataFrame) -> dict[str, float]:
    """Several classifiers on the same rows, a few fits at a time."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return dict(zip(pipelines, pool.map(lambda make: held_out_accuracy(make(), rows), pipelines.values())))


def experiment_grid(
    spark: SparkSession,
    variants: dict[str, tuple[DataFrame, Sequence[str]]],
    pipelines: dict[str, Callable[[Sequence[str]], Pipeline]],
    results: str,
    done: DataFrame | None = None,
) -> DataFrame:
    """Held-out accuracy of every classifier on every variant, appended to a results table.

    A variant is its rows and its own feature columns; pipelines are made from those columns. Pairs already in
    ``done`` are skipped, so an interrupted run goes on where it stopped. Fits run side by side, scores are
    written once.
    """
    schema = "variant string, classifier string, accuracy double"
    pairs = spark.createDataFrame([(v, c) for v in variants for c in pipelines], "variant string, classifier string")
    if done is not None:
        pairs = pairs.join(done, ["variant", "classifier"], "left_anti")

    def run(pair):
        rows, columns = variants[pair.variant]
        return pair.variant, pair.classifier, held_out_accuracy(pipelines[pair.classifier](columns), rows)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        scores = list(pool.map(run, pairs.collect()))
    spark.createDataFrame(scores, schema).write.mode("append").parquet(results)
    return spark.read.schema(schema).parquet(results)
