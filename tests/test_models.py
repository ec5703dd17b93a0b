import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.operators import models as md
from tidemark.operators import rows
from tidemark.sources import exports, registry

HORIZONS = (1, 5)


@pytest.fixture(scope="module")
def training(spark, make_bars):
    wave = lambda k: [60 + 20 * math.sin(i / (4 + k)) for i in range(150)]
    return ft.training_set(make_bars({"A": wave(0), "B": wave(1)}), HORIZONS, indicators=False).cache()


COLUMNS = ft.feature_columns(indicators=False)


def test_feature_order_and_width():
    assert len(ft.feature_columns(True, True, True)) == 28
    assert len(ft.feature_columns(True, True, True, symbol=True)) == 29
    assert ft.feature_columns()[:4] == ["horizon", "open", "high", "low"]


def test_gaps_are_dropped_or_filled(make_bars):
    bars = make_bars({"A": range(1, 31)})
    dropped = ft.training_set(bars, [1])
    assert dropped.count() == 0
    filled = ft.training_set(bars, [1], ignore_null=False)
    assert filled.count() == 29 and filled.filter("sma200 <> 0").count() == 0


def test_variants(make_bars):
    grid = ft.variant_grid(make_bars({"A": range(1, 41)}), [1], alphas=(0.1, 0.5))
    counts = {(r.alpha, r.indicators): r["count"] for r in grid.groupBy("alpha", "indicators").count().collect()}
    assert counts == {(1.0, False): 39, (0.1, False): 39, (0.5, False): 39}


def test_all_variants_are_written(spark):
    from tidemark.plans import models as plans

    grid = plans.written_variants(spark, "/root/testdata/sf0.001")
    found = {(r.variant, r.alpha, r.indicators, r.with_sentiment) for r in grid.select("variant", "alpha", "indicators", "with_sentiment").distinct().collect()}
    assert len(found) == 40 and len({v for v, *_ in found}) == 40
    with_mood = grid.filter("with_sentiment")
    assert with_mood.filter("sentiment is null").count() == 0 and grid.filter("not with_sentiment and sentiment is not null").count() == 0
    assert with_mood.select("sentiment").distinct().count() > 10


def test_predictions_use_sentiment(spark, monkeypatch):
    from tidemark.plans import models as plans

    seen = []
    small = md.multi_pipeline
    monkeypatch.setattr(md, "multi_pipeline", lambda columns, n: seen.append(columns) or small(columns, n, numTrees=2, maxDepth=3))
    got = plans.predict_direction(spark, "/root/testdata/sf0.001").collect()
    assert "sentiment" in seen[0]
    assert len(got) == len({(r.symbol, r.horizon) for r in got}) > 0


def test_forest_per_symbol_and_registry(spark, training, tmp_path):
    fitted = md.forest_per_symbol(training, COLUMNS, ["A", "B"], numTrees=5, maxDepth=6)
    assert set(fitted) == {"A", "B"} and all(score > 0.6 for score, _ in fitted.values())
    path = str(tmp_path / "registry")
    row = {"scope": "A", "type": "SINGLE", "model_number": 1, "accuracy": fitted["A"][0], "path": str(tmp_path / "a1")}
    registry.register(spark, path, fitted["A"][1], row)
    model = registry.load_latest(spark, path, "A", "SINGLE")
    rows_ = training.filter("symbol = 'A'")
    assert md.accuracy(model.transform(rows_)) == pytest.approx(md.accuracy(fitted["A"][1].transform(rows_)))


def test_multi_forest_predicts_every_horizon(training, make_bars):
    model = md.multi_pipeline(COLUMNS, 2, numTrees=5, maxDepth=5).fit(training)
    newest = rows.last_n(training.drop("horizon", "label").distinct(), 1)
    got = md.predict_direction(model, newest, HORIZONS).collect()
    assert sorted((r.symbol, r.horizon) for r in got) == [("A", 1), ("A", 5), ("B", 1), ("B", 5)]
    assert {r.prediction for r in got} <= {0, 1}


def test_classifiers_and_grid_resume(spark, training, tmp_path):
    small = {
        "logistic": md.logistic,
        "svm": lambda columns: md.margin_machine(columns, normalised=True, iterations=5),
        "perceptron": lambda columns: md.perceptron(columns, 0.3, 3, epochs=5),
        "forest": lambda columns: md.deep_forest(columns, trees=2, depth=4),
    }
    results = str(tmp_path / "results")
    first = md.experiment_grid(spark, {"v": (training, COLUMNS)}, {"logistic": small["logistic"]}, results)
    assert first.count() == 1
    done = first.select("variant", "classifier").cache()
    table = md.experiment_grid(spark, {"v": (training, COLUMNS)}, small, results, done)
    assert sorted(r.classifier for r in table.collect()) == sorted(small)
    assert table.filter("accuracy between 0 and 1").count() == 4


def test_experiments_cover_all_variants_and_classifiers(spark, monkeypatch):
    from tidemark.plans import models as plans

    grid = plans.written_variants(spark, "/root/testdata/sf0.001").filter("symbol = 'ASIA'").cache()
    monkeypatch.setattr(plans, "written_variants", lambda *_: grid)
    machines = plans.shared.machines
    monkeypatch.setattr(plans.shared, "machines", lambda: machines(epochs=2))
    fitted = {}

    def accuracy(pipeline, rows):
        found = rows.select("variant").distinct().collect()
        assembled = next(s for s in pipeline.getStages() if s.hasParam("inputCols")).getInputCols()
        assert len(found) == 1 and rows.select(assembled).dropna().count() == rows.count()
        fitted.setdefault(found[0].variant, []).append(len(assembled))
        return 0.5

    monkeypatch.setattr(md, "held_out_accuracy", accuracy)
    got = plans.experiment_grid(spark, "/root/testdata/sf0.001").collect()
    assert len({(r.variant, r.classifier) for r in got}) == len(got) == 40 * 9
    assert {v: {len(c)} for v, (_, c) in plans.variant_tables(grid).items()} == {v: set(n) for v, n in fitted.items()}


def test_third_margin_machine(training):
    names = [n for n in md.classifiers(COLUMNS) if n.startswith("svm")]
    assert len(names) == 3
    assert 0 <= md.held_out_accuracy(md.margin_machine(COLUMNS, iterations=5, calibrated=False), training) <= 1


def test_text_exports_round_trip(spark, training, tmp_path):
    path = str(tmp_path / "t.svm")
    exports.export_libsvm(training, path, COLUMNS)
    assert exports.load_libsvm(spark, path, len(COLUMNS)).count() == training.count()
    exports.export_csv(training, str(tmp_path / "t.csv"))
    back = spark.read.schema(training.schema).option("header", True).csv(str(tmp_path / "t.csv"))
    assert sorted(back.collect()) == sorted(training.collect())


def test_split_is_repeatable(training):
    key = ("symbol", "trade_date", "horizon")
    split = ft.split_rows(training, 0.7, *key)
    share = split.agg(F.avg((F.col("part") == "train").cast("double"))).head()[0]
    assert 0.6 < share < 0.8
    assert sorted(split.collect()) == sorted(ft.split_rows(training.repartition(3), 0.7, *key).collect())
