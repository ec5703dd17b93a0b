import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.operators import models as md
from tidemark.operators import shared_forests as forests
from tidemark.operators import shared_fits as shared

PLAIN = ft.feature_columns(indicators=False)
COLUMNS = {"v": PLAIN, "w": ["open", "close", "percent_change"]}


@pytest.fixture(scope="module")
def grid(spark, make_bars):
    wave = lambda k: [60 + 20 * math.sin(i / (4 + k)) for i in range(200)]
    rows = ft.training_set(make_bars({"A": wave(0), "B": wave(1)}), (1, 5), indicators=False)
    variants = F.explode(F.array(*map(F.lit, COLUMNS))).alias("variant")
    return rows.select("*", variants).repartition(5).cache()


def plain_rows(grid, variant):
    """Scaled training and held-out rows of a variant, in numpy."""
    rows = ft.split_rows(grid.filter(F.col("variant") == variant), 0.7, "symbol", "trade_date", "horizon").toPandas()
    x, y, train = rows[COLUMNS[variant]].to_numpy(float), rows["label"].to_numpy(float), (rows["part"] == "train").to_numpy()
    deviation = x[train].std(axis=0, ddof=1)
    x = (x - x[train].mean(axis=0)) * np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0)
    x = np.column_stack([x, np.ones(len(x))])
    return x[train], y[train], x[~train], y[~train]


def test_linear_machines_score_as_single_fits(spark, grid):
    fits = {k: v for k, v in shared.machines().items() if not k.startswith("perceptron")}
    got = {(r.variant, r.classifier): r.accuracy for r in shared.held_out_accuracies(spark, grid, COLUMNS, fits).collect()}
    assert len(got) == 8
    for variant, columns in COLUMNS.items():
        rows = grid.filter(F.col("variant") == variant)
        for name in ("logistic", "svm_linear", "svm_normalised") if variant == "w" else ("logistic",):
            assert got[variant, name] == pytest.approx(md.held_out_accuracy(md.classifiers(columns)[name](), rows), abs=0.02), (variant, name)


def test_perceptron_equals_a_loop_over_all_rows(spark, grid):
    fits = {"p": lambda width, rows: shared.perceptron(width, rows, 0.3, 3, epochs=15)}
    got = {r.variant: r.accuracy for r in shared.held_out_accuracies(spark, grid, COLUMNS, fits).collect()}
    for variant in COLUMNS:
        x, y, test_x, test_y = plain_rows(grid, variant)
        draw = np.random.default_rng(shared.SEED)
        first = draw.uniform(-2.4, 2.4, x.shape[1] * 3) / x.shape[1]
        first, second = first.reshape(-1, 3), (draw.uniform(-2.4, 2.4, 8) / 4).reshape(4, 2)

        def forward(rows):
            hidden = np.column_stack([1 / (1 + np.exp(-rows @ first)), np.ones(len(rows))])
            out = np.exp(hidden @ second)
            return hidden, out / out.sum(axis=1, keepdims=True)

        for epoch in range(1, 16):
            hidden, chance = forward(x)
            wrong = chance - np.column_stack([1 - y, y])
            back = wrong @ second[:3].T * hidden[:, :3] * (1 - hidden[:, :3])
            first = first - 0.3 / math.sqrt(epoch) * x.T @ back / len(y)
            second = second - 0.3 / math.sqrt(epoch) * hidden.T @ wrong / len(y)
        chance = forward(test_x)[1]
        assert got[variant] == pytest.approx(((chance[:, 1] > chance[:, 0]) == (test_y > 0.5)).mean())


@pytest.mark.parametrize("sums", [shared._logistic_sums, shared._hinge_sums, shared._perceptron_sums])
def test_gradients_follow_the_loss(sums):
    draw = np.random.default_rng(1)
    x, y = np.column_stack([draw.normal(size=(40, 3)), np.ones(40)]), (draw.random(40) < 0.5).astype(float)
    w = draw.normal(size=4 * 2 + 3 * 2 if sums is shared._perceptron_sums else 4)
    slope = sums(x, y, w)[1:]
    for i in range(len(w)):
        step = np.eye(len(w))[i] * 1e-6
        assert slope[i] == pytest.approx((sums(x, y, w + step)[0] - sums(x, y, w - step)[0]) / 2e-6, rel=1e-4, abs=1e-5)


def test_minimum_is_found():
    draw = np.random.default_rng(2)
    x, y = np.column_stack([draw.normal(size=(300, 4)), np.ones(300)]), (draw.random(300) < 0.4).astype(float)
    fit, answer = shared.minimised(None, 5, 300, tolerance=1e-12), None
    try:
        request = next(fit)
        while True:
            request = fit.send(shared._logistic_sums(x, y, request.weights))
    except StopIteration as end:
        answer = end.value
    assert np.abs(shared._logistic_sums(x, y, answer)[1:] / 300).max() < 1e-4


def test_odd_rows(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    schema = "variant string, symbol string, trade_date date, horizon int, label int, a double, flat double"
    good = [("v", "A", day(i), 1, i % 2, float(i % 2) + 0.1 * (i % 3), 7.0) for i in range(60)]
    bad = [("v", "A", day(100 + i), 1, None if i % 2 else 1, None if i % 3 else math.nan, 7.0) for i in range(12)]
    rows = spark.createDataFrame(good + bad + [("lonely", "A", day(0), 1, 1, None, 1.0)], schema)
    columns = {"v": ["a", "flat"], "lonely": ["a"], "missing": ["a"]}
    fits = {"logistic": shared.logistic}
    got = {r.variant: r.accuracy for r in shared.held_out_accuracies(spark, rows, columns, fits).collect()}
    assert got == {"v": 1.0, "lonely": None, "missing": None}
    none = shared.held_out_accuracies(spark, rows.filter("false"), columns, fits).collect()
    assert [r.accuracy for r in none] == [None] * 3
    counts = shared.row_counts(shared.blocks_of(spark, rows, columns), list(columns))
    assert sum(counts["v"]) == 60 and sum(counts.get("lonely", (0, 0))) == 0


def test_forest_learns_what_single_fits_learn(spark, grid, monkeypatch):
    found = {}
    for task_rows in (forests.TASK_ROWS, 1):
        monkeypatch.setattr(forests, "TASK_ROWS", task_rows)
        found = {r.variant: r for r in forests.held_out_accuracies(spark, grid, {**COLUMNS, "none": PLAIN}, trees=20, depth=8).collect()}
        assert found["none"].accuracy is None and found["v"].classifier == "random_forest"
        for variant, columns in COLUMNS.items():
            single = md.held_out_accuracy(md.deep_forest(columns, trees=20, depth=8), grid.filter(F.col("variant") == variant))
            assert found[variant].accuracy == pytest.approx(single, abs=0.06), variant
            grown = md.held_out_accuracy(md.GrownForest(columns, trees=20, depth=8), grid.filter(F.col("variant") == variant))
            assert grown == pytest.approx(single, abs=0.06), variant


def test_trees_of_a_forest_follow_the_labels():
    draw = np.random.default_rng(1)
    x = draw.integers(0, forests.BINS, (4000, 9)).astype(np.uint8)
    y = ((x[:, 0] > 15) ^ (x[:, 1] > 15)).astype(float)
    rise = forests.votes(x[:3000], y[:3000], x[3000:], range(20))
    assert ((rise > 10) == (y[3000:] > 0.5)).mean() > 0.9
    assert (forests.votes(x[:3000], y[:3000], x[3000:], range(20)) == rise).all()
    # leaves of full trees are pure, stumps at depth 0 vote by the drawn rows alone
    assert np.allclose(rise, rise.round())
    assert len(set(forests.votes(x[:3000], y[:3000], x[3000:], range(20), depth=0))) == 1
    assert forests.votes(x[:0], y[:0], x[3000:], range(4)).tolist() == [2.0] * 1000
