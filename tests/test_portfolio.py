import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.operators import portfolio as pf


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(1)
    data = [(f"S{s}", dt.date(2000, 1, 1) + dt.timedelta(days=d), float(rng.normal())) for s in range(7) for d in range(30)]
    return spark.createDataFrame(data, "symbol string, trade_date date, log_return double").cache()


@pytest.mark.parametrize("blocks", [1, 3, 8])
def test_covariance(returns, blocks):
    got = {(r.symbol_i, r.symbol_j): r.cov for r in pf.covariance_matrix(pf.return_vectors(returns), blocks).collect()}
    x = returns.toPandas().pivot(index="symbol", columns="trade_date", values="log_return").to_numpy()
    assert len(got) == 49
    for (i, j), cov in got.items():
        assert cov == pytest.approx(np.cov(x)[int(i[1]), int(j[1])])


def test_rolling_ends_at_full_covariance(returns):
    vectors = pf.return_vectors(returns)
    full = {(r.symbol_i, r.symbol_j): r.cov for r in pf.covariance_matrix(vectors).collect()}
    rolled = pf.rolling_calibration(vectors, 30, 3).collect()
    assert len(rolled) == 28
    for r in rolled:
        assert r.cov == pytest.approx(full[r.symbol_i, r.symbol_j])


@pytest.mark.parametrize("names", [10, 101, 2001])
def test_risk_of_unknown_symbols(spark, names):
    cov = spark.range(names).selectExpr("concat('S', id) AS symbol_i", "concat('S', id) AS symbol_j", "1.0D AS cov")
    weights = spark.createDataFrame([(1, "S1", 0.5), (1, "unknown", 0.5)], "portfolio_id long, symbol string, weight double")
    assert [r.risk for r in pf.portfolio_risk(weights, cov).collect()] == [0.25]


def test_weights(spark):
    ids = spark.range(100).withColumnRenamed("id", "portfolio_id")
    weights = pf.candidate_portfolios(ids, ["A", "B", "C"])
    moved = pf.perturb(weights, 1.0)
    for df in (weights, moved.filter("weight is not null")):
        assert df.filter("weight < 0").count() == 0
        assert pf.weights_valid(df).filter("not valid").count() == 0
    equal = pf.equal_weights(weights.drop("weight"))
    assert equal.select("weight").distinct().collect() == [(pytest.approx(1 / 3),)]


def test_cost_counts_both_directions(spark):
    schema = "portfolio_id int, symbol string, weight double"
    now = spark.createDataFrame([(0, "A", 1.0)], schema)
    new = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5)], schema)
    prices = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "symbol string, close double")
    assert pf.transaction_cost(now, new, prices).head().cost == pytest.approx(0.5 * 1 + 0.5 * 2)


def test_backtest_rolls_lots(spark):
    closes, signal = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0], [1, 1, 1, 0, 0, 1]
    data = [("A", dt.date(2000, 1, 1 + i), c, 2, s) for i, (c, s) in enumerate(zip(closes, signal))]
    df = spark.createDataFrame(data, "symbol string, trade_date date, close double, horizon int, signal int")
    got = {r.trade_date.day: (r.exit_date.day if r.exit_date else None, r.gross_return) for r in ledger.signal_backtest(df).collect()}
    assert got == {1: (5, 15.0), 2: (4, 3.0), 3: (5, 3.0), 6: (None, None)}


def test_proposals_skip_what_cash_cannot_pay(spark):
    portfolio = spark.createDataFrame([("A", 100.0, 0.0), ("B", 60.0, 0.0), ("C", 5.0, 0.0)], "symbol string, allocation double, investment double")
    rising = spark.createDataFrame([("A", 1, 1), ("B", 1, 1), ("B", 30, 1), ("C", 1, 1), ("A", 30, 0)], "symbol string, horizon int, prediction int")
    prices = spark.createDataFrame([("A", 10.0), ("B", 10.0), ("C", 10.0)], "symbol string, close double")
    got = {(r.symbol, r.horizon): r.quantity for r in ledger.trade_proposals(portfolio, rising, prices, F.lit(70.0)).collect()}
    assert got == {("B", 1): 3, ("B", 30): 3}


@pytest.mark.parametrize("seed", range(4))
def test_walk_equals_paying_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [(f"S{i}", rng.choice([1, 30, 200]), float(rng.choice([50, 50, 50, rng.randrange(100)])), rng.choice([1.0, 7.5, 40.0, 500.0, rng.randrange(1, 900) / 4])) for i in range(700)]
    wanted = spark.createDataFrame(rows, "symbol string, horizon int, allocation double, value double")
    left, want = 3000.0 * 3**seed, set()
    for symbol, horizon, _, value in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if value <= left:
            left -= value
            want.add((symbol, horizon))
    got = ledger.take_while_affordable(wanted, 3000.0 * 3**seed, "allocation", ("symbol", "horizon"), ranges=4).collect()
    assert len(got) == len(want) and {(r.symbol, r.horizon) for r in got} == want
    assert ledger.take_while_affordable(wanted, 0.1, "allocation", ("symbol", "horizon")).count() == 0
    assert ledger.take_while_affordable(wanted.limit(0), 10.0, "allocation", ("symbol", "horizon")).count() == 0


def test_balance_and_worth(spark):
    trades = spark.createDataFrame([("A", "BUY", 10.0, 5.0), ("A", "SELL", 20.005, 2.0)], "symbol string, type string, price double, volume double")
    prices = spark.createDataFrame([("A", 7.0)], "symbol string, close double")
    row = ledger.total_worth(trades, prices).head()
    assert (row.balance, row.stock_worth) == (9990.01, 21.0)
