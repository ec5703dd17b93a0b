import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import rows

WAVE = [50 + 10 * math.sin(i / 3) + (i % 7) for i in range(260)]


def warm_up(values):
    return next((i for i, v in enumerate(values) if v is not None), len(values))


@pytest.fixture(scope="module")
def wave(spark, make_bars):
    return ind.all_indicators(make_bars({"A": WAVE})).cache()


@pytest.mark.parametrize(
    "name, rows_",
    [("sma5", 4), ("sma200", 199), ("ema10", 9), ("ema200", 199), ("macd", 33), ("macd_sig", 33), ("macd_hist", 33),
     ("rsi", 14), ("adx10", 19), ("cci", 13), ("ad", 0), ("obv", 0), ("slow_k", 8), ("slow_d", 8), ("willr", 13)],
)
def test_warm_up(wave, column, name, rows_):
    values = column(wave, name)
    assert warm_up(values) == rows_
    assert all(v is not None for v in values[rows_:])


def test_bounds(wave):
    low, high = wave.agg(F.min("rsi"), F.max("rsi")).head()
    assert 0 <= low <= high <= 100
    low, high = wave.agg(F.min("slow_k"), F.max("slow_d")).head()
    assert 0 <= low and high <= 100
    low, high = wave.agg(F.min("willr"), F.max("willr")).head()
    assert -100 <= low <= high <= 0


def test_sequential_definitions(make_bars, column):
    bars = make_bars({"A": WAVE})
    ema = column(ind.ema(bars, [10]), "ema10")
    y = sum(WAVE[:10]) / 10
    for i in range(10, len(WAVE)):
        y += 2 / 11 * (WAVE[i] - y)
        assert ema[i] == pytest.approx(y)
    gain = loss = 0.0
    rsi = column(ind.rsi(bars), "rsi")
    for i in range(1, 15):
        d = WAVE[i] - WAVE[i - 1]
        gain, loss = gain + max(d, 0) / 14, loss + max(-d, 0) / 14
    assert rsi[14] == pytest.approx(100 * gain / (gain + loss))
    s = WAVE[0]
    smooth = column(ind.smooth(bars), "smoothed_close")
    for i in range(1, len(WAVE)):
        s = 0.1 * WAVE[i] + 0.9 * s
        assert smooth[i] == pytest.approx(s)


def test_flat_series_and_zero_range(make_bars, column):
    table = ind.all_indicators(make_bars({"A": [5] * 40}, spread=0))
    assert set(column(table, "sma5")[4:]) == {5.0}
    for name, start in (("rsi", 14), ("cci", 13), ("slow_k", 8), ("willr", 13), ("adx10", 19), ("macd", 33), ("ad", 0)):
        assert set(column(table, name)[start:]) == {0.0}, name


def test_rising_and_falling(make_bars, column):
    table = ind.all_indicators(make_bars({"A": range(1, 41), "B": range(41, 1, -1)}))
    assert set(column(table, "rsi")[14:]) == {100.0}
    assert set(column(table, "rsi", "B")[14:]) == {0.0}
    assert column(table, "obv")[-1] == 400.0 and column(table, "obv", "B")[-1] == 10.0 - 390.0
    assert column(table, "adx10")[-1] == pytest.approx(100.0)


@pytest.mark.parametrize("n", [1, 19, 20, 33, 34, 200, 201])
def test_short_series(make_bars, column, n):
    table = ind.all_indicators(make_bars({"A": WAVE[:n]}))
    for name, start in (("adx10", 19), ("macd_sig", 33), ("sma200", 199)):
        assert warm_up(column(table, name)) == min(start, n)


def test_average_ignores_days_without_movement(make_bars, column):
    moving = [100 + 3 * (i % 5) for i in range(30)]
    adx = column(ind.adx(make_bars({"A": moving + [moving[-1]] * 200}, spread=0)), "adx10")
    assert adx[-1] is not None and adx[-1] >= 0


def test_labels_drop_the_tail(make_bars):
    labels = ind.direction_labels(make_bars({"A": [1, 2, 2, 1]}), [1, 2])
    got = {(r.horizon, r.trade_date.day): r.label for r in labels.collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 0, (2, 1): 1, (2, 2): 0}


def test_percent_change_and_returns(make_bars, column):
    bars = make_bars({"A": [10, 15, 12]})
    assert column(ind.percent_change(bars), "percent_change") == [0.0, 0.5, -0.2]
    assert column(ind.log_returns(bars, 2), "log_return") == pytest.approx([math.log(1.2)])


def test_incremental_equals_full(make_bars):
    bars = make_bars({"A": WAVE, "B": WAVE[:30]})
    full = ind.sma(bars, [20])
    stored = full.withColumn("sma20", F.expr("if(symbol = 'A' and trade_date < '2000-05-01', sma20, null)"))
    filled = ind.incremental_fill(bars, stored, "sma20", lambda b: ind.sma(b, [20]), 20)
    want = full.filter("sma20 is not null and not (symbol = 'A' and trade_date < '2000-05-01')")
    assert sorted(filled.collect()) == sorted(want.select("symbol", "trade_date", "sma20").collect())


def test_calendar_and_newest(make_bars):
    bars = make_bars({"A": [1, 2, 3, 4], "B": [5, 6, 7]}).filter("not (symbol = 'B' and close = 6)")
    assert [r.trade_date.day for r in rows.common_calendar(bars).orderBy("trade_date").collect()] == [1, 3]
    assert {r.symbol: r.close for r in rows.latest_price(bars, "trade_date").collect()} == {"A": 4.0, "B": 7.0}
    assert rows.last_n(bars, 2).filter("symbol = 'A'").count() == 2
    change = {r.symbol: r.previous for r in rows.price_change(bars, "2000-01-03").collect()}
    assert change == {"A": 2.0, "B": 5.0}


def test_zero_closes_do_not_end_the_job(make_bars, column):
    bars = make_bars({"A": [1, 0, 2, 4]})
    assert column(ind.percent_change(bars), "percent_change") == [0.0, -1.0, 0.0, 1.0]
    assert ind.log_returns(bars).count() == 1
