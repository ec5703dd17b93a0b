import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import series


@pytest.fixture(scope="module")
def ticks(spark):
    """One symbol holds most rows; chunks are of very different size."""
    rng = random.Random(3)
    data, moment = [], dt.datetime(2024, 1, 1)
    for i in range(3000):
        moment += dt.timedelta(seconds=rng.choice([1, 5, 4000]))
        data.append(("HOT" if i % 10 else "COLD", moment, i, float(rng.randint(1, 500))))
    df = spark.createDataFrame(data, "symbol string, ts timestamp, seq long, price double")
    return df.withColumn("day", series.chunk_of("ts", "day")).cache()


def test_chunked_average_equals_plain_scan(ticks):
    got = {(r.symbol, r.seq): r.ema for r in series.chunked_ema(ticks, "price", "ema", 0.05, "day").collect()}
    state = {}
    for r in ticks.orderBy("seq").collect():
        y = state.get(r.symbol, r.price)
        state[r.symbol] = y + 0.05 * (r.price - y)
        assert got[r.symbol, r.seq] == pytest.approx(state[r.symbol])
    assert len(got) == 3000


def test_chunked_lag_and_sum_equal_windows(ticks):
    w = Window.partitionBy("symbol").orderBy("seq")
    want = ticks.withColumn("p", F.lag("price").over(w)).withColumn("total", F.sum("price").over(w))
    got = series.chunked_sum(series.chunked_lag(ticks, "price", "p", "day"), "price", "total", "day")
    columns = ["symbol", "seq", "p", "total"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
