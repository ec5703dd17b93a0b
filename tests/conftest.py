import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    from compare import session
    from tidemark.session import prepare

    spark = session("8")
    yield prepare(spark)
    spark.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from closes: one symbol per key, consecutive days, high/low one above/below."""
    import datetime as dt

    def make(series, spread=1.0):
        rows = [
            (s, dt.date(2000, 1, 1) + dt.timedelta(days=i), c, c + spread, c - spread, c, 10.0)
            for s, closes in series.items()
            for i, c in enumerate(map(float, closes))
        ]
        schema = "symbol string, trade_date date, open double, high double, low double, close double, volume double"
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def column():
    """Values of one column in date order."""

    def values(df, name, symbol="A"):
        return [r[name] for r in df.filter(f"symbol = '{symbol}'").orderBy("trade_date").collect()]

    return values
