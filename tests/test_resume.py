"""Indicators from stored state against the same indicators over all bars."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import resume
from tidemark.session import written

SPEC = resume.Spec(sma=(3, 5), ema=(4, 10), rsi=6)


def full(bars):
    table = ind.obv(ind.sma(ind.ema(bars, [4, 10]), [3, 5]))
    staged, specs = ind.rsi_inputs(table, 6)
    return ind.rsi_finish(ind.ema_scan(staged, specs))


@pytest.mark.parametrize("cuts", [[0], [2, 3, 9], [5, 6, 7, 30], [40]])
def test_steps_equal_the_full_run(spark, make_bars, cuts):
    rng = np.random.default_rng(4)
    bars = make_bars({s: (rng.integers(60, 90, n) / 4).tolist() for s, n in (("A", 50), ("B", 7), ("C", 1), ("D", 21))})
    bars = written(spark, bars.withColumn("volume", F.col("volume") + F.dayofmonth("trade_date")))
    state, found = resume.empty_state(spark), {}
    first = dt.date(2000, 1, 1)
    edges = [dt.date(1999, 1, 1), *(first + dt.timedelta(days=c) for c in cuts), dt.date(2100, 1, 1)]
    for start, end in zip(edges, edges[1:]):
        new = bars.filter((F.col("trade_date") > start) & (F.col("trade_date") <= end))
        rows = written(spark, resume.advance(state, new, SPEC))
        state = written(spark, resume.next_state(rows, state))
        # the same bars again, and none at all, give no rows and no other state
        assert resume.advance(state, new, SPEC).count() == 0 == resume.advance(state, bars.limit(0), SPEC).count()
        found |= {(r.symbol, r.trade_date): r for r in rows.collect()}
    want = {(r.symbol, r.trade_date): r for r in full(bars).collect()}
    assert found.keys() == want.keys()
    for key, r in want.items():
        for c in SPEC.columns:
            assert found[key][c] is None if r[c] is None else found[key][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9), (key, c)
    sizes = {r.symbol: (r.n_rows, len(r.closes)) for r in state.collect()}
    assert sizes == {"A": (50, 10), "B": (7, 7), "C": (1, 1), "D": (21, 10)}
