"""Indicators that go on from a stored state instead of from the first bar.

The state is one row per symbol: the last date, the number of bars so far, the closes that windows still look back
on, and the running values of the recurrences. ``advance`` reads the state and the bars after it, and nothing older;
its rows carry the state to store next. A symbol without state starts from its first bar, so the same call fills a
table from the beginning, after a day, or after a year, with the same values. Bars up to the stored date are left out:
a batch that comes again changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.series import ema_values, null_nan

STATE = "symbol string, last_date date, n_rows long, closes array<double>, averages array<double>, up double, down double, obv double"


@dataclass(frozen=True)
class Spec:
    """Periods of the moving averages, the exponential averages, and the strength index."""

    sma: tuple[int, ...] = (20,)
    ema: tuple[int, ...] = (20,)
    rsi: int = 14

    @property
    def columns(self) -> list[str]:
        return [*(f"sma{n}" for n in self.sma), *(f"ema{n}" for n in self.ema), "rsi", "obv"]

    @property
    def look_back(self) -> int:
        return max(*self.sma, *self.ema, self.rsi + 1)


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _continued(value: float | None, seed_row: int, before: int, seeds: np.ndarray, path: np.ndarray, alpha: float) -> np.ndarray:
    """An average over the rows of ``path``, of which ``before`` came earlier: from its stored value, or from the seed
    at ``seed_row`` (1-based) once that is reached."""
    if before >= seed_row:
        start = np.concatenate([[value], np.full(len(path), np.nan)])
        return ema_values(np.concatenate([[value], path]), start, alpha)[1:]
    at = seed_row - before - 1
    start = np.full(len(path), np.nan)
    start[at : at + 1] = seeds[at : at + 1]
    return ema_values(path, start, alpha)


def _window_means(values: np.ndarray, n: int, rows: int) -> np.ndarray:
    """Means over the last ``n`` of ``values`` at each of its last ``rows`` places; NaN where fewer are there."""
    out = np.full(rows, np.nan)
    if len(values) >= n:
        means = np.lib.stride_tricks.sliding_window_view(values, n).mean(axis=1)[-rows:]
        out[rows - len(means) :] = means
    return out


def advance(state: DataFrame, bars: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """(symbol, trade_date, the columns of ``spec``, state) of the bars after each symbol's state.

    ``state`` is null but in a symbol's last row. A group is one symbol's new bars, at most one a day. Hand in a table
    that is cut to the new dates already, as its scan then reads no older ones. Closes and volumes are not null.
    """
    schema = "symbol string, trade_date date, " + ", ".join(f"{c} double" for c in spec.columns)
    schema += f", state struct<{STATE.replace(' ', ':').replace(',:', ',')}>"

    def run(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        known = None if old.empty else old.iloc[0]
        new = new.sort_values("trade_date", kind="stable")
        if known is not None:
            new = new[new["trade_date"] > known["last_date"]]
        rows = len(new)
        out = pd.DataFrame({"symbol": new["symbol"].to_numpy(), "trade_date": new["trade_date"].to_numpy()})
        if not rows:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("symbol", "trade_date", *spec.columns, "state")})
        before = 0 if known is None else int(known["n_rows"])
        tail = np.zeros(0) if known is None else np.asarray(known["closes"], dtype=float)
        close, volume = new["close"].to_numpy(float), new["volume"].to_numpy(float)
        closes = np.concatenate([tail, close])
        for n in spec.sma:
            out[f"sma{n}"] = _window_means(closes, n, rows)
        for k, n in enumerate(spec.ema):
            stored = None if known is None else known["averages"][k]
            out[f"ema{n}"] = _continued(stored, n, before, _window_means(closes, n, rows), close, 2.0 / (n + 1))
        change = np.diff(closes, prepend=np.nan)
        gain, loss = np.maximum(change, 0.0), np.maximum(-change, 0.0)
        up, down = (
            _continued(None if known is None else known[c], spec.rsi + 1, before, _window_means(v[1:], spec.rsi, rows), v[-rows:], 1.0 / spec.rsi)
            for c, v in (("up", gain), ("down", loss))
        )
        with np.errstate(invalid="ignore", divide="ignore"):
            out["rsi"] = np.where(up + down == 0, 0.0, 100 * up / (up + down))
        moved = change[-rows:]
        step = np.where(np.isnan(moved) | (moved > 0), volume, np.where(moved < 0, -volume, 0.0))
        out["obv"] = (0.0 if known is None else float(known["obv"])) + np.cumsum(step)
        last = out.iloc[-1]
        stored = {
            "symbol": last["symbol"], "last_date": last["trade_date"], "n_rows": before + rows,
            "closes": closes[-spec.look_back :].tolist(), "averages": [float(last[f"ema{n}"]) for n in spec.ema],
            "up": float(up[-1]), "down": float(down[-1]), "obv": float(last["obv"]),
        }
        out["state"] = [*[None] * (rows - 1), stored]
        return out

    grouped = bars.select("symbol", "trade_date", "close", "volume").groupBy("symbol").cogroup(state.groupBy("symbol"))
    return null_nan(grouped.applyInPandas(run, schema), spec.columns)


def next_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The state after ``advance`` gave ``rows``, a written table: new states, and those of symbols without new bars."""
    new = rows.filter("state is not null").select("state.*")
    return new.unionByName(state.join(new.select("symbol"), "symbol", "left_anti"))
