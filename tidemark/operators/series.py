"""Recurrences and running totals over ordered series.

Exponential averages are first-order recurrences ``y = y' + alpha * (x - y')``.
Spark has no window function whose value depends on the previous output, so
they run as grouped maps. Two layouts exist:

* ``ema_scan``: one group per symbol. For daily bars, where a symbol has at
  most one row per calendar day.
* ``chunked_ema`` / ``chunked_sum`` / ``chunked_lag``: groups are (symbol,
  chunk), the chunk being a time span. Only one summary row per chunk is
  ever ordered per symbol, so a hot symbol spreads over all its chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Ema:
    """``out`` starts at the first non-null ``seed`` and then follows ``value``."""

    out: str
    value: str
    seed: str
    alpha: float


@dataclass(frozen=True)
class Derived:
    """``out`` is computed from other columns of an ordered series, averages before it included."""

    out: str
    of: tuple[str, ...]
    fn: Callable[..., np.ndarray]


def mean_at(n: int, at: int) -> Callable[[np.ndarray], np.ndarray]:
    """A seed: the mean of the last ``n`` values at row ``at`` (1-based), NaN elsewhere; missing values do not count."""

    def seed(value: np.ndarray) -> np.ndarray:
        out = np.full(len(value), np.nan)
        window = value[max(0, at - n) : at]
        if len(value) >= at and not np.isnan(window).all():
            out[at - 1] = np.nanmean(window)
        return out

    return seed


def ema_values(value: np.ndarray, seed: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential average of one ordered series.

    NaN before the seed row; a missing value after it leaves the average unchanged.
    """
    out = np.full(len(value), np.nan)
    seeded = np.flatnonzero(~np.isnan(seed))
    if len(seeded):
        start = seeded[0]
        path = value[start:].copy()
        path[0] = seed[start]
        out[start:] = pd.Series(path).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()
    return out


def with_doubles(schema: T.StructType, names: Sequence[str]) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(n, T.DoubleType()) for n in names])


def ema_scan(df: DataFrame, specs: Sequence[Ema | Derived], by: str = "symbol", order: str = "trade_date") -> DataFrame:
    """Add every column of ``specs``, in their order, in a single pass per symbol.

    An average may follow a column derived from averages before it, so chains need no second pass and no exchange
    between. The group is one symbol's bars, so its size is the number of days. Input already partitioned by ``by``
    for window functions is not shuffled again.
    """
    schema = with_doubles(df.schema, [s.out for s in specs])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        made: dict[str, np.ndarray] = {}

        def series(name: str) -> np.ndarray:
            return made[name] if name in made else pdf[name].to_numpy(float)

        for s in specs:
            if isinstance(s, Ema):
                made[s.out] = ema_values(series(s.value), series(s.seed), s.alpha)
            else:
                made[s.out] = s.fn(*map(series, s.of))
        return pdf.assign(**made)

    return null_nan(df.groupBy(by).applyInPandas(scan, schema), [s.out for s in specs])


def null_nan(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast("double")) for n in names})


def chunk_of(ts: str, span: str) -> Column:
    """Chunk key of a timestamp: the day, hour, ... it falls in."""
    return F.date_trunc(span, F.col(ts))


def chunked_ema(
    df: DataFrame, value: str, out: str, alpha: float, chunk: str, order: str = "seq", by: str = "symbol",
    entering: DataFrame | None = None,
) -> DataFrame:
    """Exponential average started at the first value, parallel within a symbol.

    With ``entering``, a table of (``by``, ``entered``), a series found there goes on from that value instead.

    A chunk maps the value carried in, ``y``, to ``keep * y + gain``. Those
    pairs compose, so the value entering each chunk comes from the pairs
    alone, and every chunk then runs independently from its own start.
    """
    in_chunk = Window.partitionBy(by, chunk).orderBy(order)
    rest = Window.partitionBy(by, chunk).orderBy(F.col(order).desc())
    is_first = F.row_number().over(Window.partitionBy(by).orderBy(chunk)) == 1
    decay = F.lit(1.0 - alpha)
    # gain = sum(alpha * decay^(rows left) * value), by groups of (symbol, chunk)
    pairs = (
        df.select(by, chunk, order, value, (F.row_number().over(rest) - 1).alias("left_over"))
        .groupBy(by, chunk)
        .agg(
            F.sum(F.lit(alpha) * F.pow(decay, F.col("left_over")) * F.col(value)).alias("gain"),
            F.count(F.lit(1)).alias("n"),
            F.min_by(value, order).alias("first_value"),
        )
        .withColumn("keep", F.pow(decay, F.col("n")))
        .withColumn("is_first", is_first)
    )
    # The very first row carries itself in: y = v + alpha * (v - v).
    first = F.col("first_value")
    if entering is not None:
        pairs = pairs.join(entering.select(by, "entered"), by, "left")
        first = F.coalesce("entered", "first_value")
    pairs = pairs.withColumn("start", F.when(F.col("is_first"), first))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(chunk, kind="stable")
        entering, y = np.empty(len(pdf)), pdf["start"].iloc[0]
        for i, (keep, gain) in enumerate(zip(pdf["keep"], pdf["gain"])):
            entering[i] = y
            y = keep * y + gain
        return pdf[[by, chunk]].assign(carried=entering)

    starts = T.StructType([df.schema[by], df.schema[chunk], T.StructField("carried", T.DoubleType())])
    carried = pairs.groupBy(by).applyInPandas(carry, starts)
    schema = with_doubles(df.schema, [out])
    columns = df.columns

    def scan(rows: pd.DataFrame, entering: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        path = np.concatenate([[entering["carried"].iloc[0]], rows[value].to_numpy(float)])
        rows[out] = pd.Series(path).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
        return rows[columns + [out]]

    return df.groupBy(by, chunk).cogroup(carried.groupBy(by, chunk)).applyInPandas(scan, schema)


def chunked_lag(df: DataFrame, value: str, out: str, chunk: str, order: str = "seq", by: str = "symbol") -> DataFrame:
    """Previous value of the series, across chunk borders."""
    last = df.groupBy(by, chunk).agg(F.max_by(value, order).alias("last_value"))
    before = last.select(
        by, chunk, F.lag("last_value").over(Window.partitionBy(by).orderBy(chunk)).alias("before_chunk")
    )
    previous = F.lag(value).over(Window.partitionBy(by, chunk).orderBy(order))
    first = F.row_number().over(Window.partitionBy(by, chunk).orderBy(order)) == 1
    return (
        df.withColumn(out, F.when(~first, previous))
        .withColumn("is_first", first)
        .join(before, [by, chunk])
        .withColumn(out, F.when(F.col("is_first"), F.col("before_chunk")).otherwise(F.col(out)))
        .drop("is_first", "before_chunk")
    )


def chunked_sum(df: DataFrame, value: str, out: str, chunk: str, order: str = "seq", by: str = "symbol") -> DataFrame:
    """Running sum of the series: sum inside the chunk plus the chunks before."""
    totals = df.groupBy(by, chunk).agg(F.sum(value).alias("chunk_total"))
    earlier = Window.partitionBy(by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(by, chunk, F.coalesce(F.sum("chunk_total").over(earlier), F.lit(0.0)).alias("before"))
    inside = Window.partitionBy(by, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn(out, F.sum(value).over(inside))
        .join(before, [by, chunk])
        .withColumn(out, F.col(out) + F.col("before"))
        .drop("before")
    )
