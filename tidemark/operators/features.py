"""Labelled feature sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators.portfolio import hash_uniform
from tidemark.operators.series import Ema, ema_scan

# Fixed order of the feature columns; optional ones are left out where not asked for.
BASE = ("open", "high", "low", "close", "volume", "percent_change")
ALPHAS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def feature_columns(
    smoothed: bool = False, indicators: bool = True, sentiment: bool = False, symbol: bool = False, horizon: bool = True
) -> list[str]:
    names = ["symbol_index"] if symbol else []
    names += ["horizon"] if horizon else []
    names += list(BASE) + (["smoothed_close"] if smoothed else [])
    names += list(ind.INDICATORS) if indicators else []
    return names + (["sentiment"] if sentiment else [])


def features(bars: DataFrame, alpha: float = 1.0, indicators: bool = True, sentiment: DataFrame | None = None) -> DataFrame:
    """Feature columns per symbol and date; ``alpha`` below 1 smooths the price they are built on.

    ``sentiment`` has rows (symbol, trade_date, sentiment); days without one
    count as neutral.
    """
    table = ind.percent_change(bars)
    price = "close"
    if alpha != 1.0:
        table, price = ind.smooth(table, alpha=alpha), "smoothed_close"
    if indicators:
        table = ind.all_indicators(table, price)
    if sentiment is not None:
        table = table.join(sentiment.select("symbol", "trade_date", "sentiment"), ["symbol", "trade_date"], "left")
        table = table.withColumn("sentiment", F.coalesce("sentiment", F.lit(0.5)))
    return table


def training_set(
    bars: DataFrame,
    horizons: Sequence[int],
    alpha: float = 1.0,
    indicators: bool = True,
    sentiment: DataFrame | None = None,
    ignore_null: bool = True,
) -> DataFrame:
    """Features times horizons with the direction label; rows with gaps are dropped or filled with 0."""
    table = features(bars, alpha, indicators, sentiment)
    price = "close" if alpha == 1.0 else "smoothed_close"
    names = feature_columns(alpha != 1.0, indicators, sentiment is not None)
    labelled = ind.direction_labels(table, horizons, price).select("symbol", "trade_date", *names, "label")
    return labelled.dropna(subset=names) if ignore_null else labelled.fillna(0, subset=names)


def variant_grid(
    bars: DataFrame, horizons: Sequence[int], alphas: Sequence[float] = ALPHAS, sentiment: DataFrame | None = None
) -> DataFrame:
    """Training rows of all variants: raw and smoothed prices, with and without indicators.

    Every smoothing runs in one scan; each (symbol, alpha) then is a series of
    its own, so the grid is a single job whose parallelism grows with it.
    ``variant`` names the column set a row belongs to; columns outside it are
    null.
    """
    specs = [Ema(f"alpha{i}_", "close", "first_", a) for i, a in enumerate(alphas)]
    staged = ind.percent_change(bars).withColumn("first_", F.when(ind.row() == 1, F.col("close")))
    names = [c for c in staged.columns if c not in ("symbol", "first_")]
    prices = F.array(
        F.struct(F.lit(1.0).alias("alpha"), F.col("close").alias("smoothed_close")),
        *[F.struct(F.lit(a).alias("alpha"), F.col(s.out).alias("smoothed_close")) for a, s in zip(alphas, specs)],
    )
    exploded = ema_scan(staged, specs).select(F.col("symbol").alias("name"), *names, F.inline(prices))
    exploded = exploded.withColumn("symbol", F.concat_ws("|", "name", "alpha"))
    table = ind.all_indicators(exploded, "smoothed_close")
    kept = ["name", "alpha"]
    if sentiment is not None:
        table = table.join(
            sentiment.select(F.col("symbol").alias("name"), "trade_date", "sentiment"), ["name", "trade_date"], "left"
        ).withColumn("sentiment", F.coalesce("sentiment", F.lit(0.5)))
    labelled = ind.direction_labels(table, horizons, "smoothed_close")
    sets = [(i, s) for i in (False, True) for s in ((False, True) if sentiment is not None else (False,))]
    flags = F.array(*[F.struct(F.lit(i).alias("indicators"), F.lit(s).alias("with_sentiment")) for i, s in sets])
    grid = labelled.select("*", F.inline(flags))
    complete = F.lit(True)
    for c in ind.INDICATORS:
        complete = complete & F.col(c).isNotNull()
    grid = grid.filter(~F.col("indicators") | complete)
    outside = {c: F.when(F.col("indicators"), F.col(c)) for c in ind.INDICATORS}
    if sentiment is not None:
        outside["sentiment"] = F.when(F.col("with_sentiment"), F.col("sentiment"))
    columns = [*kept, "trade_date", *feature_columns(True, True, sentiment is not None), "label", "indicators"]
    variant = F.concat_ws(
        "_", F.lit("a"), F.col("alpha"), F.when(F.col("indicators"), "ind"), F.when(F.col("with_sentiment"), "sent")
    )
    return grid.withColumns(outside).select(*columns, "with_sentiment", variant.alias("variant")).withColumnRenamed(
        "name", "symbol"
    )


def split_rows(df: DataFrame, share: float, *key: str) -> DataFrame:
    """Repeatable random split by the row's key: ``part`` is train or test."""
    return df.withColumn("part", F.when(hash_uniform(*[F.col(k) for k in key]) < share, "train").otherwise("test"))


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and nulls per feature column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs: list[Column] = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("nulls")) for c in columns]
    return counts.select("rows", F.inline(F.array(*pairs)))


def model_accuracy(predictions: DataFrame) -> DataFrame:
    """Share of right predictions per symbol from rows (symbol, prediction, label)."""
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return predictions.groupBy("symbol").agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("rows"))
