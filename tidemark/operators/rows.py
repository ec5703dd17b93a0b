"""Row filters, calendars and newest-row selections over bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zero_fill(df: DataFrame) -> DataFrame:
    return df.fillna(0)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def valid_prices(df: DataFrame, price: str = "close") -> DataFrame:
    return df.filter(F.col(price).isNotNull() & (F.col(price) != 0))


def date_range(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def latest_price(df: DataFrame, order: str = "ts", price: str = "close") -> DataFrame:
    """Newest price per symbol, without sorting the symbol's rows."""
    return df.groupBy("symbol").agg(F.max_by(price, order).alias(price))


def newest_first():
    return Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())


def last_n(bars: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` rows per symbol; Spark keeps only ``n`` per symbol before the shuffle."""
    return bars.withColumn("back", F.row_number().over(newest_first())).filter(F.col("back") <= n).drop("back")


def latest_features(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    return last_n(complete_rows(features, columns), 1)


def holdout_split(bars: DataFrame, test_rows: int) -> DataFrame:
    """Marks the newest ``test_rows`` rows of each symbol as test, the older ones as training."""
    back = F.row_number().over(newest_first())
    return bars.withColumn("split", F.when(back <= test_rows, "test").otherwise("train"))


def calendar_mismatch(split: DataFrame, reference_symbol: str) -> DataFrame:
    """Symbols whose first test date is not the reference symbol's."""
    first = split.filter("split = 'test'").groupBy("symbol").agg(F.min("trade_date").alias("first_test"))
    reference = first.filter(F.col("symbol") == reference_symbol).select("first_test")
    return first.join(reference, "first_test", "left_anti").select("symbol", "first_test")


def common_calendar(bars: DataFrame) -> DataFrame:
    """Dates on which every symbol has a bar, relying on one bar per symbol and date."""
    symbols = bars.select("symbol").distinct().agg(F.count(F.lit(1))).scalar()
    per_date = bars.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    return per_date.filter(F.col("n") == symbols).select("trade_date")


def on_common_calendar(bars: DataFrame) -> DataFrame:
    return bars.join(common_calendar(bars), "trade_date", "left_semi")


def price_change(bars: DataFrame, today) -> DataFrame:
    """Latest close against the last close before ``today``; null where one is missing."""
    is_before = F.col("trade_date") < F.lit(today).cast("date")
    return (
        bars.groupBy("symbol")
        .agg(
            F.max_by("close", "trade_date").alias("latest"),
            F.max_by("close", F.when(is_before, F.col("trade_date"))).alias("previous"),
        )
        .select(
            "symbol",
            "latest",
            "previous",
            (F.col("latest") - F.col("previous")).alias("change"),
            (F.try_divide(F.col("latest") - F.col("previous"), F.col("previous")) * 100).alias("change_pct"),
            F.signum(F.col("latest") - F.col("previous")).cast("int").alias("direction"),
        )
    )


def intraday_series(minutes: DataFrame, today) -> DataFrame:
    """Closes of ``today``, or of the trading day before it, indexed up to 0.

    The day before a Monday is Friday, before a Sunday too. A symbol's day has
    at most one row per minute.
    """
    today = F.lit(today).cast("date")
    weekday = F.dayofweek(today)
    back = F.when(weekday == 2, 3).when(weekday == 1, 2).otherwise(1)
    day = F.to_date("ts")
    recent = minutes.filter((day == today) | (day == F.date_sub(today, back.cast("int")))).withColumn("day", day)
    shown = recent.groupBy("symbol").agg(F.max("day").alias("day"))
    in_day = Window.partitionBy("symbol")
    index = F.row_number().over(in_day.orderBy("ts")) - F.count(F.lit(1)).over(in_day)
    return recent.join(shown, ["symbol", "day"], "left_semi").select("symbol", "ts", "close", index.alias("position"))
