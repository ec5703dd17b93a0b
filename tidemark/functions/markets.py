"""Opening hours of stock markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Market, time zone, opening, closing, start and end of the lunch break.
MARKETS = (
    ("NASDAQ", "America/New_York", "09:30", "16:00", None, None),
    ("London SE", "Europe/London", "08:00", "16:30", None, None),
    ("Euronext", "CET", "09:00", "17:30", None, None),
    ("Japan Exchange Group", "Asia/Tokyo", "09:00", "15:00", "11:30", "12:30"),
    ("Hong Kong SE", "Asia/Hong_Kong", "09:30", "16:00", "12:00", "13:00"),
    ("Korea Exchange", "Asia/Tokyo", "09:00", "15:30", None, None),
    ("Australia SX", "Australia/Canberra", "09:50", "16:12", None, None),
    ("Deutsche Börse", "CET", "08:00", "22:00", None, None),
    ("SIX Swiss Exchange", "CET", "09:00", "17:30", None, None),
    ("Bombay SE", "Asia/Calcutta", "09:15", "15:30", None, None),
    ("JSE Limited", "Africa/Johannesburg", "09:00", "17:00", None, None),
    ("TMX Group", "America/New_York", "09:30", "16:00", None, None),
    ("Taiwan SE", "Asia/Hong_Kong", "09:00", "13:30", None, None),
)


def market_status(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row per input row and market: OPEN, CLOSED or BREAK, by the market's own clock."""
    hours = F.array(
        *[
            F.struct(
                F.lit(name).alias("market"),
                F.from_utc_timestamp(F.col(ts), zone).alias("local"),
                *[F.lit(v).cast("string").alias(n) for n, v in zip(("opens", "closes", "rests", "resumes"), times)],
            )
            for name, zone, *times in MARKETS
        ]
    )
    return (
        df.select(*df.columns, F.inline(hours))
        .withColumn("status", _status())
        .drop("local", "opens", "closes", "rests", "resumes")
    )


def _status() -> Column:
    # Seconds and fractions count: a market is closed right after its closing time.
    clock = F.date_format("local", "HH:mm:ss.SSSSSS")
    at = lambda name: F.concat(F.col(name), F.lit(":00.000000"))
    weekend = F.dayofweek("local").isin(1, 7)
    return (
        F.when(weekend | (clock < at("opens")) | (clock > at("closes")), "CLOSED")
        .when((clock >= at("rests")) & (clock < at("resumes")), "BREAK")
        .otherwise("OPEN")
    )


def trading_window(df: DataFrame, ts: str = "ts", start_hour: int = 14, end_hour: int = 21) -> DataFrame:
    return df.filter((F.hour(ts) >= start_hour) & (F.hour(ts) < end_hour))
