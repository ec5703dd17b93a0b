"""Price files: parsing, merging into stored bars, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.text import bound, fields_of, is_number

OHLCV = ("open", "high", "low", "close", "volume")


def _last_line_wins(rows: DataFrame, key: str) -> DataFrame:
    """One row per symbol and key, combined before the shuffle."""
    return rows.groupBy("symbol", key).agg(*[F.max_by(c, "line_no").alias(c) for c in OHLCV])


def _numbers(first: int, names=OHLCV) -> dict[str, Column]:
    return {c: F.get("f", F.lit(first + i)).try_cast("double") for i, c in enumerate(names)}


def _readable() -> Column:
    """All prices and the volume of a line are numbers."""
    return F.concat(*[F.col(c).cast("string") for c in OHLCV]).isNotNull()


def parse_daily(lines: DataFrame) -> DataFrame:
    """``date[ time],open,high,low,close,volume``; headers, short lines and lines with a field that is no number are dropped."""
    split = bound(lines, f=fields_of()).filter((F.size("f") == 6) & is_number(F.get("f", F.lit(1))))
    rows = bound(split, trade_date=F.expr("try_cast(substring_index(f[0], ' ', 1) as date)"), **_numbers(1))
    rows = rows.filter(F.col("trade_date").isNotNull() & _readable())
    return _last_line_wins(rows, "trade_date")


def parse_intraday(lines: DataFrame) -> DataFrame:
    """``timestamp,open,high,low,close,volume``; rows with an unreadable time or number are dropped."""
    split = bound(lines, f=fields_of()).filter((F.size("f") == 6) & is_number(F.get("f", F.lit(1))))
    rows = bound(split, ts=F.expr("try_to_timestamp(f[0], 'yyyy-MM-dd HH:mm:ss')"), **_numbers(1))
    rows = rows.filter(F.col("ts").isNotNull() & _readable())
    return _last_line_wins(rows, "ts")


def parse_backfill(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """``date,open,high,low,close,adjusted,volume`` for symbols without any stored row."""
    new = lines.join(stored.select("symbol").distinct(), "symbol", "left_anti")
    split = bound(new, f=fields_of()).filter((F.size("f") == 7) & is_number(F.get("f", F.lit(1))))
    numbers = _numbers(1, OHLCV[:4]) | _numbers(6, OHLCV[4:])
    rows = bound(split, trade_date=F.expr("try_cast(f[0] as date)"), **numbers)
    rows = rows.filter(F.col("trade_date").isNotNull() & _readable())
    return _last_line_wins(rows, "trade_date")


def parse_vendor_history(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quoted vendor rows as (bars, rejected lines).

    Rows with fewer than eight fields, or with a time or number that cannot be
    read, are rejected; rows without a numeric fourth field are headers and
    are skipped. The time's offset is dropped.
    """
    split = bound(lines, f=F.split(F.translate("value", '"', ""), ","))
    local = F.regexp_extract(F.get("f", F.lit(1)), r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})", 0)
    parsed = bound(split, ts=F.try_to_timestamp(local, F.lit("yyyy-MM-dd'T'HH:mm:ss")), **_numbers(3))
    short = F.size("f") < 8
    row = ~short & is_number(F.get("f", F.lit(3)))
    good = F.col("ts").isNotNull() & _readable()
    rejected = parsed.filter(short | (row & ~good)).select("symbol", "line_no", "value")
    return parsed.filter(row & good).select("symbol", "ts", *OHLCV), rejected


def parse_vendor_quotes(lines: DataFrame) -> DataFrame:
    """Quoted vendor quotes; the heading row has ``symbol`` in its first field."""
    field = {"open": 11, "high": 12, "low": 13, "close": 6, "volume": 16}
    return (
        lines.withColumn("f", F.split(F.regexp_replace("value", '"', ""), ","))
        .filter(F.get("f", F.lit(0)) != "symbol")
        .withColumn("local", F.regexp_extract(F.get("f", F.lit(7)), r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", 0))
        .select(
            F.get("f", F.lit(0)).alias("symbol"),
            F.try_to_timestamp("local", F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts"),
            *[F.get("f", F.lit(field[c])).try_cast("double").alias(c) for c in OHLCV],
        )
    )


def parse_index(lines: DataFrame) -> DataFrame:
    """Benchmark index: date in field 0, close in field 4; the header has no number there."""
    return (
        lines.withColumn("f", fields_of())
        .filter(is_number(F.get("f", F.lit(4))))
        .select(F.get("f", F.lit(0)).try_cast("date").alias("trade_date"), F.get("f", F.lit(4)).try_cast("double").alias("close"))
        .filter("trade_date is not null and close is not null")
    )


def upsert(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...], replaced: tuple[str, ...]) -> DataFrame:
    """Incoming rows replace ``replaced`` columns by key; other columns keep their stored value.

    Both sides hold one row per key, so a full outer join on the whole key
    spreads over all keys of a hot symbol.
    """
    new = incoming.select(*key, *[F.col(c).alias(f"new_{c}") for c in replaced], F.lit(True).alias("is_new"))
    others = [c for c in existing.columns if c not in key and c not in replaced]
    merged = existing.join(new, list(key), "full_outer")
    return merged.select(
        *key, *[F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in replaced], *others
    )


def upsert_stored(spark: SparkSession, path: str, incoming: DataFrame, key, replaced, partition: str = "trade_date"):
    """Merge into a Parquet table, rewriting only the partitions the input touches."""
    existing = spark.read.parquet(path)
    touched = existing.join(incoming.select(partition).distinct(), partition, "left_semi")
    merged = upsert(touched, incoming, key, replaced).select(*existing.columns)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def latest_quotes(quotes: DataFrame, order: str = "seq") -> DataFrame:
    """Newest quote per symbol as a provisional intraday row."""
    columns = [c for c in quotes.columns if c not in ("symbol", order)]
    newest = quotes.groupBy("symbol").agg(*[F.max_by(c, order).alias(c) for c in columns])
    return newest.withColumn("provisional", F.lit(True))


def upsert_latest_quote(daily: DataFrame, quotes: DataFrame, order: str = "seq") -> DataFrame:
    """Write the newest quote of each symbol into its day's bar."""
    today = latest_quotes(quotes, order).withColumn("trade_date", F.to_date("ts"))
    return upsert(daily, today, ("symbol", "trade_date"), OHLCV)


def purge_provisional(intraday: DataFrame) -> DataFrame:
    return intraday.filter(~F.col("provisional"))


def reset_derived(bars: DataFrame) -> DataFrame:
    """Only the stored columns and the percent change remain."""
    return bars.select("symbol", "trade_date", *OHLCV, "percent_change")


def freshness(symbols: DataFrame, daily: DataFrame, intraday: DataFrame, now) -> DataFrame:
    """Which symbols need a full reload as of ``now``, and where the next load starts."""
    now = F.lit(now).cast("timestamp")
    day = daily.groupBy("symbol").agg(F.max("trade_date").alias("last_date"))
    minute = intraday.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    stale_daily = F.col("last_date").isNull() | (F.col("last_date") < F.date_sub(F.to_date(now), 100))
    stale_intraday = F.col("last_ts").isNull() | (F.col("last_ts") < now - F.expr("interval 100 minutes"))
    return (
        symbols.select("symbol")
        .distinct()
        .join(day, "symbol", "left")
        .join(minute, "symbol", "left")
        .select(
            "symbol",
            "last_date",
            "last_ts",
            stale_daily.alias("reload_daily"),
            stale_intraday.alias("reload_intraday"),
            F.coalesce(F.col("last_ts") - F.expr("interval 1 minute"), F.to_timestamp(F.lit("2001-01-01"))).alias(
                "next_start"
            ),
        )
    )
