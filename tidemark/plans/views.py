"""Market-shaped views over the driver's tables.

Prices are quoted in 64ths, so price sums are exact in double precision
whatever the order of the additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HORIZONS = (1, 30, 200)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def naive(name: str) -> Column:
    """Timestamp without a time zone, as the source tables store it."""
    return F.col(name).cast("timestamp_ntz").alias(name)


def trade_sequence() -> Column:
    """Order of trades within a day, packed into one decimal.

    A decimal keeps ``min_by``/``max_by`` in a hash aggregate; a struct key
    would force a sort of every trade.
    """
    return F.expr(
        "cast(l_orderkey as decimal(13,0)) * cast(1e25 as decimal(26,0))"
        " + cast(l_linenumber as decimal(3,0)) * cast(1e22 as decimal(23,0))"
        " + cast(l_partkey as decimal(11,0)) * cast(1e11 as decimal(12,0))"
        " + cast(l_suppkey as decimal(11,0))"
    )


def trades(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """One row per line item, with ``symbol`` the part's brand or the supplier's region."""
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus")
    line = table(spark, sf_dir, "lineitem").select(*columns, "l_shipdate")
    if by == "brand":
        named = line.join(
            table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol")),
            F.col("l_partkey") == F.col("p_partkey"),
        )
    elif by == "region":
        named = line.join(supplier_regions(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
    else:
        raise ValueError(by)
    return named.select(
        "symbol",
        F.to_date("l_shipdate").alias("trade_date"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 64) / 64).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.col("l_linestatus").alias("status"),
        "l_orderkey",
        trade_sequence().alias("seq"),
    )


def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("symbol"))
    )


def daily_bars(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Daily bars: at most one row per symbol and calendar day, however hot the symbol is."""
    return (
        trades(spark, sf_dir, by)
        .groupBy("symbol", "trade_date")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(table(spark, sf_dir, "events"))


def as_ticks(events: DataFrame) -> DataFrame:
    """Events as ticks; ``seq`` orders them by time, then id. Batch or streaming."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    seq = F.expr(
        "cast(unix_micros(ts) as decimal(18,0)) * cast(1e19 as decimal(20,0)) + cast(event_id as decimal(19,0))"
    )
    return events.select(F.col("event_type").alias("symbol"), "ts", seq.alias("seq"), F.col("value").alias("price"))


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-minute bars of the ticks; ``provisional`` marks the odd minutes."""
    from tidemark.operators.bars import bars_from_ticks

    return bars_from_ticks(ticks(spark, sf_dir), "1 minute").withColumn("provisional", F.minute("ts") % 2 == 1)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_articles(table(spark, sf_dir, "documents"))


def as_articles(documents: DataFrame) -> DataFrame:
    """Documents as news articles of 25 symbols, over 2,400 days. Batch or streaming."""
    published = F.expr("date_add(date'1995-01-02', cast(doc_id * 7 % 2400 as int))")
    return documents.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("symbol"),
        F.substring_index("text", "\n", 1).alias("headline"),
        F.col("text").alias("content"),
        published.alias("published_date"),
        F.concat(F.lit("http://news/"), F.col("source"), F.lit("/"), F.col("n_chars").cast("string")).alias("url"),
    )
