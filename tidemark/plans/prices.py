"""Price sources, row filters and newest-row queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import markets
from tidemark.operators import indicators as ind
from tidemark.operators import rows
from tidemark.plans import sql
from tidemark.plans.registry import query
from tidemark.plans.views import daily_bars, minute_bars, naive, table, ticks, trades
from tidemark.operators.bars import bars_from_ticks
from tidemark.sources import bars as src

KEY = ["symbol", "trade_date"]
ORD = "(PARTITION BY symbol ORDER BY trade_date)"
SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
OHLCV = list(src.OHLCV)


def lines_with_noise(df, line, order, header):
    """Text lines in file order, every seventh followed by a header and a short line."""
    noisy = F.when(
        F.crc32(line.cast("binary")) % 7 == 0, F.array(line, F.lit(header), F.lit("1999-01-01,1.0,2.0"))
    ).otherwise(F.array(line))
    return df.select("symbol", F.col(order).alias("line_no"), F.explode(noisy).alias("value"))


def trade_lines(spark, sf):
    price = F.col("price").cast("string")
    line = F.concat_ws(
        ",", F.concat(F.col("trade_date").cast("string"), F.lit(" 00:00:00")), price, price, price, price,
        F.col("volume").cast("string"),
    )
    return lines_with_noise(trades(spark, sf, "brand"), line, "seq", "timestamp,open,high,low,close,volume")


LAST_TRADE = f"""
SELECT symbol, trade_date, p AS open, p AS high, p AS low, p AS close, v AS volume FROM (
  SELECT symbol, trade_date, last(price ORDER BY {SEQ}) AS p, last(volume ORDER BY {SEQ}) AS v
  FROM trades GROUP BY symbol, trade_date)"""


@query("load_daily_bars", sql.brand(LAST_TRADE))
def load_daily_bars(spark, sf):
    return src.parse_daily(trade_lines(spark, sf)).select(*KEY, *OHLCV)


@query("load_backfill", sql.brand(
    "SELECT symbol, trade_date, open, high, low, close, volume FROM bars WHERE symbol >= 'Brand#2'"))
def load_backfill(spark, sf):
    bars = daily_bars(spark, sf)
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("trade_date", "open", "high", "low", "close", "low", "volume")])
    lines = bars.select("symbol", F.col("trade_date").alias("line_no"), line.alias("value"))
    stored = bars.filter("symbol < 'Brand#2'")
    return src.parse_backfill(lines, stored).select(*KEY, *OHLCV)


@query("load_intraday_bars", """
SELECT symbol, ts, p AS open, p AS high, p AS low, p AS close, 1.0::DOUBLE AS volume FROM (
  SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, last(value ORDER BY events.ts, event_id) AS p
  FROM events GROUP BY ALL)""")
def load_intraday_bars(spark, sf):
    price = F.col("price").cast("string")
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:00"), price, price, price, price, F.lit("1"))
    lines = lines_with_noise(ticks(spark, sf), line, "seq", "not a time,1.5,1.5,1.5,1.5,1")
    return src.parse_intraday(lines).select("symbol", naive("ts"), *OHLCV)


def vendor_lines(spark, sf):
    """Quoted rows; every seventh order holds a cut-off row."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    full = F.concat_ws(
        ",", quoted("symbol"), F.concat(F.lit('"'), F.col("trade_date").cast("string"), F.lit('T10:30:00-06:00"')),
        quoted("trade_date"), quoted("price"), quoted("price"), quoted("price"), quoted("price"), quoted("volume"),
    )
    short = F.concat_ws(",", quoted("symbol"), quoted("trade_date"))
    line = F.when(F.col("l_orderkey") % 7 == 0, short).otherwise(full)
    return trades(spark, sf, "brand").select("symbol", F.col("seq").alias("line_no"), line.alias("value"))


@query("parse_vendor_history", sql.brand("""
SELECT symbol, CAST(trade_date AS TIMESTAMP) + INTERVAL 630 MINUTE AS ts, price AS open, price AS high, price AS low,
       price AS close, volume FROM trades WHERE l_orderkey % 7 <> 0"""))
def parse_vendor_history(spark, sf):
    bars, _ = src.parse_vendor_history(vendor_lines(spark, sf))
    return bars.select("symbol", naive("ts"), *OHLCV)


@query("vendor_history_rejects", sql.brand("""
SELECT symbol, '"' || symbol || '","' || CAST(trade_date AS VARCHAR) || '"' AS value FROM trades WHERE l_orderkey % 7 = 0"""))
def vendor_history_rejects(spark, sf):
    _, rejected = src.parse_vendor_history(vendor_lines(spark, sf))
    return rejected.select("symbol", "value")


@query("parse_vendor_quotes", sql.minutes("SELECT symbol, ts, open, high, low, close, volume FROM minutes"))
def parse_vendor_quotes(spark, sf):
    minute = minute_bars(spark, sf)
    text = {0: "symbol", 6: "close", 11: "open", 12: "high", 13: "low", 16: "volume"}
    fields = [F.col(text[i]).cast("string") if i in text else F.lit("-") for i in range(17)]
    fields[7] = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-06:00'")
    line = F.concat(F.lit('"'), F.concat_ws('","', *fields), F.lit('"'))
    heading = F.lit('"symbol","name"')
    lines = minute.select(F.explode(F.when(F.minute("ts") == 0, F.array(line, heading)).otherwise(F.array(line))).alias("value"))
    return src.parse_vendor_quotes(lines).select("symbol", naive("ts"), *OHLCV)


INDEX_SQL = "SELECT trade_date, sum(close) AS close FROM bars GROUP BY trade_date"


def index_levels(spark, sf, by="brand"):
    """Index level: the closes of all symbols traded that day."""
    return daily_bars(spark, sf, by).groupBy("trade_date").agg(F.sum("close").alias("close"))


@query("load_index", sql.brand(INDEX_SQL))
def load_index(spark, sf):
    close = F.col("close").cast("string")
    line = F.concat_ws(",", F.col("trade_date").cast("string"), close, close, close, close, F.lit("0"))
    header = F.lit("Date,Open,High,Low,Close,Volume")
    lines = index_levels(spark, sf).select(
        F.explode(F.when(F.dayofmonth("trade_date") == 1, F.array(header, line)).otherwise(F.array(line))).alias("value")
    )
    return src.parse_index(lines)


@query("upsert_bars", sql.brand(f"""
SELECT symbol, trade_date, open * k AS open, high * k AS high, low * k AS low, close * k AS close, volume * k AS volume,
       CASE WHEN trade_date <= DATE '1998-06-30' THEN pc END AS percent_change
FROM (SELECT *, CASE WHEN trade_date >= DATE '1998-01-01' THEN 2 ELSE 1 END AS k,
             coalesce((close - lag(close) OVER {ORD}) / lag(close) OVER {ORD}, 0) AS pc FROM bars)"""))
def upsert_bars(spark, sf):
    bars = daily_bars(spark, sf)
    existing = ind.percent_change(bars).filter("trade_date <= date'1998-06-30'")
    incoming = bars.filter("trade_date >= date'1998-01-01'").select(*KEY, *[(F.col(c) * 2).alias(c) for c in OHLCV])
    return src.upsert(existing, incoming, ("symbol", "trade_date"), src.OHLCV)


def quotes(spark, sf):
    price = F.col("price")
    return ticks(spark, sf).select("symbol", "seq", "ts", *[price.alias(c) for c in OHLCV[:4]], F.lit(1.0).alias("volume"))


@query("upsert_latest_quote", """
WITH days AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS trade_date, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
         min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume,
         max(CAST(ts AS DATE)) = (SELECT max(CAST(e.ts AS DATE)) FROM events e WHERE e.event_type = events.event_type) AS newest
  FROM events GROUP BY event_type, CAST(ts AS DATE))
SELECT symbol, trade_date, CASE WHEN newest THEN close ELSE open END AS open, CASE WHEN newest THEN close ELSE high END AS high,
       CASE WHEN newest THEN close ELSE low END AS low, close, CASE WHEN newest THEN 1.0 ELSE volume END AS volume FROM days""")
def upsert_latest_quote(spark, sf):
    daily = bars_from_ticks(ticks(spark, sf), "1 day").withColumn("trade_date", F.to_date("ts")).select(*KEY, *OHLCV)
    return src.upsert_latest_quote(daily, quotes(spark, sf))


@query("latest_quotes", """
SELECT event_type AS symbol, last(ts ORDER BY ts, event_id) AS ts, last(value ORDER BY ts, event_id) AS close, true AS provisional
FROM events GROUP BY event_type""")
def latest_quotes(spark, sf):
    return src.latest_quotes(quotes(spark, sf)).select("symbol", naive("ts"), "close", "provisional")


@query("purge_provisional", sql.minutes("SELECT symbol, ts, close FROM minutes WHERE NOT provisional"))
def purge_provisional(spark, sf):
    return src.purge_provisional(minute_bars(spark, sf)).select("symbol", naive("ts"), "close")


@query("freshness_report", sql.brand("""
SELECT symbol, last_date, CAST(last_date AS TIMESTAMP) AS last_ts,
       last_date IS NULL OR last_date < DATE '2002-01-01' - 100 AS reload_daily,
       last_date IS NULL OR last_date < TIMESTAMP '2002-01-01' - INTERVAL 100 MINUTE AS reload_intraday,
       coalesce(CAST(last_date AS TIMESTAMP) - INTERVAL 1 MINUTE, TIMESTAMP '2001-01-01') AS next_start
FROM (SELECT DISTINCT p_brand AS symbol FROM part)
LEFT JOIN (SELECT symbol, max(trade_date) AS last_date FROM bars WHERE symbol <> 'Brand#7' GROUP BY symbol) USING (symbol)"""))
def freshness_report(spark, sf):
    daily = daily_bars(spark, sf).filter("symbol <> 'Brand#7'")
    intraday = daily.select("symbol", F.col("trade_date").cast("timestamp").alias("ts"))
    symbols = table(spark, sf, "part").select(F.col("p_brand").alias("symbol"))
    report = src.freshness(symbols, daily, intraday, "2002-01-01 00:00:00")
    return report.select("symbol", "last_date", naive("last_ts"), "reload_daily", "reload_intraday", naive("next_start"))


@query("reset_derived", sql.brand(f"""
SELECT symbol, trade_date, open, high, low, close, volume,
       coalesce((close - lag(close) OVER {ORD}) / lag(close) OVER {ORD}, 0) AS percent_change FROM bars"""))
def reset_derived(spark, sf):
    return src.reset_derived(ind.sma(ind.percent_change(daily_bars(spark, sf))))


SMA20 = f"CASE WHEN row_number() OVER {ORD} >= 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING) END AS sma20"
SMA20_TABLE = f"(SELECT symbol, trade_date, close, {SMA20} FROM bars)"


def sma20(spark, sf):
    return ind.sma(daily_bars(spark, sf), [20]).select(*KEY, "close", "sma20")


@query("zero_fill", sql.brand(f"SELECT symbol, trade_date, close, coalesce(sma20, 0) AS sma20 FROM {SMA20_TABLE}"))
def zero_fill(spark, sf):
    return rows.zero_fill(sma20(spark, sf))


@query("complete_rows", sql.brand(f"SELECT * FROM {SMA20_TABLE} WHERE sma20 IS NOT NULL"))
def complete_rows(spark, sf):
    return rows.complete_rows(sma20(spark, sf), ["sma20"])


@query("valid_prices", sql.brand("SELECT symbol, trade_date, close FROM bars WHERE day(trade_date) NOT IN (1, 2)"))
def valid_prices(spark, sf):
    broken = F.expr("case day(trade_date) when 1 then 0D when 2 then null else close end")
    return rows.valid_prices(daily_bars(spark, sf).withColumn("close", broken)).select(*KEY, "close")


@query("date_range", sql.brand("SELECT symbol, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars GROUP BY symbol"))
def date_range(spark, sf):
    return rows.date_range(trades(spark, sf, "brand"))


def market_sql() -> str:
    values = ", ".join(
        "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in market) + ")" for market in markets.MARKETS
    )
    return f"""
WITH hours(market, zone, opens, closes, rests, resumes) AS (VALUES {values}),
local AS (SELECT event_id, h.*, timezone(zone, timezone('UTC', ts)) AS t FROM events, hours h)
SELECT event_id, market, CASE
  WHEN dayofweek(t) IN (0, 6) OR t::TIME < opens::TIME OR t::TIME > closes::TIME THEN 'CLOSED'
  WHEN t::TIME >= rests::TIME AND t::TIME < resumes::TIME THEN 'BREAK' ELSE 'OPEN' END AS status
FROM local"""


@query("market_status", market_sql())
def market_status(spark, sf):
    stamped = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return markets.market_status(stamped).drop("ts")


@query("trading_window", "SELECT event_id, ts, value FROM events WHERE hour(ts) >= 14 AND hour(ts) < 21")
def trading_window(spark, sf):
    return markets.trading_window(table(spark, sf, "events").select("event_id", "ts", "value"))


@query("latest_price", "SELECT event_type AS symbol, last(value ORDER BY ts, event_id) AS price FROM events GROUP BY event_type")
def latest_price(spark, sf):
    return rows.latest_price(ticks(spark, sf), "seq", "price")


BACK = "row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC)"


@query("last_n", sql.brand(f"SELECT symbol, trade_date, close FROM (SELECT *, {BACK} AS back FROM bars WHERE close <> 0) WHERE back <= 200"))
def last_n(spark, sf):
    return rows.last_n(rows.valid_prices(daily_bars(spark, sf)), 200).select(*KEY, "close")


@query("holdout_split", sql.brand(f"SELECT symbol, trade_date, CASE WHEN {BACK} <= 60 THEN 'test' ELSE 'train' END AS split FROM bars"))
def holdout_split(spark, sf):
    return rows.holdout_split(daily_bars(spark, sf), 60).select(*KEY, "split")


@query("calendar_mismatch", sql.brand(f"""
SELECT * FROM first_dates WHERE first_test NOT IN (SELECT first_test FROM first_dates WHERE symbol = 'Brand#1')""", f"""
first_dates AS (SELECT symbol, min(trade_date) AS first_test FROM (SELECT *, {BACK} AS back FROM bars) WHERE back <= 60 GROUP BY symbol)"""))
def calendar_mismatch(spark, sf):
    return rows.calendar_mismatch(rows.holdout_split(daily_bars(spark, sf), 60), "Brand#1")


@query("latest_features", sql.brand(f"""
SELECT symbol, trade_date, close, sma20 FROM (SELECT *, {BACK} AS back FROM {SMA20_TABLE} WHERE sma20 IS NOT NULL) WHERE back = 1"""))
def latest_features(spark, sf):
    return rows.latest_features(sma20(spark, sf), ["sma20"])


COMMON_SQL = """
common AS (SELECT trade_date FROM bars GROUP BY trade_date
  HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))"""


@query("common_calendar", sql.region("SELECT trade_date FROM common", COMMON_SQL))
def common_calendar(spark, sf):
    return rows.common_calendar(daily_bars(spark, sf, "region"))


@query("price_change", sql.brand("""
SELECT symbol, latest, previous, latest - previous AS change, (latest - previous) / previous * 100 AS change_pct,
       CAST(sign(latest - previous) AS INTEGER) AS direction
FROM (SELECT symbol, arg_max(close, trade_date) AS latest, arg_max(close, trade_date) FILTER (trade_date < DATE '2001-10-01') AS previous
      FROM bars GROUP BY symbol)"""))
def price_change(spark, sf):
    return rows.price_change(daily_bars(spark, sf), "2001-10-01")


@query("intraday_series", sql.minutes("""
SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - count(*) OVER (PARTITION BY symbol) AS position
FROM minutes m WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM minutes n WHERE n.symbol = m.symbol
  AND CAST(ts AS DATE) IN (DATE '2024-01-15', DATE '2024-01-12'))"""))
def intraday_series(spark, sf):
    shown = rows.intraday_series(minute_bars(spark, sf), "2024-01-15")
    return shown.select("symbol", naive("ts"), "close", F.col("position").cast("bigint").alias("position"))


@query("model_registry", """
WITH registry AS (SELECT p_brand AS scope, CASE WHEN p_size % 2 = 0 THEN 'MULTI' ELSE 'SINGLE' END AS type,
  p_partkey AS model_number, '/models/' || p_partkey AS path FROM part)
SELECT scope, type, max(model_number) AS latest_number, arg_max(path, model_number) AS latest_path,
       CASE WHEN type = 'SINGLE' THEN max(model_number) + 1
            ELSE (SELECT max(model_number) + 1 FROM registry WHERE type = 'MULTI') END AS next_number
FROM registry GROUP BY scope, type""")
def model_registry(spark, sf):
    from tidemark.sources.registry import latest_models

    registry = table(spark, sf, "part").select(
        F.col("p_brand").alias("scope"),
        F.when(F.col("p_size") % 2 == 0, "MULTI").otherwise("SINGLE").alias("type"),
        F.col("p_partkey").alias("model_number"),
        F.concat(F.lit("/models/"), F.col("p_partkey").cast("string")).alias("path"),
    )
    return latest_models(registry)


@query("stream_bars_batch", sql.minutes("SELECT symbol, ts, open, high, low, close, volume FROM minutes"))
def minute_bars_batch(spark, sf):
    return bars_from_ticks(ticks(spark, sf), "1 minute").select("symbol", naive("ts"), *OHLCV)
