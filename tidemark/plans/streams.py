"""Streaming queries over the event and document tables, run until all input is processed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import forests as fo
from tidemark.operators import indicators as ind
from tidemark.operators import resume
from tidemark.plans import sql
from tidemark.plans.news import TO_SCORES, TO_SENTENCES, TO_STATS, text_sql
from tidemark.plans.portfolio import symbols
from tidemark.plans.registry import query
from tidemark.plans.series import EMA_BASE, EMA_STATES, RESUME_DATE, RESUME_WINDOWS, RSI_BASE, RSI_OUT, RSI_STATES, settle
from tidemark.plans.views import HORIZONS, as_articles, as_ticks, daily_bars, minute_bars, naive, table
from tidemark.session import shared_dir, written
from tidemark.streaming import streams as st

OHLCV = ("open", "high", "low", "close", "volume")
# Events arrive in spans of so many days. The delay is longer than a span, so that order within one makes no row late,
# and far shorter than the data, so that the watermark moves through it and state is evicted.
SPAN_DAYS = 5
DELAY_DAYS = 6
DELAY = f"{DELAY_DAYS} days"


def event_stream(spark, sf):
    return st.read_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)


def arriving_events(spark, sf, late=None):
    """The events as a stream that takes about one span of time per micro-batch; rows of ``late`` arrive after all spans."""
    events, path, files = table(spark, sf, "events"), shared_dir(spark), spark.sparkContext.defaultParallelism
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    spans = 0 if low is None else (high - low).days // SPAN_DAYS + 1
    step = dt.timedelta(days=SPAN_DAYS)
    # one job per span: files are read in the order in which they were written
    for i in range(spans):
        span = events.filter((F.col("ts") >= F.lit(low + i * step)) & (F.col("ts") < F.lit(low + (i + 1) * step)))
        span.repartition(files).write.mode("append").parquet(path)
    (events.limit(0) if late is None else late).write.mode("append").parquet(path)
    return st.read_stream(spark, path, events.schema, max_files=files)


@query("stream_bars", sql.minutes("SELECT symbol, ts, open, high, low, close, volume FROM minutes"))
def stream_bars(spark, sf):
    path = shared_dir(spark)
    bars = st.stream_bars(as_ticks(arriving_events(spark, sf)), "1 minute", DELAY)
    st.log_changes(bars, f"{path}/bars", f"{path}/state", mode="update").awaitTermination()
    current = st.current_rows(st.read_log(spark, f"{path}/bars", bars.schema), ("symbol", "ts"))
    return current.select("symbol", naive("ts"), *OHLCV)


@query("stream_upsert", """
SELECT event_type AS symbol, last(ts ORDER BY ts, event_id) AS ts, last(value ORDER BY ts, event_id) AS price FROM events GROUP BY event_type""")
def stream_upsert(spark, sf):
    path = shared_dir(spark)
    ticks = as_ticks(event_stream(spark, sf))
    st.log_changes(ticks, f"{path}/quotes", f"{path}/state").awaitTermination()
    current = st.current_rows(st.read_log(spark, f"{path}/quotes", ticks.schema), ("symbol",), ("seq",))
    return current.select("symbol", naive("ts"), "price")


@query("stream_late_cutoff", "SELECT DISTINCT event_type AS symbol, date_trunc('minute', ts) AS ts FROM events")
def stream_late_cutoff(spark, sf):
    return cut_minutes(spark, arriving_events(spark, sf))


def cut_minutes(spark, stream):
    path = shared_dir(spark)
    minutes = as_ticks(stream).withColumn("ts", F.date_trunc("minute", "ts")).select("symbol", "ts")
    st.append_to(st.late_cutoff(minutes, ("symbol", "ts"), DELAY), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("symbol", naive("ts"))


@query("stream_late_dropped", f"""
WITH newest AS (SELECT max(ts) AS top FROM events),
late AS (SELECT event_type, ts - INTERVAL 60 DAY AS ts FROM events
  UNION ALL SELECT event_type, ts - INTERVAL 7 MINUTE FROM events, newest WHERE ts > top - INTERVAL 1 DAY)
SELECT DISTINCT event_type AS symbol, date_trunc('minute', ts) AS ts FROM (
  SELECT event_type, ts FROM events
  UNION ALL SELECT event_type, ts FROM late, newest WHERE date_trunc('minute', ts) > date_trunc('minute', top) - INTERVAL {DELAY_DAYS} DAY)""")
def stream_late_dropped(spark, sf):
    events = table(spark, sf, "events")
    newest = F.lit(events.agg(F.max("ts")).first()[0])
    old = events.withColumn("ts", F.col("ts") - F.expr("INTERVAL 60 DAYS"))
    recent = events.filter(F.col("ts") > newest - F.expr("INTERVAL 1 DAY")).withColumn("ts", F.col("ts") - F.expr("INTERVAL 7 MINUTES"))
    return cut_minutes(spark, arriving_events(spark, sf, old.unionByName(recent)))


@query("stream_ema", "WITH RECURSIVE " + sql.MINUTES + """,
numbered AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM minutes),
scan AS (SELECT symbol, ts, rn, close AS y FROM numbered WHERE rn = 1
  UNION ALL SELECT n.symbol, n.ts, n.rn, s.y + 0.1 * (n.close - s.y) FROM scan s JOIN numbered n ON n.symbol = s.symbol AND n.rn = s.rn + 1)
SELECT symbol, ts, round(y + 1e-8, 4) + 0.0 AS ema FROM scan""")
def stream_ema(spark, sf):
    path = shared_dir(spark)
    bars = written(spark, minute_bars(spark, sf).select("symbol", "ts", "close"))
    low, high = bars.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
    share = (F.unix_timestamp("ts") - F.lit(low)) / F.lit((high or 0) - (low or 0) + 1)
    # the minutes arrive in three spans of time, and each run goes on from the value that the one before it stored
    for i in range(3):
        bars.filter(F.floor(share * 3) == i).write.mode("append").parquet(f"{path}/bars")
        stream = st.read_stream(spark, f"{path}/bars", bars.schema)
        st.stream_ema(stream, 0.1, path, f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/averages").select("symbol", naive("ts"), settle("ema", 4))


HELD = """
held AS (SELECT event_type AS symbol, CAST(count(*) AS DOUBLE) AS held, count(*) * avg(value) AS investment FROM events GROUP BY event_type)"""


@query("stream_alerts", "WITH " + HELD + """
SELECT symbol, ts, value * held AS worth FROM events JOIN held ON symbol = event_type
WHERE value * held <= investment * 0.5 OR value * held >= investment * 2""")
def stream_alerts(spark, sf):
    path = shared_dir(spark)
    held = table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(
        F.count(F.lit(1)).cast("double").alias("held"), (F.count(F.lit(1)) * F.avg("value")).alias("investment")
    )
    out = st.alerts(as_ticks(event_stream(spark, sf)), written(spark, held), 0.5, 1.0)
    st.append_to(out, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("symbol", naive("ts"), "worth")


@query("stream_minute_refresh", sql.minutes("""
SELECT symbol, ts, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) >= 20
  THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), 4) + 0.0 END AS sma20 FROM minutes"""))
def stream_minute_refresh(spark, sf):
    path = shared_dir(spark)

    def average(bars):
        dated = bars.withColumnRenamed("ts", "trade_date")
        return ind.sma(dated, [20]).select("symbol", F.col("trade_date").alias("ts"), "sma20")

    st.minute_refresh(as_ticks(arriving_events(spark, sf)), path, f"{path}/state", average, None, DELAY).awaitTermination()
    log = spark.read.parquet(f"{path}/derived")
    return st.current_rows(log, ("symbol", "ts")).select("symbol", naive("ts"), F.round("sma20", 4).alias("sma20"))


REFRESH_DATES = (RESUME_DATE, "1998-09-15", "1998-10-15", "9999-12-31")
REFRESH_COLUMNS = ["horizon", "close", *resume.Spec().columns]


@query("stream_predictions", sql.region(f"""
SELECT symbol, trade_date, horizon, sma20, ema20, rsi, obv, 100::INTEGER AS trees FROM (
  SELECT symbol, scan.trade_date, sma20, round(ema20 + 1e-8, 4) + 0.0 AS ema20, {RSI_OUT}, obv,
    row_number() OVER (PARTITION BY symbol, scan.trade_date > DATE '{REFRESH_DATES[1]}', scan.trade_date > DATE '{REFRESH_DATES[2]}'
      ORDER BY scan.trade_date DESC) AS back
  FROM scan JOIN windows USING (symbol, rn) WHERE scan.trade_date > DATE '{RESUME_DATE}'),
  (VALUES {", ".join(f"({h}::INTEGER)" for h in HORIZONS)}) AS h(horizon) WHERE back = 1""", *RESUME_WINDOWS,
    sql.scan({"ema20": EMA_STATES["ema20"], **RSI_STATES}), recursive=True))
def stream_predictions(spark, sf):
    """Newest indicators of each symbol per batch of daily bars, with the trees of its forest that voted on it."""
    path, _ = refreshed_predictions(spark, sf)
    days = st.read_log(spark, f"{path}/indicators", resume.advance(resume.empty_state(spark), daily_bars(spark, sf, "region")).schema)
    predicted = spark.read.parquet(f"{path}/predictions").drop("batch_id")
    rows = days.drop("state", "batch_id").join(predicted, ["symbol", "trade_date"])
    return rows.select("symbol", "trade_date", "horizon", "sma20", settle("ema20", 4), settle("rsi", 4), "obv", "trees")


def refreshed_predictions(spark, sf, **settings):
    """The regions' daily bars after the resume date arrive in three batches; the state and the forests are those of the older ones."""
    path = shared_dir(spark)
    bars = written(spark, daily_bars(spark, sf, "region"))
    between = lambda start, end: bars.filter(
        (F.col("trade_date") > F.lit(start).cast("date")) & (F.col("trade_date") <= F.lit(end).cast("date")))
    older = between("0001-01-01", RESUME_DATE)
    filled = written(spark, resume.advance(resume.empty_state(spark), older))
    state = written(spark, resume.next_state(filled, resume.empty_state(spark)))
    labelled = ind.direction_labels(older, HORIZONS).select("symbol", "trade_date", "close", "horizon", "label").dropna()
    training = written(spark, filled.drop("state").join(labelled, ["symbol", "trade_date"]), ("symbol",))
    forests = fo.store_forests(training, REFRESH_COLUMNS, symbols(spark, sf), f"{path}/forests", **settings)
    for start, end in zip(REFRESH_DATES, REFRESH_DATES[1:]):
        between(start, end).write.mode("append").parquet(f"{path}/bars")
        # a run takes what has arrived since the one before it, and goes on from its checkpoint
        stream = st.read_stream(spark, f"{path}/bars", bars.schema)
        st.predicted_refresh(stream, path, f"{path}/checkpoint", state, forests, REFRESH_COLUMNS, HORIZONS, every=None).awaitTermination()
    return path, forests


def refreshed_news(spark, sf):
    path = shared_dir(spark)
    schema = table(spark, sf, "documents").schema
    articles = as_articles(st.read_stream(spark, f"{sf}/documents.parquet", schema))
    bars = written(spark, daily_bars(spark, sf).select("symbol", "trade_date", "close"))
    st.news_refresh(articles, bars, path, f"{path}/state", None).awaitTermination()
    return path


@query("stream_news_sentences", text_sql("SELECT sentence, documents, occurrences FROM counts", *TO_SENTENCES))
def stream_news_sentences(spark, sf):
    return st.sentence_totals(spark, refreshed_news(spark, sf)).select("sentence", "documents", "occurrences")


@query("stream_news", sql.brand("SELECT id, round(mood, 6) AS mood FROM scored", *TO_SCORES))
def stream_news(spark, sf):
    moods = spark.read.parquet(f"{refreshed_news(spark, sf)}/moods")
    return moods.select("id", F.round("mood", 6).alias("mood"))


@query("stream_news_ngrams", sql.brand("SELECT gram, documents, occurrences, increase, decrease FROM stats", *TO_STATS))
def stream_news_ngrams(spark, sf):
    totals = st.ngram_totals(spark, refreshed_news(spark, sf))
    return totals.select("gram", "documents", "occurrences", "increase", "decrease")
