import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.markets import market_status
from tidemark.sources import bars, news
from tidemark.sources.registry import latest_models
from tidemark.sources.text import read_lines


def lines(spark, *values, symbol="A"):
    return spark.createDataFrame([(symbol, i, v) for i, v in enumerate(values)], "symbol string, line_no long, value string")


def test_daily_file(spark, tmp_path):
    (tmp_path / "ABC.csv").write_text(
        "timestamp,open,high,low,close,volume\n2020-01-01 00:00:00,1,2,0.5,1.5,100\n2020-01-01,9,9,9,9,9\n"
        "2020-01-02,1,2,3\n2020-01-03,1,2,.5,+1,7,,\nnot a date,1,2,3,4,5\n"
    )
    got = bars.parse_daily(read_lines(spark, str(tmp_path))).orderBy("trade_date").collect()
    assert [(r.symbol, r.trade_date.day, r.close, r.volume) for r in got] == [("ABC", 1, 9.0, 9.0), ("ABC", 3, 1.0, 7.0)]


def test_intraday_drops_bad_times(spark):
    got = bars.parse_intraday(lines(spark, "2020-01-01 10:00:00,1,2,3,4,5", "2020-13-01 10:00:00,1,2,3,4,5", "x,1,2,3,4,5"))
    assert got.count() == 1


def test_backfill_only_for_new_symbols(spark):
    stored = spark.createDataFrame([("B",)], "symbol string")
    row = "2020-01-01,1,2,3,4,99,5"
    both = lines(spark, row).union(lines(spark, row, symbol="B"))
    got = bars.parse_backfill(both, stored).collect()
    assert [(r.symbol, r.close, r.volume) for r in got] == [("A", 4.0, 5.0)]


def test_vendor_rows(spark):
    good, bad = bars.parse_vendor_history(
        lines(spark, '"symbol","timestamp","day","open","high","low","close","volume"',
              '"A","2020-01-01T09:30:00-05:00","2020-01-01","1","2","3","4","5"', '"A","cut"')
    )
    row = good.head()
    assert (row.ts, row.open, row.close) == (dt.datetime(2020, 1, 1, 9, 30), 1.0, 4.0)
    assert good.count() == 1 and bad.count() == 1


def test_news_lines(spark):
    feed = ["preamble", "preamble",
            "Co,T,C,One, two 'three',2020-01-01 10:00:00 +0000,http://u,Text, more", "Co,T,C,No date,here,http://u,x",
            "Co,T,C,H,2020-01-01 10:00:00,http://u,", "Co,T,C,H,2020-01-01 10:00:00,ftp://u,",
            "Co,T,C,H,2020-01-01 10:00:00,http://u,"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(feed)], "line_in_file long, value string")
    got = {(r.headline, r.published, r.description) for r in news.parse_news(df).collect()}
    assert got == {("One two three", "2020-01-01 10:00:00 +0000", "Text more"), ("H", "2020-01-01 10:00:00", "NULL")}


def test_article_text(spark):
    pages = ["<p>One <b>two</b></p><script>var t='</p><p>no'</script><p>it's<br>4 &amp; 5", "<div>none</div>", "Redirect", "<p> </p>"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(pages)], "page_id long, html string")
    for strict in (False, True):
        got = news.extract_articles(df, strict=strict).orderBy("page_id").collect()
        assert [r.content for r in got] == ["One two its 4 & 5", None, None, None]
        assert [r.redirected for r in got] == [False, False, True, False]


def test_upsert_stored_touches_only_its_dates(spark, make_bars, tmp_path):
    path = str(tmp_path / "bars")
    stored = make_bars({"A": [1, 2, 3], "B": [4, 5, 6]}).withColumn("extra", F.lit("kept"))
    stored.write.partitionBy("trade_date").parquet(path)
    new = make_bars({"A": [1, 20], "C": [0, 7]}).filter("trade_date = '2000-01-02'")
    bars.upsert_stored(spark, path, new, ("symbol", "trade_date"), bars.OHLCV)
    got = {(r.symbol, str(r.trade_date)[-2:]): (r.close, r.extra) for r in spark.read.parquet(path).collect()}
    assert got == {("A", "01"): (1.0, "kept"), ("A", "02"): (20.0, "kept"), ("A", "03"): (3.0, "kept"), ("B", "01"): (4.0, "kept"),
                   ("B", "02"): (5.0, "kept"), ("B", "03"): (6.0, "kept"), ("C", "02"): (7.0, None)}


def test_market_clock(spark):
    times = ["2024-01-05 03:00:00", "2024-01-05 04:30:00", "2024-01-06 04:30:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("ts"))
    status = market_status(df).filter("market = 'Hong Kong SE'").orderBy("ts").collect()
    assert [r.status for r in status] == ["OPEN", "BREAK", "CLOSED"]


def test_registry_numbers(spark):
    data = [("A", "SINGLE", 3, "a3"), ("A", "SINGLE", 1, "a1"), ("x", "MULTI", 7, "m7"), ("y", "MULTI", 2, "m2")]
    df = spark.createDataFrame(data, "scope string, type string, model_number long, path string")
    got = {(r.scope, r.type): (r.next_number, r.latest_path) for r in latest_models(df).collect()}
    assert got == {("A", "SINGLE"): (4, "a3"), ("x", "MULTI"): (8, "m7"), ("y", "MULTI"): (8, "m2")}


def test_unreadable_rows_do_not_end_the_job(spark):
    daily = lines(spark, "2020-01-01,1,2,3,4,N/A", "2020-01-02,1,-,3,4,5", "2020-01-03,1,2,3,4,5")
    assert [r.trade_date.day for r in bars.parse_daily(daily).collect()] == [3]
    stored = spark.createDataFrame([], "symbol string")
    assert bars.parse_backfill(lines(spark, "2020-01-01,1,2,3,4,4,-", "2020-01-02,1,2,3,4,4,5"), stored).count() == 1
    index = lines(spark, "Date,Open,High,Low,Close", "null,1,2,3,4", "2020-01-02,1,2,3,4")
    assert [r.close for r in bars.parse_index(index).collect()] == [4.0]
    good = "A,2020-01-01T10:00:00-05:00,x,1,2,3,4,5"
    history = lines(spark, good, good.replace("2020-01-01T10", "when"), good.replace(",5", ",N/A"), "A,Time,x,Open,High,Low,Close,Volume", "short")
    kept, rejected = bars.parse_vendor_history(history)
    assert kept.filter("ts is not null").count() == kept.count() == 1
    assert sorted(r.line_no for r in rejected.collect()) == [1, 2, 4]


def test_pages_reach_python_in_small_batches(spark):
    import pandas as pd

    @F.pandas_udf("long")
    def together(values: pd.Series) -> pd.Series:
        return pd.Series([len(values)] * len(values))

    pages = spark.range(5000).coalesce(1).select(F.repeat(F.lit("<p>text "), 1000).alias("html"))
    rows = pages.select(together("html").alias("rows")).agg(F.max("rows"), F.count("rows")).head()
    # 8,000 bytes each; a batch had 5,000 of them before
    assert rows[0] <= 600 and rows[1] == 5000
