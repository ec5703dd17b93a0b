import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import news
from tidemark.operators.bars import bars_from_ticks
from tidemark.streaming import streams as st

SCHEMA = "symbol string, ts timestamp, seq long, price double"


def ticks(spark):
    start = dt.datetime(2024, 1, 1)
    data = [("A" if i % 3 else "B", start + dt.timedelta(seconds=20 * i), i, float(i * 37 % 101)) for i in range(300)]
    return spark.createDataFrame(data, SCHEMA)


def feed(df, folder, parts, order):
    """One file per part, with rising modification times."""
    for i in range(parts):
        part = df.filter(F.floor(F.col(order) * parts / df.count()) == i)
        part.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("landed") / "ticks")
    feed(ticks(spark), folder, 3, "seq")
    return folder


def test_bars_over_batches_equal_batch(spark, landed, tmp_path):
    stream = st.read_stream(spark, landed, ticks(spark).schema, max_files=1)
    bars = st.stream_bars(stream, "1 minute", "1 hour")
    st.log_changes(bars, f"{tmp_path}/out", f"{tmp_path}/state", mode="update").awaitTermination()
    log = st.read_log(spark, f"{tmp_path}/out", bars.schema)
    assert log.select("batch_id").distinct().count() >= 3
    got = st.current_rows(log, ("symbol", "ts"))
    want = bars_from_ticks(ticks(spark), "1 minute")
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_average_carries_over_batches(spark, landed, tmp_path):
    stream = st.read_stream(spark, landed, ticks(spark).schema, max_files=1)
    st.stream_ema(stream, 0.2, f"{tmp_path}/out", f"{tmp_path}/state", "price", "minute").awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/out/averages")
    assert log.select("batch_id").distinct().count() >= 3
    got = {(r.symbol, r.ts): r.ema for r in log.collect()}
    assert len(got) == log.count() == ticks(spark).count()
    state = {}
    for r in ticks(spark).orderBy("seq").collect():
        y = state.get(r.symbol, r.price)
        state[r.symbol] = y + 0.2 * (r.price - y)
        assert got[r.symbol, r.ts] == pytest.approx(state[r.symbol])


def test_late_rows_and_repeats_are_dropped(spark, tmp_path):
    folder = f"{tmp_path}/in"
    base = dt.datetime(2024, 1, 1, 12)
    for rows in ([("A", base, 1, 1.0), ("A", base, 2, 2.0)], [("A", base + dt.timedelta(hours=5), 3, 3.0)],
                 # Spark drops late rows by the watermark of the batch before.
                 [("A", base + dt.timedelta(hours=5), 6, 6.0)], [("A", base + dt.timedelta(minutes=1), 4, 4.0), ("A", base + dt.timedelta(hours=6), 5, 5.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = st.read_stream(spark, folder, ticks(spark).schema, max_files=1)
    st.append_to(st.late_cutoff(stream, ("symbol", "ts"), "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    hours = sorted(r.ts.hour for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert hours == [12, 17, 18]


def test_news_counts_add_up_and_replay_changes_nothing(spark, make_bars, tmp_path):
    texts = [f"Common line here. Story number {'abc'[i % 3]} today. Unique {'x' * (i + 1)} text." for i in range(9)]
    data = [(i, "A", dt.date(2000, 1, 2 + i), v) for i, v in enumerate(texts)]
    articles = spark.createDataFrame(data, "id long, symbol string, published_date date, content string")
    bars = make_bars({"A": [10, 11, 9, 12, 8, 13, 7, 14, 6, 15, 5]})
    feed(articles, f"{tmp_path}/in", 3, "id")
    stream = st.read_stream(spark, f"{tmp_path}/in", articles.schema, max_files=1)
    st.news_refresh(stream, bars, f"{tmp_path}/out", f"{tmp_path}/state", None).awaitTermination()
    columns = ["sentence", "documents", "occurrences", "blacklisted"]
    want = sorted(news.sentence_counts(news.with_sentences(articles)).select(columns).collect())
    assert sorted(st.sentence_totals(spark, f"{tmp_path}/out").select(columns).collect()) == want
    # the merged total of the last batch is the sum of what all batches added
    merged = spark.read.parquet(st.slot(f"{tmp_path}/out/totals/sentences", 2))
    assert sorted(merged.select(columns).collect()) == want
    grams = ["gram", "n", "documents", "occurrences", "increase", "decrease"]
    total = spark.read.parquet(st.slot(f"{tmp_path}/out/totals/ngrams", 2))
    assert sorted(total.select(grams).collect()) == sorted(st.ngram_totals(spark, f"{tmp_path}/out").select(grams).collect())
    assert {d for d in os.listdir(f"{tmp_path}/out/totals/ngrams") if "=" in d} == {"slot=0", "slot=1"}
    moods = spark.read.parquet(f"{tmp_path}/out/moods")
    assert sorted(r.id for r in moods.collect()) == list(range(9))
    last = max(int(d.split("=")[1]) for d in os.listdir(f"{tmp_path}/out/sentence_counts") if "=" in d)
    again = spark.read.parquet(f"{tmp_path}/out/sentences/batch_id={last}")
    st.write_batch(news.sentence_counts(again), f"{tmp_path}/out/sentence_counts", last)
    assert sorted(st.sentence_totals(spark, f"{tmp_path}/out").select(columns).collect()) == want


def test_alerts(spark, landed, tmp_path):
    held = spark.createDataFrame([("A", 2.0, 100.0)], "symbol string, held double, investment double")
    out = st.alerts(st.read_stream(spark, landed, ticks(spark).schema), held, 0.5, 0.5)
    st.append_to(out, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    want = [r.price * 2 for r in ticks(spark).filter("symbol = 'A' and (price * 2 <= 50 or price * 2 >= 150)").collect()]
    assert sorted(r.worth for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(want)


def test_late_rows_of_the_table_are_dropped_and_state_is_evicted(spark, tmp_path):
    from tidemark.plans import streams as plans

    sf = "/root/testdata/sf0.001"
    low = spark.read.parquet(f"{sf}/events.parquet").agg(F.min("ts")).first()[0]
    out = plans.stream_late_dropped(spark, sf)
    assert out.count() > 0 and out.filter(F.col("ts") < F.date_trunc("minute", F.lit(low))).count() == 0
    bars = st.stream_bars(plans.as_ticks(plans.arriving_events(spark, sf)), "1 minute", plans.DELAY)
    query = st.log_changes(bars, f"{tmp_path}/out", f"{tmp_path}/state", mode="update")
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    total = st.read_log(spark, f"{tmp_path}/out", bars.schema).select("symbol", "ts").distinct().count()
    assert sum(p["numInputRows"] > 0 for p in progress) >= 3
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < total / 2
    assert all(s["numRowsDroppedByWatermark"] == 0 for p in progress for s in p["stateOperators"])


def test_predictions_over_batches_equal_one_run(spark):
    from tidemark.operators import forests as fo
    from tidemark.operators import resume
    from tidemark.plans import streams as plans

    sf, key = "/root/testdata/sf0.001", ["symbol", "trade_date", "horizon"]
    path, forests = plans.refreshed_predictions(spark, sf, numTrees=3, maxDepth=4)
    log = spark.read.parquet(f"{path}/predictions")
    assert log.select("batch_id").distinct().count() == 3
    assert {d for d in os.listdir(f"{path}/state") if d.startswith("slot")} == {"slot=0", "slot=1"}

    bars = plans.daily_bars(spark, sf, "region")
    whole = resume.advance(resume.empty_state(spark), bars).drop("state").join(bars.select("symbol", "trade_date", "close"), ["symbol", "trade_date"])
    span = F.lit(0)
    for date in plans.REFRESH_DATES[:3]:
        span = span + (F.col("trade_date") > F.lit(date).cast("date")).cast("int")
    numbered = whole.withColumn("span", span).filter("span > 0")
    newest = numbered.groupBy("symbol", "span").agg(F.max("trade_date").alias("trade_date"))
    asked = numbered.join(newest, ["symbol", "span", "trade_date"]).withColumn("horizon", F.explode(F.array(*map(F.lit, plans.HORIZONS))))
    want = fo.predict(forests, asked, plans.REFRESH_COLUMNS, key).collect()
    columns = [*key, "trees", "votes", "prediction"]
    assert sorted(log.select(columns).collect()) == sorted(want) and len(want) > 0
    assert {r.prediction for r in want} <= {0, 1}


def test_a_repeated_batch_goes_on_from_the_same_state(spark, make_bars, tmp_path):
    from tidemark.operators import forests as fo
    from tidemark.operators import resume
    from tidemark.session import written

    bars = make_bars({"A": [10 + i % 7 for i in range(60)], "B": [30 - i % 5 for i in range(50)]})
    spec, columns = resume.Spec(sma=(3,), ema=(4,), rsi=5), ["horizon", "close", "sma3", "rsi"]
    filled = resume.advance(resume.empty_state(spark), bars, spec).join(bars.select("symbol", "trade_date", "close"), ["symbol", "trade_date"])
    training = filled.withColumn("horizon", F.lit(1)).withColumn("label", (F.col("close") > 12).cast("int")).drop("state").dropna()
    forests = fo.store_forests(written(spark, training, ("symbol",)), columns, ["A", "B"], f"{tmp_path}/forests", numTrees=2, maxDepth=3)
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run():
        stream = st.read_stream(spark, folder, bars.schema)
        st.predicted_refresh(stream, out, f"{tmp_path}/checkpoint", resume.empty_state(spark), forests, columns, (1,), spec, None).awaitTermination()

    for low, high in ((0, 20), (20, 41), (41, 60)):
        part = bars.filter((F.datediff("trade_date", F.lit("2000-01-01")) >= low) & (F.datediff("trade_date", F.lit("2000-01-01")) < high))
        part.write.mode("append").parquet(folder)
        run()
    read = lambda: sorted(spark.read.parquet(f"{out}/predictions").collect(), key=str)
    want, state = read(), sorted(spark.read.schema(resume.STATE).parquet(f"{out}/state/slot=0").collect())
    # as if the driver had been lost after the last batch's tables were written and before its commit
    os.remove(f"{tmp_path}/checkpoint/commits/2")
    crc = f"{tmp_path}/checkpoint/commits/.2.crc"
    if os.path.exists(crc):
        os.remove(crc)
    run()
    assert read() == want and len(want) == 6
    assert sorted(spark.read.schema(resume.STATE).parquet(f"{out}/state/slot=0").collect()) == state
