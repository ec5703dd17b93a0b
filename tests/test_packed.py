import datetime as dt
import time

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import packed
from tidemark.functions import text as t
from tidemark.operators import news
from tidemark.session import written

DAY = dt.date(2000, 1, 1)
LONG = "L" * 40
ROWS = [
    (0, "A", DAY, ["GOOD DAY", "A B C", f"{LONG} {LONG}M", "X\nY Z"]), (1, "A", DAY, ["GOOD GOOD", "!B C D", ""]), (2, "B", DAY, ["GOOD DAY", "Q R"]),
    (3, None, None, ["B C", "D"]), (None, "A", DAY, ["GOOD DAY"]), (None, "B", DAY, ["A B"]), (7, "B", dt.date(2000, 1, 2), ["GOOD DAY"]),
    (8, "C", DAY, ["GOOD DAY", "A B C"]), (8, "C", DAY, ["GOOD DAY", "A B C"]), (9, "A", DAY, []), (10, "A", DAY, None), (11, "C", DAY, ["ALONE"]),
]
MOVES = [("A", DAY, 1.0), ("B", DAY, -1.0), ("B", dt.date(2000, 1, 2), None), ("C", DAY, 0.0)]


def articles(spark):
    return spark.createDataFrame(ROWS, "id long, symbol string, published_date date, sentences array<string>")


def moves(spark):
    return spark.createDataFrame(MOVES, "symbol string, published_date date, move double")


def test_packed_scores_are_those_of_the_keyed_statistics(spark):
    rows = lambda df: sorted(map(str, df.select("id", "symbol", "published_date", F.round("score", 9), F.round("mood", 9)).collect()))
    want = rows(news.article_sentiment(articles(spark), news.ngram_stats(articles(spark), moves(spark), keyed=True)))
    for parts, buckets in ((1, 2), (5, 64)):
        df = articles(spark).repartition(parts)
        got = rows(news.article_sentiment(df, news.ngram_stats(df, moves(spark), keyed=True, buckets=buckets)))
        assert got == want and len(got) == len(ROWS), (parts, buckets)
    none = articles(spark).limit(0)
    assert news.article_sentiment(none, news.ngram_stats(none, moves(spark), keyed=True, buckets=2)).count() == 0


def test_packed_statistics_are_those_of_the_grams(spark):
    df = articles(spark).coalesce(1)
    for n in (1, 3):
        want = {r.gram: (r.documents, r.increase) for r in news.ngram_stats(df, moves(spark), n).collect()}
        got, pairs = {}, 0
        for r in news.ngram_stats(df, moves(spark), n, keyed=True, buckets=4).collect():
            pairs += r.pairs
            if r.heads is None:
                lengths = packed._restored(bytes(r.lengths), "u4", r.entries)
                text = packed._codec().decompress(bytes(r.grams), int(lengths.sum()), asbytes=True)
                ends = lengths.cumsum().tolist()
                grams = [text[a:b].decode() for a, b in zip([0, *ends], ends)]
                assert grams == sorted(grams, key=lambda g: (len(g.split(" ")), g.split(" ")))
                for g, d, i in zip(grams, memoryview(r.documents).cast("q"), memoryview(r.increase).cast("q")):
                    assert g not in got
                    got[g] = d, i
        assert pairs == 0 and {g: s for g, s in got.items() if s[0]} == want


def test_scores_send_packed_grams_through_one_exchange(spark):
    from tidemark.plans import news as plans

    sf = "/root/testdata/sf0.001"
    sentenced, moved = plans.dealt_articles(spark, sf, ())
    stats = news.ngram_stats(plans.stripped_of(spark, sentenced), moved, keyed=True, buckets=packed.buckets_of(sentenced))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(bucket") == plan.count("Exchange hashpartitioning") == 1
    sent = sum(len(r.grams) + len(r.places) + len(r.counts) + len(r.lengths) for r in stats.filter("heads is null").collect())
    pairs = t.add_gram_numbers(plans.stripped_of(spark, sentenced), "sentences", 2).agg(F.sum("count_")).head()[0]
    # a key and its number alone take 24 bytes
    assert sent < 12 * pairs


def test_a_lost_pack_is_an_error(spark):
    stats = news.ngram_stats(articles(spark).coalesce(1), moves(spark), keyed=True, buckets=4)
    whole = packed.article_totals(stats, articles(spark).select(*news.ARTICLE)).count()
    assert whole == len(ROWS)
    most = stats.agg(F.max("entries")).head()[0]
    lost = stats.filter((F.col("entries") != most) | F.col("heads").isNotNull())
    try:
        packed.article_totals(lost, articles(spark).select(*news.ARTICLE)).count()
    except Exception as error:
        assert "are missing" in str(error)
    else:
        raise AssertionError("no error")


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = lambda: {f.getName() for f in (found.apply(i) for found in [files()] for i in range(found.size()))}
    before = {n for n in names() if n.startswith("shuffle")}
    kept = written(spark, spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not (left := {n for n in names() if n.startswith("shuffle")} - before):
            break
        time.sleep(0.2)
    assert not left and kept.count() == 7


def test_sentences_are_dropped_by_both_parts_of_their_keys(spark):
    df = articles(spark)
    key = news.gram_key(F.col("sentence"))
    black = spark.createDataFrame([("GOOD DAY",), ("",)], "sentence string").select(*key)
    near = black.union(black.select("k1", (F.col("k2") + 1).alias("k2"))).union(black.select("k1", (F.col("k2") - 1).alias("k2")))
    other = spark.createDataFrame([("A B C",)], "sentence string").select(*key).select("k1", (F.col("k2") + 1).alias("k2"))
    want = sorted(str([s for s in r[3] or [] if s not in ("GOOD DAY", "")]) for r in ROWS)
    for keys in (black, near, black.union(other)):
        got = t.drop_sentences(df, "sentences", news.gram_key, keys.toArrow())
        assert got.schema == df.schema and sorted(str(r.sentences) for r in got.collect()) == want
    none = pa.table({"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int64())})
    assert [len(r.sentences) for r in t.drop_sentences(df, "sentences", news.gram_key, none).collect()] == [len(r[3] or []) for r in ROWS]


def test_packed_rows_are_the_statistics(spark):
    df = articles(spark).repartition(3)
    for n in (1, 3):
        got = news.ngram_stats(df, moves(spark), n, buckets=4)
        want = news.ngram_stats(df, moves(spark), n)
        assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())


def test_known_statistics_add_to_those_of_the_articles(spark):
    from tidemark.streaming import streams as st

    first, then = articles(spark).filter("id < 2").coalesce(1), articles(spark).filter("id >= 2 or id is null").repartition(2)
    before = news.ngram_stats(first, moves(spark))
    totals = st.add_ngrams(before.unionByName(news.ngram_stats(then, moves(spark))))
    rows = lambda df: sorted(map(str, df.select("id", "symbol", "published_date", F.round("score", 9)).collect()))
    want = rows(news.article_sentiment(then, totals))
    got = rows(news.article_sentiment(then, news.ngram_stats(then, moves(spark), keyed=True, buckets=8, known=before)))
    assert got == want != rows(news.article_sentiment(then, news.ngram_stats(then, moves(spark), keyed=True, buckets=8)))


def test_the_stream_stores_each_text_once(spark):
    import os

    from tidemark.plans import streams as plans

    path = plans.refreshed_news(spark, "/root/testdata/sf0.001")
    # the first batch is a total itself, and grams of articles are not stored
    assert not os.path.exists(f"{path}/totals") and not os.path.exists(f"{path}/stripped")
    log = spark.read.parquet(f"{path}/ngrams")
    assert "hash" not in log.columns and log.count() == log.select("gram").distinct().count()
