import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import news
from tidemark.session import written


def frame(spark, *texts):
    data = [(i, "A", dt.date(2000, 1, 2 + i % 3), v) for i, v in enumerate(texts)]
    return spark.createDataFrame(data, "id long, symbol string, published_date date, content string")


def test_sentences(spark):
    df = frame(spark, "I DO NOT AGREE. Straße 12!  Really?\n\nNo  stop", "", "   ", "123. 456.", None)
    got = [r[0] for r in df.orderBy("id").select(t.clean_sentences(F.col("content"))).collect()]
    assert got == [["I DO !AGREE", "STRASSE", "REALLY", "NO STOP"], [], [""], [], None]


def test_single_and_document_cleaning_agree(spark):
    text = "Not here. It is not good, is it? 5 %. Tab\there.\n x"
    df = spark.createDataFrame([(text,)], "x string")
    whole = df.select(t.clean_sentences(F.col("x"))).head()[0]
    single = [r[0] for r in df.select(F.explode(t.split_sentences(F.col("x"))).alias("s")).select(t.clean_sentence(F.col("s"))).collect()]
    assert whole == [s for s in single if s is not None]


def test_grams(spark):
    df = spark.createDataFrame([(["ONE", "I AM !GOOD", "CAN!DO IT"],)], "s array<string>")
    got = df.withColumn("w", t.sentence_words(F.col("s"))).select(t.ngrams(F.col("w"), 2)).head()[0]
    assert got == ["I", "AM", "GOOD", "I AM", "AM GOOD", "CANDO", "IT", "CANDO IT"]
    three = df.withColumn("w", t.sentence_words(F.col("s"), True)).select(t.ngrams(F.col("w"), 3)).head()[0]
    assert three == ["I", "AM", "!GOOD", "I AM", "AM !GOOD", "I AM !GOOD"]


def test_boilerplate_is_removed_in_order(spark):
    df = news.with_sentences(frame(spark, *["Click here now. Text %s goes. Click here now. End of it." % w for w in ("one", "two", "three")]))
    counts = news.sentence_counts(df)
    click = counts.filter("sentence = 'CLICK HERE NOW'").head()
    assert (click.documents, click.occurrences, click.blacklisted) == (3, 6, True)
    got = {r.id: r.sentences for r in news.strip_boilerplate(df, counts).collect()}
    assert got[0] == ["TEXT ONE GOES", "END OF IT"]


def test_price_moves(spark, make_bars):
    bars = make_bars({"A": [10, 20]}).withColumn("trade_date", F.date_add("trade_date", 2))
    got = {r.published_date.day: r.move for r in news.price_moves(frame(spark, "a", "b", "c"), bars).collect()}
    assert got == {2: None, 3: None, 4: 50.0}


def test_scores_by_hand(spark, make_bars):
    bars = make_bars({"A": [10, 10, 5, 20, 1]}, spread=0)
    df = news.with_sentences(frame(spark, "good day", "bad day", "good bad", "x"))
    stats = news.ngram_stats(df, news.price_moves(df, bars))
    rise = {r.gram: (r.documents, r.increase, r.decrease) for r in stats.collect()}
    # Dates of the articles: 2nd (no change), 3rd (fall), 4th (rise), 2nd.
    assert rise["GOOD"] == (2, 2, 0) and rise["DAY"] == (2, 1, 1) and rise["BAD"] == (2, 1, 1)
    moods = {r.id: (r.score, r.mood) for r in news.article_sentiment(df, stats).collect()}
    assert moods[0][0] == pytest.approx((1 + 0.5 + 1) / 3)
    assert moods[3] == (-1.0, 0.5)


def test_duplicates(spark):
    data = [(1, "A", "h", "u1"), (2, "A", "h", "u2"), (3, "A", "g", "u1"), (4, "B", "h", "u1"), (5, "A", "h", "u1")]
    df = spark.createDataFrame(data, "id long, symbol string, headline string, url string").withColumn(
        "published_date", F.lit("2000-01-01").cast("date")
    )
    got = {r.id: r.duplicate for r in news.unique_articles(df).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}


def test_missing_headlines_and_times_of_a_day(spark):
    rows = [(1, "A", None, "u1", "d 10"), (2, "A", None, None, "d 10"), (3, "A", "h", "u1", "d 10"), (4, "A", "h", "u2", "d 11"), (5, "A", "h", "u2", "d 11")]
    feed = spark.createDataFrame(rows, "id long, symbol string, headline string, url string, published string")
    got = {r.id: r.duplicate for r in news.unique_articles(feed, "published").collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}


@pytest.mark.parametrize("hot", [2, 1000])
def test_grams_meet_their_statistics(spark, hot):
    rows = [(i, g) for i in range(40) for g in ("common gram", f"rare {i % 7}", f"own {i}")]
    known = [("common gram", 40, 0.5), *((f"rare {k}", 6, 0.25) for k in range(5))]
    stats = spark.createDataFrame(known, "gram string, documents long, share double").select(*news.gram_key(F.col("gram")), "documents", "share")
    met = news.join_grams(spark.createDataFrame(rows, "id long, gram string"), written(spark, stats), hot=hot, salts=4)
    got = Counter((r.id, r.share) for r in met.collect())
    assert got == Counter([(i, 0.5) for i in range(40)] + [(i, 0.25) for i in range(40) if i % 7 < 5])
    assert len({r.salt for r in met.filter("share = 0.5").collect()}) == (4 if hot == 2 else 1)


def test_counted_grams_are_those_of_the_columns(spark):
    rows = [(["ONE", "I AM !GOOD", "I AM I AM", "", "A  B "],), ([],), (None,), ([""],), (["I AM", "CAN!DO IT\tNOW SO"],)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, s array<string>").coalesce(1)
    for n in (1, 2, 3):
        for keep in (False, True):
            plain = df.select("id", F.explode(t.ngrams(t.sentence_words(F.col("s"), keep), n)).alias("gram"))
            want = Counter((r.id, r.gram) for r in plain.collect())
            got = t.add_gram_counts(df, "s", n, keep).select("id", F.inline("grams")).collect()
            assert {(r.id, r.gram): r.times for r in got} == want and len(got) == len(want), (n, keep)


def test_articles_that_share_an_id_are_counted_together(spark):
    df = spark.createDataFrame([(1, ["A B", "A B"]), (1, ["A C"]), (2, ["A B"]), (None, ["X Y"]), (None, ["X Z"])], "id long, sentences array<string>")
    got = [tuple(r) for r in news.article_grams(df).collect()]
    want = {(1, "A"): 3, (1, "B"): 2, (1, "A B"): 2, (1, "C"): 1, (1, "A C"): 1, (2, "A"): 1, (2, "B"): 1, (2, "A B"): 1,
            (None, "X"): 2, (None, "Y"): 1, (None, "X Y"): 1, (None, "Z"): 1, (None, "X Z"): 1}
    assert {r[:2]: r[2] for r in got} == want and len(got) == len(want)


def test_keyed_statistics_score_as_those_with_texts(spark, make_bars):
    bars = make_bars({"A": [10, 10, 5, 20, 1]}, spread=0)
    df = news.with_sentences(frame(spark, "good day", "bad day", "good bad good", "x"))
    moves = news.price_moves(df, bars)
    plain, keyed = news.ngram_stats(df, moves), news.ngram_stats(df, moves, keyed=True)
    assert "gram" not in keyed.columns and keyed.count() == plain.count()
    assert sorted(news.article_sentiment(df, keyed).collect()) == sorted(news.article_sentiment(df, plain).collect())


def test_grams_of_articles_need_no_grouping_by_text(spark):
    """Only ids that rows share meet in an exchange; grouping all grams sent every text through one."""
    from tidemark.plans import news as plans

    plan = plans.ngrams(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [id") == 1 and "LeftAnti" in plan and "LeftSemi" in plan


def test_scores_read_stored_keys_and_no_texts(spark):
    from tidemark.plans import news as plans

    sf = "/root/testdata/sf0.001"
    stored, stats = plans.gram_table(spark, sf)
    assert stored.columns == ["id", "symbol", "published_date", "grams"]
    assert stored.schema["grams"].dataType.elementType.fieldNames() == ["k1", "k2", "times"]
    texts, text_stats = plans.gram_table(spark, sf, keyed=False)
    rows = lambda df: sorted(df.select("id", F.round("score", 9)).collect())
    assert rows(news.article_sentiment(stored, stats)) == rows(news.article_sentiment(texts, text_stats))


def test_sentences_cleaned_over_arrow_are_those_of_the_columns(spark):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b.{c} {c}" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    texts += [None, "", "  ", "?! ", "I do NOT NOT agree.\n\nNot so!  \t x\x01\x01y \x0b", "Straße. ﬁne? ok", "not\tnow. not ! a.b . c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, x string").repartition(8)
    got = {r.id: r.s for r in t.add_clean_sentences(df, "x", "s").collect()}
    want = {r.id: r.s for r in df.select("id", t.clean_sentences(F.col("x")).alias("s")).collect()}
    assert got == want


def test_boilerplate_keys_are_the_blacklist(spark):
    df = news.with_sentences(frame(spark, "Five of it. a b. five of it. ", *["x %s. five of it. a b" % "abc"[i] for i in range(3)], None))
    flagged = news.sentence_counts(df).filter("blacklisted")
    keys = sorted(news.boilerplate(df).collect())
    assert keys == sorted(flagged.select(*news.gram_key(F.col("sentence"))).collect()) and len(keys) == 1
    removed = lambda counts: sorted(news.strip_boilerplate(df, counts).collect())
    assert removed(news.boilerplate(df)) == removed(news.sentence_counts(df))


def test_gram_keys_stand_for_texts(spark):
    long = "L" * 40
    rows = [(["A A", "A", "AB A", "A BA", "B A", f"{long} {long}M", ""],), (["A A", "!A B", "ÄÖ A"],), ([],), (None,)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, sentences array<string>").coalesce(1)
    for n in (1, 2, 3):
        named = [(r.id, r.gram, r.times) for r in t.add_gram_counts(df, "sentences", n).select("id", F.inline("grams")).collect()]
        keyed = [(r.id, (r.k1, r.k2), r.times) for r in t.add_gram_keys(df, "sentences", n).select("id", F.inline("grams")).collect()]
        assert [(i, c) for i, _, c in keyed] == [(i, c) for i, _, c in named]
        pairs = {(g, k) for (_, g, _), (_, k, _) in zip(named, keyed)}
        assert len(pairs) == len({g for g, _ in pairs}) == len({k for _, k in pairs})
        numbers = {r.id: r.count_ for r in t.add_gram_numbers(df, "sentences", n).collect()}
        assert numbers == {i: sum(r[0] == i for r in named) for i in range(4)}
        all_keys = spark.createDataFrame([k for _, k in pairs], "k1 long, k2 long")
        assert {tuple(r) for r in t.gram_keys(df, "sentences", n, t.key_bits(all_keys)).collect()} == {k for _, k in pairs}
        few = sorted(k for _, k in pairs)[::5]
        kept = {tuple(r) for r in t.gram_keys(df, "sentences", n, t.key_bits(spark.createDataFrame(few, "k1 long, k2 long"))).collect()}
        assert kept == set(few)
    assert not t.key_bits(all_keys.limit(0)).any()


def test_known_grams_look_up_only_what_articles_without_a_move_ask(spark):
    data = [
        (0, "A", dt.date(2000, 1, 1), ["good day", "a b c"]), (1, "A", dt.date(2000, 1, 2), ["good good", "b c d"]),
        (2, "B", dt.date(2000, 1, 1), ["good day", "c d e", "x y"]), (3, None, None, ["b c", "d"]), (4, "B", dt.date(2000, 1, 2), ["q r"]),
        (5, "B", dt.date(2000, 1, 3), []), (6, "A", dt.date(2000, 1, 2), []),
    ]
    df = spark.createDataFrame(data, "id long, symbol string, published_date date, sentences array<string>")
    moved = [("A", dt.date(2000, 1, 1), 1.0), ("A", dt.date(2000, 1, 2), -1.0), ("B", dt.date(2000, 1, 1), None)]
    moves = spark.createDataFrame(moved, "symbol string, published_date date, move double")
    got = {r.id: (r.count_, r.known) for r in news.known_grams(written(spark, news.with_gram_numbers(df)), moves).collect()}
    stats = {r.gram for r in news.ngram_stats(df, moves).collect()}
    grams = {r.id: {g.gram for g in r.grams} for r in news.with_grams(df).collect()}
    assert got == {i: (len(g), len(g & stats)) for i, g in grams.items()}


def test_scored_articles_send_no_grams_of_counted_articles_through_an_exchange(spark):
    from tidemark.plans import news as plans

    df = plans.score_articles(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # The grams of articles without a move are the only ones that are exploded.
    assert plan.count("Generate inline(grams") == 1
    grams, known, n = df.agg(F.sum("grams"), F.sum("known"), F.count("*")).head()
    stored, stats = plans.gram_table(spark, "/root/testdata/sf0.001")
    rows = stored.select(F.inline("grams"))
    assert (grams, known) == (rows.count(), rows.join(stats, ["k1", "k2"]).count())
    assert n == stored.filter(F.size("grams") > 0).count()
