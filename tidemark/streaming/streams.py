"""Price and news pipelines as Structured Streaming queries.

Sinks that replace rows keep a change log: every micro-batch overwrites its
own ``batch_id`` partition, so a repeated batch leaves no trace, and readers
take the newest version of each key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import packed
from tidemark.functions import text as t
from tidemark.operators import forests as fo
from tidemark.operators import news, resume
from tidemark.operators.bars import bars_from_ticks
from tidemark.operators.series import chunk_of, chunked_ema
from tidemark.session import shuffles_removed, written


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Parquet files below ``path``, or a single file, as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # As a pattern the path may name one file as well as a folder.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def _start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def append_to(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return _start(df.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, every)


def write_batch(batch: DataFrame, path: str, batch_id: int, compression: str = "snappy") -> None:
    with shuffles_removed(batch.sparkSession):
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}", compression=compression)


def log_changes(
    df: DataFrame, path: str, checkpoint: str, every: str | None = None, mode: str = "append",
    then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Write each micro-batch as one version, then run ``then`` on what was written."""
    schema = df.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)
        if then is not None:
            then(batch.sparkSession.read.schema(schema).parquet(f"{path}/batch_id={batch_id}"), batch_id)

    return _start(df.writeStream.outputMode(mode).foreachBatch(write), checkpoint, every)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    versioned = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(versioned).parquet(path)


def current_rows(log: DataFrame, key: Sequence[str], order: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Newest version per key: the last write wins."""
    version = F.struct(*order) if len(order) > 1 else F.col(order[0])
    values = [c for c in log.columns if c not in key and c != "batch_id"]
    return log.groupBy(*key).agg(*[F.max_by(c, version).alias(c) for c in values])


def stream_bars(ticks: DataFrame, interval: str, delay: str) -> DataFrame:
    """Bars of a tick stream; ticks later than ``delay`` no longer change their bar."""
    return bars_from_ticks(ticks.withWatermark("ts", delay), interval)


def late_cutoff(rows: DataFrame, key: Sequence[str], delay: str) -> DataFrame:
    """Drops rows older than the newest one by more than ``delay``, and repeats of a key within it."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(key))


def slot(path: str, batch_id: int) -> str:
    """Folder of the state after a batch. Two take turns, so a repeated batch starts from the same state as the first
    time, a broken write hurts only the state after it, and the folders do not grow with the batches."""
    return f"{path}/slot={batch_id % 2}"


def state_before(first: DataFrame, path: str, batch_id: int) -> DataFrame:
    """What the batch before stored, or ``first`` for the first batch."""
    return first if batch_id == 0 else first.sparkSession.read.schema(first.schema).parquet(slot(path, batch_id - 1))


def write_state(state: DataFrame, path: str, batch_id: int, compression: str = "snappy") -> None:
    with shuffles_removed(state.sparkSession):
        state.write.mode("overwrite").parquet(slot(path, batch_id), compression=compression)


def stream_ema(
    bars: DataFrame, alpha: float, path: str, checkpoint: str, price: str = "close", span: str = "day", every: str | None = None
) -> StreamingQuery:
    """Exponential average that carries one value per symbol between micro-batches, written to ``path``/averages.

    Input is bars in order of arrival, at most one per symbol and time; within a batch they are put in order of time. A
    batch is cut into chunks of one symbol and ``span``, which run side by side: only a pair of numbers per chunk is put
    in order per symbol.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = state_before(spark.createDataFrame([], "symbol string, entered double"), f"{path}/carried", batch_id)
        chunked = batch.select("symbol", "ts", price).withColumn("chunk", chunk_of("ts", span))
        averaged = chunked_ema(chunked, price, "ema", alpha, "chunk", "ts", entering=known).select("symbol", "ts", "ema")
        write_batch(averaged, f"{path}/averages", batch_id)
        done = spark.read.schema(averaged.schema).parquet(f"{path}/averages/batch_id={batch_id}")
        last = done.groupBy("symbol").agg(F.max_by("ema", "ts").alias("entered"))
        write_state(last.unionByName(known.join(last, "symbol", "left_anti")), f"{path}/carried", batch_id)

    return _start(bars.writeStream.outputMode("append").foreachBatch(refresh), checkpoint, every)


def alerts(quotes: DataFrame, held: DataFrame, loss: float, profit: float) -> DataFrame:
    """Quotes at which a position's worth leaves its limits; ``held`` is a static table."""
    worth = F.col("price") * F.col("held")
    low, high = F.col("investment") * (1 - loss), F.col("investment") * (1 + profit)
    return (
        quotes.join(held.select("symbol", "held", "investment"), "symbol")
        .withColumn("worth", worth)
        .filter((F.col("worth") <= low) | (F.col("worth") >= high))
        .select("symbol", "ts", "worth")
    )


def minute_refresh(
    ticks: DataFrame, path: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame],
    every: str | None = "1 minute", delay: str = "1 day",
) -> StreamingQuery:
    """Bars of new ticks, and ``compute`` over the bars of the symbols they touch, per trigger."""
    bars = stream_bars(ticks, "1 minute", delay)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = current_rows(read_log(spark, f"{path}/bars", bars.schema), ("symbol", "ts"))
        touched = stored.join(batch.select("symbol").distinct(), "symbol", "left_semi")
        write_batch(compute(touched), f"{path}/derived", batch_id)

    return log_changes(bars, f"{path}/bars", checkpoint, every, "update", refresh)


def predicted_refresh(
    bars: DataFrame, path: str, checkpoint: str, state: DataFrame, forests: DataFrame, columns: Sequence[str],
    horizons: Sequence[int], spec: resume.Spec = resume.Spec(), every: str | None = "1 minute",
) -> StreamingQuery:
    """Indicators of new daily bars, and each refreshed symbol's prediction by its own forest, per trigger.

    Older bars are not read: a batch goes on from the state that the batch before it stored, the first one from
    ``state``. ``columns`` may name the horizon, the close and the columns of ``spec``.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = state_before(state, f"{path}/state", batch_id)
        advanced = resume.advance(known, batch, spec)
        write_batch(advanced, f"{path}/indicators", batch_id)
        filled = spark.read.schema(advanced.schema).parquet(f"{path}/indicators/batch_id={batch_id}")
        write_state(resume.next_state(filled, known), f"{path}/state", batch_id)
        newest = filled.filter("state is not null").withColumn("close", F.element_at("state.closes", -1)).drop("state")
        asked = newest.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
        write_batch(fo.predict(forests, asked, columns, ("symbol", "trade_date", "horizon")), f"{path}/predictions", batch_id)

    return _start(bars.writeStream.outputMode("append").foreachBatch(refresh), checkpoint, every)


def news_refresh(
    articles: DataFrame, bars: DataFrame, path: str, checkpoint: str, every: str | None = "1 hour", n: int = 2
) -> StreamingQuery:
    """Sentence counts, gram statistics and moods of new articles, per trigger.

    Sentences, counts, statistics and moods that a batch adds are stored under its batch id, so running a
    batch again changes nothing. A batch reads one total, the one merged by the batch before it, and none of
    the earlier batches; what the first batch adds is a total already. Hashes are made from texts where totals are read.
    """

    totals_of = {"sentence_counts": f"{path}/totals/sentences", "ngrams": f"{path}/totals/ngrams"}

    def known(spark: SparkSession, name: str, batch_id: int) -> DataFrame:
        before = f"{path}/{name}/batch_id=0" if batch_id == 1 else slot(totals_of[name], batch_id - 1)
        return spark.read.parquet(before)

    def merged(added: DataFrame, name: str, batch_id: int, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if batch_id == 0:
            return added
        spark, totals = added.sparkSession, totals_of[name]
        write_state(add(known(spark, name, batch_id).unionByName(added)).drop("hash"), totals, batch_id, "zstd")
        return spark.read.schema(added.schema).parquet(slot(totals, batch_id))

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch(news.with_sentences(batch), f"{path}/sentences", batch_id, "zstd")
        sentenced = spark.read.parquet(f"{path}/sentences/batch_id={batch_id}")
        write_batch(news.sentence_counts(sentenced).drop("hash"), f"{path}/sentence_counts", batch_id, "zstd")
        counted = spark.read.parquet(f"{path}/sentence_counts/batch_id={batch_id}")
        totals = merged(counted, "sentence_counts", batch_id, add_sentences)
        stripped, buckets = news.strip_boilerplate(sentenced, totals), packed.buckets_of(sentenced)
        moves = written(spark, news.price_moves(sentenced, bars))
        write_batch(news.ngram_stats(stripped, moves, n, buckets=buckets).drop("hash"), f"{path}/ngrams", batch_id, "zstd")
        merged(spark.read.parquet(f"{path}/ngrams/batch_id={batch_id}"), "ngrams", batch_id, add_ngrams)
        before = known(spark, "ngrams", batch_id) if batch_id else None
        stats = news.ngram_stats(stripped, moves, n, keyed=True, buckets=buckets, known=before)
        write_batch(news.article_sentiment(stripped, stats, n), f"{path}/moods", batch_id)

    return _start(articles.writeStream.outputMode("append").foreachBatch(refresh), checkpoint, every)


def add_sentences(counts: DataFrame) -> DataFrame:
    """Counts of sentences from several batches as one."""
    return counts.groupBy("sentence").agg(
        F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences")
    ).withColumn("hash", t.text_hash(F.col("sentence"))).withColumn("blacklisted", F.col("occurrences") >= news.BOILERPLATE_OCCURRENCES)


def add_ngrams(stats: DataFrame) -> DataFrame:
    """Gram statistics from several batches as one."""
    counts = ("documents", "occurrences", "increase", "decrease")
    added = stats.groupBy("gram").agg(*[F.sum(c).alias(c) for c in counts])
    return added.withColumn("n", F.size(F.split("gram", " "))).withColumn("hash", t.text_hash(F.col("gram")))


def sentence_totals(spark: SparkSession, path: str) -> DataFrame:
    return _total(spark, f"{path}/sentence_counts", "sentence", add_sentences)


def ngram_totals(spark: SparkSession, path: str) -> DataFrame:
    return _total(spark, f"{path}/ngrams", "gram", add_ngrams)


def _total(spark: SparkSession, path: str, key: str, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sum of what all batches added. The first batch alone is a sum already."""
    log = spark.read.parquet(path)
    if log.filter("batch_id > 0").isEmpty():
        return log.drop("batch_id").withColumn("hash", t.text_hash(F.col(key)))
    return add(log)
