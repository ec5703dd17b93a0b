"""Feature-set, export and classifier queries."""

from __future__ import annotations

from itertools import product

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.operators import forests as fo
from tidemark.operators import indicators as ind
from tidemark.operators import models as md
from tidemark.operators import news, rows
from tidemark.operators import shared_fits as shared
from tidemark.plans import sql
from tidemark.plans import series as ser
from tidemark.plans.ledger import SIGNALS, signals
from tidemark.plans.news import TO_SCORES, scored_articles
from tidemark.plans.portfolio import symbols, uniform_sql
from tidemark.plans.registry import query
from tidemark.plans.views import HORIZONS, daily_bars
from tidemark.session import shared_dir, written
from tidemark.sources import exports

ORD = ser.ORD
KEY = ["symbol", "trade_date"]
PLAIN = ft.feature_columns(indicators=False)
FULL = ft.feature_columns()
MOODED = ft.feature_columns(sentiment=True)

CHANGE = f"coalesce((close - lag(close) OVER {ORD}) / lag(close) OVER {ORD}, 0) AS percent_change"
LABELS = "labels AS (" + " UNION ALL ".join(
    f"SELECT symbol, trade_date, {h}::INTEGER AS horizon, CAST(CASE WHEN lead(close, {h}) OVER {ORD} - close >= 0 THEN 1 "
    f"WHEN lead(close, {h}) OVER {ORD} IS NOT NULL THEN 0 END AS INTEGER) AS label FROM bars" for h in HORIZONS) + ")"
CHANGED = f"changed AS (SELECT *, {CHANGE} FROM bars)"
PLAIN_ROWS = """SELECT symbol, trade_date, horizon, open, high, low, close, volume, percent_change, label
FROM changed JOIN labels USING (symbol, trade_date) WHERE label IS NOT NULL"""
INDICATOR_SQL = ", ".join(map(ser.all_sql, ind.INDICATORS))


@query("training_set", sql.region(
    f"SELECT symbol, scan.trade_date, horizon, open, high, low, c.close, volume, percent_change, {INDICATOR_SQL}, label FROM scan "
    "JOIN plain USING (symbol, rn) JOIN changed c ON c.symbol = scan.symbol AND c.trade_date = scan.trade_date "
    "JOIN labels l ON l.symbol = scan.symbol AND l.trade_date = scan.trade_date WHERE label IS NOT NULL AND rn >= 200".replace(
        "SELECT symbol", "SELECT scan.symbol").replace("scan.trade_date, horizon", "scan.trade_date AS trade_date, horizon"),
    ser.EMA_BASE.replace("base AS", "ema_base AS"), ser.RSI_BASE, ser.ADX_BASE, ser.ALL_BASE, ser.ALL_PLAIN, CHANGED, LABELS,
    sql.scan({**ser.EMA_STATES, **ser.MACD_STATES, **ser.RSI_STATES, **ser.ADX_STATES}), recursive=True).replace(
        "SELECT scan.scan.symbol", "SELECT scan.symbol").replace("volume, percent_change,", "c.volume, percent_change,"))
def training_set(spark, sf):
    table = ft.training_set(daily_bars(spark, sf, "region"), HORIZONS)
    exact = {"symbol", "trade_date", "label", *PLAIN, *[f"sma{n}" for n in ind.SMA_PERIODS]}
    return table.select(*[c if c in exact else ser.settle(c, 3) for c in table.columns])


@query("training_set_sentiment", sql.brand("""
SELECT symbol, trade_date, horizon, open, high, low, close, volume, percent_change, round(coalesce(m, 0.5), 6) AS sentiment, label
FROM changed JOIN labels USING (symbol, trade_date)
LEFT JOIN (SELECT symbol, published_date AS trade_date, avg(mood) AS m FROM scored GROUP BY ALL) USING (symbol, trade_date)
WHERE label IS NOT NULL""", *TO_SCORES, CHANGED, LABELS))
def training_set_sentiment(spark, sf):
    mood = scored_articles(spark, sf).groupBy("symbol", F.col("published_date").alias("trade_date")).agg(F.avg("mood").alias("sentiment"))
    table = ft.training_set(daily_bars(spark, sf), HORIZONS, indicators=False, sentiment=mood)
    return table.withColumn("sentiment", F.round("sentiment", 6))


VARIANT_BASE = f"base AS (SELECT symbol, trade_date, close, row_number() OVER {ORD} AS rn FROM bars)"
VARIANT_STATES = {f"y{i}": ("b.close", f"s.y{i} + {a!r} * (b.close - s.y{i})") for i, a in enumerate(ft.ALPHAS)}
VARIANT_PRICES = "series AS (SELECT symbol, rn, 1.0::DOUBLE AS alpha, close AS p FROM base" + "".join(
    f" UNION ALL SELECT symbol, rn, {a!r}::DOUBLE, y{i} FROM scan" for i, a in enumerate(ft.ALPHAS)) + ")"


def region_scores(spark, sf):
    """Articles scored on the prices of the regions, to which they are dealt by id."""
    return scored_articles(spark, sf, symbols(spark, sf))


def region_mood(scored):
    """Mean mood per region and day."""
    return scored.groupBy("symbol", F.col("published_date").alias("trade_date")).agg(F.avg("mood").alias("sentiment"))


def written_variants(spark, sf):
    """Training rows of all 40 variants, in one folder per variant."""
    mood = written(spark, region_mood(region_scores(spark, sf)))
    return written(spark, ft.variant_grid(daily_bars(spark, sf, "region"), HORIZONS, sentiment=mood), ("variant",))


def variant_counts(grid, *key):
    return grid.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("rises"))


@query("variant_grid", sql.region(f"""
SELECT alpha, horizon, indicators, count(*) AS rows, CAST(sum(label) AS BIGINT) AS rises FROM (
  SELECT alpha, rn, horizon, CASE WHEN ahead - p >= 0 THEN 1 ELSE 0 END AS label FROM (""" + " UNION ALL ".join(
    f"SELECT alpha, rn, p, {h}::INTEGER AS horizon, lead(p, {h}) OVER (PARTITION BY symbol, alpha ORDER BY rn) AS ahead FROM series" for h in HORIZONS)
    + """) WHERE ahead IS NOT NULL), (VALUES (true), (false)) AS i(indicators)
WHERE NOT indicators OR rn >= 200 GROUP BY ALL""", VARIANT_BASE, sql.scan(VARIANT_STATES), VARIANT_PRICES, recursive=True))
def variant_grid(spark, sf):
    # the SQL counts one of the two sentiment sets, which have the same rows
    return variant_counts(written_variants(spark, sf).filter("not with_sentiment"), "alpha", "horizon", "indicators")


@query("variant_grid_sentiment", sql.region(f"""
SELECT alpha, horizon, indicators, with_sentiment, count(*) AS rows, CAST(sum(label) AS BIGINT) AS rises FROM (
  SELECT alpha, rn, horizon, CASE WHEN ahead - p >= 0 THEN 1 ELSE 0 END AS label FROM (""" + " UNION ALL ".join(
    f"SELECT alpha, rn, p, {h}::INTEGER AS horizon, lead(p, {h}) OVER (PARTITION BY symbol, alpha ORDER BY rn) AS ahead FROM series" for h in HORIZONS)
    + """) WHERE ahead IS NOT NULL), (VALUES (true), (false)) AS i(indicators), (VALUES (true), (false)) AS m(with_sentiment)
WHERE NOT indicators OR rn >= 200 GROUP BY ALL""", VARIANT_BASE, sql.scan(VARIANT_STATES), VARIANT_PRICES, recursive=True))
def variant_grid_sentiment(spark, sf):
    return variant_counts(written_variants(spark, sf), "alpha", "horizon", "indicators", "with_sentiment")


@query("split_70_30", sql.brand(f"""
SELECT symbol, trade_date, CASE WHEN {uniform_sql('symbol', 'CAST(trade_date AS VARCHAR)')} < 0.7 THEN 'train' ELSE 'test' END AS part FROM bars"""))
def split_70_30(spark, sf):
    return ft.split_rows(daily_bars(spark, sf).select(*KEY), 0.7, *KEY)


@query("feature_null_report", sql.brand(" UNION ALL ".join(
    f"SELECT count(*) AS rows, 'sma{n}' AS feature, count(*) FILTER (rn < {n}) AS nulls FROM numbered" for n in ind.SMA_PERIODS),
    f"numbered AS (SELECT row_number() OVER {ORD} AS rn FROM bars)"))
def feature_null_report(spark, sf):
    return ft.null_report(ind.sma(daily_bars(spark, sf)), [f"sma{n}" for n in ind.SMA_PERIODS])


ACCURACY = """
guesses AS (SELECT symbol, signal AS prediction, label FROM signals JOIN labels USING (symbol, trade_date, horizon) WHERE label IS NOT NULL)"""


def guesses(spark, sf):
    labels = ind.direction_labels(daily_bars(spark, sf, "region"), HORIZONS).select(*KEY, "horizon", "label")
    return signals(spark, sf).join(labels, [*KEY, "horizon"]).select("symbol", F.col("signal").alias("prediction"), "label")


@query("model_accuracy", sql.region("""
SELECT symbol, avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS rows FROM guesses GROUP BY symbol""",
    SIGNALS, LABELS, ACCURACY))
def model_accuracy(spark, sf):
    return ft.model_accuracy(guesses(spark, sf))


@query("label_nominal", sql.region("SELECT symbol, trade_date, horizon, label, CAST(label AS DOUBLE) AS label_index FROM labels WHERE label IS NOT NULL", LABELS))
def label_nominal(spark, sf):
    labels = ind.direction_labels(daily_bars(spark, sf, "region"), HORIZONS).select(*KEY, "horizon", "label")
    return md.nominal_label(labels)


# --- exports -----------------------------------------------------------------------


@query("export_training_csv", sql.region(PLAIN_ROWS, CHANGED, LABELS))
def export_training_csv(spark, sf):
    table = ft.training_set(daily_bars(spark, sf, "region"), HORIZONS, indicators=False)
    path = shared_dir(spark)
    exports.export_csv(table, path)
    return spark.read.schema(table.schema).option("header", True).csv(path)


@query("export_libsvm", sql.region(
    "SELECT CAST(label AS DOUBLE) AS label, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in PLAIN) + f" FROM ({PLAIN_ROWS})", CHANGED, LABELS))
def export_libsvm(spark, sf):
    table = ft.training_set(daily_bars(spark, sf, "region"), HORIZONS, indicators=False)
    path = shared_dir(spark)
    exports.export_libsvm(table, path, PLAIN)
    loaded = exports.load_libsvm(spark, path, len(PLAIN)).withColumn("v", vector_to_array("features"))
    return loaded.select("label", *[F.col("v")[i].alias(c) for i, c in enumerate(PLAIN)])


@query("load_replay_records", sql.region("SELECT symbol, trade_date, close, coalesce(CASE WHEN row_number() OVER "
       f"{ORD} >= 20 THEN avg(close) OVER {ser.over(20)} END, 0) AS sma20 FROM bars"))
def load_replay_records(spark, sf):
    table = ind.smooth(ind.percent_change(daily_bars(spark, sf, "region")))
    path = shared_dir(spark)
    exports.export_replay(ind.all_indicators(table), path)
    return exports.load_replay(spark, path).select(*KEY, "close", "sma20")


# --- classifiers -------------------------------------------------------------------


def training_table(spark, sf, partition_by=()):
    return written(spark, ft.training_set(daily_bars(spark, sf, "region"), HORIZONS), partition_by)


def scores(spark, found):
    return spark.createDataFrame(sorted(found.items()), "name string, accuracy double")


@query("rf_per_symbol")
def rf_per_symbol(spark, sf):
    training = training_table(spark, sf, ("symbol",))
    fitted = md.forest_per_symbol(training, FULL, symbols(spark, sf))
    return scores(spark, {symbol: score for symbol, (score, _) in fitted.items()})


@query("symbol_forest_votes", sql.region(f"""
SELECT symbol, max(trade_date) AS trade_date, horizon, 100::INTEGER AS trees, 100.0::DOUBLE AS votes FROM bars,
  (VALUES {", ".join(f"({h}::INTEGER)" for h in HORIZONS)}) AS h(horizon) GROUP BY symbol, horizon HAVING count(*) > 200"""))
def symbol_forest_votes(spark, sf):
    """How each symbol's own forest votes on its latest row, over each horizon: trees asked and shares cast."""
    training = training_table(spark, sf, ("symbol",))
    forests = fo.store_forests(training, FULL, symbols(spark, sf), shared_dir(spark))
    latest = rows.latest_features(ft.features(daily_bars(spark, sf, "region")), list(ind.INDICATORS))
    asked = latest.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
    found = fo.predict(forests, asked, FULL, [*KEY, "horizon"])
    return found.select(*KEY, "horizon", "trees", F.round(F.aggregate("votes", F.lit(0.0), lambda a, b: a + b), 6).alias("votes"))


@query("rf_multi")
def rf_multi(spark, sf):
    names = symbols(spark, sf)
    score = md.held_out_accuracy(md.multi_pipeline(FULL, len(names)), training_table(spark, sf))
    return scores(spark, {"all symbols": score})


@query("predict_direction")
def predict_direction(spark, sf):
    names = symbols(spark, sf)
    bars = daily_bars(spark, sf, "region")
    scored = written(spark, region_scores(spark, sf))
    table = written(spark, ft.features(bars, sentiment=region_mood(scored)))
    labelled = ind.direction_labels(table, HORIZONS).dropna(subset=MOODED)
    model = md.multi_pipeline(MOODED, len(names)).fit(labelled)
    # the rows to predict have the sentiment of the latest trade date
    today = news.latest_day_sentiment(bars, scored).select("symbol", "sentiment")
    latest = rows.latest_features(table, list(ind.INDICATORS)).drop("sentiment").join(today, "symbol")
    return md.predict_direction(model, latest, HORIZONS)


@query("clf_logistic")
def clf_logistic(spark, sf):
    return scores(spark, {"logistic": md.held_out_accuracy(md.logistic(FULL), training_table(spark, sf))})


@query("clf_random_forest")
def clf_random_forest(spark, sf):
    return scores(spark, {"random_forest": md.held_out_accuracy(md.deep_forest(FULL), training_table(spark, sf))})


@query("clf_mlp")
def clf_mlp(spark, sf):
    training = training_table(spark, sf)
    grid = {k: v for k, v in md.classifiers(FULL).items() if k.startswith("perceptron")}
    return scores(spark, md.held_out_accuracies(grid, training))


@query("clf_svm")
def clf_svm(spark, sf):
    training = training_table(spark, sf)
    grid = {k: v for k, v in md.classifiers(FULL).items() if k.startswith("svm")}
    return scores(spark, md.held_out_accuracies(grid, training))


def variant_tables(grid):
    """Rows and own feature columns of every variant of the written grid."""
    variants = {}
    for alpha, indicators, mood in product((1.0, *ft.ALPHAS), (False, True), (False, True)):
        name = f"a_{alpha}" + "_ind" * indicators + "_sent" * mood
        variants[name] = grid.filter(F.col("variant") == name), ft.feature_columns(alpha != 1.0, indicators, mood)
    return variants


def variant_columns(grid):
    return {name: columns for name, (_, columns) in variant_tables(grid).items()}


@query("experiment_rows", sql.region(f"""
SELECT 'a_' || CAST(alpha AS VARCHAR) || CASE WHEN indicators THEN '_ind' ELSE '' END || CASE WHEN with_sentiment THEN '_sent' ELSE '' END AS variant,
  count(*) FILTER (train) AS train_rows, count(*) FILTER (NOT train) AS test_rows FROM (
  SELECT alpha, rn, ahead, {uniform_sql('symbol', 'CAST(trade_date AS VARCHAR)', 'CAST(horizon AS VARCHAR)')} < 0.7 AS train FROM (""" + " UNION ALL ".join(
    f"SELECT symbol, alpha, rn, {h}::INTEGER AS horizon, lead(p, {h}) OVER (PARTITION BY symbol, alpha ORDER BY rn) AS ahead FROM series" for h in HORIZONS)
    + """) JOIN (SELECT symbol, rn, trade_date FROM base) USING (symbol, rn)
) , (VALUES (true), (false)) AS i(indicators), (VALUES (true), (false)) AS m(with_sentiment)
WHERE ahead IS NOT NULL AND (NOT indicators OR rn >= 200) GROUP BY ALL""", VARIANT_BASE, sql.scan(VARIANT_STATES), VARIANT_PRICES, recursive=True))
def experiment_rows(spark, sf):
    """Training and held-out rows that the shared fits of every variant add up over."""
    grid = written_variants(spark, sf)
    columns = variant_columns(grid)
    counts = shared.row_counts(shared.blocks_of(spark, grid, columns), list(columns))
    return spark.createDataFrame([(v, *n) for v, n in counts.items()], "variant string, train_rows long, test_rows long")


@query("experiment_machines")
def experiment_machines(spark, sf):
    """All classifiers but the forest on every variant, in shared passes."""
    grid = written_variants(spark, sf)
    return shared.held_out_accuracies(spark, grid, variant_columns(grid), shared.machines())


@query("experiment_grid")
def experiment_grid(spark, sf):
    grid = written_variants(spark, sf)
    results = shared_dir(spark)
    machines = shared.held_out_accuracies(spark, grid, variant_columns(grid), shared.machines())
    machines.write.parquet(results)
    done = written(spark, machines.select("variant", "classifier"))
    # the forests' trees grow in tasks of their own, a few variants side by side
    pipelines = {name: lambda columns, name=name: md.classifiers(columns)[name]() for name in md.classifiers(PLAIN)}
    pipelines["random_forest"] = md.GrownForest
    return md.experiment_grid(spark, variant_tables(grid), pipelines, results, done)
