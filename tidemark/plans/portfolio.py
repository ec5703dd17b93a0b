"""Portfolio queries; symbols are the five supplier regions, candidates the customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import portfolio as pf
from tidemark.operators import rows
from tidemark.plans import sql
from tidemark.plans.registry import query
from tidemark.plans.prices import COMMON_SQL
from tidemark.plans.views import daily_bars, table
from tidemark.session import written

ORD = "(PARTITION BY symbol ORDER BY trade_date)"
LOOK_BACK = 200

SHARED = f"""
shared AS (SELECT symbol, trade_date, ln(lead(close) OVER {ORD} / close) AS r FROM bars WHERE trade_date IN (SELECT trade_date FROM common)),
returns AS (SELECT * FROM shared WHERE r IS NOT NULL)"""
RECENT = f"""
recent AS (SELECT symbol, trade_date, close FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM bars
  WHERE trade_date IN (SELECT trade_date FROM common)) WHERE back <= {LOOK_BACK}),
returns AS (SELECT * FROM (SELECT symbol, trade_date, ln(lead(close) OVER {ORD} / close) AS r FROM recent) WHERE r IS NOT NULL)"""
MOMENTS = """
means AS (SELECT symbol, avg(r) AS mean FROM returns GROUP BY symbol),
cov AS (SELECT a.symbol AS symbol_i, b.symbol AS symbol_j, covar_samp(a.r, b.r) AS cov
  FROM returns a JOIN returns b USING (trade_date) GROUP BY 1, 2)"""


def uniform_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


WEIGHTS = f"""
raw AS (SELECT c_custkey AS portfolio_id, r_name AS symbol, {uniform_sql('c_custkey', 'r_name')} AS w FROM customer CROSS JOIN region),
weights AS (SELECT portfolio_id, symbol, w / sum(w) OVER (PARTITION BY portfolio_id) AS weight FROM raw)"""
SCORES = """
rets AS (SELECT portfolio_id, sum(weight * mean) AS expected_return FROM weights JOIN means USING (symbol) GROUP BY 1),
risks AS (SELECT a.portfolio_id, sum(a.weight * b.weight * cov) AS risk FROM weights a JOIN weights b ON a.portfolio_id = b.portfolio_id
  JOIN cov ON a.symbol = symbol_i AND b.symbol = symbol_j GROUP BY 1),
ratios AS (SELECT portfolio_id, expected_return, risk, CASE WHEN expected_return = 0 OR risk = 0 THEN 0 ELSE expected_return / risk END AS ratio
  FROM rets JOIN risks USING (portfolio_id))"""
CURRENT = """
prices AS (SELECT symbol, arg_max(close, trade_date) AS close FROM bars GROUP BY symbol),
current_weights AS (SELECT symbol, 1.0 / count(*) OVER () AS weight FROM prices),
costs AS (SELECT portfolio_id, sum(abs(c.weight - w.weight) * close * 0.1) AS cost
  FROM weights w JOIN current_weights c USING (symbol) JOIN prices USING (symbol) GROUP BY 1)"""
TO_SCORES = (COMMON_SQL, RECENT, MOMENTS, WEIGHTS, SCORES)


def shared_returns(spark, sf):
    return ind.log_returns(rows.on_common_calendar(daily_bars(spark, sf, "region")))


def recent_returns(spark, sf):
    shared = rows.on_common_calendar(daily_bars(spark, sf, "region"))
    return ind.log_returns(rows.last_n(rows.valid_prices(shared), LOOK_BACK))


def moments(spark, sf):
    """Mean returns and covariances of the look-back; both are read several times."""
    returns = written(spark, recent_returns(spark, sf).select("symbol", "trade_date", "log_return"))
    return pf.return_stats(returns), written(spark, pf.covariance_matrix(pf.return_vectors(returns)))


def symbols(spark, sf):
    """The universe; one name per region."""
    return sorted(r[0] for r in table(spark, sf, "region").select("r_name").collect())


def candidates(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("portfolio_id"))
    return pf.candidate_portfolios(ids, symbols(spark, sf))


def latest_closes(spark, sf):
    return rows.latest_price(daily_bars(spark, sf, "region"), "trade_date")


def held_weights(spark, sf):
    held = latest_closes(spark, sf).select(F.lit(0).alias("portfolio_id"), "symbol")
    return pf.equal_weights(held)


@query("return_stats", sql.brand(f"""
SELECT symbol, round(avg(r), 9) + 0.0 AS mean, round(var_samp(r), 9) AS variance, round(stddev_samp(r), 9) AS stddev
FROM (SELECT symbol, ln(lead(close) OVER {ORD} / close) AS r FROM bars) WHERE r IS NOT NULL GROUP BY symbol"""))
def return_stats(spark, sf):
    stats = pf.return_stats(ind.log_returns(daily_bars(spark, sf)))
    return stats.select("symbol", *[F.round(c, 9).alias(c) for c in ("mean", "variance", "stddev")])


@query("expected_returns", sql.region("SELECT symbol, round(mean, 9) + 0.0 AS mean FROM means", COMMON_SQL, RECENT, MOMENTS))
def expected_returns(spark, sf):
    return pf.return_stats(recent_returns(spark, sf)).select("symbol", F.round("mean", 9).alias("mean"))


@query("return_pairs", sql.region("""
SELECT a.symbol AS symbol_i, b.symbol AS symbol_j, count(*) AS days, round(sum(a.r * b.r), 6) + 0.0 AS product
FROM returns a JOIN returns b ON a.trade_date = b.trade_date AND a.symbol <= b.symbol GROUP BY 1, 2""", COMMON_SQL, SHARED))
def return_pairs(spark, sf):
    pairs = pf.return_pairs(pf.return_vectors(shared_returns(spark, sf)))
    return pairs.withColumn("product", F.round("product", 6))


@query("covariance_matrix", sql.region("SELECT symbol_i, symbol_j, round(cov, 9) + 0.0 AS cov FROM cov", COMMON_SQL, SHARED, MOMENTS))
def covariance_matrix(spark, sf):
    cov = pf.covariance_matrix(pf.return_vectors(shared_returns(spark, sf)))
    return cov.withColumn("cov", F.round("cov", 9))


@query("rolling_calibration", sql.region(f"""
SELECT symbol_i, symbol_j, trade_date, round(cov, 6) + 0.0 AS cov FROM (
  SELECT a.symbol AS symbol_i, b.symbol AS symbol_j, trade_date,
         covar_samp(a.r, b.r) OVER w AS cov, count(*) OVER w AS n
  FROM returns a JOIN returns b USING (trade_date) WHERE a.symbol <= b.symbol
  WINDOW w AS (PARTITION BY a.symbol, b.symbol ORDER BY trade_date ROWS {LOOK_BACK - 1} PRECEDING))
WHERE n = {LOOK_BACK}""", COMMON_SQL, SHARED))
def rolling_calibration(spark, sf):
    cov = pf.rolling_calibration(pf.return_vectors(shared_returns(spark, sf)), LOOK_BACK)
    return cov.withColumn("cov", F.round("cov", 6))


@query("rolling_means", sql.region(f"""
SELECT symbol, trade_date, round(m, 8) + 0.0 AS mean FROM (
  SELECT symbol, trade_date, avg(r) OVER w AS m, count(*) OVER w AS n FROM returns
  WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS {LOOK_BACK - 1} PRECEDING)) WHERE n = {LOOK_BACK}""", COMMON_SQL, SHARED))
def rolling_means(spark, sf):
    means = ind.sma(shared_returns(spark, sf), [LOOK_BACK], "log_return").filter(f"sma{LOOK_BACK} is not null")
    return means.select("symbol", "trade_date", F.round(f"sma{LOOK_BACK}", 8).alias("mean"))


@query("candidate_portfolios", "WITH " + WEIGHTS + " SELECT portfolio_id, symbol, round(weight, 9) AS weight FROM weights")
def candidate_portfolios(spark, sf):
    return candidates(spark, sf).withColumn("weight", F.round("weight", 9))


@query("perturbed_portfolios", "WITH " + WEIGHTS + f""",
moved AS (SELECT portfolio_id, symbol, CASE WHEN {uniform_sql('portfolio_id', 'symbol', "'0'", "'p'")} < 0.5 THEN greatest(weight +
  sqrt(-2 * ln(1 - {uniform_sql('portfolio_id', 'symbol', "'0'", "'n'", "'a'")})) * cos(2 * pi() * {uniform_sql('portfolio_id', 'symbol', "'0'", "'n'", "'b'")}), 0)
  ELSE weight END AS w FROM weights)
SELECT portfolio_id, symbol, CASE WHEN t > 0 THEN round(w / t, 7) END AS weight
FROM (SELECT *, sum(w) OVER (PARTITION BY portfolio_id) AS t FROM moved)""")
def perturbed_portfolios(spark, sf):
    return pf.perturb(candidates(spark, sf), 0.5).withColumn("weight", F.round("weight", 7))


@query("weights_valid", "WITH " + WEIGHTS + """
SELECT portfolio_id, round(sum(weight), 9) AS total, abs(sum(weight) - 1) <= 0.01 AS valid
FROM (SELECT portfolio_id, weight * CASE WHEN portfolio_id % 3 = 0 THEN 1.25 ELSE 1 END AS weight FROM weights) GROUP BY 1""")
def weights_valid(spark, sf):
    off = F.when(F.col("portfolio_id") % 3 == 0, F.col("weight") * 1.25).otherwise(F.col("weight"))
    checked = pf.weights_valid(candidates(spark, sf).withColumn("weight", off))
    return checked.withColumn("total", F.round("total", 9))


@query("equal_weights", sql.brand("SELECT symbol, 1.0::DOUBLE / count(*) OVER () AS weight FROM (SELECT DISTINCT symbol FROM trades)"))
def equal_weights(spark, sf):
    held = daily_bars(spark, sf).select(F.lit(0).alias("portfolio_id"), "symbol").distinct()
    return pf.equal_weights(held).select("symbol", "weight")


@query("portfolio_return", sql.region("SELECT portfolio_id, round(expected_return, 9) + 0.0 AS expected_return FROM rets", *TO_SCORES))
def portfolio_return(spark, sf):
    means = pf.return_stats(recent_returns(spark, sf))
    scored = pf.portfolio_return(candidates(spark, sf), means)
    return scored.withColumn("expected_return", F.round("expected_return", 9))


@query("portfolio_risk", sql.region("SELECT portfolio_id, round(risk, 9) AS risk FROM risks", *TO_SCORES))
def portfolio_risk(spark, sf):
    _, cov = moments(spark, sf)
    return pf.portfolio_risk(candidates(spark, sf), cov).withColumn("risk", F.round("risk", 9))


@query("return_risk_ratio", sql.region("SELECT portfolio_id, round(ratio, 7) + 0.0 AS ratio FROM ratios", *TO_SCORES))
def return_risk_ratio(spark, sf):
    means, cov = moments(spark, sf)
    weights = candidates(spark, sf)
    ratio = pf.return_risk_ratio(pf.portfolio_return(weights, means), pf.portfolio_risk(weights, cov))
    return ratio.select("portfolio_id", F.round("ratio", 7).alias("ratio"))


@query("transaction_cost", sql.region("SELECT portfolio_id, round(cost, 7) AS cost FROM costs", WEIGHTS, CURRENT))
def transaction_cost(spark, sf):
    closes = written(spark, latest_closes(spark, sf))
    current = pf.equal_weights(closes.select(F.lit(0).alias("portfolio_id"), "symbol"))
    cost = pf.transaction_cost(current, candidates(spark, sf), closes)
    return cost.withColumn("cost", F.round("cost", 7))


@query("best_portfolios", sql.region("""
SELECT portfolio_id, round(ratio - cost, 6) + 0.0 AS fitness FROM ratios JOIN costs USING (portfolio_id)
ORDER BY round(ratio - cost, 9) DESC, portfolio_id LIMIT 20""", *TO_SCORES, CURRENT))
def best_portfolios(spark, sf):
    means, cov = moments(spark, sf)
    closes = written(spark, latest_closes(spark, sf))
    current = pf.equal_weights(closes.select(F.lit(0).alias("portfolio_id"), "symbol"))
    scored = pf.fitness(candidates(spark, sf), means, cov, current, closes)
    return pf.best_portfolios(scored, 20).select("portfolio_id", F.round("fitness", 6).alias("fitness"))


@query("vector_math", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS dot FROM embeddings")
def vector_math(spark, sf):
    from tidemark.functions.numeric import dot

    vectors = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return vectors.select("vec_id", F.round(dot(F.col("v"), F.col("v")), 6).alias("dot"))


@query("vector_matrix", """
WITH entries AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT CAST(i AS INTEGER) AS position, round(sum(x * label), 6) + 0.0 AS value FROM entries JOIN embeddings USING (vec_id) GROUP BY i""")
def vector_matrix(spark, sf):
    from tidemark.functions.numeric import vector_times_matrix

    rows_ = table(spark, sf, "embeddings")
    entries = rows_.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "value"))
    vector = rows_.select(F.col("vec_id").alias("i"), F.col("label").cast("double").alias("x"))
    product = vector_times_matrix(vector, entries)
    return product.select(F.col("j").alias("position"), F.round("value", 6).alias("value"))


@query("numeric_predicate", """
SELECT event_type, count(*) FILTER (regexp_full_match(t, '[-+]?\\d*\\.?\\d+')) AS numeric, count(*) FILTER (NOT regexp_full_match(t, '[-+]?\\d*\\.?\\d+')) AS other
FROM (SELECT event_type, unnest([replace(props, '"', ''), CAST(event_id AS VARCHAR), '-' || event_id, event_id || '.']) AS t FROM events) GROUP BY 1""")
def numeric_predicate(spark, sf):
    from tidemark.sources.text import is_number

    event_id = F.col("event_id").cast("string")
    texts = F.array(F.replace("props", F.lit('"'), F.lit("")), event_id, F.concat(F.lit("-"), event_id), F.concat(event_id, F.lit(".")))
    exploded = table(spark, sf, "events").select("event_type", F.explode(texts).alias("t"))
    numeric = is_number(F.col("t"))
    return exploded.groupBy("event_type").agg(F.count_if(numeric).alias("numeric"), F.count_if(~numeric).alias("other"))


@query("date_functions", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) - 30 AS DATE) AS month_before,
       CAST(CAST(o_orderdate AS DATE) + 200 AS DATE) AS matures, DATE '2001-01-01' - CAST(o_orderdate AS DATE) AS age FROM orders""")
def date_functions(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", day.alias("day"), F.date_sub(day, 30).alias("month_before"), F.date_add(day, 200).alias("matures"),
        F.datediff(F.to_date(F.lit("2001-01-01")), day).cast("long").alias("age"),
    )
