"""Ledger and back-test queries; line items are trades of the five supplier regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import ledger as led
from tidemark.operators import portfolio as pf
from tidemark.operators import rows
from tidemark.plans import sql
from tidemark.plans.portfolio import uniform_sql
from tidemark.plans.prices import INDEX_SQL, index_levels, quotes
from tidemark.plans.registry import query
from tidemark.plans.views import HORIZONS, daily_bars, naive, table, trades
from tidemark.session import written
from tidemark.sources.bars import latest_quotes

ORD = "(PARTITION BY symbol ORDER BY trade_date)"
TODAY = "2000-06-30"

LEDGER = """
ledger AS (SELECT symbol, trade_date, CASE WHEN status = 'O' THEN 'BUY' ELSE 'SELL' END AS type, price, volume FROM trades),
positions AS (SELECT symbol, sum(CASE WHEN type = 'BUY' THEN volume ELSE -volume END) AS held,
  sum(CASE WHEN type = 'BUY' THEN price * volume ELSE -(price * volume) END) AS investment FROM ledger GROUP BY symbol),
latest AS (SELECT symbol, arg_max(close, trade_date) AS close FROM bars GROUP BY symbol),
bank AS (SELECT floor((10000.0 - sum(CASE WHEN type = 'BUY' THEN price * volume ELSE -(price * volume) END)) * 100) / 100 AS balance FROM ledger)"""
PORTFOLIO = """
allocations AS (SELECT r_name AS symbol, round(sum(c_acctbal), 2) AS allocation
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
portfolio AS (SELECT symbol, allocation, held, investment,
  CAST(DATE '2000-01-01' + CAST(length(symbol) AS INTEGER) AS DATE) AS last_updated FROM allocations JOIN positions USING (symbol))"""
INVESTMENTS = """
investments AS (SELECT o_orderkey AS id, r_name AS symbol, CAST(floor(o_totalprice / 10000) AS BIGINT) AS amount,
  [1, 30, 200][o_orderkey % 3 + 1] AS period, CAST(CAST(o_orderdate AS DATE) + [1, 30, 200][o_orderkey % 3 + 1] AS DATE) AS end_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SIGNALS = "signals AS (" + " UNION ALL ".join(
    f"SELECT symbol, trade_date, close, CAST({h} AS INTEGER) AS horizon, "
    f"CAST(CASE WHEN close >= lag(close, {h}) OVER {ORD} THEN 1 ELSE 0 END AS INTEGER) AS signal FROM bars" for h in HORIZONS) + ")"
PREDICTIONS = """
predictions AS (SELECT symbol, horizon, arg_max(signal, trade_date) AS prediction FROM signals GROUP BY 1, 2)"""


def ledger(spark, sf):
    kind = F.when(F.col("status") == "O", "BUY").otherwise("SELL")
    return trades(spark, sf, "region").select("symbol", "trade_date", kind.alias("type"), "price", "volume")


def latest(spark, sf):
    return rows.latest_price(daily_bars(spark, sf, "region"), "trade_date")


def customer_regions(spark, sf):
    return (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_acctbal", F.col("r_name").alias("symbol"))
    )


def portfolio(spark, sf):
    allocations = customer_regions(spark, sf).groupBy("symbol").agg(F.round(F.sum("c_acctbal"), 2).alias("allocation"))
    updated = F.expr("date_add(date'2000-01-01', length(symbol))")
    return allocations.join(led.positions(ledger(spark, sf)), "symbol").withColumn("last_updated", updated)


def investments(spark, sf):
    period = F.expr("element_at(array(1, 30, 200), cast(o_orderkey % 3 as int) + 1)")
    orders = table(spark, sf, "orders").join(customer_regions(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        F.col("o_orderkey").alias("id"), "symbol", F.floor(F.col("o_totalprice") / 10000).alias("amount"),
        period.alias("period"), F.date_add(F.to_date("o_orderdate"), period).alias("end_date"),
    )


def signals(spark, sf):
    """A rise is expected where the close has risen over the horizon before."""
    bars = daily_bars(spark, sf, "region")
    rose = {f"s{h}": F.lag("close", h).over(ind.ordered()) <= F.col("close") for h in HORIZONS}
    per_horizon = F.array(
        *[F.struct(F.lit(h).alias("horizon"), F.coalesce(F.col(f"s{h}").cast("int"), F.lit(0)).alias("signal")) for h in HORIZONS]
    )
    return bars.withColumns(rose).select("symbol", "trade_date", "close", F.inline(per_horizon))


def predictions(spark, sf):
    return signals(spark, sf).groupBy("symbol", "horizon").agg(F.max_by("signal", "trade_date").alias("prediction"))


def cash(spark, sf):
    return led.balance(ledger(spark, sf)).scalar()


@query("positions", sql.region("SELECT * FROM positions", LEDGER))
def positions(spark, sf):
    return led.positions(ledger(spark, sf))


@query("bank_balance", sql.region("SELECT balance FROM bank", LEDGER))
def bank_balance(spark, sf):
    return led.balance(ledger(spark, sf))


@query("position_value", sql.region("SELECT symbol, held, held * close AS value FROM positions JOIN latest USING (symbol)", LEDGER))
def position_value(spark, sf):
    return led.position_value(led.positions(ledger(spark, sf)), latest(spark, sf)).select("symbol", "held", "value")


@query("portfolio_pnl", sql.region("SELECT round(sum(held * close) - sum(investment), 2) AS pnl FROM positions JOIN latest USING (symbol)", LEDGER))
def portfolio_pnl(spark, sf):
    return led.portfolio_pnl(led.positions(ledger(spark, sf)), latest(spark, sf))


PNL = """
quotes AS (SELECT symbol, CAST(trade_date AS TIMESTAMP) AS ts, trade_date, close FROM bars)"""


def dated_quotes(spark, sf):
    return daily_bars(spark, sf, "region").select("symbol", F.col("trade_date").cast("timestamp_ntz").alias("ts"), "close")


@query("pnl_join", sql.region("""
SELECT symbol, ts, close * held - investment AS pnl FROM quotes JOIN portfolio USING (symbol) WHERE ts >= last_updated""", LEDGER, PORTFOLIO, PNL))
def pnl_join(spark, sf):
    return led.pnl_rows(portfolio(spark, sf), dated_quotes(spark, sf))


@query("pnl_series", sql.region("""
SELECT ts, sum(close * held - investment) AS pnl FROM quotes JOIN portfolio USING (symbol) WHERE ts >= last_updated GROUP BY ts""",
    LEDGER, PORTFOLIO, PNL))
def pnl_series(spark, sf):
    return led.pnl_series(portfolio(spark, sf), dated_quotes(spark, sf))


@query("total_worth", sql.region("""
SELECT balance, stock_worth, balance + stock_worth AS total_worth
FROM bank, (SELECT round(sum(held * close), 2) AS stock_worth FROM positions JOIN latest USING (symbol))""", LEDGER))
def total_worth(spark, sf):
    return led.total_worth(ledger(spark, sf), latest(spark, sf))


@query("allocation_share", sql.region("""
SELECT symbol, allocation, round(allocation / sum(allocation) OVER (), 9) AS share FROM portfolio""", LEDGER, PORTFOLIO))
def allocation_share(spark, sf):
    return led.allocation_share(portfolio(spark, sf)).select("symbol", "allocation", F.round("share", 9).alias("share"))


@query("allocation_ranking", sql.region("SELECT symbol, allocation FROM portfolio ORDER BY allocation DESC", LEDGER, PORTFOLIO))
def allocation_ranking(spark, sf):
    return led.allocation_ranking(portfolio(spark, sf)).select("symbol", "allocation")


@query("allocate_funds", sql.region("""
SELECT symbol, 100000.0 * (1.0::DOUBLE / count(*) OVER ()) AS allocation, held FROM portfolio""", LEDGER, PORTFOLIO))
def allocate_funds(spark, sf):
    stored = portfolio(spark, sf)
    weights = pf.equal_weights(stored.select(F.lit(0).alias("portfolio_id"), "symbol"))
    return pf.allocate_funds(stored.select("symbol", "allocation", "held"), weights, F.lit(100000.0))


@query("cutoffs", sql.region("""
SELECT trade_date, worth, floor(base_worth * 0.75 * 100) / 100 AS loss_cutoff, floor(base_worth * 1.25 * 100) / 100 AS profit_cutoff,
  worth <= floor(base_worth * 0.75 * 100) / 100 OR worth >= floor(base_worth * 1.25 * 100) / 100 AS triggered
FROM (SELECT trade_date, sum(close) AS worth, max(base) AS base_worth
  FROM bars, (SELECT arg_min(t, trade_date) AS base FROM (SELECT trade_date, sum(close) AS t FROM bars GROUP BY 1)) GROUP BY trade_date)"""))
def cutoffs(spark, sf):
    worth = index_levels(spark, sf, "region").withColumnRenamed("close", "worth")
    base = worth.agg(F.min_by("worth", "trade_date")).scalar()
    return pf.cutoffs(worth.withColumn("base_worth", base), F.lit(0.25)).drop("base_worth")


@query("available_shares", sql.region("""
SELECT symbol, held, held - coalesce(locked, 0) AS available FROM positions
LEFT JOIN (SELECT symbol, sum(amount) AS locked FROM investments GROUP BY 1) USING (symbol)""", LEDGER, INVESTMENTS))
def available_shares(spark, sf):
    return led.available_shares(led.positions(ledger(spark, sf)), investments(spark, sf))


@query("quota_status", """
SELECT event_type AS name, count(*) AS calls, length(event_type) * 10 AS daily_limit, count(*) >= length(event_type) * 10 AS exhausted
FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05' GROUP BY event_type""")
def quota_status(spark, sf):
    events = table(spark, sf, "events")
    calls = events.groupBy(F.col("event_type").alias("name"), F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("calls"))
    limit = (F.length("event_type") * 10).cast("long")
    limits = events.select(F.col("event_type").alias("name"), limit.alias("daily_limit")).distinct()
    return led.quota_status(calls, limits, "2024-01-05")


@query("quote_match", """
SELECT event_type AS symbol, user_id, last(ts ORDER BY ts, event_id) AS ts, last(price ORDER BY ts, event_id) AS close
FROM (SELECT w.event_type, w.user_id, e.ts, e.event_id, e.value AS price FROM (SELECT DISTINCT event_type, user_id FROM events) w
  JOIN (SELECT * FROM events e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1) e USING (event_type))
GROUP BY 1, 2""")
def quote_match(spark, sf):
    watch_list = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "user_id").distinct()
    newest = latest_quotes(quotes(spark, sf)).select("symbol", naive("ts"), "close")
    return led.match_quotes(watch_list, newest)


@query("benchmark_compare", sql.region("""
SELECT trade_date, total, index_close FROM (SELECT trade_date, sum(close * held) AS total FROM bars JOIN positions USING (symbol) GROUP BY 1)
JOIN levels USING (trade_date)""", LEDGER, "levels AS (" + INDEX_SQL.replace("AS close", "AS index_close") + ")"))
def benchmark_compare(spark, sf):
    held = led.positions(ledger(spark, sf))
    total = daily_bars(spark, sf, "region").join(held, "symbol").groupBy("trade_date").agg(
        F.sum(F.col("close") * F.col("held")).alias("total")
    )
    return led.benchmark_compare(total, index_levels(spark, sf, "region"))


@query("validate_orders", sql.region("""
SELECT id, type, symbol, quantity, coalesce(quantity > 0 AND ((type = 'BUY' AND close * quantity <= balance) OR (type = 'SELL' AND quantity <= available)), false) AS valid
FROM requests LEFT JOIN latest USING (symbol) LEFT JOIN (SELECT symbol, held - coalesce(locked, 0) AS available FROM positions
  LEFT JOIN (SELECT symbol, sum(amount) AS locked FROM investments GROUP BY 1) USING (symbol)) USING (symbol), bank""", LEDGER, INVESTMENTS, """
requests AS (SELECT id, symbol, CASE WHEN id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS type, amount - 5 AS quantity FROM investments)"""))
def validate_orders(spark, sf):
    locked = investments(spark, sf)
    requests = locked.select(
        "id", "symbol", F.when(F.col("id") % 2 == 0, "BUY").otherwise("SELL").alias("type"), (F.col("amount") - 5).alias("quantity")
    )
    free = led.available_shares(led.positions(ledger(spark, sf)), locked)
    return led.validate_orders(requests, latest(spark, sf), free, cash(spark, sf))


@query("matured_investments", sql.region(f"""
SELECT id, symbol, amount, period, end_date, CASE WHEN prediction = 1 THEN 'EXTEND' ELSE 'SELL' END AS action,
  CASE WHEN prediction = 1 THEN CAST(DATE '{TODAY}' + period AS DATE) END AS new_end_date
FROM investments LEFT JOIN predictions p ON investments.symbol = p.symbol AND period = horizon WHERE end_date <= DATE '{TODAY}'""".replace(
    "SELECT id, symbol", "SELECT id, investments.symbol"), INVESTMENTS, SIGNALS, PREDICTIONS))
def matured_investments(spark, sf):
    return led.matured_investments(investments(spark, sf), predictions(spark, sf), TODAY)


@query("trade_proposals", sql.region("""
SELECT symbol, horizon, quantity, value FROM steps WHERE taken""", LEDGER, PORTFOLIO, SIGNALS, PREDICTIONS, """
wanted AS (SELECT symbol, horizon, quantity, quantity * close AS value, row_number() OVER (ORDER BY allocation DESC, symbol, horizon) AS rn
  FROM (SELECT p.symbol, r.horizon, allocation, close, CAST(floor((allocation - 0.0) / close / count(*) OVER (PARTITION BY p.symbol)) AS BIGINT) AS quantity
    FROM allocations p JOIN latest USING (symbol) JOIN predictions r ON r.symbol = p.symbol AND r.prediction = 1) WHERE quantity > 0),
steps AS (
  SELECT symbol, horizon, quantity, value, rn, value <= 2000000.0 AS taken, CASE WHEN value <= 2000000.0 THEN 2000000.0 - value ELSE 2000000.0 END AS remaining
  FROM wanted WHERE rn = 1
  UNION ALL SELECT w.symbol, w.horizon, w.quantity, w.value, w.rn, w.value <= s.remaining,
    CASE WHEN w.value <= s.remaining THEN s.remaining - w.value ELSE s.remaining END FROM steps s JOIN wanted w ON w.rn = s.rn + 1)""", recursive=True))
def trade_proposals(spark, sf):
    unspent = portfolio(spark, sf).withColumn("investment", F.lit(0.0))
    return led.trade_proposals(unspent, predictions(spark, sf), latest(spark, sf), F.lit(2000000.0))


@query("trade_proposals_computed", sql.region("""
SELECT symbol, horizon, quantity, value FROM steps WHERE taken""", LEDGER, PORTFOLIO, SIGNALS, PREDICTIONS, """
funds AS (SELECT balance + (SELECT round(sum(held * close), 2) FROM positions JOIN latest USING (symbol)) AS cash FROM bank),
wanted AS (SELECT symbol, horizon, quantity, quantity * close AS value, row_number() OVER (ORDER BY allocation DESC, symbol, horizon) AS rn
  FROM (SELECT p.symbol, r.horizon, allocation, close, CAST(floor((allocation - investment) / close / count(*) OVER (PARTITION BY p.symbol)) AS BIGINT) AS quantity
    FROM portfolio p JOIN latest USING (symbol) JOIN predictions r ON r.symbol = p.symbol AND r.prediction = 1) WHERE quantity > 0),
steps AS (
  SELECT symbol, horizon, quantity, value, rn, value <= cash AS taken, CASE WHEN value <= cash THEN cash - value ELSE cash END AS remaining
  FROM wanted, funds WHERE rn = 1
  UNION ALL SELECT w.symbol, w.horizon, w.quantity, w.value, w.rn, w.value <= s.remaining,
    CASE WHEN w.value <= s.remaining THEN s.remaining - w.value ELSE s.remaining END FROM steps s JOIN wanted w ON w.rn = s.rn + 1)""", recursive=True))
def trade_proposals_computed(spark, sf):
    """Proposals for what is not invested yet, paid from the balance and the worth of all positions."""
    prices = written(spark, latest(spark, sf))
    worth = led.total_worth(ledger(spark, sf), prices).select("total_worth").scalar()
    return led.trade_proposals(portfolio(spark, sf), predictions(spark, sf), prices, worth)


@query("signal_backtest", sql.region(f"""
SELECT s.symbol, s.horizon, s.trade_date, e.trade_date AS exit_date, e.close / s.close - 1 AS gross_return
FROM (SELECT *, (SELECT min(rn) FROM numbered n WHERE n.symbol = m.symbol AND n.horizon = m.horizon AND n.signal = 0 AND n.rn > m.rn
        AND (n.rn - m.rn) % m.horizon = 0) AS exit_rn FROM numbered m WHERE signal = 1) s
LEFT JOIN numbered e ON e.symbol = s.symbol AND e.horizon = s.horizon AND e.rn = s.exit_rn""", SIGNALS, """
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY trade_date) AS rn FROM signals)"""))
def signal_backtest(spark, sf):
    return led.signal_backtest(signals(spark, sf))


EQUITY = f"""
moves AS (SELECT symbol, trade_date, coalesce((close - lag(close) OVER {ORD}) / lag(close) OVER {ORD}, 0) AS r,
  coalesce(lag(rose) OVER {ORD}, false) AS signalled, coalesce(lag(coin) OVER {ORD}, 0) < 0.5 AS coined
  FROM (SELECT *, coalesce(close >= lag(close, 1) OVER {ORD}, false) AS rose,
               {uniform_sql('symbol', 'CAST(trade_date AS VARCHAR)')} AS coin FROM bars)),
members AS (SELECT 'signal' AS strategy, trade_date, r, signalled AS member FROM moves
  UNION ALL SELECT 'equal', trade_date, r, true FROM moves
  UNION ALL SELECT 'random', trade_date, r, coined FROM moves
  UNION ALL SELECT 'index', trade_date, coalesce((close - lag(close) OVER (ORDER BY trade_date)) / lag(close) OVER (ORDER BY trade_date), 0), true
    FROM ({INDEX_SQL})),
days AS (SELECT strategy, trade_date, coalesce(sum(r) FILTER (member) / count(*) FILTER (member), 0) AS daily_return FROM members GROUP BY 1, 2)"""


def strategy_rows(spark, sf):
    bars = daily_bars(spark, sf, "region")
    rose = F.coalesce(F.col("close") >= F.lag("close").over(ind.ordered()), F.lit(False))
    coin = pf.hash_uniform(F.col("symbol"), F.col("trade_date"))
    staged = ind.percent_change(bars).withColumns({"rose": rose, "coin": coin})
    yesterday = lambda c, none: F.coalesce(F.lag(c).over(ind.ordered()), F.lit(none))
    staged = staged.withColumns({"signalled": yesterday("rose", False), "coined": yesterday("coin", 0.0) < 0.5})
    held = F.array(
        F.struct(F.lit("signal").alias("strategy"), F.col("signalled").alias("member")),
        F.struct(F.lit("equal").alias("strategy"), F.lit(True).alias("member")),
        F.struct(F.lit("random").alias("strategy"), F.col("coined").alias("member")),
    )
    symbols = staged.select("trade_date", F.col("percent_change").alias("daily_return"), F.inline(held))
    level = index_levels(spark, sf, "region").withColumn("symbol", F.lit("index"))
    index = ind.percent_change(level).select(
        F.lit("index").alias("strategy"), "trade_date", F.col("percent_change").alias("daily_return"), F.lit(True).alias("member")
    )
    return symbols.unionByName(index)


@query("strategy_equity", sql.region("""
SELECT strategy, trade_date, round(daily_return, 8) + 0.0 AS daily_return,
  round(sum(ln(1 + daily_return)) OVER (PARTITION BY strategy ORDER BY trade_date), 5) + 0.0 AS log_equity FROM days""", EQUITY))
def strategy_equity(spark, sf):
    equity = led.strategy_equity(strategy_rows(spark, sf))
    return equity.select("strategy", "trade_date", F.round("daily_return", 8).alias("daily_return"), F.round("log_equity", 5).alias("log_equity"))
