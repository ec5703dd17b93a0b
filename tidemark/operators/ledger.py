"""Positions, balances, orders and back-tests over trade tables.

Trades are rows (symbol, ts, type, price, volume). Per-symbol results have
one row per symbol, so the joins below meet small tables whatever the number
of trades; hot symbols shrink in the grouping before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

OPENING_DEPOSIT = 10000.0
# Ranges that a walk over proposals is cut into.
RANGES = 32


def signed(amount: Column) -> Column:
    return F.when(F.col("type") == "BUY", amount).otherwise(-amount)


def positions(trades: DataFrame) -> DataFrame:
    """Shares held and money invested per symbol."""
    value = F.col("price") * F.col("volume")
    return trades.groupBy("symbol").agg(
        F.sum(signed(F.col("volume"))).alias("held"), F.sum(signed(value)).alias("investment")
    )


def balance(trades: DataFrame, deposit: float = OPENING_DEPOSIT) -> DataFrame:
    """Deposit less purchases plus sales, cut to two places."""
    spent = F.coalesce(F.sum(signed(F.col("price") * F.col("volume"))), F.lit(0.0))
    return trades.agg((F.floor((F.lit(deposit) - spent) * 100) / 100).alias("balance"))


def position_value(held: DataFrame, prices: DataFrame) -> DataFrame:
    return held.join(prices.select("symbol", "close"), "symbol").withColumn("value", F.col("held") * F.col("close"))


def portfolio_pnl(held: DataFrame, prices: DataFrame) -> DataFrame:
    valued = position_value(held, prices)
    return valued.agg(F.round(F.sum("value") - F.sum("investment"), 2).alias("pnl"))


def pnl_rows(held: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes at or after a position's last update, with their profit or loss."""
    return (
        quotes.join(held.select("symbol", "held", "investment", "last_updated"), "symbol")
        .filter(F.col("ts") >= F.col("last_updated"))
        .withColumn("pnl", F.col("close") * F.col("held") - F.col("investment"))
        .select("symbol", "ts", "pnl")
    )


def pnl_series(held: DataFrame, quotes: DataFrame) -> DataFrame:
    return pnl_rows(held, quotes).groupBy("ts").agg(F.sum("pnl").alias("pnl"))


def total_worth(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Balance and the value of all positions, one row."""
    worth = position_value(positions(trades), prices).agg(F.round(F.sum("value"), 2)).scalar()
    return balance(trades).withColumn("stock_worth", worth).withColumn(
        "total_worth", F.col("balance") + F.col("stock_worth")
    )


def allocation_share(portfolio: DataFrame) -> DataFrame:
    total = portfolio.agg(F.sum("allocation")).scalar()
    return portfolio.withColumn("share", F.try_divide(F.col("allocation"), total))


def allocation_ranking(portfolio: DataFrame) -> DataFrame:
    return portfolio.orderBy(F.col("allocation").desc(), "symbol")


def locked_shares(investments: DataFrame) -> DataFrame:
    return investments.groupBy("symbol").agg(F.sum("amount").alias("locked"))


def available_shares(held: DataFrame, investments: DataFrame) -> DataFrame:
    return held.join(locked_shares(investments), "symbol", "left").select(
        "symbol", "held", (F.col("held") - F.coalesce("locked", F.lit(0))).alias("available")
    )


def quota_status(calls: DataFrame, limits: DataFrame, today, strict: bool = False) -> DataFrame:
    """Whether today's calls reach the daily limit, or exceed it if ``strict``."""
    day = calls.filter(F.col("date") == F.lit(today).cast("date"))
    reached = F.col("calls") > F.col("daily_limit") if strict else F.col("calls") >= F.col("daily_limit")
    return day.join(limits, "name").select("name", "calls", "daily_limit", reached.alias("exhausted"))


def match_quotes(watch_list: DataFrame, quotes: DataFrame) -> DataFrame:
    return watch_list.join(quotes, "symbol")


def benchmark_compare(strategy: DataFrame, index: DataFrame) -> DataFrame:
    return strategy.join(index.select("trade_date", F.col("close").alias("index_close")), "trade_date")


def validate_orders(orders: DataFrame, prices: DataFrame, available: DataFrame, cash: Column) -> DataFrame:
    """Flags each order: affordable purchases and covered sales are valid."""
    terms = prices.select("symbol", "close").join(available.select("symbol", "available"), "symbol", "left")
    filled = (F.col("quantity") > 0) & (F.coalesce("symbol", F.lit("")) != "")
    buy = (F.col("type") == "BUY") & (F.col("close") * F.col("quantity") <= cash)
    sell = (F.col("type") == "SELL") & (F.col("quantity") <= F.col("available"))
    return (
        orders.join(terms, "symbol", "left")
        .withColumn("valid", F.coalesce(filled & (buy | sell), F.lit(False)))
        .drop("close", "available")
    )


def matured_investments(investments: DataFrame, predictions: DataFrame, today) -> DataFrame:
    """Investments that ended: extended by their period where a rise is predicted, sold elsewhere."""
    today = F.lit(today).cast("date")
    signal = predictions.select("symbol", F.col("horizon").alias("period"), "prediction")
    rises = F.coalesce(F.col("prediction") == 1, F.lit(False))
    return (
        investments.filter(F.col("end_date") <= today)
        .join(signal, ["symbol", "period"], "left")
        .withColumn("action", F.when(rises, "EXTEND").otherwise("SELL"))
        .withColumn("new_end_date", F.when(rises, F.date_add(today, F.col("period"))))
        .drop("prediction")
    )


def wanted_purchases(portfolio: DataFrame, predictions: DataFrame, prices: DataFrame) -> DataFrame:
    """(symbol, horizon, allocation, quantity, value): what is not spent yet of an allocation, split over the rising
    horizons of its symbol."""
    rising = predictions.filter("prediction = 1")
    count = rising.groupBy("symbol").agg(F.count(F.lit(1)).alias("parts"))
    quantity = F.floor((F.col("allocation") - F.col("investment")) / F.col("close") / F.col("parts"))
    return (
        portfolio.join(prices.select("symbol", "close"), "symbol")
        .join(count, "symbol")
        .withColumn("quantity", quantity)
        .filter("quantity > 0")
        .join(rising.select("symbol", "horizon"), "symbol")
        .select("symbol", "horizon", "allocation", "quantity", (F.col("quantity") * F.col("close")).alias("value"))
    )


def _precedes(names: Sequence[str], row) -> Column:
    """Whether a row comes before ``row`` in the order of ``names``: the first one descending, the others ascending."""
    ahead = F.lit(False)
    for k in reversed(range(len(names))):
        column, value = F.col(names[k]), row[names[k]]
        ahead = (column > value if k == 0 else column < value) | ((column == value) & ahead)
    return ahead


def take_while_affordable(wanted: DataFrame, cash: float, by: str, order: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """The rows that a walk by descending ``by``, then ``order``, can pay one by one from ``cash``; ``value`` is a row's price.

    Cash only falls, so a row dearer than what is left is never bought. A round drops those rows, cuts the walk at
    limits from a sample of fixed size into ranges, and sums values along it: inside each range, and one total for
    each range before. All rows before the first whose sum exceeds the cash are bought. The next round starts at that
    row, which no longer fits, with the cash that is left. Rounds are written tables.
    """
    spark, names, columns = wanted.sparkSession, [by, *order], wanted.columns
    bought, left, rest = [], cash, written(spark, wanted)
    while True:
        rest = rest.filter(F.col("value") <= left)
        drawn = rest.select(*names).orderBy(F.xxhash64(*names), *names).limit(100 * ranges).collect()
        if not drawn:
            break
        drawn.sort(key=lambda r: (-r[by], *[r[c] for c in order]))
        place = sum(((~_precedes(names, drawn[i])).cast("int") for i in range(100, len(drawn), 100)), F.lit(0))
        dealt = rest.withColumn("range_", place)
        totals = dealt.groupBy("range_").agg(F.sum("value").alias("sum_"))
        earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("range_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0.0)).alias("before_"))
        inside = Window.partitionBy("range_").orderBy(F.col(by).desc(), *order).rowsBetween(Window.unboundedPreceding, 0)
        spent = F.col("before_") + F.col("inside_")
        summed = written(spark, dealt.withColumn("inside_", F.sum("value").over(inside)).join(totals, "range_").withColumn("spent_", spent))
        stop = summed.filter(F.col("spent_") > left).orderBy(F.col(by).desc(), *order).select(*names).first()
        taken = summed if stop is None else summed.filter(_precedes(names, stop))
        bought.append(taken.select(*columns))
        if stop is None:
            break
        left -= taken.agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
        rest = summed.filter(~_precedes(names, stop)).select(*columns)
    return reduce(DataFrame.unionAll, bought) if bought else wanted.limit(0)


def trade_proposals(portfolio: DataFrame, predictions: DataFrame, prices: DataFrame, cash: Column | float) -> DataFrame:
    """Purchases per symbol and rising horizon, in order of allocation, while the cash lasts.

    A proposal that the remaining cash cannot pay is skipped. ``cash`` is one amount for all.
    """
    wanted = wanted_purchases(portfolio, predictions, prices)
    spark = wanted.sparkSession
    amount = float(spark.range(1).select(cash).first()[0]) if isinstance(cash, Column) else cash
    kept = take_while_affordable(wanted, amount, "allocation", ("symbol", "horizon"))
    return kept.select("symbol", F.col("horizon").cast("int").alias("horizon"), F.col("quantity").cast("long").alias("quantity"), "value")


def signal_backtest(signals: DataFrame) -> DataFrame:
    """Gross return of the lot each rising signal opens.

    A lot opens at the close and is looked at every ``horizon`` rows: it goes
    on while the signal rises and ends at the first row where it does not.
    Rows of equal position modulo the horizon form that chain, so the end is
    the next falling row of the chain; lots without one stay open. Input is
    one row per symbol, date and horizon.
    """
    dated = Window.partitionBy("symbol", "horizon").orderBy("trade_date")
    chain = Window.partitionBy("symbol", "horizon", "phase").orderBy(F.col("trade_date").desc())
    later = chain.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(F.col("signal") == 0, F.struct("trade_date", "close"))
    return (
        signals.withColumn("phase", (F.row_number().over(dated) - 1) % F.col("horizon"))
        .withColumn("exit", F.last(ends, ignorenulls=True).over(later))
        .filter("signal = 1")
        .select(
            "symbol",
            "horizon",
            "trade_date",
            F.col("exit.trade_date").alias("exit_date"),
            (F.try_divide(F.col("exit.close"), F.col("close")) - 1).alias("gross_return"),
        )
    )


def strategy_equity(returns: DataFrame) -> DataFrame:
    """Daily and cumulative return per strategy from rows (strategy, trade_date, daily_return, member).

    Members share a day equally; a day without any member returns 0. The
    running sum orders one row per strategy and day.
    """
    share = F.sum(F.when(F.col("member"), F.col("daily_return"))) / F.count_if(F.col("member"))
    daily = returns.groupBy("strategy", "trade_date").agg(F.coalesce(share, F.lit(0.0)).alias("daily_return"))
    so_far = Window.partitionBy("strategy").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("log_equity", F.sum(F.log1p("daily_return")).over(so_far)).withColumn(
        "equity", F.exp("log_equity")
    )
