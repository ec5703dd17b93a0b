"""Technical indicators over daily bars.

Each function adds columns to a bars DataFrame keyed by (symbol, trade_date).
All windows share one specification, so a chain of indicators costs a single
exchange by symbol. A symbol holds one row per day, which bounds the window.
Rows inside an indicator's warm-up are null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import Derived, Ema, ema_scan, mean_at

SMA_PERIODS = (5, 10, 20, 200)
EMA_PERIODS = (5, 10, 20, 200)


def ordered():
    return Window.partitionBy("symbol").orderBy("trade_date")


def running():
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def last(n: int):
    """Frame of the current row and the ``n - 1`` before it."""
    return ordered().rowsBetween(-(n - 1), 0)


def row() -> Column:
    return F.row_number().over(ordered())


def after_warm_up(rows: int, value: Column) -> Column:
    return F.when(row() > rows, value)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, or 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


# --- plain windows -----------------------------------------------------------------


def percent_change(bars: DataFrame, price: str = "close") -> DataFrame:
    before = F.lag(price).over(ordered())
    return bars.withColumn("percent_change", F.coalesce(F.try_divide(F.col(price) - before, before), F.lit(0.0)))


def log_returns(bars: DataFrame, hold: int = 1) -> DataFrame:
    """Log return over ``hold`` rows, dated at the row it starts from; none where a close is 0."""
    ahead = F.lead("close", hold).over(ordered())
    return bars.withColumn("log_return", F.log(F.try_divide(ahead, F.col("close")))).filter("log_return is not null")


def direction_labels(bars: DataFrame, horizons, price: str = "close") -> DataFrame:
    """One row per horizon: 1 where the price ``horizon`` rows ahead is not lower."""
    names = bars.columns
    staged = bars.withColumns({f"ahead{h}_": F.lead(price, h).over(ordered()) for h in horizons})
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ahead{h}_").alias("ahead")) for h in horizons])
    return (
        staged.select(*names, F.inline(pairs))
        .filter("ahead is not null")
        .select(*names, "horizon", F.when(F.col("ahead") - F.col(price) >= 0, 1).otherwise(0).alias("label"))
    )


def sma(bars: DataFrame, periods=SMA_PERIODS, price: str = "close") -> DataFrame:
    return bars.withColumns({f"sma{n}": after_warm_up(n - 1, F.avg(price).over(last(n))) for n in periods})


def obv(bars: DataFrame, price: str = "close") -> DataFrame:
    before = F.lag(price).over(ordered())
    step = (
        F.when(before.isNull() | (F.col(price) > before), F.col("volume"))
        .when(F.col(price) < before, -F.col("volume"))
        .otherwise(0.0)
    )
    return bars.withColumn("step_", step).withColumn("obv", F.sum("step_").over(running())).drop("step_")


def accumulation_distribution(bars: DataFrame, price: str = "close") -> DataFrame:
    spread = F.col("high") - F.col("low")
    flow = ratio((F.col(price) - F.col("low")) - (F.col("high") - F.col(price)), spread) * F.col("volume")
    return bars.withColumn("flow_", flow).withColumn("ad", F.sum("flow_").over(running())).drop("flow_")


def cci(bars: DataFrame, n: int = 14, price: str = "close") -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col(price)) / 3
    staged = bars.withColumn("tp_", typical)
    mean = F.avg("tp_").over(last(n))
    staged = staged.withColumns({"mean_": mean, "frame_": F.collect_list("tp_").over(last(n))})
    deviation = F.aggregate("frame_", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("mean_"))) / n
    gap = F.col("tp_") - F.col("mean_")
    return staged.withColumn(
        "cci", after_warm_up(n - 1, F.when((gap == 0) | (deviation == 0), 0.0).otherwise(gap / (0.015 * deviation)))
    ).drop("tp_", "mean_", "frame_")


def stochastic(bars: DataFrame, fast_k: int = 5, slow_k: int = 3, slow_d: int = 3, price: str = "close") -> DataFrame:
    lowest, highest = F.min("low").over(last(fast_k)), F.max("high").over(last(fast_k))
    warm_up = fast_k + slow_k + slow_d - 3
    staged = bars.withColumn(
        "fast_", after_warm_up(fast_k - 1, 100 * ratio(F.col(price) - lowest, highest - lowest))
    ).withColumn("slow_", after_warm_up(fast_k + slow_k - 2, F.avg("fast_").over(last(slow_k))))
    return staged.withColumns(
        {
            "slow_d": after_warm_up(warm_up, F.avg("slow_").over(last(slow_d))),
            "slow_k": after_warm_up(warm_up, F.col("slow_")),
        }
    ).drop("fast_", "slow_")


def williams_r(bars: DataFrame, n: int = 14, price: str = "close") -> DataFrame:
    lowest, highest = F.min("low").over(last(n)), F.max("high").over(last(n))
    return bars.withColumn("willr", after_warm_up(n - 1, -100 * ratio(highest - F.col(price), highest - lowest)))


# --- recurrences -------------------------------------------------------------------
# Each pair below stages the inputs with windows and names the averages to run, in order, so
# that several indicators can share one scan.


def seed_mean(value: Column, n: int, at: int) -> Column:
    """Mean of the last ``n`` values at row ``at`` (1-based), null elsewhere."""
    return F.when(row() == at, F.avg(value).over(last(n)))


def smooth_inputs(bars: DataFrame, price: str = "close", alpha: float = 0.1):
    staged = bars.withColumn("first_", F.when(row() == 1, F.col(price)))
    return staged, [Ema("smoothed_close", price, "first_", alpha)]


def ema_inputs(bars: DataFrame, periods=EMA_PERIODS, price: str = "close"):
    staged = bars.withColumns({f"seed{n}_": seed_mean(F.col(price), n, n) for n in periods})
    return staged, [Ema(f"ema{n}", price, f"seed{n}_", 2.0 / (n + 1)) for n in periods]


def macd_inputs(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close"):
    """Both averages start on the row where the slow one has its first value; the signal follows their difference."""
    staged = bars.withColumns(
        {"fast_seed_": seed_mean(F.col(price), fast, slow), "slow_seed_": seed_mean(F.col(price), slow, slow)}
    )
    return staged, [
        Ema("macd_fast_", price, "fast_seed_", 2.0 / (fast + 1)),
        Ema("macd_slow_", price, "slow_seed_", 2.0 / (slow + 1)),
        Derived("line_", ("macd_fast_", "macd_slow_"), np.subtract),
        Derived("signal_seed_", ("line_",), mean_at(signal, slow + signal - 1)),
        Ema("macd_sig", "line_", "signal_seed_", 2.0 / (signal + 1)),
    ]


def macd_finish(scanned: DataFrame) -> DataFrame:
    line = F.when(F.col("macd_sig").isNotNull(), F.col("line_"))
    return scanned.withColumns({"macd": line, "macd_hist": line - F.col("macd_sig")}).drop(
        "macd_fast_", "macd_slow_", "fast_seed_", "slow_seed_", "line_", "signal_seed_"
    )


def rsi_inputs(bars: DataFrame, n: int = 14, price: str = "close"):
    diff = F.col(price) - F.lag(price).over(ordered())
    staged = bars.withColumn("diff_", diff).withColumns(
        {"gain_": F.greatest(F.col("diff_"), F.lit(0.0)), "loss_": F.greatest(-F.col("diff_"), F.lit(0.0))}
    )
    staged = staged.withColumns(
        {f"{c}seed_": F.when(row() == n + 1, F.avg(c).over(last(n))) for c in ("gain_", "loss_")}
    )
    return staged, [Ema("up_", "gain_", "gain_seed_", 1.0 / n), Ema("down_", "loss_", "loss_seed_", 1.0 / n)]


def rsi_finish(scanned: DataFrame) -> DataFrame:
    return scanned.withColumn("rsi", 100 * ratio(F.col("up_"), F.col("up_") + F.col("down_"))).drop(
        "diff_", "gain_", "loss_", "gain_seed_", "loss_seed_", "up_", "down_"
    )


def adx_inputs(bars: DataFrame, n: int = 10, price: str = "close"):
    """Directional movement and true range, each with its Wilder sum as a scaled average.

    The sum ``S - S/n + x`` is ``n`` times an average with ``alpha = 1/n`` whose
    first value is ``1/n`` of the plain sum over the first ``n - 1`` moves.
    """
    up = F.col("high") - F.lag("high").over(ordered())
    down = F.lag("low").over(ordered()) - F.col("low")
    before = F.lag(price).over(ordered())
    staged = bars.withColumns({"up_move_": up, "down_move_": down, "prev_": before}).withColumns(
        {
            "minus_": F.when((F.col("down_move_") > 0) & (F.col("up_move_") < F.col("down_move_")), F.col("down_move_"))
            .when(F.col("prev_").isNotNull(), 0.0),
            "plus_": F.when((F.col("up_move_") > 0) & (F.col("up_move_") > F.col("down_move_")), F.col("up_move_"))
            .when(F.col("prev_").isNotNull(), 0.0),
            "range_": F.when(
                F.col("prev_").isNotNull(),
                F.greatest(
                    F.col("high") - F.col("low"),
                    F.abs(F.col("high") - F.col("prev_")),
                    F.abs(F.col("low") - F.col("prev_")),
                ),
            ),
        }
    )
    inputs = ("minus_", "plus_", "range_")
    staged = staged.withColumns({f"{c}seed_": F.when(row() == n, F.sum(c).over(last(n - 1)) / n) for c in inputs})
    return staged, [
        *[Ema(f"{c}sum_", c, f"{c}seed_", 1.0 / n) for c in inputs],
        Derived("dx_", ("plus_sum_", "minus_sum_", "range_sum_"), directional_index(n)),
        Derived("dx_seed_", ("dx_",), mean_at(n, 2 * n)),
        Ema(f"adx{n}", "dx_", "dx_seed_", 1.0 / n),
    ]


def directional_index(n: int):
    """Directional index from row ``n + 1`` on.

    Without any movement the index counts as 0 in the seed, its first ``n`` values, and is missing, which leaves the
    average as it is, after it.
    """

    def index(plus: np.ndarray, minus: np.ndarray, spread: np.ndarray) -> np.ndarray:
        both = plus + minus
        moves = (spread != 0) & (both != 0) & ~np.isnan(both)
        out = np.where(np.arange(len(plus)) < 2 * n, 0.0, np.nan)
        out[moves] = 100 * np.abs(minus - plus)[moves] / both[moves]
        out[:n] = np.nan
        return out

    return index


def adx_finish(scanned: DataFrame) -> DataFrame:
    names = ("minus_", "plus_", "range_")
    return scanned.drop(
        "up_move_", "down_move_", "prev_", "dx_", "dx_seed_",
        *names, *[f"{c}seed_" for c in names], *[f"{c}sum_" for c in names],
    )


def smooth(bars: DataFrame, price: str = "close", alpha: float = 0.1) -> DataFrame:
    return ema_scan(*smooth_inputs(bars, price, alpha)).drop("first_")


def ema(bars: DataFrame, periods=EMA_PERIODS, price: str = "close") -> DataFrame:
    return ema_scan(*ema_inputs(bars, periods, price)).drop(*[f"seed{n}_" for n in periods])


def macd(bars: DataFrame, price: str = "close") -> DataFrame:
    return macd_finish(ema_scan(*macd_inputs(bars, price=price)))


def rsi(bars: DataFrame, price: str = "close") -> DataFrame:
    return rsi_finish(ema_scan(*rsi_inputs(bars, price=price)))


def adx(bars: DataFrame, price: str = "close") -> DataFrame:
    return adx_finish(ema_scan(*adx_inputs(bars, price=price)))


INDICATORS = (
    [f"sma{n}" for n in SMA_PERIODS]
    + [f"ema{n}" for n in EMA_PERIODS]
    + ["macd", "macd_sig", "macd_hist", "rsi", "adx10", "cci", "ad", "obv", "slow_k", "slow_d", "willr"]
)


def all_indicators(bars: DataFrame, price: str = "close") -> DataFrame:
    """The 19 indicators: one exchange by symbol, one scan.

    ``price`` picks raw or smoothed closes; high, low and volume stay raw.
    """
    names = bars.columns
    staged = bars
    for plain in (sma, cci, stochastic, williams_r):
        staged = plain(staged, price=price)
    staged = accumulation_distribution(obv(staged, price), price)
    specs: list[Ema | Derived] = []
    for inputs in (ema_inputs, macd_inputs, rsi_inputs, adx_inputs):
        staged, more = inputs(staged, price=price)
        specs += more
    scanned = ema_scan(staged, specs)
    return adx_finish(rsi_finish(macd_finish(scanned))).select(*names, *INDICATORS)


def incremental_fill(bars: DataFrame, stored: DataFrame, column: str, compute, look_back: int) -> DataFrame:
    """Recompute ``column`` from each symbol's last stored value on.

    ``compute`` needs ``look_back`` rows before the first row it fills; older
    rows are dropped first. Returns only rows whose value is new or changed.
    """
    resume = stored.filter(F.col(column).isNotNull()).groupBy("symbol").agg(F.max("trade_date").alias("resume"))
    newest = bars.join(resume, "symbol", "left").withColumn(
        "to_fill", F.col("resume").isNull() | (F.col("trade_date") >= F.col("resume"))
    )
    backwards = Window.partitionBy("symbol", "to_fill").orderBy(F.col("trade_date").desc())
    kept = newest.withColumn("back", F.row_number().over(backwards)).filter(
        F.col("to_fill") | (F.col("back") <= look_back)
    )
    filled = compute(kept.drop("resume", "back")).filter("to_fill")
    old = stored.select("symbol", "trade_date", F.col(column).alias("old"))
    return (
        filled.join(old, ["symbol", "trade_date"], "left")
        .filter(~F.col(column).eqNullSafe(F.col("old")))
        .select("symbol", "trade_date", column)
    )
