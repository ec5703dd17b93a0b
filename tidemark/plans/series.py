"""Indicator and label queries over daily bars, and chunked series over ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import resume, series
from tidemark.plans import sql
from tidemark.plans.registry import query
from tidemark.plans.views import HORIZONS, daily_bars, naive, ticks
from tidemark.session import written

KEY = ["symbol", "trade_date"]
ORD = "(PARTITION BY symbol ORDER BY trade_date)"


def over(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RUNNING = "(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def rounded(df, places: int, *names: str):
    return df.select(*KEY, *[F.round(n, places).alias(n) for n in names])


def settle(name: str, places: int):
    """Rounded, with exact ties moved up first.

    Engines differ in the last bit of a recurrence; a value that ends in a 5
    right after the last place would round either way.
    """
    return F.round(F.col(name) + 1e-8, places).alias(name)


def settled(df, places: int, *names: str):
    return df.select(*KEY, *[settle(n, places) for n in names])


@query("percent_change", sql.brand(f"""
SELECT symbol, trade_date, coalesce((close - lag(close) OVER {ORD}) / lag(close) OVER {ORD}, 0) AS percent_change
FROM bars"""))
def percent_change(spark, sf):
    return ind.percent_change(daily_bars(spark, sf)).select(*KEY, "percent_change")


@query("log_returns", sql.brand(f"""
SELECT symbol, trade_date, {sql.rnd('log_return', 9, 'log_return')} FROM (
  SELECT symbol, trade_date, ln(lead(close, 1) OVER {ORD} / close) AS log_return FROM bars)
WHERE log_return IS NOT NULL"""))
def log_returns(spark, sf):
    return rounded(ind.log_returns(daily_bars(spark, sf)), 9, "log_return")


@query("direction_label", sql.brand(" UNION ALL ".join(f"""
SELECT symbol, trade_date, CAST({h} AS INTEGER) AS horizon, CAST(CASE WHEN ahead - close >= 0 THEN 1 ELSE 0 END AS INTEGER) AS label
FROM (SELECT symbol, trade_date, close, lead(close, {h}) OVER {ORD} AS ahead FROM bars) WHERE ahead IS NOT NULL
""" for h in HORIZONS)))
def direction_label(spark, sf):
    return ind.direction_labels(daily_bars(spark, sf), HORIZONS).select(*KEY, "horizon", "label")


@query("sma", sql.brand("SELECT symbol, trade_date, " + ", ".join(
    f"CASE WHEN row_number() OVER {ORD} >= {n} THEN avg(close) OVER {over(n)} END AS sma{n}"
    for n in ind.SMA_PERIODS) + " FROM bars"))
def sma(spark, sf):
    return ind.sma(daily_bars(spark, sf)).select(*KEY, *[f"sma{n}" for n in ind.SMA_PERIODS])


@query("obv", sql.brand(f"""
SELECT symbol, trade_date, sum(step) OVER {RUNNING} AS obv FROM (
  SELECT symbol, trade_date, CASE WHEN p IS NULL OR close > p THEN volume WHEN close < p THEN -volume ELSE 0 END AS step
  FROM (SELECT *, lag(close) OVER {ORD} AS p FROM bars))"""))
def obv(spark, sf):
    return ind.obv(daily_bars(spark, sf)).select(*KEY, "obv")


@query("accumulation_distribution", sql.brand(f"""
SELECT symbol, trade_date, round(sum(flow) OVER {RUNNING}, 3) + 0.0 AS ad FROM (
  SELECT *, CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END AS flow FROM bars)"""))
def accumulation_distribution(spark, sf):
    return rounded(ind.accumulation_distribution(daily_bars(spark, sf)), 3, "ad")


@query("cci", sql.brand(f"""
SELECT symbol, trade_date, CASE WHEN rn >= 14 THEN CASE WHEN tp = m OR dev = 0 THEN 0.0
  ELSE round((tp - m) / (0.015 * dev), 5) + 0.0 END END AS cci
FROM (SELECT *, list_sum(list_transform(frame, lambda x: abs(x - m))) / 14 AS dev
  FROM (SELECT symbol, trade_date, tp, row_number() OVER {ORD} AS rn, avg(tp) OVER {over(14)} AS m,
               list(tp) OVER {over(14)} AS frame
        FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars)))"""))
def cci(spark, sf):
    return rounded(ind.cci(daily_bars(spark, sf)), 5, "cci")


@query("stochastic", sql.brand(f"""
SELECT symbol, trade_date, CASE WHEN rn > 8 THEN round(slow, 6) + 0.0 END AS slow_k,
       CASE WHEN rn > 8 THEN round(avg(slow) OVER {over(3)}, 6) + 0.0 END AS slow_d
FROM (SELECT *, avg(fast) OVER {over(3)} AS slow
  FROM (SELECT symbol, trade_date, row_number() OVER {ORD} AS rn,
               CASE WHEN hh = ll THEN 0 ELSE 100 * ((close - ll) / (hh - ll)) END AS fast
        FROM (SELECT *, min(low) OVER {over(5)} AS ll, max(high) OVER {over(5)} AS hh FROM bars)))"""))
def stochastic(spark, sf):
    return rounded(ind.stochastic(daily_bars(spark, sf)), 6, "slow_k", "slow_d")


@query("williams_r", sql.brand(f"""
SELECT symbol, trade_date, CASE WHEN rn >= 14 THEN CASE WHEN hh = ll THEN 0.0
  ELSE round(-100 * ((hh - close) / (hh - ll)), 6) + 0.0 END END AS willr
FROM (SELECT *, row_number() OVER {ORD} AS rn, min(low) OVER {over(14)} AS ll, max(high) OVER {over(14)} AS hh FROM bars)"""))
def williams_r(spark, sf):
    return rounded(ind.williams_r(daily_bars(spark, sf)), 6, "willr")


# --- recurrences -------------------------------------------------------------------

EMA_BASE = f"""
base AS (SELECT symbol, trade_date, close, row_number() OVER {ORD} AS rn, """ + ", ".join(
    f"avg(close) OVER {over(n)} AS m{n}" for n in (5, 10, 12, 20, 26, 200)) + " FROM bars)"
EMA_STATES = {f"ema{n}": sql.average(f"ema{n}", "b.close", f"b.m{n}", n, 2.0 / (n + 1)) for n in ind.EMA_PERIODS}
FAST = "(s.fast + 0.15384615384615385 * (b.close - s.fast))"
SLOW = "(s.slow + 0.07407407407407407 * (b.close - s.slow))"
MACD_STATES = {
    "fast": sql.average("fast", "b.close", "b.m12", 26, 2.0 / 13),
    "slow": sql.average("slow", "b.close", "b.m26", 26, 2.0 / 27),
    "total": ("NULL", f"CASE WHEN b.rn < 26 THEN NULL WHEN b.rn = 26 THEN b.m12 - b.m26 "
                      f"WHEN b.rn <= 34 THEN s.total + ({FAST} - {SLOW}) END"),
    "sig": ("NULL", f"CASE WHEN b.rn < 34 THEN NULL WHEN b.rn = 34 THEN (s.total + ({FAST} - {SLOW})) / 9 "
                    f"ELSE s.sig + 0.2 * (({FAST} - {SLOW}) - s.sig) END"),
}
MACD_OUT = """round(CASE WHEN rn >= 34 THEN fast - slow + 1e-8 END, 4) + 0.0 AS macd, round(sig + 1e-8, 4) + 0.0 AS macd_sig,
       round(fast - slow - sig + 1e-8, 4) + 0.0 AS macd_hist"""
RSI_BASE = f"""
rsi_base AS (
  SELECT *, avg(gain) OVER {over(14)} AS mg, avg(loss) OVER {over(14)} AS ml
  FROM (SELECT *, greatest(d, 0) AS gain, greatest(-d, 0) AS loss
    FROM (SELECT symbol, trade_date, row_number() OVER {ORD} AS rn, close - lag(close) OVER {ORD} AS d FROM bars)))"""
RSI_STATES = {
    "g": sql.average("g", "b.gain", "b.mg", 15, 1.0 / 14),
    "l": sql.average("l", "b.loss", "b.ml", 15, 1.0 / 14),
}
RSI_OUT = "CASE WHEN g + l = 0 THEN 0.0 ELSE round(100 * (g / (g + l)) + 1e-8, 4) + 0.0 END AS rsi"
ADX_BASE = f"""
adx_base AS (
  SELECT *, sum(pdm) OVER {over(9)} AS sp, sum(mdm) OVER {over(9)} AS sm, sum(tr) OVER {over(9)} AS st
  FROM (SELECT *, CASE WHEN dm > 0 AND dp < dm THEN dm ELSE 0 END AS mdm,
               CASE WHEN dp > 0 AND dp > dm THEN dp ELSE 0 END AS pdm,
               greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
    FROM (SELECT *, row_number() OVER {ORD} AS rn, high - lag(high) OVER {ORD} AS dp,
                 lag(low) OVER {ORD} - low AS dm, lag(close) OVER {ORD} AS pc FROM bars)))"""


def _wilder(name: str, value: str, seed: str) -> tuple[str, str]:
    return ("NULL", f"CASE WHEN b.rn < 10 THEN NULL WHEN b.rn = 10 THEN b.{seed} "
                    f"ELSE s.{name} - s.{name} / 10 + b.{value} END")


def _now(name: str, value: str) -> str:
    return f"(s.{name} - s.{name} / 10 + b.{value})"


P, M, R = _now("p", "pdm"), _now("m", "mdm"), _now("t", "tr")
STILL = f"({R} = 0 OR {P} + {M} = 0)"
DX = f"(100 * abs({P} - {M}) / ({P} + {M}))"
ADX_STATES = {
    "p": _wilder("p", "pdm", "sp"), "m": _wilder("m", "mdm", "sm"), "t": _wilder("t", "tr", "st"),
    "dxs": ("0", f"CASE WHEN b.rn <= 10 THEN 0 WHEN b.rn <= 20 THEN s.dxs + CASE WHEN {STILL} THEN 0 ELSE {DX} END END"),
    "adx": ("NULL", f"CASE WHEN b.rn < 20 THEN NULL WHEN b.rn = 20 THEN (s.dxs + CASE WHEN {STILL} THEN 0 ELSE {DX} END) / 10 "
                    f"WHEN {STILL} THEN s.adx ELSE (s.adx * 9 + {DX}) / 10 END"),
}


@query("exp_smooth", sql.brand(
    "SELECT symbol, trade_date, round(y + 1e-8, 4) + 0.0 AS smoothed_close FROM scan", EMA_BASE,
    sql.scan({"y": ("b.close", "0.1 * b.close + 0.9 * s.y")}), recursive=True))
def exp_smooth(spark, sf):
    return settled(ind.smooth(daily_bars(spark, sf)), 4, "smoothed_close")


@query("ema", sql.brand(
    "SELECT symbol, trade_date, " + ", ".join(f"round(ema{n} + 1e-8, 4) + 0.0 AS ema{n}" for n in ind.EMA_PERIODS) + " FROM scan",
    EMA_BASE, sql.scan(EMA_STATES), recursive=True))
def ema(spark, sf):
    return settled(ind.ema(daily_bars(spark, sf)), 4, *[f"ema{n}" for n in ind.EMA_PERIODS])


@query("macd", sql.brand(f"SELECT symbol, trade_date, {MACD_OUT} FROM scan", EMA_BASE, sql.scan(MACD_STATES), recursive=True))
def macd(spark, sf):
    return settled(ind.macd(daily_bars(spark, sf)), 4, "macd", "macd_sig", "macd_hist")


@query("rsi", sql.brand(f"SELECT symbol, trade_date, {RSI_OUT} FROM scan", RSI_BASE, sql.scan(RSI_STATES, "rsi_base"), recursive=True))
def rsi(spark, sf):
    return settled(ind.rsi(daily_bars(spark, sf)), 4, "rsi")


@query("adx", sql.brand("SELECT symbol, trade_date, round(adx + 1e-8, 4) + 0.0 AS adx10 FROM scan", ADX_BASE,
                        sql.scan(ADX_STATES, "adx_base"), recursive=True))
def adx(spark, sf):
    return settled(ind.adx(daily_bars(spark, sf)), 4, "adx10")


ALL_BASE = """
base AS (SELECT e.*, r.* EXCLUDE (symbol, trade_date, rn), a.* EXCLUDE (symbol, trade_date, rn, close)
  FROM ema_base e JOIN rsi_base r USING (symbol, rn) JOIN adx_base a USING (symbol, rn))"""
ALL_PLAIN = f"""
plain AS (SELECT symbol, trade_date, rn, """ + ", ".join(
    f"CASE WHEN rn >= {n} THEN avg(close) OVER {over(n)} END AS sma{n}" for n in ind.SMA_PERIODS) + f""",
  sum(CASE WHEN pc IS NULL OR close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER {RUNNING} AS obv,
  sum(CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END) OVER {RUNNING} AS ad,
  CASE WHEN rn >= 14 THEN CASE WHEN hh14 = ll14 THEN 0 ELSE -100 * ((hh14 - close) / (hh14 - ll14)) END END AS willr,
  CASE WHEN rn >= 14 THEN CASE WHEN tp = tm OR dev = 0 THEN 0 ELSE (tp - tm) / (0.015 * dev) END END AS cci,
  CASE WHEN rn > 8 THEN slow END AS slow_k, CASE WHEN rn > 8 THEN avg(slow) OVER {over(3)} END AS slow_d
FROM (SELECT *, list_sum(list_transform(frame, lambda x: abs(x - tm))) / 14 AS dev, avg(fast) OVER {over(3)} AS slow
  FROM (SELECT *, CASE WHEN hh5 = ll5 THEN 0 ELSE 100 * ((close - ll5) / (hh5 - ll5)) END AS fast
    FROM (SELECT *, avg(tp) OVER {over(14)} AS tm, list(tp) OVER {over(14)} AS frame,
                 min(low) OVER {over(5)} AS ll5, max(high) OVER {over(5)} AS hh5,
                 min(low) OVER {over(14)} AS ll14, max(high) OVER {over(14)} AS hh14
      FROM (SELECT *, (high + low + close) / 3 AS tp FROM adx_base)))))"""
ALL_COLUMNS = [c for c in ind.INDICATORS]
_ALL_EXPR = {
    "macd": "CASE WHEN rn >= 34 THEN fast - slow END", "macd_sig": "sig", "macd_hist": "fast - slow - sig",
    "rsi": "CASE WHEN g + l = 0 THEN 0.0 ELSE 100 * (g / (g + l)) END", "adx10": "adx",
}


def all_sql(column: str) -> str:
    """Averages of exact prices are equal as they are; the rest is rounded."""
    value = _ALL_EXPR.get(column, column)
    return f"{value} AS {column}" if column.startswith("sma") else f"round({value} + 1e-8, 3) + 0.0 AS {column}"


ALL_SQL = sql.region(
    "SELECT symbol, scan.trade_date, " + ", ".join(map(all_sql, ALL_COLUMNS))
    + " FROM scan JOIN plain USING (symbol, rn)",
    EMA_BASE.replace("base AS", "ema_base AS"), RSI_BASE, ADX_BASE, ALL_BASE, ALL_PLAIN,
    sql.scan({**EMA_STATES, **MACD_STATES, **RSI_STATES, **ADX_STATES}), recursive=True)


@query("all_indicators", ALL_SQL)
def all_indicators(spark, sf):
    table = ind.all_indicators(daily_bars(spark, sf, "region"))
    return table.select(*KEY, *[c if c.startswith("sma") else settle(c, 3) for c in ALL_COLUMNS])


@query("incremental_fill", sql.brand(f"""
SELECT symbol, trade_date, sma20 FROM (
  SELECT symbol, trade_date, row_number() OVER {ORD} AS rn, avg(close) OVER {over(20)} AS sma20 FROM bars)
WHERE rn >= 20 AND trade_date > DATE '1998-12-31'"""))
def incremental_fill(spark, sf):
    bars = daily_bars(spark, sf)
    stored = ind.sma(bars, [20]).withColumn("sma20", F.expr("if(trade_date <= date'1998-12-31', sma20, null)"))
    filled = ind.incremental_fill(bars, stored, "sma20", lambda b: ind.sma(b, [20]), 20)
    return filled


RESUME_DATE = "1998-06-30"


RESUME_WINDOWS = (EMA_BASE.replace("base AS", "ema_base AS"), RSI_BASE, """
base AS (SELECT e.*, r.* EXCLUDE (symbol, trade_date, rn) FROM ema_base e JOIN rsi_base r USING (symbol, rn))""", f"""
windows AS (SELECT symbol, rn, CASE WHEN rn >= 20 THEN avg(close) OVER {over(20)} END AS sma20,
  sum(CASE WHEN p IS NULL OR close > p THEN volume WHEN close < p THEN -volume ELSE 0 END) OVER {RUNNING} AS obv
  FROM (SELECT *, row_number() OVER {ORD} AS rn, lag(close) OVER {ORD} AS p FROM bars))""")


@query("resumed_indicators", sql.brand(f"""
SELECT symbol, scan.trade_date, sma20, round(ema20 + 1e-8, 4) + 0.0 AS ema20, {RSI_OUT}, obv
FROM scan JOIN windows USING (symbol, rn) WHERE scan.trade_date > DATE '{RESUME_DATE}'""", *RESUME_WINDOWS,
    sql.scan({"ema20": EMA_STATES["ema20"], **RSI_STATES}), recursive=True))
def resumed_indicators(spark, sf):
    """The stored state of the older bars, then the newer ones in two steps from it."""
    bars = daily_bars(spark, sf)
    state, filled = resume.empty_state(spark), []
    for start, end in (("0001-01-01", RESUME_DATE), (RESUME_DATE, "1998-10-15"), ("1998-10-15", "9999-12-31")):
        new = bars.filter((F.col("trade_date") > F.lit(start).cast("date")) & (F.col("trade_date") <= F.lit(end).cast("date")))
        filled.append(written(spark, resume.advance(state, new)))
        state = written(spark, resume.next_state(filled[-1], state))
    return filled[1].unionByName(filled[2]).select(*KEY, "sma20", settle("ema20", 4), settle("rsi", 4), "obv")


# --- ticks, in chunks --------------------------------------------------------------

TICKS = """
ticks AS (SELECT event_type AS symbol, ts, event_id, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn,
  lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events)"""


@query("tick_ema", "WITH RECURSIVE " + TICKS + """,
scan AS (
  SELECT symbol, ts, rn, price AS y FROM ticks WHERE rn = 1
  UNION ALL SELECT t.symbol, t.ts, t.rn, s.y + 0.01 * (t.price - s.y) FROM scan s JOIN ticks t ON t.symbol = s.symbol AND t.rn = s.rn + 1)
SELECT symbol, ts, round(y + 1e-8, 4) + 0.0 AS ema FROM scan""")
def tick_ema(spark, sf):
    chunked = ticks(spark, sf).withColumn("day", series.chunk_of("ts", "day"))
    averaged = series.chunked_ema(chunked, "price", "ema", 0.01, "day")
    return averaged.select("symbol", naive("ts"), settle("ema", 4))


@query("tick_obv", "WITH " + TICKS + """
SELECT symbol, ts, sum(CASE WHEN p IS NULL OR price > p THEN 1.0 WHEN price < p THEN -1.0 ELSE 0.0 END)
  OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS obv FROM ticks""")
def tick_obv(spark, sf):
    chunked = ticks(spark, sf).withColumn("day", series.chunk_of("ts", "day"))
    moved = series.chunked_lag(chunked, "price", "p", "day").withColumn(
        "step", F.expr("case when p is null or price > p then 1.0D when price < p then -1.0D else 0.0D end")
    )
    return series.chunked_sum(moved, "step", "obv", "day").select("symbol", naive("ts"), "obv")
