"""SQL text shared by the queries that DuckDB runs for comparison."""

from __future__ import annotations

BRAND_TRADES = """
trades AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
         floor(l_extendedprice / l_quantity * 64) / 64 AS price, l_quantity AS volume,
         l_linestatus AS status, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

REGION_TRADES = """
trades AS (
  SELECT r_name AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
         floor(l_extendedprice / l_quantity * 64) / 64 AS price, l_quantity AS volume,
         l_linestatus AS status, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

BARS = """
bars AS (
  SELECT symbol, trade_date,
         first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open,
         max(price) AS high, min(price) AS low,
         last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close,
         sum(volume) AS volume
  FROM trades GROUP BY symbol, trade_date)"""

MINUTES = """
minutes AS (
  SELECT event_type AS symbol, date_trunc('minute', ts) AS ts,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume,
         minute(date_trunc('minute', ts)) % 2 = 1 AS provisional
  FROM events GROUP BY event_type, date_trunc('minute', ts))"""


def brand(body: str, *ctes: str, recursive: bool = False) -> str:
    return _with([BRAND_TRADES, BARS, *ctes], body, recursive)


def region(body: str, *ctes: str, recursive: bool = False) -> str:
    return _with([REGION_TRADES, BARS, *ctes], body, recursive)


def minutes(body: str, *ctes: str) -> str:
    return _with([MINUTES, *ctes], body, False)


def _with(ctes, body: str, recursive: bool) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes) + "\n" + body


def rnd(expr: str, places: int, name: str) -> str:
    """Rounded column; adding 0.0 turns a negative zero into zero."""
    return f"round({expr}, {places}) + 0.0 AS {name}"


def scan(states: dict[str, tuple[str, str]], source: str = "base") -> str:
    """Recursive CTE ``scan`` that runs ``states`` along ``rn`` within each symbol.

    A state is (first value, step); the step reads the previous row as ``s``
    and the current one as ``b``.
    """
    first = ", ".join(f"CAST({init} AS DOUBLE) AS {name}" for name, (init, _) in states.items())
    step = ", ".join(f"CAST({step} AS DOUBLE)" for _, step in states.values())
    return f"""
scan AS (
  SELECT b.symbol, b.trade_date, b.rn, {first} FROM {source} b WHERE b.rn = 1
  UNION ALL
  SELECT b.symbol, b.trade_date, b.rn, {step}
  FROM scan s JOIN {source} b ON b.symbol = s.symbol AND b.rn = s.rn + 1)"""


def average(name: str, value: str, seed: str, at: int, alpha: float) -> tuple[str, str]:
    """Step of an exponential average seeded with ``seed`` at row ``at``."""
    return (
        "NULL",
        f"CASE WHEN b.rn < {at} THEN NULL WHEN b.rn = {at} THEN {seed} "
        f"ELSE s.{name} + {alpha!r} * (({value}) - s.{name}) END",
    )
