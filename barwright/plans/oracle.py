"""Pieces of DuckDB SQL that the statements in the catalog are put together from."""

from __future__ import annotations

BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY event_type, date_trunc('hour', ts)),
b AS (SELECT *, close AS p, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n_bars FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts))"""
W = "PARTITION BY symbol ORDER BY bar_ts"


def with_bars(body: str) -> str:
    return f"WITH RECURSIVE {BARS}{body}"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) WHEN ({b}) = 0 AND ({a}) > 0 THEN CAST('Infinity' AS DOUBLE) WHEN ({b}) = 0 AND ({a}) < 0 THEN CAST('-Infinity' AS DOUBLE) END)"


def lag(x: str, n: int = 1) -> str:
    return f"(lag({x}, {n}) OVER ({W}))"


def roll(f: str, x: str, n: int) -> str:
    over = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {over} = {n} THEN {f}({x}) {over} END)"


def change(x: str, n: int) -> str:
    return f"({div(x, lag(x, n))} - 1)"


def rounded(**columns: str) -> str:
    return ", ".join(f"round({x}, 6) + 0.0 AS {name}" for name, x in columns.items())


def chain(name: str, source: str, x: str, alpha: float, first: str = "rn = 1") -> str:
    """A CTE (symbol, rn, e) of e += alpha * (x - e) over `source`, from the row where `first` holds."""
    return f"""{name} AS (
  SELECT symbol, rn, CAST({x} AS DOUBLE) AS e FROM {source} WHERE {first}
  UNION ALL
  SELECT s.symbol, s.rn, q.e + {alpha!r} * (s.{x} - q.e) FROM {name} q JOIN {source} s ON s.symbol = q.symbol AND s.rn = q.rn + 1)"""
