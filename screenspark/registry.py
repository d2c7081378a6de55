"""Queries by name, each with its DuckDB SQL if it has one."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def ks_exact_sql(tests: str) -> str:
    """CTEs up to ``exact (key, p)``: the exact two-sided KS p of ``tests (key, ks, n1, n2)``, the share of all orders of both samples that leave the band.

    ``walk`` holds the mass of all prefixes that are still inside, by their length and their number of values of the first sample.
    """
    return f"""tests AS ({tests}),
sized AS (SELECT key, CAST(n1 AS BIGINT) AS m, CAST(n2 AS BIGINT) AS n, gcd(CAST(n1 AS BIGINT), CAST(n2 AS BIGINT)) AS g, ks FROM tests),
limits AS (SELECT key, m, n, m // g AS a, n // g AS b, CAST(round(ks * (m // g) * n) AS BIGINT) AS h FROM sized),
walk AS (SELECT key, m, n, a, b, h, 0::BIGINT AS k, 0::BIGINT AS i, 1.0::DOUBLE AS mass, FALSE AS beyond FROM limits WHERE h > 0
  UNION ALL
  SELECT key, m, n, a, b, h, k + 1, j, sum(w), abs(j * b - (k + 1 - j) * a) >= h
  FROM (SELECT key, m, n, a, b, h, k, i + d AS j, mass * CASE d WHEN 0 THEN n - k + i ELSE m - i END / (m + n - k) AS w
        FROM walk, (VALUES (0::BIGINT), (1::BIGINT)) t(d) WHERE NOT beyond AND k < m + n) WHERE w > 0
  GROUP BY key, m, n, a, b, h, k, j),
exact AS (SELECT limits.key, CASE WHEN max(limits.h) = 0 THEN 1.0 ELSE least(1.0, coalesce(sum(mass) FILTER (beyond), 0)) END::DOUBLE AS p FROM limits LEFT JOIN walk ON walk.key = limits.key GROUP BY limits.key)"""
