"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.plans.base import Base

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The frames of plans.base in SQL.
FRAMES = """WITH inter AS (
  SELECT o_custkey AS u, l_partkey AS i, count(*) AS n, sum(l_quantity) AS hours, log2(1 + sum(l_quantity)) AS hours_t,
         max(CAST(o_orderdate AS DATE)) AS d, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS early
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
), sizes AS (SELECT u, least(count(*) // 10, 5) AS k FROM inter GROUP BY u HAVING count(*) >= 10
), held AS (
  SELECT u, i FROM (SELECT u, i, k, row_number() OVER (PARTITION BY u ORDER BY md5('42:' || u || ':' || i), i) AS r FROM inter JOIN sizes USING (u)) WHERE r <= k
), drawn AS (
  SELECT u, k, i, j FROM (SELECT u, k, j, CAST('0x' || substr(md5('42n:' || u || ':' || j), 1, 15) AS BIGINT) % n AS place
    FROM (SELECT u, k, unnest(range(0, k * 6)) AS j FROM sizes) CROSS JOIN (SELECT count(*) AS n FROM part)) JOIN (SELECT p_partkey AS i, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part) USING (place)
), negs AS (
  SELECT u, i FROM (SELECT u, k, i, row_number() OVER (PARTITION BY u ORDER BY j) AS r FROM (
    SELECT u, k, i, min(j) AS j FROM drawn WHERE i IN (SELECT p_partkey FROM part) AND (u, i) NOT IN (SELECT (u, i) FROM inter) GROUP BY 1, 2, 3)) WHERE r <= k
), cand AS (
  SELECT u * 16 + row_number() OVER (PARTITION BY u ORDER BY i, label) AS id, u, i, label FROM (SELECT u, i, 1 AS label FROM held UNION ALL SELECT u, i, 0 FROM negs)
), train AS (SELECT * FROM inter ANTI JOIN held USING (u, i)
), ipop AS (SELECT i, count(*) AS pop, avg(date_diff('day', DATE '1970-01-01', d)) AS day_i, avg(hours_t) AS mean_t FROM train GROUP BY i
), udeg AS (SELECT u, count(*) AS deg, avg(date_diff('day', DATE '1970-01-01', d)) AS day_u FROM train GROUP BY u
), base AS (
  SELECT id, u, i, label, coalesce(pop, 0) AS pop, coalesce(deg, 0) AS deg, round(ln(1 + coalesce(pop, 0)), 9) AS s1,
         round(coalesce(-abs(day_u - day_i) / 365.0, -10.0), 9) AS s2, round(coalesce(mean_t, 0.0), 9) AS s3
  FROM cand LEFT JOIN ipop USING (i) LEFT JOIN udeg USING (u)
), decoded AS (
  SELECT *, count(*) OVER (PARTITION BY u) // 2 AS k, row_number() OVER (PARTITION BY u ORDER BY s1 DESC, id) AS r1,
         row_number() OVER (PARTITION BY u ORDER BY s2 DESC, id) AS r2, row_number() OVER (PARTITION BY u ORDER BY s3 DESC, id) AS r3 FROM base
), preds AS (SELECT *, CAST(r1 <= k AS INT) AS p1, CAST(r2 <= k AS INT) AS p2, CAST(r3 <= k AS INT) AS p3 FROM decoded)
"""


def query(name: str, sql: str | None = None, frames: bool = True):
    """Register a function of Base as a query, with its SQL after the frames (or alone)."""

    def register(f: Callable[[Base], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Base(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = (FRAMES if frames else "") + sql
        return f

    return register
