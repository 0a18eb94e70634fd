"""Geo-located observations derived from the star-schema tables, in Spark and in SQL.

Coordinates come from a key by integer arithmetic, so both engines see the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _coords(key: str) -> str:
    return f"35.0e0 + ({key} * 7919 % 20000) / 1000.0e0 AS lat, -10.0e0 + ({key} * 104729 % 40000) / 1000.0e0 AS lon"


def _points(time: str) -> str:
    return f"SELECT CAST(c_custkey AS BIGINT) AS row, CAST(c_custkey AS DOUBLE) AS unit, {time} AS time, {_coords('CAST(c_custkey AS BIGINT)')}, CAST(c_acctbal AS DOUBLE) / 1000.0e0 AS y, ((CAST(c_custkey AS BIGINT) * 31) % 17 - 8) / 10.0e0 AS z FROM customer"


#: Customers as a cross-section, and in three periods of different customers.
XS = _points("1.0e0")
UNB3 = _points("CAST(c_custkey % 3 AS DOUBLE)")
#: Suppliers by year: a balanced panel.
BAL = f"""
SELECT u * 10000 + CAST(time AS BIGINT) AS row, CAST(u AS DOUBLE) AS unit, time, {_coords('u')}, y, z FROM (
  SELECT CAST(l_suppkey AS BIGINT) AS u, CAST(year(l_shipdate) AS DOUBLE) AS time, sum(CAST(l_extendedprice AS DOUBLE)) / 1.0e6 AS y, avg(CAST(l_quantity AS DOUBLE)) AS z
  FROM lineitem GROUP BY l_suppkey, year(l_shipdate))
"""
#: Users by day: an unbalanced panel with gaps.
DAY = f"""
SELECT u * 100 + CAST(time AS BIGINT) AS row, CAST(u AS DOUBLE) AS unit, time, {_coords('u')}, y, z FROM (
  SELECT CAST(user_id AS BIGINT) AS u, CAST(day(ts) AS DOUBLE) AS time, sum(CAST(value AS DOUBLE)) / 100.0e0 AS y, count(*) - 2.0e0 AS z
  FROM events GROUP BY user_id, day(ts))
"""
SQL = {"xs": XS, "unb3": UNB3, "bal": BAL, "day": DAY}
_BASE = {"xs": "customer", "unb3": "customer", "bal": "lineitem", "day": "events"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """row, unit, time, lat, lon, y, z of a fixture."""
    base = _BASE[name]
    view = f"__fixture_{base}"
    spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(view)
    return spark.sql(SQL[name].replace(f"FROM {base}", f"FROM {view}"))


def observed(points: DataFrame) -> DataFrame:
    """Points in canonical form, with regressors (1, z) and y in the place of residuals."""
    return points.select("row", "unit", "time", "lat", "lon", F.col("y").alias("e"), F.array(F.lit(1.0), F.col("z")).alias("x"))
