"""The canonical frame: row, unit, time, lat, lon, e and x, an array of the regressors.

Names are kept apart by construction: whatever the input's columns are called, only the ones
named by the parameters are read.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrahac.plans.spec import SpatialHacSpec

log = logging.getLogger("terrahac")


def key(column: Column) -> Column:
    """A label as a number; null if it is none. NaN is null too, as it must equal nothing."""
    x = column.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def canonical(df: DataFrame, spec: SpatialHacSpec, x_cols: list[str], e_col: str, subset: str | None = None) -> DataFrame:
    """The rows of df (those that subset, an SQL predicate, keeps) in canonical form.

    Without a unit the rows are a cross-section: each its own unit, all at time 1.
    """
    if not x_cols:
        raise ValueError("Could not infer coefficient names: there are no regressors.")
    missing = [c for c in [*x_cols, e_col, spec.lat, spec.lon, spec.unit, spec.time] if c and c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    if subset:
        df = df.filter(subset)
    q = lambda c: F.col(f"`{c}`")
    row = F.monotonically_increasing_id()
    panel = spec.unit is not None
    return df.select(
        row.alias("row"),
        (key(q(spec.unit)) if panel else row.cast("double")).alias("unit"),
        (key(q(spec.time)) if panel else F.lit(1.0)).alias("time"),
        q(spec.lat).cast("double").alias("lat"),
        q(spec.lon).cast("double").alias("lon"),
        q(e_col).cast("double").alias("e"),
        F.array(*[q(c).cast("double") for c in x_cols]).alias("x"),
    )


def align(rows: DataFrame, extras: DataFrame, on: str) -> DataFrame:
    """The extra columns of exactly the rows of an estimate, matched by a row name."""
    return rows.join(extras, on, "left")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_check(obs: DataFrame) -> DataFrame:
    """One row: n, bad_coords (not finite), bad_rows (null e or regressor), panel (more times than one), far_lat."""
    return obs.agg(
        F.count("*").alias("n"),
        F.sum(F.when(_finite(F.col("lat")) & _finite(F.col("lon")), 0).otherwise(1)).alias("bad_coords"),
        F.sum(F.when(F.col("e").isNull() | F.exists("x", lambda v: v.isNull()), 1).otherwise(0)).alias("bad_rows"),
        F.coalesce(F.min("time") != F.max("time"), F.lit(False)).alias("panel"),
        F.sum(F.when(F.abs(F.col("lat")) > 90, 1).otherwise(0)).alias("far_lat"),
    )


def block_sizes(obs: DataFrame) -> DataFrame:
    """time, n: rows of each period."""
    return obs.groupBy("time").agg(F.count("*").alias("n"))


def moving_units(obs: DataFrame) -> DataFrame:
    """Units whose coordinates change over time; no more is needed of a unit than its extremes."""
    ends = obs.groupBy("unit").agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    return ends.filter("min_lat <> max_lat or min_lon <> max_lon").select("unit")


def check(obs: DataFrame, spec: SpatialHacSpec, r=None) -> tuple[bool, bool]:
    """Raise what the inputs don't allow; whether there are several times, and whether one neighbour graph serves all.

    r: the counts of finite_check, where they are known.
    """
    r = r or finite_check(obs).first()
    if not r.n:
        raise ValueError("there are no rows to estimate from")
    if r.bad_coords:
        raise ValueError("lat/lon contain non-finite values.")
    if r.bad_rows:
        raise ValueError("residuals or regressors contain nulls.")
    if r.far_lat:
        log.warning("latitudes beyond 90 degrees")
    if spec.balanced_pnl and r.panel:
        if not obs.filter("unit is null").isEmpty():
            raise ValueError("balanced_pnl = TRUE requires a unit in every row.")
        if not moving_units(obs).isEmpty():
            raise ValueError("balanced_pnl = TRUE requires time-invariant coordinates per unit, but some units have varying lat or lon across periods.")
        b = block_sizes(obs).agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
        if b.lo != b.hi:
            log.warning("balanced_pnl = TRUE, but periods differ in size; the general path is taken")
            return r.panel, False
    return r.panel, spec.balanced_pnl and r.panel
