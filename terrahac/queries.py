"""The registered queries, one for each operator, over fixtures of the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrahac.fixtures import load, observed
from terrahac.functions.geo import DISTANCE, cached, lon_wrapped, safe_acos, weight
from terrahac.operators import meat as M
from terrahac.operators.pairs import neighbour_counts, pairs, reuse, row_counts, unit_edges
from terrahac.operators.serial import serial_join, serial_window
from terrahac.operators.vcov import inverse, matrix, spatial_hac
from terrahac.oracle import CUTOFF, LAG
from terrahac.plans.fit import ols, within_one, within_two
from terrahac.plans.spec import SpatialHacSpec
from terrahac.sources.frame import align, block_sizes, canonical, finite_check, key, moving_units

Query = Callable[[SparkSession, str], DataFrame]


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _long(df: DataFrame) -> DataFrame:
    return df.select("a", "b", r6("value").alias("value"))


def _obs(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return observed(load(spark, sf, name))


def _pairs(spark: SparkSession, sf: str, name: str, fn: str, kernel: str, cutoff: float = CUTOFF) -> DataFrame:
    """Pairs of rows, with distances and weights to 6 decimals."""
    return pairs(M.scores(_obs(spark, sf, name)), fn, cutoff, kernel, ["time"], [], digits=6)


def _columns(spark: SparkSession, sf: str, name: str, **cols: Callable[[DataFrame], Column]) -> DataFrame:
    df = cached(load(spark, sf, name))
    return df.select("row", *[r6(f(df)).alias(c) for c, f in cols.items()])


def _row_ptr(spark: SparkSession, sf: str) -> DataFrame:
    points = load(spark, sf, "xs")
    n = neighbour_counts(_pairs(spark, sf, "xs", "haversine", "uniform", 100.0))
    w = Window.orderBy("lat", "lon", "row").rowsBetween(Window.unboundedPreceding, -1)
    counted = points.join(n, points["row"] == n["i"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.select("row", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ptr"))


def _inverse(spark: SparkSession, sf: str) -> DataFrame:
    m = inverse(matrix(M.gram(_obs(spark, sf, "xs"), 2), 2))
    rows = [(a, b, float(np.round(1e3 * m[a, b], 6))) for a in range(2) for b in range(2)]
    return spark.createDataFrame(rows, "a int, b int, value double")


def _meat(spark: SparkSession, sf: str, name: str, fn: str, kernel: str, cutoff: float = CUTOFF, balanced: bool = False, method: str | None = None) -> DataFrame:
    return _long(M.spatial_meat(_obs(spark, sf, name), 2, fn, cutoff, kernel, balanced, method))


def _total(spark: SparkSession, sf: str) -> DataFrame:
    obs = _obs(spark, sf, "bal")
    return _long(M.added([M.spatial_meat(obs, 2, "haversine", CUTOFF, "bartlett", balanced=True), serial_window(obs, 2, LAG)]))


def _accumulated(spark: SparkSession, sf: str) -> DataFrame:
    s = M.scores(_obs(spark, sf, "unb3"))
    out = M.accumulated(pairs(s, "haversine", CUTOFF, "bartlett", ["time"], ["s"]), s, 2)
    return out.select("row", *[F.round(F.col("c")[a], 7).alias(f"c{a}") for a in range(2)])


def vcov(spark: SparkSession, sf: str, name: str, panel: bool = False, **options: object) -> DataFrame:
    """V, scaled by 1e3, of y on (1, z)."""
    points = load(spark, sf, name).withColumn("one", F.lit(1.0))
    _, fitted = ols(points, "y", ["one", "z"])
    keys = {"unit": "unit", "time": "time"} if panel else {}
    spec = SpatialHacSpec(lat="lat", lon="lon", dist_cutoff=CUTOFF, **keys, **options)  # type: ignore[arg-type]
    out = spatial_hac(fitted, spec, ["one", "z"])
    return out.select("term_i", "term_j", r6(1e3 * F.col("value")).alias("value"))


def _finite(spark: SparkSession, sf: str) -> DataFrame:
    nan = F.when(F.col("row") % 50 == 0, F.lit(float("nan"))).when(F.col("row") % 70 == 0, F.lit(None)).otherwise(F.col("lat"))
    return finite_check(_obs(spark, sf, "xs").withColumn("lat", nan)).select("n", "bad_coords")


def _moving(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when((F.col("unit") % 4 == 0) & (F.col("time") == 1995), F.col("lat") + 1).otherwise(F.col("lat"))
    return moving_units(load(spark, sf, "bal").withColumn("lat", moved)).select(F.col("unit").cast("long").alias("unit"))


def _key_cast(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey")
    text = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).when(F.col("c_custkey") % 3 == 1, F.concat(F.col("c_custkey").cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("id-"), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", key(text).alias("value"))


def _cross_section(spark: SparkSession, sf: str) -> DataFrame:
    obs = canonical(load(spark, sf, "xs"), SpatialHacSpec("lat", "lon", CUTOFF), ["z"], "y")
    return obs.agg(F.count("*").alias("n"), F.count_distinct("unit").alias("n_unit"), F.count_distinct("time").alias("n_time"))


def _subset(spark: SparkSession, sf: str) -> DataFrame:
    points = load(spark, sf, "xs").withColumn("one", F.lit(1.0))
    obs = canonical(points, SpatialHacSpec("lat", "lon", CUTOFF), ["one", "z"], "y", "z > 0")
    return _long(M.spatial_meat(obs, 2, "haversine", CUTOFF, "uniform"))


def _timedist(spark: SparkSession, sf: str) -> DataFrame:
    return _long(serial_join(_obs(spark, sf, "xs").withColumn("time", F.col("row").cast("double")), 2, 3.0, by_unit=False))


def _band(spark: SparkSession, sf: str, fn: str) -> DataFrame:
    found = row_counts(_obs(spark, sf, "xs"), fn, 200.0, "uniform", ["time"])
    return found.groupBy("time").agg(F.sum("n").alias("n"), r6(F.sum(F.col("dist") * F.col("n")) / 1e3).alias("dist")).filter("n > 0")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "radians_cache": lambda s, d: _columns(s, d, "xs", **{c: (lambda x, c=c: F.col(c)) for c in ("lat_r", "lon_r", "cos_lat", "sin_lat")}),
        "xyz_cache": lambda s, d: _columns(s, d, "xs", **{c: (lambda x, c=c: F.col(c)) for c in ("px", "py", "pz")}),
        "safe_acos": lambda s, d: _columns(s, d, "xs", angle=lambda x: safe_acos(F.col("lon") / 10)),
        "lon_wrap": lambda s, d: _columns(s, d, "xs", gap=lambda x: lon_wrapped(F.radians(9 * F.col("lon")), F.lit(3.0))),
        "scores": lambda s, d: M.scores(_obs(s, d, "xs")).select("row", *[r6(F.col("s")[a]).alias(f"s{a}") for a in range(2)]),
        "lon_screen": lambda s, d: _pairs(s, d, "unb3", "haversine", "uniform", 100.0).select("i", "j"),
        "neighbor_counts": lambda s, d: neighbour_counts(_pairs(s, d, "unb3", "haversine", "uniform")),
        "row_ptr": _row_ptr,
        "score_accum": _accumulated,
        "gram": lambda s, d: _long(M.gram(_obs(s, d, "xs"), 2)),
        "bread_inverse": _inverse,
        "edges_balanced": lambda s, d: unit_edges(_obs(s, d, "bal"), "haversine", 500.0, "bartlett").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("dist").alias("dist")),
        "graph_reuse": lambda s, d: reuse(_obs(s, d, "bal"), "haversine", 500.0, "bartlett", ["row"], digits=6).select("time", F.col("i_row").alias("i"), F.col("j_row").alias("j"), "w"),
        "serial_meat_window": lambda s, d: _long(serial_window(_obs(s, d, "day"), 2, 2.0)),
        "serial_meat_fraction": lambda s, d: _long(serial_window(_obs(s, d, "day"), 2, 1.5)),
        "serial_meat_join": lambda s, d: _long(serial_join(_obs(s, d, "bal"), 2, 2.0)),
        "timedist_meat": _timedist,
        "meat_balanced": lambda s, d: _meat(s, d, "bal", "haversine", "bartlett", 500.0, balanced=True),
        "meat_unbalanced": lambda s, d: _meat(s, d, "day", "chord", "uniform", method="sums"),
        "meat_tiled": lambda s, d: _meat(s, d, "unb3", "haversine", "bartlett", method="tiles"),
        "meat_total": _total,
        "vcov_cross_section": lambda s, d: vcov(s, d, "xs"),
        "vcov_panel": lambda s, d: vcov(s, d, "unb3", panel=True, dist_fn="spherical", kernel="uniform"),
        "vcov_panel_serial": lambda s, d: vcov(s, d, "bal", panel=True, lag_cutoff=LAG, balanced_pnl=True),
        "block_sizes": lambda s, d: block_sizes(load(s, d, "day")),
        "block_rank": lambda s, d: load(s, d, "unb3").select("row", F.row_number().over(Window.partitionBy("time").orderBy("lat", "lon", "row")).cast("long").alias("rank")),
        "block_end": lambda s, d: load(s, d, "unb3").select("row", F.count("*").over(Window.partitionBy("time")).alias("row_end")),
        "finite_coord_check": _finite,
        "coord_invariance_check": _moving,
        "key_cast": _key_cast,
        "cross_section_mode": _cross_section,
        "row_align": lambda s, d: align(load(s, d, "xs").filter("row % 2 = 0").select("row"), load(s, d, "xs").select("row", "lat", "lon"), "row"),
        "subset_filter": _subset,
        "within_oneway": lambda s, d: within_one(load(s, d, "bal"), ["y", "z"], "unit").select("row", r6("y").alias("y"), r6("z").alias("z")),
        "within_twoway": lambda s, d: within_two(load(s, d, "bal"), ["y", "z"], "unit", "time").select("row", r6("y").alias("y"), r6("z").alias("z")),
    }
    for fn in DISTANCE:
        out[f"dist_{fn}"] = lambda s, d, fn=fn: _pairs(s, d, "unb3", fn, "uniform").select("i", "j", "dist")
        out[f"edges_band_{fn}"] = partial(_band, fn=fn)
        for k in ("bartlett", "uniform"):
            out[f"meat_general_{fn}_{k}"] = partial(_meat, name="unb3", fn=fn, kernel=k, method="sums")
    for k in ("bartlett", "uniform"):
        out[f"kernel_{k}"] = lambda s, d, k=k: _columns(s, d, "xs", w=lambda x: weight(10 * F.col("lat"), CUTOFF, k))
        out[f"edges_{k}"] = lambda s, d, k=k: _pairs(s, d, "unb3", "haversine", k).select("time", "i", "j", "w")
    return out
