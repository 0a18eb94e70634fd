"""Headline queries, timed: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def panel(spark: SparkSession, units: int, periods: int, k: int) -> DataFrame:
    """The published benchmark's shape: units at random places, k regressors and a residual."""
    n = spark.range(0, units * periods, 1, int(CPUS))
    unit, time_ = (F.col("id") / periods).cast("long"), (F.col("id") % periods).cast("double")
    place = lambda seed: F.pmod(F.xxhash64(unit, F.lit(seed)), F.lit(1_000_000)) / 1e6
    cols = [unit.alias("unit"), time_.alias("time"), (25 + 24 * place(1)).alias("lat"), (-124 + 57 * place(2)).alias("lon"), F.randn(3).alias("e")]
    return n.select(*cols, *[F.randn(10 + i).alias(f"x{i}") for i in range(k)])


def main() -> None:
    from terrahac.operators.vcov import spatial_hac
    from terrahac.plans.spec import SpatialHacSpec
    from terrahac.queries import queries

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def run(name: str, df) -> None:
        start = time.time()
        df().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)

    run("warm_up", lambda: queries()["vcov_cross_section"](spark, SF_DIR))
    # Units, regressors and lag of the published table.
    for units, k, lag in ((100, 20, 0), (800, 20, 0), (1500, 50, 0), (3000, 50, 0), (5000, 50, 0), (8000, 50, 0), (1500, 20, 1), (3000, 20, 1), (8000, 20, 1)):
        obs = panel(spark, units, 4, k).cache()
        obs.count()
        spec = SpatialHacSpec("lat", "lon", 500, unit="unit", time="time", lag_cutoff=lag, balanced_pnl=lag > 0)
        run(f"hac_{units}x4_k{k}" + ("_lag1" if lag else ""), lambda: spatial_hac(obs, spec, [f"x{i}" for i in range(k)]))
        obs.unpersist()
    for fn in ("haversine", "spherical", "chord", "flatearth"):
        obs = panel(spark, 8000, 1, 5).cache()
        obs.count()
        run(f"hac_8000_k5_{fn}", lambda: spatial_hac(obs, SpatialHacSpec("lat", "lon", 500, dist_fn=fn), [f"x{i}" for i in range(5)]))
        obs.unpersist()
    for name in ("vcov_cross_section", "vcov_panel", "vcov_panel_serial", "meat_balanced", "meat_tiled", "serial_meat_window", "edges_bartlett"):
        run(name, lambda: queries()[name](spark, SF_DIR))
    times.pop("warm_up")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
