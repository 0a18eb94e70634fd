"""Pairs of points within a cutoff: a range self-join made of equi-joins.

The globe is cut into bands of latitude as high as the cutoff's angle, and each pair of
neighbouring bands into cells of longitude wide enough that a point and its neighbours lie in
adjacent cells. A point meets only the points of up to two bands and three cells, whatever
the number of points; the exact distance is a residual condition of that join. Each pair
comes once, its southern point (then western, then smaller row) first.

Rows that share a place are gathered first: two places are compared once, and what is wanted of
their rows (all pairs, their number, sums of products) is worked out from that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrahac.functions.geo import DISTANCE, Screen, cached, weight

#: Rows of a place that are gathered in one part at most.
PLACE = 256


def gridded(points: DataFrame, screen: Screen) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points as a pair's first and as its second, with the grid keys they meet on."""
    if not screen.banded:
        return points, points, []
    keys = ["grid", "jband", "cell"]
    band = screen.band(F.col("lat"))
    first = points.withColumn("grid", band).withColumn("jband", F.explode(F.array(F.col("grid"), F.col("grid") + 1)))
    second = points.withColumn("jband", band).withColumn("grid", F.explode(F.array(F.col("jband"), F.col("jband") - 1)))
    first = first.withColumn("__width", screen.cells(F.col("grid")))
    first = first.withColumn("cell", F.explode(screen.around(screen.cell(F.col("lon"), F.col("__width")), F.col("__width"))))
    second = second.withColumn("__width", screen.cells(F.col("grid")))
    second = second.withColumn("cell", screen.cell(F.col("lon"), F.col("__width")))
    return first.drop("__width"), second.drop("__width"), keys


def in_roles(points: DataFrame, screen: Screen) -> tuple[DataFrame, list[str]]:
    """gridded() as one table, with the role of a pair's first (0) and second (1), from one reading of the points."""
    if not screen.banded:
        return points.withColumn("role", F.explode(F.array(F.lit(0), F.lit(1)))), []
    band = screen.band(F.col("lat"))
    bands = [F.struct(F.lit(r).alias("role"), (band - (d if r else 0)).alias("grid"), (band + (0 if r else d)).alias("jband")) for r in (0, 1) for d in (0, 1)]
    out = points.withColumn("__band", F.explode(F.array(*bands))).select(*points.columns, "__band.*").withColumn("__width", screen.cells(F.col("grid")))
    cell = screen.cell(F.col("lon"), F.col("__width"))
    cells = F.when(F.col("role") == 0, screen.around(cell, F.col("__width"))).otherwise(F.array(cell))
    return out.withColumn("cell", F.explode(cells)).drop("__width"), ["grid", "jband", "cell"]


def near(places: DataFrame, dist_fn: str, cutoff: float, kernel: str, by: list[str], carry: list[str], digits: int | None = None) -> DataFrame:
    """Places within the cutoff of each other, and each with itself: (by, dist, w, same and the carried columns as i_*, j_*).

    places: lat, lon and the columns of by and carry. Of several rows at one place every one meets
    every one, in both orders and itself; ``same`` marks these. dist and w are rounded to digits, if given.
    """
    screen = Screen(dist_fn, cutoff)
    first, second, keys = gridded(cached(places), screen)
    on = [*by, *keys]
    if on:  # a number of partitions that is kept: the work is by pairs, and few bytes may hold many
        n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        first, second = first.repartition(n, *on), second.repartition(n, *on)
    i, j = first.alias("i"), second.alias("j")
    cond = F.lit(True)
    for k in on:
        cond = cond & (F.col(f"i.{k}") == F.col(f"j.{k}"))
    order = (F.col("i.lat") < F.col("j.lat")) | ((F.col("i.lat") == F.col("j.lat")) & (F.col("i.lon") <= F.col("j.lon")))
    # Conditions are checked in this order, so the costly ones are last; a filter on the result would come first.
    cond = cond & order & screen.space("i", "j") & (F.col("j.lat") - F.col("i.lat") <= screen.height + 1e-12) & screen.longitude("i", "j")
    d = DISTANCE[dist_fn]("i", "j")
    same = (F.col("i.lat") == F.col("j.lat")) & (F.col("i.lon") == F.col("j.lon"))
    kept = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ij" for c in carry]
    out = i.join(j, cond & (weight(d, cutoff, kernel) != 0)).select(*[F.col(f"i.{b}").alias(b) for b in by], d.alias("dist"), same.alias("same"), *kept)
    out = out.withColumn("w", weight(F.col("dist"), cutoff, kernel))
    return out if digits is None else out.withColumns({c: F.round(c, digits) for c in ("dist", "w")})


def gathered(points: DataFrame, by: list[str], carry: list[str], row: str = "row") -> DataFrame:
    """One row for each place in ``by``: (by, lat, lon, part, members), members being structs of __row and the carried columns.

    A place of more than PLACE rows has several parts. Rows that no pair can have are left out.
    """
    at = [*by, "lat", "lon"]
    points = points.dropna(subset=at)  # NaN as well, in numbers
    crowded = points.groupBy(*at).agg(F.count("*").alias("__n")).filter(F.col("__n") > PLACE)
    part = F.coalesce(F.pmod(F.xxhash64(row), F.ceil(F.col("__n") / PLACE)), F.lit(0)).alias("part")
    member = F.struct(F.col(row).alias("__row"), *carry).alias("member")
    return points.join(crowded, at, "left").select(*at, part, member).groupBy(*at, "part").agg(F.collect_list("member").alias("members"))


def _spread(found: DataFrame, by: list[str], carry: list[str]) -> DataFrame:
    """A row for each pair of members of places that are near each other."""
    out = found.select(*by, "dist", "w", "same", F.explode("i_members").alias("i"), "j_members")
    out = out.select(*by, "dist", "w", "same", "i", F.explode("j_members").alias("j")).filter(~F.col("same") | (F.col("i.__row") < F.col("j.__row")))
    kept = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ij" for c in carry]
    return out.select(*by, F.col("i.__row").alias("i"), F.col("j.__row").alias("j"), "dist", *kept, "w")


def pairs(points: DataFrame, dist_fn: str, cutoff: float, kernel: str, by: list[str], carry: list[str], row: str = "row", digits: int | None = None) -> DataFrame:
    """(by, i, j, dist, w and the carried columns as i_*, j_*): pairs of rows that agree in ``by``.

    points: row, lat, lon and the columns of by and carry. Two places are compared once, however
    many rows they have.
    """
    return _spread(near(gathered(points, by, carry, row), dist_fn, cutoff, kernel, by, ["members"], digits), by, carry)


def row_counts(points: DataFrame, dist_fn: str, cutoff: float, kernel: str, by: list[str], row: str = "row") -> DataFrame:
    """(by, dist, w, n): pairs of rows as pairs() has them, as numbers, 0 too, for each pair of places."""
    at = [*by, "lat", "lon"]
    single = points.dropna(subset=at).groupBy(*at, row).agg(F.count("*").alias("n"))
    places = single.groupBy(*at).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    n = F.when(F.col("same"), F.shiftright(F.col("i_n") * F.col("i_n") - F.col("i_own"), 1)).otherwise(F.col("i_n") * F.col("j_n"))
    return near(places, dist_fn, cutoff, kernel, by, ["n", "own"]).select(*by, "dist", "w", n.alias("n"))


def unit_edges(obs: DataFrame, dist_fn: str, cutoff: float, kernel: str) -> DataFrame:
    """The neighbour graph of a balanced panel, by unit: (i, j, dist, w)."""
    places = obs.groupBy("unit").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return pairs(places, dist_fn, cutoff, kernel, [], [], row="unit")


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """(i, n): the neighbours of each first point."""
    return edges.groupBy("i").agg(F.count("*").alias("n"))


def by_period(places: DataFrame, key: list[str], dist_fn: str, cutoff: float, kernel: str, carry: list[str], digits: int | None = None) -> DataFrame:
    """near() within each period, of places that have rows for several: distances are worked out once for all periods.

    places: time, lat, lon and the columns of key, which tells rows of a time and place apart, and of carry.
    """
    held = F.map_from_entries(F.collect_list(F.struct("time", F.struct(*carry)))).alias("periods")
    found = near(places.groupBy("lat", "lon", *key).agg(held), dist_fn, cutoff, kernel, [], ["periods", *key], digits)
    keys = [f"{s}_{c}" for s in "ij" for c in key]
    out = found.select("dist", "w", "same", *keys, F.explode("i_periods").alias("time", "i"), "j_periods")
    out = out.withColumn("j", F.col("j_periods")[F.col("time")]).filter("j is not null")
    return out.select("time", "dist", "w", "same", *keys, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ij" for c in carry])


def settled(obs: DataFrame) -> DataFrame:
    """The rows of a balanced panel that have a time, each at its unit's one place."""
    w = Window.partitionBy("unit")
    return obs.withColumns({c: F.min(c).over(w) for c in ("lat", "lon")}).filter("time is not null and unit is not null")


def reuse(obs: DataFrame, dist_fn: str, cutoff: float, kernel: str, carry: list[str], digits: int | None = None) -> DataFrame:
    """The edges of units (see unit_edges) in each period that has both: (time, i, j, dist, w, i_*, j_*).

    A unit's rows travel with its place, so edges need no join with the rows, and are not shuffled.
    """
    places = gathered(settled(obs), ["time"], carry, row="unit")
    return _spread(by_period(places, ["part"], dist_fn, cutoff, kernel, ["members"], digits), ["time"], carry)
