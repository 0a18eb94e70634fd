"""Rows that share a place: every pair of theirs counts, and places are compared once."""

import math
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from terrahac.functions.geo import Screen
from terrahac.operators import meat as M
from terrahac.operators import pairs as P
from terrahac.operators.vcov import matrix

SPOTS = [(40.0, 10.0), (40.0, 10.5), (40.9, 10.0), (41.0, 12.0), (55.0, -20.0)]


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def crowd(spark, n=60):
    """Rows over five places and two times, one row without a place and one name that occurs twice."""
    rng = np.random.default_rng(4)
    rows = [(i, float(i), float(i % 2), *SPOTS[i * i % 5], rng.normal(), [1.0, rng.normal()]) for i in range(n)]
    rows += [(n, float(n), 0.0, None, 10.0, 1.0, [1.0, 1.0]), rows[3]]
    return rows, spark.createDataFrame(rows, "row long, unit double, time double, lat double, lon double, e double, x array<double>")


def brute(rows, cutoff):
    """(time, i, j) of pairs of rows with places, by distance; the southern, western, smaller row first."""
    rows = [r for r in rows if r[3] is not None]
    key = lambda r: (r[3], r[4], r[0])
    return Counter((a[2], a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and key(a) < key(b) and km(a[3:5], b[3:5]) <= cutoff)


@pytest.mark.parametrize("fn", ["haversine", "spherical"])
def test_pairs_of_crowded_places(spark, monkeypatch, fn):
    monkeypatch.setattr(P, "PLACE", 4)
    rows, obs = crowd(spark)
    got = P.pairs(obs, fn, 150.0, "bartlett", ["time"], ["x"], digits=6).collect()
    assert Counter((r.time, r.i, r.j) for r in got) == brute(rows, 150.0)
    assert all(r.i_x == rows[r.i][6] and r.j_x == rows[r.j][6] for r in got)
    assert all(abs(r.dist - km(rows[r.i][3:5], rows[r.j][3:5])) < 1e-3 and r.w == round(r.w, 6) for r in got)


def test_places_are_compared_once(spark):
    """The join's rows follow the places, not the rows that share them."""
    many = spark.range(3000).selectExpr("id as row", "1.0D as time", "40.0D + (id % 3) * 0.1D as lat", "10.0D as lon", "1.0D as e", "array(1.0D, 2.0D) as x")
    assert P.near(P.gathered(many, ["time"], []), "spherical", 100.0, "uniform", ["time"], ["members"]).count() <= 6 * (3000 // P.PLACE + 1) ** 2
    counted = P.row_counts(many, "spherical", 100.0, "uniform", ["time"]).collect()
    assert len(counted) == 6 and sum(r.n for r in counted) == 3000 * 2999 // 2
    assert P.near(M.place_sums(M.scores(many), 2), "spherical", 100.0, "uniform", ["time"], []).count() == 6


def test_graph_reuse_shuffles_no_edges(spark, monkeypatch):
    monkeypatch.setattr(P, "PLACE", 2)
    rows = [(u * 100 + t, float(u), float(t) if t else None, *SPOTS[u % 5]) for u in range(12) for t in range(4) if (u, t) != (5, 2)]
    obs = spark.createDataFrame(rows, "row long, unit double, time double, lat double, lon double")
    found = P.reuse(obs, "haversine", 150.0, "bartlett", ["row"], digits=6)
    got = Counter((r.time, r.i_row, r.j_row) for r in found.collect())
    want = brute([(r[1], r[1], r[2], *r[3:]) for r in rows if r[2] is not None], 150.0)
    assert got == Counter({(t, int(i * 100 + t), int(j * 100 + t)): n for (t, i, j), n in want.items()}) and got
    above = found._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert "Exchange" not in above


def test_band_counts(spark):
    rows, obs = crowd(spark)
    got = Counter()
    for r in P.row_counts(obs, "haversine", 150.0, "uniform", ["time"]).collect():
        got[r.time] += r.n
    want = Counter()
    for (time, _, _), n in brute(rows, 150.0).items():
        want[time] += n
    assert got == want


@pytest.mark.parametrize("kernel", ["bartlett", "uniform"])
def test_meat_of_crowded_places(spark, kernel):
    rows, obs = crowd(spark)
    rows[7] = (*rows[7][:6], [1.0, None])  # a null score takes part in no product
    obs = spark.createDataFrame(rows, obs.schema)
    of = {r[0]: [None if v is None else v * r[5] for v in r[6]] for r in rows}
    place = {r[0]: r[3:5] for r in rows}
    want = np.zeros((2, 2))
    for (_, i, j), n in brute(rows, 150.0).items():
        w = n * (1 - km(place[i], place[j]) / 150.0 if kernel == "bartlett" else 1.0)
        for a in range(2):
            for b in range(2):
                v = (of[i][a], of[j][b], of[i][b], of[j][a])
                want[a, b] += 0 if None in v else w * (v[0] * v[1] + v[2] * v[3])
    for fn in ("haversine", "spherical"):
        got = matrix(M.cross_meat(obs, 2, fn, 150.0, kernel, method="sums"), 2)
        assert np.abs(got - want).max() < (1e-9 if fn == "haversine" else 1e-4)


def test_balanced_meat_of_crowded_places(spark):
    rng = np.random.default_rng(5)
    rows = [(u * 10 + t, float(u), float(t), *SPOTS[u % 5], rng.normal(), [1.0, rng.normal()]) for u in range(12) for t in range(3)]
    obs = spark.createDataFrame(rows, "row long, unit double, time double, lat double, lon double, e double, x array<double>")
    one, other = (matrix(M.cross_meat(obs, 2, "haversine", 150.0, "bartlett", balanced=b, method="sums"), 2) for b in (True, False))
    tiles = matrix(M.cross_meat(obs, 2, "haversine", 150.0, "bartlett", method="tiles"), 2)
    assert np.abs(one - other).max() < 1e-9 and np.abs(one - tiles).max() < 1e-9


@pytest.mark.parametrize("kernel", ["bartlett", "uniform"])
def test_meat_of_places_has_no_row_for_a_pair(spark, monkeypatch, kernel):
    """Places meet in tiles of a few, whatever the metric, with and without a grid."""
    monkeypatch.setattr(M, "TILE", 3)
    rng = np.random.default_rng(6)
    rows = [(i, float(i), float(i % 2), 40 + i * 7 % 20 * 0.4, 179 + i * 3 % 20 * 0.3 - 360 * (i * 3 % 20 > 3), rng.normal(), [1.0, rng.normal()]) for i in range(90)]
    obs = spark.createDataFrame(rows, "row long, unit double, time double, lat double, lon double, e double, x array<double>")
    for fn in ("haversine", "spherical", "chord", "flatearth"):
        for cutoff in (150.0, 11_000.0):
            found = M.cross_meat(obs, 2, fn, cutoff, kernel, method="sums")
            assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
            by_row = P.pairs(M.scores(obs), fn, cutoff, kernel, ["time"], ["s"]).collect()
            assert len(by_row) > 100
            want = sum(r.w * (np.outer(r.i_s, r.j_s) + np.outer(r.j_s, r.i_s)) for r in by_row)
            assert np.abs(matrix(found, 2) - want).max() < 1e-9


def test_weights_of_places():
    rng = np.random.default_rng(7)
    lat, lon = np.append(60 + rng.random(40) * 3, [60.5, 60.5, 90.0]), np.append(10 + rng.random(40) * 6, [11.0, 11.0, 0.0])
    a = {"lat": lat, "lon": lon, "cos_lat": np.cos(np.radians(lat)), "sin_lat": np.sin(np.radians(lat))}
    whole = np.s_[:, None], np.s_[None, :]
    for fn in ("haversine", "spherical", "chord", "flatearth"):
        d = M._defined(fn, *(M._some(a, at) for at in whole))
        for cutoff in (0.0, 30.0, float(d[3, 5]), 300.0, 9000.0, 30_000.0):  # one of them is a pair's own distance
            for kernel in ("bartlett", "uniform"):
                got = np.concatenate([w.copy() for _, w in M._weights(a, a, fn, cutoff, kernel)])
                want = M._kernel(d, cutoff, kernel)
                assert np.abs(got - want).max() < 1e-10, (fn, cutoff, kernel)


def test_meat_of_places_with_odd_scores(spark):
    """Infinite scores reach the pairs they are in, and a null takes its own part only."""
    rows = [(0, 0.0, 1.0, 40.0, 10.0, 1.0, [float("inf"), 2.0]), (1, 1.0, 1.0, 40.0, 10.5, 1.0, [3.0, 4.0]), (2, 2.0, 1.0, 40.0, 10.0, 1.0, [5.0, None]), (3, 3.0, 1.0, 55.0, 10.0, 1.0, [1.0, 1.0]), (4, 4.0, 2.0, float("inf"), 10.0, 1.0, [1.0, 1.0])]
    obs = spark.createDataFrame(rows, "row long, unit double, time double, lat double, lon double, e double, x array<double>")
    got = matrix(M.cross_meat(obs, 2, "haversine", 150.0, "uniform", method="sums"), 2)
    assert got[0, 0] == float("inf") and got[0, 1] == got[1, 0] == float("inf") and got[1, 1] == 16.0
    alone = obs.filter("row in (0, 3, 4)")
    assert not matrix(M.cross_meat(alone, 2, "haversine", 150.0, "uniform", method="sums"), 2).any()


@pytest.mark.parametrize("dist_fn, cutoff", [("spherical", 300.0), ("flatearth", 900.0), ("haversine", 15_000.0)])
def test_roles_are_those_of_the_grid_from_one_reading(spark, dist_fn, cutoff):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 400), rng.uniform(-200, 200, 400)))] + [(400, 90.0, 0.0), (401, -90.0, 180.0)]
    points, screen = spark.createDataFrame(rows, "row long, lat double, lon double"), Screen(dist_fn, cutoff)
    first, second, keys = P.gridded(points, screen)
    both, same = P.in_roles(points, screen)
    assert same == keys
    want = first.withColumn("role", F.lit(0)).unionByName(second.withColumn("role", F.lit(1)))
    cols = ["role", "row", "lat", "lon", *keys]
    assert sorted(map(tuple, both.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    places = M.place_sums(points.selectExpr("row", "0D AS time", "lat", "lon", "array(1D, lat) AS s"), 2)
    plan = M.place_cross(places, 2, dist_fn, cutoff, "uniform")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan  # places are summed, and read, once
