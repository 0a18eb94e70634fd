"""Score outer products: the Gram matrix and the spatial meat, in long form (a, b, value).

Positions a, b count from 0. Pairs are summed in one of two ways. Tiles: rows meet in tiles of
bounded size, a tile is two matrix products, and each task sends one k x k matrix. Sums: rows are
summed by place first; places meet in tiles, too. Those of a balanced panel have a row for each
pair of places, and expressions that Spark compiles, with a partial sum in every task; with few
regressors it takes this way, as its distances are then worked out once for all periods.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrahac.functions.geo import DEGREE_KM, RADIUS, Screen, cached
from terrahac.operators.pairs import by_period, gridded, in_roles, settled
from terrahac.runtime import ship

#: Regressors up to which sums of a balanced panel or of windows are expressions.
FEW = 4
#: Rows of a side of a tile, and rows up to which tiles need no grid.
TILE, SMALL = 2048, 32_768
#: Pairs of a block of a tile of places, few enough for a core's cache.
BLOCK = 65_536
PLACE_COLUMNS = ("lat", "lon", "cos_lat", "sin_lat")
LONG = "a int, b int, value double"


def scores(obs: DataFrame) -> DataFrame:
    """obs with s, the score vector e * x, in place of e and x."""
    return obs.withColumn("s", F.transform("x", lambda v: v * F.col("e"))).drop("e", "x")


def _long(sums: DataFrame, k: int) -> DataFrame:
    """One row of columns m_a_b into a row for each."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"m_{a}_{b}"), F.lit(0.0)).alias("value")) for a in range(k) for b in range(k)]
    return sums.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _sum_blocks(rows: DataFrame) -> DataFrame:
    """Matrices that tasks have sent, added up by place."""
    return rows.select(F.posexplode("m").alias("p", "value"), "k").groupBy("p", "k").agg(F.sum("value").alias("value")).select((F.col("p") / F.col("k")).cast("int").alias("a"), (F.col("p") % F.col("k")).cast("int").alias("b"), "value")


def _rows(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def gram(obs: DataFrame, k: int, column: str = "x") -> DataFrame:
    """The sum over rows of the outer product of an array column with itself."""
    if k <= 16:
        x = [F.col(column)[a] for a in range(k)]
        sums = obs.agg(*[F.sum(x[min(a, b)] * x[max(a, b)]).alias(f"m_{a}_{b}") for a in range(k) for b in range(k)])
        return _long(sums, k)

    ship(obs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((k, k))
        for batch in batches:
            x = _rows(batch.column(0), k)
            m += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([m.ravel().tolist()], pa.list_(pa.float64())), pa.array([k], pa.int32())], names=["m", "k"])

    return _sum_blocks(obs.select(column).mapInArrow(run, "m array<double>, k int"))


def matrices(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the numbers that tasks have sent as bytes (m), ``size`` of each.

    Where there are many tasks, their root of the number adds them up first, so the driver gets few.
    """
    parts = rows.rdd.getNumPartitions()
    if parts > 64:

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for m in batch.column(0).to_pylist():
                    total += np.frombuffer(m)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

        rows = rows.repartition(math.isqrt(parts)).mapInArrow(add, "m binary")
    total = np.zeros(size)
    for r in rows.collect():
        total += np.frombuffer(r.m)
    return total


@dataclass
class Summary:
    """What one pass over the observations finds: both Gram matrices, and what the checks need."""

    products: np.ndarray
    own: np.ndarray
    n: int
    bad_coords: int
    bad_rows: int
    far_lat: int
    panel: bool
    most: int | None


def summary(obs: DataFrame, k: int) -> Summary:
    """Sums of x x' and of s s', s being e * x, counts for the checks, and the most rows of a time if there are few rows."""
    ship(obs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, counts = np.zeros((2, k, k)), np.zeros(4, dtype=np.int64)
        low, high, times, many = np.inf, -np.inf, [], False
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            x, e, lat, lon, time_ = _rows(column, k), *(batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2, 3, 4))
            bad = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            if column.flatten().null_count:
                bad = bad | column.flatten().is_null().to_numpy(zero_copy_only=False).reshape(-1, k).any(axis=1)
            counts += [len(e), np.count_nonzero(~(np.isfinite(lat) & np.isfinite(lon))), np.count_nonzero(bad), np.count_nonzero(np.abs(lat) > 90)]
            t = time_[~np.isnan(time_)]
            if len(t):
                low, high = min(low, t.min()), max(high, t.max())
            many = many or counts[0] > SMALL
            times = [] if many else [*times, t]
            m[0] += x.T @ x
            x = x * e[:, None]
            m[1] += x.T @ x
        t, n = np.unique(np.concatenate(times), return_counts=True) if times else (np.zeros(0), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (np.concatenate([m.ravel(), counts, [float(many)]]).tobytes(), np.array([low, high]).tobytes(), t.tobytes(), n.astype(np.float64).tobytes())], names=["m", "ends", "times", "n"])

    rows = obs.select("x", "e", "lat", "lon", "time").mapInArrow(run, "m binary, ends binary, times binary, n binary")
    size = 2 * k * k + 5
    if obs.rdd.getNumPartitions() <= 64:
        sent = rows.collect()
        total = np.sum([np.frombuffer(r.m) for r in sent], axis=0) if sent else np.zeros(size)
        ends = np.array([np.frombuffer(r.ends) for r in sent]) if sent else np.array([[np.inf, -np.inf]])
        low, high = ends[:, 0].min(), ends[:, 1].max()
        most = None
        if total[2 * k * k] <= SMALL:
            by: Counter = Counter()
            for r in sent:
                by.update(dict(zip(np.frombuffer(r.times).tolist(), np.frombuffer(r.n).tolist())))
            most = int(max(by.values(), default=0))
    else:
        total = matrices(rows.select("m"), size)
        span = obs.agg(F.min("time").alias("low"), F.max("time").alias("high")).first()
        low, high, most = (np.inf, -np.inf, None) if span.low is None else (span.low, span.high, None)
    m, counts = total[: 2 * k * k].reshape(2, k, k), total[2 * k * k :].astype(np.int64)
    return Summary(m[0], m[1], int(counts[0]), int(counts[1]), int(counts[2]), int(counts[3]), bool(low < high), most)


def place_sums(s: DataFrame, k: int, row: str = "row") -> DataFrame:
    """One row for each time, place and kind: n rows, s, the sum of their scores, and own, that of the scores' products.

    A kind is which scores are null: rows of several kinds don't add up, as the null ones have no
    product. own has products of rows of the same name, which are no pair.
    """
    at = ["time", "lat", "lon", "kind"]
    of = s.dropna(subset=at[:3]).withColumn("kind", F.transform("s", F.isnull))
    # Rows seldom share a name, so they are dealt before they are summed.
    single = of.repartition(row).groupBy(*at, row).agg(*[F.sum(F.col("s")[a]).alias(f"s{a}") for a in range(k)])
    own = [F.sum(F.col(f"s{a}") * F.col(f"s{b}")).alias(f"o{a}_{b}") for a in range(k) for b in range(a, k)]
    return single.groupBy(*at).agg(F.count("*").alias("n"), *[F.sum(f"s{a}").alias(f"s{a}") for a in range(k)], *own)


def cross(found: DataFrame, k: int) -> DataFrame:
    """Both outer products of the pairs of rows of places that are near each other (place_sums() as i_*, j_*), by weight."""

    def cell(a: int, b: int) -> Column:
        both = F.col(f"i_s{a}") * F.col(f"j_s{b}") + F.col(f"i_s{b}") * F.col(f"j_s{a}")
        own = F.when(F.col("i_kind") == F.col("j_kind"), F.col(f"i_o{min(a, b)}_{max(a, b)}")).otherwise(F.lit(0.0))
        return F.sum(F.col("w") * F.when(F.col("same"), both / 2 - own).otherwise(both)).alias(f"m_{a}_{b}")

    found = found.filter(~F.col("same") | (F.col("i_kind") != F.col("j_kind")) | (F.col("i_n") > 1))
    return _long(found.agg(*[cell(a, b) for a in range(k) for b in range(k)]), k)


def accumulated(weighted: DataFrame, s: DataFrame, k: int) -> DataFrame:
    """(row, c): half of each row's own score plus its neighbours' by weight; rows without neighbours stay."""
    sums = weighted.groupBy("i").agg(*[F.sum(F.col("w") * F.col("j_s")[a]).alias(f"c{a}") for a in range(k)])
    joined = s.join(sums, s["row"] == sums["i"], "left")
    return joined.select("row", "s", F.array(*[F.col("s")[a] / 2 + F.coalesce(F.col(f"c{a}"), F.lit(0.0)) for a in range(k)]).alias("c"))


def added(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.sum("value").alias("value"))


def _half_sines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """sin((b - a) / 2) squared for all pairs of angles, from products of sines and cosines of single ones."""
    d = np.outer(np.cos(a / 2), np.sin(b / 2)) - np.outer(np.sin(a / 2), np.cos(b / 2))
    return d * d


def _near(dist_fn: str, a: dict[str, np.ndarray], b: dict[str, np.ndarray], cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (flat, in an a x b matrix) of the pairs within the cutoff, and their distances.

    A bound on the sine or cosine of the angle comes first, so that only pairs within it, up to
    rounding, need an inverse function.
    """
    la, lb, oa, ob = np.radians(a["lat"]), np.radians(b["lat"]), np.radians(a["lon"]), np.radians(b["lon"])
    if dist_fn == "haversine":
        h = _half_sines(la, lb) + np.outer(np.cos(la), np.cos(lb)) * _half_sines(oa, ob)
        most = np.sin(min(cutoff / RADIUS, np.pi) / 2) ** 2
        at = np.flatnonzero(h <= most * (1 + 1e-9) + 1e-15)
        h = np.clip(h.ravel()[at], 0, 1)
        d = 2 * RADIUS * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
    elif dist_fn == "spherical":
        c = np.outer(np.sin(la), np.sin(lb)) + np.outer(np.cos(la), np.cos(lb)) * (np.outer(np.cos(oa), np.cos(ob)) + np.outer(np.sin(oa), np.sin(ob)))
        at = np.flatnonzero(c >= np.cos(min(cutoff / RADIUS, np.pi)) - 1e-9)
        d = RADIUS * np.arccos(np.clip(c.ravel()[at], -1, 1))
    elif dist_fn == "chord":
        p, q = ([np.cos(x) * np.cos(y), np.cos(x) * np.sin(y), np.sin(x)] for x, y in ((la, oa), (lb, ob)))
        d = RADIUS * np.sqrt(sum((u[:, None] - v[None, :]) ** 2 for u, v in zip(p, q))).ravel()
        at = np.arange(len(d))
    else:
        south = np.where(a["lat"][:, None] <= b["lat"][None, :], np.cos(la)[:, None], np.cos(lb)[None, :])
        d = np.sqrt((DEGREE_KM * (b["lat"][None, :] - a["lat"][:, None])) ** 2 + (DEGREE_KM * south * (b["lon"][None, :] - a["lon"][:, None])) ** 2).ravel()
        at = np.arange(len(d))
    near = d <= cutoff
    return at[near], d[near]


def _tile(first: dict[str, np.ndarray], second: dict[str, np.ndarray], dist_fn: str, cutoff: float, kernel: str, ordered: bool = True) -> np.ndarray:
    """Weighted sums of second's scores for each of first, over pairs in their order, or over all."""
    n, m = len(first["row"]), len(second["row"])
    at, d = _near(dist_fn, first, second, cutoff)
    i, j = at // m, at % m
    x, y = first["lat"][i], second["lat"][j]
    ok = np.ones(len(at), dtype=bool)
    if ordered:
        u, v = first["lon"][i], second["lon"][j]
        ok = (x < y) | ((x == y) & ((u < v) | ((u == v) & (first["row"][i] < second["row"][j]))))
    w = np.zeros(n * m)
    w[at[ok]] = 1 - d[ok] / cutoff if kernel == "bartlett" and cutoff > 0 else 1.0
    return w.reshape(n, m) @ second["s"]


def _defined(dist_fn: str, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Distances of pairs of places, a[i] and b[i], by the definitions in geo."""
    la, lb, oa, ob = np.radians(a["lat"]), np.radians(b["lat"]), np.radians(a["lon"]), np.radians(b["lon"])
    if dist_fn == "haversine":
        h = np.clip(np.sin((lb - la) / 2) ** 2 + a["cos_lat"] * b["cos_lat"] * np.sin((ob - oa) / 2) ** 2, 0, 1)
        return 2 * RADIUS * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
    if dist_fn == "spherical":
        return RADIUS * np.arccos(np.clip(a["sin_lat"] * b["sin_lat"] + a["cos_lat"] * b["cos_lat"] * np.cos(oa - ob), -1, 1))
    if dist_fn == "chord":
        return np.sqrt(sum((RADIUS * u - RADIUS * v) ** 2 for u, v in zip(_spot(a, oa), _spot(b, ob))))
    south = np.where(a["lat"] <= b["lat"], a["cos_lat"], b["cos_lat"])
    return np.sqrt((DEGREE_KM * (b["lat"] - a["lat"])) ** 2 + (DEGREE_KM * south * (b["lon"] - a["lon"])) ** 2)


def _spot(a: dict[str, np.ndarray], lon: np.ndarray) -> list[np.ndarray]:
    """Places on the unit sphere; lon in radians."""
    return [a["cos_lat"] * np.cos(lon), a["cos_lat"] * np.sin(lon), a["sin_lat"]]


def _some(a: dict[str, np.ndarray], at: object) -> dict[str, np.ndarray]:
    """What distances need of some places."""
    return {c: a[c][at] for c in PLACE_COLUMNS}


def _kernel(d: np.ndarray, cutoff: float, kernel: str) -> np.ndarray:
    return np.where(d <= cutoff, 1 - d / cutoff if kernel == "bartlett" and cutoff > 0 else 1.0, 0.0)


def _weights(a: dict[str, np.ndarray], b: dict[str, np.ndarray], dist_fn: str, cutoff: float, kernel: str) -> Iterator[tuple[int, np.ndarray]]:
    """Weights of all pairs of places of a and b, by blocks of a's: (the first of the block, a matrix that is used again).

    On the sphere they come from q, the squared half chord, which is one matrix product around the
    middle of b. Where its rounding could matter, at the cutoff and at short distances, the definition decides.
    """
    n, m = len(a["lat"]), len(b["lat"])
    step = max(1, BLOCK // m)
    if dist_fn == "flatearth":
        for lo in range(0, n, step):
            yield lo, _kernel(_defined(dist_fn, _some(a, np.s_[lo : lo + step, None]), _some(b, np.s_[None, :])), cutoff, kernel)
        return
    u, v = (np.stack(_spot(p, np.radians(p["lon"])), axis=1) for p in (a, b))
    middle = v.mean(axis=0)
    u, v = u - middle, v - middle
    left = np.concatenate([u / -2, (u * u).sum(axis=1, keepdims=True) / 4, np.ones((n, 1))], axis=1)
    right = np.concatenate([v, np.ones((m, 1)), (v * v).sum(axis=1, keepdims=True) / 4], axis=1).T.copy()
    half = cutoff / (2 * RADIUS)
    limit = min(1.0, half) ** 2 if dist_fn == "chord" else math.sin(min(half, math.pi / 2)) ** 2
    slope = kernel == "bartlett" and cutoff > 0
    # The arc sine of a root, over that root, as a series in q; short enough for the largest q within the cutoff.
    series = [1.0]
    while not slope or dist_fn != "chord" and series[-1] * limit ** (len(series) - 1) > 1e-17:
        if not slope or len(series) == 12:
            series = []
            break
        i = len(series)
        series.append(series[-1] * (2 * i - 1) ** 2 / (2 * i * (2 * i + 1)))
    near = min(limit / 256, (1e-4 / half) ** 2) if slope else limit * (1 + 1e-9) + 1e-15
    space, more = np.empty((min(step, n), m)), np.empty((min(step, n), m))
    for lo in range(0, n, step):
        size = min(step, n - lo)
        q, w = np.matmul(left[lo : lo + size], right, out=space[:size]), more[:size]
        if not slope:
            sure = limit * (1 - 1e-9) - 1e-15
            np.less_equal(q, near, out=w, casting="unsafe")
            unsure = np.flatnonzero((q > sure) & (w != 0)) if np.count_nonzero(q <= sure) != w.sum() else ()
        else:
            unsure = np.flatnonzero(q <= near)
            np.clip(q, 0, 1, out=q)
            if series:
                w[:] = series[-1]
                for c in series[-2::-1]:
                    w *= q
                    w += c
                w *= np.sqrt(q, out=q)
            else:
                np.arcsin(np.sqrt(q, out=q), out=w)
            w *= -1 / half
            w += 1
            np.maximum(w, 0, out=w)
        if len(unsure):
            i, j = unsure // m, unsure % m
            w[i, j] = _kernel(_defined(dist_fn, _some(a, lo + i), _some(b, j)), cutoff, kernel)
        yield lo, w


def _products(a: dict[str, np.ndarray], b: dict[str, np.ndarray], dist_fn: str, cutoff: float, kernel: str) -> np.ndarray:
    """The sum of a's scores times b's over all pairs of places, by weight.

    A null score has no product, and neither has that place's other score in the same cell of the
    matrix. Where scores are odd (see place_cross()), only pairs within the cutoff are multiplied.
    """
    k = a["s"].shape[1]
    total = np.zeros((k, k))
    if not (len(a["lat"]) and len(b["lat"])):
        return total
    if a["odd"].any() or b["odd"].any():
        for p in range(len(a["lat"])):
            one = {c: v[p : p + 1] for c, v in a.items()}
            for _, w in _weights(one, b, dist_fn, cutoff, kernel):
                w = w.ravel()
                if one["odd"][0]:
                    w[(b["lat"] == one["lat"]) & (b["lon"] == one["lon"]) & (b["row"] == one["row"])] = 0
                j = np.flatnonzero(w)
                null = one["null"] | b["null"][j]
                c = w[j, None, None] * one["s"][0][None, :, None] * b["s"][j][:, None, :]
                total += np.where(null[:, :, None] | null[:, None, :], 0.0, c).sum(axis=0)
        return total
    if not (a["null"].any() or b["null"].any()):
        for lo, w in _weights(a, b, dist_fn, cutoff, kernel):
            total += a["s"][lo : lo + len(w)].T @ (w @ b["s"])
        return total
    x = (a["s"][:, :, None] * ~a["null"][:, None, :]).reshape(-1, k * k)
    y = (b["s"][:, None, :] * ~b["null"][:, :, None]).reshape(-1, k * k)
    for lo, w in _weights(a, b, dist_fn, cutoff, kernel):
        total += np.einsum("pc,pc->c", x[lo : lo + len(w)], w @ y).reshape(k, k)
    return total


def place_cross(places: DataFrame, k: int, dist_fn: str, cutoff: float, kernel: str) -> DataFrame:
    """cross() over the places (place_sums()) of each period that are near each other, without a row for each pair.

    Places meet by the keys of the grid, in tiles. Within a band, and without a grid, two places meet
    in both orders, each for one half, and a place meets itself; own products are taken off there.
    Odd sums are those whose squares are not finite; such a place does not meet itself.
    """
    ship(places.sparkSession)
    screen = Screen(dist_fn, cutoff)
    sums, own = [F.col(f"s{a}") for a in range(k)], [(a, b) for a in range(k) for b in range(a, k)]
    products = [F.col(f"o{a}_{b}") for a, b in own]
    wild = F.lit(False)
    for c, most in [*((c, 1e150) for c in sums), *((c, 1e300) for c in products)]:
        wild = wild | F.coalesce(F.isnan(c) | (F.abs(c) > most), F.lit(False))
    bits = F.aggregate("kind", F.lit(0).cast("long"), lambda x, null: x * 2 + null.cast("long"))
    points = cached(places.filter("abs(lat) < double('inf') and abs(lon) < double('inf')")).select("time", *PLACE_COLUMNS, bits.alias("row"), F.array(*sums).alias("s"), F.array(*products).alias("o"), wild.alias("odd"), (F.col("n") > 1).alias("shared"))
    both, grid = in_roles(points, screen)
    keys = ["time", *grid]
    level = F.expr("grid = jband") if grid else F.lit(True)
    both = both.withColumn("o", F.when((F.col("role") == 1) & level, F.col("o")))
    # Places are counted by key and dealt into tiles of bounded size; each first meets each second once.
    w = Window.partitionBy(*keys)
    n = {f"n{r}": F.ceil(F.sum(F.when(F.col("role") == r, 1).otherwise(0)).over(w) / TILE).cast("int") for r in (0, 1)}
    first_role = F.col("role") == 0
    dealt = both.withColumns(n).filter("n0 > 0 and n1 > 0")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("row", "lat", "lon"), F.when(first_role, F.col("n0")).otherwise(F.col("n1"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(first_role, F.col("n1")).otherwise(F.col("n0")) - 1)))
    t0, t1 = F.when(first_role, F.col("own")).otherwise(F.col("other")).alias("t0"), F.when(first_role, F.col("other")).otherwise(F.col("own")).alias("t1")
    once = F.when(F.col("other") == 0, F.col("o")).alias("o")
    dealt = dealt.select(F.xxhash64(*keys, t0, t1).alias("spread"), level.alias("level"), *keys, t0, t1, "role", "row", *PLACE_COLUMNS, "s", once, "odd", "shared")
    marks = [*keys, "t0", "t1"]
    # A number of partitions that is kept: the work is by pairs, and few bytes may hold many.
    spark = places.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    dealt = dealt.repartition(parts, "spread").sortWithinPartitions("spread", *marks, "role")
    plain = ["row", *PLACE_COLUMNS, "odd"]

    def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
        flat = column.flatten()
        null = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width)
        return np.where(null, 0.0, flat.to_numpy(zero_copy_only=False).reshape(-1, width)), null

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((k, k))
        now: tuple | None = None
        held: list[dict[str, np.ndarray]] = []

        def spend() -> None:
            rows = {c: np.concatenate([p[c] for p in held]) for c in held[0]}
            sides = [{c: v[rows["role"] == r] for c, v in rows.items()} for r in (0, 1)]
            c = _products(*sides, dist_fn, cutoff, kernel) * (0.5 if rows["level"][0] else 1.0)
            np.add(m, c + c.T, out=m)

        def take_off(batch: pa.RecordBatch) -> None:
            batch = batch.filter(batch.column("o").is_valid())
            if not batch.num_rows:
                return
            o, null = matrix(batch.column("o"), len(own))
            s = matrix(batch.column("s"), k)[0]
            at = {c: batch.column(c).to_numpy() for c in PLACE_COLUMNS}
            odd, shared = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("odd", "shared"))
            w = _kernel(_defined(dist_fn, at, at), cutoff, kernel)
            for i, (a, b) in enumerate(own):
                less = np.where(odd, np.where(shared & ~null[:, i], o[:, i] - s[:, a] * s[:, b], 0.0), o[:, i])
                less = (w * less)[w > 0].sum()
                m[a, b] -= less
                if a != b:
                    m[b, a] -= less

        for batch in batches:
            if not batch.num_rows:
                continue
            take_off(batch)
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*marks, "level", "role", *plain]}
            col["s"], col["null"] = matrix(batch.column("s"), k)
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in marks:
                change[1:] |= col[c][1:] != col[c][:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                key = tuple(col[c][lo] for c in marks)
                if key != now:
                    if held:
                        spend()
                    now, held = key, []
                held.append({c: col[c][lo:hi] for c in ("level", "role", *plain, "s", "null")})
        if held:
            spend()
        yield pa.RecordBatch.from_arrays([pa.array([m.ravel().tolist()], pa.list_(pa.float64())), pa.array([k], pa.int32())], names=["m", "k"])

    return _sum_blocks(dealt.drop("spread").mapInArrow(run, "m array<double>, k int"))


def few_tiles(s: DataFrame, k: int, dist_fn: str, cutoff: float, kernel: str, most: int) -> DataFrame:
    """Sums over all pairs of s (row, time, lat, lon, s) as bytes (m, a k x k matrix a task), without a grid.

    most: the most rows of a time. Each time's rows are dealt into tiles of TILE, and every two tiles meet once.
    """
    ship(s.sparkSession)
    tiles = max(1, -(-most // TILE))
    own = F.pmod(F.xxhash64("row"), F.lit(tiles)).alias("own")
    dealt = s.filter("time is not null").select("time", "row", "lat", "lon", "s", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    dealt = dealt.select("time", F.least("own", "other").alias("t0"), F.greatest("own", "other").alias("t1"), (F.col("own") > F.col("other")).alias("right"), "row", "lat", "lon", "s")
    marks = ["time", "t0", "t1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((k, k))
        now, parts = None, []

        def spend() -> None:
            rows = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
            same = now[1] == now[2]
            left = rows if same else {c: v[~rows["right"]] for c, v in rows.items()}
            right = rows if same else {c: v[rows["right"]] for c, v in rows.items()}
            if len(left["row"]) and len(right["row"]):
                c = left["s"].T @ _tile(left, right, dist_fn, cutoff, kernel, ordered=same)
                np.add(m, c + c.T, out=m)

        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: _rows(batch.column(c), k) if c == "s" else batch.column(c).to_numpy(zero_copy_only=False) for c in [*marks, "right", "row", "lat", "lon", "s"]}
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in marks:
                change[1:] |= col[c][1:] != col[c][:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                key = tuple(col[c][lo] for c in marks)
                if key != now:
                    if parts:
                        spend()
                    now, parts = key, []
                parts.append({c: col[c][lo:hi] for c in ("right", "row", "lat", "lon", "s")})
        if parts:
            spend()
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["m"])

    return dealt.repartition(*marks).sortWithinPartitions(*marks).mapInArrow(run, "m binary")


def tiled_cross(s: DataFrame, k: int, dist_fn: str, cutoff: float, kernel: str) -> DataFrame:
    """cross() over the pairs of s (row, time, lat, lon, s) without a row for each pair."""
    ship(s.sparkSession)
    screen = Screen(dist_fn, cutoff)
    first, second, grid = gridded(s.filter("time is not null"), screen)
    keys = ["time", *grid]
    both = first.withColumn("role", F.lit(0)).unionByName(second.withColumn("role", F.lit(1)))
    # Rows are counted by key and dealt into tiles of bounded size; each first meets each second once.
    n = both.groupBy(*keys).agg(*[F.ceil(F.sum(F.when(F.col("role") == r, 1).otherwise(0)) / TILE).cast("int").alias(f"n{r}") for r in (0, 1)]).filter("n0 > 0 and n1 > 0")
    dealt = both.join(n, keys)
    own = F.when(F.col("role") == 0, F.pmod(F.xxhash64("row"), F.col("n0"))).otherwise(F.pmod(F.xxhash64("row"), F.col("n1"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("n1")).otherwise(F.col("n0")) - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    first_tile = F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")).alias("t0")
    second_tile = F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own")).alias("t1")
    dealt = dealt.select(F.xxhash64(*keys, first_tile, second_tile).alias("spread"), *keys, first_tile, second_tile, "role", "row", "lat", "lon", "s")
    order = ["spread", *keys, "t0", "t1", "role"]
    dealt = dealt.repartition("spread").sortWithinPartitions(*order)
    marks = [*keys, "t0", "t1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((k, k))
        now: tuple | None = None
        parts: list[dict[str, np.ndarray]] = []

        def spend() -> None:
            sides = []
            for r in (0, 1):
                own = [{c: v[p["role"] == r] for c, v in p.items()} for p in parts]
                sides.append({c: np.concatenate([p[c] for p in own]) for c in ("row", "lat", "lon", "s")})
            if len(sides[0]["row"]) and len(sides[1]["row"]):
                c = sides[0]["s"].T @ _tile(*sides, dist_fn, cutoff, kernel)
                np.add(m, c + c.T, out=m)

        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: _rows(batch.column(c), k) if c == "s" else batch.column(c).to_numpy(zero_copy_only=False) for c in ["role", "row", "lat", "lon", "s", *marks]}
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in marks:
                change[1:] |= col[c][1:] != col[c][:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                key = tuple(col[c][lo] for c in marks)
                if key != now:
                    if parts:
                        spend()
                    now, parts = key, []
                parts.append({c: col[c][lo:hi] for c in ("role", "row", "lat", "lon", "s")})
        if parts:
            spend()
        yield pa.RecordBatch.from_arrays([pa.array([m.ravel().tolist()], pa.list_(pa.float64())), pa.array([k], pa.int32())], names=["m", "k"])

    return _sum_blocks(dealt.drop("spread").mapInArrow(run, "m array<double>, k int"))


def spatial_meat(obs: DataFrame, k: int, dist_fn: str, cutoff: float, kernel: str, balanced: bool = False, method: str | None = None) -> DataFrame:
    """Own products plus both products of all pairs of a period, by weight: (a, b, value).

    method: 'sums' or 'tiles'; None chooses.
    """
    own = gram(scores(obs), k, "s")
    return own if cutoff < 0 else added([own, cross_meat(obs, k, dist_fn, cutoff, kernel, balanced, method)])


def cross_meat(obs: DataFrame, k: int, dist_fn: str, cutoff: float, kernel: str, balanced: bool = False, method: str | None = None) -> DataFrame:
    """The part of the spatial meat that comes from pairs."""
    s = scores(obs)
    if (method or ("sums" if balanced and k <= FEW else "tiles")) == "tiles":
        return tiled_cross(s, k, dist_fn, cutoff, kernel)
    if balanced:
        kept = ["n", *[f"s{a}" for a in range(k)], *[f"o{a}_{b}" for a in range(k) for b in range(a, k)]]
        return cross(by_period(place_sums(settled(s), k, "unit"), ["kind"], dist_fn, cutoff, kernel, kept), k)
    return place_cross(place_sums(s, k), k, dist_fn, cutoff, kernel)
