"""Serial terms of a panel: rows of one unit at most a lag apart, with weights that fall to 0.

The window form needs no self-join. With weight 1 - (t_i - t_j) / (L + 1), the weighted sum
of earlier scores is two plain sums over a RANGE frame, of s and of t * s, less those of the
row's own time; times are counted from the unit's first, against cancellation. The join form
cuts time into stretches of a lag, so that rows meet only within two of them; it also serves
where all rows are one unit, which a window would put into one task. With many regressors
the sums of a window would be too many expressions: then sorted rows are added up by arrays,
a unit's time being dealt out in long stretches that overlap by a lag.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrahac.operators.meat import _long, _rows, _sum_blocks, scores
from terrahac.runtime import ship

#: Lags of time that one task reads of a unit at least.
STRETCH = 64


def serial_window(obs: DataFrame, k: int, lag: float) -> DataFrame:
    """(a, b, value) by range windows over (unit, time)."""
    s = scores(obs).filter("unit is not null and time is not null").select("unit", "time", "s")
    s = s.withColumn("t", F.col("time") - F.min("time").over(Window.partitionBy("unit"))).select("unit", "t", *[F.col("s")[a].alias(f"s{a}") for a in range(k)])
    back = f"(PARTITION BY unit ORDER BY t RANGE BETWEEN {float(lag)!r}D PRECEDING AND CURRENT ROW)"
    peer = "(PARTITION BY unit ORDER BY t RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    sums = s.select("t", *[f"s{a}" for a in range(k)], *[F.expr(f"sum({x}) OVER {back} - sum({x}) OVER {peer}").alias(n) for a in range(k) for x, n in ((f"s{a}", f"p{a}"), (f"t * s{a}", f"q{a}"))])
    c = [(1 - F.col("t") / (lag + 1)) * F.col(f"p{a}") + F.col(f"q{a}") / (lag + 1) for a in range(k)]
    x = [F.col(f"s{a}") for a in range(k)]
    return _long(sums.agg(*[F.sum(x[a] * c[b] + x[b] * c[a]).alias(f"m_{a}_{b}") for a in range(k) for b in range(k)]), k)


def serial_join(obs: DataFrame, k: int, lag: float, by_unit: bool = True) -> DataFrame:
    """The same by a join on unit (or none) and stretches of time."""
    s = scores(obs).filter("time is not null").select(*(["unit"] if by_unit else []), "time", "s")
    s = s.withColumn("stretch", F.floor(F.col("time") / lag))
    i, j = s.withColumn("stretch", F.explode(F.array(F.col("stretch"), F.col("stretch") - 1))).alias("i"), s.alias("j")
    cond = (F.col("i.stretch") == F.col("j.stretch")) & (F.col("j.time") < F.col("i.time")) & (F.col("i.time") - F.col("j.time") <= lag)
    if by_unit:
        cond = cond & (F.col("i.unit") == F.col("j.unit"))
    w = 1 - (F.col("i.time") - F.col("j.time")) / (lag + 1)
    x, y = [F.col("i.s")[a] for a in range(k)], [F.col("j.s")[a] for a in range(k)]
    both = i.join(j, cond)
    return _long(both.agg(*[F.sum(w * (x[a] * y[b] + x[b] * y[a])).alias(f"m_{a}_{b}") for a in range(k) for b in range(k)]), k)


def serial_arrays(obs: DataFrame, k: int, lag: float) -> DataFrame:
    """The same for any number of regressors."""
    return _sum_blocks(serial_blocks(obs, k, lag))


def serial_blocks(obs: DataFrame, k: int, lag: float) -> DataFrame:
    """The same as matrices to be added up: each task sends one, k x k (m, k)."""
    ship(obs.sparkSession)
    s = scores(obs).filter("unit is not null and time is not null").select("unit", "time", "s")
    span = STRETCH * lag
    own = F.floor(F.col("time") / span)
    # Rows within a lag of the next stretch are also read there, but only as earlier rows.
    late = F.col("time") >= (own + 1) * span - lag
    parts = F.when(late, F.array(F.struct(own.alias("part"), F.lit(True).alias("counts")), F.struct((own + 1).alias("part"), F.lit(False).alias("counts")))).otherwise(F.array(F.struct(own.alias("part"), F.lit(True).alias("counts"))))
    dealt = s.withColumn("p", F.explode(parts)).select("unit", F.col("p.part").alias("part"), "time", F.col("p.counts").alias("counts"), "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((k, k))
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)] + [_rows(batch.column(4), k)]
            n_held = len(held[0]) if held else 0
            unit, part, t, counts, x = (np.concatenate(c) for c in zip(held, now)) if held else now
            group = np.cumsum(np.concatenate([[0], (unit[1:] != unit[:-1]) | (part[1:] != part[:-1])]))
            c = np.zeros_like(x)
            i, d = np.arange(len(t)), 1
            while len(i := i[i >= d]):
                gap = t[i] - t[i - d]
                near = (group[i] == group[i - d]) & (gap <= lag)
                if not near.any():
                    break
                i, gap = i[near], gap[near]
                c[i] += np.where(gap > 0, 1 - gap / (lag + 1), 0.0)[:, None] * x[i - d]
                d += 1
            new = counts.astype(bool) & (np.arange(len(t)) >= n_held)
            part_m = x[new].T @ c[new]
            m += part_m + part_m.T
            keep = (group == group[-1]) & (t >= t[-1] - lag)
            held = [v[keep] for v in (unit, part, t, counts, x)]
        yield pa.RecordBatch.from_arrays([pa.array([m.ravel().tolist()], pa.list_(pa.float64())), pa.array([k], pa.int32())], names=["m", "k"])

    return dealt.repartition("unit", "part").sortWithinPartitions("unit", "part", "time").mapInArrow(run, "m array<double>, k int")


def serial_bytes(obs: DataFrame, k: int, lag: float) -> DataFrame:
    """The same matrices as bytes (m), row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = [_rows(batch.column(0).slice(i, 1), k).tobytes() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["m"])

    return serial_blocks(obs, k, lag).select("m").mapInArrow(run, "m binary")


def serial_meat(obs: DataFrame, k: int, lag: float) -> DataFrame:
    """The form that holds for units of any size: a window would put all rows of a unit into one task."""
    return serial_arrays(obs, k, lag)
