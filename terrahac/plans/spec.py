"""The parameters of a spatial-HAC estimate, checked when they are given."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: The first of each is the default.
KERNELS = ("bartlett", "uniform")
DISTANCES = ("haversine", "spherical", "chord", "flatearth")


def choose(value: str | None, options: tuple[str, ...], name: str) -> str:
    """The option that value names in full or by a beginning that no other option shares."""
    if value is None:
        return options[0]
    if value in options:
        return value
    found = [o for o in options if value and o.startswith(value)]
    if len(found) != 1:
        raise ValueError(f"{name} must be one of {', '.join(options)}")
    return found[0]


def _number(value: object, name: str, least: float, strict: bool) -> float:
    try:
        x = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        x = math.nan
    if isinstance(value, bool) or not math.isfinite(x) or x < least or (strict and x == least):
        raise ValueError(f"{name} must be a single {'positive' if strict else 'non-negative'} finite number.")
    return x


@dataclass
class SpatialHacSpec:
    """unit and time name the panel's keys; without unit the rows are a cross-section.

    ncores and maxobsmem are accepted for callers that pass them and change nothing: Spark
    plans the work.
    """

    lat: str
    lon: str
    dist_cutoff: float
    unit: str | None = None
    time: str | None = None
    kernel: str | None = None
    dist_fn: str | None = None
    lag_cutoff: float = 0
    verbose: bool = False
    balanced_pnl: bool = False
    ncores: int | None = None
    maxobsmem: int = 50_000

    def __post_init__(self) -> None:
        self.kernel = choose(self.kernel, KERNELS, "kernel")
        self.dist_fn = choose(self.dist_fn, DISTANCES, "dist_fn")
        self.dist_cutoff = _number(self.dist_cutoff, "dist_cutoff", 0, True)
        self.lag_cutoff = _number(self.lag_cutoff, "lag_cutoff", 0, False)
        if self.unit is not None and self.time is None:
            raise ValueError("a panel needs time as well as unit")
