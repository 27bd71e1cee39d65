"""Tables and driver-side values of the engine."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

SCAN_ROW = "file_id string, seq long, mode int, x double, y double, z double, power double, param double"
SCAN_VECTOR = "vector_id long, layer int, sx double, sy double, sz double, ex double, ey double, ez double, t0 double, t1 double"
MODE = "dim string, k int, amplitude double, frequency double, phase double"
SERIES = "series_id string, n long, t double, value double"
VOXEL = "voxel_id long, ix int, iy int, iz int, x double, y double, z double"
MORPHOLOGY_EMPTY = "label long"
DIMS = ("width", "depth", "height")


def axis_count(low: float, high: float, step: float) -> int:
    """Points of an axis from ``low`` to ``high``, both ends included."""
    return max(0, math.ceil((high + step / 2 - low) / step))


@dataclass(frozen=True)
class GridSpec:
    """A regular grid of points: ``voxel_id = (ix * ny + iy) * nz + iz``."""

    resolution: float
    origin: tuple[float, float, float]
    shape: tuple[int, int, int]

    @classmethod
    def from_box(cls, resolution: float, bound_box) -> GridSpec:
        if resolution <= 0:
            raise ValueError("voxel_resolution must be positive")
        try:
            low, high = ([float(v) for v in point] for point in bound_box)
        except (TypeError, ValueError):
            raise ValueError("bound_box must be [[xmin, ymin, zmin], [xmax, ymax, zmax]]") from None
        if len(low) != 3 or len(high) != 3:
            raise ValueError("bound_box must be [[xmin, ymin, zmin], [xmax, ymax, zmax]]")
        if any(h <= l for l, h in zip(low, high)):
            raise ValueError("bound_box must grow along every axis")
        return cls(float(resolution), tuple(low), tuple(axis_count(l, h, resolution) for l, h in zip(low, high)))

    @classmethod
    def from_extent(cls, resolution: float, low, high) -> GridSpec:
        """Grid over the extent of scan vectors; an axis may have one plane only."""
        if resolution <= 0:
            raise ValueError("voxel_resolution must be positive")
        return cls(float(resolution), tuple(map(float, low)), tuple(axis_count(l, h, resolution) for l, h in zip(low, high)))

    @property
    def n_voxels(self) -> int:
        nx, ny, nz = self.shape
        return nx * ny * nz

    def step(self, axis: int) -> float:
        """The spacing of an axis as repeated addition to its origin sees it."""
        return (self.origin[axis] + self.resolution) - self.origin[axis]

    @property
    def high(self) -> tuple[float, float, float]:
        return tuple(o + (n - 1) * self.step(a) for a, (o, n) in enumerate(zip(self.origin, self.shape)))


@dataclass(frozen=True)
class MeltPoolSpec:
    """Spectra of width, depth and height, padded to one length, with shape exponents.

    ``modes[dim]`` lists (amplitude, frequency, phase); its size is the configured number of modes.
    """

    modes: dict[str, tuple[tuple[float, float, float], ...]]
    width_shape: float = 2.0
    depth_shape: float = 2.0
    height_shape: float = 2.0
    random_phases: bool = False
    seed: int = 0
    n_modes: int = field(init=False)

    def __post_init__(self):
        if set(self.modes) != set(DIMS):
            raise ValueError(f"a melt pool needs {', '.join(DIMS)}")
        most = max(len(m) for m in self.modes.values())
        padded = {d: tuple(tuple(map(float, x)) for x in m) + ((0.0, 0.0, 0.0),) * (most - len(m)) for d, m in self.modes.items()}
        object.__setattr__(self, "modes", padded)
        object.__setattr__(self, "n_modes", most)

    def maximum(self, dim: str) -> float:
        """Sum of the amplitudes: the outer bound of a dimension."""
        return sum(a for a, _, _ in self.modes[dim])

    def mean(self, dim: str) -> float:
        return self.modes[dim][0][0]

    @property
    def phases(self) -> tuple[float, ...]:
        """Without random phases, those of the width serve all dimensions."""
        return tuple(p for _, _, p in self.modes["width"])
