"""Colour maps as columns of a value in [0, 1]: formulas, and tables interpolated between control points."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Red, green and blue of the perceptual maps at 0, 0.067, 0.133, 0.2, ... 1 (sixteenths of the range, to three digits).
AT = (0.0, 0.067, 0.133, 0.2, 0.267, 0.333, 0.4, 0.467, 0.533, 0.6, 0.667, 0.733, 0.8, 0.867, 0.933, 1.0)
CONTROL = {
    "viridis": """0.267 0.005 0.329, 0.283 0.141 0.458, 0.254 0.265 0.530, 0.208 0.374 0.553, 0.163 0.471 0.558, 0.125 0.563 0.551, 0.108 0.648 0.522, 0.135 0.727 0.473,
0.205 0.797 0.401, 0.310 0.851 0.311, 0.429 0.893 0.200, 0.558 0.920 0.108, 0.682 0.937 0.093, 0.797 0.940 0.165, 0.905 0.934 0.306, 0.993 0.906 0.144""",
    "magma": """0.001 0.000 0.014, 0.028 0.016 0.097, 0.092 0.021 0.202, 0.183 0.026 0.296, 0.278 0.032 0.365, 0.378 0.053 0.406, 0.478 0.087 0.417, 0.576 0.124 0.413,
0.671 0.167 0.398, 0.762 0.229 0.375, 0.843 0.318 0.344, 0.906 0.441 0.318, 0.948 0.585 0.349, 0.973 0.726 0.459, 0.989 0.859 0.620, 0.988 0.992 0.749""",
    "inferno": """0.001 0.000 0.014, 0.037 0.010 0.111, 0.120 0.013 0.216, 0.222 0.016 0.287, 0.325 0.028 0.310, 0.427 0.056 0.300, 0.527 0.098 0.263, 0.622 0.153 0.203,
0.710 0.219 0.127, 0.789 0.298 0.048, 0.856 0.392 0.007, 0.908 0.502 0.030, 0.945 0.625 0.122, 0.968 0.754 0.272, 0.983 0.882 0.475, 0.988 1.000 0.645""",
    "plasma": """0.050 0.030 0.528, 0.177 0.006 0.583, 0.275 0.003 0.613, 0.365 0.019 0.626, 0.449 0.047 0.624, 0.529 0.082 0.608, 0.607 0.117 0.579, 0.682 0.154 0.539,
0.752 0.196 0.490, 0.818 0.244 0.432, 0.877 0.302 0.366, 0.926 0.373 0.292, 0.960 0.460 0.211, 0.979 0.561 0.131, 0.980 0.672 0.068, 0.940 0.975 0.131""",
    "turbo": """0.190 0.072 0.232, 0.274 0.314 0.697, 0.240 0.524 0.906, 0.133 0.718 0.907, 0.028 0.867 0.764, 0.028 0.954 0.549, 0.241 0.990 0.324, 0.489 0.981 0.123,
0.714 0.920 0.028, 0.889 0.809 0.028, 0.991 0.671 0.028, 0.994 0.502 0.028, 0.942 0.321 0.028, 0.847 0.163 0.028, 0.702 0.052 0.028, 0.479 0.016 0.010""",
}
NAMES = ("grayscale", "viridis", "magma", "inferno", "plasma", "hot", "cool", "bone", "jet", "turbo")


def control(name: str) -> list[tuple[float, float, float]]:
    return [tuple(map(float, p.split())) for p in CONTROL[name].split(",")]


@cache
def table(name: str) -> np.ndarray:
    """The 256 colours of a map with control points (single precision, as bytes rounded half up)."""
    at, p = np.float32(AT).astype(float), np.float32(control(name)).astype(float)
    t = np.arange(256) / 255
    k = np.clip(np.searchsorted(at, t) - 1, 0, len(at) - 2)
    f = (t - at[k]) / (at[k + 1] - at[k])
    return np.floor(np.clip(p[k] + f[:, None] * (p[k + 1] - p[k]), 0, 1) * 255 + 0.5).astype(int)


def index(t: Column) -> Column:
    """Position in a map of 256 colours."""
    return _byte(t)


def _byte(v: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255.0 + 0.5).cast("int")


def _bone(t: Column) -> list[Column]:
    low, high = t < 3 / 8, t >= 3 / 4
    rise = (t - 3 / 4) * 4 / 3
    over = [F.when(high, rise).otherwise(0.0), F.when(high, rise + 1 / 8).when(low, 0.0).otherwise((t - 3 / 8) * 4 / 3), F.when(low, t * 4 / 3).otherwise(1 / 8)]
    return [t * 7 / 8 + v for v in over]


def colour(t: Column, name: str) -> Column:
    """Struct (r, g, b) of the map ``name`` at ``t``, which is clamped."""
    if name not in NAMES:
        raise ValueError(f"unknown colour map {name}")
    if name in CONTROL:
        every = F.array(*[F.struct(*[F.lit(int(v)).alias(k) for k, v in zip("rgb", row, strict=True)]) for row in table(name)])
        return F.element_at(every, index(t) + 1)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ramp = lambda k: 1.5 - F.abs(4 * t - k)
    maps = {"grayscale": [t, t, t], "hot": [t * 3, t * 3 - 1, t * 3 - 2], "cool": [t, 1 - t, F.lit(1.0)], "bone": _bone(t), "jet": [ramp(3), ramp(2), ramp(1)]}
    return F.struct(*[_byte(c).alias(k) for k, c in zip("rgb", maps[name], strict=True)])
