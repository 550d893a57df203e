"""Learning-rate and weight schedules as columns of the step."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(step: Column, total: int, top: float, low: float = 0.0) -> Column:
    """Half a cosine from ``top`` to ``low``."""
    return low + 0.5 * (top - low) * (1 + F.cos(math.pi * step / total))


def cosine_restarts(step: Column, period: int, top: float, low: float = 0.0) -> Column:
    """Cosines that start again every ``period`` steps."""
    return cosine(F.pmod(step, F.lit(float(period))), period, top, low)


def polynomial(step: Column, total: int, top: float, power: float) -> Column:
    return top * F.pow(1 - step / float(total), F.lit(power))


def linear_ramp(step: Column, length: int) -> Column:
    """0 to 1 over ``length`` steps, then 1."""
    return F.least(F.lit(1.0), step / float(length))


def sigmoid_ramp(step: Column, length: int) -> Column:
    """exp(-5 (1 - t)^2) over ``length`` steps, then 1."""
    t = 1 - linear_ramp(step, length)
    return F.exp(-5.0 * t * t)


def one_cycle(step: Column, total: int, top: float, warm: float = 0.3, start: float = 25.0, end: float = 1e4) -> Column:
    """Cosine up to ``top`` over the first ``warm`` share, cosine down for the rest."""
    up = total * warm
    first, last = top / start, top / end
    rise = first + (top - first) * 0.5 * (1 - F.cos(math.pi * step / up))
    fall = last + (top - last) * 0.5 * (1 + F.cos(math.pi * (step - up) / (total - up)))
    return F.when(step < up, rise).otherwise(fall)
