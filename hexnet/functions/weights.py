"""Weights of edges and paths, as columns and as plain numbers.

A scalar weight is a number.  A standard weight is a travel duration in seconds (td) and a preference
(pref; smaller is better).  Durations add up; preferences are averaged by duration, each counting as one
second at least.  Order is by duration, then preference.  The standard zero is one second at preference
10, so a path costs that much more than its edges.

A routing mode with a factor orders paths by td * factor * pref instead.  This is additive, and shortest
paths are exact, where every edge takes a second or longer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument

#: (td, pref) of a path without edges.
ZERO = (1.0, 10.0)


def add(t1: Column, p1: Column, t2: Column, p2: Column) -> tuple[Column, Column]:
    m1, m2 = F.greatest(F.abs(t1), F.lit(1.0)), F.greatest(F.abs(t2), F.lit(1.0))
    return t1 + t2, (F.abs(p1) * m1 + F.abs(p2) * m2) / (m1 + m2)


def add_numbers(a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float]:
    m1, m2 = max(abs(a[0]), 1.0), max(abs(b[0]), 1.0)
    return a[0] + b[0], (abs(a[1]) * m1 + abs(b[1]) * m2) / (m1 + m2)


def fold(weights: Column) -> Column:
    """The sum of an array of structs (td, pref), from left to right; null for an empty one."""
    first = F.element_at(F.slice(weights, 1, 1), 1)
    rest = F.slice(weights, 2, F.greatest(F.size(weights) - 1, F.lit(0)))

    def step(acc: Column, w: Column) -> Column:
        t, p = add(acc["td"], acc["pref"], w["td"], w["pref"])
        return F.struct(t.alias("td"), p.alias("pref"))

    start = F.struct(first["td"].alias("td"), first["pref"].alias("pref"))
    return F.when(F.size(weights) > 0, F.aggregate(rest, start, step))


@dataclass(frozen=True)
class Profile:
    """How paths are compared.  standard: standard weights, else td alone.  factor: of a routing mode."""

    standard: bool = False
    factor: float | None = None

    def __post_init__(self) -> None:
        if self.factor is not None and (not self.standard or not (math.isfinite(self.factor) and self.factor > 0)):
            raise InvalidArgument("a factor must be a positive number, of a standard profile")

    @property
    def zero(self) -> tuple[float, float]:
        return ZERO if self.standard else (0.0, 0.0)

    def key(self, td: float, pref: float) -> tuple[float, float]:
        """Smaller is better."""
        if self.factor is not None:
            return (td * self.factor * pref, 0.0)
        return (td, pref) if self.standard else (td, 0.0)

    def add(self, a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float]:
        return add_numbers(a, b) if self.standard else (a[0] + b[0], 0.0)

    def key_column(self, td: Column, pref: Column) -> Column:
        if self.factor is not None:
            return F.struct((td * self.factor * pref).alias("k1"), F.lit(0.0).alias("k2"))
        return F.struct(td.alias("k1"), (pref if self.standard else F.lit(0.0)).alias("k2"))

    def add_columns(self, t1: Column, p1: Column, t2: Column, p2: Column) -> tuple[Column, Column]:
        return add(t1, p1, t2, p2) if self.standard else (t1 + t2, F.lit(0.0))


SCALAR, STANDARD = Profile(), Profile(standard=True)


def mode(modes: dict[str, float | None], name: str = "") -> Profile:
    """The standard profile with a named routing mode's factor; no name: none."""
    if not name:
        return STANDARD
    if name not in modes:
        raise InvalidArgument(f"unknown routing mode {name!r}")
    return Profile(True, modes[name])
