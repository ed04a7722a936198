"""A hexagonal lattice with axial coordinates, as column math.

A cell is q + r * width, with q from 0 to width - 1 and r from 0.  Neighbours differ by (1,0) (0,1)
(-1,1) (-1,0) (0,-1) (1,-1); the distance is (|dq| + |dr| + |dq + dr|) / 2; a cell's parent halves both
coordinates, rounding down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTIONS = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))


@dataclass(frozen=True)
class Lattice:
    """width: even, so that parents form a lattice of half the width.  size: of a cell's edge, in metres."""

    width: int
    size: float = 1.0

    def q(self, cell: Column) -> Column:
        return F.pmod(cell, F.lit(self.width))

    def r(self, cell: Column) -> Column:
        return F.floor(cell / self.width).cast("long")

    def cell(self, q: Column, r: Column) -> Column:
        """Null outside the lattice."""
        return F.when((q >= 0) & (q < self.width) & (r >= 0), (q + r * self.width).cast("long"))

    def distance(self, a: Column, b: Column) -> Column:
        dq, dr = self.q(a) - self.q(b), self.r(a) - self.r(b)
        return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("long")

    def parent(self, cell: Column) -> Column:
        """The cell of coarser() that has a cell."""
        return (F.floor(self.q(cell) / 2) + F.floor(self.r(cell) / 2) * (self.width // 2)).cast("long")

    def coarser(self) -> Lattice:
        return Lattice(self.width // 2, self.size * 2)

    def children(self, df: DataFrame, cell: str, out: str = "child") -> DataFrame:
        """The four cells, of the lattice twice as wide, of each cell of this one."""
        wide = Lattice(self.width * 2)
        q, r = self.q(F.col(cell)), self.r(F.col(cell))
        every = [wide.cell(q * 2 + a, r * 2 + b) for b in (0, 1) for a in (0, 1)]
        return df.withColumn(out, F.explode(F.array(*every)))

    def disk(self, df: DataFrame, cell: str, k: int, out: str = "near", ring: str = "k") -> DataFrame:
        """A row for each cell at most k steps away, itself included, with its distance."""
        steps = [(a, b, (abs(a) + abs(b) + abs(a + b)) // 2) for a in range(-k, k + 1) for b in range(max(-k, -a - k), min(k, -a + k) + 1)]
        offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(d).alias("d")) for a, b, d in steps))
        df = df.withColumn("__o", F.explode(offsets))
        near = self.cell(self.q(F.col(cell)) + F.col("__o.a"), self.r(F.col(cell)) + F.col("__o.b"))
        return df.withColumns({out: near, ring: F.col("__o.d")}).drop("__o").where(F.col(out).isNotNull())

    def neighbours(self, df: DataFrame, cell: str, out: str = "near") -> DataFrame:
        return self.disk(df, cell, 1, out, "__k").where("__k = 1").drop("__k")

    def length_m(self) -> float:
        """Between the centres of neighbouring cells: two heights of an equilateral triangle."""
        return self.size * 3**0.5

    def centre(self, cell: Column) -> tuple[Column, Column]:
        """x and y in metres."""
        q, r = self.q(cell), self.r(cell)
        return (q + r / 2) * self.length_m(), r * (self.size * 1.5)
