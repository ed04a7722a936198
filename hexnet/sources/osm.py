"""Networks from map data given as tables of nodes and tagged ways.

    nodes  id long, lon double, lat double (or x, y of a lattice)
    ways   id long, nodes array<long>, tags map<string,string>
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.geo import line_cells
from ..functions.lattice import Lattice
from ..operators import graph as g
from ..plans.store import ship

#: Ways' analyzers by name: an expression from tags to pref, speed_kmh, bidirectional, or null.
PROFILES: dict[str, Callable[[Column], Column]] = {"car": tags.car_profile, "foot": tags.foot_profile}


def way_points(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """way, xs, ys: the ways' points in order; nodes that are missing are left out, and ways of fewer than two points."""
    each = ways.select(F.col("id").alias("way"), F.posexplode("nodes").alias("pos", "node"))
    placed = each.join(nodes.select(F.col("id").alias("node"), "x", "y"), "node")
    lines = placed.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return lines.where(F.size("p") >= 2).select("way", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))


def way_cells(points: DataFrame, lattice: Lattice) -> DataFrame:
    """way, pos, cell along the ways' lines."""
    ship(points.sparkSession)
    @F.pandas_udf("array<long>")
    def cells(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([line_cells(lattice, list(zip(map(float, x), map(float, y), strict=True))) for x, y in zip(xs, ys, strict=True)])

    return points.select("way", F.posexplode(cells("xs", "ys")).alias("pos", "cell"))


def way_edges(cells: DataFrame, ways: DataFrame, profile: Callable[[Column], Column], length_m: float, lattice: Lattice | None = None) -> DataFrame:
    """The edges of passable ways, both ways round with the same weight unless they are one-way; the least weight of each."""
    passable = ways.select(F.col("id").alias("way"), profile(F.col("tags")).alias("p")).where("p is not null").select("way", "p.*")
    along = g.cells_to_edges(cells, lattice=lattice).join(passable, "way")
    there = along.select("src", "dst", tags.duration(F.lit(length_m), F.col("speed_kmh")).alias("td"), "pref", F.lit(length_m).alias("len_m"), "bidirectional")
    back = there.where("bidirectional").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "td", "pref", "len_m", "bidirectional")
    return g.build(there.unionByName(back).drop("bidirectional"))


def build_graph(nodes: DataFrame, ways: DataFrame, lattice: Lattice, profile: str = "car", min_shortcut: int | None = 5) -> DataFrame:
    """A network of the lattice, with shortcuts of min_shortcut edges or more unless that is None.  Runs jobs for those."""
    from ..operators.contract import contract

    analyzed = ways.where(PROFILES[profile](F.col("tags")).isNotNull())
    cells = way_cells(way_points(nodes, analyzed), lattice)
    edges = way_edges(cells, analyzed, PROFILES[profile], lattice.length_m(), lattice)
    return contract(edges, min_shortcut) if min_shortcut else edges


def only_last(nodes: DataFrame) -> DataFrame:
    """One row for each node id, the last by its columns, where files repeat nodes."""
    w = Window.partitionBy("id").orderBy(F.desc("x"), F.desc("y"))
    return nodes.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
