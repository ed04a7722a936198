"""Paths before and after cells are closed, what that changes for each origin, and coarse prefiltering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DestinationsNotInGraph, InvalidArgument
from ..functions.lattice import Lattice
from ..functions.weights import STANDARD, Profile
from ..plans.store import Rounds
from . import enrich
from . import graph as g
from .routing import Options, every_cost, shortest_paths, summaries

#: Metres around a coarse cell in which a change makes its fine origins worth computing.
REACH_M = 1500.0
#: Resolutions that are tried below that of the network.
COARSER = 4


def select_origins(reference: DataFrame, closed: DataFrame, cell: str = "cell") -> DataFrame:
    """The reference cells that aren't closed, once each."""
    return enrich.outside(reference.select(cell).distinct(), closed, cell)


def differential_paths(
    edges: DataFrame, closed: DataFrame, origins: DataFrame, destinations: DataFrame, options: Options = Options(), profile: Profile = STANDARD, lattice: Lattice | None = None
) -> DataFrame:
    """The columns of shortest_paths and phase: "before" and "after" the cells of closed go.

    Origins without a path before are left out; those without one after have no row of that phase.
    """
    origins, edges, after_edges, rounds = _both(edges, closed, origins)
    if not options.gap and every_cost(edges, options, profile):
        # a path after is one before, so no origin is to be left out, and neither phase is read twice
        phases = [shortest_paths(e, origins, destinations, options, profile, lattice).withColumn("phase", F.lit(name)) for e, name in ((edges, "before"), (after_edges, "after"))]
        return phases[0].unionByName(phases[1])
    before = rounds.write(shortest_paths(edges, origins, destinations, options, profile, lattice))
    try:
        after = rounds.write(shortest_paths(after_edges, origins, destinations, options, profile, lattice))
    except DestinationsNotInGraph:
        # closing every destination fails as a whole, like asking for none
        raise
    after = after.join(before.select("origin").distinct(), "origin", "left_semi").select(before.columns)
    return before.withColumn("phase", F.lit("before")).unionByName(after.withColumn("phase", F.lit("after")))


def _both(edges: DataFrame, closed: DataFrame, origins: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Rounds]:
    """Origins that aren't closed, and the network before and after."""
    if not closed.limit(1).count():
        raise InvalidArgument("no cell is closed")
    rounds = Rounds(edges.sparkSession, keep=10)
    if not edges.storageLevel.useMemory:
        edges = rounds.write(edges)  # read several times
    return select_origins(origins, closed), edges, g.exclude(edges, closed), rounds


def _compared(edges: DataFrame, closed: DataFrame, origins: DataFrame, destinations: DataFrame, options: Options, profile: Profile, lattice: Lattice | None) -> DataFrame | None:
    """origin, b and a: routing.summaries() of each origin with a path before, before and after; None where paths have to be compared one by one."""
    if options.gap or not every_cost(edges, options, profile):
        return None
    origins, edges, after, _ = _both(edges, closed, origins)
    found = [summaries(e, origins, destinations, options, profile, lattice) for e in (edges, after)]
    if any(f is None for f in found):
        return None
    b, a = (f.select("origin", F.struct(*(c for c in f.columns if c != "origin")).alias(name)) for f, name in zip(found, "ba", strict=True))
    return b.join(a.hint("shuffle_hash"), "origin", "left")


def origin_statistics(
    edges: DataFrame, closed: DataFrame, origins: DataFrame, destinations: DataFrame, options: Options = Options(), profile: Profile = STANDARD, lattice: Lattice | None = None
) -> DataFrame:
    """statistics() of differential_paths(), without a table of paths where they can be folded as they are found."""
    both = _compared(edges, closed, origins, destinations, options, profile, lattice)
    if both is None:
        return statistics(differential_paths(edges, closed, origins, destinations, options, profile, lattice), profile)
    out = []
    for s, name in (("b", "without"), ("a", "with")):
        out += [
            F.col(f"{s}.best").alias(f"preferred_dest_h3index_{name}_disturbance"),
            F.coalesce(f"{s}.n", F.lit(0).cast("long")).alias(f"num_reached_{name}_disturbance"),
            (F.col(f"{s}.sum_td") / F.col(f"{s}.n")).alias(f"avg_travel_duration_{name}_disturbance"),
            (F.col(f"{s}.sum_pref") / F.col(f"{s}.n")).alias(f"avg_edge_preference_{name}_disturbance"),
        ]
    return both.select(F.col("origin").alias("h3index_origin"), *out)


def affected_origins(
    edges: DataFrame, closed: DataFrame, origins: DataFrame, destinations: DataFrame, options: Options = Options(), profile: Profile = STANDARD, lattice: Lattice | None = None, hops: bool = True
) -> DataFrame:
    """affected() of differential_paths(), without a table of paths where they can be folded as they are found.  hops: whether numbers of edges count."""
    folded = hops or profile.factor is None  # of equal products, the lesser number of edges goes before the lesser td
    both = _compared(edges, closed, origins, destinations, options, profile, lattice) if folded else None
    if both is None:
        paths = differential_paths(edges, closed, origins, destinations, options, profile, lattice)
        return affected(paths if hops else paths.withColumn("hops", F.lit(0)), profile)
    # what is left of a network has no better path: a path's first part that differs gets larger, so sums without rounding differ if any path does
    return both.where(_differs(profile, hops)).select(F.col("origin").alias("cell"))


def _differs(profile: Profile, hops: bool) -> Column:
    parts = ["sum_td", "sum_w"] if profile.standard else ["sum_td"]
    changed = [F.col(f"a.{c}") != F.col(f"b.{c}") for c in (["n", *parts, "sum_hops"] if hops else ["n", *parts])]
    out = F.col("a").isNull()
    for c in changed:
        out |= c
    return out


def statistics(paths: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    """One row for each origin of differential_paths: its best destination, destinations reached and averages, before and after."""
    key = F.struct(profile.key_column(F.col("td"), F.col("pref")).alias("k"), "start_cell", "end_cell", "destination")
    out = []
    for phase, name in (("before", "without"), ("after", "with")):
        mine = F.col("phase") == phase
        out += [
            F.min_by(F.when(mine, F.col("destination")), F.when(mine, key)).alias(f"preferred_dest_h3index_{name}_disturbance"),
            F.count(F.when(mine, 1)).alias(f"num_reached_{name}_disturbance"),
            F.avg(F.when(mine, F.col("td"))).alias(f"avg_travel_duration_{name}_disturbance"),
            F.avg(F.when(mine, F.col("pref"))).alias(f"avg_edge_preference_{name}_disturbance"),
        ]
    return paths.groupBy(F.col("origin").alias("h3index_origin")).agg(*out)


def coarse_distance(edge_length_m: float) -> int:
    """Rings of coarse cells that REACH_M covers, one at least."""
    return max(1, math.ceil(REACH_M / edge_length_m))


def affected(paths: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    """cell: origins whose paths differ in cost or in their number of edges."""
    one = F.struct("destination", "td", *(["pref"] if profile.standard else []), "hops")
    both = paths.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.when(F.col("phase") == "before", one))).alias("b"), F.array_sort(F.collect_list(F.when(F.col("phase") == "after", one))).alias("a")
    )
    return both.where("a <> b").select(F.col("origin").alias("cell"))


def preroute(
    coarse_edges: DataFrame, closed: DataFrame, origins: DataFrame, destinations: DataFrame, lattice: Lattice, options: Options = Options(), profile: Profile = STANDARD
) -> DataFrame:
    """The origins (fine cells) near enough to a coarse cell whose paths change, or inside a coarse closed cell.

    lattice is that of the fine cells.  The selection is a heuristic: far-reaching changes that the coarse
    network hides are missed.
    """
    up = lattice.coarser()
    raise_ = lambda df: df.select(lattice.parent(F.col("cell")).alias("cell")).distinct()
    shut = raise_(closed)
    changed = affected_origins(coarse_edges, shut, raise_(origins), raise_(destinations), options, profile, up)
    near = up.disk(changed, "cell", coarse_distance(up.size), "near").select(F.col("near").alias("p")).distinct()
    wanted = near.unionByName(shut.select(F.col("cell").alias("p"))).distinct()
    fine = origins.select("cell").distinct().withColumn("p", lattice.parent(F.col("cell")))
    return fine.join(wanted, "p", "left_semi").select("cell")
