"""Networks as tables of directed edges: building, merging, looking up, coarsening, hiding.

    edges  edge long, src long, dst long, td double, pref double, len_m double
           and, for networks with shortcuts, ff struct<edges, cells, dst, td, pref> or null
    nodes  cell long, is_origin boolean, is_destination boolean

Every function takes and returns DataFrames and runs nothing, unless it says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EmptyGraph, MixedResolutions, TooHighResolution
from ..functions.lattice import Lattice

EDGE = ["edge", "src", "dst", "td", "pref", "len_m"]


def build(edges: DataFrame) -> DataFrame:
    """One row for each edge: the one with the least (td, pref).  Rows with a null edge or weight go.

    Needs src, dst, td; edge, pref and len_m are made where they are missing.
    """
    have = set(edges.columns)
    more = {
        "edge": F.xxhash64("src", "dst"),
        "pref": F.lit(0.0),
        "len_m": F.lit(1.0),
    }
    edges = edges.withColumns({c: e for c, e in more.items() if c not in have}).where("edge is not null and td is not null and pref is not null")
    least = F.min(F.struct("td", "pref", "len_m")).alias("w")
    out = edges.groupBy("edge").agg(F.first("src").alias("src"), F.first("dst").alias("dst"), least)
    return out.select("edge", "src", "dst", F.col("w.td").cast("double").alias("td"), F.col("w.pref").cast("double").alias("pref"), F.col("w.len_m").cast("double").alias("len_m"))


def merge(*graphs: DataFrame, resolution: Callable[[Column], Column] | None = None) -> DataFrame:
    """All edges of networks of one resolution; the least weight of those that are in several.

    Given a resolution of cells, MixedResolutions is raised where there are several, which runs a job.
    """
    out = graphs[0].select(EDGE)
    for g in graphs[1:]:
        out = out.unionByName(g.select(EDGE))
    return build(check(out, resolution) if resolution else out)


def check(edges: DataFrame, resolution: Callable[[Column], Column] | None = None) -> DataFrame:
    """The edges, after a look whether there are any and, given a resolution of cells, only one.  Runs a job."""
    found = edges.agg(F.count(F.lit(1)), F.countDistinct(resolution(F.col("src"))) if resolution else F.lit(1)).first()
    if not found[0]:
        raise EmptyGraph("a network needs an edge")
    if found[1] > 1:
        raise MixedResolutions(f"{found[1]} resolutions in one network")
    return edges


def nodes(edges: DataFrame) -> DataFrame:
    """cell, is_origin, is_destination."""
    ends = F.array(F.struct(F.col("src").alias("cell"), F.lit(True).alias("o")), F.struct(F.col("dst").alias("cell"), F.lit(False).alias("o")))
    every = edges.select(F.explode(ends).alias("n")).select("n.cell", "n.o")
    return every.groupBy("cell").agg(F.bool_or("o").alias("is_origin"), F.bool_or(~F.col("o")).alias("is_destination"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: num_nodes, num_edges, num_shortcuts."""
    shortcuts = F.count("ff") if "ff" in edges.columns else F.lit(0).cast("long")
    counted = edges.agg(F.count(F.lit(1)).alias("num_edges"), shortcuts.alias("num_shortcuts"))
    return nodes(edges).agg(F.count(F.lit(1)).alias("num_nodes")).crossJoin(counted)


def reverse(edges: DataFrame) -> DataFrame:
    """Every edge the other way round, with its weight."""
    return edges.select(F.xxhash64("dst", "src").alias("edge"), F.col("dst").alias("src"), F.col("src").alias("dst"), "td", "pref", "len_m")


def outgoing(edges: DataFrame, cells: DataFrame, cell: str = "cell") -> DataFrame:
    """The edges that start in the cells given."""
    return edges.join(cells.select(F.col(cell).alias("src")).distinct(), "src", "left_semi")


def lookup(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the edges asked for by their id."""
    return edges.join(wanted.select("edge").distinct(), "edge", "left_semi")


def lookup_nodes(edges: DataFrame, cells: DataFrame, cell: str = "cell") -> DataFrame:
    return nodes(edges).join(cells.select(F.col(cell).alias("cell")).distinct(), "cell", "left_semi")


def dedupe(edges: DataFrame) -> DataFrame:
    """One row for each edge id, with its least weight and all columns."""
    w = Window.partitionBy("edge").orderBy("td", "pref", "src", "dst")
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def without_shortcuts(edges: DataFrame) -> DataFrame:
    return edges.drop("ff")


def downsample(edges: DataFrame, parent: Callable[[Column], Column], combine: Callable[[Column], Column] = F.min) -> DataFrame:
    """The network between the parents of cells; combine folds the (td, pref, len_m) of edges that fall together.

    combine must not depend on the order of rows.
    """
    up = edges.select(parent(F.col("src")).alias("src"), parent(F.col("dst")).alias("dst"), F.struct("td", "pref", "len_m").alias("w")).where("src <> dst")
    out = up.groupBy("src", "dst").agg(combine(F.col("w")).alias("w"))
    return out.select(F.xxhash64("src", "dst").alias("edge"), "src", "dst", "w.td", "w.pref", "w.len_m")


def downsample_h3(edges: DataFrame, res: int, combine: Callable[[Column], Column] = F.min) -> DataFrame:
    """downsample() of H3 cells to a coarser resolution.  Runs a job that looks at the resolution."""
    from ..functions import bits

    own = edges.agg(F.min(bits.resolution(F.col("src")))).first()[0]
    if own is not None and res >= own:
        raise TooHighResolution(f"{res} isn't coarser than {own}")
    return downsample(edges, lambda c: bits.parent(c, res), combine)


def downsample_lattice(edges: DataFrame, lattice: Lattice, combine: Callable[[Column], Column] = F.min) -> DataFrame:
    return downsample(edges, lattice.parent, combine)


def cells_to_edges(ways: DataFrame, skip_gaps: bool = False, lattice: Lattice | None = None) -> DataFrame:
    """Rows (way, pos, cell) as edges between the cells that follow each other in a way: way, pos, src, dst.

    Repeated cells are passed over.  Given a lattice, two cells that aren't neighbours end their way, or
    are passed over with skip_gaps.
    """
    order = Window.partitionBy("way").orderBy("pos")
    moved = ways.withColumn("prev", F.lag("cell").over(order)).where("prev is null or prev <> cell")
    pairs = moved.withColumn("dst", F.lead("cell").over(order)).where("dst is not null").select("way", "pos", F.col("cell").alias("src"), "dst")
    if lattice is None:
        return pairs
    near = lattice.distance(F.col("src"), F.col("dst")) == 1
    if skip_gaps:
        return pairs.where(near)
    gap = F.min(F.when(~near, F.col("pos"))).over(Window.partitionBy("way"))
    return pairs.withColumn("gap", gap).where("gap is null or pos < gap").drop("gap")


def exclude(edges: DataFrame, cells: DataFrame, cell: str = "cell") -> DataFrame:
    """The network as if the cells weren't there: edges from or to them go, and shortcuts through them."""
    hidden = cells.select(F.col(cell).alias("__x")).distinct()
    out = edges
    for end in ("src", "dst"):
        out = out.join(hidden, out[end] == hidden["__x"], "left_anti")
    if "ff" in edges.columns:
        through = out.where("ff is not null").select("edge", F.explode("ff.cells").alias("__x")).join(hidden, "__x", "left_semi").select("edge").distinct().withColumn("__cut", F.lit(True))
        out = out.join(through, "edge", "left").withColumn("ff", F.when(F.col("__cut").isNull(), F.col("ff"))).drop("__cut")
    return out


def reweight(edges: DataFrame, cost: Callable[[Column, Column], Column]) -> DataFrame:
    """A column cost of each edge from its (td, pref), computed where it is used."""
    return edges.withColumn("cost", cost(F.col("td"), F.col("pref")))


def degrees(edges: DataFrame) -> DataFrame:
    """cell, in_degree, out_degree."""
    ends = F.array(F.struct(F.col("src").alias("cell"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("cell"), F.lit(0).alias("o")))
    every = edges.select(F.explode(ends).alias("n")).select("n.cell", "n.o")
    return every.groupBy("cell").agg(F.sum(1 - F.col("o")).cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"))


def bounds(edges: DataFrame, lattice: Lattice) -> DataFrame:
    """One row: the box around the centres of all nodes."""
    x, y = lattice.centre(F.col("cell"))
    at = nodes(edges).select(x.alias("x"), y.alias("y"))
    return at.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def features(edges: DataFrame) -> DataFrame:
    """What an export writes: a row for each edge and one for each shortcut, with the cells of its line.

    num_edges is the true number; num_edges_less_one is that of older exports.
    """
    single = edges.select(
        "edge", F.array("src", "dst").alias("cells"), F.col("td").alias("travel_duration_secs"), F.col("pref").alias("edge_preference"), F.lit(False).alias("is_long_edge"), F.lit(1).alias("num_edges")
    )
    if "ff" not in edges.columns:
        return single
    long = edges.where("ff is not null").select(
        "edge", F.concat(F.array("src"), "ff.cells").alias("cells"), F.col("ff.td").alias("travel_duration_secs"), F.col("ff.pref").alias("edge_preference"),
        F.lit(True).alias("is_long_edge"), F.size("ff.edges").alias("num_edges"),
    )
    long = long.withColumn("cells", F.array_distinct("cells"))
    return single.unionByName(long).withColumn("num_edges_less_one", F.col("num_edges") - 1)
