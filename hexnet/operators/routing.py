"""Shortest paths and reachable cells.

Three strategies give the same costs and paths.

    relax  rounds of joins: the frontier of improved labels meets the edges on their source, the best
           label of each (origin, cell) stays, until nothing improves.  The network and the labels may
           be of any size.
    local  the network, as arrays, is sent to tasks that each search for some origins with a heap.  For
           networks of at most MAX_LOCAL_EDGES edges, which is counted.

    strip  costs of all pairs of a narrow network, whose edges join cells with near numbers, where sums aren't
           rounded: the cells are passed in order (strip.py).

Labels are compared by (key of the profile, number of edges, previous cell), so ties are settled the
same way everywhere.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DestinationsNotInGraph, InvalidArgument
from ..functions import geo
from ..functions.lattice import Lattice
from ..functions.weights import SCALAR, Profile
from ..plans.store import Rounds, ship
from . import graph as g
from . import strip
from .search import ALONG, EDGES_AT_ONCE, ROWS_AT_ONCE, Forest, Network, nearest

#: About 200 bytes an edge in each Python worker, searched cell by cell.
MAX_LOCAL_EDGES = 1_000_000
#: About 50 bytes an edge in each Python worker and the driver, for paths to cells that are known.
MAX_ARRAY_EDGES = 5_000_000
#: Edges of paths that a task follows at once, and about those of a task.
EDGES_FOLLOWED, EDGES_OF_A_TASK = 8_000_000, 16_000_000
LABEL = "origin long, node long, td double, pref double, len_m double, hops int, path array<long>"
_NAMES = ["origin", "node", "td", "pref", "len_m", "hops", "path"]
_ALONG = ", edges_n long, edges_td double, edges_m double, first_cell long, last_cell long"


@dataclass(frozen=True)
class Options:
    """k: destinations to reach (None or 0: all).  gap: rings to look for a cell of the network around a
    cell that isn't one.  strategy: auto, relax or local.  paths: whether paths' edges are wanted, or costs
    alone (edges are empty then, which spares most of a long path's row).  along: whether what is along the paths' edges
    is wanted: edges_n, their sums edges_td and edges_m, first_cell and last_cell.  All edges of all paths count, but
    paths from one origin are folded together as a tree, not listed one by one; edges are empty.
    """

    k: int | None = None
    gap: int = 0
    strategy: str = "auto"
    paths: bool = True
    along: bool = False

    def __post_init__(self) -> None:
        if self.k is not None and self.k < 0 or self.gap < 0 or self.strategy not in ("auto", "relax", "local"):
            raise InvalidArgument(f"{self}")


def _strategy(edges: DataFrame, wanted: str, most: int) -> str:
    if wanted != "auto":
        return wanted
    return "local" if edges.limit(most + 1).count() <= most else "relax"


class _Arrays(Network):
    """A network as arrays, with the search of one origin cell by cell: of reachable cells, and where an edge may make a path less."""

    def steps(self) -> tuple:
        """As plain lists, which are faster one by one: cells, source and edge id of each edge, and of each cell the edges that leave it."""
        if self.lists is None:
            each = list(zip(self.dst.tolist(), self.td.tolist(), self.pref.tolist(), self.len_m.tolist(), range(len(self.dst)), strict=True))
            starts = self.starts.tolist()
            self.lists = self.cells.tolist(), self.src.tolist(), self.edge.tolist(), [each[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        return self.lists

    def search(self, origin: int, profile: Profile, limit: float | None, targets: set[int] | None, k: int | None, paths: bool = True) -> list[tuple]:
        """(cell, td, pref, len_m, hops, path of edges) of settled cells; of targets only if they are given."""
        at = int(np.searchsorted(self.cells, origin))
        zero = profile.zero
        if at == len(self.cells) or self.cells[at] != origin:
            return [(origin, *zero, 0.0, 0, [])] if targets is None else []
        cells, sources, names, leaving = self.steps()
        add, key_of, plain = profile.add, profile.key, profile is SCALAR or profile == SCALAR
        best: dict[int, tuple] = {at: (profile.key(*zero), 0, -1)}
        state = {at: (*zero, 0.0, -1)}
        done: set[int] = set()
        heap, out, line = [(profile.key(*zero), 0, -1, at)], [], None
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            key, hops, prev, here = pop(heap)
            if here in done or (key, hops, prev) != best[here]:
                continue
            if line is not None and key > line:
                break
            done.add(here)
            td, pref, length, _ = state[here]
            cell = cells[here]
            if targets is None or cell in targets:
                path, x = [], here
                while paths and state[x][3] >= 0:
                    e = state[x][3]
                    path.append(names[e])
                    x = sources[e]
                out.append((cell, td, pref, length, hops, path[::-1]))
                if len(out) == k:
                    line = key  # cells just as near may have a smaller number
            hops += 1
            for to, t, p, n, e in leaving[here]:
                if to in done:
                    continue
                if not plain or pref or p:
                    t, p = add((t, p), (td, pref))
                else:
                    t = td + t
                new = key_of(t, p)
                if limit is not None and new[0] > limit:
                    continue
                old = best.get(to)
                if old is None or new < old[0] or new == old[0] and (hops, cell) < old[1:]:
                    label = best[to] = (new, hops, cell)
                    state[to] = (t, p, length + n, e)
                    push(heap, (*label, to))
        if line is not None:
            out = sorted(out, key=lambda r: (key_of(r[1], r[2]), r[0]))[:k]
        return out


def _local(edges: DataFrame, origins: DataFrame, profile: Profile, limit: float | None, targets: DataFrame | None, k: int | None, paths: bool, along: bool = False) -> DataFrame:
    ship(edges.sparkSession)
    spark, sc = edges.sparkSession, edges.sparkSession.sparkContext
    n, low, high = edges.agg(F.count(F.lit(1)), F.min("len_m"), F.max("len_m")).first()
    if n > MAX_ARRAY_EDGES:
        raise InvalidArgument(f"{n} edges are too many to send to every task")
    if targets is not None and limit is None and not paths and not profile.standard and low == high:
        net = _Arrays.plain(edges.select("src", "dst", "td").toArrow(), low)
        if net.batched(profile):
            return _batched(spark, net, origins.select("cell").where("cell is not null").distinct(), profile, targets, k, paths, along)
    net = _Arrays(edges.select("src", "dst", "td", "pref", "len_m", "edge").toArrow())
    origins = origins.select("cell").where("cell is not null").distinct()
    if targets is not None and limit is None and net.batched(profile):
        return _batched(spark, net, origins, profile, targets, k, paths, along)
    if along:
        return _folded(_local(edges, origins, profile, limit, targets, k, True), edges)
    if len(net.edge) > MAX_LOCAL_EDGES:
        return _relax(edges, origins, profile, limit, targets, k, paths)
    arrays, wanted = sc.broadcast(net), None
    if targets is not None:
        cells = targets.select("cell").distinct()
        found = cells.join(g.nodes(edges), "cell", "left_semi").union(cells.join(origins, "cell", "left_semi")).distinct()
        # cells of a network of at most MAX_LOCAL_EDGES edges, or origins
        wanted = sc.broadcast({r[0] for r in found.collect()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for origin in batch["cell"]:
                rows = arrays.value.search(int(origin), profile, limit, wanted.value if wanted else None, k, paths)
                if rows:
                    yield pd.DataFrame([(int(origin), *r) for r in rows], columns=["origin", "node", "td", "pref", "len_m", "hops", "path"])

    return origins.repartition(max(1, min(4 * sc.defaultParallelism, 10_000)), "cell").mapInPandas(run, LABEL)


def _batched(spark: SparkSession, net: _Arrays, origins: DataFrame, profile: Profile, targets: DataFrame, k: int | None, paths: bool, along: bool = False) -> DataFrame:
    """Searches of many origins at once.  Costs alone, where sums are exact, are searched from the targets if those are fewer, or once for all if k are wanted."""
    sc = spark.sparkContext
    # both at most the cells of a network that was counted
    ends, starts = (net.places(df.select("cell").where("cell is not null").distinct().toArrow().column("cell").to_numpy()) for df in (targets, origins))
    turned = not paths and not along and not profile.standard and net.exact()
    at_once = turned and k is not None and k < len(ends) and len(starts) > 32 * k
    turned = at_once or turned and (k is None or k >= len(ends)) and len(ends) < len(starts)
    shared = sc.broadcast((net.backwards() if turned else net, starts, ends))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(len(b) for b in batches):
            return
        net, starts, ends = shared.value
        o, t, td, hops = nearest(net, starts, ends, k)
        for a in range(0, len(o), ROWS_AT_ONCE):
            own = slice(a, a + ROWS_AT_ONCE)
            none = np.zeros(len(o[own]))
            length = hops[own] * float(net.len_m[0] if len(net.len_m) else 0)
            columns = net.cells[o[own]], net.cells[t[own]], td[own], none, length, hops[own]
            yield pa.record_batch([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(np.zeros(len(none) + 1, np.int32)), pa.array([], pa.int64()))], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, starts, ends = shared.value
        own = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)])
        for found in net.search_many(own, profile, starts if turned else ends, k):
            for batch in found.batches(paths, along):
                yield batch.rename_columns(["node", "origin", *_NAMES[2:]]).select(_NAMES) if turned else batch

    if at_once:
        return spark.range(0, 1, 1, 1).mapInArrow(once, LABEL)
    # neighbouring cells together, which end at about the same time
    own = ends if turned else starts
    parts = max(1, min(4 * sc.defaultParallelism, len(own)))
    deal = spark.range(0, parts, 1, parts)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, starts, ends = shared.value
        for b in batches:
            for n in b.column(0).to_pylist():
                yield pa.record_batch([pa.array(np.array_split(ends if turned else starts, parts)[n].astype(np.int64))], names=["at"])

    return deal.mapInArrow(lambda batches: run(part(batches)), LABEL + _ALONG * along)


def _relax(edges: DataFrame, origins: DataFrame, profile: Profile, limit: float | None, targets: DataFrame | None, k: int | None, paths: bool) -> DataFrame:
    rounds = Rounds(edges.sparkSession)
    zero = profile.zero
    key = lambda: profile.key_column(F.col("td"), F.col("pref"))
    none = F.expr("cast(array() as array<bigint>)")
    labels = origins.where("cell is not null").select("cell").distinct().select(
        F.col("cell").alias("origin"), F.col("cell").alias("node"), F.lit(float(zero[0])).alias("td"), F.lit(float(zero[1])).alias("pref"),
        F.lit(0.0).alias("len_m"), F.lit(0).alias("hops"), F.lit(-1).cast("long").alias("prev"), none.alias("path"), F.lit(0).alias("round"),
    )
    labels = rounds.write(labels)
    step = edges.select("edge", "src", "dst", F.col("td").alias("t"), F.col("pref").alias("p"), F.col("len_m").alias("l"))
    wanted = targets.select(F.col("cell").alias("node")).distinct() if targets is not None else None
    n = 0
    while True:
        front = labels.where(F.col("round") == n)
        n += 1
        if wanted is not None and k is not None:
            # an origin whose k-th destination is better than all of its frontier is through
            reached = labels.join(wanted, "node", "left_semi").withColumn("key", key())
            kth = Window.partitionBy("origin").orderBy("key", "node")
            line = reached.withColumn("n", F.row_number().over(kth)).where(F.col("n") == k).select("origin", F.col("key").alias("line"))
            front = front.join(line, "origin", "left").where(F.col("line").isNull() | (key() <= F.col("line"))).drop("line")
        t, p = profile.add_columns(F.col("t"), F.col("p"), F.col("td"), F.col("pref"))
        new = front.join(step, front["node"] == step["src"]).select(
            "origin", F.col("dst").alias("node"), t.alias("td"), p.alias("pref"), (F.col("len_m") + F.col("l")).alias("len_m"), (F.col("hops") + 1).alias("hops"),
            F.col("src").alias("prev"), (F.concat("path", F.array("edge")) if paths else F.col("path")).alias("path"), F.lit(n).alias("round"),
        )
        if limit is not None:
            new = new.where(key()["k1"] <= limit)
        order = F.struct(key().alias("key"), "hops", "prev", "path")
        least = labels.unionByName(new).groupBy("origin", "node").agg(F.min_by(F.struct("td", "pref", "len_m", "hops", "prev", "path", "round"), order).alias("b"))
        labels = rounds.write(least.select("origin", "node", "b.*"))
        if not labels.where(F.col("round") == n).limit(1).count():
            break
    out = labels.select("origin", "node", "td", "pref", "len_m", "hops", "path")
    if wanted is None:
        return out
    out = out.join(wanted, "node", "left_semi").select("origin", "node", "td", "pref", "len_m", "hops", "path")
    if k is not None:
        order = Window.partitionBy("origin").orderBy(key(), "node")
        out = out.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
    return out


def _folded(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels, of paths that are listed, with what is along their edges, and without the lists."""
    each = labels.select("origin", "node", F.posexplode("path").alias("pos", "edge")).join(edges.select("edge", "src", "dst", F.col("td").alias("t"), F.col("len_m").alias("l")), "edge")
    sums = each.groupBy("origin", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"), F.sum("l").alias("l"), F.min_by("src", "pos").alias("first"), F.max_by("dst", "pos").alias("last"))
    found = zip(ALONG, ("n", "t", "l", "first", "last"), (F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0), F.col("origin"), F.col("origin")), strict=True)
    out = labels.join(sums, ["origin", "node"], "left")
    return out.select(*_NAMES[:-1], F.expr("cast(array() as array<bigint>)").alias("path"), *(F.coalesce(F.col(c), none).alias(name) for name, c, none in found))


def _labels(
    edges: DataFrame, origins: DataFrame, profile: Profile, limit: float | None, targets: DataFrame | None, k: int | None, strategy: str, paths: bool, along: bool = False
) -> DataFrame:
    most = MAX_LOCAL_EDGES if targets is None or limit is not None else MAX_ARRAY_EDGES
    if _strategy(edges, strategy, most) == "local":
        return _local(edges, origins, profile, limit, targets, k, paths, along)
    out = _relax(edges, origins, profile, limit, targets, k, paths or along)
    return _folded(out, edges) if along else out


def within_threshold(edges: DataFrame, origins: DataFrame, limit: float, profile: Profile = SCALAR, strategy: str = "auto") -> DataFrame:
    """origin, cell, td, pref of every cell whose cost from an origin is at most limit.

    origins has a column cell.  An origin reaches itself, whether or not the network has it.
    """
    if not (limit > 0 and limit < float("inf")):
        raise InvalidArgument("the limit must be a positive number")
    out = _labels(edges, origins, profile, float(limit), None, None, strategy, False)
    return out.select("origin", F.col("node").alias("cell"), "td", "pref")


def reached_cells(reached: DataFrame, profile: Profile = SCALAR, fold: Column | None = None) -> DataFrame:
    """cell, td, pref: within_threshold() of many origins, folded by the least cost, or by another aggregate."""
    if fold is not None:
        return reached.groupBy("cell").agg(fold)
    key = profile.key_column(F.col("td"), F.col("pref"))
    out = reached.groupBy("cell").agg(F.min_by(F.struct("td", "pref"), F.struct(key.alias("key"), "origin")).alias("b"))
    return out.select("cell", "b.td", "b.pref")


def nearest_nodes(edges: DataFrame, cells: DataFrame, lattice: Lattice, gap: int) -> DataFrame:
    """cell, node, k, is_origin, is_destination: all nodes of the nearest ring that has any, at most gap away."""
    disk = lattice.disk(cells.select("cell").where("cell is not null").distinct(), "cell", gap, "node", "k")
    # not left to Spark's estimates, which know nothing of a disk's size and would send all of it to the driver
    found = disk.join(g.nodes(edges).withColumnRenamed("cell", "node").hint("shuffle_hash"), "node")
    near = Window.partitionBy("cell").orderBy("k")
    return found.withColumn("n", F.rank().over(near)).where("n = 1").select("cell", "node", "k", "is_origin", "is_destination")


def substitutes(edges: DataFrame, origins: DataFrame, destinations: DataFrame, options: Options, lattice: Lattice | None) -> tuple[DataFrame, DataFrame]:
    """(requested, node) of origins and of destinations: the cells of the network that stand for those asked for.

    An origin's is the nearest that is one; a destination's the nearest that is one, or a node that stands
    for an origin here.  Ties go to the smaller cell.
    """
    def near(cells: DataFrame) -> DataFrame:
        if options.gap and lattice is None:
            raise InvalidArgument("a gap needs a lattice")
        if not options.gap:
            known = g.nodes(edges).withColumn("node", F.col("cell"))
            return known.join(cells.select("cell").distinct(), "cell", "left_semi")
        return nearest_nodes(edges, cells, lattice, options.gap)

    first = Window.partitionBy("cell").orderBy("node")
    pick = lambda df: df.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("cell").alias("requested"), "node")
    starts = pick(near(origins).where("is_origin"))
    ends = near(destinations)
    own = starts.select("node").distinct().withColumn("__own", F.lit(True))
    ends = pick(ends.join(own, "node", "left").where("is_destination or __own"))
    return starts, ends


def shortest_paths(
    edges: DataFrame, origins: DataFrame, destinations: DataFrame, options: Options = Options(), profile: Profile = SCALAR, lattice: Lattice | None = None
) -> DataFrame:
    """origin, destination, start_cell, end_cell, td, pref, length_m, hops, edges of the best path to each of the k nearest destinations.

    origins and destinations have a column cell.  k counts cells of the network, of which each may stand
    for several destinations.  An origin that is a destination has an empty path to itself.  Origins that
    reach nothing have no row.  DestinationsNotInGraph is raised if no destination has a cell of the network.
    """
    edges, by = _narrow(edges, options, profile)
    found = by and _passed(edges, origins, destinations, options, by, lattice)
    if found is not None:
        return found
    starts, ends = substitutes(edges, origins, destinations, options, lattice)
    if not starts.limit(1).count():
        k = None
    elif not ends.limit(1).count():
        raise DestinationsNotInGraph("no destination is near a cell of the network")
    k = options.k or None
    labels = _labels(edges, starts.select(F.col("node").alias("cell")), profile, None, ends.select(F.col("node").alias("cell")), k, options.strategy, options.paths and not options.along, options.along)
    more = ALONG if options.along else ()
    if not options.gap:  # every cell stands for itself
        return labels.select(
            "origin", F.col("node").alias("destination"), F.col("origin").alias("start_cell"), F.col("node").alias("end_cell"), "td", "pref", F.col("len_m").alias("length_m"), "hops", F.col("path").alias("edges"), *more
        )
    # labels are as many as origins times destinations, which Spark's estimates don't know: the other side is built, in parts
    starts, ends = starts.hint("shuffle_hash"), ends.hint("shuffle_hash")
    out = labels.join(starts.select(F.col("requested").alias("origin_cell"), F.col("node").alias("s")), labels["origin"] == F.col("s"))
    out = out.join(ends.select(F.col("requested").alias("destination"), F.col("node").alias("e")), out["node"] == F.col("e"))
    return out.select(
        F.col("origin_cell").alias("origin"), "destination", F.col("s").alias("start_cell"), F.col("e").alias("end_cell"), "td", "pref", F.col("len_m").alias("length_m"), "hops", F.col("path").alias("edges"), *more
    )


def every_cost(edges: DataFrame, options: Options, profile: Profile) -> bool:
    """Whether costs of all pairs are found cell by cell."""
    return _plain(options) and strip.scale(edges, profile) is not None


def _plain(options: Options) -> bool:
    return options.strategy == "auto" and not options.k and (options.along or not options.paths)


def _narrow(edges: DataFrame, options: Options, profile: Profile) -> tuple[DataFrame, strip.Scale | None]:
    """The edges, and how costs of all pairs are found cell by cell, if the network is narrow and paths needn't be listed."""
    if not _plain(options):
        return edges, None
    edges = Rounds(edges.sparkSession).write(edges)  # read several times
    return edges, strip.scale(edges, profile)


def _stand(edges: DataFrame, origins: DataFrame, destinations: DataFrame, options: Options, lattice: Lattice | None) -> tuple[DataFrame, DataFrame]:
    """substitutes(); without a gap, cells that stand for themselves, of which those of the network are chosen later."""
    if options.gap:
        return substitutes(edges, origins, destinations, options, lattice)
    starts, ends = (df.select(F.col("cell").alias("requested"), F.col("cell").alias("node")).where("node is not null").distinct() for df in (origins, destinations))
    return starts, ends


def _passed(edges: DataFrame, origins: DataFrame, destinations: DataFrame, options: Options, by: strip.Scale, lattice: Lattice | None) -> DataFrame | None:
    """Rows of shortest_paths(): each value sums td and counts edges along a path, so what is along it follows."""
    starts, ends = _stand(edges, origins, destinations, options, lattice)
    more, far = ["pref"] if by.profile.standard else [], ["start_cell", "end_cell"] if options.gap else []
    out = strip.costs(edges, starts, ends, by, not options.gap, ["origin", "destination", *far, "td", *more, "hops"])
    if out is None:
        return None
    first, last = (F.col(a if options.gap else b) for a, b in (("start_cell", "origin"), ("end_cell", "destination")))
    length = F.col("hops") * F.lit(by.length)
    along = F.col("hops").cast("long"), F.col("td") - by.profile.zero[0], length, first, last
    return out.select(
        "origin", "destination", first.alias("start_cell"), last.alias("end_cell"), "td", F.col("pref") if more else F.lit(0.0).alias("pref"), length.alias("length_m"), "hops",
        F.expr("cast(array() as array<bigint>)").alias("edges"), *(c.alias(name) for name, c in zip(ALONG, along, strict=True) if options.along),
    )


def summaries(edges: DataFrame, origins: DataFrame, destinations: DataFrame, options: Options, profile: Profile, lattice: Lattice | None = None) -> DataFrame | None:
    """strip.SUMMARY of the paths of each origin, folded where they are found; None where that can't be."""
    edges, by = _narrow(edges, options, profile)
    if by is None:
        return None
    return strip.summaries(edges, *_stand(edges, origins, destinations, options, lattice), by, not options.gap)


def ordered(paths: DataFrame, profile: Profile = SCALAR) -> DataFrame:
    """Paths in the order of cost, first cell, last cell."""
    return paths.orderBy(profile.key_column(F.col("td"), F.col("pref")), "start_cell", "end_cell", "origin", "destination")


def path_cells(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The paths with a column cells: the cells passed, from start to end."""
    each = paths.select("origin", "destination", F.posexplode("edges").alias("pos", "edge")).join(edges.select("edge", "dst"), "edge")
    passed = each.groupBy("origin", "destination").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("s"))
    out = paths.join(passed, ["origin", "destination"], "left")
    rest = F.coalesce(F.col("s.dst"), F.expr("cast(array() as array<bigint>)"))
    return out.withColumn("cells", F.concat(F.array("start_cell"), rest)).drop("s")


_LINE = "origin long, node long, td double, len_m double, hops int, wkb binary"


def lines(
    edges: DataFrame, origins: DataFrame, destinations: DataFrame, centre: Callable[[Column], tuple[Column, Column]], options: Options = Options(), profile: Profile = SCALAR,
    lattice: Lattice | None = None, smoothen: bool = True,
) -> DataFrame:
    """shortest_paths() with an edge, with their line as wkb instead of their edges; centre gives a cell's place.

    The k nearest of many origins are found in one search, and drawn where their cells are followed; else paths are listed first.
    """
    if options.k and not options.gap and not profile.standard and _strategy(edges, options.strategy, MAX_ARRAY_EDGES) == "local":
        found = _drawn(edges, *substitutes(edges, origins, destinations, options, lattice), centre, options.k, smoothen)
        if found is not None:
            return found.select(
                "origin", F.col("node").alias("destination"), F.col("origin").alias("start_cell"), F.col("node").alias("end_cell"), "td", F.lit(0.0).alias("pref"), F.col("len_m").alias("length_m"), "hops", "wkb"
            )
    found = path_cells(shortest_paths(edges, origins, destinations, replace(options, paths=True, along=False), profile, lattice).where("hops > 0"), edges)
    return geo.route_wkb(found, centre, smoothen).drop("edges", "cells")


def _drawn(edges: DataFrame, starts: DataFrame, ends: DataFrame, centre: Callable[[Column], tuple[Column, Column]], k: int, smoothen: bool) -> DataFrame | None:
    """Lines of the paths to the k nearest, of starts and ends that are cells of the network; None where one search doesn't find them."""
    spark, sc = edges.sparkSession, edges.sparkSession.sparkContext
    ship(spark)
    n, low, high = edges.agg(F.count(F.lit(1)), F.min("len_m"), F.max("len_m")).first()
    if n > MAX_ARRAY_EDGES or not n or low != high:
        return None
    # each edge the other way round
    net = Network.plain(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "td").toArrow(), low)
    to, of = (net.places(df.select("node").distinct().toArrow().column("node").to_numpy()) for df in (ends, starts))
    if not net.exact() or not len(to) or len(of) <= 32 * k:
        return None
    search, known = sc.broadcast((net, to, min(k, len(to)))), net.cells
    del net

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(len(b) for b in batches):
            f = Forest.grown(*search.value)
            every = [pa.array(x) for x in (f.node, f.then, f.target, f.td, f.hops)]
            for a in range(0, len(f.node), ROWS_AT_ONCE):
                yield pa.record_batch([x.slice(a, ROWS_AT_ONCE) for x in every], names=["node", "then", "target", "td", "hops"])

    # at most k labels for each cell of a network that was counted
    labels = spark.range(0, 1, 1, 1).mapInArrow(grow, "node int, then int, target int, td double, hops int").toArrow()
    forest = Forest(*(labels.column(c).to_numpy() for c in ("node", "then", "target", "td", "hops")))
    search.unpersist()
    cells = spark.createDataFrame(pa.table({"cell": known}))
    x, y = centre(F.col("cell"))
    at = cells.select("cell", x.cast("double").alias("x"), y.cast("double").alias("y")).toArrow().sort_by("cell")
    own = np.flatnonzero(np.isin(forest.node, of) & (forest.hops > 0))
    own = own[np.argsort(-forest.hops[own], kind="stable")]
    parts = max(1, min(len(own), max(4 * sc.defaultParallelism, int(forest.hops[own].sum(dtype=np.int64)) // EDGES_OF_A_TASK)))
    shared = sc.broadcast((forest, own, known, np.stack([at.column(c).to_numpy() for c in "xy"], 1), float(low)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, own, cells, places, length = shared.value
        for part in (p for b in batches for p in b.column(0).to_pylist()):
            mine = own[part::parts]
            for some in _cut(mine, forest.hops[mine], EDGES_FOLLOWED):
                passed, begin = forest.passed(some), 0
                for few in _cut(some, forest.hops[some], EDGES_AT_ONCE // 2):
                    lens = forest.hops[few].astype(np.int64) + 1
                    points = places[passed[begin : begin + lens.sum()]]
                    begin += lens.sum()
                    columns = cells[forest.node[few]], cells[forest.target[few]], forest.td[few], forest.hops[few] * length, forest.hops[few]
                    yield pa.record_batch([*map(pa.array, columns), geo.wkb_lines_of(points, lens, smoothen)], names=["origin", "node", "td", "len_m", "hops", "wkb"])

    return spark.range(0, parts, 1, parts).mapInArrow(draw, _LINE)


def _cut(rows: np.ndarray, hops: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """rows in runs of at most so many edges, or of one row, and of at most ROWS_AT_ONCE."""
    ends, a = np.cumsum(hops, dtype=np.int64), 0
    while a < len(rows):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right"))
        b = max(a + 1, min(b, a + ROWS_AT_ONCE))
        yield rows[a:b]
        a = b
