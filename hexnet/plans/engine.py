"""The engine: networks, datasets and results of a store, and the analytic requests over them."""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..errors import InvalidArgument, NotFound
from ..functions import geo, weights
from ..functions.lattice import Lattice
from ..operators import differential, enrich, routing
from ..sources import graphs
from ..sources.config import Config
from ..sources.graphs import GraphKey


class Engine:
    """lattice: of a resolution's cells; parent(column, resolution): of cells, for datasets by coarse cell;
    cells_at(frame, column, resolution): the distinct valid cells of a request's at the network's resolution (for H3 ids
    ``bits.distinct_at``; without it, requests must bring cells of that resolution).
    """

    def __init__(
        self, spark: SparkSession, config: Config, lattice: Callable[[int], Lattice] | None = None, parent: Callable[[Column, int], Column] | None = None,
        cells_at: Callable[[DataFrame, str, int], DataFrame] | None = None,
    ):
        self.spark, self.config, self.lattice, self.parent, self.cells_at = spark, config, lattice, parent, cells_at
        self._graphs: OrderedDict[GraphKey, DataFrame] = OrderedDict()

    # ------------------------------------------------------------ catalog

    def version(self) -> str:
        return __version__

    def list_graphs(self) -> list[GraphKey]:
        return graphs.list_graphs(self.spark, f"{self.config.root}/{self.config.graphs_prefix}")

    def list_datasets(self) -> list[str]:
        return sorted(self.config.datasets)

    def save_graph(self, key: GraphKey, edges: DataFrame) -> None:
        graphs.write(edges, f"{self.config.root}/{self.config.graphs_prefix}{key}.parquet")
        if key in self._graphs:
            self._graphs.pop(key).unpersist()

    def graph(self, key: GraphKey) -> DataFrame:
        """The network, kept for later requests; beyond cache_size the one that was used longest ago is let go."""
        if key in self._graphs:
            self._graphs.move_to_end(key)
            return self._graphs[key]
        if key not in self.list_graphs():
            raise NotFound(f"no network {key}")
        edges = graphs.read(self.spark, f"{self.config.root}/{self.config.graphs_prefix}{key}.parquet").persist()
        self._graphs[key] = edges
        while len(self._graphs) > max(1, self.config.cache_size):
            self._graphs.popitem(last=False)[1].unpersist()
        return edges

    def select(self, cells: DataFrame, key: GraphKey, dataset: str | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Distinct cells of the network's resolution, without nulls and invalid ones; of a dataset: those it has, and its rows for them."""
        cells = cells.select(F.col("cell").cast("long").alias("cell")).where("cell is not null")
        cells = self.cells_at(cells, "cell", key.resolution) if self.cells_at else cells.distinct()
        if dataset is None:
            return cells, None
        if dataset not in self.config.datasets:
            raise NotFound(f"no dataset {dataset!r}")
        d = self.config.datasets[dataset]
        up = (lambda c: self.parent(c, d.file_resolution(key.resolution))) if self.parent else None
        rows = d.read(self.spark, key.resolution, cells, up)
        return enrich.members(cells, rows, d.cell_column), rows.withColumnRenamed(d.cell_column, "__cell")

    # ------------------------------------------------------------ requests

    def _setup(self, key: GraphKey, mode: str) -> tuple[DataFrame, weights.Profile, Lattice | None]:
        return self.graph(key), weights.mode(self.config.modes, mode), self.lattice(key.resolution) if self.lattice else None

    def _paths(self, key: GraphKey, origins, destinations, options, mode, origin_data, destination_data):
        edges, profile, lattice = self._setup(key, mode)
        origins, od = self.select(origins, key, origin_data)
        destinations, dd = self.select(destinations, key, destination_data)
        return routing.shortest_paths(edges, origins, destinations, options, profile, lattice), edges, profile, lattice, od, dd

    def shortest_path(
        self, key: GraphKey, origins: DataFrame, destinations: DataFrame, options: routing.Options = routing.Options(k=3, gap=1), mode: str = "",
        origin_dataset: str | None = None, destination_dataset: str | None = None,
    ) -> DataFrame:
        """A row for each path: cells, length, duration and preference, with the columns of the datasets."""
        paths, _, _, _, od, dd = self._paths(key, origins, destinations, options, mode, origin_dataset, destination_dataset)
        out = paths.select(
            F.col("origin").alias("h3index_cell_origin"), F.col("destination").alias("h3index_cell_destination"), F.col("length_m").alias("path_length_meters"),
            F.col("td").cast("float").alias("travel_duration_secs"), F.col("pref").cast("float").alias("edge_preference"),
        )
        if od is not None:
            out = enrich.enrich(out, "h3index_cell_origin", od, "__cell", "origin_")
        if dd is not None:
            out = enrich.enrich(out, "h3index_cell_destination", dd, "__cell", "dest_")
        return out

    def shortest_path_edges(self, key: GraphKey, origins: DataFrame, destinations: DataFrame, options: routing.Options = routing.Options(k=3, gap=1), mode: str = "") -> DataFrame:
        return self._route(self._paths(key, origins, destinations, options, mode, None, None)[0], F.col("edges").alias("h3indexes"))

    def shortest_path_cells(self, key: GraphKey, origins: DataFrame, destinations: DataFrame, options: routing.Options = routing.Options(k=3, gap=1), mode: str = "") -> DataFrame:
        paths, edges, *_ = self._paths(key, origins, destinations, options, mode, None, None)
        return self._route(routing.path_cells(paths, edges), F.col("cells").alias("h3indexes"))

    def shortest_path_routes(self, key: GraphKey, origins: DataFrame, destinations: DataFrame, options: routing.Options = routing.Options(k=3, gap=1), mode: str = "", smoothen: bool = True) -> DataFrame:
        paths, edges, _, lattice, *_ = self._paths(key, origins, destinations, options, mode, None, None)
        if lattice is None:
            raise InvalidArgument("routes need a lattice")
        return self._route(geo.route_wkb(routing.path_cells(paths, edges), lattice.centre, smoothen), F.col("wkb"))

    @staticmethod
    def _route(paths: DataFrame, *more: Column) -> DataFrame:
        keep = [F.col("phase")] if "phase" in paths.columns else []
        return paths.select(
            F.col("origin").alias("origin_cell"), F.col("destination").alias("destination_cell"), F.col("td").alias("travel_duration_secs"),
            F.col("pref").alias("edge_preference"), F.col("length_m").alias("path_length_m"), *more, *keep,
        )

    def cells_within_threshold(self, key: GraphKey, origins: DataFrame, seconds: float, mode: str = "", origin_dataset: str | None = None, strategy: str = "auto") -> DataFrame:
        """The cells reached, with their least cost.

        The key column is named after origins, and a dataset's columns are joined to the cells reached, so
        that cells outside the dataset go: what callers of this request expect.
        """
        edges, profile, _ = self._setup(key, mode)
        origins, data = self.select(origins, key, origin_dataset)
        reached = routing.reached_cells(routing.within_threshold(edges, origins, seconds, profile, strategy), profile)
        out = reached.select(F.col("cell").alias("h3index_cell_origin"), F.col("td").cast("float").alias("travel_duration_secs"), F.col("pref").cast("float").alias("edge_preference"))
        return out if data is None else enrich.enrich(out, "h3index_cell_origin", data, "__cell", "origin_")

    def differential_shortest_path(
        self, key: GraphKey, reference: str, closed: DataFrame, origins: DataFrame, destinations: DataFrame, options: routing.Options = routing.Options(k=3, gap=1),
        preroute: bool = False, store: bool = False,
    ) -> tuple[str | None, DataFrame]:
        """(id if stored, statistics for each origin with the reference dataset's columns)."""
        edges, _, lattice = self._setup(key, "")
        origins, data = self.select(origins, key, reference)
        destinations, _ = self.select(destinations, key)
        closed, _ = self.select(closed, key)
        if preroute:
            origins = differential.preroute(self._coarser(key), closed, origins, destinations, lattice, options)
        paths = differential.differential_paths(edges, closed, origins, destinations, options, weights.STANDARD, lattice)
        stats = enrich.enrich(differential.statistics(paths), "h3index_origin", data, "__cell")
        if not store:
            return None, stats
        name = uuid.uuid4().hex
        folder = self._output(name)
        paths.withColumn("graph", F.lit(str(key))).write.option("compression", "zstd").parquet(f"{folder}/paths")
        stats.write.option("compression", "zstd").parquet(f"{folder}/statistics")
        return name, self.load_result(name)

    def _coarser(self, key: GraphKey) -> DataFrame:
        """The network of the same name at the nearest coarser resolution."""
        there = {k.resolution for k in self.list_graphs() if k.name == key.name}
        for r in range(key.resolution - 1, key.resolution - 1 - differential.COARSER, -1):
            if r in there:
                return self.graph(GraphKey(key.name, r))
        raise InvalidArgument(f"no coarser network of {key.name!r}")

    def _output(self, name: str) -> str:
        if not re.fullmatch(r"[0-9a-f]{32}", name):
            raise InvalidArgument(f"{name!r} isn't a result's id")
        return f"{self.config.root}/{self.config.outputs_prefix}{name}"

    def load_result(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._output(name)}/statistics")

    def result_routes(self, name: str, cells: DataFrame | None = None, smoothen: bool = True) -> DataFrame:
        """The stored paths, of the origins given: routes with phase "before" or "after" (with_disturbance 0 or 1)."""
        paths = self.spark.read.parquet(f"{self._output(name)}/paths")
        key = GraphKey.parse(paths.select("graph").limit(1).collect()[0][0])
        if cells is not None:
            paths = enrich.members(paths, cells, "cell", "origin")
        out = routing.path_cells(paths.where("phase = 'before'"), self.graph(key)).unionByName(routing.path_cells(paths.where("phase = 'after'"), self.graph(key)))
        lines = geo.route_wkb(out, self.lattice(key.resolution).centre, smoothen)
        return self._route(lines, F.col("wkb")).withColumn("with_disturbance", (F.col("phase") == "after").cast("int"))

    def views(self, key: GraphKey, prefix: str = "") -> None:
        """Temporary views of a network's edges and nodes, for SQL."""
        from ..operators.graph import nodes

        self.graph(key).createOrReplaceTempView(f"{prefix}edges")
        nodes(self.graph(key)).createOrReplaceTempView(f"{prefix}nodes")
