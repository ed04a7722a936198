import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hexnet.errors import InvalidArgument, NotFound, UnidentifiedFileFormat, UnsupportedResolution
from hexnet.functions.lattice import Lattice
from hexnet.operators import contract
from hexnet.operators import graph as g
from hexnet.operators.routing import Options
from hexnet.plans.engine import Engine
from hexnet.sources import datasets, graphs, osm
from hexnet.sources.config import Config
from hexnet.sources.datasets import Dataset
from hexnet.sources.graphs import GraphKey
from hexnet.streaming import updates

GRID = Lattice(64, 500.0)


def lattice(res):
    return Lattice(64 * 2 ** (res - 8), 500.0 * 2 ** (8 - res))


def parent(c, res):
    for r in range(8, res, -1):
        c = lattice(r).parent(c)
    return c


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("root"))
    edges = [(r * 64 + q, r * 64 + q + d) for r in range(6) for q in range(10) for d in (1, 64)]
    df = spark.createDataFrame([(a * 10**6 + b, a, b, float(10 + a % 7), 3.0, 1.0) for a, b in edges + [(b, a) for a, b in edges]], "edge long, src long, dst long, td double, pref double, len_m double")
    config = Config.of({"root": root, "datasets": {"people": {"path": "people", "resolutions": {8: 6}}}, "routing_modes": {"better": {"edge_preference_factor": 0.8}, "exact": None}})
    people = spark.createDataFrame([(c, float(c)) for c in range(0, 330, 2)], "h3index long, people double")
    config.datasets["people"].write(people, lambda c: parent(c, 6), 8)
    e = Engine(spark, config, lattice, parent)
    e.save_graph(GraphKey("roads", 8), g.build(df))
    e.save_graph(GraphKey("roads", 7), g.downsample_lattice(df, lattice(8)))
    return e


def cells(spark, *c):
    return spark.createDataFrame([(x,) for x in c], "cell long")


def test_catalog(engine):
    assert engine.list_graphs() == [GraphKey("roads", 7), GraphKey("roads", 8)] and engine.list_datasets() == ["people"] and engine.version()
    with pytest.raises(NotFound):
        engine.graph(GraphKey("rivers", 8))


def test_shortest_path_requests(engine, spark):
    key, o, d = GraphKey("roads", 8), cells(spark, 0, 2, None), cells(spark, 260, 200)
    rows = engine.shortest_path(key, o, d, Options(), origin_dataset="people", destination_dataset="people").collect()
    assert rows and set(rows[0].asDict()) == {"h3index_cell_origin", "h3index_cell_destination", "path_length_meters", "travel_duration_secs", "edge_preference", "origin_people", "dest_people"}
    assert all(r.origin_people == r.h3index_cell_origin for r in rows)
    edges = {(r.origin_cell, r.destination_cell): r.h3indexes for r in engine.shortest_path_edges(key, o, d, Options()).collect()}
    passed = {(r.origin_cell, r.destination_cell): r.h3indexes for r in engine.shortest_path_cells(key, o, d, Options()).collect()}
    assert all(passed[x] == [x[0], *(e % 10**6 for e in edges[x])] and passed[x][-1] == x[1] for x in edges)
    assert engine.shortest_path_routes(key, o, d, Options()).where("wkb is null").count() == 0
    assert engine.shortest_path(key, o, d, Options(), "better").count() == len(rows)
    with pytest.raises(InvalidArgument):
        engine.shortest_path(key, o, d, Options(), "unknown")


def test_threshold_request(engine, spark):
    rows = engine.cells_within_threshold(GraphKey("roads", 8), cells(spark, 0), 40, origin_dataset="people").collect()
    assert rows and all(r.h3index_cell_origin % 2 == 0 and r.travel_duration_secs <= 40 for r in rows)


def test_differential_request(engine, spark):
    key = GraphKey("roads", 8)
    origins, ends, closed = cells(spark, *range(0, 10, 2)), cells(spark, 324, 4), cells(spark, 130, 132, 134)
    name, stats = engine.differential_shortest_path(key, "people", closed, origins, ends, Options(k=2), store=True)
    assert stats.count() == 5 and engine.load_result(name).count() == 5
    routes = engine.result_routes(name, cells(spark, 0))
    assert {(r.with_disturbance, r.phase) for r in routes.collect()} == {(0, "before"), (1, "after")}
    none, fewer = engine.differential_shortest_path(key, "people", closed, origins, ends, Options(k=2), preroute=True)
    assert none is None and fewer.count() <= 5
    with pytest.raises(InvalidArgument):
        engine.load_result("../x")


def test_dataset_reads_only_the_folders_needed(engine, spark):
    d = engine.config.datasets["people"]
    got = d.read(spark, 8, cells(spark, 0, 2, 3, 10_000), lambda c: parent(c, 6))
    assert sorted(r.h3index for r in got.collect()) == [0, 2]
    assert "PartitionFilters: [" in (plan := got._jdf.queryExecution().toString()) and "dynamicpruning" in plan.lower() or "file_cell" in plan
    with pytest.raises(UnsupportedResolution):
        d.read(spark, 9)


def test_names_and_formats():
    assert GraphKey.parse("somegraph_7.ipc") == GraphKey("somegraph", 7) and str(GraphKey("a_b", 9)) == "a_b_9"
    for bad in ("nothing", "x_99"):
        with pytest.raises(InvalidArgument):
            GraphKey.parse(bad)
    assert datasets.format_of(" x.Arrow ") == "ipc" and datasets.format_of("a/b.parquet") == "parquet"
    for bad in ("x.tiff", "x"):
        with pytest.raises(UnidentifiedFileFormat):
            datasets.format_of(bad)
    assert datasets.key_of("p/{ file_h3_resolution }/{data_h3_resolution}/{ h3cell}.arrow", data_h3_resolution=10, file_h3_resolution=5, h3cell="ab") == "p/5/10/ab.arrow"
    with pytest.raises(InvalidArgument):
        Config.of({"routing_modes": {"x": {"edge_preference_factor": -1.0}}})


def test_graph_with_shortcuts_survives_writing(spark, tmp_path):
    edges = g.build(spark.createDataFrame([(k, k, k + 1, 2.0, 1.0) for k in range(12)], "edge long, src long, dst long, td double, pref double"))
    done = contract.contract(edges, 3)
    graphs.write(done, f"{tmp_path}/g_5.parquet")
    back = graphs.read(spark, f"{tmp_path}/g_5.parquet")
    key = lambda df: sorted((r.edge, r.td, len(r.ff.edges) if r.ff else 0) for r in df.collect())
    assert key(back) == key(done)


def test_arrow_files(spark, tmp_path):
    t = pa.table({"h3index": pa.array([1, 2, 3], pa.uint64()), "x": [1.5, None, 2.5]})
    for name, new in (("a.arrow", pa.ipc.new_file), ("b.arrow", pa.ipc.new_stream)):
        sink = io.BytesIO()
        with new(sink, t.schema) as w:
            w.write_table(t)
        (tmp_path / name).write_bytes(sink.getvalue())
    got = graphs.read_ipc(spark, f"{tmp_path}/*.arrow", "h3index long, x double, missing string")
    assert sorted((r.h3index, r.x, r.missing) for r in got.collect() if r.x) == [(1, 1.5, None)] * 2 + [(3, 2.5, None)] * 2
    d = Dataset(str(tmp_path), {10: 5}, key_pattern="{h3cell}.arrow", schema="h3index long, x double")
    assert d.read(spark, 10, cells(spark, 2)).count() == 2


def test_chunks(spark):
    df = spark.range(7001).select("id", (F.col("id") * 2).alias("b"))
    chunks = list(graphs.to_ipc_chunks(df))
    assert [len(pa.ipc.open_file(c).read_all()) for c in chunks] == [3000, 3000, 1001]
    assert graphs.concat_chunks(iter(chunks)).num_rows == 7001 and graphs.concat_chunks(graphs.to_ipc_chunks(df.limit(0))) is None


def test_graph_from_ways(spark):
    x = lambda q, r: ((q + r / 2) * GRID.length_m(), r * GRID.size * 1.5)
    at = {k: x(k, 2) for k in range(12)}
    nodes = spark.createDataFrame([(k, *p) for k, p in at.items()], "id long, x double, y double")
    ways = spark.createDataFrame([(1, list(range(9)), {"highway": "primary", "maxspeed": "36"}), (2, [8, 9, 99, 10], {"highway": "road", "oneway": "yes", "maxspeed": "40"}), (3, [0, 11], {"waterway": "river"}), (4, [5], {"highway": "road"})], "id long, nodes array<long>, tags map<string,string>")
    edges = osm.build_graph(nodes, ways, GRID, "car", 5)
    got = {(r.src, r.dst): r for r in edges.collect()}
    row = 2 * 64
    assert (row, row + 1) in got and (row + 1, row) in got and (row + 8, row + 9) in got and (row + 9, row + 8) not in got and len(got) == 18
    assert abs(got[row, row + 1].td - GRID.length_m() / 10) < 1e-9 and got[row, row + 1].pref == 3.0
    assert sum(r.ff is not None for r in got.values()) >= 1


def test_streamed_updates(spark, tmp_path):
    base = f"{tmp_path}/net"
    edges = g.build(spark.createDataFrame([(1, 1, 2, 5.0, 1.0), (2, 2, 3, 5.0, 1.0)], "edge long, src long, dst long, td double, pref double"))
    edges.write.parquet(f"{base}/v=-1")
    rows = [(1, 1, 2, 7.0, 1.0, 1.0, "2024-01-01 00:00:00"), (1, 1, 2, 9.0, 1.0, 1.0, "2024-01-01 01:00:00"), (2, 2, 3, None, None, None, "2024-01-01 00:00:00"), (3, 3, 4, 1.0, 1.0, 1.0, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "edge long, src long, dst long, td double, pref double, len_m double, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(updates.UPDATE).parquet(f"{tmp_path}/in")
    updates.maintain(stream, base, f"{tmp_path}/cp").awaitTermination(60)
    now = spark.read.parquet(f"{base}/v={updates.current(spark, base)}")
    assert sorted((r.edge, r.td) for r in now.collect()) == [(1, 9.0), (3, 1.0)]
    q = updates.latest(stream).writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("means").where("edge = 1").agg(F.sum("n")).first()[0] == 2


def test_cells_of_requests_and_merged_resolutions(engine, spark):
    from hexnet.errors import MixedResolutions
    from hexnet.functions import bits

    base = 1 << 59 | 20 << 45
    cell = lambda res, *digits: base | res << 52 | sum(d << 3 * (14 - k) for k, d in enumerate(digits)) | (1 << 3 * (15 - res)) - 1
    e = Engine(spark, engine.config, cells_at=bits.distinct_at)
    got, _ = e.select(cells(spark, cell(2, 3, 4), cell(3, 3, 4, 0), cell(4, 3, 5, 1, 2), 17, None), GraphKey("roads", 3))
    assert {r.cell for r in got.collect()} == {cell(3, 3, 4, d) for d in range(7)} | {cell(3, 3, 5, 1)}
    one, two = (spark.createDataFrame([(1, cell(r, *range(r)), cell(r, *range(r)), 1.0, 0.0, 1.0)], "edge long, src long, dst long, td double, pref double, len_m double") for r in (3, 4))
    assert g.merge(one, one, resolution=bits.resolution).count() == 1
    with pytest.raises(MixedResolutions):
        g.merge(one, two, resolution=bits.resolution)


def test_costs_without_paths(engine, spark):
    from hexnet.operators import routing

    edges = engine.graph(GraphKey("roads", 8))
    for strategy in ("local", "relax"):
        full, slim = (routing.shortest_paths(edges, cells(spark, 0, 2), cells(spark, 260, 200), Options(strategy=strategy, paths=p)).select("origin", "destination", "td", "hops", "edges").collect() for p in (True, False))
        assert sorted(r[:4] for r in full) == sorted(r[:4] for r in slim) and not any(r.edges for r in slim) and all(len(r.edges) == r.hops for r in full)
