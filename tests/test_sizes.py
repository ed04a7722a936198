"""What is sent to the driver, and searches of many origins at once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hexnet.functions import geo
from hexnet.functions.lattice import Lattice
from hexnet.functions.weights import SCALAR, STANDARD, Profile
from hexnet.operators import graph as g
from hexnet.operators import routing, search
from hexnet.plans import queries


def net(spark, edges):
    return g.build(spark.createDataFrame([(a * 10_000 + b, a, b, float(t), float(p)) for a, b, t, p in edges], "edge long, src long, dst long, td double, pref double"))


def cells(spark, *c):
    return spark.createDataFrame([(x,) for x in c], "cell long")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_disk_is_not_broadcast(spark):
    # Spark takes a disk to be as small as the cells that it is made of
    few = spark.range(5).select(F.col("id").alias("cell"))
    wide = spark.range(3_000_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert "BroadcastHashJoin" not in plan(routing.nearest_nodes(wide, few, Lattice(64), 2))


def test_paths_are_not_broadcast(spark):
    # labels come from a search, of which Spark knows the size of what goes in
    edges = net(spark, [(k, k + 1, 10, 1) for k in range(70, 90)])
    for gap in (0, 1):
        found = routing.shortest_paths(edges, cells(spark, 70, 71), cells(spark, 80, 81, 82), routing.Options(gap=gap), lattice=Lattice(64))
        assert "BroadcastHashJoin" not in plan(found)
        assert found.count() == 6


def grid(seed, n=25, m=80):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(n) * 3, rnd.randrange(n) * 3, float(rnd.randint(seed % 3 != 0, 4)), float(rnd.choice([3, 4, 8])), float(rnd.choice([1, 2, 5]) if seed % 2 else 1)) for _ in range(m)]
    src, dst, td, pref, length = zip(*(r for r in rows if r[0] != r[1]), strict=True)
    return routing._Arrays(pa.table({"edge": pa.array(range(len(src)), pa.int64()), "src": src, "dst": dst, "td": td, "pref": pref, "len_m": length}))


@pytest.mark.parametrize("profile", [SCALAR, STANDARD, Profile(True, 0.8)], ids=["scalar", "standard", "mode"])
def test_many_origins_at_once_find_what_one_finds(monkeypatch, profile):
    for seed in range(40):
        monkeypatch.setattr(search, "LABELS_AT_ONCE", (1, 60, 4000)[seed % 3])
        monkeypatch.setattr(search, "EDGES_AT_ONCE", (3, 1000)[seed % 2])
        monkeypatch.setattr(search, "_LOOK", (1, 2, 32)[seed % 3])
        some = grid(seed)
        if not some.batched(profile):
            continue
        starts, ends = np.arange(5), np.arange(3, len(some.cells), 2)
        for k in (None, 1, 3):
            got, each = [], []
            for found in some.search_many(starts, profile, ends, k):
                if not profile.standard:
                    assert np.array_equal(found.sums(some.td), found.td)
                got += [tuple(r.values()) for b in found.batches(True) for r in b.to_pylist()]
            for o in some.cells[starts].tolist():
                each += [(o, *r) for r in some.search(o, profile, None, set(some.cells[ends].tolist()), k)]
            if profile.factor is None:
                whole = lambda rows: sorted((*r[:2], round(r[2], 9), round(r[3], 9), *r[4:6], tuple(map(int, r[6]))) for r in rows)
            else:  # equal products of different factors are settled by rounding
                whole = lambda rows: sorted((r[0], round(r[2] * r[3], 6)) for r in rows)
            assert whole(got) == whole(each), (seed, k)
            if k and profile is SCALAR and some.exact():
                o, t, td, hops = search.nearest(some.backwards(), starts, ends, k)
                assert sorted(zip(some.cells[o].tolist(), some.cells[t].tolist(), td.tolist(), hops.tolist(), strict=True)) == sorted((r[0], r[1], r[2], r[5]) for r in each)


def test_ties_of_the_nearest_go_to_the_smaller_cell(spark):
    # 9 is an edge away, 5 two, at the same cost
    edges = net(spark, [(1, 9, 4, 1), (1, 2, 2, 1), (2, 5, 2, 1)])
    for strategy in ("local", "relax"):
        got = routing.shortest_paths(edges, cells(spark, 1), cells(spark, 5, 9), routing.Options(k=1, strategy=strategy)).collect()
        assert [(r.destination, r.td) for r in got] == [(5, 4.0)]


def test_networks_too_large_for_lists_are_searched_as_arrays(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a round of joins for each edge of a path")

    monkeypatch.setattr(routing, "MAX_LOCAL_EDGES", 5)
    monkeypatch.setattr(routing, "_relax", never)
    edges = net(spark, [(k, k + 1, 10, 1) for k in range(70, 110)])
    for origins, ends, options, rows in (([70], [80, 81], {}, 2), ([70, 75], [80], {"paths": False}, 2), (range(70, 109), [90, 80, 100], {"paths": False, "k": 1}, 31)):
        found = routing.shortest_paths(edges, cells(spark, *origins), cells(spark, *ends), routing.Options(**options)).collect()
        assert len(found) == rows and all(r.td == 10 * r.hops == 10 * (r.destination - r.origin) for r in found)


@pytest.mark.parametrize("strategy", ["local", "relax"])
@pytest.mark.parametrize("profile", [SCALAR, STANDARD], ids=["scalar", "standard"])
def test_what_is_along_paths_is_what_their_lists_say(spark, strategy, profile):
    rnd = random.Random(4)
    rows = {(a, b): (a, b, rnd.randint(1, 9), rnd.choice([3, 4, 8])) for a, b in ((rnd.randrange(70, 95), rnd.randrange(70, 95)) for _ in range(90)) if a != b}
    edges = net(spark, rows.values())
    td = {r.edge: r.td for r in edges.collect()}
    find = lambda **o: routing.shortest_paths(edges, cells(spark, *range(70, 80)), cells(spark, *range(70, 95, 2)), routing.Options(strategy=strategy, **o), profile).collect()
    listed, folded = find(), {(r.origin, r.destination): r for r in find(along=True)}
    assert len(listed) == len(folded) > 50 and max(r.hops for r in listed) > 3
    for r in listed:
        got = folded[r.origin, r.destination]
        ends = (r.edges[0] // 10_000, r.edges[-1] % 10_000) if r.edges else (r.origin, r.origin)
        assert (got.edges_n, got.edges_td, got.edges_m, got.first_cell, got.last_cell) == (len(r.edges), sum(td[e] for e in r.edges), r.length_m, *ends)
        assert (got.td, got.hops, got.length_m, got.edges) == (r.td, r.hops, r.length_m, [])


def test_no_path_is_listed_for_sums_over_its_edges(spark, monkeypatch, tmp_path):
    # 40 paths of one origin share their edges: lists hold 820 of them, the tree 40
    edges = net(spark, [(k, k + 1, 10, 1) for k in range(70, 110)])
    listed = lambda **o: routing.shortest_paths(edges, cells(spark, 70), cells(spark, *range(71, 111)), routing.Options(**o)).selectExpr("sum(size(edges))").first()[0]
    assert (listed(), listed(along=True)) == (820, 0)
    for name in ("path_weight_fold", "path_cells", "path_edges_len"):
        seen = []
        monkeypatch.setattr(queries, "_paths", lambda *_, **o: seen.append(o) or (_ for _ in ()).throw(StopIteration))
        with pytest.raises(StopIteration):
            queries.QUERIES[name](spark, str(tmp_path))
        assert seen[0].get("along") and not seen[0].get("paths")


@pytest.mark.parametrize("k", [1, 3])
def test_paths_of_one_search_from_all_ends_are_those_from_each_start(k):
    for seed in range(1, 60):
        some = grid(seed * 2, 30, 120)  # edges of one length, many of equal cost
        starts, ends = np.arange(len(some.cells)), np.arange(3, len(some.cells), 4)
        forest = search.Forest.grown(some.backwards(), ends, k)
        own = np.flatnonzero(np.isin(forest.node, starts))
        own = own[np.argsort(-forest.hops[own], kind="stable")]
        passed = np.split(some.cells[forest.passed(own)], np.cumsum(forest.hops[own] + 1)[:-1])
        got = sorted((some.cells[forest.node[x]], some.cells[forest.target[x]], forest.td[x], forest.hops[x], p.tolist()) for x, p in zip(own, passed, strict=True))
        each = []
        for found in some.search_many(starts, SCALAR, ends, k):
            for b in found.batches(True):
                for r in b.to_pylist():
                    each.append((r["origin"], r["node"], r["td"], r["hops"], [r["origin"], *(int(some.cells[some.dst[some.edge == e][0]]) for e in r["path"])]))
        assert got == sorted(each) and len(got) > 10


@pytest.mark.parametrize("smoothen", [True, False])
def test_lines_at_once_are_those_one_by_one(smoothen):
    rnd, lattice = np.random.default_rng(3), Lattice(64)
    walks = [np.cumsum(rnd.choice([[1, 0], [0, 1], [-1, 1], [1, -1]], (n, 1) if n < 5 else n).reshape(-1, 2), axis=0) for n in (2, 3, 4, 50, 300, 2)]
    flat = [np.stack([(w[:, 0] + w[:, 1] / 2) * lattice.length_m(), w[:, 1] * 1.5], 1) for w in walks]
    bent = [np.stack([t, 1e-5 * np.sin(t * 3) * 4], 1) for t in (np.linspace(0, 9, 200),)]  # not as plain: corners about as wide as epsilon
    lines = flat + bent
    got = geo.wkb_lines_of(np.concatenate(lines), [len(x) for x in lines], smoothen).to_pylist()
    for line, wkb in zip(lines, got, strict=True):
        points = list(map(tuple, line.tolist()))
        whole = geo.chaikin(points) if smoothen else points
        kind, own = geo.parse_wkb(wkb)
        plain = geo.simplify(whole)
        # of points on a straight piece, the plain one may keep some by rounding
        assert kind == "line" and own[0] == plain[0] and own[-1] == plain[-1] and set(own) <= set(plain)
        assert geo.simplify(own) == own
        at = [whole.index(p) for p in own] if len(set(whole)) == len(whole) else []
        for a, b in zip(at, at[1:], strict=False):
            (x, y), (u, v) = whole[a], whole[b]
            assert all(abs((u - x) * (q - y) - (v - y) * (p - x)) <= 1.001e-5 * np.hypot(u - x, v - y) for p, q in whole[a:b])


def test_lines_of_the_nearest_are_drawn_without_a_list_of_edges(spark, monkeypatch):
    rnd = random.Random(8)
    rows = {(a, b): (a, b, rnd.randint(1, 3), 1) for a, b in ((rnd.randrange(70, 250), rnd.randrange(70, 250)) for _ in range(900)) if a != b}
    edges, lattice = net(spark, rows.values()), Lattice(16)
    find = lambda: {(r.origin, r.destination): r for r in routing.lines(edges, cells(spark, *range(70, 250)), cells(spark, *range(70, 250, 20)), lattice.centre, routing.Options(k=2), lattice=lattice).collect()}
    monkeypatch.setattr(routing, "_drawn", lambda *_: None)
    listed = find()
    monkeypatch.undo()
    monkeypatch.setattr(routing, "EDGES_FOLLOWED", 40)
    monkeypatch.setattr(routing, "EDGES_AT_ONCE", 20)
    monkeypatch.setattr(routing, "path_cells", lambda *_: (_ for _ in ()).throw(AssertionError("listed")))
    assert find() == listed and len(listed) > 300 and all(r.hops > 0 for r in listed.values())
