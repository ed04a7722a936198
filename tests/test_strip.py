"""Costs of all pairs of narrow networks, passed cell by cell."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexnet.functions.weights import SCALAR, STANDARD, Profile
from hexnet.operators import differential, enrich, routing, strip
from hexnet.operators import graph as g

MODE = Profile(True, 0.8)


def best(edges, profile, origin):
    """Of each cell reached: td, pref, td * pref and edges, by plain sums."""
    value = lambda t, p: (t, 0, 1) if not profile.standard else (t, t * p, 1) if profile.factor is None else (t * p, 1, t)
    found, heap, done = {origin: (0, 0, 0)}, [((0, 0, 0), origin)], set()
    while heap:
        v, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        for s, d, t, p in edges:
            if s == x and (d not in found or tuple(map(sum, zip(v, value(t, p)))) < found[d]):
                found[d] = tuple(map(sum, zip(v, value(t, p))))
                heapq.heappush(heap, (found[d], d))
    if not profile.standard:
        return {c: (v[0], 0, 0, v[2]) for c, v in found.items()}
    out = {c: (v[0], v[1], v[2]) if profile.factor is None else (v[2], v[0], v[1]) for c, v in found.items()}
    return {c: (t + 1, (w + 10) / (t + 1), w + 10, h) for c, (t, w, h) in out.items()}


@pytest.mark.parametrize("profile", [SCALAR, STANDARD, MODE], ids=["scalar", "standard", "mode"])
def test_all_pairs_are_those_of_plain_searches(profile):
    many = 0
    for seed in range(90):
        rnd = random.Random(seed)
        n, width = rnd.choice([6, 20, 60]), rnd.choice([1, 2, 5, 9])
        tried = [(a, a + rnd.randint(-width, width)) for a in (rnd.randrange(n) for _ in range(n * rnd.choice([1, 2, 4])))]
        edges = [(a * 3, b * 3, rnd.randint(1, 5), rnd.choice([3, 4, 8])) for a, b in tried if 0 <= b < n]
        if not edges:
            continue
        src, dst, td, pref = (np.array(x) for x in zip(*edges, strict=True))
        a, b = sorted((rnd.randrange(n), rnd.randrange(n)))
        starts, ends = np.array([(x * 3 + 1, x * 3) for x in rnd.sample(range(n), n // 2)]), np.array([(x * 3, x * 3) for x in range(a, b + 1)])
        by = strip.Scale(profile, 1, 10, 1.0)
        net = strip.prepared(src, dst, td.astype(float), pref.astype(float), starts, ends, by)
        got, want = {}, {}
        if "start" in net:
            chosen = np.arange(seed % 3, len(net["start"]), 2)
            for e, s, va, vb in strip.sweeps(net, chosen):
                for i, k in zip(*np.nonzero(np.isfinite(va)), strict=True):
                    pair = int(net["start"][s[k], 1]), int(net["end"][e[i], 1])
                    assert pair not in got
                    got[pair] = tuple(float(x[0]) for x in by.weights(va[i, k : k + 1], None if vb is None else vb[i, k : k + 1]))
            cells = {*src.tolist(), *dst.tolist()}
            for o in net["start"][chosen, 1].tolist():
                want |= {(o, d): v for d, v in best(edges, profile, o).items() if d in cells and a * 3 <= d <= b * 3}
        assert got == want, seed
        many += len(want)
    assert many > 1500


def lattice(spark, n=300, width=8):
    rnd = random.Random(5)
    rows = {(a, b): (a * 10_000 + b, a, b, float(rnd.randint(5, 9)), float(rnd.choice([3, 4, 8]))) for a in range(n) for b in (a + 1, a + width, a + width - 1, a - 1, a - width) if 0 <= b < n and rnd.random() < 0.5}
    return g.build(spark.createDataFrame(list(rows.values()), "edge long, src long, dst long, td double, pref double"))


def cells(spark, c):
    return spark.createDataFrame([(x,) for x in c], "cell long")


@pytest.mark.parametrize("profile", [SCALAR, STANDARD, MODE], ids=["scalar", "standard", "mode"])
def test_narrow_networks_are_not_searched_from_each_origin(spark, monkeypatch, profile):
    edges, origins, ends = lattice(spark), cells(spark, range(0, 300, 7)), cells(spark, range(20, 90))
    find = lambda **o: {(r.origin, r.destination): r for r in routing.shortest_paths(edges, origins, ends, routing.Options(**o), profile).collect()}
    want = find(strategy="local", along=True)
    monkeypatch.setattr(routing, "_labels", lambda *_: (_ for _ in ()).throw(AssertionError("searched")))
    got = find(along=True)
    assert got.keys() == want.keys() and len(got) > 1000
    for pair, r in want.items():
        same = ("start_cell", "end_cell", "first_cell", "last_cell", "edges") + (() if profile is MODE else ("td", "hops", "length_m", "edges_n", "edges_td", "edges_m"))
        assert [got[pair][c] for c in same] == [r[c] for c in same]
        assert got[pair].td * got[pair].pref == pytest.approx(r.td * r.pref)
    assert find(paths=False).keys() == want.keys()


def test_changes_are_folded_without_a_table_of_paths(spark, monkeypatch):
    edges, closed, origins, ends = lattice(spark), cells(spark, [40, 41, 133, 134]), cells(spark, range(0, 300, 7)), cells(spark, range(20, 90))
    wide = routing.Options(paths=False, strategy="local")
    paths = differential.differential_paths(edges, closed, origins, ends, wide, SCALAR).persist()
    want = sorted(map(tuple, differential.statistics(paths, SCALAR).collect()))
    changed = [sorted(r.cell for r in differential.affected(p, SCALAR).collect()) for p in (paths, paths.withColumn("hops", F.lit(0)))]
    listed = sorted(map(tuple, paths.select("origin", "destination", "td", "phase").collect()))
    lean = routing.Options(paths=False)
    got = differential.differential_paths(edges, closed, origins, ends, lean, SCALAR)
    assert sorted(map(tuple, got.select("origin", "destination", "td", "phase").collect())) == listed
    monkeypatch.setattr(differential, "shortest_paths", lambda *_: (_ for _ in ()).throw(AssertionError("a table of paths")))
    assert sorted(map(tuple, differential.origin_statistics(edges, closed, origins, ends, lean, SCALAR).collect())) == want
    for hops, c in zip((True, False), changed, strict=True):
        assert sorted(r.cell for r in differential.affected_origins(edges, closed, origins, ends, lean, SCALAR, hops=hops).collect()) == c
    assert 0 < len(changed[0]) <= len(want)


def test_results_of_a_search_are_not_broadcast_to_be_joined(spark, monkeypatch):
    # Spark takes a search's result to be as small as what it comes from
    edges, origins, ends = lattice(spark), cells(spark, range(0, 300, 7)), cells(spark, range(20, 90))
    found = routing.shortest_paths(edges, origins, ends, routing.Options(paths=False)).select("origin", "destination", "td")
    data = spark.range(3_000_000).withColumn("name", F.col("id").cast("string"))
    for most, kind in ((enrich.MOST_SENT, "BuildRight"), (1, "BuildRight")):
        monkeypatch.setattr(enrich, "MOST_SENT", most)
        out = enrich.enrich(enrich.enrich(found, "origin", enrich.few(data, "id", origins), "id", "o_"), "destination", enrich.few(data, "id", ends), "id", "d_")
        joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "HashJoin" in x and " Inner" in x]
        assert len(joins) == 2 and all(kind in x for x in joins), joins
        rows = out.collect()
        assert len(rows) == found.count() and all((r.o_name, r.d_name) == (str(r.origin), str(r.destination)) for r in rows)
