import math
import random

import pytest
from pyspark.sql import functions as F

from hexnet.errors import InvalidArgument, SegmentedPath
from hexnet.functions import bits, geo, tags, weights
from hexnet.functions.lattice import Lattice

CELL = 0x89283080DDBFFFF  # resolution 9


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_cell_bits(spark):
    c = F.lit(CELL)
    r = one(spark, bits.resolution(c), bits.mode(c), bits.base_cell(c), bits.is_cell(c), bits.parent(c, 5), bits.parent(c, 9), bits.parent(c, 10))
    assert tuple(r)[:4] == (9, 1, 20, True) and r[4] == 0x85283083FFFFFFF and r[5] == CELL and r[6] is None


def test_transform_resolution(spark):
    df = spark.createDataFrame([(0x86283082FFFFFFF,), (0,), (None,)], "cell long")
    assert bits.to_resolution(df, "cell", 6).count() == 1
    assert bits.to_resolution(df, "cell", 5).count() == 1
    assert bits.to_resolution(df, "cell", 7).count() == 7
    back = bits.to_resolution(bits.to_resolution(df, "cell", 8), "cell", 6)
    assert back.count() == 49 and back.distinct().count() == 1


def test_pentagons_have_six_children(spark):
    pentagon = 1 << 59 | 4 << 45 | (1 << 45) - 1
    df = spark.createDataFrame([(pentagon,)], "cell long")
    got = bits.children(df, "cell", 2).select("child")
    assert got.count() == 6 + 5 * 7 and got.where(~bits.is_cell(F.col("child"))).count() == 0
    deleted = pentagon & ~(15 << 52 | 7 << 42) | 1 << 52 | 1 << 42
    assert not one(spark, bits.is_cell(F.lit(deleted)))[0]


def test_edge_bits(spark):
    e = 0x1176B49474FFFFFF
    r = one(spark, bits.mode(F.lit(e)), bits.edge_direction(F.lit(e)), bits.edge_origin(F.lit(e)))
    assert tuple(r) == (2, 1, 0x876B49474FFFFFF | 1 << 59 if False else (e & ~(15 << 59 | 7 << 56)) | 1 << 59)
    assert one(spark, bits.is_cell(F.lit(r[2])))[0] and one(spark, bits.resolution(F.lit(r[2])))[0] == 7


def test_weights(spark):
    a, b = (10.0, 4.0), (15.0, 6.0)
    assert weights.add_numbers(a, b) == (25.0, 5.2)
    t, p = weights.add(*(F.lit(x) for x in (*a, *b)))
    assert tuple(one(spark, t, p)) == (25.0, 5.2)
    arr = F.array(*(F.struct(F.lit(t).alias("td"), F.lit(p).alias("pref")) for t, p in (a, b, (0.5, 1.0))))
    want = weights.add_numbers(weights.add_numbers(a, b), (0.5, 1.0))
    assert one(spark, weights.fold(arr))[0] == want
    assert one(spark, weights.fold(F.slice(arr, 1, 1)))[0] == a
    assert one(spark, weights.fold(F.filter(arr, lambda x: x["td"] < 0)))[0] is None


def test_profiles():
    assert weights.STANDARD.zero == (1.0, 10.0) and weights.SCALAR.zero == (0.0, 0.0)
    assert weights.mode({"fast": None, "nice": 0.8}, "nice").key(10, 4) == (32.0, 0.0)
    assert weights.mode({}, "").factor is None
    for bad in (0.0, -1.0, math.inf, math.nan):
        with pytest.raises(InvalidArgument):
            weights.Profile(True, bad)
    with pytest.raises(InvalidArgument):
        weights.mode({"a": 1.0}, "b")


@pytest.mark.parametrize("text,kmh", [("50", 50), ("DE:zone:51", 51), ("50 kmh", 50), ("3kmh", 3), ("none", math.inf), ("DE:urban", 50), ("DE:33", 33), ("DE:zone:31", 31), ("DE:zone31", 31), ("5 knots", 9.26), ("walk", 5), ("", None), ("signals", None), (None, None)])
def test_max_speed(spark, text, kmh):
    got = one(spark, tags.max_speed(F.lit(text).cast("string")))[0]
    assert got == kmh or math.isclose(got, kmh)


def test_max_speed_miles(spark):
    assert math.floor(one(spark, tags.max_speed(F.lit("20 mph")))[0]) == 32


def test_car_duration(spark):
    assert math.isclose(one(spark, tags.duration(F.lit(1000.0), F.lit(36.0)))[0], 100.0)


def test_profiles_of_ways(spark):
    rows = [
        ({"highway": "Primary_link", "maxspeed": "none"}, (3.0, 130.0, True), None), ({"highway": "road", "oneway": "Yes"}, (9.0, 45.0, False), None),
        ({"highway": "steps"}, None, 1.0), ({"highway": "primary", "sidewalk": "both"}, (3.0, 120.0, True), 10.0), ({"highway": "river", "footway": "Crossing"}, None, 1.0),
        ({"highway": "residential", "Sidewalk ": " LEFT"}, (8.0, 28.5, True), 1.0), ({"highway": "residential", "maxspeed": "x", "zone:maxspeed": "20"}, (8.0, 19.0, True), 2.0), ({}, None, None),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "id int, tags map<string,string>")
    got = {r.id: r for r in df.select("id", tags.car_profile(F.col("tags")).alias("car"), tags.foot_profile(F.col("tags")).alias("foot"), tags.sidewalk(F.col("tags")).alias("side")).collect()}
    for k, (_, car, foot) in enumerate(rows):
        assert (tuple(got[k].car) if got[k].car else None) == car and (got[k].foot.pref if got[k].foot else None) == foot
    assert got[3].side.left and got[3].side.right and got[5].side.left and not got[5].side.right and got[0].side is None


def test_lattice(spark):
    grid = Lattice(16)
    cells = spark.createDataFrame([(q + r * 16,) for q in range(16) for r in range(8)], "cell long")
    disk = grid.disk(cells, "cell", 3)
    assert disk.where(grid.distance(F.col("cell"), F.col("near")) != F.col("k")).count() == 0
    assert disk.where("cell = 72").count() == 37 and grid.neighbours(cells, "cell").where("cell = 72").count() == 6
    up = cells.select("cell", grid.parent(F.col("cell")).alias("up"))
    down = grid.coarser().children(up.select("up").distinct(), "up", "cell")
    assert sorted(map(tuple, down.select("cell", "up").collect())) == sorted(map(tuple, up.collect()))


def test_point_to_cell(spark):
    grid = Lattice(32, 10.0)
    cells = spark.range(0, 32 * 20).withColumnRenamed("id", "cell")
    x, y = grid.centre(F.col("cell"))
    moved = cells.select("cell", geo.point_to_cell(grid, x + 3, y - 4).alias("found"))
    assert moved.where("found is null or found <> cell").count() == 0


def test_wkb():
    shapes = [("point", (1.5, -2.0)), ("line", [(0.0, 0.0), (1.0, 2.0)]), ("polygon", [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]]), ("lines", [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]])]
    for kind, shape in shapes:
        write = {"point": geo.wkb_point, "line": geo.wkb_line, "polygon": geo.wkb_polygon, "lines": geo.wkb_lines}[kind]
        assert geo.parse_wkb(write(shape)) == (kind, shape)
    for bad in (b"", b"\x01", b"\x01\x63\x00\x00\x00"):
        with pytest.raises(InvalidArgument):
            geo.parse_wkb(bad)


def test_lines():
    corner = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]
    assert geo.chaikin(corner) == [(0.0, 0.0), (1.0, 0.0), (3.0, 0.0), (4.0, 1.0), (4.0, 3.0), (4.0, 4.0)]
    assert geo.simplify([(0.0, 0.0), (1.0, 1e-7), (2.0, 0.0)]) == [(0.0, 0.0), (2.0, 0.0)]
    assert geo.simplify(corner) == corner
    assert geo.join_lines([(1, 2), (2, 3), (5, 6)]) == [[1, 2, 3], [5, 6]] and geo.one_line([(1, 2), (2, 3)]) == [1, 2, 3]
    for bad in ([], [(1, 2), (3, 4)]):
        with pytest.raises(SegmentedPath):
            geo.one_line(bad)


def test_shapes():
    rnd = random.Random(1)
    points = [(rnd.random(), rnd.random()) for _ in range(200)] + [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert geo.hull(points) == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    kind, rings = geo.parse_wkb(geo.buffer(geo.wkb_point((5.0, 5.0)), 2.0))
    assert kind == "polygon" and len(rings[0]) == 9 and all(math.isclose(math.dist(p, (5, 5)), 2.0) for p in rings[0])
    grid = Lattice(16, 1.0)
    square = [(0.0, 0.0), (12.0, 0.0), (12.0, 9.0), (0.0, 9.0), (0.0, 0.0)]
    for c in geo.polygon_cells(grid, [square]):
        q, r = c % 16, c // 16
        assert -0.01 <= (q + r / 2) * grid.length_m() <= 12.01 and r * 1.5 <= 9.01
    assert geo.polygon_cells(grid, [[(5.0, 3.0), (5.1, 3.0), (5.1, 3.1), (5.0, 3.0)]])
    ring = geo.outline([33], grid)
    assert len(ring) == 1 and len(ring[0]) == 7 and ring[0][0] == ring[0][-1]
    assert len(geo.outline([33, 34], grid)[0]) == 11 and len(geo.outline([1, 100], grid)) == 2


def test_mercator_clamps(spark):
    x, y = geo.to_mercator(F.lit(200.0), F.lit(89.0))
    lon, lat = geo.from_mercator(x, y)
    r = one(spark, lon, lat)
    assert math.isclose(r[0], 180.0) and math.isclose(r[1], 85.0)
