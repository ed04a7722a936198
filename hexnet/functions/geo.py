"""Geometry: mercator coordinates, WKB, lines of routes, outlines and cells of shapes.

Points are (x, y); WKB is little-endian.  Columns where columns suffice, Arrow UDFs elsewhere.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, SegmentedPath
from ..plans.store import ship
from .lattice import DIRECTIONS, Lattice

EARTH_M = 6378137.0
SIMPLIFY = 1e-5
_POINT, _LINE, _POLYGON, _MULTILINE = 1, 2, 3, 5
Points = list[tuple[float, float]]


def _clamp(c: Column, most: float) -> Column:
    return F.least(F.greatest(c, F.lit(-most)), F.lit(most))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres; longitudes beyond 180 and latitudes beyond 85 are moved to the border."""
    lon, lat = _clamp(lon, 180.0), _clamp(lat, 85.0)
    return F.radians(lon) * EARTH_M, F.log(F.tan(F.radians(lat) * 0.5 + math.pi / 4)) * EARTH_M


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    lon, lat = F.degrees(x / EARTH_M), F.degrees(F.lit(math.pi / 2) - F.atan(F.exp(-y / EARTH_M)) * 2)
    return _clamp(lon, 180.0), _clamp(lat, 85.0)


# ---------------------------------------------------------------- WKB

def _coords(points: Points) -> bytes:
    return struct.pack("<I", len(points)) + np.array(points, "<f8").reshape(-1, 2).tobytes()


def wkb_point(p: tuple[float, float]) -> bytes:
    return struct.pack("<BIdd", 1, _POINT, *p)


def wkb_line(points: Points) -> bytes:
    return struct.pack("<BI", 1, _LINE) + _coords(points)


def wkb_polygon(rings: list[Points]) -> bytes:
    return struct.pack("<BII", 1, _POLYGON, len(rings)) + b"".join(map(_coords, rings))


def wkb_lines(lines: list[Points]) -> bytes:
    return struct.pack("<BII", 1, _MULTILINE, len(lines)) + b"".join(map(wkb_line, lines))


def parse_wkb(data: bytes) -> tuple[str, list]:
    """("point", (x, y)), ("line", points), ("polygon", rings) or ("lines", lines).  InvalidArgument if it's neither."""

    def at(pos: int) -> tuple[str, object, int]:
        order = "<" if data[pos] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", data, pos + 1)
        pos += 5

        def points(pos: int) -> tuple[Points, int]:
            (n,) = struct.unpack_from(order + "I", data, pos)
            xy = np.frombuffer(data, order + "f8", 2 * n, pos + 4).reshape(-1, 2)
            return [tuple(p) for p in xy.tolist()], pos + 4 + 16 * n

        if kind == _POINT:
            return "point", struct.unpack_from(order + "dd", data, pos), pos + 16
        if kind == _LINE:
            p, pos = points(pos)
            return "line", p, pos
        if kind in (_POLYGON, _MULTILINE):
            (n,) = struct.unpack_from(order + "I", data, pos)
            pos, out = pos + 4, []
            for _ in range(n):
                if kind == _POLYGON:
                    p, pos = points(pos)
                else:
                    _, p, pos = at(pos)
                out.append(p)
            return ("polygon" if kind == _POLYGON else "lines"), out, pos
        raise InvalidArgument(f"geometry of kind {kind}")

    try:
        name, shape, _ = at(0)
    except (struct.error, IndexError, ValueError) as e:
        raise InvalidArgument("not WKB") from e
    return name, shape


# ---------------------------------------------------------------- lines

def chaikin(points: Points, times: int = 1) -> Points:
    """Corners cut at a quarter and three quarters of each piece; the ends stay."""
    for _ in range(times):
        if len(points) < 3:
            break
        p = np.array(points)
        a, b = p[:-1], p[1:]
        cut = np.stack([0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b], 1).reshape(-1, 2)
        points = [points[0], *map(tuple, cut.tolist()), points[-1]]
    return points


def _kept(p: np.ndarray, epsilon: float) -> np.ndarray:
    keep, todo = np.zeros(len(p), bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, own = p[b] - p[a], p[a + 1 : b] - p[a]
        n = math.hypot(*d)
        far = np.abs(d[0] * own[:, 1] - d[1] * own[:, 0]) / n if n else np.hypot(own[:, 0], own[:, 1])
        k = int(far.argmax())
        if far[k] > epsilon:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify(points: Points, epsilon: float = SIMPLIFY) -> Points:
    """Ramer-Douglas-Peucker: what is within epsilon of the line between kept points goes."""
    if len(points) < 3:
        return points
    return [x for x, y in zip(points, _kept(np.array(points), epsilon), strict=True) if y]


def wkb_lines_of(points: np.ndarray, lens: np.ndarray, smoothen: bool = True, epsilon: float = SIMPLIFY) -> pa.Array:
    """WKB of lines of at least two points each, given one after the other, smoothed by chaikin() and simplified.

    A corner whose triangle with its neighbours is wider than twice epsilon is kept by any simplification; where all between such corners
    is within epsilon of the line between them, it goes, at once for all lines.  Other lines are simplified one by one.
    """
    points, lens = np.asarray(points, float).reshape(-1, 2), np.asarray(lens, np.int64)
    if smoothen:
        last = np.cumsum(lens) - 1
        cut = np.empty((2 * len(points), 2))
        cut[1:-1:2] = 0.75 * points[:-1] + 0.25 * points[1:]
        cut[2::2] = 0.25 * points[:-1] + 0.75 * points[1:]
        cut[2 * (last - lens + 1)], cut[2 * last + 1] = points[last - lens + 1], points[last]
        if (lens < 3).any():  # a single piece has no corner
            rest = np.repeat(lens > 2, 2 * lens)
            rest[2 * (last - lens + 1)] = rest[2 * last + 1] = True
            cut, lens = cut[rest], np.where(lens > 2, 2 * lens, 2)
        else:
            lens = 2 * lens
        points = cut
    ends = np.cumsum(lens)
    first, of = ends - lens, np.repeat(np.arange(len(lens)), lens)
    step = np.diff(points, axis=0)
    keep = np.ones(len(points), bool)
    x, y = step.T
    long = np.maximum(np.hypot(x, y)[:-1], np.hypot(x, y)[1:])
    long = np.maximum(long, np.hypot(x[:-1] + x[1:], y[:-1] + y[1:]))
    keep[1:-1] = np.abs(x[:-1] * y[1:] - y[:-1] * x[1:]) > 2.001 * epsilon * long
    keep[first], keep[ends - 1] = True, True
    out = np.flatnonzero(~keep)
    kept = np.flatnonzero(keep)
    after = np.searchsorted(kept, out)
    a, b = points[kept[after - 1]], points[kept[after]]
    d, own = b - a, points[out] - a
    n = np.hypot(d[:, 0], d[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(n > 0, np.abs(d[:, 0] * own[:, 1] - d[:, 1] * own[:, 0]) / n, np.hypot(own[:, 0], own[:, 1]))
    for j in np.unique(of[out[~(far <= epsilon)]]).tolist():
        keep[first[j] : ends[j]] = _kept(points[first[j] : ends[j]], epsilon)
    many = np.add.reduceat(keep, first, dtype=np.int64) if len(lens) else lens
    stops = np.concatenate([[0], np.cumsum(9 + 16 * many)])
    data, coords = np.empty(stops[-1], np.uint8), np.ascontiguousarray(points[keep], "<f8").view(np.uint8).ravel()
    at = 0
    for begin, size in zip(stops.tolist(), many.tolist(), strict=False):
        data[begin : begin + 9] = np.frombuffer(struct.pack("<BII", 1, _LINE, size), np.uint8)
        data[begin + 9 : begin + 9 + 16 * size] = coords[at : at + 16 * size]
        at += 16 * size
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(data)])


def route_wkb(paths: DataFrame, centre: Callable[[Column], tuple[Column, Column]], smoothen: bool = True, epsilon: float = SIMPLIFY) -> DataFrame:
    """The paths (with a column cells) with their line as wkb; null for paths without an edge."""
    ship(paths.sparkSession)

    @F.pandas_udf("binary")
    def line(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = [wkb_lines_of(np.stack([x, y], 1), [len(x)], smoothen, epsilon)[0].as_py() if len(x) > 1 else None for x, y in zip(xs, ys, strict=True)]
        return pd.Series(out, dtype=object)

    xs, ys = F.transform("cells", lambda c: centre(c)[0]), F.transform("cells", lambda c: centre(c)[1])
    return paths.withColumn("wkb", line(xs, ys))


def join_lines(edges: list[tuple[int, int]]) -> list[list[int]]:
    """Consecutive edges as runs of cells: a new run where an edge doesn't start at the end of the one before."""
    runs: list[list[int]] = []
    for a, b in edges:
        if runs and runs[-1][-1] == a:
            runs[-1].append(b)
        else:
            runs.append([a, b])
    return runs


def one_line(edges: list[tuple[int, int]]) -> list[int]:
    """The cells of a path; an error if it has no edge or a gap."""
    runs = join_lines(edges)
    if len(runs) != 1:
        raise SegmentedPath("a path without an edge" if not runs else f"{len(runs)} pieces")
    return runs[0]


# ---------------------------------------------------------------- shapes and cells

def hull(points: Points) -> Points:
    """The convex hull, counter-clockwise, without repeating the first point."""
    every = sorted(set(points))
    if len(every) < 3:
        return every

    def half(some: list) -> Points:
        out: Points = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return half(every)[:-1] + half(every[::-1])[:-1]


def node_hull(nodes: DataFrame, lattice: Lattice) -> Points:
    """The hull of the nodes' centres: of each partition on its own, then of the partitions' hulls."""
    ship(nodes.sparkSession)
    x, y = lattice.centre(F.col("cell"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Points = []
        for b in batches:
            own = hull(own + list(zip(b["x"].tolist(), b["y"].tolist(), strict=True)))
        yield pd.DataFrame(own, columns=["x", "y"])

    return hull([(r["x"], r["y"]) for r in nodes.select(x.alias("x"), y.alias("y")).mapInPandas(run, "x double, y double").collect()])


def buffer(shape: bytes, metres: float) -> bytes:
    """The hull of a shape in metres, grown by an octagon: two pieces of circle for each quarter.

    Approximate: inner corners are filled.
    """
    name, found = parse_wkb(shape)
    points = [found] if name == "point" else found if name == "line" else [p for part in found for p in part]
    around = [(metres * math.cos(k * math.pi / 4), metres * math.sin(k * math.pi / 4)) for k in range(8)]
    grown = hull([(x + a, y + b) for x, y in points for a, b in around])
    return wkb_polygon([[*grown, grown[0]]])


def point_to_cell(lattice: Lattice, x: Column, y: Column) -> Column:
    """The cell whose centre is nearest; null outside the lattice."""
    r = y / (lattice.size * 1.5)
    q = x / lattice.length_m() - r / 2
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    nq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    nr = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return lattice.cell(nq.cast("long"), nr.cast("long"))


def _nearest(lattice: Lattice, x: float, y: float) -> tuple[int, int]:
    r = y / (lattice.size * 1.5)
    q = x / lattice.length_m() - r / 2
    rq, rr, rs = round(q), round(r), round(-q - r)
    dq, dr, ds = abs(rq - q), abs(rr - r), abs(rs + q + r)
    if dq > dr and dq > ds:
        rq = -rr - rs
    elif dr > ds:
        rr = -rq - rs
    return rq, rr


def line_cells(lattice: Lattice, points: Points) -> list[int]:
    """The cells along a line, in order, without consecutive repeats."""
    out: list[int] = []
    for (x1, y1), (x2, y2) in zip(points[:-1], points[1:], strict=True):
        n = max(1, math.ceil(math.hypot(x2 - x1, y2 - y1) / (lattice.size / 2)))
        for k in range(n + 1):
            q, r = _nearest(lattice, x1 + (x2 - x1) * k / n, y1 + (y2 - y1) * k / n)
            if 0 <= q < lattice.width and r >= 0 and (not out or out[-1] != q + r * lattice.width):
                out.append(q + r * lattice.width)
    return out


def polygon_cells(lattice: Lattice, rings: list[Points]) -> list[int]:
    """The cells whose centres a polygon holds, and the cell of its centre, sorted."""
    outer = np.array(rings[0])
    rows = range(max(0, math.floor(outer[:, 1].min() / (lattice.size * 1.5))), math.ceil(outer[:, 1].max() / (lattice.size * 1.5)) + 1)
    q, r = _nearest(lattice, *outer[:-1].mean(0).tolist())
    found = {q + r * lattice.width} if 0 <= q < lattice.width and r >= 0 else set()
    for row in rows:
        y = row * lattice.size * 1.5
        x = (np.arange(lattice.width) + row / 2) * lattice.length_m()
        inside = np.zeros(lattice.width, bool)
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (y1 > y) != (y2 > y):
                    inside ^= x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        found.update((np.flatnonzero(inside) + row * lattice.width).tolist())
    return sorted(found)


def shapes_to_cells(shapes: DataFrame, lattice: Lattice, wkb: str = "wkb") -> DataFrame:
    """The shapes with a row for each of their cells, in a column cell."""
    ship(shapes.sparkSession)

    @F.pandas_udf("array<long>")
    def cells(data: pd.Series) -> pd.Series:
        out = []
        for b in data:
            name, found = parse_wkb(bytes(b))
            points = [found] if name == "point" else found
            out.append(polygon_cells(lattice, found) if name == "polygon" else line_cells(lattice, points * 2 if name == "point" else points) if name != "lines" else sorted({c for x in found for c in line_cells(lattice, x)}))
        return pd.Series(out)

    return shapes.withColumn("cell", F.explode(cells(wkb)))


def outline(cells: list[int], lattice: Lattice) -> list[Points]:
    """The rings around cells: sides that only one of them has, joined end to end."""
    own = {(c % lattice.width, c // lattice.width) for c in cells}
    ends: dict[tuple, list[tuple]] = {}
    height, half = lattice.length_m(), lattice.size / 2
    # corners of a cell in doubled coordinates, so that neighbours agree on them exactly
    corners = [(1, -1), (1, 1), (0, 2), (-1, 1), (-1, -1), (0, -2)]
    sides = {(1, 0): 0, (0, 1): 1, (-1, 1): 2, (-1, 0): 3, (0, -1): 4, (1, -1): 5}
    for q, r in own:
        cx, cy = 2 * q + r, 3 * r
        for step in DIRECTIONS:
            if (q + step[0], r + step[1]) not in own:
                k = sides[step]
                a, b = corners[k], corners[(k + 1) % 6]
                ends.setdefault((cx + a[0], cy + a[1]), []).append((cx + b[0], cy + b[1]))
    rings = []
    while ends:
        start = next(iter(ends))
        ring, here = [start], start
        while here in ends:
            to = ends[here].pop()
            if not ends[here]:
                del ends[here]
            ring.append(to)
            here = to
        rings.append([(x * height / 2, y * half) for x, y in ring])
    return rings


def covered_area(edges: DataFrame, lattice: Lattice, levels: int = 2, tile: int = 64) -> DataFrame:
    """tile, wkb: outlines of the network's cells, coarsened by levels and dissolved within tiles of tile x tile cells."""
    ship(edges.sparkSession)
    coarse, cell = lattice, F.col("c")
    for _ in range(levels):
        cell, coarse = coarse.parent(cell), coarse.coarser()
    up = edges.select(F.explode(F.array("src", "dst")).alias("c")).select(cell.alias("c")).distinct()
    at = (F.floor(coarse.q(F.col("c")) / tile) + F.floor(coarse.r(F.col("c")) / tile) * (1 + coarse.width // tile)).cast("long")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        lines = [simplify(x, 1e-6) for x in outline(own["c"].tolist(), coarse)]
        return pd.DataFrame([{"tile": int(own["tile"].iloc[0]), "wkb": wkb_lines(lines)}])

    return up.withColumn("tile", at).groupBy("tile").applyInPandas(run, "tile long, wkb binary")
