"""Costs between many cells of a narrow network, whose edges join cells that are near in the order of their numbers.

The width is the most places between an edge's ends.  Cells are passed in order, from both sides; each, when it is passed,
leaves to the cells of the next width the costs of the ways through it (elimination).  A way to a cell then comes over one of
the width cells beside it, so the costs of all origins to it follow from theirs to those cells: width sums for each pair of origin and
destination, whatever the network's length.  All pairs are found, and costs are those of any other search.

A value is a pair (a, b) of numbers without rounding, added and compared in this order, which together hold the profile's key
and the number of edges; b is None if a holds all.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DestinationsNotInGraph
from ..functions.weights import Profile
from ..plans.store import ship

#: The widest network that is passed so, the most values kept of the cells that have destinations among them, and of those outside.
WIDEST, MOST_INSIDE, MOST_OUTSIDE = 64, 6_000_000, 40_000_000
#: Origins that a task takes at once: few calls for each cell, for rows of values that stay in the cache.
ORIGINS_AT_ONCE = 8192
COLUMNS = {"origin": "long", "destination": "long", "start_cell": "long", "end_cell": "long", "td": "double", "pref": "double", "hops": "int"}
SUMMARY = "origin long, n long, best_td double, best_pref double, best long, sum_td double, sum_pref double, sum_hops double, sum_w double"


@dataclass(frozen=True)
class Scale:
    """How weights become values: td (and td * pref) are whole numbers after multiplication by unit; bits: of a number of edges; length: of each edge."""

    profile: Profile
    unit: int
    bits: int
    length: float

    def values(self, td: np.ndarray, pref: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        one = float(1 << self.bits)
        if not self.profile.standard:
            return td * self.unit * one + 1, None
        return (td, td * pref * one + 1) if self.profile.factor is None else (td * pref * one + 1, td)

    def weights(self, a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """td, pref, td * pref (0 for scalars) and the number of edges."""
        one = float(1 << self.bits)
        if b is None:
            td = np.floor(a / one)
            none = np.zeros(len(a))
            return td / self.unit, none, none, a - td * one
        both, td = (b, a) if self.profile.factor is None else (a, b)
        w = np.floor(both / one)
        zero_td, zero_pref = self.profile.zero
        td, hops, w = td + zero_td, both - w * one, w + zero_td * zero_pref
        return td, w / td, w, hops


def scale(edges: DataFrame, profile: Profile) -> Scale | None:
    """None for a network that isn't narrow, or whose sums would be rounded."""
    whole = lambda c: F.bool_and(c == F.floor(c))
    td, both = F.col("td"), F.col("td") * F.col("pref")
    found = edges.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("src") - F.col("dst"))).alias("width"), F.max("src").alias("s1"), F.max("dst").alias("d1"), F.min("src").alias("s0"), F.min("dst").alias("d0"),
        F.min("td").alias("low"), F.max("td").alias("high"), F.max(both).alias("most"), F.min("pref").alias("pref"), whole(td).alias("one"), whole(td * 1024).alias("small"), whole(both).alias("even"),
        F.min("len_m").alias("len0"), F.max("len_m").alias("len1"), F.bool_and(F.col("td").isNotNull() & F.col("pref").isNotNull() & F.col("len_m").isNotNull()).alias("known"),
    ).first()
    if not found.n or not found.known or found.width > WIDEST or found.len0 != found.len1 or found.len0 != int(found.len0) or not found.small:
        return None
    cells = min(max(found.s1, found.d1) - min(found.s0, found.d0) + 1, 2 * found.n)
    out = Scale(profile, 1 if found.one else 1024, int(cells).bit_length(), float(found.len0))
    # a path has each cell once at most, so no sum is larger
    if profile.standard:
        fits = found.one and found.even and found.low >= 1 and found.pref > 0 and cells * max(found.most, found.high) < 2.0 ** (52 - out.bits)
    else:
        fits = found.low >= 0 and cells * found.high * out.unit < 2.0 ** (52 - out.bits)
    return out if fits and out.length * cells < 2**52 and cells * found.width <= MOST_OUTSIDE else None


def _less(a1, b1, a0, b0):
    return a1 < a0 if b0 is None else (a1 < a0) | (a1 == a0) & (b1 < b0)


def _least(xa: np.ndarray, xb: np.ndarray | None, ea: np.ndarray, eb: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """For each column of x, the least of its values with those of e added."""
    sums = xa + ea[:, None]
    a = sums.min(0)
    return (a, None) if xb is None else (a, np.where(sums == a, xb + eb[:, None], np.inf).min(0))


def _follow(xa: np.ndarray, xb: np.ndarray | None, to: int, ea: np.ndarray, eb: np.ndarray | None) -> None:
    """Row to of x becomes the least of the rows with their e added; its own e is infinite."""
    ways, a = np.flatnonzero(ea != np.inf).tolist(), xa[to]
    a.fill(np.inf)
    if xb is None:
        sums = np.empty_like(a)
        for k, e in zip(ways, ea[ways].tolist(), strict=True):
            np.add(xa[k], e, out=sums)
            np.minimum(a, sums, out=a)
        return
    b = xb[to]
    b.fill(np.inf)
    for k, e, f in zip(ways, ea[ways].tolist(), eb[ways].tolist(), strict=True):
        sa, sb = xa[k] + e, xb[k] + f
        less = sa == a
        less &= sb < b
        less |= sa < a
        np.copyto(a, sa, where=less)
        np.copyto(b, sb, where=less)


class _Passed:
    """Cells 0 to hi - 1 passed in order.  into: of the cells from lo on, the values from the next width cells over cells before; out: of the cells before lo,
    those to them; at: among the width cells that begin each block from lo on, those over cells before.  A cell's place in a row of values is its remainder by width + 1.
    """

    def __init__(self, width: int, src: np.ndarray, dst: np.ndarray, a: np.ndarray, b: np.ndarray | None, lo: int, hi: int):
        size, two = width + 1, b is not None
        late = np.maximum(src, dst)
        order = np.lexsort([x for x in (b, a, dst, src, late) if x is not None])
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(src[order]) != 0) | (np.diff(dst[order]) != 0)
        order = order[first]
        flat, late = (src[order] % size) * size + dst[order] % size, late[order]
        a, b = a[order], b[order] if two else None
        starts = np.searchsorted(late, np.arange(hi + size + 1)).tolist()
        none = lambda *shape: np.full(shape, np.inf)
        self.into, self.out, self.at = ([none(*s), none(*s) if two else None] for s in ((hi - lo, size), (lo, size), ((hi - lo) // width, width, width)))
        ma, ta = none(size, size), none(size, size)
        mb = none(size, size) if two else None
        fa, fb = ma.ravel(), mb.ravel() if two else None
        add, least = np.add.outer, np.minimum

        def enter(c: int) -> None:
            s, x, y = c % size, starts[c], starts[c + 1]
            ma[s] = np.inf
            ma[:, s] = np.inf
            if two:
                mb[s] = np.inf
                mb[:, s] = np.inf
            if y > x:
                fa[flat[x:y]] = a[x:y]
                if two:
                    fb[flat[x:y]] = b[x:y]

        for c in range(width):
            enter(c)
        for p in range(hi):
            enter(p + width)
            s = p % size
            if p >= lo and (p - lo) % width == 0:
                own = np.arange(p, p + width) % size
                for m, kept in ((ma, self.at[0]), (mb, self.at[1])):
                    if m is not None:
                        kept[(p - lo) // width] = m[np.ix_(own, own)]
            if p >= lo:
                into = ma[:, s].copy(), mb[:, s].copy() if two else None
                # a way that is no less than one that goes to another of these cells first says nothing
                into[0][s], ma[s, s] = np.inf, np.inf
                over = ma + into[0]
                if two:
                    same = np.where(over == into[0][:, None], mb + into[1], np.inf).min(1)
                    over = over.min(1)
                    gone = (over < into[0]) | (over == into[0]) & (same <= into[1])
                else:
                    gone = over.min(1) <= into[0]
                into[0][gone] = np.inf
                self.into[0][p - lo] = into[0]
                if two:
                    self.into[1][p - lo] = into[1]
            else:
                self.out[0][p] = ma[s]
                if two:
                    self.out[1][p] = mb[s]
            if two:
                sa, sb = add(ma[:, s], ma[s]), add(mb[:, s], mb[s])
                less = _less(sa, sb, ma, mb)
                np.copyto(ma, sa, where=less)
                np.copyto(mb, sb, where=less)
            else:
                add(ma[:, s], ma[s], out=ta)
                least(ma, ta, out=ma)
        for kept, at in ((self.into, lo), (self.out, 0)):  # none with itself
            for x in kept:
                if x is not None:
                    x[np.arange(len(x)), (np.arange(len(x)) + at) % size] = np.inf


def _closed(a: np.ndarray, b: np.ndarray | None) -> None:
    """The least values between the cells of each block, in place."""
    own = np.arange(a.shape[1])
    a[:, own, own] = 0
    if b is not None:
        b[:, own, own] = 0
    for k in own:
        sa = a[:, :, k, None] + a[:, k, None, :]
        if b is None:
            np.minimum(a, sa, out=a)
        else:
            sb = b[:, :, k, None] + b[:, k, None, :]
            less = _less(sa, sb, a, b)
            np.copyto(a, sa, where=less)
            np.copyto(b, sb, where=less)


def _from_outside(width: int, passed: _Passed, first: list, wanted: np.ndarray, lo: int) -> list:
    """Of the wanted cells before lo, the values to the cells of the block that begins at lo; first: those between its cells."""
    size, out = width + 1, []
    for x in passed.out:
        out.append(None if x is None else np.full((len(wanted), width), np.inf))
    ring = [None if x is None else np.full((size, width), np.inf) for x in first]
    for r, x in zip(ring, first, strict=True):
        if r is not None:
            r[np.arange(lo, lo + width) % size] = x
    place = np.full(lo, -1)
    place[wanted] = np.arange(len(wanted))
    stop, place = int(wanted.min()) if len(wanted) else lo, place.tolist()
    (ea, eb), (ra, rb) = passed.out, ring
    for o in range(lo - 1, stop - 1, -1):
        a, b = _least(ra, rb, ea[o], None if eb is None else eb[o])
        ra[o % size] = a
        if rb is not None:
            rb[o % size] = b
        if place[o] >= 0:
            out[0][place[o]] = a
            if rb is not None:
                out[1][place[o]] = b
    return out


def prepared(src: np.ndarray, dst: np.ndarray, td: np.ndarray, pref: np.ndarray, starts: np.ndarray, ends: np.ndarray, by: Scale, own: bool = False) -> dict[str, np.ndarray]:
    """What sweeps need.  starts, ends: rows of a label and the cell that stands for it; those that aren't cells of the network go.
    own: starts that no edge leaves go as well, and ends that no edge reaches, if they aren't starts.
    """
    cells, plain = np.union1d(src, dst), src != dst
    known = lambda rows: rows[np.isin(rows[:, 1], cells)]
    if own:
        starts = starts[np.isin(starts[:, 1], src)]
        ends = ends[np.isin(ends[:, 1], dst) | np.isin(ends[:, 1], starts[:, 1])]
    starts, ends = known(starts), known(ends)
    found = {"found": np.array([len(starts), len(ends)])}
    if not len(starts) or not len(ends):
        return found
    src, dst, td, pref = (x[plain] for x in (src, dst, td, pref))
    src, dst = np.searchsorted(cells, src), np.searchsorted(cells, dst)
    width = int(np.abs(src - dst).max(initial=1))
    blocks = -(-len(cells) // width)
    n = blocks * width  # cells without edges fill the last block
    a, b = by.values(td, pref)
    start, end = np.searchsorted(cells, starts[:, 1]), np.searchsorted(cells, ends[:, 1])
    lo, hi = int(end.min()) // width * width, (int(end.max()) // width + 1) * width
    if (hi - lo) * (width + 1) > MOST_INSIDE:
        return found | {"wide": np.array([hi - lo])}
    up = _Passed(width, src, dst, a, b, lo, hi)
    down = _Passed(width, n - 1 - src, n - 1 - dst, a, b, n - hi, n - lo)
    between = [None if x is None else x.copy() for x in up.at]
    other = [None if x is None else x[::-1, ::-1, ::-1] for x in down.at]
    less = _less(*other, *between)
    for x, y in zip(between, other, strict=True):
        if x is not None:
            np.copyto(x, y, where=less)
    _closed(*between)
    order = np.argsort(start, kind="stable")
    starts, start = starts[order], start[order]
    left, right = np.unique(start[start < lo]), np.unique(start[start >= hi])
    before = _from_outside(width, up, [None if x is None else x[0] for x in between], left, lo)
    after = _from_outside(width, down, [None if x is None else x[-1, ::-1, ::-1] for x in between], n - 1 - right, n - hi)
    out = found | {"cells": np.array([len(cells), width, lo, hi]), "start": starts, "block": np.clip(start, lo, hi - 1) // width - lo // width}
    mid = (start >= lo) & (start < hi)
    for k, name in enumerate("ab"):
        if between[k] is None:
            continue
        rows = np.empty((len(start), width))
        rows[mid] = between[k][out["block"][mid], start[mid] % width]
        rows[start < lo] = before[k][np.searchsorted(left, start[start < lo])]
        rows[start >= hi] = after[k][np.searchsorted(right, start[start >= hi])][:, ::-1]
        out |= {f"row_{name}": rows, f"up_{name}": up.into[k], f"down_{name}": down.into[k]}
    order = np.argsort(end, kind="stable")
    return out | {"end": ends[order], "end_place": end[order] - lo}


def sweeps(net: dict[str, np.ndarray], chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Parts of all pairs of the chosen starts (places among them) and ends: places of ends, of starts, and a value for each pair, infinite if there is no path."""
    _, width, lo, hi = net["cells"].tolist()
    size, blocks, two = width + 1, (hi - lo) // width, "row_b" in net
    place, n = net["end_place"], hi - lo
    ends_of = np.searchsorted(place, np.arange(blocks + 1) * width)
    for turned in (False, True):  # towards smaller cells with the start's own block, then towards larger ones
        block = net["block"][chosen]
        block = blocks - 1 - block if turned else block
        order = np.argsort(-block, kind="stable")
        own, block = chosen[order], block[order]
        ea, eb = (net.get(f"{'down' if turned else 'up'}_{x}") for x in "ab")
        # places as _Passed had them
        at = (len_all(net) - hi) if turned else lo
        xa = np.full((size, len(own)), np.inf)
        xb = np.full((size, len(own)), np.inf) if two else None
        active = 0
        for j in range(blocks - 1, -1, -1):
            slots = np.arange(at + j * width, at + (j + 1) * width) % size
            if active:
                va, vb = xa[:, :active], xb[:, :active] if two else None
                for t in range((j + 1) * width - 1, j * width - 1, -1):
                    _follow(va, vb, (at + t) % size, ea[t], eb[t] if two else None)
            now = int(np.searchsorted(-block, -j, "right"))
            if now > active:
                for x, name in ((xa, "row_a"), (xb, "row_b")):
                    if x is not None:
                        rows = net[name][own[active:now]]
                        x[slots, active:now] = (rows[:, ::-1] if turned else rows).T
            real = blocks - 1 - j if turned else j
            e = np.arange(ends_of[real], ends_of[real + 1])
            many = active if turned else now
            if len(e) and many:
                p = n - 1 - place[e] if turned else place[e]
                rows = slots[p - j * width]
                yield e, own[:many], xa[rows, :many], xb[rows, :many] if two else None
            active = now


def len_all(net: dict[str, np.ndarray]) -> int:
    """The number of cells with those that fill the last block."""
    cells, width = net["cells"][:2].tolist()
    return -(-cells // width) * width


def _gather(edges: DataFrame, starts: DataFrame, ends: DataFrame, by: Scale, own: bool) -> bytes:
    """prepared(), by one task; edges don't come to the driver."""
    ship(edges.sparkSession)
    none = F.lit(0.0)
    every = edges.select(F.lit(0).alias("kind"), F.col("src").alias("x"), F.col("dst").alias("y"), "td", "pref")
    for kind, df in ((1, starts), (2, ends)):
        every = every.unionAll(df.select(F.lit(kind), F.col("requested").cast("long"), F.col("node").cast("long"), none, none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        table = pa.Table.from_batches(found)
        kind, *columns = (table.column(c).to_numpy() for c in ("kind", "x", "y", "td", "pref"))
        x, y, td, pref = columns
        rows = [np.stack([x[kind == k], y[kind == k]], 1) for k in (1, 2)]
        mine = kind == 0
        out = io.BytesIO()
        np.savez(out, **prepared(x[mine], y[mine], td[mine], pref[mine], *rows, by, own))
        whole, piece = out.getvalue(), 8_000_000
        for at in range(0, len(whole), piece):
            yield pa.record_batch([pa.array([at // piece]), pa.array([whole[at : at + piece]], pa.binary())], names=["n", "data"])

    got = every.repartition(1).mapInArrow(run, "n long, data binary").toArrow().sort_by("n")
    return b"".join(got.column("data").to_pylist())


def _tasks(edges: DataFrame, starts: DataFrame, ends: DataFrame, by: Scale, own: bool, make: Callable, schema: str) -> DataFrame | None:
    """make(net, chosen) of all starts, dealt to tasks; None if destinations lie too far apart."""
    spark, sc = edges.sparkSession, edges.sparkSession.sparkContext
    data = _gather(edges, starts, ends, by, own)
    with np.load(io.BytesIO(data)) as z:
        if "wide" in z:
            return None
        n_starts, n_ends = z["found"].tolist()
        many = len(z["block"]) if "block" in z else 0
    if n_starts and not n_ends:
        raise DestinationsNotInGraph("no destination is near a cell of the network")
    raw = sc.broadcast(data)
    del data
    # each task passes all cells with destinations, so no more tasks than cores, or than memory needs
    cores = sc.defaultParallelism
    parts = max(1, min(many, -(-many // (ORIGINS_AT_ONCE * cores)) * cores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None
        for b in batches:
            for part in b.column(0).to_pylist():
                if net is None:
                    with np.load(io.BytesIO(raw.value)) as z:
                        net = {k: z[k] for k in z.files}
                if many:
                    mine = np.arange(part, many, parts)
                    for a in range(0, len(mine), ORIGINS_AT_ONCE):
                        yield from make(net, mine[a : a + ORIGINS_AT_ONCE])

    return spark.range(0, parts, 1, parts).mapInArrow(run, schema)


def costs(edges: DataFrame, starts: DataFrame, ends: DataFrame, by: Scale, own: bool, columns: list[str]) -> DataFrame | None:
    """Rows of all pairs with a path, with those of COLUMNS.  starts, ends: requested, node.  own: as in prepared()."""

    def rows(net: dict, chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
        for e, s, a, b in sweeps(net, chosen):
            whole = np.isfinite(a).ravel()
            pick = slice(None) if whole.all() else np.flatnonzero(whole)
            a, b = a.ravel()[pick], None if b is None else b.ravel()[pick]
            if not len(a):
                continue
            td, pref, _, hops = by.weights(a, b)
            found = {}
            for c in columns:
                if c in ("origin", "start_cell"):
                    found[c] = np.tile(net["start"][s, int(c != "origin")], len(e))[pick]
                elif c in ("destination", "end_cell"):
                    found[c] = np.repeat(net["end"][e, int(c != "destination")], len(s))[pick]
                else:
                    found[c] = hops.astype(np.int32) if c == "hops" else td if c == "td" else pref
            yield pa.record_batch([pa.array(x) for x in found.values()], names=list(found))

    return _tasks(edges, starts, ends, by, own, rows, ", ".join(f"{c} {COLUMNS[c]}" for c in columns))


def summaries(edges: DataFrame, starts: DataFrame, ends: DataFrame, by: Scale, own: bool) -> DataFrame | None:
    """SUMMARY of each origin with a path: their number, the best, and sums over all, folded where they are found."""

    def rows(net: dict, chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, n = int(chosen[0]), int(chosen[-1] - chosen[0] + 1)
        count, sums, best = np.zeros(n, np.int64), [np.zeros(n) for _ in range(4)], np.zeros(n, np.int64)
        key, end = np.full((2, n), np.inf), np.full((2, n), np.iinfo(np.int64).max)
        for e, s, a, b in sweeps(net, chosen):
            s = s - first
            whole = np.isfinite(a)
            td, pref, w, hops = (x.reshape(a.shape) for x in by.weights(np.where(whole, a, 0).ravel(), None if b is None else np.where(whole, b, 0).ravel()))
            count[s] += whole.sum(0)
            for total, x in zip(sums, (td, pref, hops, w), strict=True):
                total[s] += np.where(whole, x, 0).sum(0)
            # by the profile's key, then the cell that stands for it, then the destination
            if by.profile.factor is not None:
                keys = np.where(whole, w, np.inf), np.zeros(a.shape)
            else:
                keys = np.where(whole, td, np.inf), np.where(whole, pref, np.inf)
            labels, nodes = net["end"][e, 0], net["end"][e, 1]
            near = np.flatnonzero(keys[0].min(0) <= key[0, s])
            for r in np.lexsort([labels, nodes]) if len(near) else ():
                x, mine = s[near], (keys[0][r][near], keys[1][r][near])
                less, same = mine[0] < key[0, x], mine[0] == key[0, x]
                for v, was in ((mine[1], key[1, x]), (nodes[r], end[0, x]), (labels[r], end[1, x])):
                    less |= same & (v < was)
                    same &= v == was
                less &= whole[r][near]
                x = x[less]
                key[0, x], key[1, x], end[0, x], end[1, x] = mine[0][less], mine[1][less], nodes[r], labels[r]
        some = chosen[count[chosen - first] > 0]
        x = some - first
        columns = net["start"][some, 0], count[x], key[0, x], key[1, x], end[1, x], *(t[x] for t in sums)
        yield pa.record_batch([pa.array(c) for c in columns], names=[c.split()[0] for c in SUMMARY.split(", ")])

    return _tasks(edges, starts, ends, by, own, rows, SUMMARY)
