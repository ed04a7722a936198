"""A network as arrays, and searches from many origins at once in one task.

Labels are (key of the profile, number of edges, last edge), least first; edges are sorted by source, so of equal
paths the one over the smaller previous cell is taken, as everywhere.  Each round takes the waiting labels within four
mean edges of the least and offers them to the cells that follow, all origins together, until nothing waits that
could still reach a wanted cell.  Labels only get less, so what is left is what a search cell by cell finds.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.weights import Profile

#: Labels (origins times cells) that a task searches at once, of about 40 bytes each.
LABELS_AT_ONCE = 4_000_000
#: Edges of paths in one batch of rows, and rows.
EDGES_AT_ONCE, ROWS_AT_ONCE = 1_000_000, 50_000
#: Columns of what is along a path.
ALONG = ("edges_n", "edges_td", "edges_m", "first_cell", "last_cell")
#: Rounds between looks at which origins have reached all they should.
_LOOK = 32


class Network:
    """cells (sorted), and of each edge, sorted by source: src, dst (places among cells), td, pref, len_m, edge; starts: each cell's first edge."""

    def __init__(self, edges: pa.Table):
        """Without pref, edge and len_m (costs alone of edges of one length, which is then given as their only len_m) a third of the memory is needed."""
        src, dst, td = (edges.column(c).to_numpy() for c in ("src", "dst", "td"))
        pref, len_m, edge = (edges.column(c).to_numpy() if c in edges.column_names else None for c in ("pref", "len_m", "edge"))
        order = np.lexsort([x for x in (edge, pref, td, dst, src) if x is not None])
        self.cells = np.union1d(src, dst)
        self.src, self.dst = (np.searchsorted(self.cells, x[order]).astype(np.int32) for x in (src, dst))
        self.td, self.pref, self.len_m, self.edge = (x[order] if x is not None else None for x in (td, pref, len_m, edge))
        self.starts = np.searchsorted(self.src, np.arange(len(self.cells) + 1))
        self.lists = None

    @classmethod
    def plain(cls, edges: pa.Table, length: float) -> Network:
        """Of src, dst and td, all edges being of one length."""
        out = cls(edges)
        out.len_m = np.array([length])
        return out

    def backwards(self) -> Network:
        """The network with each edge the other way round, for costs alone."""
        return type(self).plain(pa.table({"src": self.cells[self.dst], "dst": self.cells[self.src], "td": self.td}), float(self.len_m[0]) if len(self.len_m) else 0.0)

    def places(self, cells: np.ndarray) -> np.ndarray:
        """Of those cells that the network has."""
        return np.flatnonzero(np.isin(self.cells, cells))

    def batched(self, profile: Profile) -> bool:
        """Whether no edge makes a path less, which search_many relies on."""
        return bool(((self.td >= (1.0 if profile.standard else 0.0)) & (self.td < np.inf) & (self.pref > 0 if profile.standard else True)).all())

    def exact(self) -> bool:
        """Whether sums over edges are the same in any order, and lengths follow from numbers of edges."""
        whole = bool((np.floor(self.td * 1024) == self.td * 1024).all()) and float(self.td.sum()) * 1024 < 2**52
        return whole and self._even() and self.batched(Profile())

    def _even(self) -> bool:
        return not len(self.len_m) or bool(self.len_m.min() == self.len_m.max() == np.floor(self.len_m[0])) and self.len_m[0] * len(self.td) < 2**52

    def search_many(self, origins: np.ndarray, profile: Profile, targets: np.ndarray, k: int | None) -> Iterator[Found]:
        """origins, targets: places.  For a few origins at a time, the paths to all targets reached, or to the k nearest (ties to the smaller cell)."""
        at_once = max(1, LABELS_AT_ONCE // max(1, len(self.cells)))
        for at in range(0, len(origins), at_once):
            yield Found(self, origins[at : at + at_once], profile, targets, k)


class Found:
    """Paths from some origins: a row for each, in origin (which of them), node (places), td, pref and hops."""

    def __init__(self, net: Network, origins: np.ndarray, profile: Profile, targets: np.ndarray, k: int | None):
        self.net, self.origins, n = net, origins, len(net.cells)
        k = None if k is None or k >= len(targets) else k
        self._search(profile, targets, k)
        key = self.key.reshape(-1, n)[:, targets]
        reached = np.isfinite(key)
        if k is not None:
            ties = (key, self.pref.reshape(-1, n)[:, targets]) if profile.standard and profile.factor is None else (key,)
            best = np.lexsort(ties[::-1], axis=1)[:, :k]
            chosen = np.zeros_like(reached)
            np.put_along_axis(chosen, best, True, axis=1)
            reached &= chosen
        self.origin, node = np.nonzero(reached)
        self.node = targets[node]
        self.at = self.origin * n + self.node
        self.td, self.hops = self.time[self.at], self.edges[self.at]
        self.pref = self.pref[self.at] if profile.standard else np.zeros(len(self.at))

    def _search(self, profile: Profile, targets: np.ndarray, k: int | None) -> None:
        net, n, standard, mode = self.net, len(self.net.cells), profile.standard, profile.factor is not None
        size, first = len(self.origins) * n, np.arange(len(self.origins)) * n + self.origins
        key = np.full(size, np.inf)
        time = np.zeros(size) if mode else key
        pref = np.zeros(size) if standard else None
        hops, last, mark, waits = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.empty(size, np.int32), np.zeros(size, bool)
        key[first] = profile.key(*profile.zero)[0]
        time[first] = profile.zero[0]
        if standard:
            pref[first] = profile.zero[1]
        weight = net.td * net.pref * profile.factor if mode else net.td
        step, waiting, n_round = 4 * float(weight.mean()) if len(weight) else 1.0, first, 0
        while len(waiting):
            n_round += 1
            if n_round % _LOOK == 0 and len(targets):
                own = key.reshape(-1, n)[:, targets]
                line = own.max(1) if k is None else np.partition(own, k - 1, axis=1)[:, k - 1]
                near = key[waiting] <= line[waiting // n]
                waits[waiting[~near]] = False  # they may get less yet
                waiting = waiting[near]
                if not len(waiting):
                    break
            d = key[waiting]
            now = d <= d.min() + step
            here, waiting = waiting[now], waiting[~now]
            waits[here] = False
            place = here % n
            begin = net.starts[place]
            many = net.starts[place + 1] - begin
            of = np.repeat(np.arange(len(here)), many)
            e = np.arange(len(of)) + np.repeat(begin - (np.cumsum(many) - many), many)
            to = (here - place)[of] + net.dst[e]
            t = time[here][of] + net.td[e]
            if mode or standard:
                m1, m2 = np.maximum(np.abs(net.td[e]), 1.0), np.maximum(np.abs(time[here][of]), 1.0)
                p = (np.abs(net.pref[e]) * m1 + np.abs(pref[here][of]) * m2) / (m1 + m2)
            new = t * profile.factor * p if mode else t
            some = np.flatnonzero(new <= key[to])
            to, t, new, e, h = to[some], t[some], new[some], e[some].astype(np.int32), hops[here][of[some]] + 1
            p = p[some] if standard else None
            fresh = []
            while len(to):
                # less than what is there: by key, preference, edges, last edge
                less = (h < hops[to]) | (h == hops[to]) & (e < last[to])
                change = (h < hops[to]) | mode
                if standard and not mode:
                    less = (p < pref[to]) | (p == pref[to]) & less
                    change |= p != pref[to]
                old = key[to]
                less = (new < old) | (new == old) & less
                change |= new < old
                some = np.flatnonzero(less)
                to, t, new, e, h, change = to[some], t[some], new[some], e[some], h[some], change[some]
                p = p[some] if standard else None
                mark[to] = np.arange(len(to), dtype=np.int32)
                one = mark[to] == np.arange(len(to))  # one of each cell; the others are compared with it next
                at = to[one]
                key[at], hops[at], last[at] = new[one], h[one], e[one]
                if mode:
                    time[at] = t[one]
                if standard:
                    pref[at] = p[one]
                at = at[change[one] & ~waits[at]]
                waits[at] = True
                fresh.append(at)
                one = ~one
                to, t, new, e, h = to[one], t[one], new[one], e[one], h[one]
                p = p[one] if standard else None
            waiting = np.concatenate([waiting, *fresh])
        self.key, self.time, self.pref, self.edges, self.last = key, time, pref, hops, last

    def before(self, at: np.ndarray) -> np.ndarray:
        """The labels that labels with a last edge come from."""
        e = self.last[at]
        return at - self.net.dst[e] + self.net.src[e]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each row, the sum of the edges' values along its path, from its start."""
        every = np.flatnonzero(self.last >= 0)
        every = every[np.argsort(self.edges[every], kind="stable")]
        out = np.zeros(len(self.last))
        for level in np.split(every, np.flatnonzero(np.diff(self.edges[every])) + 1):
            out[level] = out[self.before(level)] + values[self.last[level]] if len(level) else 0.0
        return out[self.at]

    def along(self) -> list[np.ndarray]:
        """Of each row's path, from its edges in their order: how many, their sums of td and len_m, the cell that they start from and the last that they reach.

        Paths of an origin share their beginnings, so each edge of the tree of all is passed once, and none is listed.
        """
        net, own = self.net, np.arange(len(self.last))
        every = np.flatnonzero(self.last >= 0)
        every = every[np.argsort(self.edges[every], kind="stable")]
        many, td, first = np.zeros(len(own), np.int64), np.zeros(len(own)), (own % len(net.cells)).astype(np.int32)
        even, length = len(net.len_m) != len(net.td), np.zeros(len(own))
        each = net.len_m[0] if even else None
        for level in np.split(every, np.flatnonzero(np.diff(self.edges[every])) + 1):
            e = self.last[level]
            before = level - net.dst[e] + net.src[e]
            many[level] = many[before] + 1
            td[level] = td[before] + net.td[e]
            length[level] = length[before] + (each if even else net.len_m[e])
            first[level] = first[before]
        e = self.last[self.at]
        last = np.where(e >= 0, net.dst[e], self.at % len(net.cells)) if len(net.dst) else self.at % max(1, len(net.cells))
        return [many[self.at], td[self.at], length[self.at], net.cells[first[self.at]], net.cells[last]]

    def lengths(self) -> np.ndarray:
        return self.hops * float(self.net.len_m[0] if len(self.net.len_m) else 0) if self.net._even() else self.sums(self.net.len_m)

    def batches(self, paths: bool, along: bool = False) -> Iterator[pa.RecordBatch]:
        """The rows; with their paths' edges, or empty lists; with what is along() their paths, if wanted."""
        more = self.along() if along else []
        length, ends = self.lengths(), np.cumsum(self.hops, dtype=np.int64)
        a = 0
        while a < len(self.at):
            b = min(len(self.at), a + ROWS_AT_ONCE)
            if paths:
                b = max(a + 1, min(b, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + EDGES_AT_ONCE, "right"))))
            hops = self.hops[a:b]
            stops = np.concatenate([[0], np.cumsum(hops, dtype=np.int32)]) if paths else np.zeros(b - a + 1, np.int32)
            values = np.empty(stops[-1], np.int64)
            if paths:
                at, place = self.at[a:b], stops[1:] - 1
                while len(some := np.flatnonzero(self.last[at] >= 0)):
                    at, place = at[some], place[some]
                    values[place] = self.net.edge[self.last[at]]
                    at, place = self.before(at), place - 1
            yield pa.record_batch([
                pa.array(self.net.cells[self.origins[self.origin[a:b]]]), pa.array(self.net.cells[self.node[a:b]]), pa.array(self.td[a:b]), pa.array(self.pref[a:b]), pa.array(length[a:b]),
                pa.array(hops), pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(values)),
                *(pa.array(x[a:b]) for x in more),
            ], names=["origin", "node", "td", "pref", "len_m", "hops", "path", *(ALONG if along else ())])
            a = b


def nearest(backwards: Network, origins: np.ndarray, targets: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """origin, target (places), td and hops of the k nearest targets of each origin (ties to the smaller), in one search from all targets.

    Scalar weights; each cell keeps its k least (td, target), and what passes a cell is among its own.
    """
    n = len(backwards.cells)
    starts, dst, td = backwards.starts.tolist(), backwards.dst.tolist(), backwards.td.tolist()
    kept: list[list | None] = [None] * n
    heap = [(0.0, t, 0, t) for t in sorted(targets.tolist())]
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        far, target, hops, here = pop(heap)
        own = kept[here]
        if own is None:
            own = kept[here] = []
        elif len(own) >= 3 * k or target in own[::3]:
            continue
        own += target, far, hops
        hops += 1
        for e in range(starts[here], starts[here + 1]):
            there = kept[dst[e]]
            if there is None or len(there) < 3 * k:
                push(heap, (far + td[e], target, hops, dst[e]))
    rows = [(o, own[j], own[j + 1], own[j + 2]) for o in origins.tolist() if (own := kept[o]) for j in range(0, len(own), 3)]
    o, t, far, hops = zip(*rows, strict=True) if rows else ((), (), (), ())
    return np.array(o, np.int64), np.array(t, np.int64), np.array(far, float), np.array(hops, np.int32)


class Forest:
    """The paths from every cell to its k nearest targets, from one search from all targets: labels, each of a cell (node) and a target, with its td and
    hops, and the label that its path goes on with (then; -1 at the target).

    Scalar weights whose sums are exact.  Of equal paths, the one that a search from its first cell takes: fewer edges, then, from
    the target back, the smaller previous cell.  Only cells are known of paths, not which of parallel edges they take.
    """

    def __init__(self, node: np.ndarray, then: np.ndarray, target: np.ndarray, td: np.ndarray, hops: np.ndarray):
        self.node, self.then, self.target, self.td, self.hops = node, then, target, td, hops

    @classmethod
    def grown(cls, backwards: Network, targets: np.ndarray, k: int) -> Forest:
        starts, dst, td = backwards.starts.tolist(), backwards.dst.tolist(), backwards.td.tolist()
        own: list[list | None] = [None] * len(backwards.cells)
        node, then, target, far, hops = array("i"), array("i"), array("i"), array("d"), array("i")
        heap = [(0.0, t, 0, t, -1) for t in sorted(targets.tolist())]
        push, pop = heapq.heappush, heapq.heappop

        def less(a: int, b: int) -> bool:
            """Of two labels of one target, as many edges away: whether the path from the target to a is the less one."""
            if a == b:
                return False
            while then[a] != then[b]:
                a, b = then[a], then[b]
            return node[a] < node[b]

        while heap:
            d, t, h, here, before = pop(heap)
            labels = own[here]
            if labels is None:
                labels = own[here] = []
            else:
                same = next((x for x in labels if target[x] == t), None)
                if same is not None:
                    # what follows a label has more edges, so it waits until all that are equal are compared
                    if d == far[same] and h == hops[same] and less(before, then[same]):
                        then[same] = before
                    continue
                if len(labels) >= k:
                    continue
            n = len(node)
            labels.append(n)
            node.append(here)
            then.append(before)
            target.append(t)
            far.append(d)
            hops.append(h)
            h += 1
            for e in range(starts[here], starts[here + 1]):
                there = own[dst[e]]
                if there is None or len(there) < k:
                    push(heap, (d + td[e], t, h, dst[e], n))
        return cls(*(np.frombuffer(x, kind) if len(x) else np.zeros(0, kind) for x, kind in ((node, "i4"), (then, "i4"), (target, "i4"), (far, "f8"), (hops, "i4"))))

    def passed(self, labels: np.ndarray) -> np.ndarray:
        """The cells (places) of the labels' paths, start to target, one path after the other; labels with the most edges first."""
        many = self.hops[labels]
        place = np.cumsum(many + 1, dtype=np.int64) - (many + 1)
        out = np.empty(int((many + 1).sum(dtype=np.int64)), np.int32)
        left = np.searchsorted(-many, -np.arange(int(many[0]) + 1 if len(many) else 0), "right")
        here = labels
        for step, n in enumerate(left.tolist()):
            here = here[:n]
            out[place[:n] + step] = self.node[here]
            here = self.then[here]
        return out
