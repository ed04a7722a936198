"""Exact top-k inner-product search with a pivot-distance index.

Each vector is keyed by the band of its norm (powers of the square root of two), its nearest pivot and its distance
from it; the distance is the angle, which is a metric.  Sorted by this key, vectors are cut into annuli of at most
RING vectors, stored as one row each with their least and largest angle and norm.  With the angle a between a
query and the pivot of an annulus of angles lo..hi, no vector there is nearer to the query than

    gap = max(a - hi, lo - a, 0)                                   (triangle inequality)

so no inner product exceeds |query| * norm * cos(gap), with the largest norm, or the least if the cosine is negative.

A query's annuli are searched in waves from near to far: those of its nearest pivot, of the next sqrt(pivots) ones,
then all others.  After each wave its k-th best score is its line, and annuli whose bound is under the line are skipped; within a
task the line rises as well.  Queries are sent to the tasks in chunks of at most CHUNK (and CHUNK_BYTES), so what is
broadcast is bounded; a chunk makes one pass over the annuli in each wave, and no table of queries and annuli
is made.  A task returns the k best that it has seen of each query.

Pivots are means of directions, fitted on a sample of at most SAMPLE vectors: as many as the square root of the
number of vectors, MOST_PIVOTS at most.  All vectors are indexed, and results are exact whatever the pivots.
Equal vectors are stored once with the k + 1 smallest of their ids, as no query can return more of them.

Defined results: rows with a null id or vector, or with a null or non-finite component, take no part; components are
held between -2**62 and 2**62, and scores between the limits of a long; shorter vectors are padded
with zeros; rows that repeat both id and vector count once, and rows with the query's own id are never its results; ties go to the
smaller id; an id with several vectors is a query by each of them, and is found once, by the best; an empty table gives
no row; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, MOST_PIVOTS, LEAST_PIVOTS = 16_384, 2048, 8
RING = 1024
CHUNK, CHUNK_BYTES = 8192, 64 << 20
#: Found rows that a task holds before it keeps only the best.
HELD = 1 << 20
WAVES = 3
_SALT = 16
_LARGE = 1 << 62
_FOUND = "query_id long, vec_id long, score long"


def quantize(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the components as floor(1024 * x)."""
    e = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    e = e.where("vec_id is not null and x is not null and not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    held = f"greatest(least(c * 1024, {float(_LARGE)!r}D), {-float(_LARGE)!r}D)"
    return e.select("vec_id", F.expr(f"transform(x, c -> floor({held}))").alias("v")).distinct()


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _first_ids(v: DataFrame, k: int) -> DataFrame:
    """v and ids, the k + 1 smallest ids of each distinct vector, in two steps so that no vector's rows meet in one task."""
    for by in (["v", "salt"], ["v"]):
        v = v.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(_SALT))) if "salt" in by else v
        v = v.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    return v.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


class Pivots:
    """Directions of unit length."""

    def __init__(self, sample: np.ndarray, wanted: int):
        _, x = self.directions(sample)
        rng = np.random.default_rng(7)
        self.points = x[np.sort(rng.choice(len(x), min(wanted, len(x)), replace=False))] if len(x) else np.zeros((1, sample.shape[1]))
        for _ in range(5 if len(x) else 0):  # means of the nearest directions
            near = (x @ self.points.T).argmax(1)
            means = np.zeros_like(self.points)
            np.add.at(means, near, x)
            length = np.sqrt((means * means).sum(1))
            self.points = np.where(length[:, None] > 0, means / np.maximum(1e-300, length)[:, None], self.points)

    @staticmethod
    def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms, and vectors of unit length."""
        x = v.astype(float)
        norm = np.sqrt((x * x).sum(1))
        return norm, x / np.maximum(1e-300, norm)[:, None]

    def angles(self, directions: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(directions @ self.points.T, -1.0, 1.0))


class Index:
    """annuli: cell, lo, hi, least, most (norms), ids, data (one row for each); pivots; the kind of numbers for exact arithmetic."""

    def __init__(self, annuli: DataFrame, pivots: Pivots, width: int, largest: int):
        self.annuli, self.pivots, self.width = annuli, pivots, width
        #: sums of products stay exact in doubles below 2**53
        self.kind = float if largest * largest * max(1, width) < 1 << 53 else object


def build(vectors: DataFrame, k: int) -> Index:
    """Indexes rows (vec_id, v)."""
    spark = vectors.sparkSession
    common.ready(spark)
    distinct = common.materialize(_first_ids(vectors, k), "vectors")
    number, width, largest = distinct.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = max(1, width or 0)
    sample = distinct.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()
    pivots = Pivots(_matrix([r["v"] for r in sample], width), min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(number))))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                m = _matrix(batch["v"].tolist(), width)
                norm, x = pivots.directions(m)
                a = pivots.angles(x)
                cell = a.argmin(1)
                band = np.floor(2 * np.log2(np.maximum(1.0, norm))).astype(np.int32)
                yield pd.DataFrame({"band": band, "cell": cell.astype(np.int32), "r": a[np.arange(len(a)), cell], "norm": norm, "ids": batch["ids"], "data": [v.tobytes() for v in m]})

    def rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()

        def ring(some: pd.DataFrame) -> dict:
            return {
                "cell": some["cell"].iloc[0], "lo": some["r"].min(), "hi": some["r"].max(), "least": some["norm"].min(), "most": some["norm"].max(),
                "ids": [x.tolist() for x in some["ids"]], "data": b"".join(some["data"]),
            }

        for batch in batches:
            held, out = pd.concat([held, batch], ignore_index=True), []
            key = held["band"].astype(np.int64) * (1 << 32) + held["cell"] if len(held) else None
            at = 0
            while len(held) > at and (key.iloc[-1] != key.iloc[at] or len(held) - at >= RING):
                n_own = min(RING, int(np.searchsorted(key.to_numpy()[at:], key.iloc[at], "right")))
                out.append(ring(held.iloc[at : at + n_own]))
                at += n_own
            held = held.iloc[at:].reset_index(drop=True)
            if out:
                yield pd.DataFrame(out)
        if len(held):
            yield pd.DataFrame([ring(held)])

    placed = distinct.mapInPandas(keyed, "band int, cell int, r double, norm double, ids array<long>, data binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    annuli = placed.repartitionByRange(parts, "band", "cell", "r").sortWithinPartitions("band", "cell", "r").mapInPandas(
        rings, "cell int, lo double, hi double, least double, most double, ids array<array<long>>, data binary"
    )
    return Index(common.materialize(annuli, "annuli"), pivots, width, int(largest or 0))


class Chunk:
    """Queries of one pass: ids, vectors, norms and directions, nearest pivot, and the angle up to which pivots belong to the second wave."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, index: Index, k: int):
        self.ids, self.m, self.k = ids, m, k
        self.norm, self.x = index.pivots.directions(m)
        a = index.pivots.angles(self.x)
        self.nearest = a.argmin(1)
        n = math.isqrt(a.shape[1])
        self.second = np.partition(a, min(n, a.shape[1] - 1), axis=1)[:, min(n, a.shape[1] - 1)]
        #: a k-th best score that is known of each query
        self.line = np.full(len(ids), -np.inf)

    def wanted(self, wave: int, cell: int, lo: float, hi: float, least: float, most: float, pivot: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, int]:
        """Queries of the wave that must search an annulus, and how many need not."""
        a = np.arccos(np.clip(self.x @ pivot, -1.0, 1.0))
        own = self.nearest == cell
        own = own if not wave else ~own & ((a <= self.second) if wave == 1 else (a > self.second))
        gap = np.cos(np.minimum(np.pi, np.maximum(0.0, np.maximum(a - hi, lo - a) - 1e-7)))
        bound = self.norm * np.where(gap > 0, most, least) * gap
        need = own & (bound + 1e-9 * self.norm * most + 1e-6 >= line)
        return np.flatnonzero(need), int(own.sum() - need.sum())


def _best(found: list[np.ndarray], k: int) -> np.ndarray:
    """The k best rows (query, id, score) of each query; each id once."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
    if len(rows):  # an id with several vectors counts with the best of them
        key = np.lexsort((np.arange(len(rows)), rows[:, 1], rows[:, 0]))
        again = np.zeros(len(rows), bool)
        again[key[1:]] = (rows[key[1:], :2] == rows[key[:-1], :2]).all(1)
        rows = rows[~again]
    starts = np.flatnonzero(np.diff(rows[:, 0], prepend=-1)) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return rows[rank < k]


def _search(index: Index, sent, wave: int) -> DataFrame:
    """query_id, vec_id, score: of each task, the k best of each query.  A row without a query_id has the pairs searched and skipped."""
    width, kind, points = index.width, index.kind, index.pivots.points

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk: Chunk = sent.value
        line, found, held, searched, skipped = chunk.line.copy(), [], 0, 0, 0
        k = chunk.k
        for batch in batches:
            for row in batch.itertuples(index=False):
                who, left = chunk.wanted(wave, row.cell, row.lo, row.hi, row.least, row.most, points[row.cell], line)
                vectors = np.frombuffer(row.data, np.int64).reshape(-1, width)
                skipped += left * len(vectors)
                searched += len(who) * len(vectors)
                if not len(who):
                    continue
                scores = chunk.m[who].astype(kind) @ vectors.T.astype(kind)
                if kind is object:
                    scores = np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64)
                least = line[who]
                if len(vectors) > k + 1:  # k + 1 distinct vectors hold the k best besides the query's own
                    least = np.maximum(least, np.partition(scores, -k - 1, axis=1)[:, -k - 1])
                q, v = np.nonzero(scores >= least[:, None])
                lens = np.array([len(x) for x in row.ids])
                ids, ends = np.concatenate([np.asarray(x, np.int64) for x in row.ids]), np.cumsum(lens)
                n = lens[v]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((ends - lens)[v], n)
                rows = np.stack([np.repeat(who[q], n), ids[at], np.repeat(scores[q, v].astype(np.int64), n)], 1)
                rows = rows[rows[:, 1] != chunk.ids[rows[:, 0]]]
                found.append(rows)
                held += len(rows)
                if held > HELD:
                    found, held = [_best(found, k)], 0
                    full = np.bincount(found[0][:, 0], minlength=len(line)) == k
                    line[full] = np.maximum(line[full], _lines(found[0], len(line))[full])
        out = _best(found, k) if found else np.zeros((0, 3), np.int64)
        yield pd.DataFrame({"query_id": pd.array([None], dtype="Int64"), "vec_id": [searched], "score": [skipped]})
        yield pd.DataFrame({"query_id": pd.array(chunk.ids[out[:, 0]], dtype="Int64"), "vec_id": out[:, 1], "score": out[:, 2]})

    return index.annuli.mapInPandas(run, _FOUND)


def _lines(rows: np.ndarray, n: int) -> np.ndarray:
    """The least score of each query."""
    out = np.full(n, np.inf)
    np.minimum.at(out, rows[:, 0], rows[:, 2].astype(float))
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    best = found.where("query_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int = 10, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of each query row with all other rows.

    report, if given, gets the pairs of queries and vectors that were searched, and that bounds spared.
    """
    spark = vectors.sparkSession
    vectors = common.materialize(vectors, "quantized")
    index = build(vectors, k)
    queries = vectors.where(is_query).select("vec_id", "v")
    size = max(1, min(CHUNK, CHUNK_BYTES // (8 * index.width)))
    chunks = -(-queries.count() // size)
    found = []
    for c in range(chunks):
        own = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks)) == c).orderBy("vec_id", "v").collect()
        if not own:
            continue
        chunk = Chunk(np.array([r["vec_id"] for r in own], np.int64), _matrix([r["v"] for r in own], index.width), index, k)
        waves = None
        for wave in range(WAVES):
            sent = spark.sparkContext.broadcast(chunk)
            some = common.materialize(_search(index, sent, wave), f"wave{wave}")
            if report is not None:
                for name, n in some.where("query_id is null").agg(F.sum("vec_id").alias("searched"), F.sum("score").alias("skipped")).first().asDict().items():
                    report[name] = report.get(name, 0) + (n or 0)
            waves = some if waves is None else waves.unionByName(some)
            if wave + 1 < WAVES:
                lines = {r["query_id"]: r["line"] for r in _top(waves, k).groupBy("query_id").agg(F.min("score").alias("line"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect()}
                ids, times = np.unique(chunk.ids, return_counts=True)
                once = set(ids[times == 1].tolist())  # the line of an id with several vectors is no line of each
                chunk.line = np.array([lines.get(i, -np.inf) if i in once else -np.inf for i in chunk.ids.tolist()], float)
        found.append(waves)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return _top(out, k)
