"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A document's fingerprint has bit b set if over half of its shingles' hashes have it.  Postings are keyed
by the bytes at a few places; within a posting list the bytes that pairs share in place are tallied,
pairs below a minimum are left, and the rest are verified by counting differing bits.

    STRICT  64 bits of XXH64 (seed 42).  Fingerprints link at 4 or fewer differing bits, so they share at
            least four of eight bytes, and postings are keyed by three bytes: twenty triples of places
            suffice for every set of four places to hold one of them.  Nothing is missed.
    WIDE    512 bits over distinct shingles, for text similarity rather than equal fingerprints.  Sets of
            shingles with a Jaccard similarity of 0.8 differ in 15 % of the bits, and share about 17 of 64
            bytes; postings are keyed by two bytes at 96 pairs of places.  Of pairs with a similarity of
            0.8 the whole scheme misses 0.6 %, at 0.82 0.3 %, at 0.85 0.05 % (simulated with independent bits,
            100,000 pairs each).  Very small sets differ in more bits: of a set of four shingles within
            one of five 7 % are missed (50,000 pairs).
            These pairs are candidates: the exact Jaccard similarity of their sets of shingles decides.
            First each candidate's nearest one of each list is verified, then all candidates that are not in
            one component by then, so that large groups of near copies need few pairs and none is assumed.
            Of the latter, pairs whose sets are known to differ in too many shingles are not met again: by
            their sizes, and by parities, which differ in no more places than sets do in shingles.

Only distinct fingerprints are indexed, and a list of STRICT gives links that connect what is linked within it
(a spanning forest) rather than all its pairs, so a large group of near copies costs as many links as it
has members.  Components are found by passing on the smallest reachable document id, in tables that are
written to the shared folder after each round.

Defined results: a text without words, null included, has fingerprint zero; fewer words than a shingle
are one shingle; repeated rows are returned as often as they come; a null doc_id is returned with its own
fingerprint and the component of that fingerprint (null if no id has it); an empty table gives no row;
further columns are ignored, or kept by ``first_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_SHINGLES_AT_ONCE = 1 << 14
#: Lists up to this length are compared together, longer ones each in blocks of so many pairs.
_SHORT = 32
_PAIRS_AT_ONCE = 1 << 17
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
#: Bits of a set's parity.
_PARITY = 512


@dataclass(frozen=True)
class Scheme:
    """words: 64-bit words of a fingerprint.  places: the byte places that key a posting list each.
    shared: bytes that a pair must share.  distance: bits in which it may differ.  sets: each shingle
    counts once.  long_list: a longer list is divided by one more byte, which needs shared > len(places[0]).
    similarity: if given, pairs within these bounds are candidates only, and link if their sets of shingles
    have this Jaccard similarity or more.
    """

    words: int
    places: tuple[tuple[int, ...], ...]
    shared: int
    distance: int
    sets: bool
    long_list: int | None
    similarity: float | None = None


#: Every four of the eight places hold one of these triples: three places of one group, or two of one and one of the next.
STRICT = Scheme(
    1,
    tuple(t for g in _GROUPS for t in combinations(g, 3))
    + tuple((*two, one) for k, g in enumerate(_GROUPS) for two in combinations(g, 2) for one in _GROUPS[(k + 1) % 3]),
    4, 4, False, 4096,
)
#: 96 pairs of places.  Bits that differ at a similarity of 0.8: 78, with a deviation of 8.
WIDE = Scheme(8, tuple((k, (k + 1) % 64) for k in range(64)) + tuple((k, k + 32) for k in range(32)), 4, 120, True, None, 0.8)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The hashes of a text's shingles, in order."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - size + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[k : k + size]), 42) for k in range(n)), np.uint64, n)


def jaccard(one: np.ndarray, other: np.ndarray) -> float:
    """Of two arrays of distinct hashes; 1 for two empty ones."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / (len(one) + len(other) - both) if len(one) or len(other) else 1.0


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each place, set if an odd number of a set's hashes fall there: each shingle that only one of two sets has turns one bit."""
    return np.packbits(np.bincount((hashes % np.uint64(_PARITY)).astype(np.int64), minlength=_PARITY) & 1).tobytes()


def fingerprint(text: str | None, size: int = 4, scheme: Scheme = STRICT) -> bytes:
    """The fingerprint's words, each with its highest byte first."""
    every = shingles(text, size)
    if not len(every):
        return bytes(8 * scheme.words)
    if scheme.sets:
        every = np.unique(every)
    counts = np.zeros((scheme.words, 64), np.int64)
    for at in range(0, len(every), _SHINGLES_AT_ONCE):
        own = every[at : at + _SHINGLES_AT_ONCE]
        for k in range(scheme.words):
            h = own if not k else _mixed(own + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            counts[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(every), axis=1, bitorder="little").view("<u8").astype(">u8").tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(documents: DataFrame, size: int, scheme: Scheme, *columns: Column) -> DataFrame:
    """doc_id, fp and the columns given."""
    common.ready(documents.sparkSession)

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, size, scheme)) if texts.notna().all() else pd.Series([fingerprint(t, size, scheme) for t in texts])

    return documents.select(F.col("doc_id").cast("long"), of("text").alias("fp"), *columns)


def near(one: np.ndarray, others: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Rows of others that share enough bytes in place with one and differ in few enough bits."""
    x = others ^ one
    some = np.flatnonzero((x == 0).sum(1) >= scheme.shared)
    bits = np.bitwise_count(np.ascontiguousarray(x[some]).view(np.uint64)).sum(1)
    return some[bits <= scheme.distance]


def forest(ids: np.ndarray, fps: np.ndarray, scheme: Scheme) -> list[tuple[int, int]]:
    """Links that connect the fingerprints (rows of bytes) of a list as all their links would."""
    links, left = [], np.arange(len(ids))
    while len(left) > 1:
        edge, left = [left[0]], left[1:]
        while edge and len(left):
            one = edge.pop()
            found = near(fps[one], fps[left], scheme)
            if len(found):
                links += [(int(ids[one]), int(ids[x])) for x in left[found]]
                edge += list(left[found])
                left = np.delete(left, found)
    return links


def _list_links(key: int, ids: np.ndarray, fps: np.ndarray, scheme: Scheme) -> list[tuple[int, int]]:
    if not scheme.long_list or len(ids) <= scheme.long_list:
        return forest(ids, fps, scheme)
    links = []
    for place in set(range(fps.shape[1])) - set(scheme.places[key & 63]):
        order = np.argsort(fps[:, place], kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(fps[order, place])) + 1):
            links += forest(ids[part], fps[part], scheme)
    return links


def links(distinct: DataFrame, scheme: Scheme) -> DataFrame:
    """a, b: linked ids, of rows (rep, fp) with distinct fp."""
    width = 8 * scheme.words

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = np.frombuffer(b"".join(batch["fp"]), np.uint8).reshape(-1, width).astype(np.int64)
            for k, places in enumerate(scheme.places):
                key = np.zeros(len(data), np.int64)
                for p in places:
                    key = key << 8 | data[:, p]
                yield pd.DataFrame({"key": key << 6 | k, "rep": batch["rep"], "fp": batch["fp"]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held = None, []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if sum(len(x) for x, _ in held) > 1:
                out.extend(_list_links(held_key, np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), scheme))

        for batch in batches:
            if not len(batch):
                continue
            key, ids = batch["key"].to_numpy(), batch["rep"].to_numpy()
            fps = np.frombuffer(b"".join(batch["fp"]), np.uint8).reshape(-1, width)
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            if key[0] != held_key:
                close()
                held_key, held = int(key[0]), []
            held.append((ids[: ends[0]], fps[: ends[0]]))
            if len(starts) > 1:
                close()
                for k in np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1:
                    part = slice(starts[k], ends[k])
                    out.extend(_list_links(int(key[starts[k]]), ids[part], fps[part], scheme))
                held_key, held = int(key[-1]), [(ids[starts[-1] :], fps[starts[-1] :])]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    postings = distinct.where("rep is not null").select("rep", "fp").mapInPandas(keys, "key long, rep long, fp binary")
    return postings.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def candidates(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """a < b: pairs of rows (node, fp) that have a list in common and are near enough.

    Without a column root, each node is paired with its nearest one of each list only, so a list gives no
    more pairs than it has members.  With root, size and parity of the node's set, all pairs are given whose
    roots differ, but for those whose sets can't have the scheme's similarity.
    """
    width, roots = 8 * scheme.words, "root" in nodes.columns
    own = ["key", "node", "fp", *(["root", "size", "parity"] if roots else [])]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = np.frombuffer(b"".join(batch["fp"]), np.uint8).reshape(-1, width).astype(np.int64)
            for k, places in enumerate(scheme.places):
                key = np.zeros(len(data), np.int64)
                for p in places:
                    key = key << 8 | data[:, p]
                yield batch.assign(key=key << 8 | k)[own]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch["key"].iloc[-1]
            start = int(np.searchsorted(batch["key"].to_numpy(), last))
            if start or held and held[-1]["key"].iloc[-1] != last:
                yield _list_pairs(pd.concat([*held, batch.iloc[:start]]), scheme)
                held = []
            held.append(batch.iloc[start:])
        if held:
            yield _list_pairs(pd.concat(held), scheme)

    kinds = "key long, node long, fp binary" + (", root long, size long, parity binary" if roots else "")
    return nodes.mapInPandas(keys, kinds).repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def _list_pairs(rows: pd.DataFrame, scheme: Scheme) -> pd.DataFrame:
    """candidates of whole lists, which are sorted by key."""
    key, ids = rows["key"].to_numpy(), rows["node"].to_numpy()
    roots = rows["root"].to_numpy() if "root" in rows else None
    bounded = "parity" in rows
    if bounded:
        sizes, odd = rows["size"].to_numpy(), np.frombuffer(b"".join(rows["parity"]), np.uint64).reshape(len(rows), -1)
    fps = np.frombuffer(b"".join(rows["fp"]), np.uint8).reshape(len(rows), -1)
    bits = fps.view(np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    lengths = np.diff(np.append(starts, len(key)))
    short = np.repeat(lengths <= _SHORT, lengths)
    out = []

    def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if roots is not None:
            some = roots[i] != roots[j]
            i, j = i[some], j[some]
        d = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
        some = d <= scheme.distance
        i, j, d = i[some], j[some], d[some]
        if bounded:
            apart = np.maximum(np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64), np.abs(sizes[i] - sizes[j]))
            both = sizes[i] + sizes[j]  # a similarity is (both - apart) / (both + apart), or less
            some = both - apart >= scheme.similarity * (both + apart) - 1e-6
            i, j, d = i[some], j[some], d[some]
        some = (fps[i] == fps[j]).sum(1) >= scheme.shared
        return i[some], j[some], d[some]

    def give(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        if roots is None:  # the nearest j of each i
            order = np.lexsort((ids[j], d, i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            i, j = i[first], j[first]
        out.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1))

    found = []
    for step in range(1, int(lengths[lengths <= _SHORT].max(initial=0))):
        i = np.flatnonzero((key[step:] == key[:-step]) & short[step:])
        found.append(kept(i, i + step))
    if found:
        i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
        give(*((i, j, d) if roots is not None else (np.append(i, j), np.append(j, i), np.append(d, d))))
    for start, n in zip(starts[lengths > _SHORT], lengths[lengths > _SHORT], strict=True):
        rows_at_once = max(1, _PAIRS_AT_ONCE // int(n))
        for at in range(start, start + n, rows_at_once):
            i, j = np.meshgrid(np.arange(at, min(at + rows_at_once, start + n)), np.arange(start, start + n), indexing="ij")
            other = i < j if roots is not None else i != j
            give(*kept(i[other], j[other]))
    every = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame(every, columns=["a", "b"])


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose sets (node, hashes as bytes) have a Jaccard similarity of least or more."""

    @F.pandas_udf("double")
    def of(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(one, other, strict=True)], dtype=float)

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.where(of("x", "y") >= least).select("a", "b")


def verified(documents: DataFrame, nodes: DataFrame, size: int, scheme: Scheme) -> DataFrame:
    """node, root of all nodes but the roots, by links between sets of shingles that are similar enough.

    nodes: node, fp, and doc_id and text_hash of a document that has it.  The nearest candidates are verified first;
    of the other candidates, all that are not in one component by then.  So no pair of candidates is
    left unverified that could link two components, and many near copies of a document are few pairs.
    """
    first = common.materialize(candidates(nodes.select("node", "fp"), scheme).distinct(), "near")
    some = first.select("a").union(first.select("b")).distinct().toDF("node")
    busy = common.materialize(nodes.join(some, "node", "left_semi"), "busy")

    @F.pandas_udf("hashes binary, size long, parity binary")
    def described(texts: pd.Series) -> pd.DataFrame:
        found = [np.unique(shingles(t, size)) for t in texts]
        return pd.DataFrame({"hashes": [x.tobytes() for x in found], "size": [len(x) for x in found], "parity": [parity(x) for x in found]})

    named = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    texts = named.join(busy.select("node", "doc_id", "text_hash"), ["doc_id", "text_hash"]).dropDuplicates(["node"])
    every = common.materialize(texts.select("node", described("text").alias("set")).select("node", "set.*"), "sets")
    sets = every.select("node", "hashes")
    links = common.materialize(similar(first, sets, scheme.similarity), "links")
    found = components(links)
    of = busy.select("node", "fp").join(every.select("node", "size", "parity"), "node").join(found, "node", "left")
    rooted = common.materialize(of.select("node", "fp", F.coalesce("root", "node").alias("root"), "size", "parity"), "rooted")
    rest = candidates(rooted, scheme).distinct().join(first, ["a", "b"], "left_anti")
    more = similar(common.materialize(rest, "rest"), sets, scheme.similarity)
    return components(links.union(more))


def _stars(edges: DataFrame) -> DataFrame:
    """Edges of each partition, replaced with edges to the smallest node reachable within the partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            path = []
            while (y := above.get(x, x)) != x:
                path.append(x)
                x = y
            for p in path:
                above[p] = x
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
        rows = [(x, top(x)) for x in list(above)]
        for at in range(0, len(rows), 50_000):
            yield pd.DataFrame(rows[at : at + 50_000], columns=["a", "b"])

    return edges.mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of edges a, b but the roots.

    Large-star and small-star rounds: each node links its larger neighbours to the smallest node that it
    touches, then itself and its smaller neighbours likewise, until only stars are left.
    """
    edges = common.materialize(_stars(edges), "edges")
    while True:
        least = edges.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
        if not least.where("n > 1").limit(1).count() and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        # written first, so that the join shuffles both sides and Spark can split the rows of a node with many neighbours
        low = common.materialize(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "low")
        large = common.materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "large")
        down = common.materialize(large.groupBy("u").agg(F.min("v").alias("low")), "down")
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("low").alias("b"))
        edges = common.materialize(_stars(small.distinct()).distinct(), "edges")


def classes(documents: DataFrame, size: int = 4, scheme: Scheme = STRICT) -> DataFrame:
    """Per row: doc_id, fingerprint (hex digits), component_id (the smallest doc_id reachable)."""
    if scheme.similarity is not None:
        docs = _rooted(documents, size, scheme)
        least = docs.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return docs.join(least, "root").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
    docs = common.materialize(fingerprints(documents, size, scheme), "fingerprints")
    distinct = common.materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(links(distinct, scheme))
    of = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return docs.join(of, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _rooted(documents: DataFrame, size: int, scheme: Scheme) -> DataFrame:
    """doc_id, fp, text_hash and root: equal for rows of a component.  Rows are told apart by id and text, as ids may clash."""
    docs = common.materialize(fingerprints(documents, size, scheme, F.xxhash64("text").alias("text_hash")), "fingerprints")
    one = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("one")
    distinct = common.materialize(docs.groupBy("fp").agg(one).select(F.xxhash64("fp").alias("node"), "fp", "one.*"), "distinct")
    nodes = distinct.where("doc_id is not null")
    found = verified(documents, nodes, size, scheme) if scheme.similarity is not None else components(links(nodes.select(F.col("node").alias("rep"), "fp"), scheme))
    of = distinct.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    return common.materialize(docs.join(of, "fp"), "rooted")


def first_of_each(documents: DataFrame, size: int = 5, scheme: Scheme = WIDE) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, once; all columns stay.

    Texts without words are copies of each other.  Rows with a null doc_id stay.  Of a group's texts with
    the smallest id, the one with the smallest hash stays; an id stays with each text that is in a group of its own.
    """
    own = F.struct(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    firsts = _rooted(documents, size, scheme).where("doc_id is not null").groupBy("root").agg(F.min(own).alias("one")).select("one.*")
    at = (documents["doc_id"].cast("long") == firsts["__id"]) & (F.xxhash64(documents["text"]) == firsts["__hash"])
    return documents.join(firsts, at, "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(documents.where("doc_id is null"))
