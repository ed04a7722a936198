"""Language-model scoring with a hierarchical Pitman-Yor model of words given the word, or the two words, before.

Each context is a restaurant whose customers are the words that follow it in training.  Every table of a context of two
words sends a customer to the restaurant of its near word, and every table of a context of one word sends one to the root, the parent
that all share; the root's parent is uniform over the V known words and one unknown.  Before a text's first word come starts.  The
discount is 1/2.

Seating is sampled by Gibbs, a dish at a time.  Of a dish's seating only the number t of its tables
matters to predictions and to the parent, so the sizes of tables are summed out: a dish of c customers has

    p(t) ~ S(c, t) * (discount * x * P(word in the parent)) ** t,   t = 1 .. c

with the generalised Stirling numbers S, which have a closed form for the discount 1/2: p(t + 1) / p(t) is a
fraction, and t is drawn exactly for a dish of any size.  x, drawn from Gamma(strength / discount + tables in
the restaurant), makes the dishes of a restaurant independent of each other: dishes and x are drawn in turn.
The parent's probability is its prediction given its own seating, which stays as it is meanwhile.

Contexts start with one table for each dish; then the root and the contexts are sampled alternately, ROUNDS times, and the root
once more.  In a round, contexts of two words and those of one are sampled in turn.  Contexts of a length with counts between the same
powers of two share a strength, drawn before each round given the expected auxiliary counts of the seating.  In the last round predictions

    P(w | u) = (c_uw - d t_uw) / (s + c_u)  +  (s + d t_u) / (s + c_u) * P(w in the parent)

are averaged over SAMPLES draws, as a share of the context's own and a factor of the root's P(w).  All randomness comes from hashes of
words, so that scores don't depend on how rows are dealt out (see HOT for the exception).

How it is dealt out.  Texts become blocks of at most BLOCK_TOKENS tokens.  A block sends its distinct words to shards of
words, and its distinct n-grams to shards of near words, so a context of two words is where its parent is.  What goes from a block to
a shard is one row, holding arrays in an order that the answer keeps; where there is nothing to send, there is no row, so rows never
outnumber distinct n-grams.  A row has an entry for each distinct n-gram, not for each token, so frequent words don't weigh on a shard.
Shards follow the number of tokens, so a shard's memory doesn't; they are dealt with in PASSES, so that a share of the messages is on
disk at once.  A near word of more than HOT customers is divided over shards by the following word, with the contexts that end in it;
the parts of a context learn each other's customers and tables from the root's shards before each round.  What doesn't divide is
a pair of near and following word: its contexts of two words, as many as there are words before it, lie in one shard.  Blocks know
such words from a broadcast list while there are at most MOST_HOT of them, and beyond that by a shuffle.

Words are known by 64-bit hashes, the far and the following words of a context by 48 bits of them; words that collide
would count as one (of 4 million words, 0.03 pairs in all are expected to).

Defined results: a null or empty text is its end token alone; a null doc_id isn't learned from; without
training tokens every probability is 1; repeated rows are scored, and learned from, as often as they come;
an empty table gives no row; further columns are ignored; there is no order, so no ties.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from . import common

BLOCK_TOKENS = 2_000_000
#: Tokens of the corpus for each shard of contexts, and for each shard of words; half as many with contexts of two words.
SHARD_TOKENS = 2_000_000
WORD_SHARD_TOKENS = 8_000_000
#: Customers of one part of a context.
HOT = 500_000
#: Divided contexts that are broadcast, of 16 bytes each.
MOST_HOT = 1_000_000
#: In which shards, and then blocks, are dealt with, so that only a share of the messages is on disk.
PASSES = 3
DISCOUNT = 0.5
STRENGTH, ROOT_STRENGTH = 1.0, 10.0
ROUNDS, BURN_IN, SAMPLES = 1, 3, 4
#: Stand for the start and the end of a text among the words' hashes.
START, END = 1, 2
_BANDS = 64
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOW = np.uint64((1 << 48) - 1)
_PART = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = "block long, tokens long, learned long, docs binary, lens binary, train binary, ids binary, vocab binary, counts binary"
#: kind, the block or shard that a row goes to, the shard that it comes from.
_ROW = "kind int, to long, of long, a binary, b binary, c binary, d binary"
WORDS, STATE, TO_ROOT, STRENGTHS, ROOT_TO_BLOCK, ROOT_TO_SHARD, GRAMS = range(7)
_SCORES = "doc_id string, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _pack(a: np.ndarray) -> bytes:
    """Compressed bytes, first bytes of all numbers first; an array's own kind is known where it is read."""
    a = np.ascontiguousarray(a).ravel()
    return zlib.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def _read(data: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _six(words: np.ndarray) -> bytes:
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case; cut at space and the control characters 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Ids(dict):
    """Numbers words as they come; 0 and 1 are the start and the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 2
        return n


def _blocks(documents: DataFrame, learn: Column) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        from pyspark import TaskContext

        n_block = TaskContext.get().partitionId() << 32
        ids, docs, parts, train, tokens = _Ids(), [], [], [], 0

        def block() -> pd.DataFrame:
            nonlocal ids, docs, parts, train, tokens, n_block
            every, lens, learned = np.concatenate(parts), np.array([len(x) for x in parts], np.int32), np.array(train, bool)
            vocab = np.array([START, END, *(xxhash.xxh64_intdigest(w) for w in ids)], np.uint64)
            counts = np.bincount(every[np.repeat(learned, lens)], minlength=len(vocab)).astype(np.uint32)
            known = [d is not None for d in docs]
            row = {
                "block": n_block, "tokens": tokens, "learned": int(lens[learned].sum()), "docs": _pack(np.array([[d or 0, k] for d, k in zip(docs, known, strict=True)], np.int64)),
                "lens": _pack(lens), "train": _pack(learned), "ids": _pack(every.astype(np.uint32)), "vocab": vocab.tobytes(), "counts": _pack(counts),
            }
            ids, docs, parts, train, tokens, n_block = _Ids(), [], [], [], 0, n_block + 1
            return pd.DataFrame([row])

        for batch in batches:
            for doc_id, text, y in zip(batch["doc_id"].tolist(), batch["text"].tolist(), batch["learn"].tolist(), strict=True):
                words = words_of(text if isinstance(text, str) else None)
                own = np.empty(len(words) + 1, np.uint32)
                own[:-1] = list(map(ids.__getitem__, words))
                own[-1] = 1
                parts.append(own)
                docs.append(None if doc_id is None or doc_id != doc_id else int(doc_id))
                train.append(bool(y))
                tokens += len(own)
                if tokens >= BLOCK_TOKENS:
                    yield block()
        if parts:
            yield block()

    # ids as text: a column of longs with nulls would pass through doubles
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return rows.mapInPandas(run, _BLOCK)


def _row(kind: int, to: int, of: int, a: bytes = b"", b: bytes = b"", c: bytes = b"", d: bytes = b"") -> dict:
    return {"kind": kind, "to": int(to), "of": int(of), "a": a, "b": b, "c": c, "d": d}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "to", "of", "a", "b", "c", "d"])


def _by(shard: np.ndarray, *within: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, with its places in the order of what is given, else in their own."""
    order = np.lexsort((*within, shard))
    starts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=False):
        yield int(shard[order[at]]), order[at:end]


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words & _LOW) % np.uint64(shards)).astype(np.int64)


def _word_asks(blocks: DataFrame, shards: int) -> DataFrame:
    """to (shard of words), of (block), a (hashes), b (training counts), in the order of the block's words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, vocab, counts in zip(batch["block"], batch["vocab"], batch["counts"], strict=True):
                vocab, counts = np.frombuffer(vocab, np.uint64), _read(counts, "<u4")
                yield _frame([_row(WORDS, s, block, vocab[at].tobytes(), _pack(counts[at])) for s, at in _by(_word_shard(vocab, shards))])

    return blocks.select("block", "vocab", "counts").mapInPandas(run, _ROW)


def _totals(asked: list[np.ndarray], counts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, their training counts, and the word of each entry asked."""
    words, at = np.unique(np.concatenate([*asked, np.zeros(0, np.uint64)]), return_inverse=True)
    total = np.bincount(at, np.concatenate([*(_read(x, "<u4") for x in counts), np.zeros(0)]), len(words)).astype(np.uint64)
    return words, total, at


def _count_words(asks: DataFrame) -> DataFrame:
    """Of each shard of words: a, how many are known; b and c, those of more than HOT tokens and their counts."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        words, total, _ = _totals([np.frombuffer(x, np.uint64) for x in own["a"]], own["b"])
        hot = total > HOT
        return _frame([_row(WORDS, 0, own["to"].iloc[0], np.array([(total > 0).sum()], "<f8").tobytes(), words[hot].tobytes(), total[hot].tobytes(), np.array([hot.sum()], "<f8").tobytes())])

    return asks.groupBy("to").applyInPandas(run, _ROW)


def _tell_hot(asks: DataFrame) -> DataFrame:
    """The words of more than HOT tokens, and their counts, for each block that has them."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        asked = [np.frombuffer(x, np.uint64) for x in own["a"]]
        _, total, at = _totals(asked, own["b"])
        rows = []
        for block, ws, n in zip(own["of"], asked, np.split(total[at], np.cumsum([len(x) for x in asked])[:-1]), strict=True):
            if (n > HOT).any():
                rows.append(_row(WORDS, block, own["to"].iloc[0], b=ws[n > HOT].tobytes(), c=n[n > HOT].tobytes()))
        return _frame(rows)

    return asks.groupBy("to").applyInPandas(run, _ROW)


def _hot_of(rows) -> tuple[np.ndarray, np.ndarray]:
    """Words, sorted, and counts from columns b and c."""
    words = np.concatenate([*(np.frombuffer(x, np.uint64) for x in rows["b"]), np.zeros(0, np.uint64)])
    order = np.argsort(words)
    return words[order], np.concatenate([*(np.frombuffer(x, np.uint64) for x in rows["c"]), np.zeros(0, np.uint64)])[order]


def _answers(rows: pd.DataFrame, column: str, vocab: np.ndarray, shards: int, sort: str) -> np.ndarray:
    """What the root's shards have answered to a block, in the order of vocab."""
    out = np.zeros(len(vocab), sort)
    own = rows[rows["kind"] == ROOT_TO_BLOCK]
    got = dict(zip(own["of"].tolist(), own[column], strict=True))
    for s, at in _by(_word_shard(vocab, shards)):
        out[at] = _read(got[s], sort)
    return out


class _Sizes:
    """What is known of the whole corpus once words are counted.  words: of a context; passes: in which shards and blocks are dealt with."""

    def __init__(self, n: int, v: int, word_shards: int, shards: int, words: int, passes: int):
        self.n, self.v, self.word_shards, self.shards, self.words, self.passes = n, v, word_shards, shards, words, passes


def _code(house: np.ndarray, far: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Numbers in the order of house, then far, then word; the latter two are less than n."""
    bits = int(n).bit_length()
    inner, room = far.astype(np.int64) << bits | word, 2 * bits
    if room + int(house.max(initial=0)).bit_length() > 62:
        inner = _distinct(inner)[1]
        room = len(inner).bit_length()
    return house.astype(np.int64) << room | inner


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct code, sorted, a place where it occurs; of each entry, its number among them."""
    order = np.argsort(code)
    code = code[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = code[1:] != code[:-1]
    of = np.empty(len(order), np.int32)
    of[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return order[fresh], of


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(fresh)


class _Grams:
    """A block's distinct n-grams, in the order of shard, house (a near word, or a part of it), far word and word.

    at: the tokens of the shards of pass g, and gram: the n-gram of each; of each n-gram house, far and w (places in
    hashes), counts (in training); of each house key, part, ways and shard.  Of contexts of one word the far word is always 0.
    """

    def __init__(self, block: dict, totals: np.ndarray, sizes: _Sizes, g: int):
        lens, ids = _read(block["lens"], "<i4"), _read(block["ids"], "<u4").view(np.int32)
        vocab = np.frombuffer(block["vocab"], np.uint64)
        self.hashes, rank = np.unique(vocab & _LOW, return_inverse=True)
        rank = rank.astype(np.int32)
        starts = np.cumsum(lens) - lens
        near = np.empty_like(ids)
        near[1:] = ids[:-1]
        near[starts] = 0
        totals = totals.copy()
        totals[0] = totals[1]  # as many starts as ends
        ways = np.where(totals > HOT, -(-totals // HOT), 1).astype(np.int64)
        taken, split = (self._shards(vocab, sizes) % sizes.passes == g)[near], np.flatnonzero((ways > 1)[near])
        taken[split] = self._shards(self._keys(vocab, near[split], self._parts(vocab, ways, near[split], ids[split])), sizes) % sizes.passes == g
        at = np.flatnonzero(taken).astype(np.int32)
        u, w = near[at], ids[at]
        first, house = _distinct(u.astype(np.int64) << 32 | self._parts(vocab, ways, u, w))
        own, part = u[first], self._parts(vocab, ways, u[first], w[first])
        key = self._keys(vocab, own, part)
        shard = self._shards(key, sizes)
        order = np.lexsort((key, shard))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.key, self.part, self.ways, self.shard = key[order], part[order], ways[own][order], shard[order]
        house, w, far = place[house], rank[w], np.zeros(len(at), np.int32)
        if sizes.words > 1:
            # before a text's first word come two starts
            before = np.empty_like(near)
            before[1:] = near[:-1]
            before[starts] = 0
            far = rank[before[at]]
        first, self.gram = _distinct(_code(house, far, w, len(self.hashes)))
        self.at, self.house, self.far, self.w = at, house[first], far[first], w[first]
        learned = np.repeat(_read(block["train"], "?"), lens)[at]
        self.counts = np.bincount(self.gram[learned], minlength=len(first)).astype(np.uint32)

    @staticmethod
    def _parts(vocab: np.ndarray, ways: np.ndarray, near: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(near), np.int64)
        split = np.flatnonzero((ways > 1)[near])
        out[split] = ((vocab[ids[split]] & _LOW) >> np.uint64(16)).astype(np.int64) % ways[near[split]]
        return out

    @staticmethod
    def _keys(vocab: np.ndarray, near: np.ndarray, part: np.ndarray) -> np.ndarray:
        return vocab[near] + part.astype(np.uint64) * _PART

    @staticmethod
    def _shards(key: np.ndarray, sizes: _Sizes) -> np.ndarray:
        return (_mix(key) % np.uint64(sizes.shards)).astype(np.int64)

    def by_shard(self) -> Iterator[tuple[int, slice, slice]]:
        """Each shard, with its houses and its n-grams."""
        starts = _begins(self.shard).tolist()
        for a, z in zip(starts, [*starts[1:], len(self.shard)], strict=False):
            if z:
                yield int(self.shard[a]), slice(a, z), slice(*np.searchsorted(self.house, [a, z]).tolist())


def _gram_asks(block: dict, hot: tuple[np.ndarray, np.ndarray], sizes: _Sizes, g: int) -> pd.DataFrame:
    """a: of each house key, part and number of parts; b: its contexts, their far words and n-grams; c: the words that occur;
    d: each n-gram's word and count."""
    vocab = np.frombuffer(block["vocab"], np.uint64)
    place = np.minimum(np.searchsorted(hot[0], vocab), max(0, len(hot[0]) - 1))
    totals = np.where(hot[0][place] == vocab, hot[1][place], 0).astype(np.int64) if len(hot[0]) else np.zeros(len(vocab), np.int64)
    grams, rows = _Grams(block, totals, sizes, g), []
    for s, houses, own in grams.by_shard():
        house, far, w = grams.house[own], grams.far[own], grams.w[own]
        head = np.stack([grams.key[houses], grams.part[houses].astype(np.uint64), grams.ways[houses].astype(np.uint64)])
        starts = _begins(house, far)
        used, place = np.unique(np.concatenate([far[starts], w]), return_inverse=True)
        contexts = np.bincount(house[starts] - houses.start, minlength=head.shape[1]).astype(np.uint32)
        far = np.diff(place[: len(starts)], prepend=0).astype(np.int32)
        told = (_pack(contexts), _pack(far), _pack(np.diff(starts, append=len(w)).astype(np.uint32)))
        rows.append(_row(GRAMS, s, block["block"], _pack(head), pickle.dumps(told), _six(grams.hashes[used]), pickle.dumps((_pack(place[len(starts) :].astype(np.uint32)), _pack(grams.counts[own])))))
    return _frame(rows)


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers: the finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seeds: np.ndarray, draw: int) -> np.ndarray:
    """Numbers between 0 and 1, both excluded."""
    return ((_mix(seeds + np.uint64((draw + 1) * int(_PART) % (1 << 64))) >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def draw_gamma(shape: np.ndarray, seeds: np.ndarray, draw: int) -> np.ndarray:
    """Of Gamma(shape, 1), for shapes over 1/3: normal deviates cubed, accepted by the ratio of densities."""
    out, left, attempt = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(left):
        d = shape[left] - 1 / 3
        salt = (draw * 64 + attempt) * 3 + (1 << 40)
        a, b, u = (_uniform(seeds[left], salt + k) for k in range(3))
        z = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        v = np.maximum(1 + z / np.sqrt(9 * d), 1e-12) ** 3
        done = np.log(u) < 0.5 * z * z + d - d * v + d * np.log(v)
        out[left[done]] = (d * v)[done]
        left, attempt = left[~done], attempt + 1
    return out


def draw_tables(c: np.ndarray, alpha: np.ndarray, u: np.ndarray) -> np.ndarray:
    """t of 1..c with p(t) ~ S(c, t) alpha**t, from uniform numbers u, within 8 deviations and 8 of the mode.

    p(t + 1) / p(t) = 4 alpha (c - t) / ((2 c - t - 1) t) falls with t, so the mode is where it crosses 1.
    """
    out = np.ones(len(c), np.int64)
    two = c == 2
    out[two] += u[two] * (1 + 2 * alpha[two]) < 2 * alpha[two]
    rest = np.flatnonzero(c > 2)
    n, a = c[rest].astype(float), alpha[rest]
    b = 2 * n - 1 + 4 * a
    mode = np.clip(np.ceil(8 * a * n / (b + np.sqrt(np.maximum(0.0, b * b - 16 * a * n)))), 1, n)
    reach = 8 * np.sqrt(mode) + 8
    low = np.maximum(1, np.floor(mode - reach))
    width = (np.minimum(n, np.ceil(mode + reach)) - low).astype(np.int64) + 1
    order = np.argsort(width, kind="stable")
    at = 0
    while at < len(order):
        # rows of like width, a few megabytes at a time
        end = int(np.searchsorted(width[order], 2 * width[order[at]], "right"))
        end = min(end, at + max(1, 500_000 // int(width[order[end - 1]])))
        own = order[at:end]
        t = low[own, None] + np.arange(int(width[own[-1]]) - 1)
        some = n[own, None]
        ratio = 4 * a[own, None] * np.maximum(some - t, 0.0) / (np.maximum(2 * some - t - 1, 1.0) * t)
        with np.errstate(divide="ignore"):
            logs = np.cumsum(np.log(ratio), axis=1)
        top = np.maximum(0.0, logs.max(axis=1, initial=0.0))[:, None]
        weight = np.cumsum(np.hstack([np.exp(-top), np.exp(logs - top)]), axis=1)
        place = (weight < u[rest[own], None] * weight[:, -1:]).sum(axis=1)
        out[rest[own]] = low[own] + np.minimum(place, width[own] - 1)
        at = end
    return out


class Houses:
    """Restaurants of a shard: for each dish its house (sorted), word and customers c; for each house its key,
    part and number of parts.  What the other parts of a house have is told after a round, and before taken to be as its own."""

    def __init__(self, house: np.ndarray, words: np.ndarray, c: np.ndarray, keys: np.ndarray, part: np.ndarray, ways: np.ndarray):
        self.house, self.words, self.keys, self.part, self.ways = house, words, keys, part, ways
        self.dish_seeds = _mix(words ^ _mix(keys[house]))
        #: of a context, not of its part
        self.house_seeds = _mix(keys - part.astype(np.uint64) * _PART)
        #: how many times its own customers and tables a house has
        self.scale = ways.astype(float)
        self.elsewhere: np.ndarray | None = None
        self.seat(c)
        self.t = (c > 0).astype(np.int64)

    def seat(self, c: np.ndarray) -> None:
        """New customers; tables are those of before until the next sweep."""
        self.c, self.here, self.many = c, np.bincount(self.house, c, len(self.keys)), np.flatnonzero(c > 1)

    def own_tables(self) -> np.ndarray:
        return np.bincount(self.house, self.t, len(self.keys))

    def customers(self) -> np.ndarray:
        return self.here * self.scale if self.elsewhere is None else self.here + self.elsewhere[0]

    def tables(self) -> np.ndarray:
        own = self.own_tables()
        return own * self.scale if self.elsewhere is None else own + self.elsewhere[1]

    def sweep(self, parent: np.ndarray, strength: np.ndarray, draw: int) -> None:
        """Draws x for each house that has dishes of several customers, then their tables."""
        many, of = self.many, self.house[self.many]
        starts = _begins(of)
        own = of[starts]
        x = draw_gamma(np.broadcast_to(strength, len(self.keys))[own] / DISCOUNT + self.tables()[own], self.house_seeds[own], draw)
        self.t = (self.c > 0).astype(np.int64)
        self.t[many] = draw_tables(self.c[many], DISCOUNT * np.repeat(x, np.diff(starts, append=len(of))) * parent[many], _uniform(self.dish_seeds[many], draw))

    def shares(self, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each dish what its own customers give to its probability, and of each house what its parent's probability is taken times."""
        whole = strength + self.customers()
        return (self.c - DISCOUNT * self.t) / whole[self.house], (strength + DISCOUNT * self.tables()) / whole


class _Shard:
    """The restaurants of a shard: top holds the whole contexts; middle, for contexts of two words, those of the near word, in which each
    table of top is a customer.  dish: the dish of middle, or the word, that a dish of top has for its parent."""

    def __init__(self, keys: np.ndarray, part: np.ndarray, ways: np.ndarray, words: np.ndarray, house: np.ndarray, far: np.ndarray, per: np.ndarray, w: np.ndarray, c: np.ndarray, sizes: _Sizes):
        """house and far: of each context; per: its n-grams; w: each n-gram's place in words; c: its customers."""
        self.words, self.context = words, np.repeat(np.arange(len(per), dtype=np.int32), per)
        self.w, self.far, self.of, self.per = w, far, house, per
        if sizes.words == 1:
            self.top, self.middle = Houses(self.context, words[w], c, keys, part, ways), None
            return
        near = keys - part.astype(np.uint64) * _PART
        self.top = Houses(self.context, words[w], c, _mix(near[house] + _mix(words[far] ^ _PART)), np.zeros(len(house), np.int64), ways[house])
        self.top.scale = np.ones(len(house))
        first, self.dish = _distinct(_code(house[self.context], np.zeros(len(w), np.int32), w, len(words)))
        self.middle_w = w[first]
        self.middle = Houses(house[self.context[first]], words[self.middle_w], self.tables_of_top(), keys, part, ways)

    def tables_of_top(self) -> np.ndarray:
        return np.bincount(self.dish, self.top.t).astype(np.int64)

    def levels(self) -> list[Houses]:
        return [self.top] if self.middle is None else [self.top, self.middle]

    def divided(self) -> list[tuple[Houses, np.ndarray, np.ndarray]]:
        """Of each level, the houses that have other parts, and the names by which these know each other."""
        out = []
        for salt, h in enumerate(self.levels()):
            at = np.flatnonzero(h.ways > 1)
            out.append((h, at, _mix((h.keys[at] - h.part[at].astype(np.uint64) * _PART) ^ np.uint64(salt))))
        return out

    def run_round(self, parent: np.ndarray, strengths: np.ndarray, n_round: int) -> tuple[np.ndarray, np.ndarray]:
        """Sweeps of a round; parent: of each word in the root.  Over the last SAMPLES, the averages of what of an n-gram's probability is its own,
        and of what its context takes the root's probability times."""
        band = [strengths[k * _BANDS + band_of(h.customers())] for k, h in enumerate(self.levels())]
        own, rest = np.zeros(len(self.w)), np.zeros(len(self.per))
        if self.middle is not None:
            a, b = self.middle.shares(band[1])
        for k in range(BURN_IN + SAMPLES):
            draw = n_round * 100 + k
            if self.middle is None:
                self.top.sweep(parent[self.w], band[0], draw)
            else:
                self.top.sweep((a + b[self.middle.house] * parent[self.middle_w])[self.dish], band[0], draw)
                self.middle.seat(self.tables_of_top())
                self.middle.sweep(parent[self.middle_w], band[1], draw)
                a, b = self.middle.shares(band[1])
            if k >= BURN_IN:
                x, y = self.top.shares(band[0])
                own += (x if self.middle is None else x + y[self.context] * a[self.dish]) / SAMPLES
                rest += (y if self.middle is None else y * b[self.of]) / SAMPLES
        return own, rest


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.asarray(x, float).copy(), np.zeros(np.shape(x))
    for _ in range(6):
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def band_of(totals: np.ndarray) -> np.ndarray:
    return np.minimum(_BANDS - 1, np.floor(np.log2(np.maximum(1, totals))).astype(np.int64))


def strength_counts(strength: np.ndarray, totals: np.ndarray, tables: np.ndarray, band: np.ndarray, share: np.ndarray | float = 1.0) -> np.ndarray:
    """For each band, what the posterior of its strength adds to a Gamma's shape and rate, in expectation.  share: of a house, that is counted here."""
    own = totals > 1
    s, n, t, band, share = strength[own], totals[own], tables[own], band[own], np.broadcast_to(share, own.shape)[own]
    shape = s / DISCOUNT * (digamma(s / DISCOUNT + t) - digamma(s / DISCOUNT + 1))
    rate = digamma(s + n) - digamma(s + 1)
    return np.stack([np.bincount(band, share * shape, _BANDS), np.bincount(band, share * rate, _BANDS)])


def draw_strengths(counts: np.ndarray, n_round: int) -> np.ndarray:
    """One strength for each band, with the prior Gamma(1, 1)."""
    rng = np.random.default_rng(1000 + n_round)
    return np.maximum(1e-3, rng.gamma(1 + counts[0]) / (1 + counts[1]))


def _after_round(n_shard: int, own: _Shard, strengths: np.ndarray, sizes: _Sizes) -> list[dict]:
    """What the root and the strengths learn from a shard: tables of each word; customers and tables of each part of a divided context."""
    seen = []
    for k, h in enumerate(own.levels()):
        totals, band = h.customers(), band_of(h.customers())
        # a context of two words may have other parts or not, and counts once they have been told
        share = np.where((h.ways > 1) & (h.scale == 1) & (h.elsewhere is None), 0.0, h.here / np.maximum(1, totals))
        seen.append(strength_counts(strengths[k * _BANDS + band], totals, h.tables(), band, share))
    out = [_row(STRENGTHS, 0, n_shard, np.concatenate(seen, axis=1).astype("<f8").tobytes())]
    last, w = (own.top, own.w) if own.middle is None else (own.middle, own.middle_w)
    sent = np.bincount(w, last.t, len(own.words)).astype(np.uint32)
    told = own.divided()
    names = np.concatenate([x for _, _, x in told])
    sums = np.stack([np.concatenate([h.here[at] for h, at, _ in told]), np.concatenate([h.own_tables()[at] for h, at, _ in told])]).astype("<u4")
    at_words, at_parts = dict(_by(_word_shard(own.words, sizes.word_shards))), dict(_by(_word_shard(names, sizes.word_shards)))
    none = np.zeros(0, np.int64)
    for s in sorted({*at_words, *at_parts}):
        w, p = at_words.get(s, none), at_parts.get(s, none)
        out.append(_row(TO_ROOT, s, n_shard, _six(own.words[w]), _pack(sent[w]), names[p].tobytes(), _pack(sums[:, p])))
    return out


def _gathered(asks: DataFrame, sizes: _Sizes) -> DataFrame:
    """The restaurants of each shard, with one table for each dish."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        n_shard = int(own["to"].iloc[0])
        heads = [_read(x, "<u8").reshape(3, -1) for x in own["a"]]
        keys, first, place = np.unique(np.concatenate([x[0] for x in heads]), return_index=True, return_inverse=True)
        part, ways = (np.concatenate([x[k] for x in heads])[first].astype(np.int64) for k in (1, 2))
        houses = np.split(place, np.cumsum([x.shape[1] for x in heads])[:-1])
        used = [_from_six(x) for x in own["c"]]
        words, place = np.unique(np.concatenate(used), return_inverse=True)
        house, far, w, lens = [], [], [], []
        for at, ours, b, d in zip(np.split(place, np.cumsum([len(x) for x in used])[:-1]), houses, own["b"], own["d"], strict=True):
            contexts, fars, per = (_read(x, kind) for x, kind in zip(pickle.loads(b), ("<u4", "<i4", "<u4"), strict=True))
            house.append(np.repeat(np.repeat(ours, contexts), per).astype(np.int32))
            far.append(np.repeat(at[np.cumsum(fars)], per).astype(np.int32))
            w.append(at[_read(pickle.loads(d)[0], "<u4")].astype(np.int32))
            lens.append(len(w[-1]))
        house, far, w = np.concatenate(house), np.concatenate(far), np.concatenate(w)
        first, dish = _distinct(_code(house, far, w, len(words)))
        c = np.bincount(dish, np.concatenate([_read(pickle.loads(x)[1], "<u4") for x in own["d"]]), len(first)).astype(np.int64)
        house, far, w = house[first], far[first], w[first]
        starts = _begins(house, far)
        per = np.diff(starts, append=len(w))
        shard = _Shard(keys, part, ways, words, house[starts], far[starts], per, w, c, sizes)
        state = {
            "keys": keys.tobytes(), "part": _pack(part), "ways": _pack(ways), "words": _six(words), "contexts": _pack(np.bincount(house[starts], minlength=len(keys)).astype(np.uint32)),
            "far": _pack(np.diff(far[starts], prepend=np.int32(0))), "per": _pack(per.astype(np.uint32)), "w": _pack(w.astype(np.uint32)), "c": _pack(c.astype(np.uint32)),
            "t": [_pack(h.t.astype(np.uint32)) for h in shard.levels()], "dish": _pack(np.diff(dish, prepend=np.int32(0))), "asks": (own["of"].tolist(), lens),
        }
        return _frame([_row(STATE, n_shard, n_shard, pickle.dumps(state)), *_after_round(n_shard, shard, np.full(sizes.words * _BANDS, STRENGTH), sizes)])

    return asks.groupBy("to").applyInPandas(run, _ROW)


def _restored(s: dict, sizes: _Sizes) -> _Shard:
    keys, per = np.frombuffer(s["keys"], "<u8"), _read(s["per"], "<u4")
    house, far = np.repeat(np.arange(len(keys)), _read(s["contexts"], "<u4")), np.cumsum(_read(s["far"], "<i4"), dtype=np.int32)
    shard = _Shard(keys, _read(s["part"], "<i8"), _read(s["ways"], "<i8"), _from_six(s["words"]), house, far, per, _read(s["w"], "<u4"), _read(s["c"], "<u4").astype(np.int64), sizes)
    for h, t in zip(shard.levels(), s["t"], strict=True):
        h.t = _read(t, "<u4").astype(np.int64)
    if shard.middle is not None:
        shard.middle.seat(shard.tables_of_top())
    return shard


def _sample_root(asks: DataFrame, sent: DataFrame, sizes: _Sizes, n_round: int) -> DataFrame:
    """Seats the tables of all contexts in the root.  Answers to blocks and shards: a, the words' customers less
    discounts; b, to shards, the customers and tables of divided contexts over all their parts, and to blocks, the words' training counts; c, in
    a shard's first row, customers and tables."""

    def run(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        shard = int(own["to"].iloc[0] if len(own) else got["to"].iloc[0])
        told = [_from_six(x) for x in got["a"]]
        words, at = np.unique(np.concatenate([*told, np.zeros(0, "<u8")]), return_inverse=True)
        k = np.bincount(at, np.concatenate([*(_read(x, "<u4") for x in got["b"]), np.zeros(0)]), len(words)).astype(np.int64)
        here = np.flatnonzero(k > 0)
        h = Houses(np.zeros(len(here), np.int64), words[here], k[here], np.array([START], np.uint64), np.array([0]), np.array([1]))
        h.scale = np.array([sizes.v / max(1, len(here))])
        t, draws = np.zeros(len(here)), BURN_IN + SAMPLES
        for n in range(draws):
            h.sweep(np.full(len(here), 1 / (sizes.v + 1)), np.array([ROOT_STRENGTH]), n_round * 100 + 50 + n)
            t += h.t / SAMPLES if n >= BURN_IN else 0
        left = np.zeros(len(words) + 1, "<f4")
        left[here] = k[here] - DISCOUNT * t
        contexts, place = np.unique(np.concatenate([*(np.frombuffer(x, "<u8") for x in got["c"]), np.zeros(0, "<u8")]), return_inverse=True)
        parts = np.concatenate([*(_read(x, "<u4").reshape(2, -1) for x in got["d"]), np.zeros((2, 0), "<u4")], axis=1)
        sums = np.stack([np.bincount(place, x, len(contexts)) for x in parts])[:, place]
        of_parts = np.split(sums, np.cumsum([len(x) // 8 for x in got["c"]])[:-1], axis=1) if len(got) else []
        rows = [_row(ROOT_TO_SHARD, to, shard, _pack(x), _pack(y)) for to, x, y in zip(got["of"], np.split(left[at], np.cumsum([len(x) for x in told])[:-1]) if len(got) else [], of_parts, strict=True)]
        asked = [np.frombuffer(x, np.uint64) for x in own["a"]]
        _, total, entry = _totals(asked, own["b"])
        for block, ws, n in zip(own["of"], asked, np.split(total[entry], np.cumsum([len(x) for x in asked])[:-1]) if len(own) else [], strict=True):
            low = ws & _LOW
            found = np.searchsorted(words, low)
            found[found == len(words)] = 0
            hit = words[found] == low if len(words) else np.zeros(len(low), bool)
            rows.append(_row(ROOT_TO_BLOCK, block, shard, _pack(left[np.where(hit, found, len(words))]), _pack(n)))
        if rows:
            rows[0]["c"] = np.array([k.sum(), t.sum()], "<f8").tobytes()
        return _frame(rows)

    return asks.groupBy("to").cogroup(sent.groupBy("to")).applyInPandas(run, _ROW)


class _Root:
    """The root's predictions from the customers less discounts."""

    def __init__(self, customers: float, tables: float, v: int, n_round: int):
        counts = strength_counts(np.array([ROOT_STRENGTH]), np.array([customers]), np.array([max(1.0, tables)]), np.array([0]))
        self.strength = float(draw_strengths(counts, -n_round - 1)[0]) if customers else ROOT_STRENGTH
        self.rest, self.of = (self.strength + DISCOUNT * tables) / (v + 1), self.strength + customers

    def __call__(self, left: np.ndarray) -> np.ndarray:
        return (left.astype(float) + self.rest) / self.of


def _next_round(state: DataFrame, answers: DataFrame, sizes: _Sizes, root: _Root, strengths: np.ndarray, n_round: int, last: bool) -> DataFrame:
    """Samples the restaurants given the root.  After the last round, answers to blocks: a, of each n-gram, what its own restaurants give to its
    probability; b, of each context, what the root's probability is taken times.  Before, the next state.  Always what the root learns."""

    def run(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        n_shard, s = int(own["to"].iloc[0]), pickle.loads(own["a"].iloc[0])
        shard = _restored(s, sizes)
        told = shard.divided()
        names = np.concatenate([x for _, _, x in told])
        left, sums = np.zeros(len(shard.words), "<f4"), np.zeros((2, len(names)))
        at_words, at_parts = dict(_by(_word_shard(shard.words, sizes.word_shards))), dict(_by(_word_shard(names, sizes.word_shards)))
        for of, a, b in zip(got["of"].tolist(), got["a"], got["b"], strict=True):
            if of in at_words:
                left[at_words[of]] = _read(a, "<f4")
            if of in at_parts:
                sums[:, at_parts[of]] = _read(b, "<f8").reshape(2, -1)
        for (h, at, _), x in zip(told, np.split(sums, np.cumsum([len(x) for _, _, x in told])[:-1], axis=1), strict=True):
            h.elsewhere = np.zeros((2, len(h.keys)))
            h.elsewhere[:, at] = x - np.stack([h.here, h.own_tables()])[:, at]
        own_share, rest = shard.run_round(root(left), strengths, n_round)
        out = _after_round(n_shard, shard, strengths, sizes)
        if not last:
            s["t"] = [_pack(h.t.astype(np.uint32)) for h in shard.levels()]
            return _frame([_row(STATE, n_shard, n_shard, pickle.dumps(s)), *out])
        a, b, context = own_share.astype("<f4"), rest.astype("<f4"), shard.context
        blocks, n_grams = s["asks"]
        for block, dish in zip(blocks, np.split(np.cumsum(_read(s["dish"], "<i4"), dtype=np.int32), np.cumsum(n_grams)[:-1]), strict=True):
            contexts = context[dish]
            out.append(_row(GRAMS, block, n_shard, _pack(a[dish]), _pack(b[contexts[_begins(contexts)]])))
        return _frame(out)

    return state.groupBy("to").cogroup(answers.groupBy("to")).applyInPandas(run, _ROW)


def _score(block: dict, answers: pd.DataFrame, sizes: _Sizes, root: _Root) -> pd.DataFrame:
    vocab = np.frombuffer(block["vocab"], np.uint64)
    totals = _answers(answers, "b", vocab, sizes.word_shards, "<u8").astype(np.int64)
    parent = root(_answers(answers, "a", vocab, sizes.word_shards, "<f4"))
    own = answers[answers["kind"] == GRAMS]
    got = {s: (a, b) for s, a, b in zip(own["of"].tolist(), own["a"], own["b"], strict=True)}
    ids, lens = _read(block["ids"], "<u4"), _read(block["lens"], "<i4")
    starts, logs = np.cumsum(lens) - lens, np.zeros(len(ids))
    for g in range(sizes.passes):
        grams = _Grams(block, totals, sizes, g)
        share, rest = np.zeros(len(grams.w), np.float32), np.zeros(len(grams.w), np.float32)
        for s, _, mine in grams.by_shard():
            begins = _begins(grams.house[mine], grams.far[mine])
            share[mine] = _read(got[s][0], "<f4")
            rest[mine] = np.repeat(_read(got[s][1], "<f4"), np.diff(begins, append=mine.stop - mine.start))
        logs[grams.at] = np.log10(np.minimum(1.0, share[grams.gram] + rest[grams.gram] * parent[ids[grams.at]]))
    plain = np.log10((totals + 1) / (sizes.n + sizes.v + 1))
    docs = _read(block["docs"], "<i8").reshape(-1, 2)
    score = np.add.reduceat(logs, starts)
    return pd.DataFrame({
        "doc_id": [str(d) if known else None for d, known in docs.tolist()], "n_tokens": lens.astype(np.int64), "n_known": np.add.reduceat((totals[ids] > 0).astype(np.int64), starts),
        "train_tokens": sizes.n, "base_score": np.add.reduceat(plain[ids], starts), "score": score, "perplexity": 10.0 ** np.minimum(300, -score / lens),
    })


def _sum(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """The sum of arrays of n doubles; empty ones count as zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n)
        for batch in batches:
            for x in batch[column]:
                total += np.frombuffer(x, "<f8") if len(x) else 0
        yield pd.DataFrame({"k": range(n), "v": total})

    got = {r["k"]: r["v"] for r in rows.select(column).mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return np.array([got.get(k, 0.0) for k in range(n)])


def score(documents: DataFrame, learn: Column, words: int = 1) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row; learn says which rows are learned from.

    words: how many words a context has, 1 or 2.  base_score is that of add-one word frequencies, score that of the model, in log10;
    perplexity is 10 ** (-score / n_tokens).
    """
    if words not in (1, 2):
        raise InvalidArgument("contexts have one word or two")
    conf = documents.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")  # a finished shuffle would take disk until the driver collects its garbage
    try:
        return _scored(documents, learn, words)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)


def _scored(documents: DataFrame, learn: Column, words: int) -> DataFrame:
    spark = documents.sparkSession
    common.ready(spark)
    blocks = common.materialize(_blocks(documents, learn), "blocks")
    tokens, n = blocks.agg(F.sum("tokens"), F.sum("learned")).first()
    tokens, n = tokens or 0, n or 0
    word_shards, shards = 4 + int(words * tokens // WORD_SHARD_TOKENS), 4 + int(words * tokens // SHARD_TOKENS)
    asked = _word_asks(blocks, word_shards)
    counted = common.materialize(_count_words(asked), "counted")
    known, n_hot = _sum(counted, "a", 1)[0], _sum(counted, "d", 1)[0]
    sizes = _Sizes(n, int(known), word_shards, shards, words, min(PASSES, 1 + int(tokens // SHARD_TOKENS)))
    hot = spark.sparkContext.broadcast(_hot_of(counted.select("b", "c").toPandas())) if n_hot <= MOST_HOT else None

    def asks(g: int) -> DataFrame:
        if hot is not None:

            def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for block in batch.to_dict("records"):
                        yield _gram_asks(block, hot.value, sizes, g)

            return blocks.mapInPandas(ask, _ROW)

        def ask_told(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            return _gram_asks(own.iloc[0].to_dict(), _hot_of(told), sizes, g)

        return blocks.groupBy("block").cogroup(_tell_hot(asked).groupBy("to")).applyInPandas(ask_told, _ROW)

    done = [common.materialize(_gathered(asks(g), sizes), "round", by="kind") for g in range(sizes.passes)]
    nobody = spark.createDataFrame([], _ROW)
    for k in range(1, ROUNDS + 1):
        root, roots = _root(nobody, done, sizes, k)
        seen = _sum(_all(done).where(F.col("kind") == STRENGTHS), "a", 2 * words * _BANDS)
        strengths = draw_strengths(seen.reshape(2, words * _BANDS), k)
        for g, one in enumerate(done):
            state, told = one.where(F.col("kind") == STATE), roots.where((F.col("kind") == ROOT_TO_SHARD) & (F.col("to") % sizes.passes == g))
            done[g] = common.materialize(_next_round(state, told, sizes, root, strengths, k, k == ROUNDS), "round", by="kind")
            common.drop(one)
        common.drop(roots)
    root, roots = _root(asked, done, sizes, ROUNDS + 1)

    def final(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _score(own.iloc[0].to_dict(), answers, sizes, root)

    answers = roots.where(F.col("kind") == ROOT_TO_BLOCK).unionByName(_all(done).where(F.col("kind") == GRAMS))
    scored = []
    for g in range(sizes.passes):
        mine = lambda block, g=g: F.pmod(F.xxhash64(block), F.lit(sizes.passes)) == g
        own = blocks.where(mine("block")).groupBy("block").cogroup(answers.where(mine("to")).groupBy("to"))
        scored.append(common.materialize(own.applyInPandas(final, _SCORES), "scores"))
    for x in (blocks, roots, *done):
        common.drop(x)
    return _all(scored).withColumn("doc_id", F.col("doc_id").cast("long"))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _root(asked: DataFrame, done: list[DataFrame], sizes: _Sizes, n_round: int) -> tuple[_Root, DataFrame]:
    """The root after the contexts' round, and its answers."""
    roots = common.materialize(_sample_root(asked, _all(done).where(F.col("kind") == TO_ROOT), sizes, n_round), "root", by="kind")
    for x in done:
        common.drop(x, f"kind={TO_ROOT}")
    customers, tables = _sum(roots, "c", 2)
    return _Root(customers, tables, sizes.v, n_round), roots
