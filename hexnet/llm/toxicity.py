"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

An example is a TF-IDF vector over all of its words, none left out: (1 + log tf) * idf * relevance, of unit
length.  relevance is sqrt(1 + z * z), with z the deviations by which a word's share among toxic examples differs
from that among clean ones, so that words that tell nothing still count as in plain TF-IDF (1 for every word,
with ``relevance=False``).  A text's vector is over the words that the examples have.

The inverted index has the examples in blocks of BLOCK, ordered by label and number of words.  A text's nearest K are found exactly:

1. the lists of words that at most a SHARE of the examples have, and of the FIRST longer ones that can add most to
   a cosine, are added up for all examples;
2. for the other lists, the largest weight of each block bounds what they could add; the K best of
   the examples with the highest sums so far, scored in full, set the line;
3. only examples whose sum and bound reach the line are scored in full.

The nearest K vote with weights that fall with the cosine distance; a logistic curve fitted on
leave-one-out votes of the examples calibrates the share of toxic votes.  The nearest examples, and the words
that add most to the cosine with the nearest one, are the evidence.

Examples are about ``per_class`` labelled documents of each label of at most EXAMPLE_CHARS characters (chosen by the
hashes of their ids), fewer where their characters exceed SAMPLE_CHARS; the index, bounded by them, is sent to
every task.  Votes are weighted by how many labelled documents an example stands for.  Every text is read whole.

Defined results: a null or empty text, and one without a word that an example has, gets the share of toxic
documents among the examples without words; without labels of both kinds every score is the smoothed share of toxic
labels; examples equally near are taken in the order of the index; an empty table gives no row; repeated rows
are scored as often as they come; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PER_CLASS = 3000
EXAMPLE_CHARS, SAMPLE_CHARS = 200_000, 16 << 20
K = 25
BLOCK = 16
SHARE = 1 / 16
FIRST = 24
#: Words given as evidence.
TOLD = 5
_BETWEEN = bytes(k if k >= 128 or chr(k).isalpha() else 32 for k in range(256))
_REMEMBERED = 100_000


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and of everything beyond ASCII, in lower case, as UTF-8."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BETWEEN).split()


class Counts:
    """Words of texts: at (word -> number), and of one text after the other the words' numbers and how often they come."""

    def __init__(self, texts):
        self.at: dict[bytes, int] = {}
        which, tf, lens = [], [], []
        for t in texts:
            own = Counter(words_of(t))
            which.append(np.fromiter((self.at.setdefault(w, len(self.at)) for w in own), np.int32, len(own)))
            tf.append(np.fromiter(own.values(), np.int32, len(own)))
            lens.append(len(own))
        none = np.zeros(0, np.int32)
        self.which, self.tf, self.lens = np.concatenate([none, *which]), np.concatenate([none, *tf]), np.array(lens, np.int64)


class Index:
    """examples: (doc_id, label, weight), in the order of doc_id; counts: of their texts."""

    def __init__(self, examples: list[tuple[int, int, float]], counts: Counts, prior: float, relevance: bool = True):
        self.prior = prior
        full, rest = [x for x, n in zip(examples, counts.lens, strict=True) if n], [x for x, n in zip(examples, counts.lens, strict=True) if not n]
        self.bare = (sum(x[2] * x[1] for x in rest) + prior) / (sum(x[2] for x in rest) + 1)
        self.at, which, lens = counts.at, counts.which, counts.lens[counts.lens > 0]
        labels = np.array([x[1] for x in full], float)
        seen, toxic = np.bincount(which, minlength=len(self.at)), np.bincount(which, np.repeat(labels, lens), len(self.at))
        n, n1 = len(full), labels.sum()
        self.worth = np.log((n + 1) / (seen + 0.5))
        if relevance and 0 < n1 < n:
            p = seen / n
            z = (toxic / n1 - (seen - toxic) / (n - n1)) / np.sqrt(np.maximum(1e-12, p * (1 - p) * (1 / n1 + 1 / (n - n1))))
            self.worth = self.worth * np.sqrt(1 + z * z)
        values = (1 + np.log(counts.tf)) * self.worth[which]
        row = np.repeat(np.arange(n), lens)
        values = values / np.maximum(1e-300, np.sqrt(np.bincount(row, values * values, n)))[row]
        # like examples beside each other: by label, then by the number of words, on which weights depend
        order = np.lexsort((np.arange(n), lens, labels))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.doc_ids, self.labels, self.weights = [full[k][0] for k in order], labels[order], np.array([full[k][2] for k in order], float)
        self.size = n
        #: word -> its list of examples and their weights
        row = place[row]
        own = np.lexsort((row, which))
        self.list_of, self.list_weights, self.list_ends = row[own].astype(np.int32), values[own], np.concatenate([[0], np.cumsum(seen)]).astype(np.int64)
        self.curve = (1.0, 0.0)
        self._ready()

    def __getstate__(self) -> dict:
        """Without what follows from the lists."""
        return {k: getattr(self, k) for k in ("prior", "bare", "at", "worth", "doc_ids", "labels", "weights", "size", "list_of", "list_weights", "list_ends", "curve")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _ready(self) -> None:
        n, self.lens = self.size, np.diff(self.list_ends)
        #: example -> its words and their weights
        own = np.argsort(self.list_of, kind="stable")
        self.example_words, self.example_weights = np.repeat(np.arange(len(self.at), dtype=np.int32), self.lens)[own], self.list_weights[own]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(self.list_of, minlength=n))]).astype(np.int64)
        #: long lists as columns of a matrix with a row for each example, and the largest weight of each of their blocks
        long = np.flatnonzero(self.lens > SHARE * n)
        self.long_row = np.full(len(self.at), -1, np.int32)
        self.long_row[long] = np.arange(len(long))
        self.columns = np.zeros((n, len(long)))
        for k, w in enumerate(long):
            part = slice(self.list_ends[w], self.list_ends[w + 1])
            self.columns[self.list_of[part], k] = self.list_weights[part]
        starts = np.arange(0, n, BLOCK)
        self.most = np.ascontiguousarray(np.maximum.reduceat(self.columns, starts, axis=0).T) if n and len(long) else np.zeros((len(long), len(starts)))
        self.top = self.most.max(axis=1, initial=0.0)
        self.memory: dict[bytes, tuple[float, list[int], list[str]]] = {}
        #: examples that were compared, and those scored in full
        self.compared = self.scored = 0

    def vector(self, tf: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The words of a text that examples have, and their weights."""
        found = [(self.at[w], n) for w, n in tf.items() if w in self.at]
        which = np.array([k for k, _ in found], np.int64)
        w = (1 + np.log(np.array([n for _, n in found], float))) * self.worth[which] if found else np.zeros(0)
        order = np.argsort(which)
        length = math.sqrt(float(w @ w))
        return which[order], w[order] / (length or 1.0)

    def nearest(self, which: np.ndarray, w: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the K nearest examples that share a word, nearest first, ties by place.

        Cosines are rounded to nine decimals, so that equal ones are ties.
        """
        row = self.long_row[which]
        rest = np.flatnonzero(row >= 0)
        if len(rest) > FIRST:
            rest = rest[np.argpartition(w[rest] * self.top[row[rest]], -FIRST)[:-FIRST]]
        else:
            rest = rest[:0]
        added = np.ones(len(which), bool)
        added[rest] = False
        at, lens = self.list_ends[which[added]], self.lens[which[added]]
        ends = np.cumsum(lens)
        every = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - lens), lens)
        known = np.bincount(self.list_of[every], self.list_weights[every] * np.repeat(w[added], lens), self.size)
        rows, heavy = row[rest], w[rest]
        upper = known + np.repeat(heavy @ self.most[rows], BLOCK)[: self.size]
        if leave >= 0:
            known[leave], upper[leave] = -1.0, -1.0
        some = np.argpartition(known, -2 * K)[-2 * K :] if self.size > 2 * K else np.arange(self.size)
        first = known[some] + heavy @ self.columns[some][:, rows].T
        line = np.partition(first, -K)[-K] if len(first) > K else -1.0
        some = np.flatnonzero((upper > 0) & (upper >= line - 1e-9))
        self.compared += self.size
        self.scored += len(some)
        cosines = np.round(known[some] + heavy @ self.columns[some][:, rows].T, 9)
        best = np.lexsort((some, -cosines))[:K]
        best = best[cosines[best] > 0]
        return cosines[best], some[best]

    def vote(self, cosines: np.ndarray, best: np.ndarray) -> float:
        w = self.weights[best] / (1.05 - cosines)
        return float((w @ self.labels[best] + self.prior) / (w.sum() + 1))

    def evidence(self, which: np.ndarray, w: np.ndarray, example: int) -> list[int]:
        """The words that add most to the cosine with an example."""
        part = slice(self.ends[example], self.ends[example + 1])
        both, mine, other = np.intersect1d(which, self.example_words[part], assume_unique=True, return_indices=True)
        return both[np.argsort(-w[mine] * self.example_weights[part][other], kind="stable")[:TOLD]].tolist()

    def score(self, text: str | None) -> tuple[float, list[int], list[str]]:
        """Score, ids of the three nearest examples, evidence."""
        key = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key not in self.memory:
            if len(self.memory) > _REMEMBERED:
                self.memory.clear()
            self.memory[key] = self._score(text)
        return self.memory[key]

    def _score(self, text: str | None) -> tuple[float, list[int], list[str]]:
        which, w = self.vector(Counter(words_of(text)))
        cosines, best = self.nearest(which, w) if len(which) else (np.zeros(0), np.zeros(0, np.int64))
        if not len(best):
            return self.bare, [], []
        a, b = self.curve
        p = _sigmoid(a * _logit(self.vote(cosines, best)) + b)
        return p, [self.doc_ids[k] for k in best[:3]], [self.named(k) for k in self.evidence(which, w, int(best[0]))]

    def named(self, word: int) -> str:
        if not hasattr(self, "names"):
            self.names = list(self.at)
        return self.names[word].decode("utf-8", "replace")

    def calibrate(self) -> None:
        if not self.size:
            return
        votes = []
        for k in range(self.size):
            part = slice(self.ends[k], self.ends[k + 1])
            cosines, best = self.nearest(self.example_words[part].astype(np.int64), self.example_weights[part], leave=k)
            votes.append(_logit(self.vote(cosines, best) if len(best) else self.bare))
        x, y, n = np.array(votes), self.labels, self.weights / self.weights.mean()
        a, b = 1.0, 0.0
        for _ in range(100):  # Newton's steps, with a prior around the votes as they are
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
            d, h = n * (p - y), n * p * (1 - p) + 1e-9
            grad = np.array([d @ x + 5 * (a - 1), d.sum() + 5 * b])
            move = np.linalg.solve(np.array([[h @ x**2 + 5, h @ x], [h @ x, h.sum() + 5]]), grad)
            a, b = a - move[0], b - move[1]
            if np.abs(move).max() < 1e-9:
                break
        if a > 0:
            self.curve = (float(a), float(b))


def _logit(p: float) -> float:
    p = min(0.9999, max(0.0001, p))
    return math.log(p / (1 - p))


def _sigmoid(v: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, v))))


def fit(documents: DataFrame, labels: DataFrame, keep: Column, per_class: int = PER_CLASS, relevance: bool = True) -> Index:
    """The index of examples from labels (doc_id, toxic) of the ids that keep, an expression over doc_id, selects."""
    common.ready(documents.sparkSession)
    known = {r["label"]: r["count"] for r in common.once_per_id(labels, "toxic").where(keep).groupBy(F.least(F.col("label"), F.lit(1)).alias("label")).count().collect()}
    prior = (known.get(1, 0) + 0.5) / (sum(known.values()) + 1)
    chosen = common.labelled_sample(documents, labels, "toxic", keep, per_class, EXAMPLE_CHARS, SAMPLE_CHARS)

    found = chosen.collect() if len(known) == 2 else []
    found.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    of = Counter(r["label"] for r in found)
    each = {y: known[y] / n for y, n in of.items()}
    least = min(each.values(), default=1.0)
    index = Index([(r["doc_id"], r["label"], each[r["label"]] / least) for r in found], Counts(r["text"] for r in found), prior, relevance)
    index.calibrate()
    return index


def predict(documents: DataFrame, index: Index, *columns: Column | str) -> DataFrame:
    """The columns given, score, predicted (1: toxic), neighbours (ids of the nearest examples), terms."""
    spark = documents.sparkSession
    common.ready(spark)
    sent = spark.sparkContext.broadcast(index)

    @F.pandas_udf("score double, neighbours array<long>, terms array<string>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in texts:
            yield pd.DataFrame([own.score(t) for t in batch], columns=["score", "neighbours", "terms"])

    out = documents.select(*columns, of("text").alias("__p")).select("*", "__p.*").drop("__p")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
