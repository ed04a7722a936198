"""Text quality by a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad.  The potentials of a line's labels are linear in features of the line
and of the lines beside it: shares of kinds of characters and words, hashed words, and the order of words (pairs of
the shapes of words that follow each other, with the line's start and end).  A table of four weights joins the labels
of neighbouring lines.  Forward and backward passes give the marginal probability that a line is good; their mean,
weighted by the lengths of the lines, is the document's quality, calibrated by a logistic curve.

Labels are of documents, and lines may differ from them: a line has its document's label with probability AGREE, and
the field maximizes the likelihood of the documents' labels with the lines' labels summed out.  Each
step compares the marginals given the document's label with those without it.  The field is fitted on the
driver, on the whole chains of about ``per_class`` labelled documents of each label of at most EXAMPLE_CHARS
characters, fewer where their characters exceed SAMPLE_CHARS.  Scoring reads every line of every text.

Defined results: a null, empty or blank text has one line without words; repeated rows are scored as
often as they come; a score of exactly 0.5 counts as good; without labels of both kinds every score is 0.5 or the
share of good labels; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PER_CLASS = 2500
EXAMPLE_CHARS, SAMPLE_CHARS = 200_000, 8 << 20
#: How often a line has its document's label.
AGREE = 0.9
#: Buckets of hashed words, and shapes of words; the last shape is a line's start or end.
BUCKETS, SHAPES = 1 << 13, 16
_REMEMBERED = 300_000
_MARKS = dict.fromkeys(map(ord, "!#$%&*@^~=<>{}[]|\\/_+"), None)
_ENDS = ".,;:?!"
N_OWN = 16


def line_features(line: str) -> list[float]:
    """N_OWN numbers, mostly shares between 0 and 1."""
    words = line.split()
    n, chars = len(words), len(line)
    if not n:
        return [1.0] + [0.0] * (N_OWN - 1)
    letters = sum(map(len, words))
    kinds = set(words)
    plain = len(line.translate(_MARKS))
    upper = sum(map(str.isupper, words))
    pipes = line.count("|")
    bangs = line.count("!")
    digits = sum(map(line.count, "0123456789"))
    same = sum(map(str.__eq__, words[1:], words))
    ends = sum(w[-1] in _ENDS for w in kinds)
    return [
        0.0, math.log1p(n) / 5, math.log1p(chars) / 8, letters / n / 10, len(kinds) / n, upper / n, (chars - plain) / chars,
        min(1.0, pipes / n), min(1.0, bangs / n), digits / chars, same / n, ends / len(kinds), float(n < 4), float(same > 2),
        float(chars - plain > 0.3 * n), float(upper > 0.5 * n),
    ]


def shape_of(word: str) -> int:
    """Whether a word is small, capitalized, in capitals, with a digit or another, and what mark ends it."""
    core = word.rstrip(_ENDS)
    if core.islower():
        kind = 0
    elif core.isupper() and len(core) > 1:
        kind = 2
    elif core[:1].isupper():
        kind = 1
    else:
        kind = 3 if any(map(str.isdigit, core)) else 4
    return 3 * kind + (0 if core == word else 2 if word[-1] in ".?!" else 1)


def bucket_of(word: str) -> int:
    return zlib.crc32(word.lower().strip(_ENDS).encode("utf-8", "surrogatepass")) % BUCKETS


class _Memory(dict):
    """What is known of words; emptied when it gets too large."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = value = self.of(word)
        return value


def describe(text: str | None) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Features of each line with those of its neighbours and of its place, the lines' lengths and words."""
    lines = (text or "").split("\n")
    seen: dict[str, int] = {}
    own = np.array([line_features(x) for x in lines])
    again = np.zeros((len(lines), 1))
    for k, x in enumerate(lines):
        if x and seen.setdefault(x, k) != k:
            again[k] = 1
    own = np.hstack([own, again])
    around = np.zeros_like(own)
    before, after = np.vstack([around[:1], own[:-1]]), np.vstack([own[1:], around[:1]])
    place = np.zeros((len(lines), 3))
    place[0, 0] = place[-1, 1] = 1
    place[:, 2] = len(lines) == 1
    return np.hstack([own, before, after, place, np.ones((len(lines), 1))]), np.array([len(x) + 1.0 for x in lines]), [x.split() for x in lines]


def sparse_features(words: list[str], shapes: _Memory, buckets: _Memory) -> tuple[list[int], list[float]]:
    """Places and values of a line's words and pairs of shapes; each kind sums to 1."""
    if not words:
        return [], []
    s = [SHAPES - 1, *map(shapes.__getitem__, words), SHAPES - 1]
    n = len(words)
    return [*map(buckets.__getitem__, words), *(BUCKETS + SHAPES * a + b for a, b in zip(s, s[1:], strict=False))], [1 / n] * n + [1 / (n + 1)] * (n + 1)


WIDTH = 3 * (N_OWN + 1) + 4
SPARSE = BUCKETS + SHAPES * SHAPES


class Field:
    """w: weights of the potential of "good" against "bad", sparse: those of words and shapes; join: [label before, label] -> weight."""

    def __init__(self, w: np.ndarray, sparse: np.ndarray, join: np.ndarray, curve: tuple[float, float]):
        self.w, self.sparse, self.join, self.curve = w, sparse, join, curve
        self._ready()

    def _ready(self) -> None:
        words, pairs = self.sparse[:BUCKETS].tolist(), self.sparse[BUCKETS:].reshape(SHAPES, SHAPES).tolist()
        self._shape = _Memory(shape_of)
        self._word = _Memory(lambda w: words[bucket_of(w)])
        self._pair = {(a, b): pairs[a][b] for a in range(SHAPES) for b in range(SHAPES)}

    def __reduce__(self):
        return Field, (self.w, self.sparse, self.join, self.curve)

    def potentials(self, x: np.ndarray, words: list[list[str]]) -> np.ndarray:
        more = []
        for line in words:
            s = [SHAPES - 1, *map(self._shape.__getitem__, line), SHAPES - 1]
            more.append(sum(map(self._word.__getitem__, line)) / len(line) + sum(map(self._pair.__getitem__, zip(s, s[1:], strict=False))) / (len(line) + 1) if line else 0.0)
        return np.clip(x @ self.w + np.array(more), -30, 30)

    def marginals(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the lines' lengths."""
        x, lengths, words = describe(text)
        return chain(self.potentials(x, words), self.join)[0], lengths

    def score(self, text: str | None) -> float:
        a, b = self.curve
        good, lengths = self.marginals(text)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a * float(good @ lengths / lengths.sum()) + b))))


def chain(potential: np.ndarray, join: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of label 1, expected counts of neighbouring labels, log of the partition function."""
    s, e = np.exp(potential).tolist(), np.exp(join)
    (e00, e01), (e10, e11) = e.tolist()
    n, z = len(s), 0.0
    forward, scale = [], []
    a0, a1 = 1.0, s[0]
    for k in range(n):
        if k:
            a0, a1 = a0 * e00 + a1 * e10, (a0 * e01 + a1 * e11) * s[k]
        t = a0 + a1
        a0, a1, z = a0 / t, a1 / t, z + math.log(t)
        forward.append((a0, a1))
        scale.append(t)
    b0 = b1 = 1.0
    good, pairs = [0.0] * n, np.zeros((2, 2))
    p00 = p01 = p10 = p11 = 0.0
    for k in range(n - 1, -1, -1):
        a0, a1 = forward[k]
        good[k] = a1 * b1 / (a0 * b0 + a1 * b1)
        if k:
            q0, q1 = b0 / scale[k], b1 * s[k] / scale[k]
            f0, f1 = forward[k - 1]
            p00, p01, p10, p11 = p00 + f0 * e00 * q0, p01 + f0 * e01 * q1, p10 + f1 * e10 * q0, p11 + f1 * e11 * q1
            b0, b1 = e00 * q0 + e01 * q1, e10 * q0 + e11 * q1
    pairs[:] = (p00, p01), (p10, p11)
    return np.array(good), pairs, z


def chains(potential: np.ndarray, starts: np.ndarray, lens: np.ndarray, join: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """chain() of many documents at once: marginals of all lines, and each document's expected counts of neighbouring labels.

    Lines stand one document after the other; documents are sorted by falling length, so those still going on are the first.
    """
    e, s = np.exp(join), np.exp(potential)
    forward, scale = np.zeros((len(potential), 2)), np.zeros(len(potential))
    going = [int((lens > k).sum()) for k in range(int(lens.max(initial=0)))]
    for k, n in enumerate(going):
        at = starts[:n] + k
        a = np.stack([np.ones(n), s[at]], 1) if not k else (forward[at - 1] @ e) * np.stack([np.ones(n), s[at]], 1)
        scale[at] = a.sum(1)
        forward[at] = a / scale[at][:, None]
    backward, pairs = np.ones((len(potential), 2)), np.zeros((len(lens), 2, 2))
    for k in range(len(going) - 1, 0, -1):
        at = starts[: going[k]] + k
        q = backward[at] * np.stack([np.ones(len(at)), s[at]], 1) / scale[at][:, None]
        pairs[: len(at)] += forward[at - 1][:, :, None] * e * q[:, None, :]
        backward[at - 1] = q @ e.T
    both = forward * backward
    return both[:, 1] / both.sum(1), pairs


def fit_field(docs: list[tuple[str | None, int]], rounds: int = 80, decay: float = 1e-3) -> Field:
    """docs: (text, label).  Adam on the likelihood of the documents' labels, each document counting once."""
    share = sum(y for _, y in docs) / len(docs) if docs else 0.5
    if not docs or not 0 < share < 1:
        p = min(0.999, max(0.001, share))
        return Field(np.zeros(WIDTH), np.zeros(SPARSE), np.zeros((2, 2)), (0.0, math.log(p / (1 - p))))
    shapes, buckets, known = _Memory(shape_of), _Memory(bucket_of), []
    for t, label in docs:  # one text's words at a time
        x, lengths, words = describe(t)
        lines = [sparse_features(line, shapes, buckets) for line in words]
        n = [len(a) for a, _ in lines]
        at, value = np.fromiter((k for a, _ in lines for k in a), np.int32, sum(n)), np.fromiter((v for _, b in lines for v in b), np.float32, sum(n))
        known.append((x.astype(np.float32), lengths, at, value, np.array(n, np.int32), label))
    known.sort(key=lambda d: -len(d[0]))
    lens, y = np.array([len(d[0]) for d in known]), np.array([d[5] for d in known], float)
    starts = np.cumsum(lens) - lens
    x, lengths, at, value, n = (np.concatenate([d[k] for d in known]) for k in range(5))
    of = np.repeat(np.arange(len(n), dtype=np.int32), n)
    del known, shapes, buckets
    each = np.repeat(1 / (lens * len(lens)), lens)
    evidence = np.repeat((2 * y - 1) * math.log(AGREE / (1 - AGREE)), lens)
    theta = np.zeros(WIDTH + SPARSE + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def potentials() -> np.ndarray:
        more = np.bincount(of, theta[WIDTH : WIDTH + SPARSE][at] * value, len(x))
        return np.clip(x @ theta[:WIDTH] + more, -30, 30)

    for step in range(1, rounds + 1):
        p, join = potentials(), theta[-4:].reshape(2, 2)
        good, pairs = chains(p, starts, lens, join)
        given, pairs_given = chains(p + evidence, starts, lens, join)
        d = (good - given) * each
        joined = ((pairs - pairs_given) / (lens * len(lens))[:, None, None]).sum(0)
        grad = np.concatenate([d @ x, np.bincount(at, value * d[of], SPARSE), joined.ravel()]) + decay * theta * np.concatenate([np.full(WIDTH, 1.0), np.full(SPARSE, 0.1), np.full(4, 1.0)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - (0.2 / (1 + step / 20)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -3, 3)
    good, _ = chains(potentials(), starts, lens, theta[-4:].reshape(2, 2))
    raw = np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)
    a, b = 4.0, -2.0
    for _ in range(200):  # Newton's steps, with a prior that keeps the curve finite
        p = 1 / (1 + np.exp(-(a * raw + b)))
        d, h = p - y, p * (1 - p) + 1e-6
        grad = np.array([d @ raw + 0.05 * (a - 4), d.sum() + 0.05 * (b + 2)])
        hess = np.array([[h @ raw**2 + 0.05, h @ raw], [h @ raw, h.sum() + 0.05]])
        move = np.linalg.solve(hess, grad)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return Field(theta[:WIDTH], theta[WIDTH : WIDTH + SPARSE], theta[-4:].reshape(2, 2), (float(a), float(b)))


def fit(documents: DataFrame, labels: DataFrame, keep: Column, per_class: int = PER_CLASS) -> Field:
    """Learns from labels (doc_id, quality) of the ids that keep, an expression over doc_id, selects."""
    common.ready(documents.sparkSession)
    rows = common.labelled_sample(documents, labels, "quality", keep, per_class, EXAMPLE_CHARS, SAMPLE_CHARS).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit_field([(r["text"], int(r["label"])) for r in rows])


def predict(documents: DataFrame, field: Field, *columns: Column | str) -> DataFrame:
    """The columns given, score and predicted (1: good)."""
    spark = documents.sparkSession
    common.ready(spark)
    sent = spark.sparkContext.broadcast(field)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for batch in texts:
            yield pd.Series([own.score(t) for t in batch], dtype="float64")

    return documents.select(*columns, of("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
