"""Language identification by hierarchical discrimination.

A linear support vector machine (one against the rest) predicts the family of a text's language; within
the family, one-versus-one machines separate the languages and vote.  Features are hashed sequences of
one to three letters, with word limits, of the whole text in lower case, counted, square-rooted and
scaled to unit length.

Machines are fitted on the driver, on the features of about ``per_language`` training texts of each
language (chosen by the hashes of their ids), fewer where MOST_LANGUAGES languages would have more than MOST_TEXTS; of more languages,
the most frequent are learned.  The features of a text are a vector of DIM numbers however long it is.  The
models, a few vectors of DIM numbers, are sent to every task.

Defined results: ``und`` with score 0 for a null text and a text without a letter, and for any text if
nothing was learned; a family with one language needs no second step; an empty table gives no row;
repeated rows are predicted as often as they come; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 1 << 13
PER_LANGUAGE = 400
#: Languages that are learned, the most frequent ones, and texts of all languages in the sample: 256 MB of features at most.
MOST_LANGUAGES, MOST_TEXTS = 250, 8000
#: Families of common languages by ISO 639-1 code.  A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi ur bn mr gu pa ne si",
    "sinitic": "zh yue wuu",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_LETTER = regex.compile(r"\p{L}")
#: Codepoints of a text that are hashed at once.
_BLOCK = 1 << 20


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"own:{lang}")


def _classes(text: str) -> np.ndarray:
    """Codepoints in lower case; everything but letters becomes one kind of gap."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = ((points >= 97) & (points <= 122)) | ((points >= 0xAA) & (points != 0xD7) & (points != 0xF7) & ((points < 0x2000) | (points > 0x206F)))
    return np.where(letters, points, 0).astype(np.uint32)


def features(text: str | None) -> np.ndarray:
    """A vector of DIM numbers of unit length, or zeros."""
    counts = np.zeros(DIM)
    if text:
        points = _classes(text)
        for at in range(0, len(points), _BLOCK):
            p = np.concatenate([[0], points[max(0, at - 2) if at else 0 : at + _BLOCK], [0]]).astype(np.uint32)
            one = p * np.uint32(2654435761)
            two = (one[:-1] ^ (p[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
            three = (two[:-1] ^ (p[2:] * np.uint32(668265263))) * np.uint32(374761393)
            for h, keep in ((one, p != 0), (two, (p[:-1] | p[1:]) != 0), (three, p[1:-1] != 0)):
                counts += np.bincount((h[keep] >> np.uint32(19)).astype(np.int64), minlength=DIM)
    counts = np.sqrt(counts)
    n = np.linalg.norm(counts)
    return counts / n if n else counts


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, c: float = 10.0) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by dual coordinate descent.  y: -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diag = (x * x).sum(1) + 0.5 / c
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + 0.5 / c * alpha[i]
            new = max(0.0, alpha[i] - g / diag[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


class Model:
    """families: the learned ones in order; family_w: a row of weights for each; pairs: within families."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        kinds = [family(v) for v in langs]
        self.families = sorted(set(kinds))
        self.members = {f: [v for v in self.langs if family(v) == f] for f in self.families}
        sign = lambda is_it: np.where(is_it, 1.0, -1.0)
        self.family_w = np.array([fit_svm(x, sign(np.array(kinds) == f)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                own = np.array([v in (a, b) for v in langs])
                self.pairs[a, b] = fit_svm(x[own], sign(np.array(langs)[own] == a))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language and a score from 0 to 1."""
        if not self.langs:
            return "und", 0.0
        x = np.append(x, 1.0)
        score, best = 1.0, self.families[0]
        if self.family_w is not None:
            margins = self.family_w @ x
            best, score = self.families[int(margins.argmax())], _sigmoid(2 * margins.max())
        members = self.members[best]
        votes = {v: [0, 0.0] for v in members}
        margin = {}
        for a, b in combinations(members, 2):
            m = float(self.pairs[a, b] @ x)
            margin[a, b] = m
            for v, own in ((a, m), (b, -m)):
                votes[v][0] += own > 0
                votes[v][1] += own
        lang = max(members, key=lambda v: (votes[v][0], votes[v][1], v))
        least = min((m if lang == a else -m for (a, b), m in margin.items() if lang in (a, b)), default=None)
        return lang, score * (1.0 if least is None else _sigmoid(2 * least))


def _sigmoid(v: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(v, -50, 50))))


def fit(documents: DataFrame, keep: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from about per_language texts of each non-null lang among the rows that keep selects."""
    common.ready(documents.sparkSession)
    texts = common.sample(documents.where(keep & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text"), "lang", per_language, MOST_LANGUAGES, MOST_TEXTS)

    @F.pandas_udf("binary")
    def vectors(text: pd.Series) -> pd.Series:
        return text.map(lambda t: features(t).astype("<f4").tobytes())

    # a lang and a vector each, of a bounded number of rows
    rows = texts.select("lang", vectors("text").alias("x"), "doc_id").collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] if r["doc_id"] is not None else -1, bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<f4").reshape(len(rows), DIM)
    return Model(x, [r["lang"] for r in rows])


def predict(documents: DataFrame, model: Model, *columns: Column | str) -> DataFrame:
    """The columns given, lang_pred and score."""
    spark = documents.sparkSession
    common.ready(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in texts:
            found = [own.predict(features(t)) if t and _LETTER.search(t) else ("und", 0.0) for t in batch]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return documents.select(*columns, of("text").alias("__p")).select("*", "__p.*").drop("__p")
