"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums over the subsequences of ORDER letters they share, each discounted by the letters it spans in
both, so an insult with gaps or inserted letters stays close to itself. A sentence is the sum of its words' feature maps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm.quality import fold
from dyadic.session import materialize

ORDER = 3
DECAY = 0.5
LANDMARKS = 128
# Labelled documents that the model is fitted on, drawn by the hash of their id.
TRAIN_ROWS = 20_000
FOLDS = 5
HELD_OUT = 0
# Candidates for the machine's cost, chosen by cross-validation over so many parts of the sample.
COSTS = (0.01, 0.1, 1.0)
PARTS = 3
# Letters of a word compared at once; longer words are read in overlapping pieces of this length.
PIECE = 24
# A landmark's kernel counts for a word that has this share of its distinct letters and reaches this similarity.
LETTERS = 0.8
SIMILAR = 0.3
# Words whose weight a worker remembers.
REMEMBERED = 500_000
_SENTENCE = re.compile(r"[.!?\n]+")
_SPACED = re.compile(r"(?<!\w)\w(?:[ \t]\w){2,}(?!\w)")
_OTHER = re.compile(r"[\W_]+")


def _codes(words: Sequence[str], pad: int) -> np.ndarray:
    """Words as rows of code points between two end marks."""
    out = np.full((len(words), max(map(len, words), default=0) + 2), pad, np.int32)
    for i, w in enumerate(words):
        out[i, : len(w) + 2] = [1, *map(ord, w), 2]
    return out


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of the paired rows of two code matrices."""
    total, m = np.zeros(len(s), np.float32), t.shape[1]
    j = np.arange(m)
    fade = np.where(j[:, None] <= j[None, :], decay ** np.maximum(j[None, :] - j[:, None], 0), 0).astype(np.float32)
    before = [np.ones((len(s), m + 1), np.float32)] + [np.zeros((len(s), m + 1), np.float32) for _ in range(order - 1)]
    for i in range(s.shape[1]):
        match = (s[:, i:i + 1] == t).astype(np.float32) * np.float32(decay**2)
        now = [before[0]]
        for q in range(1, order):
            step = before[q] * np.float32(decay)
            step[:, 1:] += (match * before[q - 1][:, :m]) @ fade
            now.append(step)
        total += (match * before[order - 1][:, :m]).sum(axis=1)
        before = now
    return total


def _letters(words: Sequence[str]) -> np.ndarray:
    return np.array([sum({1 << (ord(c) % 64): 0 for c in w}) for w in words], np.uint64)


def pieces(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[i:i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


class Landmarks:
    """Similarities of words to a fixed list of words."""

    def __init__(self, words: Sequence[str]):
        self.words = list(words)
        self.letters = _letters(self.words)
        self.size = np.bitwise_count(self.letters)
        self.codes = _codes(self.words, -2)
        self.self = kernel(_codes(self.words, -1), self.codes)

    def similarities(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse (word, landmark, normalised kernel) of all pairs that share enough letters and reach SIMILAR."""
        rows, cols, values = [], [], []
        for at in range(0, len(words), 4096):
            part = sorted(range(at, min(at + 4096, len(words))), key=lambda i: len(words[i]))
            shared = np.bitwise_count(_letters([words[i] for i in part])[:, None] & self.letters[None, :])
            r, c = np.nonzero(shared >= LETTERS * self.size[None, :])
            for lo in range(0, len(r), 2048):
                rr, cc = r[lo:lo + 2048], c[lo:lo + 2048]
                own, back = np.unique(rr, return_inverse=True)
                s = _codes([words[part[i]] for i in own], -1)
                norm = kernel(s, np.where(s == -1, -2, s))
                k = kernel(s[back], self.codes[cc]) / np.sqrt(np.maximum(norm[back] * self.self[cc], 1e-30))
                near = k >= SIMILAR
                rows += [part[i] for i in rr[near]]
                cols.append(cc[near])
                values.append(k[near])
        empty = [np.empty(0, int)]
        return np.array(rows, int), np.concatenate(cols or empty), np.concatenate(values or empty).astype(float)


def sentences(text: str | None) -> list[str]:
    """Lower-cased sentences; letters that stand one by one are closed up to a word first."""
    closed = _SPACED.sub(lambda m: _OTHER.sub("", m[0]) or m[0], (text or "").lower())
    return _SENTENCE.split(closed)


def clean(token: str) -> str:
    return _OTHER.sub("", token)


@dataclass
class ToxicModel:
    """Weight of each landmark in the decision, the bias, and the calibration of a document's score."""

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0
    calibration: np.ndarray | None = None
    prior: float = 0.5

    def __post_init__(self):
        self._known: dict[str, float] = {}
        self._side: Landmarks | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_side")}

    def __setstate__(self, state):
        self.__dict__.update(state, _known={}, _side=None)

    def learn(self, tokens: set[str]) -> None:
        """Weigh tokens not met before, all at once."""
        new = [t for t in tokens if t not in self._known]
        if not new:
            return
        if len(self._known) > REMEMBERED:
            self._known.clear()
            new = list(tokens)
        if self._side is None:
            self._side = Landmarks(self.landmarks)
        parts = [(i, p) for i, t in enumerate(new) for p in pieces(clean(t)) if len(p) >= ORDER]
        r, c, k = self._side.similarities([p for _, p in parts])
        weight = np.zeros(len(new))
        np.add.at(weight, np.array([i for i, _ in parts], int)[r] if len(r) else r, k * self.weights[c])
        self._known.update(zip(new, weight.tolist()))

    def known(self, token: str) -> float:
        return self._known[token]

    def evidence(self, texts: Sequence[str | None]) -> np.ndarray:
        """Per text: the highest sentence decision, the number of sentences on the toxic side, and the number of words."""
        out = np.zeros((len(texts), 3))
        for at in range(0, len(texts), 64):
            split = [sentences(t) for t in texts[at:at + 64]]
            words = [[s.split() for s in sent] for sent in split]
            self.learn({w for sent in words for s in sent for w in s})
            for i, sent in enumerate(words):
                scores = [sum(map(self._known.__getitem__, s)) + self.bias for s in sent]
                out[at + i] = max(scores), sum(x > 0 for x in scores), sum(map(len, sent))
        return out

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        if self.weights is None or self.calibration is None:
            return np.full(len(texts), self.prior)
        return _logistic(_calibrated(self.evidence(texts)) @ self.calibration)


def _calibrated(evidence: np.ndarray) -> np.ndarray:
    n = np.log1p(evidence[:, 2])
    return np.column_stack([np.ones(len(evidence)), np.clip(evidence[:, 0], -5, 5), np.log1p(evidence[:, 1]), n])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss by Newton steps; the classes have equal total cost."""
    z = np.column_stack([x, np.ones(len(x))])
    s = np.where(y > 0, 1.0, -1.0)
    c = cost * np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-12), 0.5 / max((y <= 0).mean(), 1e-12))
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    active = None
    for _ in range(rounds):
        now = s * (z @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        a = z[active] * c[active, None]
        w = np.linalg.solve(ridge + a.T @ z[active], a.T @ s[active])
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _logistic(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def nystroem(landmarks: Landmarks) -> np.ndarray:
    """The inverse root of the landmarks' kernel matrix, which turns similarities into features."""
    m = len(landmarks.words)
    r, c, k = landmarks.similarities(landmarks.words)
    gram = np.zeros((m, m))
    gram[r, c] = k
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    return (vector / np.sqrt(np.maximum(value, 0.05))) @ vector.T


def witness(texts: Sequence[str | None], side: Landmarks) -> np.ndarray:
    """Of each text the sentence most similar to the landmarks, as its sums of similarities."""
    out = np.zeros((len(texts), len(side.words)))
    plain = ToxicModel(side.words, np.ones(len(side.words)))
    for at in range(0, len(texts), 64):
        split = [[s.split() for s in sentences(t)] for t in texts[at:at + 64]]
        plain.learn({w for sent in split for s in sent for w in s})
        best = [max(sent, key=lambda s: sum(map(plain.known, s))) for sent in split]
        parts = [(at + i, p) for i, s in enumerate(best) for w in s if plain.known(w) for p in pieces(clean(w)) if len(p) >= ORDER]
        r, c, k = side.similarities([p for _, p in parts])
        if len(r):
            np.add.at(out, (np.array([i for i, _ in parts])[r], c), k)
    return out


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, label) of the training folds, drawn to about `rows` labels by the hash of the id, one text an id."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").distinct()
    known = known.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    share = min(1.0, rows / max(known.count(), 1))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return materialize(found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label"))


def choose_landmarks(sample: DataFrame, toxic: int, clean_rows: int, count: int = LANDMARKS) -> list[str]:
    """The words that separate the two classes best by how many documents hold them (two-proportion z statistic)."""
    words = F.array_distinct(F.split(F.lower("text"), r"(?U)[\W_]+"))
    held = sample.select("label", F.explode(words).alias("word")).filter(F.length("word").between(ORDER, PIECE))
    held = held.groupBy("word").agg(F.sum("label").alias("a"), F.count("*").alias("n")).filter("n > 2")
    rate = F.col("n") / F.lit(toxic + clean_rows)
    gap = F.col("a") / F.lit(toxic) - (F.col("n") - F.col("a")) / F.lit(clean_rows)
    z = gap / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * F.lit(1 / toxic + 1 / clean_rows))
    best = held.select("word", z.alias("z")).filter("z > 0").orderBy(F.desc("z"), "word").limit(count)
    return [r["word"] for r in best.collect()]


def choose_cost(x: np.ndarray, y: np.ndarray, part: np.ndarray, costs: Sequence[float]) -> float:
    """The cost whose machines, each fitted without one part of the rows, err least on the parts left out; the classes weigh
    the same, and of equal costs the first is taken."""
    errors = []
    for cost in costs:
        wrong = np.zeros(len(y), dtype=bool)
        for k in np.unique(part):
            held = part == k
            if len(np.unique(y[~held])) == 2:
                w, b = fit_svm(x[~held], y[~held], cost)
                wrong[held] = (x[held] @ w + b > 0) != (y[held] > 0)
        errors.append(sum(wrong[y == v].mean() for v in np.unique(y)))
    return costs[int(np.argmin(np.round(errors, 12)))]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS,
        costs: Sequence[float] = COSTS) -> ToxicModel:
    """Model of the labelled documents of the training folds (docs: doc_id, text; labels: doc_id, toxic).

    A document's label holds for the sentence most similar to the landmarks; the machine learns from these sentences, and
    the score of whole documents is calibrated on the same sample. At most about `rows` documents are drawn, so what
    reaches the driver is a table of `rows` by `landmarks` numbers. The machine's cost is chosen by cross-validation over them. Without both classes or without landmarks every
    score is the share of toxic labels (one half without any).
    """
    sample = _labelled(docs, labels, rows)
    counts = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("a"), F.count("*").alias("n")).first()
    toxic, clean_rows = counts["a"], counts["n"] - counts["a"]
    prior = toxic / counts["n"] if counts["n"] else 0.5
    words = choose_landmarks(sample, toxic, clean_rows, landmarks) if toxic and clean_rows else []
    if not words:
        return ToxicModel(prior=prior)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side = Landmarks(words)
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "part": batch["part"], "x": list(witness(list(batch["text"]), side))})

    parts = sample.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int"))
    rows_ = parts.mapInPandas(features, "label int, part int, x array<double>").toPandas()
    turn = nystroem(Landmarks(words))
    x, y = np.stack(rows_["x"].to_numpy()) @ turn, rows_["label"].to_numpy()
    weights, bias = fit_svm(x, y, choose_cost(x, y, rows_["part"].to_numpy(), costs))
    model = ToxicModel(words, turn @ weights, bias, prior=prior)

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            e = model.evidence(list(batch["text"]))
            yield pd.DataFrame({"label": batch["label"], "a": e[:, 0], "b": e[:, 1], "c": e[:, 2]})

    seen = sample.mapInPandas(evidence, "label int, a double, b double, c double").toPandas()
    model.calibration = fit_logistic(_calibrated(seen[["a", "b", "c"]].to_numpy()), seen["label"].to_numpy())
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs` (doc_id, text), from its whole text.

    Labels are learned only from ids outside the held-out fold. An id with several labels counts with each, repeated
    label rows once; of several texts of an id one teaches; null ids and labels other than 0 and 1 teach nothing. Null and empty texts are scored as one empty
    sentence. Repeated rows stay. An empty table gives an empty result. Other columns are not read.
    """
    model = fit(docs, labels, **options)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(list(texts)), dtype=float)

    scored = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
