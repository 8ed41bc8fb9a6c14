"""Text quality by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm.common import matches
from dyadic.session import materialize

# Candidates for the share of the pooled covariance, and of its mean variance on the diagonal, in each class covariance; one
# pair is chosen by cross-validation over so many parts of the rows that teach.
POOLED = (0.02, 0.1, 0.3)
RIDGE = (0.01, 0.05, 0.2)
PARTS = 4
FOLDS = 3
HELD_OUT = 1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CLASSES = {
    "upper": np.arange(65, 91), "lower": np.arange(97, 123), "digit": np.arange(48, 58), "stop": np.frombuffer(b".,;:?'\"-()", np.uint8),
    "bang": np.frombuffer(b"!", np.uint8), "pipe": np.frombuffer(b"|", np.uint8), "symbol": np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8),
    "wide": np.arange(128, 256),
}
FEATURES = ("words", "word_length", *_CLASSES, "distinct", "repeats", "line_words", "marked", "short")


# What a text is taken to hold besides its own: prose of PRIOR_WORDS words with these shares of its characters. A text of a
# few words then looks like short prose rather than like an extreme of every statistic.
PRIOR_WORDS, PRIOR_CHARS = 6, 30
_PRIOR = {"upper": 0.02, "lower": 0.9, "stop": 0.02, "wide": 0.02}


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text; shares become log odds, counts become logs. A null text is an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.count(b"\n") + 1
    n = len(words)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    filled = int(chars[~_BLANK].sum())

    def odds(part: float, whole: float, more: float, prior: float = 0.0) -> float:
        return float(np.log((part + 0.5 + more * prior) / (whole - part + 0.5 + more * (1 - prior) + 0.01 * whole)))

    repeats = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(w[-1:] in b"!#$%&*" for w in words)
    short = sum(len(w) <= 3 for w in words)
    return np.array([
        np.log(n + PRIOR_WORDS), np.log((filled + PRIOR_CHARS) / (n + PRIOR_WORDS)),
        *[odds(int(chars[c].sum()), filled, PRIOR_CHARS, _PRIOR.get(name, 0.0)) for name, c in _CLASSES.items()],
        # Fewer words are new the longer a text is; the power of the count keeps the share comparable.
        np.log((len(set(words)) + PRIOR_WORDS) / (n + PRIOR_WORDS) ** 0.8), odds(repeats, n, PRIOR_WORDS),
        np.log((n + PRIOR_WORDS) / lines), odds(marked, n, PRIOR_WORDS), odds(short, n, PRIOR_WORDS, 0.5),
    ])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([statistics(t) for t in texts])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log-density constants of the two classes."""

    prior: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    roots: tuple[np.ndarray, np.ndarray] | None = None
    constants: tuple[float, float] = (0.0, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for every row."""
        if self.means is None:
            return np.full(len(x), self.prior)
        log = [c - 0.5 * (((x - m) @ r.T) ** 2).sum(axis=1) for m, r, c in zip(self.means, self.roots, self.constants)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _moments(labelled: DataFrame) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of `x` per (part, label), from one aggregate of `labelled` (x, label, part)."""
    p = len(FEATURES)
    lower = np.tril_indices(p)
    sums = [F.count("*").alias("n")] + [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(p)]
    sums += [F.sum(F.col("x")[int(i)] * F.col("x")[int(j)]).alias(f"c{i}_{j}") for i, j in zip(*lower)]
    out = {}
    for r in labelled.groupBy("part", "label").agg(*sums).collect():
        c = np.zeros((p, p))
        c[lower] = [r[f"c{i}_{j}"] for i, j in zip(*lower)]
        out[int(r["part"]), int(r["label"])] = (r["n"], np.array([r[f"s{i}"] for i in range(p)]), c + np.tril(c, -1).T)
    return out


def _discriminant(moments: dict, left_out: int | None, pooled: float, ridge: float) -> Discriminant:
    """Discriminant of all parts but one.

    A class covariance S becomes (1 - pooled) S + pooled P, P being the pooled covariance, plus `ridge` times its mean
    variance on the diagonal. If a class has no rows, every score is the share of class 1 (one half without any rows).
    """
    p = len(FEATURES)
    own = {k: [m for (part, label), m in moments.items() if label == k and part != left_out] for k in (0, 1)}
    counts = [sum(m[0] for m in own[k]) for k in (0, 1)]
    if min(counts) == 0:
        return Discriminant(0.5 if sum(counts) == 0 else counts[1] / sum(counts))
    means = [sum(m[1] for m in own[k]) / counts[k] for k in (0, 1)]
    scatter = [sum(m[2] for m in own[k]) / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    common = (counts[0] * scatter[0] + counts[1] * scatter[1]) / sum(counts)
    roots, constants = [], []
    for k in (0, 1):
        s = (1 - pooled) * scatter[k] + pooled * common
        s = s + np.eye(p) * (ridge * np.trace(common) / p + 1e-9)
        root = np.linalg.inv(np.linalg.cholesky(s))
        roots.append(root)
        constants.append(float(np.log(np.diag(root)).sum() + np.log(counts[k] / sum(counts))))
    return Discriminant(counts[1] / sum(counts), tuple(means), tuple(roots), tuple(constants))


def fit(labelled: DataFrame, pooled: tuple[float, ...] = POOLED, ridge: tuple[float, ...] = RIDGE) -> tuple[Discriminant, tuple[float, float]]:
    """Discriminant of `labelled` (doc_id, x, label 0/1), and its settings (pooled, ridge).

    The rows are dealt into parts by the hash of their id. Counts, sums and products per part and class come from one
    aggregate, and the discriminant of all parts but one from their differences. Each pair of settings is judged by the
    errors of these on the parts left out, then by their log loss; nothing but the rows given decides.
    """
    rows = materialize(labelled.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).select("x", "label", "part"))
    moments = _moments(rows)
    settings = [(a, b) for a in pooled for b in ridge]
    models = [[_discriminant(moments, part, *pair) for part in range(PARTS)] for pair in settings]

    @F.pandas_udf("array<double>")
    def losses(x: pd.Series, label: pd.Series, part: pd.Series) -> pd.Series:
        out = np.zeros((len(x), 2 * len(settings)))
        if len(x):
            rows_, y, at = np.stack(x.to_numpy()), label.to_numpy(), part.to_numpy()
            for i, own in enumerate(models):
                for k in np.unique(at):
                    score = own[k].score(rows_[at == k])
                    out[at == k, i] = (score >= 0.5) != (y[at == k] == 1)
                    out[at == k, len(settings) + i] = -np.log(np.clip(np.where(y[at == k] == 1, score, 1 - score), 1e-12, 1))
        return pd.Series(list(out))

    judged = rows.select(losses("x", "label", "part").alias("l")).agg(*[F.sum(F.col("l")[i]) for i in range(2 * len(settings))]).first()
    best = min(range(len(settings)), key=lambda i: (judged[i] or 0, round(judged[len(settings) + i] or 0, 6), i))
    return _discriminant(moments, None, *settings[best]), settings[best]


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_hash, held_out, score, predicted) of every row of `docs` (doc_id, text).

    The discriminant learns from all rows with a `quality` label (labels: doc_id, quality) whose id falls in no held-out
    fold, and its settings are chosen among these rows too; nothing but statistics of the text enters a score. An id with several labels counts with each of them, repeated
    label rows once. Null ids and labels other than 0 and 1 teach nothing. Null and empty texts are scored as empty.
    Repeated rows stay. An empty table gives an empty result. Other columns are not read.
    """
    stats = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _statistics("text").alias("x")))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1)").distinct()
    known = known.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    model, _ = fit(stats.join(known, "doc_id").select("doc_id", "x", "label"))

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    scored = stats.select("doc_id", "text_hash", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the discriminant does not reject. Equal rows have equal scores."""
    bad = score_quality(docs, labels).filter("predicted = 0").select("doc_id", "text_hash").distinct()
    return matches(docs, materialize(bad), "left_anti")
