import struct
import zlib

import numpy as np
import pytest
import xxhash

from dyadic.llm import quality


def corpus(rnd, words, n=600):
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        t = [rnd.choice(words) for _ in range(rnd.randint(5, 150))]
        if not good:
            t = rnd.choice([[w + "$$$" for w in t], [w.upper() + "!!" for w in t], [t[0]] * len(t), [w + " |" for w in t]])
        rows.append((i, " ".join(t)))
        labels.append((i, int(good), 0))
    return rows, labels


def part(doc_id):
    """The part of cross-validation of an id, as Spark's xxhash64 deals it."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    return (h - (1 << 64) if h >= 1 << 63 else h) % quality.PARTS


def density(v, k, x, y, pooled, ridge):
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pool = (np.sum(y == 0) * cov[0] + np.sum(y == 1) * cov[1]) / len(y)
    s = (1 - pooled) * cov[k] + pooled * pool + np.eye(len(pool)) * (ridge * np.trace(pool) / len(pool) + 1e-9)
    d = v - x[y == k].mean(axis=0)
    return -0.5 * d @ np.linalg.solve(s, d) - 0.5 * np.linalg.slogdet(s)[1] + np.log(np.mean(y == k))


def test_held_out_accuracy_and_direct_density(spark, documents, words, rnd):
    rows, labels = corpus(rnd, words)
    rows += [(9000, None), (9001, ""), (None, "no id at all"), rows[2], (9002, "word " * 100_000)]
    lab = spark.createDataFrame(labels + [labels[0], (None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(documents(rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: q for i, q, _ in labels}
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97

    train = [(quality.statistics(t), truth[i], part(i)) for i, t in rows if i in truth and zlib.crc32(str(i).encode()) % 3 != 1]
    x, y, at = (np.array(c) for c in zip(*train))
    settings = [(a, b) for a in quality.POOLED for b in quality.RIDGE]

    def judged(pair):
        """Errors and log loss of a pair of settings on the parts left out."""
        p = np.array([1 / (1 + np.exp(np.clip(density(v, 0, x[at != k], y[at != k], *pair) - density(v, 1, x[at != k], y[at != k], *pair), -700, 700)))
                      for v, k in zip(x, at)])
        return np.sum((p >= 0.5) != y), round(-np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-12, 1)).sum(), 6)

    best = min(settings, key=judged)

    text = {(i, t): quality.statistics(t) for i, t in rows}
    for r in got[:40]:
        v = next(s for (i, _), s in text.items() if i == r.doc_id)
        assert r.score == pytest.approx(1 / (1 + np.exp(np.clip(density(v, 0, x, y, *best) - density(v, 1, x, y, *best), -700, 700))), abs=1e-6)


def test_scores_do_not_see_held_out_labels(spark, documents, words, rnd):
    rows, labels = corpus(rnd, words, 200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted(map(tuple, quality.score_quality(documents(rows), spark.createDataFrame(x, schema)).collect())) for x in (labels, flipped))
    assert [r[0] for r in a] == [r[0] for r in b] and [r[3] for r in a] == pytest.approx([r[3] for r in b], abs=1e-12)


def test_one_class_and_none(spark, documents, words, rnd):
    rows, labels = corpus(rnd, words, 30)
    schema = "doc_id long, quality int, toxic int"
    only = spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], schema)
    assert {r.score for r in quality.score_quality(documents(rows), only).collect()} == {1.0}
    none = spark.createDataFrame([], schema)
    assert {r.score for r in quality.score_quality(documents(rows), none).collect()} == {0.5}
    assert quality.score_quality(documents([]), only).collect() == []
    kept = quality.keep_good(documents(rows), none).collect()
    assert len(kept) == len(rows) and kept[0]._hash == "h"
