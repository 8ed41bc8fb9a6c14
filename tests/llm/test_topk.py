import math

import numpy as np
import pytest

from dyadic.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, norm2 string, block int, least int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 0, "v", "n", 1, 2) for i, e in rows], SCHEMA)


def brute(rows, every, k):
    fit = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in e)) for i, e in rows
           if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in sorted({i for i, _ in fit if i % every == 0}):
        scores = [(-sum(a * b for a, b in zip(u, v)), j) for i, u in fit if i == q for j, v in fit if j != q and len(u) == len(v)]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("kind", ["mixed", "unit", "copies", "negative"])
def test_equals_brute_force(spark, rnd, kind):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 12)) * (r.lognormal(0, 1.5, (400, 1)) if kind == "mixed" else 1)
    if kind == "unit":
        x[200:] = x[7] + 0.05 * r.normal(size=(200, 12))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "copies":
        x[50:300] = x[1]
    if kind == "negative":
        x = np.abs(x)
        x[::10] *= -1
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    rows += [(401, None), (410, [None, 1.0]), (420, [math.nan] * 12), (430, [math.inf] * 12), (None, rows[0][1]), rows[3], (440, [0.0] * 12), (450, [1.0, 2.0]),
             (451, [2.0, 1.0]), (460, [])]
    got = topk.nearest(table(spark, rows), every=10, k=5).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 10, 5)


def test_groups_and_seeds_do_not_change_results(spark, monkeypatch):
    r = np.random.default_rng(9)
    x = r.normal(size=(500, 8)) * r.lognormal(0, 0.3, (500, 1))
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    want = brute(rows, 7, 3)
    monkeypatch.setattr(topk, "GROUP", 20)
    monkeypatch.setattr(topk, "SEEDS", 15)
    assert sorted(tuple(r) for r in topk.nearest(table(spark, rows), every=7, k=3).collect()) == want


def test_large_components_and_several_widths(spark):
    big = [(50, [1e9, -3.0]), (51, [6e15, 1.0]), (52, [-2.0**60, 2.0]), (53, [1.0, 1.0]), (100, [2.5, 1.0]), (101, [3e38, 1.0]), (102, [1.0]), (150, [2.0]),
           (103, [0.5, 2.0**50 / 3])]
    cut = [(q, r, c, min(max(s, -(2**63)), 2**63 - 1)) for q, r, c, s in brute(big, 50, len(big))]
    want = []
    for q in {c[0] for c in cut}:
        own = sorted((-s, c) for a, _, c, s in cut if a == q)
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(own)]
    got = [tuple(r) for r in topk.nearest(table(spark, big), k=len(big)).collect()]
    assert sorted(got) == sorted(want)


def test_few_and_none(spark):
    assert topk.nearest(table(spark, [])).collect() == []
    assert [tuple(r) for r in topk.nearest(table(spark, [(50, [1.0]), (51, [2.0])])).collect()] == [(50, 1, 51, 256 * 512)]
