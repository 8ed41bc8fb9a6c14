import math

import numpy as np
import pandas as pd
import pytest

from dyadic.operators import activity, multivariate
from helpers import long_frame


def huber(y, x, rounds=60):
    """Robust regression of one sample by plain matrices."""
    x = np.column_stack([np.ones(len(y)), x])
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        r = np.abs(y - x @ coef)
        scale = np.median(r) / 0.6745
        if scale == 0:
            break
        w = np.minimum(1, 1.345 * scale / np.maximum(r, 1e-300))
        coef = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)
    kept = np.maximum(coef[1:], 0)
    return kept / kept.sum()


@pytest.fixture
def mixture(rng):
    """Samples mixed of three cell types, a tenth of whose features are far off."""
    panel = rng.random((150, 3))
    true = rng.dirichlet([3, 2, 1], size=12)
    clean = true @ panel.T
    spoilt = clean + 0.005 * rng.normal(size=clean.shape)
    for row in spoilt:
        row[rng.choice(150, 15, replace=False)] = 1.0
    return panel, true, clean, np.clip(spoilt, 0, 1)


def fractions(df):
    return df.orderBy("sample_id").toPandas()[["A", "B", "C"]].to_numpy(dtype=float)


def panel_frame(spark, panel):
    rows = pd.DataFrame(panel, columns=["A", "B", "C"]).assign(feature_id=[f"g{j:03d}" for j in range(len(panel))])
    return spark.createDataFrame(rows)


def test_outliers_leave_robust_fractions_unchanged(spark, mixture):
    panel, true, clean, spoilt = mixture
    cells, reference = long_frame(spark, spoilt), panel_frame(spark, panel)
    robust = fractions(activity.deconvolve_robust(cells, reference, ["A", "B", "C"]))
    plain = fractions(activity.deconvolve(cells, reference, ["A", "B", "C"]))
    assert np.abs(robust - true).max() < 0.02 < np.abs(plain - true).max()
    assert np.allclose(robust, [huber(y, panel) for y in spoilt], atol=1e-5)
    exact = fractions(activity.deconvolve_robust(long_frame(spark, clean), reference, ["A", "B", "C"]))
    assert np.allclose(exact, true, atol=1e-8)


def test_robust_edges(spark, rng):
    """Null cells, a zero scale, a sample below all cell types, values that are no beta values, an empty table."""
    panel = rng.random((40, 3))
    exact = np.vstack([np.tile(panel[:, 0], (1, 1)), -0.0 * panel[:, :1].T, 0.5 - 0.4 * panel.mean(axis=1)])
    exact[0, 5] = np.nan
    reference = panel_frame(spark, panel)
    out = fractions(activity.deconvolve_robust(long_frame(spark, exact), reference, ["A", "B", "C"]))
    assert np.allclose(out[0], [1, 0, 0], atol=1e-8) and np.isnan(out[1:]).all()
    assert activity.deconvolve_robust(long_frame(spark, exact).filter("false"), reference, ["A", "B", "C"]).count() == 0
    with pytest.raises(Exception, match="no beta values"):
        activity.deconvolve_robust(long_frame(spark, exact + 2), reference, ["A", "B", "C"])


def direct_variation(x, sets, max_diff=True):
    """Whole walks gene by gene, over matrices (samples x genes)."""
    n, p = x.shape
    level = np.full(x.shape, 0.5)
    for j in range(p):
        h = np.std(x[:, j], ddof=1) / 4
        if h > 1e-12 * np.abs(x[:, j]).max():
            level[:, j] = [np.mean([0.5 + 0.5 * math.erf((v - u) / h / math.sqrt(2)) for u in x[:, j]]) for v in x[:, j]]
    level = np.round(level, 12)
    out = np.zeros((n, len(sets)))
    for i in range(n):
        order = sorted(range(p), key=lambda j: (-level[i, j], j))
        step = {j: abs(p / 2 - at) for at, j in enumerate(order)}
        for s, genes in enumerate(sets):
            whole, walk, top, low = sum(step[g] for g in genes), 0.0, 0.0, 0.0
            for j in order:
                walk += step[j] / whole if j in genes else -1 / (p - len(genes))
                top, low = max(top, walk), min(low, walk)
            out[i, s] = top + low if max_diff else (top if top > -low else low)
    return out


@pytest.mark.parametrize("max_diff", [True, False])
def test_set_variation_equals_whole_walks(spark, rng, max_diff):
    x = rng.normal(size=(20, 30))
    x[:, 4] = 2.0
    x[:, 7] = np.round(x[:, 7])
    sets = [set(range(0, 8)), {3, 9, 12, 20, 29}, {1, 2}]
    rows = [(f"s{k}", f"g{g:03d}") for k, genes in enumerate(sets) for g in genes] + [("s1", "absent")]
    frame = spark.createDataFrame(rows, "source string, target string")
    out = activity.set_variation(long_frame(spark, x), frame, 5, max_diff).toPandas().pivot(index="sample_id", columns="source", values="score")
    assert list(out.columns) == ["s0", "s1"]
    assert np.allclose(out.to_numpy(), direct_variation(x, sets[:2], max_diff), atol=1e-9)


def test_set_variation_follows_planted_set(spark, rng):
    x = rng.normal(size=(30, 60))
    x[:10, :8] += 2.5
    frame = spark.createDataFrame([("up", f"g{g:03d}") for g in range(8)], "source string, target string")
    out = activity.set_variation(long_frame(spark, x), frame).orderBy("sample_id").toPandas()["score"].to_numpy()
    assert out[:10].min() > out[10:].max()


@pytest.mark.parametrize("shape", ["normal", "tied", "far"])
def test_binned_kernel_keeps_its_bound(rng, shape):
    x = rng.normal(size=1500)
    x = np.round(x, 1) if shape == "tied" else np.append(x, [60.0, -45.0]) if shape == "far" else x
    exact, binned = activity.kernel_distribution(x, 10**6), activity.kernel_distribution(x, 0)
    assert np.abs(exact - binned).max() <= 0.061 * activity.BIN_PART**2
    assert np.allclose(activity.kernel_distribution(np.full(5, 3.0)), 0.5)


def brute(y, subject):
    """Best log-likelihood over a fine grid of variance ratios, by whole covariance matrices."""
    y, subject = np.asarray(y), np.asarray(subject)
    same = (subject[:, None] == subject[None, :]).astype(float)
    best = (-np.inf, 0.0)
    for share in np.linspace(0, 0.999, 1000):
        v = np.eye(len(y)) + share / (1 - share) * same
        inverse = np.linalg.inv(v)
        mean = inverse.sum(axis=0) @ y / inverse.sum()
        q = (y - mean) @ inverse @ (y - mean) / len(y)
        best = max(best, (-(len(y) * np.log(2 * np.pi * q) + np.linalg.slogdet(v)[1] + len(y)) / 2, share))
    return best


def test_mixed_model_unbalanced(spark, rng):
    rows, want = [], {}
    for factor, spread in ((0, 0.0), (1, 0.7), (2, 3.0)):
        subject = np.repeat(np.arange(18), rng.integers(1, 9, size=18))
        y = 5 + spread * rng.normal(size=18)[subject] + rng.normal(size=len(subject))
        want[factor] = brute(y, subject)
        rows += [(int(s), factor, float(v)) for s, v in zip(subject, y)] + [(3, factor, None)]
    out = {r.factor: r for r in multivariate.mixed_model(spark.createDataFrame(rows, "subject_id int, factor int, value double")).collect()}
    for factor, (loglik, share) in want.items():
        assert out[factor].icc == pytest.approx(share, abs=1.1e-3)
        assert loglik <= out[factor].loglik + 1e-9 and out[factor].loglik == pytest.approx(loglik, abs=1e-4)


def test_mixed_model_balanced_and_small(spark, rng):
    """Equal to the closed form with equal rows; one subject, or one row each, has nothing between subjects."""
    a, k = 15, 4
    y = 2 * rng.normal(size=(a, 1)) + rng.normal(size=(a, k))
    rows = [(i, 0, float(v)) for i, row in enumerate(y) for v in row]
    rows += [(1, 1, 1.0), (1, 1, 2.0)] + [(i, 2, float(i)) for i in range(6)]
    out = {r.factor: r for r in multivariate.mixed_model(spark.createDataFrame(rows, "subject_id int, factor int, value double")).collect()}
    within = y.var(axis=1).sum() * k / (a * k - a)
    outer = k * y.mean(axis=1).var()
    assert out[0].s_within == pytest.approx(within) and out[0].s_between == pytest.approx((outer - within) / k)
    assert out[0].mean == pytest.approx(y.mean())
    assert out[1].icc == out[2].icc == 0.0
