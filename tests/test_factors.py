import numpy as np
import pandas as pd
import pytest

from dyadic.functions.tails import digamma
from dyadic.operators.factors import factor_model


def views_frame(spark, parts):
    rows = [(v, i, j, None if np.isnan(x) else float(x)) for v, m in parts.items() for (i, j), x in np.ndenumerate(m)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["view", "obs_id", "feature_id", "value"]).astype({"value": object}),
                                 "view string, obs_id int, feature_id int, value double")


@pytest.fixture
def planted(rng):
    """Two views: one factor shared, one private to each."""
    n = 80
    z = rng.normal(size=(n, 3))
    wa, wb = rng.normal(size=(3, 14)), rng.normal(size=(3, 10))
    wa[2], wb[1] = 0, 0
    a, b = z @ wa + 0.3 * rng.normal(size=(n, 14)), 5 * (z @ wb + 0.3 * rng.normal(size=(n, 10))) + 2
    return z, a, b


def matched(found, true):
    """Correlation of each planted factor with the one found that is most like it, and which that is."""
    c = np.abs(np.corrcoef(found.T, true.T)[: found.shape[1], found.shape[1]:])
    return c.max(axis=0), c.argmax(axis=0)


def parts_of(out, n, k):
    s = out["scores"].toPandas().pivot(index="obs_id", columns="factor", values="value").to_numpy()
    r2 = {(r.view, r.factor): r.r2 for r in out["activity"].collect()}
    bounds = [r.bound for r in out["bounds"].orderBy("round").collect()]
    assert s.shape == (n, k)
    return s, r2, bounds


def test_planted_factors_and_their_views(spark, planted):
    z, a, b = planted
    out = factor_model(views_frame(spark, {"a": a, "b": b}), 5, rounds=25)
    s, r2, bounds = parts_of(out, 80, 5)
    like, which = matched(s, z)
    assert (like > 0.95).all() and len(set(which)) == 3
    shared, only_a, only_b = which + 1
    assert r2["a", shared] > 0.1 and r2["b", shared] > 0.1
    assert r2["a", only_a] > 0.1 and r2["b", only_a] < 0.02 and r2["b", only_b] > 0.1 and r2["a", only_b] < 0.02
    for surplus in set(range(1, 6)) - set(which + 1):
        assert r2["a", surplus] < 0.02 and r2["b", surplus] < 0.02
    assert all(y >= x - 1e-6 * abs(x) for x, y in zip(bounds, bounds[1:])) and len(bounds) > 3
    noise = out["loadings"].filter("view = 'a' and factor = 1").toPandas()["noise"] * a.std(axis=0).mean()
    assert 0.2 < noise.median() < 0.45


def test_missing_views_and_cells(spark, planted, rng):
    z, a, b = planted
    a, b = a.copy(), b.copy()
    b[:20] = np.nan
    a[70:] = np.nan
    a[rng.random(a.shape) < 0.1] = np.nan
    out = factor_model(views_frame(spark, {"a": a, "b": b}), 3, rounds=25)
    s, _, bounds = parts_of(out, 80, 3)
    like, _ = matched(s[20:70], z[20:70])
    assert (like > 0.85).all()
    assert all(y >= x - 1e-6 * abs(x) for x, y in zip(bounds, bounds[1:]))
    # A sample without view b still has its place on what view a shows.
    like, _ = matched(s[:20], z[:20, :2])
    assert (like > 0.9).all()


def test_matches_direct_updates(spark, rng):
    """Five rounds against the same updates on whole matrices, cells missing."""
    n, k, prior = 25, 2, 1e-3
    parts = {"a": rng.normal(size=(n, 5)), "b": rng.normal(size=(n, 4))}
    parts["a"][3, 2] = parts["b"][7] = np.nan
    z0 = rng.normal(size=(n, k))
    start = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(z0)], "obs_id int, z array<double>")
    out = factor_model(views_frame(spark, parts), k, rounds=5, tolerance=-1.0, start=start, turn=False)
    y, view = [], []
    for v, m in parts.items():
        c = m - np.nanmean(m, axis=0)
        y.append(c / np.sqrt(np.nanmean(c * c)))
        view += [v] * m.shape[1]
    y, view = np.hstack(y), np.array(view)
    seen = ~np.isnan(y)
    y = np.where(seen, y, 0)
    z, zz = z0, z0[:, :, None] * z0[:, None, :]
    tau, alpha = np.ones(y.shape[1]), {v: np.ones(k) for v in parts}
    for _ in range(5):
        u, uu = np.zeros((y.shape[1], k)), np.zeros((y.shape[1], k, k))
        for d in range(y.shape[1]):
            g = zz[seen[:, d]].sum(axis=0)
            c = np.linalg.inv(np.diag(alpha[view[d]]) + tau[d] * g)
            u[d] = tau[d] * c @ (z * y[:, [d]]).sum(axis=0)
            uu[d] = c + np.outer(u[d], u[d])
            q = (y[:, d] ** 2).sum() - 2 * u[d] @ (z * y[:, [d]]).sum(axis=0) + (uu[d] * g).sum()
            tau[d] = (prior + seen[:, d].sum() / 2) / (prior + q / 2)
        for v in parts:
            at = view == v
            alpha[v] = (prior + at.sum() / 2) / (prior + np.einsum("dkk->k", uu[at]) / 2)
        z, zz = z.copy(), zz.copy()
        for i in range(n):
            s = np.linalg.inv(np.eye(k) + np.einsum("d,dij->ij", tau * seen[i], uu))
            z[i] = s @ ((tau * y[i]) @ u)
            zz[i] = s + np.outer(z[i], z[i])
    s, _, _ = parts_of(out, n, k)
    assert np.allclose(s, z, atol=1e-8)
    got = {(r.view, r.feature_id, r.factor): (r.loading, r.noise) for r in out["loadings"].collect()}
    for d in range(y.shape[1]):
        for j in range(k):
            assert np.allclose(got[view[d], d % 5 if view[d] == "a" else d - 5, j + 1], (u[d, j], tau[d] ** -0.5), atol=1e-8)
    assert {(r.view, r.factor): r.precision for r in out["activity"].collect()} == pytest.approx(
        {(v, j + 1): alpha[v][j] for v in parts for j in range(k)})


def test_constant_feature_and_empty(spark, rng):
    m = rng.normal(size=(12, 3))
    m[:, 1] = 4.0
    out = factor_model(views_frame(spark, {"a": m}), 1, rounds=10)
    loads = {r.feature_id: r.loading for r in out["loadings"].collect()}
    assert abs(loads[1]) < 1e-6
    with pytest.raises(ValueError):
        factor_model(views_frame(spark, {"a": m}).filter("false"), 1)


def test_digamma():
    for x in (0.001, 0.5, 1.0, 3.7, 40.0, 1e6):
        h = 1e-5 * x
        import math

        assert digamma(np.array([x]))[0] == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-5)
