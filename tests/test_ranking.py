import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadic.operators import ranking as K


def bh(p):
    p = np.where(np.isnan(p), 1.0, p)
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


@pytest.mark.parametrize("task_rows", [2_000_000, 9])
def test_bh_with_ties_and_missing(spark, rng, task_rows):
    p = np.round(rng.uniform(size=90) ** 2, 2)
    p[::7] = np.nan
    p[60:] = 0.5  # a third of all rows share one value
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(p)], "id int, p_val double")
    got = K.bh_fdr(df, [], task_rows=task_rows).orderBy("id").toPandas().q_val.to_numpy()
    assert np.allclose(got, bh(p), atol=1e-14)


@pytest.mark.parametrize("descending", [False, True])
def test_split_prefix_equals_single_window(spark, rng, descending):
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "x": rng.permutation(300).astype(float), "v": rng.normal(size=300)})
    df = spark.createDataFrame(pdf).withColumn("one", F.lit(1))
    measures = {"s": ("sum", "v"), "n": ("count", "one"), "lo": ("min", "v"), "hi": ("max", "v")}
    frames = [K.ordered_prefix(df, ["g"], "x", measures, descending, task_rows=t).toPandas().sort_values(["g", "x"]) for t in (10**6, 11)]
    assert len(frames[1]) == 300
    for c in measures:
        assert np.allclose(frames[0][c], frames[1][c], atol=1e-12)


@pytest.mark.parametrize("task_rows", [2_000_000, 8])
def test_average_rank(spark, rng, task_rows):
    pdf = pd.DataFrame({"g": ["a", "b"] * 60, "x": rng.integers(0, 12, 120).astype(float)})
    got = K.average_rank(spark.createDataFrame(pdf), ["g"], "x", task_rows=task_rows).toPandas()
    want = pdf.assign(rank=pdf.groupby("g").x.rank())
    assert sorted(map(tuple, got[["g", "x", "rank"]].to_numpy())) == sorted(map(tuple, want.to_numpy()))


@pytest.mark.parametrize("task_rows", [2_000_000, 10])
def test_weighted_quantile(spark, rng, task_rows):
    s, w = np.round(rng.uniform(size=80), 2), rng.uniform(size=80)
    got = K.weighted_quantile(spark.createDataFrame(pd.DataFrame({"score": s, "weight": w})), [], alpha=0.2, task_rows=task_rows).first()[0]
    order = np.argsort(s)
    cum = np.cumsum(w[order]) / (w.sum() + w.mean())
    assert got == s[order][np.searchsorted(cum, 0.8)]


def test_weighted_quantile_falls_back_to_largest(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "score double, weight double")
    assert K.weighted_quantile(df, [], alpha=0.01).first()[0] == 2.0


def test_mondrian_small_and_unseen_strata(spark):
    cal = spark.createDataFrame([("a", 0.1 * i, 1.0) for i in range(20)] + [("b", 0.3, 1.0)], "stratum string, score double, weight double")
    test = spark.createDataFrame([("a", 0.2), ("b", 3.0), ("c", 3.0)], "stratum string, score double")
    got = {r.stratum: r for r in K.mondrian_conformal(cal, test).collect()}
    assert got["b"].mean_radius == pytest.approx(np.pi) and got["c"].mean_radius == pytest.approx(np.pi)
    assert got[None].n == 3 and got[None].coverage == 1.0


def test_conformal_coverage_near_target(spark, rng):
    cal = spark.createDataFrame(pd.DataFrame({"stratum": "a", "score": rng.uniform(size=400), "weight": 1.0}))
    test = spark.createDataFrame(pd.DataFrame({"stratum": "a", "score": rng.uniform(size=2000)}))
    cover = K.mondrian_conformal(cal, test).filter("stratum IS NULL").first().coverage
    assert 0.85 < cover < 0.95


def test_spearman_pi1_and_ci(spark, rng):
    x = np.round(rng.normal(size=100), 1)
    y = np.round(x + rng.normal(size=100), 1)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    for rows in (2_000_000, 9):
        assert K.spearman(df, [], "x", "y", task_rows=rows).first().rho == pytest.approx(want, abs=1e-12)
    uniform = spark.createDataFrame([(i / 1000.0,) for i in range(1, 1001)], "p_val double")
    assert K.pi1(uniform, []).first().pi1 == pytest.approx(0.0, abs=0.01)
    assert K.percentile_ci(df, [], "x", {"m": 0.5}).first().m == pytest.approx(np.median(x))


def test_rank_to_normal_inverts_the_normal_distribution(spark):
    import math

    df = spark.createDataFrame([("g", f"s{i}", float(i * i)) for i in range(101)], "feature_id string, sample_id string, value double")
    rows = K.rank_to_normal(df).collect()
    for r in rows:
        level = min(max(r.level, 1e-7), 1 - 1e-7)
        assert 0.5 * math.erfc(-r.z / math.sqrt(2)) == pytest.approx(level, rel=1e-9)


def test_leaderboard_shape(spark):
    cells = spark.createDataFrame([("m2", "B", "x"), ("m1", "A", "y")], "metric string, arm string, cell string")
    got = K.leaderboard(cells, ["A", "B"], ["m1", "m2"]).orderBy("position").toPandas()
    assert list(got.metric) == ["m1", "m2"] and list(got.A) == ["y", "n/a"]


@pytest.mark.parametrize("shape", ["normal", "tied", "one", "heavy"])
def test_bracketed_percentiles_are_exact(spark, rng, shape):
    """Sketch, bracket and count against numpy, for distinct, tied and single values; nulls are left out."""

    n = {"one": 1}.get(shape, 4000)
    x = {"normal": rng.normal(size=n), "tied": np.round(rng.normal(size=n)), "one": np.array([3.5]),
         "heavy": np.where(rng.random(n) < 0.9, 7.0, rng.normal(size=n) * 100)}[shape]
    frame = pd.DataFrame({"g": np.arange(n) % 2, "v": x})
    rows = spark.createDataFrame(frame).unionByName(spark.sql("select 0L as g, cast(null as double) as v union all select 9L, null")).repartition(5)
    points = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.777, "e": 1.0}
    for by in (["g"], []):
        out = K.percentile_ci(rows, by, "v", points, task_rows=0, sketch=100).collect()
        for r in out:
            own = frame.v if not by else frame.v[frame.g == r.g]
            if len(own) == 0:
                assert all(r[k] is None for k in points)
            else:
                assert [r[k] for k in points] == pytest.approx(list(np.quantile(own, list(points.values()))), abs=1e-12)
        assert len(out) == (1 if not by else len(set(frame.g) | {0, 9}))


def test_weights_capped_either_way(spark, rng):
    rows = spark.createDataFrame([(float(v),) for v in rng.exponential(size=500)], "weight double")
    a, b = (sorted(r.weight for r in K.capped_weights(rows, task_rows=t).collect()) for t in (10**6, 0))
    assert a == pytest.approx(b, abs=1e-12)


def test_split_is_bounded_and_needs_no_cuts(spark, rng, monkeypatch):
    """Wishes for tiny tasks end in at most `RANGES` ranges of any group; no row looks through a list of cuts."""
    monkeypatch.setattr(K, "RANGES", 16)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b", "c"], [3000, 5, 300]), "x": rng.permutation(3305).astype(float), "one": 1})
    split = K.ordered_prefix(spark.createDataFrame(pdf), ["g"], "x", {"n": ("count", "one")}, task_rows=4)
    plan = split._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan and "_cuts" not in plan
    want = pdf.assign(n=pdf.groupby("g").x.rank().astype(int))
    assert sorted(map(tuple, split.select("g", "x", "n").collect())) == sorted(map(tuple, want[["g", "x", "n"]].to_numpy()))
