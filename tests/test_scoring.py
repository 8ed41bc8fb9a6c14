import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadic import session
from dyadic.operators import clustering, moments, multivariate as M, scoring


@pytest.fixture
def cohort(spark, rng):
    n, d = 24, 3
    flag = np.arange(n) % 2 == 0
    z = rng.normal(size=(n, d)) * 0.3 + np.where(flag[:, None], [2.0, 0, 0], [-0.5, 0, 0])
    deltas = spark.createDataFrame(pd.DataFrame({
        "subject_id": range(n), "responder": flag, "target": z[:, 0] * 2 + rng.normal(size=n), "z": [list(map(float, r)) for r in z]}))
    runs = spark.createDataFrame([(s, r, [float(v) for v in z[s] + 0.01 * r]) for s in range(n) for r in range(3)], "subject_id long, run int, z array<double>")
    scores = spark.createDataFrame(
        [(s, v, f, float(z[s, f] * (1 if f else 0.1) + rng.normal() * 0.05 * (1 + f))) for s in range(n) for v in range(2) for f in range(d)],
        "subject_id long, visit int, factor int, value double")
    return deltas, runs, scores, z, flag


def test_six_metrics(spark, cohort):
    deltas, runs, scores, z, flag = cohort
    coverage = spark.createDataFrame([("a", 0.5), (None, 0.912)], "stratum string, coverage double")
    enrichment = spark.createDataFrame([(0.01,), (0.2,), (None,)], "q_val double")
    cells = {r.metric: r.cell for r in scoring.score_arm("B", deltas, runs, scores, coverage, enrichment, bootstrap=20, k_grid=(1, 2), archetype_bootstrap=2).collect()}
    assert list(cells) == list(scoring.METRICS)
    assert cells["iv_conformal_coverage"] == "covered 0.912" and cells["v_biological_coherence"] == "1 enriched sets | PASS"
    axis = np.linalg.eigh(np.cov(z[flag].T))[1][:, -1]
    axis = axis * np.sign(axis @ z[flag].mean(0))
    cos = (z / np.linalg.norm(z, axis=1, keepdims=True)) @ axis
    gap = cos[flag].mean() - cos[~flag].mean()
    assert cells["i_trajectory_consistency"] == f"runs agree 1.000, responders {cos[flag].mean():.3f}, gap {gap:.3f} | PASS"
    bare = {r.metric: r.cell for r in scoring.score_arm("B", deltas, runs, scores, metrics=scoring.METRICS[3:5]).collect()}
    assert bare == {m: scoring.NOT_GIVEN for m in scoring.METRICS[3:5]}


def test_the_bootstrap_parameter_is_obeyed(spark, cohort, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "classify_icc", lambda s, b, seed: seen.append(b) or spark.createDataFrame([(0, "trait"), (1, "state")], "factor int, classification string"))
    real = M.cca_max
    monkeypatch.setattr(M, "cca_max", lambda w, a, b, n, seed: seen.append(n) or real(w, a, b, 5, seed))
    scoring.trait_state(cohort[2], bootstrap=2000).collect()
    assert seen == [2000, 2000]


def test_mixture_tells_whether_it_settled(spark, cohort):
    points = cohort[0].select("subject_id", "z", F.array(F.lit(1.0)).alias("w"))
    assert clustering.fit_mixtures(points, [2])[2] and not clustering.fit_mixtures(points, [2], iterations=1)[2]
    assert clustering.cluster_archetypes(cohort[0], k_grid=(2,), bootstrap=2)["summary"].first().converged


def test_likelihood_icc(spark, cohort):
    got = {r.factor: r for r in M.classify_icc(cohort[2], bootstrap=5).collect()}
    rows = cohort[2].toPandas()
    for f, part in rows.groupby("factor"):
        v = part.pivot(index="subject_id", columns="visit", values="value").to_numpy()
        ssb, ssw, a = 2 * ((v.mean(1) - v.mean()) ** 2).sum(), ((v - v.mean(1, keepdims=True)) ** 2).sum(), len(v)
        between = max(0.0, (ssb / a - ssw / a) / 2)
        assert got[f].icc == pytest.approx(between / (between + ssw / a))


def test_small_side_counts_bytes_and_runs_once(spark):
    hits = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        hits.add(1)
        return x

    df = spark.range(50).select(seen("id").alias("id"), F.sequence(F.lit(1), F.lit(100)).alias("v")).repartition(2)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "ResolvedHint" in session.small_side(df)._jdf.queryExecution().analyzed().toString()
    assert hits.value == 50
    assert "hint" not in plan(session.small_side(df, rows=49)).lower() and "hint" not in plan(session.small_side(df, size=1000)).lower()


def test_vectors_of_different_width_raise(spark):
    with pytest.raises(ValueError):
        moments.vector_width(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "z array<double>"), "z")


def test_a_centroid_stands_in_for_a_cloud(spark, tmp_path):
    from dyadic.sources import tables

    path = str(tmp_path / "c")
    spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "id string, g1 double, g2 double").write.parquet(path)
    got = sorted(map(tuple, tables.read_cloud(spark, "ill", centroid_path=path, group="b").collect()))
    assert got == [("ill", "b", "g1", 3.0), ("ill", "b", "g2", 4.0)]
    assert tables.read_cloud(spark, "ill", samples_path=path).count() == 4
    with pytest.raises(ValueError):
        tables.read_cloud(spark, "ill", centroid_path=path, group="z")
    with pytest.raises(ValueError):
        tables.read_cloud(spark, "ill")


@pytest.mark.parametrize("name", ["score_arm_fitted", "job_leaderboard_fitted"])
def test_fitted_queries_take_the_whole_work(spark, monkeypatch, name):
    """All metrics with the operator's own replicates; the leaderboard keeps the grid that its planted clusters are tested with."""
    import inspect

    import __spark_entry__ as entry
    from dyadic.catalog import latent

    real, seen = inspect.signature(scoring.score_arm), []

    def spy(*args, **kwargs):
        bound = real.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments)
        return spark.createDataFrame([(m, args[0], "x") for m in scoring.METRICS], "metric string, arm string, cell string")

    monkeypatch.setattr(latent.scoring, "score_arm", spy)
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() == 6
    for got in seen:
        assert got["metrics"] is None and got["coverage"] is not None and got["enrichment"] is not None
        assert (got["bootstrap"], got["archetype_bootstrap"]) == (2000, 10)
        assert tuple(got["k_grid"]) == ((2, 3, 4, 5) if name == "score_arm_fitted" else (2, 3))
    assert seen


def test_resampled_components_make_no_row_per_draw(spark, rng, monkeypatch):
    """Ratios of every replicate as from copied subjects, over more factors than a block and with subjects that lack some."""
    rows = [(s, f, float(v)) for s in range(40) for f in range(70) if (s * f) % 7 or s < 3
            for v in rng.normal(loc=s * (f % 3), size=1 + (s + f) % 3)]
    rows += [(s, 70, None) for s in range(3)] + [(5, 70, 1.0), (6, 70, 2.0), (6, 70, 2.5)]
    scores = spark.createDataFrame(rows, "subject_id long, factor int, value double")
    monkeypatch.setattr(M, "_CHUNK", 15)
    groups = M._subject_groups(scores)
    got = {(r.rep, r.factor): r for r in M._resampled_components(groups, 70, 3).collect()}
    copies = M.bootstrap_counts(groups.select("subject_id").distinct(), 70, 3).toPandas()
    frame = pd.DataFrame([r for r in rows if r[2] is not None], columns=["subject_id", "factor", "value"])
    own = frame.groupby(["factor", "subject_id"])["value"].agg(["count", "mean", lambda v: ((v - v.mean()) ** 2).sum()]).reset_index()
    own.columns = ["factor", "subject_id", "k", "m", "w"]
    checked = 0
    for (rep, f), part in copies.merge(own, on="subject_id").query("factor < 70").groupby(["rep", "factor"]):
        c, k, m = part["copies"], part["k"], part["m"]
        a, n = c.sum(), (c * k).sum()
        assert (got[rep, f].a, got[rep, f].n) == (a, n)
        if a < 2 or n == a:
            continue
        grand = (c * k * m).sum() / n
        msb, msw = (c * k * (m - grand) ** 2).sum() / (a - 1), (c * part["w"]).sum() / (n - a)
        between, within = max(0.0, (msb - msw) / ((n - (c * k * k).sum() / n) / (a - 1))), max(msw, 1e-12)
        assert got[rep, f].icc == pytest.approx(between / (between + within), abs=1e-9)
        checked += 1
    assert checked > 4500
