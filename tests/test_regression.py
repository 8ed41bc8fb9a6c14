import numpy as np
import pytest
from helpers import design_frame, long_frame, ols
from pyspark.sql import functions as F

from dyadic.functions.tails import t_two_sided
from dyadic.operators import regression as G


@pytest.fixture
def cohort(spark, rng):
    n, p = 36, 12
    y = rng.normal(3, 1, (n, p))
    y[:, 6:][rng.uniform(size=(n, 6)) < 0.15] = np.nan
    cols = {"response": (np.arange(n) % 2).astype(float), "a": rng.uniform(size=n), "b": rng.uniform(size=n), "age": rng.normal(50, 9, n)}
    return y, cols, long_frame(spark, y), design_frame(spark, **cols)


def test_interaction_matches_direct_fits(cohort):
    y, c, features, samples = cohort
    got = G.interaction_regression(features, samples, ["a", "b"], ["age"]).toPandas().set_index(["feature_id", "cell_type", "term"])
    for j in range(y.shape[1]):
        for cell in ("a", "b"):
            x = np.column_stack([np.ones(len(y)), c["response"], c[cell], c["response"] * c[cell], c["age"]])
            beta, se, df = ols(y[:, j], x)
            for k, term in ((1, "response"), (3, "interaction")):
                row = got.loc[(f"g{j:03d}", cell, term)]
                assert row.coef == pytest.approx(beta[k], abs=1e-10)
                assert row.se == pytest.approx(se[k], abs=1e-10)
                assert row.df == df
                assert row.p_val == pytest.approx(float(t_two_sided(beta[k] / se[k], df)), abs=1e-10)


def test_row_order_and_partitions_do_not_matter(cohort):
    _, _, features, samples = cohort
    a = G.simple_regression(features, samples, ["age"]).toPandas().set_index("feature_id").sort_index()
    b = G.simple_regression(features.orderBy(F.rand(3)).repartition(7), samples.repartition(3), ["age"]).toPandas().set_index("feature_id").sort_index()
    assert np.allclose(a[["coef", "se", "p_val", "q_val"]], b[["coef", "se", "p_val", "q_val"]], atol=1e-12)


def test_rank_deficient_designs_give_the_least_norm_fit(spark, cohort):
    y, c, features, samples = cohort
    extra = samples.withColumn("flat", F.lit(2.0)).withColumn("twice", F.col("a") * 2 + 1)
    names = ("age", "flat", "a", "twice")
    got = G.fit_models(features, extra, [G.Model("m", names, ("intercept", *names))]).toPandas()
    x = np.column_stack([np.ones(len(y)), c["age"], np.full(len(y), 2.0), c["a"], 2 * c["a"] + 1])
    for j in range(y.shape[1]):
        beta, se, df = ols(y[:, j], x)
        rows = got[got.feature_id == f"g{j:03d}"].set_index("term")
        for k, term in enumerate(("intercept", *names)):
            assert rows.coef[term] == pytest.approx(beta[k], abs=1e-9)
            assert rows.se[term] == pytest.approx(se[k], abs=1e-9)


def test_too_few_values_give_nulls(spark):
    y = np.full((8, 2), np.nan)
    y[:, 0] = np.arange(8)
    y[:3, 1] = [1.0, 2.0, 4.0]
    got = G.simple_regression(long_frame(spark, y), design_frame(spark, response=[0, 1] * 4)).toPandas().set_index("feature_id")
    assert np.isnan(got.coef["g001"]) and got.q_val["g001"] == 1.0
    assert np.isfinite(got.coef["g000"])


def test_covariate_holes_only_drop_rows_of_the_models_using_them(spark, cohort):
    y, c, features, samples = cohort
    holed = samples.withColumn("b", F.when(F.col("sample_id") > "s005", F.col("b")))
    got = G.interaction_regression(features, holed, ["a", "b"]).filter("term = 'interaction'").toPandas().set_index(["feature_id", "cell_type"])
    assert got.loc[("g000", "a")].n == 36 and got.loc[("g000", "b")].n == 30


def test_absent_cells_can_mean_zero(spark, rng):
    y = rng.poisson(0.7, (30, 8)).astype(float)
    dense = long_frame(spark, y)
    samples = design_frame(spark, response=(np.arange(30) % 2).astype(float), age=rng.normal(size=30))
    a = G.simple_regression(dense, samples, ["age"], absent="none").toPandas().set_index("feature_id").sort_index()
    b = G.simple_regression(dense.filter("value <> 0"), samples, ["age"], absent="zero").toPandas().set_index("feature_id").sort_index()
    assert np.allclose(a[["coef", "se", "p_val"]], b[["coef", "se", "p_val"]], atol=1e-12)


def test_residuals_are_orthogonal(spark, cohort):
    y, c, features, samples = cohort
    got = G.residualise(features, samples, ["a", "b", "age"]).toPandas().pivot(index="sample_id", columns="feature_id", values="value")
    x = np.column_stack([np.ones(len(y)), c["a"], c["b"], c["age"]])
    for j in range(y.shape[1]):
        keep = ~np.isnan(y[:, j])
        assert np.allclose(x[keep].T @ got[f"g{j:03d}"].to_numpy()[keep], 0, atol=1e-8)


def test_planted_interaction_is_found_and_null_is_not(spark, rng):
    n = 60
    response, a = (np.arange(n) % 2).astype(float), rng.uniform(size=n)
    y = rng.normal(size=(n, 40))
    y[:, :5] += 6 * (response * a)[:, None]
    got = G.interaction_regression(long_frame(spark, y), design_frame(spark, response=response, a=a), ["a"]).filter(
        "term = 'interaction'").toPandas().set_index("feature_id").q_val
    assert (got[[f"g{j:03d}" for j in range(5)]] < 0.05).all()
    assert (got[[f"g{j:03d}" for j in range(5, 40)]] < 0.05).sum() <= 3


def test_fraction_pc1_constant_columns(spark):
    flat = design_frame(spark, a=[0.5] * 6, b=[0.5] * 6)
    assert {r.pc1 for r in G.fraction_pc1(flat, ["a", "b"]).collect()} == {0.0}


def test_stratified_replication_parts(spark, rng):
    n = 40
    y = rng.normal(size=(n, 3))
    response = (np.arange(n) % 2).astype(float)
    y[:, 0] += 3 * response
    samples = design_frame(spark, response=response, therapy=["cpt" if i % 4 < 2 else "PE" for i in range(n)])
    ref = spark.createDataFrame([("g000", 1.0), ("g001", -1.0)], "feature_id string, reference_coef double")
    out = G.stratified_replication(long_frame(spark, y), samples, ref, "therapy", "CPT")
    overall = out["overall"].toPandas().set_index("feature_id")
    assert overall.same_direction["g000"] and not overall.same_direction["g002"]
    assert set(out["within"].toPandas().therapy) == {"CPT", "PE"}
    summary = G.replication_summary(out["overall"]).first()
    assert summary.n_tested == 3 and summary.spearman_rho is None


def test_perfect_replication(spark, rng):
    rows = [(f"g{i}", "Mono", float(c), float(c * rng.uniform(0.8, 1.2)), 0.01, 0.01) for i, c in enumerate(rng.normal(size=100))]
    looked = spark.createDataFrame(rows, "feature_id string, cell_type string, coef double, other_coef double, other_p_val double, other_q_val double")
    got = G.concordance_summary(looked.withColumn("matched", F.lit(True))).first()
    assert got.sign_concordance > 0.7 and got.spearman_rho > 0.5 and got.verdict == "REPLICATES"
