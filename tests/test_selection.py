import numpy as np
import pytest
from helpers import long_frame
from pyspark.sql import functions as F

from dyadic.operators import resample, selection as S


def test_fold_selection_uses_training_rows_only(spark, rng):
    x = rng.normal(size=(20, 6))
    features = long_frame(spark, x).withColumnRenamed("sample_id", "subject_id")
    folds = spark.createDataFrame([(f"s{i:03d}", i % 4) for i in range(20)], "subject_id string, fold int")
    got = S.fold_preprocess(features, folds, 3).toPandas()
    for fold in range(4):
        train = np.arange(20) % 4 != fold
        var = x[train].var(axis=0, ddof=1)
        keep = np.argsort(-var)[:3]
        part = got[got.fold == fold]
        assert set(part.feature_id) == {f"g{j:03d}" for j in keep}
        j = keep[0]
        rows = part[part.feature_id == f"g{j:03d}"].set_index("subject_id").value
        want = (x[:, j] - x[train, j].mean()) / x[train, j].std(ddof=1)
        assert np.allclose(rows.sort_index(), want)
    assert (got[got.held_out].groupby("fold").subject_id.nunique() == 5).all()


def test_held_out_rows_do_not_move_the_panel(spark, rng):
    x = rng.normal(size=(12, 5))
    folds = spark.createDataFrame([(f"s{i:03d}", i % 3) for i in range(12)], "subject_id string, fold int")
    changed = x.copy()
    changed[::3] *= 50  # fold 0 only
    panels = [S.fold_stats(long_frame(spark, m).withColumnRenamed("sample_id", "subject_id"), folds).filter("fold = 0").orderBy("feature_id").toPandas()
              for m in (x, changed)]
    assert np.allclose(panels[0].variance, panels[1].variance)


def test_left_out_variance(spark, rng):
    x = rng.normal(1000, 1, size=(8, 4))
    features = long_frame(spark, x).withColumnRenamed("sample_id", "subject_id")
    got = S.loo_topk_variance(features, 4).toPandas().set_index(["subject_id", "feature_id"]).variance
    for i in range(8):
        for j in range(4):
            assert got[(f"s{i:03d}", f"g{j:03d}")] == pytest.approx(np.delete(x[:, j], i).var(ddof=1), rel=1e-9)


def test_topk_breaks_ties_by_id_and_keeps_fixed_block(spark):
    rows = [(f, s, float(s)) for f in "dcba" for s in range(3)] + [("z", s, 1.0) for s in range(3)]
    df = spark.createDataFrame(rows, "feature_id string, sample_id int, value double")
    assert [r.feature_id for r in S.topk_variance(df, 2).collect()] == ["a", "b"]
    assert sorted(r.feature_id for r in S.topk_variance(df, 1, always=["z"]).collect()) == ["a", "z"]


def test_encode_covariates(spark):
    df = spark.createDataFrame([(1, "M", 2.0, None), (2, "F", None, None), (3, None, 4.0, None)], "id int, sex string, age double, void double")
    got = S.encode_covariates(df, ["sex", "age", "void"]).orderBy("id").collect()
    assert [r.sex for r in got] == [1.0, 0.0, 0.5] and [r.age for r in got] == [2.0, 3.0, 4.0] and [r.void for r in got] == [0.0] * 3
    assert [r.age for r in S.encode_covariates(df, ["age"], fill="zero").orderBy("id").collect()] == [2.0, 0.0, 4.0]


def test_scaling_and_imputation(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", None), ("g", "c", 3.0), ("h", "a", 5.0), ("h", "b", 5.0), ("v", "a", None)],
                               "feature_id string, sample_id string, value double")
    filled = {(r.feature_id, r.sample_id): r.value for r in S.impute_mean(df).collect()}
    assert filled[("g", "b")] == 2.0 and filled[("v", "a")] is None
    scaled = {(r.feature_id, r.sample_id): r.value for r in S.zscale(df.na.drop()).collect()}
    assert scaled[("h", "a")] == 0.0 and scaled[("g", "c")] == 1.0


def test_tier_needs_hits_and_genes(spark):
    results = spark.createDataFrame([("c1", 0.01), ("c2", 0.5)], "feature_id string, q_val double")
    dnam = spark.createDataFrame([("c1", 0.1), ("c1", 0.9), ("c2", 0.2), ("c2", 0.4)], "feature_id string, value double")
    rna = spark.createDataFrame([("G", 1.0), ("G", 2.0), ("H", 1.0), ("H", 1.0)], "feature_id string, value double")
    near = spark.createDataFrame([("c1", "G", -50.0), ("c1", "H", 500.0)], "feature_id string, gene string, distance_kb double")
    tier = S.resolve_tier(results, dnam, rna, near)
    assert sorted((r.tier, r.feature_id) for r in tier.collect()) == [(1, "G"), (1, "c1")]
    far = near.withColumn("distance_kb", F.lit(900.0))
    assert {r.tier for r in S.resolve_tier(results, dnam, rna, far).collect()} == {2}


def test_outlier_flag(spark):
    rows = [(f"s{i}", "JAK_STAT", 10.0 if i == 0 else 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "sample_id string, source string, score double")
    assert [r.sample_id for r in S.flag_outliers(df, "JAK-STAT").filter("flagged").collect()] == ["s0"]
    assert S.flag_outliers(df, "other").filter("flagged").count() == 0


def test_folds_are_even_and_disjoint(spark):
    subjects = spark.createDataFrame([(i,) for i in range(23)], "subject_id int")
    folds = resample.subject_folds(subjects, 5).toPandas()
    assert len(folds) == 23 and folds.subject_id.is_unique and set(folds.fold.value_counts()) == {4, 5}
    assert folds.equals(resample.subject_folds(subjects.repartition(3), 5).toPandas().sort_values("subject_id").reset_index(drop=True)) or (
        dict(folds.itertuples(index=False)) == dict(resample.subject_folds(subjects.repartition(3), 5).toPandas().itertuples(index=False)))
    with pytest.raises(ValueError):
        resample.subject_folds(subjects, 24)
    assert resample.calibration_split(subjects).filter("calibration").count() == 5
