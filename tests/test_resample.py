import numpy as np
import pandas as pd
import pytest
from helpers import vectors
from pyspark.sql import functions as F

from dyadic.functions import verdicts as V
from dyadic.operators import resample as R


def test_permutations_keep_group_sizes_and_differ(spark):
    s = spark.createDataFrame([(i, int(i < 7)) for i in range(20)], "subject_id int, label int")
    grid = R.permutation_grid(s, 30).toPandas()
    sums = grid.groupby("rep").label.sum()
    assert len(grid) == 31 * 20 and (sums == 7).all()
    ordered = grid[grid.rep > 0].sort_values(["rep", "subject_id"])
    assert ordered.groupby("rep").label.apply(tuple).nunique() > 25


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 50, 97, 100, 1000])
def test_keyed_places_are_permutations(spark, n):
    """Every replicate permutes all places, and the column form gives the same."""
    keys = R.permutation_keys(20, 5)
    places = R.keyed_places(np.arange(n), keys, n)
    assert (np.sort(places, axis=1) == np.arange(n)).all()
    if n in (1, 3, 97):
        rows = spark.range(n).crossJoin(spark.range(1, 21).withColumnRenamed("id", "rep"))
        out = rows.select("rep", "id", R.keyed_place(F.col("id"), F.col("rep"), n, 5).alias("to")).collect()
        assert all(r.to == places[r.rep, r.id] for r in out)


def test_keyed_places_are_even():
    """Each subject comes to each place, and each pair to the same side, as often as chance has it."""
    n, b = 12, 6000
    places = R.keyed_places(np.arange(n), R.permutation_keys(b, 9)[1:], n)
    counts = np.array([[np.sum(places[:, i] == j) for j in range(n)] for i in range(n)])
    expected = b / n
    assert ((counts - expected) ** 2 / expected).sum() < 121 + 5 * np.sqrt(2 * 121)
    ones = places < 6
    together = np.array([(ones[:, i] & ones[:, j]).mean() for i in range(n) for j in range(i)])
    assert np.abs(together - 6 * 5 / (12 * 11)).max() < 5 * np.sqrt(0.25 / b)


def test_label_sums_equal_the_grid(spark, rng, monkeypatch):
    """With the labels of a few replicates at a time, against the rows of the grid."""
    monkeypatch.setattr(R, "_LABEL_CELLS", 100)
    x, g = rng.normal(size=(30, 4)), np.arange(30) % 3 == 0
    frame = vectors(spark, x, label=g.astype(int))
    grid = R.permutation_grid(frame.select("subject_id", "label"), 25).toPandas()
    sums = {r.rep: r for r in R.label_sums(frame, 25).collect()}
    assert len(sums) == 26
    for rep, rows in grid.groupby("rep"):
        ones = rows[rows.label == 1].subject_id.to_numpy()
        assert sums[rep].ones == len(ones) == 10 and sums[rep].zeros == 20
        assert np.allclose(sums[rep].one_sum, x[ones].sum(0)) and np.allclose(sums[rep].zero_sum, x.sum(0) - x[ones].sum(0))


def test_draws_do_not_depend_on_partitioning(spark):
    s = spark.createDataFrame([(i, i % 2) for i in range(40)], "subject_id int, label int")
    a = R.bootstrap_counts(s, 10).toPandas().sort_values(["rep", "subject_id"]).reset_index(drop=True)
    b = R.bootstrap_counts(s.orderBy(F.rand(5)).repartition(6), 10).toPandas().sort_values(["rep", "subject_id"]).reset_index(drop=True)
    assert a.equals(b) and (a.groupby("rep").copies.sum() == 40).all()


def test_split_hash_order_equals_single_window(spark, monkeypatch):
    s = spark.createDataFrame([(i,) for i in range(500)], "subject_id int")
    key = R.draw(3, F.col("subject_id"))
    one = dict(R.hash_position(s, [], key, "at", "subject_id").select("subject_id", "at").collect())
    monkeypatch.setattr(R, "TASK_ROWS", 50)
    assert dict(R.hash_position(s, [], key, "at", "subject_id").select("subject_id", "at").collect()) == one
    assert sorted(one.values()) == list(range(1, 501))


def pseudo_f(x, g):
    total = ((x - x.mean(0)) ** 2).sum()
    within = sum(((x[g == k] - x[g == k].mean(0)) ** 2).sum() for k in (0, 1))
    return (total - within) / (within / (len(x) - 2))


def test_permanova_statistic_and_power(spark, rng):
    g = np.arange(40) % 2
    x = rng.normal(size=(40, 3)) + 1000
    shifted = x + np.outer(g, [2.0, 0, 0])
    hit = R.permanova(vectors(spark, shifted, label=g), 199).first()
    assert hit.f_statistic == pytest.approx(pseudo_f(shifted, g), rel=1e-6) and hit.p_value == 0.0
    assert R.permanova(vectors(spark, x, label=g), 199).first().p_value > 0.05


def test_cohens_d_conventions(spark):
    df = spark.createDataFrame([(1, 4.0), (1, 6.0), (0, 1.0), (0, 3.0)], "label int, value double")
    assert R.cohens_d(df, []).first().d == pytest.approx(3 / np.sqrt(2))
    assert R.cohens_d(df, [], ddof=0).first().d == pytest.approx(3.0)
    swapped = df.withColumn("label", 1 - F.col("label"))
    assert R.cohens_d(swapped, [], signed=True).first().d == pytest.approx(-3 / np.sqrt(2))
    assert R.cohens_d(df.filter("label = 1"), []).first().d == 0.0
    assert R.cohens_d(df.filter("label = 1"), [], empty=None).first().d is None
    flat = spark.createDataFrame([(1, 1.0), (1, 1.0), (0, 1.0), (0, 1.0)], "label int, value double")
    assert R.cohens_d(flat, []).first().d == 0.0


def clouds(spark, rng, gap):
    ref = rng.normal(0, 0.6, (40, 8)) + np.eye(8)[0] * 2.5
    yes, no = rng.normal(0, 0.6, (30, 8)), rng.normal(0, 0.6, (30, 8)) + np.eye(8)[0] * gap
    termini = vectors(spark, np.vstack([yes, no]), label=[1] * 30 + [0] * 30)
    return termini, vectors(spark, ref)


def test_proximity_planted_and_null(spark, rng):
    hit = R.proximity_test(*clouds(spark, rng, 1.5), bootstrap=199, permutations=199)
    row = hit.withColumn("v", V.proximity_gate(F.col("p_value"), F.col("cohens_d"))).first()
    assert row.v == "PASS" and row.effect_low < row.effect < row.effect_high and row.d_low > 0
    assert row.p_value == pytest.approx(1 / 200)
    null = R.proximity_test(*clouds(spark, rng, 0.0), bootstrap=99, permutations=99).first()
    assert null.p_value > 0.05


def test_proximity_refuses_bad_input(spark, rng):
    termini, ref = clouds(spark, rng, 0.0)
    with pytest.raises(ValueError, match="dimensions"):
        R.proximity_test(termini, vectors(spark, np.zeros((3, 5))))
    with pytest.raises(ValueError, match="two subjects"):
        R.proximity_test(termini.filter("label = 1"), ref)


def test_proximity_gate_bounds_are_strict(spark):
    df = spark.createDataFrame([(0.05, 0.9), (0.01, 0.3), (0.049, 0.31)], "p double, d double")
    assert [r[0] for r in df.select(V.proximity_gate(F.col("p"), F.col("d"))).collect()] == ["FAIL", "FAIL", "PASS"]


@pytest.mark.parametrize("missing", [False, True])
def test_centroid_permutation_both_routes(spark, rng, missing):
    x = rng.normal(size=(16, 6))
    x[8:] += 1.0
    rows = [(i, j, float(x[i, j])) for i in range(16) for j in range(6) if not (missing and i == 3 and j == 2)]
    features = spark.createDataFrame(rows, "sample_id int, feature_id int, value double")
    subjects = spark.createDataFrame([(i, int(i < 8)) for i in range(16)], "sample_id int, label int")
    anchor = spark.createDataFrame([(j, 2.0) for j in range(6)], "feature_id int, value double")
    got = R.centroid_permutation(features, subjects, anchor, 49).first()
    one = x[:8].mean(0)
    if missing:
        one[2] = np.delete(x[:8, 2], 3).mean()
    assert got.d_one == pytest.approx(np.linalg.norm(one - 2.0))
    assert got.d_zero == pytest.approx(np.linalg.norm(x[8:].mean(0) - 2.0))
    assert got.direction_ok and got.p_value < 0.05 and got.n_permutations == 49


def test_ttest_and_hotelling(spark, rng):
    x = rng.normal(size=(30, 2))
    g = np.arange(30) % 2
    df = spark.createDataFrame(pd.DataFrame({"label": g, "value": x[:, 0], "k": 1}))
    t = R.ttest(df, ["k"]).first()
    a, b = x[g == 1, 0], x[g == 0, 0]
    pooled = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / 28
    assert t.t_stat == pytest.approx((a.mean() - b.mean()) / np.sqrt(pooled * (1 / len(a) + 1 / len(b))))
    one = vectors(spark, x[:, :1], label=g)
    assert R.hotelling_t2(one).first().p_val == pytest.approx(t.p_val)


def test_numbered_subjects_leave_one_task(spark):
    """Replicates are laid out by several tasks, with the labels of the column form."""
    s = spark.range(400).select(F.col("id").alias("subject_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    tasks = lambda df: df.filter("rep > 0").select(F.spark_partition_id().alias("p")).distinct().count()
    grid = R.permutation_grid(s, 5)
    assert tasks(grid) > 1
    placed = R._placed(s.select("subject_id"), 42, "subject_id", 400)
    assert placed.select(F.spark_partition_id()).distinct().count() > 1
    want = placed.crossJoin(spark.range(1, 6).withColumnRenamed("id", "rep")).select(
        "rep", "subject_id", (R.keyed_place(F.col("_at"), F.col("rep"), 400, 42) < 134).cast("int"))
    assert sorted(map(tuple, grid.filter("rep > 0").collect())) == sorted(map(tuple, want.collect()))
