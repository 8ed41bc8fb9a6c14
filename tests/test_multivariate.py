import numpy as np
import pandas as pd
import pytest
from helpers import long_frame, vectors
from pyspark.sql import functions as F

from dyadic.operators import clustering, domain, multivariate as M, scoring


def signal(rng, n, p):
    return rng.normal(size=(n, p)) + 4 * np.outer(rng.normal(size=n), rng.normal(size=p)) + 2 * np.outer(rng.normal(size=n), rng.normal(size=p))


@pytest.mark.parametrize("shape", [(9, 30), (30, 9)])
def test_components_from_either_side(spark, rng, shape):
    x = signal(rng, *shape)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    out = M.pca_long(long_frame(spark, x), 2, "sample_id")
    scores = np.stack(out["scores"].toPandas().sort_values("sample_id").scores)
    loads = out["loadings"].toPandas().pivot(index="feature_id", columns="component", values="loading").to_numpy()
    assert np.allclose(np.abs(scores), np.abs(u[:, :2] * s[:2]), atol=1e-9)
    assert np.allclose((x - x.mean(0)) @ loads, scores, atol=1e-9)
    assert np.allclose(out["explained"].toPandas().ratio, (s**2 / (s**2).sum())[:2])
    assert (loads[np.abs(loads).argmax(0), range(2)] > 0).all()


def test_power_iteration_for_two_long_sides(spark, rng, monkeypatch):
    x = np.hstack([signal(rng, 14, 11), rng.normal(size=(14, 1))])
    frame = long_frame(spark, x)

    def tables(k):
        out = M.pca_long(frame, k, "sample_id")
        scores = np.stack(out["scores"].toPandas().sort_values("sample_id").scores)
        loads = out["loadings"].toPandas().pivot(index="feature_id", columns="component", values="loading").to_numpy()
        return scores, loads, out["explained"].toPandas().sort_values("component").variance.to_numpy()

    exact = {k: tables(k) for k in (2, 50)}
    monkeypatch.setattr(M, "GRAM_SIDE", 5)
    for k, want in exact.items():
        got = tables(k)
        assert got[0].shape == want[0].shape == (14, min(k, 12))
        for a, b in zip(got, want):
            assert np.allclose(a, b, atol=1e-6)
    with pytest.raises(ArithmeticError):
        M.pca_long(long_frame(spark, rng.normal(size=(40, 40))), 2, "sample_id", iterations=1)


def test_absent_cells_count_as_the_mean(spark, rng):
    x = signal(rng, 8, 5)
    holed = x.copy()
    holed[2, 3] = np.nan
    filled = np.where(np.isnan(holed), np.nanmean(holed, axis=0), holed)
    got = M.pca_long(long_frame(spark, holed).na.drop(), 1, "sample_id")["explained"].first().ratio
    s = np.linalg.svd(filled - filled.mean(0), compute_uv=False)
    assert got == pytest.approx(s[0] ** 2 / (s**2).sum())


def test_leave_one_out_identity(spark, rng):
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    errors = []
    design = np.column_stack([np.ones(20), x])
    for i in range(20):
        keep = np.arange(20) != i
        errors.append(abs(y[i] - design[i] @ np.linalg.lstsq(design[keep], y[keep], rcond=None)[0]))
    got = M.loo_linear_probe(vectors(spark, x, target=y)).first()
    assert got.loso_mae == pytest.approx(np.mean(errors)) and got.n_subjects == 20
    assert M.loo_linear_probe(vectors(spark, x[:2], target=y[:2])).first().loso_mae is None


def test_probe_with_selection_never_sees_the_held_out_subject(spark, rng):
    rows, target = [], []
    x = rng.normal(size=(8, 2, 6))
    for s in range(8):
        target.append((f"s{s}", float(x[s, 1, 0] - x[s, 0, 0])))
        rows += [(f"s{s}", v, f"f{j}", float(x[s, v, j])) for v in range(2) for j in range(6)]
    features = spark.createDataFrame(rows, "subject_id string, visit int, feature_id string, value double")
    targets = spark.createDataFrame(target, "subject_id string, target double")
    got = M.loo_probe_with_selection(features, targets, 3, 2, always=["f0"]).first()
    y, errors = np.array([t for _, t in target]), []
    for held in range(8):
        # Everything is fitted on the other subjects' rows only; the held-out rows are touched once, to be predicted.
        train = np.delete(x, held, axis=0)
        flat = train.reshape(-1, 6)
        order = np.lexsort((np.arange(1, 6), -flat[:, 1:].var(axis=0, ddof=1)))
        use = sorted({0, *(order[:3] + 1)})
        sd = flat[:, use].std(axis=0)
        axes = np.linalg.svd((flat[:, use] - flat[:, use].mean(axis=0)) / sd, full_matrices=False)[2][:2].T
        delta = ((x[:, 1] - x[:, 0])[:, use] / sd) @ axes
        design = np.column_stack([np.ones(8), delta])
        keep = np.arange(8) != held
        errors.append(abs(y[held] - design[held] @ np.linalg.lstsq(design[keep], y[keep], rcond=None)[0]))
    assert got.n_subjects == 8 and got.loso_mae == pytest.approx(np.mean(errors), rel=1e-6)


@pytest.mark.parametrize("cells", [1 << 22, 60])
def test_probe_with_selection_keeps_rows_that_lack_cells(spark, rng, monkeypatch, cells):
    monkeypatch.setattr(M, "BLOCK_CELLS", cells)
    n, p = 24, 7
    x = rng.normal(size=(n, 2, p)) * np.array([1, 3, 2.98, 2.96, 2.94, 0.5, 2.0])
    x[rng.random((n, 2, p)) < 0.06] = np.nan
    x[3, 1, 0], x[5, 0] = np.nan, np.nan
    rows = [(f"s{s}", v, f"f{j}", float(x[s, v, j])) for s in range(n) for v in range(2) for j in range(p) if not np.isnan(x[s, v, j])]
    y = np.nan_to_num(x[:, 1, 0] - x[:, 0, 0]) + rng.normal(size=n)
    y[7] = np.nan
    features = spark.createDataFrame(rows, "subject_id string, visit int, feature_id string, value double")
    targets = spark.createDataFrame([(f"s{s}", float(t)) for s, t in enumerate(y) if not np.isnan(t)], "subject_id string, target double")
    errors, panels, kept = [], set(), np.zeros((n, 2), dtype=bool)
    for held in range(n):
        others = np.arange(n) != held
        flat = x[others].reshape(-1, p)
        order = np.lexsort((np.arange(1, p), -np.nanvar(flat[:, 1:], axis=0, ddof=1)))
        use = sorted({0, *(order[:3] + 1)})
        panels.add(tuple(use))
        whole = ~np.isnan(x[:, :, use]).any(axis=2)
        kept |= whole
        if np.isnan(y[held]) or not whole[held].all():
            continue
        train = x[others][:, :, use][whole[others]]
        sd = train.std(axis=0)
        axes = np.linalg.svd((train - train.mean(axis=0)) / sd, full_matrices=False)[2][:2].T
        both = whole.all(axis=1) & ~np.isnan(y)
        fit = both & others
        delta = ((x[:, 1] - x[:, 0])[:, use] / sd) @ axes
        design = np.column_stack([np.ones(n), delta])
        errors.append(abs(y[held] - design[held] @ np.linalg.lstsq(design[fit], y[fit], rcond=None)[0]))
    got = M.loo_probe_with_selection(features, targets, 3, 2, always=["f0"]).first()
    # Several panels, and rows that only some of them allow.
    assert len(panels) > 1 and len(errors) > 5 and (kept & np.isnan(x).any(axis=2)).any()
    assert got.n_subjects == len(errors) and got.loso_mae == pytest.approx(np.mean(errors), rel=1e-6)


def test_canonical_correlation(spark, rng):
    a, b = rng.normal(size=(60, 2)), rng.normal(size=(60, 3))
    b[:, 0] += 2 * a[:, 1]
    df = spark.createDataFrame(pd.DataFrame(np.hstack([a, b]), columns=list("pqrst")).assign(subject_id=range(60)))
    qa, qb = np.linalg.qr(a - a.mean(0))[0], np.linalg.qr(b - b.mean(0))[0]
    got = M.cca_max(df, ["p", "q"], ["r", "s", "t"], 50).first()
    assert got.rho == pytest.approx(np.linalg.svd(qa.T @ qb, compute_uv=False)[0])
    assert got.rho_ci_low <= got.rho <= got.rho_ci_high + 0.05
    assert M.cca_max(df, [], ["r"]).first().rho == 0.0


def test_axes(spark, rng):
    x = rng.normal(0, 0.3, (30, 4)) + np.outer(rng.normal(2, 1, 30), np.eye(4)[1])
    deltas = vectors(spark, np.vstack([x, rng.normal(size=(10, 4))]), responder=[True] * 30 + [False] * 10)
    axis = np.array(M.recovery_axis(deltas).first()[0])
    assert np.linalg.norm(axis) == pytest.approx(1) and axis[1] > 0.95
    cons = M.trajectory_consistency(deltas, M.recovery_axis(deltas)).first()
    assert cons.responder_mean_cos > cons.nonresponder_mean_cos
    with pytest.raises(ValueError):
        M.recovery_axis(deltas.limit(1))


def test_two_anchor_axis_guards(spark):
    rows = [("h", [1.0, 0.0])] * 10 + [("d", [-1.0, 0.0])] * 5
    clouds = spark.createDataFrame(rows, "cloud string, z array<double>")
    axis = M.two_anchor_axis(clouds, "h", "d")
    assert axis.first()[0] == [1.0, 0.0]
    scored = M.axis_projection(spark.createDataFrame([([3.0, 9.0],)], "z array<double>"), axis)
    assert scored.first().recovery_score == 3.0
    with pytest.raises(ValueError, match="coincide"):
        M.two_anchor_axis(clouds.withColumn("z", F.array(F.lit(1.0), F.lit(1.0))), "h", "d")
    with pytest.raises(ValueError, match="fewer"):
        M.two_anchor_axis(clouds.limit(12), "h", "d")
    with pytest.raises(ValueError, match="dimensions"):
        M.axis_projection(spark.createDataFrame([([1.0],)], "z array<double>"), axis)


def test_across_runs(spark):
    rows = [(s, r, [1.0, 0.0] if r < 2 else [0.0, 1.0]) for s in range(3) for r in range(3)]
    df = spark.createDataFrame(rows, "subject_id int, run int, z array<double>")
    got = M.across_seed_consistency(df).first()
    assert got.n_pairs == 9 and got.median == 0.0 and not got.passed
    with pytest.raises(ValueError):
        M.across_seed_consistency(df.filter("run = 0"))


def test_icc_bands(spark, rng):
    rows = []
    for s in range(40):
        base = rng.normal()
        for v in range(2):
            rows += [(s, v, 0, float(base + 0.05 * rng.normal())), (s, v, 1, float(rng.normal()))]
    df = spark.createDataFrame(rows, "subject_id int, visit int, factor int, value double")
    got = {r.factor: r for r in M.classify_icc(df, 40).collect()}
    assert got[0].classification == "trait" and got[1].classification == "state"
    assert got[0].lrt_pval < 1e-6 and 0 <= got[1].icc_ci_low <= got[1].icc_ci_high
    y = pd.DataFrame(rows, columns=["s", "v", "f", "y"]).query("f == 1")
    m = y.groupby("s").y.mean()
    msb, msw = 2 * m.var(), y.groupby("s").y.var().mean()
    parts = {r.factor: r for r in M.variance_components(df).collect()}
    assert parts[1].s_between == pytest.approx(max(0.0, (msb - msw) / 2)) and parts[1].s_within == pytest.approx(msw)


def test_rand_index(spark):
    same = spark.createDataFrame([(i % 3, "abc"[i % 3]) for i in range(30)], "a int, b string")
    assert M.adjusted_rand(same, "a", "b").first().ari == pytest.approx(1.0)


def test_archetypes_find_three_clouds(spark, rng):
    x = np.vstack([rng.normal(c, 0.4, (25, 2)) for c in ([0, 0], [5, 0], [0, 5])])
    out = clustering.cluster_archetypes(vectors(spark, x), k_grid=(2, 3), bootstrap=3)
    summary = out["summary"].first()
    assert summary.best_k == 3 and summary.passed and sorted(r["size"] for r in out["sizes"].collect()) == [25, 25, 25]


def test_auc_and_weights(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "score double, label int")
    assert domain.auc(df, []).first().auc == pytest.approx(0.875)
    w = domain.shift_weights(spark.createDataFrame([(0, 0.5), (0, 0.9), (1, 0.5)], "label int, p double"), 0.5).orderBy("p").collect()
    assert [r.weight for r in w] == pytest.approx([1.0, 5.0])


def test_encoder_hook(spark, rng):
    x = rng.normal(size=(5, 3))
    got = np.stack(M.encode_with(vectors(spark, x), lambda m: m @ np.ones((3, 2))).toPandas().z)
    assert np.allclose(got, np.repeat(x.sum(1)[:, None], 2, axis=1))


def test_coherence_waits_for_its_table(spark):
    assert scoring.biological_coherence(None) is None
    table = spark.createDataFrame([(0.05,), (None,)], "q_val double")
    assert scoring.biological_coherence(table).first().n_coherent_axes == 1


def test_mixture_seeding_finds_unequal_clusters(spark, rng):
    """Planted clusters of 400 down to 12 rows, found from any seed; the likelihood is that of a direct fit from the truth."""
    sizes, centres = [400, 150, 40, 12], 8.0 * np.eye(4)
    x = np.vstack([rng.normal(c, 0.6, (n, 4)) for n, c in zip(sizes, centres)])
    label = np.repeat(np.arange(4), sizes)
    points = spark.createDataFrame([(i, row.tolist(), [1.0]) for i, row in enumerate(x)], "subject_id int, z array<double>, w array<double>").cache()
    mean = np.stack([x[label == j].mean(axis=0) for j in range(4)])
    var = np.stack([x[label == j].var(axis=0) for j in range(4)]) + clustering.VARIANCE_FLOOR
    truth = clustering.Mixture(np.log(np.array(sizes) / len(x))[None], mean[None], var[None])
    want = np.log(np.exp(truth.log_joint(x)).sum(axis=2)).sum()
    good = 0
    for seed in range(8):
        mix, loglik, settled = clustering.fit_mixtures(points, [4], seed=seed)
        assert settled and loglik[0] <= want + 1.0
        good += bool(loglik[0] > want - 1.0 and np.allclose(np.sort(np.exp(mix.log_share[0]) * len(x)), np.sort(sizes), atol=0.5))
    assert good == 8
    one = clustering.seed_means(points, [4], 1, 1, "subject_id")
    assert np.array_equal(one, clustering.seed_means(points.repartition(5), [4], 1, 1, "subject_id")) or np.allclose(
        np.sort(one[0], axis=0), np.sort(clustering.seed_means(points.repartition(5), [4], 1, 1, "subject_id")[0], axis=0), atol=1e-6)


def test_mixture_seeding_of_few_distinct_rows(spark):
    """Fewer distinct rows than components: repeated means, no crash, finite likelihood; rows of weight zero start nothing."""
    rows = [(i, [float(i % 2), 0.0], [1.0 if i < 6 else 0.0]) for i in range(8)]
    points = spark.createDataFrame([*rows, (9, [99.0, 99.0], [0.0])], "subject_id int, z array<double>, w array<double>")
    mean = clustering.seed_means(points, [3], 5, 1, "subject_id")
    assert mean.shape == (1, 3, 2) and np.isfinite(mean).all() and mean.max() <= 1.0
    assert np.isfinite(clustering.fit_mixtures(points, [3])[1]).all()


def test_mixture_rounds_use_all_tasks_and_no_shuffle(spark, rng):
    """The sums of one round equal numpy's, however the rows are spread, and come without a shuffle."""
    from dyadic.operators import clustering as C
    from dyadic.session import spread

    x = rng.normal(size=(90, 3))
    points = vectors(spark, x).coalesce(1).withColumn("w", F.array(F.lit(1.0)))
    assert spread(points, "subject_id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    mix = C.Mixture(np.log(np.full((1, 2), 0.5)), x[None, :2].copy(), np.ones((1, 2, 3)))
    whole, wide = C._sums(points, mix, False, 1), C._sums(spread(points, "subject_id"), mix, False, 1)
    joint = mix.log_joint(x)[:, 0]
    resp = np.exp(joint - np.log(np.exp(joint).sum(axis=1, keepdims=True)))
    for got in (whole, wide):
        assert np.allclose(got[0][0], resp.sum(axis=0)) and np.allclose(got[1][0], resp.T @ x)
        assert np.allclose(got[2][0], resp.T @ x**2) and np.allclose(got[3][0], np.log(np.exp(joint).sum(axis=1)).sum())
    seen = []
    run = type(points).mapInPandas
    try:
        type(points).mapInPandas = lambda self, *a, **k: seen.append(run(self, *a, **k)) or seen[-1]
        C._sums(points, mix, True, 1)
    finally:
        type(points).mapInPandas = run
    assert seen[0].dtypes == [("sums", "binary")]
