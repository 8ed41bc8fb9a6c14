"""Leaderboard metrics of one embedding, and the sensitivity refit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.verdicts import trait_state_pass
from dyadic.operators import clustering, multivariate as M
from dyadic.operators.ranking import cell_text
from dyadic.session import materialize

# The order of the metrics in the leaderboard.
METRICS = (
    "i_trajectory_consistency",
    "ii_trait_state_disentanglement",
    "iii_loso_reconstruction",
    "iv_conformal_coverage",
    "v_biological_coherence",
    "vi_archetype_clusterability",
)
# The cell of a metric whose input table is not given.
NOT_GIVEN = "no input table"


def trait_state(scores: DataFrame, bootstrap: int = 2000, seed: int = 42) -> DataFrame:
    """Counts of trait, state and mixed factors and the dependence between the two subspaces, as one row.

    `bootstrap` replicates are drawn for the classes and for the dependence alike. Each factor becomes a column, so the
    classes of all factors, one word each, come to the driver.
    """
    classes = materialize(M.classify_icc(scores, bootstrap, seed))
    kinds = {r["factor"]: r["classification"] for r in classes.select("factor", "classification").collect()}
    trait = sorted(f for f, c in kinds.items() if c == "trait")
    state = sorted(f for f, c in kinds.items() if c == "state")
    per = M.subject_factor_means(scores, missing=0.0)
    wide = per.groupBy("subject_id").agg(
        *[F.max(F.when(F.col("factor") == f, F.col("mean"))).alias(f"m{f}") for f in trait],
        *[F.max(F.when(F.col("factor") == f, F.col("delta"))).alias(f"d{f}") for f in state],
        F.count(F.lit(1)).alias("_factors"),
    )
    rho = M.cca_max(wide, [f"m{f}" for f in trait], [f"d{f}" for f in state], bootstrap, seed)
    n_trait, n_state = F.lit(len(trait)), F.lit(len(state))
    return rho.select(
        n_trait.alias("n_trait"), n_state.alias("n_state"), F.lit(len(kinds) - len(trait) - len(state)).alias("n_mixed"),
        "rho", "rho_ci_low", "rho_ci_high",
        trait_state_pass(n_trait, n_state, F.col("rho"), F.col("rho_ci_high")).alias("passed"),
    )


def biological_coherence(enrichment: DataFrame | None, fdr: float = 0.10) -> DataFrame | None:
    """Significant enrichment rows; None while there is no enrichment table."""
    if enrichment is None:
        return None
    return enrichment.agg(F.count_if(F.coalesce("q_val", F.lit(1.0)) < fdr).alias("n_coherent_axes")).withColumn(
        "passed", F.col("n_coherent_axes") >= 1)


def score_arm(
    arm: str, deltas: DataFrame, runs: DataFrame, scores: DataFrame, coverage: DataFrame | None = None,
    enrichment: DataFrame | None = None, bootstrap: int = 2000, seed: int = 42, k_grid=(2, 3, 4, 5),
    archetype_bootstrap: int = 10, metrics: Sequence[str] | None = None,
) -> DataFrame:
    """(metric, arm, cell) rows of the six metrics.

    `deltas(subject_id, responder, target, z)`, `runs(subject_id, run, z)`,
    `scores(subject_id, visit, factor, value)`, `coverage` a `mondrian_conformal` result, `enrichment` a table with
    `q_val`. Metrics whose table is not given say so. `metrics` restricts the work to some of the six.
    """
    wanted = set(METRICS if metrics is None else metrics)
    flag = lambda c: F.when(F.col(c), " | PASS").otherwise(" | FAIL")

    def consistency() -> DataFrame:
        across = M.across_seed_consistency(runs)
        within = M.trajectory_consistency(deltas, M.recovery_axis(deltas)).select("responder_mean_cos", "difference")
        return across.crossJoin(within).select(F.concat(F.format_string(
            "runs agree %.3f, responders %.3f, gap %.3f", "median", "responder_mean_cos", "difference"), flag("passed")).alias("cell"))

    def disentanglement() -> DataFrame:
        return trait_state(scores, bootstrap, seed).select(F.concat(F.format_string(
            "%d lasting, %d changing, dependence %.3f", "n_trait", "n_state", "rho"), flag("passed")).alias("cell"))

    def reconstruction() -> DataFrame:
        return M.loo_linear_probe(deltas).select(
            F.coalesce(cell_text(F.lit("left-out error"), F.col("loso_mae")), F.lit("too few subjects")).alias("cell"))

    def conformal() -> DataFrame | None:
        if coverage is None:
            return None
        return coverage.filter(F.col("stratum").isNull()).select(cell_text(F.lit("covered"), F.col("coverage")).alias("cell"))

    def coherence() -> DataFrame | None:
        found = biological_coherence(enrichment)
        return None if found is None else found.select(
            F.concat(F.format_string("%d enriched sets", "n_coherent_axes"), flag("passed")).alias("cell"))

    def archetypes() -> DataFrame:
        fitted = clustering.cluster_archetypes(deltas, k_grid=k_grid, bootstrap=archetype_bootstrap, seed=seed)["summary"]
        return fitted.select(F.concat(F.format_string("%d clusters, stability %.3f", "best_k", "bootstrap_ari_mean"), flag("passed")).alias("cell"))

    one, out = deltas.sparkSession.range(1), None
    for metric, made in zip(METRICS, (consistency, disentanglement, reconstruction, conformal, coherence, archetypes)):
        if metric not in wanted:
            continue
        cell = made()
        cell = one.select(F.lit(NOT_GIVEN).alias("cell")) if cell is None else cell
        row = cell.select(F.lit(metric).alias("metric"), F.lit(arm).alias("arm"), "cell")
        out = row if out is None else out.unionByName(row)
    return out


def factor_scores_long(scores: DataFrame, obs: DataFrame) -> DataFrame:
    """`scores(obs_id, scores array)` joined with `obs(obs_id, subject_id, visit)` to (subject_id, visit, factor, value)."""
    return scores.join(obs, "obs_id").select("subject_id", "visit", F.posexplode("scores").alias("factor", "value"))


def sensitivity_refit(views: DataFrame, obs: DataFrame, flagged: DataFrame, k: int, bootstrap: int = 200,
                      seed: int = 42) -> DataFrame:
    """Factor classes of the full fit and of the fit without flagged observations, side by side."""
    keep = flagged.filter("flagged").select(F.col("sample_id").alias("obs_id"))
    out = []
    for table in (views, views.join(keep, "obs_id", "left_anti")):
        factors = M.multiview_factors(table, k)
        out.append(M.classify_icc(factor_scores_long(factors["scores"], obs), bootstrap, seed).select(
            "factor", "icc", "classification"))
    right = out[1].withColumnsRenamed({"icc": "icc_without", "classification": "classification_without"})
    return out[0].join(right, "factor", "full_outer")
