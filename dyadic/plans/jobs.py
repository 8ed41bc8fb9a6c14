"""Composed jobs. Each takes canonical tables and returns named result tables.

Canonical inputs: `observations(subject_id, visit, feature_id, value)`,
`features(sample_id, feature_id, value)`, `samples(sample_id, ...)`,
`subjects(subject_id, label 0/1)`, `network(source, target, weight)`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.functions import verdicts as V
from dyadic.functions.columns import logit2, safe_ratio
from dyadic.operators import (
    activity, domain, enrichment, multivariate, pairing, ranking, regression, resample, scoring, selection,
)
from dyadic.session import materialize
from dyadic.sources import tables


def load_check(features: DataFrame, samples: DataFrame) -> dict[str, DataFrame]:
    """Group sizes, coverage per sample, and samples without metadata."""
    return {
        "groups": tables.counts_summary(samples, ["visit", "response"]),
        "coverage": tables.coverage_per_sample(features),
        "unmatched": pairing.check_alignment(features, samples),
    }


def fraction_gate(fractions: DataFrame, mono: str, neu: str, lymphocytes: Sequence[str]) -> dict[str, DataFrame]:
    """Are within-subject changes of cell fractions large enough, and do they follow the cell ratio?

    `fractions(subject_id, visit, *cells)`, one row per subject and visit.
    """
    ratio = safe_ratio(F.col(neu), [F.col(c) for c in lymphocytes])
    long = fractions.withColumn("ratio", ratio).select(
        "subject_id", "visit",
        F.inline(F.array(*[F.struct(F.lit(n).alias("feature_id"), F.col(c).alias("value"))
                           for n, c in (("mono", mono), ("neu", neu), ("ratio", "ratio"))])),
    )
    wide = tables.to_wide(pairing.paired_delta(long), ["mono", "neu", "ratio"], "subject_id", "feature_id", "delta")
    summary = multivariate.delta_sd_corr(wide)
    return {"deltas": wide, "summary": summary.withColumn(
        "verdict", V.fraction_gate(F.coalesce("sd_mono", F.lit(0.0)), F.coalesce("sd_neu", F.lit(0.0)), F.col("r")))}


def _separation(long: DataFrame, subjects: DataFrame, k: int, replicates: int, seed: int) -> dict[str, DataFrame]:
    """Components of a scaled joint table, and tests of group separation on their scores."""
    pca = multivariate.pca_long(long, k)
    scores = materialize(pca["scores"].join(subjects.select("subject_id", "label"), "subject_id"))
    per = scores.select("subject_id", "label", F.posexplode("scores").alias("component", "value")).withColumn(
        "component", F.col("component") + 1)
    d = materialize(resample.cohens_d(per, ["component"], ddof=0))
    test = resample.permanova(scores, replicates, seed, vector="scores")
    max_d = d.agg(F.max("d")).scalar()
    t2 = resample.hotelling_t2(scores, vector="scores").select("p_val").scalar()
    summary = test.withColumn("max_cohens_d", max_d).withColumn("hotelling_p", t2)
    return {
        "scores": scores, "loadings": pca["loadings"], "explained": pca["explained"], "cohens_d": d,
        "ttest": resample.ttest(per, ["component"]), "summary": summary,
        "top_loadings": ranking.top_n(pca["loadings"], ["component"], [F.abs("loading").desc(), F.col("feature_id")], 50),
    }


def separation_gate(
    dnam: DataFrame, rna: DataFrame, subjects: DataFrame, top_dnam: int = 5000, top_rna: int = 2000, k: int = 10,
    replicates: int = 2000, seed: int = 42, corrected_by: dict[str, DataFrame] | None = None,
    columns: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Do responders and non-responders move apart? Joint delta components, permutation test, verdict.

    With `corrected_by[modality](subject_id, *columns)` the deltas are first
    residualised on those columns.
    """
    views = {}
    for name, obs, top in (("dnam", dnam, top_dnam), ("rna", rna, top_rna)):
        delta = pairing.paired_delta(obs).select("subject_id", "feature_id", F.col("delta").alias("value"))
        delta = delta.join(subjects.select("subject_id"), "subject_id", "left_semi")
        if corrected_by is not None:
            delta = regression.residualise(delta, corrected_by[name], columns, sample="subject_id").filter("value IS NOT NULL")
        delta = materialize(delta)
        views[name] = selection.keep_features(delta, selection.topk_variance(delta, top))
    joint = pairing.stack_views(views).select(
        "subject_id", F.concat_ws(":", "modality", F.col("feature_id").cast("string")).alias("feature_id"), "value")
    out = _separation(materialize(selection.zscale(joint)), subjects, k, replicates, seed)
    rule = V.separation_gate if corrected_by is None else V.rescue_gate
    out["summary"] = out["summary"].withColumn("verdict", rule(F.col("p_value"), F.col("max_cohens_d")))
    return out


def shift_gate(a: DataFrame, b: DataFrame, top: int = 2000, minimum: int = 3000, trees: int = 500, seed: int = 42,
               bootstrap: int = 2000) -> dict[str, DataFrame]:
    """How far apart are two cohorts? Classifiers on shared delta features and importance weights.

    `a`, `b`: paired observations. Features are ranked per cohort, intersected, and
    subjects with a complete row are used.
    """
    deltas = [materialize(pairing.paired_delta(obs).select("subject_id", "feature_id", F.col("delta").alias("value")))
              for obs in (a, b)]
    panels = [materialize(selection.topk_variance(d, top)) for d in deltas]
    shared = materialize(pairing.feature_intersection(panels[0], panels[1], minimum))
    p = shared.count()
    stacked = pairing.union_tagged({i: selection.zscale(selection.keep_features(d, shared)) for i, d in enumerate(deltas)}, "label")
    rows = tables.to_vectors(stacked.withColumn("sample_id", F.concat_ws("-", "label", "subject_id")))
    rows = rows.filter(F.size("z") == p).withColumn("label", F.substring_index("sample_id", "-", 1).cast("int"))
    out = domain.domain_classifier(rows, seed=seed, trees=trees, bootstrap=bootstrap)
    out["weights"] = domain.shift_weights(out["probability"])
    out["top_features"] = ranking.top_n(
        out["features"].withColumn("all", F.lit(1)), ["all"],
        [(F.abs("coefficient") + F.col("importance")).desc(), F.col("position")], 20).drop("all")
    out["verdict"] = out["summary"].agg(F.max("mean_auc").alias("auc")).withColumn("verdict", V.shift_gate(F.col("auc")))
    return out


def direction_gate(a: DataFrame, b: DataFrame, subjects: DataFrame, anchors: DataFrame, top: int = 2000,
                   replicates: int = 2000, seed: int = 42, minimum: int = 0, plane: bool = True) -> dict[str, DataFrame]:
    """Are non-responders nearer to an external group than responders, in harmonised expression space?

    `a`, `b`: features of the own and the external cohort; `anchors(sample_id)` the
    external group; `subjects(sample_id, label)` the own labels. `plane` adds the first two components of the panel.
    Normal scores of features without ties have the same variance, so the panel takes rounded variances, ties by id.
    """
    shared = pairing.feature_intersection(a, b, minimum)
    both = pairing.union_tagged({"own": a, "external": b}, "cohort").join(shared, "feature_id", "left_semi")
    level = materialize(ranking.rank_to_normal(both).select("cohort", "sample_id", "feature_id", F.col("z").alias("value")))
    panel = selection.keep_features(level, selection.topk_variance(level, top, digits=9))
    own = panel.filter("cohort = 'own'").drop("cohort")
    centre = panel.filter("cohort = 'external'").join(anchors.select("sample_id"), "sample_id", "left_semi").groupBy(
        "feature_id").agg(F.avg("value").alias("value"))
    test = resample.centroid_permutation(own, subjects, centre, replicates, seed)
    centroids = own.join(subjects, "sample_id").groupBy("label", "feature_id").agg(F.avg("value").alias("value"))
    out = {"test": test.withColumn("verdict", V.direction_gate(F.col("p_value"), F.col("direction_ok"))), "centroids": centroids}
    return out | {"plane": multivariate.pca_long(own, 2, "sample_id")["scores"]} if plane else out


def cell_fractions(betas: DataFrame, panel: DataFrame, cell_types: Sequence[str], samples: DataFrame) -> dict[str, DataFrame]:
    """Estimated fractions, their checks, and the sample table with them attached."""
    fractions = activity.deconvolve(betas, panel, list(cell_types))
    return {
        "fractions": fractions, "checks": activity.fraction_checks(fractions, list(cell_types)),
        "samples": pairing.join_prefixed(samples, fractions, "epidish_"),
    }


def interaction_contrasts(
    observations: DataFrame, samples: DataFrame, cell_types: Sequence[str], covariates: Sequence[str] = (),
    fdr: float = 0.05, beta_clip: float = 1e-6, m_clip: float = 8.0, absent: str = "check",
) -> dict[str, DataFrame]:
    """Interaction regression at PRE, at POST and on the delta, and the cross-contrast class of every feature.

    `observations` hold fractions in [0, 1]; `samples(subject_id, visit, response,
    *cell_types, *covariates)`. The delta contrast uses delta fractions and PRE covariates.
    """
    m = observations.withColumn("value", logit2(F.col("value"), beta_clip, m_clip))
    known = samples.filter(F.col("response").isNotNull())
    out = {}
    for visit in ("PRE", "POST"):
        side = m.filter(F.col("visit") == visit).select(F.col("subject_id").alias("sample_id"), "feature_id", "value")
        design = known.filter(F.col("visit") == visit).withColumn("sample_id", F.col("subject_id"))
        out[visit.lower()] = regression.interaction_regression(side, design, cell_types, covariates, absent=absent)
    delta = pairing.paired_delta(m).select(F.col("subject_id").alias("sample_id"), "feature_id", F.col("delta").alias("value"))
    out["delta"] = regression.interaction_regression(delta, _delta_design(known, cell_types, covariates), cell_types, covariates,
                                                     absent=absent)
    tests = {k: v.filter("term = 'interaction'") for k, v in out.items()}
    out["classes"] = pairing.cross_contrast_class(tests["pre"], tests["post"], tests["delta"], fdr)
    return out


def _delta_design(samples: DataFrame, changing: Sequence[str], fixed: Sequence[str]) -> DataFrame:
    """Per paired subject: POST - PRE of the changing columns; response and fixed columns from PRE."""
    def at(visit: str, c: str) -> Column:
        return F.max(F.when(F.col("visit") == visit, F.col(c)))

    return samples.groupBy(F.col("subject_id").alias("sample_id")).agg(
        F.countDistinct("visit").alias("_visits"),
        *[(at("POST", c) - at("PRE", c)).alias(c) for c in changing], *[at("PRE", c).alias(c) for c in ("response", *fixed)],
    ).filter(F.col("_visits") == 2).drop("_visits")


def differential_expression(observations: DataFrame, samples: DataFrame, cell_types: Sequence[str],
                            covariates: Sequence[str] = (), absent: str = "check") -> dict[str, DataFrame]:
    """PC1-adjusted regression at PRE and on the delta, and the delta residuals."""
    known = samples.filter(F.col("response").isNotNull())
    pre = observations.filter("visit = 'PRE'").select(F.col("subject_id").alias("sample_id"), "feature_id", "value")
    delta = materialize(pairing.paired_delta(observations).select(
        F.col("subject_id").alias("sample_id"), "feature_id", F.col("delta").alias("value")))
    design = _delta_design(known, cell_types, covariates)
    return {
        "pre": regression.regression_pc1(pre, known.filter("visit = 'PRE'").withColumn("sample_id", F.col("subject_id")),
                                         cell_types, covariates, absent=absent),
        "delta": regression.regression_pc1(delta, design, cell_types, covariates, absent=absent),
        "residuals": regression.residualise(delta, design, cell_types, absent=absent),
    }


def activity_association(features: DataFrame, pairs: DataFrame, network: DataFrame, samples: DataFrame,
                         covariates: Sequence[str] = (), minimum: int = 5, method: str = "ulm") -> dict[str, DataFrame]:
    """Source activities per sample, their paired deltas and the association of the deltas with response.

    `pairs(subject_id, pre_id, post_id)`, `samples(sample_id = subject, response, *covariates)`.
    """
    run = activity.ulm_activity if method == "ulm" else activity.ssgsea
    scores = materialize(run(features, network, minimum))
    delta = pairing.paired_delta_by_id(scores.select("sample_id", F.col("source").alias("feature_id"), F.col("score").alias("value")), pairs)
    table = delta.select(F.col("subject_id").alias("sample_id"), "feature_id", F.col("delta").alias("value"))
    return {"scores": scores, "delta": delta, "association": regression.simple_regression(table, samples, covariates)}


def regulator_report(run: dict[str, DataFrame], families: dict, fdr: float = 0.10, min_sources: int = 1000) -> DataFrame:
    """Acceptance of a regulator run: sources per sample and significant family members, as one row."""
    from dyadic.functions.columns import family_label

    coverage = run["scores"].groupBy("sample_id").agg(F.count("score").alias("n")).agg(F.min("n")).scalar()
    tagged = run["association"].withColumn("family", family_label(F.col("feature_id"), families)).filter("family != ''")
    return tagged.agg(F.count_if(F.col("q_val") < fdr).alias("n_family_hits")).withColumn(
        "min_sources", F.coalesce(coverage, F.lit(0))).withColumn(
        "accepted", V.activity_pass(F.col("min_sources"), F.col("n_family_hits"), min_sources))


def replication(observations: DataFrame, samples: DataFrame, reference: DataFrame, stratum: str, indicator: str,
                covariates: Sequence[str] = (), threshold: float = 0.10, absent: str = "check") -> dict[str, DataFrame]:
    """Second-cohort delta fits against the reference effects, by stratum, with the summary row."""
    delta = materialize(pairing.paired_delta(observations).select(
        F.col("subject_id").alias("sample_id"), "feature_id", F.col("delta").alias("value")))
    out = regression.stratified_replication(delta, samples, regression.mean_effect(reference), stratum, indicator, covariates, absent=absent)
    out["summary"] = regression.replication_summary(out["overall"], threshold)
    return out


def set_enrichment(results: DataFrame, annotation: DataFrame, gene_sets: DataFrame, fdr: float = 0.05, cut: float = 0.05,
                   min_genes: int = 5, keywords: dict = enrichment.KEYWORDS) -> dict[str, DataFrame]:
    """Genes of each cell type's hits, enriched sets, themes among them and the coherence verdict."""
    hits = results.filter(F.col("q_val") < fdr).select("cell_type", "feature_id")
    genes = materialize(enrichment.annotate_explode(hits, annotation))
    terms = materialize(enrichment.over_representation(genes, gene_sets, min_genes=min_genes))
    themes = enrichment.keyword_hits(terms, ["cell_type"], cut=cut, keywords=keywords)
    return {
        "genes": genes, "terms": terms, "top_terms": ranking.top_n(terms, ["cell_type"], [F.col("q_val"), F.col("term")], 10),
        "themes": themes, "coherence": enrichment.coherence(themes, ["cell_type"]),
    }


def second_cohort(first: DataFrame, observations: DataFrame, samples: DataFrame, cell_types: Sequence[str],
                  covariates: Sequence[str] = (), fdr: float = 0.05, absent: str = "check") -> dict[str, DataFrame]:
    """Delta regression on baseline fractions in a second cohort and its agreement with the first one's hits.

    `samples(sample_id = subject, response, *cell_types, *covariates)` at baseline.
    """
    delta = pairing.paired_delta(observations).select(F.col("subject_id").alias("sample_id"), "feature_id", F.col("delta").alias("value"))
    fitted = materialize(regression.interaction_regression(delta, samples, cell_types, covariates, absent=absent).filter("term = 'interaction'"))
    looked = materialize(pairing.hit_lookup(first.filter(F.col("q_val") < fdr), fitted))
    return {"results": fitted, "matched": looked, "summary": regression.concordance_summary(looked)}


def feature_tables(dnam: DataFrame, rna: DataFrame, results: DataFrame | None, gene_map: DataFrame | None, path: str,
                   blacklist: DataFrame | None = None, fdr: float = 0.10) -> DataFrame:
    """Write the active tier's feature tables with their provenance; returns the selected ids.

    Tier 1 is a fixed prior and safe for cross-validation; tier 2 candidates are only
    range-filtered here and are stamped unsafe, to be ranked inside the folds.
    """
    chosen = materialize(selection.resolve_tier(results, dnam, rna, gene_map, blacklist, fdr))
    tier = chosen.select("tier").first()[0]
    spark = dnam.sparkSession
    for name, table in (("dnam", dnam), ("rna", rna)):
        ids = chosen.filter(F.col("modality") == name).select("feature_id")
        if tier == 2 and name == "dnam":
            ids = selection.range_filter(dnam, blacklist).select("feature_id")
        elif tier == 2:
            ids = rna.select("feature_id").distinct()
        tables.write_table(selection.keep_features(table, ids), f"{path}/{name}")
        tables.stamp_provenance(spark, f"{path}/{name}", tier == 1, "tier 1 prior" if tier == 1 else "candidates")
    return chosen


def factor_run(views: DataFrame, obs: DataFrame, k: int = 20, covariates: Sequence[str] = (), bootstrap: int = 200,
               seed: int = 42) -> dict[str, DataFrame]:
    """Residualised two-view factors, their classes and per-subject state changes.

    `views(view, obs_id, feature_id, value)`, `obs(obs_id, subject_id, visit, target, *covariates)`.
    """
    clean = views
    if covariates:
        clean = regression.residualise(views, obs, covariates, by=("view", "feature_id"), sample="obs_id").filter("value IS NOT NULL")
    factors = multivariate.multiview_factors(materialize(clean), k)
    scores = materialize(scoring.factor_scores_long(factors["scores"], obs.select("obs_id", "subject_id", "visit")))
    classes = materialize(multivariate.classify_icc(scores, bootstrap, seed))
    state = classes.filter("classification = 'state'").select("factor")
    kept = scores if state.isEmpty() else scores.join(F.broadcast(state), "factor", "left_semi")
    deltas = multivariate.subject_factor_means(kept).filter("delta IS NOT NULL")
    vectors = tables.to_vectors(deltas.select("subject_id", "factor", F.col("delta").alias("value")), "subject_id", "factor")
    target = obs.groupBy("subject_id").agg(
        (F.max(F.when(F.col("visit") == 1, F.col("target"))) - F.max(F.when(F.col("visit") == 0, F.col("target")))).alias("target"),
        F.max_by("responder", F.when(F.col("visit") == 0, 1).otherwise(0)).alias("responder"))
    return {"factors": factors["scores"], "loadings": factors["loadings"], "explained": factors["explained"], "scores": scores,
            "classes": classes, "deltas": vectors.join(target, "subject_id")}


def projection(clouds: DataFrame, termini: DataFrame, loadings: DataFrame, toward: str, away: str, subjects: DataFrame,
               path: str | None = None, min_subjects: int = 10, min_toward: int = 10, min_away: int = 5) -> dict[str, DataFrame]:
    """Project reference clouds and subject end points onto the loadings and score them on the two-anchor axis.

    `clouds(cloud, sample_id, feature_id, value)`, `termini(subject_id, feature_id, value)`,
    `subjects(subject_id, response, cohort)`. Written to `path` if given. A cloud of one centroid row needs its minimum
    lowered to 1.
    """
    def latent(table: DataFrame, key: list[str]) -> DataFrame:
        flat = table.withColumn("_row", F.struct(*key))
        coords = multivariate.project(flat, loadings, "_row")
        return tables.to_vectors(coords, "_row", "component", "coordinate").select("_row.*", "z")

    cloud_z = materialize(latent(clouds, ["cloud", "sample_id"]))
    end_z = materialize(latent(termini, ["subject_id"]))
    if end_z.limit(min_subjects).count() < min_subjects:
        raise ValueError(f"fewer than {min_subjects} subjects to project")
    axis = materialize(multivariate.two_anchor_axis(cloud_z, toward, away, min_toward, min_away))
    scored = multivariate.axis_projection(end_z, axis).join(subjects, "subject_id")
    out = {"terminus": scored.select("subject_id", "response", "cohort", "recovery_score", "z"), "clouds": cloud_z, "axis": axis}
    if path is not None:
        for name, table in out.items():
            tables.write_table(table, f"{path}/{name}")
    return out


def load_projection(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that `projection` wrote to `path`; a missing one raises."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("terminus", "clouds", "axis")}
