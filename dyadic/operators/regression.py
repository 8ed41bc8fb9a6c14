"""Feature-wise linear models over long tables.

A cohort's design (samples x covariates) is shared by all features, so it is
factorised once. Every design column combination needed is an orthonormal
function of the samples; a fit is then a handful of sums per feature, computed
by one partially aggregated `groupBy`. No feature's values are ever gathered in
one task. Features with missing values have their own design; for these the
same `groupBy` returns central co-moments and a small solver runs on them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.tails import clean_nan, t_two_sided_udf
from dyadic.operators.ranking import bh_fdr, pi1, spearman
from dyadic.session import BROADCAST_ROWS, materialize, small_side

INTERCEPT = "intercept"
RANK_TOLERANCE = 1e-10


@dataclass(frozen=True)
class Model:
    """Design columns beside the intercept, and the terms whose coefficients are reported.

    List shared columns first: models sharing a leading run of columns share its sums.
    """

    name: str
    columns: tuple[str, ...]
    terms: tuple[str, ...]


@dataclass
class _Basis:
    """Orthonormal sample functions: rows of (constant, coefficients over the design columns)."""

    keys: dict = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    def add(self, key, row: np.ndarray) -> int:
        if key not in self.keys:
            self.keys[key] = len(self.rows)
            self.rows.append(row)
        return self.keys[key]


@dataclass
class _Fit:
    model: Model
    slots: list[int]  # positions of this model's basis functions
    loads: np.ndarray  # (1 + q) x len(slots): coefficients (intercept first) from the sums
    from_mean: np.ndarray  # (1 + q): coefficients from the mean response
    rank: int


def _design_moments(design: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray, list[str]]:
    """Row count, means, population covariance and the columns with missing values, from one aggregate row."""
    q = len(columns)
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    row = design.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"h{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    cov = np.zeros((q, q))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    holes = [c for i, c in enumerate(columns) if row[f"h{i}"]]
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(q)]), cov, holes


def _row_space(null: np.ndarray, scale: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Projection that turns any least-squares solution into the one of least norm.

    `null` holds directions of the centred, scaled columns that vanish on the samples.
    """
    slopes = null / scale[:, None]
    directions = np.vstack([-(mean @ slopes), slopes])
    return np.eye(len(mean) + 1) - directions @ np.linalg.pinv(directions)


def _factorise(model: Model, columns: list[str], n: int, mean: np.ndarray, cov: np.ndarray, basis: _Basis) -> _Fit:
    at = np.array([columns.index(c) for c in model.columns], dtype=int)
    q, m = len(at), mean[at]
    sd = np.sqrt(np.maximum(np.diag(cov)[at], 0.0))
    scale = np.where(sd > 0, sd, 1.0)
    corr = cov[np.ix_(at, at)] / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(corr) if q else (np.ones(0), np.zeros((0, 0)))
    kept = values > RANK_TOLERANCE
    if kept.all():
        # Gram-Schmidt in column order, so that models with equal leading columns share their functions.
        inverse = np.linalg.inv(np.linalg.cholesky(corr)) if q else np.zeros((0, 0))
        weights, keys = inverse.T, [model.columns[: j + 1] for j in range(q)]
        shape = np.eye(q + 1)
    else:
        weights = vectors[:, kept] / np.sqrt(values[kept])
        keys = [(model.name, model.columns, j) for j in range(weights.shape[1])]
        shape = _row_space(vectors[:, ~kept], scale, m)
    slopes = weights / scale[:, None] / math.sqrt(n)
    slots = []
    for j, key in enumerate(keys):
        row = np.zeros(1 + len(columns))
        row[1 + at], row[0] = slopes[:, j], -(m @ slopes[:, j])
        slots.append(basis.add(key, row))
    return _Fit(model, slots, shape @ np.vstack([-(m @ slopes), slopes]), shape[:, 0], 1 + int(kept.sum()))


def _combine(weights: np.ndarray, parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for w, part in zip(weights, parts):
        if w != 0.0:
            out = out + F.lit(float(w)) * part
    return out


def _with_basis(design: DataFrame, columns: list[str], basis: _Basis, sample: str, keep: list[str]) -> DataFrame:
    cols = [F.lit(1.0)] + [F.col(c) for c in columns]
    return design.select(sample, *keep, *[_combine(row, cols).alias(f"_u{j}") for j, row in enumerate(basis.rows)])


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _term_rows(fits: list[_Fit], sums: list[Column], n: Column, mean: Column, m2: Column) -> Column:
    """Array of result structs for all models and terms of one feature."""
    out = []
    for fit in fits:
        g = [sums[s] for s in fit.slots]
        explained = F.lit(0.0)
        for part in g:
            explained = explained + part * part
        df = n - F.lit(fit.rank)
        enough = n >= len(fit.model.columns) + 3
        variance = F.greatest(F.lit(0.0), m2 - explained) / F.nullif(df, F.lit(0).cast("bigint"))
        for term in fit.model.terms:
            at = 0 if term == INTERCEPT else 1 + fit.model.columns.index(term)
            coef, unit = _combine(fit.loads[at], g), F.lit(float(fit.loads[at] @ fit.loads[at]))
            if abs(fit.from_mean[at]) > 1e-14:
                weight = float(fit.from_mean[at])
                coef, unit = coef + F.lit(weight) * mean, unit + F.lit(weight * weight) / n
            out.append(
                F.struct(
                    F.lit(fit.model.name).alias("model"), F.lit(term).alias("term"), n.cast("bigint").alias("n"),
                    F.when(enough, df).cast("bigint").alias("df"),
                    F.when(enough, coef).alias("coef"), F.when(enough, F.sqrt(variance * unit)).alias("se"),
                )
            )
    return F.array(*out)


def _finish(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    t = F.col("coef") / F.nullif(F.col("se"), F.lit(0.0))
    return rows.withColumn("t_stat", t).withColumn("p_val", clean_nan(t_two_sided_udf("t_stat", "df"))).select(
        *by, "model", "term", "n", "df", "coef", "se", "t_stat", "p_val"
    )


def fit_models(
    features: DataFrame,
    design: DataFrame,
    models: Sequence[Model],
    by: Sequence[str] = ("feature_id",),
    sample: str = "sample_id",
    value: str = "value",
    absent: str = "check",
    test: bool = True,
    min_samples: int = 0,
) -> DataFrame:
    """Ordinary least squares of `value` on each model for every feature.

    `design(sample, *columns)` has one row per sample; rows with a missing
    covariate are left out of the models using it. Output: one row per feature,
    model and term with n, df, coef, se, t_stat and two-sided p_val, all NULL
    where n < parameters + 2.

    `absent` says what a missing (feature, sample) cell means: "zero" (sparse
    tables), "none" (the caller knows there is none), or "check" (features with
    missing cells are found and get their own design).
    """
    columns = list(dict.fromkeys(c for m in models for c in m.columns))
    design = design.select(sample, *[F.col(c).cast("double").alias(c) for c in columns])
    n, mean, cov, holes = _design_moments(design, columns)
    if holes and len({frozenset(m.columns).intersection(holes) for m in models}) > 1:
        parts = [fit_models(features, design, [m], by, sample, value, absent, test, min_samples) for m in models]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    clean = design
    if holes:
        for c in holes:
            clean = clean.filter(F.col(c).isNotNull() & ~F.isnan(c))
        n, mean, cov, _ = _design_moments(clean, columns)
    if n < min_samples:
        raise ValueError(f"{n} samples have a complete design; at least {min_samples} are needed")
    basis = _Basis()
    fits = [_factorise(m, columns, n, mean, cov, basis) for m in models]
    rows = features.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, sample, F.col(value).alias("_y"))
    joined = rows.join(_sized(_with_basis(clean, columns, basis, sample, []), n), sample)
    stats = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_mean"), F.var_pop("_y").alias("_var"),
        *[F.sum(F.col(f"_u{j}") * F.col("_y")).alias(f"_g{j}") for j in range(len(basis.rows))],
    )
    if absent == "zero":
        share = F.col("_n") / F.lit(float(n))
        stats = stats.select(
            *by, *[f"_g{j}" for j in range(len(basis.rows))], F.lit(n).cast("bigint").alias("_n"),
            (F.col("_mean") * share).alias("_mean"),
            (F.col("_n") * F.col("_var") + F.col("_n") * F.col("_mean") * F.col("_mean") * (1.0 - share)).alias("_m2"),
        )
    else:
        stats = stats.withColumn("_m2", F.col("_n") * F.col("_var"))
        if absent == "check":
            stats = materialize(stats)
    whole = stats if absent != "check" else stats.filter(F.col("_n") == n)
    sums = [F.col(f"_g{j}") for j in range(len(basis.rows))]
    fitted = whole.select(*by, F.inline(_term_rows(fits, sums, F.col("_n"), F.col("_mean"), F.col("_m2"))))
    if absent == "check":
        ragged = stats.filter(F.col("_n") < n).select(*by)
        if not ragged.isEmpty():
            scale = np.where(np.diag(cov) > 0, np.sqrt(np.diag(cov)), 1.0)
            own = rows.join(ragged, list(by), "left_semi").join(_sized(clean, n), sample)
            fitted = fitted.unionByName(_fit_own_design(own, models, columns, by, mean, scale))
    return _finish(fitted, by) if test else fitted


def fit_by_stratum(
    features: DataFrame, design: DataFrame, model: Model, stratum: str, by: Sequence[str] = ("feature_id",),
    sample: str = "sample_id", value: str = "value", min_rows: int = 5,
) -> DataFrame:
    """One fit per (stratum, feature); the stratum is a column of the design. Small strata are skipped."""
    columns = list(model.columns)
    design = design.select(sample, stratum, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    kept = design.groupBy(stratum).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= min_rows)
    design = design.join(kept.select(stratum), stratum, "left_semi")
    n, mean, cov, _ = _design_moments(design, columns)
    scale = np.where(np.diag(cov) > 0, np.sqrt(np.diag(cov)), 1.0)
    rows = features.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, sample, F.col(value).alias("_y"))
    keys = [stratum, *by]
    return _finish(_fit_own_design(rows.join(_sized(design, n), sample), [model], columns, keys, mean, scale), keys)


def _fit_own_design(
    joined: DataFrame, models: Sequence[Model], columns: list[str], by: Sequence[str], mean: np.ndarray, scale: np.ndarray
) -> DataFrame:
    """Fits from per-group central co-moments; used where a group has its own set of samples."""
    q = len(columns)
    z = [((F.col(c) - float(mean[i])) / float(scale[i])) for i, c in enumerate(columns)]
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    stats = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(
            F.avg("_y"), F.var_pop("_y"), *[F.avg(v) for v in z], *[F.covar_pop(v, F.col("_y")) for v in z],
            *[F.covar_pop(z[i], z[j]) for i, j in pairs],
        ).alias("_mom"),
    )
    layout = [(m.name, [columns.index(c) for c in m.columns], [
        0 if t == INTERCEPT else 1 + m.columns.index(t) for t in m.terms]) for m in models]
    wanted = [(m.name, t) for m in models for t in m.terms]

    def solve(count: pd.Series, packed: pd.Series) -> pd.Series:
        n = count.to_numpy(dtype=float)
        mom = np.stack(packed.to_numpy()) if len(packed) else np.zeros((0, 2 + 2 * q + len(pairs)))
        ybar, yvar, zbar, zy = mom[:, 0], mom[:, 1], mom[:, 2 : 2 + q], mom[:, 2 + q : 2 + 2 * q]
        gram = np.zeros((len(mom), q, q))
        for k, (i, j) in enumerate(pairs):
            gram[:, i, j] = gram[:, j, i] = mom[:, 2 + 2 * q + k]
        out = []
        for _, at, terms in layout:
            k = len(at)
            g, c = gram[:, at][:, :, at], zy[:, at]
            sd = np.sqrt(np.maximum(np.diagonal(g, axis1=1, axis2=2), 0.0))
            safe = np.where(sd > 1e-12, sd, 1.0)
            values, vectors = np.linalg.eigh(g / (safe[:, :, None] * safe[:, None, :]))
            kept = values > RANK_TOLERANCE
            inv = np.where(kept, 1.0 / np.where(kept, values, 1.0), 0.0)
            pinv = np.einsum("bik,bk,bjk->bij", vectors, inv, vectors) / (safe[:, :, None] * safe[:, None, :])
            beta = np.einsum("bij,bj->bi", pinv, c)
            df = n - 1 - kept.sum(axis=1)
            rss = np.maximum(n * (yvar - np.einsum("bi,bi->b", beta, c)), 0.0)
            # Back to the columns as given, intercept first.
            centre = mean[at] + zbar[:, at] * scale[at]
            slope, cov = beta / scale[at], pinv / np.outer(scale[at], scale[at])
            full = np.concatenate([(ybar - np.einsum("bi,bi->b", slope, centre))[:, None], slope], axis=1)
            spread = np.zeros((len(mom), k + 1, k + 1))
            tilt = np.einsum("bij,bj->bi", cov, centre)
            spread[:, 1:, 1:], spread[:, 0, 1:], spread[:, 1:, 0] = cov, -tilt, -tilt
            spread[:, 0, 0] = 1.0 + np.einsum("bi,bi->b", centre, tilt)
            for b in np.flatnonzero(~kept.all(axis=1)):
                shape = _row_space(vectors[b][:, ~kept[b]], safe[b] * scale[at], centre[b])
                full[b], spread[b] = shape @ full[b], shape @ spread[b] @ shape.T
            ok = (n >= k + 3) & (df > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                se = np.sqrt((rss / df / n)[:, None] * np.diagonal(spread, axis1=1, axis2=2))
            for t in terms:
                out += [np.where(ok, df, np.nan), np.where(ok, full[:, t], np.nan), np.where(ok, se[:, t], np.nan)]
        return pd.Series(list(np.stack(out, axis=1)))

    solved = stats.withColumn("_fit", F.pandas_udf(solve, "array<double>")("_n", "_mom"))
    structs = [
        F.struct(
            F.lit(name).alias("model"), F.lit(term).alias("term"), F.col("_n").cast("bigint").alias("n"),
            clean_nan(F.col("_fit")[3 * k]).cast("bigint").alias("df"),
            clean_nan(F.col("_fit")[3 * k + 1]).alias("coef"), clean_nan(F.col("_fit")[3 * k + 2]).alias("se"),
        )
        for k, (name, term) in enumerate(wanted)
    ]
    return solved.select(*by, F.inline(F.array(*structs)))


# --- the reference models -------------------------------------------------------------


def interaction_design(samples: DataFrame, cell_types: Sequence[str], response: str = "response") -> DataFrame:
    """Add response x fraction columns `response:<cell type>`."""
    return samples.withColumns({f"{response}:{c}": F.col(response) * F.col(c) for c in cell_types})


def interaction_regression(
    features: DataFrame, samples: DataFrame, cell_types: Sequence[str], covariates: Sequence[str] = (),
    response: str = "response", absent: str = "check", min_samples: int = 10,
) -> DataFrame:
    """Per feature and cell type: y ~ response + fraction + response x fraction + covariates.

    Samples without a 0/1 response are dropped. Reports response and interaction
    terms with q-values per cell type and term.
    """
    known = samples.filter(F.col(response).isNotNull())
    models = [
        Model(c, (response, *covariates, c, f"{response}:{c}"), (response, f"{response}:{c}")) for c in cell_types
    ]
    fitted = fit_models(features, interaction_design(known, cell_types, response), models, absent=absent,
                        min_samples=min_samples)
    named = fitted.withColumnRenamed("model", "cell_type").withColumn(
        "term", F.when(F.col("term") == response, "response").otherwise("interaction")
    )
    return bh_fdr(named, ["cell_type", "term"])


def joint_interaction_regression(
    features: DataFrame, samples: DataFrame, cell_types: Sequence[str], covariates: Sequence[str] = (),
    response: str = "response", absent: str = "check",
) -> DataFrame:
    """All fractions and all interactions in one model per feature; q-values per cell type.

    As the fractions carry the response effect, response itself is no column.
    """
    known = samples.filter(F.col(response).isNotNull())
    terms = tuple(f"{response}:{c}" for c in cell_types)
    # Fractions adding to one span the intercept; the fit of least norm is reported then.
    model = Model("joint", (*covariates, *cell_types, *terms), terms)
    fitted = fit_models(features, interaction_design(known, cell_types, response), [model], absent=absent)
    named = fitted.withColumn("cell_type", F.substring_index("term", ":", -1)).drop("model", "term")
    return bh_fdr(named, ["cell_type"])


def fraction_pc1(samples: DataFrame, cell_types: Sequence[str], out: str = "pc1") -> DataFrame:
    """First principal component of the scaled fractions, missing as 0; zeros if all are constant.

    Only the K x K covariance reaches the driver. The sign makes the largest loading positive.
    """
    filled = samples.na.fill(0.0, subset=list(cell_types))
    _, mean, cov, _ = _design_moments(filled, list(cell_types))
    sd = np.sqrt(np.diag(cov))
    if len(cell_types) < 2 or np.all(sd < 1e-12):
        return samples.withColumn(out, F.lit(0.0))
    scale = np.where(sd < 1e-12, 1.0, sd)
    vector = np.linalg.eigh(cov / np.outer(scale, scale))[1][:, -1]
    vector = vector * np.sign(vector[np.argmax(np.abs(vector))])
    weights = vector / scale
    score = F.lit(-float(weights @ mean))
    for w, c in zip(weights, cell_types):
        score = score + F.lit(float(w)) * F.coalesce(F.col(c), F.lit(0.0))
    return samples.withColumn(out, score)


def regression_pc1(
    features: DataFrame, samples: DataFrame, cell_types: Sequence[str], covariates: Sequence[str] = (),
    response: str = "response", absent: str = "check",
) -> DataFrame:
    """y ~ response + PC1(fractions) + response x PC1 + covariates, with q-values per term."""
    known = fraction_pc1(samples.filter(F.col(response).isNotNull()), cell_types)
    model = Model("pc1", (response, *covariates, "pc1", f"{response}:pc1"), (response, f"{response}:pc1"))
    fitted = fit_models(features, interaction_design(known, ["pc1"], response), [model], absent=absent)
    named = fitted.withColumn("term", F.when(F.col("term") == response, "response").otherwise("interaction"))
    return bh_fdr(named.drop("model"), ["term"])


def simple_regression(
    features: DataFrame, samples: DataFrame, covariates: Sequence[str] = (), response: str = "response",
    absent: str = "check",
) -> DataFrame:
    """y ~ response + covariates per feature, with q-values over the set."""
    known = samples.filter(F.col(response).isNotNull())
    model = Model("simple", (response, *covariates), (response,))
    return bh_fdr(fit_models(features, known, [model], absent=absent).drop("model", "term"), [])


def mean_effect(results: DataFrame) -> DataFrame:
    """Mean interaction effect of a feature over cell types."""
    return results.groupBy("feature_id").agg(F.avg("coef").alias("reference_coef"))


def stratified_replication(
    features: DataFrame, samples: DataFrame, reference: DataFrame, stratum: str, indicator: str,
    covariates: Sequence[str] = (), response: str = "response", absent: str = "check",
) -> dict[str, DataFrame]:
    """Second-cohort fits: overall, within strata, and response x (stratum = indicator).

    `reference(feature_id, reference_coef)`; sign agreement is false where either effect is missing.
    """
    from dyadic.functions.columns import same_sign

    known = samples.filter(F.col(response).isNotNull())
    model = Model("simple", (response, *covariates), (response,))
    agree = same_sign(F.col("coef"), F.col("reference_coef"))

    def judged(df: DataFrame) -> DataFrame:
        return df.join(reference, "feature_id", "left").withColumn("same_direction", agree)

    token = F.upper(F.trim(F.col(stratum).cast("string")))
    marked = known.withColumn("marked", F.coalesce((token == indicator.upper()).cast("double"), F.lit(0.0)))
    crossed = Model("crossed", (response, *covariates, "marked", f"{response}:marked"), (f"{response}:marked",))
    both = materialize(fit_models(features, interaction_design(marked, ["marked"], response), [model, crossed], absent=absent))
    overall = judged(bh_fdr(both.filter("model = 'simple'").drop("model", "term"), []))
    interaction = bh_fdr(both.filter("model = 'crossed'").drop("model", "term"), [])
    within = judged(fit_by_stratum(features, known.withColumn(stratum, token), model, stratum).drop("model", "term"))
    return {"overall": overall, "within": within, "interaction": interaction}


def replication_summary(overall: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Tested and replicated counts, percent, rank correlation and verdict, as one row."""
    from dyadic.functions.verdicts import replication_gate

    stored = materialize(overall.select("feature_id", "coef", "reference_coef", "p_val", "same_direction"))
    hit = F.col("same_direction") & (F.col("p_val") < threshold)
    counts = stored.agg(
        F.count("p_val").alias("n_tested"), F.coalesce(F.count_if(hit), F.lit(0)).alias("n_replicated")
    )
    share = F.coalesce(F.col("n_replicated") / F.nullif(F.col("n_tested"), F.lit(0).cast("bigint")) * 100.0, F.lit(0.0))
    rho = spearman(stored, [], "reference_coef", "coef").select("rho").scalar()
    return counts.select(
        "n_tested", "n_replicated", F.round(share, 2).alias("pct_replicated"),
        F.when(F.col("n_tested") == 0, "NO_DATA").otherwise(replication_gate(share)).alias("verdict"),
        rho.alias("spearman_rho"),
    )


def concordance_summary(looked_up: DataFrame) -> DataFrame:
    """Agreement of matched hits: sign share, rank correlation, pi1, significant counts, verdict."""
    from dyadic.functions.verdicts import concordance_gate

    stored = materialize(looked_up)
    matched = stored.filter("matched")
    p, q = F.coalesce("other_p_val", F.lit(1.0)), F.coalesce("other_q_val", F.lit(1.0))
    counts = stored.agg(
        F.count(F.lit(1)).alias("n_hits"), F.count_if("matched").alias("n_matched"),
        F.avg(F.when(F.col("matched"), (F.signum("coef") == F.signum("other_coef")).cast("double"))).alias("_sign"),
        F.count_if(F.col("matched") & (q < 0.05)).alias("n_sig_fdr"),
        F.count_if(F.col("matched") & (p < 0.05)).alias("n_sig_p"),
    )
    rho = spearman(matched, [], "coef", "other_coef", min_rows=2).select("rho").scalar()
    share = pi1(matched, [], "other_p_val").select("pi1").scalar()
    verdict = concordance_gate(F.col("_sign"), F.col("pi1"), F.col("_rho"))
    return counts.withColumns({"_rho": rho, "pi1": share}).select(
        "n_hits", "n_matched", F.round("_sign", 4).alias("sign_concordance"), F.round("_rho", 4).alias("spearman_rho"),
        "pi1", "n_sig_fdr", "n_sig_p", F.when(F.col("n_matched") == 0, "NO_MATCH").otherwise(verdict).alias("verdict"),
    )


def residualise(
    features: DataFrame, design: DataFrame, columns: Sequence[str], by: Sequence[str] = ("feature_id",),
    sample: str = "sample_id", absent: str = "check",
) -> DataFrame:
    """Residual of each value after regression on the columns and an intercept.

    NULL for features with too few values. Features and samples outside the design are dropped.
    """
    columns = list(columns)
    model = Model("residual", tuple(columns), (INTERCEPT, *columns))
    coefs = fit_models(features, design, [model], by=by, sample=sample, absent=absent, test=False)
    wide = coefs.groupBy(*by).agg(
        *[F.max(F.when(F.col("term") == t, F.col("coef"))).alias(f"_b{i}") for i, t in enumerate([INTERCEPT, *columns])]
    )
    x = design.select(sample, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    fitted = F.col("_b0")
    for i in range(len(columns)):
        fitted = fitted + F.col(f"_b{i + 1}") * F.col(f"_x{i}")
    n = x.limit(BROADCAST_ROWS + 1).count()
    return (
        features.join(_sized(x, n), sample)
        .join(small_side(wide), list(by))
        .withColumn("value", F.col("value") - fitted)
        .select(*features.columns)
    )
