"""Feature selection, scaling and imputation, including leakage-free fold versions.

Per-feature statistics are partial aggregates joined back to the rows, never
windows over a feature's rows: a feature holding a large share of the table is
then split over tasks, and the statistics can be reused on held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.operators.ranking import top_n
from dyadic.operators.resample import hash_position
from dyadic.session import materialize, small_side


def impute_mean(features: DataFrame, by: tuple[str, ...] = ("feature_id",), value: str = "value") -> DataFrame:
    """Fill missing values with their group mean; groups without any value stay as they are."""
    means = features.groupBy(*by).agg(F.avg(value).alias("_mean"))
    return features.join(small_side(means), list(by)).withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def scale_stats(features: DataFrame, by: tuple[str, ...] = ("feature_id",), value: str = "value", ddof: int = 0):
    """Mean and standard deviation per feature; a zero or undefined deviation becomes 1."""
    sd = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    return features.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1.0)).alias("sd")
    )


def zscale(
    features: DataFrame, stats: DataFrame | None = None, by: tuple[str, ...] = ("feature_id",),
    value: str = "value", ddof: int = 0,
) -> DataFrame:
    """Centre and scale per feature; pass `stats` of the training rows to scale held-out rows."""
    stats = scale_stats(features, by, value, ddof) if stats is None else stats
    return (
        features.join(small_side(stats), list(by))
        .withColumn(value, (F.col(value) - F.col("mean")) / F.col("sd"))
        .drop("mean", "sd")
    )


def topk_variance(
    features: DataFrame, n: int, ddof: int = 1, value: str = "value", feature: str = "feature_id",
    always: list[str] | None = None, digits: int | None = None,
) -> DataFrame:
    """The n features of highest variance (ties by id; no variance counts as 0) with their variance.

    Ids in `always` are kept whatever their variance and do not use up the n. With `digits`, variances that agree when
    rounded are ties, so that the order of summation does not pick the panel.
    """
    var = F.var_pop(value) if ddof == 0 else F.var_samp(value)
    ranked = features.groupBy(feature).agg(F.coalesce(var, F.lit(0.0)).alias("variance"))
    height = F.col("variance") if digits is None else F.round("variance", digits)
    if not always:
        return ranked.orderBy(height.desc(), feature).limit(n)
    free = ranked.filter(~F.col(feature).isin(*always)).orderBy(height.desc(), feature).limit(n)
    return ranked.filter(F.col(feature).isin(*always)).unionByName(free)


def keep_features(features: DataFrame, selected: DataFrame, feature: str = "feature_id") -> DataFrame:
    """Rows of the selected features."""
    return features.join(small_side(selected.select(feature)), feature, "left_semi")


def range_filter(
    features: DataFrame, blacklist: DataFrame | None, floor: float = 0.05, top: int | None = None,
    value: str = "value", feature: str = "feature_id",
) -> DataFrame:
    """Features outside the blacklist whose max - min exceeds the floor, by variance if `top` is given."""
    kept = features if blacklist is None else features.join(blacklist.select(feature), feature, "left_anti")
    stats = kept.groupBy(feature).agg(
        (F.max(value) - F.min(value)).alias("range"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance")
    ).filter(F.col("range") > floor)
    return stats if top is None else stats.orderBy(F.desc("variance"), feature).limit(top)


def significant_features(results: DataFrame, fdr: float = 0.10) -> DataFrame:
    """Features significant in any cell type."""
    return results.filter(F.col("q_val") < fdr).select("feature_id").distinct()


def cis_map(features: DataFrame, gene_map: DataFrame, window_kb: float = 100.0) -> DataFrame:
    """Genes within the window of any of the given features; `gene_map(feature_id, gene, distance_kb)`."""
    return (
        gene_map.filter(F.abs("distance_kb") <= window_kb)
        .join(features.select("feature_id"), "feature_id", "left_semi")
        .select("gene").distinct()
    )


def resolve_tier(
    results: DataFrame | None, dnam: DataFrame, rna: DataFrame, gene_map: DataFrame | None,
    blacklist: DataFrame | None = None, fdr: float = 0.10, top_dnam: int = 5000, top_rna: int = 2000,
    window_kb: float = 100.0, floor: float = 0.05,
) -> DataFrame:
    """Features of the active tier as (tier, modality, feature_id).

    Tier 1: significant features plus the genes around them, if both exist in the
    tables; otherwise tier 2: the range filter and the variance ranks.
    """
    if results is not None and gene_map is not None:
        sig = significant_features(results, fdr).join(dnam.select("feature_id"), "feature_id", "left_semi")
        genes = cis_map(sig, gene_map, window_kb).withColumnRenamed("gene", "feature_id")
        genes = genes.join(rna.select("feature_id"), "feature_id", "left_semi")
        if not sig.isEmpty() and not genes.isEmpty():
            return _tier(1, sig, genes)
    return _tier(2, range_filter(dnam, blacklist, floor, top_dnam), topk_variance(rna, top_rna))


def _tier(tier: int, dnam: DataFrame, rna: DataFrame) -> DataFrame:
    tagged = [
        df.select(F.lit(tier).alias("tier"), F.lit(name).alias("modality"), "feature_id")
        for name, df in (("dnam", dnam), ("rna", rna))
    ]
    return tagged[0].unionByName(tagged[1])


def fold_stats(features: DataFrame, folds: DataFrame, sample: str = "subject_id") -> DataFrame:
    """Training-row statistics of every (fold, feature), from one pass over the data.

    Each row is summed once under its own fold; a fold's training moments are the
    totals over the other folds, combined from the per-fold moments.
    """
    per_fold = features.join(small_side(folds), sample).groupBy("feature_id", "fold").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    ).filter(F.col("n") > 0)
    # One row per (feature, fold): k rows per feature, k the number of folds.
    moments = per_fold.groupBy("feature_id").agg(F.collect_list(F.struct("fold", "n", "m", "v")).alias("parts"))
    held = folds.select(F.col("fold").alias("fold")).distinct().agg(F.sort_array(F.collect_set("fold"))).scalar()
    expanded = moments.withColumn("fold", F.explode(held)).withColumn(
        "train", F.filter("parts", lambda p: p["fold"] != F.col("fold"))
    )
    n = F.aggregate("train", F.lit(0).cast("bigint"), lambda s, p: s + p["n"])
    mean = F.aggregate("train", F.lit(0.0), lambda s, p: s + p["n"] * p["m"]) / F.nullif(n, F.lit(0).cast("bigint"))
    stats = expanded.withColumns({"n_train": n, "mean": mean})
    spread = F.aggregate(
        "train", F.lit(0.0),
        lambda s, p: s + p["n"] * (p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean"))),
    )
    return stats.withColumn("variance", spread / F.nullif(F.col("n_train") - 1, F.lit(0).cast("bigint"))).select(
        "fold", "feature_id", "n_train", "mean", F.coalesce("variance", F.lit(0.0)).alias("variance")
    )


def fold_preprocess(
    features: DataFrame, folds: DataFrame, top: int, sample: str = "subject_id", standardise: bool = True
) -> DataFrame:
    """Every fold's selected and scaled table, training and held-out rows alike.

    Features are ranked, and means and deviations frozen, on each fold's training
    rows. Output: fold, subject, feature_id, value, held_out.
    """
    panel = top_n(fold_stats(features, folds, sample), ["fold"], [F.desc("variance"), F.col("feature_id")], top)
    sd = F.coalesce(F.nullif(F.sqrt("variance"), F.lit(0.0)), F.lit(1.0))
    panel = panel.select(F.col("fold").alias("panel_fold"), "feature_id", "mean", sd.alias("sd"))
    value = (F.col("value") - F.col("mean")) / F.col("sd") if standardise else F.col("value")
    own = folds.select(sample, F.col("fold").alias("own_fold"))
    return (
        features.join(small_side(own), sample)
        .join(small_side(panel), "feature_id")
        .select(
            F.col("panel_fold").alias("fold"), sample, "feature_id", value.alias("value"),
            (F.col("own_fold") == F.col("panel_fold")).alias("held_out"),
        )
    )


def loo_topk_variance(features: DataFrame, top: int, subject: str = "subject_id") -> DataFrame:
    """Top features by variance for every left-out subject, without re-scanning per subject.

    The left-out variance follows from the totals minus the subject's own
    moments; values are centred on the feature mean first, so nothing cancels.
    Expects a row for every (subject, feature) cell, with NULL where missing.
    """
    means = features.groupBy("feature_id").agg(F.avg("value").alias("_mean"))
    centred = features.join(small_side(means), "feature_id").withColumn("_c", F.col("value") - F.col("_mean"))
    own = centred.groupBy("feature_id", subject).agg(
        F.count("_c").alias("n"), F.coalesce(F.sum("_c"), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.col("_c") * F.col("_c")), F.lit(0.0)).alias("ss"),
    )
    total = own.groupBy("feature_id").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("ss").alias("all_ss"))
    n, s, ss = F.col("all_n") - F.col("n"), F.col("all_s") - F.col("s"), F.col("all_ss") - F.col("ss")
    zero = F.lit(0).cast("bigint")
    variance = F.when(n > 1, (ss - s * s / F.nullif(n, zero)) / F.nullif(n - 1, zero))
    left_out = own.join(small_side(total), "feature_id").select(
        subject, "feature_id", F.coalesce(variance, F.lit(0.0)).alias("variance")
    )
    return top_n(left_out, [subject], [F.desc("variance"), F.col("feature_id")], top)


def min_targets(network: DataFrame, minimum: int, panel: DataFrame | None = None) -> DataFrame:
    """Edges of sources with at least `minimum` distinct targets (within the panel, if given)."""
    edges = network
    if panel is not None:
        edges = edges.join(panel.select(F.col("feature_id").alias("target")), "target", "left_semi")
    kept = edges.groupBy("source").agg(F.countDistinct("target").alias("_n")).filter(F.col("_n") >= minimum)
    return edges.join(kept.select("source"), "source", "left_semi")


def encode_covariates(samples: DataFrame, columns: list[str], fill: str = "mean") -> DataFrame:
    """Numeric form of covariate columns.

    Text becomes its place among the sorted distinct values (from 0). Missing
    values become the column mean, or 0 where there is none; `fill="zero"` uses 0 only.
    """
    out = samples
    for name in columns:
        if dict(out.dtypes)[name] in ("string", "boolean"):
            levels = materialize(out.filter(F.col(name).isNotNull()).select(name).distinct())
            placed = hash_position(levels, [], F.col(name).cast("string"), "_at", name, rows=levels.count())
            levels = placed.select(name, (F.col("_at") - 1).cast("double").alias("_code"))
            out = out.join(levels, name, "left").drop(name).withColumnRenamed("_code", name)
        else:
            out = out.withColumn(name, F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")))
    if fill == "zero":
        return out.na.fill(0.0, subset=columns).select(*samples.columns)
    means = out.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).first()
    return out.na.fill({c: means[c] for c in columns}).select(*samples.columns)


def flag_outliers(activity: DataFrame, source: str, threshold: float = 2.0) -> DataFrame:
    """Samples whose activity of one source lies more than `threshold` population SDs above its mean.

    A source that is absent flags nothing; names match case-insensitively with _ as -.
    """
    wanted = F.translate(F.upper("source"), "_", "-") == source.upper().replace("_", "-")
    stats = activity.filter(wanted).agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    high = F.max(F.when(wanted, F.col("score")))
    mean, sd = stats.select("m").scalar(), stats.select("s").scalar()
    return activity.groupBy("sample_id").agg(high.alias("score")).withColumn(
        "flagged", F.coalesce((F.col("score") - mean) / F.nullif(sd, F.lit(0.0)) > threshold, F.lit(False))
    )
