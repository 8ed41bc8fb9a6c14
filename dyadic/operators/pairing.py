"""Alignment, pairing of visits, deltas, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.columns import POST_LABELS_WIDE, PRE_LABELS_WIDE, finite_or_null, normalise_visit
from dyadic.operators.ranking import ordered_prefix, top_n
from dyadic.session import materialize, small_side


def check_alignment(features: DataFrame, samples: DataFrame, sample: str = "sample_id", shown: int = 5) -> DataFrame:
    """Samples of the matrix that the metadata lacks."""
    return features.select(sample).distinct().join(samples.select(sample), sample, "left_anti")


def require_alignment(features: DataFrame, samples: DataFrame, sample: str = "sample_id") -> None:
    """Raise naming the first five missing samples."""
    first = [r[0] for r in check_alignment(features, samples, sample).orderBy(sample).limit(5).collect()]
    if first:
        raise ValueError(f"samples without metadata, first ones: {first}")


def crosswalk(df: DataFrame, mapping: DataFrame, key: str, target: str, order: Column, how: str = "inner") -> DataFrame:
    """Remap `key` to `target`; of several mappings for a key the first by `order` counts."""
    unique = top_n(mapping, [key], [order], 1, "_first").select(key, target)
    return df.join(small_side(unique), key, how)


def pair_subjects(samples: DataFrame, rule: str = "any", order: str = "sample_id") -> DataFrame:
    """One row per paired subject: subject_id, pre_id, post_id, response.

    `samples(subject_id, visit 'PRE'|'POST', sample_id, response)`. Rules: `any`
    needs a PRE and a POST (the first sample by `order` is used), `exactly_one`
    needs exactly one of each, `last` uses the last sample of each visit. The
    response comes from the PRE row.
    """
    def side(visit: str, pick) -> Column:
        return pick(F.when(F.col("visit") == visit, F.struct(F.col(order).alias("_order"), "sample_id", "response")))

    pick = F.max if rule == "last" else F.min
    pairs = samples.groupBy("subject_id").agg(
        F.count_if(F.col("visit") == "PRE").alias("_pre"),
        F.count_if(F.col("visit") == "POST").alias("_post"),
        side("PRE", pick).alias("_a"),
        side("POST", pick).alias("_b"),
    )
    if rule == "exactly_one":
        kept = pairs.filter((F.col("_pre") == 1) & (F.col("_post") == 1))
    else:
        kept = pairs.filter((F.col("_pre") > 0) & (F.col("_post") > 0))
    return kept.select(
        "subject_id",
        F.col("_a.sample_id").alias("pre_id"),
        F.col("_b.sample_id").alias("post_id"),
        F.col("_a.response").alias("response"),
    )


def subjects_from_names(samples: DataFrame, pre: str = "BL", post: str = "12W") -> DataFrame:
    """Fill subject_id and visit from `{subject}-{visit}` sample names; other names are dropped."""
    pattern = rf"^(.*)-({pre}|{post})$"
    visit = F.regexp_extract("sample_id", pattern, 2)
    return samples.filter(F.col("sample_id").rlike(pattern)).withColumns(
        {
            "subject_id": F.regexp_extract("sample_id", pattern, 1),
            "visit": F.when(visit == pre, "PRE").otherwise("POST"),
        }
    )


def wide_visits(samples: DataFrame, visit: str = "visit") -> DataFrame:
    """Second-cohort visit spellings to PRE/POST; rows of other visits are dropped."""
    return samples.withColumn(
        visit, normalise_visit(F.col(visit), PRE_LABELS_WIDE, POST_LABELS_WIDE, strict=False)
    ).filter(F.col(visit).isNotNull())


def paired_delta(observations: DataFrame, by: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """POST - PRE per subject and feature in one shuffle; cells lacking a side are dropped.

    `observations(subject_id, visit, *by, value)` with at most one value per cell.
    """
    pre = F.max(F.when(F.col("visit") == "PRE", F.col("value")))
    post = F.max(F.when(F.col("visit") == "POST", F.col("value")))
    return (
        observations.groupBy("subject_id", *by)
        .agg(pre.alias("pre"), post.alias("post"))
        .filter(F.col("pre").isNotNull() & F.col("post").isNotNull())
        .withColumn("delta", F.col("post") - F.col("pre"))
    )


def paired_delta_by_id(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Delta of a sample-keyed matrix, given `pairs(subject_id, pre_id, post_id)`."""
    sides = pairs.select(
        "subject_id", F.inline(F.array(
            F.struct(F.lit("PRE").alias("visit"), F.col("pre_id").alias("sample_id")),
            F.struct(F.lit("POST").alias("visit"), F.col("post_id").alias("sample_id")),
        ))
    )
    return paired_delta(features.join(small_side(sides), "sample_id"))


def scalar_delta(samples: DataFrame, column: str) -> DataFrame:
    """POST - PRE of one metadata column per subject; text that is no number counts as missing."""
    value = finite_or_null(F.col(column).try_cast("double"))
    return samples.groupBy("subject_id").agg(
        (F.max(F.when(F.col("visit") == "POST", value)) - F.max(F.when(F.col("visit") == "PRE", value))).alias("delta"),
        F.min_by("response", F.struct(F.when(F.col("visit") == "PRE", 0).otherwise(1), "sample_id")).alias("response"),
    )


def feature_intersection(a: DataFrame, b: DataFrame, minimum: int = 0, feature: str = "feature_id") -> DataFrame:
    """Ids present in both tables; fewer than `minimum` raises."""
    shared = a.select(feature).distinct().join(b.select(feature), feature, "left_semi")
    if minimum and shared.limit(minimum).count() < minimum:
        raise ValueError(f"fewer than {minimum} shared features")
    return shared


def align_views(views: list[DataFrame], sample: str = "sample_id", minimum: int = 0) -> DataFrame:
    """Sample ids present in every view."""
    shared = views[0].select(sample).distinct()
    for view in views[1:]:
        shared = shared.join(view.select(sample), sample, "left_semi")
    if minimum and shared.limit(minimum).count() < minimum:
        raise ValueError(f"fewer than {minimum} shared samples")
    return shared


def join_prefixed(samples: DataFrame, extra: DataFrame, prefix: str, sample: str = "sample_id") -> DataFrame:
    """Left-join extra columns under a prefix; `matched` tells whether the sample was found."""
    renamed = extra.withColumnsRenamed({c: prefix + c for c in extra.columns if c != sample})
    return samples.join(renamed.withColumn("matched", F.lit(True)), sample, "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False))
    )


def cross_contrast_class(pre: DataFrame, post: DataFrame, delta: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Class of each (feature, cell type) of the delta contrast by where it is significant."""
    keys = ["feature_id", "cell_type"]

    def flags(df: DataFrame, name: str) -> DataFrame:
        hit = F.coalesce(F.nanvl(F.col("q_val"), F.lit(1.0)), F.lit(1.0)) < fdr
        return df.groupBy(*keys).agg(F.max(hit).alias(name))

    joined = flags(delta, "d").join(flags(pre, "a"), keys, "left").join(flags(post, "b"), keys, "left")
    earlier = F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))
    label = (
        F.when(F.col("d") & ~earlier, "state_of_recovery")
        .when(F.col("d") & earlier, "baseline_and_recovery")
        .when(earlier, "trait_stable")
        .otherwise("other")
    )
    return joined.select(*keys, label.alias("cross_contrast_class"))


def hit_lookup(hits: DataFrame, other: DataFrame, keys: tuple[str, ...] = ("feature_id", "cell_type")) -> DataFrame:
    """Left-join results of a second cohort onto significant hits, its columns under `other_`."""
    renamed = other.withColumnsRenamed({c: f"other_{c}" for c in other.columns if c not in keys})
    return hits.join(renamed, list(keys), "left").withColumn("matched", F.col("other_coef").isNotNull())


def activity_feature_join(activity: DataFrame, samples: DataFrame) -> DataFrame:
    """Inner join on subject and visit; no match at all raises."""
    joined = activity.join(samples, ["subject_id", "visit"])
    if joined.isEmpty():
        raise ValueError("no activity row matches the sample table on (subject_id, visit)")
    return joined


def visit_stack(paired: DataFrame) -> DataFrame:
    """PRE and POST values of a paired table as rows with visit 0 and 1."""
    return paired.select(
        "subject_id", "feature_id",
        F.inline(F.array(
            F.struct(F.lit(0).alias("visit"), F.col("pre").alias("value")),
            F.struct(F.lit(1).alias("visit"), F.col("post").alias("value")),
        )),
    )


def stack_views(views: dict[str, DataFrame], subject: str = "subject_id") -> DataFrame:
    """Rows of all views tagged with `modality`, kept for subjects that every view has."""
    tagged = None
    shared = align_views(list(views.values()), subject)
    for name, view in views.items():
        part = view.withColumn("modality", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.join(shared, subject, "left_semi")


def union_tagged(tables: dict[object, DataFrame], tag: str) -> DataFrame:
    """Row-concatenate tables with a tag column (contrasts, cohorts, clouds)."""
    out = None
    for name, table in tables.items():
        part = table.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def strip_id_prefix(ids: DataFrame, feature: str = "feature_id", position: str = "position") -> DataFrame:
    """Symbol of each id; later repeats of a symbol, by position, get _1, _2, ..."""
    from dyadic.functions.columns import symbol_of

    symbols = materialize(ids.withColumn("_symbol", symbol_of(F.col(feature))).withColumn("_one", F.lit(1)))
    counted = ordered_prefix(symbols, ["_symbol"], position, {"_seen": ("count", "_one")})
    suffix = F.when(F.col("_seen") > 1, F.concat(F.lit("_"), (F.col("_seen") - 1).cast("string"))).otherwise("")
    return counted.withColumn("symbol", F.concat("_symbol", suffix)).drop("_symbol", "_one", "_seen")
