"""Network activity and set scores per sample, and mixture fractions."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadic.operators.ranking import rank_table
from dyadic.operators.selection import min_targets
from dyadic.session import BROADCAST_BYTES, TASK_ROWS, materialize, small_side


def ulm_activity(features: DataFrame, network: DataFrame, minimum: int = 5) -> DataFrame:
    """t-value of the slope of expression on edge weight, per sample and source.

    The regression runs over all genes of the panel, a gene outside the source's
    targets having weight 0, and an absent (sample, gene) cell value 0. Only
    network edges are joined; the rest enters through per-sample and per-source totals.
    """
    panel = features.select("feature_id").distinct()
    n = panel.count()
    edges = min_targets(network, minimum, panel)
    sources = edges.groupBy("source").agg(F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("weight")).alias("_ww"))
    totals = features.groupBy("sample_id").agg(
        F.count("value").alias("_k"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v")
    )
    cross = features.join(
        small_side(edges.withColumnRenamed("target", "feature_id")), "feature_id"
    ).groupBy("sample_id", "source").agg(F.sum(F.col("weight") * F.col("value")).alias("_wx"))
    # Every (sample, source) pair has a score, also where a sample holds none of the source's genes.
    full = totals.crossJoin(small_side(sources)).join(cross, ["sample_id", "source"], "left")
    share = F.col("_k") / F.lit(float(n))
    mean = F.col("_m") * share
    sxx = F.col("_k") * F.col("_v") + F.col("_k") * F.col("_m") * F.col("_m") * (1.0 - share)
    sww = F.col("_ww") - F.col("_w") * F.col("_w") / F.lit(float(n))
    swx = F.coalesce("_wx", F.lit(0.0)) - F.col("_w") * mean
    r = swx / F.nullif(F.sqrt(sxx * sww), F.lit(0.0))
    scored = full.withColumn("r", r)
    t = F.col("r") * F.sqrt(F.lit(float(n - 2)) / F.nullif(1.0 - F.col("r") * F.col("r"), F.lit(0.0)))
    return scored.select("sample_id", "source", t.alias("score"))


def ssgsea(features: DataFrame, sets: DataFrame, minimum: int = 5, alpha: float = 0.25,
           task_rows: int = TASK_ROWS) -> DataFrame:
    """Summed difference of the in-set and off-set rank distributions, per sample and set.

    Ranks run from the lowest value of a sample; ties share their mean rank. The
    running sums have a closed form in the in-set rows, so nothing is walked, and
    only the rows of some set look up their rank. A sample without any gene of a
    set has a row with a NULL score.
    """
    members = materialize(min_targets(sets, minimum, features.select("feature_id").distinct()).select(
        "source", F.col("target").alias("feature_id")
    ).distinct())
    stored = materialize(features.select("sample_id", "feature_id", "value"))
    ranks = rank_table(stored, ["sample_id"], "value", "_r", False, task_rows)
    listed = stored.join(small_side(members.select("feature_id").distinct()), "feature_id", "left_semi")
    ranked = listed.join(ranks, ["sample_id", "value"])
    sizes = stored.groupBy("sample_id").agg(F.count("value").alias("_n"))
    weight = F.pow(F.col("_r"), F.lit(alpha))
    inside = ranked.join(small_side(members), "feature_id").groupBy("sample_id", "source").agg(
        F.count(F.lit(1)).alias("_m"), F.sum(weight * F.col("_r")).alias("_wr"), F.sum(weight).alias("_w"),
        F.sum("_r").alias("_rs"),
    )
    n, m = F.col("_n"), F.col("_m")
    outside = (n * (n + 1) / 2.0 - F.col("_rs")) / F.nullif(n - m, F.lit(0).cast("bigint"))
    pairs = sizes.crossJoin(small_side(members.select("source").distinct()))
    return pairs.join(inside, ["sample_id", "source"], "left").select(
        "sample_id", "source", (F.col("_wr") / F.col("_w") - outside).alias("score"))


# Samples up to which a gene's kernel sums are taken over all pairs; beyond it values go to bins of this part of the kernel's
# width, which moves a sum by less than 0.061 of the part's square (2.5e-5).
PAIR_SAMPLES, BIN_PART = 256, 0.02


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    flat = np.array([math.erf(v) for v in (x / math.sqrt(2.0)).ravel()])
    return 0.5 + 0.5 * flat.reshape(np.shape(x))


def kernel_distribution(values: np.ndarray, pair_samples: int = PAIR_SAMPLES, part: float = BIN_PART) -> np.ndarray:
    """Smoothed distribution function of `values` at each of them: the mean of normal kernels a quarter of their deviation
    wide. Equal values give a half."""
    n = len(values)
    width = float(np.std(values, ddof=1)) / 4.0 if n > 1 else 0.0
    if not width > 1e-12 * float(np.abs(values).max(initial=0.0)):
        return np.full(n, 0.5)
    x = (values - values.min()) / width
    if n <= pair_samples:
        return _normal_cdf(x[:, None] - x[None, :]).mean(axis=1)
    # A value is shared between the bins on both sides of it, and a sum is read between bins in the same way.
    at = x / part
    low = np.floor(at).astype(np.int64)
    bins = np.bincount(low, 1 - (at - low), low.max() + 2) + np.bincount(low + 1, at - low, low.max() + 2)
    reach = int(9 / part)
    kernel = _normal_cdf(np.arange(-reach, reach + 1) * part)
    # Below the kernel's reach a bin counts in full.
    wide = np.concatenate([np.zeros(reach), bins, np.zeros(reach)])
    near = np.convolve(wide, kernel, "valid")
    full = np.concatenate([np.zeros(reach + 1), np.cumsum(bins)])[:len(near)]
    total = (near + full) / n
    return total[low] * (1 - (at - low)) + total[low + 1] * (at - low)


def set_variation(features: DataFrame, sets: DataFrame, minimum: int = 5, max_diff: bool = True,
                  pair_samples: int = PAIR_SAMPLES) -> DataFrame:
    """Gene-set variation score per sample and set: (sample_id, source, score).

    Every gene's values become their kernel-smoothed distribution function over all samples. In each sample the genes are
    ordered by it, highest first; equal ones by feature_id, as also genes that are constant, which stand at a half. A set's
    walk goes down that order, up at a gene of the set by its distance from the middle rank (their sum counted as one) and
    down evenly at others. The score is the highest point above zero plus the lowest below it, or with `max_diff` off the
    one further from zero. Highest points lie at the set's genes and lowest points just before them, so only their rows are
    walked.

    A gene is one row of its samples' values, whose kernel sums are exact for few samples and binned beyond `pair_samples`;
    no table of sample pairs is made. Null values are left out. Sets need `minimum` genes that occur. A sample without any
    gene of a set, or with no other genes, has a row with a NULL score.
    """
    members = materialize(min_targets(sets, minimum, features.select("feature_id").distinct()).select(
        "source", F.col("target").alias("feature_id")).distinct())
    smooth = F.pandas_udf(lambda v: pd.Series([kernel_distribution(np.asarray(x), pair_samples) for x in v]), "array<double>")
    genes = features.filter(F.col("value").isNotNull()).groupBy("feature_id").agg(
        F.sort_array(F.collect_list(F.struct("sample_id", F.col("value").cast("double").alias("value")))).alias("rows"))
    levels = genes.select("feature_id", F.explode(F.arrays_zip(
        F.col("rows.sample_id").alias("sample_id"), smooth(F.col("rows.value")).alias("level"))).alias("r"))
    levels = levels.select("feature_id", "r.sample_id", F.round("r.level", 12).alias("level"))
    order = Window.partitionBy("sample_id").orderBy(F.desc("level"), "feature_id")
    placed = materialize(levels.select("sample_id", "feature_id", F.row_number().over(order).alias("at")))
    sizes = placed.groupBy("sample_id").agg(F.max("at").alias("p"))
    inside = placed.join(small_side(members), "feature_id").join(sizes, "sample_id")
    inside = inside.withColumn("step", F.abs(F.col("p") / 2.0 - F.col("at") + 1.0))
    walk = Window.partitionBy("sample_id", "source").orderBy("at")
    whole = Window.partitionBy("sample_id", "source")
    inside = inside.select("sample_id", "source", "at", "p", "step", F.row_number().over(walk).alias("i"),
                           F.sum("step").over(walk).alias("sum"), F.sum("step").over(whole).alias("all"), F.count("*").over(whole).alias("m"))
    off = F.nullif(F.col("p") - F.col("m"), F.lit(0).cast("bigint"))
    share = F.nullif("all", F.lit(0.0))
    ends = inside.groupBy("sample_id", "source").agg(
        F.greatest(F.lit(0.0), F.max(F.col("sum") / share - (F.col("at") - F.col("i")) / off)).alias("top"),
        F.least(F.lit(0.0), F.min((F.col("sum") - F.col("step")) / share - (F.col("at") - F.col("i")) / off)).alias("low"),
        F.min(F.col("p") - F.col("m")).alias("rest"), F.max("all").alias("all"))
    far = F.col("top") + F.col("low") if max_diff else F.when(F.col("top") > -F.col("low"), F.col("top")).otherwise(F.col("low"))
    scores = ends.select("sample_id", "source", F.when((F.col("rest") > 0) & (F.col("all") > 0), far).alias("score"))
    pairs = sizes.select("sample_id").crossJoin(small_side(members.select("source").distinct()))
    return pairs.join(scores, ["sample_id", "source"], "left")


def _nonnegative(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Least squares with non-negative weights, from its normal equations; exact for small K."""
    k = len(rhs)
    passive: list[int] = []
    x = np.zeros(k)
    for _ in range(3 * k + 1):
        gradient = rhs - gram @ x
        free = [i for i in range(k) if i not in passive]
        if not free or max(gradient[i] for i in free) <= 1e-12 * max(1.0, np.abs(rhs).max()):
            break
        passive.append(max(free, key=lambda i: gradient[i]))
        while True:
            trial = np.zeros(k)
            trial[passive] = np.linalg.lstsq(gram[np.ix_(passive, passive)], rhs[passive], rcond=None)[0]
            if not passive or trial[passive].min() > 0:
                x = trial
                break
            ratios = [x[i] / (x[i] - trial[i]) for i in passive if trial[i] <= 0]
            x = x + min(ratios) * (trial - x)
            passive = [i for i in passive if x[i] > 1e-14]
            x[[i for i in range(k) if i not in passive]] = 0.0
    return x


def deconvolve(betas: DataFrame, panel: DataFrame, cell_types: list[str], check: bool = True) -> DataFrame:
    """Non-negative cell fractions per sample, adding to one, from a reference panel.

    `panel(feature_id, *cell_types)`. Values outside [-0.01, 1.01] make the job fail.
    Each sample is reduced to its K x K normal equations by one aggregate.
    """
    value = F.col("value")
    if check:
        outside = (value < -0.01) | (value > 1.01)
        value = F.when(outside, F.raise_error(F.lit("values outside [-0.01, 1.01] are no beta values")).cast("double")).otherwise(value)
    k = len(cell_types)
    pairs = [(i, i) for i in range(k)] + list(combinations(range(k), 2))
    c = [F.col(name).cast("double") for name in cell_types]
    moments = (
        betas.select("sample_id", "feature_id", value.alias("value"))
        .filter(F.col("value").isNotNull())
        .join(small_side(panel.select("feature_id", *cell_types)), "feature_id")
        .groupBy("sample_id")
        .agg(
            F.array(*[F.sum(c[i] * c[j]) for i, j in pairs]).alias("_g"),
            F.array(*[F.sum(x * F.col("value")) for x in c]).alias("_b"),
        )
    )

    def solve(g: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for packed, rhs in zip(g, b):
            gram = np.zeros((k, k))
            for value, (i, j) in zip(packed, pairs):
                gram[i, j] = gram[j, i] = value
            x = _nonnegative(gram, np.asarray(rhs, dtype=float))
            out.append(x / x.sum() if x.sum() > 0 else np.full(k, np.nan))
        return pd.Series(out)

    solved = moments.withColumn("_f", F.pandas_udf(solve, "array<double>")("_g", "_b"))
    return solved.select("sample_id", *[F.col("_f")[i].alias(name) for i, name in enumerate(cell_types)])


def deconvolve_robust(betas: DataFrame, panel: DataFrame, cell_types: list[str], rounds: int = 50, tolerance: float = 1e-6,
                      bend: float = 1.345, check: bool = True) -> DataFrame:
    """Cell fractions per sample by robust partial correlation, negative ones set to zero, adding to one.

    As `deconvolve`, but each sample's values are regressed on the panel and a constant by M-estimation: from least squares
    on, features whose residual exceeds `bend` times the scale count inversely to it, where the scale is the median size of
    the sample's residuals over 0.6745. A round is one grouped median and one grouped set of weighted (K+1) x (K+1) sums
    over the joined table, which is stored once; coefficients are a small table per sample. Rounds end when no sample's
    coefficients move by more than `tolerance` of their size. A sample whose scale is zero keeps its coefficients. Null
    values and features outside the panel are left out; a sample without a positive coefficient has NULL fractions.
    """
    value = F.col("value").cast("double")
    if check:
        outside = (value < -0.01) | (value > 1.01)
        value = F.when(outside, F.raise_error(F.lit("values outside [-0.01, 1.01] are no beta values")).cast("double")).otherwise(value)
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in cell_types])
    known = betas.select("sample_id", "feature_id", value.alias("y")).filter(F.col("y").isNotNull())
    cells = materialize(known.join(small_side(panel.select("feature_id", x.alias("x"))), "feature_id").select("sample_id", "y", "x"))
    k = len(cell_types) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows, cols = np.triu_indices(k)

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series, b: pd.Series, old: pd.Series) -> pd.Series:
        out = []
        for packed, rhs, last in zip(g, b, old):
            gram = np.zeros((k, k))
            gram[rows, cols] = gram[cols, rows] = packed
            out.append(last if packed[0] is None or np.isnan(packed[0]) else np.linalg.lstsq(gram, np.asarray(rhs, float), rcond=None)[0])
        return pd.Series(out)

    def fit(weighted: DataFrame) -> DataFrame:
        w = F.col("w")
        sums = weighted.groupBy("sample_id").agg(
            F.array(*[F.sum(w * F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("g"),
            F.array(*[F.sum(w * F.col("x")[i] * F.col("y")) for i in range(k)]).alias("b"), F.first("coef").alias("old"))
        return materialize(sums.select("sample_id", solve("g", "b", "old").alias("coef"), "old"))

    none = F.lit(None).cast("array<double>")
    fits = fit(cells.withColumns({"w": F.lit(1.0), "coef": none}))
    # A sample has k coefficients and a scale, so its table is broadcast while the samples are few.
    near = F.broadcast if fits.count() * 8 * (k + 4) <= BROADCAST_BYTES else lambda df: df
    for _ in range(rounds):
        fitted = sum((F.col("x")[i] * F.col("coef")[i] for i in range(k)), F.lit(0.0))
        apart = cells.join(near(fits.select("sample_id", "coef")), "sample_id").withColumn("r", F.abs(F.col("y") - fitted))
        scales = apart.groupBy("sample_id").agg((F.percentile("r", 0.5) / 0.6745).alias("scale"))
        # A zero scale makes the weights null, and with them the sums.
        weight = F.when(F.col("scale") > 0, F.least(F.lit(1.0), bend * F.col("scale") / F.nullif("r", F.lit(0.0))))
        fits = fit(apart.join(near(scales), "sample_id").withColumn("w", weight))
        moved = F.aggregate(F.zip_with("coef", "old", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b))
        size = F.aggregate("coef", F.lit(1e-12), lambda a, b: F.greatest(a, F.abs(b)))
        if fits.filter(moved > tolerance * size).isEmpty():
            break
    kept = [F.greatest(F.col("coef")[i], F.lit(0.0)) for i in range(1, k)]
    total = F.nullif(sum(kept, F.lit(0.0)), F.lit(0.0))
    return fits.select("sample_id", *[(c / total).alias(name) for c, name in zip(kept, cell_types)])


def fraction_checks(fractions: DataFrame, cell_types: list[str], tolerance: float = 0.05) -> DataFrame:
    """Row-sum range, rows off one by more than the tolerance, and near-constant columns, as one row."""
    total = sum((F.col(c) for c in cell_types), F.lit(0.0))
    flat = F.filter(
        F.array(*[F.when(F.var_samp(c) < 1e-6, F.lit(c)) for c in cell_types]), lambda x: x.isNotNull()
    )
    return fractions.agg(
        F.count(F.lit(1)).alias("n"), F.min(total).alias("min_sum"), F.max(total).alias("max_sum"),
        F.count_if(F.abs(total - 1.0) > tolerance).alias("n_off"), flat.alias("near_constant"),
    )
