"""Components, factors, axes, clusters and the diagnostics built on them.

Vectors live in an ARRAY<DOUBLE> column; cross-products are Spark aggregates and
only matrices whose side is a component count or a sample count reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.functions import columns as C
from dyadic.functions.tails import boundary_lrt_udf
from dyadic.functions.verdicts import icc_class
from dyadic.operators.moments import covariance, cross_product, vector_mean, vector_width
from dyadic.operators.ranking import bh_fdr
from dyadic.operators.resample import bootstrap_counts, draw
from dyadic.operators.selection import loo_topk_variance, zscale
from dyadic.session import collect_bounded, materialize, small_side

# Largest side of a cross-product matrix that is brought to the driver (4096^2 doubles = 128 MB).
GRAM_SIDE = 4096
# Numbers of a block of vectors, or of a block of panels' moments, that one task holds.
BLOCK_CELLS = 1 << 22


def _oriented(vectors: np.ndarray) -> np.ndarray:
    """Fix signs: the entry of largest size is positive in every column."""
    at = np.abs(vectors).argmax(axis=0)
    sign = np.sign(vectors[at, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1.0, sign)


def pca_vectors(vectors: DataFrame, k: int, keep: list[str], vector: str = "z") -> dict[str, DataFrame]:
    """Components of row vectors of modest width: scores, loadings and explained shares."""
    n, mean, cov = covariance(vectors, vector)
    values, axes = np.linalg.eigh(cov)
    k = min(k, n - 1, len(mean))
    axes = _oriented(axes[:, ::-1][:, :k])
    centred = F.zip_with(vector, C.literal_vector(mean), lambda a, b: a - b)
    spark = vectors.sparkSession
    scores = vectors.select(*keep, F.array(*[C.dot(centred, C.literal_vector(axes[:, j])) for j in range(k)]).alias("scores"))
    loadings = spark.createDataFrame(
        [(i, j + 1, float(axes[i, j])) for i in range(len(mean)) for j in range(k)],
        "feature_id int, component int, loading double",
    )
    total = float(values.sum())
    return {"scores": scores, "loadings": loadings, "explained": _explained(spark, values[::-1][:k], total)}


def _explained(spark, values, total: float) -> DataFrame:
    return spark.createDataFrame(
        [(j + 1, float(v), float(v / total) if total > 0 else 0.0) for j, v in enumerate(values)],
        "component int, variance double, ratio double",
    )


def pca_long(features: DataFrame, k: int, sample: str = "subject_id", feature: str = "feature_id",
             iterations: int = 500) -> dict[str, DataFrame]:
    """Components of a long table; absent cells count as the feature's mean.

    `k` is at most the smaller of samples - 1 and features. The cross-product of the centred data is summed over its
    longer side and factorised on the shorter one; the other side's coordinates follow from one join. If both sides
    exceed `GRAM_SIDE`, the leading subspace is found by power iteration on the long table, so neither side of the matrix
    has to fit anywhere; it raises an error if it has not settled after `iterations` rounds. Both ways give the same
    components: the loading of largest size is positive.
    """
    means = features.groupBy(feature).agg(F.avg("value").alias("_m"))
    centred = materialize(features.join(small_side(means), feature).select(sample, feature, (F.col("value") - F.col("_m")).alias("value")))
    sizes = centred.agg(F.countDistinct(sample).alias("n"), F.countDistinct(feature).alias("p")).first()
    n, p = sizes["n"], sizes["p"]
    k = min(k, n - 1, p)
    way = _pca_power if min(n, p) > GRAM_SIDE else _pca_gram
    coords, loads, values, total = way(centred, k, n, p, sample, feature, iterations)
    top = loads.agg(*[F.max_by(F.signum(F.col("u")[j]), F.struct(F.round(F.abs(F.col("u")[j]), 8), F.hash(feature))).alias(f"s{j}")
                      for j in range(k)]).first()
    sign = [top[f"s{j}"] or 1.0 for j in range(k)]
    size = np.sqrt(values)
    return {
        "scores": coords.select(sample, F.array(*[F.col("u")[j] * F.lit(float(size[j] * sign[j])) for j in range(k)]).alias("scores")),
        "loadings": loads.select(feature, F.posexplode("u").alias("_j", "_l")).select(
            feature, (F.col("_j") + 1).alias("component"),
            (F.col("_l") * F.element_at(F.array(*[F.lit(float(v)) for v in sign]), F.col("_j") + 1)).alias("loading")),
        "explained": _explained(features.sparkSession, values / max(n - 1, 1), total / max(n - 1, 1)),
    }


def _pca_gram(centred: DataFrame, k: int, n: int, p: int, sample: str, feature: str, iterations: int):
    """Unit coordinates and loadings `u`, squared singular values and their sum, from the shorter side's cross-product."""
    short, long = (feature, sample) if p <= n else (sample, feature)
    values, axes = np.linalg.eigh(_short_gram(centred, short, long))
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1][:, :k]
    ids = [r[0] for r in centred.select(short).distinct().orderBy(short).collect()]
    unit = centred.sparkSession.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in zip(ids, axes)],
        T.StructType([centred.schema[short], T.StructField("u", T.ArrayType(T.DoubleType()))]))
    inverse = [float(1.0 / s) if s > 0 else 0.0 for s in np.sqrt(values[:k])]
    other = materialize(centred.join(F.broadcast(unit), short).groupBy(long).agg(
        F.array(*[F.sum(F.col("value") * F.col("u")[j]) * F.lit(inverse[j]) for j in range(k)]).alias("u")))
    loads, coords = (unit, other) if short == feature else (other, unit)
    return coords, loads, values[:k], float(values.sum())


def _short_gram(centred: DataFrame, short: str, long: str) -> np.ndarray:
    """Cross-product over the short side's ids, in id order; each long-side id becomes one vector."""
    ids = centred.agg(F.sort_array(F.collect_set(short)).alias("ids"))
    packed = centred.groupBy(long).agg(F.sort_array(F.collect_list(F.struct(short, "value"))).alias("_p")).withColumn("_ids", ids.scalar())
    filled = F.transform("_ids", lambda i: F.coalesce(F.element_at(F.map_from_entries("_p"), i), F.lit(0.0)))
    whole = F.transform("_p", lambda p: p["value"])
    return cross_product(packed.select(F.when(F.size("_p") == F.size("_ids"), whole).otherwise(filled).alias("z")))


def _pca_power(centred: DataFrame, k: int, n: int, p: int, sample: str, feature: str, iterations: int):
    """As `_pca_gram`, by block power iteration with Ritz values: two grouped sums a round, a small factorisation on the
    driver. A few directions beyond `k` make it settle sooner; it ends when X X'u differs from its multiple of u by less
    than 1e-9 of the largest value for all `k` directions."""
    width = min(k + 8, n, p)
    u = materialize(centred.select(sample).distinct().select(sample, F.array(*[
        F.conv(F.substring(draw(j, F.col(sample)), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5 for j in range(width)]).alias("u")))

    def push(values: DataFrame, key: str, other: str, m: int) -> DataFrame:
        return materialize(centred.join(values, key).groupBy(other).agg(
            F.array(*[F.sum(F.col("value") * F.col("u")[j]) for j in range(m)]).alias("u")))

    def turned(df: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
        return df.select(key, F.array(*[C.dot(F.col("u"), C.literal_vector(matrix[:, j])) for j in range(matrix.shape[1])]).alias("u"))

    def orthonormal(df: DataFrame, key: str) -> tuple[DataFrame, np.ndarray]:
        """An orthonormal basis of the columns in order of size, and the squared sizes; null directions go."""
        size, turn = np.linalg.eigh(cross_product(df, "u"))
        size, turn = size[::-1], turn[:, ::-1]
        kept = size > 1e-20 * max(size[0], 1e-300)
        return turned(df, key, turn[:, kept] / np.sqrt(size[kept])), size[kept]

    u, _ = orthonormal(u, sample)
    for _ in range(iterations):
        u = materialize(u)
        m = vector_width(u, "u")
        w = push(u, sample, feature, m)
        # Ritz step: turn u so that its images are orthogonal, then compare X X'u with its multiple of u.
        values, turn = np.linalg.eigh(cross_product(w, "u"))
        values, turn = np.maximum(values[::-1], 0.0), turn[:, ::-1]
        u, y = turned(u, sample, turn), turned(push(w, feature, sample, m), sample, turn)
        both = y.withColumnRenamed("u", "y").join(u, sample)
        gap = both.agg(*[F.sum(F.pow(F.col("y")[j] - F.lit(float(values[j])) * F.col("u")[j], F.lit(2))).alias(f"g{j}")
                         for j in range(min(k, m))]).first()
        if all(np.sqrt(g or 0.0) <= 1e-9 * max(values[0], 1e-300) for g in gap):
            break
        u, _ = orthonormal(y, sample)
    else:
        raise ArithmeticError(f"the components have not settled after {iterations} rounds")
    w = turned(w, feature, turn)
    total = centred.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    values = np.concatenate([values, np.zeros(max(k - m, 0))])[:k]
    inverse = [float(1.0 / np.sqrt(v)) if v > 0 else 0.0 for v in values]
    pad = lambda j: F.coalesce(F.get("u", F.lit(j)), F.lit(0.0))
    coords = materialize(u.select(sample, F.array(*[pad(j) for j in range(k)]).alias("u")))
    loads = materialize(w.select(feature, F.array(*[pad(j) * F.lit(inverse[j]) for j in range(k)]).alias("u")))
    return coords, loads, values, float(total)


def multiview_factors(views: DataFrame, k: int, sample: str = "obs_id") -> dict[str, DataFrame]:
    """Factors of several views stacked side by side: `views(view, sample, feature_id, value)`.

    Every feature is scaled, then each view is divided by the square root of its
    feature count so that no view dominates by size. Loadings come back per view.
    """
    scaled = zscale(views, by=("view", "feature_id"))
    sizes = views.groupBy("view").agg(F.countDistinct("feature_id").alias("_p"))
    weighted = scaled.join(small_side(sizes), "view").select(
        sample, F.struct("view", "feature_id").alias("feature_id"), (F.col("value") / F.sqrt("_p")).alias("value")
    )
    out = pca_long(weighted, k, sample)
    out["loadings"] = out["loadings"].select("feature_id.view", "feature_id.feature_id", "component", "loading")
    return out


def project(features: DataFrame, loadings: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Latent coordinates: sum of value x loading over shared features, as (sample, component, coordinate)."""
    return features.join(small_side(loadings), "feature_id").groupBy(sample, "component").agg(
        F.sum(F.col("value") * F.col("loading")).alias("coordinate")
    )


def encode_with(vectors: DataFrame, encoder, vector: str = "z", out: str = "z") -> DataFrame:
    """Hook for a user-supplied encoder: a function from an (n x p) to an (n x d) numpy array, run per Arrow batch."""
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encoder(np.stack(batch.to_numpy())), dtype=float)))

    return vectors.withColumn(out, F.pandas_udf(run, "array<double>")(F.col(vector)))


# --- factor diagnostics -----------------------------------------------------------------


def subject_factor_means(scores: DataFrame, missing: float | None = None) -> DataFrame:
    """Mean over visits and POST - PRE per (subject, factor); `scores(subject_id, visit 0/1, factor, value)`.

    A subject lacking a visit gets `missing` as delta (0.0 or NULL).
    """
    pre, post = F.avg(F.when(F.col("visit") == 0, F.col("value"))), F.avg(F.when(F.col("visit") == 1, F.col("value")))
    delta = post - pre
    return scores.groupBy("subject_id", "factor").agg(
        F.avg("value").alias("mean"), (delta if missing is None else F.coalesce(delta, F.lit(missing))).alias("delta")
    )


def _components(groups: DataFrame, keys: list[str]) -> DataFrame:
    """One-way variance components per key from per-subject (n, mean, within sum of squares) rows."""
    # Centre on the key's overall mean first, so the between-subject sum does not cancel.
    grand = groups.groupBy(*keys).agg((F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("_grand"))
    gap = F.col("m") - F.col("_grand")
    return _ratios(groups.join(grand, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("a"), F.sum("k").cast("double").alias("n"),
        F.sum(F.col("k") * F.col("k")).cast("double").alias("kk"),
        F.sum(F.col("k") * gap * gap).alias("ssb"), F.sum("ssw").alias("ssw"),
    ), keys)


def _ratios(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Variance components and their ratio per key from its subjects `a`, rows `n`, squared sizes `kk` and sums of squares."""
    ok = (F.col("a") >= 2) & (F.col("n") > F.col("a"))
    msb = F.col("ssb") / F.nullif(F.col("a") - 1.0, F.lit(0.0))
    msw = F.col("ssw") / F.nullif(F.col("n") - F.col("a"), F.lit(0.0))
    n0 = (F.col("n") - F.col("kk") / F.nullif(F.col("n"), F.lit(0.0))) / F.nullif(F.col("a") - 1.0, F.lit(0.0))
    n0 = F.when(n0 <= 0, F.lit(1.0)).otherwise(n0)
    between = F.when(ok, F.greatest(F.lit(0.0), (msb - msw) / n0)).otherwise(F.lit(0.0))
    within = F.when(ok, F.greatest(msw, F.lit(1e-12))).otherwise((F.col("ssb") + F.col("ssw")) / F.nullif(F.col("n"), F.lit(0.0)))
    parts = sums.select(*keys, "a", "n", "ssb", "ssw", between.alias("s_between"), within.alias("s_within"))
    share = F.col("s_between") / F.nullif(F.col("s_between") + F.col("s_within"), F.lit(0.0))
    return parts.withColumn("icc", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), F.lit(0.0)))


# Factors whose sums a task holds together, subjects in a task's group, and replicates added up in one group.
_BLOCK, _CHUNK, _REPS = 64, 2048, 64


def _resampled_components(groups: DataFrame, bootstrap: int, seed: int) -> DataFrame:
    """`_components` of every (rep, factor), each subject counting as often as the replicate drew it.

    There is no row per replicate, subject and factor: a group of subjects turns its copies (replicates x subjects) and
    values (subjects x a block of factors) into one product, and only the products are shuffled.
    """
    named = materialize(groups.groupBy("factor").agg((F.sum(F.col("k") * F.col("m")) / F.nullif(F.sum("k"), F.lit(0))).alias("_grand"))
                        .withColumn("_slot", F.row_number().over(W.orderBy("factor")) - 1))
    subjects = groups.select("subject_id").distinct()
    chunks = subjects.count() // _CHUNK + 1
    copies = bootstrap_counts(subjects, bootstrap, seed).groupBy("subject_id").agg(F.collect_list(F.struct("rep", "copies")).alias("c"))
    zero = F.lit(0.0)
    value = F.struct((F.col("_slot") % _BLOCK).alias("at"), F.col("k").cast("double").alias("k"),
                     F.coalesce(F.col("m") - F.col("_grand"), zero).alias("g"), F.coalesce("ssw", zero).alias("ssw"))
    wide = groups.join(named, "factor").groupBy(F.floor(F.col("_slot") / _BLOCK).alias("block"), "subject_id").agg(
        F.collect_list(value).alias("v"))
    rows = wide.join(copies, "subject_id").select(
        "block", F.pmod(F.xxhash64("subject_id"), F.lit(chunks)).alias("chunk"), *[f"v.{c}" for c in ("at", "k", "g", "ssw")], "c.rep", "c.copies")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((bootstrap, _BLOCK * 6))
        for start in range(0, len(pdf), 512):
            part = pdf.iloc[start:start + 512]
            flat = lambda c: (np.repeat(np.arange(len(part)), part[c].map(len)), np.concatenate(part[c].to_numpy()))
            weight = np.zeros((bootstrap, len(part)))
            row, drawn = flat("rep")
            weight[drawn.astype(int) - 1, row] = flat("copies")[1]
            row, at = flat("at")
            k, g, ssw = (flat(c)[1] for c in ("k", "g", "ssw"))
            x = np.zeros((len(part), _BLOCK, 6))
            x[row, at.astype(int)] = np.stack([np.ones(len(k)), k, k * k, k * g, k * g * g, ssw], axis=1)
            total += weight @ x.reshape(len(part), -1)
        return pd.DataFrame({"block": pdf["block"].iloc[0], "rep": np.arange(1, bootstrap + 1), "sums": [row.tobytes() for row in total]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        reps, index = np.unique(pdf["rep"].to_numpy(), return_inverse=True)
        total = np.zeros((len(reps), _BLOCK * 6))
        np.add.at(total, index, np.stack([np.frombuffer(row) for row in pdf["sums"]]))
        out = pd.DataFrame(total.reshape(-1, 6), columns=["a", "n", "kk", "kg", "kgg", "ssw"])
        out.insert(0, "_slot", np.tile(np.arange(_BLOCK), len(reps)) + int(pdf["block"].iloc[0]) * _BLOCK)
        out.insert(0, "rep", np.repeat(reps, _BLOCK))
        return out[out["a"] > 0]

    made = rows.groupBy("block", "chunk").applyInPandas(products, "block long, rep int, sums binary")
    sums = made.groupBy("block", F.floor(F.col("rep") / _REPS).alias("_reps")).applyInPandas(
        added, "rep int, _slot int, a double, n double, kk double, kg double, kgg double, ssw double")
    ssb = F.greatest(zero, F.col("kgg") - F.col("kg") * F.col("kg") / F.nullif(F.col("n"), zero))
    return _ratios(sums.join(named, "_slot").withColumn("ssb", ssb), ["rep", "factor"])


def _subject_groups(scores: DataFrame) -> DataFrame:
    return scores.groupBy("factor", "subject_id").agg(
        F.count("value").alias("k"), F.avg("value").alias("m"), (F.count("value") * F.var_pop("value")).alias("ssw")
    )


def variance_components(scores: DataFrame) -> DataFrame:
    """Between- and within-subject variance and their ratio (ICC) per factor."""
    return _components(_subject_groups(scores), ["factor"]).select("factor", "s_between", "s_within", "icc")


def profile_ratio(k, a, s1, s2, ssw: float) -> tuple[float, float, float, float, float]:
    """Maximum likelihood of a random subject intercept from sums per subject size: (ratio, mean, within, loglik, loglik at 0).

    `k` rows in each of `a` subjects, whose means add to `s1` and their squares to `s2`; `ssw` is the sum of squares inside
    subjects. Given the ratio of both variances, mean and within-variance have closed forms, so only the ratio is searched:
    the best of a grid of shares brackets it, then Newton steps on the slope, or halving where a step leaves the bracket.
    """
    n = float((k * a).sum())

    def parts(ratio):
        w = k / (1.0 + k * ratio)
        mean = (w * s1).sum() / (w * a).sum()
        rest = np.maximum(s2 - 2.0 * mean * s1 + mean * mean * a, 0.0)
        return w, mean, rest, max(ssw + (w * rest).sum(), 1e-300)

    def loss(ratio):
        q = parts(ratio)[3]
        return n * np.log(q / n) + (a * np.log1p(k * ratio)).sum()

    def slope(ratio):
        w, _, rest, q = parts(ratio)
        first, second = (w * w * rest).sum(), (w**3 * rest).sum()
        return (a * w).sum() - n * first / q, n * (2.0 * second / q - (first / q) ** 2) - (a * w * w).sum()

    ratio = 0.0
    if a.sum() >= 2 and n > a.sum():
        shares = np.concatenate([[0.0], 1.0 / (1.0 + np.exp(-np.linspace(-18.0, 27.0, 361)))])
        grid = shares / (1.0 - shares)
        best = int(np.argmin([loss(g) for g in grid]))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
        if best or slope(0.0)[0] < 0:
            ratio = grid[best] or high / 2
            for _ in range(200):
                g, curve = slope(ratio)
                low, high = (ratio, high) if g < 0 else (low, ratio)
                step = ratio - g / curve if curve > 0 else -1.0
                new = step if low < step < high else (low + high) / 2
                if abs(new - ratio) <= 1e-14 * max(ratio, 1e-300):
                    break
                ratio = new
    _, mean, _, q = parts(ratio)
    logliks = [-(loss(r) + n * (np.log(2.0 * np.pi) + 1.0)) / 2.0 for r in (ratio, 0.0)]
    return float(ratio), float(mean), q / n, max(logliks), logliks[1]


def mixed_model(scores: DataFrame) -> DataFrame:
    """Random subject intercept per factor by maximum likelihood, also if subjects have unequal numbers of rows.

    `scores(subject_id, factor, value)` gives (factor, mean, s_between, s_within, icc, loglik, loglik_pooled). Subjects are
    reduced to sums per factor and number of rows, so what is searched has as many entries as there are different numbers.
    Null values are left out. With fewer than two subjects, or one row in each, the variance between them is zero.
    """
    groups = _subject_groups(scores).filter("k > 0")
    grand = groups.groupBy("factor").agg((F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("grand"))
    gap = F.col("m") - F.col("grand")
    sizes = groups.join(grand, "factor").groupBy("factor", "grand", "k").agg(
        F.count(F.lit(1)).alias("a"), F.sum(gap).alias("s1"), F.sum(gap * gap).alias("s2"), F.sum("ssw").alias("ssw"))
    lists = sizes.groupBy("factor", "grand").agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("k", "a", "s1", "s2", "ssw")]))).alias("sizes"))

    @F.pandas_udf("ratio double, mean double, within double, loglik double, pooled double")
    def fit(k: pd.Series, a: pd.Series, s1: pd.Series, s2: pd.Series, ssw: pd.Series) -> pd.DataFrame:
        found = [profile_ratio(*map(np.asarray, row[:4]), float(np.sum(row[4]))) for row in zip(k, a, s1, s2, ssw)]
        return pd.DataFrame(found, columns=["ratio", "mean", "within", "loglik", "pooled"])

    out = lists.withColumn("f", fit(*[F.col(f"sizes.{c}") for c in ("k", "a", "s1", "s2", "ssw")]))
    return out.select(
        "factor", (F.col("grand") + F.col("f.mean")).alias("mean"), (F.col("f.ratio") * F.col("f.within")).alias("s_between"),
        F.col("f.within").alias("s_within"), (F.col("f.ratio") / (1.0 + F.col("f.ratio"))).alias("icc"), F.col("f.loglik").alias("loglik"),
        F.col("f.pooled").alias("loglik_pooled"))


def classify_icc(scores: DataFrame, bootstrap: int = 2000, seed: int = 42) -> DataFrame:
    """ICC, subject-bootstrap interval, likelihood-ratio diagnostic and trait/state/mixed class per factor.

    The ICC and its class come from the maximum-likelihood fit of a random subject intercept (`mixed_model`), for subjects
    with any numbers of rows; the bootstrap uses the moment estimator. The likelihood ratio compares that fit with the
    pooled mean; it is reported only.
    """
    groups = materialize(_subject_groups(scores))
    boots = _resampled_components(groups, bootstrap, seed)
    ci = boots.groupBy("factor").agg(
        F.percentile("icc", 0.025).alias("icc_ci_low"), F.percentile("icc", 0.975).alias("icc_ci_high")
    )
    likely = mixed_model(scores).select("factor", "icc", (2.0 * (F.col("loglik") - F.col("loglik_pooled"))).alias("lrt_stat"))
    tested = likely.withColumn("lrt_pval", boundary_lrt_udf("lrt_stat"))
    joined = bh_fdr(tested, [], "lrt_pval", "lrt_qval").join(ci, "factor")
    return joined.select(
        "factor", "icc", "icc_ci_low", "icc_ci_high", "lrt_stat", "lrt_pval", "lrt_qval",
        icc_class(F.col("icc")).alias("classification"),
    )


def adjusted_rand(pairs: DataFrame, a: str, b: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Adjusted Rand index of two labelings per group."""
    by = by or []
    n = F.sum(weight) if weight else F.count(F.lit(1))
    cells = pairs.groupBy(*by, a, b).agg(n.cast("double").alias("_n"))
    choose = lambda c: c * (c - 1.0) / 2.0
    inside = cells.groupBy(*by).agg(F.sum(choose(F.col("_n"))).alias("_ij"), F.sum("_n").alias("_t"))
    rows = cells.groupBy(*by, a).agg(F.sum("_n").alias("_x")).groupBy(*by).agg(F.sum(choose(F.col("_x"))).alias("_a"))
    cols = cells.groupBy(*by, b).agg(F.sum("_n").alias("_x")).groupBy(*by).agg(F.sum(choose(F.col("_x"))).alias("_b"))
    if by:
        joined = inside.join(rows, by).join(cols, by)
    else:
        joined = inside.withColumns({"_a": rows.scalar(), "_b": cols.scalar()})
    expected = F.col("_a") * F.col("_b") / F.nullif(choose(F.col("_t")), F.lit(0.0))
    top = (F.col("_a") + F.col("_b")) / 2.0
    return joined.select(
        *by, F.coalesce((F.col("_ij") - expected) / F.nullif(top - expected, F.lit(0.0)), F.lit(1.0)).alias("ari")
    )


def delta_sd_corr(deltas: DataFrame, min_pairs: int = 10) -> DataFrame:
    """SD of the monocyte and neutrophil deltas and the correlation of monocyte delta with ratio delta.

    `deltas(subject_id, mono, neu, ratio)`; the correlation is 0 below `min_pairs`.
    """
    both = F.col("mono").isNotNull() & F.col("ratio").isNotNull()
    r = F.corr(F.when(both, F.col("mono")), F.when(both, F.col("ratio")))
    return deltas.agg(
        F.count(F.lit(1)).alias("n_paired"), F.stddev_samp("mono").alias("sd_mono"), F.stddev_samp("neu").alias("sd_neu"),
        F.when(F.count_if(both) >= min_pairs, r).otherwise(F.lit(0.0)).alias("r"), F.count_if(both).alias("n_pairs"),
    )


# --- canonical correlation and linear probes ------------------------------------------------


def _cca_from(cov: np.ndarray, ka: int) -> float:
    """Largest canonical correlation from a joint covariance whose first `ka` variables form the first block."""
    aa, bb, ab = cov[:ka, :ka], cov[ka:, ka:], cov[:ka, ka:]

    def inverse_root(m: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(m)
        kept = values > 1e-10 * max(values.max(), 1e-300)
        return (vectors[:, kept] / np.sqrt(values[kept])) @ vectors[:, kept].T

    if np.trace(aa) <= 0 or np.trace(bb) <= 0:
        return 0.0
    return float(min(1.0, np.linalg.svd(inverse_root(aa) @ ab @ inverse_root(bb), compute_uv=False)[0]))


def cca_max(blocks: DataFrame, a: list[str], b: list[str], bootstrap: int = 500, seed: int = 42,
            subject: str = "subject_id") -> DataFrame:
    """Largest canonical correlation of column blocks a and b with a subject-bootstrap interval, as one row.

    0 when a block is empty or there are fewer than three subjects. A subject is
    one row with its copy count in every replicate; each task turns its rows into
    one joint moment matrix per replicate, and only those are shuffled.
    """
    spark = blocks.sparkSession
    cols = [*a, *b]
    n = blocks.count()
    if not a or not b or n < 3:
        return spark.range(1).select(*[F.lit(0.0).alias(c) for c in ("rho", "rho_ci_low", "rho_ci_high")])
    centre = blocks.agg(*[F.avg(c).alias(c) for c in cols]).first()
    x = F.array(*[(F.col(c) - F.lit(float(centre[c]))).cast("double") for c in cols])
    copies = bootstrap_counts(blocks.select(subject), bootstrap, seed, subject)
    counted = copies.groupBy(subject).agg(F.collect_list(F.struct("rep", "copies")).alias("c"))
    rows = blocks.select(subject, x.alias("x")).join(counted, subject, "left").select("x", "c.rep", "c.copies")
    k, ka = len(cols), len(a)

    def partial(batches):
        total = np.zeros((bootstrap + 1, 1 + k + k * k))
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                v = np.stack(part["x"].to_numpy())
                weight = np.zeros((bootstrap + 1, len(v)))
                weight[0] = 1.0
                for i, (reps, count) in enumerate(zip(part["rep"], part["copies"])):
                    if reps is not None and len(reps):
                        weight[np.asarray(reps, dtype=int), i] = count
                outer = (v[:, :, None] * v[:, None, :]).reshape(len(v), k * k)
                total += weight @ np.concatenate([np.ones((len(v), 1)), v, outer], axis=1)
        for rep, row in enumerate(total):
            yield pd.DataFrame({"rep": np.int32(rep), "slot": np.arange(len(row), dtype=np.int32), "value": row})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values("slot")["value"].to_numpy()
        mean = m[1 : 1 + k] / m[0]
        cov = m[1 + k :].reshape(k, k) / m[0] - np.outer(mean, mean)
        return pd.DataFrame({"rep": [pdf["rep"].iloc[0]], "rho": [_cca_from(cov, ka)]})

    # Tasks' moments are summed slot by slot; only a replicate's own 1 + k + k * k sums meet in one group.
    moments = rows.mapInPandas(partial, "rep int, slot int, value double").groupBy("rep", "slot").agg(F.sum("value").alias("value"))
    rho = moments.groupBy("rep").applyInPandas(solve, "rep int, rho double")
    return rho.agg(
        F.max(F.when(F.col("rep") == 0, F.col("rho"))).alias("rho"),
        F.percentile(F.when(F.col("rep") > 0, F.col("rho")), 0.025).alias("rho_ci_low"),
        F.percentile(F.when(F.col("rep") > 0, F.col("rho")), 0.975).alias("rho_ci_high"),
    )


def loo_linear_probe(points: DataFrame, target: str = "target", vector: str = "z") -> DataFrame:
    """Leave-one-out mean absolute error of a linear probe, from one fit: error = residual / (1 - leverage).

    Rows without a target are dropped; fewer than three rows give NULL.
    """
    used = points.filter(F.col(target).isNotNull() & ~F.isnan(target)).select(
        F.transform(vector, lambda v: v.cast("double")).alias("z"), F.col(target).cast("double").alias("t"))
    if used.limit(3).count() < 3:
        return used.agg(F.lit(None).cast("double").alias("loso_mae"), F.count(F.lit(1)).alias("n_subjects"))
    n, mean, cov = covariance(used.select(F.concat("z", F.array("t")).alias("z")))
    inverse = np.linalg.pinv(cov[:-1, :-1], rcond=1e-10)
    slope = inverse @ cov[:-1, -1]

    def error(z: pd.Series, t: pd.Series) -> pd.Series:
        gap = np.stack(z.to_numpy()) - mean[:-1]
        leverage = (1.0 + np.einsum("bi,ij,bj->b", gap, inverse, gap)) / n
        return pd.Series(np.abs((t.to_numpy() - mean[-1] - gap @ slope) / (1.0 - leverage)))

    errors = used.select(F.pandas_udf(error, "double")("z", "t").alias("e"))
    return errors.agg(F.avg("e").alias("loso_mae"), F.count(F.lit(1)).alias("n_subjects"))


def _partial_moments(panels: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """(panel, `name`): per distinct `panel` array, the flat cross-product of the `rows` (v) that have all its places.

    Places of `v` beyond the panels' features, the last ones, are always kept. An absent cell is null. Blocks of rows
    meet blocks of panels, both of bounded size, and what each pair of blocks yields is summed place by place, so neither
    side is gathered. Panels that no row covers have no row.
    """
    n, p = rows.count(), panels.count()
    if not n or not p:
        return panels.select("panel", F.lit(None).cast("array<double>").alias(name)).limit(0)
    width = len(rows.first()["v"])
    side = panels.agg(F.max(F.size("panel"))).first()[0] + 2
    row_blocks, panel_blocks = -(-n * width // BLOCK_CELLS), -(-p * side * side // BLOCK_CELLS)
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = panels.withColumn("_p", F.pmod(F.xxhash64("panel"), F.lit(panel_blocks)).cast("int")).withColumn("_r", each(row_blocks))
    right = rows.withColumn("_r", F.pmod(F.xxhash64("v"), F.lit(row_blocks)).cast("int")).withColumn("_p", each(panel_blocks))
    tail = 2 if name == "more_moves" else 1

    def sums(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"panel": pd.Series(dtype=object), "slot": np.empty(0, np.int32), "value": np.empty(0)})]
        if len(asked) and len(given):
            v = np.stack(given["v"].to_numpy())
            for places in asked["panel"]:
                part = v[:, np.append(np.asarray(places, dtype=int), np.arange(width - tail, width))]
                part = part[~np.isnan(part).any(axis=1)]
                if len(part):
                    flat = (part.T @ part).ravel()
                    out.append(pd.DataFrame({"panel": [places] * len(flat), "slot": np.arange(len(flat), dtype=np.int32), "value": flat}))
        return pd.concat(out[1:] or out)

    keys = ["_p", "_r"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(sums, "panel array<int>, slot int, value double")
    summed = parts.groupBy("panel", "slot").agg(F.sum("value").alias("value"))
    made = summed.groupBy("panel").agg(F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("_m"))
    return materialize(made.select("panel", F.col("_m.value").alias(name)))


def loo_probe_with_selection(
    features: DataFrame, targets: DataFrame, top: int, k: int, always: list | None = None, subject: str = "subject_id"
) -> DataFrame:
    """Leave-one-subject-out probe error with panel, factors and probe refitted without the held-out subject.

    `features(subject_id, visit 0/1, feature_id, value)`, `targets(subject_id, target)`. Panels come from left-out
    moments. A fold's feature and delta moments are those of all subjects minus the held-out subject's own, restricted to
    its panel, so no fold reads the table again: per subject one vector a visit over the union of the panels is kept, and
    the moments of that union (at most `GRAM_SIDE` features) are shared with the tasks. A fold takes every row that has
    its own panel's features: rows that lack a feature of the union add their moments once per distinct panel they cover
    (`_partial_moments`). A subject is predicted if it has a target and both visits with its panel; of cells given twice
    the greater value counts. Without such subjects the error is NULL and the count 0.
    """
    ranked = features.filter(~F.col("feature_id").isin(*always)) if always else features
    panel = loo_topk_variance(ranked.select(subject, "feature_id", "value"), top, subject)
    known = materialize(targets.filter(F.col("target").isNotNull()).select(subject, F.col("target").cast("double").alias("target")))
    panel = materialize(panel.join(small_side(known.select(subject)), subject, "left_semi").select(subject, "feature_id"))
    union = panel.select("feature_id").distinct()
    if always:
        union = union.unionByName(features.select("feature_id").filter(F.col("feature_id").isin(*always)).distinct()).distinct()
    ids = [r[0] for r in collect_bounded(union, GRAM_SIDE, "features of all panels")]
    u, at = len(ids), {f: i for i, f in enumerate(sorted(ids))}
    place = features.sparkSession.createDataFrame(
        list(at.items()), T.StructType([features.schema["feature_id"], T.StructField("_i", T.IntegerType())]))
    fixed = [at[f] for f in always or [] if f in at]
    cells = features.join(F.broadcast(place), "feature_id").filter(F.col("value").isNotNull())
    rows = cells.groupBy(subject, "visit").agg(F.array_sort(F.collect_list(F.struct("_i", F.col("value").cast("double").alias("v")))).alias("p"))

    @F.pandas_udf("array<double>")
    def spread(places: pd.Series, values: pd.Series) -> pd.Series:
        out = np.full((len(places), u), np.nan)
        for i, (at_, v) in enumerate(zip(places, values)):
            out[i, np.asarray(at_, dtype=int)] = v
        return pd.Series(list(out))

    rows = materialize(rows.select(subject, "visit", F.transform(spread("p._i", "p.v"), lambda v: F.nanvl(v, F.lit(None))).alias("x")))
    empty = features.sparkSession.range(1).select(F.lit(None).cast("double").alias("loso_mae"), F.lit(0).cast("long").alias("n_subjects"))
    if u == 0 or rows.isEmpty():
        return empty
    # A centre near the means keeps the sums exact; cells that are absent do not count.
    means = rows.select(F.posexplode("x").alias("i", "v")).filter("v is not null").groupBy("i").agg(F.avg("v").alias("m")).collect()
    centre = np.zeros(u)
    centre[[r["i"] for r in means]] = [r["m"] for r in means]
    away = F.zip_with("x", C.literal_vector(centre), lambda a, b: a - b)
    rows = materialize(rows.select(subject, "visit", away.alias("x")))
    one, full = F.array(F.lit(1.0)), lambda x: ~F.exists(x, F.isnull)
    whole = rows.filter(full("x"))
    all_rows = cross_product(whole.select(F.concat("x", one).alias("v")), "v") if not whole.isEmpty() else np.zeros((u + 1, u + 1))
    pairs = rows.groupBy(subject).agg(
        F.max_by("x", F.when(F.col("visit") == 0, 1)).alias("pre"), F.max_by("x", F.when(F.col("visit") == 1, 1)).alias("post"))
    pairs = materialize(pairs.join(small_side(known), subject, "left"))
    fit = pairs.filter("pre is not null and post is not null and target is not null")
    moved = F.zip_with("post", "pre", lambda a, b: a - b)
    moves = materialize(fit.select(F.concat(moved, F.array("target"), one).alias("v")))
    whole_moves = moves.filter(full("v"))
    all_deltas = cross_product(whole_moves, "v") if not whole_moves.isEmpty() else np.zeros((u + 2, u + 2))
    shared = features.sparkSession.sparkContext.broadcast((all_rows, all_deltas))
    own = panel.join(F.broadcast(place), "feature_id").groupBy(subject).agg(F.collect_set("_i").alias("panel"))
    use = F.array_sort(F.array_union(F.coalesce("panel", F.array().cast("array<int>")), F.array(*map(F.lit, fixed)).cast("array<int>")))
    folds = materialize(fit.join(own, subject, "left").select("pre", "post", "target", use.alias("panel")))
    panels = materialize(folds.select("panel").distinct())
    more = _partial_moments(panels, rows.filter(~full("x")).select(F.concat("x", one).alias("v")), "more_rows").join(
        _partial_moments(panels, moves.filter(~full("v")), "more_moves"), "panel", "full")
    folds = folds.join(more, "panel", "left")

    def refit(batches):
        total, deltas = shared.value
        for pdf in batches:
            errors = []
            for pre, post, y, own, rest, moved in zip(pdf["pre"], pdf["post"], pdf["target"], pdf["panel"], pdf["more_rows"], pdf["more_moves"]):
                use = np.asarray(own, dtype=int)
                held = np.stack([np.append(x[use], 1.0) for x in (pre, post)])
                if np.isnan(held).any():
                    errors.append(np.nan)
                    continue
                cut = np.append(use, u)
                m = total[np.ix_(cut, cut)] - held.T @ held
                if rest is not None:
                    m += np.asarray(rest, dtype=float).reshape(m.shape)
                n, mean = m[-1, -1], m[-1, :-1] / max(m[-1, -1], 1.0)
                cov = m[:-1, :-1] / max(n, 1.0) - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
                sd = np.where(sd > 1e-12 * max(sd.max(initial=0.0), 1e-300), sd, 1.0)
                axes = np.linalg.eigh(cov / np.outer(sd, sd))[1][:, ::-1][:, : min(k, max(int(round(n)) - 1, 0), len(use))] / sd[:, None]
                delta = np.concatenate([(post - pre)[use], [y, 1.0]])
                cut = np.concatenate([use, [u, u + 1]])
                d = deltas[np.ix_(cut, cut)] - np.outer(delta, delta)
                if moved is not None:
                    d += np.asarray(moved, dtype=float).reshape(d.shape)
                count = d[-1, -1]
                if count < 2.5:
                    errors.append(np.nan)
                    continue
                mx, my = d[-1, :-2] / count, d[-1, -2] / count
                scatter, cross = d[:-2, :-2] / count - np.outer(mx, mx), d[:-2, -2] / count - mx * my
                slope = np.linalg.pinv(axes.T @ scatter @ axes, rcond=1e-10) @ (axes.T @ cross)
                errors.append(abs(y - my - (delta[:-2] - mx) @ axes @ slope))
            yield pd.DataFrame({"error": np.array(errors, dtype=float)})

    errors = folds.mapInPandas(refit, "error double")
    kept = F.when(~F.isnan("error"), F.col("error"))
    return errors.agg(F.avg(kept).alias("loso_mae"), F.count(kept).alias("n_subjects"))


# --- axes ------------------------------------------------------------------------------------


def recovery_axis(deltas: DataFrame, flag: str = "responder", vector: str = "z") -> DataFrame:
    """First principal direction of the flagged rows, pointing along their mean, as one row `axis`."""
    rows = deltas.filter(F.col(flag))
    if rows.limit(2).count() < 2:
        raise ValueError("the recovery axis needs at least two responders")
    _, mean, cov = covariance(rows, vector)
    axis = np.linalg.eigh(cov)[1][:, -1]
    axis = -axis if axis @ mean < 0 else axis
    return deltas.sparkSession.range(1).select(C.literal_vector(axis / (np.linalg.norm(axis) + 1e-12)).alias("axis"))


def two_anchor_axis(clouds: DataFrame, toward: str, away: str, min_toward: int = 10, min_away: int = 5,
                    vector: str = "z") -> DataFrame:
    """Unit vector from the centroid of cloud `away` to that of cloud `toward`, as one row `axis`."""
    means = {
        r["cloud"]: (r["n"], np.array(r["centroid"]))
        for r in collect_bounded(
            vector_mean(clouds.filter(F.col("cloud").isin(toward, away)), ["cloud"], vector), 2, "anchor clouds")
    }
    for name, minimum in ((toward, min_toward), (away, min_away)):
        if means.get(name, (0, None))[0] < minimum:
            raise ValueError(f"cloud {name} has fewer than {minimum} rows")
    gap = means[toward][1] - means[away][1]
    length = float(np.linalg.norm(gap))
    if length < 1e-12:
        raise ValueError("the two centroids coincide")
    return clouds.sparkSession.range(1).select(C.literal_vector(gap / length).alias("axis"))


def axis_projection(termini: DataFrame, axis: DataFrame, vector: str = "z", out: str = "recovery_score") -> DataFrame:
    """Dot product of every row vector with the axis; a width mismatch raises."""
    if vector_width(termini, vector) != vector_width(axis, "axis"):
        raise ValueError("termini and axis live in different dimensions")
    placed = termini.withColumn("_axis", axis.select("axis").scalar())
    return placed.withColumn(out, C.dot(F.col(vector), F.col("_axis"))).drop("_axis")


def trajectory_consistency(deltas: DataFrame, axis: DataFrame, flag: str = "responder", vector: str = "z") -> DataFrame:
    """Mean and SD of the cosine to the axis for responders and others, and the difference of means."""
    cos = C.dot(C.unit_vector(F.col(vector)), F.col("_axis"))
    rows = deltas.withColumn("_axis", axis.select("axis").scalar()).select(F.col(flag).alias("f"), cos.alias("c"))
    yes, no = F.when(F.col("f"), F.col("c")), F.when(~F.col("f"), F.col("c"))
    zero = F.lit(0.0)
    return rows.agg(
        F.coalesce(F.avg(yes), zero).alias("responder_mean_cos"), F.coalesce(F.stddev_pop(yes), zero).alias("responder_sd_cos"),
        F.coalesce(F.avg(no), zero).alias("nonresponder_mean_cos"), F.coalesce(F.stddev_pop(no), zero).alias("nonresponder_sd_cos"),
        F.coalesce(F.avg(yes) - F.avg(no), zero).alias("difference"),
    )


def across_seed_consistency(runs: DataFrame, subject: str = "subject_id", run: str = "run", vector: str = "z",
                            threshold: float = 0.5) -> DataFrame:
    """Median and 5th percentile of the cosine of a subject's vectors over all pairs of runs.

    A subject's runs are few (training seeds); their pairs are formed inside one row.
    """
    if runs.select(run).distinct().limit(2).count() < 2:
        raise ValueError("needs at least two runs")
    unit = runs.select(subject, run, C.unit_vector(F.col(vector)).alias("v"))
    per = unit.groupBy(subject).agg(F.sort_array(F.collect_list(F.struct(run, "v"))).alias("r"))
    pairs = F.flatten(F.transform("r", lambda a, i: F.transform(
        F.filter("r", lambda b: b[run] > a[run]), lambda b: C.dot(a["v"], b["v"]))))
    cos = per.select(F.explode(pairs).alias("c"))
    return cos.agg(F.percentile("c", 0.5).alias("median"), F.percentile("c", 0.05).alias("p05"), F.count("c").alias("n_pairs")).withColumn(
        "passed", F.col("median") >= threshold
    )
