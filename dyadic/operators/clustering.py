"""Diagonal Gaussian mixtures fitted for many models at once, and trajectory archetypes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.operators.moments import vector_width
from dyadic.operators.multivariate import adjusted_rand
from dyadic.operators.resample import bootstrap_counts
from dyadic.operators.ranking import top_n
from dyadic.session import collect_bounded, materialize, spread

VARIANCE_FLOOR = 1e-6


@dataclass
class Mixture:
    """Parameters of M mixtures padded to K components."""

    log_share: np.ndarray  # M x K, -inf for unused components
    mean: np.ndarray  # M x K x d
    var: np.ndarray  # M x K x d

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the means, rows x M x K; infinite for unused components."""
        m, k, d = self.mean.shape
        mu = self.mean.reshape(m * k, d)
        square = (x**2).sum(axis=1)[:, None] - 2.0 * x @ mu.T + (mu**2).sum(axis=1)
        return np.maximum(square, 0.0).reshape(len(x), m, k) + np.where(np.isinf(self.log_share), np.inf, 0.0)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log share + log density, rows x M x K."""
        m, k, d = self.mean.shape
        inv = (1.0 / self.var).reshape(m * k, d)
        mu = self.mean.reshape(m * k, d)
        square = x**2 @ inv.T - 2.0 * x @ (mu * inv).T + (mu**2 * inv).sum(axis=1)
        const = np.log(self.var).sum(axis=2).reshape(m * k) + d * np.log(2 * np.pi)
        return (-0.5 * (square + const)).reshape(len(x), m, k) + self.log_share


def _sums(points: DataFrame, mix: Mixture, hard: bool, weights: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One pass for all models: component weights, first and second moments, log-likelihoods.

    A task returns one row of m k (2 d + 1) + m sums, whatever its rows; they are added on the driver.

    `w` of `points` has `weights` entries; each is used by as many consecutive models of `mix` as that takes.
    """
    m, k, d = mix.mean.shape

    def per_batch(batches):
        total = np.zeros(m * k * (1 + 2 * d) + m)
        for pdf in batches:
            if not len(pdf):
                continue
            x, w = np.stack(pdf["z"].to_numpy()).astype(float), np.repeat(np.stack(pdf["w"].to_numpy()).astype(float), m // weights, axis=1)
            joint = mix.log_joint(x)
            peak = joint.max(axis=2, keepdims=True)
            norm = peak[:, :, 0] + np.log(np.exp(joint - peak).sum(axis=2))
            if hard:
                resp = np.eye(k)[mix.gaps(x).argmin(axis=2)]
            else:
                resp = np.exp(joint - norm[:, :, None])
            resp = resp * w[:, :, None]
            flat = resp.reshape(len(x), m * k)
            total += np.concatenate(
                [flat.sum(axis=0), (flat.T @ x).ravel(), (flat.T @ x**2).ravel(), (norm * w).sum(axis=0)])
        yield pd.DataFrame({"sums": [total.tobytes()]})

    # One row of sums per task, added up here: a round is one short job without a shuffle.
    parts = points.select("z", "w").mapInPandas(per_batch, "sums binary").collect()
    out = np.sum([np.frombuffer(row["sums"]) for row in parts], axis=0)
    cut = m * k
    return (out[:cut].reshape(m, k), out[cut : cut + cut * d].reshape(m, k, d),
            out[cut + cut * d : cut + 2 * cut * d].reshape(m, k, d), out[-m:])


def _update(mix: Mixture, weight: np.ndarray, first: np.ndarray, second: np.ndarray) -> Mixture:
    unused = np.isinf(mix.log_share)
    safe = np.where(weight > 1e-10, weight, 1.0)[:, :, None]
    mean = np.where(weight[:, :, None] > 1e-10, first / safe, mix.mean)
    var = np.where(weight[:, :, None] > 1e-10, np.maximum(second / safe - mean**2, 0.0), mix.var - VARIANCE_FLOOR) + VARIANCE_FLOOR
    share = np.log(np.maximum(weight / weight.sum(axis=1, keepdims=True), 1e-300))
    return Mixture(np.where(unused, -np.inf, share), mean, var)


def _farthest(points: DataFrame, mix: Mixture, take: np.ndarray, seed: int, step: int, weights: int, id_col: str) -> dict[int, list]:
    """`take[i]` rows for model i, drawn without replacement by weight times squared distance to the nearest mean.

    A row's key is an exponential draw over its rate, and the least keys win: every task hands on its own least ones only.
    Draws are hashes of (seed, step, model, id). Before the first mean the rate is the weight alone.
    """
    m, k, d = mix.mean.shape
    first = np.isinf(mix.log_share).all()
    id_type = points.schema[id_col].dataType
    draws = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(step), F.lit(i), F.col(id_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52) for i in range(m)]

    def per_batch(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, w = np.stack(pdf["z"].to_numpy()).astype(float), np.repeat(np.stack(pdf["w"].to_numpy()).astype(float), m // weights, axis=1)
            rate = w if first else w * mix.gaps(x).min(axis=2)
            with np.errstate(divide="ignore"):
                key = np.where(rate > 0, -np.log(np.stack(pdf["u"].to_numpy())) / rate, np.inf)
            least = [np.argsort(key[:, i], kind="stable")[: take[i]] for i in range(m)]
            model = np.repeat(np.arange(m, dtype=np.int32), [len(at) for at in least])
            at = np.concatenate(least)
            kept = np.isfinite(key[at, model])
            model, at = model[kept], at[kept]
            if len(at):
                yield pd.DataFrame({"model": model, "key": key[at, model], "id": pdf["id"].iloc[at].to_numpy(), "z": list(x[at])})

    schema = T.StructType([T.StructField("model", T.IntegerType()), T.StructField("key", T.DoubleType()),
                           T.StructField("id", id_type), T.StructField("z", T.ArrayType(T.DoubleType()))])
    drawn = points.select(F.col(id_col).alias("id"), "z", "w", F.array(*draws).alias("u")).mapInPandas(per_batch, schema)
    found: dict[int, list] = {}
    for row in collect_bounded(top_n(drawn, ["model"], [F.col("key"), F.col("id")], int(take.max()), "_at"), m * int(take.max()), "mixture seeds"):
        if row["_at"] <= take[row["model"]]:
            found.setdefault(row["model"], []).append(np.array(row["z"]))
    return found


def _thinned(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k of the few weighted candidates by distance-weighted draws, moved to their centres of weight."""
    chosen = [x[rng.choice(len(x), p=weight / weight.sum())]]
    while len(chosen) < k:
        rate = weight * ((x[:, None, :] - np.array(chosen)[None]) ** 2).sum(axis=2).min(axis=1)
        chosen.append(x[rng.choice(len(x), p=rate / rate.sum())] if rate.sum() > 0 else chosen[0])
    centre = np.array(chosen)
    for _ in range(rounds):
        near = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        for j in range(k):
            mine = weight * (near == j)
            if mine.sum() > 0:
                centre[j] = mine @ x / mine.sum()
    return centre


def seed_means(points: DataFrame, ks: list[int], seed: int, weights: int, id_col: str, passes: int = 3) -> np.ndarray:
    """Starting means of every model (models x largest k x d) by oversampled distance-weighted seeding.

    A row drawn by weight, then `passes` rounds of 2k rows each drawn by squared distance to those at hand; the candidates
    are weighed by the rows next to them and thinned to k.
    """
    m, k, d = len(ks), max(ks), vector_width(points, "z")
    held: list[list] = [[] for _ in range(m)]

    def mixture() -> Mixture:
        width = max(1, max(map(len, held)))
        mean, share = np.zeros((m, width, d)), np.full((m, width), -np.inf)
        for i, rows in enumerate(held):
            if rows:
                mean[i, : len(rows)], share[i, : len(rows)] = rows, 0.0
        return Mixture(share, mean, np.ones((m, width, d)))

    for step in range(passes + 1):
        take = np.array([1 if step == 0 else 2 * each for each in ks])
        for i, rows in _farthest(points, mixture(), take, seed, step, weights, id_col).items():
            held[i] += rows
    near = _sums(points, mixture(), True, weights)[0]
    rng, mean = np.random.default_rng(seed), np.zeros((m, k, d))
    for i, rows in enumerate(held):
        if rows:
            weight = near[i, : len(rows)]
            mean[i, : ks[i]] = _thinned(np.array(rows), weight if weight.sum() > 0 else np.ones(len(rows)), ks[i], rng)
    return mean


def fit_mixtures(points: DataFrame, ks: list[int], seed: int = 42, id_col: str = "subject_id", lloyd: int = 8,
                 iterations: int = 100, tolerance: float = 1e-3, starts: int = 4) -> tuple[Mixture, np.ndarray, bool]:
    """EM for model i with ks[i] components on rows weighted by w[i]; returns parameters, log-likelihoods and whether
    every model's gain per row fell below `tolerance` within `iterations` rounds.

    All models advance in the same pass over the data, each from `starts` seedings refined by hard assignments; the start
    of the best likelihood is returned.
    """
    models, d = len(ks), vector_width(points, "z")
    ks = [each for each in ks for _ in range(starts)]
    m, k = len(ks), max(ks)
    stats = points.agg(*[F.var_pop(F.col("z")[i]).alias(f"v{i}") for i in range(d)]).first()
    spread = np.maximum(np.array([stats[f"v{i}"] or 0.0 for i in range(d)]), VARIANCE_FLOOR)
    share = np.where(np.arange(k)[None, :] < np.array(ks)[:, None], -np.log(np.array(ks, dtype=float))[:, None], -np.inf)
    mix = Mixture(share, seed_means(points, ks, seed, models, id_col), np.tile(spread, (m, k, 1)))
    for _ in range(lloyd):
        weight, first, second, _ = _sums(points, mix, True, models)
        moved = _update(mix, weight, first, second)
        still = np.allclose(moved.mean, mix.mean)
        mix = moved
        if still:
            break
    last = np.full(m, -np.inf)
    rows, converged = None, np.zeros(m, dtype=bool)
    for _ in range(iterations):
        weight, first, second, loglik = _sums(points, mix, False, models)
        rows = weight.sum(axis=1) if rows is None else rows
        converged = np.abs(loglik - last) / rows < tolerance
        if converged.all():
            break
        last = loglik
        mix = _update(mix, weight, first, second)
    best = loglik.reshape(models, starts).argmax(axis=1) + np.arange(models) * starts
    return Mixture(mix.log_share[best], mix.mean[best], mix.var[best]), loglik[best], bool(converged[best].all())


def assign(points: DataFrame, mix: Mixture, keep: list[str], out: str = "cluster") -> DataFrame:
    """Most likely component of every row under each model, as an array over models."""

    def label(z: pd.Series) -> pd.Series:
        return pd.Series(list(mix.log_joint(np.stack(z.to_numpy()).astype(float)).argmax(axis=2).astype(np.int32)))

    return points.select(*keep, F.pandas_udf(label, "array<int>")("z").alias(out))


def cluster_archetypes(deltas: DataFrame, k_grid=(2, 3, 4, 5), bootstrap: int = 10, seed: int = 42,
                       subject: str = "subject_id", vector: str = "z", min_size: int = 10) -> dict[str, DataFrame]:
    """Mixture by BIC over the grid, stability by bootstrap ARI, and cluster sizes.

    Passes with at least three clusters, mean ARI of at least .5 and every cluster
    of `min_size` subjects or more. `converged` says whether all fits settled.
    """
    # Stored once, over all tasks: every pass reads the rows again, and a small table or a coalesced join is one task's.
    base = materialize(spread(deltas.select(subject, F.transform(vector, lambda v: v.cast("double")).alias("z")), subject))
    n = base.count()
    ks = [k for k in k_grid if k < n]
    grid = base.withColumn("w", F.array(*[F.lit(1.0) for _ in ks])).persist(StorageLevel.MEMORY_AND_DISK)
    mix, loglik, settled = fit_mixtures(grid, ks, seed, subject)
    d = mix.mean.shape[2]
    bic = [-2.0 * loglik[i] + (2 * k * d + k - 1) * np.log(n) for i, k in enumerate(ks)]
    best = int(np.argmin(bic))
    labels = materialize(assign(grid, mix, [subject]).select(subject, F.col("cluster")[best].alias("cluster")))
    grid.unpersist()

    copies = bootstrap_counts(base.select(subject), bootstrap, seed, subject)
    weights = copies.groupBy(subject).agg(F.map_from_entries(F.collect_list(F.struct("rep", "copies"))).alias("_c"))
    resampled = spread(base.join(weights, subject, "left").select(
        subject, "z", F.array(*[F.coalesce(F.element_at("_c", F.lit(r + 1)), F.lit(0)).cast("double") for r in range(bootstrap)]).alias("w")
    ), subject).persist(StorageLevel.MEMORY_AND_DISK)
    boot, _, boot_settled = fit_mixtures(resampled, [ks[best]] * bootstrap, seed + 1, subject)
    tagged = assign(resampled, boot, [subject, "w"], "boot").select(
        subject, F.posexplode(F.arrays_zip("boot", "w")).alias("rep", "_bw")).select(
        subject, "rep", F.col("_bw.boot").alias("boot"), F.col("_bw.w").alias("w")).filter(F.col("w") > 0)
    tagged = materialize(tagged)
    resampled.unpersist()
    ari = adjusted_rand(tagged.join(labels, subject), "cluster", "boot", ["rep"], "w")
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    smallest = sizes.agg(F.min("size")).scalar()
    summary = ari.agg(F.avg("ari").alias("bootstrap_ari_mean"), F.stddev_pop("ari").alias("bootstrap_ari_sd")).select(
        F.lit(ks[best]).alias("best_k"), "bootstrap_ari_mean", "bootstrap_ari_sd",
        ((F.lit(ks[best]) >= 3) & (F.col("bootstrap_ari_mean") >= 0.5) & (smallest >= min_size)).alias("passed"),
        F.lit(settled and boot_settled).alias("converged"),
    )
    spark = deltas.sparkSession
    return {"summary": summary, "labels": labels, "sizes": sizes,
            "bic": spark.createDataFrame([(k, float(b)) for k, b in zip(ks, bic)], "k int, bic double")}
