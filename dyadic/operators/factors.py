"""Factor model of several views with relevance determination, fitted by variational updates over the long table."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.tails import digamma
from dyadic.operators.multivariate import pca_long
from dyadic.session import BROADCAST_BYTES, materialize, small_side

# Shape and rate of the gamma priors of all precisions.
PRIOR = 1e-3


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _packed(matrices: np.ndarray) -> np.ndarray:
    rows, cols = np.triu_indices(matrices.shape[-1])
    return matrices[:, rows, cols]


def _square(packed: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(packed), k, k))
    rows, cols = np.triu_indices(k)
    out[:, rows, cols] = out[:, cols, rows] = packed
    return out


def _sums(values: list, name: str):
    return F.array(*[F.sum(v) for v in values]).alias(name)


def _side(df: DataFrame, rows: int, k: int) -> DataFrame:
    """`df` for a broadcast if its rows of K + K(K+1)/2 numbers are within the bound; otherwise Spark shuffles."""
    return F.broadcast(df) if rows * 8 * (k * (k + 3) // 2 + 8) <= BROADCAST_BYTES else df


def _weights(k: int, relevance: dict[str, np.ndarray], prior: float):
    """Per feature, from its sums over the samples: posterior of its loadings and its noise."""

    @F.pandas_udf("u array<double>, uu array<double>, tau double, logdet double, q double, gain double")
    def run(view: pd.Series, zz: pd.Series, zy: pd.Series, yy: pd.Series, n: pd.Series, tau: pd.Series) -> pd.DataFrame:
        g, sy, t = _square(np.stack(zz), k), np.stack(zy), tau.to_numpy()
        precision = t[:, None, None] * g
        precision[:, range(k), range(k)] += np.stack([relevance[v] for v in view])
        c = np.linalg.inv(precision)
        u = t[:, None] * np.einsum("dij,dj->di", c, sy)
        uu = c + u[:, :, None] * u[:, None, :]
        q = np.maximum(yy.to_numpy() - 2 * (u * sy).sum(1) + (uu * g).sum((1, 2)), 0.0)
        a, b = prior + n.to_numpy() / 2, prior + q / 2
        log_tau, mean = digamma(a) - np.log(b), a / b
        lgamma = np.array([math.lgamma(x) for x in a])
        gain = n.to_numpy() / 2 * (log_tau - math.log(2 * math.pi)) - mean * q / 2
        gain += prior * math.log(prior) - math.lgamma(prior) + (prior - 1) * log_tau - prior * mean
        gain += a - np.log(b) + lgamma + (1 - a) * digamma(a)
        return pd.DataFrame({"u": list(u), "uu": list(_packed(uu)), "tau": mean, "logdet": np.linalg.slogdet(c)[1], "q": q, "gain": gain})

    return run


def _positions(k: int):
    """Per sample, from its sums over the features: posterior of its scores."""

    @F.pandas_udf("z array<double>, zz array<double>, kept double")
    def run(ww: pd.Series, wy: pd.Series) -> pd.DataFrame:
        s = np.linalg.inv(_square(np.stack(ww), k) + np.eye(k))
        z = np.einsum("nij,nj->ni", s, np.stack(wy))
        kept = 0.5 * (np.linalg.slogdet(s)[1] + k - np.trace(s, axis1=1, axis2=2) - (z * z).sum(1))
        return pd.DataFrame({"z": list(z), "zz": list(_packed(s + z[:, :, None] * z[:, None, :])), "kept": kept})

    return run


def _turn(zz: np.ndarray, ww: list[tuple[int, np.ndarray]], n: int, prior: float) -> np.ndarray | None:
    """A K x K matrix for the scores (its inverse for the loadings) that raises the bound, or None.

    The likelihood does not see it, so only the priors decide: the scores are made white, then planes are rotated until
    the loadings of each view load on as few factors as they can. From the moments of the scores and of each view's
    (features, loadings).
    """
    k = len(zz)

    def gain(a: np.ndarray) -> float:
        back = np.linalg.inv(a)
        out = (n - sum(d for d, _ in ww)) * np.linalg.slogdet(a)[1] - np.trace(a @ zz @ a.T) / 2
        return out - sum((prior + d / 2) * np.log(prior + np.diag(back.T @ m @ back) / 2).sum() for d, m in ww)

    size, axes = np.linalg.eigh(zz / n)
    if size[0] <= 1e-12 * size[-1]:
        return None
    white = (axes / np.sqrt(size)) @ axes.T
    back = np.linalg.inv(white)
    held = [(prior + d / 2, back.T @ m @ back) for d, m in ww]
    turned = np.eye(k)
    angles = np.linspace(-math.pi / 4, math.pi / 4, 91)
    for _ in range(20):
        moved = 0.0
        for i, j in _pairs(k):
            if i == j:
                continue

            def cost(t, i=i, j=j):
                c, s = np.cos(t), np.sin(t)
                return sum(w * (np.log(prior + (c * c * m[i, i] + s * s * m[j, j] + 2 * c * s * m[i, j]) / 2)
                                + np.log(prior + (s * s * m[i, i] + c * c * m[j, j] - 2 * c * s * m[i, j]) / 2)) for w, m in held)

            best = 0.0
            for grid in (angles, angles / 45, angles / 2025):
                tried = best + grid
                at = int(np.argmin(cost(tried)))
                if cost(tried[at]) < cost(best):
                    best = float(tried[at])
            if abs(best) > 1e-6:
                g = np.eye(k)
                g[[i, j], [i, j]], g[j, i], g[i, j] = math.cos(best), math.sin(best), -math.sin(best)
                held, turned, moved = [(w, g.T @ m @ g) for w, m in held], turned @ g, max(moved, abs(best))
        if moved < 1e-4:
            break
    a = turned.T @ white
    return a if gain(a) > gain(np.eye(k)) else None


def _turned(a: np.ndarray):
    k, log = len(a), float(np.linalg.slogdet(a)[1])

    @F.pandas_udf("z array<double>, zz array<double>, kept double")
    def run(z: pd.Series, zz: pd.Series, kept: pd.Series) -> pd.DataFrame:
        old = _square(np.stack(zz), k)
        new = a @ old @ a.T
        change = log + (np.trace(old, axis1=1, axis2=2) - np.trace(new, axis1=1, axis2=2)) / 2
        return pd.DataFrame({"z": list(np.stack(z) @ a.T), "zz": list(_packed(new)), "kept": kept + change})

    return run


def factor_model(views: DataFrame, k: int, rounds: int = 100, tolerance: float = 1e-6, start: DataFrame | None = None,
                 sample: str = "obs_id", prior: float = PRIOR, turn: bool = True) -> dict[str, DataFrame]:
    """Factors shared by views, or private to some, with surplus factors switched off view by view.

    `views(view, sample, feature_id, value)`; a cell, a feature or a whole view may be missing for a sample, and what is
    there is all that counts. Features are centred and a view is divided by its root mean square. A value is the product
    of scores with prior N(0, 1) and loadings with one precision per view and factor, plus noise with one precision per
    feature. Each round takes two groups of sums over the long table, per feature over the scores' moments and per sample
    over the loadings' moments, and a K x K solve per group; only K x K moments a view and the bound reach the driver. Rounds
    end when the lower bound of the likelihood grows by less than `tolerance` of its size. With `turn` the factors are also
    rotated each round to where the priors are likeliest, which the updates alone approach very slowly.

    Scores begin at the principal components, or at `start(sample, z array)`. Null values are missing; a feature that is
    constant stays at zero. Result: `scores(sample, factor, value)`, `loadings(view, feature_id, factor, loading, noise)`,
    `activity(view, factor, precision, r2)` with the share of the view's squares that a factor takes, and `bounds(round,
    bound)`. An empty table raises ValueError.
    """
    spark = views.sparkSession
    present = materialize(views.filter(F.col("value").isNotNull()).select("view", F.col(sample).alias("s"), "feature_id", "value"))
    means = present.groupBy("view", "feature_id").agg(F.avg("value").alias("_m"))
    centred = present.join(small_side(means), ["view", "feature_id"]).withColumn("value", F.col("value") - F.col("_m")).drop("_m")
    scales = centred.groupBy("view").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("_s"))
    y = F.coalesce(F.col("value") / F.nullif("_s", F.lit(0.0)), F.lit(0.0))
    cells = materialize(centred.join(F.broadcast(scales), "view").select("view", "s", "feature_id", y.alias("y")))  # a row a view
    n, p = cells.agg(F.countDistinct("s"), F.countDistinct("view", "feature_id")).first()
    if not n:
        raise ValueError("no values to fit factors to")
    if start is None:
        wide = cells.select("s", F.struct("view", "feature_id").alias("feature_id"), F.col("y").alias("value"))
        found = pca_long(wide, k, "s")
        sizes = [r.variance for r in found["explained"].orderBy("component").collect()]
        k = len(sizes)
        first = F.array(*[F.col("scores")[j] / F.lit(math.sqrt(v) if v > 0 else 1.0) for j, v in enumerate(sizes)])
        begin = found["scores"].select("s", first.alias("z"))
    else:
        begin = start.select(F.col(sample).alias("s"), "z")
    z = materialize(begin.select("s", "z", F.array(*[F.col("z")[i] * F.col("z")[j] for i, j in _pairs(k)]).alias("zz"),
                                 F.lit(0.0).alias("kept")))
    kinds = [r.view for r in scales.select("view").collect()]
    relevance = {v: np.ones(k) for v in kinds}
    tau, bounds, loads = None, [], []
    everything = k * (k + 1) // 2
    for number in range(rounds):
        if turn and loads:
            zz = _square(np.array([z.agg(_sums([F.col("zz")[i] for i in range(everything)], "zz")).first().zz]), k)[0]
            a = _turn(zz, [(d, m) for _, d, m in loads], n, prior)
            if a is not None:
                z = materialize(z.select("s", _turned(a)("z", "zz", "kept").alias("p")).select("s", "p.*"))
                back = np.linalg.inv(a)
                relevance = {v: (prior + d / 2) / (prior + np.diag(back.T @ m @ back) / 2) for v, d, m in loads}
        groups = cells.join(_side(z, n, k), "s").groupBy("view", "feature_id").agg(
            _sums([F.col("zz")[i] for i in range(everything)], "zz"), _sums([F.col("z")[i] * F.col("y") for i in range(k)], "zy"),
            F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).alias("n"))
        groups = groups.withColumn("tau", F.lit(1.0)) if tau is None else groups.join(tau, ["view", "feature_id"])
        solved = groups.withColumn("w", _weights(k, relevance, prior)("view", "zz", "zy", "yy", "n", "tau"))
        w = materialize(solved.select("view", "feature_id", "w.*"))
        tau = w.select("view", "feature_id", "tau")
        bound = z.agg(F.sum("kept")).first()[0]
        loads = []
        for row in w.groupBy("view").agg(F.count(F.lit(1)).alias("d"), F.sum(F.col("logdet") / 2 + F.col("gain")).alias("part"),
                                         _sums([F.col("uu")[i] for i in range(everything)], "ww")).collect():
            loads.append((row.view, row.d, _square(np.array([row.ww]), k)[0]))
            own = np.diag(loads[-1][2])
            a, b = prior + row.d / 2, prior + own / 2
            log_alpha, relevance[row.view] = float(digamma(np.array([a]))[0]) - np.log(b), a / b
            bound += row.part + row.d * k / 2 + float((row.d * log_alpha / 2 - relevance[row.view] * own / 2).sum())
            bound += float((prior * math.log(prior) - math.lgamma(prior) + (prior - 1) * log_alpha - prior * relevance[row.view]
                            + a - np.log(b) + math.lgamma(a) + (1 - a) * digamma(np.array([a]))[0]).sum())
        if number:  # the start has no spread and so no bound
            bounds.append(float(bound))
        t = F.col("tau")
        sums = cells.join(_side(w.select("view", "feature_id", "u", "uu", "tau"), p, k), ["view", "feature_id"]).groupBy("s").agg(
            _sums([t * F.col("uu")[i] for i in range(everything)], "ww"), _sums([t * F.col("u")[i] * F.col("y") for i in range(k)], "wy"))
        z = materialize(sums.select("s", _positions(k)("ww", "wy").alias("p")).select("s", "p.*"))
        if len(bounds) > 1 and bounds[-1] - bounds[-2] <= tolerance * abs(bounds[-1]):
            break
    both = cells.join(_side(z.select("s", "z"), n, k), "s").join(_side(w.select("view", "feature_id", "u"), p, k), ["view", "feature_id"])
    part = [F.col("z")[j] * F.col("u")[j] for j in range(k)]
    shares = both.groupBy("view").agg(F.array(*[F.sum(x * (2 * F.col("y") - x)) / F.nullif(F.sum(F.col("y") * F.col("y")), F.lit(0.0))
                                                 for x in part]).alias("r2"))
    alphas = spark.createDataFrame([(j + 1, [float(relevance[v][j]) for v in kinds]) for j in range(k)], "factor int, alpha array<double>")
    named = alphas.select("factor", F.posexplode("alpha").alias("v", "precision"))
    named = named.withColumn("view", F.element_at(F.array(*[F.lit(v) for v in kinds]), F.col("v") + 1))
    taken = shares.select("view", F.posexplode("r2").alias("j", "r2")).select("view", (F.col("j") + 1).alias("factor"), "r2")
    return {
        "scores": z.select(F.col("s").alias(sample), F.posexplode("z").alias("j", "value")).select(
            sample, (F.col("j") + 1).alias("factor"), "value"),
        "loadings": w.select("view", "feature_id", F.posexplode("u").alias("j", "loading"), (1 / F.sqrt("tau")).alias("noise")).select(
            "view", "feature_id", (F.col("j") + 1).alias("factor"), "loading", "noise"),
        "activity": named.join(taken, ["view", "factor"]).select("view", "factor", "precision", "r2"),
        "bounds": spark.createDataFrame(list(enumerate(bounds, 2)), "round int, bound double"),
    }
