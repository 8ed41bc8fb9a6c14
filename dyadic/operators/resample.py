"""Reproducible resampling and the tests built on it.

All draws come from md5 of (seed, replicate, id), so they do not depend on row
order, partitioning or retries, and any SQL engine can repeat them. A permuted
label is computed where it is needed from the subject's place and the
replicate's keys, so permutation tests make no row per replicate and subject.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.functions import columns as C
from dyadic.functions.tails import clean_nan, f_upper_udf, t_two_sided_udf
from dyadic.operators.moments import covariance, cross_product, vector_mean, vector_width
from dyadic.session import TASK_ROWS, materialize, small_side, spread

# Leading hex digits of a hash used to split one replicate's sort: 16^3 ranges of equal width.
_RANGE_DIGITS = 3


def draw(seed: int, *parts: Column) -> Column:
    """Hash of the seed and the parts, as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def draw_integer(seed: int, *parts: Column) -> Column:
    """First 32 bits of the hash as a non-negative integer."""
    return F.conv(F.substring(draw(seed, *parts), 1, 8), 16, 10).cast("bigint")


def hash_position(df: DataFrame, by: list[str], key: Column, out: str, tiebreak: str, rows: int | None = None) -> DataFrame:
    """1-based place of each row when its group is sorted by a text key, usually a hash.

    Groups beyond one task's worth are sorted per range of leading characters, and
    the counts of the ranges give the offsets; for hashes the ranges are even.
    """
    hashed = df.withColumn("_hash", key)
    rows = hashed.groupBy(*by).count().agg(F.max("count")).first()[0] if rows is None and by else rows
    rows = hashed.count() if rows is None else rows
    order = [F.col("_hash"), F.col(tiebreak)]
    if (rows or 0) <= TASK_ROWS:
        return hashed.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order))).drop("_hash")
    ranged = hashed.withColumn("_range", F.substring("_hash", 1, _RANGE_DIGITS))
    sizes = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order))
    return (
        ranged.withColumn("_local", local)
        .join(offsets, [*by, "_range"])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_hash", "_range", "_before", "_local")
    )


def subject_folds(subjects: DataFrame, k: int, seed: int = 42, subject: str = "subject_id") -> DataFrame:
    """Even folds over subjects in hash order; all rows of a subject share its fold."""
    n = subjects.count()
    if k > n:
        raise ValueError(f"{k} folds for {n} subjects")
    placed = hash_position(subjects.select(subject), [], draw(seed, F.col(subject)), "_at", subject, rows=n)
    return placed.select(subject, ((F.col("_at") - 1) % k).cast("int").alias("fold"))


def calibration_split(subjects: DataFrame, fraction: float = 0.2, seed: int = 42, subject: str = "subject_id") -> DataFrame:
    """Mark max(1, round(n x fraction)) subjects, first in hash order, as calibration subjects."""
    n = subjects.count()
    size = max(1, int(round(n * fraction)))
    placed = hash_position(subjects.select(subject), [], draw(seed, F.col(subject)), "_at", subject, rows=n)
    return placed.select(subject, (F.col("_at") <= size).alias("calibration"))


# Rounds of a keyed permutation; its multipliers and modulus, under which no product exceeds 63 bits.
ROUNDS = 6
MULTIPLIERS, MODULUS = (1540483477, 1103515245, 1664525), 1 << 31
# Steps that the column form takes at most to come back into range: a place needs more with a chance below 1e-40 if the
# places out of range are more than these, and never otherwise.
WALK = 30


def _sides(n: int) -> tuple[int, int]:
    """Two sides whose product is at least `n`, and less than `n` plus the first."""
    a = max(1, math.isqrt(n))
    return a, max(1, -(-n // a))


def permutation_keys(replicates: int, seed: int) -> np.ndarray:
    """(replicates + 1) x ROUNDS keys; replicate 0, the observed labelling, has none that count."""
    def key(rep: int, i: int) -> int:
        return int(hashlib.md5(f"{seed}:{rep}:{i}".encode()).hexdigest()[:8], 16) % MODULUS

    return np.array([[key(rep, i) for i in range(ROUNDS)] for rep in range(replicates + 1)], np.int64)


def keyed_places(places: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Permuted place (0 to n - 1) of each place, per replicate: `keys` (replicates x ROUNDS) gives replicates x places.

    A place is split into two numbers below the sides of a grid; in turn each is shifted by a keyed hash of the other, which
    can be undone and so is a permutation of the grid. Places that fall outside 0..n-1 go on until they are inside.
    """
    a, b = _sides(n)
    out = np.repeat(np.asarray(places, np.int64)[None, :], len(keys), axis=0)
    todo = np.ones(out.shape, bool)
    while todo.any():
        rep = np.nonzero(todo)[0]
        left, right = np.divmod(out[todo], b)
        for i in range(ROUNDS):
            key = keys[rep, i]
            if i % 2 == 0:
                left = (left + _hashed(right + key)) % a
            else:
                right = (right + _hashed(left + key)) % b
        out[todo] = left * b + right
        todo = out >= n
    return out


def _hashed(x: np.ndarray) -> np.ndarray:
    for m in MULTIPLIERS:
        x = (x * m + 12345) % MODULUS
        x = x ^ (x >> 15)
    return x


def _hashed_column(x: Column) -> Column:
    steps = F.array(*[F.lit(m).cast("bigint") for m in MULTIPLIERS])

    def one(h, m):
        value = (h * m + 12345) % MODULUS
        return value.bitwiseXOR(F.floor(value / F.lit(float(1 << 15))).cast("bigint"))

    return F.aggregate(steps, (x % MODULUS).cast("bigint"), one)


def keyed_place(place: Column, rep: Column, n: int, seed: int) -> Column:
    """As `keyed_places`, as a column expression over a place and a replicate."""
    a, b = (F.lit(v).cast("bigint") for v in _sides(n))
    keys = F.array(*[F.struct(*[(draw_integer(seed, rep, F.lit(i + j)) % MODULUS).alias(f"k{j}") for j in (0, 1)]) for i in range(0, ROUNDS, 2)])

    def pair(x, k):
        right = x % b
        left = (F.floor(x / b) + _hashed_column(right + k["k0"])) % a
        return left * b + (right + _hashed_column(left + k["k1"])) % b

    def once(x):
        return F.aggregate(keys, x.cast("bigint"), pair)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(place), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a permuted place stayed out of range")).cast("bigint"))


def _placed(subjects: DataFrame, seed: int, subject: str, n: int) -> DataFrame:
    """Rows with `_at`, their place from 0 in the order of the hash of their subject."""
    placed = hash_position(subjects, [], draw(seed, F.col(subject)), "_at", subject, rows=n)
    return spread(placed.withColumn("_at", F.col("_at").cast("bigint") - 1), "_at")


def permutation_grid(subjects: DataFrame, replicates: int, seed: int = 42, subject: str = "subject_id",
                     label: str = "label") -> DataFrame:
    """(rep, subject, label) with a 0/1 label shuffled over the subjects; rep 0 is the observed labelling.

    Subjects are numbered once. A label follows from the permuted number, so the rows of the grid are neither sorted nor
    shuffled; tasks compute them in blocks of replicates from their subjects' places. Tests that only need sums take
    `label_sums`, which makes no such rows.
    """
    counts = subjects.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones")).first()
    n = counts["n"]
    ones, keys = int(counts["ones"] or 0), permutation_keys(replicates, seed)

    def run(batches):
        for pdf in batches:
            at = pdf["_at"].to_numpy()
            step = max(1, _LABEL_CELLS // max(len(at), 1))
            for lo in range(1, replicates + 1, step):
                labels = keyed_places(at, keys[lo:lo + step], n) < ones
                yield pd.DataFrame({"rep": np.repeat(np.arange(lo, lo + len(labels), dtype=np.int32), len(at)),
                                    subject: np.tile(pdf[subject].to_numpy(), len(labels)), label: labels.ravel().astype(np.int32)})

    schema = T.StructType([T.StructField("rep", T.IntegerType()), subjects.schema[subject], T.StructField(label, T.IntegerType())])
    shuffled = _placed(subjects.select(subject), seed, subject, n).mapInPandas(run, schema)
    observed = subjects.select(F.lit(0).alias("rep"), subject, F.col(label).cast("int").alias(label))
    return observed.unionByName(shuffled)


def label_sums(rows: DataFrame, replicates: int, seed: int = 42, subject: str = "subject_id", label: str = "label",
               vector: str = "z") -> DataFrame:
    """(rep, ones, zeros, one_sum, zero_sum): sizes and summed vectors of both label groups in each permuted labelling.

    Rep 0 is the observed one. A task multiplies the labels of a block of replicates, computed in place, with its rows'
    vectors and returns one row per replicate, so memory and shuffle follow the replicates, not replicates x subjects.
    """
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones"), F.max(F.size(vector)).alias("d")).first()
    n, ones, d = counts["n"], int(counts["ones"] or 0), counts["d"] or 0
    placed = _placed(rows.select(subject, F.col(label).cast("int").alias(label), F.col(vector).alias(vector)), seed, subject, n)
    keys = permutation_keys(replicates, seed)

    def run(batches):
        total, whole = np.zeros((replicates + 1, d)), np.zeros(d)
        for pdf in batches:
            x, at = np.stack(pdf[vector].to_numpy()), pdf["_at"].to_numpy()
            whole += x.sum(axis=0)
            total[0] += pdf[label].to_numpy(dtype=float) @ x
            step = max(1, _LABEL_CELLS // max(len(at), 1))
            for lo in range(1, replicates + 1, step):
                total[lo:lo + step] += (keyed_places(at, keys[lo:lo + step], n) < ones).astype(float) @ x
        yield pd.DataFrame({"rep": range(replicates + 1), "one": list(total), "all": [whole] * (replicates + 1)})

    parts = placed.select("_at", label, vector).mapInPandas(run, "rep int, one array<double>, all array<double>")
    sums = parts.groupBy("rep").agg(C.vector_aggregate("sum", "one", d).alias("one_sum"), C.vector_aggregate("sum", "all", d).alias("all_sum"))
    return sums.select("rep", F.lit(ones).alias("ones"), F.lit(n - ones).alias("zeros"), "one_sum",
                       F.zip_with("all_sum", "one_sum", lambda a, b: a - b).alias("zero_sum"))


def bootstrap_counts(subjects: DataFrame, replicates: int, seed: int = 42, subject: str = "subject_id",
                     by: list[str] | None = None) -> DataFrame:
    """(rep, *by, subject, copies): with-replacement draws of whole subjects, per group if `by` is given."""
    by = by or []
    numbered = spread(hash_position(subjects.select(*by, subject), by, draw(seed, F.col(subject)), "_at", subject), *by, "_at")
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else None
    if by:
        slots = numbered.join(F.broadcast(sizes), by)  # one row per group label
    else:
        slots = numbered.withColumn("_n", F.lit(numbered.count()))
    picks = (
        slots.select(*by, "_n", F.col("_at").alias("_slot"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
        .withColumn("_at", (draw_integer(seed, F.col("rep"), F.col("_slot")) % F.col("_n") + 1).cast("int"))
        .groupBy("rep", *by, "_at").agg(F.count(F.lit(1)).alias("copies"))
    )
    return picks.join(numbered.withColumn("_at", F.col("_at").cast("int")), [*by, "_at"]).select("rep", *by, subject, "copies")


def permutation_p(stats: DataFrame, value: str, tail: str = "upper", plus_one: bool = False) -> DataFrame:
    """p-value of replicate 0 against replicates 1..B; ties count as extreme."""
    observed = F.max(F.when(F.col("rep") == 0, F.col(value)))
    numbers = F.collect_list(F.when(F.col("rep") > 0, F.col(value)))  # B numbers, B fixed by the caller
    hit = (lambda x: x >= F.col("observed")) if tail == "upper" else (lambda x: x <= F.col("observed"))
    n_hit = F.size(F.filter("_null", hit)).cast("double")
    extra = 1.0 if plus_one else 0.0
    return stats.agg(observed.alias("observed"), numbers.alias("_null")).select(
        "observed", ((n_hit + extra) / (F.size("_null") + extra)).alias("p_value"),
        F.size("_null").cast("bigint").alias("n_permutations"),
    )


def permanova(scores: DataFrame, replicates: int = 2000, seed: int = 42, subject: str = "subject_id",
              label: str = "label", vector: str = "z") -> DataFrame:
    """Pseudo-F of two groups and its label-permutation p-value.

    Per replicate only group sums are needed (`label_sums`): with data centred on the grand mean
    the between-group sum of squares is sum |S_g|^2 / n_g, and the total is fixed.
    """
    labelled = scores.filter(F.col(label).isNotNull())
    d = vector_width(labelled, vector)
    row = vector_mean(labelled, [], vector, "m", d).first()
    n = row["n"]
    centred = labelled.select(
        subject, label, F.zip_with(vector, C.literal_vector(row["m"]), lambda a, b: a - b).alias("_c"))
    total = centred.agg(F.sum(C.dot(F.col("_c"), F.col("_c")))).scalar()
    groups = label_sums(centred.filter(F.lit(d > 0)), replicates, seed, subject, label, "_c")
    part = [F.when(F.col(k) > 0, C.dot(F.col(v), F.col(v)) / F.col(k)).otherwise(0.0) for k, v in (("ones", "one_sum"), ("zeros", "zero_sum"))]
    between = groups.select("rep", (part[0] + part[1]).alias("ssb"), ((F.col("ones") > 0).cast("int") + (F.col("zeros") > 0).cast("int")).alias("g"))
    within = F.col("sst") - F.col("ssb")
    df1, df2 = F.col("g") - 1, F.lit(n) - F.col("g")
    f = F.when((within <= 1e-12) | (df2 == 0) | (df1 == 0), F.lit(0.0)).otherwise(
        F.try_divide(F.try_divide(F.col("ssb"), df1), F.try_divide(within, df2))
    )
    stats = between.withColumn("sst", total).withColumn("f", f)
    return permutation_p(stats, "f").withColumnRenamed("observed", "f_statistic")


def cohens_d(scores: DataFrame, by: list[str], value: str = "value", label: str = "label", ddof: int = 1,
             signed: bool = False, empty: float | None = 0.0) -> DataFrame:
    """Standardised mean difference of label 1 against label 0 per group.

    `ddof=0` takes population variances with n - 1 weights. `empty` is the value
    for groups with fewer than two rows on a side; no spread gives 0.
    """
    one, zero = F.col(label) == 1, F.col(label) == 0
    var = F.var_samp if ddof == 1 else F.var_pop
    v = F.col(value)
    agg = scores.groupBy(*by).agg(
        F.count(F.when(one, v)).alias("n1"), F.count(F.when(zero, v)).alias("n0"),
        F.avg(F.when(one, v)).alias("m1"), F.avg(F.when(zero, v)).alias("m0"),
        var(F.when(one, v)).alias("v1"), var(F.when(zero, v)).alias("v0"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    pooled = ((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / F.nullif(n1 + n0 - 2, F.lit(0).cast("bigint"))
    gap = F.col("m1") - F.col("m0")
    d = F.coalesce((gap if signed else F.abs(gap)) / F.nullif(F.sqrt(pooled), F.lit(0.0)), F.lit(0.0))
    short = (n1 < 2) | (n0 < 2)
    return agg.select(*by, "n1", "n0", "m1", "m0", F.when(short, F.lit(empty).cast("double")).otherwise(d).alias("d"))


def ttest(scores: DataFrame, by: list[str], value: str = "value", label: str = "label") -> DataFrame:
    """Equal-variance two-sample t-test per group; p is 1 with fewer than two rows on a side."""
    one, zero, v = F.col(label) == 1, F.col(label) == 0, F.col(value)
    agg = scores.groupBy(*by).agg(
        F.count(F.when(one, v)).alias("n1"), F.count(F.when(zero, v)).alias("n0"),
        F.avg(F.when(one, v)).alias("m1"), F.avg(F.when(zero, v)).alias("m0"),
        F.var_pop(F.when(one, v)).alias("v1"), F.var_pop(F.when(zero, v)).alias("v0"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    df = n1 + n0 - 2
    pooled = (n1 * F.col("v1") + n0 * F.col("v0")) / F.nullif(df, F.lit(0).cast("bigint"))
    se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0)))
    short = (n1 < 2) | (n0 < 2)
    t = F.when(~short, (F.col("m1") - F.col("m0")) / F.nullif(se, F.lit(0.0)))
    out = agg.select(*by, df.alias("df"), t.alias("t_stat"), short.alias("_short"))
    return out.withColumn("p_val", clean_nan(t_two_sided_udf("t_stat", "df"))).withColumn(
        "p_val", F.when(F.col("_short"), F.lit(1.0)).otherwise(F.col("p_val"))
    ).drop("_short")


def hotelling_t2(scores: DataFrame, label: str = "label", vector: str = "z") -> DataFrame:
    """Two-sample Hotelling T-squared with its F and p, as one row.

    Only the group sizes, means and the pooled d x d covariance reach the driver.
    """
    one, zero = (covariance(scores.filter(F.col(label) == i), vector) for i in (1, 0))
    (n1, m1, c1), (n0, m0, c0) = one, zero
    d = len(m1)
    gap = m1 - m0
    t2 = float(gap @ np.linalg.pinv((n1 * c1 + n0 * c0) / (n1 + n0 - 2)) @ gap) * n1 * n0 / (n1 + n0)
    df2 = n1 + n0 - d - 1
    f = t2 * df2 / (d * (n1 + n0 - 2))
    out = scores.sparkSession.range(1).select(
        F.lit(t2).alias("t2"), F.lit(float(f)).alias("f"), F.lit(float(d)).alias("df1"), F.lit(float(df2)).alias("df2")
    )
    return out.withColumn("p_val", f_upper_udf("f", "df1", "df2"))


# Samples up to which a permutation test works on the samples x samples cross-product (8 MB).
_CROSS_SAMPLES = 1024


def centroid_permutation(features: DataFrame, subjects: DataFrame, anchor: DataFrame, replicates: int = 2000,
                         seed: int = 42, subject: str = "sample_id", label: str = "label") -> DataFrame:
    """d(label 0 centroid, anchor) - d(label 1 centroid, anchor) and its lower-tail permutation p.

    `features(sample, feature_id, value)`, `subjects(sample, label 0/1)`,
    `anchor(feature_id, value)`. Values are taken relative to the anchor, so a
    group's squared distance is the sum of its block of the samples x samples
    cross-product over n squared: the features are read once, whatever the number
    of replicates. Tables with missing cells or very many samples take per-feature
    group means instead, from one vector per feature and blocks of replicates.
    """
    known = subjects.filter(F.col(label).isNotNull()).select(subject, F.col(label).cast("int").alias(label))
    shifted = features.join(anchor.withColumnRenamed("value", "_anchor"), "feature_id").join(
        small_side(known.select(subject)), subject, "left_semi").select(
        subject, "feature_id", (F.col("value") - F.col("_anchor")).alias("_v"))
    placed = materialize(_placed(known, seed, subject, known.count()))
    sizes = shifted.agg(F.countDistinct(subject).alias("n"), F.countDistinct("feature_id").alias("p"), F.count("_v").alias("k")).first()
    if sizes["n"] <= _CROSS_SAMPLES and sizes["k"] == sizes["n"] * sizes["p"]:
        distance = _group_norms(shifted, placed, replicates, seed, subject, label)
    else:
        distance = _block_norms(shifted, placed, replicates, seed, subject, label)
    gap = distance.groupBy("rep").agg(
        F.max(F.when(F.col(label) == 0, F.col("_d"))).alias("d_zero"),
        F.max(F.when(F.col(label) == 1, F.col("_d"))).alias("d_one"),
    ).withColumn("gap", F.col("d_zero") - F.col("d_one"))
    observed = gap.filter("rep = 0").select("d_zero", "d_one")
    p = permutation_p(gap, "gap", tail="lower").withColumnRenamed("observed", "gap")
    return p.withColumns({"d_zero": observed.select("d_zero").scalar(), "d_one": observed.select("d_one").scalar()}).select(
        "d_zero", "d_one", "gap", "p_value", "n_permutations", (F.col("gap") < 0).alias("direction_ok")
    )


def _group_norms(shifted: DataFrame, placed: DataFrame, replicates: int, seed: int, subject: str, label: str) -> DataFrame:
    """Norm of each group's mean vector per (rep, label), from the cross-product of the samples."""
    per_feature = shifted.groupBy("feature_id").agg(F.sort_array(F.collect_list(F.struct(subject, "_v"))).alias("_p"))
    gram = cross_product(per_feature.select(F.transform("_p", lambda p: p["_v"]).alias("z")))
    # The samples are bounded by the caller; only those with features stand in the cross-product.
    known = {r[0]: (r["_at"], r[label]) for r in placed.join(F.broadcast(shifted.select(subject).distinct()), subject, "left_semi").collect()}
    at, seen = (np.array([known[s][i] for s in sorted(known)]) for i in (0, 1))
    keys, n, ones = permutation_keys(replicates, seed), placed.count(), int(placed.agg(F.sum(label)).first()[0] or 0)

    def norms(batches):
        for pdf in batches:
            rep = pdf["id"].to_numpy()
            marks = np.where(rep[:, None] == 0, seen == 1, keyed_places(at, keys[rep], n) < ones).astype(float)
            for g, m in ((0, 1.0 - marks), (1, marks)):
                k = m.sum(axis=1)
                size = np.sqrt(np.maximum(np.einsum("ri,ij,rj->r", m, gram, m, optimize=True), 0.0))
                yield pd.DataFrame({"rep": rep, "g": g, "_d": size / np.maximum(k, 1.0)})[k > 0]

    reps = shifted.sparkSession.range(replicates + 1)
    return reps.mapInPandas(norms, "rep long, g int, _d double").withColumnRenamed("g", label)


# Cells of the samples x replicates label matrix that a task holds at a time (64 MB).
_LABEL_CELLS = 8_000_000


def _block_norms(shifted: DataFrame, placed: DataFrame, replicates: int, seed: int, subject: str, label: str) -> DataFrame:
    """As `_group_norms` for any table: a feature's present values times a block of label columns gives its group sums.

    A feature is one row of at most as many values as there are samples; replicates come in blocks, so that a block's
    labels fit a task, which computes them from the samples' places. Tasks return one sum of squares per replicate and group.
    """
    n = placed.count()
    packed = materialize(shifted.filter(F.col("_v").isNotNull()).join(small_side(placed.select(subject, "_at")), subject).groupBy("feature_id").agg(
        F.collect_list(F.struct(F.col("_at").alias("_i"), "_v")).alias("_p")).select(F.col("_p._i").alias("i"), F.col("_p._v").alias("v")))
    observed = np.zeros(n, dtype=bool)
    observed[[r["_at"] for r in placed.filter(F.col(label) == 1).select("_at").toLocalIterator()]] = True
    ones, keys = int(observed.sum()), permutation_keys(replicates, seed)
    step, out = max(1, _LABEL_CELLS // max(n, 1)), None
    for lo in range(0, replicates + 1, step):
        size = min(step, replicates + 1 - lo)
        marks = (keyed_places(np.arange(n), keys[lo:lo + size], n) < ones).T.astype(float)
        if lo == 0:
            marks[:, 0] = observed
        shared = shifted.sparkSession.sparkContext.broadcast(marks)

        def norms(batches, lo=lo, size=size, shared=shared):
            total, seen = np.zeros((2, size)), np.zeros((2, size), dtype=bool)
            for pdf in batches:
                for i, v in zip(pdf["i"], pdf["v"]):
                    part = shared.value[np.asarray(i, dtype=int)]
                    ones, sums = part.sum(axis=0), np.asarray(v, dtype=float) @ part
                    for g, (count, s) in enumerate(((len(i) - ones, np.sum(v) - sums), (ones, sums))):
                        has = count > 0
                        total[g] += np.where(has, (s / np.where(has, count, 1.0)) ** 2, 0.0)
                        seen[g] |= has
            for g in (0, 1):
                yield pd.DataFrame({"rep": np.arange(lo, lo + size, dtype=np.int64)[seen[g]], "g": g, "s": total[g][seen[g]]})

        part = materialize(packed.mapInPandas(norms, "rep long, g int, s double").groupBy("rep", "g").agg(F.sum("s").alias("s")))
        out = part if out is None else out.unionByName(part)
    return out.select("rep", F.col("g").alias(label), F.sqrt("s").alias("_d"))


def proximity_test(termini: DataFrame, reference: DataFrame, bootstrap: int = 2000, permutations: int = 2000,
                   seed: int = 42, subject: str = "subject_id", label: str = "label", vector: str = "z") -> DataFrame:
    """Are label-0 termini closer to the reference centroid? One row with effect, signed d, CIs and p.

    Effect = mean distance of label 1 - mean distance of label 0. CIs bootstrap
    whole subjects within each group; p permutes labels, counting the observed one.
    """
    d = vector_width(termini, vector)
    if vector_width(reference, vector) != d:
        raise ValueError("termini and reference live in different dimensions")
    centre = vector_mean(reference, [], vector, d=d).select("centroid").scalar()
    dist = termini.filter(F.col(label).isNotNull()).withColumn("_centre", centre).select(
        subject, F.col(label).cast("int").alias(label), C.distance(F.col(vector), F.col("_centre")).alias("value")
    )
    sizes = {r[0]: r[1] for r in dist.groupBy(label).count().collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 2:
        raise ValueError("each group needs at least two subjects")
    base = cohens_d(dist, [], signed=True)
    copies = bootstrap_counts(dist, bootstrap, seed, subject, [label])
    boots = _weighted_gap(copies.join(small_side(dist.select(subject, "value")), subject), label)
    ci = boots.agg(
        F.percentile("effect", 0.025).alias("effect_low"), F.percentile("effect", 0.975).alias("effect_high"),
        F.percentile("d", 0.025).alias("d_low"), F.percentile("d", 0.975).alias("d_high"),
    )
    sums = label_sums(dist.withColumn("_one", F.array("value")), permutations, seed + 1, subject, label, "_one")
    gaps = sums.select("rep", (F.col("one_sum")[0] / F.col("ones") - F.col("zero_sum")[0] / F.col("zeros")).alias("gap"))
    p = permutation_p(gaps, "gap", plus_one=True).select("p_value").scalar()
    row = base.select(
        F.col("n1").alias("n_label1"), F.col("n0").alias("n_label0"), F.col("m1").alias("mean_label1"),
        F.col("m0").alias("mean_label0"), (F.col("m1") - F.col("m0")).alias("effect"), F.col("d").alias("cohens_d"),
    )
    for name in ("effect_low", "effect_high", "d_low", "d_high"):
        row = row.withColumn(name, ci.select(name).scalar())
    return row.withColumn("p_value", p)


def _weighted_gap(draws: DataFrame, label: str) -> DataFrame:
    """Per replicate: mean gap and signed d of resampled groups, from copy counts."""
    w, v = F.col("copies"), F.col("value")
    moments = draws.groupBy("rep", label).agg(F.sum(w).alias("n"), F.sum(w * v).alias("s"), F.sum(w * v * v).alias("ss"))
    side = {k: {c: F.max(F.when(F.col(label) == k, F.col(c))) for c in ("n", "s", "ss")} for k in (0, 1)}
    wide = moments.groupBy("rep").agg(*[side[k][c].alias(f"{c}{k}") for k in (0, 1) for c in ("n", "s", "ss")])
    m1, m0 = F.col("s1") / F.col("n1"), F.col("s0") / F.col("n0")
    spread = (F.col("ss1") - F.col("n1") * m1 * m1) + (F.col("ss0") - F.col("n0") * m0 * m0)
    pooled = F.greatest(F.lit(0.0), spread) / (F.col("n1") + F.col("n0") - 2)
    return wide.select(
        "rep", (m1 - m0).alias("effect"),
        F.coalesce((m1 - m0) / F.nullif(F.sqrt(pooled), F.lit(0.0)), F.lit(0.0)).alias("d"),
    )
