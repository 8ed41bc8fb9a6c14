"""Ordered operators: prefix sums, ranks, false-discovery rates, quantiles.

Anything ordered inside a group goes through `ordered_prefix`. It first reduces
the group to its distinct order values, so copies of one value never pile up in
a task, and splits tables with groups larger than `task_rows` by Spark's range
partitioning into value ranges that are sorted separately and stitched together
from one total per range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadic.session import TASK_ROWS, materialize, small_side

# Value ranges that a table is split into at most, unless ranges of `TASK_ROWS` / 2 rows take more: beyond them smaller
# tasks cost more than they save.
RANGES = 512

_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0.0)) + b),
    "count": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "min": (F.min, lambda a, b: F.coalesce(F.least(a, b), b)),
    "max": (F.max, lambda a, b: F.coalesce(F.greatest(a, b), b)),
}


def _keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Give an ungrouped table one constant key, so grouped code serves both."""
    return (df, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def largest_group(df: DataFrame, by: list[str]) -> int:
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def ordered_prefix(
    df: DataFrame,
    by: list[str],
    order: str,
    measures: dict[str, tuple[str, str]],
    descending: bool = False,
    task_rows: int = TASK_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Running aggregates over rows up to and including each row.

    `measures` maps an output column to (kind, input column), kind one of sum,
    count (a sum of whole numbers), min, max. `order` must be numeric, not null,
    and unique within the group. `df` should come from stored data (see
    `session.materialize`): it is read once to size the groups, unless `largest`
    is given, and once to run; to be split it is counted, sampled and stored.
    """
    if largest is None:
        largest = largest_group(df, by)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    if largest <= task_rows:
        w = W.partitionBy(*by).orderBy(direction).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.select("*", *[_COMBINE[k][0](c).over(w).alias(out) for out, (k, c) in measures.items()])

    total = df.count()
    ranges = max(2, min(math.ceil(2 * total / task_rows), max(RANGES, math.ceil(2 * total / TASK_ROWS))))
    # Ranges of (group, value) of like sizes; stored, as another run might draw other bounds.
    ranged = materialize(df.repartitionByRange(ranges, *by, direction).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_range").agg(
        *[_COMBINE[k][0](c).alias(f"_t_{out}") for out, (k, c) in measures.items()]
    )
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_range", *[_COMBINE[k][0](f"_t_{out}").over(before).alias(f"_o_{out}") for out, (k, _) in measures.items()]
    )
    w = W.partitionBy(*by, "_range").orderBy(direction).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.select("*", *[_COMBINE[k][0](c).over(w).alias(f"_l_{out}") for out, (k, c) in measures.items()])
    return local.join(small_side(offsets), [*by, "_range"]).select(
        *df.columns, *[_COMBINE[k][1](F.col(f"_o_{o}"), F.col(f"_l_{o}")).alias(o) for o, (k, _) in measures.items()]
    )


def rank_table(stored: DataFrame, keys: list[str], value: str, out: str, descending: bool, task_rows: int) -> DataFrame:
    """Mean rank of every distinct value of a group."""
    counts = stored.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_prefix(counts, keys, value, {"_upto": ("count", "_n")}, descending, task_rows)
    return ranked.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))


def average_rank(
    df: DataFrame, by: list[str], value: str, out: str = "rank", descending: bool = False, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Add the 1-based rank of `value` in its group, ties sharing their mean rank."""
    keyed, keys = _keyed(df, by)
    stored = materialize(keyed)
    ranks = rank_table(stored, keys, value, out, descending, task_rows)
    return stored.join(ranks, [*keys, value]).select(*df.columns, out)


def bh_fdr(
    results: DataFrame, by: list[str], p: str = "p_val", q: str = "q_val", task_rows: int = TASK_ROWS
) -> DataFrame:
    """Add Benjamini-Hochberg q-values within each group; a missing p counts as 1."""
    keyed, keys = _keyed(results, by)
    stored = materialize(keyed.withColumn("_p", F.coalesce(F.nanvl(F.col(p), F.lit(1.0)), F.lit(1.0))))
    counts = stored.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    largest = largest_group(counts, keys)
    sizes = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    upto = ordered_prefix(counts, keys, "_p", {"_upto": ("count", "_n")}, task_rows=task_rows, largest=largest)
    raw = upto.join(small_side(sizes), keys).select(*keys, "_p", (F.col("_p") * F.col("_m") / F.col("_upto")).alias("_raw"))
    if largest > task_rows:
        raw = materialize(raw)
    steps = ordered_prefix(
        raw, keys, "_p", {"_q": ("min", "_raw")}, descending=True, task_rows=task_rows, largest=largest
    )
    table = steps.select(*keys, "_p", F.least(F.lit(1.0), "_q").alias(q))
    return stored.join(table, [*keys, "_p"]).select(*results.columns, q)


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group; Spark prunes inside the map tasks (window group limit)."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def weighted_quantile(
    df: DataFrame,
    by: list[str],
    score: str = "score",
    weight: str = "weight",
    alpha: float = 0.10,
    out: str = "q_hat",
    min_rows: int = 1,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Smallest score whose cumulative weight reaches 1 - alpha of (total + mean) weight, else the largest.

    Groups with fewer than `min_rows` rows get pi, the widest angle.
    """
    keyed, keys = _keyed(df, by)
    masses = materialize(keyed.groupBy(*keys, score).agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n")))
    totals = masses.groupBy(*keys).agg(
        F.sum("_w").alias("_sum"), F.sum("_n").alias("_rows"), F.max(score).alias("_max")
    )
    upto = ordered_prefix(masses, keys, score, {"_upto": ("sum", "_w")}, task_rows=task_rows)
    reached = F.col("_upto") / (F.col("_sum") + F.col("_sum") / F.col("_rows")) >= F.lit(1.0 - alpha)
    found = F.coalesce(F.min(F.when(reached, F.col(score))), F.max("_max"))
    return (
        upto.join(small_side(totals), keys)
        .groupBy(*keys)
        .agg(F.when(F.max("_rows") < min_rows, F.lit(math.pi)).otherwise(found).alias(out))
        .select(*by, out)
    )


def mondrian_conformal(
    calibration: DataFrame, test: DataFrame, alpha: float = 0.10, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Coverage and mean radius per stratum and overall (stratum NULL).

    `calibration(stratum, score, weight)` gives a radius per stratum (pi when it
    has fewer than two rows); test strata never calibrated use the largest one.
    """
    radius = weighted_quantile(calibration, ["stratum"], alpha=alpha, out="radius", min_rows=2, task_rows=task_rows)
    widest = radius.agg(F.coalesce(F.max("radius"), F.lit(math.pi))).scalar()
    scored = (
        test.join(radius, "stratum", "left")
        .select("stratum", "score", F.coalesce("radius", widest).alias("radius"))
        .withColumn("covered", (F.col("score") <= F.col("radius")).cast("double"))
    )
    return scored.rollup("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.avg("covered").alias("coverage"), F.avg("radius").alias("mean_radius")
    )


def spearman(df: DataFrame, by: list[str], x: str, y: str, min_rows: int = 5, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rank correlation per group over rows where both sides are present; NULL below `min_rows`.

    Equal (x, y) pairs are counted once and weighted, so the joins see distinct pairs only.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    keyed, keys = _keyed(both, by)
    stored = materialize(keyed.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_k")))
    rows = stored.select(*keys, "_x", "_y", "_k")
    out = rows
    for value, rank in (("_x", "_rx"), ("_y", "_ry")):
        counts = rows.groupBy(*keys, value).agg(F.sum("_k").alias("_n"))
        ranked = ordered_prefix(counts, keys, value, {"_upto": ("count", "_n")}, task_rows=task_rows)
        out = out.join(ranked.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(rank)), [*keys, value])
    # Mean ranks sum to n (n + 1) / 2, so both sides are centred exactly before the weighted moments.
    sizes = rows.groupBy(*keys).agg(F.sum("_k").alias("n"))
    dx, dy, k = F.col("_rx") - (F.col("n") + 1) / 2.0, F.col("_ry") - (F.col("n") + 1) / 2.0, F.col("_k")
    spread = F.sqrt(F.sum(k * dx * dx) * F.sum(k * dy * dy))
    rho = F.sum(k * dx * dy) / F.nullif(spread, F.lit(0.0))
    return out.join(small_side(sizes), keys).groupBy(*keys).agg(
        F.max("n").alias("n"), F.when(F.max("n") >= min_rows, rho).alias("rho")).select(*by, "n", "rho")


def pi1(df: DataFrame, by: list[str], p: str = "p_val", cut: float = 0.5) -> DataFrame:
    """Estimated share of true effects: 1 - #{p > cut} / (n (1 - cut)), not below 0, 4 decimals."""
    above = F.sum((F.col(p) > cut).cast("double"))
    n = F.count(p)
    return df.groupBy(*by).agg(
        n.alias("n"), F.round(1.0 - F.least(F.lit(1.0), above / F.nullif(n * (1.0 - cut), F.lit(0.0))), 4).alias("pi1")
    )


# Inverse of the share of a group's rows by which a sketched rank may be off.
SKETCH = 10_000


def percentile_ci(df: DataFrame, by: list[str], value: str, points: dict[str, float], task_rows: int = TASK_ROWS,
                  sketch: int = SKETCH) -> DataFrame:
    """Exact interpolated percentiles; `points` maps an output name to a fraction.

    Groups of up to `task_rows` rows are taken as they are. For larger ones a mergeable quantile sketch brackets each answer
    first; a second pass counts what lies below a bracket and keeps only the distinct values inside it, some 4 in `sketch`
    of the rows, so no task ever holds a group. Both ways give the same. Nulls are left out; a group of nulls has NULLs.
    """
    if largest_group(df, by) <= task_rows if by else df.count() <= task_rows:
        return df.groupBy(*by).agg(*[F.percentile(value, f).alias(name) for name, f in points.items()])
    rows, keys = _keyed(df.select(*by, F.col(value).cast("double").alias("_v")), by)
    slack = 2.0 / sketch
    edges = [edge for f in points.values() for edge in (max(f - slack, 0.0), min(f + slack, 1.0))]
    ends = F.percentile_approx("_v", edges, sketch)
    sizes = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), ends.alias("_e"))
    brackets = materialize(sizes.select(*keys, "_n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("point"), F.lit(float(f)).alias("f"),
                 (F.col("_min") if f - slack <= 0 else F.col("_e")[2 * i]).alias("low"),
                 (F.col("_max") if f + slack >= 1 else F.col("_e")[2 * i + 1]).alias("high"))
        for i, f in enumerate(points.values())])).alias("_b")).select(*keys, "_n", "_b.*"))
    inside = rows.filter("_v is not null").join(small_side(brackets), keys)
    below = inside.filter("_v < low").groupBy(*keys, "point").agg(F.count(F.lit(1)).alias("_below"))
    kept = materialize(inside.filter("_v between low and high").groupBy(*keys, "point", "_v").agg(F.count(F.lit(1)).alias("_k")))
    order = ordered_prefix(kept, [*keys, "point"], "_v", {"_seen": ("count", "_k")})
    ranked = order.join(small_side(brackets.join(below, [*keys, "point"], "left")), [*keys, "point"])
    seen = F.col("_seen") + F.coalesce("_below", F.lit(0))
    place = F.col("f") * (F.col("_n") - 1)
    # The values that stand at the whole places on both sides of the fraction's place.
    at = [F.min(F.when(seen > p, F.col("_v"))) for p in (F.floor(place), F.ceil(place))]
    found = ranked.groupBy(*keys, "point").agg(at[0].alias("_a"), at[1].alias("_b"), F.first(place - F.floor(place)).alias("_w"))
    exact = F.when(F.col("_b").isNull(), F.raise_error(F.lit("a percentile left its bracket")).cast("double")).otherwise(
        F.col("_a") * (1 - F.col("_w")) + F.col("_b") * F.col("_w"))
    wide = found.select(*keys, "point", exact.alias("_x")).groupBy(*keys).agg(
        *[F.max(F.when(F.col("point") == i, F.col("_x"))).alias(name) for i, name in enumerate(points)])
    return sizes.select(*keys).join(wide, keys, "left").select(*by, *points)


def capped_weights(df: DataFrame, weight: str = "weight", fraction: float = 0.99, task_rows: int = TASK_ROWS) -> DataFrame:
    """Cap weights at their interpolated percentile, found as in `percentile_ci`."""
    cap = percentile_ci(df.select(weight), [], weight, {"cap": fraction}, task_rows).scalar()
    return df.withColumn(weight, F.least(F.col(weight), cap))


def rank_to_normal(features: DataFrame, feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Per feature, empirical quantile level and its normal score over all samples of all cohorts."""
    from dyadic.functions.columns import normal_quantile

    ranked = average_rank(features.filter(F.col(value).isNotNull()), [feature], value, "_rank")
    sizes = ranked.groupBy(feature).agg(F.count(F.lit(1)).alias("_n"))
    level = (F.col("_rank") - 1.0) / F.nullif(F.col("_n") - 1.0, F.lit(0.0))
    edge = 1e-7
    return (
        ranked.join(sizes, feature)
        .withColumn("level", F.coalesce(level, F.lit(0.0)))
        .withColumn("z", normal_quantile(F.greatest(F.lit(edge), F.least(F.lit(1.0 - edge), F.col("level")))))
        .drop("_rank", "_n")
    )


def leaderboard(cells: DataFrame, arms: list[str], metrics: list[str]) -> DataFrame:
    """(metric, arm, cell) rows to one row per metric in the given order and one column per arm."""
    place = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric"))
    return (
        cells.groupBy("metric").pivot("arm", arms).agg(F.first("cell"))
        .withColumn("position", place)
        .na.fill("n/a", subset=arms)
    )


def cell_text(kind: Column, value: Column, passed: Column | None = None) -> Column:
    """Render one leaderboard cell: a formatted number, with PASS or FAIL where a flag exists."""
    text = F.concat(kind, F.lit(" "), F.format_string("%.3f", value))
    if passed is None:
        return text
    return F.concat(text, F.when(passed, " | PASS").otherwise(" | FAIL"))
