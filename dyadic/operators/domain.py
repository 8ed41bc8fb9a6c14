"""How well two cohorts can be told apart: classifiers, fold AUCs, importance weights."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.columns import odds
from dyadic.operators.ranking import average_rank, capped_weights
from dyadic.operators.resample import draw, draw_integer, hash_position
from dyadic.session import materialize

# Training rows worth a task of their own.
_FIT_ROWS = 4096


def auc(scored: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve per group from average ranks."""
    ranked = average_rank(scored.select(*by, score, label), by, score, "_r")
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    ranks = F.sum(F.when(F.col(label) == 1, F.col("_r")))
    zero = F.lit(0).cast("bigint")
    return ranked.groupBy(*by).agg(
        ((ranks - pos * (pos + 1) / 2.0) / F.nullif(pos * neg, zero)).alias("auc"), (pos + neg).alias("n"))


def stratified_folds(rows: DataFrame, k: int = 5, seed: int = 42, id_col: str = "sample_id", label: str = "label") -> DataFrame:
    """Folds in hash order within each class."""
    placed = hash_position(rows, [label], draw(seed, F.col(id_col)), "_at", id_col)
    return placed.withColumn("fold", ((F.col("_at") - 1) % k).cast("int")).drop("_at")


def _balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # two classes
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    return rows.withColumn("_weight", weight)


def _laid_out(rows: DataFrame, n: int, id_col: str) -> DataFrame:
    """The n rows over all cores, in tasks and an order that reruns on as many cores repeat.

    Every task of a forest's level passes on the sums of all its nodes, however few rows it has, so more tasks than cores
    cost more than they save. Bags are drawn by task and row, so the layout decides which forest is grown.
    """
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / _FIT_ROWS))
    return rows.repartition(max(tasks, 1), id_col).sortWithinPartitions(id_col)


def domain_classifier(rows: DataFrame, k: int = 5, seed: int = 42, trees: int = 500, depth: int = 20,
                      bootstrap: int = 2000, id_col: str = "sample_id", vector: str = "z") -> dict[str, DataFrame]:
    """Balanced logistic regression and random forest telling cohort 1 from cohort 0.

    `rows(sample, label 0/1, z)`. Returns out-of-fold AUCs, their bootstrap
    interval with the larger mean AUC, coefficients and importances by position,
    and the final logistic probabilities.
    """
    stored = materialize(rows)
    placed = stratified_folds(stored, k, seed, id_col).withColumn(
        "features", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    prepared = materialize(_laid_out(placed, stored.count(), id_col))

    def logistic(n: int):
        # One penalty unit over the summed loss, as weights add up to n.
        return LogisticRegression(
            featuresCol="features", labelCol="label", weightCol="_weight", regParam=1.0 / n, elasticNetParam=0.0,
            standardization=False, maxIter=1000, tol=1e-6)

    def forest(_n: int):
        return RandomForestClassifier(
            featuresCol="features", labelCol="label", weightCol="_weight", numTrees=trees, maxDepth=depth, seed=seed,
            featureSubsetStrategy="sqrt", maxMemoryInMB=512, cacheNodeIds=True)

    scored = None
    for name, build in (("lr", logistic), ("rf", forest)):
        for fold in range(k):
            train = _balanced(prepared.filter(F.col("fold") != fold))
            model = build(train.count()).fit(train)
            # Stored model by model: in one plan of all parts every task would load all models.
            part = materialize(model.transform(prepared.filter(F.col("fold") == fold)).select(
                id_col, "label", "fold", F.lit(name).alias("model"), vector_to_array("probability")[1].alias("score")))
            scored = part if scored is None else scored.unionByName(part)
    folds = materialize(auc(scored, ["model", "fold"]))
    everything = _balanced(prepared)
    final_lr, final_rf = logistic(everything.count()).fit(everything), forest(0).fit(everything)
    draws = folds.sparkSession.range(1, bootstrap + 1).select(
        F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    picks = draws.withColumn("fold", (draw_integer(seed, F.col("rep"), F.col("slot")) % k).cast("int"))
    means = picks.join(F.broadcast(folds), "fold").groupBy("model", "rep").agg(F.avg("auc").alias("a"))
    ci = means.groupBy("model").agg(F.percentile("a", 0.025).alias("ci_low"), F.percentile("a", 0.975).alias("ci_high"))
    summary = folds.groupBy("model").agg(F.avg("auc").alias("mean_auc")).join(ci, "model")
    spark = rows.sparkSession
    weights = final_lr.coefficients.toArray()
    importances = final_rf.featureImportances.toArray()
    combined = spark.createDataFrame(
        [(i, float(c), float(v)) for i, (c, v) in enumerate(zip(weights, importances))],
        "position int, coefficient double, importance double")
    probability = final_lr.transform(prepared).select(id_col, "label", vector_to_array("probability")[1].alias("p"))
    return {"folds": folds, "summary": summary, "features": combined, "probability": probability}


def shift_weights(probability: DataFrame, fraction: float = 0.99) -> DataFrame:
    """Importance weights p / (1 - p) of cohort-0 rows, capped at their percentile."""
    base = probability.filter("label = 0").withColumn("weight", odds(F.col("p"), floor=1e-8))
    return capped_weights(base, "weight", fraction)
