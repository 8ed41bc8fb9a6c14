"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadic.session import materialize, small_side

# A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def matches(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of `docs` (doc_id, text) with `keys` (doc_id, text_hash); null ids match null ids.

    The keys are broadcast while they are counted to be few; otherwise both sides are shuffled.
    """
    doc, text = fresh(docs, "_id", "_hash")
    keys = keys.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text))
    return docs.join(small_side(keys), F.col("doc_id").eqNullSafe(F.col(doc)) & F.xxhash64("text").eqNullSafe(F.col(text)), how)


def running_total(df: DataFrame, by: Sequence[str], bucket: str, order: Sequence, value: Column, name: str) -> DataFrame:
    """Add `name`, the sum of `value` over the earlier rows of a group, in the order (bucket, *order).

    `bucket` cuts a group into stretches of a bounded number of rows. Only a stretch is sorted in one task; the
    stretches' totals are summed apart and joined back, so a group of any size is spread over the cluster.
    """
    keys = [*by, bucket]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    offsets = totals.select(*keys, F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_offset"))
    rows = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(offsets, keys).withColumn(name, F.col("_within") + F.col("_offset")).drop("_within", "_offset")


def hot_join(rows: DataFrame, side: DataFrame, key: str, parts: int = 1024) -> DataFrame:
    """Left join of `rows` with `side`, which has one row per `key`, however the keys of `rows` are spread.

    Keys with more than one row in `parts` are at most `parts` many, so their rows of `side` are broadcast and the rows
    that hold them stay where they are; all others are shuffled. `rows` should be a stored table, as it is read twice.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    hot = materialize(counts.filter(F.col("_n") * parts > total).filter(F.col(key).isNotNull()).select(key))
    if hot.isEmpty():
        return rows.join(side, key, "left")
    few = materialize(side.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, "left").unionByName(
        rows.join(F.broadcast(hot), key, "left_anti").join(side, key, "left"))
