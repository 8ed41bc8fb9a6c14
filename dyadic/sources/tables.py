"""Matrices, sample tables, guarded reads and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.functions.columns import finite_or_null, normalise_visit

PROVENANCE_SUFFIX = "_provenance"


def _read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    name = path.rstrip("/").lower()
    if name.endswith((".csv", ".tsv", ".txt")):
        reader = spark.read.option("header", True).option("sep", "," if name.endswith(".csv") else "\t")
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.parquet(path)


def read_matrix_long(
    spark: SparkSession, path: str, orientation: str = "features", key: str | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Wide matrix (parquet, CSV, TSV/TXT) to (feature_id, sample_id, value).

    `orientation` names what the rows are: features or samples. `key` is the id
    column, the first by default; `columns` restricts the wide columns read, so
    the scan touches only those. Values that are no finite number become NULL.
    """
    wide = _read(spark, path)
    key = key or wide.columns[0]
    return unpivot_matrix(wide, key, orientation, columns)


def unpivot_matrix(wide: DataFrame, key: str, orientation: str = "features", columns: list[str] | None = None) -> DataFrame:
    """Wide DataFrame to long rows."""
    names = [c for c in wide.columns if c != key] if columns is None else list(columns)
    typed = wide.select(F.col(key).cast("string").alias("_key"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names])
    row, col = ("feature_id", "sample_id") if orientation == "features" else ("sample_id", "feature_id")
    return typed.unpivot("_key", [F.col(f"`{c}`") for c in names], col, "value").select(
        F.col("_key").alias(row), col, finite_or_null(F.col("value")).alias("value")
    ).select("feature_id", "sample_id", "value")


def read_samples(
    spark: SparkSession, path: str, subject: str = "Subcode", visit: str = "Visit", schema: T.StructType | None = None
) -> DataFrame:
    """Sample metadata with canonical subject_id, visit and `{subject}-{visit as written}` key."""
    return canonical_samples(_read(spark, path, schema), subject, visit)


def canonical_samples(raw: DataFrame, subject: str = "Subcode", visit: str = "Visit") -> DataFrame:
    missing = [c for c in (subject, visit) if c not in raw.columns]
    if missing:
        raise ValueError(f"sample table lacks columns {missing}")
    return raw.withColumns(
        {
            "subject_id": F.col(subject).cast("string"),
            "subject_visit": F.concat_ws("-", F.col(subject).cast("string"), F.col(visit)),
            "visit": normalise_visit(F.col(visit)),
        }
    )


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A result table, or None if it is absent or empty."""
    from pyspark.errors import AnalysisException

    try:
        df = _read(spark, path)
        return None if df.isEmpty() else df
    except AnalysisException:
        return None


def read_cloud(spark: SparkSession, cloud: str, samples_path: str | None = None, centroid_path: str | None = None,
               group: str | None = None) -> DataFrame:
    """A reference cloud (cloud, sample_id, feature_id, value) from a wide file of samples, or, where there are no samples,
    from the row `group` of a wide file of group centroids, which then stands in as the cloud's only row."""
    if samples_path is not None:
        long = read_matrix_long(spark, samples_path, "samples")
    elif centroid_path is not None:
        long = read_matrix_long(spark, centroid_path, "samples").filter(F.col("sample_id") == group)
        if long.isEmpty():
            raise ValueError(f"no centroid of group {group}")
    else:
        raise ValueError("a cloud needs its samples or its centroid")
    return long.select(F.lit(cloud).alias("cloud"), "sample_id", "feature_id", "value")


def to_wide(features: DataFrame, columns: list[str], row: str = "sample_id", column: str = "feature_id",
            value: str = "value") -> DataFrame:
    """One column per named id. Meant for small panels; use `to_vectors` for large ones."""
    return features.groupBy(row).pivot(column, columns).agg(F.first(value))


def to_vectors(features: DataFrame, row: str = "sample_id", column: str = "feature_id", value: str = "value",
               out: str = "z") -> DataFrame:
    """One array per row id, ordered by column id."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(column), F.col(value))))
    return features.groupBy(row).agg(packed.alias("_p")).select(row, F.transform("_p", lambda p: p[value]).alias(out))


def from_vectors(vectors: DataFrame, row: str, vector: str = "z", column: str = "feature_id") -> DataFrame:
    """Array rows to long rows; column ids are positions from 0."""
    return vectors.select(
        *[c for c in vectors.columns if c != vector], F.posexplode(vector).alias(column, "value")
    ).withColumn("value", F.col("value").cast("double"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a result as parquet, CSV or TSV."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt in ("csv", "tsv"):
        writer.option("header", True).option("sep", "," if fmt == "csv" else "\t").csv(path)
    else:
        raise ValueError(f"unknown table format {fmt}")


def table_digest(df: DataFrame) -> DataFrame:
    """Digest of a table's rows and columns as one row (n_rows, low, high, columns), whatever the order of either.

    A row's values, in the order of their column names and each with its length, are hashed by md5; the digest sums two
    48-bit pieces of it, so repeated and missing rows show and any SQL engine can repeat it. One partially aggregated pass.
    """
    names = sorted(df.columns)
    cells = [F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]
    sizes = [F.when(F.col(f"`{n}`").isNull(), F.lit("-")).otherwise(F.length(c).cast("string")) for n, c in zip(names, cells)]
    row = F.md5(F.concat(*[x for size, cell in zip(sizes, cells) for x in (size, F.lit(":"), cell, F.lit(";"))]))
    part = [F.coalesce(F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for at in (1, 13)]
    kinds = ",".join(f"{n} {t}" for n, t in sorted(df.dtypes))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), part[0].alias("low"), part[1].alias("high")).withColumn("columns", F.lit(kinds))


def _digest_text(df: DataFrame) -> str:
    return "|".join(str(v) for v in table_digest(df).first())


def stamp_provenance(spark: SparkSession, path: str, cv_loop_safe: bool, selection_stage: str) -> None:
    """Write the one-row provenance table beside a feature table that is there already; it holds the table's digest."""
    spark.range(1).select(
        F.lit(cv_loop_safe).alias("cv_loop_safe"), F.lit(selection_stage).alias("selection_stage"),
        F.lit(_digest_text(spark.read.parquet(path))).alias("digest"),
    ).coalesce(1).write.mode("overwrite").json(path.rstrip("/") + PROVENANCE_SUFFIX)


def check_provenance(spark: SparkSession, path: str) -> dict:
    """Provenance of a feature table; refuses a missing stamp and one that is not safe for cross-validation."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.json(path.rstrip("/") + PROVENANCE_SUFFIX).limit(2).collect()
    except AnalysisException:
        rows = []
    if len(rows) != 1:
        raise PermissionError(f"{path} carries no provenance; its selection history is unknown")
    stamp = rows[0].asDict()
    if str(stamp.get("cv_loop_safe")).strip().lower() != "true":
        raise PermissionError(
            f"{path} is stamped cv_loop_safe={stamp.get('cv_loop_safe')} at stage {stamp.get('selection_stage')}; "
            "select features inside the training folds instead"
        )
    return stamp


def guarded_read(spark: SparkSession, path: str) -> DataFrame:
    """Read a feature table for modelling; refuses unsafe, unstamped, changed or empty ones.

    The stamp belongs to the table only if its digest is that of the rows read, so a changed, cut or swapped table is
    refused, and so is a stamp without a digest.
    """
    stamp = check_provenance(spark, path)
    rows = _non_empty(spark.read.parquet(path), path)
    if stamp.get("digest") != _digest_text(rows):
        raise PermissionError(f"{path} is not the table that its provenance was written for")
    return rows


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Read a candidate table; the caller selects features per training fold."""
    return _non_empty(spark.read.parquet(path), path)


def _non_empty(df: DataFrame, path: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{path} is empty")
    return df


def non_finite_report(features: DataFrame, value: str = "value") -> DataFrame:
    """Row count, count of missing or non-finite values and the first offender by (sample, feature), as one row."""
    bad = finite_or_null(F.col(value)).isNull()
    first = F.min(F.when(bad, F.struct("sample_id", "feature_id")))
    return features.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"),
        first["sample_id"].alias("first_sample"), first["feature_id"].alias("first_feature"),
    )


def assert_finite(features: DataFrame, what: str = "feature table") -> DataFrame:
    """Return the table if it has rows and all values are finite, else raise naming the first offender."""
    row = non_finite_report(features).first()
    if row["n_rows"] == 0:
        raise ValueError(f"{what} has no rows")
    if row["n_bad"]:
        raise ValueError(
            f"{what} carries {row['n_bad']} non-finite value(s); first at sample {row['first_sample']}, "
            f"feature {row['first_feature']}"
        )
    return features


def label_share(samples: DataFrame, flag: Column) -> DataFrame:
    return samples.agg(F.avg(flag.cast("double")).alias("share"), F.count(flag).alias("n"))


def assert_label_balance(samples: DataFrame, flag: Column, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Return the table if the share of flagged rows lies in [low, high]."""
    share = label_share(samples, flag).first()["share"]
    if share is None or not low <= share <= high:
        raise ValueError(f"share of positive labels is {share}, outside [{low}, {high}]")
    return samples


def counts_summary(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def coverage_per_sample(features: DataFrame) -> DataFrame:
    """Non-missing values per sample."""
    return features.groupBy("sample_id").agg(F.count(finite_or_null(F.col("value"))).alias("n_values"))
