"""Session settings and the guards that decide between a local and a spread-out plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows one task may sort in a window before the work is split over range buckets.
TASK_ROWS = 2_000_000
# Rows and estimated bytes up to which a side is broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 256 << 20

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lets `row_number() <= n` prune inside every map task for panels up to 20k features.
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def tuned_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings the operators are tuned for; `extra` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        path = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, in the folder that holds the checkpoints."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    Used before a table is joined with something derived from itself: floating
    point sums may differ in the last bit when recomputed, so both sides must
    read the same stored values.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores again, in up to four tasks each if the session shuffles to more.

    For rows that an ordering, a small file or a coalesced join left in few tasks and that take much work each.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(min(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), 4 * cores), *keys)


def fits(df: DataFrame, rows: int) -> bool:
    """True if `df` has at most `rows` rows; stops counting just past the bound."""
    return df.limit(rows + 1).count() <= rows


def _cell_bytes(name: str, kind: T.DataType) -> Column:
    """Estimated size of one cell; arrays count by their length, strings by theirs."""
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.length(col), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        each = 8 * (len(inner.fields) + 1) if isinstance(inner, T.StructType) else 32 if isinstance(inner, T.StringType) else 8
        return F.greatest(F.size(col), F.lit(0)) * each + 16
    return F.lit(8 * (len(kind.fields) + 1) if isinstance(kind, T.StructType) else 8)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, stored, and marked for broadcast only if it is counted to be within `rows` and `size` bytes.

    It is stored first, so what it is made from runs once and both the count and the join read the same values. Beyond
    the bounds the join is left to Spark (sort-merge with AQE skew splitting).
    """
    stored = materialize(df)
    width = sum((_cell_bytes(f.name, f.dataType) for f in stored.schema.fields), F.lit(8))
    n, wide = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()
    return F.broadcast(stored) if n <= rows and wide <= size else stored


def collect_bounded(df: DataFrame, rows: int, what: str) -> list:
    """Collect a table whose size is bounded by design, refusing anything larger."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"{what}: more than {rows} rows would reach the driver")
    return got
