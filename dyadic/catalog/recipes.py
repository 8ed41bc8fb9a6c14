"""How the shared test tables are read as the engine's logical tables, in Spark and in SQL.

The SQL fragments are CTE bodies; each mirrors the function above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadic.catalog.registry import table

# The visit text given to each order status.
VISIT_TEXT = {"O": " pre_iop", "F": "POST-IOP", "P": "BL"}


def cells(spark: SparkSession, d: str, pre: str = "O") -> DataFrame:
    """Paired long table: customers, order statuses as visits (`pre` and the others), priorities as features."""
    visit = F.when(F.col("o_orderstatus") == pre, "PRE").otherwise("POST")
    return (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("subject_id"), visit.alias("visit"), F.col("o_orderpriority").alias("feature_id"))
        .agg(F.avg("o_totalprice").alias("value"))
    )


def sql_cells(pre: str = "O") -> str:
    return f"""SELECT o_custkey AS subject_id, CASE o_orderstatus WHEN '{pre}' THEN 'PRE' ELSE 'POST' END AS visit,
 o_orderpriority AS feature_id, avg(o_totalprice) AS value FROM orders GROUP BY ALL"""


def sql_delta(source: str = "cells") -> str:
    return f"""SELECT subject_id, feature_id, max(CASE WHEN visit = 'PRE' THEN value END) AS pre,
 max(CASE WHEN visit = 'POST' THEN value END) AS post,
 max(CASE WHEN visit = 'POST' THEN value END) - max(CASE WHEN visit = 'PRE' THEN value END) AS delta
 FROM {source} GROUP BY ALL HAVING pre IS NOT NULL AND post IS NOT NULL"""


def visits(spark: SparkSession, d: str) -> DataFrame:
    """Sample rows: one per order, with a visit spelling and a response from the market segment."""
    text = F.when(F.col("o_orderstatus") == "O", VISIT_TEXT["O"]).when(F.col("o_orderstatus") == "F", VISIT_TEXT["F"]).otherwise(
        VISIT_TEXT["P"])
    response = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "R").otherwise("NR")
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("Subcode"), text.alias("Visit"), F.col("o_orderkey").alias("sample_id"),
        response.alias("response"), "o_totalprice",
    )


SQL_VISITS = """SELECT o_custkey AS subject_id, CASE o_orderstatus WHEN 'F' THEN 'POST' ELSE 'PRE' END AS visit,
 CASE o_orderstatus WHEN 'O' THEN ' pre_iop' WHEN 'F' THEN 'POST-IOP' ELSE 'BL' END AS raw, o_orderkey AS sample_id,
 CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'R' ELSE 'NR' END AS response, o_totalprice
 FROM orders JOIN customer ON o_custkey = c_custkey"""


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """Sparse wide-panel table: suppliers as samples, parts as features, summed quantity."""
    return table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("feature_id")
    ).agg(F.sum("l_quantity").alias("value"))


SQL_MATRIX = "SELECT l_suppkey AS sample_id, l_partkey AS feature_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"


def ragged(spark: SparkSession, d: str) -> DataFrame:
    """Panel with a few missing cells: suppliers as samples, brand and line number as features, mean price."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_suppkey").alias("sample_id"), F.concat_ws("|", "p_brand", "l_linenumber").alias("feature_id")
    ).agg((F.avg("l_extendedprice") / 1000).alias("value"))


SQL_RAGGED = """SELECT l_suppkey AS sample_id, concat_ws('|', p_brand, l_linenumber) AS feature_id, avg(l_extendedprice) / 1000 AS value
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"""


def design(spark: SparkSession, d: str) -> DataFrame:
    """Supplier design: binary response, two fractions, one covariate, one stratum."""
    s = table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("sample_id"), (F.col("s_nationkey") % 2).alias("response"),
        (F.abs("s_acctbal") / 10000.0).alias("frac_a"), (F.col("s_suppkey") * 7 % 11 / 11.0).alias("frac_b"),
        (F.col("s_nationkey") / 5.0).alias("age"), F.when(F.col("s_suppkey") % 3 == 0, "CPT").otherwise("PE").alias("therapy"),
    )


SQL_DESIGN = """SELECT s_suppkey AS sample_id, CAST(s_nationkey % 2 AS DOUBLE) AS response,
 abs(s_acctbal) / CAST(10000 AS DOUBLE) AS frac_a, CAST(s_suppkey * 7 % 11 AS DOUBLE) / 11 AS frac_b,
 CAST(s_nationkey AS DOUBLE) / 5 AS age, CASE WHEN s_suppkey % 3 = 0 THEN 'CPT' ELSE 'PE' END AS therapy FROM supplier"""


def dense(spark: SparkSession, d: str) -> DataFrame:
    """Complete long table: vectors as samples, dimensions as features."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("feature_id", "value")
    ).withColumn("value", F.col("value").cast("double"))


SQL_DENSE = """SELECT vec_id AS sample_id, CAST(unnest(range(0, len(embedding))) AS BIGINT) AS feature_id,
 CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with a 0/1 label, a subject and a visit."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("subject_id"), (F.col("label") < 5).cast("int").alias("label"),
        F.transform("embedding", lambda v: v.cast("double")).alias("z"), F.col("label").alias("class"),
    )


SQL_POINTS = "SELECT vec_id AS subject_id, CAST(label < 5 AS INT) AS label, label AS class FROM embeddings"


def factor_scores(spark: SparkSession, d: str) -> DataFrame:
    """Factor scores: two consecutive vectors are a subject's visits, dimensions are factors."""
    return table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 2).alias("subject_id"), (F.col("vec_id") % 2).cast("int").alias("visit"),
        F.posexplode("embedding").alias("factor", "value"),
    ).withColumn("value", F.col("value").cast("double"))


SQL_FACTORS = """SELECT CAST(floor(vec_id / 2) AS BIGINT) AS subject_id, vec_id % 2 AS visit,
 CAST(unnest(range(0, len(embedding))) AS BIGINT) AS factor, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings"""


def deltas(spark: SparkSession, d: str) -> DataFrame:
    """Per-subject difference vectors of consecutive vectors, with a flag and a target."""
    e = table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 2).alias("subject_id"), (F.col("vec_id") % 2).alias("visit"),
        F.transform("embedding", lambda v: v.cast("double")).alias("e"), "label")
    both = e.groupBy("subject_id").agg(
        F.max_by("e", F.when(F.col("visit") == 0, 1).otherwise(0)).alias("a"),
        F.max_by("e", F.when(F.col("visit") == 1, 1).otherwise(0)).alias("b"),
        F.max(F.when(F.col("visit") == 0, F.col("label"))).alias("first"), F.sum("label").cast("double").alias("target"),
        F.count(F.lit(1)).alias("k"),
    ).filter("k = 2")
    return both.select(
        "subject_id", (F.col("first") < 5).alias("responder"), "target", F.zip_with("b", "a", lambda x, y: x - y).alias("z"))


# Long form (subject_id, responder, target, i, z) of the same.
SQL_DELTAS = """SELECT subject_id, responder, target, CAST(i AS BIGINT) AS i, b[i] - a[i] AS z FROM (
 SELECT CAST(floor(x.vec_id / 2) AS BIGINT) AS subject_id, x.label < 5 AS responder, CAST(x.label + y.label AS DOUBLE) AS target,
 CAST(x.embedding AS DOUBLE[]) AS a, CAST(y.embedding AS DOUBLE[]) AS b, unnest(range(1, len(x.embedding) + 1)) AS i
 FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0)"""


def plane(column: str = "z"):
    """A vector's coordinates under two fixed loadings: the sums of its even and of its odd places."""
    def total(rest):
        return F.aggregate(F.filter(column, lambda v, i: i % 2 == rest), F.lit(0.0), lambda a, v: a + v)

    return F.array(total(0), total(1))


def plane_deltas(spark: SparkSession, d: str) -> DataFrame:
    """`deltas` on the two fixed loadings."""
    return deltas(spark, d).withColumn("z", plane())


SQL_PLANE = f"""SELECT subject_id, responder, target, sum(z) FILTER (i % 2 = 1) AS x, sum(z) FILTER (i % 2 = 0) AS y FROM ({SQL_DELTAS}) GROUP BY ALL"""


def two_views(spark: SparkSession, d: str) -> DataFrame:
    """One feature per view: the sums of a vector's first and second half, as (view, obs_id, feature_id, value)."""
    half = F.max("feature_id").over(W.partitionBy("sample_id")) / 2.0
    rows = dense(spark, d).withColumn("view", F.when(F.col("feature_id") < half, "dnam").otherwise("rna"))
    return rows.groupBy("view", F.col("sample_id").alias("obs_id")).agg(F.sum("value").alias("value")).withColumn("feature_id", F.lit(1))


def wide_views(spark: SparkSession, d: str) -> DataFrame:
    """All features of two views: the first 40 dimensions and the others, as (view, obs_id, feature_id, value)."""
    view = F.when(F.col("feature_id") < 40, "dnam").otherwise("rna")
    return dense(spark, d).withColumn("view", view).withColumnRenamed("sample_id", "obs_id")


SQL_VIEWS = f"""SELECT sample_id AS obs_id, sum(value) FILTER (feature_id < h) AS x, sum(value) FILTER (feature_id >= h) AS y
 FROM (SELECT *, max(feature_id) OVER (PARTITION BY sample_id) / CAST(2 AS DOUBLE) AS h FROM ({SQL_DENSE})) GROUP BY 1"""


def sql_pair_factors(source: str, out: str) -> str:
    """CTE `out(obs_id, factor, value)`: both components of a CTE (obs_id, x, y) of two columns, up to their signs."""
    return f"""{out}_z AS (SELECT obs_id, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS zx, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS zy, sign(corr(x, y) OVER ()) AS s FROM {source}),
 {out} AS (SELECT obs_id, 0 AS factor, (zx + s * zy) / sqrt(2) AS value FROM {out}_z UNION ALL SELECT obs_id, 1, (zx - s * zy) / sqrt(2) FROM {out}_z)"""


def network(spark: SparkSession, d: str) -> DataFrame:
    """Part types as sources, parts as targets, size signed by brand parity as weight."""
    odd = F.substring("p_brand", -1, 1).cast("int") % 2 == 1
    return table(spark, d, "part").select(
        F.col("p_type").alias("source"), F.col("p_partkey").alias("target"),
        (F.when(odd, F.col("p_size")).otherwise(-F.col("p_size"))).cast("double").alias("weight"),
    )


SQL_NETWORK = """SELECT p_type AS source, p_partkey AS target, CAST(CASE WHEN CAST(right(p_brand, 1) AS INT) % 2 = 1
 THEN p_size ELSE -p_size END AS DOUBLE) AS weight FROM part"""


def spots(spark: SparkSession, d: str) -> DataFrame:
    """Events as 1-bp sites: type as chromosome, epoch seconds as position."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", epoch, F.col("ts").cast("timestamp_ntz"))
    return table(spark, d, "events").select(
        F.col("event_id").alias("feature_id"), F.col("event_type").alias("chrom"),
        seconds.alias("start"), (seconds + 1).alias("end"))


SQL_SPOTS = """SELECT event_id AS feature_id, event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS start,
 CAST(floor(epoch(ts)) AS BIGINT) + 1 AS "end" FROM events"""


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Target intervals of three sets: order days shifted onto the event months, one hour each."""
    o = table(spark, d, "orders")
    span = 30 * 86400
    start = F.lit(1704067200) + F.pmod(F.col("o_orderkey") * 7919, F.lit(span))
    kinds = F.element_at(F.array(*[F.lit(c) for c in EVENT_TYPES]), (F.col("o_custkey") % 5 + 1).cast("int"))
    return o.select(
        F.col("o_orderstatus").alias("set_name"), kinds.alias("chrom"), start.cast("bigint").alias("start"),
        (start + F.col("o_custkey") % 60 + 1).cast("bigint").alias("end"))


# The event types, used as chromosomes.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

SQL_REGIONS = """SELECT o_orderstatus AS set_name, (['click', 'error', 'purchase', 'signup', 'view'])[o_custkey % 5 + 1] AS chrom,
 1704067200 + (o_orderkey * 7919) % 2592000 AS start, 1704067200 + (o_orderkey * 7919) % 2592000 + o_custkey % 60 + 1 AS "end"
 FROM orders"""


def hashed_p(*parts):
    """A uniform number from a hash, as a stand-in p-value."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") + 1) / F.lit(4294967297.0)


def sql_hashed_p(*parts: str) -> str:
    text = "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"((CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) + 1) / CAST(4294967297 AS DOUBLE))"


def results(spark: SparkSession, d: str, tag: str = "a") -> DataFrame:
    """Result-like table: parts as features, types as cell types, hashed p and a size-based effect."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("feature_id"), F.col("p_type").alias("cell_type"),
        (hashed_p(F.lit(tag), F.col("p_partkey")) * hashed_p(F.lit(tag), F.col("p_brand"), F.col("p_partkey"))).alias("p_val"),
        ((F.col("p_size") - 25) * hashed_p(F.lit(tag), F.lit("coef"), F.col("p_partkey"))).alias("coef"),
        (hashed_p(F.lit(tag), F.lit("q"), F.col("p_partkey")) / 2).alias("q_val"),
    )


def sql_results(tag: str = "a") -> str:
    p = sql_hashed_p(f"'{tag}'", "p_partkey")
    p2 = sql_hashed_p(f"'{tag}'", "p_brand", "p_partkey")
    c = sql_hashed_p(f"'{tag}'", "'coef'", "p_partkey")
    q = sql_hashed_p(f"'{tag}'", "'q'", "p_partkey")
    return (f"SELECT p_partkey AS feature_id, p_type AS cell_type, {p} * {p2} AS p_val, (p_size - 25) * {c} AS coef, "
            f"{q} / 2 AS q_val FROM part")
