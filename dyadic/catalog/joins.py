"""Queries: joins, pairing and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.catalog import recipes as R
from dyadic.catalog.registry import query, rounded, sr6, table
from dyadic.operators import enrichment, multivariate, pairing, selection
from dyadic.sources import tables


@query("check_alignment", "SELECT DISTINCT l_suppkey AS sample_id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000)")
def check_alignment(spark, d):
    samples = table(spark, d, "supplier").filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("sample_id"))
    return pairing.check_alignment(R.matrix(spark, d), samples)


@query("crosswalk", """
WITH m AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
SELECT c_custkey, c_mktsegment, o_orderkey AS renamed FROM customer LEFT JOIN m ON o_custkey = c_custkey AND k = 1""")
def crosswalk(spark, d):
    mapping = table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("renamed"), F.struct("o_orderdate", "o_orderkey").alias("place"))
    out = pairing.crosswalk(table(spark, d, "customer"), mapping, "c_custkey", "renamed", F.col("place"), "left")
    return out.select("c_custkey", "c_mktsegment", "renamed")


def _sql_pairs(pick: str, having: str) -> str:
    return f"""SELECT subject_id, {pick}(sample_id) FILTER (visit = 'PRE') AS pre_id, {pick}(sample_id) FILTER (visit = 'POST') AS post_id,
 any_value(response) AS response FROM v GROUP BY subject_id HAVING {having}"""


@query("pair_subjects", f"""
WITH v AS ({R.SQL_VISITS}) SELECT 'any' AS rule, * FROM ({_sql_pairs('min', "count(*) FILTER (visit = 'PRE') > 0 AND count(*) FILTER (visit = 'POST') > 0")})
UNION ALL SELECT 'last', * FROM ({_sql_pairs('max', "count(*) FILTER (visit = 'PRE') > 0 AND count(*) FILTER (visit = 'POST') > 0")})
UNION ALL SELECT 'exactly_one', * FROM ({_sql_pairs('min', "count(*) FILTER (visit = 'PRE') = 1 AND count(*) FILTER (visit = 'POST') = 1")})""")
def pair_subjects(spark, d):
    rows = tables.canonical_samples(R.visits(spark, d)).withColumn("subject_id", F.col("Subcode"))
    return pairing.union_tagged({r: pairing.pair_subjects(rows, r) for r in ("any", "last", "exactly_one")}, "rule").select(
        "rule", "subject_id", "pre_id", "post_id", "response")


@query("pair_by_name", """
WITH v AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'BL' WHEN 'F' THEN '12W' END AS vis FROM orders),
 n AS (SELECT CAST(o_custkey AS VARCHAR) AS subject_id, max(o_custkey || '-' || vis) FILTER (vis = 'BL') AS pre_id,
  max(o_custkey || '-' || vis) FILTER (vis = '12W') AS post_id FROM v GROUP BY 1)
SELECT * FROM n WHERE pre_id IS NOT NULL AND post_id IS NOT NULL""")
def pair_by_name(spark, d):
    suffix = F.when(F.col("o_orderstatus") == "O", "-BL").when(F.col("o_orderstatus") == "F", "-12W").otherwise("_other")
    names = table(spark, d, "orders").select(F.concat(F.col("o_custkey"), suffix).alias("sample_id"), F.lit("R").alias("response"))
    return pairing.pair_subjects(pairing.subjects_from_names(names), "last").drop("response")


@query("paired_delta", f"""
WITH cells AS ({R.sql_cells()}) SELECT subject_id, feature_id, {sr6('pre')} AS pre, {sr6('post')} AS post, {sr6('delta')} AS delta FROM ({R.sql_delta()})""")
def paired_delta(spark, d):
    return rounded(pairing.paired_delta(R.cells(spark, d)).select("subject_id", "feature_id", "pre", "post", "delta"))


@query("paired_delta_by_id", f"""
WITH v AS ({R.SQL_VISITS}), p AS ({_sql_pairs('min', "count(*) FILTER (visit = 'PRE') > 0 AND count(*) FILTER (visit = 'POST') > 0")}),
 f AS (SELECT l_orderkey AS sample_id, l_linenumber AS feature_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)
SELECT subject_id, CAST(a.feature_id AS BIGINT) AS feature_id, {sr6('b.value - a.value')} AS delta
FROM p JOIN f a ON a.sample_id = pre_id JOIN f b ON b.sample_id = post_id AND a.feature_id = b.feature_id""")
def paired_delta_by_id(spark, d):
    rows = tables.canonical_samples(R.visits(spark, d)).withColumn("subject_id", F.col("Subcode"))
    features = table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("feature_id")).agg(F.sum("l_quantity").alias("value"))
    return rounded(pairing.paired_delta_by_id(features, pairing.pair_subjects(rows)).select("subject_id", "feature_id", "delta"))


@query("scalar_delta", f"""
WITH u AS (SELECT user_id AS subject_id, event_type IN ('view', 'click') AS pre, avg(value) AS v FROM events GROUP BY ALL)
SELECT subject_id, {sr6("max(v) FILTER (NOT pre) - max(v) FILTER (pre)")} AS delta FROM u GROUP BY subject_id""")
def scalar_delta(spark, d):
    visit = F.when(F.col("event_type").isin("view", "click"), "PRE").otherwise("POST")
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("subject_id"), visit.alias("visit")).agg(F.avg("value").alias("v")).select(
        "subject_id", "visit", F.col("v").cast("string").alias("score"), F.lit("R").alias("response"), F.col("visit").alias("sample_id"))
    return rounded(pairing.scalar_delta(rows, "score").select("subject_id", "delta"))


@query("feature_intersection", "SELECT DISTINCT l_partkey AS feature_id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def feature_intersection(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "feature_id")
    return pairing.feature_intersection(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'N'"), minimum=50)


@query("align_views", """
SELECT s_suppkey AS sample_id, s_name FROM supplier WHERE s_suppkey IN (SELECT CASE WHEN l_suppkey % 5 = 2 THEN -l_suppkey ELSE l_suppkey END FROM lineitem)
 AND s_suppkey IN (SELECT CASE WHEN ps % 7 = 3 THEN -ps ELSE ps END FROM (SELECT CAST(l_partkey % 100 + 1 AS BIGINT) AS ps FROM lineitem))""")
def align_views(spark, d):
    # Some ids of each view are turned into ids that match nothing.
    key = lambda c, m, r: F.when(c % m == r, -c).otherwise(c).alias("sample_id")
    li = table(spark, d, "lineitem")
    shared = pairing.align_views([li.select(key(F.col("l_suppkey"), 5, 2)), li.select(key(F.col("l_partkey") % 100 + 1, 7, 3))])
    meta = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), "s_name")
    return meta.join(shared, "sample_id", "left_semi")


@query("join_prefixed", f"""
SELECT s_suppkey AS sample_id, s_name, m AS epidish_cents, m IS NOT NULL AS matched FROM supplier
LEFT JOIN (SELECT CASE WHEN l_suppkey % 5 = 2 THEN -l_suppkey ELSE l_suppkey END AS k, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS m FROM lineitem GROUP BY 1) ON k = s_suppkey""")
def join_prefixed(spark, d):
    key = F.when(F.col("l_suppkey") % 5 == 2, -F.col("l_suppkey")).otherwise(F.col("l_suppkey"))  # some match no supplier
    extra = table(spark, d, "lineitem").groupBy(key.alias("sample_id")).agg(F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("cents"))
    samples = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), "s_name")
    return rounded(pairing.join_prefixed(samples, extra, "epidish_"))


@query("cross_contrast_class", f"""
WITH a AS ({R.sql_results('a')}), b AS ({R.sql_results('b')}), c AS ({R.sql_results('c')}),
 j AS (SELECT c.feature_id, c.cell_type, c.q_val < 0.1 AS d, coalesce(a.q_val < 0.1, false) OR coalesce(b.q_val < 0.1, false) AS e
 FROM c LEFT JOIN a ON a.feature_id = c.feature_id AND a.feature_id % 3 > 0 LEFT JOIN b ON b.feature_id = c.feature_id)
SELECT feature_id, cell_type, CASE WHEN d AND NOT e THEN 'state_of_recovery' WHEN d THEN 'baseline_and_recovery' WHEN e THEN 'trait_stable' ELSE 'other' END AS cross_contrast_class FROM j""")
def cross_contrast_class(spark, d):
    pre = R.results(spark, d, "a").withColumn("q_val", F.when(F.col("feature_id") % 3 > 0, F.col("q_val")))  # some untested
    return pairing.cross_contrast_class(pre, R.results(spark, d, "b"), R.results(spark, d, "c"), 0.1)


@query("interval_semi_join", f"""
WITH q AS ({R.SQL_SPOTS}), t AS ({R.SQL_REGIONS})
SELECT DISTINCT feature_id, set_name FROM q JOIN t ON q.chrom = t.chrom AND t.start < q."end" AND t."end" > q.start""")
def interval_semi_join(spark, d):
    return enrichment.overlap_members(R.spots(spark, d), R.regions(spark, d))


@query("interval_semi_join_closed", f"""
WITH q AS ({R.SQL_SPOTS}), t AS ({R.SQL_REGIONS})
SELECT set_name, count(DISTINCT feature_id) AS n FROM q JOIN t ON q.chrom = t.chrom AND t.start <= q."end" AND t."end" >= q.start GROUP BY set_name""")
def interval_semi_join_closed(spark, d):
    hit = enrichment.overlap_members(R.spots(spark, d), R.regions(spark, d), closed=True)
    return hit.groupBy("set_name").agg(F.count(F.lit(1)).alias("n"))


@query("cis_map", """
SELECT DISTINCT l_suppkey AS gene FROM lineitem WHERE abs(l_extendedprice - 50000) / 100 <= 100
 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)""")
def cis_map(spark, d):
    gene_map = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("gene"), ((F.col("l_extendedprice") - 50000) / 100).alias("distance_kb"))
    return selection.cis_map(table(spark, d, "part").filter("p_size < 5").select(F.col("p_partkey").alias("feature_id")), gene_map)


@query("annotate_explode", """
SELECT DISTINCT p_type AS cell_type, trim(g) AS gene_id FROM (SELECT p_type, unnest(string_split(CASE WHEN p_size % 5 = 0 THEN p_brand
 ELSE replace(p_name, ' ', '; ') END, ';')) AS g FROM part) WHERE trim(g) <> ''""")
def annotate_explode(spark, d):
    p = table(spark, d, "part")
    features = p.select(F.col("p_type").alias("cell_type"), F.col("p_partkey").alias("feature_id"))
    gene = F.when(F.col("p_size") % 5 == 0, F.when(F.col("p_size") % 2 == 0, "NA").otherwise(" ")).otherwise(
        F.concat(F.regexp_replace("p_name", " ", "; "), F.lit(";")))
    notes = p.select(F.col("p_partkey").alias("feature_id"), gene.alias("gene"), F.col("p_brand").alias("fallback"))
    return enrichment.annotate_explode(features, notes)


@query("hit_lookup", f"""
WITH a AS ({R.sql_results('a')}), b AS ({R.sql_results('b')})
SELECT a.feature_id, a.cell_type, {sr6('a.coef')} AS coef, {sr6('b.coef')} AS other_coef, {sr6('b.p_val')} AS other_p_val, b.coef IS NOT NULL AS matched
FROM a LEFT JOIN b ON a.feature_id = b.feature_id AND a.cell_type = b.cell_type AND b.p_val < 0.5 WHERE a.q_val < 0.2""")
def hit_lookup(spark, d):
    hits = R.results(spark, d, "a").filter("q_val < 0.2")
    out = pairing.hit_lookup(hits, R.results(spark, d, "b").filter("p_val < 0.5"))
    return rounded(out.select("feature_id", "cell_type", "coef", "other_coef", "other_p_val", "matched"))


@query("activity_feature_join", f"""
WITH cells AS ({R.sql_cells()}), v AS (SELECT DISTINCT subject_id, visit, response FROM ({R.SQL_VISITS}))
SELECT subject_id, visit, feature_id, {sr6('value')} AS value, response FROM cells JOIN v USING (subject_id, visit)""")
def activity_feature_join(spark, d):
    samples = tables.canonical_samples(R.visits(spark, d)).select(F.col("Subcode").alias("subject_id"), "visit", "response").distinct()
    out = pairing.activity_feature_join(R.cells(spark, d), samples)
    return rounded(out.select("subject_id", "visit", "feature_id", "value", "response"))


@query("visit_stack", f"""
WITH cells AS ({R.sql_cells()}), dl AS ({R.sql_delta()})
SELECT subject_id, feature_id, 0::BIGINT AS visit, {sr6('pre')} AS value FROM dl UNION ALL SELECT subject_id, feature_id, 1, {sr6('post')} FROM dl""")
def visit_stack(spark, d):
    return rounded(pairing.visit_stack(pairing.paired_delta(R.cells(spark, d))))


@query("project", f"""
WITH f AS ({R.SQL_MATRIX}), l AS (SELECT p_partkey AS feature_id, c AS component, sin(p_partkey * c) AS loading FROM part, (SELECT unnest([1, 2, 3]) AS c))
SELECT sample_id, CAST(component AS BIGINT) AS component, {sr6('sum(value * loading)')} AS coordinate FROM f JOIN l USING (feature_id) GROUP BY ALL""")
def project(spark, d):
    loadings = table(spark, d, "part").select(
        F.col("p_partkey").alias("feature_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("component")
    ).withColumn("loading", F.sin(F.col("feature_id") * F.col("component")))
    return rounded(multivariate.project(R.matrix(spark, d), loadings))
