"""Queries: sources, scalar columns, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.catalog import recipes as R
from dyadic.catalog.registry import big, query, r6, rounded, sr6, table
from dyadic.functions import columns as C
from dyadic.functions import verdicts as V
from dyadic.operators import enrichment, pairing, ranking, selection
from dyadic.session import scratch_path
from dyadic.sources import tables

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("read_matrix_long", f"""
WITH long AS (UNPIVOT (SELECT l_orderkey, l_linenumber, {', '.join(MEASURES)} FROM lineitem) ON {', '.join(MEASURES)} INTO NAME feature_id VALUE value)
SELECT feature_id, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_samples, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
 min(value) AS low, max(value) AS high FROM long GROUP BY feature_id""")
def read_matrix_long(spark, d):
    return _matrix_summary(tables.read_matrix_long(spark, f"{d}/lineitem.parquet", "samples", "l_orderkey", MEASURES))


def _matrix_summary(long):
    """Counts and exact sums in hundredths; a rounded mean of two-decimal values can sit on a tie."""
    return long.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("sample_id").alias("n_samples"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
        F.min("value").alias("low"), F.max("value").alias("high"))


_SQL_FILE = f"""
WITH wide AS (SELECT p_partkey, sum(l_quantity) FILTER (l_linestatus = 'O') AS open, sum(l_quantity) FILTER (l_linestatus = 'F') AS closed FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
 long AS (SELECT p_partkey, 'open' AS s, open AS v FROM wide UNION ALL SELECT p_partkey, 'closed', closed FROM wide)
SELECT s AS sample_id, count(*) AS n_rows, count(v) AS n_values, count(DISTINCT p_partkey) AS n_features, CAST(sum(v) AS BIGINT) AS total FROM long GROUP BY 1"""


def _file_summary(spark, d, ending: str, sep: str):
    """A matrix of parts by line status written as text and read back."""
    status = F.col("l_linestatus")
    wide = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_partkey").agg(
        F.sum(F.when(status == "O", F.col("l_quantity"))).alias("open"), F.sum(F.when(status == "F", F.col("l_quantity"))).alias("closed"))
    path = scratch_path(spark, "matrix") + ending
    wide.write.option("header", True).option("sep", sep).csv(path)
    long = tables.read_matrix_long(spark, path)
    return long.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.countDistinct("feature_id").alias("n_features"),
        F.sum(F.col("value").cast("bigint")).alias("total"))


@query("read_matrix_csv", _SQL_FILE)
def read_matrix_csv(spark, d):
    return _file_summary(spark, d, ".csv", ",")


@query("read_matrix_tsv", _SQL_FILE)
def read_matrix_tsv(spark, d):
    return _file_summary(spark, d, ".tsv", "\t")


@query("read_samples_file", f"""
WITH v AS ({R.SQL_VISITS}) SELECT CAST(subject_id AS VARCHAR) AS subject_id, visit,
 concat(subject_id, '-', trim(raw)) AS subject_visit, count(*) AS n FROM v GROUP BY ALL""")
def read_samples_file(spark, d):
    path = scratch_path(spark, "samples") + ".tsv"
    R.visits(spark, d).withColumn("Visit", F.trim("Visit")).write.option("header", True).option("sep", "\t").csv(path)
    rows = tables.read_samples(spark, path)
    return rows.groupBy("subject_id", "visit", "subject_visit").agg(F.count(F.lit(1)).alias("n"))


@query("read_samples", f"""
WITH v AS ({R.SQL_VISITS}) SELECT CAST(subject_id AS VARCHAR) AS subject_id, visit,
 concat(subject_id, '-', raw) AS subject_visit, count(*) AS n FROM v GROUP BY ALL""")
def read_samples(spark, d):
    rows = tables.canonical_samples(R.visits(spark, d), "Subcode", "Visit")
    return rows.groupBy("subject_id", "visit", "subject_visit").agg(F.count(F.lit(1)).alias("n"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("to_wide", f"""
WITH cells AS ({R.sql_cells()}), dl AS ({R.sql_delta()})
SELECT subject_id, {', '.join(f"{sr6(f'''max(CASE WHEN feature_id = '{p}' THEN delta END)''')} AS p{i}" for i, p in enumerate(PRIORITIES))}
FROM dl GROUP BY subject_id""")
def to_wide(spark, d):
    wide = tables.to_wide(pairing.paired_delta(R.cells(spark, d)), PRIORITIES, "subject_id", "feature_id", "delta")
    return wide.select("subject_id", *[r6(F.col(f"`{p}`")).alias(f"p{i}") for i, p in enumerate(PRIORITIES)])


@query("write_table", f"""
WITH cells AS ({R.sql_cells()}) SELECT feature_id, visit, count(*) AS n, {sr6('avg(value)')} AS mean_value FROM cells GROUP BY ALL""")
def write_table(spark, d):
    path = scratch_path(spark, "cells")
    tables.write_table(R.cells(spark, d), path, partition_by=["visit"])
    back = spark.read.parquet(path)
    return back.groupBy("feature_id", "visit").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_value"))


@query("guarded_read", f"""
WITH cells AS ({R.sql_cells()}), dl AS ({R.sql_delta()}) SELECT subject_id, feature_id, {sr6('delta')} AS delta FROM dl""")
def guarded_read(spark, d):
    path = scratch_path(spark, "delta")
    tables.write_table(pairing.paired_delta(R.cells(spark, d)), path)
    tables.stamp_provenance(spark, path, True, "training folds")
    return tables.guarded_read(spark, path).select("subject_id", "feature_id", r6("delta").alias("delta"))


@query("table_digest", """
WITH r AS (SELECT md5(concat(length(c_custkey::VARCHAR), ':', c_custkey, ';', CASE WHEN c_mktsegment = 'BUILDING' THEN '-' ELSE length(c_mktsegment)::VARCHAR END, ':',
 CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END, ';', length(c_name), ':', c_name, ';', length(c_nationkey::VARCHAR), ':', c_nationkey, ';')) AS m FROM customer)
SELECT count(*) AS n_rows, sum(CAST('0x' || substr(m, 1, 12) AS BIGINT))::VARCHAR AS low, sum(CAST('0x' || substr(m, 13, 12) AS BIGINT))::VARCHAR AS high,
 'c_custkey bigint,c_mktsegment string,c_name string,c_nationkey bigint' AS columns FROM r""")
def table_digest(spark, d):
    """Of a table whose segment is missing for some customers, with its columns in another order."""
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return tables.table_digest(table(spark, d, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_name", segment.alias("c_mktsegment"), F.col("c_custkey").cast("bigint").alias("c_custkey")))


@query("assert_finite", """
WITH f AS (SELECT l_suppkey AS sample_id, l_partkey AS feature_id, CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END AS value FROM lineitem)
SELECT count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_bad,
 (SELECT sample_id FROM f WHERE value IS NULL ORDER BY sample_id, feature_id LIMIT 1) AS first_sample,
 (SELECT feature_id FROM f WHERE value IS NULL ORDER BY sample_id, feature_id LIMIT 1) AS first_feature FROM f""")
def assert_finite(spark, d):
    ratio = F.col("l_quantity") / F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("feature_id"), ratio.alias("value"))
    return tables.non_finite_report(rows)


@query("assert_label_balance", """
SELECT round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS share, count(*) AS n FROM labels""")
def assert_label_balance(spark, d):
    flag = F.col("quality") == 1
    return rounded(tables.label_share(tables.assert_label_balance(table(spark, d, "labels"), flag), flag))


@query("normalise_visit", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'POST' ELSE 'PRE' END AS visit FROM orders")
def normalise_visit(spark, d):
    return R.visits(spark, d).select(F.col("sample_id").alias("o_orderkey"), C.normalise_visit(F.col("Visit")).alias("visit"))


@query("encode_response", """
SELECT c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 1::DOUBLE WHEN 'MACHINERY' THEN 0 WHEN 'AUTOMOBILE' THEN 1 END AS response,
 CASE c_nationkey % 3 + 1 WHEN 1 THEN 'R' WHEN 2 THEN 'NR' ELSE 'NA' END AS named, count(*) AS n FROM customer GROUP BY ALL""")
def encode_response(spark, d):
    spelled = F.when(F.col("c_mktsegment") == "BUILDING", " responder").when(F.col("c_mktsegment") == "MACHINERY", "nr").when(
        F.col("c_mktsegment") == "AUTOMOBILE", "1").otherwise("PARTIAL")
    return table(spark, d, "customer").select(
        "c_mktsegment", C.encode_response(spelled).cast("double").alias("response"), C.response_name(F.col("c_nationkey") % 3 + 1).alias("named"),
    ).groupBy("c_mktsegment", "response", "named").agg(F.count(F.lit(1)).alias("n"))


def _sql_logit(clip: float, m: float | None) -> str:
    b = f"greatest(CAST({clip} AS DOUBLE), least(1 - CAST({clip} AS DOUBLE), l_discount * 10))"
    logit = f"log2({b} / (1 - {b}))"
    return sr6(logit if m is None else f"greatest(CAST(-{m} AS DOUBLE), least(CAST({m} AS DOUBLE), {logit}))")


@query("logit2", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_sql_logit(1e-3, 3.0)} AS m_tight, {_sql_logit(1e-6, 8.0)} AS m_wide, {_sql_logit(1e-6, None)} AS m_open FROM lineitem""")
def logit2(spark, d):
    beta = F.col("l_discount") * 10
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(C.logit2(beta, 1e-3, 3.0)).alias("m_tight"),
        r6(C.logit2(beta, 1e-6, 8.0)).alias("m_wide"), r6(C.logit2(beta, 1e-6)).alias("m_open"))


@query("safe_ratio", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sr6('CASE WHEN l_discount + l_tax = 0 THEN NULL ELSE l_quantity / (l_discount + l_tax) END')} AS ratio,
 {sr6('CASE WHEN l_discount + l_tax = 0 THEN l_quantity ELSE l_quantity / (l_discount + l_tax) END')} AS with_fallback FROM lineitem""")
def safe_ratio(spark, d):
    parts = [F.col("l_discount"), F.col("l_tax")]
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(C.safe_ratio(F.col("l_quantity"), parts)).alias("ratio"),
        r6(C.safe_ratio(F.col("l_quantity"), parts, F.col("l_quantity"))).alias("with_fallback"))


@query("encode_covariates", f"""
WITH c AS (SELECT c_custkey, c_mktsegment AS s, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS b FROM customer)
SELECT c_custkey, CAST((SELECT count(DISTINCT x.c_mktsegment) FROM customer x WHERE x.c_mktsegment < c.s) AS DOUBLE) AS segment,
 {sr6('coalesce(b, avg(b) OVER ())')} AS balance FROM c""")
def encode_covariates(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return rounded(selection.encode_covariates(rows, ["segment", "balance"]))


@query("impute_mean", f"""
WITH f AS (SELECT c_custkey AS sample_id, c_mktsegment AS feature_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS value FROM customer)
SELECT sample_id, feature_id, {sr6('coalesce(value, avg(value) OVER (PARTITION BY feature_id))')} AS value FROM f""")
def impute_mean(spark, d):
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("feature_id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("value"))
    return rounded(selection.impute_mean(rows).select("sample_id", "feature_id", "value"))


@query("zscale", f"""
WITH f AS ({R.SQL_DENSE}), s AS (SELECT feature_id, avg(value) AS m, stddev_pop(value) AS p, stddev_samp(value) AS q FROM f GROUP BY feature_id)
SELECT sample_id, feature_id, {sr6('(value - m) / p')} AS z_pop, {sr6('(value - m) / q')} AS z_samp FROM f JOIN s USING (feature_id)""")
def zscale(spark, d):
    rows = R.dense(spark, d)
    first = selection.zscale(rows.withColumn("raw", F.col("value")))
    both = selection.zscale(first.withColumnsRenamed({"value": "z_pop", "raw": "value"}), ddof=1)
    return both.select(big("sample_id").alias("sample_id"), big("feature_id").alias("feature_id"),
                       r6("z_pop").alias("z_pop"), r6("value").alias("z_samp"))


@query("flag_outliers", """
WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM (SELECT l_suppkey, sum(l_quantity) AS l_quantity FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1))
SELECT l_suppkey AS sample_id, coalesce((sum(l_quantity) FILTER (l_returnflag = 'A') - any_value(m)) / any_value(sd) > 2.0, false) AS flagged
FROM lineitem CROSS JOIN s GROUP BY l_suppkey""")
def flag_outliers(spark, d):
    activity = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_returnflag").alias("source")).agg(
        F.sum("l_quantity").alias("score"))
    return selection.flag_outliers(activity, "a").select("sample_id", "flagged")


def _sql_horner(x: str, c) -> str:
    out = repr(c[-1]) + "::DOUBLE"
    for v in reversed(c[:-1]):
        out = f"({out} * {x} + {v!r}::DOUBLE)"
    return out


def sql_normal_quantile(p: str) -> str:
    q, r = f"({p} - 0.5)", f"(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))"
    t = f"sqrt(-ln(least({p}, 1 - {p})))"
    c, m, f = C.PPND_CENTRE, C.PPND_MIDDLE, C.PPND_FAR
    mid = f"{_sql_horner('(t - 1.6::DOUBLE)', m[0])} / {_sql_horner('(t - 1.6::DOUBLE)', m[1])}"
    far = f"{_sql_horner('(t - 5)', f[0])} / {_sql_horner('(t - 5)', f[1])}"
    return (f"(SELECT CASE WHEN abs({q}) <= 0.425 THEN {q} * {_sql_horner(r, c[0])} / {_sql_horner(r, c[1])} "
            f"ELSE sign({q}) * (CASE WHEN t <= 5 THEN {mid} ELSE {far} END) END FROM (SELECT {t} AS t))")


@query("rank_to_normal", f"""
WITH f AS ({R.SQL_DENSE}), r AS (SELECT *, (rank() OVER (PARTITION BY feature_id ORDER BY value) - 1 +
 (count(*) OVER (PARTITION BY feature_id, value) - 1) / CAST(2 AS DOUBLE)) / (count(*) OVER (PARTITION BY feature_id) - 1) AS level FROM f),
 e AS (SELECT *, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, level)) AS p FROM r)
SELECT sample_id, feature_id, {sr6('level')} AS level, {sr6(sql_normal_quantile('p'), 5)} AS z FROM e""")
def rank_to_normal(spark, d):
    out = ranking.rank_to_normal(R.dense(spark, d))
    return out.select("sample_id", big("feature_id").alias("feature_id"), r6("level").alias("level"), r6("z", 5).alias("z"))


@query("unit_vector", f"""
WITH f AS ({R.SQL_DENSE}), n AS (SELECT sample_id, sqrt(sum(value * value)) AS len FROM f GROUP BY 1)
SELECT sample_id, feature_id, {sr6('value / CASE WHEN len < 1e-12 THEN 1 ELSE len END')} AS value FROM f JOIN n USING (sample_id)""")
def unit_vector(spark, d):
    unit = R.points(spark, d).select(F.col("subject_id").alias("sample_id"), C.unit_vector(F.col("z")).alias("z"))
    return rounded(tables.from_vectors(unit, "sample_id"))


@query("arc_length", f"""
WITH x AS ({R.SQL_DELTAS}), n AS (SELECT *, z / sqrt(sum(z * z) OVER (PARTITION BY subject_id)) AS u FROM x),
 m AS (SELECT i, avg(u) AS c FROM n GROUP BY i), k AS (SELECT i, c / sqrt(sum(c * c) OVER ()) AS c FROM m)
SELECT subject_id, {sr6('acos(greatest(-1, least(1, sum(u * c))))')} AS score FROM n JOIN k USING (i) GROUP BY subject_id""")
def arc_length(spark, d):
    from dyadic.operators.resample import vector_mean

    rows = R.deltas(spark, d).select("subject_id", C.unit_vector(F.col("z")).alias("u"))
    centre = vector_mean(rows, [], "u").select(C.unit_vector(F.col("centroid"))).scalar()
    placed = rows.withColumn("centre", centre)
    return placed.select("subject_id", r6(C.arc_length(F.col("u"), F.col("centre"))).alias("score"))


@query("importance_weight", f"""
WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p / (1 - p) AS w, p0 / greatest(1 - p0, 1e-8::DOUBLE) AS v FROM (
 SELECT *, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, l_discount * 10)) AS p, l_discount * 10 AS p0 FROM lineitem)),
 c AS (SELECT quantile_cont(w, 0.99) AS cw, quantile_cont(v, 0.95) AS cv FROM w)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, {sr6('least(w, cw)', 3)} AS weight, {sr6('least(v, cv)', 3)} AS floored FROM w CROSS JOIN c""")
def importance_weight(spark, d):
    p = F.col("l_discount") * 10
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.odds(p).alias("weight"), C.odds(p, floor=1e-8).alias("floored"))
    out = ranking.capped_weights(ranking.capped_weights(rows, "weight", 0.99), "floored", 0.95)
    return rounded(out, 3)


@query("strip_id_prefix", """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name END AS symbol FROM part),
 n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p_partkey) - 1 AS k FROM p)
SELECT p_partkey AS position, symbol || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS symbol FROM n""")
def strip_id_prefix(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ENSG0000"), F.col("p_partkey"), F.lit(".5_"), F.col("p_name"))).otherwise(
        F.col("p_name"))
    ids = table(spark, d, "part").select(name.alias("feature_id"), F.col("p_partkey").alias("position"))
    return pairing.strip_id_prefix(ids).select("position", "symbol")


@query("ids_to_intervals", """
SELECT p_partkey AS feature_id, CASE WHEN p_size % 2 = 0 THEN 'chr' || p_size ELSE 'chr' || p_size END AS chrom,
 CAST(floor(p_retailprice) AS BIGINT) AS start, CAST(floor(p_retailprice) AS BIGINT) + 1 AS "end"
FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""")
def ids_to_intervals(spark, d):
    chrom = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("chr"), F.col("p_size"))).otherwise(F.col("p_size").cast("string"))
    manifest = table(spark, d, "part").select(
        F.col("p_partkey").alias("feature_id"), chrom.alias("chrom"), F.floor("p_retailprice").alias("position"))
    ids = table(spark, d, "lineitem").select(F.col("l_partkey").alias("feature_id")).distinct()
    return enrichment.ids_to_intervals(ids, manifest)


# Themes whose words occur in the test texts.
THEMES = {
    "monocyte": ("copyright", "license"),
    "inflammatory": ("password", "token"),
    "wnt": ("ouenau",),
    "cd8t": ("ing the", "tion"),
    "stress_trauma": ("schen", "keit"),
    "epigenetic": ("aci\u00f3n", "eaux"),
}


def _sql_theme_rows() -> str:
    return ", ".join(f"('{k}', '{w}')" for k, words in THEMES.items() for w in words)


@query("keyword_match", f"""
WITH t AS (SELECT lang, source, lower(text) AS term, {R.sql_hashed_p("'kw'", 'doc_id')} / 10 AS q_val, doc_id FROM documents),
 k(theme, word) AS (VALUES {_sql_theme_rows()}),
 h AS (SELECT DISTINCT lang, source, theme, doc_id, q_val FROM t JOIN k ON contains(term, word) WHERE q_val < 0.05),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, theme ORDER BY q_val, doc_id) AS rk FROM h)
SELECT lang, source, theme, rk AS place, doc_id, {sr6('q_val')} AS q_val,
 (SELECT count(DISTINCT x.theme) >= 2 OR bool_or(x.theme IN ('monocyte', 'inflammatory', 'wnt')) FROM r x WHERE x.lang = r.lang AND x.source = r.source AND x.rk <= 3) AS coherent
FROM r WHERE rk <= 3""")
def keyword_match(spark, d):
    terms = table(spark, d, "documents").select(
        "lang", "source", "doc_id", F.col("text").alias("term"), (R.hashed_p(F.lit("kw"), F.col("doc_id")) / 10).alias("q_val"))
    hits = enrichment.keyword_hits(
        terms, ["lang", "source"], extra=["doc_id"], order=[F.col("q_val"), F.col("doc_id")], keywords=THEMES)
    verdict = enrichment.coherence(hits, ["lang", "source"]).select("lang", "source", "coherent")
    return hits.join(verdict, ["lang", "source"]).select(
        "lang", "source", "theme", big("rank").alias("place"), "doc_id", r6("q_val").alias("q_val"), "coherent")


@query("verdict", """
WITH x AS (SELECT o_orderkey, (o_orderkey * 7919 % 1000) / CAST(1000 AS DOUBLE) AS p, (o_orderkey * 104729 % 1000) / CAST(1000 AS DOUBLE) AS v FROM orders)
SELECT o_orderkey, CASE WHEN p < 0.05 AND v >= 0.3 THEN 'PASS' WHEN p < 0.15 THEN 'MARGINAL' ELSE 'FAIL' END AS separation,
 CASE WHEN p >= 0.02 AND v >= 0.02 AND abs(p - v) >= 0.3 THEN 'PASS' WHEN p >= 0.02 AND v >= 0.02 THEN 'MARGINAL' ELSE 'FAIL' END AS fraction,
 CASE WHEN v < 0.75 THEN 'PASS' WHEN v <= 0.85 THEN 'MARGINAL' ELSE 'FAIL' END AS shift,
 CASE WHEN v >= 0.5 THEN 'FAIL' WHEN p < 0.05 THEN 'PASS' WHEN p < 0.15 THEN 'MARGINAL' ELSE 'FAIL' END AS direction,
 CASE WHEN p < 0.05 AND v > 0.3 THEN 'PASS' ELSE 'FAIL' END AS proximity,
 CASE WHEN p < 0.05 AND v > 0.3 THEN 'RESCUE_PASS' WHEN p < 0.15 THEN 'MARGINAL' ELSE 'FAIL' END AS rescue,
 CASE WHEN p < 0.05 AND v < 0.5 THEN 'RESCUE_PASS' WHEN p < 0.15 AND v < 0.5 THEN 'MARGINAL' ELSE 'FAIL' END AS rescue_direction,
 CASE WHEN v * 100 >= 40 THEN 'PASS' ELSE 'FAIL' END AS replication,
 CASE WHEN v >= 0.55 AND p >= 0.30 AND v - p >= 0.15 THEN 'REPLICATES' WHEN v >= 0.5 AND p >= 0.2 THEN 'MARGINAL' ELSE 'DOES_NOT_REPLICATE' END AS concordance,
 CASE WHEN v > 0.85 THEN 'trait' WHEN v < 0.65 THEN 'state' ELSE 'mixed' END AS icc,
 v * 10 >= 3 AND p * 10 >= 3 AND p < 0.3 AND v < 0.5 AS trait_state, v * 2000 >= 1000 AND p * 10 > 0 AS activity FROM x""")
def verdict(spark, d):
    x = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderkey") * 7919 % 1000 / 1000.0).alias("p"), (F.col("o_orderkey") * 104729 % 1000 / 1000.0).alias("v"))
    p, v = F.col("p"), F.col("v")
    return x.select(
        "o_orderkey", V.separation_gate(p, v).alias("separation"), V.fraction_gate(p, v, p - v).alias("fraction"),
        V.shift_gate(v).alias("shift"), V.direction_gate(p, v < 0.5).alias("direction"), V.proximity_gate(p, v).alias("proximity"),
        V.rescue_gate(p, v).alias("rescue"), V.rescue_direction_gate(p, v - 0.5).alias("rescue_direction"),
        V.replication_gate(v * 100).alias("replication"), V.concordance_gate(v, p, v - p).alias("concordance"),
        V.icc_class(v).alias("icc"), V.trait_state_pass(v * 10, p * 10, p, v).alias("trait_state"),
        V.activity_pass(v * 2000, p * 10).alias("activity"))


@query("family_label", """
SELECT p_partkey, CASE WHEN p_name IN ('red widget', 'blue bolt') THEN 'NFAT' WHEN p_name IN ('small ring') THEN 'WNT' ELSE '' END AS family,
 p_size < 10 AS significant FROM part WHERE p_name IN ('red widget', 'blue bolt', 'small ring')""")
def family_label(spark, d):
    families = {"NFAT": ("red widget", "blue bolt"), "WNT": ("small ring",)}
    rows = table(spark, d, "part").withColumn("family", C.family_label(F.col("p_name"), families))
    return rows.filter("family != ''").select("p_partkey", "family", (F.col("p_size") < 10).alias("significant"))


# --- set operations -----------------------------------------------------------------------


@query("stack_views", f"""
WITH c AS ({R.sql_cells()}), a AS ({R.sql_delta('c')}), c2 AS ({R.sql_cells('P')}), b AS ({R.sql_delta('c2')}),
 u AS (SELECT 'dnam' AS modality, subject_id, feature_id, delta FROM a UNION ALL SELECT 'rna', subject_id, feature_id, delta FROM b),
 k AS (SELECT * FROM u WHERE subject_id IN (SELECT subject_id FROM a) AND subject_id IN (SELECT subject_id FROM b)),
 s AS (SELECT modality, feature_id, avg(delta) AS m, stddev_pop(delta) AS sd FROM k GROUP BY ALL)
SELECT modality, subject_id, feature_id, {sr6('(delta - m) / sd')} AS value FROM k JOIN s USING (modality, feature_id)""")
def stack_views(spark, d):
    a = pairing.paired_delta(R.cells(spark, d))
    b = pairing.paired_delta(R.cells(spark, d, "P"))
    joint = pairing.stack_views({"dnam": a, "rna": b}).withColumn("value", F.col("delta"))
    return rounded(selection.zscale(joint, by=("modality", "feature_id")).select("modality", "subject_id", "feature_id", "value"))


@query("union_contrasts", f"""
SELECT 'a' AS contrast, feature_id, cell_type, {sr6('q_val')} AS q_val FROM ({R.sql_results('a')}) UNION ALL
SELECT 'b', feature_id, cell_type, {sr6('q_val')} FROM ({R.sql_results('b')})""")
def union_contrasts(spark, d):
    out = pairing.union_tagged({t: R.results(spark, d, t) for t in ("a", "b")}, "contrast")
    return rounded(out.select("contrast", "feature_id", "cell_type", "q_val"))


@query("stack_cohorts", """
SELECT 0::BIGINT AS cohort, c_custkey AS id, round(c_acctbal, 6) + 0.0 AS value FROM customer UNION ALL SELECT 1, s_suppkey, round(s_acctbal, 6) + 0.0 FROM supplier""")
def stack_cohorts(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    return rounded(pairing.union_tagged({0: a, 1: b}, "cohort"))


@query("id_set_algebra", """
SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'only_a', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def id_set_algebra(spark, d):
    o = table(spark, d, "orders")
    a = o.filter("o_orderstatus = 'O'").select("o_custkey")
    b = o.filter("o_orderstatus = 'F'").select("o_custkey")
    count = F.count(F.lit(1)).alias("n")
    return a.intersect(b).agg(count).select(F.lit("both").alias("part"), "n").unionByName(
        a.distinct().join(b, "o_custkey", "left_anti").agg(count).select(F.lit("only_a").alias("part"), "n"))
