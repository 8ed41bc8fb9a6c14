"""Queries: aggregation, selection, ranking, quantiles."""

from __future__ import annotations


from pyspark.sql import functions as F

from dyadic.catalog import recipes as R
from dyadic.catalog.registry import big, query, r6, rounded, sql_bh, sql_draw, sr6, table
from dyadic.operators import multivariate, pairing, ranking, regression, resample, selection
from dyadic.sources import tables


@query("topk_variance", f"""
WITH f AS ({R.SQL_MATRIX}) SELECT feature_id, {sr6('coalesce(var_samp(value), 0)')} AS variance FROM f GROUP BY feature_id
ORDER BY coalesce(var_samp(value), 0) DESC, feature_id LIMIT 500""")
def topk_variance(spark, d):
    return rounded(selection.topk_variance(R.matrix(spark, d), 500))


@query("topk_variance_fixed_block", f"""
WITH f AS ({R.SQL_DENSE}), v AS (SELECT feature_id, var_samp(value) AS v FROM f GROUP BY 1)
SELECT feature_id, {sr6('v')} AS variance FROM v WHERE feature_id IN (0, 1, 2)
UNION ALL (SELECT feature_id, {sr6('v')} FROM v WHERE feature_id NOT IN (0, 1, 2) ORDER BY v DESC, feature_id LIMIT 20)""")
def topk_variance_fixed_block(spark, d):
    return rounded(selection.topk_variance(R.dense(spark, d), 20, always=[0, 1, 2]))


@query("blacklist_range_filter", f"""
SELECT l_partkey AS feature_id, {sr6('max(l_discount) - min(l_discount)')} AS "range", {sr6('var_samp(l_discount)')} AS variance FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY 1 HAVING max(l_discount) - min(l_discount) > 0.085
ORDER BY var_samp(l_discount) DESC, feature_id LIMIT 300""")
def blacklist_range_filter(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("feature_id"), F.col("l_discount").alias("value"))
    black = table(spark, d, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("feature_id"))
    return rounded(selection.range_filter(rows, black, 0.085, 300))


@query("resolve_tier", f"""
WITH s AS (SELECT DISTINCT feature_id FROM ({R.sql_results()}) WHERE q_val < 0.1),
 g AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT feature_id FROM s) AND l_quantity <= 3)
SELECT 1::BIGINT AS tier, 'dnam' AS modality, feature_id FROM s WHERE feature_id IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 1, 'rna', l_suppkey FROM g""")
def resolve_tier(spark, d):
    li = table(spark, d, "lineitem")
    gene_map = li.select(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("gene"), F.col("l_quantity").alias("distance_kb"))
    rna = li.select(F.col("l_suppkey").alias("feature_id"), F.col("l_tax").alias("value"))
    dnam = li.select(F.col("l_partkey").alias("feature_id"), F.col("l_discount").alias("value"))
    return rounded(selection.resolve_tier(R.results(spark, d), dnam, rna, gene_map, window_kb=3))


@query("resolve_tier_fallback", """
WITH v AS (SELECT l_partkey AS f, var_samp(l_discount) AS v FROM lineitem GROUP BY 1 HAVING max(l_discount) - min(l_discount) > 0.05),
 r AS (SELECT l_suppkey AS f, var_samp(l_tax) AS v FROM lineitem GROUP BY 1)
(SELECT 2::BIGINT AS tier, 'dnam' AS modality, f AS feature_id FROM v ORDER BY v DESC, f LIMIT 100)
UNION ALL (SELECT 2, 'rna', f FROM r ORDER BY v DESC, f LIMIT 10)""")
def resolve_tier_fallback(spark, d):
    li = table(spark, d, "lineitem")
    rna = li.select(F.col("l_suppkey").alias("feature_id"), F.col("l_tax").alias("value"))
    dnam = li.select(F.col("l_partkey").alias("feature_id"), F.col("l_discount").alias("value"))
    return rounded(selection.resolve_tier(None, dnam, rna, None, top_dnam=100, top_rna=10))


SQL_FOLDS = f"""SELECT sample_id, CAST((row_number() OVER (ORDER BY {sql_draw(42, 'sample_id')}, sample_id) - 1) % 5 AS INT) AS fold
 FROM (SELECT vec_id AS sample_id FROM embeddings)"""


@query("fold_preprocess", f"""
WITH f AS ({R.SQL_DENSE}), k AS ({SQL_FOLDS}), j AS (SELECT * FROM f JOIN k USING (sample_id)), h AS (SELECT DISTINCT fold AS held FROM k),
 s AS (SELECT held, feature_id, avg(value) AS m, var_samp(value) AS v FROM j JOIN h ON fold <> held GROUP BY ALL),
 p AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY v DESC, feature_id) AS rk FROM s)
SELECT CAST(held AS BIGINT) AS fold, sample_id, p.feature_id, {sr6('(value - m) / sqrt(v)')} AS value, j.fold = held AS held_out
FROM p JOIN j ON j.feature_id = p.feature_id WHERE rk <= 16""")
def fold_preprocess(spark, d):
    rows = R.dense(spark, d)
    samples = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"))
    folds = resample.subject_folds(samples, 5, subject="sample_id")
    out = selection.fold_preprocess(rows, folds, 16, sample="sample_id")
    return out.select(big("fold").alias("fold"), "sample_id", big("feature_id").alias("feature_id"), r6("value").alias("value"), "held_out")


@query("loo_topk_variance", f"""
WITH f AS ({R.SQL_FACTORS}), m AS (SELECT factor, avg(value) AS mu FROM f GROUP BY 1), c AS (SELECT subject_id, factor, value - mu AS x FROM f JOIN m USING (factor)),
 t AS (SELECT factor, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM c GROUP BY 1),
 o AS (SELECT subject_id, factor, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM c GROUP BY ALL),
 v AS (SELECT o.subject_id, factor, ((t.ss - o.ss) - (t.s - o.s) * (t.s - o.s) / (t.n - o.n)) / (t.n - o.n - 1) AS v FROM o JOIN t USING (factor)),
 r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY v DESC, factor) AS rk FROM v)
SELECT subject_id, factor AS feature_id, {sr6('v')} AS variance, rk AS rank FROM r WHERE rk <= 10""")
def loo_topk_variance(spark, d):
    rows = R.factor_scores(spark, d).withColumnRenamed("factor", "feature_id")
    return rounded(selection.loo_topk_variance(rows, 10))


@query("group_centroids", f"""
WITH f AS ({R.SQL_DENSE}) SELECT CAST(label AS BIGINT) AS label, feature_id, {sr6('avg(value)')} AS centroid, count(*) AS n
FROM f JOIN ({R.SQL_POINTS}) ON subject_id = sample_id GROUP BY ALL""")
def group_centroids(spark, d):
    means = resample.vector_mean(R.points(spark, d), ["label"])
    return rounded(means.select("label", "n", F.posexplode("centroid").alias("feature_id", "centroid")))


SQL_SUBJECT_MEANS = """SELECT subject_id, factor, avg(value) AS mean, avg(value) FILTER (visit = 1) - avg(value) FILTER (visit = 0) AS delta FROM f GROUP BY ALL"""


@query("subject_factor_means", f"""
WITH f AS ({R.SQL_FACTORS}) SELECT subject_id, factor, {sr6('mean')} AS mean, {sr6('coalesce(delta, 0)')} AS delta FROM ({SQL_SUBJECT_MEANS})""")
def subject_factor_means(spark, d):
    return rounded(multivariate.subject_factor_means(R.factor_scores(spark, d), 0.0))


SQL_COMPONENTS = """g AS (SELECT factor, subject_id, count(*) AS k, avg(value) AS m, count(*) * var_pop(value) AS w FROM f GROUP BY ALL),
 u AS (SELECT *, m - sum(k * m) OVER (PARTITION BY factor) / sum(k) OVER (PARTITION BY factor) AS gap FROM g),
 c AS (SELECT factor, count(*) AS a, sum(k) AS n, sum(k * k) AS kk, sum(k * gap * gap) AS ssb, sum(w) AS ssw FROM u GROUP BY 1),
 e AS (SELECT *, greatest(0, (ssb / (a - 1) - ssw / (n - a)) / ((n - kk / CAST(n AS DOUBLE)) / (a - 1))) AS sb, greatest(ssw / (n - a), 1e-12::DOUBLE) AS sw FROM c)"""


@query("variance_components", f"""
WITH f AS ({R.SQL_FACTORS}), {SQL_COMPONENTS} SELECT factor, {sr6('sb')} AS s_between, {sr6('sw')} AS s_within, {sr6('sb / (sb + sw)')} AS icc FROM e""")
def variance_components(spark, d):
    return rounded(multivariate.variance_components(R.factor_scores(spark, d)))


# Maximum-likelihood ICC of a balanced design from its sums of squares.
SQL_ML_ICC = """CASE WHEN ssb / a > ssw / (n - a) THEN (ssb / a - ssw / (n - a)) * a / n / ((ssb / a - ssw / (n - a)) * a / n + ssw / (n - a)) ELSE 0 END"""


@query("classify_icc", f"""
WITH f AS ({R.SQL_FACTORS}), {SQL_COMPONENTS},
 s AS (SELECT DISTINCT subject_id FROM f), nb AS (SELECT subject_id, row_number() OVER (ORDER BY {sql_draw(42, 'subject_id')}, subject_id) AS pos, count(*) OVER () AS n FROM s),
 dr AS (SELECT rep, 1 + CAST('0x' || substr(md5(concat_ws(':', '42', CAST(rep AS VARCHAR), CAST(pos AS VARCHAR))), 1, 8) AS BIGINT) % n AS pick FROM nb, (SELECT unnest(range(1, 51)) AS rep)),
 cp AS (SELECT rep, subject_id, count(*) AS w FROM dr JOIN nb ON pos = pick GROUP BY ALL),
 bx AS (SELECT rep, factor, cp.w, k, m, g.w AS ssw0 FROM cp JOIN g USING (subject_id)),
 bu AS (SELECT *, m - sum(w * k * m) OVER (PARTITION BY rep, factor) / sum(w * k) OVER (PARTITION BY rep, factor) AS gap FROM bx),
 bc AS (SELECT rep, factor, sum(w) AS a, sum(w * k) AS n, sum(w * k * k) AS kk, sum(w * k * gap * gap) AS ssb, sum(w * ssw0) AS ssw FROM bu GROUP BY ALL),
 be AS (SELECT rep, factor, greatest(0, (ssb / (a - 1) - ssw / (n - a)) / ((n - kk / CAST(n AS DOUBLE)) / (a - 1))) AS sb, greatest(ssw / (n - a), 1e-12::DOUBLE) AS sw FROM bc),
 ci AS (SELECT factor, quantile_cont(sb / (sb + sw), 0.025) AS lo, quantile_cont(sb / (sb + sw), 0.975) AS hi FROM be GROUP BY 1)
SELECT factor, {sr6(SQL_ML_ICC)} AS icc, {sr6('lo')} AS icc_ci_low, {sr6('hi')} AS icc_ci_high,
 {sr6('CASE WHEN ssb / a > ssw / (n - a) THEN n * ln((ssb + ssw) / n) - (n - a) * ln(ssw / (n - a)) - a * ln(ssb / a) ELSE 0 END')} AS lrt_stat,
 CASE WHEN {SQL_ML_ICC} > 0.85 THEN 'trait' WHEN {SQL_ML_ICC} < 0.65 THEN 'state' ELSE 'mixed' END AS classification
FROM e JOIN ci USING (factor)""")
def classify_icc(spark, d):
    out = multivariate.classify_icc(R.factor_scores(spark, d), bootstrap=50)
    return rounded(out.drop("lrt_pval", "lrt_qval"))


# Slope of the profile likelihood in the ratio `lam` of the variances, from lists of sums per subject size.
SQL_PROFILE = """list_sum(list_transform(st, lambda x: x.k / (1 + x.k * lam) * x.s1)) / list_sum(list_transform(st, lambda x: x.k / (1 + x.k * lam) * x.a)) AS mu,
  ssw + list_sum(list_transform(st, lambda x: x.k / (1 + x.k * lam) * (x.s2 - 2 * mu * x.s1 + mu * mu * x.a))) AS q,
  list_sum(list_transform(st, lambda x: x.k / (1 + x.k * lam) * x.a)) - n * list_sum(list_transform(st, lambda x: pow(x.k / (1 + x.k * lam), 2) * (x.s2 - 2 * mu * x.s1 + mu * mu * x.a))) / q AS slope"""


@query("mixed_model", f"""
WITH RECURSIVE f AS (SELECT o_custkey AS subject_id, o_orderpriority AS factor, o_totalprice / 100000 + CAST(o_custkey % 7 AS DOUBLE) / 5 AS value FROM orders),
 g AS (SELECT factor, subject_id, count(*) AS k, avg(value) AS m, count(*) * var_pop(value) AS w FROM f GROUP BY ALL),
 e AS (SELECT factor, sum(k * m) / sum(k) AS grand FROM g GROUP BY 1),
 z AS (SELECT factor, grand, k, count(*) AS a, sum(m - grand) AS s1, sum((m - grand) * (m - grand)) AS s2, sum(w) AS w FROM g JOIN e USING (factor) GROUP BY ALL),
 l AS (SELECT factor, grand, list({{'k': CAST(k AS DOUBLE), 'a': CAST(a AS DOUBLE), 's1': s1, 's2': s2}}) AS st, sum(w) AS ssw, CAST(sum(k * a) AS DOUBLE) AS n FROM z GROUP BY ALL),
 b AS (SELECT 0 AS i, factor, grand, st, ssw, n, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi FROM l UNION ALL
  SELECT i + 1, factor, grand, st, ssw, n, CASE WHEN slope < 0 THEN share ELSE lo END, CASE WHEN slope < 0 THEN hi ELSE share END
  FROM (SELECT *, (lo + hi) / 2 AS share, share / (1 - share) AS lam, {SQL_PROFILE} FROM b WHERE i < 50)),
 o AS (SELECT *, lo / (1 - lo) AS lam, {SQL_PROFILE} FROM b WHERE i = 50)
SELECT factor, {sr6('grand + mu')} AS mean, {sr6('lam * q / n')} AS s_between, {sr6('q / n')} AS s_within, {sr6('lo')} AS icc,
 {sr6('-(n * ln(2 * pi() * q / n) + list_sum(list_transform(st, lambda x: x.a * ln(1 + x.k * lam))) + n) / 2', 4)} AS loglik FROM o""")
def mixed_model(spark, d):
    """Customers as subjects with one row to dozens each."""
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("factor"),
        (F.col("o_totalprice") / 100000 + F.col("o_custkey") % 7 / 5.0).alias("value"))
    out = multivariate.mixed_model(rows).drop("loglik_pooled")
    return rounded(out.drop("loglik")).join(out.select("factor", r6("loglik", 4).alias("loglik")), "factor")


@query("delta_sd_corr", f"""
WITH f AS (SELECT o_custkey AS s, CASE o_orderstatus WHEN 'O' THEN 'O' ELSE 'F' END AS v, avg(o_totalprice) / 100000 AS mono, avg(o_orderkey % 100) / 100 AS neu FROM orders GROUP BY ALL),
 d AS (SELECT a.s, b.mono - a.mono AS mono, b.neu - a.neu AS neu, b.neu / (1 + b.mono) - a.neu / (1 + a.mono) AS ratio FROM f a JOIN f b ON a.s = b.s AND a.v = 'O' AND b.v = 'F')
SELECT count(*) AS n_paired, {sr6('stddev_samp(mono)')} AS sd_mono, {sr6('stddev_samp(neu)')} AS sd_neu, {sr6('corr(mono, ratio)')} AS r, count(*) AS n_pairs FROM d""")
def delta_sd_corr(spark, d):
    visit = F.when(F.col("o_orderstatus") == "O", "PRE").otherwise("POST")
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject_id"), visit.alias("visit")).agg(
        (F.avg("o_totalprice") / 100000).alias("mono"), (F.avg(F.col("o_orderkey") % 100) / 100).alias("neu"))
    long = rows.withColumn("ratio", F.col("neu") / (1 + F.col("mono"))).select(
        "subject_id", "visit",
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature_id"), F.col(c).alias("value")) for c in ("mono", "neu", "ratio")])))
    wide = tables.to_wide(pairing.paired_delta(long), ["mono", "neu", "ratio"], "subject_id", "feature_id", "delta")
    return rounded(multivariate.delta_sd_corr(wide))


@query("adjusted_rand", f"""
WITH c AS (SELECT p_type AS a, p_brand AS b, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS ij FROM c),
 x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT {sr6('(ij - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2))', 9)} AS ari FROM t, x, y""")
def adjusted_rand(spark, d):
    return rounded(multivariate.adjusted_rand(table(spark, d, "part"), "p_type", "p_brand"), 9)


@query("counts_summary", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def counts_summary(spark, d):
    return tables.counts_summary(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("coverage_per_sample", "SELECT l_suppkey AS sample_id, count(CASE WHEN l_tax > 0 THEN 1 END) AS n_values, count(CASE WHEN l_tax > 0 THEN 1 END) >= 300 AS enough FROM lineitem GROUP BY 1")
def coverage_per_sample(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("sample_id"), F.when(F.col("l_tax") > 0, F.col("l_tax")).otherwise(F.lit(float("nan"))).alias("value"))
    return tables.coverage_per_sample(rows).withColumn("enough", F.col("n_values") >= 300)


@query("min_targets_filter", """
SELECT l_suppkey AS source, l_partkey AS target, count(*) AS n FROM lineitem WHERE l_suppkey IN (
 SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 275)
 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) GROUP BY ALL""")
def min_targets_filter(spark, d):
    net = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    panel = table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("feature_id"))
    return selection.min_targets(net, 275, panel).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("mean_effect", f"SELECT feature_id, {sr6('avg(coef)')} AS reference_coef FROM (SELECT feature_id, coef FROM ({R.sql_results('a')}) UNION ALL SELECT feature_id, coef FROM ({R.sql_results('b')})) GROUP BY 1")
def mean_effect(spark, d):
    return rounded(regression.mean_effect(R.results(spark, d, "a").unionByName(R.results(spark, d, "b"))))


# --- ranking ------------------------------------------------------------------------------


@query("bh_fdr", f"""
WITH r AS ({R.sql_results()}) SELECT feature_id, cell_type, {sr6('p_val')} AS p_val, {sr6('q')} AS q_new FROM ({sql_bh('(SELECT feature_id, cell_type, p_val FROM r)', 'cell_type', q='q')})""")
def bh_fdr(spark, d):
    rows = R.results(spark, d).select("feature_id", "cell_type", "p_val")
    return rounded(ranking.bh_fdr(rows, ["cell_type"], q="q_new"))


@query("bh_fdr_global", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax > 0 THEN {R.sql_hashed_p("'line'", 'l_partkey', 'l_orderkey')} END AS p_val FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, {sr6('q_val')} AS q_val FROM ({sql_bh('r', '', tie='l_orderkey')})""")
def bh_fdr_global(spark, d):
    p = F.when(F.col("l_tax") > 0, R.hashed_p(F.lit("line"), F.col("l_partkey"), F.col("l_orderkey")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", p.alias("p_val"))
    return rounded(ranking.bh_fdr(rows, [], task_rows=20_000).drop("p_val"))


@query("topn_per_group", """
WITH r AS (SELECT l_suppkey, l_partkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(v) DESC, l_partkey) AS rank FROM r)
SELECT l_suppkey, l_partkey, round(v, 4) + 0.0 AS v, rank FROM k WHERE rank <= 50""")
def topn_per_group(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    return rounded(ranking.top_n(rows, ["l_suppkey"], [F.abs("v").desc(), F.col("l_partkey")], 50), 4)


def sql_quantile(by: str, alpha: float, minimum: int) -> str:
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    lead = by + "," if by else ""
    return f"""SELECT {lead} CASE WHEN count(*) < {minimum} THEN pi() ELSE coalesce(min(score) FILTER (up / (tot + tot / n) >= {1 - alpha}::DOUBLE), max(score)) END AS radius
 FROM (SELECT *, sum(weight) OVER ({part} ORDER BY score) AS up, sum(weight) OVER ({part}) AS tot, count(*) OVER ({part}) AS n FROM cal) {group}"""


SQL_CAL = """cal AS (SELECT l_returnflag AS stratum, l_extendedprice / 40000 AS score, l_quantity AS weight FROM lineitem WHERE l_tax < 0.04),
 tst AS (SELECT CASE WHEN l_linestatus = 'O' AND l_discount = 0 THEN 'Z' ELSE l_returnflag END AS stratum, l_extendedprice / 40000 AS score FROM lineitem WHERE l_tax >= 0.04)"""


def calibration(spark, d):
    li = table(spark, d, "lineitem").withColumn("score", F.col("l_extendedprice") / 40000)
    cal = li.filter("l_tax < 0.04").select(
        F.col("l_returnflag").alias("stratum"), "score", F.col("l_quantity").alias("weight"))
    unseen = (F.col("l_linestatus") == "O") & (F.col("l_discount") == 0)
    return cal, li.filter("l_tax >= 0.04").select(F.when(unseen, "Z").otherwise(F.col("l_returnflag")).alias("stratum"), "score")


@query("weighted_quantile", f"WITH {SQL_CAL} SELECT stratum, {sr6('radius')} AS q_hat FROM ({sql_quantile('stratum', 0.1, 1)})")
def weighted_quantile(spark, d):
    return rounded(ranking.weighted_quantile(calibration(spark, d)[0], ["stratum"], task_rows=5_000))


@query("mondrian_conformal", f"""
WITH {SQL_CAL}, r AS ({sql_quantile('stratum', 0.1, 2)}), s AS (SELECT t.stratum, score, coalesce(radius, (SELECT max(radius) FROM r)) AS radius FROM tst t LEFT JOIN r USING (stratum))
SELECT stratum, count(*) AS n, {sr6('avg(CASE WHEN score <= radius THEN 1 ELSE 0 END)')} AS coverage, {sr6('avg(radius)')} AS mean_radius FROM s GROUP BY GROUPING SETS ((stratum), ())""")
def mondrian_conformal(spark, d):
    return rounded(ranking.mondrian_conformal(*calibration(spark, d)))


@query("spearman", f"""
WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS x, l_discount AS y FROM lineitem),
 k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / CAST(2 AS DOUBLE) AS a,
  rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / CAST(2 AS DOUBLE) AS b FROM r)
SELECT g, count(*) AS n, {sr6('corr(a, b)')} AS rho FROM k GROUP BY g""")
def spearman(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("y"))
    return rounded(ranking.spearman(rows, ["g"], "x", "y"))


@query("pi1", f"""
WITH r AS ({R.sql_results()}) SELECT cell_type, count(p_val) AS n, round(1 - least(1, count(*) FILTER (p_val > 0.5) / (count(p_val) * 0.5::DOUBLE)), 4) AS pi1 FROM r GROUP BY 1""")
def pi1(spark, d):
    return ranking.pi1(R.results(spark, d), ["cell_type"])


@query("percentile_ci", f"""
SELECT l_returnflag AS g, {', '.join(f"{sr6(f'quantile_cont(l_extendedprice, {v})')} AS {n}" for n, v in (('p025', 0.025), ('p05', 0.05), ('p50', 0.5), ('p975', 0.975), ('p99', 0.99)))} FROM lineitem GROUP BY 1""")
def percentile_ci(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_extendedprice")
    return rounded(ranking.percentile_ci(rows, ["g"], "l_extendedprice", {"p025": 0.025, "p05": 0.05, "p50": 0.5, "p975": 0.975, "p99": 0.99}))


PERCENTILES = {"p0": 0.0, "p01": 0.01, "p33": 0.333, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@query("percentile_bracket", f"""
SELECT l_returnflag AS g, l_linestatus AS h, {', '.join(f"{sr6(f'quantile_cont(l_extendedprice, {v})')} AS {n}" for n, v in PERCENTILES.items())} FROM lineitem GROUP BY ALL""")
def percentile_bracket(spark, d):
    """By the way of groups too large for a task: sketched brackets, then the values inside them."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("h"), "l_extendedprice")
    return rounded(ranking.percentile_ci(rows, ["g", "h"], "l_extendedprice", PERCENTILES, task_rows=0, sketch=500))


@query("leaderboard_pivot", """
WITH c AS (SELECT o_orderpriority AS metric, o_orderstatus AS arm, avg(o_totalprice) / 100000 AS v FROM orders GROUP BY ALL),
 t AS (SELECT metric, arm, concat('mean ', printf('%.3f', v), CASE WHEN v > 2.5 THEN ' | PASS' ELSE ' | FAIL' END) AS cell FROM c)
SELECT metric, coalesce(max(cell) FILTER (arm = 'O'), 'n/a') AS "O", coalesce(max(cell) FILTER (arm = 'F'), 'n/a') AS "F", coalesce(max(cell) FILTER (arm = 'P'), 'n/a') AS "P", 'n/a' AS "X",
 list_position(['5-LOW', '1-URGENT', '3-MEDIUM', '2-HIGH', '4-NOT SPECIFIED'], metric)::BIGINT AS position FROM t GROUP BY metric""")
def leaderboard_pivot(spark, d):
    rows = table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("arm")).agg((F.avg("o_totalprice") / 100000).alias("v"))
    cells = rows.select("metric", "arm", ranking.cell_text(F.lit("mean"), F.col("v"), F.col("v") > 2.5).alias("cell"))
    return ranking.leaderboard(cells, ["O", "F", "P", "X"], ["5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH", "4-NOT SPECIFIED"])
