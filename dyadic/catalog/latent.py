"""Queries: components, classifiers, probes, axes, clusters, scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from dyadic.catalog import recipes as R
from dyadic.catalog.statistics import SQL_CAL, SQL_ML_ICC, calibration, sql_quantile
from dyadic.catalog.registry import query, r6, rounded, sql_draw, sql_draw_integer, sr6, table
from dyadic.functions import columns as C
from dyadic.operators import clustering, domain, factors, multivariate, ranking, scoring


@query("pca_plane", f"""
WITH v AS (SELECT l_orderkey, l_partkey, l_extendedprice / 10000 AS x, l_quantity / 5 AS y FROM lineitem),
 s AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM v),
 e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS lam FROM s), u AS (SELECT *, b / sqrt(b * b + (lam - a) * (lam - a)) AS ux, (lam - a) / sqrt(b * b + (lam - a) * (lam - a)) AS uy FROM e),
 w AS (SELECT *, CASE WHEN (CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE uy END) < 0 THEN -1 ELSE 1 END AS sg FROM u)
SELECT l_orderkey, l_partkey, {sr6('sg * ((x - mx) * ux + (y - my) * uy)')} AS score FROM v, w""")
def pca_plane(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", F.array(F.col("l_extendedprice") / 10000, F.col("l_quantity") / 5).alias("z"))
    out = multivariate.pca_vectors(rows, 1, ["l_orderkey", "l_partkey"])["scores"]
    return out.select("l_orderkey", "l_partkey", r6(F.col("scores")[0]).alias("score"))


@query("pca_scores", f"""
WITH c AS (SELECT sample_id, feature_id, value - avg(value) OVER (PARTITION BY feature_id) AS v FROM ({R.SQL_DENSE}))
SELECT a.sample_id AS subject_id, {sr6('sum(a.v * a.v)')} AS norm2, {sr6('sum(a.v * b.v)')} AS with_next FROM c a LEFT JOIN c b ON b.sample_id = a.sample_id + 1 AND b.feature_id = a.feature_id GROUP BY 1""")
def pca_scores(spark, d):
    # All components together keep every inner product of the centred rows, however they are turned.
    rows = R.dense(spark, d).withColumnRenamed("sample_id", "subject_id")
    scores = multivariate.pca_long(rows, 64)["scores"]
    after = scores.select((F.col("subject_id") - 1).alias("subject_id"), F.col("scores").alias("next"))
    return scores.join(after, "subject_id", "left").select(
        "subject_id", r6(C.dot(F.col("scores"), F.col("scores"))).alias("norm2"), r6(C.dot(F.col("scores"), F.col("next"))).alias("with_next"))


@query("pca_long_plane", f"""
WITH v AS (SELECT obs_id, x, y FROM ({R.SQL_VIEWS})), s AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM v),
 e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS lam FROM s), u AS (SELECT *, b / sqrt(b * b + (lam - a) * (lam - a)) AS ux, (lam - a) / sqrt(b * b + (lam - a) * (lam - a)) AS uy FROM e),
 w AS (SELECT *, CASE WHEN (CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE uy END) < 0 THEN -1 ELSE 1 END AS sg FROM u)
SELECT obs_id AS subject_id, {sr6('sg * ((x - mx) * ux + (y - my) * uy)')} AS score FROM v, w""")
def pca_long_plane(spark, d):
    rows = R.two_views(spark, d).select(F.col("obs_id").alias("subject_id"), F.col("view").alias("feature_id"), "value")
    return multivariate.pca_long(rows, 1)["scores"].select("subject_id", r6(F.col("scores")[0]).alias("score"))


@query("pca_explained", f"""
WITH f AS ({R.SQL_DENSE}) SELECT CAST(1 AS DOUBLE) AS total_ratio, {sr6('sum(v)', 4)} AS total_variance FROM (SELECT var_pop(value) AS v FROM f GROUP BY feature_id)""")
def pca_explained(spark, d):
    rows = R.points(spark, d)
    out = multivariate.pca_vectors(rows, 64, ["subject_id"])["explained"]
    return out.agg(r6(F.sum("ratio")).alias("total_ratio"), r6(F.sum("variance"), 4).alias("total_variance"))


@query("multiview_factors", f"""
WITH v AS ({R.SQL_VIEWS}), r AS (SELECT corr(x, y) AS r FROM v)
SELECT view, component, {sr6('1 / sqrt(CAST(2 AS DOUBLE))')} AS size, {sr6('(1 + abs(r) * (3 - 2 * component)) / 2')} AS ratio, CAST(sign(r) * (3 - 2 * component) AS BIGINT) AS same_way
FROM r, (SELECT unnest(['dnam', 'rna']) AS view), (SELECT unnest([1, 2]) AS component)""")
def multiview_factors(spark, d):
    # One feature a view, so that the factors have a closed form; the two loadings of a factor are equally large.
    out = multivariate.multiview_factors(R.two_views(spark, d), 2)
    loads = out["loadings"]
    way = loads.groupBy("component").agg(F.signum(F.product("loading")).cast("bigint").alias("same_way"))
    return rounded(loads.join(out["explained"], "component").join(way, "component").select(
        "view", "component", F.abs("loading").alias("size"), "ratio", "same_way"))


@query("multiview_factors_fitted")
def multiview_factors_fitted(spark, d):
    """Four factors of the full views; pytest holds them against numpy."""
    out = multivariate.multiview_factors(R.wide_views(spark, d), 4)
    return rounded(out["loadings"].join(out["explained"], "component").select("view", "feature_id", "component", "loading", "ratio"))


@query("factor_model", f"""
WITH RECURSIVE v AS ({R.SQL_VIEWS}), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, corr(x, y) AS r, CAST(0.001 AS DOUBLE) AS b FROM v),
 f AS (SELECT 0 AS i, n, r, b, CAST(1 AS DOUBLE) AS p1, CAST(0 AS DOUBLE) AS p2, CAST(0 AS DOUBLE) AS s, CAST(1 AS DOUBLE) AS t1, CAST(1 AS DOUBLE) AS t2,
   CAST(1 AS DOUBLE) AS a1, CAST(1 AS DOUBLE) AS a2, CAST(0 AS DOUBLE) AS u1, CAST(0 AS DOUBLE) AS u2 FROM s UNION ALL
  SELECT i + 1, n, r, b, s2 * h1 * v1, s2 * h2 * v2, s2, h1, h2, (b + 0.5) / (b + w1 / 2), (b + 0.5) / (b + w2 / 2), v1, v2
  FROM (SELECT *, n * (p1 * p1 + 2 * p1 * p2 * r + p2 * p2 + s) AS zz, n * (p1 + p2 * r) AS y1, n * (p1 * r + p2) AS y2,
    1 / (a1 + t1 * zz) AS c1, 1 / (a2 + t2 * zz) AS c2, c1 * t1 * y1 AS v1, c2 * t2 * y2 AS v2, v1 * v1 + c1 AS w1, v2 * v2 + c2 AS w2,
    (b + n / 2) / (b + (n - 2 * v1 * y1 + w1 * zz) / 2) AS h1, (b + n / 2) / (b + (n - 2 * v2 * y2 + w2 * zz) / 2) AS h2,
    1 / (1 + h1 * w1 + h2 * w2) AS s2 FROM f WHERE i < 6))
SELECT 'dnam' AS view, {sr6('u1')} AS loading, {sr6('1 / sqrt(t1)')} AS noise, {sr6('a1')} AS precision, {sr6('2 * u1 * (p1 + p2 * r) - u1 * u1 * (p1 * p1 + 2 * p1 * p2 * r + p2 * p2)')} AS r2 FROM f WHERE i = 6
UNION ALL
SELECT 'rna', {sr6('u2')}, {sr6('1 / sqrt(t2)')}, {sr6('a2')}, {sr6('2 * u2 * (p1 * r + p2) - u2 * u2 * (p1 * p1 + 2 * p1 * p2 * r + p2 * p2)')} FROM f WHERE i = 6""")
def factor_model(spark, d):
    """Six rounds of one factor over two features, so that SQL can follow them."""
    views = R.two_views(spark, d)
    first = views.filter("view = 'dnam'")
    stats = first.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    start = first.crossJoin(F.broadcast(stats)).select("obs_id", F.array((F.col("value") - F.col("m")) / F.col("s")).alias("z"))
    out = factors.factor_model(views, 1, rounds=6, tolerance=-1.0, start=start, turn=False)
    return rounded(out["loadings"].join(out["activity"], ["view", "factor"]).select("view", "loading", "noise", "precision", "r2"))


@query("factor_model_fitted")
def factor_model_fitted(spark, d):
    """Four factors of the full views; pytest holds the same updates against numpy and planted factors."""
    return rounded(factors.factor_model(R.wide_views(spark, d), 4, rounds=8)["activity"])


@query("encode_hook", """SELECT vec_id AS subject_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v)), 6) + 0.0 AS energy,
 round(list_max(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS peak FROM embeddings""")
def encode_hook(spark, d):
    out = multivariate.encode_with(R.points(spark, d), lambda m: np.column_stack([(m**2).sum(axis=1), m.max(axis=1)]))
    return out.select("subject_id", r6(F.col("z")[0]).alias("energy"), r6(F.col("z")[1]).alias("peak"))


@query("auc", f"""
WITH r AS (SELECT l_linestatus AS g, l_returnflag = 'A' AS pos, rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / CAST(2 AS DOUBLE) AS k FROM lineitem)
SELECT g, {sr6('(sum(k) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * CAST(count(*) FILTER (NOT pos) AS DOUBLE))')} AS auc, count(*) AS n FROM r GROUP BY g""")
def auc(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("g"), (F.col("l_returnflag") == "A").cast("int").alias("label"), F.col("l_extendedprice").alias("score"))
    return rounded(domain.auc(rows, ["g"]))


def sql_one_feature(source: str, bootstrap: int) -> str:
    """Logistic AUCs of one feature, from a CTE (sample_id, label, x): a line orders a fold by x, upwards if class 1 lies
    above class 0 in the training folds."""
    return f"""fo AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {sql_draw(42, 'sample_id')}, sample_id) - 1) % 5 AS fold FROM {source}),
 up AS (SELECT t.fold, avg(x) FILTER (label = 1 AND fo.fold <> t.fold) - avg(x) FILTER (label = 0 AND fo.fold <> t.fold) AS g FROM fo, (SELECT unnest(range(5)) AS fold) t GROUP BY 1),
 rk AS (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY x) + (count(*) OVER (PARTITION BY fold, x) - 1) / CAST(2 AS DOUBLE) AS k FROM fo),
 au AS (SELECT fold, (sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * CAST(count(*) FILTER (label = 0) AS DOUBLE)) AS auc FROM rk GROUP BY 1),
 si AS (SELECT fold, CASE WHEN g > 0 THEN auc ELSE 1 - auc END AS auc FROM au JOIN up USING (fold)),
 me AS (SELECT rep, avg(auc) AS a FROM (SELECT rep, {sql_draw_integer(42, 'rep', 'slot')} % 5 AS fold FROM (SELECT unnest(range(1, {bootstrap + 1})) AS rep), (SELECT unnest(range(5)) AS slot)) JOIN si USING (fold) GROUP BY 1)
SELECT 'lr' AS model, (SELECT {sr6('avg(auc)')} FROM si) AS mean_auc, {sr6('quantile_cont(a, 0.025)')} AS ci_low, {sr6('quantile_cont(a, 0.975)')} AS ci_high FROM me"""


@query("domain_classifier", f"""
WITH x AS (SELECT f.sample_id, label, sum(value) FILTER (feature_id % 2 = 0) AS x FROM ({R.SQL_DENSE}) f JOIN ({R.SQL_POINTS}) ON subject_id = sample_id GROUP BY ALL), {sql_one_feature('x', 200)}""")
def domain_classifier(spark, d):
    rows = R.points(spark, d).withColumnRenamed("subject_id", "sample_id").withColumn("z", F.slice(R.plane(), 1, 1))
    out = domain.domain_classifier(rows, trees=5, depth=3, bootstrap=200)
    return rounded(out["summary"].filter("model = 'lr'"))


@query("domain_classifier_fitted")
def domain_classifier_fitted(spark, d):
    """Both models on all dimensions; pytest holds them against planted signals."""
    rows = R.points(spark, d).withColumnRenamed("subject_id", "sample_id")
    out = domain.domain_classifier(rows, trees=20, depth=8, bootstrap=200)
    return rounded(out["summary"])


SQL_BLOCKS = """b AS (SELECT l_suppkey AS subject_id, avg(l_quantity) AS a1, avg(l_discount) * 100 AS a2, avg(l_tax) * 100 AS b1, avg(l_extendedprice) / 1000 AS b2 FROM lineitem GROUP BY 1)"""
_COV = ", ".join(f"covar_pop({x}, {y}) AS {x}{y}" for x, y in (
    ("a1", "a1"), ("a1", "a2"), ("a2", "a2"), ("b1", "b1"), ("b1", "b2"), ("b2", "b2"), ("a1", "b1"), ("a1", "b2"), ("a2", "b1"), ("a2", "b2")))
# Largest eigenvalue of Saa^-1 Sab Sbb^-1 Sba for two columns on each side.
_CCA = """SELECT rep, sqrt((tr + sqrt(greatest(0, tr * tr - 4 * dt))) / 2) AS rho FROM (SELECT rep,
 (a2a2 * (a1b1 * (b2b2 * a1b1 - b1b2 * a1b2) + a1b2 * (b1b1 * a1b2 - b1b2 * a1b1)) - 2 * a1a2 * (a2b1 * (b2b2 * a1b1 - b1b2 * a1b2) + a2b2 * (b1b1 * a1b2 - b1b2 * a1b1))
  + a1a1 * (a2b1 * (b2b2 * a2b1 - b1b2 * a2b2) + a2b2 * (b1b1 * a2b2 - b1b2 * a2b1))) / ((a1a1 * a2a2 - a1a2 * a1a2) * (b1b1 * b2b2 - b1b2 * b1b2)) AS tr,
 (a1b1 * a2b2 - a1b2 * a2b1) * (a1b1 * a2b2 - a1b2 * a2b1) / ((a1a1 * a2a2 - a1a2 * a1a2) * (b1b1 * b2b2 - b1b2 * b1b2)) AS dt FROM m)"""


@query("cca_max", f"""
WITH {SQL_BLOCKS}, n AS (SELECT *, row_number() OVER (ORDER BY {sql_draw(42, 'subject_id')}, subject_id) AS pos, count(*) OVER () AS n FROM b),
 p AS (SELECT rep, 1 + {sql_draw_integer(42, 'rep', 'pos')} % n AS pick FROM n, (SELECT unnest(range(1, 61)) AS rep)),
 x AS (SELECT 0 AS rep, * EXCLUDE (subject_id) FROM b UNION ALL SELECT rep, a1, a2, b1, b2 FROM p JOIN n ON pos = pick), m AS (SELECT rep, {_COV} FROM x GROUP BY rep), r AS ({_CCA})
SELECT {sr6('max(rho) FILTER (rep = 0)')} AS rho, {sr6('quantile_cont(rho, 0.025) FILTER (rep > 0)')} AS rho_ci_low, {sr6('quantile_cont(rho, 0.975) FILTER (rep > 0)')} AS rho_ci_high FROM r""")
def cca_max(spark, d):
    blocks = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject_id")).agg(
        F.avg("l_quantity").alias("a1"), (F.avg("l_discount") * 100).alias("a2"), (F.avg("l_tax") * 100).alias("b1"),
        (F.avg("l_extendedprice") / 1000).alias("b2"))
    return rounded(multivariate.cca_max(blocks, ["a1", "a2"], ["b1", "b2"], 60))


@query("loo_linear_probe", f"""
WITH {SQL_BLOCKS}, y AS (SELECT subject_id, a1, a2, b1, s_acctbal / 1000 AS t FROM b JOIN supplier ON s_suppkey = subject_id WHERE s_acctbal > 0),
 g0 AS (SELECT *, a1 - avg(a1) OVER () AS q0, t - avg(t) OVER () AS r FROM y), g1 AS (SELECT *, a2 - avg(a2) OVER () - q0 * (sum(a2 * q0) OVER () / sum(q0 * q0) OVER ()) AS q1 FROM g0),
 g2 AS (SELECT *, b1 - avg(b1) OVER () - q0 * (sum(b1 * q0) OVER () / sum(q0 * q0) OVER ()) - q1 * (sum(b1 * q1) OVER () / sum(q1 * q1) OVER ()) AS q2 FROM g1),
 h AS (SELECT r - q0 * (sum(r * q0) OVER () / sum(q0 * q0) OVER ()) - q1 * (sum(r * q1) OVER () / sum(q1 * q1) OVER ()) - q2 * (sum(r * q2) OVER () / sum(q2 * q2) OVER ()) AS e,
  1 / CAST(count(*) OVER () AS DOUBLE) + q0 * q0 / sum(q0 * q0) OVER () + q1 * q1 / sum(q1 * q1) OVER () + q2 * q2 / sum(q2 * q2) OVER () AS lev FROM g2)
SELECT {sr6('avg(abs(e / (1 - lev)))')} AS loso_mae, count(*) AS n_subjects FROM h""")
def loo_linear_probe(spark, d):
    blocks = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.array(F.avg("l_quantity"), F.avg("l_discount") * 100, F.avg("l_tax") * 100).alias("z"))
    target = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 1000)
    rows = blocks.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("z", target.alias("target"))
    return rounded(multivariate.loo_linear_probe(rows))


_PICKED = """o AS (SELECT subject_id, factor, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM f GROUP BY ALL),
 v AS (SELECT subject_id, factor, ((sum(ss) OVER p - ss) - pow(sum(s) OVER p - s, 2) / (sum(n) OVER p - n)) / (sum(n) OVER p - n - 1) AS v FROM o WINDOW p AS (PARTITION BY factor)),
 k AS (SELECT subject_id, factor FROM v QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY v DESC, factor) = 1)"""


@query("loo_probe_with_selection", f"""
WITH f AS ({R.SQL_FACTORS}), {_PICKED}, d AS (SELECT subject_id, i - 1 AS factor, z AS d, target AS y FROM ({R.SQL_DELTAS})),
 t AS (SELECT factor, count(*) AS n, sum(d) AS sd, sum(y) AS sy, sum(d * d) AS sdd, sum(d * y) AS sdy FROM d GROUP BY 1),
 h AS (SELECT d.y, d.d, t.n - 1 AS n, sd - d.d AS sd, sy - d.y AS sy, sdd - d.d * d.d AS sdd, sdy - d.d * d.y AS sdy FROM d JOIN k USING (subject_id, factor) JOIN t USING (factor))
SELECT {sr6('avg(abs(y - sy / n - (d - sd / n) * (sdy - sd * sy / n) / (sdd - sd * sd / n)))')} AS loso_mae, count(*) AS n_subjects FROM h""")
def loo_probe_with_selection(spark, d):
    # One feature a panel: the probe is then a line, whatever the feature's scale.
    rows = R.factor_scores(spark, d).withColumnRenamed("factor", "feature_id")
    return rounded(multivariate.loo_probe_with_selection(rows, R.deltas(spark, d).select("subject_id", "target"), 1, 1))


@query("loo_probe_with_selection_fitted")
def loo_probe_with_selection_fitted(spark, d):
    """Panels of ten features and two fixed ones, three factors; pytest holds it against refits in numpy."""
    rows = R.factor_scores(spark, d).withColumnRenamed("factor", "feature_id")
    targets = R.deltas(spark, d).select("subject_id", "target")
    return rounded(multivariate.loo_probe_with_selection(rows, targets, 10, 3, always=[0, 1]))


@query("gmm_archetypes", f"""
WITH f AS ({R.SQL_DENSE}), v AS (SELECT feature_id, count(*) AS n, avg(value) AS m, var_pop(value) + 1e-6::DOUBLE AS v, var_pop(value) AS s FROM f GROUP BY 1)
SELECT 1 AS best_k, CAST(1 AS DOUBLE) AS bootstrap_ari_mean, CAST(0 AS DOUBLE) AS bootstrap_ari_sd, false AS passed, true AS converged,
 {sr6('sum(n * s / v + n * ln(v) + n * ln(2 * pi())) + 2 * count(*) * ln(max(n))', 3)} AS bic, max(n) AS size FROM v""")
def gmm_archetypes(spark, d):
    # One component has a closed form.
    out = clustering.cluster_archetypes(R.points(spark, d), k_grid=(1,), bootstrap=5)
    extra = {"bic": out["bic"].select("bic").scalar(), "size": out["sizes"].select("size").scalar()}
    return rounded(out["summary"].withColumns(extra), 3)


@query("gmm_archetypes_fitted")
def gmm_archetypes_fitted(spark, d):
    """The choice among several components; pytest holds it against planted clusters."""
    return rounded(clustering.cluster_archetypes(R.points(spark, d), k_grid=(2, 3, 4), bootstrap=5)["summary"])


# Axis of the responders' first direction on the plane of fixed loadings, pointing along their mean: u(ux, uy).
_AXIS = f"""dp AS ({R.SQL_PLANE}), ds AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM dp WHERE responder),
 de AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS lam FROM ds),
 dn AS (SELECT mx, my, b / sqrt(b * b + (lam - a) * (lam - a)) AS ux, (lam - a) / sqrt(b * b + (lam - a) * (lam - a)) AS uy FROM de),
 u AS (SELECT CASE WHEN ux * mx + uy * my < 0 THEN -ux ELSE ux END AS ux, CASE WHEN ux * mx + uy * my < 0 THEN -uy ELSE uy END AS uy FROM dn)"""


@query("recovery_axis", f"WITH {_AXIS} SELECT 0 AS component, {sr6('ux')} AS weight FROM u UNION ALL SELECT 1, {sr6('uy')} FROM u")
def recovery_axis(spark, d):
    axis = multivariate.recovery_axis(R.plane_deltas(spark, d))
    return rounded(axis.select(F.posexplode("axis").alias("component", "weight")))


@query("recovery_axis_fitted")
def recovery_axis_fitted(spark, d):
    """The axis in all dimensions; pytest holds it against numpy."""
    axis = multivariate.recovery_axis(R.deltas(spark, d))
    return rounded(axis.select(F.posexplode("axis").alias("component", "weight")))


_TWO = f"""x AS (SELECT f.feature_id, f.value, f.sample_id, label FROM ({R.SQL_DENSE}) f JOIN ({R.SQL_POINTS}) ON subject_id = sample_id),
 c AS (SELECT feature_id, avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0) AS g FROM x GROUP BY 1), a AS (SELECT feature_id, g / sqrt(sum(g * g) OVER ()) AS w FROM c)"""


def _clouds(spark, d):
    return R.points(spark, d).withColumn("cloud", F.when(F.col("label") == 1, "toward").otherwise("away"))


@query("two_anchor_axis", f"WITH {_TWO} SELECT feature_id AS component, {sr6('w')} AS weight FROM a")
def two_anchor_axis(spark, d):
    axis = multivariate.two_anchor_axis(_clouds(spark, d), "toward", "away")
    return rounded(axis.select(F.posexplode("axis").alias("component", "weight")))


@query("axis_projection", f"WITH {_TWO} SELECT sample_id AS subject_id, {sr6('sum(value * w)')} AS recovery_score FROM x JOIN a USING (feature_id) GROUP BY 1")
def axis_projection(spark, d):
    axis = multivariate.two_anchor_axis(_clouds(spark, d), "toward", "away")
    return rounded(multivariate.axis_projection(R.points(spark, d), axis).select("subject_id", "recovery_score"))


@query("trajectory_consistency", f"""
WITH {_TWO}, dl AS ({R.SQL_DELTAS}), n AS (SELECT subject_id, i, responder, z / sqrt(sum(z * z) OVER (PARTITION BY subject_id)) AS u FROM dl),
 k AS (SELECT subject_id, any_value(responder) AS r, sum(u * w) AS c FROM n JOIN a ON feature_id = i - 1 GROUP BY 1)
SELECT {sr6('avg(c) FILTER (r)')} AS responder_mean_cos, {sr6('stddev_pop(c) FILTER (r)')} AS responder_sd_cos, {sr6('avg(c) FILTER (NOT r)')} AS nonresponder_mean_cos,
 {sr6('stddev_pop(c) FILTER (NOT r)')} AS nonresponder_sd_cos, {sr6('avg(c) FILTER (r) - avg(c) FILTER (NOT r)')} AS difference FROM k""")
def trajectory_consistency(spark, d):
    axis = multivariate.two_anchor_axis(_clouds(spark, d), "toward", "away")
    return rounded(multivariate.trajectory_consistency(R.deltas(spark, d), axis))


def _runs(spark, d):
    return R.points(spark, d).select(F.floor(F.col("subject_id") / 4).alias("subject_id"), (F.col("subject_id") % 4).alias("run"), "z")


@query("across_seed_consistency", f"""
WITH f AS (SELECT CAST(floor(sample_id / 4) AS BIGINT) AS s, sample_id % 4 AS run, feature_id, value / sqrt(sum(value * value) OVER (PARTITION BY sample_id)) AS u FROM ({R.SQL_DENSE})),
 c AS (SELECT a.s, a.run, b.run AS run2, sum(a.u * b.u) AS c FROM f a JOIN f b ON a.s = b.s AND a.feature_id = b.feature_id AND a.run < b.run GROUP BY ALL)
SELECT {sr6('quantile_cont(c, 0.5)')} AS median, {sr6('quantile_cont(c, 0.05)')} AS p05, count(*) AS n_pairs, quantile_cont(c, 0.5) >= 0.5 AS passed FROM c""")
def across_seed_consistency(spark, d):
    return rounded(multivariate.across_seed_consistency(_runs(spark, d)))


SQL_METRICS = ("i_trajectory_consistency", "iii_loso_reconstruction", "iv_conformal_coverage", "v_biological_coherence")


def sql_arm(runs: str, plane: str, name: str) -> str:
    """CTEs ending in `name(metric, cell)`: the metrics that the data fix, from runs (s, run, feature, u) and a plane CTE."""
    return f"""{name}_c AS (SELECT sum(a.u * b.u) AS c FROM {runs} a JOIN {runs} b ON a.s = b.s AND a.feature_id = b.feature_id AND a.run < b.run GROUP BY a.s, a.run, b.run),
 {name}_s AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM {plane} WHERE responder),
 {name}_e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS lam FROM {name}_s),
 {name}_u AS (SELECT b / sqrt(b * b + (lam - a) * (lam - a)) * o AS ux, (lam - a) / sqrt(b * b + (lam - a) * (lam - a)) * o AS uy FROM (SELECT *, CASE WHEN b * mx + (lam - a) * my < 0 THEN -1 ELSE 1 END AS o FROM {name}_e)),
 {name}_t AS (SELECT avg((x * ux + y * uy) / sqrt(x * x + y * y)) FILTER (responder) AS r, avg((x * ux + y * uy) / sqrt(x * x + y * y)) FILTER (NOT responder) AS o FROM {plane}, {name}_u),
 {name}_g AS (SELECT target, x - avg(x) OVER () AS q0, y, target - avg(target) OVER () AS r FROM {plane}),
 {name}_h AS (SELECT *, y - avg(y) OVER () - q0 * (sum(y * q0) OVER () / sum(q0 * q0) OVER ()) AS q1 FROM {name}_g),
 {name}_l AS (SELECT r - q0 * (sum(r * q0) OVER () / sum(q0 * q0) OVER ()) - q1 * (sum(r * q1) OVER () / sum(q1 * q1) OVER ()) AS e,
  1 / CAST(count(*) OVER () AS DOUBLE) + q0 * q0 / sum(q0 * q0) OVER () + q1 * q1 / sum(q1 * q1) OVER () AS lev FROM {name}_h),
 {name} AS (SELECT 'i_trajectory_consistency' AS metric, printf('runs agree %.3f, responders %.3f, gap %.3f', m, r, r - o) || CASE WHEN m >= 0.5 THEN ' | PASS' ELSE ' | FAIL' END AS cell
   FROM (SELECT quantile_cont(c, 0.5) AS m FROM {name}_c), {name}_t
  UNION ALL SELECT 'iii_loso_reconstruction', printf('left-out error %.3f', avg(abs(e / (1 - lev)))) FROM {name}_l
  UNION ALL SELECT 'iv_conformal_coverage', printf('covered %.3f', avg(CASE WHEN score <= radius THEN 1.0::DOUBLE ELSE 0 END)) FROM cov
  UNION ALL SELECT 'v_biological_coherence', printf('%d enriched sets', count(*) FILTER (q_val < 0.1)) || CASE WHEN count(*) FILTER (q_val < 0.1) >= 1 THEN ' | PASS' ELSE ' | FAIL' END FROM enr)"""


SQL_COVERED = f"""{SQL_CAL}, rad AS ({sql_quantile('stratum', 0.1, 2)}), cov AS (SELECT score, coalesce(radius, (SELECT max(radius) FROM rad)) AS radius FROM tst t LEFT JOIN rad USING (stratum)),
 enr AS ({R.sql_results()})"""


def sql_runs(name: str, condition: str = "true") -> str:
    return f"""{name} AS (SELECT CAST(floor(sample_id / 4) AS BIGINT) AS s, sample_id % 4 AS run, feature_id, value / sqrt(sum(value * value) OVER (PARTITION BY sample_id)) AS u FROM ({R.SQL_DENSE}) WHERE {condition})"""


def position(metric: str) -> str:
    return "CASE metric " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(scoring.METRICS)) + " END"


@query("score_arm", f"""
WITH {SQL_COVERED}, {sql_runs('rn')}, pl AS ({R.SQL_PLANE}), {sql_arm('rn', 'pl', 'arm')} SELECT metric, cell AS "B", {position('metric')} AS position FROM arm""")
def score_arm(spark, d):
    coverage = ranking.mondrian_conformal(*calibration(spark, d))
    cells = scoring.score_arm("B", R.plane_deltas(spark, d), _runs(spark, d), R.factor_scores(spark, d), coverage, R.results(spark, d), metrics=SQL_METRICS)
    return ranking.leaderboard(cells, ["B"], list(scoring.METRICS))


@query("score_arm_fitted")
def score_arm_fitted(spark, d):
    """All six metrics on every dimension, with the operator's own replicates and grid; pytest holds them against direct computation."""
    coverage = ranking.mondrian_conformal(*calibration(spark, d))
    cells = scoring.score_arm("B", R.deltas(spark, d), _runs(spark, d), R.factor_scores(spark, d), coverage, R.results(spark, d))
    return ranking.leaderboard(cells, ["B"], list(scoring.METRICS))


def sql_icc(source: str, out: str) -> str:
    """CTE `out(factor, icc)` of a CTE (subject_id, factor, value), by maximum likelihood."""
    return f"""{out}_g AS (SELECT factor, subject_id, count(*) AS k, avg(value) AS m, count(*) * var_pop(value) AS w FROM {source} GROUP BY ALL),
 {out}_u AS (SELECT *, m - sum(k * m) OVER (PARTITION BY factor) / sum(k) OVER (PARTITION BY factor) AS gap FROM {out}_g),
 {out}_c AS (SELECT factor, count(*) AS a, sum(k) AS n, sum(k * gap * gap) AS ssb, sum(w) AS ssw FROM {out}_u GROUP BY 1),
 {out} AS (SELECT factor, {SQL_ML_ICC} AS icc FROM {out}_c)"""


def sql_class(icc: str) -> str:
    return f"CASE WHEN {icc} > 0.85 THEN 'trait' WHEN {icc} < 0.65 THEN 'state' ELSE 'mixed' END"


def _sensitivity(spark, d, views, k: int):
    obs = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("obs_id"), F.floor(F.col("vec_id") / 2).alias("subject_id"), (F.col("vec_id") % 2).cast("int").alias("visit"))
    flagged = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") == 3).alias("flagged"))
    return rounded(scoring.sensitivity_refit(views, obs, flagged, k, bootstrap=20))


@query("sensitivity_refit", f"""
WITH v AS ({R.SQL_VIEWS}), w AS (SELECT v.* FROM v JOIN embeddings ON vec_id = obs_id WHERE label <> 3), {R.sql_pair_factors('v', 'p')}, {R.sql_pair_factors('w', 'q')},
 pf AS (SELECT CAST(floor(obs_id / 2) AS BIGINT) AS subject_id, factor, value FROM p), qf AS (SELECT CAST(floor(obs_id / 2) AS BIGINT) AS subject_id, factor, value FROM q),
 {sql_icc('pf', 'a')}, {sql_icc('qf', 'b')}
SELECT a.factor, {sr6('a.icc')} AS icc, {sql_class('a.icc')} AS classification, {sr6('b.icc')} AS icc_without, {sql_class('b.icc')} AS classification_without FROM a JOIN b USING (factor)""")
def sensitivity_refit(spark, d):
    return _sensitivity(spark, d, R.two_views(spark, d), 2)


@query("sensitivity_refit_fitted")
def sensitivity_refit_fitted(spark, d):
    """Three factors of the full views; pytest holds it against numpy."""
    return _sensitivity(spark, d, R.wide_views(spark, d), 3)
