"""Queries: the composed jobs, one each."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.catalog import recipes as R
from dyadic.catalog.latent import SQL_COVERED, SQL_METRICS, position, sql_arm, sql_class, sql_icc, sql_one_feature
from dyadic.catalog.shaping import sql_normal_quantile
from dyadic.catalog.statistics import calibration
from dyadic.catalog.models import SQL_ENRICH, SQL_RANKS, SQL_SETS, SQL_ULM, sql_grid, sql_hyper
from dyadic.catalog.registry import query, r6, rounded, sql_bh, sql_fit_own, sql_t_tail, sr6, table
from dyadic.operators import moments, ranking, scoring
from dyadic.plans import jobs
from dyadic.session import scratch_path
from dyadic.sources import tables


def _paired_samples(spark, d):
    """Customers as subjects: response, two fractions per visit and a covariate."""
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("response"),
        (F.col("c_acctbal") / 1000).alias("age"), F.when(F.col("c_nationkey") % 2 == 0, "CPT").otherwise("PE").alias("therapy"))
    o = table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("subject_id"), F.when(F.col("o_orderstatus") == "O", "PRE").otherwise("POST").alias("visit")
    ).agg((F.avg(F.col("o_orderkey") % 101) / 101).alias("frac_a"), (F.avg(F.col("o_orderkey") % 37) / 37).alias("frac_b"))
    return o.join(c, "subject_id")


def _betas(spark, d):
    """Paired fractions in (0, 1): mean price of a customer's orders per visit and priority, scaled."""
    cells = R.cells(spark, d)
    top = cells.agg(F.max("value")).scalar()
    return cells.withColumn("value", F.col("value") / (top * 1.01))


def _embedding_observations(spark, d, view: str):
    """Complete paired table: consecutive vectors as visits, dimensions as features of one of two views."""
    side = F.col("feature_id") < 32 if view == "dnam" else F.col("feature_id") >= 32
    return R.factor_scores(spark, d).withColumnRenamed("factor", "feature_id").filter(side).withColumn(
        "visit", F.when(F.col("visit") == 0, "PRE").otherwise("POST"))


def _embedding_subjects(spark, d):
    return R.deltas(spark, d).select("subject_id", F.col("responder").cast("int").alias("label"))


# Subjects with a PRE visit: response, covariate and PRE fractions; deltas as `f(sample_id, feature_id, value)`.
_SQL_SUBJECTS = """d AS (SELECT c_custkey AS sample_id, CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS DOUBLE) AS response, c_acctbal / 1000 AS age,
 avg(o_orderkey % 101) / 101 AS frac_a, avg(o_orderkey % 37) / 37 AS frac_b, any_value(CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS DOUBLE)) * avg(o_orderkey % 101) / 101 AS inter_a,
 any_value(CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS DOUBLE)) * avg(o_orderkey % 37) / 37 AS inter_b
 FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY ALL)"""


def _sql_side(name: str, visit: str) -> str:
    """Design of one visit: response, covariate, fractions and their products with response."""
    r = "CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS DOUBLE)"
    return f"""{name} AS (SELECT *, response * frac_a AS inter_a, response * frac_b AS inter_b FROM (SELECT c_custkey AS sample_id, {r} AS response, c_acctbal / 1000 AS age,
 avg(o_orderkey % 101) / 101 AS frac_a, avg(o_orderkey % 37) / 37 AS frac_b FROM customer JOIN orders ON o_custkey = c_custkey AND (o_orderstatus = 'O') = {str(visit == 'PRE').lower()} GROUP BY ALL))"""


_SQL_DELTA_DESIGN = f"""{_sql_side('dpre', 'PRE')}, {_sql_side('dpost', 'POST')},
 ddelta AS (SELECT *, response * frac_a AS inter_a, response * frac_b AS inter_b FROM (SELECT sample_id, a.response, a.age, b.frac_a - a.frac_a AS frac_a, b.frac_b - a.frac_b AS frac_b FROM dpre a JOIN dpost b USING (sample_id)))"""


def _sql_contrasts() -> str:
    parts, tags = [], []
    for contrast in ("pre", "post", "delta"):
        for c in ("a", "b"):
            name = f"{contrast}_{c}"
            parts.append(sql_fit_own(f"f{contrast}", f"d{contrast}", ["response", "age", f"frac_{c}", f"inter_{c}"], name))
            tags.append(f"SELECT '{contrast}' AS contrast, 'frac_{c}' AS cell_type, feature_id, coef, t_stat, df FROM {name}_fit")
    beta = "greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, value / (top * CAST(1.01 AS DOUBLE))))"
    return f"""WITH raw AS ({R.sql_cells()}), cells AS (SELECT subject_id, visit, feature_id, greatest(-8, least(8, log2({beta} / (1 - {beta})))) AS value FROM raw, (SELECT max(value) AS top FROM raw)),
 fpre AS (SELECT subject_id AS sample_id, feature_id, value FROM cells WHERE visit = 'PRE'), fpost AS (SELECT subject_id AS sample_id, feature_id, value FROM cells WHERE visit = 'POST'),
 fdelta AS (SELECT subject_id AS sample_id, feature_id, delta AS value FROM ({R.sql_delta()})), {_SQL_DELTA_DESIGN}, {', '.join(parts)}, u AS ({' UNION ALL '.join(tags)}),
 p AS (SELECT *, {sql_t_tail('t_stat', 'df')} AS p_val FROM u), q AS ({sql_bh('p', 'contrast, cell_type')}),
 w AS (SELECT feature_id, cell_type, bool_or(q_val < 0.5) FILTER (contrast = 'delta') AS d, bool_or(q_val < 0.5) FILTER (contrast <> 'delta') AS e FROM q GROUP BY ALL)
SELECT feature_id, cell_type, {sr6('coef')} AS coef, {sr6('p_val')} AS p_val, {sr6('q_val')} AS q_val,
 CASE WHEN d AND NOT e THEN 'state_of_recovery' WHEN d THEN 'baseline_and_recovery' WHEN e THEN 'trait_stable' ELSE 'other' END AS cross_contrast_class
FROM q JOIN w USING (feature_id, cell_type) WHERE contrast = 'delta'"""


_SQL_PC1_DELTA = f"""WITH cells AS ({R.sql_cells()}), f AS (SELECT subject_id AS sample_id, feature_id, delta AS value FROM ({R.sql_delta()})), {_SQL_DELTA_DESIGN},
 s AS (SELECT *, (frac_a - avg(frac_a) OVER ()) / stddev_pop(frac_a) OVER () AS za, (frac_b - avg(frac_b) OVER ()) / stddev_pop(frac_b) OVER () AS zb, corr(frac_a, frac_b) OVER () AS r FROM ddelta),
 d AS (SELECT *, response * pc1 AS inter FROM (SELECT *, (CASE WHEN r >= 0 THEN za + zb ELSE za - zb END) / sqrt(2) AS pc1 FROM s)),
 {sql_fit_own('f', 'd', ['response', 'age', 'pc1', 'inter'], 'i')}, {sql_fit_own('f', 'd', ['age', 'pc1', 'inter', 'response'], 'r')},
 u AS (SELECT 'interaction' AS term, * FROM i_fit UNION ALL SELECT 'response', * FROM r_fit), p AS (SELECT *, {sql_t_tail('t_stat', 'df')} AS p_val FROM u)
SELECT feature_id, term, n, {sr6('abs(coef)', 4)} AS size, {sr6('se', 4)} AS se, {sr6('p_val')} AS p_val, {sr6('q_val')} AS q_val FROM ({sql_bh('p', 'term')})"""


@query("job_load_check", f"""
WITH v AS ({R.SQL_VISITS}), o AS (SELECT l_orderkey FROM lineitem GROUP BY 1)
SELECT visit, response, count(*) AS n, (SELECT count(*) FROM o) AS n_samples, (SELECT count(*) FROM o WHERE l_orderkey NOT IN (SELECT sample_id FROM v)) AS n_unmatched FROM v GROUP BY ALL""")
def job_load_check(spark, d):
    samples = tables.canonical_samples(R.visits(spark, d))
    features = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("feature_id"), F.col("l_quantity").alias("value"))
    out = jobs.load_check(features, samples)
    count = F.count(F.lit(1))
    return out["groups"].withColumns({
        "n_samples": out["coverage"].agg(count).scalar(), "n_unmatched": out["unmatched"].agg(count).scalar()})


@query("job_fraction_gate", f"""
WITH f AS (SELECT o_custkey AS s, CASE o_orderstatus WHEN 'O' THEN 'O' ELSE 'F' END AS v, avg(o_orderkey % 101) / 101 AS mono, avg(o_orderkey % 37) / 37 AS neu FROM orders GROUP BY ALL),
 d AS (SELECT b.mono - a.mono AS mono, b.neu - a.neu AS neu, CASE WHEN b.mono > 0 AND a.mono > 0 THEN b.neu / b.mono - a.neu / a.mono END AS ratio FROM f a JOIN f b ON a.s = b.s AND a.v = 'O' AND b.v = 'F'),
 s AS (SELECT count(*) AS n_paired, stddev_samp(mono) AS sm, stddev_samp(neu) AS sn, corr(mono, ratio) FILTER (ratio IS NOT NULL) AS r, count(ratio) AS n_pairs FROM d)
SELECT n_paired, {sr6('sm')} AS sd_mono, {sr6('sn')} AS sd_neu, {sr6('r')} AS r, n_pairs,
 CASE WHEN sm >= 0.02 AND sn >= 0.02 AND abs(r) >= 0.3 THEN 'PASS' WHEN sm >= 0.02 AND sn >= 0.02 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM s""")
def job_fraction_gate(spark, d):
    rows = _paired_samples(spark, d).select("subject_id", "visit", "frac_a", "frac_b")
    return rounded(jobs.fraction_gate(rows, "frac_a", "frac_b", ["frac_a"])["summary"])


@query("job_shift_gate", f"""
WITH v AS (SELECT CAST(floor(obs_id / 2) AS BIGINT) AS s, obs_id % 2 AS visit, x FROM ({R.SQL_VIEWS})), dl AS (SELECT s, max(x) FILTER (visit = 1) - max(x) FILTER (visit = 0) AS v FROM v GROUP BY 1),
 r AS (SELECT DISTINCT subject_id, CAST(responder AS INT) AS label FROM ({R.SQL_DELTAS})),
 x AS (SELECT concat_ws('-', label, s) AS sample_id, label, (v - avg(v) OVER (PARTITION BY label)) / stddev_pop(v) OVER (PARTITION BY label) AS x FROM dl JOIN r ON subject_id = s), {sql_one_feature('x', 100)}""")
def job_shift_gate(spark, d):
    flags = _embedding_subjects(spark, d)
    rows = R.two_views(spark, d).filter("view = 'dnam'").select(
        F.floor(F.col("obs_id") / 2).alias("subject_id"), F.when(F.col("obs_id") % 2 == 0, "PRE").otherwise("POST").alias("visit"), "feature_id", "value")
    a, b = (rows.join(flags.filter(F.col("label") == i), "subject_id", "left_semi") for i in (0, 1))
    out = jobs.shift_gate(a, b, top=1, minimum=1, trees=5, bootstrap=100)
    return rounded(out["summary"].filter("model = 'lr'"))


@query("job_shift_gate_fitted")
def job_shift_gate_fitted(spark, d):
    """Both models on the shared panel, with the verdict."""
    flags = _embedding_subjects(spark, d)
    rows = _embedding_observations(spark, d, "dnam").unionByName(_embedding_observations(spark, d, "rna"))
    a, b = (rows.join(flags.filter(F.col("label") == i), "subject_id", "left_semi") for i in (0, 1))
    out = jobs.shift_gate(a, b, top=40, minimum=5, trees=10, bootstrap=100)
    return rounded(out["summary"].withColumn("verdict", out["verdict"].select("verdict").scalar()))


def _sql_separation(top_dnam: int, top_rna: int, source: str) -> str:
    """CTEs: scaled panel `z(subject_id, label, feature_id, v)` of the deltas in CTE `source(subject_id, label, feature_id, v)`."""
    return f"""var AS (SELECT feature_id, var_samp(v) AS s FROM {source} GROUP BY 1),
 pick AS (SELECT feature_id FROM var QUALIFY row_number() OVER (PARTITION BY feature_id < 32 ORDER BY s DESC, feature_id) <= CASE WHEN feature_id < 32 THEN {top_dnam} ELSE {top_rna} END),
 z AS (SELECT subject_id, label, feature_id, (v - avg(v) OVER (PARTITION BY feature_id)) / stddev_pop(v) OVER (PARTITION BY feature_id) AS v FROM {source} JOIN pick USING (feature_id)),
 s AS (SELECT DISTINCT subject_id, label FROM {source}), g AS ({sql_grid('s', 99)}), t AS (SELECT sum(v * v) AS sst FROM z),
 m AS (SELECT rep, g.label, feature_id, sum(v) AS s, count(*) AS k FROM g JOIN z USING (subject_id) GROUP BY ALL),
 b AS (SELECT rep, sum(s * s / k) AS ssb, max(n) AS n FROM m, (SELECT count(*) AS n FROM s) GROUP BY rep), f AS (SELECT rep, ssb / ((sst - ssb) / (n - 2)) AS f FROM b, t),
 test AS (SELECT max(f) FILTER (rep = 0) AS f_statistic, count(*) FILTER (rep > 0 AND f >= (SELECT f FROM f WHERE rep = 0)) / CAST(99 AS DOUBLE) AS p_value, count(*) FILTER (rep > 0) AS n_permutations FROM f)"""


_SQL_RAW = f"raw AS (SELECT subject_id, CAST(responder AS INT) AS label, i - 1 AS feature_id, z AS v FROM ({R.SQL_DELTAS}))"
# Residuals on two covariates, orthogonalised one after the other.
_SQL_CLEAN = f"""{_SQL_RAW}, ca AS (SELECT *, sin(subject_id) - avg(sin(subject_id)) OVER p AS q0, cos(subject_id) - avg(cos(subject_id)) OVER p AS b, v - avg(v) OVER p AS y FROM raw WINDOW p AS (PARTITION BY feature_id)),
 cb AS (SELECT *, b - q0 * (sum(b * q0) OVER p / sum(q0 * q0) OVER p) AS q1 FROM ca WINDOW p AS (PARTITION BY feature_id)),
 clean AS (SELECT subject_id, label, feature_id, y - q0 * (sum(y * q0) OVER p / sum(q0 * q0) OVER p) - q1 * (sum(y * q1) OVER p / sum(q1 * q1) OVER p) AS v FROM cb WINDOW p AS (PARTITION BY feature_id))"""
_SQL_TEST = f"SELECT {sr6('f_statistic')} AS f_statistic, {sr6('p_value')} AS p_value, n_permutations FROM test"


def _sql_plane(rule: str) -> str:
    """Everything the gate reports of a panel of two features, whose components have a closed form."""
    return f"""w AS (SELECT subject_id, any_value(label) AS label, max(v) FILTER (feature_id < 32) AS x, max(v) FILTER (feature_id >= 32) AS y FROM z GROUP BY 1),
 c AS (SELECT label, (x + o * y) / sqrt(2) AS a, (x - o * y) / sqrt(2) AS b FROM (SELECT *, sign(corr(x, y) OVER ()) AS o FROM w)),
 h AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0, avg(a) FILTER (label = 1) - avg(a) FILTER (label = 0) AS ga, avg(b) FILTER (label = 1) - avg(b) FILTER (label = 0) AS gb,
  var_pop(a) FILTER (label = 1) AS a1, var_pop(a) FILTER (label = 0) AS a0, var_pop(b) FILTER (label = 1) AS b1, var_pop(b) FILTER (label = 0) AS b0,
  covar_pop(a, b) FILTER (label = 1) AS c1, covar_pop(a, b) FILTER (label = 0) AS c0 FROM c),
 k AS (SELECT *, greatest(abs(ga) / sqrt(((n1 - 1) * a1 + (n0 - 1) * a0) / (n1 + n0 - 2)), abs(gb) / sqrt(((n1 - 1) * b1 + (n0 - 1) * b0) / (n1 + n0 - 2))) AS d,
  (n1 * a1 + n0 * a0) / (n1 + n0 - 2) AS pa, (n1 * b1 + n0 * b0) / (n1 + n0 - 2) AS pb, (n1 * c1 + n0 * c0) / (n1 + n0 - 2) AS pc FROM h),
 t2 AS (SELECT *, (ga * ga * pb - 2 * ga * gb * pc + gb * gb * pa) / (pa * pb - pc * pc) * n1 * n0 / (n1 + n0) AS t2 FROM k)
SELECT {sr6('f_statistic')} AS f_statistic, {sr6('p_value')} AS p_value, n_permutations, {sr6('d')} AS max_cohens_d,
 {sr6('pow(1 + 2 * (t2 * (n1 + n0 - 3) / (2 * (n1 + n0 - 2))) / (n1 + n0 - 3), -(n1 + n0 - 3) / CAST(2 AS DOUBLE))')} AS hotelling_p, {rule} AS verdict FROM t2, test"""


_SQL_GATE = "CASE WHEN p_value < 0.05 AND d >= 0.3 THEN 'PASS' WHEN p_value < 0.15 THEN 'MARGINAL' ELSE 'FAIL' END"
_SQL_RESCUE = "CASE WHEN p_value < 0.05 AND d > 0.3 THEN 'RESCUE_PASS' WHEN p_value < 0.15 THEN 'MARGINAL' ELSE 'FAIL' END"


def _separation(spark, d, top_dnam: int, top_rna: int, corrected: bool, k: int | None = None):
    covariate = R.deltas(spark, d).select("subject_id", F.sin("subject_id").alias("frac_a"), F.cos("subject_id").alias("frac_b"))
    extra = {"corrected_by": {"dnam": covariate, "rna": covariate}, "columns": ["frac_a", "frac_b"]} if corrected else {}
    return jobs.separation_gate(
        _embedding_observations(spark, d, "dnam"), _embedding_observations(spark, d, "rna"), _embedding_subjects(spark, d),
        top_dnam=top_dnam, top_rna=top_rna, k=k or top_dnam + top_rna, replicates=99, **extra)["summary"]


# With all components the permutation test does not depend on how they are turned; the plane covers what does.
@query("job_separation_gate", f"WITH {_SQL_RAW}, {_sql_separation(24, 16, 'raw')} {_SQL_TEST}")
def job_separation_gate(spark, d):
    return rounded(_separation(spark, d, 24, 16, False).select("f_statistic", "p_value", "n_permutations"))


@query("job_separation_gate_corrected", f"WITH {_SQL_CLEAN}, {_sql_separation(24, 16, 'clean')} {_SQL_TEST}")
def job_separation_gate_corrected(spark, d):
    return rounded(_separation(spark, d, 24, 16, True).select("f_statistic", "p_value", "n_permutations"))


@query("job_separation_gate_plane", f"WITH {_SQL_RAW}, {_sql_separation(1, 1, 'raw')}, {_sql_plane(_SQL_GATE)}")
def job_separation_gate_plane(spark, d):
    return rounded(_separation(spark, d, 1, 1, False))


@query("job_separation_gate_corrected_plane", f"WITH {_SQL_CLEAN}, {_sql_separation(1, 1, 'clean')}, {_sql_plane(_SQL_RESCUE)}")
def job_separation_gate_corrected_plane(spark, d):
    return rounded(_separation(spark, d, 1, 1, True))


@query("job_separation_gate_fitted")
def job_separation_gate_fitted(spark, d):
    """Five components of the panel, with effect sizes and verdict."""
    return rounded(_separation(spark, d, 24, 16, False, 5))


@query("job_separation_gate_corrected_fitted")
def job_separation_gate_corrected_fitted(spark, d):
    """As `job_separation_gate_fitted`, of deltas cleaned of two covariates."""
    return rounded(_separation(spark, d, 24, 16, True, 5))


@query("job_direction_gate", f"""
WITH f AS ({R.SQL_DENSE}), r AS (SELECT *, (rank() OVER (PARTITION BY feature_id ORDER BY value) - 1 +
 (count(*) OVER (PARTITION BY feature_id, value) - 1) / CAST(2 AS DOUBLE)) / (count(*) OVER (PARTITION BY feature_id) - 1) AS level FROM f),
 e AS (SELECT *, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, level)) AS p FROM r), z AS (SELECT sample_id, feature_id, {sql_normal_quantile('p')} AS z FROM e),
 l AS (SELECT vec_id AS subject_id, label AS class, CAST(label < 5 AS INT) AS label FROM embeddings),
 a AS (SELECT feature_id, avg(z) AS a FROM z JOIN l ON subject_id = sample_id WHERE class = 9 GROUP BY 1),
 c AS (SELECT subject_id, feature_id, z - a AS v FROM z JOIN a USING (feature_id) JOIN l ON subject_id = sample_id WHERE class < 8),
 s AS (SELECT subject_id, label FROM l WHERE class < 8), g AS ({sql_grid('s', 50)}),
 m AS (SELECT rep, label, feature_id, avg(v) AS m FROM g JOIN c USING (subject_id) GROUP BY ALL), d AS (SELECT rep, label, sqrt(sum(m * m)) AS e FROM m GROUP BY ALL),
 k AS (SELECT rep, max(e) FILTER (label = 0) AS d0, max(e) FILTER (label = 1) AS d1 FROM d GROUP BY rep), o AS (SELECT * FROM k WHERE rep = 0),
 t AS (SELECT max(o.d0) AS d_zero, max(o.d1) AS d_one, max(o.d0 - o.d1) AS gap, count(*) FILTER (k.d0 - k.d1 <= o.d0 - o.d1) / CAST(50 AS DOUBLE) AS p_value, count(*) AS n_permutations FROM k, o WHERE k.rep > 0)
SELECT {sr6('d_zero', 4)} AS d_zero, {sr6('d_one', 4)} AS d_one, {sr6('gap', 4)} AS gap, {sr6('p_value', 4)} AS p_value, n_permutations, gap < 0 AS direction_ok,
 CASE WHEN gap >= 0 THEN 'FAIL' WHEN p_value < 0.05 THEN 'PASS' WHEN p_value < 0.15 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM t""")
def job_direction_gate(spark, d):
    return rounded(_direction(spark, d, 64, plane=False)["test"], 4)


@query("job_direction_gate_fitted")
def job_direction_gate_fitted(spark, d):
    """The gate on a panel of 32 features: its plane, with the test and the verdict beside every score."""
    out = _direction(spark, d, 32, plane=True)
    return rounded(out["plane"].crossJoin(F.broadcast(out["test"])), 4)


def _direction(spark, d, top: int, plane: bool):
    rows = R.dense(spark, d)
    labels = R.points(spark, d).select(F.col("subject_id").alias("sample_id"), "label", "class")
    own = rows.join(labels.filter("class < 8"), "sample_id", "left_semi")
    external = rows.join(labels.filter("class >= 8"), "sample_id", "left_semi")
    return jobs.direction_gate(own, external, labels.filter("class < 8").select("sample_id", "label"), labels.filter("class = 9"), top, 50, plane=plane)


def _sql_three() -> str:
    """Non-negative least squares of three columns: of all sets of columns, the best fit without a negative weight."""
    fits = {
        "a": ("ya / aa", "0", "0"), "b": ("0", "yb / bb", "0"), "c": ("0", "0", "yc / cc"),
        "ab": ("(bb * ya - ab * yb) / (aa * bb - ab * ab)", "(aa * yb - ab * ya) / (aa * bb - ab * ab)", "0"),
        "ac": ("(cc * ya - ac * yc) / (aa * cc - ac * ac)", "0", "(aa * yc - ac * ya) / (aa * cc - ac * ac)"),
        "bc": ("0", "(cc * yb - bc * yc) / (bb * cc - bc * bc)", "(bb * yc - bc * yb) / (bb * cc - bc * bc)"),
    }
    det = "(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))"
    fits["abc"] = (
        f"(ya * (bb * cc - bc * bc) - ab * (yb * cc - bc * yc) + ac * (yb * bc - bb * yc)) / {det}",
        f"(aa * (yb * cc - bc * yc) - ya * (ab * cc - bc * ac) + ac * (ab * yc - yb * ac)) / {det}",
        f"(aa * (bb * yc - yb * bc) - ab * (ab * yc - yb * ac) + ya * (ab * bc - bb * ac)) / {det}")
    rows = " UNION ALL ".join(f"SELECT *, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, CAST({z} AS DOUBLE) AS z FROM m" for x, y, z in fits.values())
    loss = "aa * x * x + bb * y * y + cc * z * z + 2 * (ab * x * y + ac * x * z + bc * y * z) - 2 * (ya * x + yb * y + yc * z)"
    return f"SELECT sample_id, x / (x + y + z) AS x, y / (x + y + z) AS y, z / (x + y + z) AS z FROM ({rows}) WHERE x >= 0 AND y >= 0 AND z >= 0 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY {loss}) = 1"


@query("job_cell_fractions", f"""
WITH bt AS (SELECT l_suppkey AS sample_id, l_partkey AS feature_id, avg(l_discount) * 10 AS v FROM lineitem GROUP BY ALL),
 pn AS (SELECT p_partkey AS feature_id, p_size / CAST(50 AS DOUBLE) AS a, CAST(p_partkey * 13 % 97 AS DOUBLE) / 97 AS b, p_retailprice / CAST(3000 AS DOUBLE) AS c FROM part),
 m AS (SELECT sample_id, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * v) AS ya, sum(b * v) AS yb, sum(c * v) AS yc FROM bt JOIN pn USING (feature_id) GROUP BY 1),
 n AS ({_sql_three()})
SELECT s_suppkey AS sample_id, s_name, {sr6('x')} AS epidish_a, {sr6('y')} AS epidish_b, {sr6('z')} AS epidish_c, sample_id IS NOT NULL AS matched FROM supplier LEFT JOIN n ON s_suppkey = sample_id""")
def job_cell_fractions(spark, d):
    betas = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("feature_id")).agg(
        (F.avg("l_discount") * 10).alias("value"))
    panel = table(spark, d, "part").select(
        F.col("p_partkey").alias("feature_id"), (F.col("p_size") / 50.0).alias("a"), (F.col("p_partkey") * 13 % 97 / 97.0).alias("b"),
        (F.col("p_retailprice") / 3000.0).alias("c"))
    samples = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), "s_name")
    return rounded(jobs.cell_fractions(betas, panel, ["a", "b", "c"], samples)["samples"])


@query("job_interaction_contrasts", _sql_contrasts())
def job_interaction_contrasts(spark, d):
    out = jobs.interaction_contrasts(_betas(spark, d), _paired_samples(spark, d), ["frac_a", "frac_b"], ["age"], fdr=0.5)
    tested = out["delta"].filter("term = 'interaction'").select("feature_id", "cell_type", "coef", "p_val", "q_val")
    return rounded(tested.join(out["classes"], ["feature_id", "cell_type"]))


@query("job_differential_expression", _SQL_PC1_DELTA)
def job_differential_expression(spark, d):
    out = jobs.differential_expression(R.cells(spark, d), _paired_samples(spark, d), ["frac_a", "frac_b"], ["age"])
    # The sign of a component is a convention, so sizes are compared.
    return out["delta"].select("feature_id", "term", "n", r6(F.abs("coef"), 4).alias("size"), r6("se", 4).alias("se"),
                               r6("p_val").alias("p_val"), r6("q_val").alias("q_val"))


def _activity(spark, d, method: str):
    features = R.matrix(spark, d)
    subject = F.floor(F.col("s_suppkey") / 2)
    s = table(spark, d, "supplier")
    pairs = s.groupBy(subject.alias("subject_id")).agg(
        F.min("s_suppkey").alias("pre_id"), F.max("s_suppkey").alias("post_id")).filter("pre_id < post_id")
    samples = s.groupBy(subject.alias("sample_id")).agg((F.min("s_nationkey") % 2).alias("response"), F.avg("s_acctbal").alias("age"))
    return jobs.activity_association(features, pairs, R.network(spark, d), samples, ["age"], method=method)


def _sql_association(scores: str) -> str:
    """CTEs ending in `q`: association of the paired deltas of a CTE body (sample_id, source, score) with response."""
    return f"""sc AS ({scores}), pr AS (SELECT CAST(floor(s_suppkey / 2) AS BIGINT) AS s, min(s_suppkey) AS a, max(s_suppkey) AS b FROM supplier GROUP BY 1 HAVING min(s_suppkey) < max(s_suppkey)),
 fa AS (SELECT s AS sample_id, x.source AS feature_id, y.score - x.score AS value FROM pr JOIN sc x ON x.sample_id = a JOIN sc y ON y.sample_id = b AND y.source = x.source WHERE y.score - x.score IS NOT NULL),
 da AS (SELECT CAST(floor(s_suppkey / 2) AS BIGINT) AS sample_id, CAST(min(s_nationkey) % 2 AS DOUBLE) AS response, avg(s_acctbal) AS age FROM supplier GROUP BY 1),
 {sql_fit_own('fa', 'da', ['age', 'response'], 'as')}, ap AS (SELECT *, {sql_t_tail('t_stat', 'df')} AS p_val FROM as_fit), q AS ({sql_bh('ap', '')})"""


@query("job_set_activity", f"""
WITH {_sql_association(SQL_SETS)} SELECT feature_id, n, {sr6('coef')} AS coef, {sr6('se')} AS se, {sr6('p_val')} AS p_val, {sr6('q_val')} AS q_val FROM q""")
def job_set_activity(spark, d):
    return rounded(_activity(spark, d, "ssgsea")["association"].select("feature_id", "n", "coef", "se", "p_val", "q_val"))


@query("job_regulator_activity", f"""
WITH {_sql_association(SQL_ULM)}, c AS (SELECT min(n) AS n FROM (SELECT count(score) AS n FROM sc GROUP BY sample_id)),
 h AS (SELECT count(*) FILTER (q_val < 0.5) AS n FROM q WHERE regexp_matches(feature_id, '^(PROMO|SMALL|LARGE)'))
SELECT h.n AS n_family_hits, c.n AS min_sources, c.n >= 5 AND h.n > 0 AS accepted FROM h, c""")
def job_regulator_activity(spark, d):
    return jobs.regulator_report(_activity(spark, d, "ulm"), {"NFAT": ("PROMO", "SMALL"), "WNT": ("LARGE",)}, 0.5, 5)


@query("job_regulatory_enrichment", SQL_ENRICH)
def job_regulatory_enrichment(spark, d):
    from dyadic.operators import enrichment

    e = table(spark, d, "events")
    manifest = R.spots(spark, d).select("feature_id", "chrom", F.col("start").alias("position"))
    sites = enrichment.ids_to_intervals(e.select(F.col("event_id").alias("feature_id")), manifest)
    targets = R.regions(spark, d).withColumn("chrom", F.concat(F.lit("chr"), "chrom"))
    results = e.select(F.col("event_id").alias("feature_id"), (F.col("user_id") % 4).alias("cell_type"),
                       R.hashed_p(F.lit("sig"), F.col("event_id")).alias("q_val"))
    return rounded(enrichment.regulatory_enrichment(results, sites, sites, targets, fdr=0.3))


@query("job_replication", f"""
WITH cells AS ({R.sql_cells()}), f AS (SELECT subject_id AS sample_id, feature_id, delta AS value FROM ({R.sql_delta()})), {_SQL_SUBJECTS},
 {sql_fit_own('f', 'd', ['age', 'response'], 'o')}, ref AS (SELECT feature_id, avg(value) AS reference_coef FROM ({R.sql_cells('P')}) GROUP BY 1),
 j AS (SELECT coef, reference_coef, {sql_t_tail('t_stat', 'df')} AS p_val, sign(coef) = sign(reference_coef) AS same FROM o_fit JOIN ref USING (feature_id)),
 k AS (SELECT *, {SQL_RANKS.format('coef')} AS x, {SQL_RANKS.format('reference_coef')} AS y FROM j)
SELECT count(p_val) AS n_tested, count(*) FILTER (same AND p_val < 0.1) AS n_replicated, round(count(*) FILTER (same AND p_val < 0.1) / CAST(count(p_val) AS DOUBLE) * 100, 2) AS pct_replicated,
 CASE WHEN count(*) FILTER (same AND p_val < 0.1) / CAST(count(p_val) AS DOUBLE) * 100 >= 40 THEN 'PASS' ELSE 'FAIL' END AS verdict, {sr6('corr(x, y)')} AS spearman_rho FROM k""")
def job_replication(spark, d):
    samples = _paired_samples(spark, d).filter("visit = 'PRE'").withColumn("sample_id", F.col("subject_id"))
    reference = R.cells(spark, d, "P").groupBy("feature_id").agg(F.avg("value").alias("coef"))
    out = jobs.replication(R.cells(spark, d), samples, reference, "therapy", "CPT", ["age"])
    return rounded(out["summary"])


@query("job_set_enrichment", f"""
WITH h AS (SELECT * FROM ({R.sql_results()}) WHERE q_val < 0.02), l0 AS (SELECT DISTINCT cell_type, unnest(string_split(p_name, ' ')) AS gene_id FROM h JOIN part ON p_partkey = feature_id),
 l AS (SELECT * FROM l0 WHERE gene_id <> '' QUALIFY count(*) OVER (PARTITION BY cell_type) >= 2),
 g AS (SELECT DISTINCT p_brand || ' ' || p_type AS term, unnest(string_split(p_name, ' ')) AS gene_id FROM part),
 t AS (SELECT term, count(*) AS n_feature FROM g GROUP BY 1), s AS (SELECT cell_type, count(*) AS n_sig FROM l WHERE gene_id IN (SELECT gene_id FROM g) GROUP BY 1),
 o AS (SELECT cell_type, term, count(*) AS observed FROM l JOIN g USING (gene_id) GROUP BY ALL),
 j AS (SELECT o.*, n_sig, n_feature, (SELECT count(DISTINCT gene_id) FROM g) AS n_background FROM o JOIN s USING (cell_type) JOIN t USING (term)),
 p AS (SELECT *, {sql_hyper('observed', 'n_background', 'n_feature', 'n_sig')} AS p_val FROM j), q AS ({sql_bh('p', 'cell_type', tie='term')}),
 k AS (SELECT DISTINCT cell_type, theme FROM q JOIN (VALUES ('wnt', 'promo'), ('cd8t', 'small')) w(theme, word) ON contains(lower(term), word)),
 c AS (SELECT cell_type, count(*) AS n_themes, count(*) >= 2 OR bool_or(theme IN ('monocyte', 'inflammatory', 'wnt')) AS coherent FROM k GROUP BY 1)
SELECT cell_type, 'brand' AS library, term, observed, {sr6('p_val')} AS p_val, {sr6('q_val')} AS q_val, n_themes, coherent FROM q LEFT JOIN c USING (cell_type)""")
def job_set_enrichment(spark, d):
    p = table(spark, d, "part")
    notes = p.select(F.col("p_partkey").alias("feature_id"), F.regexp_replace("p_name", " ", ";").alias("gene"), F.lit("").alias("fallback"))
    genes = F.explode(F.split("p_name", " "))
    sets = p.select(F.lit("brand").alias("library"), F.concat_ws(" ", "p_brand", "p_type").alias("term"), genes.alias("gene_id"))
    out = jobs.set_enrichment(R.results(spark, d), notes, sets, fdr=0.02, cut=1.1, min_genes=2, keywords={"wnt": ("promo",), "cd8t": ("small",)})
    return rounded(out["terms"].select("cell_type", "library", "term", "observed", "p_val", "q_val").join(out["coherence"], "cell_type", "left"))


@query("job_second_cohort", f"""
WITH cells AS ({R.sql_cells('P')}), f AS (SELECT subject_id AS sample_id, feature_id, delta AS value FROM ({R.sql_delta()})), {_SQL_SUBJECTS},
 {sql_fit_own('f', 'd', ['response', 'age', 'frac_a', 'inter_a'], 'a')}, {sql_fit_own('f', 'd', ['response', 'age', 'frac_b', 'inter_b'], 'b')},
 u AS (SELECT 'frac_a' AS cell_type, feature_id, coef, t_stat, df FROM a_fit UNION ALL SELECT 'frac_b', feature_id, coef, t_stat, df FROM b_fit),
 p AS (SELECT *, {sql_t_tail('t_stat', 'df')} AS p_val FROM u), q AS ({sql_bh('p', 'cell_type')}), m AS (SELECT *, sin(length(feature_id)) AS c1 FROM q),
 k AS (SELECT *, {SQL_RANKS.format('c1')} AS x, {SQL_RANKS.format('coef')} AS y FROM m),
 s AS (SELECT count(*) AS n, avg(CASE WHEN sign(c1) = sign(coef) THEN 1.0::DOUBLE ELSE 0 END) AS sc, corr(x, y) AS rho, round(1 - least(1, count(*) FILTER (p_val > 0.5) / (count(*) * 0.5::DOUBLE)), 4) AS pi1,
  count(*) FILTER (q_val < 0.05) AS nf, count(*) FILTER (p_val < 0.05) AS np FROM k)
SELECT n AS n_hits, n AS n_matched, round(sc, 4) AS sign_concordance, round(rho, 4) + 0.0 AS spearman_rho, pi1, nf AS n_sig_fdr, np AS n_sig_p,
 CASE WHEN sc >= 0.55 AND pi1 >= 0.3 AND rho >= 0.15 THEN 'REPLICATES' WHEN sc >= 0.5 AND pi1 >= 0.2 THEN 'MARGINAL' ELSE 'DOES_NOT_REPLICATE' END AS verdict FROM s""")
def job_second_cohort(spark, d):
    samples = _paired_samples(spark, d).filter("visit = 'PRE'").withColumn("sample_id", F.col("subject_id"))
    first = jobs.second_cohort(
        R.cells(spark, d).select("feature_id").distinct().select("feature_id", F.explode(F.array(F.lit("frac_a"), F.lit("frac_b"))).alias("cell_type"))
        .withColumns({"coef": F.sin(F.length("feature_id")), "q_val": F.lit(0.01)}),
        R.cells(spark, d, "P"), samples, ["frac_a", "frac_b"], ["age"])
    return rounded(first["summary"])


@query("job_feature_tables", f"""
SELECT l_partkey AS feature_id, count(*) AS n, {sr6('sum(l_discount)')} AS total FROM lineitem
WHERE l_partkey IN (SELECT feature_id FROM ({R.sql_results()}) WHERE q_val < 0.1) GROUP BY 1""")
def job_feature_tables(spark, d):
    li = table(spark, d, "lineitem")
    dnam = li.select(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("sample_id"), F.col("l_discount").alias("value"))
    rna = li.select(F.col("l_suppkey").alias("feature_id"), F.col("l_partkey").alias("sample_id"), F.col("l_tax").alias("value"))
    gene_map = li.select(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("gene"), F.col("l_quantity").alias("distance_kb"))
    path = scratch_path(spark, "tier")
    jobs.feature_tables(dnam, rna, R.results(spark, d), gene_map, path)
    return tables.guarded_read(spark, path + "/dnam").groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


def _factor_run(spark, d, views, k: int):
    obs = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("obs_id"), F.floor(F.col("vec_id") / 2).alias("subject_id"), (F.col("vec_id") % 2).cast("int").alias("visit"),
        F.col("label").cast("double").alias("target"), (F.col("label") < 5).alias("responder"), F.sin("vec_id").alias("sex"))
    return jobs.factor_run(views, obs, k, ["sex"], bootstrap=20)


@query("job_factor_run", f"""
WITH v AS (SELECT obs_id, x, y, sin(obs_id) AS c FROM ({R.SQL_VIEWS})),
 w AS (SELECT obs_id, x - avg(x) OVER () - (c - avg(c) OVER ()) * (covar_pop(x, c) OVER () / var_pop(c) OVER ()) AS x, y - avg(y) OVER () - (c - avg(c) OVER ()) * (covar_pop(y, c) OVER () / var_pop(c) OVER ()) AS y FROM v),
 {R.sql_pair_factors('w', 'p')}, pf AS (SELECT CAST(floor(obs_id / 2) AS BIGINT) AS subject_id, factor, value FROM p), {sql_icc('pf', 'a')}
SELECT factor, {sr6('icc')} AS icc, {sql_class('icc')} AS classification FROM a""")
def job_factor_run(spark, d):
    # One feature a view; the classes do not depend on a factor's sign.
    return rounded(_factor_run(spark, d, R.two_views(spark, d), 2)["classes"].select("factor", "icc", "classification"))


@query("job_factor_run_fitted")
def job_factor_run_fitted(spark, d):
    """Four factors of the full views; pytest holds their classes against numpy."""
    return rounded(_factor_run(spark, d, R.wide_views(spark, d), 4)["classes"])


def _sql_half(arm: str, condition: str) -> str:
    plane = f"""SELECT subject_id, responder, target, sum(z) FILTER (i % 2 = 1) AS x, sum(z) FILTER (i % 2 = 0) AS y FROM (SELECT *, max(i) OVER (PARTITION BY subject_id) AS w FROM ({R.SQL_DELTAS})) WHERE {condition} GROUP BY ALL"""
    rows = f"(SELECT *, feature_id + 1 AS i, max(feature_id + 1) OVER (PARTITION BY sample_id) AS w FROM ({R.SQL_DENSE}))"
    runs = f"""SELECT CAST(floor(sample_id / 4) AS BIGINT) AS s, sample_id % 4 AS run, feature_id, value / sqrt(sum(value * value) OVER (PARTITION BY sample_id)) AS u FROM {rows} WHERE {condition}"""
    return f"run{arm} AS ({runs}), pl{arm} AS ({plane}), {sql_arm(f'run{arm}', f'pl{arm}', f'arm{arm}')}"


@query("job_leaderboard", f"""
WITH {SQL_COVERED}, {_sql_half('A', 'i <= w // 2')}, {_sql_half('B', 'i > w // 2')}
SELECT metric, a.cell AS "A", b.cell AS "B", 'n/a' AS "C", {position('metric')} AS position FROM armA a JOIN armB b USING (metric)""")
def job_leaderboard(spark, d):
    """The metrics that the data fix, of the first and the second half of the dimensions."""
    coverage, enriched = ranking.mondrian_conformal(*calibration(spark, d)), R.results(spark, d)
    half, arms = F.floor(F.size("z") / 2).cast("int"), None
    for arm in ("A", "B"):
        part = F.slice("z", 1, half) if arm == "A" else F.slice("z", half + 1, F.size("z") - half)
        rows = R.deltas(spark, d).withColumn("z", part).withColumn("z", R.plane())
        runs = R.points(spark, d).select(
            F.floor(F.col("subject_id") / 4).alias("subject_id"), (F.col("subject_id") % 4).alias("run"), part.alias("z"))
        cells = scoring.score_arm(arm, rows, runs, R.factor_scores(spark, d), coverage, enriched, metrics=SQL_METRICS)
        arms = cells if arms is None else arms.unionByName(cells)
    return ranking.leaderboard(arms, ["A", "B", "C"], list(scoring.METRICS))


@query("job_leaderboard_fitted")
def job_leaderboard_fitted(spark, d):
    """All six metrics on every dimension of each half, two or three clusters; pytest holds them against direct computation."""
    coverage, enriched = ranking.mondrian_conformal(*calibration(spark, d)), R.results(spark, d)
    width, arms = moments.vector_width(R.points(spark, d), "z"), None
    for arm, start, size in (("A", 0, width // 2), ("B", width // 2, width - width // 2)):
        part = F.slice("z", start + 1, size).alias("z")
        rows = R.deltas(spark, d).withColumn("z", part)
        runs = R.points(spark, d).select(F.floor(F.col("subject_id") / 4).alias("subject_id"), (F.col("subject_id") % 4).alias("run"), part)
        scores = R.factor_scores(spark, d).filter(F.col("factor").between(start, start + size - 1))
        cells = scoring.score_arm(arm, rows, runs, scores, coverage, enriched, k_grid=(2, 3))
        arms = cells if arms is None else arms.unionByName(cells)
    return ranking.leaderboard(arms, ["A", "B", "C"], list(scoring.METRICS))


_SQL_PROJECTION = f"""
WITH f AS (SELECT x.*, e.label FROM ({R.SQL_DENSE}) x JOIN embeddings e ON vec_id = sample_id),
 c AS (SELECT sample_id, label, comp, sum(value * cos(feature_id * comp)) AS z FROM f, (SELECT unnest([1, 2, 3, 4]) AS comp) GROUP BY ALL),
 a AS (SELECT comp, avg(z) FILTER (label = 9) - avg(z) FILTER (label = 8) AS g FROM c GROUP BY comp), u AS (SELECT comp, g / sqrt(sum(g * g) OVER ()) AS w FROM a)
SELECT sample_id AS subject_id, CASE WHEN label < 4 THEN 'R' ELSE 'NR' END AS response, 'first' AS cohort, {sr6('sum(z * w)')} AS recovery_score
FROM c JOIN u USING (comp) WHERE label < 8 GROUP BY sample_id, label"""


def _projection_inputs(spark, d):
    labels = R.points(spark, d).select(F.col("subject_id").alias("sample_id"), "class")
    rows = R.dense(spark, d).join(labels, "sample_id")
    clouds = rows.filter("class >= 8").select(
        F.when(F.col("class") == 9, "healthy").otherwise("disease").alias("cloud"), "sample_id", "feature_id", "value")
    termini = rows.filter("class < 8").select(F.col("sample_id").alias("subject_id"), "feature_id", "value")
    loadings = rows.select("feature_id").distinct().select(
        "feature_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("component")).withColumn("loading", F.cos(F.col("feature_id") * F.col("component")))
    subjects = labels.filter("class < 8").select(
        F.col("sample_id").alias("subject_id"), F.when(F.col("class") < 4, "R").otherwise("NR").alias("response"), F.lit("first").alias("cohort"))
    return clouds, termini, loadings, subjects


@query("job_projection", _SQL_PROJECTION)
def job_projection(spark, d):
    """Projected, written and read back."""
    clouds, termini, loadings, subjects = _projection_inputs(spark, d)
    path = scratch_path(spark, "projection")
    jobs.projection(clouds, termini, loadings, "healthy", "disease", subjects, path)
    return rounded(jobs.load_projection(spark, path)["terminus"].drop("z"))


@query("job_projection_centroid", _SQL_PROJECTION)
def job_projection_centroid(spark, d):
    """One cloud is only known by its centroid, a row of a wide file; the axis between the centroids is the same."""
    clouds, termini, loadings, subjects = _projection_inputs(spark, d)
    path = scratch_path(spark, "centroids")
    clouds.groupBy("cloud").pivot("feature_id").agg(F.avg("value")).write.parquet(path)
    single = tables.read_cloud(spark, "disease", centroid_path=path, group="disease").withColumn("feature_id", F.col("feature_id").cast("int"))
    both = clouds.filter("cloud = 'healthy'").withColumn("sample_id", F.col("sample_id").cast("string")).unionByName(single)
    out = jobs.projection(both, termini, loadings, "healthy", "disease", subjects, min_away=1)
    return rounded(out["terminus"].drop("z"))
