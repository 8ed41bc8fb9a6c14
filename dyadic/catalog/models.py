"""Queries: regression, tests, enrichment and activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.catalog import recipes as R
from dyadic.catalog.registry import (
    big, query, r6, rounded, sql_bh, sql_draw, sql_draw_integer, sql_fit, sql_fit_own, sql_t_tail, sr6, table,
)
from dyadic.operators import activity, enrichment, regression, resample

CELL_TYPES = ["frac_a", "frac_b"]
BASE = f"f AS ({R.SQL_MATRIX}), d0 AS ({R.SQL_DESIGN}), d AS (SELECT *, response * frac_a AS inter_a, response * frac_b AS inter_b FROM d0)"
FIT_OUT = "CAST(n AS BIGINT) AS n, CAST(df AS BIGINT) AS df"


RAGGED_BASE = f"f AS ({R.SQL_RAGGED}), d AS ({R.SQL_DESIGN})"


def _fits(parts: list[tuple[str, list[str], str, str]], zero: bool) -> str:
    return ", ".join(sql_fit("f", "d", cols, name, zero=True) if zero else sql_fit_own("f", "d", cols, name) for name, cols, _, _ in parts)


def _interaction_sql(zero: bool) -> str:
    """Both terms of both cell types; a term is fitted as the last column of its own ordering."""
    parts = []
    for c in ("a", "b"):
        parts.append((f"i{c}", ["response", "age", f"frac_{c}", f"inter_{c}"], f"frac_{c}", "interaction"))
        parts.append((f"r{c}", ["age", f"frac_{c}", f"inter_{c}", "response"], f"frac_{c}", "response"))
    union = " UNION ALL ".join(
        f"SELECT feature_id, '{cell}' AS cell_type, '{term}' AS term, n, df, coef, se, t_stat FROM {name}_fit" for name, _, cell, term in parts)
    return f"""WITH {BASE}, {_fits(parts, zero)}, u0 AS ({union}),
u AS (SELECT feature_id, cell_type, term, n, CASE WHEN n >= 7 THEN df END AS df, CASE WHEN n >= 7 THEN coef END AS coef, CASE WHEN n >= 7 THEN se END AS se, CASE WHEN n >= 7 THEN t_stat END AS t_stat FROM u0),
 p AS (SELECT *, CASE WHEN t_stat IS NULL THEN NULL ELSE {sql_t_tail('t_stat', 'df')} END AS p_val FROM u)
SELECT feature_id, cell_type, term, CAST(n AS BIGINT) AS n, CAST(df AS DOUBLE) AS df, {sr6('coef')} AS coef, {sr6('se')} AS se, {sr6('t_stat')} AS t_stat,
 {sr6('p_val')} AS p_val, {sr6('q_val')} AS q_val FROM ({sql_bh('p', 'cell_type, term')})"""


def _result(df):
    return rounded(df.withColumn("df", F.col("df").cast("double")))


@query("interaction_regression", _interaction_sql(True))
def interaction_regression(spark, d):
    return _result(regression.interaction_regression(R.matrix(spark, d), R.design(spark, d), CELL_TYPES, ["age"], absent="zero"))


@query("interaction_regression_missing", _interaction_sql(False))
def interaction_regression_missing(spark, d):
    return _result(regression.interaction_regression(R.matrix(spark, d), R.design(spark, d), CELL_TYPES, ["age"]))


DENSE_DESIGN = """SELECT vec_id AS sample_id, CAST(label < 5 AS DOUBLE) AS response, CAST(vec_id * 7 % 13 AS DOUBLE) / 13 AS frac_a,
 CAST(vec_id * 5 % 11 AS DOUBLE) / 11 AS frac_b, CAST(vec_id % 17 AS DOUBLE) AS age FROM embeddings"""
DENSE_BASE = f"f AS ({R.SQL_DENSE}), d0 AS ({DENSE_DESIGN}), d AS (SELECT *, response * frac_a AS inter_a, response * frac_b AS inter_b FROM d0)"


def _dense_design(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"), (F.col("label") < 5).cast("double").alias("response"),
        (F.col("vec_id") * 7 % 13 / 13.0).alias("frac_a"), (F.col("vec_id") * 5 % 11 / 11.0).alias("frac_b"),
        (F.col("vec_id") % 17).cast("double").alias("age"))


def _dense_sql(parts: list[tuple[str, list[str], str]], label: str, by: str) -> str:
    union = " UNION ALL ".join(f"SELECT feature_id, '{tag}' AS {label}, n, df, coef, se, t_stat FROM {name}_fit" for name, _, tag in parts)
    fits = ", ".join(sql_fit("f", "d", cols, name) for name, cols, _ in parts)
    return f"""WITH {DENSE_BASE}, {fits}, u AS ({union}), p AS (SELECT *, {sql_t_tail('t_stat', 'df')} AS p_val FROM u)
SELECT feature_id, {label}, {FIT_OUT}, {sr6('coef')} AS coef, {sr6('se')} AS se, {sr6('t_stat')} AS t_stat, {sr6('p_val')} AS p_val, {sr6('q_val')} AS q_val
FROM ({sql_bh('p', by)})"""


@query("joint_interaction_regression", _dense_sql(
    [("ja", ["age", "frac_a", "frac_b", "inter_b", "inter_a"], "frac_a"), ("jb", ["age", "frac_a", "frac_b", "inter_a", "inter_b"], "frac_b")],
    "cell_type", "cell_type"))
def joint_interaction_regression(spark, d):
    out = regression.joint_interaction_regression(R.dense(spark, d), _dense_design(spark, d), CELL_TYPES, ["age"], absent="none")
    return rounded(out.select("feature_id", "cell_type", "n", "df", "coef", "se", "t_stat", "p_val", "q_val"))


# With two scaled columns the first component is their sum or, if they correlate negatively, their difference.
SQL_PC1 = f"""WITH f AS ({R.SQL_DENSE}), d0 AS ({DENSE_DESIGN}),
 s AS (SELECT *, (frac_a - avg(frac_a) OVER ()) / stddev_pop(frac_a) OVER () AS za, (frac_b - avg(frac_b) OVER ()) / stddev_pop(frac_b) OVER () AS zb, corr(frac_a, frac_b) OVER () AS r FROM d0),
 d AS (SELECT *, response * pc1 AS inter FROM (SELECT *, (CASE WHEN r >= 0 THEN za + zb ELSE za - zb END) / sqrt(2) AS pc1 FROM s)),
 {sql_fit('f', 'd', ['response', 'age', 'pc1', 'inter'], 'x')}, p AS (SELECT *, {sql_t_tail('t_stat', 'df')} AS p_val FROM x_fit)
SELECT feature_id, {FIT_OUT}, {sr6('abs(coef)')} AS size, {sr6('se')} AS se, {sr6('p_val')} AS p_val, {sr6('q_val')} AS q_val FROM ({sql_bh('p', '')})"""


@query("regression_pc1", SQL_PC1)
def regression_pc1(spark, d):
    out = regression.regression_pc1(R.dense(spark, d), _dense_design(spark, d), CELL_TYPES, ["age"], absent="none")
    # The sign of a component is a convention, so sizes are compared.
    return rounded(out.filter("term = 'interaction'").select("feature_id", "n", "df", F.abs("coef").alias("size"), "se", "p_val", "q_val"))


@query("simple_regression", f"""WITH {BASE}, {sql_fit('f', 'd', ['age', 'response'], 'x', zero=True)}, p AS (SELECT *, {sql_t_tail('t_stat', 'df')} AS p_val FROM x_fit)
SELECT feature_id, {FIT_OUT}, {sr6('coef')} AS coef, {sr6('se')} AS se, {sr6('t_stat')} AS t_stat, {sr6('p_val')} AS p_val, {sr6('q_val')} AS q_val FROM ({sql_bh('p', '')})""")
def simple_regression(spark, d):
    return rounded(regression.simple_regression(R.matrix(spark, d), R.design(spark, d), ["age"], absent="zero"))


SQL_REF = "ref AS (SELECT DISTINCT feature_id, sin(ascii(right(feature_id, 1)) + length(feature_id)) AS reference_coef FROM f)"


def _replication_sql() -> str:
    pieces = [sql_fit_own("f", "d", ["age", "response"], "o")]
    for therapy in ("CPT", "PE"):
        pieces += [f"d_{therapy} AS (SELECT * FROM d WHERE therapy = '{therapy}')", sql_fit_own("f", f"d_{therapy}", ["age", "response"], f"w{therapy}")]
    pieces += ["dm AS (SELECT *, CAST(therapy = 'CPT' AS DOUBLE) AS marked, response * CAST(therapy = 'CPT' AS DOUBLE) AS crossed FROM d)",
               sql_fit_own("f", "dm", ["response", "age", "marked", "crossed"], "x")]
    union = " UNION ALL ".join(
        f"SELECT '{part}' AS part, '{s}' AS stratum, feature_id, n, CASE WHEN n >= {k} THEN coef END AS coef, CASE WHEN n >= {k} THEN se END AS se FROM {name}_fit "
        + (f"WHERE (SELECT count(*) FROM d_{s}) >= 5" if part == "within" else "")
        for part, s, name, k in (("overall", "", "o", 5), ("within", "CPT", "wCPT", 5), ("within", "PE", "wPE", 5), ("interaction", "", "x", 7)))
    return f"""WITH {RAGGED_BASE}, {SQL_REF}, {', '.join(pieces)}, u AS ({union})
SELECT part, stratum, feature_id, CAST(n AS BIGINT) AS n, {sr6('coef')} AS coef, {sr6('se')} AS se,
 part <> 'interaction' AND coalesce(sign(coef) = sign(reference_coef), false) AS same_direction FROM u LEFT JOIN ref USING (feature_id)"""


@query("stratified_replication", _replication_sql())
def stratified_replication(spark, d):
    features = R.ragged(spark, d)
    ref = features.select("feature_id").distinct().withColumn(
        "reference_coef", F.sin(F.ascii(F.substring("feature_id", -1, 1)) + F.length("feature_id")))
    out = regression.stratified_replication(features, R.design(spark, d), ref, "therapy", "cpt", ["age"])
    empty = F.lit("").alias("stratum")
    same = F.col("same_direction")
    parts = [
        out["overall"].select(F.lit("overall").alias("part"), empty, "feature_id", "n", "coef", "se", same),
        out["within"].select(F.lit("within").alias("part"), F.col("therapy").alias("stratum"), "feature_id", "n", "coef", "se", same),
        out["interaction"].select(F.lit("interaction").alias("part"), empty, "feature_id", "n", "coef", "se", F.lit(False).alias("same_direction")),
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _dense_replication_sql() -> str:
    pieces = ["d AS (SELECT *, CASE WHEN sample_id % 3 = 0 THEN 'CPT' ELSE 'PE' END AS therapy FROM d0)",
              "ref AS (SELECT CAST(i AS BIGINT) AS feature_id, sin(i) AS reference_coef FROM range(0, 64) t(i))",
              sql_fit("f", "d", ["age", "response"], "o")]
    for therapy in ("CPT", "PE"):
        pieces += [f"d_{therapy} AS (SELECT * FROM d WHERE therapy = '{therapy}')", sql_fit("f", f"d_{therapy}", ["age", "response"], f"w{therapy}")]
    pieces += ["dm AS (SELECT *, CAST(therapy = 'CPT' AS DOUBLE) AS marked, response * CAST(therapy = 'CPT' AS DOUBLE) AS crossed FROM d)",
               sql_fit("f", "dm", ["response", "age", "marked", "crossed"], "x")]
    union = " UNION ALL ".join(
        f"SELECT '{part}' AS part, '{s}' AS stratum, feature_id, n, df, coef, se, t_stat FROM {name}_fit"
        for part, s, name in (("overall", "", "o"), ("within", "CPT", "wCPT"), ("within", "PE", "wPE"), ("interaction", "", "x")))
    return f"""WITH f AS ({R.SQL_DENSE}), d0 AS ({DENSE_DESIGN}), {', '.join(pieces)}, u AS ({union})
SELECT part, stratum, feature_id, CAST(n AS BIGINT) AS n, {sr6('coef')} AS coef, {sr6('se')} AS se, {sr6(sql_t_tail('t_stat', 'df'))} AS p_val,
 part <> 'interaction' AND sign(coef) = sign(reference_coef) AS same_direction FROM u JOIN ref USING (feature_id)"""


def _dense_replication(spark, d):
    samples = _dense_design(spark, d).withColumn("therapy", F.when(F.col("sample_id") % 3 == 0, " cpt").otherwise("PE"))
    features = R.dense(spark, d)
    ref = features.select("feature_id").distinct().withColumn("reference_coef", F.sin("feature_id"))
    return regression.stratified_replication(features, samples, ref, "therapy", "CPT", ["age"], absent="none")


@query("stratified_replication_complete", _dense_replication_sql())
def stratified_replication_complete(spark, d):
    out = _dense_replication(spark, d)
    parts = [out[name].select(
        F.lit(name).alias("part"), (F.col("therapy") if name == "within" else F.lit("")).alias("stratum"), "feature_id", "n", "coef", "se", "p_val",
        (F.lit(False) if name == "interaction" else F.col("same_direction")).alias("same_direction")) for name in out]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


SQL_RANKS = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / CAST(2 AS DOUBLE))"


@query("replication_summary", f"""
WITH a AS ({R.sql_results('a')}), b AS ({R.sql_results('b')}), j AS (SELECT a.feature_id, b.coef AS coef, a.coef AS reference_coef, b.p_val, sign(a.coef) = sign(b.coef) AS same FROM a JOIN b USING (feature_id)),
 k AS (SELECT *, {SQL_RANKS.format('coef')} AS x, {SQL_RANKS.format('reference_coef')} AS y FROM j)
SELECT count(p_val) AS n_tested, count(*) FILTER (same AND p_val < 0.1) AS n_replicated, round(count(*) FILTER (same AND p_val < 0.1) / CAST(count(p_val) AS DOUBLE) * 100, 2) AS pct_replicated,
 CASE WHEN count(*) FILTER (same AND p_val < 0.1) / CAST(count(p_val) AS DOUBLE) * 100 >= 40 THEN 'PASS' ELSE 'FAIL' END AS verdict, {sr6('corr(x, y)')} AS spearman_rho FROM k""")
def replication_summary(spark, d):
    ref = regression.mean_effect(R.results(spark, d, "a"))
    rows = R.results(spark, d, "b").join(ref, "feature_id").withColumn(
        "same_direction", F.signum("coef") == F.signum("reference_coef"))
    return rounded(regression.replication_summary(rows, 0.10))


@query("concordance_summary", f"""
WITH a AS ({R.sql_results('a')}), b AS ({R.sql_results('b')}),
 j AS (SELECT a.coef, b.coef AS oc, b.p_val AS op, b.q_val AS oq FROM a LEFT JOIN b ON a.feature_id = b.feature_id AND b.p_val < 0.9 WHERE a.q_val < 0.2),
 m AS (SELECT *, {SQL_RANKS.format('coef')} AS x, {SQL_RANKS.format('oc')} AS y FROM j WHERE oc IS NOT NULL),
 s AS (SELECT count(*) AS nm, avg(CASE WHEN sign(coef) = sign(oc) THEN 1.0::DOUBLE ELSE 0 END) AS sc, corr(x, y) AS rho,
  round(1 - least(1, count(*) FILTER (op > 0.5) / (count(op) * 0.5::DOUBLE)), 4) AS pi1, count(*) FILTER (oq < 0.05) AS f, count(*) FILTER (op < 0.05) AS p FROM m)
SELECT (SELECT count(*) FROM j) AS n_hits, nm AS n_matched, round(sc, 4) AS sign_concordance, round(rho, 4) + 0.0 AS spearman_rho, pi1, f AS n_sig_fdr, p AS n_sig_p,
 CASE WHEN sc >= 0.55 AND pi1 >= 0.3 AND rho >= 0.15 THEN 'REPLICATES' WHEN sc >= 0.5 AND pi1 >= 0.2 THEN 'MARGINAL' ELSE 'DOES_NOT_REPLICATE' END AS verdict FROM s""")
def concordance_summary(spark, d):
    from dyadic.operators import pairing

    hits = R.results(spark, d, "a").filter("q_val < 0.2")
    return rounded(regression.concordance_summary(pairing.hit_lookup(hits, R.results(spark, d, "b").filter("p_val < 0.9"))))


@query("residualise", f"""
WITH {DENSE_BASE}, b AS (SELECT feature_id, regr_slope(value, frac_a) AS s, regr_intercept(value, frac_a) AS i FROM f JOIN d USING (sample_id) GROUP BY 1)
SELECT sample_id, feature_id, {sr6('value - i - s * frac_a')} AS value FROM f JOIN d USING (sample_id) JOIN b USING (feature_id)""")
def residualise(spark, d):
    return rounded(regression.residualise(R.dense(spark, d), _dense_design(spark, d), ["frac_a"], absent="none"))


@query("residualise_missing", f"""
WITH {RAGGED_BASE}, b AS (SELECT feature_id, count(*) AS n, regr_slope(value, age) AS s, regr_intercept(value, age) AS i FROM f JOIN d USING (sample_id) GROUP BY 1)
SELECT sample_id, feature_id, {sr6('CASE WHEN n >= 4 THEN value - i - s * age END')} AS value FROM f JOIN d USING (sample_id) JOIN b USING (feature_id)""")
def residualise_missing(spark, d):
    return rounded(regression.residualise(R.ragged(spark, d), R.design(spark, d), ["age"]))


# --- tests -----------------------------------------------------------------------------------


def _labelled(spark, d):
    return R.dense(spark, d).join(R.points(spark, d).select(F.col("subject_id").alias("sample_id"), "label"), "sample_id")


SQL_LABELLED = f"x AS (SELECT f.*, label FROM ({R.SQL_DENSE}) f JOIN ({R.SQL_POINTS}) ON subject_id = sample_id)"


@query("cohens_d", f"""
WITH {SQL_LABELLED}, s AS (SELECT feature_id, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0, avg(value) FILTER (label = 1) AS m1, avg(value) FILTER (label = 0) AS m0,
 var_samp(value) FILTER (label = 1) AS v1, var_samp(value) FILTER (label = 0) AS v0, var_pop(value) FILTER (label = 1) AS p1, var_pop(value) FILTER (label = 0) AS p0 FROM x GROUP BY 1)
SELECT feature_id, {sr6('(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))')} AS d_signed, {sr6('abs(m1 - m0) / sqrt(((n1 - 1) * p1 + (n0 - 1) * p0) / (n1 + n0 - 2))')} AS d_pop FROM s""")
def cohens_d(spark, d):
    rows = _labelled(spark, d)
    signed = resample.cohens_d(rows, ["feature_id"], signed=True).select("feature_id", F.col("d").alias("d_signed"))
    pop = resample.cohens_d(rows, ["feature_id"], ddof=0).select("feature_id", F.col("d").alias("d_pop"))
    return rounded(signed.join(pop, "feature_id"))


@query("ttest", f"""
WITH {SQL_LABELLED}, s AS (SELECT feature_id, count(*) - 2 AS df, (avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0)) / sqrt(
 ((count(*) FILTER (label = 1)) * var_pop(value) FILTER (label = 1) + (count(*) FILTER (label = 0)) * var_pop(value) FILTER (label = 0)) / (count(*) - 2)
 * (1 / CAST(count(*) FILTER (label = 1) AS DOUBLE) + 1 / CAST(count(*) FILTER (label = 0) AS DOUBLE))) AS t FROM x GROUP BY 1)
SELECT feature_id, df, {sr6('t')} AS t_stat, {sr6(sql_t_tail('t', 'df'))} AS p_val FROM s""")
def ttest(spark, d):
    return rounded(resample.ttest(_labelled(spark, d), ["feature_id"]))


# In two dimensions the pooled covariance inverts by hand and F with (2, m) degrees has a closed tail.
@query("hotelling_t2", f"""
WITH v AS (SELECT l_returnflag = 'A' AS g, l_quantity AS x, l_discount AS y FROM lineitem),
 s AS (SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n0, avg(x) FILTER (g) - avg(x) FILTER (NOT g) AS dx, avg(y) FILTER (g) - avg(y) FILTER (NOT g) AS dy,
  (count(*) FILTER (g) * var_pop(x) FILTER (g) + count(*) FILTER (NOT g) * var_pop(x) FILTER (NOT g)) / (count(*) - 2) AS a,
  (count(*) FILTER (g) * covar_pop(x, y) FILTER (g) + count(*) FILTER (NOT g) * covar_pop(x, y) FILTER (NOT g)) / (count(*) - 2) AS b,
  (count(*) FILTER (g) * var_pop(y) FILTER (g) + count(*) FILTER (NOT g) * var_pop(y) FILTER (NOT g)) / (count(*) - 2) AS c, count(*) AS n FROM v),
 t AS (SELECT *, (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * c - b * b) * (n1 / CAST(n AS DOUBLE)) * n0 AS t2 FROM s)
SELECT {sr6('t2')} AS t2, {sr6('t2 * (n - 3) / (2 * CAST(n - 2 AS DOUBLE))')} AS f, CAST(2 AS DOUBLE) AS df1, CAST(n - 3 AS DOUBLE) AS df2,
 {sr6('pow(1 + 2 * (t2 * (n - 3) / (2 * CAST(n - 2 AS DOUBLE))) / (n - 3), -(n - 3) / CAST(2 AS DOUBLE))')} AS p_val FROM t""")
def hotelling_t2(spark, d):
    rows = table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "A").cast("int").alias("label"), F.array("l_quantity", "l_discount").alias("z"))
    return rounded(resample.hotelling_t2(rows))


def sql_keyed_place(x: str, n: str, seed: int, rep: str) -> str:
    """`keyed_place` of a place `x` in 0..n-1, `sa` and `sb` being columns with the sides of its grid."""
    hashed = lambda v: (f"list_reduce([({v}) % {resample.MODULUS}, {', '.join(map(str, resample.MULTIPLIERS))}], "  # noqa: E731
                        f"lambda h, m: xor((h * m + 12345) % {resample.MODULUS}, ((h * m + 12345) % {resample.MODULUS}) >> 15))")
    keys = ", ".join(f"{{'k0': {sql_draw_integer(seed, rep, str(i))} % {resample.MODULUS}, 'k1': {sql_draw_integer(seed, rep, str(i + 1))} % {resample.MODULUS}}}"
                     for i in range(0, resample.ROUNDS, 2))
    left = f"((p.x // sb + {hashed('p.x % sb + k.k0')}) % sa)"
    once = lambda v: (f"list_reduce(list_prepend({{'x': CAST({v} AS BIGINT), 'k0': CAST(0 AS BIGINT), 'k1': CAST(0 AS BIGINT)}}, "  # noqa: E731
                      f"list_transform([{keys}], lambda q: {{'x': CAST(0 AS BIGINT), 'k0': q.k0, 'k1': q.k1}})), "
                      f"lambda p, k: {{'x': {left} * sb + (p.x % sb + {hashed(left + ' + k.k1')}) % sb, 'k0': CAST(0 AS BIGINT), 'k1': CAST(0 AS BIGINT)}}).x")
    return f"list_reduce(list_prepend({once(x)}, range({resample.WALK})), lambda y, i: CASE WHEN y < {n} THEN y ELSE {once('y')} END)"


def sql_grid(subjects: str, reps: int, seed: int = 42) -> str:
    """CTE body (rep, subject_id, label) of `permutation_grid` over a CTE (subject_id, label)."""
    return f"""SELECT 0 AS rep, subject_id, label FROM {subjects} UNION ALL
 SELECT rep, subject_id, CASE WHEN {sql_keyed_place('place', 'nn', seed, 'rep')} < ones THEN 1 ELSE 0 END
 FROM (SELECT *, CAST(ceil(nn / CAST(sa AS DOUBLE)) AS BIGINT) AS sb FROM (SELECT subject_id, row_number() OVER (ORDER BY {sql_draw(seed, 'subject_id')}, subject_id) - 1 AS place,
  count(*) OVER () AS nn, sum(label) OVER () AS ones, CAST(greatest(1, floor(sqrt(count(*) OVER ()))) AS BIGINT) AS sa FROM {subjects})), (SELECT unnest(range(1, {reps + 1})) AS rep)"""


@query("subject_folds", f"""
WITH k AS (SELECT c_custkey AS subject_id, row_number() OVER (ORDER BY {sql_draw(7, 'c_custkey')}, c_custkey) AS pos, count(*) OVER () AS n FROM customer)
SELECT subject_id, CAST((pos - 1) % 5 AS BIGINT) AS fold, pos <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) AS calibration FROM k""")
def subject_folds(spark, d):
    subjects = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"))
    folds = resample.subject_folds(subjects, 5, 7)
    return rounded(folds.join(resample.calibration_split(subjects, 0.2, 7), "subject_id"))


@query("resample_grid", f"""
WITH s AS (SELECT subject_id, label FROM ({R.SQL_POINTS})), g AS ({sql_grid('s', 40)}),
 n AS (SELECT subject_id, row_number() OVER (ORDER BY {sql_draw(42, 'subject_id')}, subject_id) AS pos, count(*) OVER () AS n FROM s),
 b AS (SELECT rep, 1 + {sql_draw_integer(42, 'rep', 'pos')} % n AS pick FROM n, (SELECT unnest(range(1, 41)) AS rep)),
 c AS (SELECT rep, subject_id, count(*) AS copies FROM b JOIN n ON pos = pick GROUP BY ALL)
SELECT CAST(g.rep AS BIGINT) AS rep, g.subject_id, CAST(g.label AS BIGINT) AS label, coalesce(copies, 0) AS copies FROM g LEFT JOIN c ON g.rep = c.rep AND g.subject_id = c.subject_id""")
def resample_grid(spark, d):
    subjects = R.points(spark, d).select("subject_id", "label")
    grid = resample.permutation_grid(subjects, 40)
    copies = resample.bootstrap_counts(subjects.select("subject_id"), 40)
    return rounded(grid.join(copies, ["rep", "subject_id"], "left").na.fill(0, subset=["copies"]))


@query("permanova", f"""
WITH {SQL_LABELLED}, s AS (SELECT subject_id, label FROM ({R.SQL_POINTS})), g AS ({sql_grid('s', 99)}),
 c AS (SELECT sample_id AS subject_id, feature_id, value - avg(value) OVER (PARTITION BY feature_id) AS v FROM x),
 t AS (SELECT sum(v * v) AS sst FROM c), m AS (SELECT rep, label, feature_id, sum(v) AS s, count(*) AS k FROM g JOIN c USING (subject_id) GROUP BY ALL),
 b AS (SELECT rep, sum(s * s / k) AS ssb, max(n) AS n FROM m, (SELECT count(*) AS n FROM s) GROUP BY rep),
 f AS (SELECT rep, ssb / ((sst - ssb) / (n - 2)) AS f FROM b, t)
SELECT {sr6('max(f) FILTER (rep = 0)')} AS f_statistic, {sr6('count(*) FILTER (rep > 0 AND f >= (SELECT f FROM f WHERE rep = 0)) / CAST(99 AS DOUBLE)')} AS p_value, count(*) FILTER (rep > 0) AS n_permutations FROM f""")
def permanova(spark, d):
    return rounded(resample.permanova(R.points(spark, d), 99))


@query("centroid_permutation", f"""
WITH {SQL_LABELLED}, s AS (SELECT subject_id, label FROM ({R.SQL_POINTS})), g AS ({sql_grid('s', 60)}),
 c AS (SELECT sample_id AS subject_id, feature_id, value - cos(feature_id) / 10 AS v FROM x),
 m AS (SELECT rep, label, feature_id, avg(v) AS m FROM g JOIN c USING (subject_id) GROUP BY ALL), e AS (SELECT rep, label, sqrt(sum(m * m)) AS e FROM m GROUP BY ALL),
 k AS (SELECT rep, max(e) FILTER (label = 0) AS d0, max(e) FILTER (label = 1) AS d1 FROM e GROUP BY rep), o AS (SELECT * FROM k WHERE rep = 0)
SELECT {sr6('max(o.d0)')} AS d_zero, {sr6('max(o.d1)')} AS d_one, {sr6('max(o.d0 - o.d1)')} AS gap, {sr6('count(*) FILTER (k.d0 - k.d1 <= o.d0 - o.d1) / CAST(60 AS DOUBLE)')} AS p_value,
 count(*) AS n_permutations, max(o.d0 - o.d1) < 0 AS direction_ok FROM k, o WHERE k.rep > 0""")
def centroid_permutation(spark, d):
    features = R.dense(spark, d)
    subjects = R.points(spark, d).select(F.col("subject_id").alias("sample_id"), "label")
    anchor = features.select("feature_id").distinct().withColumn("value", F.cos("feature_id") / 10)
    return rounded(resample.centroid_permutation(features, subjects, anchor, 60))


@query("proximity_test", f"""
WITH {SQL_LABELLED}, r AS (SELECT CAST(unnest(range(0, len(embedding))) AS BIGINT) AS feature_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE label = 9),
 c AS (SELECT feature_id, avg(v) AS c FROM r GROUP BY 1), s AS (SELECT sample_id AS subject_id, label, sqrt(sum((value - c) * (value - c))) AS v FROM x JOIN c USING (feature_id) GROUP BY ALL),
 g AS ({sql_grid('s', 99, 43)}), p AS (SELECT rep, avg(v) FILTER (g.label = 1) - avg(v) FILTER (g.label = 0) AS gap FROM g JOIN s USING (subject_id) GROUP BY rep),
 n AS (SELECT subject_id, label, v, row_number() OVER (PARTITION BY label ORDER BY {sql_draw(42, 'subject_id')}, subject_id) AS pos, count(*) OVER (PARTITION BY label) AS n FROM s),
 b AS (SELECT rep, label, 1 + {sql_draw_integer(42, 'rep', 'pos')} % n AS pick FROM n, (SELECT unnest(range(1, 100)) AS rep)),
 y AS (SELECT rep, b.label, v FROM b JOIN n ON b.label = n.label AND pos = pick),
 z AS (SELECT rep, avg(v) FILTER (label = 1) - avg(v) FILTER (label = 0) AS e, sqrt((count(*) FILTER (label = 1) * var_pop(v) FILTER (label = 1) + count(*) FILTER (label = 0) * var_pop(v) FILTER (label = 0)) / (count(*) - 2)) AS sd FROM y GROUP BY rep),
 o AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0, avg(v) FILTER (label = 1) AS m1, avg(v) FILTER (label = 0) AS m0,
  sqrt((count(*) FILTER (label = 1) * var_pop(v) FILTER (label = 1) + count(*) FILTER (label = 0) * var_pop(v) FILTER (label = 0)) / (count(*) - 2)) AS sd FROM s)
SELECT n1 AS n_label1, n0 AS n_label0, {sr6('m1')} AS mean_label1, {sr6('m0')} AS mean_label0, {sr6('m1 - m0')} AS effect, {sr6('(m1 - m0) / sd')} AS cohens_d,
 {sr6('(SELECT quantile_cont(e, 0.025) FROM z)')} AS effect_low, {sr6('(SELECT quantile_cont(e, 0.975) FROM z)')} AS effect_high,
 {sr6('(SELECT quantile_cont(e / sd, 0.025) FROM z)')} AS d_low, {sr6('(SELECT quantile_cont(e / sd, 0.975) FROM z)')} AS d_high,
 {sr6('((SELECT count(*) FROM p WHERE rep > 0 AND gap >= (SELECT gap FROM p WHERE rep = 0)) + 1) / CAST(100 AS DOUBLE)')} AS p_value FROM o""")
def proximity_test(spark, d):
    rows = R.points(spark, d)
    return rounded(resample.proximity_test(rows, rows.filter(F.col("class") == 9), 99, 99))


# --- enrichment and activity ------------------------------------------------------------------


def sql_hyper(k: str, total: str, marked: str, drawn: str) -> str:
    """P(X >= k) from log-gamma terms."""
    ch = lambda n, r: f"(lgamma({n} + 1::DOUBLE) - lgamma({r} + 1::DOUBLE) - lgamma({n} - {r} + 1::DOUBLE))"
    term = f"exp({ch(marked, 'j')} + {ch(f'({total} - {marked})', f'({drawn} - j)')} - {ch(total, drawn)})"
    return (f"least(1.0::DOUBLE, coalesce(list_sum(list_transform(range(greatest({k}, {drawn} - ({total} - {marked}), 0), least({marked}, {drawn}) + 1), "
            f"lambda j: {term})), 0.0::DOUBLE))")


SQL_ENRICH = f"""
WITH q AS ({R.SQL_SPOTS}), t AS ({R.SQL_REGIONS}), r AS (SELECT event_id AS feature_id, user_id % 4 AS cell_type, {R.sql_hashed_p("'sig'", 'event_id')} AS q_val FROM events),
 m AS (SELECT DISTINCT feature_id, set_name FROM q JOIN t ON q.chrom = t.chrom AND t.start < q."end" AND t."end" > q.start),
 h AS (SELECT cell_type, feature_id FROM r WHERE q_val < 0.3), s AS (SELECT cell_type, count(*) AS n_sig FROM h GROUP BY 1), k AS (SELECT set_name, count(feature_id) AS n_feature FROM (SELECT DISTINCT set_name FROM t) LEFT JOIN m USING (set_name) GROUP BY 1),
 o AS (SELECT cell_type, set_name, count(*) AS observed FROM h JOIN m USING (feature_id) GROUP BY ALL),
 j AS (SELECT s.cell_type, k.set_name, n_sig, (SELECT count(*) FROM q) AS n_background, n_feature, coalesce(observed, 0) AS observed FROM s CROSS JOIN k LEFT JOIN o ON o.cell_type = s.cell_type AND o.set_name = k.set_name),
 p AS (SELECT *, n_sig * (n_feature / CAST(n_background AS DOUBLE)) AS expected, CASE WHEN n_feature > 0 THEN {sql_hyper('observed', 'n_background', 'n_feature', 'n_sig')} END AS p_val FROM j)
SELECT cell_type, set_name, n_sig, n_background, n_feature, observed, {sr6('expected')} AS expected, {sr6('observed / nullif(expected, 0)')} AS enrichment, {sr6('p_val')} AS p_val, {sr6('q_val')} AS q_val
FROM ({sql_bh('p', '', tie='set_name')})"""


@query("hypergeom_enrichment", SQL_ENRICH)
def hypergeom_enrichment(spark, d):
    results = table(spark, d, "events").select(
        F.col("event_id").alias("feature_id"), (F.col("user_id") % 4).alias("cell_type"), R.hashed_p(F.lit("sig"), F.col("event_id")).alias("q_val"))
    sites = R.spots(spark, d)
    return rounded(enrichment.regulatory_enrichment(results, sites, sites, R.regions(spark, d), fdr=0.3))


@query("ora", f"""
WITH l AS (SELECT DISTINCT l_suppkey % 7 AS cell_type, l_partkey AS gene_id FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.05),
 g AS (SELECT 'type' AS library, p_type AS term, p_partkey AS gene_id FROM part UNION ALL SELECT 'brand', p_brand, p_partkey FROM part),
 s AS (SELECT library, cell_type, count(*) AS n_sig FROM l, (SELECT unnest(['type', 'brand']) AS library) GROUP BY ALL),
 t AS (SELECT library, term, count(*) AS n_feature FROM g GROUP BY ALL), o AS (SELECT cell_type, library, term, count(*) AS observed FROM l JOIN g USING (gene_id) GROUP BY ALL),
 j AS (SELECT o.*, n_sig, n_feature, (SELECT count(*) FROM part) AS n_background FROM o JOIN s USING (library, cell_type) JOIN t USING (library, term)),
 p AS (SELECT *, {sql_hyper('observed', 'n_background', 'n_feature', 'n_sig')} AS p_val FROM j WHERE n_sig >= 5)
SELECT library, cell_type, term, observed, n_sig, n_feature, n_background, {sr6('p_val')} AS p_val, {sr6('q_val')} AS q_val FROM ({sql_bh('p', 'cell_type, library', tie='term')})""")
def ora(spark, d):
    lists = table(spark, d, "lineitem").filter("l_quantity >= 50 AND l_discount >= 0.05").select(
        (F.col("l_suppkey") % 7).alias("cell_type"), F.col("l_partkey").alias("gene_id"))
    p = table(spark, d, "part")
    sets = p.select(F.lit("type").alias("library"), F.col("p_type").alias("term"), F.col("p_partkey").alias("gene_id")).unionByName(
        p.select(F.lit("brand").alias("library"), F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene_id")))
    out = enrichment.over_representation(lists, sets)
    return rounded(out.select("library", "cell_type", "term", "observed", "n_sig", "n_feature", "n_background", "p_val", "q_val"))


SQL_ULM = f"""WITH f AS ({R.SQL_MATRIX}), w AS ({R.SQL_NETWORK}), g AS (SELECT * FROM w WHERE target IN (SELECT feature_id FROM f)), nn AS (SELECT CAST(count(DISTINCT feature_id) AS DOUBLE) AS n FROM f),
 s AS (SELECT sample_id, sum(value) AS x, sum(value * value) AS xx FROM f GROUP BY 1), v AS (SELECT source, sum(weight) AS w, sum(weight * weight) AS ww FROM g GROUP BY 1),
 c AS (SELECT sample_id, source, sum(value * weight) AS xw FROM f JOIN g ON target = feature_id GROUP BY ALL),
 r AS (SELECT s.sample_id, v.source, n, (coalesce(xw, 0) - x * w / n) / sqrt((xx - x * x / n) * (ww - w * w / n)) AS r FROM s CROSS JOIN v CROSS JOIN nn LEFT JOIN c ON c.sample_id = s.sample_id AND c.source = v.source)
SELECT sample_id, source, r * sqrt((n - 2) / (1 - r * r)) AS score FROM r"""


@query("ulm_activity", f"SELECT sample_id, source, {sr6('score')} AS score FROM ({SQL_ULM})")
def ulm_activity(spark, d):
    return rounded(activity.ulm_activity(R.matrix(spark, d), R.network(spark, d)))


SQL_SETS = f"""WITH f AS ({R.SQL_MATRIX}), k AS (SELECT *, rank() OVER (PARTITION BY sample_id ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, value) - 1) / CAST(2 AS DOUBLE) AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM f),
 g AS (SELECT p_type AS source, p_partkey AS feature_id FROM part WHERE p_partkey IN (SELECT feature_id FROM f)),
 i AS (SELECT sample_id, source, max(n) AS n, count(*) AS m, sum(pow(r, 0.25) * r) AS wr, sum(pow(r, 0.25)) AS w, sum(r) AS rs FROM k JOIN g USING (feature_id) GROUP BY ALL),
 e AS (SELECT * FROM (SELECT DISTINCT sample_id FROM f), (SELECT DISTINCT source FROM g))
SELECT e.sample_id, e.source, wr / w - (n * (n + 1) / CAST(2 AS DOUBLE) - rs) / (n - m) AS score FROM e LEFT JOIN i ON e.sample_id = i.sample_id AND e.source = i.source"""


@query("ssgsea", f"SELECT sample_id, source, {sr6('score')} AS score FROM ({SQL_SETS})")
def ssgsea(spark, d):
    sets = R.network(spark, d).select("source", "target")
    return rounded(activity.ssgsea(R.matrix(spark, d), sets))


@query("deconvolve", f"""
WITH b AS (SELECT l_suppkey AS sample_id, l_partkey AS feature_id, avg(l_discount) * 10 AS y FROM lineitem GROUP BY ALL),
 r AS (SELECT p_partkey AS feature_id, p_size / CAST(50 AS DOUBLE) AS a, CAST(p_partkey * 13 % 97 AS DOUBLE) / 97 AS c FROM part),
 m AS (SELECT sample_id, sum(a * a) AS aa, sum(a * c) AS ac, sum(c * c) AS cc, sum(a * y) AS ay, sum(c * y) AS cy FROM b JOIN r USING (feature_id) GROUP BY 1),
 u AS (SELECT *, (cc * ay - ac * cy) / (aa * cc - ac * ac) AS x, (aa * cy - ac * ay) / (aa * cc - ac * ac) AS z FROM m),
 w AS (SELECT sample_id, CASE WHEN x >= 0 AND z >= 0 THEN x WHEN x < 0 THEN 0 ELSE ay / aa END AS x, CASE WHEN x >= 0 AND z >= 0 THEN z WHEN x < 0 THEN cy / cc ELSE 0 END AS z FROM u)
SELECT sample_id, {sr6('x / (x + z)')} AS first, {sr6('z / (x + z)')} AS second FROM w""")
def deconvolve(spark, d):
    betas = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("feature_id")).agg(
        (F.avg("l_discount") * 10).alias("value"))
    panel = table(spark, d, "part").select(
        F.col("p_partkey").alias("feature_id"), (F.col("p_size") / 50.0).alias("first"), (F.col("p_partkey") * 13 % 97 / 97.0).alias("second"))
    return rounded(activity.deconvolve(betas, panel, ["first", "second"]))


def sql_robust(rounds: int) -> str:
    """CTEs from `d(sample_id, y, a, c)` to `c<rounds>(sample_id, b0, b1, b2)`: M-estimates of a line in two columns."""
    steps, rows = [], "(SELECT *, CAST(1 AS DOUBLE) AS w FROM d)"
    for i in range(rounds + 1):
        steps.append(f"""m{i} AS (SELECT sample_id, sum(w * a) / sum(w) AS ma, sum(w * c) / sum(w) AS mc, sum(w * y) / sum(w) AS my, sum(w * a * a) / sum(w) - ma * ma AS aa,
  sum(w * a * c) / sum(w) - ma * mc AS ac, sum(w * c * c) / sum(w) - mc * mc AS cc, sum(w * a * y) / sum(w) - ma * my AS ay, sum(w * c * y) / sum(w) - mc * my AS cy FROM {rows} GROUP BY 1),
 c{i} AS (SELECT sample_id, (cc * ay - ac * cy) / (aa * cc - ac * ac) AS b1, (aa * cy - ac * ay) / (aa * cc - ac * ac) AS b2, my - b1 * ma - b2 * mc AS b0 FROM m{i}),
 r{i} AS (SELECT d.*, abs(y - b0 - b1 * a - b2 * c) AS r FROM d JOIN c{i} USING (sample_id)),
 w{i} AS (SELECT *, least(1.0::DOUBLE, 1.345 * median(r) OVER (PARTITION BY sample_id) / 0.6745 / nullif(r, 0)) AS w FROM r{i})""")
        rows = f"w{i}"
    return ", ".join(steps)


@query("deconvolve_robust", f"""
WITH b AS (SELECT l_suppkey AS sample_id, l_partkey AS feature_id, avg(l_discount) * 10 AS y FROM lineitem GROUP BY ALL),
 p AS (SELECT p_partkey AS feature_id, p_size / CAST(50 AS DOUBLE) AS a, CAST(p_partkey * 13 % 97 AS DOUBLE) / 97 AS c FROM part),
 d AS (SELECT sample_id, y + a / 2 + c / 4 AS y, a, c FROM b JOIN p USING (feature_id)), {sql_robust(3)}
SELECT sample_id, {sr6('greatest(b1, 0) / nullif(greatest(b1, 0) + greatest(b2, 0), 0)')} AS first, {sr6('greatest(b2, 0) / nullif(greatest(b1, 0) + greatest(b2, 0), 0)')} AS second FROM c3""")
def deconvolve_robust(spark, d):
    """Three rounds, so that SQL can follow them; the values follow the panel in part."""
    panel = table(spark, d, "part").select(
        F.col("p_partkey").alias("feature_id"), (F.col("p_size") / 50.0).alias("first"), (F.col("p_partkey") * 13 % 97 / 97.0).alias("second"))
    betas = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("feature_id")).agg(
        (F.avg("l_discount") * 10).alias("value"))
    betas = betas.join(panel, "feature_id").select(
        "sample_id", "feature_id", (F.col("value") + F.col("first") / 2 + F.col("second") / 4).alias("value"))
    return rounded(activity.deconvolve_robust(betas, panel, ["first", "second"], rounds=3, tolerance=0.0, check=False))


# The normal distribution function by its series of positive terms.
SQL_NORMAL = """CASE WHEN abs(t) > 8 THEN (t > 0)::DOUBLE WHEN t = 0 THEN 0.5 ELSE 0.5 + sign(t) * exp(-t * t / 2) / sqrt(2 * pi()) * list_sum(list_transform(
  range(0, 120), lambda i: exp((2 * i + 1) * ln(abs(t)) - lgamma(i + CAST(1.5 AS DOUBLE)) - (i + 1) * ln(CAST(2 AS DOUBLE)) + ln(pi()) / 2))) END"""


@query("set_variation", f"""
WITH x AS (SELECT l_suppkey AS sample_id, p_brand AS feature_id, avg(l_extendedprice) / 1000 AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
 h AS (SELECT feature_id, stddev_samp(v) / 4 AS h FROM x GROUP BY 1),
 k AS (SELECT a.sample_id, a.feature_id, (a.v - b.v) / h AS t FROM x a JOIN x b USING (feature_id) JOIN h USING (feature_id)),
 l AS (SELECT sample_id, feature_id, round(avg({SQL_NORMAL}), 12) AS level FROM k GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY level DESC, feature_id) AS place, count(*) OVER (PARTITION BY sample_id) AS p FROM l),
 g AS (SELECT sample_id, source, place, p, left(feature_id, 7) = source AS hit, abs(p / CAST(2 AS DOUBLE) - place + 1) AS step FROM o, (SELECT DISTINCT left(p_brand, 7) AS source FROM part)),
 u AS (SELECT *, sum(step) FILTER (hit) OVER (PARTITION BY sample_id, source) AS whole, count(*) FILTER (hit) OVER (PARTITION BY sample_id, source) AS m FROM g),
 w AS (SELECT sample_id, source, whole, m, p, sum(CASE WHEN hit THEN step / whole ELSE CAST(-1 AS DOUBLE) / (p - m) END) OVER (PARTITION BY sample_id, source ORDER BY place) AS walk FROM u)
SELECT sample_id, source, {sr6('CASE WHEN max(m) > 0 THEN greatest(0, max(walk)) + least(0, min(walk)) END')} AS score FROM w GROUP BY ALL""")
def set_variation(spark, d):
    features = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_suppkey").alias("sample_id"), F.col("p_brand").alias("feature_id")).agg((F.avg("l_extendedprice") / 1000).alias("value"))
    sets = table(spark, d, "part").select(F.substring("p_brand", 1, 7).alias("source"), F.col("p_brand").alias("target")).distinct()
    return rounded(activity.set_variation(features, sets, 1))


@query("fraction_checks", f"""
WITH f AS (SELECT l_suppkey AS sample_id, avg(l_discount) * 5 AS a, avg(l_tax) * 10 AS b, CAST(0.5 AS DOUBLE) AS c FROM lineitem GROUP BY 1)
SELECT count(*) AS n, {sr6('min(a + b + c)')} AS min_sum, {sr6('max(a + b + c)')} AS max_sum, count(*) FILTER (abs(a + b + c - 1) > 0.16) AS n_off, 'c' AS near_constant FROM f""")
def fraction_checks(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id")).agg(
        (F.avg("l_discount") * 5).alias("a"), (F.avg("l_tax") * 10).alias("b"), F.lit(0.5).alias("c"))
    out = activity.fraction_checks(rows, ["a", "b", "c"], 0.16)
    return rounded(out.withColumn("near_constant", F.concat_ws(",", "near_constant")))
