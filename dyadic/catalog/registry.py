"""Registry of queries and their SQL twins, and the small SQL fragments the twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col: Column | str, digits: int = 6) -> Column:
    """Round for comparison; + 0.0 turns -0.0 into 0.0."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def big(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double and widen every integer, keeping names."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(r6(name, digits).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(big(name).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def sr6(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def sql_t_tail(t: str, df: str) -> str:
    """Two-sided Student tail for whole degrees of freedom, by its finite trigonometric sums."""
    c2 = f"(CAST({df} AS DOUBLE) / ({df} + {t} * {t}))"
    theta = f"atan(abs({t}) / sqrt({df}))"
    even = (
        f"sin({theta}) * coalesce(list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), "
        f"lambda k: exp(lgamma(k + CAST(0.5 AS DOUBLE)) - lgamma(k + CAST(1 AS DOUBLE))) / sqrt(pi()) * pow({c2}, k))), 0)"
    )
    odd = (
        f"2 / pi() * ({theta} + sin({theta}) * cos({theta}) * coalesce(list_sum(list_transform("
        f"range(0, (CAST({df} AS BIGINT) - 1) // 2), "
        f"lambda k: exp(lgamma(k + CAST(1 AS DOUBLE)) - lgamma(k + CAST(1.5 AS DOUBLE))) * sqrt(pi()) / 2 * pow({c2}, k))), 0))"
    )
    return f"(CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END)"


def sql_bh(source: str, by: str, p: str = "p_val", q: str = "q_val", tie: str = "feature_id") -> str:
    """SELECT adding q-values to `source`; `by` is a comma list, possibly empty."""
    part = f"PARTITION BY {by}" if by else ""
    return (
        f"SELECT * EXCLUDE (_raw, _p), least(1.0::DOUBLE, min(_raw) OVER ({part} ORDER BY _p DESC, {tie} DESC "
        f"ROWS UNBOUNDED PRECEDING)) AS {q} FROM (SELECT *, _p * count(*) OVER ({part}) / "
        f"row_number() OVER ({part} ORDER BY _p, {tie}) AS _raw FROM (SELECT *, coalesce({p}, 1.0::DOUBLE) AS _p FROM {source}))"
    )


def sql_fit(features: str, design: str, columns: list[str], prefix: str, by: str = "feature_id", zero: bool = False,
            extra: str = "") -> str:
    """CTEs `<prefix>_fit(by, n, df, coef, se, t_stat)` for the LAST column of a complete design.

    Columns are orthogonalised one after the other; the last one's coefficient is
    its projection. `features` and `design` are CTE names.
    """
    steps, last = [], design
    for j, c in enumerate(columns):
        proj = "".join(f" - q{i} * (sum({c} * q{i}) OVER () / sum(q{i} * q{i}) OVER ())" for i in range(j))
        steps.append(f"{prefix}_g{j} AS (SELECT *, {c} - avg({c}) OVER (){proj} AS q{j} FROM {last})")
        last = f"{prefix}_g{j}"
    k = len(columns)
    sums = ", ".join(f"sum(q{j} * value) AS s{j}" for j in range(k))
    lens = ", ".join(f"sum(q{j} * q{j}) AS l{j}" for j in range(k))
    explained = " + ".join(f"s{j} * s{j} / l{j}" for j in range(k))
    n = "max(nn)" if zero else "count(*)"
    return ", ".join(steps) + f""",
{prefix}_len AS (SELECT count(*) AS nn, {lens} FROM {last}),
{prefix}_sum AS (SELECT {by}, {sums}, sum(value) AS sy, sum(value * value) AS syy, {n} AS n
  FROM {features} JOIN {last} USING (sample_id) CROSS JOIN {prefix}_len GROUP BY {by}),
{prefix}_rss AS (SELECT *, n - {k + 1} AS df, s{k - 1} / l{k - 1} AS coef,
  greatest(0.0::DOUBLE, syy - sy * sy / n - ({explained})) AS rss FROM {prefix}_sum CROSS JOIN {prefix}_len),
{prefix}_fit AS (SELECT {by}, n, df, coef, sqrt(rss / df / l{k - 1}) AS se, coef / sqrt(rss / df / l{k - 1}) AS t_stat FROM {prefix}_rss)"""


def sql_fit_own(features: str, design: str, columns: list[str], prefix: str, by: str = "feature_id") -> str:
    """As `sql_fit`, but every feature is fitted on the samples it has."""
    steps, last, part = [], f"{prefix}_rows", f"OVER (PARTITION BY {by})"
    for j, c in enumerate(columns):
        proj = "".join(f" - q{i} * (sum({c} * q{i}) {part} / nullif(sum(q{i} * q{i}) {part}, 0))" for i in range(j))
        steps.append(f"{prefix}_g{j} AS (SELECT *, {c} - avg({c}) {part}{proj} AS q{j} FROM {last})")
        last = f"{prefix}_g{j}"
    k = len(columns)
    sums = ", ".join(f"sum(q{j} * value) AS s{j}, nullif(sum(q{j} * q{j}), 0) AS l{j}" for j in range(k))
    explained = " + ".join(f"s{j} * s{j} / l{j}" for j in range(k))
    return f"""{prefix}_rows AS (SELECT * FROM {features} JOIN {design} USING (sample_id)), """ + ", ".join(steps) + f""",
{prefix}_rss AS (SELECT {by}, n, n - {k + 1} AS df, s{k - 1} / l{k - 1} AS coef, l{k - 1} AS len, greatest(0.0::DOUBLE, n * v - ({explained})) AS rss
  FROM (SELECT {by}, {sums}, count(*) AS n, var_pop(value) AS v FROM {last} GROUP BY {by})),
{prefix}_fit AS (SELECT {by}, n, df, coef, CASE WHEN df > 0 THEN sqrt(rss / df / len) END AS se, CASE WHEN df > 0 AND rss > 0 THEN coef / sqrt(rss / df / len) END AS t_stat FROM {prefix}_rss)"""


def sql_draw(seed: int, *parts: str) -> str:
    return "md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def sql_draw_integer(seed: int, *parts: str) -> str:
    return f"CAST('0x' || substr({sql_draw(seed, *parts)}, 1, 8) AS BIGINT)"
