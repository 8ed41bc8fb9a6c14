import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [
    "interaction_regression", "paired_delta", "topk_variance", "bh_fdr", "mondrian_conformal", "interval_semi_join", "ulm_activity",
    "permanova", "pair_subjects", "residualise", "logit2", "job_fraction_gate",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if v is None or isinstance(v, str):
            return (0 if v is None else 2, v or "")
        return (1, float(v))

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("FULL_QUERIES") else QUICK)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want, got = canonical(cursor.fetchall(), names), canonical([tuple(r) for r in df.collect()], df.columns)
    assert len(want) == len(got)
    for a, b in zip(got, want):
        for (ka, va), (kb, vb) in zip(a, b):
            assert ka == kb and (va == vb if ka != 1 else math.isclose(va, vb, rel_tol=1e-6, abs_tol=2e-6)), (a, b)
