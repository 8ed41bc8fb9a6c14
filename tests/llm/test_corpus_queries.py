import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from dyadic.llm import decontaminate, linededup, queries, simhash

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_registered():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(r) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_cover_their_table(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    key, source = ("page_id", "pages") if name.startswith("op3") else ("doc_id", "documents")
    assert {r[key] for r in df.select(key).collect()} == {r[0] for r in duck.execute(f"SELECT {key} FROM {source}").fetchall()}


def test_pipeline_stage_by_stage(spark, duck, tmp_path):
    """Every stage against the plain form of its decision on its own input."""
    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        after = spark.read.parquet(str(tmp_path / str(n)))
        rows = {r.doc_id: r.asDict() for r in after.collect()}
        assert set(rows) <= set(before)
        sizes.append(len(rows))
        if name == "quality classifier":
            truth = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
            wrong = [d for d in truth if (d in rows) != (truth[d] == 1)]
            assert len(wrong) <= 0.1 * len(truth)
            assert all(rows[d] == before[d] for d in rows)
        if name == "line dedup":
            full = {r.doc_id: r for r in linededup.drop_repeated_lines(docs).collect()}
            assert set(before) - set(rows) == {d for d, r in full.items() if 0 < r.n_removed == r.n_lines}
            assert all(rows[d]["text"] == full[d].text and rows[d]["n_chars"] == len(full[d].text) for d in rows)
        if name == "simhash near-dedup":
            groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert set(rows) == set(groups.values())
        if name == "benchmark decontamination":
            leaks = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert leaks and set(rows) == set(before) - leaks
        if n < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        docs = after
    assert sizes[-1] == sizes[-2] and set(rows[min(rows)]) >= {"doc_id", "size", "target", "taken"}
    assert math.isclose(sum(r["taken"] for r in rows.values()), 1.5 * sum(r["size"] for r in rows.values()), rel_tol=0.01)
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]
