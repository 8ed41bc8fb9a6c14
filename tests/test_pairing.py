import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadic.functions import columns as C
from dyadic.operators import pairing as P
from dyadic.sources import tables

VISITS = [
    ("a", "PRE", 1, "R"), ("a", "POST", 2, "R"), ("b", "PRE", 3, "NR"), ("b", "POST", 4, "NR"), ("b", "POST", 5, "NR"),
    ("c", "PRE", 6, "R"), ("d", "POST", 7, "R"),
]


@pytest.fixture
def samples(spark):
    return spark.createDataFrame(VISITS, "subject_id string, visit string, sample_id int, response string")


def test_pairing_rules(samples):
    got = {r: {x.subject_id: (x.pre_id, x.post_id) for x in P.pair_subjects(samples, r).collect()} for r in ("any", "last", "exactly_one")}
    assert got["any"] == {"a": (1, 2), "b": (3, 4)}
    assert got["last"] == {"a": (1, 2), "b": (3, 5)}
    assert got["exactly_one"] == {"a": (1, 2)}


def test_names_to_pairs(spark):
    names = spark.createDataFrame([("x-1-BL", "R"), ("x-1-12W", "R"), ("y-BL", "R"), ("zBL", "R")], "sample_id string, response string")
    assert [r.subject_id for r in P.pair_subjects(P.subjects_from_names(names), "last").collect()] == ["x-1"]


def test_delta_is_joined_by_id_not_by_position(spark, samples):
    features = spark.createDataFrame([(i, "g", float(i * i)) for i in range(1, 8)], "sample_id int, feature_id string, value double")
    pairs = P.pair_subjects(samples)
    want = {"a": 3.0, "b": 7.0}
    for shuffled in (features, features.orderBy(F.rand(1)).repartition(3)):
        got = {r.subject_id: r.delta for r in P.paired_delta_by_id(shuffled, pairs.orderBy(F.rand(2))).collect()}
        assert got == want


def test_delta_drops_incomplete_cells(spark):
    obs = spark.createDataFrame([("a", "PRE", "g", 1.0), ("a", "POST", "g", None), ("b", "PRE", "g", 2.0), ("b", "POST", "g", 5.0)],
                                "subject_id string, visit string, feature_id string, value double")
    assert [(r.subject_id, r.delta) for r in P.paired_delta(obs).collect()] == [("b", 3.0)]


def test_visit_and_response_spellings(spark):
    df = spark.createDataFrame([(" pre-iop ",), ("Week12",), ("bl",)], "v string")
    assert [r[0] for r in df.select(C.normalise_visit(F.col("v"))).collect()] == ["PRE", "POST", "PRE"]
    with pytest.raises(Exception, match="unrecognised visit"):
        spark.createDataFrame([("later",)], "v string").select(C.normalise_visit(F.col("v"))).collect()
    coded = spark.createDataFrame([("Responder",), ("0",), ("partial",), (None,)], "r string").select(C.encode_response(F.col("r")))
    assert [r[0] for r in coded.collect()] == [1, 0, None, None]


def test_scalar_delta(spark):
    rows = [("a", "PRE", 1, "R", "10"), ("a", "POST", 2, "R", "4"), ("b", "PRE", 3, "NR", "x"), ("b", "POST", 4, "NR", "4")]
    df = spark.createDataFrame(rows, "subject_id string, visit string, sample_id int, response string, pcl string")
    assert {r.subject_id: (r.delta, r.response) for r in P.scalar_delta(df, "pcl").collect()} == {"a": (-6.0, "R"), "b": (None, "NR")}


def test_cross_contrast(spark):
    def t(rows):
        return spark.createDataFrame([(f, "c", q) for f, q in rows], "feature_id string, cell_type string, q_val double")

    got = P.cross_contrast_class(t([("1", 0.01), ("3", 0.01)]), t([("4", None)]), t([("1", 0.01), ("2", 0.01), ("3", 0.9), ("4", 0.9)]))
    assert {r.feature_id: r.cross_contrast_class for r in got.collect()} == {
        "1": "baseline_and_recovery", "2": "state_of_recovery", "3": "trait_stable", "4": "other"}


def test_alignment_error_names_first_samples(spark):
    features = spark.createDataFrame([(f"s{i}",) for i in range(9)], "sample_id string")
    with pytest.raises(ValueError, match="s3"):
        P.require_alignment(features, spark.createDataFrame([("s0",), ("s1",), ("s2",)], "sample_id string"))


def test_crosswalk_keeps_first_duplicate(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "k string")
    mapping = spark.createDataFrame([("a", "late", 2), ("a", "early", 1)], "k string, t string, at int")
    assert {r.k: r.t for r in P.crosswalk(ids, mapping, "k", "t", F.col("at"), "left").collect()} == {"a": "early", "b": None}


def test_strip_id_prefix(spark):
    ids = spark.createDataFrame([("ENSG1.2_X", 0), ("X", 1), ("ENSG3_Y_Z", 2), ("A_B", 3), ("ENSG9_X", 4)], "feature_id string, position int")
    assert [r.symbol for r in P.strip_id_prefix(ids).orderBy("position").collect()] == ["X", "X_1", "Y_Z", "A_B", "X_2"]


def test_stack_views_keeps_shared_subjects(spark):
    a = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "subject_id string, value double")
    b = spark.createDataFrame([("s2", 3.0), ("s3", 4.0)], "subject_id string, value double")
    assert sorted((r.modality, r.subject_id) for r in P.stack_views({"a": a, "b": b}).collect()) == [("a", "s2"), ("b", "s2")]


def test_activity_join_without_a_match_raises(spark):
    a = spark.createDataFrame([("s", "PRE", 1.0)], "subject_id string, visit string, value double")
    with pytest.raises(ValueError):
        P.activity_feature_join(a, spark.createDataFrame([("t", "PRE")], "subject_id string, visit string"))


def test_matrix_files_round_trip(spark, tmp_path):
    wide = pd.DataFrame({"cpg": ["c1", "c2"], "s1": [0.1, float("nan")], "s.2": [0.3, 0.4]})
    wide.to_parquet(tmp_path / "m.parquet")
    wide.to_csv(tmp_path / "m.csv", index=False)
    wide.to_csv(tmp_path / "m.txt", index=False, sep="\t")
    for name in ("m.parquet", "m.csv", "m.txt"):
        got = {(r.feature_id, r.sample_id): r.value for r in tables.read_matrix_long(spark, str(tmp_path / name)).collect()}
        assert got == {("c1", "s1"): 0.1, ("c1", "s.2"): 0.3, ("c2", "s1"): None, ("c2", "s.2"): 0.4}
    flipped = tables.read_matrix_long(spark, str(tmp_path / "m.csv"), orientation="samples").filter("feature_id = 's1'")
    assert {r.sample_id for r in flipped.collect()} == {"c1", "c2"}


def test_guarded_read_fails_closed(spark, tmp_path):
    path = str(tmp_path / "features")
    tables.write_table(spark.createDataFrame([("g", 1.0)], "feature_id string, value double"), path)
    with pytest.raises(PermissionError, match="no provenance"):
        tables.guarded_read(spark, path)
    tables.stamp_provenance(spark, path, False, "candidates")
    with pytest.raises(PermissionError, match="cv_loop_safe"):
        tables.guarded_read(spark, path)
    assert tables.read_candidates(spark, path).count() == 1
    tables.stamp_provenance(spark, path, True, "training folds")
    assert tables.guarded_read(spark, path).count() == 1
    assert tables.read_optional(spark, str(tmp_path / "nothing")) is None


def test_finite_and_balance_guards(spark):
    good = spark.createDataFrame([("s", "g", 1.0)], "sample_id string, feature_id string, value double")
    assert tables.assert_finite(good) is good
    bad = good.unionByName(spark.createDataFrame([("t", "h", float("inf"))], good.schema))
    with pytest.raises(ValueError, match="1 non-finite.*sample t, feature h"):
        tables.assert_finite(bad)
    with pytest.raises(ValueError, match="no rows"):
        tables.assert_finite(good.filter("false"))
    flags = spark.createDataFrame([(i == 0,) for i in range(30)], "f boolean")
    with pytest.raises(ValueError, match="share"):
        tables.assert_label_balance(flags, F.col("f"))


def test_sample_table_needs_its_columns(spark):
    with pytest.raises(ValueError, match="Visit"):
        tables.canonical_samples(spark.createDataFrame([("a",)], "Subcode string"))


def test_stamp_belongs_to_its_table(spark, tmp_path):
    """A changed value, a missing, a repeated and an added row, another column name or type and a swapped table are refused."""
    path = str(tmp_path / "t")
    base = [(1, "a", 0.5), (2, None, 1.5), (3, "", None)]
    schema = "i int, s string, v double"
    spark.createDataFrame(base, schema).write.parquet(path)
    tables.stamp_provenance(spark, path, True, "training folds")
    assert tables.guarded_read(spark, path).count() == 3
    spark.createDataFrame(base[::-1], schema).repartition(3).select("v", "i", "s").write.mode("overwrite").parquet(path)
    assert tables.guarded_read(spark, path).count() == 3
    others = [base[:2], base + base[:1], base + [(4, "d", 2.0)], [(1, "a", 0.5), (2, None, 1.25), (3, "", None)],
              [(1, "a", 0.5), (2, "", 1.5), (3, None, None)], [(1, "a", 0.5), (2, "", None), (3, None, 1.5)]]
    frames = [spark.createDataFrame(rows, schema) for rows in others]
    frames += [spark.createDataFrame(base, schema.replace("v ", "w ")), spark.createDataFrame(base, schema.replace("int", "long"))]
    for frame in frames:
        frame.write.mode("overwrite").parquet(path)
        with pytest.raises(PermissionError, match="not the table"):
            tables.guarded_read(spark, path)
    spark.range(1).selectExpr("true as cv_loop_safe", "'x' as selection_stage").write.mode("overwrite").json(path + tables.PROVENANCE_SUFFIX)
    with pytest.raises(PermissionError, match="not the table"):
        tables.guarded_read(spark, path)
