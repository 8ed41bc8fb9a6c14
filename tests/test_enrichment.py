import numpy as np
import pandas as pd
import pytest

from dyadic.operators import activity as A
from dyadic.operators import enrichment as E
from helpers import long_frame


def boxes(rng, n, widest):
    start = rng.integers(0, 3000, n)
    return pd.DataFrame({"chrom": rng.choice(["x", "y"], n), "start": start, "end": start + rng.integers(1, widest, n)})


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("task_rows", [2_000_000, 15])
def test_overlap_against_brute_force(spark, rng, closed, task_rows):
    q = boxes(rng, 120, 40).assign(feature_id=range(120))
    q.loc[60:, ["chrom", "start", "end"]] = ["x", 1500, 1501]  # half of the queries share one place
    t = boxes(rng, 60, 200).assign(set_name=rng.choice(["u", "v"], 60))
    got = {(r.feature_id, r.set_name) for r in E.overlap_members(
        spark.createDataFrame(q), spark.createDataFrame(t), closed=closed, task_rows=task_rows).collect()}
    want = set()
    for a in q.itertuples():
        for b in t.itertuples():
            inside = (b.start <= a.end and b.end >= a.start) if closed else (b.start < a.end and b.end > a.start)
            if a.chrom == b.chrom and inside:
                want.add((a.feature_id, b.set_name))
    assert got == want


@pytest.mark.parametrize("closed", [False, True])
def test_overlap_of_very_long_and_odd_intervals(spark, rng, closed):
    """Whole chromosomes on either side, negative coordinates, intervals that are empty, reversed or null."""
    low, high = -(10**9), 2 * 10**12
    q = [(0, "x", low, high), (1, "x", 5, 5), (2, "x", 7, 3), (3, "x", None, 4), (4, "y", 10**6, 10**6 + 1), (5, None, 1, 2), (6, "x", high - 1, high)]
    q += [(i, "x", int(s), int(s) + int(n)) for i, (s, n) in enumerate(zip(rng.integers(-500, 500, 40), rng.integers(1, 300, 40)), 10)]
    t = [("u", "x", low, high), ("v", "y", low, high), ("w", "x", 40, 90), ("w", "x", 200, 201), ("z", "x", 100, 100), ("z", "x", 9, 2), ("n", "x", None, 7)]
    t += [("m", "x", int(s), int(s) + 3) for s in rng.integers(-500, 500, 30)]
    got = {(r.feature_id, r.set_name) for r in E.overlap_members(
        spark.createDataFrame(q, "feature_id int, chrom string, start long, end long"),
        spark.createDataFrame(t, "set_name string, chrom string, start long, end long"), closed=closed).collect()}
    want = set()
    for i, c, s, e in q:
        for name, chrom, a, b in t:
            if None not in (c, s, e, a, b) and c == chrom and s <= e and a <= b and ((a <= e and b >= s) if closed else (a < e and b > s)):
                want.add((i, name))
    assert got == want


def test_an_interval_is_few_blocks(spark, rng):
    """Blocks tile the interval, at most two a level, whatever its length."""
    ends = [(0, 1), (0, 2**40), (1, 2**40 - 1), (5, 5)] + [tuple(sorted(map(int, rng.integers(0, 4000, 2)))) for _ in range(60)]
    rows = spark.createDataFrame(ends, "a long, b long").select("a", "b", E._nodes_of_interval("a", "b", 41).alias("n")).collect()
    for r in rows:
        assert len(r.n) <= 2 * 41 and sum(2**b.level for b in r.n) == r.b - r.a
        if r.b < 5000:
            assert sorted(x for b in r.n for x in range(b.node << b.level, (b.node + 1) << b.level)) == list(range(r.a, r.b))
    assert max(len(r.n) for r in rows if r.b >= 2**39) <= 80


def test_no_overlap_of_nothing(spark):
    q = spark.createDataFrame([(1, "x", 1, 9)], "feature_id int, chrom string, start long, end long")
    t = spark.createDataFrame([("u", "x", 2, 3)], "set_name string, chrom string, start long, end long")
    for a, b in ((q, t.limit(0)), (q.limit(0), t), (q.limit(0), t.limit(0))):
        assert E.overlap_members(a, b).collect() == []


def test_merged_intervals_are_disjoint(spark, rng):
    t = boxes(rng, 80, 150).assign(set_name="u")
    merged = E.merge_intervals(spark.createDataFrame(t), task_rows=12).toPandas().sort_values(["chrom", "start"])
    for chrom, part in merged.groupby("chrom"):
        assert (part.start.to_numpy()[1:] > part.end.to_numpy()[:-1]).all()
        cover = np.zeros(4000, bool)
        for r in t[t.chrom == chrom].itertuples():
            cover[r.start : r.end] = True
        assert (part.end - part.start).sum() == cover.sum()


def test_regulatory_enrichment_counts(spark):
    places = pd.DataFrame({"feature_id": range(20), "chrom": "chr1", "start": range(0, 2000, 100)})
    places["end"] = places.start + 1
    sites = spark.createDataFrame(places)
    targets = spark.createDataFrame([("hit", "chr1", 0, 450), ("none", "chr2", 0, 9)], "set_name string, chrom string, start long, end long")
    results = spark.createDataFrame([("Mono", i, 0.01 if i < 4 else 0.9) for i in range(20)], "cell_type string, feature_id long, q_val double")
    got = {r.set_name: r for r in E.regulatory_enrichment(results, sites, sites, targets).collect()}
    assert (got["hit"].n_sig, got["hit"].n_feature, got["hit"].observed, got["hit"].n_background) == (4, 5, 4, 20)
    assert got["hit"].p_val == pytest.approx(5 / 4845) and got["hit"].enrichment == pytest.approx(4.0)
    assert got["none"].p_val is None and got["none"].q_val == 1.0


def test_genes_of_hits(spark):
    notes = spark.createDataFrame([("c1", "GENE_A;GENE_A;GENE_B", "x"), ("c2", "GENE_C", "x"), ("c3", "NA", " GENE_D; "), ("c4", None, "NA")],
                                  "feature_id string, gene string, fallback string")
    hits = spark.createDataFrame([("Mono", f"c{i}") for i in range(1, 5)], "cell_type string, feature_id string")
    assert sorted(r.gene_id for r in E.annotate_explode(hits, notes).collect()) == ["GENE_A", "GENE_B", "GENE_C", "GENE_D"]


def test_themes_and_coherence(spark):
    terms = spark.createDataFrame([("a", f"TNF signal {i}", 0.01 * i) for i in range(1, 6)] + [("b", "Histone marks", 0.01), ("b", "WNT", 0.5)],
                                  "cell_type string, term string, q_val double")
    hits = E.keyword_hits(terms, ["cell_type"])
    assert hits.filter("cell_type = 'a'").count() == 3  # first three significant ones
    assert {r.cell_type: r.coherent for r in E.coherence(hits, ["cell_type"]).collect()} == {"a": True, "b": False}


def test_short_gene_lists_are_left_out(spark):
    lists = spark.createDataFrame([("a", f"g{i}") for i in range(6)] + [("b", "g1")], "cell_type string, gene_id string")
    sets = spark.createDataFrame([("L", "t", f"g{i}") for i in range(3)] + [("L", "rest", f"g{i}") for i in range(3, 30)], "library string, term string, gene_id string")
    got = E.over_representation(lists, sets).toPandas()
    assert set(got.cell_type) == {"a"} and got.set_index("term").observed["t"] == 3


def test_ulm_is_the_t_value_of_a_regression(spark, rng):
    x = rng.normal(size=(5, 30))
    weights = np.zeros(30)
    weights[:8] = rng.choice([-1.0, 1.0], 8)
    net = spark.createDataFrame([("T", f"g{j:03d}", float(weights[j])) for j in range(8)] + [("small", "g000", 1.0)], "source string, target string, weight double")
    got = {r.sample_id: r.score for r in A.ulm_activity(long_frame(spark, x), net).collect()}
    for i in range(5):
        r = np.corrcoef(x[i], weights)[0, 1]
        assert got[f"s{i:03d}"] == pytest.approx(r * np.sqrt(28 / (1 - r * r)))


def test_ssgsea_closed_form_equals_the_walk(spark, rng):
    x = rng.normal(size=(3, 25))
    members = {f"g{j:03d}" for j in rng.choice(25, 7, replace=False)}
    sets = spark.createDataFrame([("S", g) for g in members], "source string, target string")
    got = {r.sample_id: r.score for r in A.ssgsea(long_frame(spark, x), sets).collect()}
    for i in range(3):
        rank = pd.Series(x[i]).rank().to_numpy()
        order = np.argsort(-x[i])
        inside = np.array([f"g{j:03d}" in members for j in order])
        w = np.where(inside, rank[order] ** 0.25, 0.0)
        walk = np.cumsum(w) / w.sum() - np.cumsum(~inside) / (~inside).sum()
        assert got[f"s{i:03d}"] == pytest.approx(walk.sum())


def test_deconvolution_recovers_fractions(spark, rng):
    panel = rng.uniform(size=(60, 3))
    truth = rng.dirichlet([2, 1, 1], 6)
    truth[0] = [0.7, 0.3, 0.0]
    betas = long_frame(spark, truth @ panel.T)
    ref = spark.createDataFrame(pd.DataFrame(panel, columns=list("abc")).assign(feature_id=[f"g{j:03d}" for j in range(60)]))
    got = A.deconvolve(betas, ref, list("abc")).orderBy("sample_id").toPandas()[list("abc")].to_numpy()
    assert np.allclose(got, truth, atol=1e-8)
    with pytest.raises(Exception, match="no beta values"):
        A.deconvolve(long_frame(spark, np.full((2, 60), 3.0)), ref, list("abc")).collect()
    checks = A.fraction_checks(A.deconvolve(betas, ref, list("abc")), list("abc")).first()
    assert checks.n == 6 and checks.n_off == 0 and checks.near_constant == []


def test_absent_pairs_have_a_row_without_score(spark):
    rows = [("s1", f"g{i}", float(i)) for i in range(6)] + [("s2", "g5", 1.0), ("s2", "g4", 2.0)]
    features = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    sets = spark.createDataFrame([("a", f"g{i}") for i in range(3)] + [("b", "g4"), ("b", "g3"), ("b", "g1")], "source string, target string")
    got = {(r.sample_id, r.source): r.score for r in A.ssgsea(features, sets, minimum=3).collect()}
    assert set(got) == {(s, t) for s in ("s1", "s2") for t in ("a", "b")}
    assert got["s2", "a"] is None and got["s2", "b"] is not None and got["s1", "a"] is not None
