"""Domain classifiers and the shift gate: how their rows are dealt and how often their inputs are read."""

import numpy as np
import pandas as pd

from dyadic.operators import domain
from dyadic.plans import jobs


def _rows(spark, n, rng):
    label = np.arange(n) % 2
    x = rng.normal(size=(n, 2)) + label[:, None] * [1.0, 0.0]
    return spark.createDataFrame(pd.DataFrame(
        {"sample_id": [f"s{i:05d}" for i in range(n)], "label": label, "z": [list(map(float, v)) for v in x]}))


def test_every_core_fits(spark, rng):
    n = 3 * domain._FIT_ROWS + 10
    out = domain.domain_classifier(_rows(spark, n, rng), trees=2, depth=2, bootstrap=10)
    sizes = [len(part) for part in out["probability"].select("sample_id").rdd.glom().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism == 4
    assert sum(sizes) == n and max(sizes) < 1.2 * n / 4
    got = {r.model: r.mean_auc for r in out["summary"].collect()}
    assert abs(got["lr"] - 0.76) < 0.02 and 0.65 < got["rf"] < 0.78  # two normals one deviation apart: 0.760


def test_shift_gate_reads_observations_once(spark, rng):
    n, p = 40, 6
    x = rng.normal(size=(2, n, 2, p)) * np.arange(1, p + 1)
    x[1, :, 1, :3] += 40
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    sides = [
        spark.createDataFrame(pd.DataFrame([(i, v, j, float(c[i, k, j])) for i in range(n) for k, v in enumerate(("PRE", "POST"))
                                            for j in range(p)], columns=["subject_id", "visit", "feature_id", "value"]))
        for c in x
    ]
    sides = [s.mapInPandas(counted, s.schema) for s in sides]
    out = jobs.shift_gate(*sides, top=4, minimum=1, trees=3, bootstrap=10)
    # The four widest features of both cohorts, scaled within each: no shift is left.
    assert out["features"].count() == 4
    assert {r.model for r in out["summary"].collect()} == {"lr", "rf"} and out["probability"].count() == 2 * n
    assert read.value == 2 * n * 2 * p
