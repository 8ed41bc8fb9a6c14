import numpy as np
import pandas as pd


def long_frame(spark, matrix, sample="sample_id", feature="feature_id"):
    """Matrix (samples x features) to a long DataFrame; NaN becomes NULL."""
    n, p = matrix.shape
    rows = [(f"s{i:03d}", f"g{j:03d}", None if np.isnan(matrix[i, j]) else float(matrix[i, j])) for i in range(n) for j in range(p)]
    return spark.createDataFrame(rows, f"{sample} string, {feature} string, value double")


def design_frame(spark, **columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame(pd.DataFrame({"sample_id": [f"s{i:03d}" for i in range(n)], **columns}))


def ols(y, x):
    """Least squares with the minimum-norm solution: coefficients, standard errors, residual degrees."""
    keep = ~np.isnan(y)
    x, y = x[keep], y[keep]
    beta = np.linalg.pinv(x) @ y
    df = len(y) - np.linalg.matrix_rank(x)
    s2 = np.sum((y - x @ beta) ** 2) / df
    return beta, np.sqrt(s2 * np.diag(np.linalg.pinv(x.T @ x))), df


def vectors(spark, matrix, **columns):
    data = {"subject_id": range(len(matrix)), "z": [list(map(float, r)) for r in matrix], **columns}
    return spark.createDataFrame(pd.DataFrame(data))
