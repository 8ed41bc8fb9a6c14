"""Exact top-k inner-product search over norm buckets.

Vectors are grouped by length. A query's score with a bucket is at most |q| times the longest vector in it, so the score
it already has for its k-th place gives a cosine that any useful vector of the bucket must reach. Buckets that cannot
reach it are skipped; in the others, vectors are pruned by length where that cosine is low and by their coordinates along
the query's largest components where it is high. What is left is verified with exact products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadic.session import materialize, small_side

K = 5
# Lengths in a bucket differ by at most this factor.
STEP = 1.1
# Vectors of a bucket, and queries, that one task holds at a time.
GROUP = 8192
# Longest vectors of each number of components that give every query its first threshold.
SEEDS = 2048
# Cosine from which coordinates prune better than lengths.
COORDINATE_COSINE = 0.5
FOCUS = 4
_FOUND = "query_id long, vec_id long, score long"
_LEAST, _MOST = -(2**63), 2**63 - 1


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, norm2): floor(256 * x) of every component x as a double.

    Rows without an id, with a null vector or with a null or non-finite component take no part; nor do components so large
    that 256 times them is no finite double. Rows that are equal in id and vector are one; as queries, rows of one id that
    differ are answered together.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < 2.0**1015))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & fine)
    # A double from 2^52 on is whole already, and its floor as a long would not hold it. Adding zero turns -0.0 to 0.0.
    v = F.transform(x, lambda e: F.when(F.abs(e) < 2.0**44, F.floor(e * 256.0).cast("double")).otherwise(e * 256.0) + 0.0)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct().withColumn("norm2", norm2)


def _bucket(norm2: Column) -> Column:
    """Of a squared length: 0 for the zero vector, then one for every factor of STEP; at most a few thousand in all."""
    return F.when(norm2 <= 0, 0).otherwise(1 + F.floor(F.log(F.least(norm2, F.lit(1e300))) / float(2 * np.log(STEP)))).cast("int")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(list(vectors), dtype=float).reshape(len(vectors), -1)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of the rows, in floating point only where every partial sum is exact in it.

    A product beyond the range of a 64-bit integer is the nearest such integer.
    """
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if most < 2.0**53:
        return np.rint(q @ c.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ c.T.astype(np.int64)
    whole = [[int(e) for e in row] for row in c.tolist()]
    out = np.empty((len(q), len(c)), np.int64)
    for i, row in enumerate(q.tolist()):
        own = [int(e) for e in row]
        for j, other in enumerate(whole):
            out[i, j] = min(max(sum(a * b for a, b in zip(own, other)), _LEAST), _MOST)
    return out


def search_group(queries: pd.DataFrame, vectors: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """The best `k` of one group of similar lengths for every query, as far as they can reach its `least` score."""
    out = []
    if len(queries) and len(vectors):
        vectors = vectors.sort_values(["norm2", "vec_id"], ascending=[False, True], kind="stable")
        c, ids = _matrix(vectors["v"]), vectors["vec_id"].to_numpy(np.int64)
        length = np.sqrt(vectors["norm2"].to_numpy(float))
        unit = c / np.maximum(length, 1.0)[:, None]
        q, qid = _matrix(queries["v"]), queries["vec_id"].to_numpy(np.int64)
        q_length, least = np.sqrt(queries["norm2"].to_numpy(float)), queries["least"].to_numpy(float)
        # The cosine that a vector as long as the group's longest needs; the margin covers rounding.
        need = np.where(np.isneginf(least), -np.inf, least) / np.maximum(q_length * length[0], 1e-300) - 1e-9
        plain = [i for i in range(len(q)) if not need[i] > COORDINATE_COSINE]
        for i in range(len(q)):
            if need[i] > COORDINATE_COSINE:
                if need[i] > 1:
                    continue
                # Unit vectors at an angle of at most acos(t) differ by at most that angle against any axis, so along a
                # component of size x of the query they reach cos(acos(x) + acos(t)).
                direction = q[i] / q_length[i]
                keep = length * q_length[i] >= least[i] * (1 - 1e-9)
                for f in np.argsort(-np.abs(direction))[:FOCUS]:
                    side, t = np.sign(direction[f]), min(need[i], 1.0)
                    x = abs(direction[f])
                    slack = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x)))
                    keep &= side * unit[:, f] >= t * x - slack - 1e-9
                rows = np.flatnonzero(keep)
                if len(rows):
                    _best(out, qid[i:i + 1], _exact(q[i:i + 1], c[rows]), ids[rows], least[i:i + 1], k)
        # Length pruning: of the vectors, longest first, those that could reach the weakest of these queries' needs.
        for at in range(0, len(plain), 256):
            rows = np.array(plain[at:at + 256])
            reach = np.where(least[rows] > 0, least[rows] * (1 - 1e-9) / np.maximum(q_length[rows], 1e-300), 0.0).min()
            upto = int((length >= reach).sum())
            if upto:
                _best(out, qid[rows], _exact(q[rows], c[:upto]), ids[:upto], least[rows], k)
    return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 3), np.int64), columns=["query_id", "vec_id", "score"])


def _best(out: list, qid: np.ndarray, scores: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> None:
    for i, row in enumerate(scores):
        fit = (ids != qid[i]) & (row >= least[i])
        row, own = row[fit], ids[fit]
        if len(row) > k:
            kth = np.partition(row, len(row) - k)[len(row) - k]
            row, own = row[row >= kth], own[row >= kth]
        order = np.lexsort((own, -row))[:k]
        out.append(np.column_stack([np.full(len(order), qid[i]), own[order], row[order]]))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): every query's `k` highest inner products (all, if fewer), ties to smaller ids.

    Both sides are (vec_id, v, norm2) as `quantised` gives them. A vector never meets the rows of its own id, nor those
    with another number of components. Queries and vectors meet in groups of bounded size: a group of vectors is a part of
    a norm bucket, and a query goes to the groups its threshold does not rule out. Vectors go where some query goes.
    Scores beyond the range of a long are its ends. Empty sides give an empty result.
    """
    vectors = materialize(vectors.withColumns({"dim": F.size("v"), "bucket": _bucket(F.col("norm2"))}))
    # New names for the query side, which may be a part of the vectors.
    queries = queries.toDF(*queries.columns).withColumn("dim", F.size("v"))
    blocks = max(1, -(-queries.count() // GROUP))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    search = _search(k)
    keys = ["dim", "bucket", "part", "block"]

    # First thresholds: the k-th score among the longest vectors of a width, a list of fixed length.
    longest = Window.partitionBy("dim").orderBy(F.desc("norm2"), "vec_id")
    seeds = vectors.withColumn("place", F.row_number().over(longest)).filter(F.col("place") <= SEEDS).drop("place")
    seeds = seeds.withColumns({"bucket": F.lit(0), "part": F.lit(0)}).withColumn("block", all_blocks)
    asked = queries.withColumns({"bucket": F.lit(0), "part": F.lit(0), "least": F.lit(float("-inf"))})
    first = _ranked(asked.groupBy(*keys).cogroup(seeds.groupBy(*keys)).applyInPandas(search, _FOUND), k)
    # As a double a long score may be rounded up, by less than this part of it.
    kth = F.col("score").cast("double")
    least = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (kth - F.abs(kth) * 1e-15).alias("least"))
    queries = materialize(queries.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))))

    # Norm buckets are few whatever the number of vectors; each is split into parts of bounded size.
    sizes = vectors.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm2").alias("longest"))
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("n") / GROUP).cast("int")))
    placed = vectors.join(F.broadcast(sizes.select("dim", "bucket", "parts")), ["dim", "bucket"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")).withColumn("block", all_blocks)
    reach = F.sqrt("norm2") * F.sqrt("longest") * (1 + 1e-9) >= F.col("least")
    met = sizes.select("dim", "bucket", "parts", "longest").toDF("dim", "bucket", "parts", "longest")
    asked = queries.join(F.broadcast(met), "dim").filter(reach)
    reached = small_side(asked.select("dim", "bucket", "block").distinct())
    placed = placed.join(reached, ["dim", "bucket", "block"], "left_semi")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = asked.groupBy(*keys).cogroup(placed.select("vec_id", "v", "norm2", *keys).groupBy(*keys)).applyInPandas(search, _FOUND)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _search(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        return search_group(queries, vectors, k)

    return run


def nearest(embeddings: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """`top_k` of the rows whose vec_id is divisible by `every` against all other rows."""
    rows = materialize(quantised(embeddings))
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)


OP4_SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= {K}
"""
