"""Near-duplicate documents: 64-bit SimHash fingerprints linked by covering locality-sensitive hashing."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm.common import matches
from dyadic.llm.graph import connected_components
from dyadic.session import materialize

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
# Distinct fingerprints that one task compares with each other; larger buckets are hashed further.
BUCKET = 1024


def simhash(text: str | None) -> int:
    """Fingerprint of a whole text as a signed 64-bit integer.

    A-Z are lower-cased; words are runs of anything but ASCII blanks; shingles of three words (all words, if there are
    fewer) count with their repeats. Null and wordless texts give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-SHINGLE] + 1).tolist()]
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:].tolist())])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, BITS)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(bits)).view(">i8")[0])


@F.pandas_udf(T.LongType())
def _simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([simhash(t) for t in texts], dtype="int64")


def covering_masks(level: int = 1, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2**(radius+1) - 1 bit masks of which one misses any `radius` bits given.

    Every bit gets a non-zero vector of radius+1 binary digits; mask `v` holds the bits whose vector has odd overlap
    with `v`. At most `radius` vectors leave some non-zero `v` orthogonal to all of them, so two fingerprints that differ
    in these bits agree under mask `v`. `level` gives another assignment.
    """
    vectors = list(range(1, 2 ** (radius + 1)))
    given = [vectors[i % len(vectors)] for i in range(bits)]
    random.Random(level).shuffle(given)
    masks = [sum(1 << i for i, g in enumerate(given) if (g & v).bit_count() % 2) for v in vectors]
    return [m - (1 << bits) if m >= 1 << (bits - 1) else m for m in masks]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))
def _bucket_links(buckets: pd.Series) -> pd.Series:
    """Links that join the fingerprints of one bucket as far as pairs within the radius join them."""
    out = []
    for members in buckets:
        fp = np.unique(np.asarray(members, np.int64))
        u = fp.view(np.uint64)
        near = np.bitwise_count(u[:, None] ^ u[None, :]) <= RADIUS
        label, last = np.arange(len(fp)), None
        while last is None or (label != last).any():
            last, label = label, np.where(near, label[None, :], len(fp)).min(axis=1)
            label = label[label]
        out.append([{"a": int(fp[i]), "b": int(fp[r])} for i, r in enumerate(label) if i != r])
    return pd.Series(out)


def near_links(fingerprints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints `fp`; their components are those of all pairs within the radius.

    A pair shares a bucket of some covering mask. Buckets of up to `bucket` members are compared in a task. The members of
    larger ones are hashed again under further masks joined to the first: each level fixes about half of the bits still
    free, and a bucket with so few free bits cannot hold more than `bucket` distinct fingerprints. Nothing is capped.
    """
    rows = fingerprints.select("fp", F.lit(0).cast("long").alias("fixed"), F.lit("").alias("path"))
    found, level = [], 0
    while True:
        level += 1
        masks = F.array(*[
            F.struct(F.concat("path", F.lit(f"{i}.")).alias("path"), F.col("fixed").bitwiseOR(F.lit(m)).alias("fixed"))
            for i, m in enumerate(covering_masks(level))
        ])
        keyed = rows.select("fp", F.explode(masks).alias("m")).select(
            "fp", "m.path", "m.fixed", F.col("fp").bitwiseAND(F.col("m.fixed")).alias("key"))
        counts = materialize(keyed.groupBy("path", "key").agg(F.count("*").alias("n")).filter("n > 1"))
        shared = keyed.join(counts, ["path", "key"])
        groups = shared.filter(F.col("n") <= bucket).groupBy("path", "key").agg(F.collect_list("fp").alias("members"))
        links = groups.select(F.explode(_bucket_links("members")).alias("e")).select("e.a", "e.b").distinct()
        found.append(materialize(links))
        if counts.filter(F.col("n") > bucket).isEmpty():
            break
        rows = materialize(shared.filter(F.col("n") > bucket).select("fp", "fixed", "path"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, fingerprint, component_id) of every row of `docs` (doc_id, text).

    Documents are linked if their fingerprints differ in at most three bits; `component_id` is the smallest doc_id that
    can be reached over links. Null, empty and wordless texts have fingerprint zero and are linked like any other. Rows
    with a null doc_id take part but name no component, so one that only they form has a null id. Repeated rows stay as
    they are. An empty table gives an empty result. Other columns are not read.
    """
    prints = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _simhash("text").alias("fp")))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(near_links(distinct))
    rooted = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = materialize(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", "text_hash", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the least doc_id stays.

    Rows of a component without any id are told apart by the hash of their text; of equal rows one stays.
    """
    found = near_duplicates(docs)
    # A component with a null id consists of rows without ids; their fingerprint stands for it.
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    winners = found.groupBy(group.alias("g")).agg(best)
    winners = materialize(winners.select(F.col("best.doc_id"), F.col("best.text_hash")).distinct())
    kept = matches(docs, winners, "left_semi")
    repeated = found.groupBy("doc_id", "text_hash").count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
