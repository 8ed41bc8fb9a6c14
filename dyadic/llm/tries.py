"""Prefix trie of conversations: shared beginnings, their members and what storing each once would save."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadic.llm.common import hot_join, running_total
from dyadic.llm.contraction import subtree_sums
from dyadic.session import materialize

# Neighbouring turn numbers that one task sorts; a longer conversation is spread over several.
STRETCH_BITS = 10
# Neighbouring conversation ids that are written into one string before a node's digest is taken.
ID_BITS = 12
KEYS = ("k1", "k2")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, role, text): turns in the order (turn, role, text), a null turn first, `pos` from 0."""
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    stretch = F.coalesce(F.shiftright("turn", STRETCH_BITS), F.lit(-(1 << 62)))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    placed = running_total(turns.withColumn("stretch", stretch), ["conv"], "stretch", order, F.lit(1), "pos")
    return placed.select("conv", "pos", "role", "text")


def rebuild(turns: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rebuilt turns (conv, pos, role, text), (conv, length) of every conversation, turnless ones included).

    Conversation c starts with the first h turns of conversation c - c % group, h = crc32(c) % (most + 1), as far as that
    has them, and goes on with its own turns after its first h.
    """
    turns = materialize(turns)
    sizes = materialize(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")))
    plan = sizes.select(
        "conv", "own", (F.col("conv") - F.col("conv") % group).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).alias("h"))
    lent = sizes.select(F.col("conv").alias("base"), F.col("own").alias("lent"))
    plan = plan.join(lent, "base", "left").withColumn("got", F.least("h", F.coalesce("lent", F.lit(0))))
    plan = materialize(plan.drop("lent"))
    # At most 2 * group - 1 conversations share a base, and it lends them at most `most` turns.
    heads = turns.filter(F.col("pos") < most).withColumnRenamed("conv", "base")
    heads = heads.join(plan.select("base", "conv", "got"), "base").filter("pos < got").select("conv", "pos", "role", "text")
    tails = hot_join(turns, plan.select("conv", "h", "got"), "conv").filter("pos >= h")
    tails = tails.select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "role", "text")
    length = F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return heads.unionByName(tails), plan.select("conv", length.alias("length"))


def _turn_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "pos", "role", F.lit(seed), "text")


def prefix_keys(turns: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, size): the 128-bit key of the first `depth` turns, that of one turn less, the bytes of the last.

    A turn's hash covers its place, role and text, so the running exclusive-or of the hashes names the sequence. It is
    taken within stretches of a conversation and across their totals, so no conversation is one task's work.
    """
    rows = turns.withColumn("stretch", F.shiftright("pos", STRETCH_BITS))
    rows = rows.withColumns({"t1": _turn_key(1), "t2": _turn_key(2), "size": F.octet_length("text").cast("long")}).drop("role", "text")
    inner = Window.partitionBy("conv", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "stretch").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    before = totals.select("conv", "stretch", *[F.coalesce(F.bit_xor(f"s{i}").over(outer), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    keyed = rows.withColumns({f"w{i}": F.bit_xor(f"t{i}").over(inner) for i in (1, 2)}).join(before, ["conv", "stretch"])
    keyed = keyed.withColumns({f"k{i}": F.col(f"w{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
    return keyed.select("conv", (F.col("pos") + 1).alias("depth"), *KEYS,
                        *[F.col(f"k{i}").bitwiseXOR(F.col(f"t{i}")).alias(f"p{i}") for i in (1, 2)], "size")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the pieces of each node, which stand together and in order; one piece at a time is hashed."""
    node, running = None, None
    for batch in batches:
        out = []
        for k1, k2, ids in zip(batch.k1, batch.k2, batch.ids):
            if (k1, k2) == node:
                running.update(b"," + ids.encode())
            else:
                if node is not None:
                    out.append((*node, running.hexdigest()))
                node, running = (k1, k2), hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, running.hexdigest())], columns=["k1", "k2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): digest of the ascending, comma-joined `conv` of every node.

    Ids are first joined within stretches of 4,096 neighbouring ids, which bounds a group; the digest of a node then
    streams over its stretches, as the order of a digest demands.
    """
    pieces = ends.groupBy(*KEYS, F.shiftright("conv", ID_BITS).alias("stretch")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    pieces = pieces.select(*KEYS, "stretch", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ordered = pieces.repartition(*KEYS).sortWithinPartitions(*KEYS, "stretch")
    return ordered.select(*KEYS, "ids").mapInPandas(_digests, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie over the rebuilt conversations of `conversations` (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; see
    `rebuild` for what is rebuilt. A node is a distinct sequence of first turns, the root is the empty one. `n_leaves` and
    `saved_tokens` are subtree sums by tree contraction. Rows with a null conv_id belong to no conversation and are left
    out; null roles and texts are empty; equal turn numbers are ordered by role and text, and repeated rows are turns of
    their own. An empty table has no members and gives no row, not even the root. Other columns are not read.
    """
    turns, lengths = rebuild(ordered_turns(conversations))
    lengths = materialize(lengths)
    none = F.lit(None).cast("long")
    roots = lengths.select("conv", *[F.lit(0).cast("long").alias(c) for c in ("depth", *KEYS)], none.alias("p1"), none.alias("p2"),
                           F.lit(0).cast("long").alias("size"))
    rows = materialize(prefix_keys(turns).unionByName(roots))
    nodes = rows.groupBy(*KEYS).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        *[F.first(c).alias(c) for c in ("depth", "p1", "p2", "size")])
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    above = nodes.select(F.struct(F.col("k1"), F.col("k2")).alias("p"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    placed = nodes.withColumn("p", F.when(F.col("p1").isNotNull(), F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2"))))
    placed = materialize(hot_join(placed, above, "p").drop("p", "p1", "p2"))
    kids = placed.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    placed = materialize(placed.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    sums = subtree_sums(placed.select(
        "node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = hot_join(rows.select("conv", "depth", *KEYS), lengths, "conv").filter("depth = length")
    out = placed.join(sums, "node").join(end_digests(ends), list(KEYS), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


# A key holds 64 hex digits a turn, so an ancestor's key is a prefix of it. crc32 is worked out bit by bit.
OP12_SQL = """
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS own FROM o GROUP BY c),
h AS (
  SELECT c, own, c - c % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 9 AS h
  FROM sizes),
plan AS (SELECT h.*, least(h.h, coalesce(b.own, 0)) AS got FROM h LEFT JOIN sizes b ON b.c = h.base),
rebuilt AS (
  SELECT p.c, o.pos, o.role, o.text FROM plan p JOIN o ON o.c = p.base AND o.pos < p.got
  UNION ALL
  SELECT p.c, o.pos - p.h + p.got, o.role, o.text FROM plan p JOIN o ON o.c = p.c AND o.pos >= p.h),
p AS (
  SELECT c, pos + 1 AS d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY pos) AS key, strlen(text) AS size FROM rebuilt
  UNION ALL
  SELECT c, 0, '', 0 FROM plan),
nodes AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, min(size) AS size FROM p GROUP BY key, d),
kids AS (SELECT key[:len(key) - 64] AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (key)),
sums AS (
  SELECT a.key, sum((n.n_children = 0)::INT) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM full_nodes n JOIN p a ON a.c = n.conv_id AND a.d <= n.d GROUP BY a.key),
ends AS (
  SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256
  FROM p JOIN (SELECT c, max(d) AS d FROM p GROUP BY c) l USING (c, d) GROUP BY key)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes n JOIN sums s USING (key) LEFT JOIN ends e USING (key)
LEFT JOIN nodes u ON n.d > 0 AND u.key = n.key[:len(n.key) - 64]
"""
