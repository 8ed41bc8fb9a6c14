"""Find benchmark passages in documents with spaced-seed hashing.

Seeds are fixed masks over token windows that ignore some positions. Any stretch of OVERLAP aligned tokens with up to
EDITS substitutions holds, for some mask, a window whose kept positions are all equal; so joining the seed hashes of the
two sides loses no overlap, and what the join finds is verified token by token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadic.llm.common import matches
from dyadic.session import fits, materialize, small_side

# 11 of 13 tokens are a similarity above 0.8.
OVERLAP = 13
EDITS = 2
MASKS = ((0, 1, 2, 4, 10, 11), (0, 1, 3, 4, 5, 6))
# Items of SHORT tokens up to OVERLAP - 1 are found whole: from LOOSE tokens on with one substitution, which leaves the first
# or the second SHORT_MASK of them intact, below that without any.
SHORT = 6
LOOSE = 10
SHORT_MASK = (0, 1, 2, 3, 4)
# Seeds of the benchmark side that are broadcast; each holds a context of up to 2 * OVERLAP token hashes.
SEED_ROWS = 100_000
# Token positions of a document that are hashed at a time.
STRETCH = 2048
# Parts into which every seed hash is split where the sides are joined by shuffle.
SALTS = 8
KEY = ["doc_id", "text_hash"]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _seeds(toks: str, at: Column, masks: Sequence[Sequence[int]]) -> Column:
    """(mask, key) of every mask laid at a position; the key is null where the mask does not fit."""
    each = []
    for n, mask in enumerate(masks):
        fits_here = at + mask[-1] < F.size(toks)
        kept = [F.get(toks, at + o) for o in mask]
        each.append(F.when(fits_here, F.xxhash64(F.lit(n), *kept)))
    return F.array(*each)


def benchmark_seeds(benchmark: DataFrame, masks: Sequence[Sequence[int]] = MASKS, overlap: int = OVERLAP, edits: int = EDITS) -> DataFrame:
    """(key, context, off, len, edits, item_id): seed hashes with the tokens around them, `off` being the seed's place
    among these; `len` tokens with up to `edits` substitutions make an overlap.

    The context reaches as far as an overlap that holds the seed can; that of an item below `overlap` tokens is the item.
    Items that agree in seed and context are one row, under the smallest id, so a passage that many items share is compared
    once. Items below `SHORT` tokens give no seed.
    """
    items = benchmark.select("item_id", _hashed(F.col("text")).alias("toks")).filter(F.size("toks") >= min(SHORT, overlap))
    items = items.groupBy("toks").agg(F.min("item_id").alias("item_id")).withColumn("n", F.size("toks"))
    at = items.filter(F.col("n") >= overlap).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    start = F.greatest(F.lit(0), F.col("j") - (overlap - 1))
    long = at.select(
        "item_id", F.explode(_seeds("toks", F.col("j"), masks)).alias("key"), F.slice("toks", start + 1, F.lit(2 * overlap)).alias("context"),
        (F.col("j") - start).alias("off"), F.lit(overlap).alias("len"), F.lit(edits).alias("edits"))
    loose = F.col("n") >= LOOSE
    width = len(SHORT_MASK)
    brief = items.filter(F.col("n") < overlap).withColumn("j", F.explode(F.when(loose, F.array(F.lit(0), F.lit(width))).otherwise(F.array(F.lit(0)))))
    brief = brief.select(
        "item_id", F.get(_seeds("toks", F.col("j"), [*masks, SHORT_MASK]), F.lit(len(masks))).alias("key"), F.col("toks").alias("context"),
        F.col("j").alias("off"), F.col("n").alias("len"), loose.cast("int").alias("edits"))
    return long.unionByName(brief).filter("key is not null").groupBy("key", "off", "context", "len", "edits").agg(F.min("item_id").alias("item_id"))


def stretches(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, text_hash, n, at, toks, lo): stretches of a document's tokens, each with the tokens that a context may need
    around it. Only these short arrays stand beside exploded positions, so the longest document takes no more memory than
    its own tokens. Documents with fewer than `shortest` tokens give none."""
    around = 2 * OVERLAP
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _hashed(F.col("text")).alias("all")).withColumn("n", F.size("all"))
    pick = lambda c: F.struct(
        F.greatest(F.lit(0), c * STRETCH - around).alias("at"),
        F.slice("all", F.greatest(F.lit(0), c * STRETCH - around) + 1, F.lit(STRETCH + 2 * around)).alias("toks"), (c * STRETCH).alias("lo"))
    # Outer generators keep Spark from deriving a filter that would cut every text into tokens a second time.
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / STRETCH).cast("int")), pick)
    return base.select(*KEY, "n", F.explode_outer(F.when(F.col("n") >= shortest, cuts)).alias("c")).filter("c is not null").select(
        *KEY, "n", "c.at", "c.toks", "c.lo")


def positions(parts: DataFrame, masks: Sequence[Sequence[int]]) -> DataFrame:
    """`parts` with a row per token position `i` and mask, under the seed hash `key`."""
    upto = F.least(F.lit(STRETCH), F.col("n") - F.col("lo")) - 1
    rows = parts.withColumn("i", F.explode_outer(F.sequence(F.col("lo") - F.col("at"), F.col("lo") - F.col("at") + upto)))
    return rows.withColumn("key", F.explode_outer(_seeds("toks", F.col("i"), masks)))


def shuffled_hits(parts: DataFrame, seeds: DataFrame, masks: Sequence[Sequence[int]]) -> DataFrame:
    """The join of `positions` with seeds of any number, by shuffle.

    Only (document, stretch, position, key) goes through the exchange, every key split into `SALTS` parts; the tokens of the
    stretches that were hit are brought back afterwards.
    """
    narrow = positions(parts, masks).filter("key is not null").select(*KEY, "at", "i", "key")
    narrow = narrow.withColumn("salt", F.pmod(F.xxhash64(*KEY, "at", "i"), F.lit(SALTS)))
    split = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = materialize(narrow.join(split, ["key", "salt"]).drop("key", "salt").distinct())
    doc = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("at") == F.col("_at"))
    hit = small_side(met.select(*KEY, "at").distinct().toDF("_id", "_hash", "_at"))
    toks = parts.join(hit, doc, "left_semi").dropDuplicates([*KEY, "at"]).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("at").alias("_at"), "toks", "n")
    return met.join(toks, doc).drop("_id", "_hash", "_at")


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: Sequence[Sequence[int]] = MASKS, overlap: int = OVERLAP,
             edits: int = EDITS) -> DataFrame:
    """(doc_id, text_hash, start, end, item_id): every stretch of `overlap` tokens of a document, from token `start` to
    before `end`, that agrees with consecutive tokens of some benchmark item up to `edits` substitutions, or that agrees
    with a whole shorter item; `item_id` is the smallest such.

    `masks` must be such that any placing of `edits` substitutions in `overlap` tokens leaves one of them whole.
    """
    seeds = materialize(benchmark_seeds(benchmark, masks, overlap, edits))
    shortest = seeds.agg(F.min("len")).first()[0] or overlap
    # The mask of short items is laid only if there are any.
    used = [*masks, SHORT_MASK] if shortest < overlap else list(masks)
    parts = stretches(docs, shortest)
    if fits(seeds, SEED_ROWS):
        met = positions(parts, used).join(F.broadcast(seeds), "key")
    else:
        met = shuffled_hits(parts, seeds, used)
    # The tokens beside the context, cut out before anything else is done with a hit.
    place = F.col("i") - F.col("off")
    hits = met.select(
        *KEY, "n", "item_id", "context", "len", "edits", (F.col("at") + place).alias("first"), F.greatest(F.lit(0), -place).alias("skip"),
        F.slice("toks", F.greatest(F.lit(0), place) + 1, F.lit(2 * OVERLAP)).alias("part"))
    agrees = F.transform("context", lambda x, p: F.when(F.get("part", p - F.col("skip")) == x, 1).otherwise(0))
    same = hits.select(*KEY, "n", "item_id", "first", "len", "edits", F.when(F.size("part") > 0, agrees).alias("same"))
    inside = lambda s: (F.col("first") + s >= 0) & (F.col("first") + s + F.col("len") <= F.col("n"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("same") - F.col("len")),
        lambda s: inside(s) & (F.aggregate(F.slice("same", s + 1, F.col("len")), F.lit(0), lambda a, x: a + x) >= F.col("len") - F.col("edits")))
    found = same.select(*KEY, "item_id", F.explode_outer(starts).alias("s"), "first", "len").filter("s is not null")
    start = F.col("first") + F.col("s")
    return found.groupBy(*KEY, start.alias("start"), (start + F.col("len")).alias("end")).agg(F.min("item_id").alias("item_id"))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: Sequence[Sequence[int]] = MASKS, overlap: int = OVERLAP,
                 edits: int = EDITS) -> DataFrame:
    """One row per contaminated document: doc_id, text_hash, `item_id` (the smallest it meets), `first_token`,
    `last_token`, and `covered`, the number of its tokens inside overlaps.

    Items of fewer than `overlap` tokens count if they are met whole (with one substitution from `LOOSE` tokens on); items
    below `SHORT` tokens, null texts among them, meet nothing. Documents equal in id and text give one row; those with a
    null id keep it. Items with a null id count as larger than any other. Empty tables give an empty result. Other columns
    are not read.
    """
    before = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    return overlaps(docs, benchmark, masks, overlap, edits).withColumn("_new", new).groupBy(*KEY).agg(
        F.min("item_id").alias("item_id"), F.min("start").cast("long").alias("first_token"),
        (F.max("end") - 1).cast("long").alias("last_token"), F.sum("_new").cast("long").alias("covered"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a benchmark passage."""
    return matches(docs, materialize(contaminated(docs, benchmark).select(*KEY)), "left_anti")


OP8_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM documents),
dt AS (SELECT doc_id, text, unnest(t) AS w, unnest(range(len(t))) AS i, len(t) AS n FROM d WHERE len(t) >= {SHORT}),
b AS (SELECT t, min(item_id) AS item_id FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM benchmark)
  WHERE len(t) >= {SHORT} GROUP BY t),
bt AS (SELECT item_id, unnest(t) AS w, unnest(range(len(t))) AS j, len(t) AS m, least(len(t), {OVERLAP}) AS l,
  CASE WHEN len(t) >= {OVERLAP} THEN {EDITS} WHEN len(t) >= {LOOSE} THEN 1 ELSE 0 END AS e FROM b),
same AS (SELECT doc_id, text, item_id, i, i - j AS g, n, m, l, e FROM dt JOIN bt USING (w)),
lines AS (SELECT doc_id, text, item_id, g, n, m, l, e FROM same GROUP BY ALL HAVING count(*) >= l - e),
tries AS (SELECT *, unnest(range(greatest(0, g), least(n, g + m) - l + 1)) AS s FROM lines WHERE least(n, g + m) - greatest(0, g) >= l),
found AS (SELECT t.doc_id, t.text, t.s, t.l, t.item_id FROM tries t JOIN same a ON a.doc_id IS NOT DISTINCT FROM t.doc_id AND a.text = t.text
  AND a.item_id IS NOT DISTINCT FROM t.item_id AND a.g = t.g AND a.m = t.m AND a.i BETWEEN t.s AND t.s + t.l - 1
  GROUP BY t.doc_id, t.text, t.s, t.l, t.e, t.item_id, t.g HAVING count(*) >= t.l - t.e),
inside AS (SELECT DISTINCT doc_id, text, unnest(range(s, s + l)) AS p FROM found),
widths AS (SELECT doc_id, text, count(*) AS covered FROM inside GROUP BY doc_id, text)
SELECT f.doc_id, min(f.item_id) AS item_id, min(f.s) AS first_token, max(f.s + f.l) - 1 AS last_token, any_value(c.covered) AS covered
FROM found f JOIN widths c ON c.doc_id IS NOT DISTINCT FROM f.doc_id AND c.text = f.text GROUP BY f.doc_id, f.text
"""
