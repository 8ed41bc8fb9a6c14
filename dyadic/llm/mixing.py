"""Mix sources to target weights on a low-discrepancy schedule of equal-token blocks.

Every source's documents are laid end to end in a hashed order and cut into blocks of equally many words. Slot `i` of the
mix maps the golden-ratio point frac(i * phi) through the cumulative weights to a source; the rank of a slot among the
slots of its source names the block it takes. Every stretch of the mix thus holds the sources close to their weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadic.llm.common import running_total, word_count
from dyadic.session import materialize, small_side

PHI = 0.6180339887498949
BLOCK_WORDS = 1024
# A small source is cut finer than BLOCK_WORDS, into this many blocks at least, to come near its target.
LEAST_BLOCKS = 256
SHARE = 1.5
REPEATS = 2
SEED = 17
# Documents that one task sorts at a time, and slots that one task ranks at a time.
STRETCH = 4096
SLOT_STRETCH = 65536
# Rows that are alike and that one piece of a sequence stands for.
COPIES = 4096


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw): words of every row and the hash that shuffles it. A null text has size 0."""
    draw = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per source: rank `s`, `n` documents, `source_size`, `weight`, `target`, block `width`, `blocks`, `slots`.

    Sources take the weights in turn by code point, null last. Together they get `share` of all words; a target stops at
    `repeats` times its source and the excess goes to the others by weight. Since the capped sources are those with the
    least cap per weight, one pass over the sources in that order finds the level at which the rest is filled.
    The table has one row per source, so its windows run over a short list.
    """
    src = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("s", F.row_number().over(rank) - 1)
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("s") % len(weights) + 1))
    src = src.withColumn("cap", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    earlier, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    src = src.withColumns({
        "_place": F.row_number().over(order),
        "_level": (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))),
    })
    first = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.col("_place"))).over(everything)
    src = src.withColumn("_first", first)
    level = F.max(F.when(F.col("_place") == F.col("_first"), F.col("_level"))).over(everything)
    src = src.withColumn("target", F.when(F.col("_place") < F.col("_first"), F.col("cap").cast("double"))
                         .otherwise(F.coalesce(level * F.col("weight"), F.col("cap").cast("double"))))
    width = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / LEAST_BLOCKS)))
    src = src.withColumn("width", width.cast("long"))
    src = src.withColumn("blocks", F.ceil(F.col("source_size") / F.col("width")).cast("long"))
    passes = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(repeats)).cast("long")
    part = F.floor((F.col("target") - passes * F.col("source_size")) / F.col("width") + 0.5)
    src = src.withColumn("slots", F.least(passes * F.col("blocks") + part, repeats * F.col("blocks")).cast("long"))
    return src.select("source", "s", "n", "source_size", "weight", "target", "width", "blocks", "slots")


def slot_schedule(sources: DataFrame) -> DataFrame:
    """(slot, s, pass, block): which block of which source every slot of the mix takes.

    The points and the cumulative weights meet in equal cells of the unit interval, an even join key. A source takes its
    first `slots` ranks; ranks that the points leave open (a few per source, by their discrepancy) close the schedule.
    """
    spark = sources.sparkSession
    total, count = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    cells = max(1024, count)
    upto = F.sum("slots").over(Window.orderBy("s"))
    spans = sources.filter("slots > 0").withColumn("_upto", upto).withColumns({
        "_lo": (F.col("_upto") - F.col("slots")) / F.lit(max(total, 1)), "_hi": F.col("_upto") / F.lit(max(total, 1)),
    })
    last = F.least(F.lit(cells - 1), F.floor(F.col("_hi") * cells))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("_lo") * cells), last)))
    turn = F.col("id") * F.lit(PHI)
    points = spark.range(total).select(F.col("id").alias("slot"), (turn - F.floor(turn)).alias("_u"))
    points = points.withColumn("cell", F.least(F.lit(cells - 1), F.floor(F.col("_u") * cells)))
    drawn = points.join(spans.select("cell", "_lo", "_hi", "s"), "cell").filter("_u >= _lo and _u < _hi").select("slot", "s")
    drawn = drawn.withColumn("_stretch", F.floor(F.col("slot") / SLOT_STRETCH))
    ranked = running_total(drawn, ["s"], "_stretch", ["slot"], F.lit(1), "rank").select("slot", "s", "rank")
    got = ranked.groupBy("s").agg(F.count("*").alias("_got"))
    short = sources.join(got, "s", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).filter("_got < slots")
    closing = short.select(F.lit(total).cast("long").alias("slot"), "s", F.explode(F.sequence("_got", F.col("slots") - 1)).alias("rank"))
    ranks = ranked.unionByName(closing).join(small_side(sources.select("s", "blocks", "slots")), "s").filter("rank < slots")
    return ranks.select("slot", "s", F.floor(F.col("rank") / F.col("blocks")).alias("pass"), (F.col("rank") % F.col("blocks")).alias("block"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """The mix of `docs` (doc_id, text, source) and the sizes it rests on.

    Returns `laid`, one row per document (doc_id, source, size, source_size, target, s, start), and `taken`, one row per
    piece of a document in a slot (slot, s, pass, block, start, from_word, words): the words [from_word, from_word + words)
    of the document of source `s` that starts at word `start` of its source's stream.

    Null texts and texts without words have size 0 and are in no piece. A null source is a source of its own. Rows with
    equal ids are separate documents; rows equal in id, source and size are interchangeable, so they are counted first and
    laid out from their count, and no task sorts them. An empty table gives empty results. Other columns are not read.
    """
    sizes = materialize(document_sizes(docs))
    sources = materialize(source_targets(sizes, weights, share, repeats))
    lookup = small_side(sources.select(F.col("source").alias("_source"), "s", "n", "source_size", "target", "width"))
    alike = sizes.groupBy("source", "doc_id", "size", "draw").agg(F.count("*").alias("copies"))
    placed = alike.join(lookup, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # The hash prefix cuts a source into even stretches in the order of the hash itself.
    prefix = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    placed = placed.withColumn("_stretch", F.floor(prefix * F.ceil(F.col("n") / STRETCH)))
    laid = running_total(placed, ["s"], "_stretch", ["draw", "doc_id", "size"], F.col("size") * F.col("copies"), "start")
    run = laid.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
    copy = F.explode(F.sequence(F.col("_run") * COPIES, F.least(F.col("copies"), (F.col("_run") + 1) * COPIES) - 1))
    laid = run.withColumn("_copy", copy).withColumn("start", F.col("start") + F.col("_copy") * F.col("size"))
    laid = materialize(laid.select("doc_id", "source", "size", "source_size", "target", "s", "start", "width"))
    end = F.col("start") + F.col("size")
    pieces = laid.filter("size > 0").select(
        "s", "start", "size", "width",
        F.explode(F.sequence(F.floor(F.col("start") / F.col("width")), F.floor((end - 1) / F.col("width")))).alias("block"),
    )
    begin = F.greatest(F.col("start"), F.col("block") * F.col("width"))
    pieces = pieces.select(
        "s", "block", "start", (begin - F.col("start")).alias("from_word"),
        (F.least(end, (F.col("block") + 1) * F.col("width")) - begin).alias("words"),
    )
    return laid.drop("width"), slot_schedule(sources).join(pieces, ["s", "block"])


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of `docs`; `taken` counts repeats."""
    laid, taken = mix(docs, **options)
    per_document = taken.groupBy("s", "start").agg(F.sum("words").alias("_taken"))
    # Only rows with words are in a piece, and among these a source's `start` is unique.
    out = laid.withColumn("_key", F.when(F.col("size") > 0, F.col("start"))).join(
        per_document.withColumnRenamed("start", "_key"), ["s", "_key"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


OP1_SQL = f"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM src),
weighed AS (SELECT *, [3, 1, 2][s % 3 + 1] AS weight, 2 * source_size AS cap FROM ranked),
levels AS (SELECT *, row_number() OVER o AS place,
  (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / weight, s)),
firsts AS (SELECT *, min(CASE WHEN level * weight <= cap THEN place END) OVER () AS first FROM levels),
targets AS (SELECT *, CASE WHEN place < first THEN cap::DOUBLE ELSE
  coalesce(max(CASE WHEN place = first THEN level END) OVER () * weight, cap::DOUBLE) END AS target FROM firsts),
cut AS (SELECT source, s, source_size, target, greatest(1, least({BLOCK_WORDS}, source_size // {LEAST_BLOCKS})) AS width FROM targets),
counted AS (SELECT *, CAST(ceil(source_size::DOUBLE / width) AS BIGINT) AS blocks, least(floor(target / greatest(source_size, 1)), 2) AS passes FROM cut),
sources AS (SELECT *, CAST(least(passes * blocks + floor((target - passes * source_size) / width + 0.5), 2 * blocks) AS BIGINT) AS slots FROM counted),
spans AS (SELECT s, (upto - slots)::DOUBLE / total AS lo, upto::DOUBLE / total AS hi FROM
  (SELECT *, sum(slots) OVER (ORDER BY s) AS upto, sum(slots) OVER () AS total FROM sources WHERE slots > 0)),
points AS (SELECT i, i * {PHI}::DOUBLE - floor(i * {PHI}::DOUBLE) AS u FROM (SELECT unnest(range(0, (SELECT CAST(sum(slots) AS BIGINT) FROM sources))) AS i)),
drawn AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS rank FROM points JOIN spans ON u >= lo AND u < hi),
got AS (SELECT s, count(*) AS n FROM drawn GROUP BY s),
all_ranks AS (SELECT s, rank FROM drawn UNION ALL SELECT s, unnest(range(coalesce(n, 0), slots)) FROM sources LEFT JOIN got USING (s) WHERE coalesce(n, 0) < slots),
times AS (SELECT s, rank % blocks AS block, count(*) AS times FROM all_ranks JOIN sources USING (s) WHERE rank < slots GROUP BY ALL),
laid AS (SELECT doc_id, z.source, size, source_size, target, s, width, row_number() OVER () AS row,
  coalesce(sum(size) OVER (PARTITION BY s ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sizes z JOIN sources q ON z.source IS NOT DISTINCT FROM q.source),
pieces AS (SELECT *, CAST(unnest(range(CAST(start // width AS BIGINT), CAST((start + size - 1) // width + 1 AS BIGINT))) AS BIGINT) AS block FROM laid WHERE size > 0),
taken AS (SELECT row, sum(times * (least(start + size, (block + 1) * width) - greatest(start, block * width))) AS taken FROM pieces JOIN times USING (s, block) GROUP BY row)
SELECT doc_id, source, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM laid LEFT JOIN taken USING (row)
"""
