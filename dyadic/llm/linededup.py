"""Delete repeated runs of lines: winnowing over line hashes, matches extended both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadic.llm.common import fresh, word_count
from dyadic.session import materialize, small_side

# A run is deleted from RUN_LINES lines on; of fewer lines from SHORT_WORDS words on, of one line from LINE_WORDS words on.
RUN_LINES = 3
SHORT_WORDS = 8
LINE_WORDS = 6
BLANKS = " \t\r\x0b\x0c"
KEY = ["doc_id", "text_hash"]


def _sequence() -> Column:
    """The lines of `text` that are not blank, in order: line number, two independent hashes, and number of words."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(BLANKS)).alias("t")))
    lines = F.filter(lines, lambda x: x.t != "")
    return F.transform(lines, lambda x: F.struct(
        x.line.alias("line"), F.xxhash64(x.t).alias("h"), F.xxhash64(F.lit(1), x.t).alias("g"), word_count(x.t).alias("words")))


def _makes_run(part: Column, m: int, run_lines: int, run_words: int, line_words: int) -> Column:
    """True if a window of `m` lines is a run by itself."""
    if m == run_lines:
        return F.size(part) == m
    words = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x.words)
    return (F.size(part) == m) & (words >= (min(run_words, line_words) if m == 1 else run_words))


def _least(part: Column) -> Column:
    """Offset of the first least hash of a window."""
    hashes = F.transform(part, lambda x: x.h)
    return F.array_position(hashes, F.array_min(hashes)).cast("int") - 1


def _minima(rule: tuple[int, int, int]) -> Column:
    """Places in `seq` of the window minima: every window that makes a run selects its first least line hash."""
    def chosen(s: Column, m: int) -> Column:
        part = F.slice("seq", s + 1, m)
        return F.when(_makes_run(part, m, *rule), s + _least(part) if m > 1 else s)

    starts = F.when(F.size("seq") > 0, F.sequence(F.lit(0), F.size("seq") - 1)).otherwise(F.array().cast("array<int>"))
    each = F.transform(starts, lambda s: F.array(*[chosen(s, m) for m in range(1, rule[0] + 1)]))
    return F.array_distinct(F.filter(F.flatten(each), lambda x: x.isNotNull()))


def _extensions(rule: tuple[int, int, int]) -> Column:
    """The runs around a fingerprint: it is extended line by line both ways, as far as the window still selects it.

    `context` holds the lines around the fingerprint, which stands there at `own` and in the document at `p`.
    """
    found = []
    for before in range(rule[0]):
        for after in range(rule[0] - before):
            m = before + after + 1
            part = F.slice("context", F.greatest(F.col("own") - before, F.lit(0)) + 1, m)
            mine = (F.col("own") >= before) & _makes_run(part, m, *rule) & (_least(part) == before)
            found.append(F.when(mine, F.struct(
                (F.col("p") - before).alias("s"), F.lit(m).alias("m"), F.xxhash64(F.transform(part, lambda x: x.h)).alias("h"),
                F.xxhash64(F.lit(1), F.transform(part, lambda x: x.g)).alias("g"), F.transform(part, lambda x: x.line).alias("line"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def repeated_runs(docs: DataFrame, run_lines: int = RUN_LINES, run_words: int = SHORT_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_id, text_hash, start, lines): runs of lines of `docs` (doc_id, text) that occur earlier.

    Lines are compared without blanks at their ends; blank lines are passed over. A window is `run_lines` lines, or fewer
    with `run_words` words or more, or one line with `line_words` words or more. Every window selects its least line hash as
    a fingerprint, so two places of the same run hold the same fingerprint at the same offset. Only these places are kept,
    and only those whose fingerprint stands at another place too are joined; from there the match is extended line by line
    both ways. An extension is compared, by two hashes of 64 bits, with the first place of the same lines in the order
    (doc_id, text, line), never with every other place. Later places are deleted; those that touch make one run, so runs of
    any length are whole.
    """
    rule, reach = (run_lines, run_words, line_words), run_lines - 1
    base = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), _sequence().alias("seq"))
    places = base.withColumn("places", _minima(rule))
    # Hashes repeat exactly, so reading the texts twice is safe and cheaper than storing every fingerprint with its context.
    marks = places.select(F.explode(F.transform("places", lambda p: F.get("seq", p)["h"])).alias("mark"))
    marks = small_side(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark"))
    around = F.transform("places", lambda p: F.struct(
        p.alias("p"), F.least(p, F.lit(reach)).alias("own"), F.get("seq", p)["h"].alias("mark"),
        F.slice("seq", F.greatest(p - reach, F.lit(0)) + 1, F.least(p, F.lit(reach)) + run_lines).alias("context")))
    at = places.select(*KEY, F.explode(around).alias("w")).select(*KEY, "w.*")
    seen = at.join(marks, "mark", "left_semi").select(*KEY, F.explode(_extensions(rule)).alias("w"))
    seen = materialize(seen.select(*KEY, "w.*"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), *KEY, F.col("s"))
    first = seen.groupBy("m", "h", "g").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    first = small_side(first.filter("first <> last").select("m", "h", "g", "first"))
    later = seen.join(first, ["m", "h", "g"]).filter(order != F.col("first"))
    gone = later.select(*KEY, F.explode("line").alias("line")).distinct()
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("line"))
    return gone.withColumn("_run", F.col("line") - place).groupBy(*KEY, "_run").agg(
        F.min("line").alias("start"), F.count("*").cast("int").alias("lines")).drop("_run")


def drop_repeated_lines(docs: DataFrame, run_lines: int = RUN_LINES, run_words: int = SHORT_WORDS,
                        line_words: int = LINE_WORDS) -> DataFrame:
    """`docs` with `text` rid of repeated runs, and the columns `n_lines` (not blank, before) and `n_removed`.

    The first occurrence of a run in the order (doc_id, text, line) stays, a null doc_id being last. Null texts stay null
    and empty ones empty, with no lines. Rows equal in doc_id and text are one document: they get the same result. Other
    columns pass through unchanged, but for ones named like the two new columns, which are replaced. An empty table gives an empty result.
    """
    runs = repeated_runs(docs, run_lines, run_words, line_words)
    runs = runs.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("start", "lines"))).alias("_runs"), F.sum("lines").alias("_removed"))
    doc, text, cut, gone, lines = fresh(docs, "_id", "_hash", "_runs", "_removed", "_lines")
    side = small_side(runs.toDF(doc, text, cut, gone))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text))
    joined = docs.join(side, same, "left").withColumn(lines, F.split("text", "\n"))

    def kept(i: Column) -> Column:
        before, after = F.get(cut, i - 1), F.get(cut, i)
        start = F.coalesce(before["start"] + before["lines"], F.lit(0))
        return F.slice(lines, start + 1, F.coalesce(after["start"], F.size(lines)) - start)

    rest = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), kept)), "\n")
    count = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return joined.withColumns({
        "text": F.when(F.col(cut).isNull(), F.col("text")).otherwise(rest),
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(count).cast("long"),
        "n_removed": F.coalesce(gone, F.lit(0)).cast("long"),
    }).drop(doc, text, cut, gone, lines)


_TRIMMED = "trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
OP2_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM d),
lines AS (SELECT doc_id, text, unnest(l) AS line, unnest(range(len(l))) AS i FROM cut),
seq AS (SELECT doc_id, text, i, {_TRIMMED} AS t, row_number() OVER p - 1 AS s,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines WHERE {_TRIMMED} <> '' WINDOW p AS (PARTITION BY doc_id, text ORDER BY i)),
steps AS (SELECT *, lead(t) OVER p AS t2, lead(t, 2) OVER p AS t3, lead(words) OVER p AS words2 FROM seq WINDOW p AS (PARTITION BY doc_id, text ORDER BY i)),
wins AS (SELECT doc_id, text, s, 1 AS m, t AS content FROM steps WHERE words >= {LINE_WORDS}
  UNION ALL SELECT doc_id, text, s, 2, t || chr(10) || t2 FROM steps WHERE t2 IS NOT NULL AND words + words2 >= {SHORT_WORDS}
  UNION ALL SELECT doc_id, text, s, 3, t || chr(10) || t2 || chr(10) || t3 FROM steps WHERE t3 IS NOT NULL),
later AS (SELECT doc_id, text, s, m FROM wins QUALIFY row_number() OVER (PARTITION BY m, content ORDER BY doc_id NULLS LAST, text, s) > 1),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(s, s + m)) AS s FROM later),
marked AS (SELECT l.doc_id, l.text, l.i, l.line, q.s IS NOT NULL AS filled, g.s IS NOT NULL AS gone FROM lines l
  LEFT JOIN seq q ON l.doc_id IS NOT DISTINCT FROM q.doc_id AND l.text = q.text AND l.i = q.i
  LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND q.s = g.s),
made AS (SELECT doc_id, text, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept,
  count(*) FILTER (filled) AS n_lines, count(*) FILTER (gone) AS n_removed FROM marked GROUP BY doc_id, text)
SELECT o.doc_id, m.kept AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents o LEFT JOIN made m ON o.doc_id IS NOT DISTINCT FROM m.doc_id AND o.text = m.text
"""
