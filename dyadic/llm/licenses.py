"""License notices in texts: exact phrases, and short notices found in spite of small edits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm.common import fresh

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short notices: (words that must stand as they are, words in which edits are borne, edits at most, label). Only first
# words of three letters must stand, since one edit makes another word of them.
NOTICES = (
    ("gnu ", "general public license", 2, "gpl"),
    ("gnu ", "lesser general public license", 3, "lgpl"),
    ("gnu ", "affero general public license", 3, "agpl"),
    ("", "apache license", 2, "apache"),
    ("", "licensed under the apache license version", 3, "apache"),
    ("mit ", "license", 1, "mit"),
    ("", "permission is hereby granted free of charge to any person", 5, "mit"),
    ("", "redistribution and use in source and binary forms", 4, "bsd"),
    ("bsd ", "license", 1, "bsd"),
    ("", "mozilla public license", 2, "mpl"),
    ("", "creative commons attribution", 3, "cc-by"),
    ("", "free and unencumbered software released into the public domain", 5, "unlicense"),
)
# What is no word character here: ASCII but for digits and letters. A-Z are lower-cased.
_CLEAN = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SPAN = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType()),
    T.StructField("edits", T.IntegerType()), T.StructField("length", T.IntegerType()),
])


@cache
def _automaton() -> ahocorasick.Automaton:
    """Seeds of all notices. Cut into edits + 1 pieces, a notice within its edits keeps one piece whole."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    for n, (fixed, loose, edits, _) in enumerate(NOTICES):
        step = len(loose) / (edits + 1)
        for i in range(edits + 1):
            a, b = round(i * step), round((i + 1) * step)
            seeds.setdefault(loose[a:b], []).append((n, len(fixed) + a))
    out = ahocorasick.Automaton()
    for seed, where in seeds.items():
        out.add_word(seed, (len(seed), where))
    out.make_automaton()
    return out


@cache
def _pattern(n: int) -> regex.Pattern:
    fixed, loose, edits, _ = NOTICES[n]
    return regex.compile(rf"(?b)(?<= ){fixed}(?:{loose}){{e<={edits}}}(?= )")


def scan(text: str | None) -> tuple[int, list[tuple[str, int, int, int, int]]]:
    """Number of words of a text, and its notices: (label, first word, words, edits, length of the notice).

    Words are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased. Every place of a base phrase is
    given with 0 edits. A fuzzy notice is located by a seed, verified around it with bounded errors, and left out where
    it covers a base phrase of its label or a notice already found.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()
    if not words:
        return 0, []
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    found = []
    for phrase, label in PHRASES.items():
        at = joined.find(f" {phrase} ")
        while at >= 0:
            found.append((label, joined.count(" ", 0, at), phrase.count(" ") + 1, 0, len(phrase)))
            at = joined.find(f" {phrase} ", at + 1)
    places = set()
    for end, (length, where) in _automaton().iter(joined):
        for n, offset in where:
            places.add((n, end - length + 1 - offset))
    done: dict[int, int] = {}
    for n, start in sorted(places):
        fixed, loose, edits, label = NOTICES[n]
        if start < done.get(n, -1):
            continue
        # Edits before the seed may shift the notice's start by as many characters.
        lo, hi = max(0, start - edits - 1), start + len(fixed) + len(loose) + edits + 1
        if joined.find(fixed, lo, hi) < 0:
            continue
        m = _pattern(n).search(joined, lo, min(len(joined), hi))
        if not m:
            continue
        done[n] = m.end()
        first, count = joined.count(" ", 0, m.start()) - 1, joined.count(" ", m.start(), m.end()) + 1
        if not any(f[0] == label and f[1] < first + count and first < f[1] + f[2] for f in found):
            found.append((label, first, count, sum(m.fuzzy_counts), len(fixed) + len(loose)))
    return len(words), sorted(found, key=lambda f: (f[1], f[0], f[3]))


@F.pandas_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))]))
def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = SPAN.names
    for texts in batches:
        rows = [scan(t) for t in texts]
        yield pd.DataFrame({"n_words": [r[0] for r in rows], "spans": [[dict(zip(names, s)) for s in r[1]] for r in rows]})


def license_scan(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with `n_words` and `spans`, the notices in the whole text by place.

    A null or empty text has no words and no spans. Every row is scanned by itself, repeated ones too; other columns pass
    through, but for ones named like the two new columns, which are replaced. A base phrase counts at every place, also where places share words.
    """
    (found,) = fresh(docs, "_found")
    out = docs.withColumn(found, _scan("text"))
    return out.withColumns({"n_words": F.col(found)["n_words"], "spans": F.col(found)["spans"]}).drop(found)


def license_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_fuzzy.

    `score` is 1 for an exact phrase, 1 - edits / length of the best fuzzy notice otherwise, and 0 without any.
    """
    found = license_scan(docs)
    # Exact spans of fuzzy notices that are no base phrase ("bsd license") have 0 edits too, so phrases are told by length.
    is_base = lambda s: (s.edits == 0) & F.array_contains(F.array(*[F.lit(f"{v}:{len(k)}") for k, v in PHRASES.items()]), F.concat_ws(":", s.label, s.length))
    base = F.filter("spans", is_base)
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    best = F.array_max(F.transform("spans", lambda s: 1.0 - s.edits / s.length))
    starts = F.transform("base", lambda s: s.first_word)
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined("base").alias("base_labels"), joined("spans").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"), (F.size("spans") - F.size("base")).cast("long").alias("n_fuzzy"))
