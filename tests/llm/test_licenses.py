import re

import pytest

from dyadic.llm import licenses
from dyadic.llm.licenses import PHRASES


def brute(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i:i + phrase.count(" ") + 1] == phrase.split()]
    return len(words), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None), ",".join(sorted({p[1] for p in places}))


def test_base_columns_equal_brute_force(spark, documents, rnd):
    pieces = ["MIT", "License", "license,", "mit-license", "GNU", "General", "Public", "Apache", "cc", "BY", "cc-by", "é", "x{}y", "\x00", "word", "\n", "mit license mit license"]
    rows = [(i, " ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60)))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (None, "the mit license"), (1002, "a " * 200_000 + "CC BY"), (3, rows[3][1])]
    got = licenses.license_report(documents(rows)).collect()
    assert len(got) == len(rows)
    have = sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    assert have == sorted(repr((d, *brute(t))) for d, t in rows)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score == 1) >= (r.n_base > 0)


@pytest.mark.parametrize("text, label, edits", [
    ("under the GNU Genral Public Licence v3", "gpl", 2),
    ("the MIT licence.", "mit", 1),
    ("the Apache licens applies", "apache", 1),
    ("the BSD license", "bsd", 0),
    ("Permission is herby granted, free of charge, to any persn", "mit", 2),
    ("Creative Comons Attribution", "cc-by", 1),
    ("mozilla publik license", "mpl", 1),
    ("the Apahce License", "apache", 2), ("the Apach License", "apache", 1), ("Mozila Public License", "mpl", 1),
    ("Cretive Commons Atribution", "cc-by", 2),
])
def test_edits_are_borne(text, label, edits):
    _, found = licenses.scan(f"words before {text} words after")
    assert [(f[0], f[3]) for f in found] == [(label, edits)] and found[0][1] >= 1


@pytest.mark.parametrize("text", ["a summit license", "mit lice", "apache helicopter", "permission is granted", "gnu general store", ""])
def test_other_texts_are_left_alone(text):
    assert licenses.scan(text)[1] == []


def test_seeds_find_every_bounded_edit(rnd):
    """Whatever edits a notice bears within its bound, some seed of it stays whole."""
    for fixed, loose, edits, label in licenses.NOTICES:
        for _ in range(40):
            t = list(loose)
            for _ in range(edits):
                i = rnd.randrange(1, len(t) - 1)
                t[i:i + 1] = rnd.choice([[], [rnd.choice("xyz")], [t[i], rnd.choice("xyz")]])
            found = licenses.scan(f"aa {fixed}{''.join(t)} bb")[1]
            assert label in {f[0] for f in found} or "  " in "".join(t), "".join(t)


def test_spans_pass_columns_and_empty_tables(spark, documents):
    row = licenses.license_scan(documents([(1, "x mit license")])).first()
    assert row.spans[0].first_word == 1 and row.s == 7 and row.n_words == 3
    assert licenses.license_report(documents([])).collect() == []
