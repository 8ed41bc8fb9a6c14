import random

import pytest

from dyadic.llm import mixing


def words_in(text):
    return 0 if text is None else len(text.replace("\x0b", " ").replace("\x0c", " ").encode().split())


def reshared(sizes, weights, share=1.5, repeats=2):
    """Targets by repeated resharing of what exceeds a cap."""
    total, target, full = share * sum(sizes), {}, set()
    while True:
        left = total - sum(repeats * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        w = sum(weights[i] for i in open_)
        target = {i: left * weights[i] / w for i in open_}
        over = [i for i in open_ if target[i] > repeats * sizes[i]]
        if not over:
            return [target[i] if i in target else repeats * sizes[i] for i in range(len(sizes))]
        full |= set(over)


@pytest.fixture
def corpus():
    r = random.Random(1)
    rows = []
    for i in range(900):
        source = r.choice(["a"] * 9 + ["b", "c", "Z", "é", None])
        rows.append((i, " ".join(["w"] * r.choice([0, 1, 3, 40, 400])), source))
    return rows + [(900, None, "a"), (901, "x \t\n y", "b"), (None, "no id", "c"), (5, "again here", "b"), (5, "again here", "b"), (950, "z " * 60_000, "a")]


def test_copies_are_laid_end_to_end(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(None, "a b c", "x")] * 100 + [(None, "a b", "x")] * 20 + [(1, "", "x"), (1, "", "x"), (2, "d", "x")]
    laid = [r for r in mixing.mix(documents(rows))[0].collect() if r["size"]]
    spans = sorted((r.start, r.start + r["size"]) for r in laid)
    assert len(laid) == 121 and spans[0][0] == 0 and spans[-1][1] == 341 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_targets_and_totals(spark, documents, corpus):
    out = mixing.taken_words(documents(corpus)).collect()
    assert len(out) == len(corpus)
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((d or -1, words_in(t)) for d, t, _ in corpus)
    names = sorted({s for _, _, s in corpus if s is not None}) + [None]
    sizes = [sum(words_in(t) for _, t, s in corpus if s == n) for n in names]
    want = reshared(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])
    for name, size, target in zip(names, sizes, want):
        rows = [r for r in out if r.source == name]
        assert {r.source_size for r in rows} == {size} and rows[0].target == pytest.approx(target, abs=1e-6)
        assert sum(r.taken for r in rows) == pytest.approx(target, abs=max(2, size / 200))
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    again = mixing.taken_words(documents(corpus[::-1]).repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_any_stretch_of_the_schedule_keeps_the_weights(spark, documents, corpus):
    sizes = mixing.document_sizes(documents(corpus))
    sources = mixing.source_targets(sizes)
    slots = mixing.slot_schedule(sources).collect()
    expected = {r.s: r.slots for r in sources.collect()}
    assert len(slots) == sum(expected.values())
    total, run = len(slots), len(slots) // 5
    for lo in range(0, total - run, run):
        part = [r.s for r in slots if lo <= r.slot < lo + run]
        for s, n in expected.items():
            assert abs(part.count(s) - n * run / total) <= 6


def test_pieces_do_not_overlap(spark, documents, corpus):
    laid, taken = mixing.mix(documents(corpus))
    seen = {}
    for r in taken.collect():
        for w in range(r.from_word, r.from_word + r.words):
            assert (r.s, r.start, w, r["pass"]) not in seen
            seen[r.s, r.start, w, r["pass"]] = r.slot
    assert len(seen) == sum(r.taken for r in mixing.taken_words(documents(corpus)).collect())


def test_empty_and_wordless(spark, documents):
    assert mixing.taken_words(documents([])).collect() == []
    got = mixing.taken_words(documents([(1, "", "a"), (2, None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
