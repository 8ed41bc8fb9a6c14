import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dyadic.llm import lmscore
from dyadic.llm.lmscore import score_texts, tokens_of

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def plain(rows, order, prior):
    """The contract by counters; the model with counts quantised as the filter would hold them, but without chance hits."""
    counts = Counter()
    for doc, text in rows:
        if not held_out(doc):
            t = split(text)
            counts.update(tuple(t[i - k + 1:i + 1]) for i in range(len(t)) for k in range(1, min(order, i + 1) + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)

    def about(gram):
        q = counts[gram].bit_length()
        return (3 * 2 ** (q - 1) - 1) / 2 if q else 0.0

    def prob(gram):
        if len(gram) == 1:
            return (min(about(gram), n) + 1) / (n + v + 1)
        have = about(gram[:-1])
        return (min(about(gram), have) + prior * prob(gram[1:])) / (have + prior)

    out = []
    for doc, text in rows:
        t = split(text)
        known = sum((w,) in counts for w in t)
        base = sum(math.log10((counts[(w,)] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(prob(tuple(t[max(0, i - order + 1):i + 1]))) for i in range(len(t)))
        out.append((doc, held_out(doc), len(t), known, n, base, score))
    return out


def got(df):
    assert df.columns == COLUMNS
    return [tuple(r) for r in df.collect()]


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 6))


def same(have, want, score=1e-9):
    assert len(have) == len(want)
    for a, b in zip(sorted(have, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(a[6], b[6], rel_tol=score, abs_tol=score), (a, b)


@pytest.fixture
def rows(rnd, words):
    some = words[:120]
    rows = [(i, " ".join(rnd.choice(some) if rnd.random() < 0.7 else some[0] for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    odd = [(200, None), (201, ""), (202, " \t\n\x0b\x0c\r "), (203, "É É x A\x1cB"), (None, "some WORDS here"), (None, None), (7, "other text"),
           (7, "other text"), (7, "other text"), (204, "Hot " * 30_000), (205, "x" * 100_000)]
    return rows + odd


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("heavy", [1, 1 << 18])
def test_equals_counters(spark, documents, rows, order, heavy, monkeypatch):
    """With so many bits that chance hits do not show, and with exact counts broadcast or joined."""
    monkeypatch.setattr(lmscore, "BITS", 400)
    same(got(score_texts(documents(rows), order, 5.0, heavy_words=heavy)), plain(rows, order, 5.0))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_shuffled_filter_gives_the_same(spark, documents, rows, order):
    broadcast, shuffled = (got(score_texts(documents(rows), order, filter_bytes=b)) for b in (1 << 30, 0))
    same(shuffled, broadcast)


def test_empty_tables(spark, documents):
    assert got(score_texts(documents([]))) == []
    fold = next(i for i in range(100) if held_out(i))
    same(got(score_texts(documents([(fold, "a b")]))), [(fold, True, 3, 0, 0, 0.0, 0.0)])
    same(got(score_texts(documents([(fold, "a b")]), filter_bytes=0)), [(fold, True, 3, 0, 0, 0.0, 0.0)])


def test_levels_are_never_too_low(rnd):
    hashes = np.array([rnd.getrandbits(64) for _ in range(20_000)], np.uint64)
    counts = np.array([rnd.choice([1, 1, 1, 2, 3, 4, 7, 8, 1000, 2**40 - 1, 2**40]) for _ in hashes])
    found = lmscore.probe(lmscore.fill_part(hashes, counts), 0, hashes)
    true = np.array([int(c).bit_length() for c in counts])
    assert (found >= true).all() and (found == true).mean() > 0.9
    strange = np.array([rnd.getrandbits(64) for _ in range(20_000)], np.uint64)
    assert (lmscore.probe(lmscore.fill_part(hashes, counts), 0, strange) > 0).mean() < 0.05


def test_tokens(rnd):
    texts = [None, "", "A b", "  lead\x0b\x0c trail\r\n", "a\x1cb c", "É e"] + [
        "".join(rnd.choice("aB \t\n\x0b\x0c\r\x1c é😀") for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    for start in (0, 4, 150):
        t = tokens_of(pa.array(texts, pa.string()).slice(start))
        words = t.words.to_pylist()
        have = [[] for _ in texts[start:]]
        for c, d, p in zip(t.codes, t.doc, t.place):
            assert p == len(have[d])
            have[d].append(words[c])
        assert have == [split(x) for x in texts[start:]]


def test_model_beats_single_words(spark):
    """On held-out rows of the test table the model is far better than add-one single words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = score_texts(docs).filter("held_out").selectExpr("sum(base_score) / sum(n_tokens) b", "sum(score) / sum(n_tokens) s").first()
    assert out.s > out.b + 0.05


def test_slices(monkeypatch, rnd):
    """Whole rows in order, none lost, a slice of about the bytes set or one longer text."""
    monkeypatch.setattr(lmscore, "SLICE", 100)
    texts = [rnd.choice([None, "", "ab " * rnd.randint(1, 80)]) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    cut = [s.column("text") for s in lmscore._slices(iter([batch]))]
    assert [t for c in cut for t in c.to_pylist()] == texts and len(cut) > 20
    words = Counter(w for c in cut for t in [tokens_of(c)] for w in np.array(t.words.to_pylist(), object)[t.codes])
    assert words == Counter(w for t in texts for w in split(t))


def test_stored_tables_follow_the_ngrams_not_the_tokens(spark, documents, rnd, words, monkeypatch):
    """What is stored between the passes takes a few bytes for each token, also if no filter may be broadcast."""
    stored, real = [], lmscore.materialize

    def spy(df):
        out = real(df)
        stored.append(out.toArrow().nbytes)
        return out

    monkeypatch.setattr(lmscore, "materialize", spy)
    docs = documents([(i, " ".join(rnd.choice(words) for _ in range(200))) for i in range(400)])
    tokens = sum(r[2] for r in got(score_texts(docs, filter_bytes=0)))
    assert stored and sum(stored) < 8 * tokens


def test_parts_do_not_change_exact_counts(spark, documents, rows, monkeypatch):
    monkeypatch.setattr(lmscore, "BITS", 400)
    monkeypatch.setattr(lmscore, "PART_TEXT", 3000)
    monkeypatch.setattr(lmscore, "SLICE", 5000)
    same(got(score_texts(documents(rows + [(300 + i, "Hot some") for i in range(400)]), 3, 5.0)),
         plain(rows + [(300 + i, "Hot some") for i in range(400)], 3, 5.0))
