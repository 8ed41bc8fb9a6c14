import itertools
import zlib

import numpy as np
import pytest

from dyadic.llm import toxicity

INSULTS = ["snargle", "blockhead", "worthless", "dimwit"]
SCHEMA = "doc_id long, quality int, toxic int"


def brute_kernel(a, b, order=toxicity.ORDER, decay=toxicity.DECAY):
    a, b = f"\x01{a}\x02", f"\x01{b}\x02"
    total = 0.0
    for i in itertools.combinations(range(len(a)), order):
        for j in itertools.combinations(range(len(b)), order):
            if [a[k] for k in i] == [b[k] for k in j]:
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_equals_enumeration(rnd):
    pairs = [("".join(rnd.choice("abc") for _ in range(rnd.randint(3, 6))), "".join(rnd.choice("abc") for _ in range(rnd.randint(3, 6)))) for _ in range(25)]
    got = toxicity.kernel(toxicity._codes([p[0] for p in pairs], -1), toxicity._codes([p[1] for p in pairs], -2))
    assert got == pytest.approx([brute_kernel(*p) for p in pairs], rel=1e-4)


def test_gaps_and_inserted_letters_stay_close():
    side = toxicity.Landmarks(["worthless"])
    words = ["worthless", "worthlless", "woorthless", "worthxless", "harvester", "weather", "less"]
    r, _, k = side.similarities(words)
    near = dict(zip(r.tolist(), k))
    assert near[0] == pytest.approx(1, abs=1e-4) and all(near[i] > 0.45 for i in (1, 2, 3)) and all(near.get(i, 0) < 0.4 for i in (4, 5, 6))
    assert toxicity.sentences("You i d i o t! Bye")[0] == "you idiot"
    assert toxicity.clean("id.i-ot,") == "idiot"
    long = "x" * 1000 + "worthless" + "y" * 1000
    assert all(len(p) <= toxicity.PIECE for p in toxicity.pieces(long)) and set("".join(toxicity.pieces(long))) == set(long)


def corpus(rnd, words, n=500):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        t = [[rnd.choice(words) for _ in range(8)] for _ in range(rnd.randint(1, 6))]
        for _ in range(3 if bad else 0):
            rnd.choice(t).insert(2, rnd.choice(INSULTS))
        rows.append((i, ". ".join(" ".join(s) for s in t)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, documents, words, rnd):
    rows, labels = corpus(rnd, words)
    clean = " ".join(rnd.choice(words) for _ in range(30))
    extra = [(9000, None), (9001, ""), (None, clean), rows[0], (9002, f"{clean} wor-thlless dimmwit bl0ckhead d i m w i t"), (9003, clean + " " + "word " * 50_000)]
    lab = spark.createDataFrame(labels + [labels[0], (None, 1, 1), (3, 1, None), (7, 1, 9)], SCHEMA)
    got = toxicity.score_toxicity(documents(rows + extra), lab).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    by_id = {r.doc_id: r.predicted for r in got}
    assert by_id[9002] == 1 and by_id[9000] == by_id[9001] == by_id[9003] == by_id[None] == 0


def test_machine_is_at_its_optimum(rnd):
    """The gradient of the penalised squared hinge loss is zero."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    y = (x @ rng.normal(size=6) + rng.normal(size=300) > 1).astype(int)
    for cost in toxicity.COSTS:
        w, b = toxicity.fit_svm(x, y, cost)
        s = np.where(y > 0, 1.0, -1.0)
        c = cost * np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y <= 0).mean())
        slack = np.maximum(1 - s * (x @ w + b), 0)
        assert np.abs(w - x.T @ (c * s * slack)).max() < 1e-8 * len(y)
        assert abs(1e-6 * b - (c * s * slack).sum()) < 1e-8 * len(y)


def test_features_give_the_kernel_back():
    """Products of the landmarks' features are their similarities; the floor of small eigenvalues is not reached here."""
    side = toxicity.Landmarks(["snargle", "blockhead", "worthless", "dimwit"])
    r, c, k = side.similarities(side.words)
    gram = np.zeros((4, 4))
    gram[r, c] = k
    made = gram @ toxicity.nystroem(side)
    assert np.allclose(made @ made.T, (gram + gram.T) / 2, atol=1e-6)


def test_cost_is_chosen_on_parts_left_out():
    """Of two costs the one with fewer errors on rows not fitted, whatever the held-out fold holds; ties take the first."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=200), rng.normal(size=(200, 60))])
    y, part = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(int), np.arange(200) % 3

    def errors(cost):
        wrong = np.zeros(200, bool)
        for k in range(3):
            w, b = toxicity.fit_svm(x[part != k], y[part != k], cost)
            wrong[part == k] = (x[part == k] @ w + b > 0) != y[part == k]
        return wrong[y == 0].mean() + wrong[y == 1].mean()

    costs = (10.0, 1e-3, 0.05)
    assert toxicity.choose_cost(x, y, part, costs) == min(costs, key=errors)
    assert toxicity.choose_cost(x, y, part, (0.1, 0.1)) == 0.1


def test_one_class_none_and_held_out_labels(spark, documents, words, rnd):
    rows, labels = corpus(rnd, words, 120)
    none = spark.createDataFrame([], SCHEMA)
    assert {r.score for r in toxicity.score_toxicity(documents(rows), none).collect()} == {0.5}
    only = spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], SCHEMA)
    assert {r.score for r in toxicity.score_toxicity(documents(rows), only).collect()} == {0.0}
    lab = spark.createDataFrame(labels, SCHEMA)
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], SCHEMA)
    a, b = (sorted(map(tuple, toxicity.score_toxicity(documents(rows), x).collect())) for x in (lab, flipped))
    assert [r[2] for r in a] == pytest.approx([r[2] for r in b], abs=1e-6)
    assert toxicity.score_toxicity(documents([]), lab).collect() == []
