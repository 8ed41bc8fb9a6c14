import hashlib
import zlib
from collections import defaultdict

import pytest

from dyadic.llm import tries
from dyadic.llm.common import hot_join
from dyadic.llm.contraction import subtree_sums
from dyadic.llm.tries import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv long, pos long, node long, k1 string, parent string, h int, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "k", "p", 4, "d") for r in rows], SCHEMA)


def plain(rows):
    """The trie by dictionaries and recursion-free walks over every prefix."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_random_conversations(spark, rnd):
    rows = []
    for c in [*range(40), 1003, 1007, 5001]:
        for t in range(rnd.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "ho", "", None, "é" * 3])))
    assert got(prefix_trie(table(spark, rows))) == plain(rows)


def test_edges(spark):
    """Null ids, turns, roles and texts; equal turn numbers; repeated rows; a turnless conversation; a long text."""
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "b", "x"), (7, 3, "b", "x"), (7, 3, "a", "y"), (7, 3, "a", "y"),
            (0, 1, "user", "z" * 100_000), (0, 0, "user", ""), (1, 0, "user", "q"), (2, 0, "user", "q"), (3, 9, "user", None)]
    assert got(prefix_trie(table(spark, rows))) == plain(rows)
    assert any(len(p) for p in plain(rows))


def test_empty(spark):
    assert got(prefix_trie(table(spark, []))) == []
    assert got(prefix_trie(table(spark, [(None, 1, "user", "x")]))) == []


def test_hot_groups(spark, monkeypatch):
    """Thousands of equal conversations, one conversation of many stretches, ids spread over many digest stretches."""
    monkeypatch.setattr(tries, "STRETCH_BITS", 3)
    monkeypatch.setattr(tries, "ID_BITS", 4)
    rows = [(5 * c, t, "user", f"t{t}") for c in range(400) for t in range(3)]
    rows += [(100_000, t, "user", f"long {t % 7}") for t in range(700)]
    assert got(prefix_trie(table(spark, rows))) == plain(rows)


@pytest.mark.parametrize("shape", ["path", "star", "random", "caterpillar", "forest"])
def test_subtree_sums(spark, rnd, shape):
    n = 200
    parent = {
        "path": [None, *range(n - 1)], "star": [None] + [0] * (n - 1), "random": [None] + [rnd.randrange(i) for i in range(1, n)],
        "caterpillar": [None] + [i - 1 if i % 2 else max(0, i - 2) for i in range(1, n)],
        "forest": [None if i % 17 == 0 else rnd.randrange(i - i % 17, i) for i in range(n)],
    }[shape]
    weight = [rnd.randint(-5, 50) for _ in range(n)]
    total, count = weight[:], [1] * n
    for i in reversed(range(n)):
        if parent[i] is not None:
            total[parent[i]] += total[i]
            count[parent[i]] += count[i]
    tree = spark.createDataFrame([(i, parent[i], weight[i], 1) for i in range(n)], "node long, parent long, w long, n long")
    assert sorted(tuple(r) for r in subtree_sums(tree, ["w", "n"]).collect()) == [(i, total[i], count[i]) for i in range(n)]


def test_hot_join(spark):
    rows = spark.createDataFrame([(i, 1 if i % 2 else i) for i in range(1000)] + [(-1, None)], "i int, k int")
    side = spark.createDataFrame([(k, k * 10) for k in range(0, 1000, 3)] + [(1, 10)], "k int, v int")
    for parts in (1, 10, 5000):
        want = sorted((i, 10 if i % 2 else 10 * i if i % 3 == 0 else None) for i in range(1000)) + [(-1, None)]
        out = sorted(((r.i, r.v) for r in hot_join(rows, side, "k", parts).collect()))
        assert out == sorted(want)
