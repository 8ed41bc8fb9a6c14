import itertools

import xxhash

from dyadic.llm import simhash
from dyadic.llm.graph import connected_components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_roots(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_fingerprints(words, rnd):
    texts = [None, "", " \n", "One", "one Two", "A b C", "Été ÉTÉ x y z"]
    texts += [" ".join(rnd.choice(words).title() for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    for t in texts:
        assert simhash.simhash(t) % (1 << 64) == brute_print(t)


def test_masks_cover_every_three_bits():
    for level in (1, 2, 3):
        masks = [m % (1 << 64) for m in simhash.covering_masks(level)]
        assert len(masks) == 15 and min(m.bit_count() for m in masks) >= 30
        for bits in itertools.combinations(range(64), 3):
            b = sum(1 << i for i in bits)
            assert any(not m & b for m in masks)


def test_components_equal_brute_force(spark, documents, words, rnd):
    base = [[rnd.choice(words) for _ in range(rnd.randint(30, 120))] for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(150):
        b = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            b[rnd.randrange(len(b))] = rnd.choice(words)
        rows.append((1000 + i, " ".join(b)))
    rows += [(5000, None), (5001, ""), (5002, "\n"), (None, rows[0][1]), (3, rows[3][1]), (None, "alone without id")]
    prints = [brute_print(t) for _, t in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = brute_roots(pairs)
    group = {}
    for i, (d, _) in enumerate(rows):
        group.setdefault(roots.get(i, i), []).append(d)
    want = sorted(repr((d, f"{prints[i]:016x}", min((x for x in group[roots.get(i, i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows))
    got = simhash.near_duplicates(documents(rows)).collect()
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    kept = simhash.keep_one(documents(rows)).collect()
    assert len(kept) == len(group) and kept[0]._id == 1


def test_large_buckets_are_hashed_further(spark, rnd):
    centre = rnd.getrandbits(64)
    prints = {centre ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 5))}) for _ in range(200)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = brute_roots([(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 3])
    for bucket in (1024, 16):
        got = {r.node: r.root for r in connected_components(simhash.near_links(df, bucket)).collect()}
        assert got == want


def test_components_of_chains_and_stars(spark, rnd):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_roots([e for e in edges if e[0] != e[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(spark, documents):
    assert simhash.near_duplicates(documents([])).collect() == [] and simhash.keep_one(documents([])).collect() == []
