import itertools
import re

from dyadic.llm import decontaminate
from dyadic.llm.decontaminate import EDITS, LOOSE, MASKS, OVERLAP, SHORT


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    out = {}
    for d, text in set(docs):
        t, hit = tokens(text), {}
        for item, passage in items:
            b = tokens(passage)
            size = min(len(b), OVERLAP)
            edits = EDITS if size == OVERLAP else 1 if size >= LOOSE else 0
            for i in range(len(t) - size + 1) if size >= SHORT else ():
                for j in range(len(b) - size + 1):
                    if sum(t[i + k] == b[j + k] for k in range(size)) >= size - edits:
                        hit[i, i + size] = min(hit.get((i, i + size), item), item)
        if hit:
            covered = {p for i, e in hit for p in range(i, e)}
            out[d, text] = (min(hit.values()), min(hit)[0], max(e for _, e in hit) - 1, len(covered))
    return out


def test_masks_survive_any_edits():
    for bad in itertools.combinations(range(OVERLAP), EDITS):
        assert any(all(o + p not in bad for p in m) for m in MASKS for o in range(OVERLAP - m[-1]))


def test_equals_brute_force(spark, documents, words, rnd, monkeypatch):
    few = words[:12]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(14, 40)))) for i in range(20)]
    items += [(30 + n, " ".join(words[20 + n + k] for k in range(n))) for n in range(4, OVERLAP)]
    items += [(20, items[3][1]), (21, "too short to count"), (22, None), (23, ""), (24, " ".join(rnd.choice(few) for _ in range(30)))]
    docs = []
    for i in range(120):
        body = [rnd.choice(few if i % 3 else words) for _ in range(rnd.randint(0, 80))]
        part = tokens(rnd.choice(items[:20])[1])
        lo = rnd.randint(0, 5)
        part = part[lo:lo + rnd.randint(8, 40)]
        for _ in range(rnd.randint(0, 5)):
            part[rnd.randrange(len(part))] = "changed"
        at = rnd.randint(0, len(body))
        docs.append((i, ", ".join(w.title() for w in body[:at] + (part if i % 2 else []) + body[at:])))
    docs += [(500, None), (501, ""), (None, items[0][1]), docs[1], (1, docs[3][1]), (502, " ".join(tokens(items[5][1])[:OVERLAP]))]
    long = [rnd.choice(words) for _ in range(9000)]
    docs.append((503, " ".join(long[:4090] + tokens(items[6][1]) + long[4090:])))
    for i in range(60):
        part = tokens(items[20 + i % (OVERLAP - 4)][1])
        for _ in range(i % 3):
            part[rnd.randrange(len(part))] = "changed"
        docs.append((600 + i, " ".join([*(rnd.choice(few) for _ in range(rnd.randint(0, 3))), *part, rnd.choice(few)])))
    want = brute(docs, [(i, t) for i, t in items if t])
    bench = spark.createDataFrame([(i, t, "k", 1) for i, t in items], "item_id long, text string, key string, toks int")

    def run():
        got = decontaminate.contaminated(documents(docs), bench).collect()
        return sorted(repr((r.doc_id, r.item_id, r.first_token, r.last_token, r.covered)) for r in got)

    assert run() == sorted(repr((d, *v)) for (d, _), v in want.items()) and len(want) > 30
    kept = decontaminate.drop_contaminated(documents(docs), bench).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in kept) == sorted(repr(d) for d in docs if d not in want)
    assert kept[0]._hash == "h"
    before = run()
    monkeypatch.setattr(decontaminate, "SEED_ROWS", 0)
    assert run() == before
    seeds = decontaminate.benchmark_seeds(bench)
    assert sum(r.len < OVERLAP for r in seeds.collect()) >= 7


def test_no_tokens_in_the_exchange(spark, documents, monkeypatch, capsys):
    """On the shuffled way the join by key sees positions only; tokens come back for stretches that were hit."""
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "item_id long, text string")
    joined = []
    monkeypatch.setattr(decontaminate, "materialize", lambda df: (joined.append(df), df)[1])
    parts = decontaminate.stretches(documents([(1, "a b c d e f g h i j k l m n o p"), (2, "x y z " * 9)]), OVERLAP)
    got = decontaminate.shuffled_hits(parts, decontaminate.benchmark_seeds(bench), MASKS)
    assert {r.doc_id for r in got.collect()} == {1}
    assert "toks" not in joined[0].columns
    capsys.readouterr()
    joined[0].explain("formatted")
    plan = capsys.readouterr().out
    shuffles = [b for b in plan.split("\n\n") if "Exchange" in b.split("\n")[0] and "key#" in b and "salt#" in b]
    assert shuffles and all("toks" not in b for b in shuffles)


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    some = documents([(1, "a b c " * 20)])
    assert decontaminate.contaminated(some, bench).collect() == []
    assert decontaminate.drop_contaminated(some, bench).count() == 1
    full = spark.createDataFrame([(1, "a b c " * 20)], "item_id long, text string")
    assert decontaminate.contaminated(documents([]), full).collect() == []
    assert decontaminate.contaminated(some, full).count() == 1
