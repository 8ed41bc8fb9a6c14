from dyadic import session
from dyadic.llm import linededup
from dyadic.llm.linededup import BLANKS, LINE_WORDS, RUN_LINES, SHORT_WORDS

LONG = 50


def brute(rows, words=LONG, line_words=LONG):
    """Texts with every line gone that lies in a window seen before."""
    order = sorted(set((r[0], r[1]) for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for doc, text in order:
        lines = text.split("\n")
        filled = [i for i, x in enumerate(lines) if x.strip(BLANKS)]
        seq, gone = [lines[i].strip(BLANKS) for i in filled], set()
        for s in range(len(seq)):
            for m in range(1, RUN_LINES + 1):
                part = tuple(seq[s:s + m])
                if len(part) == m and (m == RUN_LINES or sum(len(x.split()) for x in part) >= (line_words if m == 1 else words)):
                    if part in seen:
                        gone |= set(filled[s:s + m])
                    seen.add(part)
        out[doc, text] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(filled), len(gone))
    return out


def test_equals_brute_force(spark, documents, rnd):
    pool = ["".join(rnd.choice("ab") for _ in range(3)) for _ in range(5)] + ["", "  ", "\t"] + [f"{i} " + "long " * (LONG + i) for i in range(3)]
    rows = []
    for i in range(80):
        own = [f"own {i} {j}" for j in range(4)]
        rows.append((i, "\n".join(rnd.choice(pool + own) + rnd.choice(["", " ", "\r"]) for _ in range(rnd.randint(1, 14)))))
    rows += [(None, rows[3][1]), (500, rows[3][1]), (7, rows[7][1]), (600, None), (601, "")]
    for words, line_words in ((LONG, LONG), (SHORT_WORDS, LINE_WORDS), (1, 1)):
        check(documents(rows), rows, words, line_words)


def check(docs, rows, words, line_words):
    want = brute(rows, words, line_words)
    got = linededup.drop_repeated_lines(docs, run_words=words, line_words=line_words).collect()
    assert len(got) == len(rows)
    values = sorted(repr((r.doc_id, *((r.text, r.n_lines, r.n_removed)))) for r in got)
    assert values == sorted(repr((d, *want.get((d, t), (None, 0, 0)))) for d, t in rows)
    assert sum(r.n_removed for r in got) > 100
    assert {"_runs", "_id", "_hash"} <= set(got[0].asDict()) and got[0]._runs == "r"


def test_broadcast_and_shuffle_agree(spark, documents, rnd, monkeypatch):
    rows = [(i, "\n".join(f"line {rnd.randint(0, 4)}" for _ in range(9))) for i in range(30)]
    small = sorted(map(repr, linededup.drop_repeated_lines(documents(rows)).collect()))
    monkeypatch.setattr(linededup, "small_side", session.materialize)
    assert sorted(map(repr, linededup.drop_repeated_lines(documents(rows)).collect())) == small


def test_long_runs_and_clean_documents(spark, documents):
    shared = "\n".join(f"shared line {i}" for i in range(40))
    got = {r.doc_id: r for r in linededup.drop_repeated_lines(documents([
        (1, "first\n" + shared), (2, "mine\n" + shared + "\nmine too"), (3, "two\nlines"), (4, "two\nlines")])).collect()}
    assert got[1].n_removed == 0 and got[2].text == "mine\nmine too" and got[2].n_removed == 40
    assert got[3].text == got[4].text == "two\nlines"
    assert linededup.drop_repeated_lines(documents([])).collect() == []


def test_short_runs_are_deleted(spark, documents, rnd):
    pool = ["one two", "a line of five words", "this one line has six words", "x", "four words are here", "an end of more"]
    rows = [(i, "\n".join(rnd.choice([*pool, f"own {i} {j}"]) for j in range(rnd.randint(1, 6)))) for i in range(60)]
    seen, want = set(), {}
    for i, text in rows:
        seq, gone = text.split("\n"), set()
        for s in range(len(seq)):
            for m in range(1, 4):
                part = tuple(seq[s:s + m])
                if len(part) == m and (m == 3 or sum(len(x.split()) for x in part) >= (6 if m == 1 else 8)):
                    if part in seen:
                        gone |= set(range(s, s + m))
                    seen.add(part)
        want[i] = ("\n".join(x for k, x in enumerate(seq) if k not in gone), len(gone))
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.drop_repeated_lines(documents(rows)).collect()}
    assert got == want
    assert sum("this one line has six words" in t for t, _ in got.values()) == 1


def test_every_shared_run_shares_a_fingerprint(spark, documents, rnd):
    """The guarantee of winnowing: places of one run select the same line, wherever they stand."""
    run = [f"w{rnd.random()}" for _ in range(RUN_LINES)]
    rows = [(i, "\n".join([f"a {i} {j}" for j in range(rnd.randint(0, 4))] + run + [f"z {i}"] * rnd.randint(0, 3))) for i in range(40)]
    base = documents(rows).select("text", linededup._sequence().alias("seq"))
    chosen = base.select("text", linededup._minima((RUN_LINES, SHORT_WORDS, LINE_WORDS)).alias("places")).collect()
    shared = set(run)
    for r in chosen:
        shared &= {r.text.split("\n")[p] for p in r.places}
    assert shared
    assert any(len(r.places) < len(r.text.split("\n")) for r in chosen)


def test_same_line_in_other_surroundings(spark, documents):
    """The first place of a fingerprint need not be the one that a later run repeats."""
    rows = [(1, "b1\nkey\nb2"), (2, "c1\nkey\nc2"), (3, "x\nc1\nkey\nc2\ny"), (4, "c2\nkey\nc1")]
    got = {r.doc_id: r.text for r in linededup.drop_repeated_lines(documents(rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "x\ny", 4: rows[3][1]}
