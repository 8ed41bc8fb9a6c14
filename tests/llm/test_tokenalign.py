import hashlib
import os
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from dyadic.llm import tokenalign
from dyadic.llm.tokenalign import BYTE_BPE, PIECE_BPE, TOKENIZERS, alignment, byte_letters

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabularies")

TEXTS = [
    "The quick brown fox, naïve café.", "", None, "   ", "a", "\t\n\r", "<|endoftext|> and <s>x</s><unk>", "ﬁ 東京 😀 é",
    "two  spaces\n\nlines", "a▁b", "\u0000\u0001", "123456789 $%^ 'll don't", "word " * 3000, " " * 20000 + "x", "Zz" * 5000,
    "The quick brown fox, naïve café.", "The quick red fox",
]


def plain(rows):
    """The contract's measures by loops over every pair of tokens, one text after another."""
    a_lib = Tokenizer.from_file(f"{TOKENIZERS}/{BYTE_BPE}")
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{PIECE_BPE}")
    letters = byte_letters()
    names = {i: bytes(letters[c] for c in t) for t, i in a_lib.get_vocab(with_added_tokens=False).items()}

    def piece(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    per_text, counts = {}, Counter()
    for _, text in rows:
        if not text:
            continue
        if text not in per_text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            spans = []
            for ids, of in ((a, names.__getitem__), (b, piece)):
                at, side = 0, []
                for i in ids:
                    side.append((at, at + len(of(i)), i))
                    at += len(of(i))
                spans.append(side)
            raw = (" " + text).encode()
            if b"".join(names[i] for i in a) != raw or b"".join(piece(i) for i in b) != raw:
                per_text[text] = None
                continue
            links, j = [], 0
            for s, e, i in spans[0]:
                while spans[1][j][1] <= s:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][0] < e:
                    links.append((i, spans[1][k][2]))
                    k += 1
            cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
            groups = []
            sides = [iter(s) for s in spans]
            for cut in cuts:
                parts = []
                for side in sides:
                    ids = []
                    for s, e, i in side:
                        ids.append(str(i))
                        if e == cut:
                            break
                    parts.append(",".join(ids))
                groups.append("|".join(parts))
            per_text[text] = (len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
        if per_text[text]:
            counts.update(per_text[text][3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc, text in rows:
        m = per_text.get(text) if text else None
        if not m:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((doc, *m[:3], len(m[3]), sum(counts[p] == best[p[1]] for p in m[3]), sum(counts[p] for p in m[3]), m[4]))
    return sorted(out, key=repr)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("pair_rows", [1 << 20, 0])
def test_equals_loops(spark, documents, pair_rows):
    """Also with the pair counts joined by a shuffle; ids repeat and one is null."""
    rows = [(None if i == 5 else i // 2, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])] * 3
    assert got(alignment(documents(rows), pair_rows=pair_rows)) == plain(rows)


def test_whole_table_equals_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(alignment(docs)) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_empty_table(spark, documents):
    assert got(alignment(documents([]))) == []
    assert got(alignment(documents([(1, None), (2, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pair_counts_weigh_copies(spark, documents):
    one = tokenalign.pair_counts(tokenalign.aligned_texts(documents([(1, "hello there")]))).collect()
    many = tokenalign.pair_counts(tokenalign.aligned_texts(documents([(i, "hello there") for i in range(7)]))).collect()
    assert {(r.a, r.b): 7 * r.pair_count for r in one} == {(r.a, r.b): r.pair_count for r in many}


def test_encoders_agree(rnd):
    """The faster encoder gives the ids of the vocabulary's own library."""
    both = tokenalign.aligner(TOKENIZERS)
    letters = "aeiou bcd  \n\t.,'sé東😀  XYZ019<|>_"
    for _ in range(300):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 200)))
        assert both.encode(text)[0] == both._slow.encode(" " + text, add_special_tokens=False).ids
