"""Alignment of two tokenizers over a corpus: every distinct text is encoded and aligned once, its pairs weigh by its copies."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dyadic.session import materialize, scratch_path, small_side

# Folder of the vocabularies; every node must have it under this path.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
# Fixed value: how the byte-level vocabulary splits a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Runs of blanks from this length on go to the slower encoder: the faster one's splitter overflows on very long ones.
LONG_BLANKS = re.compile(r"\s{5000}")
# Pairs up to which their counts are broadcast; beyond it the join shuffles.
PAIR_ROWS = 1 << 20

MEASURES = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, as character to byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both encoders and the bytes of their tokens, loaded once in a worker."""

    def __init__(self, folder: str):
        with open(f"{folder}/{BYTE_BPE}", encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
        # In this vocabulary an id is the rank of its merge, so the ids drive the faster encoder.
        self._fast = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._slow = Tokenizer.from_file(f"{folder}/{BYTE_BPE}")
        self._slow.encode_special_tokens = True
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self._pieces.get_piece_size())]
        self._a_len, self._b_len = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self._written = [f"{i}{end}" for i in ids for end in ",|;"]

    def _piece(self, i: int) -> bytes:
        piece = self._pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        spaced = " " + text
        if LONG_BLANKS.search(spaced):
            a = self._slow.encode(spaced, add_special_tokens=False).ids
        else:
            a = self._fast.encode_ordinary(spaced)
        return a, self._pieces.encode(text)

    def align(self, text: str) -> tuple | None:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pair codes, times), or None if the bytes do not come back."""
        a, b = self.encode(text)
        raw = b" " + text.encode("utf-8", "replace")
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        a_end, b_end = np.cumsum(self._a_len[a]), np.cumsum(self._b_len[b])
        # Between two neighbouring ends lies one stretch of one token of each side: a link.
        ends = np.union1d(a_end, b_end)
        starts = np.concatenate(([0], ends[:-1]))
        codes = a[np.searchsorted(a_end, starts, "right")] * len(self.b_bytes) + b[np.searchsorted(b_end, starts, "right")]
        codes, times = np.unique(codes, return_counts=True)
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        return len(a), len(b), len(shared), len(ends), self._digest(a, b, a_end, b_end, shared), codes, times.astype(np.int32)

    def _digest(self, a, b, a_end, b_end, shared) -> str:
        """SHA-256 of the groups as `a1,a2|b1;a3|b2,b3`: every id is written with the sign that follows it."""
        a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")] = a * 3 + (shared[a_group] == a_end)
        out[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = b * 3 + 2 * (shared[b_group] == b_end)
        return hashlib.sha256("".join(map(self._written.__getitem__, out.tolist()))[:-1].encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def aligner(folder: str) -> Aligner:
    return Aligner(folder)


def _aligned(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, copies = (batch.column(c).to_pylist() for c in ("key", "text", "copies"))
            found = [(k, n, m) for k, n, t in zip(keys, copies, texts) if (m := aligner(folder).align(t))]
            size = np.cumsum([0, *(len(m[5]) for _, _, m in found)]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(size, pa.array(np.concatenate([np.empty(0, kind), *(m[i] for _, _, m in found)]).astype(kind)))
                for i, kind in ((5, np.int64), (6, np.int32))
            ]
            plain = [pa.array([k for k, _, _ in found], pa.binary()), pa.array([n for _, n, _ in found], pa.int64())]
            plain += [pa.array([m[i] for _, _, m in found], pa.int64()) for i in range(4)]
            plain.append(pa.array([m[4] for _, _, m in found], pa.string()))
            yield pa.RecordBatch.from_arrays([*plain, *lists], names=[f.split()[0] for f in ALIGNED.split(", ")])

    return run


def aligned_texts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One stored row per distinct text of `docs` whose bytes both tokenizers give back.

    (key: SHA-256 of the text, copies, n_a, n_b, n_groups, n_links, groups_sha256, codes, times): `codes` are the pairs of
    linked ids, A * (size of B's vocabulary) + B, and `times` how many links of the text hold each.
    """
    texts = docs.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "copies")
    path = scratch_path(docs.sparkSession, "aligned")
    keyed.mapInArrow(_aligned(folder), ALIGNED).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(aligned: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(code, a, b, pair_count, is_best) of every linked pair of ids: its links corpus-wide, copies counted, and whether
    no other pair of the same B id has more."""
    links = aligned.select("copies", F.explode(F.arrays_zip("codes", "times")).alias("p"))
    counted = links.groupBy(F.col("p.codes").alias("code")).agg(F.sum(F.col("p.times") * F.col("copies")).alias("pair_count"))
    size = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}").get_piece_size()
    ids = materialize(counted.select("code", F.expr(f"code div {size}").alias("a"), (F.col("code") % size).alias("b"), "pair_count"))
    # At most one row per id of B's vocabulary.
    best = ids.groupBy("b").agg(F.max("pair_count").alias("most"))
    return ids.join(F.broadcast(best), "b").select("code", "a", "b", "pair_count", (F.col("pair_count") == F.col("most")).alias("is_best"))


def alignment(docs: DataFrame, folder: str = TOKENIZERS, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs` (doc_id, text).

    Token A is the byte-level BPE of a space and the text, token B the piece BPE of the text, which adds the space itself.
    The byte offsets where tokens of both sides end cut them into groups; two tokens are linked if their bytes overlap.
    Texts are shuffled whole to find the distinct ones, each of which is encoded and aligned once; copies count by their
    number, and only the 32-byte key of a text goes back to the documents. Null and empty texts, and texts whose bytes a
    tokenizer does not give back, have zeros and an empty digest. Null and repeated ids keep a row each. An empty table
    gives an empty result. Other columns are not read.
    """
    aligned = aligned_texts(docs, folder)
    pairs = small_side(pair_counts(aligned, folder).select("code", "pair_count", F.col("is_best").cast("long").alias("best")), pair_rows)
    links = aligned.select("key", F.explode(F.arrays_zip("codes", "times")).alias("p"))
    links = links.select("key", F.col("p.codes").alias("code"), F.col("p.times").alias("times"))
    sums = links.join(pairs, "code").groupBy("key").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("pair_count")).alias("count_sum"))
    measures = aligned.select("key", *MEASURES, "groups_sha256").join(sums, "key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("key"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    return rows.join(measures, "key", "left").select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
