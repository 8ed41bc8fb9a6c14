"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.session import materialize

ORDER = 2
# Weight of the shorter context in a smoothed probability: the best of 1, 4, 16, 64 and 256, fitted and measured inside the
# rows that teach at sf0.1.
PRIOR = 256.0
# The end of a text as a token; no word holds a line break.
END = "\n"
SEED = 42
# A part of the filter: words of 64 bits, 1 MB in all, or more if its insertions need it; and bytes of text for each part.
PART_WORDS, PART_TEXT = 1 << 17, 8 << 20
# Least bits of the filter for each insertion, and bits that an insertion sets.
BITS, SET = 6, 3
# Bits of the hash that tell the n-grams of a part apart: one equals another of a million with a chance of 1 in 4,000, far
# below the filter's chance hits. Words keep all 64 bits.
LOW = 32
# Counts from here on take eight bytes instead of one.
MANY = 255
# Bytes of text that a task works on at a time, and how hard they are compressed to travel.
SLICE, ZSTD = 8 << 20, 9

_GOLD, _M1, _M2 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: every bit of the result depends on every bit given."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Tokens(NamedTuple):
    """Texts cut into tokens: `codes` index `words`, whose last entry is the end; `doc` is the text, `place` the token's place in it."""

    codes: np.ndarray
    words: pa.Array
    doc: np.ndarray
    place: np.ndarray


def tokens_of(texts: pa.Array) -> Tokens:
    """Lower-case A-Z, take words between ASCII blanks, add one end to each text; null is an empty text."""
    # The copy starts at offset zero: Arrow's lower-casing of ASCII misreads a slice.
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(real)).dictionary_encode()
    doc = doc[real]
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_string())])
    codes = np.full(len(doc) + len(texts), len(words) - 1, np.int64)
    codes[np.arange(len(doc)) + doc] = coded.indices.to_numpy(zero_copy_only=False)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    return Tokens(codes, words, np.repeat(np.arange(len(texts)), n + 1), place)


def word_hashes(words: pa.Array) -> np.ndarray:
    """XXH64 of the words' UTF-8, as Spark's xxhash64 gives it."""
    return np.array([xxhash.xxh64_intdigest(w, SEED) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)


def gram_hashes(tokens: Tokens, hashes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to `order`, the hash of the n-gram that ends at each token; it counts only where `place` allows."""
    out = [hashes[tokens.codes]]
    for _ in range(1, order):
        last = np.concatenate((np.zeros(1, np.uint64), out[-1][:-1]))
        out.append(_mix(last * _GOLD + out[0]))
    return out


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(LOW)) % np.uint64(parts)).astype(np.int64)


def _cells(hashes: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word within a part of `size` words and its bits that the event (n-gram, level) sets."""
    event = _mix(hashes + np.full(1, level, np.uint64) * _GOLD)
    mask = np.zeros(len(event), np.uint64)
    for i in range(SET):
        mask |= np.uint64(1) << ((event >> np.uint64(20 + 6 * i)) & np.uint64(63))
    return ((event >> np.uint64(38)) % np.uint64(size)).astype(np.int64), mask


def fill_part(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One part of the filter: an n-gram of count c is there at levels 1 to q = the binary digits of c."""
    levels = np.frexp(counts.astype(np.float64))[1]
    bits = np.zeros(max(PART_WORDS, math.ceil(int(levels.sum()) * BITS / 64)), np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, mask = _cells(hashes[levels >= level], level, len(bits))
        np.bitwise_or.at(bits, at, mask)
    return bits


def probe(bits: np.ndarray, offset: int, hashes: np.ndarray) -> np.ndarray:
    """Level of each n-gram: probes go up from level 1 until one misses. Never too low; too high only by chance hits.

    The part begins at `offset` of `bits` and reaches to the end.
    """
    found = np.zeros(len(hashes), np.int64)
    left, level = np.arange(len(hashes)), 1
    while len(left):
        at, mask = _cells(hashes[left], level, len(bits) - offset)
        left = left[(bits[offset + at] & mask) == mask]
        found[left] = level
        level += 1
    return found


def count_at(level: np.ndarray) -> np.ndarray:
    """Mean count of a level: level q holds the counts from 2**(q-1) to 2**q - 1."""
    return np.where(level > 0, (3.0 * np.exp2(level - 1.0) - 1.0) / 2.0, 0.0)


def step(p: np.ndarray, gram: np.ndarray, context: np.ndarray, prior: float) -> np.ndarray:
    """Smoothed probability after a longer context, from that after the shorter one."""
    have = count_at(context)
    return (np.minimum(count_at(gram), have) + prior * p) / (have + prior)


def unigram(level: np.ndarray, tokens: int, words: int) -> np.ndarray:
    return (np.minimum(count_at(level), tokens) + 1.0) / (tokens + words + 1.0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has about SLICE bytes of text, or one longer text."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // SLICE, prepend=0))
        for a, b in zip([0, *cut], [*cut, len(size)]):
            if a < b:
                yield batch.slice(a, b - a)


def learns(doc_id: Column, fold: int = 2, folds: int = 7) -> Column:
    """Whether a row teaches the model; a row without an id does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != fold, F.lit(True))


class Grams(NamedTuple):
    """The different words and longer n-grams of a slice, part by part.

    `words` orders the codes of `tokens` by part; `keys` holds part and low hash bits of the longer n-grams, ascending; the
    bounds say where each part begins. For each longer length, `at` has the tokens that end an n-gram and its place in `keys`.
    """

    tokens: Tokens
    hashes: np.ndarray
    words: np.ndarray
    word_bounds: np.ndarray
    keys: np.ndarray
    key_bounds: np.ndarray
    at: list[tuple[np.ndarray, np.ndarray]]


def grams_of(texts: pa.Array, order: int, parts: int) -> Grams:
    tokens = tokens_of(texts)
    hashes = word_hashes(tokens.words)
    part = part_of(hashes, parts)
    words = np.argsort(part, kind="stable")
    keys, ends = [np.zeros(0, np.uint64)], []
    for k, h in enumerate(gram_hashes(tokens, hashes, order)):
        if k:
            ends.append(np.flatnonzero(tokens.place >= k))
            h = h[ends[-1]]
            keys.append(part_of(h, parts).astype(np.uint64) << np.uint64(LOW) | h & np.uint64((1 << LOW) - 1))
    own, index = np.unique(np.concatenate(keys), return_inverse=True)
    index = np.split(index, np.cumsum([len(e) for e in ends])[:-1]) if ends else []
    return Grams(tokens, hashes, words, np.searchsorted(part[words], np.arange(parts + 1)), own,
                 np.searchsorted(own, np.arange(parts + 1, dtype=np.uint64) << np.uint64(LOW)), list(zip(ends, index)))


def _cut(values: np.ndarray, bounds: np.ndarray, width: int) -> pa.Array:
    """Pieces of an array as binary cells, an entry taking `width` bytes."""
    offsets = (bounds * width).astype(np.int64)
    data = np.ascontiguousarray(values).view(np.uint8)
    cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return cells.cast(pa.binary())


def _joined(cells: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all cells and where each begins; none is null."""
    cells = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
    cells = cells.cast(pa.large_binary())
    if not len(cells):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset:cells.offset + len(cells) + 1]
    data = cells.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0]:at[-1]]
    return data, at - at[0]


def slice_name(batch: pa.RecordBatch) -> bytes:
    """128 bits of what the rows of a slice hold and of their order, so that a slice is known again when read again."""
    name = xxhash.xxh3_128()
    for cells, blank in ((batch.column("doc_id").cast(pa.string()), ""), (batch.column("text"), "")):
        name.update(np.packbits(cells.is_null().to_numpy(zero_copy_only=False)).tobytes())
        data, at = _joined(pc.fill_null(cells, blank))
        name.update(at.tobytes())
        name.update(data.tobytes())
    return name.digest()


_COUNTED = "slice binary, part long, words binary, word_counts binary, grams binary, gram_counts binary"


def gram_counts(docs: DataFrame, parts: int, order: int) -> DataFrame:
    """For each slice of `docs` (doc_id, text, learn) and part: the hashes of its n-grams and how often each occurs in rows that teach.

    A count takes a byte. What goes beyond MANY follows in rows without a slice, with eight bytes for each count.
    """

    def run(batches):
        for batch in _slices(batches):
            grams = grams_of(batch.column("text"), order, parts)
            learn = batch.column("learn").to_numpy(zero_copy_only=False)[grams.tokens.doc]
            words = np.bincount(grams.tokens.codes[learn], minlength=len(grams.words))[grams.words]
            longer = np.zeros(len(grams.keys), np.int64)
            for end, index in grams.at:
                longer += np.bincount(index[learn[end]], minlength=len(longer))
            hashes = grams.hashes[grams.words]
            w, k = grams.word_bounds, grams.key_bounds
            for name, kind in ((slice_name(batch), np.uint8), (None, np.int64)):
                if name is None:
                    words, longer = np.maximum(words - MANY, 0), np.maximum(longer - MANY, 0)
                    more = [np.append(0, np.cumsum(c > 0)) for c in (words, longer)]
                    w, k = more[0][w], more[1][k]
                    hashes, keys = hashes[words > 0], grams.keys[longer > 0]
                    words, longer = words[words > 0], longer[longer > 0]
                    cells = (words, longer)
                else:
                    keys, cells = grams.keys, (np.minimum(words, MANY), np.minimum(longer, MANY))
                used = np.flatnonzero((np.diff(w) > 0) | (np.diff(k) > 0))
                if len(used):
                    size = np.dtype(kind).itemsize
                    columns = [pa.array([name] * parts, pa.binary()), pa.array(np.arange(parts)), _cut(hashes, w, 8),
                               _cut(cells[0].astype(kind), w, size), _cut(keys.astype("<u4"), k, 4), _cut(cells[1].astype(kind), k, size)]
                    yield pa.RecordBatch.from_arrays(
                        [c.take(pa.array(used)) for c in columns], names=["slice", "part", "words", "word_counts", "grams", "gram_counts"])

    return docs.select("doc_id", "text", "learn").mapInArrow(run, _COUNTED)


_LEVELS = "slice binary, part long, word_counts binary, many_counts binary, word_levels binary, gram_levels binary, n long, v long"


def fill_and_probe(rows: pa.Table) -> pa.Table:
    """One part of the filter, filled from all counts of its n-grams and probed for each slice: a row per slice and one of totals.

    Levels and exact counts of words take a byte each, in the order of the slice's hashes; counts of MANY or more are MANY
    there and stand in `many_counts`. The totals are the tokens and the different words of the rows that teach.
    """
    asked, rest = rows.filter(pc.is_valid(rows["slice"])), rows.filter(pc.is_null(rows["slice"]))
    found, filled, out = [], [], [asked["slice"].combine_chunks(), asked["part"].combine_chunks()]
    for hashes, counts in (("words", "word_counts"), ("grams", "gram_counts")):
        kind = "<u8" if hashes == "words" else "<u4"
        h, at = zip(*(_joined(t[hashes]) for t in (asked, rest)))
        n, bounds = zip(*(_joined(t[counts]) for t in (asked, rest)))
        own, index = np.unique(np.concatenate([x.view(kind) for x in h]).astype(np.uint64), return_inverse=True)
        total = np.bincount(index, np.concatenate([n[0].astype(np.float64), n[1].view(np.int64)]), len(own))
        found.append((own, index[:len(n[0])], total, bounds[0]))
    known = [np.concatenate([f[i][f[2] > 0] for f in found]) for i in (0, 2)]
    bits = fill_part(*known)
    for i, (own, index, total, bounds) in enumerate(found):
        if i == 0:
            each = total.astype(np.int64)[index]
            out += [_cut(np.minimum(each, MANY).astype(np.uint8), bounds, 1), _cut(each[each >= MANY], np.append(0, np.cumsum(each >= MANY))[bounds], 8)]
            tokens, distinct = int(total.sum()), int((total > 0).sum())
        out.append(_cut(probe(bits, 0, own).astype(np.uint8)[index], bounds, 1))
    names = ["slice", "part", "word_counts", "many_counts", "word_levels", "gram_levels", "n", "v"]
    none = pa.nulls(len(out[0]), pa.int64())
    total = [pa.nulls(1, c.type) for c in out] + [pa.array([tokens]), pa.array([distinct])]
    return pa.concat_tables([pa.table([*out, none, none], names), pa.table(total, names)])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice as one row: its name and its rows, compressed."""
    for batch in _slices(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD))) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array([slice_name(batch)], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slice", "rows"])


def _log_probs(grams: Grams, word_levels: np.ndarray, gram_levels: np.ndarray, prior: float, n: int, v: int) -> np.ndarray:
    """log10 of the smoothed probability of each token."""
    known = word_levels[grams.tokens.codes]
    p = unigram(known, n, v)
    for at, index in grams.at:
        level = np.zeros_like(known)
        # An n-gram is never more frequent than what it is made of.
        level[at] = np.minimum(gram_levels[index], np.minimum(known[at], known[at - 1]))
        p[at] = step(p[at], level[at], known[at - 1], prior)
        known = level
    return np.log10(p)


_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scorer(parts: int, order: int, prior: float, n: int, v: int):
    """Rows of a slice with their sums, from the slice and what its parts of the filter answered."""

    def score(slices: pa.Table, answers: pa.Table) -> pa.Table:
        batch = pa.ipc.open_stream(slices["rows"][0].as_buffer()).read_next_batch()
        grams = grams_of(batch.column("text"), order, parts)
        # Equal slices have equal answers.
        first = np.unique(answers["part"].to_numpy(), return_index=True)[1]
        answers = answers.take(pa.array(first))
        counts, many, word_levels, gram_levels = (
            _joined(answers[c])[0] for c in ("word_counts", "many_counts", "word_levels", "gram_levels"))
        if len(word_levels) != len(grams.words) or len(gram_levels) != len(grams.keys):
            raise RuntimeError("the table gave other rows, or another order of rows, when it was read again: checkpoint it first")
        place = np.empty(len(grams.words), np.int64)
        place[grams.words] = np.arange(len(place))
        counts = counts.astype(np.int64)
        counts[counts == MANY] = many.view(np.int64)
        counts, word_levels = counts[place], word_levels[place].astype(np.int64)
        tokens, size = grams.tokens, batch.num_rows
        logs = _log_probs(grams, word_levels, gram_levels.astype(np.int64), prior, n, v)
        own = np.bincount(tokens.doc, minlength=size)
        base = np.bincount(tokens.doc, np.log10(counts + 1.0)[tokens.codes], size) - own * math.log10(n + v + 1)
        out = pa.table({
            "doc_id": batch.column("doc_id"), "n_tokens": own,
            "n_known": np.bincount(tokens.doc, (counts > 0)[tokens.codes], size).astype(np.int64), "base_score": base,
            "score": np.bincount(tokens.doc, logs, size)})
        return pa.concat_tables([out] * slices.num_rows)

    return score


def score_texts(
    docs: DataFrame, order: int = ORDER, prior: float = PRIOR, filter_bytes: int | None = None, heavy_words: int | None = None,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs` (doc_id, text).

    Tokens are the lower-cased (A-Z) words between ASCII blanks and one end; rows outside the held-out fold teach.
    `base_score` sums log10((c + 1) / (N + V + 1)) with the exact count c of each token, N of all and V of distinct ones
    (words are told apart by 64 bits of hash). `score` is the model's log10 probability: the counts of n-grams up to `order`
    are read from the filter by probes at rising levels, and a longer context is smoothed with `prior` parts of the shorter
    one, down to single words.

    Neither filter nor texts are broadcast or whole anywhere. A slice of rows (about SLICE bytes of text) sends the hashes of
    its different n-grams to the parts of the filter; a part is filled from all counts, probed for all slices, and answers a
    byte for each n-gram; the answers meet the compressed slice. The table is read twice and must give the same rows in the
    same order in each task, as files do; else an error says so. `filter_bytes` and `heavy_words` bounded what an earlier
    form broadcast; they change nothing now.

    Null texts are empty: one token, the end. Rows without an id teach and are not held out. Repeated rows keep a row each
    and all teach. If no row teaches, N and V are zero and every token has probability 1. An empty table gives an empty
    result. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / PART_TEXT))
    counts = gram_counts(docs.withColumn("learn", learns(F.col("doc_id"))), parts, order)
    answers = materialize(counts.repartition(parts, "part").groupBy("part").applyInArrow(fill_and_probe, _LEVELS))
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    slices = docs.mapInArrow(pack, "slice binary, rows binary").repartition(parts, "slice").groupBy("slice")
    asked = answers.filter("slice IS NOT NULL").drop("n", "v")
    each = slices.cogroup(asked.repartition(parts, "slice").groupBy("slice")).applyInArrow(_scorer(parts, order, prior, n, v), _SCORED)
    return each.select(
        "doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        "base_score", "score")
