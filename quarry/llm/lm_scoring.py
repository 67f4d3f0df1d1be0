"""Language-model scoring with a log-frequency Bloom filter.

Tokens are lower-cased runs between ASCII white space, and one end for each text. Unigram and
bigram counts c of the training texts are quantised to levels q = 1 + floor(log_B c), and
the filter holds the pairs (n-gram, 1) .. (n-gram, q). A count is recovered by probing levels
1, 2, ... until one is missing, which can only raise it, and rarely does. Scores interpolate

    P(w | v) = lambda(q(v)) min(1, c(v w) / c(v)) + (1 - lambda(q(v))) P(w)
    P(w)     = (c(w) - D) / N for known tokens, D V / N for the class of unknown ones

with D = n1 / (n1 + 2 n2) from the counts of counts, and lambda by expectation maximisation
on leave-one-out counts of all training tokens, which only needs how often each combination
of levels occurs.

Counting adds up within each task, then moves each n-gram once a task to the block of
the filter that its hash names. There are as many blocks as the training text asks for
(``BLOCK_TEXT`` bytes each, 4,096 at least); they are built one at a time where they fall.
A filter of at most ``SHARD_BYTES`` is broadcast. A larger one is cut into shards of that
size, and the probes travel instead: each piece of the corpus (some megabytes of text) sends
each shard its distinct n-grams once and gets their levels back, so the work stays in
proportion to the corpus however many shards there are.

The corpus is probed once: the levels of its tokens, two bytes a token, are written, and both
the weights and the scores come from them.

The exact add-one baseline needs exact unigram counts. Tokens with at least N / 2^20
occurrences (so at most 2^20 of them) are broadcast with their counts; for all rarer ones
(text, token) pairs are joined with the vocabulary.

Defined results: a null or empty text is the end alone. Equal rows get equal scores. With no
training text every token is unknown and all scores are 0. Rows without doc_id are scored. An empty table gives an empty result. Other columns are not read,
whatever their names, unless the condition that tells training rows names them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scratch
from . import _text as tx

BASE = 1.3
BITS_PER_ENTRY = 12
PROBES = 5
BLOCK_BITS = 12  # 4,096 blocks at least
BLOCK_TEXT = 4 << 20
TASK_TEXT = 64 << 20
SHARD_BYTES = 192 << 20
CHUNK = 16 << 10  # bytes of a block in one row
ASKED = 1024  # keys in one row
HOT_SHIFT = 20
FLUSH = 1 << 20
SENT = 1 << 16  # rows in one batch to the JVM
MAX_LEVEL = 200
END, BEGIN = np.uint64(0x454E44), np.uint64(0x424547)

VALUES = np.array([0.0, *((BASE ** (q - 1) + max(BASE ** (q - 1), BASE**q - 1)) / 2 for q in range(1, MAX_LEVEL))])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64), MAX_LEVEL - 1)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unigram keys, bigram keys (odd; unigram keys are even), whether a token begins a
    text, and row bounds."""
    h, bounds = tx.words(column)
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    out = np.full(len(h) + n, END, tx.U64)
    out[np.arange(len(h)) + rows] = h
    upto = bounds + np.arange(n + 1)
    first = np.zeros(len(out), bool)
    first[upto[:-1]] = True
    before = np.concatenate(([BEGIN], out[:-1]))
    before[first] = BEGIN
    one = tx.mix64(out) & ~tx.U64(1)
    two = tx.mix64(before * tx.U64(0x9FB21C651E98DF25) + out * tx.U64(0xD6E8FEB86659FD93)) | tx.U64(1)
    return one, two, first, upto


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")  # which merges what is sorted already
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _occurrences(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs; sorts ``keys`` in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams, added up over a task as far as memory allows."""

    def rows(keys, counts):
        for at in range(0, len(keys), SENT):
            yield pa.record_batch([pa.array(tx.signed(keys[at : at + SENT])), pa.array(counts[at : at + SENT])], names=["key", "n"])

    keys, counts, fresh, waiting = np.zeros(0, tx.U64), np.zeros(0, np.int64), [], 0

    def merged():
        k, n = _occurrences(np.concatenate(fresh) if fresh else np.zeros(0, tx.U64))
        return _added(np.concatenate((keys, k)), np.concatenate((counts, n)))

    for b in tx.slices(batches):
        one, two, _, _ = tokens(tx.column(b, "text"))
        fresh += [one, two]
        waiting += len(one) + len(two)
        if waiting >= FLUSH:
            keys, counts = merged()
            fresh, waiting = [], 0
            if len(keys) >= 3 * FLUSH:
                yield from rows(keys, counts)
                keys, counts = keys[:0].copy(), counts[:0].copy()
    yield from rows(*merged())


def _word_and_mask(keys: np.ndarray, level: np.ndarray | int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in its block an entry lies, and its bits in that 64-bit word."""
    h = tx.mix64(keys + (np.asarray(level, tx.U64) * tx.U64(0x9E3779B97F4A7C15)))
    word = ((h >> tx.U64(32)) * size.astype(tx.U64)) >> tx.U64(32)
    mask = np.zeros(len(h), tx.U64)
    for k in range(PROBES):
        mask |= tx.U64(1) << ((h >> tx.U64(6 * k)) & tx.U64(63))
    return word.astype(np.int64), mask


def block_bits(n_bytes: int) -> int:
    """Bits of a key that name its block, for so many bytes of training text."""
    return min(31, max(BLOCK_BITS, (max(n_bytes, 1) // BLOCK_TEXT).bit_length()))


def _blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Keys and counts, a block at a time, of rows that come block by block."""
    current, held = None, []
    for b in batches:
        keys, counts = _added(tx.column(b, "key").to_numpy().view(tx.U64), tx.column(b, "n").to_numpy())
        block = (keys >> tx.U64(64 - bits)).astype(np.int64)
        for i, j in _runs(block):
            if block[i] != current and held:
                yield current, *_added(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            current = int(block[i])
            held.append((keys[i:j], counts[i:j]))
    if held:
        yield current, *_added(*map(np.concatenate, zip(*held, strict=True)))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Borders of the runs of equal values."""
    borders = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else [0]
    return list(zip(borders[:-1], borders[1:], strict=True))


def _build(batches: Iterator[pa.RecordBatch], bits: int = BLOCK_BITS) -> Iterator[pa.RecordBatch]:
    """The filter blocks of a partition, and the exact counts of its unigrams."""
    for block, k, c in _blocks(batches, bits):
        levels = level_of(c)
        entries = np.repeat(k, levels)
        nth = np.arange(len(entries)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
        words = max(1, -(-len(entries) * BITS_PER_ENTRY // 64))
        word, mask = _word_and_mask(entries, nth, np.full(len(entries), words))
        filled = np.zeros(words, tx.U64)
        np.bitwise_or.at(filled, word, mask)
        one = (k & tx.U64(1)) == 0
        own = c[one]
        yield pa.record_batch(
            [pa.array([block], pa.int32()), pa.array([filled.tobytes()], pa.binary()), pa.array([words], pa.int64()), pa.array([tx.signed(k[one])], pa.list_(pa.int64())), pa.array([own], pa.list_(pa.int64())), *(pa.array([int(x)], pa.int64()) for x in (own.sum(), len(own), (own == 1).sum(), (own == 2).sum()))],
            names=["block", "bits", "words", "vocab", "counts", "n", "v", "n1", "n2"],
        )


BUILT = "block int, bits binary, words long, vocab array<long>, counts array<long>, n long, v long, n1 long, n2 long"


FOUND = "doc_id long, k long, train boolean, n_tokens long, hot_known long, hot_log double, ones binary, twos binary"


class Shard:
    """Consecutive blocks of the filter."""

    def __init__(self, words: dict[int, int], blocks, bits: int = BLOCK_BITS):
        """``words``: the blocks' sizes; ``blocks``: (block, bits) in any order; ``bits``: of a key that name its block."""
        self.shift, self.low = tx.U64(64 - bits), min(words, default=0)
        held = max(words, default=-1) - self.low + 1
        self.at, self.size = np.zeros(held, np.int64), np.zeros(held, np.int64)
        upto = 0
        for block, n in words.items():
            self.at[block - self.low], self.size[block - self.low] = upto, n
            upto += n
        self.bits = np.zeros(upto, tx.U64)
        for block, filled in blocks:
            at = self.at[block - self.low]
            self.bits[at : at + len(filled) // 8] = np.frombuffer(filled, tx.U64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts, by probing level after level; 0 for blocks held elsewhere."""
        distinct, inverse = np.unique(keys, return_inverse=True)
        block = (distinct >> self.shift).astype(np.int64) - self.low
        out = np.zeros(len(distinct), np.uint8)
        left = np.flatnonzero((block >= 0) & (block < len(self.size)))
        left = left[self.size[block[left]] > 0]
        for q in range(1, MAX_LEVEL):
            if not len(left):
                break
            word, mask = _word_and_mask(distinct[left], q, self.size[block[left]])
            left = left[self.bits[self.at[block[left]] + word] & mask == mask]
            out[left] = q
        return out[inverse]


class Stats:
    def __init__(self, n: int, v: int, n1: int, n2: int):
        self.n, self.v = n, v
        self.discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        self.lam = np.zeros(MAX_LEVEL)

    def unigram(self, value: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones_like(value)
        return np.where(value > self.discount, value - self.discount, self.discount * self.v) / self.n

    def fit(self, cells: np.ndarray) -> None:
        """lambda by context level; cells: context, bigram and unigram level, how often."""
        ctx, pair, one, times = cells.T
        lower = self.unigram(np.maximum(VALUES[one] - 1, 0))
        upper = np.minimum(1, np.maximum(VALUES[pair] - 1, 0) / np.maximum(VALUES[ctx] - 1, 1))
        total = np.bincount(ctx, times, MAX_LEVEL)
        self.lam = np.full(MAX_LEVEL, 0.5)
        for _ in range(60):
            mine = self.lam[ctx] * upper
            share = mine / np.maximum(mine + (1 - self.lam[ctx]) * lower, 1e-300)
            self.lam = np.where(total > 0, np.bincount(ctx, times * share, MAX_LEVEL) / np.maximum(total, 1), 0.0)
        self.lam = np.clip(self.lam, 0, 0.999)

    def log10(self, ctx: np.ndarray, pair: np.ndarray, one: np.ndarray) -> np.ndarray:
        upper = np.where(pair > 0, np.minimum(1, VALUES[pair] / np.maximum(VALUES[ctx], 1)), 0)
        lam = np.where(ctx > 0, self.lam[ctx], 0)
        return np.log10(np.maximum(lam * upper + (1 - lam) * self.unigram(VALUES[one]), 1e-300))


def _cut(levels: np.ndarray, upto: np.ndarray) -> pa.Array:
    """Levels, a byte each, as one value a row."""
    return pa.Array.from_buffers(pa.binary(), len(upto) - 1, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(levels, np.uint8))])


def _context(one: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    ctx = np.concatenate(([0], one[:-1])).astype(np.int64)
    ctx[first] = begin
    return ctx


def _partitions(docs: DataFrame, n_bytes: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // TASK_TEXT)


def train(docs: DataFrame, n_bytes: int) -> tuple[DataFrame, Stats, int, int]:
    """The written filter with the exact vocabulary, the statistics, how many shards, and the
    bits of a key that name its block; ``n_bytes``: the size of the texts."""
    bits = block_bits(n_bytes)
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "key long, n long")
    block = F.shiftrightunsigned("key", 64 - bits)
    dealt = counts.repartition(_partitions(docs, n_bytes), block).sortWithinPartitions(block)
    built = _scratch.write_table(dealt.mapInArrow(lambda batches: _build(batches, bits), BUILT), "filter")
    s = built.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n1", "n2", "words"))).first()
    return built, Stats(s["n"], s["v"], s["n1"], s["n2"]), max(1, -(-s["words"] * 8 // SHARD_BYTES)), bits


def _whole(built: DataFrame, bits: int):
    """The filter of one shard, broadcast."""
    words = {r["block"]: r["words"] for r in built.select("block", "words").collect()}  # a word at least each, of SHARD_BYTES
    return built.sparkSession.sparkContext.broadcast(Shard(words, built.select("block", "bits").toLocalIterator(), bits))


def _lists(values: np.ndarray, borders: list[tuple[int, int]]) -> pa.ListArray:
    """Runs that follow each other, as lists."""
    return pa.ListArray.from_arrays(pa.array([0, *(j for _, j in borders)], pa.int32()), pa.array(values))


def _ask(batches: Iterator[pa.RecordBatch], shift: int, per: int) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of a piece, in rows of one shard and at most ``ASKED`` of them."""
    for b in tx.slices(batches):
        one, two, _, upto = tokens(tx.column(b, "text"))
        of = np.repeat(tx.column(b, "piece").to_numpy(), np.diff(upto))
        for piece in np.unique(of):
            mine = of == piece
            keys = np.unique(np.concatenate((one[mine], two[mine])))
            shard = (keys >> tx.U64(shift)).astype(np.int64) // per
            borders = [(k, min(k + ASKED, j)) for i, j in _runs(shard) for k in range(i, j, ASKED)]
            yield pa.record_batch(
                [pa.array(shard[[i for i, _ in borders]].astype(np.int32)), pa.array(np.full(len(borders), piece)), _lists(tx.signed(keys), borders)],
                names=["shard", "piece", "keys"],
            )


def _answer(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Levels of the n-grams asked for. Rows come shard by shard, the filter's before the others."""
    current, words, parts, table = None, {}, {}, None
    for b in batches:
        shard = tx.column(b, "shard").to_numpy()
        for i, j in _runs(shard):
            if shard[i] != current:
                current, words, parts, table = shard[i], {}, {}, None
            run = b.slice(i, j - i)
            asked = run.filter(tx.column(run, "piece").is_valid())
            held = run.slice(0, run.num_rows - asked.num_rows)
            for block, n, chunk in zip(*(tx.column(held, c).to_pylist() for c in ("block", "words", "chunk")), strict=True):
                words[block] = n
                parts.setdefault(block, []).append(chunk)
            if asked.num_rows:
                if table is None:
                    table, parts = Shard(words, ((k, b"".join(v)) for k, v in parts.items()), bits), {}
                keys = tx.column(asked, "keys")
                found = table.levels(keys.flatten().to_numpy().view(tx.U64))
                upto = np.concatenate(([0], np.cumsum(keys.value_lengths().to_numpy()))).astype(np.int32)
                levels = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(upto), pa.py_buffer(found)])
                yield pa.record_batch([tx.column(asked, "piece"), keys, levels], names=["piece", "keys", "found"])


def _settle(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Texts with the levels of their tokens. Rows come piece by piece, answers before texts."""
    current, keys, found, known = None, [], [], None
    for b in batches:
        piece = tx.column(b, "piece").to_numpy()
        for i, j in _runs(piece):
            if piece[i] != current:
                current, keys, found, known = piece[i], [], [], None
            run = b.slice(i, j - i)
            texts = run.filter(tx.column(run, "is_text"))
            answers = run.slice(0, run.num_rows - texts.num_rows)
            if answers.num_rows:
                keys.append(tx.column(answers, "keys").flatten().to_numpy().view(tx.U64))
                found += tx.column(answers, "found").to_pylist()
            for t in tx.slices(iter([texts])):
                if known is None:
                    k, q = np.concatenate(keys), np.frombuffer(b"".join(found), np.uint8)
                    order = np.argsort(k)
                    known, keys, found = (k[order], q[order]), [], []
                one, two, _, upto = tokens(tx.column(t, "text"))
                both = np.stack([known[1][np.searchsorted(known[0], x)] for x in (one, two)])
                mixed = [both[:, upto[r] : upto[r + 1]].tobytes() for r in range(t.num_rows)]
                yield pa.record_batch([*(tx.column(t, c) for c in names), pa.array(mixed, pa.binary())], names=[*names, "__levels"])


def levels(docs: DataFrame, built: DataFrame, shards: int, bits: int, n_bytes: int) -> DataFrame:
    """``docs(doc_id, text, train)`` with ``__levels``: per token its unigram and bigram levels. Only
    used where the filter has several shards."""
    names, per, parts = docs.columns, -(-(1 << bits) // shards), _partitions(docs, n_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            piece = pa.array(np.full(b.num_rows, uuid.uuid4().int >> 65, np.int64))  # written, so a task that is run again is of no matter
            yield pa.record_batch([*(tx.column(b, c) for c in names), piece], names=[*names, "piece"])

    pieces = _scratch.write_table(docs.mapInArrow(cut, docs.withColumn("piece", F.lit(0).cast("long")).schema), "pieces")
    asked = pieces.select("text", "piece").mapInArrow(lambda batches: _ask(batches, 64 - bits, per), "shard int, piece long, keys array<long>")
    held = built.select((F.col("block") / per).cast("int").alias("shard"), "block", "words", "bits", F.explode(F.sequence(F.lit(0), F.col("words").cast("int") * 8 - 1, F.lit(CHUNK))).alias("at"))
    held = held.select("shard", "block", "words", "at", F.substring("bits", F.col("at") + 1, F.lit(CHUNK)).alias("chunk"))
    met = held.unionByName(asked, allowMissingColumns=True).repartition(max(parts, shards), "shard")
    met = met.sortWithinPartitions("shard", F.col("piece").asc_nulls_first(), "block", "at")
    answers = met.mapInArrow(lambda batches: _answer(batches, bits), "piece long, keys array<long>, found binary")
    back = answers.withColumn("is_text", F.lit(False)).unionByName(pieces.withColumn("is_text", F.lit(True)), allowMissingColumns=True)
    back = back.repartition(parts, "piece").sortWithinPartitions("piece", "is_text")
    out = _scratch.write_table(back.mapInArrow(lambda batches: _settle(batches, names), docs.withColumn("__levels", F.lit(None).cast("binary")).schema), "levels")
    _scratch.drop_table(pieces)
    return out


def score(docs: DataFrame, train_rows: Column) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: ``doc_id, n_tokens, n_known, train_tokens,
    base_score, score``. The model learns from the rows where ``train_rows`` holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train_rows, F.lit(False)).alias("train"))
    learnt = rows.where("train").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    built, stats, shards, bits = train(rows.where("train"), learnt["bytes"])
    vocabulary = built.select(F.explode(F.arrays_zip("vocab", "counts")).alias("x")).select(F.col("x.vocab").alias("key"), F.col("x.counts").alias("c"))
    frequent = vocabulary.where(F.col("c") >= max(1, stats.n >> HOT_SHIFT)).toArrow()  # at most 2^20 rows, for they share N tokens
    hot_key = frequent["key"].to_numpy().astype(np.int64).view(tx.U64)
    order = np.argsort(hot_key)
    hot = spark.sparkContext.broadcast((hot_key[order], frequent["c"].to_numpy().astype(np.int64)[order]))

    if shards == 1:
        filter_ = _whole(built, bits)
        source = rows

        def find(b: pa.RecordBatch, *keys: np.ndarray) -> list[np.ndarray]:
            return [filter_.value.levels(x) for x in keys]
    else:
        source = levels(rows, built, shards, bits, rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])

        def find(b: pa.RecordBatch, *keys: np.ndarray) -> list[np.ndarray]:
            got = [np.frombuffer(x, np.uint8).reshape(2, -1)[: len(keys)] for x in tx.column(b, "__levels").to_pylist()]
            return list(np.concatenate(got, axis=1))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            one, two, _, upto = tokens(tx.column(b, "text"))
            c = _hot_counts(one, *hot.value)
            logs = np.where(c > 0, np.log10(c + 1.0), 0.0)
            yield pa.record_batch(
                [tx.column(b, "doc_id"), pa.array(_text_keys(b)), tx.column(b, "train"), pa.array(np.diff(upto)), pa.array(np.add.reduceat((c > 0).astype(np.int64), upto[:-1])), pa.array(np.add.reduceat(logs, upto[:-1])), *(_cut(q, upto) for q in find(b, one, two))],
                names=["doc_id", "k", "train", "n_tokens", "hot_known", "hot_log", "ones", "twos"],
            )

    found = _scratch.write_table(source.mapInArrow(look, FOUND), "found")
    if shards > 1:
        _scratch.drop_table(source)
    begin = int(level_of(np.array([max(1, learnt["n"])]))[0])

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows with the levels of their contexts, bigrams and unigrams, and their bounds."""
        for b in tx.slices(batches, "ones", tx.SLICE_BYTES >> 2):
            (q1, upto), (q2, _) = (tx.text_buffer(tx.column(b, c)) for c in ("ones", "twos"))
            first = np.zeros(len(q1), bool)
            first[upto[:-1]] = True  # every text has its end
            yield b, _context(q1, first, begin), q2.astype(np.int64), q1.astype(np.int64), upto

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, ctx, q2, q1, _ in looked(batches):
            code, times = _occurrences((ctx * MAX_LEVEL + q2) * MAX_LEVEL + q1)
            seen = _added(np.concatenate((seen[0], code)), np.concatenate((seen[1], times)))
        yield pa.record_batch([pa.array(seen[0]), pa.array(seen[1])], names=["code", "n"])

    met = found.where("train").select("ones", "twos").mapInArrow(cells, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # combinations of levels
    if met.num_rows:
        code, n = met["code"].to_numpy(), met["n"].to_numpy()
        stats.fit(np.stack((code // MAX_LEVEL**2, code // MAX_LEVEL % MAX_LEVEL, code % MAX_LEVEL, n), 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ctx, q2, q1, upto in looked(batches):
            p = np.add.reduceat(stats.log10(ctx, q2, q1), upto[:-1])
            yield pa.record_batch([*(tx.column(b, c) for c in names), pa.array(p)], names=[*names, "score"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            one, _, _, upto = tokens(tx.column(b, "text"))
            keys = _text_keys(b)
            row = np.repeat(np.arange(b.num_rows), np.diff(upto))
            cold = np.flatnonzero(_hot_counts(one, *hot.value) == 0)
            pair = tx.mix64(row[cold].astype(tx.U64)) ^ one[cold]
            _, first, times = np.unique(pair, return_index=True, return_counts=True)
            at = cold[first]
            mark = tx.signed(tx.mix64(keys.view(tx.U64)) | tx.U64(1))  # one row a text, so that equal rows can be told
            out = np.concatenate((tx.signed(one[at]), mark)), np.concatenate((keys[row[at]], keys)), np.concatenate((times, np.zeros(len(keys), np.int64)))
            yield pa.record_batch([pa.array(out[0]), pa.array(out[1]), pa.array(out[2].astype(np.int32))], names=["key", "k", "times"])

    names = ["doc_id", "k", "n_tokens", "hot_known", "hot_log"]
    main = found.select(*names, "ones", "twos").mapInArrow(scored, "doc_id long, k long, n_tokens long, hot_known long, hot_log double, score double")
    pairs = rows.select("doc_id", "text").mapInArrow(rare, "key long, k long, times int")
    joined = pairs.join(vocabulary, "key", "left")
    equal_rows = F.count(F.when(F.col("times") == 0, 1))
    known_times = F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)
    known = joined.groupBy("k").agg(
        (F.sum(known_times) / equal_rows).cast("long").alias("cold_known"),
        (F.sum(known_times * F.log10(F.coalesce("c", F.lit(0)) + 1)) / equal_rows).alias("cold_log"),
    )
    out = main.join(known, "k", "left")
    total = float(np.log10(stats.n + stats.v + 1))
    return out.select("doc_id", "n_tokens", (F.col("hot_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"), F.lit(stats.n).cast("long").alias("train_tokens"), (F.col("hot_log") + F.coalesce("cold_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)).alias("base_score"), "score")


def _hot_counts(keys: np.ndarray, hot_key: np.ndarray, hot_count: np.ndarray) -> np.ndarray:
    if not len(hot_key):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(hot_key, keys), len(hot_key) - 1)
    return np.where(hot_key[at] == keys, hot_count[at], 0)


def _text_keys(b: pa.RecordBatch) -> np.ndarray:
    """One number for a text and its identifier."""
    buf, offsets = tx.text_buffer(tx.column(b, "text"))
    text = tx.span_hashes(buf, offsets[:-1], offsets[1:], tx.RAW)
    ids = tx.column(b, "doc_id").fill_null(-1).to_numpy().view(tx.U64)
    return tx.signed(tx.mix64(ids * tx.U64(0x9E3779B97F4A7C15) + text))
