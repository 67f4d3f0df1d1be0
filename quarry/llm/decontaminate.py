"""Benchmark decontamination by SimHash over item-sized windows.

Words are lower-cased runs of letters and digits. For an item of n words, every run of n
words of a document is a window (a shorter document is one window). A window's fingerprint
is the 64-bit SimHash of its weighted five-word shingles (weight: multiplicity). The items'
fingerprints are indexed in four 16-bit blocks, each with all values within
``RADIUS // 4`` bits: by the pigeonhole principle every fingerprint within ``RADIUS`` bits
shares a block entry, so the index misses none; the full distance is then tested, and what
is left is verified by exact weighted-shingle similarity.

Windows that share no shingle with any item have similarity 0 to all of them; they are
ruled out by one lookup per shingle, before any fingerprint is made. Sums for neighbouring windows are differences of prefix
sums. At similarity 0.8 the expected distance is 9.7 bits with a deviation of 2.9, so the
radius of 19 loses about one aligned window in 3,000.

Items are the stated query set: they are taken in blocks of about ``BLOCK_ITEMS / 2``, each with an
index of some 40 KB an item, one block after another: a block's matches are written and its broadcast is freed
before the next is made. Where there are several, the corpus is read once: a bitmap of all items' shingles
(``BITMAP_BITS``) lets through the documents that may hold one, and the blocks read those.

Defined results: null and empty texts, and items without words, match nothing; an item of
fewer than five words is one shingle. Equal items are all reported, rows that repeat an item once. Rows with equal doc_id
are reported as one. Without items, or documents, there is no row. Other columns are not read by ``matches`` and carried
through by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch
from . import _text as tx
from .near_dedup import multiset_similarity

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 19
BLOCKS = 4
BLOCK_ITEMS = 1024
CHUNK = 1 << 15
BITMAP_BITS = 1 << 28
FOUND = "doc_id long, item_id long, start_word int, n_words int, similarity double, hamming int"


def simhash(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs [start, end) of ``shingles``."""
    out = np.empty(len(starts), tx.U64)
    bits = np.unpackbits(tx.mix64(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits.astype(np.int8) * 2 - 1, axis=0, dtype=np.int32, out=sums[1:])
    for at in range(0, len(starts), CHUNK):
        s = slice(at, at + CHUNK)
        positive = sums[ends[s]] - sums[starts[s]] > 0
        out[s] = np.packbits(positive, axis=1, bitorder="little").view(tx.U64).ravel()
    return out


def _ball(radius: int) -> np.ndarray:
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= radius]


class Index:
    """Items of one shingle width: their shingles, and their fingerprints by length."""

    def __init__(self, items: list[tuple[int, np.ndarray]], width: int):
        self.width = width
        self.ids = np.array([i for i, _ in items])
        self.words = np.array([len(w) for _, w in items])
        bounds = np.concatenate(([0], np.cumsum(self.words)))
        self.grams, self.bounds = tx.shingles(np.concatenate([w for _, w in items]), bounds, width)
        self.prints = simhash(self.grams, self.bounds[:-1], self.bounds[1:])
        owner = np.repeat(np.arange(len(items)), np.diff(self.bounds))
        lengths = self.words[owner]
        seen = np.unique(np.stack((tx.signed(self.grams), lengths)), axis=1)
        # shingle -> item lengths (not items: a window is tried against every item of its length)
        order = np.lexsort((seen[1], seen[0].view(tx.U64)))
        keys = seen[0].view(tx.U64)[order]
        self.keys, self.first = np.unique(keys, return_index=True)
        self.last = np.append(self.first[1:], len(keys))
        self.lengths = seen[1][order]
        # block value -> items, for each length and block
        ball = _ball(RADIUS // BLOCKS)
        self.tables = {}
        for n in np.unique(self.words):
            own = np.flatnonzero(self.words == n)
            for k in range(BLOCKS):
                part = (self.prints[own] >> tx.U64(16 * k)).astype(np.uint16)
                near = (part[:, None] ^ ball[None, :]).ravel()
                order = np.argsort(near, kind="stable")
                self.tables[int(n), k] = (near[order], np.repeat(own, len(ball))[order].astype(np.int32))

    def near(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Window and item numbers within the radius."""
        pairs = []
        for k in range(BLOCKS):
            values, entries = self.tables[n, k]
            part = (prints >> tx.U64(16 * k)).astype(np.uint16)
            begin = np.searchsorted(values, part, "left")
            count = np.searchsorted(values, part, "right") - begin
            w = np.repeat(np.arange(len(prints)), count)
            e = entries[np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)].astype(np.int64)
            close = np.bitwise_count(prints[w] ^ self.prints[e]) <= RADIUS
            pairs.append(w[close] * len(self.ids) + e[close])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.ids), both % len(self.ids)

    def find(self, hashes: np.ndarray, bounds: np.ndarray, threshold: float) -> list[tuple[np.ndarray, ...]]:
        """Row, item, first word, words, similarity and distance of the matching windows."""
        grams, gb = tx.shingles(hashes, bounds, self.width)
        if not len(grams):
            return []
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == grams)
        if not len(hit):
            return []
        out = []
        of = at[hit]
        count = self.last[of] - self.first[of]
        pos = np.repeat(hit, count)
        size = self.lengths[np.arange(len(pos)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[of], count)]
        row = np.searchsorted(gb, pos, "right") - 1
        for n in np.unique(size):
            mine = size == n
            p, r = pos[mine], row[mine]
            m = max(1, n - self.width + 1)  # shingles of a window
            have = gb[r + 1] - gb[r]
            m_row = np.minimum(m, have)
            lo = np.maximum(p - m_row + 1, gb[r])
            hi = np.minimum(p, gb[r + 1] - m_row)
            begins = _union(lo, hi + 1)
            r = np.searchsorted(gb, begins, "right") - 1
            ends = begins + np.minimum(m, gb[r + 1] - gb[r])
            used = np.zeros(len(grams) + 1, np.int32)
            np.add.at(used, begins, 1)
            np.add.at(used, ends, -1)
            inside = np.flatnonzero(np.cumsum(used)[:-1] > 0)
            prints = simhash(grams[inside], np.searchsorted(inside, begins), np.searchsorted(inside, ends))
            for a in range(0, len(prints), CHUNK):
                w, item = self.near(prints[a : a + CHUNK], int(n))
                w += a
                if not len(w):
                    continue
                s = self._similarity(grams, begins[w], ends[w], item)
                ok = np.flatnonzero(s >= threshold)
                w, item = w[ok], item[ok]
                out.append((r[w], item, begins[w] - gb[r[w]], ends[w] - begins[w] + self.width - 1, s[ok], np.bitwise_count(prints[w] ^ self.prints[item])))
        return out

    def _similarity(self, grams, begins, ends, item) -> np.ndarray:
        parts = []
        for side, (b, e, source) in enumerate(((begins, ends, grams), (self.bounds[item], self.bounds[item + 1], self.grams))):
            count = e - b
            pair = np.repeat(np.arange(len(b)), count)
            g = source[np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(b, count)]
            parts.append((tx.mix64(pair.astype(tx.U64)) ^ g, np.full(len(pair), side), pair))
        return multiset_similarity(*(np.concatenate(x) for x in zip(*parts, strict=True)), len(begins))


def _union(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers in any of the ranges [lo, hi)."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    begin = np.maximum(lo, np.concatenate(([0], hi[:-1])))
    count = np.maximum(hi - begin, 0)
    return np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _index(items: list) -> list[Index]:
    h, bounds = _words(items)
    by_width: dict[int, list] = {}
    for i, r in enumerate(items):
        n = int(bounds[i + 1] - bounds[i])
        if n:
            by_width.setdefault(min(SHINGLE, n), []).append((r["item_id"], h[bounds[i] : bounds[i + 1]]))
    return [Index(x, width) for width, x in sorted(by_width.items())]


def _words(items: list) -> tuple[np.ndarray, np.ndarray]:
    return tx.words(pa.array([r["text"] for r in items], pa.string()), tx.NOT_ALNUM, fold=True)


def _may_match(slim: DataFrame, blocks: Iterator[list]) -> DataFrame:
    """The documents that share a shingle with an item, and few others, written."""
    bits, widths = np.zeros(BITMAP_BITS // 64, tx.U64), set()
    shift = tx.U64(64 - BITMAP_BITS.bit_length() + 1)
    for items in blocks:
        h, bounds = _words(items)
        size = np.diff(bounds)
        widths |= set(np.unique(np.minimum(size[size > 0], SHINGLE)).tolist())
        at = tx.shingles(h, bounds, SHINGLE)[0] >> shift
        np.bitwise_or.at(bits, (at >> tx.U64(6)).astype(np.int64), tx.U64(1) << (at & tx.U64(63)))
    shared = slim.sparkSession.sparkContext.broadcast(bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            h, bounds = tx.words(tx.column(b, "text"), tx.NOT_ALNUM, fold=True)
            rows = [np.zeros(0, np.int64)]
            for width in widths:
                grams, upto = tx.shingles(h, bounds, width)
                at = grams >> shift
                hit = np.flatnonzero(shared.value[(at >> tx.U64(6)).astype(np.int64)] >> (at & tx.U64(63)) & tx.U64(1))
                rows.append(np.searchsorted(upto, hit, "right") - 1)
            yield b.take(pa.array(np.unique(np.concatenate(rows))))

    return _scratch.write_table(slim.mapInArrow(pick, "doc_id long, text string"), "may-match")


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id`` and the most similar window of each such pair: ``start_word,
    n_words, similarity, hamming``. The rows are the contaminated documents' only."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    n_blocks = max(1, -(-items.count() // (BLOCK_ITEMS // 2)))
    keyed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if n_blocks > 1:
        slim = _may_match(slim, (keyed.where(F.col("block") == k).collect() for k in range(n_blocks)))

    def one_block(k: int) -> DataFrame:
        index = spark.sparkContext.broadcast(_index(keyed.where(F.col("block") == k).collect()))  # about BLOCK_ITEMS / 2 rows

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in tx.slices(batches, most=1 << 19):
                h, bounds = tx.words(tx.column(b, "text"), tx.NOT_ALNUM, fold=True)
                for one in index.value:
                    for r, item, start, n, s, d in one.find(h, bounds, threshold):
                        yield pa.record_batch(
                            [tx.column(b, "doc_id").take(pa.array(r)), pa.array(one.ids[item]), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(s), pa.array(d.astype(np.int32))],
                            names=["doc_id", "item_id", "start_word", "n_words", "similarity", "hamming"],
                        )

        matched = slim.mapInArrow(search, FOUND)
        if n_blocks == 1:
            return matched
        matched = _scratch.write_table(matched, "matches")
        index.destroy()
        return matched

    found = reduce(DataFrame.unionByName, (one_block(k) for k in range(n_blocks)))
    best = F.max_by(F.struct("start_word", "n_words", "similarity", "hamming"), F.struct("similarity", -F.col("start_word"), -F.col("hamming")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold an item; rows without doc_id stay."""
    bad = matches(docs, items, threshold).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["__id"], "left_anti")
