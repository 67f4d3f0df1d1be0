"""Importance resampling of documents towards the distribution of a target corpus.

A document's features are its runs of one to three words, counted in hashed buckets. Two counting passes (each task adds up an array of
``buckets`` numbers and sends that) give the counts of both corpora and from them an array of gains, one a bucket,
that scores any document: its weight is the sum of the gains of its features. Noise from a hash of doc_id turns the highest
scores into a draw without replacement (Gumbel's way).

The highest k scores are found without sorting documents. Documents with enough words are counted by exact
integer score; the histogram is summed from its upper end, first over coarse bins (floating-point like, under
30,000 of them whatever the scores), then within each bin, so that every score knows how many documents lie above
it. Those with fewer than k above survive; a survivor's rank is that offset and its row number by doc_id within its score, and
ranks beyond k fall away. The noise spreads copies of a text over thousands of scores (no score can hold more than about 0.04 % of
equal weights with different identifiers), so windows by score stay small.

Defined results: words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased; a null or
empty text has none and weight 0. Texts are read in blocks of ``BLOCK`` bytes with the last two words carried over, so long ones need
no more memory than their bytes. A null doc_id reads as an empty one and is the least in ties; repeated rows count and rank each for itself. An
empty table gives an empty result; an empty target makes all gains those of t = 0. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _crc, _scratch, _text

BLOCK = 1 << 20
BUCKETS = 10_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def _cut(buf: np.ndarray, offsets: np.ndarray, end: int) -> int:
    """The first place from ``end`` on where no word is cut in two."""
    row = int(offsets[np.searchsorted(offsets, end, "left")])
    while end < row:
        here = np.flatnonzero(_BETWEEN[_LOWER[buf[end : min(row, end + 4096)]]])
        if len(here):
            return end + int(here[0])
        end = min(row, end + 4096)
    return row


def features(column: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (bucket of each feature, its row, rows of the words) of a text column."""
    raw, offsets = _text.text_buffer(column)
    last, last_rows, at = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
    lengths = np.zeros(0, np.int64)
    while at < len(raw):
        end = _cut(raw, offsets, at + BLOCK) if at + BLOCK < len(raw) else len(raw)
        r0, r1 = int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, end, "left"))
        buf = _LOWER[raw[at:end]]
        starts, ends, rows = _text.spans(buf, np.clip(offsets[r0 : r1 + 1], at, end) - at, _BETWEEN)
        k = len(last)
        crc, rows = np.concatenate((last, _crc.of_spans(buf, starts, ends))), np.concatenate((last_rows, rows + r0))
        size = np.concatenate((lengths, ends - starts))
        two = np.flatnonzero(rows[1:] == rows[:-1]) + 1
        pair = np.zeros(len(crc), np.uint32)
        pair[two] = _crc.shifted(_crc.spaced(crc[two - 1]), size[two]) ^ crc[two]
        three = two[(two > 1)]
        three = three[rows[three - 2] == rows[three]]
        triple = _crc.shifted(_crc.spaced(pair[three - 1]), size[three]) ^ crc[three]
        two, triple, three = two[two >= k], triple[three >= k], three[three >= k]
        found = np.concatenate((crc[k:], pair[two], triple)) % np.uint32(buckets)
        yield found.astype(np.int64), np.concatenate((rows[k:], rows[two], rows[three])), rows[k:]
        last, last_rows, lengths, at = crc[-2:], rows[-2:], size[-2:], end


def bucket_counts(df: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts of ``df``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found, _, _ in features(batch.column(0), buckets):
                total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    counted = df.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket at most
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed ratio of frequencies, rounded down, by bucket."""
    n, s_all, t_all = len(raw), float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * s_all / ((float(raw[b]) + 1) * t_all))) for b in range(n)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, words = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for found, rows, of_words in features(batch.column(1), len(gain)):
                if len(rows):
                    first = int(rows.min())
                    here = np.bincount(rows - first, weights=gain[found])
                    total[first : first + len(here)] += here.astype(np.int64)
                    words[first : first + len(here)] += np.bincount(of_words - first, minlength=len(here))
            made = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(made), pa.array(total)], ["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long")


def _noise(seed: int) -> Column:
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _coarse(score: str) -> Column:
    """A bin of the score: its sign, binary exponent and eight more bits; rises with it."""
    size = F.expr(f"if({score} >= 256 or {score} <= -256, floor(log2(abs({score}))) * 256 + shiftright(abs({score}), cast(floor(log2(abs({score}))) - 8 as int)), abs({score}))")
    return (F.signum(F.col(score)) * size).cast("long")


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row; rank is null where a document is not drawn."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + _noise(seed))
    scored = _scratch.write_table(scored, "scores")
    able = F.col("n_words") >= least_words
    counts = scored.where(able).groupBy(_coarse("score").alias("bin"), "score").agg(F.count("*").alias("n"))
    counts = _scratch.write_table(counts, "score_counts")
    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = counts.groupBy("bin").agg(F.sum("n").alias("n"))
    k = (bins.agg(F.sum("n")).first()[0] or 0) * percent // 100
    bins = bins.select("bin", above(Window.orderBy(F.desc("bin"))).alias("over")).where(F.col("over") < k)
    offsets = counts.join(F.broadcast(bins), "bin")  # under 30,000 bins
    offsets = offsets.select("score", (F.col("over") + above(Window.partitionBy("bin").orderBy(F.desc("score")))).alias("over")).where(F.col("over") < k)
    offsets = _scratch.write_table(offsets, "offsets")
    cutoff = offsets.agg(F.min("score")).first()[0]
    out = ["doc_id", "n_features", "weight", "score"]
    nothing = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return scored.select(*out, nothing)
    stays = able & (F.col("score") >= cutoff)
    place = F.col("over") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features"))
    drawn = scored.where(stays).join(offsets, "score").withColumn("rank", place)
    drawn = drawn.select(*out, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return drawn.union(scored.where(~stays).select(*out, nothing))
