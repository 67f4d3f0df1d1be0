"""Line dedup by overlapping three-line windows.

A line ends at a newline and, unless ``sentences`` is off, after ``.``, ``!`` or ``?`` before a blank: passages are
pasted into the middle of paragraphs as often as on lines of their own, and with sentence
ends as borders the windows inside them are the same wherever they stand. Lines are
compared trimmed; blank ones are skipped. Every window of ``window`` consecutive lines with
at least ``min_words`` words (0: every window) is hashed to 128 bits; a window that occurs again anywhere
keeps its first occurrence (by doc_id, then position), and the lines that its later
occurrences cover go. Overlapping covers merge, so whole repeated passages go.

Defined results: null and empty texts have no lines and come back unchanged, as does a text
of fewer than ``window`` lines. Rows without doc_id are not compared. Rows with equal doc_id
count as one document: they lose the same lines (of a shorter row, those it has). Kept lines stay joined by a
newline where one stood between them, else by a blank; an untouched text is returned byte for byte. Other
columns are carried through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _scratch, _skew
from . import _text as tx

WINDOW = 3
MIN_WORDS = 0
_BORDER = np.zeros(256, bool)
_BORDER[[ord(c) for c in ".!?"]] = True


def lines(buf: np.ndarray, offsets: np.ndarray, sentences: bool = True) -> tuple[np.ndarray, ...]:
    """Trimmed non-blank lines: starts, ends, rows, words, and whether a newline stands
    between a line and the one before it."""
    starts, ends, rows = tx.spans(buf, offsets, tx.SPACE)  # words
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    newlines = np.concatenate(([0], np.cumsum(buf == 0x0A)))
    broken = newlines[starts[1:]] > newlines[ends[:-1]]
    blank = buf[np.minimum(ends[:-1], len(buf) - 1)] == 0x20
    cut = np.concatenate(([True], (rows[1:] != rows[:-1]) | broken | (sentences & blank & _BORDER[buf[ends[:-1] - 1]])))
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(starts)) - 1
    fresh = np.concatenate(([False], broken))[first]
    return starts[first], ends[last], rows[first], last - first + 1, fresh


def windows(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, sentences: bool = True) -> DataFrame:
    """``h1, h2, doc_id, pos``: the windows' hashes and first lines."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            buf, offsets = tx.text_buffer(tx.column(b, "text"))
            s, e, rows, n_words, _ = lines(buf, offsets, sentences)
            n = len(s) - window + 1
            if n <= 0:
                continue
            h = tx.span_hashes(buf, s, e, tx.RAW)
            h1, h2, total = np.full(n, 7, tx.U64), np.full(n, 11, tx.U64), np.zeros(n, np.int64)
            for k in range(window):
                h1 = tx.mix64(h1 * tx.U64(0x9FB21C651E98DF25) + h[k : k + n])
                h2 = tx.mix64((h2 ^ h[k : k + n]) * tx.U64(0xD6E8FEB86659FD93))
                total += n_words[k : k + n]
            ok = np.flatnonzero((rows[:n] == rows[window - 1 :]) & (total >= min_words))
            pos = ok - np.searchsorted(rows, rows[ok], "left")
            yield pa.record_batch(
                [pa.array(tx.signed(h1[ok])), pa.array(tx.signed(h2[ok])), tx.column(b, "doc_id").take(pa.array(rows[ok])), pa.array(pos, pa.int32())],
                names=["h1", "h2", "doc_id", "pos"],
            )

    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(emit, "h1 long, h2 long, doc_id long, pos int")


def repeated(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, sentences: bool = True) -> DataFrame:
    """``doc_id, positions``: first lines of all later occurrences of repeated windows.

    Counting pre-aggregates in each task; the join back is on the few repeated hashes, which are
    written, as they are read twice; hot ones are dealt out; the list is bounded by its document."""
    all_windows = windows(docs, window, min_words, sentences)
    place = F.struct("doc_id", "pos")
    first = all_windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    later = _skew.join_counted(all_windows, _scratch.write_table(first, "windows"), ["h1", "h2"]).where(place > F.col("first"))
    return later.groupBy("doc_id").agg(F.collect_set("pos").alias("positions"))


def _cleaned(docs: DataFrame, window: int, min_words: int, sentences: bool) -> DataFrame:
    """The columns of ``docs`` by number, with the text cleaned, and ``n_lines``, ``n_removed``."""
    gone = repeated(docs, window, min_words, sentences).select(F.col("doc_id").alias("id"), F.col("positions").alias("gone"))
    text_at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")
    base = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn(f"c{text_at}", F.col(f"c{text_at}").cast("string"))
    joined = base.join(gone, base[f"c{id_at}"].cast("long") == gone["id"], "left").drop("id")
    n_columns = len(base.columns)
    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_removed", T.IntegerType())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, f"c{text_at}"):
            texts, lists = b.column(text_at), tx.column(b, "gone")
            buf, offsets = tx.text_buffer(texts)
            s, e, rows, _, fresh = lines(buf, offsets, sentences)
            bounds = np.searchsorted(rows, np.arange(b.num_rows + 1), "left")
            touched = np.flatnonzero(np.asarray(lists.is_valid()))
            removed = np.zeros(b.num_rows, np.int32)
            if len(touched):
                raw, out = buf.tobytes(), texts.to_pylist()
                for i in touched.tolist():
                    lo, hi = int(bounds[i]), int(bounds[i + 1])
                    drop = np.zeros(hi - lo + window, bool)
                    at = np.array(lists[i].as_py(), np.int64)
                    at = at[at < hi - lo]
                    for k in range(window):
                        drop[at + k] = True
                    drop = drop[: hi - lo]
                    removed[i] = drop.sum()
                    if not removed[i]:
                        continue
                    breaks = np.concatenate(([0], np.cumsum(fresh[lo:hi])))
                    parts, last = [], -1
                    for k in np.flatnonzero(~drop).tolist():
                        if last >= 0:
                            if k == last + 1:
                                parts.append(raw[e[lo + last] : s[lo + k]])
                            else:
                                parts.append(b"\n" if breaks[k + 1] > breaks[last + 1] else b" ")
                        parts.append(raw[s[lo + k] : e[lo + k]])
                        last = k
                    out[i] = b"".join(parts).decode("utf-8", "replace")
                texts = pa.array(out, pa.string())
            columns = [texts if i == text_at else b.column(i) for i in range(n_columns)]
            yield pa.record_batch([*columns, pa.array(np.diff(bounds), pa.int32()), pa.array(removed)], names=schema.names)

    return joined.mapInArrow(rebuild, schema)


def dedup(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, sentences: bool = True) -> DataFrame:
    """``docs`` with the text cleaned, ``n_lines`` and ``n_removed`` added (clashing columns
    of those names are replaced). Fully repeated documents come back with an empty text."""
    base = docs.drop("n_lines", "n_removed")
    return _cleaned(base, window, min_words, sentences).toDF(*base.columns, "n_lines", "n_removed")


def clean(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, sentences: bool = True) -> DataFrame:
    """The columns of ``docs`` and no others: texts cleaned, documents that lost all their lines left
    out, and ``n_chars``, where there is one, renewed for those that lost any."""
    out = _cleaned(docs, window, min_words, sentences)
    text = F.col(f"c{docs.columns.index('text')}")
    out = out.where((F.col("n_removed") == 0) | (text != ""))
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(n, F.when(F.col("n_removed") > 0, F.length(text).cast(out.schema[n].dataType)).otherwise(F.col(n)))
    return out.drop("n_lines", "n_removed").toDF(*docs.columns)
