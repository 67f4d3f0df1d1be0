"""Language identification with a string kernel.

A text is the set of its character n-grams of each order in ``ORDERS`` (ASCII and Latin-1 letters lower-cased, words
padded by blanks; presence, not counts). The blended-spectrum presence kernel of two texts is the mean over
orders of |A n B| / sqrt(|A| |B|). Nystroem landmarks turn it into explicit features
K(x, L) K(L, L)^(-1/2), on which one-versus-rest kernel ridge regression is solved in
closed form. Grams are hashed to ``BUCKETS`` bits for each order, so a batch of texts is a
0/1 matrix, and scoring is matrix products: batch x landmarks, then x languages.

The model is fitted on at most ``PER_LANG`` labelled texts of each language (those with
the least hash of doc_id; fewer, but 20 at least, beyond 66 languages), of which ``LANDMARKS`` in all
are landmarks, or one a language where there are more languages. Every label is learned. Of rows that share a
doc_id, the one with the least hash of its text is fitted, so repeated rows change nothing. Fitting and
prediction read whole texts; their presence is computed in the executors, and only its bits come to
the driver.

A text is recognised unless most of its distinct characters, and ``STRANGE`` at least, stand in no landmark
text: then it is in a script that was not learned, and the regressions say nothing about it.
``keep_known`` keeps it and its label, unless told to drop it; what has no letter goes, and ``lang`` is filled in where it is null.

Defined results: a null text, and one without any letter, is ``und`` with score 0, as is
every text if no label can be learned. An empty table gives an empty result. Rows are predicted each for itself, so repeated rows
get equal results. Extra columns are ignored by ``predict`` and kept by ``keep_known``, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as tx

ORDERS = (1, 2, 3)
BUCKETS = 4096
PER_LANG = 300
FEW_LABELS = 100_000
LANDMARKS = 160
RIDGE = 1e-3
SHARPNESS = 6.0
ROWS = 256
STRANGE = 5
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")


def presence(column: pa.Array) -> np.ndarray:
    """0/1 (float32) of rows x orders x buckets."""
    buf, offsets = tx.text_buffer(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(ORDERS), BUCKETS), np.float32)
    if not len(buf):
        return out
    buf = tx.fold_latin1(buf).copy()
    upper = (buf >= 65) & (buf <= 90)
    buf[upper] += 32
    # whatever is no letter is one blank to the grams; UTF-8 continuations belong to letters
    inside = (buf >= 0x80) | ((buf >= 97) & (buf <= 122))
    # characters: first bytes of letters, and one blank for each run of other bytes
    head = inside & ((buf & 0xC0) != 0x80)
    gap = ~inside
    gap[1:] &= inside[:-1]
    at = np.flatnonzero(head | gap)
    row = np.searchsorted(offsets, at, "right") - 1
    wide = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.uint32)
    code = wide[at]
    lead = code
    for k in (1, 2, 3):
        more = lead >= (0xC0, 0xE0, 0xF0)[k - 1]
        code = np.where(more, code << 8 | wide[at + k], code)
    code = np.where(inside[at], code, 32)
    value = np.zeros(len(code), np.uint32)
    for k in range(max(ORDERS)):
        m = len(code) - k
        if m <= 0:
            break
        value = (value[:m] * np.uint32(0x01000193)) ^ (code[k:] * np.uint32(0x9E3779B1))
        if k + 1 in ORDERS:
            whole = row[:m] == row[k:]
            mixed = value * np.uint32(0x85EBCA6B)
            bucket = (mixed >> np.uint32(32 - 12)) & np.uint32(BUCKETS - 1)
            out[row[:m][whole], ORDERS.index(k + 1), bucket[whole]] = 1
    return out


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Blended presence kernel of two sets of texts (rows x orders x buckets each)."""
    out = np.zeros((len(x), len(y)), np.float32)
    for k in range(len(ORDERS)):
        a, b = x[:, k], y[:, k]
        norm = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None, :]
        out += a @ b.T / norm
    return out / len(ORDERS)


def packed(x: np.ndarray) -> np.ndarray:
    """Presence as bits, a row a text."""
    return np.packbits(x.reshape(len(x), -1).astype(bool), axis=1)


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).reshape(len(bits), len(ORDERS), BUCKETS).astype(np.float32)


class Model:
    """Landmark texts' presence and the regression's weights, folded into one matrix."""

    def __init__(self, bits: np.ndarray, langs: list[str]):
        """``bits``: packed presence of the texts, in hash order."""
        count = Counter(langs)
        self.langs = sorted(count)
        if not langs:
            return
        # landmarks: evenly from the languages, in the given (hash) order
        nth = np.zeros(len(langs), np.int64)
        met: dict[str, int] = {}
        for i, lang in enumerate(langs):
            nth[i] = met[lang] = met.get(lang, -1) + 1
        chosen = np.argsort(nth, kind="stable")[: max(LANDMARKS, len(self.langs))]
        self.landmarks = unpacked(bits[chosen])
        values, vectors = np.linalg.eigh(kernel(self.landmarks, self.landmarks).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        zz, zy = np.zeros((root.shape[1] + 1,) * 2), np.zeros((root.shape[1] + 1, len(self.langs)))
        for i in range(0, len(langs), ROWS):
            here = np.array(langs[i : i + ROWS])
            y = np.where(here[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
            z = kernel(unpacked(bits[i : i + ROWS]), self.landmarks).astype(np.float64) @ root
            z = np.concatenate((z, np.ones((len(z), 1))), 1)
            balance = np.array([1 / count[lang] for lang in here.tolist()])[:, None] * len(langs) / len(self.langs)
            zz += z.T @ (balance * z)
            zy += z.T @ (balance * y)
        weights = np.linalg.solve(zz + RIDGE * len(langs) * np.eye(len(zz)), zy)
        self.weights, self.bias = root @ weights[:-1], weights[-1]
        self.characters = self.landmarks[:, 0].any(0)

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts x languages, and whether a text is in a script that was learned."""
        x = presence(column)
        strange = x[:, 0, ~self.characters].sum(1)
        return kernel(x, self.landmarks) @ self.weights + self.bias, (strange < STRANGE) | (2 * strange < x[:, 0].sum(1))


def fit(labelled: DataFrame) -> Model:
    """Fit on a bounded sample of ``labelled(doc_id, text, lang)``."""
    named = labelled.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = named.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("__c"))  # repeated rows are one document
    many = counts.count()
    per_lang = min(PER_LANG, max(20, 20_000 // max(1, many)))
    # under this bound of the hash lie somewhat more rows of a label than are picked, so that no task sorts all of a label's
    share = (1.5 * per_lang + 100) / F.col("__c")
    counts = counts.select("lang", F.when(share < 1, (share * float(1 << 64) - float(1 << 63)).cast("long")).alias("__bound"))
    order = Window.partitionBy("lang").orderBy("__h", "doc_id")
    hashed = named.select("lang", "doc_id", F.xxhash64("doc_id", F.lit(11)).alias("__h")).join(F.broadcast(counts) if many <= FEW_LABELS else counts, "lang")
    ids = hashed.where(F.col("__bound").isNull() | (F.col("__h") < F.col("__bound"))).select("lang", "doc_id", "__h").distinct()
    picked = ids.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_lang)
    # the picked identifiers are few; texts are then fetched by a filter, without a shuffle of texts
    wanted = {(r["doc_id"]) for r in picked.select("doc_id").collect()}
    rows = _bits(named.where(F.col("doc_id").isin(list(wanted)))).collect() if wanted else []
    rows.sort(key=lambda r: (int(tx.mix64(np.array([r["doc_id"] & (1 << 64) - 1], np.uint64))[0]), r["doc_id"]))
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, 1), np.uint8)
    return Model(bits, [r["lang"] for r in rows])


def _bits(named: DataFrame) -> DataFrame:
    """``doc_id, lang, bits``: packed presence of whole texts that have a letter, one row a doc_id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in tx.slices(batches):
            for at in range(0, big.num_rows, ROWS):
                b = big.slice(at, ROWS)
                b = b.filter(pa.array([_LETTER.search(t) is not None for t in tx.column(b, "text").to_pylist()], pa.bool_()))
                bits = packed(presence(tx.column(b, "text")))
                yield pa.record_batch([tx.column(b, "doc_id"), tx.column(b, "lang"), tx.column(b, "h"), pa.array([r.tobytes() for r in bits], pa.binary())], names=["doc_id", "lang", "h", "bits"])

    made = named.select("doc_id", "lang", "text", F.xxhash64("text").alias("h")).mapInArrow(emit, "doc_id long, lang string, h long, bits binary")
    return made.groupBy("doc_id").agg(F.min(F.struct("h", "lang", "bits")).alias("x")).select("doc_id", "x.lang", "x.bits")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _score(slim, ["doc_id"], "text", model, "doc_id long").drop("recognised")


def _score(docs: DataFrame, carried: list[str], text: str, model: Model, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x BUCKETS, and a column a language

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for big in tx.slices(batches, text):
            for at in range(0, big.num_rows, ROWS):
                b = big.slice(at, ROWS)
                texts = tx.column(b, text)
                lettered = np.array([bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
                if m.langs:
                    margin, known = m.margins(texts)
                    p = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    lang = [m.langs[k] if ok else UND for k, ok in zip(best, lettered, strict=True)]
                    value = np.where(lettered, p[np.arange(len(best)), best], 0.0)
                    known &= lettered
                else:
                    lang, value, known = [UND] * b.num_rows, np.zeros(b.num_rows), lettered
                yield pa.record_batch([*(tx.column(b, c) for c in carried), pa.array(lang, pa.string()), pa.array(value.astype(np.float64)), pa.array(known)], names=[*carried, "lang_pred", "score", "recognised"])

    return docs.mapInArrow(score, f"{schema}, lang_pred string, score double, recognised boolean")


def keep_known(docs: DataFrame, model: Model, unlearned: bool = True) -> DataFrame:
    """``docs`` without the texts that have no letter; with ``unlearned=False`` those in a script that was not learned go too. A null ``lang``,
    where there is that column, becomes the predicted one if the script was learned; all else stays as it is, a label that the prediction contradicts too."""
    names = docs.columns
    text, lang = f"c{names.index('text')}", f"c{names.index('lang')}" if "lang" in names else None
    base = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn(text, F.col(f"c{names.index('text')}").cast("string"))
    scored = _score(base, base.columns, text, model, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields))
    scored = scored.where((F.col("lang_pred") != UND) | F.col("recognised") if unlearned else F.col("recognised"))
    if lang:
        made = F.when(F.col("recognised"), F.nullif("lang_pred", F.lit(UND)).cast(base.schema[lang].dataType))
        scored = scored.withColumn(lang, F.coalesce(lang, made))
    return scored.select(*base.columns).toDF(*names)
