"""Scores of all chunks against a block of questions, as matrix products over Arrow batches.

A text is cut into tokens once, on the JVM side, and counted in its own row (``counted``): terms and how often each occurs. Every block of
questions reads those counts and the vectors, no text. A batch of rows is a matrix of term counts and one of
vectors; multiplied with the questions' term weights and vectors they give every score of the batch. Scores are never shuffled.

Hybrid scores are scaled by extremes over all chunks, which are known at the end only. So a task keeps, for each question, the *k-skyband* of its
(semantic, keyword) pairs: those that fewer than k others are at least as good as on both counts. Whatever the
scaling, the k best are among them; bands of tasks merge like sets, and the extremes come along. One pass over the counts is
enough, and a few rows a question and task move.

Questions are taken in blocks of at most ``QUESTIONS`` and so that terms times questions stay within ``CELLS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text as tx
from ..sources import shared

QUESTIONS = 1024
#: Cells of the largest matrix.
CELLS = 1 << 22
#: Tokens or terms that are worked on at once, and cells of a piece's matrices: what a batch of rows needs besides itself.
PIECE, PIECE_CELLS = 1 << 18, 1 << 20
#: Steps of the staircase that rows must pass to be looked at, and rows that are compared at once.
STEPS, ROWS = 8, 512


def blocks_of(queries: DataFrame) -> Iterator[DataFrame]:
    """``queries`` in blocks of about ``QUESTIONS`` rows, fewer where they are long."""
    size = F.coalesce(F.size(tx.tokenize(F.col("question"))), F.lit(0)) if "question" in queries.columns else F.lit(0)
    rows, tokens, longest = queries.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    most = 4 * CELLS
    n = max(1, -(-rows // QUESTIONS), int((tokens * rows / most) ** 0.5) + 1 if tokens * rows > most else 1, min(rows, -(-longest * rows // most)))
    for k in range(n):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) if n > 1 else queries


def _floats(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths (0 for nulls, and for vectors with a null), starts and flat values of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    starts = np.cumsum(n) - n
    if flat.null_count:
        rows = np.repeat(np.arange(len(n)), n)
        n[rows[np.asarray(flat.is_null())]] = 0
    return n, starts, flat.to_numpy(zero_copy_only=False).astype(np.float64)


def pieces(sizes: np.ndarray, most: int = PIECE, rows: int | None = None) -> Iterator[slice]:
    """Runs of rows whose ``sizes`` sum to at most ``most`` (a larger row is a run of its own), of at most ``rows`` rows."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        end = min(end, at + rows) if rows else end
        yield slice(at, end)
        at = end


def lengths(listed: pa.Array) -> np.ndarray:
    """Lengths of lists, 0 for nulls."""
    return pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Questions:
    """A block of questions: identifiers, terms with their weights, vectors by length."""

    ids: pa.Array
    vocabulary: pa.Array
    repeats: np.ndarray  # vocabulary x questions
    vectors: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    weights: np.ndarray | None = None
    average: float = 0.0

    @classmethod
    def collect(cls, queries: DataFrame) -> Questions:
        has = queries.columns
        rows = queries.select(
            "query_id",
            (F.coalesce(tx.tokenize(F.col("question")), F.array()) if "question" in has else F.array()).cast("array<string>").alias("tokens"),
            (F.col("query_embedding") if "query_embedding" in has else F.lit(None)).cast("array<double>").alias("v"),
        ).toArrow()
        tokens = rows["tokens"].combine_chunks()
        flat = tokens.flatten()
        vocabulary = flat.unique()
        repeats = np.zeros((len(vocabulary), rows.num_rows))
        if len(flat):
            np.add.at(repeats, (pc.index_in(flat, value_set=vocabulary).to_numpy(), np.repeat(np.arange(rows.num_rows), pc.list_value_length(tokens).to_numpy())), 1)
        n, starts, values = _floats(rows["v"])
        out = cls(rows["query_id"].combine_chunks(), vocabulary, repeats)
        for d in np.unique(n[n > 0]).tolist():
            own = np.flatnonzero(n == d)
            out.vectors[d] = own, values[starts[own][:, None] + np.arange(d)]
        return out

    def weigh(self, n: int, average: float, frequency: np.ndarray) -> None:
        self.weights = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))[:, None] * self.repeats
        self.average = average

    def named(self, spark) -> DataFrame:
        """``q, query_id``."""
        schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("query_id", T._parse_datatype_string(_ddl(self.ids.type)))])
        return spark.createDataFrame(list(enumerate(self.ids.to_pylist())), schema)


def _counts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The tokens in the last column, counted row by row."""
    for whole in batches:
        for own in pieces(lengths(whole.column(whole.num_columns - 1))):
            b = whole.slice(own.start, own.stop - own.start)
            listed = b.column(b.num_columns - 1)
            dl = lengths(listed)
            coded = listed.flatten().dictionary_encode()
            words = max(1, len(coded.dictionary))
            code, times = np.unique(np.repeat(np.arange(b.num_rows), dl) * words + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            bounds = pa.array(np.searchsorted(code, np.arange(b.num_rows + 1) * words), pa.int32())
            terms = pa.ListArray.from_arrays(bounds, coded.dictionary.take(pa.array(code % words)))
            tf = pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32()))
            yield pa.record_batch([*b.columns[:-1], pa.array(dl), terms, tf], names=names)


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``dl``, ``terms`` and ``tf``: each text counted in its own row."""
    tokens = F.coalesce(tx.tokenize(F.col(text)), F.array().cast("array<string>"))
    rows = docs.select(*[c for c in docs.columns if c != text], tokens.alias("__tokens"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]), *schemas.COUNTS.fields])
    names = schema.names
    return rows.mapInArrow(lambda batches: _counts(batches, names), schema)


def counted(chunks: DataFrame, key: str) -> DataFrame:
    """``key, dl, terms, tf, embedding`` of every chunk, written: once a corpus, for all questions."""
    vector = F.col("embedding") if "embedding" in chunks.columns else F.lit(None)
    rows = shared.spread(chunks.select(F.col(key).alias("key"), vector.cast("array<double>").alias("embedding"), "text"))
    return shared.write_table(term_counts(rows).select("key", "dl", "terms", "tf", "embedding"), "counts")


def weigh(rows: DataFrame, asked: Questions, stats: tuple[int, float] | None = None) -> None:
    """Corpus statistics of counted rows, for the questions' weights."""
    if stats is None:
        s = rows.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
        stats = s[0], s[1]
    vocabulary = rows.sparkSession.sparkContext.broadcast(asked.vocabulary)

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocabulary.value), np.int64)
        for b in batches:
            for own in pieces(lengths(b.column(0))):
                at = pc.index_in(b.column(0)[own].flatten(), value_set=vocabulary.value).drop_null().to_numpy()
                n += np.bincount(at, minlength=len(n))
        met = np.flatnonzero(n)
        yield pa.record_batch([pa.array(met), pa.array(n[met])], names=["t", "n"])

    df = np.zeros(len(asked.vocabulary))
    for t, n in rows.select("terms").mapInArrow(holds, "t long, n long").groupBy("t").agg(F.sum("n")).collect():  # the questions' terms
        df[t] = n
    vocabulary.destroy()
    asked.weigh(stats[0], stats[1], df)


def _keyword(b: pa.RecordBatch, asked: Questions, k1: float, b_: float) -> np.ndarray:
    n, m = b.num_rows, len(asked.ids)
    out = np.zeros((n, m))
    if asked.weights is None or not len(asked.vocabulary) or not asked.average > 0:
        return out
    dl = b.column(1).to_numpy()
    for own in pieces(lengths(b.column(2)), rows=max(1, PIECE_CELLS // len(asked.vocabulary))):
        listed, times = b.column(2)[own], b.column(3)[own].flatten().to_numpy()
        terms = pc.fill_null(pc.index_in(listed.flatten(), value_set=asked.vocabulary), -1).to_numpy(zero_copy_only=False)
        met = terms >= 0
        rows, terms, times = np.repeat(np.arange(len(listed)), lengths(listed))[met], terms[met], times[met].astype(np.float64)
        part = times * (k1 + 1) / (times + k1 * (1 - b_ + b_ * dl[own][rows] / asked.average))
        held, where = np.unique(terms, return_inverse=True)
        x = np.zeros((len(listed), len(held)))
        x[rows, where] = part
        np.matmul(x, asked.weights[held], out=out[own])
    return out


def _semantic(b: pa.RecordBatch, asked: Questions) -> np.ndarray:
    out = np.zeros((b.num_rows, len(asked.ids)))
    n, starts, values = _floats(b.column(4))
    for d, (at, q) in asked.vectors.items():
        own = np.flatnonzero(n == d)
        v = values[starts[own][:, None] + np.arange(d)]
        scale = np.sqrt((v * v).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None, :]
        with np.errstate(all="ignore"):
            out[np.ix_(own, at)] = np.where(scale > 0, (v @ q.T) / scale, 0.0)
    return out


def _order(rows: list) -> np.ndarray:
    """Place of each key in ascending order, nulls first."""
    plain = [tuple((x is not None, x) for x in (r.values() if isinstance(r, dict) else (r,))) for r in rows]
    out = np.empty(len(rows), np.int64)
    out[sorted(range(len(rows)), key=plain.__getitem__)] = np.arange(len(rows))
    return out


def _best(r: np.ndarray, keys: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and questions of the ``k`` highest in each column of ``r``, ties to the lesser key."""
    rows, columns, order = [], [], None
    for q in range(r.shape[1]):
        s = r[:, q]
        found = np.arange(len(s))
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            found = np.flatnonzero(s >= least)
            if len(found) > k:
                order = _order(keys.to_pylist()) if order is None else order
                found = found[np.lexsort((order[found], -s[found]))[:k]]
        found = found[s[found] > -np.inf]
        rows.append(found)
        columns.append(np.full(len(found), q))
    return np.concatenate(rows), np.concatenate(columns)


@dataclass
class Band:
    """The k-skyband of the pairs seen so far for one question. A pair counts as better than another if it is no less on both
    counts and either above it by a margin, so that it stays above when scores are scaled and rounded, or of a lesser key."""

    k: int
    margin: tuple[float, float]
    s: np.ndarray = field(default_factory=lambda: np.zeros(0))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    keys: list = field(default_factory=list)
    steps: np.ndarray | None = None

    def add(self, s: np.ndarray, w: np.ndarray, keys: list) -> None:
        s, w, keys = np.concatenate((self.s, s)), np.concatenate((self.w, w)), self.keys + keys
        order = _order(keys)
        sum_order = np.lexsort((order, -w, -s))
        s, w, order = s[sum_order], w[sum_order], order[sum_order]
        stays = np.zeros(len(s), bool)
        for at in range(0, len(s), ROWS):  # whatever beats a pair comes before it in this order, or is equal to it
            own = slice(at, at + ROWS)
            held = np.concatenate((np.flatnonzero(stays[:at]), np.arange(at, min(len(s), at + ROWS))))
            no_less = (s[held] >= s[own, None]) & (w[held] >= w[own, None])
            above = (s[held] >= s[own, None] + self.margin[0]) | (w[held] >= w[own, None] + self.margin[1]) | (order[held] < order[own, None])
            stays[own] = (no_less & above).sum(1) < self.k
        self.s, self.w, self.keys = s[stays], w[stays], [keys[i] for i in sum_order[stays]]
        self._staircase()

    def _staircase(self) -> None:
        if len(self.s) >= self.k:
            counts = np.unique(np.linspace(self.k, len(self.s), STEPS).astype(int))
            self.steps = np.array([(self.s[c - 1], np.partition(self.w[:c], c - self.k)[c - self.k]) for c in counts])


def _under(s: np.ndarray, w: np.ndarray, bands: list[Band]) -> np.ndarray:
    """Which pairs (rows x questions) k others are better than, as far as the staircases tell."""
    out = np.zeros(s.shape, bool)
    high_s, high_w = np.full((STEPS, len(bands)), -np.inf), np.full((STEPS, len(bands)), -np.inf)
    ds, dw = (np.array([b.margin[i] for b in bands]) for i in (0, 1))
    for q, b in enumerate(bands):
        if b.steps is not None:
            high_s[: len(b.steps), q], high_w[: len(b.steps), q] = b.steps.T
    for a, c in zip(high_s, high_w, strict=True):
        out |= (s <= a) & (w <= c) & ((s <= a - ds) | (w <= c - dw))
    return out


def hybrid(rows: DataFrame, asked: Questions, k: int, digits: int | None, weight: float, k1: float, b: float) -> DataFrame:
    """``query_id, key, ranked, score, semantic_score, keyword_score`` of candidates that hold the ``k`` best of each
    question: blends of both scores, each scaled to its extremes over all rows."""
    spark, key = rows.sparkSession, rows.schema["key"]
    held = spark.sparkContext.broadcast(asked)
    unit = 10.0 ** -(digits or 12)
    most = asked.weights.sum(0) * (k1 + 1) if asked.weights is not None and len(asked.weights) else np.zeros(len(asked.ids))
    wide = lambda share, span: 1.01 * unit * span / share + 1e-12 * span if share > 0 and span > 0 else np.inf
    margins = [(wide(weight, 2.0), wide(1.0 - weight, float(x))) for x in most]
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("key", key.dataType), *T.StructType.fromDDL("s double, w double, extreme boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        bands, ends, upto = [Band(k, m) for m in margins], None, 64  # few rows first, for a staircase
        for whole in batches:
            at = 0
            while at < whole.num_rows and len(q.ids):
                size = max(64, min(PIECE_CELLS // len(q.ids), upto))
                x = whole.slice(at, size)
                at, upto = at + size, 2 * upto
                s, w = _semantic(x, q), _keyword(x, q, k1, b)
                here = np.stack((s.min(0), w.min(0), s.max(0), w.max(0)))
                ends = here if ends is None else np.concatenate((np.minimum(ends[:2], here[:2]), np.maximum(ends[2:], here[2:])))
                row, column = np.nonzero(~_under(s, w, bands))
                by = np.argsort(column, kind="stable")
                row, column = row[by], column[by]
                seen, keys = np.unique(row), {}
                if len(seen):
                    keys = dict(zip(seen.tolist(), x.column(0).take(pa.array(seen)).to_pylist(), strict=True))
                bounds = np.searchsorted(column, np.arange(len(bands) + 1))
                for c in np.unique(column).tolist():
                    own = row[bounds[c] : bounds[c + 1]]
                    bands[c].add(s[own, c], w[own, c], [keys[i] for i in own.tolist()])
        if ends is not None:
            n = [len(x.s) for x in bands]
            kind = x.schema.field(0).type
            flat = lambda name: pa.array(np.concatenate([getattr(x, name) for x in bands]))
            yield pa.record_batch([pa.array(np.repeat(np.arange(len(bands)), n)), pa.array([v for x in bands for v in x.keys], kind), flat("s"), flat("w"), pa.array(np.zeros(sum(n), bool))], names=schema.names)
            for low in (0, 2):
                yield pa.record_batch([pa.array(np.arange(len(bands))), pa.nulls(len(bands), kind), pa.array(ends[low]), pa.array(ends[low + 1]), pa.array(np.ones(len(bands), bool))], names=schema.names)

    found = shared.write_table(rows.select("key", "dl", "terms", "tf", "embedding").mapInArrow(run, schema), "bands")
    held.destroy()
    ends = found.where("extreme").groupBy("q").agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("w").alias("w0"), F.max("w").alias("w1"))
    pairs = found.where("not extreme").join(F.broadcast(ends), "q").join(F.broadcast(asked.named(spark)), "q")  # a block's questions
    scaled = lambda x, low, high: F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
    pairs = pairs.withColumn("semantic_score", scaled(F.col("s"), F.col("s0"), F.col("s1"))).withColumn("keyword_score", scaled(F.col("w"), F.col("w0"), F.col("w1")))
    pairs = pairs.withColumn("score", F.col("semantic_score") * F.lit(float(weight)) + F.col("keyword_score") * F.lit(1.0 - weight))
    return pairs.select("query_id", "key", (F.round("score", digits) if digits else F.col("score")).alias("ranked"), "score", "semantic_score", "keyword_score")


def scores(rows: DataFrame, asked: Questions, kind: str, k: int, digits: int | None, weight: float = 0.7, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id, key, ranked, score, semantic_score, keyword_score`` of rows that hold the ``k`` best for each
    question, by ``ranked``: the score, rounded to ``digits`` if given. ``kind``: ``semantic`` scores
    are cosines, ``keyword`` those of rows that hold a term, ``hybrid`` blends both."""
    if kind == "hybrid":
        return hybrid(rows, asked, k, digits, weight, k1, b)
    held = rows.sparkSession.sparkContext.broadcast(asked)
    key = rows.schema["key"]
    names = ["query_id", "key", "ranked", "score", "semantic_score", "keyword_score"]
    schema = T.StructType([T.StructField("query_id", T._parse_datatype_string(_ddl(asked.ids.type))), key, *(T.StructField(c, T.DoubleType()) for c in names[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        for whole in batches:
            size = max(64, CELLS // max(1, len(q.ids)))
            for at in range(0, whole.num_rows if len(q.ids) else 0, size):
                x = whole.slice(at, size)
                total = _semantic(x, q) if kind == "semantic" else _keyword(x, q, k1, b)
                if kind == "keyword":
                    total[total <= 0] = -np.inf
                ranked = np.round(total, digits) if digits else total
                row, column = _best(ranked, x.column(0), k)
                found, none = pa.array(total[row, column]), pa.array(np.zeros(len(row)))
                both = (found, none) if kind == "semantic" else (none, found)
                yield pa.record_batch([q.ids.take(pa.array(column)), x.column(0).take(pa.array(row)), pa.array(ranked[row, column]), found, *both], names=names)

    return rows.select("key", "dl", "terms", "tf", "embedding").mapInArrow(run, schema)


def _ddl(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()
