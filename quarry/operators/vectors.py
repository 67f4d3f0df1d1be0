"""Exact nearest vectors from a scan of one byte a dimension.

``coded`` keeps, for each vector, its direction in steps of 1/255 of its own range and the distance between that and
the direction itself. By Cauchy and Schwarz the cosine with any question lies within that distance of the coded one, so a scan
of the codes bounds every score from both sides: k lower bounds make a bar, and only vectors whose upper bound reaches it are
candidates. Tasks raise their own bars as they go and send what passes; the common bar then leaves little more than k
a question, and full vectors are fetched for those alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from . import embedding, grid

CODES = "d int, code binary, low double, step double, error double"


def coded(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """``key, d, code, low, step, error`` of ``vectors``; what has no direction has ``d`` 0."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T._parse_datatype_string(CODES).fields])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, starts, values = grid._floats(b.column(1))
            codes, low, step, error = [b""] * len(n), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
            for d in np.unique(n[n > 0]).tolist():
                own = np.flatnonzero(n == d)
                v = values[starts[own][:, None] + np.arange(d)]
                length = np.sqrt((v * v).sum(1))
                good = np.isfinite(length) & (length > 0)
                n[own[~good]] = 0
                own, u = own[good], v[good] / length[good, None]
                low[own], step[own] = u.min(1), np.maximum((u.max(1) - u.min(1)) / 255, 1e-300)
                c = np.rint((u - low[own, None]) / step[own, None])
                error[own] = np.sqrt(((u - (low[own, None] + step[own, None] * c)) ** 2).sum(1)) + 1e-13 * d
                for i, x in zip(own.tolist(), c.astype(np.uint8), strict=True):
                    codes[i] = x.tobytes()
            yield pa.record_batch([b.column(0), pa.array(n, pa.int32()), pa.array(codes, pa.binary()), *map(pa.array, (low, step, error))], names=schema.names)

    return rows.mapInArrow(code, schema)


def candidates(codes: DataFrame, asked: grid.Questions, k: int, digits: int | None = None) -> DataFrame:
    """``q, key`` of the vectors that may be among the ``k`` nearest of each question, written."""
    held = codes.sparkSession.sparkContext.broadcast((len(asked.ids), asked.vectors))  # a block of questions
    margin = 2 * 10.0 ** -(digits or 12)
    schema = T.StructType([T.StructField("q", T.LongType()), codes.schema["key"], *T._parse_datatype_string("low double, high double").fields])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, by_length = held.value
        bars = np.full((k, m), -np.inf)
        for whole in batches:
            step = max(64, grid.CELLS // max(1, m))
            for at in range(0, whole.num_rows if m else 0, step):
                b = whole.slice(at, step)
                d, mid, error = b.column(1).to_numpy(), np.zeros((b.num_rows, m)), np.zeros((b.num_rows, m))
                low, width, off = (b.column(i).to_numpy() for i in (3, 4, 5))
                for size, (columns, q) in by_length.items():
                    own = np.flatnonzero(d == size)
                    length = np.sqrt((q * q).sum(1))
                    q = np.divide(q, length[:, None], out=np.zeros_like(q), where=length[:, None] > 0)
                    c = np.frombuffer(b"".join(b.column(2).take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), size)
                    mid[np.ix_(own, columns)] = (c.astype(np.float64) @ q.T) * width[own, None] + low[own, None] * q.sum(1)[None, :]
                    error[np.ix_(own, columns)] = off[own, None] * (length > 0)[None, :]
                lower, upper = mid - error, mid + error
                bars = np.sort(np.concatenate((bars, lower)), axis=0)[-k:] if len(lower) <= 4 * k else np.sort(np.concatenate((bars, np.partition(lower, len(lower) - k, axis=0)[-k:])), axis=0)[-k:]
                row, column = np.nonzero(upper >= bars[0] - margin)
                yield pa.record_batch([pa.array(column), b.column(0).take(pa.array(row)), pa.array(lower[row, column]), pa.array(upper[row, column])], names=schema.names)

    found = shared.write_table(codes.mapInArrow(bound, schema), "bounds")
    held.destroy()
    ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))
    bar = found.select("q", "low", ranked.alias("i")).where(F.col("i") == k).select("q", (F.col("low") - margin).alias("bar"))
    passed = found.join(F.broadcast(bar), "q", "left").where(F.col("bar").isNull() | (F.col("high") >= F.col("bar")))  # a row a question
    out = shared.write_table(passed.select("q", "key"), "candidates")
    shared.drop_table(found)
    return out


def nearest(vectors: DataFrame, codes: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", round_to: int | None = None) -> DataFrame:
    """``query_id, rank, key, score``: the ``k`` vectors of largest cosine for each of ``queries(query_id, query_embedding)``,
    exactly; ties go to the lesser key. ``round_to`` ranks on rounded scores."""
    from .search import top_k

    out = []
    for block in grid.blocks_of(queries.select("query_id", "query_embedding")):
        asked = grid.Questions.collect(block)
        pairs = candidates(codes, asked, k, round_to).join(F.broadcast(asked.named(block.sparkSession)), "q")
        full = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).join(pairs, "key")
        both = full.join(F.broadcast(block.select("query_id", F.col("query_embedding").cast("array<double>").alias("w"))), "query_id")
        score = embedding.cosine(F.col("v"), F.col("w"))
        out.append(both.select("query_id", "key", score.alias("score")))
    scored = out[0]
    for x in out[1:]:
        scored = scored.unionByName(x)
    ranked = F.round("score", round_to) if round_to else F.col("score")
    return top_k(scored, k, ranked, "key").select("query_id", "rank", F.col("key").alias(key), "score")
