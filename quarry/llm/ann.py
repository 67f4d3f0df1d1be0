"""Nearest neighbours by a forest of hash prefixes.

Each tree hashes a vector to a string of ``BITS`` signs of random projections and keeps the
strings in a sorted array. A query descends each tree to its longest matching prefix, then
ascends all trees together, one bit at a time, until the union of the vectors under its prefixes
is ``SPREAD`` times what is to be scored. Of those met, the ones that share most prefix bits
with the query, added up over the trees, are its candidates: a ``share`` of the shard, all of
equal standing included. They are scored exactly, in double precision, in an order of
summation that is the same for every row, so that equal vectors have equal scores.

The share is fitted: on a sample of ``SAMPLE`` rows (those of least hash of vec_id; fewer if that were over ``HELD`` bytes), the size of a small shard, up to ``ASKED`` of
them are searched exactly and by the forest, and the least of ``SHARES`` is taken by which ``RECALL`` of the true
neighbours are found. Every row is indexed. Where vectors lie in clusters that is a few rows in a thousand, and the work of a query
goes with those; where they have none, no hash tells near from far and the share is a fifth and more.

Every task indexes the vectors that it reads, in shards of at most ``SHARD_ROWS``, so the
index is spread as the table is and nothing is shuffled but each shard's best for each
query. Queries go out in blocks of ``QUERY_BLOCK`` rows and ``HELD`` bytes at most, one after another, for each of which a shard's forest is made
again (as long as some hundred queries take): a block's answers are
written and its broadcast is freed before the next is fetched, so the driver holds one block.

Defined results: vectors that are null, zero, empty, or hold a null or non-finite component
take no part, neither as queries nor as candidates; vectors of unequal length are not
compared. Ties go to the smaller vec_id. Rows that repeat a vec_id are candidates each, but ask
once, with the least of their vectors; a query's own vec_id is never found. A table without
queries, or without vectors, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _sample, _scratch
from . import _text as tx

TREES = 96
BITS = 32
SPREAD = 6
#: Above one part in so many of a shard, entries are counted in an array of the shard's length.
DENSE = 16
SHARES = (0.0002, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.08, 0.11, 0.14, 0.17, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7, 1.0)
RECALL = 0.94
SAMPLE, ASKED = 1 << 14, 96
SHARD_ROWS = 1 << 16
QUERY_BLOCK = 1 << 15
#: Bytes of vectors on the driver, of a sample or a block of queries.
HELD = 1 << 26
NEAR = "query_id long, vec_id long, score double"


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, TREES * BITS)).astype(np.float32)


def _strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings as numbers, trees x vectors."""
    out = np.empty((len(vectors), TREES), np.uint32)
    for at in range(0, len(vectors), 2048):
        bits = (vectors[at : at + 2048].astype(np.float32) @ planes) > 0
        out[at : at + 2048] = np.packbits(bits, axis=1).view(">u4")
    return out.T.copy()


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


class Forest:
    """Sorted hash strings of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.touched = ids, vectors, 0
        self.norms = norms(vectors)
        self.planes = _planes(vectors.shape[1])
        strings = _strings(vectors / self.norms[:, None], self.planes)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each (unit) query, the numbers of at least ``enough`` candidates."""
        n = len(self.ids)
        enough = min(n, enough)
        strings = _strings(queries, self.planes)
        low = np.empty((BITS + 1, TREES, len(queries)), np.int64)
        high = np.empty_like(low)
        for t in range(TREES):  # the range of every prefix length, from the whole tree down
            for x in range(BITS + 1):
                mask = np.uint32(((1 << x) - 1) << (BITS - x))
                low[x, t] = np.searchsorted(self.sorted[t], strings[t] & mask, "left")
                high[x, t] = np.searchsorted(self.sorted[t], strings[t] | ~mask, "right")
        reached = (high - low).sum(1)
        flat, tree = self.order.ravel(), np.arange(TREES) * n
        for q in range(len(queries)):
            x = int(np.flatnonzero(reached[:, q] >= min(n, SPREAD * enough))[-1])
            met, shared, top = np.zeros(0, np.int64), np.zeros(0, np.int64), BITS + 1
            while True:  # bits shared with the query, over the prefixes of x bits and more
                begin, count = (low[x:top, :, q] + tree).ravel(), (high[x:top, :, q] - low[x:top, :, q]).ravel()
                at = np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)
                self.touched += len(at)
                if DENSE * (len(at) + len(met)) < n:  # work goes with what lies under the prefixes, not with the shard
                    met, back = np.unique(np.concatenate((met, flat[at])), return_inverse=True)
                    shared = np.bincount(back, np.concatenate((shared, np.ones(len(at), np.int64))), len(met)).astype(np.int64)
                else:
                    whole = np.bincount(flat[at], minlength=n)
                    whole[met] += shared
                    met = np.flatnonzero(whole)
                    shared = whole[met]
                if x == 0 or len(met) >= min(n, SPREAD * enough):
                    break
                x, top = x - 1, x
            least = int(np.partition(shared, len(met) - enough)[len(met) - enough]) if len(met) > enough else 1
            yield met[shared >= least]

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float) -> list[tuple[np.ndarray, ...]]:
        lengths = norms(queries)
        enough = max(8 * k, int(np.ceil(share * len(self.ids))))
        out = []
        for i, found in enumerate(self.candidates(queries / lengths[:, None], enough)):
            found = found[self.ids[found] != query_ids[i]]
            score = (self.vectors[found] * queries[i]).sum(1) / (self.norms[found] * lengths[i])
            if len(found) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                keep = np.flatnonzero(score >= least)
                keep = keep[np.lexsort((self.ids[found[keep]], -score[keep]))[:k]]
                found, score = found[keep], score[keep]
            out.append((np.full(len(found), query_ids[i]), self.ids[found], score))
        return out


def fit_share(ids: np.ndarray, vectors: np.ndarray, k: int) -> float:
    """The least share by which the forest finds ``RECALL`` of the sample's true neighbours."""
    if len(ids) <= k:
        return 1.0
    forest, unit = Forest(ids, vectors), vectors / norms(vectors)[:, None]
    asked = np.linspace(0, len(ids) - 1, min(ASKED, len(ids))).astype(np.int64)
    cos = unit[asked] @ unit.T
    cos[ids[asked][:, None] == ids[None, :]] = -np.inf
    kth = np.partition(cos, len(ids) - k, axis=1)[:, len(ids) - k]
    true = cos >= kth[:, None] - 1e-12

    def recall(share: float) -> float:
        enough = max(8 * k, int(np.ceil(share * len(ids))))
        met = np.array([true[i, found].sum() for i, found in enumerate(forest.candidates(unit[asked], enough))])
        return np.minimum(met / np.minimum(true.sum(1), k), 1).mean()

    return SHARES[min(bisect_left(SHARES, True, key=lambda share: bool(recall(share) >= RECALL)), len(SHARES) - 1)]


def _arrays(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Identifiers and vectors by dimension."""
    out = {}
    for d in table["dim"].unique().to_pylist():
        own = table.filter(pc.equal(table["dim"], d)).combine_chunks()
        flat = own["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out[d] = own["vec_id"].to_numpy(), flat.reshape(own.num_rows, d).astype(np.float64)
    return out


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, vector`` (array of double) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null").where(fine).select("vec_id", F.size("vector").alias("dim"), "vector")


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each vec_id where
    ``is_query`` (a condition on ``vec_id``) holds, among all rows but those of its vec_id."""
    rows = valid(vectors)
    spark = rows.sparkSession
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")).select("vec_id", F.size("vector").alias("dim"), "vector")
    total, widest = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = max(1, HELD // (8 * widest))
    blocks = max(1, -(-queries.count() // min(QUERY_BLOCK, most)))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    sample = _arrays(_sample.least_hashed(rows, min(SAMPLE, most), total, 3, "vec_id").toArrow())
    shares = {d: fit_share(i, v, k) for d, (i, v) in sample.items()}
    usual = max(shares.values(), default=1.0)  # for lengths that the sample misses

    def one_block(b: int) -> DataFrame:
        asked = spark.sparkContext.broadcast(_arrays(dealt.where(F.col("block") == b).select("vec_id", "dim", "vector").toArrow()))  # about QUERY_BLOCK rows, HELD bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[pa.RecordBatch]] = {}
            count: dict[int, int] = {}
            for batch in batches:
                dims = tx.column(batch, "dim").to_numpy()
                for d in np.unique(dims).tolist():
                    if d in asked.value:
                        own = batch.take(pa.array(np.flatnonzero(dims == d)))
                        held.setdefault(d, []).append(own)
                        count[d] = count.get(d, 0) + own.num_rows
                        if count[d] >= SHARD_ROWS:
                            yield from answer(held.pop(d), d)
                            count[d] = 0
            for d, own in held.items():
                yield from answer(own, d)

        def answer(own: list[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
            ids, vecs = asked.value[dim]
            forest = Forest(*_arrays(pa.Table.from_batches(own))[dim])
            for at in range(0, len(ids), 256):
                q, v, s = (np.concatenate(x) for x in zip(*forest.nearest(ids[at : at + 256], vecs[at : at + 256], k, shares.get(dim, usual)), strict=True))
                yield pa.record_batch([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

        found = rows.mapInArrow(run, NEAR)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks == 1:
            return ranked
        written = _scratch.write_table(ranked, "nearest")
        asked.destroy()
        return written

    return reduce(DataFrame.unionByName, (one_block(b) for b in range(blocks)))
