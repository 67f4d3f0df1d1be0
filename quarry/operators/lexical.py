"""Term statistics, and a keyword index whose blocks can be skipped.

Texts are counted in their own rows (``grid.term_counts``), so no statistic shuffles tokens. The index keeps, for each term, *blocks* of
postings: up to ``BLOCK`` consecutive chunks in one row, made where the chunks lie and sorted by term over ranges, so
that a term's blocks are read without the others. A block also holds its *tops*, the pairs of (times, length)
that no other pair of it beats with more times and less length: whatever the corpus' mean length, k1 and b, the
highest impact in the block is that of one of them.

A top-k search reads the tops of the questions' terms first, which bound what a block can add up to. The k most promising blocks of each
question are scored; the k-th best score found so bounds the rest, and blocks that can't reach it are never opened. Blocks that
can are scored too, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import grid

K1, B = 1.5, 0.75
#: Tables with at most so many rows are broadcast.
BROADCAST_ROWS = 200_000
#: Chunks in a block, as a power of two.
BLOCK_BITS = 8
POSTINGS = "term string, block long, n long, at array<int>, tf array<int>, dl array<int>, top_tf array<int>, top_dl array<int>"


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; it is run for that, so ask it of inputs."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, few: bool) -> DataFrame:
    """``df``, to be broadcast if it is known to be ``few`` rows."""
    return F.broadcast(df) if few else df


def term_freq(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, term, tf``; a text is one row."""
    counts = grid.term_counts(docs.select(key, text), text)
    return counts.select(key, F.explode(F.arrays_zip("terms", "tf")).alias("x")).select(key, F.col("x.terms").alias("term"), F.col("x.tf").cast("long").alias("tf"))


def doc_freq(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, df``."""
    return grid.term_counts(docs.select(text), text).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def doc_len(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, dl``; a text is one row, tokens are counted where they are cut."""
    return docs.select(key, F.coalesce(F.size(tx.tokenize(F.col(text))), F.lit(0)).cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def numbered(rows: DataFrame, first_block: int = 0) -> DataFrame:
    """``rows`` with ``block`` and ``at``: consecutive rows of a task make a block. Write them before they are read twice."""
    place = F.monotonically_increasing_id()
    return rows.withColumn("block", F.shiftright(place, BLOCK_BITS) + F.lit(first_block)).withColumn("at", place.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int"))


def _whole_blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole blocks that hold about ``grid.PIECE`` terms."""
    block = batch.column(0).to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
    bounds = np.append(starts, len(block))
    for own in grid.pieces(np.add.reduceat(grid.lengths(batch.column(3)), starts) if len(starts) else starts):
        yield batch.slice(bounds[own.start], bounds[own.stop] - bounds[own.start])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the blocks of each batch; a block that two batches share makes two rows a term."""
    for b in (part for whole in batches for part in _whole_blocks(whole)):
        block, at, dl = (b.column(i).to_numpy() for i in range(3))
        listed = b.column(3)
        size = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = listed.flatten().dictionary_encode()
        if not len(coded):
            continue
        rows = np.repeat(np.arange(b.num_rows), size)
        tf, length = b.column(4).flatten().to_numpy(), dl[rows]
        blocks, number = np.unique(block, return_inverse=True)
        group = number[rows] * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        by_place, by_top = np.argsort(group, kind="stable"), np.lexsort((length, -tf, group))
        groups, starts = np.unique(group[by_place], return_index=True)
        bounds = np.append(starts, len(group))
        own = np.repeat(np.arange(len(groups)), np.diff(bounds))
        low = length[by_top] - own * (int(dl.max()) + 1)  # falls from group to group, so one running minimum serves all
        least = np.minimum.accumulate(low)
        top = np.ones(len(low), bool)
        top[1:] = low[1:] < least[:-1]
        lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
        ends = np.concatenate(([0], np.cumsum(np.bincount(own[top], minlength=len(groups)))))
        yield pa.record_batch(
            [
                coded.dictionary.take(pa.array(groups % len(coded.dictionary))), pa.array(blocks[groups // len(coded.dictionary)]), pa.array(np.diff(bounds)),
                lists(at[rows][by_place], bounds), lists(tf[by_place], bounds), lists(length[by_place], bounds), lists(tf[by_top][top], ends), lists(length[by_top][top], ends),
            ], names=[c.split()[0] for c in POSTINGS.split(", ")],
        )


def postings(rows: DataFrame) -> DataFrame:
    """Blocks of postings of ``rows(block, at, dl, terms, tf)``, sorted by term over ranges."""
    made = rows.select("block", "at", "dl", "terms", "tf").mapInArrow(_blocks, POSTINGS)
    return made.repartitionByRange("term", "block").sortWithinPartitions("term", "block")


@dataclass
class KeywordIndex:
    """``rows(key, block, at)`` and their ``postings``, number and sum of lengths; ``gone(block, at, dl, terms)`` are rows that later
    ones replace."""

    rows: DataFrame
    blocks: DataFrame
    n: int
    tokens: int
    gone: DataFrame | None = None

    @classmethod
    def of(cls, rows: DataFrame, blocks: DataFrame, gone: DataFrame | None = None) -> KeywordIndex:
        count = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())
        (n, tokens), (m, less) = count(rows), count(gone) if gone is not None else (0, 0)
        return cls(rows, blocks, n - m, tokens - less, gone)

    def weigh(self, asked: grid.Questions) -> DataFrame:
        """Term weights from the index' own frequencies; the blocks of the questions' terms come back, ``term`` numbered."""
        spark = self.blocks.sparkSession
        words = asked.vocabulary.to_pylist()
        numbers = F.broadcast(spark.createDataFrame(list(enumerate(words)), "number int, term string"))  # a block's terms
        mine = (self.blocks.where(F.col("term").isin(words)) if len(words) <= BROADCAST_ROWS // 1000 else self.blocks).join(numbers, "term").drop("term")
        counts = mine.groupBy("number").agg(F.sum("n").alias("n"))
        if self.gone is not None:
            less = self.gone.select(F.explode("terms").alias("term")).join(numbers, "term").groupBy("number").agg((-F.count("*")).alias("n"))
            counts = counts.unionByName(less)
        df = np.zeros(len(words))
        for number, n in counts.groupBy("number").agg(F.sum("n")).collect():
            df[number] = n
        asked.weigh(self.n, self.tokens / self.n if self.n else 0.0, df)
        return mine

    def search(self, asked: grid.Questions, k: int, digits: int | None = None, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
        """``query_id, key, ranked, score`` of rows that hold the k best of each question, and the blocks opened (``q, block``)."""
        spark, mine = self.blocks.sparkSession, self.weigh(asked)
        q, number = np.nonzero(asked.repeats.T)
        share = [float(asked.weights[t, i]) for t, i in zip(number, q, strict=True)]
        weights = F.broadcast(spark.createDataFrame(list(zip(q.tolist(), number.tolist(), share, strict=True)), "q long, number int, weight double"))  # cells of a block of questions
        if not asked.average > 0:
            weights = weights.where("false")

        def impact(tf: Column, dl: Column) -> Column:
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(float(asked.average or 1.0))))

        top = F.array_max(F.zip_with("top_tf", "top_dl", impact))
        heads = mine.groupBy("number", "block").agg(F.max(top).alias("top"))
        bounds = heads.join(weights, "number").groupBy("q", "block").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
        from ..sources import shared

        bounds = shared.write_table(bounds, "bounds")
        first = bounds.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))).where(F.col("i") <= k).select("q", "block")

        def score(pairs: DataFrame) -> DataFrame:
            met = mine.join(pairs, "block").join(weights, ["q", "number"])
            each = met.select("q", "block", "weight", F.explode(F.arrays_zip("at", "tf", "dl")).alias("x"))
            part = F.col("weight") * impact(F.col("x.tf"), F.col("x.dl"))
            out = each.groupBy("q", "block", F.col("x.at").alias("at")).agg(F.sum(part).alias("score"))
            return out if self.gone is None else out.join(F.broadcast(self.gone.select("block", "at")) if is_small(self.gone) else self.gone.select("block", "at"), ["block", "at"], "left_anti")

        found = shared.write_table(score(first), "first_blocks")
        ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
        bar = found.withColumn("i", ranked).where(F.col("i") == k).select("q", (F.col("score") - 1e-9 * F.abs("score") - (10.0**-digits if digits else 0.0)).alias("bar"))
        rest = bounds.join(first, ["q", "block"], "left_anti").join(F.broadcast(bar), "q", "left").where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar"))).select("q", "block")  # a row a question
        rest = shared.write_table(rest, "rest_blocks")
        able = found.unionByName(score(rest)).join(F.broadcast(bar), "q", "left").where(F.col("bar").isNull() | (F.col("score") >= F.col("bar")))
        out = able.join(self.rows.select("block", "at", "key"), ["block", "at"]).join(F.broadcast(asked.named(spark)), "q")
        return out.select("query_id", "key", (F.round("score", digits) if digits else F.col("score")).alias("ranked"), "score"), first.union(rest)
