"""Hybrid top-k search of a batch of questions.

Every chunk is scored against every question (min-max scaling sees them all), in the chunk's own
row and once: see ``grid``. What moves is the extremes and the k-skyband of each question and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid, lexical

SEMANTIC_WEIGHT = 0.7
FOUND = "query_id {}, rank int, key {}, score double, semantic_score double, keyword_score double"


def minmax(value: Column, low: Column, high: Column) -> Column:
    """0 where all values are equal."""
    return F.when(high == low, 0.0).otherwise(F.try_divide(value - low, high - low))


def blend(semantic: Column, keyword: Column, weight: float = SEMANTIC_WEIGHT) -> Column:
    return semantic * F.lit(float(weight)) + keyword * F.lit(1.0 - weight)


def effective_top_k(asked: int | None, default: int) -> int:
    """0 and None mean the default; negatives are refused."""
    if asked is not None and asked < 0:
        raise ValueError("top-k must not be negative")
    return asked or default


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows; all, if ``n`` is 0 or None."""
    if n is not None and n < 0:
        raise ValueError("a limit must not be negative")
    return df.orderBy(*order).limit(n) if n else df


def top_k(scored: DataFrame, k: int, score: Column, *ties: str, by: str = "query_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(score.desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best(chunks: DataFrame, queries: DataFrame, k: int, key: str, kind: str = "hybrid", round_to: int | None = None, rows: DataFrame | None = None, stats: tuple[int, float] | None = None, weight: float = SEMANTIC_WEIGHT, k1: float = lexical.K1, b: float = lexical.B) -> DataFrame:
    """``query_id, rank, key, score, semantic_score, keyword_score``: the ``k`` best chunks of each question by ``kind``
    (``hybrid``, ``semantic``, or ``keyword``, which leaves out chunks without a term of the question). Ties go to the lesser key.
    ``round_to`` ranks on rounded scores. ``rows`` are the chunks' counts where an index has them, and ``stats`` their
    number and mean length; else texts are counted, once for all blocks of questions."""
    if rows is None:
        if kind == "semantic":
            none = lambda kind: F.array().cast(kind)
            rows = chunks.select(F.col(key).alias("key"), F.lit(0).cast("long").alias("dl"), none("array<string>").alias("terms"), none("array<int>").alias("tf"), F.col("embedding").cast("array<double>").alias("embedding"))
        else:
            rows = grid.counted(chunks, key)

    def block(asked: grid.Questions) -> DataFrame:
        if kind != "semantic":
            grid.weigh(rows, asked, stats)
        return grid.scores(rows, asked, kind, k, round_to, weight, k1, b)

    scored = reduce(DataFrame.unionByName, (block(grid.Questions.collect(q)) for q in grid.blocks_of(queries)))
    found = top_k(scored, k, F.col("ranked"), "key")
    return found.select("query_id", "rank", F.col("key").alias(key), "score", "semantic_score", "keyword_score")


def keyword_best(index: lexical.KeywordIndex, queries: DataFrame, k: int, round_to: int | None = None) -> DataFrame:
    """``query_id, rank, key, score``: the ``k`` best rows of a keyword index that hold a term of the question."""
    found = (index.search(grid.Questions.collect(q.select("query_id", "question")), k, round_to)[0] for q in grid.blocks_of(queries))
    return top_k(reduce(DataFrame.unionByName, found), k, F.col("ranked"), "key").select("query_id", "rank", "key", "score")


def search(chunks: DataFrame, queries: DataFrame, k: int = 5, key: str = "ordinal", round_to: int | None = None, **kwargs) -> DataFrame:
    """``query_id, rank, score, semantic_score, keyword_score`` and the chunk's columns (its
    vector left out); ties keep chunk order. ``round_to`` ranks on rounded scores."""
    few = lexical.is_small(queries.select("query_id"), grid.QUESTIONS)
    return lexical.hinted(best(chunks, queries, k, key, round_to=round_to, **kwargs), few).join(chunks.drop("embedding"), key)
