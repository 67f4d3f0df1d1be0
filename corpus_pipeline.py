"""Training-corpus pipeline: language identification, line dedup, near-dedup, benchmark
decontamination, packing.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir), works on all
documents that the stage before kept, and its result is written and read again before the
next. All but the last return the columns of ``docs``; the last returns the placed pieces.

Defined results: documents without any letter, null texts among them, go, and a null lang becomes the
predicted one (stage 1; in a script that was not learned it stays null); documents all of whose lines
occurred before go, and others lose such passages, however short their lines, with ``n_chars`` renewed (2); of a class of
near-duplicates the document with the least doc_id stays (3): copies are known by their texts before stage 2 cut them, else
what it leaves of a copy would pass for a document, and then by the texts they have; documents that hold a
benchmark item go (4). Extra columns are carried through, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import _scratch, decontaminate, language_id, line_dedup, near_dedup, packing
from quarry.llm.queries import vocabulary

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = near_dedup.before_cuts(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return near_dedup.keep_one(docs, whole=whole)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = _scratch.write_table(stage(spark, docs, sf_dir), name)
        _scratch.drop_table(docs)  # the stage's input, once its result is written
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
