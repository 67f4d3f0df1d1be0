"""Streaming ingest: pages that arrive in a folder are chunked and embedded as they come.

A page is packed and split in its own row. What runs from page to page, the article that is running and the number of the last chunk, is kept
as state by document (``transformWithState``, in RocksDB), so a document's pages may come in any number of files and batches. Pages
of a batch are taken by number; a page that comes later than one of a higher number follows that one. Writes are keyed by batch, so
a batch that is run again replaces its own output and nothing else."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..operators import chunking
from ..operators.embedding import Embedder

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_PARTS = "array<struct<text:string,own:struct<article:string,title:string>>>"
_OUT = "doc_id string, page_number int, parts string, known boolean, article string, title string, base long"


class Running(StatefulProcessor):
    """The running article and the number of chunks of each document, handed to each of its pages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("running", "known boolean, article string, title string, chunks long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, article, title, chunks = self.state.get() if self.state.exists() else (False, None, None, 0)
        pages = pd.concat(list(rows)).sort_values("page_number", kind="stable")  # a document's pages of one batch
        out = []
        for p in pages.itertuples():
            out.append((key[0], p.page_number, p.parts, known, article, title, chunks))
            chunks += p.n
            if p.told:
                known, article, title = True, p.article, p.title
        self.state.update((bool(known), article, title, int(chunks)))
        yield pd.DataFrame(out, columns=["doc_id", "page_number", "parts", "known", "article", "title", "base"])

    def close(self) -> None:
        pass


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def chunk_stream(pages: DataFrame, chunk_size: int = 1800, overlap: int = 250) -> DataFrame:
    """Chunks (without vectors) of a stream of pages."""
    parts = chunking.page_parts(pages, chunk_size, overlap)
    told = F.col("last").isNotNull()
    slim = parts.select(
        "doc_id", "page_number", F.to_json("parts", {"ignoreNullFields": "false"}).alias("parts"), F.size("parts").alias("n"),
        told.alias("told"), F.col("last.article").alias("article"), F.col("last.title").alias("title"),
    )
    run = slim.groupBy("doc_id").transformWithStateInPandas(Running(), _OUT, "Append", "None")
    carried = F.when(F.col("known"), F.struct("article", "title"))
    return chunking.chunk_rows(run.select("doc_id", "page_number", F.from_json("parts", _PARTS).alias("parts"), carried.alias("carried"), "base"))


def ingest_stream(pages: DataFrame, out: str, checkpoint: str, embedder: Embedder, chunk_size: int = 1800, overlap: int = 250, once: bool = True) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        chunks = embedder.embed(batch)
        chunks.select(schemas.CHUNKS.names).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")

    spark = pages.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        writer = chunk_stream(pages, chunk_size, overlap).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])
