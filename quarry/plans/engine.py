"""The three things that users do: ingest documents, ask, evaluate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, coverage, evaluation, generation, lexical, search
from ..operators.embedding import Embedder, make_embedder
from ..sources import snapshots, tables
from ..sources.config import Settings
from ..sources.replies import Replies

#: Up to so many questions, the documents found are named in the filter that reads them.
FEW = 16
Client = Callable[[], Callable[[str, str], str]]


def _key() -> Column:
    """One order over the chunks of all documents."""
    return F.struct("doc_id", "ordinal")


@dataclass
class Engine:
    spark: SparkSession
    settings: Settings = field(default_factory=Settings.from_env)

    def ingest(self, pages: DataFrame, embedder: Embedder, provider: str = "", chunk_size: int = 1800, overlap: int = 250, source: str = "", path: str | None = None, upsert: bool = False) -> dict:
        """Chunk and embed ``pages(doc_id, page_number, text)``, and write the index; its
        metadata comes back. With ``upsert`` the pages' documents replace those of the same
        doc_id in the index, and nothing else is read or written again."""
        chunks = chunking.require_chunks(chunking.build_chunks(pages, chunk_size, overlap))
        meta = {
            "pdf": source, "ocr_lang": self.settings.ocr_lang, "ocr_dpi": self.settings.ocr_dpi, "embedding_provider": provider,
            "embedding_model": embedder.model_name, "chunk_size": chunk_size, "overlap": overlap,
        }
        path = path or self.settings.index_path
        return tables.save_index(embedder.embed(chunks).select([f.name for f in tables.schemas.CHUNKS.fields]), path, meta, upsert)

    def open_index(self, local: bool = False, path: str | None = None) -> tuple[DataFrame, Embedder]:
        """The chunks (with one order over all documents, and their term counts) and the embedder that made them."""
        meta, chunks = tables.open_index(self.spark, path or self.settings.index_path)
        provider = "local" if local else meta.get("embedding_provider") or self.settings.embedding_provider
        model = meta.get("embedding_model") or self.settings.embedding_model
        return chunks.withColumn("key", _key()), make_embedder(provider, model, self.replies(64))

    def replies(self, batch: int = 1) -> Replies:
        """The store of what services replied, next to the index."""
        return Replies(self.spark, f"{self.settings.storage_dir}/replies", batch)

    def search(self, chunks: DataFrame, queries: DataFrame, embedder: Embedder, top_k: int | None = None, **kwargs) -> DataFrame:
        """Ranked results of ``queries(query_id, question)``. Chunks of an index are scored by their counts and vectors; only
        those found are read."""
        k = search.effective_top_k(top_k, self.settings.top_k)
        asked = embedder.embed(queries.select("query_id", "question"), "question", "query_embedding")
        if "terms" in chunks.columns:
            kwargs.setdefault("rows", chunks.select("key", "dl", "terms", "tf", "embedding"))
            chunks = chunks.drop("dl", "terms", "tf", "block", "at")
        if lexical.is_small(asked.select("query_id"), FEW):
            found = search.best(chunks, asked, k, "key", **kwargs).collect()  # at most FEW * k rows
            schema = search.FOUND.format(asked.schema["query_id"].dataType.simpleString(), chunks.schema["key"].dataType.simpleString())
            docs = sorted({r["key"]["doc_id"] for r in found if r["key"]["doc_id"] is not None})
            return self.spark.createDataFrame(found, schema).join(chunks.drop("embedding").where(F.col("doc_id").isin(docs)), "key")
        return search.search(chunks, asked, k, key="key", **kwargs)

    def keyword_search(self, queries: DataFrame, top_k: int | None = None, path: str | None = None, round_to: int | None = None) -> DataFrame:
        """Ranked results of ``queries(query_id, question)`` by BM25 alone, from the index' postings; blocks that can't
        hold one of them are not opened."""
        path = path or self.settings.index_path
        data = snapshots.manifest(self.spark, path)
        if not data:
            raise FileNotFoundError(f"no index at {path}; ingest first")
        index = snapshots.keyword_index(self.spark, path, data, _key())
        found = search.keyword_best(index, queries, search.effective_top_k(top_k, self.settings.top_k), round_to)
        chunks = snapshots.stored(self.spark, path, data).withColumn("key", _key()).select("key", *[c for c in tables.schemas.CHUNKS.names if c != "embedding"])
        return found.join(chunks, "key")

    def coverage(self, cases: DataFrame, path: str | None = None, strict: bool = False) -> DataFrame:
        """The cases with the number of the index' chunks that satisfy their evidence, and of their keywords that some chunk
        holds; ``coverage.ceiling`` of it is the recall that no search over this index exceeds."""
        _, chunks = tables.open_index(self.spark, path or self.settings.index_path)
        return coverage.coverage(chunks, cases, strict)

    def answer_kind(self) -> str:
        return f"answer:{self.settings.chat_model}:{self.settings.max_output_tokens}"

    def ask(self, chunks: DataFrame, queries: DataFrame, embedder: Embedder, make_client: Client, top_k: int | None = None, replies: Replies | None = None) -> DataFrame:
        """``query_id, question, context, answer, answer_error``."""
        found = self.search(chunks, queries, embedder, top_k)
        return generation.answers(queries.join(generation.contexts(found), "query_id", "left"), make_client, replies, self.answer_kind())

    def evaluate(self, chunks: DataFrame, cases: DataFrame, embedder: Embedder, make_client: Client | None = None, top_k: int | None = None, limit: int | None = None, strict: bool = False, replies: Replies | None = None) -> DataFrame:
        """The cases with their results, answers and metrics; errors of retrieval end the run,
        those of generation stay in their rows."""
        chosen = search.first_rows(cases, limit, "ordinal")
        if chosen.isEmpty():
            raise RuntimeError("no evaluation case")
        queries = chosen.select(F.col("id").alias("query_id"), "question")
        found = self.search(chunks, queries, embedder, top_k).cache()
        fields = ["query_id", "rank", "score", "semantic_score", "keyword_score", "id", "text", "page_start", "page_end", "article", "title"]
        rows = chosen.join(evaluation.results_by_query(found.select(fields)).withColumnRenamed("query_id", "id"), "id", "left")
        if make_client:
            asked = queries.join(generation.contexts(found), "query_id", "left")
            rows = rows.join(generation.answers(asked, make_client, replies, self.answer_kind()).select(F.col("query_id").alias("id"), "answer", "answer_error"), "id", "left")
        else:
            rows = rows.withColumn("answer", F.lit("")).withColumn("answer_error", F.lit(None).cast("string"))
        return evaluation.rule_checks(rows, strict)
