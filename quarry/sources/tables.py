"""Page, index and case tables: Parquet for scale, JSON for interchange."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from . import snapshots

_PAGE = T.StructType([f for f in schemas.PAGES.fields if f.name != "doc_id"])
_CHUNK = T.StructType([f for f in schemas.CHUNKS.fields if f.name not in ("doc_id", "ordinal")])


def write_json(path: str | Path, data: object) -> Path:
    """One UTF-8 document, indented, with a newline at its end."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return path


def read_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def _json(spark: SparkSession, path: str, field: str, item: T.StructType) -> DataFrame:
    schema = T.StructType([T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField(field, T.ArrayType(item))])
    whole = spark.read.json(path, schema=schema, multiLine=True)
    return whole.select(F.col("metadata")["pdf"].alias("pdf"), F.posexplode(field).alias("at", "x"))


def load_pages_json(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an exported page file, with defaults for what is missing."""
    rows = _json(spark, path, "pages", _PAGE)
    x = lambda c, d: F.coalesce(F.col(f"x.{c}"), d).alias(c)
    return rows.select(
        F.coalesce("pdf", F.lit("")).alias("doc_id"), F.col("x.page_number").alias("page_number"), x("text", F.lit("")), x("char_count", F.lit(0)),
        x("source", F.lit("unknown")), x("warnings", F.array().cast("array<string>")),
    )


def load_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of an exported index file, numbered in file order."""
    rows = _json(spark, path, "chunks", _CHUNK)
    return rows.select(
        F.coalesce("pdf", F.lit("")).alias("doc_id"), (F.col("at") + 1).alias("ordinal"), F.col("x.id").alias("id"), F.coalesce("x.text", F.lit("")).alias("text"),
        F.col("x.page_start").alias("page_start"), F.coalesce("x.page_end", "x.page_start").alias("page_end"), F.col("x.article").alias("article"),
        F.col("x.title").alias("title"), F.col("x.embedding").alias("embedding"),
    )


def save_pages(pages: DataFrame, path: str, pdf: str = "") -> None:
    pages.write.mode("overwrite").parquet(f"{path}/pages")
    meta = pages.agg(F.lit(pdf).alias("pdf"), F.lit(_now()).alias("created_at"), F.count("*").alias("page_count"))
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(f"{path}/pages")


def _now() -> str:
    return datetime.now(UTC).isoformat()


def save_index(chunks: DataFrame, path: str, metadata: dict, upsert: bool = False) -> dict:
    """Chunks with their vectors, term counts and postings, and metadata with the time and chunk count, as the next
    snapshot at ``path``; with ``upsert``, documents of other doc_ids stay as they are."""
    return snapshots.write(chunks, path, {k: metadata.get(k) for k in (f.name for f in schemas.INDEX_META.fields)}, _now(), upsert)


def load_index(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(metadata, chunks) of the newest snapshot."""
    meta, rows = open_index(spark, path)
    return meta, rows.select([f.name for f in schemas.CHUNKS.fields])


def open_index(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(metadata, chunks with their term counts) of the newest snapshot."""
    data = snapshots.manifest(spark, path)
    if not data:
        raise FileNotFoundError(f"no index at {path}; ingest first")
    return data["metadata"], snapshots.stored(spark, path, data)


def export_index_json(spark: SparkSession, path: str, out: str | Path) -> Path:
    """A whole index as one JSON document, in chunk order; for small indexes."""
    meta, chunks = load_index(spark, path)
    rows = [r.asDict(recursive=True) for r in chunks.orderBy("doc_id", "ordinal").toLocalIterator()]
    keep = [f.name for f in _CHUNK.fields]
    return write_json(out, {"metadata": meta, "chunks": [{k: r[k] for k in keep} for r in rows]})


def load_cases(spark: SparkSession, path: str | Path) -> DataFrame:
    """Evaluation cases of a YAML file (``cases: [...]``), in order. ``answerable`` must be a
    boolean; an empty file gives no cases."""
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise RuntimeError("PyYAML is not installed; it reads the case file") from e
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    rows = []
    for i, c in enumerate(data.get("cases") or []):
        answerable = c.get("answerable", True)
        if not isinstance(answerable, bool):
            raise ValueError(f"case {c['id']}: answerable must be true or false")
        text = lambda v: None if v is None else str(v)
        evidence = [(text(e.get("article")), text(e.get("page"))) for e in c.get("expected_citations") or []]
        listed = lambda k: [str(v) for v in c.get(k) or []]  # noqa: B023, E731
        rows.append((i, str(c["id"]), str(c["question"]), str(c.get("category", "unknown")), str(c.get("difficulty", "unknown")), answerable, evidence, listed("expected_keywords"), listed("expected_answer_points")))
    return spark.createDataFrame(rows, schemas.CASES)


def page_quality(pages: DataFrame, *by: str) -> DataFrame:
    """Pages, characters, and the numbers of the pages with little text."""
    low = F.array_contains("warnings", "low_ocr_text") | (F.col("char_count") < 80)
    return pages.groupBy(*by).agg(F.count("*").alias("pages"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars"), F.count_if(low).alias("low_pages"))


def quality_line() -> Column:
    """A line about the ``pages`` and ``chars`` of ``page_quality``."""
    return F.concat(F.lit("Pages: "), F.col("pages").cast("string"), F.lit(" | characters: "), F.col("chars").cast("string"))


def low_pages(pages: DataFrame, n: int) -> list[int]:
    low = F.array_contains("warnings", "low_ocr_text") | (F.col("char_count") < 80)
    return [r[0] for r in pages.where(low).orderBy("doc_id", "page_number").select("page_number").limit(n).collect()]
