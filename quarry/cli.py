"""Command line: ingest, ask, eval."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import evaluation, generation, search
from .operators.embedding import make_embedder
from .plans import report
from .plans.engine import Engine
from .sources import config, pdf, tables


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quarry", description="Document retrieval and its evaluation on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("ingest", help="read a PDF (or a Parquet table of pages), chunk, embed and write the index")
    p.add_argument("--pdf", help="file or folder; the one PDF in the working folder by default")
    p.add_argument("--pages", help="Parquet table of pages (doc_id, page_number, text) instead of a PDF")
    p.add_argument("--force-ocr", action="store_true")
    p.add_argument("--chunk-size", type=int, default=1800)
    p.add_argument("--overlap", type=int, default=250)
    p.add_argument("--local-embeddings", action="store_true")
    p.add_argument("--add", action="store_true", help="keep the index' other documents, and replace those of the same name")
    p.set_defaults(run=ingest)
    p = commands.add_parser("ask", help="answer a question from the index")
    p.add_argument("question")
    p.add_argument("--top-k", type=int)
    p.add_argument("--show-context", action="store_true")
    p.add_argument("--retrieve-only", action="store_true")
    p.add_argument("--local-embeddings", action="store_true")
    p.set_defaults(run=ask)
    p = commands.add_parser("eval", help="run evaluation cases and write reports")
    p.add_argument("--cases", default="eval/test_cases.yaml")
    p.add_argument("--top-k", type=int)
    p.add_argument("--limit", type=int)
    p.add_argument("--skip-generation", action="store_true")
    p.add_argument("--local-embeddings", action="store_true")
    p.add_argument("--report-prefix", default="eval")
    p.set_defaults(run=evaluate)
    return parser


def ocr_summary(pages) -> list[str]:
    total = tables.page_quality(pages).withColumn("line", tables.quality_line()).first()
    lines = [total["line"]]
    if total["low_pages"]:
        shown = ", ".join(map(str, tables.low_pages(pages, 12)))
        lines.append(f"Warning: little text on pages {shown}{'...' if total['low_pages'] > 12 else ''}")
    return lines


def ingest(args: argparse.Namespace, engine: Engine) -> None:
    s = engine.settings
    source = args.pages or str(args.pdf or config.find_default_pdf())
    if args.pages:
        pages = engine.spark.read.parquet(args.pages)
    else:
        pages = pdf.load_or_extract(engine.spark, source, s.pages_path, s.ocr_dpi, s.ocr_lang, args.force_ocr)
        print(*ocr_summary(pages), sep="\n")
    provider = "local" if args.local_embeddings else s.embedding_provider
    meta = engine.ingest(pages, make_embedder(provider, s.embedding_model, engine.replies(64)), provider, args.chunk_size, args.overlap, source, upsert=args.add)
    print(f"Index: {s.index_path} ({meta['chunk_count']} chunks, {provider}/{meta['embedding_model']})")


def ask(args: argparse.Namespace, engine: Engine) -> None:
    chunks, embedder = engine.open_index(args.local_embeddings)
    queries = engine.spark.createDataFrame([("q", args.question)], "query_id string, question string")
    found = engine.search(chunks, queries, embedder, args.top_k).cache()
    if args.show_context or args.retrieve_only:
        print("Passages found:", *(r["context"] for r in generation.contexts(found, 900).collect()), "", sep="\n")
    if not args.retrieve_only:
        client = generation.openai_client(engine.settings.chat_model, engine.settings.max_output_tokens)
        row = generation.answers(queries.join(generation.contexts(found), "query_id", "left"), client, engine.replies(), engine.answer_kind()).first()
        if row["answer_error"]:
            raise RuntimeError(row["answer_error"])
        print(row["answer"])


def evaluate(args: argparse.Namespace, engine: Engine) -> None:
    chunks, embedder = engine.open_index(args.local_embeddings)
    k = search.effective_top_k(args.top_k, engine.settings.top_k)
    client = None if args.skip_generation else generation.openai_client(engine.settings.chat_model, engine.settings.max_output_tokens)
    rows = engine.evaluate(chunks, tables.load_cases(engine.spark, args.cases), embedder, client, k, args.limit, replies=engine.replies() if client else None).cache()
    listed = report.report_rows(rows)
    for i, r in enumerate(listed, 1):
        print(f"[{i}/{len(listed)}] {r['case']['id']}: {r['case']['question']}", r["console"], sep="\n")
    summary = evaluation.summary(rows, k).first().asDict()
    made = report.save_reports(engine.settings.reports_dir, listed, summary, k, args.report_prefix)
    print("\nFigures over all cases:", *(f"{key}: {value}" for key, value in summary.items()), "\nReports:", *(f"- {p}" for p in made), sep="\n")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    try:
        session = spark or SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        args.run(args, Engine(session))
        return 0
    except KeyboardInterrupt:
        print("Interrupted.", file=sys.stderr)
        return 130
    except Exception as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return 1
