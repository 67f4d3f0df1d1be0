"""Evaluation reports: JSON and Markdown, from case rows in case order."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import write_json

CASE = ("id", "question", "category", "difficulty", "answerable", "expected_citations", "expected_keywords", "expected_answer_points")
METRICS = ("keyword_hit_count", "keyword_total", "keyword_hit_ratio", "citation_present", "unanswerable_refusal", "first_evidence_rank", "retrieval_hit")


def format_metric(value: object) -> str:
    if value is None:
        return "n/a"
    return f"{value:.3f}" if isinstance(value, float) else str(value)


def metric(value: Column) -> Column:
    """``format_metric`` of a number with decimals, as an expression."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.3f", value))


def remark() -> Column:
    """The error of a case, else its answer."""
    return F.coalesce("answer_error", "answer", F.lit(""))


def _place() -> Column:
    return F.coalesce(F.concat(F.lit("#"), F.col("first_evidence_rank").cast("string")), F.lit("-"))


def _state(answered: Column) -> Column:
    return F.when(F.col("answer_error").isNotNull(), "failed").when(F.coalesce("answer", F.lit("")) != "", answered).otherwise("skipped")


def case_line(limit: int = 100) -> Column:
    """A console line for a case."""
    return F.concat(F.lit("  evidence "), _place(), F.lit(", answer "), _state(F.lit("made")), F.lit(": "), tx.short_text(remark(), limit))


def table_line() -> Column:
    """A row of the Markdown table of cases: id, evidence, keywords, citation, refusal, category, remark."""
    yes_no = lambda c: F.coalesce(F.when(F.col(c), "yes").when(~F.col(c), "no"), F.lit("-"))
    cells = ["id", _place(), _state(F.format_string("%d of %d", "keyword_hit_count", "keyword_total")), yes_no("citation_present"), yes_no("unanswerable_refusal"), "category", tx.escape_cell(remark())]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def wire_results(results: Column) -> Column:
    """Results as they go into reports: scores rounded to 6 places, no vectors."""
    rounded = lambda r, c: F.round(r[c], 6).alias(c)
    chunk = lambda r: F.struct(*(r[c].alias(c) for c in ("id", "text", "page_start", "page_end", "article", "title")))
    return F.transform(results, lambda r: F.struct(r["rank"].alias("rank"), rounded(r, "score"), rounded(r, "semantic_score"), rounded(r, "keyword_score"), chunk(r).alias("chunk")))


def report_rows(rows: DataFrame) -> list[dict]:
    """Collected case rows, in case order (an evaluation suite's size)."""
    shaped = rows.select("ordinal", F.struct(*CASE).alias("case"), F.struct(*METRICS).alias("metrics"), F.coalesce("answer", F.lit("")).alias("answer"), "answer_error", F.coalesce(wire_results(F.col("results")), F.array()).alias("retrieval"), table_line().alias("line"), case_line().alias("console"))
    return [r.asDict(recursive=True) for r in shaped.orderBy("ordinal").collect()]


HEAD = ("Case", "Evidence", "Keywords", "Cites", "Refuses", "Category", "Remark")


def markdown(rows: list[dict], summary: dict, top_k: int) -> str:
    """The measures as one table, the cases as another, then each case with what was found for it."""
    measures = {f"Recall@{top_k}": summary[f"recall_at_{top_k}"], "Mean reciprocal rank": summary["mrr"], "Cases": summary["case_count"], "of these answerable": summary["answerable_case_count"], "Answers where a refusal was due": summary["unanswerable_non_refusal_count"]}
    out = ["# Evaluation of retrieval and answers", "", "| Measure | Value |", "|-|-|", *(f"| {name} | {format_metric(value)} |" for name, value in measures.items()), ""]
    out += [f"| {' | '.join(HEAD)} |", "|" + "-|" * len(HEAD), *(r["line"] for r in rows)]
    for r in rows:
        out += ["", f"## {r['case']['id']}", "", f"> {r['case']['question']}", ""]
        out += [f"{x['rank']}. page {x['chunk']['page_start']}, {x['chunk']['article'] or 'no article'} ({x['score']})" for x in r["retrieval"]] or ["Nothing was found."]
        out += ["", r["answer_error"] or r["answer"].strip() or "No answer was made."]
    return "\n".join(out) + "\n"


def save_reports(folder: str | Path, rows: list[dict], summary: dict, top_k: int, prefix: str = "eval") -> tuple[Path, Path]:
    """``{prefix}_{time}.json`` and ``.md``; the time is local, to the second."""
    stem = Path(folder) / f"{prefix}_{datetime.now():%Y%m%d_%H%M%S}"
    cases = [{k: r[k] for k in ("case", "metrics", "answer", "answer_error", "retrieval")} for r in rows]
    as_json = write_json(f"{stem}.json", {"summary": summary, "cases": cases})
    as_md = Path(f"{stem}.md")
    as_md.write_text(markdown(rows, summary, top_k), encoding="utf-8")
    return as_json, as_md
