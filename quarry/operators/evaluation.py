"""Retrieval and answer checks, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def evidence_matches(result: Column, evidence: Column, strict: bool = False) -> Column:
    """Whether one result (a struct with page_start, page_end, article, text) satisfies an
    evidence item: every check present must hold, and one must be present. A page that is no
    number matches nothing; an empty article is no check. Texts are normalised already."""
    page, article = evidence["page"], evidence["article"]
    number = F.coalesce(F.trim(page).try_cast("int"), F.lit(-1))
    has_page, has_article = page.isNotNull(), article.isNotNull() & (evidence["named"])
    page_ok = number.between(result["page_start"], result["page_end"])
    article_ok = tx.contains_normalized(result["article"], article, strict) | tx.contains_normalized(result["text"], article, strict)
    return (has_page | has_article) & (~has_page | F.coalesce(page_ok, F.lit(False))) & (~has_article | article_ok)


def first_evidence_rank(results: Column, expected: Column, strict: bool = False) -> Column:
    """The least rank in ``results`` (array of structs) that satisfies any item; null if none. Each text and each
    item is normalised once, before they meet."""
    said = F.transform(results, lambda r: F.struct(r["rank"].alias("rank"), r["page_start"].alias("page_start"), r["page_end"].alias("page_end"), tx.nonempty(r["article"]).alias("article"), tx.nonempty(r["text"]).alias("text")))
    items = F.transform(expected, lambda e: F.struct(e["page"].alias("page"), tx.normalize(e["article"]).alias("article"), (e["article"] != "").alias("named")))
    start = F.struct(items.alias("items"), F.lit(None).cast("int").alias("least"))

    def step(acc: Column, r: Column) -> Column:
        met = F.exists(acc["items"], lambda e: evidence_matches(r, e, strict))
        return F.struct(acc["items"].alias("items"), F.when(met, F.least(acc["least"], r["rank"])).otherwise(acc["least"]).alias("least"))

    return F.aggregate(said, start, step, lambda acc: acc["least"])


def results_by_query(results: DataFrame) -> DataFrame:
    """``query_id, results``: each question's ranked results as one array (k entries)."""
    fields = [c for c in results.columns if c not in ("query_id", "rank")]
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("results"))


def rule_checks(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Adds the metrics to rows with ``answer, answerable, expected_citations,
    expected_keywords, results``."""
    answer = F.coalesce("answer", F.lit(""))
    rows = rows.withColumn("__norm", tx.normalize(answer))  # once, for keywords and refusals
    hits = F.size(tx.keyword_hits(F.col("__norm"), F.col("expected_keywords"), normalized=True))
    total = F.size("expected_keywords")
    rank = first_evidence_rank(F.col("results"), F.col("expected_citations"), strict) if "results" in rows.columns else F.lit(None).cast("int")
    out = rows.withColumn("keyword_hit_count", hits).withColumn("keyword_total", total)
    return (
        out.withColumn("keyword_hit_ratio", F.try_divide(F.col("keyword_hit_count").cast("double"), F.col("keyword_total")))
        .withColumn("citation_present", tx.has_citation(answer))
        .withColumn("unanswerable_refusal", F.when(~F.col("answerable"), tx.is_refusal(F.col("__norm"), normalized=True)))
        .withColumn("first_evidence_rank", rank)
        .withColumn("retrieval_hit", F.col("first_evidence_rank").isNotNull())
        .drop("__norm")
    )


def summary(rows: DataFrame, top_k: int, *by: str, rollup: bool = False) -> DataFrame:
    """One row: recall, mean reciprocal rank over answerable cases (misses count 0), answers
    to unanswerable cases that do not refuse, and case counts. ``by`` breaks it down, and
    ``rollup`` adds subtotals."""
    found = F.col("answerable") & F.col("first_evidence_rank").isNotNull()
    answerable = F.count_if(F.col("answerable"))
    unrefused = (F.coalesce("answer", F.lit("")) != "") & ~F.col("answerable") & (F.col("unanswerable_refusal") == F.lit(False))
    grouped = rows.rollup(*by) if rollup else rows.groupBy(*by)
    return grouped.agg(
        F.try_divide(F.count_if(found).cast("double"), answerable).alias(f"recall_at_{top_k}"),
        F.try_divide(F.sum(F.when(found, 1.0 / F.col("first_evidence_rank")).otherwise(0.0)), answerable).alias("mrr"),
        F.count_if(unrefused).alias("unanswerable_non_refusal_count"),
        F.count("*").alias("case_count"),
        answerable.alias("answerable_case_count"),
    )
