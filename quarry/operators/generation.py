"""Context, prompts and pluggable answer generation."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.replies import Replies

SEPARATOR = "\n\n---\n\n"
SYSTEM = (
    "You answer questions about the documents of this index.\n"
    "Use nothing but the passages given as context.\n"
    "Cite every statement as [Trang N] or [Trang N, Điều M], as the passages are labelled.\n"
    "Say clearly when the passages do not answer the question or it lies outside them."
)


def context_block(max_chars: int = 1800) -> Column:
    """One result's block: label and citation, the three scores, the head of its text."""
    cite = tx.citation(F.col("page_start"), F.col("page_end"), F.col("article"))
    scores = F.format_string("score=%.3f semantic=%.3f keyword=%.3f", "score", "semantic_score", "keyword_score")
    return F.concat_ws("\n", F.concat(F.lit("[C"), F.col("rank").cast("string"), F.lit("] "), cite), scores, tx.strip(F.substring("text", 1, max_chars)))


def contexts(results: DataFrame, max_chars: int = 1800) -> DataFrame:
    """``query_id, context``: the blocks of each question's results, in rank order."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", context_block(max_chars).alias("block"))))  # k entries
    return results.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), SEPARATOR).alias("context"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(
        F.lit("Question:\n"), question, F.lit("\n\nContext passages:\n"), F.coalesce(context, F.lit("")),
        F.lit("\n\nRequirements:\n- answer briefly and in the question's language\n- cite page and article for each claim\n- if the context does not suffice, say so"),
    )


def response_text(response: object) -> str:
    """The text of a service's response: its ``output_text``, else its content parts by line."""
    whole = getattr(response, "output_text", None)
    if whole:
        return str(whole).strip()
    parts = (part for item in getattr(response, "output", None) or [] for part in getattr(item, "content", None) or [])
    return "\n".join(str(t) for t in (getattr(p, "text", None) for p in parts) if t).strip()


def openai_client(model: str, max_output_tokens: int = 1200) -> Callable[[], Callable[[str, str], str]]:
    """A factory of clients, made once for each Python worker."""
    if not os.getenv("OPENAI_API_KEY"):
        raise RuntimeError("no API key: set OPENAI_API_KEY, or skip generation")

    def make() -> Callable[[str, str], str]:
        from openai import OpenAI

        client = OpenAI()

        def ask(system: str, user: str) -> str:
            messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
            return response_text(client.responses.create(model=model, input=messages, max_output_tokens=max_output_tokens))

        return ask

    return make


def extractive_client() -> Callable[[str, str], str]:
    """Offline stand-in: repeats the first line of the first passage with its label."""

    def ask(system: str, user: str) -> str:
        lines = user.partition("Context passages:\n")[2].split("\n")
        return f"{lines[2]} [{lines[0].partition('] ')[2]}]" if len(lines) > 2 and lines[0].startswith("[C") else ""

    return ask


def answers(queries: DataFrame, make_client: Callable[[], Callable[[str, str], str]], replies: Replies | None = None, kind: str = "answer") -> DataFrame:
    """Adds ``answer`` and ``answer_error`` to ``queries(question, context)``. A failing call
    leaves an empty answer and its error's text; the other rows go on. With ``replies``, what that store has for the same ``kind``
    and prompt is not asked again."""
    asked = queries.withColumn("__prompt", prompt(F.col("question"), F.col("context")))
    if replies is not None:

        def one_by_one() -> Callable[[list[str]], list[str]]:
            client = make_client()
            return lambda prompts: [client(SYSTEM, p).strip() for p in prompts]

        made = replies.of(asked, "__prompt", kind, one_by_one)
        error = F.when(F.col("reply_error").isNotNull(), F.concat(F.lit("answer_generation error: "), F.col("reply_error")))
        return made.select(*queries.columns, F.coalesce("reply", F.lit("")).alias("answer"), error.alias("answer_error"))

    @F.pandas_udf("struct<answer:string,answer_error:string>")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for series in prompts:
            rows = []
            for text in series:
                try:
                    rows.append((client(SYSTEM, text).strip(), None))
                except Exception as e:  # any failure of the service belongs to its row
                    rows.append(("", f"answer_generation error: {type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["answer", "answer_error"])

    return asked.withColumn("__a", run(F.col("__prompt"))).select(*queries.columns, "__a.answer", "__a.answer_error")
