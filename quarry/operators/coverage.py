"""What a corpus holds for the cases: evidence and keywords of all cases, looked for in all chunks.

``evaluation`` checks the few results of a case against that case's own phrases, in built-in expressions. Here every chunk meets the
phrases of every case. The number of chunks that satisfy a case's evidence says what retrieval could find at best: a case without
one can't be found by any search, however large its k.

The normalised phrases of a block of cases make one Aho-Corasick automaton. A text is normalised once, on the JVM side, and goes
through it once, whatever the number of phrases. Tasks add up what they find, so one row a task and phrase or set of evidence
moves, and no text. Cases with equal evidence are looked for once. A block holds at most ``BYTES`` of phrases (or one set of
evidence); more cases are more blocks, each a pass over the chunks. What was found is written, as it is read twice.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import shared
from . import grid

BYTES = 8 << 20
#: Bytes of normalised texts that a task looks at at once.
PIECE = 1 << 20
_BORDERLESS = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")
_ITEM = "array<struct<page:int,phrase:string>>"
_built: dict[tuple, Phrases] = {}


class Phrases:
    """Phrases by number, and which of them a text holds. With ``strict``, one must end before a character other than 0-9 and a-z."""

    def __init__(self, phrases: Iterable[str], strict: bool = False):
        import ahocorasick

        self.strict, self.number = strict, {p: i for i, p in enumerate(dict.fromkeys(phrases))}
        self._always = {self.number[""]} if "" in self.number else set()
        self._automaton = ahocorasick.Automaton()
        for phrase, i in self.number.items():
            if phrase:
                self._automaton.add_word(phrase, i)
        self._automaton.make_automaton()

    def found(self, text: str | None) -> set[int]:
        """Numbers of the phrases in a normalised text; none in a null one."""
        if text is None:
            return set()
        if not len(self._automaton):
            return set(self._always)
        ends = self._automaton.iter(text)
        if self.strict:
            return self._always | {i for end, i in ends if end + 1 == len(text) or text[end + 1] not in _BORDERLESS}
        return self._always | {i for _, i in ends}

    @classmethod
    def of(cls, phrases: tuple[str, ...], strict: bool) -> Phrases:
        """Made once for each Python worker; the last few are kept."""
        key = (phrases, strict)
        if key not in _built:
            while len(_built) >= 4:
                _built.pop(next(iter(_built)))
            _built[key] = cls(phrases, strict)
        return _built[key]


def evidence(expected: Column) -> Column:
    """The checks of evidence items, as ``evaluation.evidence_matches`` makes them: JSON of distinct (page, phrase) items in
    order, without those that check nothing. A page that is no number is -1."""
    page = lambda e: F.when(e["page"].isNotNull(), F.coalesce(F.trim(e["page"]).try_cast("int"), F.lit(-1)))
    phrase = lambda e: F.when(e["article"] != "", tx.normalize(e["article"]))
    items = F.transform(expected, lambda e: F.struct(page(e).alias("page"), phrase(e).alias("phrase")))
    checks = F.filter(items, lambda i: i["page"].isNotNull() | i["phrase"].isNotNull())
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(checks, F.array().cast(_ITEM)))))


def keywords(expected: Column) -> Column:
    """The normalised keywords, duplicates kept, nulls left out."""
    return F.filter(F.transform(F.coalesce(expected, F.array().cast("array<string>")), tx.normalize), lambda k: k.isNotNull())


def blocks(wanted: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    """The rows of ``wanted(kind, value)`` in blocks of about ``most`` bytes."""
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    for k in range(n):
        rows = (wanted.where(F.pmod(F.xxhash64("kind", "value"), F.lit(n)) == k) if n > 1 else wanted).collect()
        if rows:
            yield [(r["kind"], r["value"]) for r in rows]


def _counts(chunks: DataFrame, block: list[tuple[str, str]], strict: bool) -> DataFrame:
    """``kind, value, n_chunks``: what tasks found of one block, added up in each task."""
    sets = [(value, [(i.get("page"), i.get("phrase")) for i in json.loads(value)]) for kind, value in block if kind == "evidence"]
    words = [value for kind, value in block if kind == "keyword"]
    phrases = tuple(sorted({p for _, items in sets for _, p in items if p is not None}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, spoken = Phrases.of(phrases, strict), Phrases.of(tuple(words), False)
        by_page, by_phrase = defaultdict(set), defaultdict(list)
        for s, (_, items) in enumerate(sets):
            for page, phrase in items:
                if phrase is None:
                    by_page[page].add(s)
                else:
                    by_phrase[known.number[phrase]].append((page, s))
        met, said = Counter(), Counter()
        for b in _pieces(batches):
            texts, articles = pc.dictionary_encode(b.column("text")), pc.dictionary_encode(b.column("article"))
            in_text, in_article = ([known.found(t or None) for t in c.dictionary.to_pylist()] for c in (texts, articles))
            heard = [spoken.found(t) for t in texts.dictionary.to_pylist()]
            for t, a, first, last in zip(texts.indices.to_pylist(), articles.indices.to_pylist(), b.column("page_start").to_pylist(), b.column("page_end").to_pylist()):
                paged = first is not None and last is not None
                hit = {s for p in _pages(by_page, first, last) for s in by_page[p]} if paged else set()
                for i in (in_text[t] if t is not None else set()) | (in_article[a] if a is not None else set()):
                    hit.update(s for page, s in by_phrase[i] if page is None or paged and first <= page <= last)
                met.update(hit)
                if t is not None:
                    said.update(heard[t])
        rows = [("evidence", sets[s][0], n) for s, n in met.items()] + [("keyword", words[i], n) for i, n in said.items()]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["kind", "value", "n"])

    slim = chunks.select("page_start", "page_end", tx.normalize(F.col("article")).alias("article"), tx.normalize(F.col("text")).alias("text"))
    return slim.mapInArrow(run, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n_chunks"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about ``PIECE`` bytes of texts and articles, for what is made of them in Python."""
    for b in batches:
        size = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("text", "article"))
        for own in grid.pieces(size, PIECE):
            yield b.slice(own.start, own.stop - own.start)


def _pages(wanted: dict, first: int, last: int) -> Iterable[int]:
    """The pages of first..last that are wanted, whichever of the two is shorter being walked."""
    if last - first < len(wanted):
        return [p for p in range(first, last + 1) if p in wanted]
    return [p for p in wanted if first <= p <= last]


def coverage(chunks: DataFrame, cases: DataFrame, strict: bool = False, block_bytes: int = BYTES) -> DataFrame:
    """``cases(expected_citations, expected_keywords, ...)`` with ``evidence_chunks`` (chunks of ``chunks(text, article,
    page_start, page_end)`` that satisfy an evidence item, each counted once; 0 without items), ``keyword_total`` and
    ``keywords_present`` (keywords, repeats counted, that some chunk's text holds). Null arrays count as empty; null and empty
    texts hold no evidence; an empty keyword is in every text that is not null. Cases may repeat, and have columns of any other names."""
    own = cases.withColumn("__items", evidence(F.col("expected_citations"))).withColumn("__words", keywords(F.col("expected_keywords")))
    sets = own.select(F.lit("evidence").alias("kind"), F.col("__items").alias("value")).where("value <> '[]'")
    wanted = sets.union(own.select(F.lit("keyword").alias("kind"), F.explode("__words").alias("value"))).distinct()
    empty = chunks.sparkSession.createDataFrame([], "kind string, value string, n_chunks long")
    found = shared.write_table(reduce(DataFrame.union, (_counts(chunks, block, strict) for block in blocks(wanted, block_bytes)), empty), "coverage")
    met = found.where("kind = 'evidence'").select(F.col("value").alias("__items"), F.col("n_chunks").alias("evidence_chunks"))
    said = found.where("kind = 'keyword'").select(F.col("value").alias("__word"), F.lit(1).alias("__there"))
    lists = own.select("__words").distinct().select("__words", F.explode("__words").alias("__word")).join(said, "__word")
    present = lists.groupBy("__words").agg(F.count("*").alias("keywords_present"))
    out = own.join(met, "__items", "left").join(present, "__words", "left")
    return out.select(
        *cases.columns, F.coalesce("evidence_chunks", F.lit(0)).cast("long").alias("evidence_chunks"),
        F.coalesce(F.size("expected_keywords"), F.lit(0)).alias("keyword_total"), F.coalesce("keywords_present", F.lit(0)).cast("long").alias("keywords_present"),
    )


def ceiling(covered: DataFrame) -> DataFrame:
    """One row: the recall that no search over these chunks can exceed (answerable cases with evidence somewhere), and the counts."""
    answerable = F.count_if("answerable")
    there = F.count_if(F.col("answerable") & (F.col("evidence_chunks") > 0))
    return covered.agg(F.try_divide(there.cast("double"), answerable).alias("recall_ceiling"), there.alias("covered_case_count"), answerable.alias("answerable_case_count"))
