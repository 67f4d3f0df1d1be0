"""Section-aware chunking of pages, as one native plan.

A page is packed and split within its own row. What runs across pages, the article that is running
and the numbers of chunks, is settled by windows over slim rows, one a page, so no text is sorted or
gathered by document, however large or frequent that is.

Paragraphs are packed greedily into groups of at most ``max_chars`` (counting two characters
between paragraphs), never across pages. The article of a group is the last header within it,
else the running one as it stood when the group was flushed, i.e. after the paragraph that did
not fit. Groups over the limit are cut into overlapping windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import shared

GAP = 2


def pack_starts(lengths: Column, max_chars: int) -> Column:
    """First number (from 0) of each group of the ``lengths`` (array<int>) under greedy packing."""
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("used"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["used"] >= 0) & (acc["used"] + GAP + n <= max_chars)
        used = F.when(fits, acc["used"] + GAP + n).otherwise(n)
        starts = F.when(fits, acc["starts"]).otherwise(F.array_append(acc["starts"], acc["at"]))
        return F.struct((acc["at"] + 1).alias("at"), used.alias("used"), starts.alias("starts"))

    return F.aggregate(lengths, start, step, lambda acc: acc["starts"])


def spans(starts: Column, n: Column) -> Column:
    """(first, size) of each group, from their starts and the number of all."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), (b - a).alias("size")))


def pack_groups(lengths: Column, max_chars: int) -> Column:
    """Group number of each of the ``lengths`` (array<int>) under greedy packing."""
    groups = F.transform(spans(pack_starts(lengths, max_chars), F.size(lengths)), lambda x, i: F.array_repeat(i, x["size"]))
    return F.when(F.size(lengths) > 0, F.flatten(groups)).otherwise(F.array().cast("array<int>"))


def check_window(max_chars: int, overlap: int) -> None:
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError(f"need 0 <= overlap < chunk size, got overlap {overlap} and chunk size {max_chars}")


def split_long(text: Column, max_chars: int, overlap: int) -> Column:
    """Array of the text itself, or of its stripped, non-empty overlapping windows."""
    check_window(max_chars, overlap)
    step = max_chars - overlap
    last = F.ceil(F.greatest(F.length(text) - max_chars, F.lit(0)) / step).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda k: tx.strip(F.substring(text, k * step + 1, F.lit(max_chars))))
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(F.filter(windows, lambda p: p != ""))


def paragraph_rows(pages: DataFrame, spellings=tx.ARTICLE_SPELLINGS, name: str = tx.ARTICLE_NAME) -> DataFrame:
    """``doc_id, page_number, para_idx, current``: paragraphs' places with the article that is
    running after each (null before the first header); state crosses pages, not documents. Within a page it is found in the page's
    own row; windows see one slim row a page."""
    cleaned = shared.spread(pages).select("doc_id", "page_number", tx.clean_text(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    found = F.transform(tx.paragraphs(F.col("text")), lambda p: tx.last_article(p, spellings=spellings, name=name))
    made = shared.write_table(cleaned.select("doc_id", "page_number", found.alias("found")), "headers")
    last = F.try_element_at(F.filter("found", lambda x: x.isNotNull()), F.lit(-1))
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    carried = made.select("doc_id", "page_number", last.alias("last")).select("doc_id", "page_number", F.last("last", ignorenulls=True).over(before).alias("carried"))
    none = F.array().cast("array<struct<article:string,title:string>>")
    running = F.aggregate("found", F.struct(F.col("carried").alias("now"), none.alias("all")), lambda a, x: F.struct(F.coalesce(x, a["now"]).alias("now"), F.array_append(a["all"], F.coalesce(x, a["now"])).alias("all")), lambda a: a["all"])
    rows = made.join(carried, ["doc_id", "page_number"]).select("doc_id", "page_number", F.posexplode(running).alias("para_idx", "current"))
    return rows


def page_parts(pages: DataFrame, max_chars: int = 1800, overlap: int = 250, spellings=tx.ARTICLE_SPELLINGS, name: str = tx.ARTICLE_NAME, lookahead: bool = True) -> DataFrame:
    """``doc_id, page_number, last, parts`` of each page that has text: its chunks (``text, own``, the article if the page tells) and its
    last article. What a page can't tell comes from the pages before it."""
    check_window(max_chars, overlap)
    header = lambda x: tx.last_article(x, spellings=spellings, name=name)
    none = F.lit(None).cast("struct<article:string,title:string>")
    last = lambda xs: F.try_element_at(F.filter(xs, lambda x: x.isNotNull()), F.lit(-1))
    cleaned = pages.select("doc_id", "page_number", tx.clean_text(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    paras = cleaned.select("doc_id", "page_number", tx.paragraphs(F.col("text")).alias("paras"))
    found = paras.withColumn("found", F.transform("paras", header)).withColumn("starts", pack_starts(F.transform("paras", F.length), max_chars))

    def group(x: Column) -> Column:
        end = x["first"] + x["size"]
        seen = F.when(end < F.size("paras"), end + 1).otherwise(end) if lookahead else end
        return F.struct(F.array_join(F.slice("paras", x["first"] + 1, x["size"]), "\n").alias("text"), F.coalesce(last(F.slice("found", 1, seen)), none).alias("running"))

    groups = found.select("doc_id", "page_number", F.coalesce(last(F.col("found")), none).alias("last"), F.transform(spans(F.col("starts"), F.size("paras")), group).alias("groups"))
    headed = groups.withColumn("groups", F.transform("groups", lambda g: F.struct(F.coalesce(header(g["text"]), g["running"]).alias("own"), split_long(g["text"], max_chars, overlap).alias("texts"))))
    part = lambda g: F.transform(g["texts"], lambda p: F.struct(p.alias("text"), g["own"].alias("own")))
    return headed.select("doc_id", "page_number", "last", F.flatten(F.transform("groups", part)).alias("parts"))


def chunk_rows(pages: DataFrame) -> DataFrame:
    """Chunks of ``pages(doc_id, page_number, parts, carried, base)``: the article that runs into the page, and how many chunks the document has before it."""
    rows = pages.select("doc_id", "page_number", "carried", "base", F.posexplode("parts").alias("at", "part"))
    final = F.coalesce("part.own", "carried")
    return rows.withColumn("ordinal", (F.col("base") + F.col("at") + 1).cast("int")).select(
        "doc_id",
        "ordinal",
        F.format_string("p%03d-c%04d", "page_number", "ordinal").alias("id"),
        F.col("part.text").alias("text"),
        F.col("page_number").alias("page_start"),
        F.col("page_number").alias("page_end"),
        final["article"].alias("article"),
        final["title"].alias("title"),
    )


def build_chunks(pages: DataFrame, max_chars: int = 1800, overlap: int = 250, spellings=tx.ARTICLE_SPELLINGS, name: str = tx.ARTICLE_NAME, lookahead: bool = True) -> DataFrame:
    """Chunks of ``pages(doc_id, page_number, text)``: ``doc_id, ordinal, id, text,
    page_start, page_end, article, title``. ``lookahead=False`` gives a flushed group the
    article of its own last paragraph instead of that of the paragraph that flushed it. A page
    is one row: the (doc_id, page_number) pairs must differ."""
    made = shared.write_table(page_parts(shared.spread(pages), max_chars, overlap, spellings, name, lookahead), "chunks")
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    slim = made.select("doc_id", "page_number", "last", F.size("parts").alias("n"))
    ahead = slim.select("doc_id", "page_number", F.last("last", ignorenulls=True).over(before).alias("carried"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return chunk_rows(made.drop("last").join(ahead, ["doc_id", "page_number"]))


def require_chunks(chunks: DataFrame) -> DataFrame:
    if chunks.isEmpty():
        raise RuntimeError("no chunk could be made from the page texts")
    return chunks
