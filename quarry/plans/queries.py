"""Registered queries of the retrieval engine over the fixture tables, with SQL twins.

Documents play pages and chunks (a document's vector is the embedding of its number, if there is
one), benchmark items play questions, assistant turns play answers, labels play cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, coverage, embedding, evaluation, generation, grid, lexical, search
from ..operators import vectors as vectors_
from ..sources import pdf, shared, tables
from . import report

K = 5
MAX_CHARS, OVERLAP = 1800, 250
DIGITS = 9  # scores are ranked on so many digits, for both engines


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents")


# ------------------------------------------------------------------ text


def norm_text(spark, d):
    return _docs(spark, d).select("doc_id", tx.normalize(F.col("text")).alias("norm"))


def tokenize(spark, d):
    t = tx.tokenize(F.col("text"))
    return shared.spread(_docs(spark, d)).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


def clean_text(spark, d):
    rough = F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n\n \t \f"))
    return _docs(spark, d).select("doc_id", tx.clean_text(rough).alias("cleaned"))


def short_text(spark, d):
    return _read(spark, d, "conversations").select("conv_id", "turn", tx.short_text(F.col("text"), 60).alias("short"), tx.escape_cell(F.col("text"), 40).alias("cell"))


def paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(tx.paragraphs(tx.clean_text(F.col("text")))).alias("para_idx", "para"))


# ------------------------------------------------------------------ chunking


def pack_chunks(spark, d):
    lengths = F.transform(tx.paragraphs(tx.clean_text(F.col("text"))), F.length)
    return shared.spread(_docs(spark, d)).select("doc_id", F.posexplode(chunking.pack_groups(lengths, MAX_CHARS)).alias("para_idx", "grp"))


def split_windows(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunking.split_long(F.col("text"), MAX_CHARS, OVERLAP)).alias("part", "window_text"))


def _pages(spark, d):
    header = F.concat(F.lit("Điều "), (F.col("doc_id") % 50).cast("string"), F.lit(". Title "), F.col("doc_id").cast("string"), F.lit("\n"))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(header, F.col("text"))).otherwise(F.col("text"))
    return _docs(spark, d).select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_number"), body.alias("text"))


def article_carry(spark, d):
    return chunking.paragraph_rows(_pages(spark, d)).select("doc_id", "page_number", "para_idx", F.col("current.article").alias("article"), F.col("current.title").alias("title"))


def chunks(spark, d):
    return chunking.build_chunks(_pages(spark, d), MAX_CHARS, OVERLAP)


def index_roundtrip(spark, d):
    path = shared.new_path(spark, "index")
    made = chunks(spark, d).withColumn("embedding", F.lit(None).cast("array<double>"))
    tables.save_index(made, path, {"pdf": d, "chunk_size": MAX_CHARS, "overlap": OVERLAP})
    return tables.load_index(spark, path)[1].drop("embedding")


# ------------------------------------------------------------------ lexical


def term_freq(spark, d):
    return lexical.term_freq(shared.spread(_docs(spark, d)), "doc_id")


def doc_freq(spark, d):
    return lexical.doc_freq(shared.spread(_docs(spark, d)))


def doc_len(spark, d):
    return lexical.doc_len(shared.spread(_docs(spark, d)), "doc_id")


def corpus_stats(spark, d):
    return lexical.corpus_stats(doc_len(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def _questions(spark, d):
    vectors = _read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    items = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    few = lexical.is_small(items.select("query_id"))
    own = vectors.join(lexical.hinted(items.select("query_id"), few), "query_id", "left_semi")
    return items.join(lexical.hinted(own, few), "query_id", "left")


def bm25_topk(spark, d):
    asked = _questions(spark, d).select("query_id", "question")
    found = search.best(_docs(spark, d).select("doc_id", "text"), asked, K, "doc_id", "keyword", DIGITS)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def postings_topk(spark, d):
    """The same by an index of postings, blocks of which are skipped."""
    rows = lexical.numbered(grid.term_counts(shared.spread(_docs(spark, d).select(F.col("doc_id").alias("key"), "text"))))
    rows = shared.write_table(rows, "index_rows")
    index = lexical.KeywordIndex.of(rows, shared.write_table(lexical.postings(rows), "index_postings"))
    found = search.keyword_best(index, _questions(spark, d).select("query_id", "question"), K, DIGITS)
    return found.select("query_id", "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def _indexed(spark, d):
    vectors = _read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return shared.spread(_docs(spark, d)).join(vectors, "doc_id", "left")


def cosine_topk(spark, d):
    asked = _questions(spark, d).where(F.col("query_embedding").isNotNull()).select("query_id", "query_embedding")
    found = search.best(_read(spark, d, "embeddings").select("vec_id", "embedding"), asked, K, "vec_id", "semantic", DIGITS)
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def coded_topk(spark, d):
    """The same by a scan of coded vectors; full ones are fetched for what may be among the nearest."""
    vectors = _read(spark, d, "embeddings").select("vec_id", "embedding")
    codes = shared.write_table(vectors_.coded(vectors, "vec_id"), "codes")
    asked = _questions(spark, d).where(F.col("query_embedding").isNotNull()).select("query_id", "query_embedding")
    found = vectors_.nearest(vectors, codes, asked, K, "vec_id", round_to=DIGITS)
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def minmax_scores(spark, d):
    first = _read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    ends = first.groupBy("label").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return first.join(ends, "label").select("vec_id", "label", F.round(search.minmax(F.col("x"), F.col("lo"), F.col("hi")), 6).alias("scaled"))


def _hybrid(spark, d):
    return search.search(_indexed(spark, d), _questions(spark, d), K, key="doc_id", round_to=DIGITS)


def hybrid_topk(spark, d):
    six = [F.round(c, 6).alias(c) for c in ("score", "semantic_score", "keyword_score")]
    return _hybrid(spark, d).select("query_id", "rank", "doc_id", *six)


def hash_embed(spark, d):
    out = embedding.LocalHashEmbedder().embed(shared.spread(_docs(spark, d).select("doc_id", "text")))
    return out.select("doc_id", "embedding")


def hash_embed_md5(spark, d):
    return embedding.NativeHashEmbedder().sparse(_docs(spark, d), "doc_id")


# ------------------------------------------------------------------ evaluation


def _results(spark, d):
    page = F.col("doc_id").cast("int")
    return _hybrid(spark, d).select("query_id", "rank", "score", "semantic_score", "keyword_score", page.alias("page_start"), page.alias("page_end"), F.col("source").alias("article"), "text")


def citations(spark, d):
    cite = tx.citation(F.col("page_start"), F.col("page_end"), F.col("article"))
    return _results(spark, d).select("query_id", "rank", cite.alias("citation"))


def context_blocks(spark, d):
    return generation.contexts(_results(spark, d), 200)


def offline_answers(spark, d):
    asked = _questions(spark, d).select("query_id", "question").join(context_blocks(spark, d), "query_id", "left")
    return generation.answers(asked, generation.extractive_client).select("query_id", "answer", "answer_error")


def evidence_rank(spark, d):
    q = F.col("query_id")
    item = lambda article, page: F.struct(article.cast("string").alias("article"), page.cast("string").alias("page"))
    expected = F.array(
        item(F.concat(F.lit("SRC"), (q % 20).cast("string")), F.lit(None)),
        item(F.lit(None), q * 7),
        item(F.lit(""), F.lit("no number")),
        item(F.lit(None), F.lit(None)),
    )
    rows = evaluation.results_by_query(_results(spark, d)).withColumn("expected", expected)
    return rows.select("query_id", evaluation.first_evidence_rank(F.col("results"), F.col("expected")).alias("first_evidence_rank"))


def evidence_coverage(spark, d):
    """Which of all documents hold what the questions expect: a source, a page, both, or words of the question."""
    q = F.col("query_id")
    item = lambda article, page: F.struct(article.cast("string").alias("article"), page.cast("string").alias("page"))
    src = lambda n: F.concat(F.lit("SRC"), (q % n).cast("string"))
    words = F.split(F.col("text"), " ")
    cases = _read(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), "text",
    ).select(
        "query_id", F.when(q % 3 == 0, F.array(item(src(20), F.lit(None)), item(F.lit(None), q * 7))).when(q % 3 == 1, F.array(item(src(5), q * 11), item(F.lit(""), F.lit("no number"))))
        .otherwise(F.array(item(F.get(words, F.lit(1)), F.lit(None)), item(F.lit(None), F.lit(None)))).alias("expected_citations"),
        F.array(F.get(words, F.lit(0)), F.concat_ws(" ", F.get(words, F.lit(2)), F.get(words, F.lit(3))), F.lit("ZZ no such words")).alias("expected_keywords"),
    )
    docs = shared.spread(_docs(spark, d)).select("text", F.col("source").alias("article"), F.col("doc_id").cast("int").alias("page_start"), F.col("doc_id").cast("int").alias("page_end"))
    return coverage.coverage(docs, cases).select("query_id", "evidence_chunks", "keyword_total", "keywords_present")


def _answers(spark, d):
    turns = _read(spark, d, "conversations").where("role = 'assistant'")
    tail = F.when(F.col("turn") % 3 == 0, " [Trang 3]").when(F.col("turn") % 3 == 1, " Không có thông tin.").otherwise("")
    return turns.select(
        "conv_id", "turn", F.concat("text", tail).alias("answer"), (F.col("conv_id") % 2 == 0).alias("answerable"),
        F.array(F.lit("The"), F.lit("Khong CO"), F.lit("é"), F.lit("The")).alias("expected_keywords"),
    ).withColumn("expected_citations", F.array().cast("array<struct<article:string,page:string>>"))


def rule_checks(spark, d):
    out = evaluation.rule_checks(_answers(spark, d))
    return out.select("conv_id", "turn", "keyword_hit_count", "keyword_total", F.round("keyword_hit_ratio", 6).alias("keyword_hit_ratio"), "citation_present", "unanswerable_refusal", "retrieval_hit")


def case_lines(spark, d):
    rows = evaluation.rule_checks(_answers(spark, d)).withColumn("answer_error", F.lit(None).cast("string"))
    named = rows.withColumn("id", F.concat(F.lit("C"), F.col("conv_id").cast("string"))).withColumn("category", F.lit("chat"))
    return named.select("conv_id", "turn", report.table_line().alias("line"), report.case_line().alias("console"))


def _cases(spark, d):
    rank = F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 5 + 1).cast("int"))
    answer = F.when(F.col("doc_id") % 6 == 0, "").otherwise("text")
    refusal = F.when(F.col("quality") == 0, F.col("doc_id") % 3 == 0)
    return _read(spark, d, "labels").select("doc_id", "toxic", (F.col("quality") == 1).alias("answerable"), rank.alias("first_evidence_rank"), answer.alias("answer"), refusal.alias("unanswerable_refusal"))


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if c in (f"recall_at_{K}", "mrr") else F.col(c) for c in df.columns))


def eval_summary(spark, d):
    return _rounded(evaluation.summary(_cases(spark, d), K))


def eval_breakdown(spark, d):
    return _rounded(evaluation.summary(_cases(spark, d), K, "toxic", rollup=True))


def _page_rows(spark, d):
    low = F.when(F.col("n_chars") < 80, F.array(F.lit("low_ocr_text"))).otherwise(F.array().cast("array<string>"))
    return _docs(spark, d).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), F.col("n_chars").alias("char_count"), low.alias("warnings"))


def page_quality(spark, d):
    return tables.page_quality(_page_rows(spark, d), "doc_id")


def usable_text_layers(spark, d):
    return pdf.usable_documents(_page_rows(spark, d), 2500)


def image_numbers(spark, d):
    n = F.col("page_id").cast("string")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("scan-a-"), n)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("dir-7/page-"), n, F.lit(".png"))).otherwise(F.concat(n, F.lit("-x.png")))
    return _read(spark, d, "pages").select("page_id", name.alias("name"), pdf.image_order(name).alias("number"))


def page_cache(spark, d):
    path = shared.new_path(spark, "pages")
    page = _page_rows(spark, d).select("doc_id", F.col("page_number").cast("int"), F.lit("").alias("text"), F.col("char_count").cast("int"), F.lit("fixture").alias("source"), "warnings")
    tables.save_pages(page, path, d)
    return tables.load_pages(spark, path).select("doc_id", "page_number", "char_count", "source", F.array_join("warnings", ",").alias("warnings"))


def quality_lines(spark, d):
    return page_quality(spark, d).select("doc_id", tables.quality_line().alias("line"))


def report_metrics(spark, d):
    s = evaluation.summary(_cases(spark, d), K, "toxic")
    return s.select("toxic", report.metric(F.col(f"recall_at_{K}")).alias("recall"), report.metric(F.col("mrr")).alias("mrr"), report.metric(F.lit(None).cast("double")).alias("none"))


def wire_rows(spark, d):
    listed = evaluation.results_by_query(_results(spark, d).withColumn("id", F.lit("c")).withColumn("title", F.lit(None).cast("string")))
    x = listed.select("query_id", F.explode(report.wire_results(F.col("results"))).alias("x"))
    return x.select("query_id", "x.rank", "x.score", "x.semantic_score", "x.keyword_score", "x.chunk.page_start", "x.chunk.article", "x.chunk.title")


def prompts(spark, d):
    asked = _questions(spark, d).select("query_id", "question").join(context_blocks(spark, d), "query_id", "left")
    return asked.select("query_id", generation.prompt(F.col("question"), F.col("context")).alias("prompt"))


def _odd_client():
    def ask(system, user):
        if len(user) % 2:
            raise ValueError("odd")
        return f" {len(user)} "

    return ask


def answer_errors(spark, d):
    asked = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("context"))
    return generation.answers(asked, _odd_client).select("query_id", "answer", "answer_error")


def default_topk(spark, d):
    asked = _questions(spark, d).where(F.col("query_embedding").isNotNull()).select("query_id", "query_embedding")
    return search.best(_read(spark, d, "embeddings"), asked, search.effective_top_k(0, 3), "vec_id", "semantic", DIGITS).select("query_id", "rank", "vec_id")


def first_cases(spark, d):
    return search.first_rows(_read(spark, d, "labels"), 10, "doc_id").select("doc_id", "quality", "toxic")


# ------------------------------------------------------------------ SQL

_NORM = "lower(replace(replace(strip_accents({0}), 'đ', 'd'), 'Đ', 'D'))"
_TOKENS = "regexp_extract_all(" + _NORM + ", '[0-9a-zA-Z\\x{{00C0}}-\\x{{1EF9}}]+')"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _clean(x: str) -> str:
    x = f"regexp_replace(replace({x}, chr(12), chr(10)), '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '(?m)^\\s+', '', 'g')"
    return _STRIP.format(x)


_PARAS = "list_filter(list_transform(string_split(replace({0}, '.' || chr(10), '.' || chr(1)), chr(1)), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '')"
_ARTICLE = r"(?im)^\s*(?:điều|die[uú]|dieu|ðieu|ðiều)\s+([0-9]+[a-zA-Z]?)\s*[\.:]?\s*(.*)$"
_PAGES = "(select source as doc_id, cast(doc_id as int) as page_number, case when doc_id % 3 = 0 then 'Điều ' || (doc_id % 50) || '. Title ' || doc_id || chr(10) || text else text end as text from documents)"


def _last(x: str, group: int) -> str:
    return f"list_extract(regexp_extract_all({x}, '{_ARTICLE}', {group}), -1)"


_PARA_ROWS = f"""
para as (select doc_id, page_number, unnest(range(len(p))) as para_idx, unnest(p) as para
         from (select doc_id, page_number, {_PARAS.format(_clean("text"))} as p from {_PAGES})),
found as (select *, case when {_last("para", 1)} is not null then {{'article': 'Điều ' || {_last("para", 1)}, 'title': nullif({_STRIP.format(_last("para", 2))}, '')}} end as art from para),
carried as (select doc_id, page_number, para_idx, para,
            last_value(art ignore nulls) over (partition by doc_id order by page_number, para_idx rows between unbounded preceding and current row) as cur from found)
"""


def _packing(source: str, keys: str) -> str:
    """Recursive greedy packing of ``source(keys, para_idx, n)``."""
    on = " and ".join(f"s.{k} = p.{k}" for k in keys.split(", "))
    listed = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""packed as (
  select {keys}, para_idx, 0 as grp, n as used from {source} where para_idx = 0
  union all
  select {listed}, s.para_idx, case when p.used + 2 + s.n <= {MAX_CHARS} then p.grp else p.grp + 1 end,
         case when p.used + 2 + s.n <= {MAX_CHARS} then p.used + 2 + s.n else s.n end
  from packed p join {source} s on {on} and s.para_idx = p.para_idx + 1)"""


_STEP = MAX_CHARS - OVERLAP


def _windows(text: str) -> str:
    return f"case when length({text}) <= {MAX_CHARS} then [{text}] else list_filter(list_transform(range(cast(ceil((length({text}) - {MAX_CHARS}) / {float(_STEP)}) as bigint) + 1), lambda k: {_STRIP.format(f'substr({text}, k * {_STEP} + 1, {MAX_CHARS})')}), lambda x: x <> '') end"


_CHUNKS = f"""with recursive {_PARA_ROWS},
lens as (select doc_id, page_number, para_idx, length(para) as n from carried),
{_packing("lens", "doc_id, page_number")},
grouped as (select c.doc_id, c.page_number, g.grp, string_agg(c.para, chr(10) order by c.para_idx) as text,
            arg_min({{'c': c.cur}}, c.para_idx) as at_first, arg_max({{'c': c.cur}}, c.para_idx) as at_last
            from carried c join packed g on c.doc_id = g.doc_id and c.page_number = g.page_number and c.para_idx = g.para_idx group by 1, 2, 3),
flushed as (select *, coalesce(lead(at_first) over w, at_last).c as state, lead(grp) over w as nxt, lead(at_first) over w as ahead from grouped window w as (partition by doc_id, page_number order by grp)),
final as (select doc_id, page_number, grp, text, case when nxt is null then at_last.c else ahead.c end as carried_art,
          case when {_last("text", 1)} is not null then {{'article': 'Điều ' || {_last("text", 1)}, 'title': nullif({_STRIP.format(_last("text", 2))}, '')}} end as own from flushed),
parts as (select doc_id, page_number, grp, coalesce(own, carried_art) as art, unnest(range(len(w))) as part, unnest(w) as text from (select *, {_windows("text")} as w from final)),
numbered as (select *, row_number() over (partition by doc_id order by page_number, grp, part) as ordinal from parts)
select doc_id, cast(ordinal as int) as ordinal, printf('p%03d-c%04d', page_number, ordinal) as id, text, page_number as page_start, page_number as page_end, art.article as article, art.title as title from numbered"""

_TF = f"tok as (select doc_id, {_TOKENS.format('text')} as t from documents), tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from tok) group by 1, 2)"
_BM25 = f"""{_TF},
len_ as (select doc_id, len(t) as dl from tok), stat as (select count(*) as n, avg(dl) as avgdl from len_),
df as (select term, count(*) as df from tf group by 1),
qt as (select item_id as query_id, unnest({_TOKENS.format('text')}) as term from benchmark),
bm as (select qt.query_id, tf.doc_id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * (1.5::double + 1)) / (tf + 1.5::double * (1 - 0.75::double + 0.75::double * dl / avgdl))) as kw
       from qt join tf using (term) join df using (term) join len_ using (doc_id), stat group by 1, 2)"""
_COS = "coalesce(case when sqrt(list_sum(list_transform({a}, lambda x: x * x))) > 0 and sqrt(list_sum(list_transform({b}, lambda x: x * x))) > 0 then list_dot_product({a}, {b}) / (sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x)))) end, 0.0)"
_HYBRID = f"""{_BM25},
q as (select b.item_id as query_id, cast(e.embedding as double[]) as qv from benchmark b left join embeddings e on e.vec_id = b.item_id),
c as (select d.doc_id, cast(e.embedding as double[]) as v from documents d left join embeddings e on e.vec_id = d.doc_id),
grid as (select q.query_id, c.doc_id, {_COS.format(a='c.v', b='q.qv')} as sem, coalesce(bm.kw, 0.0) as kw from q cross join c left join bm on bm.query_id = q.query_id and bm.doc_id = c.doc_id),
ends as (select query_id, min(sem) as s0, max(sem) as s1, min(kw) as k0, max(kw) as k1 from grid group by 1),
scaled as (select query_id, doc_id, case when s1 = s0 then 0.0 else (sem - s0) / (s1 - s0) end as s, case when k1 = k0 then 0.0 else (kw - k0) / (k1 - k0) end as k from grid join ends using (query_id)),
scored as (select *, s * 0.7::double + k * (1.0::double - 0.7::double) as score from scaled),
hybrid as (select *, row_number() over (partition by query_id order by round(score, {DIGITS}) desc, doc_id) as rank from scored qualify rank <= {K})"""


_CONTEXT = f"""string_agg('[C' || rank || '] Trang ' || doc_id || ', ' || source || chr(10) || printf('score=%.3f semantic=%.3f keyword=%.3f', score, s, k) || chr(10) || {_STRIP.format('substr(text, 1, 200)')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)"""


def _prompt(question: str, context: str) -> str:
    tail = "Requirements:\n- answer briefly and in the question's language\n- cite page and article for each claim\n- if the context does not suffice, say so".replace("'", "''")
    return f"""'Question:' || chr(10) || {question} || chr(10) || chr(10) || 'Context passages:' || chr(10) || {context} || chr(10) || chr(10) || '{tail}'"""


def _short(x: str, n: int) -> str:
    return f"case when length({x}) <= {n} then {x} else regexp_replace(substr({x}, 1, {n - 3}), '\\s+$', '') || '...' end"


def oracle_sql() -> dict[str, str]:
    norm_answer = _NORM.format("answer")
    answers = f"""(select conv_id, turn, conv_id % 2 = 0 as answerable, text || case turn % 3 when 0 then ' [Trang 3]' when 1 then ' Không có thông tin.' else '' end as answer from conversations where role = 'assistant')"""
    refusal = " or ".join(f"contains({norm_answer}, '{p}')" for p in tx.REFUSALS)
    cases = "(select doc_id, toxic, quality = 1 as answerable, case when doc_id % 4 <> 0 then doc_id % 5 + 1 end as fr, case when doc_id % 6 = 0 then '' else 'text' end as answer, case when quality = 0 then doc_id % 3 = 0 end as refusal from labels)"
    summary = f"""round(count(*) filter (answerable and fr is not null) / nullif(cast(count(*) filter (answerable) as double), 0), 6) as recall_at_{K},
      round(sum(case when answerable and fr is not null then 1.0::double / fr else 0 end) / nullif(count(*) filter (answerable), 0), 6) as mrr,
      count(*) filter (answer <> '' and not answerable and refusal = false) as unanswerable_non_refusal_count,
      count(*) as case_count, count(*) filter (answerable) as answerable_case_count from {cases}"""
    hit = "(case when contains({n}, 'the') then 2 else 0 end + case when contains({n}, 'khong co') then 1 else 0 end + case when contains({n}, 'e') then 1 else 0 end)".format(n=norm_answer)
    flat = _STRIP.format("regexp_replace(text, '\\s+', ' ', 'g')")
    low = "count(*) filter (n_chars < 80)"
    return {
        "norm_text": f"select doc_id, {_NORM.format('text')} as norm from documents",
        "tokenize": f"select doc_id, len(t) as n_tokens, array_to_string(t, ' ') as tokens from (select doc_id, {_TOKENS.format('text')} as t from documents)",
        "clean_text": f"select doc_id, {_clean('r')} as cleaned from (select doc_id, replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || ' ' || chr(9) || ' ' || chr(12)) as r from documents)",
        "short_text": f"select conv_id, turn, case when length(f) <= 60 then f else regexp_replace(substr(f, 1, 57), '\\s+$', '') || '...' end as short, replace(case when length(f) <= 40 then f else regexp_replace(substr(f, 1, 37), '\\s+$', '') || '...' end, '|', '\\|') as cell from (select conv_id, turn, {flat} as f from conversations)",
        "paragraphs": f"select doc_id, cast(unnest(range(len(p))) as int) as para_idx, unnest(p) as para from (select doc_id, {_PARAS.format(_clean('text'))} as p from documents)",
        "pack_chunks": f"with recursive lens as (select doc_id, para_idx, length(para) as n from (select doc_id, unnest(range(len(p))) as para_idx, unnest(p) as para from (select doc_id, {_PARAS.format(_clean('text'))} as p from documents))), {_packing('lens', 'doc_id')} select doc_id, cast(para_idx as int) as para_idx, cast(grp as int) as grp from packed",
        "split_windows": f"select doc_id, cast(unnest(range(len(w))) as int) as part, unnest(w) as window_text from (select doc_id, {_windows('text')} as w from documents)",
        "article_carry": f"with {_PARA_ROWS} select doc_id, page_number, cast(para_idx as int) as para_idx, cur.article as article, cur.title as title from carried",
        "chunks": _CHUNKS,
        "index_roundtrip": _CHUNKS,
        "term_freq": f"with {_TF} select doc_id, term, tf from tf",
        "doc_freq": f"with {_TF} select term, count(*) as df from tf group by 1",
        "doc_len": f"with {_TF} select doc_id, cast(len(t) as bigint) as dl from tok",
        "corpus_stats": f"with {_TF} select count(*) as n, round(avg(len(t)), 6) as avgdl from tok",
        "bm25_topk": f"with {_BM25} select query_id, cast(rank as int) as rank, doc_id, round(kw, 6) as score from (select *, row_number() over (partition by query_id order by round(kw, {DIGITS}) desc, doc_id) as rank from bm) where rank <= {K}",
        "postings_topk": f"with {_BM25} select query_id, cast(rank as int) as rank, doc_id, round(kw, 6) as score from (select *, row_number() over (partition by query_id order by round(kw, {DIGITS}) desc, doc_id) as rank from bm) where rank <= {K}",
        "cosine_topk": f"with q as (select item_id as query_id, cast(embedding as double[]) as qv from benchmark join embeddings on vec_id = item_id), e as (select vec_id, cast(embedding as double[]) as v from embeddings), g as (select query_id, vec_id, {_COS.format(a='v', b='qv')} as s from q cross join e), r as (select *, row_number() over (partition by query_id order by round(s, {DIGITS}) desc, vec_id) as rank from g) select query_id, cast(rank as int) as rank, vec_id, round(s, 6) as score from r where rank <= {K}",
        "coded_topk": f"with q as (select item_id as query_id, cast(embedding as double[]) as qv from benchmark join embeddings on vec_id = item_id), e as (select vec_id, cast(embedding as double[]) as v from embeddings), g as (select query_id, vec_id, {_COS.format(a='v', b='qv')} as s from q cross join e), r as (select *, row_number() over (partition by query_id order by round(s, {DIGITS}) desc, vec_id) as rank from g) select query_id, cast(rank as int) as rank, vec_id, round(s, 6) as score from r where rank <= {K}",
        "minmax_scores": "select vec_id, label, round(case when hi = lo then 0.0 else (x - lo) / (hi - lo) end, 6) as scaled from (select vec_id, label, x, min(x) over (partition by label) as lo, max(x) over (partition by label) as hi from (select vec_id, label, cast(embedding[1] as double) as x from embeddings))",
        "hybrid_topk": f"with {_HYBRID} select query_id, cast(rank as int) as rank, doc_id, round(score, 6) as score, round(s, 6) as semantic_score, round(k, 6) as keyword_score from hybrid",
        "hash_embed_md5": f"select doc_id, bucket, sum(case when bucket % 2 = 1 then -1 else 1 end)::bigint as weight from (select doc_id, cast(('0x' || right(md5(term), 2)) as int) as bucket from (select doc_id, unnest({_TOKENS.format('text')}) as term from documents)) group by 1, 2",
        "citations": f"with {_HYBRID} select query_id, cast(rank as int) as rank, 'Trang ' || doc_id || ', ' || source as citation from hybrid join documents using (doc_id)",
        "context_blocks": f"with {_HYBRID} select query_id, string_agg('[C' || rank || '] Trang ' || doc_id || ', ' || source || chr(10) || printf('score=%.3f semantic=%.3f keyword=%.3f', score, s, k) || chr(10) || {_STRIP.format('substr(text, 1, 200)')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context from hybrid join documents using (doc_id) group by 1",
        "evidence_rank": f"with {_HYBRID}, r as (select query_id, rank, doc_id, source, text from hybrid join documents using (doc_id)) select query_id, cast(min(rank) filter (contains({_NORM.format('source')}, 'src' || query_id % 20) or contains({_NORM.format('text')}, 'src' || query_id % 20) or doc_id = query_id * 7) as int) as first_evidence_rank from r group by 1",
        "rule_checks": f"select conv_id, turn, cast({hit} as int) as keyword_hit_count, 4 as keyword_total, round({hit} / 4.0::double, 6) as keyword_hit_ratio, regexp_matches(answer, '(?i)\\[(?:trang|page)\\s+\\d+') as citation_present, case when not answerable then ({refusal}) end as unanswerable_refusal, false as retrieval_hit from {answers}",
        "eval_summary": f"select {summary}",
        "eval_breakdown": f"select toxic, {summary} group by rollup (toxic)",
        "page_quality": f"select source as doc_id, count(*) as pages, cast(sum(n_chars) as bigint) as chars, {low} as low_pages from documents group by 1",
        "case_lines": f"""with a as (select *, {flat.replace('text', 'answer')} as f, (case when not answerable then ({refusal}) end) as ref, regexp_matches(answer, '(?i)\\[(?:trang|page)\\s+\\d+') as cit from {answers})
            select conv_id, turn, '| C' || conv_id || ' | - | ' || case when answer <> '' then {hit} || ' of 4' else 'skipped' end || ' | ' || case when cit then 'yes' else 'no' end || ' | ' || coalesce(case when ref then 'yes' when not ref then 'no' end, '-') || ' | chat | ' || replace({_short('f', 120)}, '|', '\\|') || ' |' as line,
            '  evidence -, answer ' || case when answer <> '' then 'made' else 'skipped' end || ': ' || {_short('f', 100)} as console from a""",
        "offline_answers": f"with {_HYBRID} select item_id as query_id, coalesce({_STRIP.format("split_part(" + _STRIP.format('substr(d.text, 1, 200)') + ", chr(10), 1) || ' [Trang ' || doc_id || ', ' || source || ']'")}, '') as answer, cast(null as varchar) as answer_error from benchmark b left join hybrid h on h.query_id = b.item_id and h.rank = 1 left join documents d using (doc_id)",
        "prompts": f"with {_HYBRID}, ctx as (select query_id, {_CONTEXT} as context from hybrid join documents using (doc_id) group by 1) select item_id as query_id, {_prompt('text', "coalesce(context, '')")} as prompt from benchmark left join ctx on query_id = item_id",
        "answer_errors": f"select item_id as query_id, case when n % 2 = 1 then '' else cast(n as varchar) end as answer, case when n % 2 = 1 then 'answer_generation error: ValueError: odd' end as answer_error from (select item_id, length({_prompt('text', "''")}) as n from benchmark)",
        "image_numbers": "select page_id, case page_id % 3 when 0 then 'scan-a-' || page_id when 1 then 'dir-7/page-' || page_id || '.png' else page_id || '-x.png' end as name, cast(case when page_id % 3 = 2 then 0 else page_id end as int) as number from pages",
        "page_cache": "select source as doc_id, cast(doc_id as int) as page_number, cast(n_chars as int) as char_count, 'fixture' as source, case when n_chars < 80 then 'low_ocr_text' else '' end as warnings from documents",
        "quality_lines": "select source as doc_id, 'Pages: ' || count(*) || ' | characters: ' || sum(n_chars) as line from documents group by 1",
        "report_metrics": f"select toxic, case when recall_at_{K} is null then 'n/a' else printf('%.3f', recall_at_{K}) end as recall, case when mrr is null then 'n/a' else printf('%.3f', mrr) end as mrr, 'n/a' as none from (select toxic, {summary} group by toxic)",
        "wire_rows": f"with {_HYBRID} select query_id, cast(rank as int) as rank, round(score, 6) as score, round(s, 6) as semantic_score, round(k, 6) as keyword_score, cast(doc_id as int) as page_start, source as article, cast(null as varchar) as title from hybrid join documents using (doc_id)",
        "default_topk": f"with q as (select item_id as query_id, cast(embedding as double[]) as qv from benchmark join embeddings on vec_id = item_id), e as (select vec_id, cast(embedding as double[]) as v from embeddings), g as (select query_id, vec_id, {_COS.format(a='v', b='qv')} as s from q cross join e) select query_id, cast(rank as int) as rank, vec_id from (select *, row_number() over (partition by query_id order by round(s, {DIGITS}) desc, vec_id) as rank from g) where rank <= 3",
        "evidence_coverage": f"""with c as (select item_id as query_id, item_id % 3 as r, {_NORM.format('split(text, chr(32))[2]')} as word,
            {_NORM.format('split(text, chr(32))[1]')} as k1, {_NORM.format("concat_ws(' ', split(text, chr(32))[3], split(text, chr(32))[4])")} as k2 from benchmark),
            n as (select doc_id, {_NORM.format('source')} as s, {_NORM.format('text')} as t from documents),
            x as (select query_id, (r = 0 and (contains(s, 'src' || query_id % 20) or contains(t, 'src' || query_id % 20) or doc_id = query_id * 7))
            or (r = 1 and doc_id = query_id * 11 and (contains(s, 'src' || query_id % 5) or contains(t, 'src' || query_id % 5)))
            or (r = 2 and (contains(s, word) or contains(t, word))) as e, contains(t, k1) as h1, contains(t, k2) as h2, contains(t, 'zz no such words') as h3 from c, n)
            select query_id, count(*) filter (e) as evidence_chunks, cast(3 as int) as keyword_total,
            cast(coalesce(bool_or(h1), false) as bigint) + cast(coalesce(bool_or(h2), false) as bigint) + cast(coalesce(bool_or(h3), false) as bigint) as keywords_present from x group by 1""",
        "first_cases": "select doc_id, quality, toxic from labels order by doc_id limit 10",
        "usable_text_layers": "select source as doc_id from documents group by 1 having avg(n_chars) >= 2500 and count(*) filter (n_chars >= 100) >= greatest(3, count(*) // 2)",
    }


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_topk, norm_text, tokenize, clean_text, short_text, paragraphs, pack_chunks, split_windows, article_carry, chunks, index_roundtrip,
        term_freq, doc_freq, doc_len, corpus_stats, bm25_topk, postings_topk, cosine_topk, coded_topk, minmax_scores, hash_embed, hash_embed_md5, citations, context_blocks,
        offline_answers, evidence_rank, evidence_coverage, rule_checks, case_lines, eval_summary, eval_breakdown, page_quality, usable_text_layers,
        image_numbers, page_cache, quality_lines, report_metrics, wire_rows, prompts, answer_errors, default_topk, first_cases,
    )
}
