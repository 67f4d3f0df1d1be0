"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _scratch, ann, conversation, decontaminate, html_extract, language_id, line_dedup, lm_scoring, near_dedup, packing, resampling, sharding, sql, sstable, toxicity


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; ``QUARRY_TOKENIZERS`` overrides the folder."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int, held: int) -> Column:
    """Whether a document is held out: its crc32 modulo ``parts`` is ``held``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held, F.lit(False))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(_table(spark, sf_dir, "documents"), ~_fold(7, 2))
    return scored.select("doc_id", _fold(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~_fold(4, 2)))
    return language_id.predict(docs, model).select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score")


def op3_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    grammar = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~_fold(5, 0)))
    return toxicity.score(docs, grammar).select("doc_id", _fold(5, 0).alias("held_out"), "score", "predicted")


def op8_sstable_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _scratch.new_path(spark, "sst")
    return sstable.read(sstable.write(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2, where))


def op9_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return conversation.repair(turns, conversation.damage(turns))


def op13_consistent_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f) and k[2].isdigit()}


_OP5 = r"""
with words as (
  select doc_id, text, unnest(range(len(w))) as i, unnest(w) as raw
  from (select doc_id, text, regexp_extract_all(text, '[^\x09-\x0D\x20]+[\x09-\x0D\x20]*') as w from documents)),
split as (select *, regexp_replace(raw, '[\x09-\x0D\x20]+$', '') as word from words),
marked as (select *, contains(substr(raw, length(word) + 1), chr(10)) as broken,
  contains(substr(raw, length(word) + 1), chr(10)) or (substr(raw, length(word) + 1, 1) = ' ' and right(word, 1) in ('.', '!', '?')) as ends from split),
numbered as (select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from marked),
lines as (select doc_id, k, string_agg(raw, '' order by i) as raw, regexp_replace(string_agg(raw, '' order by i), '[\x09-\x0D\x20]+$', '') as line,
  arg_max(broken, i) as broken from numbered group by 1, 2),
ahead as (select *, lead(line) over w as l2, lead(line, 2) over w as l3, coalesce(lag(broken) over w, false) as fresh
  from lines window w as (partition by doc_id order by k)),
later as (select doc_id, k, row_number() over (partition by line, l2, l3 order by doc_id, k) > 1 as again from ahead where l3 is not null),
covered as (select a.*, exists (select 1 from later b where b.again and b.doc_id = a.doc_id and b.k between a.k - 2 and a.k) as gone from ahead a),
kept as (select *, lag(k) over w as k0, lag(raw) over w as raw0, lag(line) over w as line0, sum(fresh::int) over (partition by doc_id order by k) as breaks from covered window w as (partition by doc_id, gone order by k)),
joined as (select doc_id, k, gone, line, case when gone or k0 is null then '' when k0 = k - 1 then substr(raw0, length(line0) + 1)
  when breaks > lag(breaks) over (partition by doc_id, gone order by k) then chr(10) else ' ' end as sep from kept),
made as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(sep || line, '' order by k) filter (not gone), '') as t from joined group by 1)
select d.doc_id, case when coalesce(n_removed, 0) = 0 then d.text else t end as text, cast(coalesce(n_lines, 0) as int) as n_lines, cast(coalesce(n_removed, 0) as int) as n_removed
from documents d left join made using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": _OP5,
        "op11_importance_resampling": sql.resampling(),
        "op12_conversation_repair": sql.repair(),
        "op13_consistent_sharding": sql.sharding(),
    }
