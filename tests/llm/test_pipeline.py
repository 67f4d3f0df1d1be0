import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_line_dedup_takes_repeated_passages_of_short_lines(spark):
    passage = "\n".join(f"w{i}!!" for i in range(133))
    rows = [(0, f"first\n{passage}\nend"), (1, f"other\n{passage}\ntail"), (2, "one\n" * 300), (3, "a\nb"), (4, passage)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, docs, DATA).collect()}
    # a text's own first window stays: of 300 equal lines, the later windows cover all but the first
    assert got == {0: (rows[0][1], len(rows[0][1])), 1: ("other\ntail", 10), 2: ("one", 3), 3: ("a\nb", 3)}


def test_language_stage_keeps_an_unlabelled_corpus_and_fills_in_labels(spark):
    rows = [(0, "the cat", None), (1, None, None), (2, "12 !", None), (3, "", None), (4, "the cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, DATA).collect()) == [0, 4]


def test_language_stage_keeps_scripts_that_were_not_learned(spark):
    rows = [(i, f"the cat and the dog number {i} are here", "en") for i in range(40)] + [(100, "Кошка и собака сидят у окна и смотрят на улицу", None), (101, "Ещё одна строка по-русски", "ru?"), (102, "12 34 !?", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where("doc_id <> 101 or lang is not null")
    from quarry.llm import language_id

    model = language_id.fit(docs.where("doc_id < 100"))
    kept = {r["doc_id"]: r["lang"] for r in language_id.keep_known(docs, model).collect()}
    assert kept[100] is None and kept[101] == "ru?" and 102 not in kept and len(kept) == 42
    assert len(language_id.keep_known(docs, model, unlearned=False).collect()) == 40


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_run_leaves_one_document_of_each_class_and_few_tables(spark, monkeypatch):
    from quarry.llm import _scratch, near_dedup

    made, drop = [], _scratch.drop_table
    monkeypatch.setattr(_scratch, "drop_table", lambda df: (made.append(df._quarry_path) if hasattr(df, "_quarry_path") else None, drop(df)))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).select("doc_id").distinct().collect()}
    classes = near_dedup.classes(docs)
    label = [c for c in classes.columns if c != "doc_id"][0]
    survivors = {}
    for r in classes.collect():
        survivors.setdefault(r[label], []).append(r["doc_id"] in left)
    assert max(sum(x) for x in survivors.values()) == 1 and 0.5 * docs.count() < len(left) <= len(survivors)
    dropped = [p for p in made if any(f"/{name}-" in p for name, _ in corpus_pipeline.STAGES)]
    assert len(dropped) == len(corpus_pipeline.STAGES) - 2  # of the stages' tables, the last is read by the result


def test_line_and_near_stages_carry_clashing_columns(spark, tmp_path):
    passage = "\n".join(f"line {i} of the passage stands here" for i in range(12))
    rows = [(0, passage), (1, passage.replace("line 5", "row 5")), (2, "a text of its own\nwith two lines"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_removed int, __id int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    cut = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert cut.columns == docs.columns and {(r["n_lines"], r["n_removed"], r["__id"]) for r in cut.collect()} == {(1, 2, 3)}
    left = corpus_pipeline.dedup_near(spark, cut, str(tmp_path))
    # what line dedup leaves of the near copy is no document
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 2, 3]
