import hashlib
import math
import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions.text import tokenize
from quarry.operators import grid, lexical, search, vectors
from quarry.operators.embedding import LocalHashEmbedder, NativeHashEmbedder, RemoteEmbedder, cosine, make_embedder

CHUNKS = [
    (1, "Điều 20. Hợp đồng thử việc và hợp đồng chính thức của nhân viên.", "Điều 20"),
    (2, "Điều 105. Giờ làm việc trong ngày do hai bên định ra.", "Điều 105"),
    (3, "", None),
]


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(CHUNKS, "ordinal int, text string, article string")
    return LocalHashEmbedder().embed(df).cache()


def queries(spark, *questions):
    df = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "query_id string, question string")
    return LocalHashEmbedder().embed(df, "question", "query_embedding")


def test_hybrid_search_ranks_the_relevant_article_first(spark, chunks):
    got = search.search(chunks, queries(spark, "Có các loại hợp đồng nào?", ""), 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"]) for r in got] == [("q0", 1), ("q0", 2), ("q1", 1), ("q1", 2)]
    assert got[0]["article"] == "Điều 20" and got[0]["score"] == pytest.approx(1.0)
    assert [r["ordinal"] for r in got[2:]] == [1, 2] and got[2]["score"] == 0  # ties keep chunk order


def test_one_chunk_always_scores_zero(spark, chunks):
    r = search.search(chunks.where("ordinal = 1"), queries(spark, "hợp đồng"), 5).collect()
    assert [(x["score"], x["semantic_score"], x["keyword_score"]) for x in r] == [(0, 0, 0)]


def test_empty_corpus_gives_nothing(spark, chunks):
    assert search.search(chunks.where("false"), queries(spark, "x"), 5).count() == 0


def bm25(docs, query, k1=1.5, b=0.75):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        s = 0.0
        for t in query:
            if t in d:
                df = sum(t in x for x in docs)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avg))
        out.append(s)
    return out


def keyword_index(spark, df, tmp_path, block_bits=None):
    rows = lexical.numbered(grid.term_counts(df.withColumnRenamed("ordinal", "key")))
    if block_bits is not None:
        rows = rows.withColumn("at", (F.col("key") % (1 << block_bits)).cast("int")).withColumn("block", F.col("key") / (1 << block_bits)).withColumn("block", F.col("block").cast("long"))
    rows.write.mode("overwrite").parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    lexical.postings(rows).write.mode("overwrite").parquet(f"{tmp_path}/postings")
    return lexical.KeywordIndex.of(rows, spark.read.parquet(f"{tmp_path}/postings"))


def test_bm25_counts_repeated_query_terms_and_empty_documents(spark, tmp_path):
    docs = ["a b a c", "b c d", "", "a"]
    df = spark.createDataFrame(list(enumerate(docs)), "ordinal int, text string").coalesce(1)
    q = spark.createDataFrame([(0, "a b a zz")], "query_id int, question string")
    want = {i: pytest.approx(s) for i, s in enumerate(bm25([d.split() for d in docs], "a b a zz".split())) if s}
    assert {r["ordinal"]: r["score"] for r in search.best(df, q, 9, "ordinal", "keyword").collect()} == want
    assert {r["key"]: r["score"] for r in search.keyword_best(keyword_index(spark, df, tmp_path), q, 9).collect()} == want
    none = search.keyword_best(keyword_index(spark, df.limit(0), tmp_path), q, 9)
    assert none.count() == 0 and search.keyword_best(keyword_index(spark, df, tmp_path), q.limit(0), 9).count() == 0


def test_blocks_that_cannot_matter_are_not_opened(spark, tmp_path):
    rnd = random.Random(4)
    docs = [" ".join(rnd.choice("common words all over the place".split()) for _ in range(rnd.randrange(1, 30))) + (" rare" * (i % 97 == 0)) + (" odd" * (i // 64 == 7)) for i in range(2048)]
    df = spark.createDataFrame(list(enumerate(docs)), "ordinal int, text string").coalesce(3)
    index = keyword_index(spark, df, tmp_path, block_bits=5)
    q = spark.createDataFrame([(0, "rare common"), (1, "odd place"), (2, "the the nothing"), (3, "nothing")], "query_id int, question string")
    asked = grid.Questions.collect(q)
    opened = {r["q"]: r["n"] for r in index.search(asked, 3, 9)[1].groupBy("q").agg(F.count("*").alias("n")).collect()}
    by_id = {asked.ids[i].as_py(): n for i, n in opened.items()}
    assert by_id[0] <= 22 and by_id[1] <= 4 and by_id[2] < 64 and 3 not in by_id  # of 64 blocks, all of which hold a term
    got = {(r["query_id"], r["rank"]): (r["key"], pytest.approx(r["score"])) for r in search.keyword_best(index, q, 3, 9).collect()}
    for i, question in enumerate(["rare common", "odd place", "the the nothing", "nothing"]):
        scores = bm25([d.split() for d in docs], question.split())
        best = [x for x in sorted(range(len(docs)), key=lambda x: (-round(scores[x], 9), x)) if scores[x]][:3]
        assert [got[i, r + 1] for r in range(len(best))] == [(x, scores[x]) for x in best] and (i, len(best) + 1) not in got


def test_bands_hold_the_best_of_any_scaling():
    rnd = np.random.default_rng(6)
    for trial in range(40):
        n, k = int(rnd.integers(1, 1500)), int(rnd.integers(1, 7))
        s, w = np.round(rnd.normal(size=n), int(rnd.integers(0, 4))), np.round(rnd.exponential(size=n) * (rnd.random(n) < 0.7), int(rnd.integers(0, 4)))
        keys = rnd.permutation(n).tolist()
        parts = [grid.Band(k, (2.02e-9, 1e-8)) for _ in range(3)]
        for part, own in zip(parts, np.array_split(np.arange(n), 3), strict=True):
            for at in range(0, len(own), 200):
                x = own[at : at + 200]
                x = x[~grid._under(s[x, None], w[x, None], [part])[:, 0]]
                if len(x):
                    part.add(s[x], w[x], [keys[i] for i in x])
        held = {key for part in parts for key in part.keys}
        for weight in (0.7, 0.01, 0.99):
            score = np.round((s - s.min()) / 2 * weight + (w - w.min()) / max(w.max(), 1) * (1 - weight), 9)
            assert {keys[i] for i in sorted(range(n), key=lambda i: (-score[i], keys[i]))[:k]} <= held
        assert sum(len(p.s) for p in parts) <= n


def test_hybrid_ties_and_extremes_over_many_tasks(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("a b c d e".split()) for _ in range(i % 4)), None if i % 7 == 0 else [float(rnd.randrange(-2, 3)), float(rnd.randrange(-2, 3))]) for i in range(400)]
    df = spark.createDataFrame(rows, "key int, text string, embedding array<double>").repartition(7)
    q = spark.createDataFrame([(0, "a b b", [1.0, 0.5]), (1, "e", None), (2, None, [0.0, 1.0]), (3, "zz", [0.0, 0.0])], "query_id int, question string, query_embedding array<double>")
    got = search.best(df, q, 6, "key", round_to=9).collect()
    for query, question, vector in [tuple(r) for r in q.collect()]:
        cos = [0.0 if not v or not vector or not any(v) or not any(vector) else sum(x * y for x, y in zip(v, vector, strict=True)) / math.hypot(*v) / math.hypot(*vector) for _, _, v in rows]
        kw = bm25([t.split() for _, t, _ in rows], (question or "").split())
        scale = lambda xs: [0.0 if max(xs) == min(xs) else (x - min(xs)) / (max(xs) - min(xs)) for x in xs]
        total = [0.7 * a + 0.3 * b for a, b in zip(scale(cos), scale(kw), strict=True)]
        best = sorted(range(len(rows)), key=lambda i: (-round(total[i], 9), i))[:6]
        assert [(r["key"], r["score"]) for r in sorted((r for r in got if r["query_id"] == query), key=lambda r: r["rank"])] == [(i, pytest.approx(total[i])) for i in best]


def test_blocks_of_questions_are_bounded_by_their_terms(spark):
    q = spark.range(3000).selectExpr("id as query_id", "'one two' as question")
    assert len(list(grid.blocks_of(q))) == 3
    long = spark.range(64).selectExpr("id as query_id", "array_join(transform(sequence(1, 20000), x -> concat('w', x * (id + 1))), ' ') as question")
    blocks = list(grid.blocks_of(long))
    assert len(blocks) >= 3 and sum(b.count() for b in blocks) == 64


def test_hash_embedder_equals_hashlib_over_a_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(path).select("doc_id", tokenize(F.col("text")).alias("tokens"), "text")
    for r in LocalHashEmbedder().embed(docs).collect():
        want = np.zeros(256)
        for t in r["tokens"]:
            v = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
            want[v % 256] += -1 if v & 1 else 1
        assert np.allclose(r["embedding"], want / (np.sqrt((want * want).sum()) or 1), atol=1e-12)


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], [])]
    df = spark.createDataFrame(list(enumerate(map(list, rows))), "i int, p array<array<double>>")
    got = [r[0] for r in df.orderBy("i").select(cosine(F.col("p")[0], F.col("p")[1])).collect()]
    assert got == [pytest.approx(math.sqrt(0.5)), 0, 0, 0, 0]


def test_local_embedder_is_signed_hashing(spark):
    row = LocalHashEmbedder().embed(spark.createDataFrame([("x y x",), ("",), (None,)], "text string")).collect()
    raw = [0.0] * 256
    for t in "xyx":
        v = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        raw[v % 256] += -1 if v & 1 else 1
    n = math.sqrt(sum(v * v for v in raw))
    assert row[0]["embedding"] == [pytest.approx(v / n) for v in raw]
    assert row[1]["embedding"] == row[2]["embedding"] == [0.0] * 256


def test_native_embedder_has_unit_vectors(spark):
    got = NativeHashEmbedder().embed(spark.createDataFrame([("a b c",), ("",)], "text string")).collect()
    assert sum(v * v for v in got[0]["embedding"]) == pytest.approx(1) and not any(got[1]["embedding"])


def test_remote_embedder_restores_order_in_batches(spark):
    def client():
        def ask(texts):
            assert len(texts) <= 64
            return [(i, [float(t)]) for i, t in reversed(list(enumerate(texts)))]

        return ask

    df = spark.range(150).select(F.col("id").cast("string").alias("text")).coalesce(1)
    got = RemoteEmbedder("m", client).embed(df).collect()
    assert all(r["embedding"] == [float(r["text"])] for r in got)


def test_providers(monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    assert make_embedder("local").model_name == "local-hash-256"
    with pytest.raises(ValueError):
        make_embedder("none")
    with pytest.raises(RuntimeError):
        make_embedder("openai", "m")


def test_top_k_and_limits(spark):
    assert search.effective_top_k(0, 5) == search.effective_top_k(None, 5) == 5
    with pytest.raises(ValueError):
        search.effective_top_k(-1, 5)
    df = spark.range(5)
    assert search.first_rows(df, 0, "id").count() == 5 and search.first_rows(df, 2, "id").count() == 2
    with pytest.raises(ValueError):
        search.first_rows(df, -1, "id")


def counting(folder, short=(), failing=(), die=None):
    """A client that notes each text it is asked, in a file of its own."""

    def client():
        def ask(texts):
            import uuid
            from pathlib import Path

            if die in texts and not Path(folder, "died").exists():
                Path(folder, "died").touch()
                os._exit(1)  # the worker is lost in mid-task
            for t in texts:
                Path(folder, f"{t or 'none'}-{uuid.uuid4().hex}").touch()
            if set(texts) & set(failing):
                raise OSError("busy")
            return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))][: len(texts) - bool(set(texts) & set(short))]

        return ask

    return client


def test_replies_are_asked_for_once(spark, tmp_path):
    from quarry.sources.replies import Replies

    calls = tmp_path / "calls"
    calls.mkdir()
    seen = lambda: sorted(p.name.partition("-")[0] for p in calls.iterdir() if "-" in p.name)
    store = lambda **kw: Replies(spark, str(tmp_path / "replies"), pause=0.0, attempts=2, tasks=2, **kw)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "a", "ccc", None])], "i int, text string")
    made = RemoteEmbedder("m", counting(str(calls)), store()).embed(df)
    assert {r["i"]: r["embedding"] for r in made.collect()} == {0: [1, 1], 1: [2, 1], 2: [1, 1], 3: [3, 1], 4: [0, 1]}
    assert seen() == ["a", "bb", "ccc", "none"]
    more = df.union(spark.createDataFrame([(9, "dddd")], df.schema))
    assert RemoteEmbedder("m", counting(str(calls)), store()).embed(more).count() == 6 and seen() == ["a", "bb", "ccc", "dddd", "none"]
    with pytest.raises(RuntimeError, match="2 texts could not be embedded: ValueError: 1 vectors for 2 texts"):
        RemoteEmbedder("n", counting(str(calls), short=["x"]), store(batch=2)).embed(spark.createDataFrame([("x",), ("y",)], "text string").coalesce(1))
    with pytest.raises(RuntimeError, match="OSError: busy"):
        RemoteEmbedder("o", counting(str(calls), failing=["bb"]), store()).embed(df)
    assert seen().count("bb") == 3 and seen().count("a") == 2  # tried twice, the others stored
    RemoteEmbedder("o", counting(str(calls)), store()).embed(df)
    assert seen().count("a") == 2 and seen().count("bb") == 4


def test_a_task_that_is_run_again_asks_nothing_twice(tmp_path):
    """On a cluster of its own, for a task of a local one is not tried again."""
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(Path(__file__).parent)!r})
import pyspark.cloudpickle as cp
import test_search
cp.register_pickle_by_value(test_search)
from pyspark.sql import SparkSession
from quarry.operators.embedding import RemoteEmbedder
from quarry.sources.replies import Replies
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
df = spark.createDataFrame([(t,) for t in "abcdefgh"], "text string")
store = Replies(spark, "{tmp_path}/replies", pause=0.0, concurrency=1, tasks=1)
print(RemoteEmbedder("m", test_search.counting("{tmp_path}/calls", die="e"), store).embed(df).count())
""")
    (tmp_path / "calls").mkdir()
    out = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": str(Path(__file__).parents[1])})
    assert out.stdout.split()[-1:] == ["8"], out.stderr[-2000:]
    assert (tmp_path / "calls" / "died").exists()
    assert sorted(p.name[0] for p in (tmp_path / "calls").iterdir() if "-" in p.name) == list("abcdefgh")


def test_coded_vectors_leave_few_to_be_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 48))
    v[10] = v[20]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9001, []), (9002, [0.0] * 48), (9003, [1.0, 2.0]), (9004, [1.0, None])]
    df = spark.createDataFrame(rows, "key long, embedding array<double>").repartition(3)
    vectors.coded(df, "key").write.parquet(str(tmp_path / "codes"))
    codes = spark.read.parquet(str(tmp_path / "codes"))
    assert codes.where("d = 0").count() == 4
    asked = [(0, v[10].tolist()), (1, v[5].tolist()), (2, rng.normal(size=48).tolist()), (3, [0.0] * 48), (4, [2.0, 4.0])]
    q = spark.createDataFrame(asked, "query_id long, query_embedding array<double>")
    block = grid.Questions.collect(q)
    read = {block.ids[r["q"]].as_py(): r["n"] for r in vectors.candidates(codes, block, 5, 9).groupBy("q").agg(F.count("*").alias("n")).collect()}
    assert all(5 <= read[i] <= 60 for i in (0, 1, 2))  # of 3,005 rows
    got = {}
    for r in vectors.nearest(df, codes, q, 5, "key", round_to=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["key"], r["score"]))
    for i, w in asked:
        cos = {key: 0.0 if not x or None in x or len(x) != len(w) or not any(x) or not any(w) else float(np.dot(x, w) / math.sqrt(np.dot(x, x) * np.dot(w, w))) for key, x in rows}
        best = sorted(cos, key=lambda key: (-round(cos[key], 9), key))[:5]
        assert [(k, s) for _, k, s in sorted(got[i])] == [(k, pytest.approx(cos[k])) for k in best]


def _peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _listed(values, each):
    return pa.ListArray.from_arrays(pa.array(range(0, len(values) + 1, each), pa.int32()), pa.array(values))


def test_a_batch_of_rows_is_worked_on_piece_by_piece():
    """What a task needs besides the batch does not grow with it: 2,000,000 tokens here, 16 MB an array of numbers."""
    rows, each = 4096, 500
    words = np.array([f"w{i}" for i in range(each)])
    tokens = _listed(np.tile(words, rows), each)
    counted = pa.Table.from_batches(grid._counts([pa.record_batch([pa.array(range(rows)), tokens], names=["key", "x"])], ["key", "dl", "terms", "tf"])).to_pydict()
    assert counted["key"] == list(range(rows)) and set(counted["dl"]) == {each} and sorted(counted["terms"][-1]) == sorted(words) and set(counted["tf"][7]) == {1}
    assert _peak_mb(lambda: [None for _ in grid._counts([pa.record_batch([pa.array(range(rows)), tokens], names=["key", "x"])], ["key", "dl", "terms", "tf"])]) < 40
    ones, dl = pa.ListArray.from_arrays(tokens.offsets, pa.array(np.ones(rows * each, np.int32))), pa.array(np.full(rows, each))
    place = np.arange(rows)
    index = pa.record_batch([pa.array(place >> 8), pa.array((place & 255).astype(np.int32)), dl, tokens, ones], names=["block", "at", "dl", "terms", "tf"])
    made = list(lexical._blocks([index]))
    assert sum(b.num_rows for b in made) == rows // 256 * each and {n for b in made for n in b.column(2).to_pylist()} == {256}
    assert _peak_mb(lambda: [None for _ in lexical._blocks([index])]) < 80
    asked = grid.Questions(pa.array([1, 2]), pa.array(["w0", "w1", "none"]), np.array([[1.0, 0], [0, 2], [1, 1]]))
    asked.weigh(rows, float(each), np.array([1.0, 2, 0]))
    batch = pa.record_batch([pa.array(place), dl, tokens, ones, pa.nulls(rows, pa.list_(pa.float64()))], names=["key", "dl", "terms", "tf", "embedding"])
    assert np.allclose(grid._keyword(batch, asked, 1.5, 0.75), [[asked.weights[0, 0], asked.weights[1, 1]]])
    assert _peak_mb(lambda: grid._keyword(batch, asked, 1.5, 0.75)) < 8


def test_pieces_hold_every_row_once():
    sizes = np.array([3, 0, 9, 1, 1, 0, 4])
    assert [(p.start, p.stop) for p in grid.pieces(sizes, 4)] == [(0, 2), (2, 3), (3, 6), (6, 7)]
    assert [(p.start, p.stop) for p in grid.pieces(sizes, 100, rows=3)] == [(0, 3), (3, 6), (6, 7)]
    assert list(grid.pieces(np.zeros(0, np.int64))) == []


def test_lengths_are_those_of_the_counted_texts_and_need_no_python(spark):
    df = spark.createDataFrame([(1, "Giờ làm việc, giờ LÀM"), (2, ""), (3, None), (4, "..."), (5, "a " * 70000)], "id int, text string")
    lengths = lexical.doc_len(df, "id")
    assert dict(lengths.collect()) == {1: 5, 2: 0, 3: 0, 4: 0, 5: 70000} == dict(grid.term_counts(df).select("id", "dl").collect())
    assert lengths.schema["dl"].dataType.simpleString() == "bigint"
    assert "MapInArrow" in grid.term_counts(df)._jdf.queryExecution().executedPlan().toString()
    for made in (lengths, lexical.corpus_stats(lengths)):
        assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()
    assert lexical.corpus_stats(lengths).first().asDict() == {"n": 5, "avgdl": 14001.0}
    assert lexical.corpus_stats(lengths.limit(0)).first().asDict() == {"n": 0, "avgdl": 0.0}


def test_a_batch_that_python_gets_is_bounded_in_bytes(spark):
    """``grid.term_counts`` relies on it: rows of any length make a batch of 64 MB and a row at most."""
    long = spark.range(0, 2000, 1, 1).select(F.array_repeat(F.lit("abcd"), 12000).alias("tokens"))  # 192 MB

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["n", "rows"])

    got = long.mapInArrow(sizes, "n long, rows long").collect()
    assert sum(r["rows"] for r in got) == 2000 and max(r["n"] for r in got) < 80e6
