import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import _wfst, ann, html_extract, language_id, lm_scoring, queries, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def lm_tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["\0end"]


@pytest.mark.parametrize("shard_bytes", [1 << 30, 20_000])
def test_lm_scoring(spark, docs, monkeypatch, shard_bytes):
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lm_scoring, "HOT_SHIFT", 6)  # so that both ways of counting are taken
    texts = ["the cat sat on the mat", "The cat ate", None, "", "new wörter HERE here", "the dog sat on a mat x\x0by", "the cat sat on the mat"] * 3
    df = docs(*texts).withColumn("k", F.lit(1))
    df = df.union(df.where("doc_id = 4"))
    got = {r["doc_id"]: r for r in lm_scoring.score(df, F.col("doc_id") % 5 != 4).collect()}
    counts = Counter(t for i, x in enumerate(texts) if i % 5 != 4 for t in lm_tokens(x))
    n, v = sum(counts.values()), len(counts)
    for i, x in enumerate(texts):
        t, r = lm_tokens(x), got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] <= 0
    assert got[0]["score"] == got[7]["score"] > got[0]["base_score"]


def test_lm_filter_never_underestimates_and_rarely_errs():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 20000).astype(np.uint64) * np.uint64(2)
    counts = np.minimum(rng.zipf(1.5, 20000), 10**6)
    batch = pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])
    blocks = [r for b in lm_scoring._build(iter([batch])) for r in b.to_pylist()]
    shard = lm_scoring.Shard({r["block"]: r["words"] for r in blocks}, ((r["block"], r["bits"]) for r in blocks))
    level = shard.levels(keys)
    assert (level >= lm_scoring.level_of(counts)).all()
    assert (level != lm_scoring.level_of(counts)).mean() < 0.05
    assert (shard.levels(rng.integers(0, 2**63, 20000).astype(np.uint64) * np.uint64(2)) > 0).mean() < 0.05


def test_lm_shards_probed_by_travelling_keys_give_the_broadcast_scores(spark, docs, monkeypatch):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(3000)] + ["the"] * 1500
    texts = [" ".join(rng.choice(words, n)) for n in [0, 1, 2, 5000, *rng.integers(5, 200, 150)]]
    df = docs(*texts, None).withColumn("k", F.lit(1))
    df = df.union(df.where("doc_id % 9 = 0"))
    rows = lambda: sorted(tuple(r) for r in lm_scoring.score(df, F.col("doc_id") % 7 != 2).collect())
    want = rows()
    for name, value in (("SHARD_BYTES", 4000), ("BLOCK_TEXT", 16), ("CHUNK", 8), ("ASKED", 3)):
        monkeypatch.setattr(lm_scoring, name, value)
    assert lm_scoring.block_bits(100_000) > lm_scoring.BLOCK_BITS
    got = rows()
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want])
    assert np.mean(np.isclose([r[5] for r in got], [r[5] for r in want], rtol=0.03)) > 0.95  # other blocks, other rare errors of the filter


def test_lm_blocks_come_one_at_a_time():
    keys = np.sort(np.random.default_rng(5).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    batches = [pa.record_batch([pa.array(k.view(np.int64)), pa.array(np.full(len(k), 2))], names=["key", "n"]) for k in np.array_split(np.repeat(keys, 2), 37)]
    got = [r for b in lm_scoring._build(iter(batches), 5) for r in b.to_pylist()]
    assert [r["block"] for r in got] == list(range(32))
    assert sum(r["v"] for r in got) == 5000 and sum(r["n"] for r in got) == 20000


def test_lm_without_training_text(spark, docs):
    r = lm_scoring.score(docs("a b"), F.lit(False)).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


@needs_data
def test_language_id_held_out_accuracy(spark):
    rows = queries.op2_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97 and rows.where("score < 0 or score > 1").count() == 0


def test_language_id_odd_rows(spark, docs):
    df = docs("the cat and the dog", "der Hund und die Katze", None, "", "123 -- !!", "the the and of", "und die der das", "é").withColumn("lang", F.when(F.col("doc_id") == 0, "en").when(F.col("doc_id") == 1, "de"))
    model = language_id.fit(df)
    got = {r["doc_id"]: r for r in language_id.predict(df.withColumn("score", F.lit("x")), model).collect()}
    assert [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and got[2]["score"] == 0
    assert got[5]["lang_pred"] == "en" and got[6]["lang_pred"] == "de"
    kept = language_id.keep_known(df.withColumnRenamed("source", "lang_pred"), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 5, 6, 7] and "lang_pred" in kept.columns
    nothing = language_id.fit(df.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(df, nothing).collect()} == {"und"}
    assert sorted(r["doc_id"] for r in language_id.keep_known(df, nothing).collect()) == [0, 1, 5, 6, 7]
    assert language_id.predict(df.where("false"), model).count() == 0 == language_id.keep_known(df.where("false"), model).count()


def test_language_id_rejects_scripts_that_were_not_learned_and_names_the_rest(spark, docs):
    df = docs("the cat and the dog", "der Hund und die Katze", "\u4f60\u597d\u4e16\u754c\u518d\u89c1 ok", "the the and of", "word and " * 100_000).withColumn("lang", F.when(F.col("doc_id") == 0, "en").when(F.col("doc_id") == 1, "de"))
    kept = language_id.keep_known(df.withColumn("c0", F.lit(1)).withColumn("recognised", F.lit(2)), language_id.fit(df), unlearned=False).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["lang"], r["c0"], r["recognised"]) for r in kept] == [(0, "en", 1, 2), (1, "de", 1, 2), (3, "en", 1, 2), (4, "en", 1, 2)]


def test_language_id_fit_does_not_change_with_repeated_rows(spark, docs):
    df = docs("the cat and the dog", "der Hund und die Katze", "a cat", "ein Hund").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    more = df.union(df).union(df.where("doc_id = 2")).union(df)
    scores = [sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.predict(df, language_id.fit(x.repartition(3))).collect()) for x in (df, more)]
    assert scores[0] == scores[1]


def test_language_id_is_fitted_on_whole_texts(spark, docs):
    far = "1 " * 5000
    df = docs(*[far + "the cat and the dog", far + "der Hund und die Katze"] * 4).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs("the the and of", "und die der das"), language_id.fit(df)).collect()}
    assert got == {0: "en", 1: "de"}


def test_language_id_learns_every_label(spark):
    own = lambda k: "".join(chr(0x4E00 + 7 * k + i) for i in range(7))
    rows = [(3 * k + i, " ".join([own(k)] * (i + 1)), f"l{k:03}") for k in range(205) for i in range(3)]
    rows += [(1000 + i, own(0), "l000") for i in range(40)]  # rarer labels than this one are learned as well
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, language_id.fit(df)).collect()}
    assert {i: v for i, _, v in rows if got[i] != v} == {}


def test_presence_kernel_is_the_blended_spectrum():
    texts = ["Abc abd", "abd xyz", "é 12 É"]
    x = language_id.presence(pa.array(texts))
    sets = [[{s[i : i + n] for i in range(len(s) - n + 1)} for n in language_id.ORDERS] for s in ("abc abd", "abd xyz", "é é")]
    want = np.mean([[[len(a[k] & b[k]) / math.sqrt(len(a[k]) * len(b[k])) for b in sets] for a in sets] for k in range(3)], axis=0)
    assert np.allclose(language_id.kernel(x, x), want, atol=0.02)  # grams may share a bucket


@needs_data
def test_toxicity_held_out(spark):
    rows = queries.op7_toxicity_grammar(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out")
    r = rows.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")), F.avg(F.when(F.col("toxic") == 1, F.col("score"))), F.avg(F.when(F.col("toxic") == 0, F.col("score")))).first()
    assert r[0] > 0.9 and r[1] > r[2] + 0.4


def run(*events):
    out = np.zeros(len(toxicity.FEATURES))
    toxicity.run_clause(*map(list, zip(*events)), out)
    return dict(zip(toxicity.FEATURES, out))


def test_grammar_patterns():
    i, t, g, n, r = toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT
    assert run((0, g, 1, False), (2, i, 3.0, False))["directed"] == 3
    assert run((0, i, 3.0, False), (3, g, 1, False))["directed"] == 3
    assert run((0, g, 1, False), (20, i, 3.0, False))["directed"] == 0
    assert run((0, n, 1, False), (1, i, 3.0, False))["negated"] == 3
    assert run((0, r, 1, False), (9, i, 3.0, False))["reported"] == 3
    assert run((0, i, 3.0, True))["reported"] == 3
    assert run((0, i, 3.0, False), (1, i, 2.0, False))["stacked"] == 2
    assert run((0, t, 1, False), (1, g, 1, False))["threat"] == 1


def paths(machine, symbols, state=0):
    """All paths of a machine over a symbol list: outputs and weight."""
    if not symbols:
        return [((), machine.semiring.one)] if state in machine.finals else []
    return [((out, *rest), machine.semiring.times(w, more)) for out, w, to in machine.arcs[state].get(symbols[0], ()) for rest, more in paths(machine, symbols[1:], to)]


@pytest.mark.parametrize("semiring", [_wfst.TROPICAL, _wfst.COUNTING])
def test_composition_equals_enumeration_of_paths(semiring):
    rng = random.Random(6)
    machine = lambda inputs, outputs: _wfst.Transducer.of(
        [(rng.randrange(3), rng.choice(inputs), rng.choice([*outputs, _wfst.EPS]), rng.randrange(3), rng.randrange(1, 5)) for _ in range(14)], [0, 2], semiring
    )
    met = 0
    for _ in range(60):
        first, second = machine("abc", "xy"), machine("xy", "uv")
        both = first.then(second)
        symbols = tuple(rng.choice("abc") for _ in range(rng.randrange(5)))
        want = Counter()
        for middle, w in paths(first, symbols):
            kept = tuple(x for x in middle if x)
            for out, w2 in paths(second, kept):
                spread = iter(out)
                want[tuple(next(spread) if x else _wfst.EPS for x in middle), semiring.times(w, w2)] += 1
        assert Counter(paths(both, symbols)) == want
        weights = [w for (_, w), n in want.items() for _ in range(n)]
        assert both.total(symbols) == (min(weights, default=semiring.zero) if semiring is _wfst.TROPICAL else sum(weights))
        if weights and semiring is _wfst.TROPICAL:
            met += 1
            assert (tuple(both.best(symbols)), min(weights)) in want
    assert met or semiring is _wfst.COUNTING


def test_the_grammar_takes_the_cheapest_reading_of_every_clause():
    rng = random.Random(4)
    alphabet = [*toxicity.WORDS.values(), *toxicity.GAPS, toxicity.OPEN, toxicity.CLOSE]
    machine = toxicity.machine()
    for _ in range(300):
        symbols = tuple(rng.choice(alphabet) for _ in range(rng.randrange(9)))
        rows = [(symbols, tuple(range(len(symbols))), 0.0)]  # outputs of the whole cascade, enumerated part by part
        for part in toxicity.parts():
            nxt = []
            for line, places, w in rows:
                for out, w2 in paths(part, line):
                    kept = [(x, p) for x, p in zip(out, places) if x]
                    nxt.append((tuple(x for x, _ in kept), tuple(p for _, p in kept), w + w2))
            rows = nxt
        got = machine.best(symbols)
        best = min(w for _, _, w in rows)
        mine = (tuple(x for x in got if x), tuple(i for i, x in enumerate(got) if x))
        assert machine.total(symbols) == best and mine in {(line, places) for line, places, w in rows if w == best}


def test_toxicity_with_repeated_and_conflicting_rows(spark, docs):
    df = docs(*["you are an idiot today", "a fine day for all"] * 12, "word " * 200_000)
    labels = df.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic")).where("doc_id < 24")
    want = sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.score(df, toxicity.fit(df, labels)).collect())
    again = labels.union(labels).union(labels.where("doc_id = 4").withColumn("toxic", F.lit(0))).union(labels.where("doc_id = 0").withColumn("toxic", F.lit(None).cast("int")))
    more = toxicity.fit(df.union(df).union(df.where("doc_id < 3")), again)
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.score(df, more).collect()) == want


def test_toxicity_odd_rows(spark, docs):
    df = docs(*["you are an idiot today", "a fine day for all"] * 12, None, "", "IDIOT!")
    labels = df.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic")).where("doc_id < 20")
    got = {r["doc_id"]: r for r in toxicity.score(df.withColumn("score", F.lit(0)), toxicity.fit(df, labels)).collect()}
    assert got[22]["predicted"] == 1 and got[23]["predicted"] == 0 and got[26]["score"] > got[25]["score"] == got[24]["score"]
    none = toxicity.fit(df, labels.where("false"))
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.0}


def test_toxicity_learns_from_whole_texts(spark, docs):
    filler = "a fine day for all of them. " * 400
    df = docs(*[filler + "you are an idiot today.", filler + "we walk home today."] * 12)
    labels = df.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert got == {i: int(i % 2 == 0) for i in range(24)}


@pytest.mark.parametrize("rows", [4000, 20])
def test_toxicity_keeps_the_ratio_of_the_labels(spark, docs, monkeypatch, rows):
    monkeypatch.setattr(toxicity, "FIT_ROWS", rows)
    df = docs(*["a fine day for all"] * 220)
    labels = df.select("doc_id", (F.col("doc_id") % 11 == 0).cast("int").alias("toxic"))
    score = toxicity.score(df, toxicity.fit(df, labels)).first()["score"]
    assert score == pytest.approx(20 / 220, abs=0.01)


def brute_nearest(ids, vectors, q, k=5):
    v = np.array(vectors, float)
    s = np.round((v * v[q]).sum(1) / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q])), 12)
    order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))
    return [ids[i] for i in order[:k]]


@pytest.mark.parametrize("block", [1 << 15, 7])
def test_ann_recall_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((1500, 24))
    ids = list(range(1500))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 50)) and all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
    assert sum(len({x[1] for x in v} & set(brute_nearest(ids, vectors, q))) for q, v in got.items()) / (5 * len(got)) >= 0.9
    a, (_, b, s) = vectors[0], min(got[0])
    assert s == pytest.approx(float(a @ vectors[b] / np.sqrt(a @ a) / np.sqrt(vectors[b] @ vectors[b])), abs=1e-14)


def test_ann_copies_and_repeated_rows(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((6, 17))
    vectors = [base[i % 6] if i % 3 else rng.standard_normal(17) for i in range(600)]
    vectors[50 : 50 + 33] = [vectors[100]] * 33  # exact copies, more than k
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [rows[100], rows[100], rows[150], (200, (vectors[200] + 1).tolist())]  # queries that occur again, once with another vector
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 50))
    for q, found in got.items():
        assert [x[0] for x in sorted(found)] == [1, 2, 3, 4, 5]
    ids, matrix = [r[0] for r in rows], np.array([r[1] for r in rows])
    for q in (100, 50):  # 32 or more equal neighbours: the smallest vec_id win
        assert [x[1] for x in sorted(got[q])] == brute_nearest(ids, matrix, ids.index(q))
        assert len({x[2] for x in got[q]}) == 1
    hits = sum(len({x[1] for x in found} & set(brute_nearest(ids, matrix, ids.index(q)))) for q, found in got.items() if q != 200)
    assert hits >= 0.9 * sum(len(set(brute_nearest(ids, matrix, ids.index(q)))) for q in got if q != 200)


def test_ann_scores_equal_vectors_alike():
    rng = np.random.default_rng(3)
    for dim in (3, 8, 64, 65, 200):
        vectors = rng.standard_normal((400, dim))
        vectors[7:300:9] = vectors[7]
        forest = ann.Forest(np.arange(400), vectors)
        ((_, found, score),) = forest.nearest(np.array([7]), vectors[7:8], 20, 0.1)
        assert found.tolist() == list(range(16, 300, 9))[:20] and len(set(score.tolist())) == 1


def test_ann_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (50, [0.0, 1.0]), (100, [0.0, 0.0]), (8, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert ann.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- c --><header>Site</header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use</div><div class="ad">Buy</div><article><header><h1>T &amp; x&nbsp;y</h1></header><p><b>Lead.<br><p>a <i>b</i>c
<a href="x>y">l</a> 5 < 6 &lt;t&gt;<table><tr><td>1<td>2</table><form>f</form><aside>s</aside><ul><li>one<li>two</ul><div id="comments"><p>reader</p></div></article><footer>f</footer>"""


def test_html_main_text():
    assert html_extract.extract(PAGE) == "T & x y\nLead.\na bc l 5 < 6 <t>\n1\n2\none\ntwo"
    assert html_extract.extract("") == "" == html_extract.extract("<nav>x</nav>") == html_extract.extract("<!-- open")
    assert html_extract.extract("plain &am text <b") == "plain &am text"
    assert html_extract.extract("<div>" * 3000 + "deep") == "deep"


def test_html_drops_nothing_but_boilerplate():
    assert html_extract.extract('<p>Intro outside.</p><article><p>Area is <math><mi>pi</mi></math> units.<svg><text>1</text></svg><p class="share price">Up</article>') == "Intro outside.\nArea is pi units.1\nUp"
    assert html_extract.extract('<div class="cookie-notice">a</div><div id="reader_comments">b</div><div role="search">c</div><div class="content main">d</div><h1 class="header">e</h1>') == "d"
    assert html_extract.extract("<div>" * 250_000 + "deep" + "</b>" * 1000) == "deep"
    assert html_extract.extract("<p>" + "word " * 300_000).count("word") == 300_000


def test_forest_touches_few_rows_of_clustered_vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(400, 32))
    vectors = np.repeat(centres, 40, axis=0) + 0.08 * rng.normal(size=(16_000, 32))
    share = ann.fit_share(np.arange(16_000), vectors, 5)
    assert share <= 0.005
    forest = ann.Forest(np.arange(16_000), vectors)
    asked = np.arange(0, 16_000, 200)
    unit = vectors / ann.norms(vectors)[:, None]
    hit = 0
    for q, found in zip(asked, forest.nearest(asked, vectors[asked], 5, share), strict=True):
        cos = unit @ unit[q]
        cos[q] = -2
        hit += len(set(found[1].tolist()) & set(np.argsort(-cos)[:5].tolist()))
    assert hit >= 0.9 * 5 * len(asked) and forest.touched < 0.025 * 96 * 16_000 * len(asked)
    dense, ann.DENSE = ann.DENSE, 0  # both ways of counting find the same
    few = [np.sort(x).tolist() for x in forest.candidates(unit[asked[:9]], 40)]
    ann.DENSE = 1 << 40
    assert few == [np.sort(x).tolist() for x in forest.candidates(unit[asked[:9]], 40)]
    ann.DENSE = dense


def test_one_label_on_most_rows_is_picked_from_without_sorting_it(spark):
    rows = [(i, f"the word number {i} is here", "en" if i % 10 else "fr") for i in range(6000)] + [(7, "again", "en")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = language_id.fit(df)
    order = spark.range(6000).select("id", F.xxhash64("id", F.lit(11)).alias("h")).collect()
    least = lambda want: {r["id"] for r in sorted((r for r in order if (r["id"] % 10 == 0) == want), key=lambda r: (r["h"], r["id"]))[:300]}
    named = df.where(F.col("doc_id").isin(list(least(True) | least(False))))
    want = language_id.fit(named)
    assert got.langs == want.langs == ["en", "fr"] and np.array_equal(got.landmarks, want.landmarks) and np.allclose(got.weights, want.weights)


def brute_templates(rows):
    """The counting of subtrees, page by page."""
    pages, seen = {}, {}
    for url, html in rows:
        host = re.match(r"https?://([^/]+)", url)[1]
        page = html_extract.extract(html)
        pages.setdefault(host, set()).add(page)
        for key in html_extract.subtrees(html, html_extract._seed(host)):
            seen.setdefault((host, *key), set()).add(page)
    out = {html_extract.host_mark(html_extract._seed(h)) for h, p in pages.items() if len(p) >= 3}
    for (host, kind, subtree), p in seen.items():
        n, of = len(p), len(pages[host])
        in_text = kind in (html_extract.EXACT, html_extract.MENU) and (n >= 8 or n >= 3 and 2 * n >= of)
        if in_text or kind == html_extract.SHAPE and n >= min(3, max(2, of)) or kind == html_extract.MARKED and of >= 3 and n >= 2:
            out.add(subtree)
    return out


def renamed(html):
    """The same page, whose boilerplate tells nothing by its names."""
    return re.sub(r"<(/?)(nav|footer)\b", r"<\1div", html).replace('class="ad"', 'class="zq7"')


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_html_templates_of_the_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url", "html")
    listed = [tuple(r) for r in rows.collect()]
    host = F.regexp_extract("url", "//([^/]+)", 1)
    found = {r["subtree"] for r in html_extract.templates(rows.withColumn("host", host)).collect()}
    assert found == brute_templates(listed) and len(found) > 100
    bare = spark.createDataFrame([(u, renamed(h)) for u, h in listed], "url string, html string")
    of_bare = {r["subtree"] for r in html_extract.templates(bare.withColumn("host", host)).collect()}
    same = by_count = withheld = 0
    for url, html in listed:
        seed = html_extract._seed(re.match(r"https?://([^/]+)", url)[1])
        text = html_extract.extract(html, found, seed)
        by_count += html_extract.extract(html, found, seed, names=False) == text  # the templates alone leave the same
        withheld += html_extract.extract(html, found & {html_extract.host_mark(seed)}, seed) != text  # and without them more is left
        same += html_extract.extract(renamed(html), of_bare, seed) == text
    assert withheld > 0.9 * len(listed) and by_count > 0.95 * len(listed) and same > 0.95 * len(listed)


@pytest.mark.parametrize("most", [0, 500_000])
def test_html_hosts_of_all_sizes_without_telling_names(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_HASHES", most)
    rnd, rows, want = random.Random(11), [], {}
    words = lambda n: " ".join(rnd.choice("stone river cloud paper light under".split()) + str(rnd.randrange(999)) for _ in range(n))
    for h, size in enumerate([2, 3, 5, 9, 40]):
        wrap = rnd.choice(["main", "article"])
        for i in range(size):
            lead, parts = words(8), [words(rnd.randrange(5, 300)) for _ in range(rnd.randrange(1, 5))]
            menu = "".join(f"<li><a href=/{k}>{words(1)}</a>" for k in range(rnd.randrange(4, 9)))
            html = f"<body><div class=k{h}><ul>{menu}</ul></div><div id=z{h}>{words(9)}</div><p>{lead}</p><{wrap}>{''.join(f'<p>{p}</p><ul><li>{p[:9]}</ul>' for p in parts)}</{wrap}><div><span>{words(4)}</span></div></body>"
            rows.append((len(rows), f"http://h{h}.example/{i}", html))
            want[len(rows) - 1] = "\n".join([lead, *(x for p in parts for x in (p, p[:9].rstrip()))])
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("unit", ['<a "', "<i>", "<div>", "<b><article><i></b>", "<ul><li>", "<dt><tr>", '<p class="', "<p>", "<table><tr><td>", "<a 'x' \"y> ", "<title>", "<!-", "&", "<", "</i>"])
def test_html_that_nothing_closes_takes_time_in_proportion(unit):
    import time

    def took(n):
        best = float("inf")
        for _ in range(3):
            began = time.process_time()
            html_extract.extract(unit * (n // len(unit)))
            best = min(best, time.process_time() - began)
        return best

    assert took(200_000) < 3 * took(100_000) + 0.3


@pytest.mark.parametrize("most", [0, 500_000])
def test_html_menus_and_marked_blocks_go_by_count_on_large_hosts(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_HASHES", most)
    menu = lambda i: "<div class=x9><ul>" + "".join(f"<li><a href=/{k}>entry {i} {k}</a>" for k in range(3 + i % 4)) + "</ul></div>"
    page = lambda i: f"{menu(i)}<p>story {i} with <a href=/>a link</a></p><ul><li>point {i}</ul><div class=ad>offer {i}</div>" + "<div class=notice>once</div>" * (i == 5)
    rows = [(i, f"http://large.example/{i}", page(i)) for i in range(20)] + [(100, "http://small.example/", page(5))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story {i} with a link\npoint {i}" + "\nonce" * (i == 5) for i in range(20))
    assert got[100] == "entry 5 0\nentry 5 1\nentry 5 2\nentry 5 3\nstory 5 with a link\npoint 5"


@pytest.mark.parametrize("most", [0, 500_000])
def test_html_templates_are_removed_per_host(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_HASHES", most)
    page = lambda i, own: f"<body><div>Welcome to the site</div><p>{own} {i}</p><div>All rights</div></body>"
    rows = [(i, f"http://a.example/{i}", page(i, "story")) for i in range(12)]
    rows += [(100 + i, "https://b.example/x", page(0, "copy")) for i in range(12)]  # copies are no template
    rows += [(200, "http://c.example", page(1, "one")), (201, None, None), (202, "x", ""), (203, "http://A.example/z?q", page(5, "story"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).collect()}
    assert got[3] == ("story 3", 7) and got[203] == ("story 5", 7)
    assert got[104][0] == "Welcome to the site\ncopy 0\nAll rights" and got[200][0].startswith("Welcome")
    assert got[201] == got[202] == ("", 0) and len(got) == len(rows)
    assert html_extract.extract_pages(df.where("false")).count() == 0


@pytest.mark.parametrize("most", [0, 500_000])
def test_html_templates_do_not_hang_on_the_size_of_the_host(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_HASHES", most)
    page = lambda i, *parts: "<body>" + "".join(f"<div>{p}</div>" for p in parts) + f"<p>story {i}</p></body>"
    rows = [(i, f"http://large.example/{i}", page(i, *["Advert"] * (i % 10 < 3), f"Section {i % 5}", *["Quoted"] * (i < 4))) for i in range(100)]
    rows += [(200 + i, f"http://small.example/{i}", page(i, "Menu here", *["Twice"] * (i < 2))) for i in range(4)]
    rows += [(300 + i, f"http://other.example/{i}", page(i, "Advert")) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
    assert got == {
        **{i: "Quoted\n" * (i < 4) + f"story {i}" for i in range(100)},
        **{200 + i: "Twice\n" * (i < 2) + f"story {i}" for i in range(4)},
        **{300 + i: f"Advert\nstory {i}" for i in range(2)},
    }
