import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import _components, _skew, decontaminate, line_dedup, near_dedup
from quarry.llm import _text as tx


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else [])


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / sum((x | y).values()) if x or y else float(a == b)


def brute_classes(texts):
    parent = list(range(len(texts)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(texts):
        for j in range(i):
            if (a or "") == (texts[j] or "") or (shingles(a) and shingles(texts[j]) and similarity(a, texts[j]) >= 0.8):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in range(len(texts))}


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_bag_minhash_estimates_weighted_jaccard_without_bias():
    rng = np.random.default_rng(0)
    keys = tx.mix64(np.arange(60, dtype=np.uint64))
    wa, wb = rng.integers(0, 12, 60), rng.integers(0, 12, 60)
    hashes = np.concatenate((np.repeat(keys, wa), np.repeat(keys, wb)))
    sig = near_dedup.bag_minhash(hashes, np.array([0, wa.sum(), wa.sum() + wb.sum()]), 6000)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / 6000) ** 0.5
    assert np.isfinite(sig).all()


@pytest.mark.parametrize("small_bucket", [32, 3])
def test_near_dedup_equals_brute_force(spark, docs, monkeypatch, small_bucket):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small_bucket)
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randrange(1, 80))) for _ in range(30)]
    texts += near_copies(rng, words(rng, 60), 60, 4) + near_copies(rng, words(rng, 200), 25, 9)
    texts += ["a b", "a b", "A  B", "", None, "", "x y z " * 400, "x y z " * 400 + "end", "one", texts[0], texts[0]]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs(*texts).withColumnRenamed("lang", "class_id")).collect()}
    want = brute_classes(texts)
    assert {i: v for i, v in got.items() if want[i] != v} == {}


def test_keep_one_and_odd_tables(spark, docs):
    df = docs("p q r s t u", "p q r s t u", "other words here").withColumn("__extra", F.lit(1))
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(df).collect()) == [0, 2]
    nulls = spark.createDataFrame([(None, "x", None)], df.schema.add("q", "string").fieldNames() and "doc_id long, text string, lang string")
    assert near_dedup.keep_one(nulls).count() == 1
    assert near_dedup.classes(docs("a").where("false")).count() == 0


def test_keep_one_goes_by_whole_texts_where_texts_were_cut(spark, docs):
    rng = random.Random(3)
    base, other = words(rng, 60), words(rng, 50)
    first, copy = " ".join(base), " ".join(["edited", *base[1:]])
    originals = docs(first, copy, " ".join(other), "same rest " + " ".join(words(rng, 40)), "same rest " + " ".join(words(rng, 40)), None)
    cut = docs(first, "edited", " ".join(other), "same rest", "same rest", None)
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(cut).collect()) == [0, 1, 2, 3, 5]
    whole = near_dedup.before_cuts(cut, originals)
    assert sorted(tuple(r) for r in whole.collect()) == sorted((r["doc_id"], r["text"]) for r in originals.where("doc_id in (1, 3, 4)").collect())
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(cut, whole=whole).collect()) == [0, 2, 3, 5]
    unrelated = docs("not what was cut", "nor this", None, "", "x", "y")
    assert near_dedup.before_cuts(cut, unrelated).count() == 0


def test_near_dedup_of_repeated_rows_and_clashing_columns(spark, docs):
    rng = random.Random(11)
    a, b = " ".join(words(rng, 30)), " ".join(words(rng, 30))
    rows = [(5, a), (5, a), (5, b), (7, b), (9, a), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, c0 int, __id int, class_id int")
    found = {(r["doc_id"], r["class_id"]) for r in near_dedup.classes(df).collect()}
    assert found == {(5, 5), (7, 5), (9, 5)}
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0, r["c0"], r["__id"], r["class_id"]) for r in kept.collect()) == [(0, 1, 2, 3)] * 2 + [(5, 1, 2, 3)] * 3


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    random.Random(1).shuffle(edges)
    got = dict(tuple(r) for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 150), 100)}


def brute_lines(texts, window=3, least=0, border=r"\n|(?<=[.!?]) "):
    split = [[s.strip() for s in re.split(border, t or "") if s.strip()] for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for i, lines in enumerate(split):
        for k in range(len(lines) - window + 1):
            key = tuple(lines[k : k + window])
            if sum(len(x.split()) for x in key) >= least:
                if key in seen:
                    gone[i].update(range(k, k + window))
                seen.add(key)
    return [[x for k, x in enumerate(lines) if k not in gone[i]] for i, lines in enumerate(split)], [len(g) for g in gone]


@pytest.mark.parametrize("least, sentences", [(0, True), (10, True), (0, False)])
def test_line_dedup_equals_brute_force(spark, docs, least, sentences):
    rng = random.Random(2)
    pool = [" ".join(words(rng, 5)) + "." for _ in range(40)]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "\n", "\n\n"]) for _ in range(rng.randrange(12))) for _ in range(120)]
    passage = " ".join(pool[:5])
    texts += [None, "", " \n", f"begin {passage} end of it", f"other {passage} tail", "A. B. C. " * 4, "w. " * 60000, "same\n" * 9]
    df = docs(*texts).withColumnRenamed("lang", "n_lines").withColumnRenamed("source", "gone")
    got = {r["doc_id"]: r for r in line_dedup.dedup(df, min_words=least, sentences=sentences).collect()}
    kept, removed = brute_lines(texts, least=least, border=r"\n|(?<=[.!?]) " if sentences else r"\n")
    for i, t in enumerate(texts):
        assert got[i]["n_removed"] == removed[i]
        assert (got[i]["text"] or "").split() == " ".join(kept[i]).split()
        if not removed[i]:
            assert got[i]["text"] == t
    assert line_dedup.dedup(df.where("false")).count() == 0


def test_rows_of_hot_keys_are_dealt_out(spark):
    """One key holds 90 % of the rows, one has just so many that it is dealt out, others have few or no partner."""
    rows = [(7, i) for i in range(4000)] + [(8, i) for i in range(_skew.SALTS)] + [(k, i) for k in range(100, 400) for i in range(2)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k long, v long")
    keyed = df.where("k <> 399").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(kept, ("-1", "false")):
            spark.conf.set(c, v)
        made = _skew.join_counted(df, keyed, ["k"])
        got = made.withColumn("task", F.spark_partition_id()).collect()
        assert made._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 1
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    most = {7: 3999, 8: _skew.SALTS - 1}
    assert sorted((r["k"], r["v"], r["most"]) for r in got) == sorted((k, v, most.get(k, 1)) for k, v in rows if k not in (399, None))
    assert max(Counter(r["task"] for r in got if r["k"] == 7).values()) < 0.5 * 4000


def test_components_of_a_hub_with_most_links(spark):
    """A hub in the middle of the identifiers: half its links are to smaller nodes, half to larger ones; and other pairs."""
    edges = [(1000, i) for i in range(2001) if i != 1000] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(100)]
    got = dict(tuple(r) for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 2001)} | {5001 + 2 * i: 5000 + 2 * i for i in range(100)}


def test_line_dedup_of_a_window_in_nearly_all_texts(spark):
    rows = [(i, f"one two\nthree four\nfive six\nown line {i}") for i in range(300)] + [(300 + i, f"a {i}\nb {i}\nc {i}") for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t if i == 0 or i >= 300 else f"own line {i}" for i, t in rows}


def test_line_dedup_of_odd_rows_and_clashing_columns(spark):
    rows = [(None, "a\nb\nc\nd"), (None, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (1, "x"), (2, "p\na\nb\nc"), (3, "a\nb\nc"), (4, None), (5, ""), (6, "a\nb")]
    df = spark.createDataFrame([(i, t, 7, 8, 9, 10) for i, t in rows], "doc_id long, text string, __id int, __gone int, n_lines int, n_chars long")
    df = df.withColumn("n_removed", F.lit("kept")).withColumn("c0", F.lit(1)).withColumn("id", F.lit(2))
    out = line_dedup.clean(df)
    assert out.columns == df.columns and {(r["n_lines"], r["n_removed"], r["__gone"], r["c0"], r["id"]) for r in out.collect()} == {(9, "kept", 8, 1, 2)}
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()), key=str)
    assert got == sorted([(0, "a\nb\nc\nd", 10), (1, "a\nb\nc\nd", 10)] * 2 + [(1, "x", 10), (2, "p", 1), (4, None, 10), (5, "", 10), (6, "a\nb", 10)], key=str)


def test_line_dedup_keeps_the_first_and_merges_covers(spark, docs):
    passage = "One two three four. Five six seven eight. Nine ten eleven twelve. More words stand here."
    out = line_dedup.dedup(docs(f"Start here. {passage}\nEnd.", f"Else.\n{passage} Done now.")).orderBy("doc_id").collect()
    assert out[0]["n_removed"] == 0 and out[1]["text"] == "Else.\nDone now." and out[1]["n_removed"] == 4


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_decontamination_finds_exact_and_edited_passages_only(spark, docs):
    rng = random.Random(7)
    bench = [" ".join(words(rng, n)) for n in (15, 30, 57)] + ["Kurz und gut.", "", None, "solo"]
    fill = lambda n: " ".join(words(rng, n))
    edited = bench[2].split()
    edited[-1] = "changed"
    texts = [f"{fill(90)} {bench[0].upper()}, {fill(9)}", f"{fill(9)}\n{bench[1]}\n", " ".join(edited), fill(300), fill(40) + " kurz, UND gut! " + fill(3), None, "", bench[0][: len(bench[0]) // 2], "x Solo y", bench[1]]
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs(*texts).withColumnRenamed("lang", "item_id"), items(spark, *bench)).collect()}
    assert set(found) == {(0, 0), (1, 1), (2, 2), (4, 3), (8, 6), (9, 1)}
    assert found[0, 0]["start_word"] == 90 and found[0, 0]["similarity"] == 1.0
    assert found[2, 2]["similarity"] == pytest.approx(52 / 54) and found[2, 2]["hamming"] <= decontaminate.RADIUS
    left = decontaminate.clean(docs(*texts), items(spark, *bench))
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 5, 6, 7]
    assert decontaminate.matches(docs(*texts), items(spark, "a").where("false")).count() == 0
    assert decontaminate.matches(docs("a").where("false"), items(spark, *bench)).count() == 0


@pytest.mark.parametrize("block_items", [1024, 4])
def test_decontamination_equals_brute_force_over_windows(spark, docs, monkeypatch, block_items):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block_items)
    rng = random.Random(9)
    bench = [" ".join(words(rng, rng.randrange(12, 40), 60)) for _ in range(6)]
    texts = []
    for _ in range(40):
        w = rng.choice(bench).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(words(rng, rng.randrange(20), 60) + w + words(rng, rng.randrange(20), 60)))
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        for j, b in enumerate(bench):
            n = len(b.split())
            best = max(similarity(" ".join(w[s : s + n]), b) for s in range(max(1, len(w) - n + 1)))
            if best >= 0.8:
                want[i, j] = pytest.approx(best)
    texts.append("word " * 200_000)
    repeated = items(spark, *bench).union(items(spark, *bench))
    got = [(r["doc_id"], r["item_id"], r["similarity"]) for r in decontaminate.matches(docs(*texts).withColumn("__id", F.lit(1)), repeated).collect()]
    assert {(d, i): s for d, i, s in got} == want and len(got) == len(want)


def test_an_index_of_many_equal_items_is_small_and_right(spark, docs):
    same = spark.range(40_000).select((F.col("id") % 2).alias("item_id"), F.lit("one two three four five six").alias("text"))
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs("x one two three four five six y", "none"), same).collect())
    assert got == [(0, 0), (0, 1)]


def test_index_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    index = decontaminate.Index([(i, tx.mix64(rng.integers(0, 2**60, 20).astype(np.uint64))) for i in range(50)], 5)
    probes = index.prints[rng.integers(0, 50, 400)].copy()
    for k in range(400):
        for bit in rng.choice(64, rng.integers(0, 24), replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(bit)
    w, item = index.near(probes, 20)
    d = np.bitwise_count(probes[:, None] ^ index.prints[None, :])
    assert set(zip(w.tolist(), item.tolist())) == set(zip(*map(list, np.nonzero(d <= decontaminate.RADIUS))))


def watch_writes(monkeypatch):
    """Plans and row counts of the tables that are written from now on, by name."""
    from quarry.llm import _scratch

    write, seen = _scratch.write_table, []

    def watched(df, name):
        out = write(df, name)
        seen.append((name, df._jdf.queryExecution().executedPlan().toString(), out.count()))
        return out

    monkeypatch.setattr(_scratch, "write_table", watched)
    return seen


def below_broadcasts(plan):
    depth = lambda line: re.search(r"\w|$", line).start()
    top = None
    for line in plan.splitlines():
        top = None if top is not None and depth(line) <= top else top
        if top is not None:
            yield line
        elif "BroadcastExchange" in line:
            top = depth(line)


def cut_and_whole(rng):
    """Originals, near copies and exact ones among them, and what is left of every other of them."""
    base = [" ".join(words(rng, 60)) for _ in range(6)]
    whole = [t for b in base for t in (b, b, *near_copies(rng, b.split(), 3, 2))]
    return whole, [" ".join(t.split()[:25]) if i % 2 else t for i, t in enumerate(whole)]


def test_near_dedup_never_broadcasts_texts(spark, docs, monkeypatch):
    whole, left = cut_and_whole(random.Random(21))
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    seen = watch_writes(monkeypatch)
    cut = docs(*left)
    near_dedup.keep_one(cut, whole=near_dedup.before_cuts(cut, docs(*whole))).collect()
    carrying = [(name, plan) for name, plan, _ in seen if name in ("links", "whole")]
    assert {name for name, _ in carrying} == {"links", "whole"}
    # by their files, which copies make small, tables of texts look as if the driver could hold them
    assert not [name for name, plan in carrying if any(re.search(r"\b(text|left|elements)#", line) for line in below_broadcasts(plan))]


def test_repeated_rows_do_not_multiply_in_near_dedup(spark, docs, monkeypatch):
    whole, left = cut_and_whole(random.Random(22))
    cut, originals = docs(*left), docs(*whole)
    four = lambda df: df.unionByName(df).unionByName(df).unionByName(df)
    seen = watch_writes(monkeypatch)

    def kept(a, b):
        seen.clear()
        ids = sorted(r["doc_id"] for r in near_dedup.keep_one(a, whole=near_dedup.before_cuts(a, b)).collect())
        return ids, [(name, n) for name, _, n in seen if name in ("texts", "whole", "links")]

    once, tables = kept(cut, originals)
    repeated, many = kept(four(cut), four(originals))
    assert repeated == sorted(4 * once) and any(n for _, n in tables)
    assert many == tables  # 16 times the texts, and 256 times the pairs, when each row met each of its identifier's


def test_before_cuts_knows_rows_of_one_identifier_that_differ(spark):
    rows = [(0, "a b c d"), (0, "a b c d"), (1, "x y z"), (1, "u v w"), (2, "same text"), (3, "p q")]
    now = [(0, "a b c d"), (0, "a c"), (1, "x z"), (1, "v"), (2, "same text"), (3, "q p")]
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in near_dedup.before_cuts(make(now), make(rows)).collect())
    assert got == [(0, "a b c d"), (1, "u v w"), (1, "x y z")]
