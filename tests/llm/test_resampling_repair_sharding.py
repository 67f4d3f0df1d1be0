"""Importance resampling, conversation repair and sharding: against SQL, brute force and their laws."""

import hashlib
import itertools
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import _crc, conversation, queries, resampling, sharding

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_conversation_repair", "op13_consistent_sharding"])
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(columns).collect())
    assert got == sorted(str(r) for r in c.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall())


def test_checksums_of_joined_spans():
    rnd = random.Random(1)
    parts = [bytes(rnd.randrange(256) for _ in range(n)) for n in [0, 1, 5, 63, 64, 65, 100, 5000, 131_072 + 77]]
    buf, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    crc = _crc.of_spans(buf, ends - [len(p) for p in parts], ends)
    assert crc.tolist() == [zlib.crc32(p) for p in parts]
    sizes = np.array([len(p) for p in parts])
    for i, a in enumerate(parts):
        left = np.full(len(parts), crc[i])
        assert (_crc.shifted(_crc.spaced(left), sizes) ^ crc).tolist() == [zlib.crc32(a + b" " + b) for b in parts]


def plain_features(text, buckets=10_000):
    words = "".join(ch if "0" <= ch <= "9" or "a" <= ch <= "z" or ch > "\x7f" else " " for ch in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).split(" ")
    words = [w for w in words if w]
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


TEXTS = [None, "", "One", "Émile a 2 PARTS-of,it x", "a b c d " * 30, "  \n", "x" * 300 + " y " + "z" * 70, "İ퟿日本語 の 文 章 " * 9, "a b c d " * 30]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_features_of_blocks(monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    found, rows, words = (np.concatenate(x) for x in zip(*resampling.features(pa.array(TEXTS)), strict=True))
    for i, t in enumerate(TEXTS):
        n, want = plain_features(t)
        assert (sorted(found[rows == i].tolist()), int((words == i).sum())) == (sorted(want), n)


def plain_draw(rows, target, percent):
    made = [(d, *plain_features(t)) for d, t in rows]
    s, t = [0] * 10_000, [0] * 10_000
    for _, _, fs in made:
        for f in fs:
            s[f] += 1
    for x in target:
        for f in plain_features(x)[1]:
            t[f] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10_000) / ((s[b] + 1.0) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for d, n, fs in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[f] for f in fs)
        out.append([d, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_draw_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("ab cd ef gh ij kl".split()) for _ in range(rnd.randrange(60)))) for i in range(150)]
    rows += [(200 + i, t) for i, t in enumerate(TEXTS)] + [(7, rows[7][1]), (None, "a b " * 40)] + [(300 + i, "same words here " * 10) for i in range(60)]
    target = ["ab cd ef gh", None, "a b a b"]
    df = spark.createDataFrame([(d, t, 1.0, "x", 2) for d, t in rows], "doc_id long, text string, score double, weight string, rank int").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 60, 100):
        got = sorted((tuple(r) for r in resampling.draw(df, bench, percent=percent).collect()), key=repr)
        assert got == plain_draw(rows, target, percent)
    assert resampling.draw(df.limit(0), bench).count() == 0
    assert {r["rank"] for r in resampling.draw(df.where("doc_id < 3 or text is null"), bench.limit(0)).collect()} == {None}


def test_coarse_bins_rise_with_scores(spark):
    values = sorted({s * v for e in range(62) for v in ((1 << e) - 1, 1 << e, (1 << e) + 1, 3 << max(e - 2, 0)) for s in (1, -1)})
    bins = [r[0] for r in spark.createDataFrame([(v,) for v in values], "score long").select(resampling._coarse("score")).collect()]
    assert bins == sorted(bins) and len({*range(-(60 * 256 + 512), 60 * 256 + 513)} & {*bins}) == len({*bins})


# Conversations


def plain_repair(rows):
    """(cost, audit, lines) of the best edit script, by search over all scripts; rows: (role, text, fault)."""
    names = {"u": "user", "a": "assistant"}

    def legal(initials):
        rest = initials[1:] if initials[:1] == "s" else initials
        return not initials or (rest and rest == "ua" * (len(rest) // 2))

    best = None
    choices = []
    for role, text, fault in rows:
        own = [("D", 4, None)]
        if fault not in (1, 2):
            extra = 3 if fault == 3 else 0
            own += [("K", extra, f"{role}:{text}")] + [("R", 3 + extra, f"{n}:{text}") for n in names.values()]
        choices.append(own)
    gap = [list(x) for n in range(3) for x in itertools.product(("user:", "assistant:"), repeat=n)]
    for inserts in itertools.product(gap, repeat=len(rows) + 1):
        if sum(map(len, inserts)) > len(rows) + 2:
            continue
        for picked in itertools.product(*choices):
            audit, lines, cost = "", [], 0
            for run, (edit, c, line) in zip(inserts, [*picked, ("", 0, None)], strict=True):
                audit, cost = audit + "I" * len(run) + edit, cost + 3 * len(run) + c
                lines += run + ([line] if line is not None else [])
            if legal("".join(x[:1] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
        out.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
        seen.add((role, text))
    return out


def figures(turns, rows, kinds):
    known = [t for t in turns if t is not None]
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(kinds.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs))


def conversations(n, most, rnd):
    roles, texts = ["user", "assistant", "system", "tool", ""], ["Yes.", "No", " ", "Why? \n", "Go!"]
    return [(c, t, rnd.choice(roles[: rnd.choice([2, 3, 5])]), rnd.choice(texts)) for c in range(n) for t in sorted(rnd.sample(range(9), rnd.randrange(1, most + 1)))]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))


def check_repair(got, rows, best):
    for conv, out in got.items():
        own = in_order([r for r in rows if r[0] == conv])
        kinds = faults([r[2:] for r in own])
        cost, audit, lines = best([(r[2], r[3], k) for r, k in zip(own, kinds, strict=True)])
        assert tuple(out)[1:] == (*figures([r[1] for r in own], [r[2:] for r in own], kinds), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), (own, audit)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_equals_search(spark):
    rows = conversations(60, 4, random.Random(3)) + [(None, None, "user", "Hi."), (None, 3, "user", "Hi."), (None, 3, "assistant", "Well.")]
    df = spark.createDataFrame(rows, SCHEMA)
    empty = spark.createDataFrame([(99, 0, "user", "gone")], SCHEMA)
    got = {r["conv_id"]: r for r in conversation.repair(df.union(empty), df).collect()}
    assert tuple(got.pop(99)) == (99, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got.keys() == {r[0] for r in rows}
    check_repair(got, rows, plain_repair)


def strings(rows):
    """The program with whole audit strings and lines in place of ranks."""
    now = {0: (0, "", [])}
    for role, text, fault in rows:
        best = {}
        for state, (cost, audit, lines) in now.items():
            for then, code, more in conversation.edges(role[:1], fault)[state]:
                macro = conversation.MACROS[code]
                made, at = [], state
                for _ in macro[:-1]:
                    made.append(("user:", "assistant:")[at == 2])
                    at = 3 if at == 2 else 2
                made += [] if macro[-1] == "D" else [f"{role}:{text}" if macro[-1] == "K" else ("user:", "assistant:")[at == 2] + text]
                best[then] = min(best.get(then, (1 << 60,)), (cost + more, audit + macro, lines + made))
        now = best
    ends = [(0, ""), (6, "II")], [(6, "II")], [(3, "I")], [(0, "")]
    tails = {"": [], "I": ["assistant:"], "II": ["user:", "assistant:"]}
    return min((c + m, a + t, ls + tails[t]) for s, (c, a, ls) in now.items() for m, t in ends[s])


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_long_conversations_in_segments(spark, most):
    rnd = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool"], [f"Line {i}{'.' * (i % 3 > 0)}" for i in range(40)] + ["", "\n"]
    rows = [(c, t if t % 7 else None, rnd.choice(roles), rnd.choice(texts)) for c in (1, 2, None) for t in range(150)] + conversations(20, 5, rnd)
    rows = [r for r in rows if r[0] not in (1, 2) or r[1] is None or r[1] >= 9]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    clash = df.withColumn("seg", F.lit("x")).withColumn("table", F.lit(1)).withColumn("cost", F.lit(None).cast("int"))
    got = {r["conv_id"]: r for r in conversation.repair(df, clash, most_rows=most).collect()}
    assert len(got) == len({r[0] for r in rows})
    check_repair(got, rows, strings)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(5)] + [(None, None, None, None), (5, None, "user", None)]
    got = sorted(map(tuple, conversation.damage(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", fault int")).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        role, text, f = role or " ", text or " ", zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f:
            want += [(c, t, "user" if f == 4 else role, "" if f == 1 else "".join(x for x in text if x not in ".!?") if f == 2 else text)] * (2 if f == 3 else 1)
    assert got == sorted(want, key=repr)
    none = spark.createDataFrame([], SCHEMA)
    assert conversation.repair(none, conversation.damage(none)).count() == 0


# Sharding


def plain_ring(shards, vnodes):
    nodes = sorted((int((m := hashlib.md5(f"shard {s} {v}".encode()).hexdigest())[:4], 16), m, s) for s in range(shards) for v in range(vnodes))
    return lambda point: list(dict.fromkeys(s for _, _, s in [x for x in nodes if x[0] >= point] + nodes))


def test_ring_is_walked_clockwise(spark):
    walk = plain_ring(5, 16)
    got = {r["point"]: r["walk"] for r in sharding.ring(spark, 5, 16).collect()}
    assert sorted(got) == list(range(1 << 16))
    assert all(got[p] == walk(p) for p in range(0, 1 << 16, 97))


def plain_shards(rows, shards, vnodes=256, slack=1):
    walk, units = plain_ring(shards, vnodes), {}
    for d, t in rows:
        units.setdefault(int(hashlib.md5(str(d).encode()).hexdigest()[:4], 16), []).append((d, len((t or "").encode()) + 1))
    total = sum(s for x in units.values() for _, s in x)
    full, load, where = -(-total * (1000 + slack) // (1000 * shards)), [0] * shards, {}
    left = sorted(((p, sum(s for _, s in x)) for p, x in units.items()), key=lambda x: (-x[1], x[0]))
    for r in range(shards):
        for point, size in left:
            goal = walk(point)[r]
            if load[goal] < full:
                load[goal] += size
                where |= {d: goal for d, _ in units[point]}
        left = [x for x in left if units[x[0]][0][0] not in where]
    return where


def test_shards_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i * 7919, "é" * rnd.randrange(1, 40)) for i in range(300)]
    assert len({hashlib.md5(str(d).encode()).hexdigest()[:4] for d, _ in rows}) == 300  # no unit is split
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, shard int, point string").repartition(7)
    got = sharding.assign(df, shards=5, vnodes=64).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == plain_shards(rows, 5, 64)
    assert all((r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode())) for r in got for d, t in rows if d == r["doc_id"])


def gapless(rows):
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_sharding_of_hot_identifiers_nulls_and_no_rows(spark):
    hot = spark.range(3000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 5 else id end as doc_id", "case when id % 10 = 0 then null else 'the same text' end as text")
    rows = sharding.assign(hot, shards=16).collect()
    gapless(rows)
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    assert len(rows) == 3000 and max(loads) <= 1.06 * sum(loads) / 16 and min(loads) >= 0.9 * sum(loads) / 16
    assert {(r["size"], r["text_crc32"]) for r in rows} == {(1, 0), (14, zlib.crc32(b"the same text"))}
    assert sharding.assign(hot.limit(0)).count() == 0
    one = sharding.assign(spark.createDataFrame([(1, "x" * 1_000_000), (2, "")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["size"], r["slot"]) for r in one) == [(1, 1_000_001, 0), (2, 1, 0)]


def test_one_more_shard_moves_few(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    before, after = (sharding.assign(df, shards=n) for n in (16, 17))
    both = before.join(after.withColumnRenamed("shard", "then"), "doc_id").where("shard <> then")
    moved, elsewhere = both.count(), both.where("then <> 16").count()
    assert moved < 2 * 20_000 / 17 and elsewhere < 20_000 / 17
    loads = [r[0] for r in after.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(loads) == 17 and max(loads) < 1.01 * sum(loads) / 17
