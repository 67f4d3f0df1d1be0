import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import _scratch, packing, sstable
from quarry.llm._tokens import ChunkTokenizer
from quarry.llm.queries import vocabulary

ODD = [
    None, "", " ", "  a  b", "a\n\nb", "\n x \n", "a \n b  ", "é  b", "a\n\n b", " \t ", "don't we'll  'S", "a\r\nb\x0b", "x y z　", "\x1ca \x1f",
    "1234 56a", "…“hi” there", "<|endoftext|> a", "́a ́", "À̀b", "a" * 5000, "x " * 3000,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_tokenisation_is_the_librarys(name):
    t = ChunkTokenizer(vocabulary(name))
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab é.\n \t'1’ ") for _ in range(60)) for _ in range(300)]
    for _ in range(2):  # fresh and known chunks
        ids, bounds = t.encode(pa.array(texts, pa.string()))
        for i, e in enumerate(t.tok.encode_batch([x or "" for x in texts], add_special_tokens=False)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == e.ids, texts[i]


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_sequences_exactly_and_nearly_full(seed):
    rng, cap = np.random.default_rng(seed), 128
    lengths = np.minimum(cap, rng.geometric(0.02, 4000))
    hist = np.bincount(lengths, minlength=cap + 1)
    rows = packing.plan(hist, cap)
    room, spans, rank = {}, {}, np.zeros(cap + 1, int)
    keys = (rows[:, 0] << 44) + rows[:, 1]
    for n in lengths.tolist():
        at = np.searchsorted(keys, (n << 44) + rank[n], "right") - 1
        assert rows[at, 0] == n
        spans.setdefault(int(rows[at, 2] + rank[n] - rows[at, 1]), []).append((int(rows[at, 3]), n))
        rank[n] += 1
    for parts in spans.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= cap
    assert len(spans) <= -(-lengths.sum() // cap) * 1.01 + 1
    assert room == {}


def test_pack_places_every_token_once(spark, docs):
    texts = ["", None, "word " * 50, "a b c", "a b c", "long " * 300]
    df = docs(*texts).withColumnRenamed("source", "piece")  # a clashing extra column
    path = vocabulary("byte_bpe_50k.json")
    placed = packing.pack(df, path, 64).cache()
    tok = ChunkTokenizer(path).tok
    by_doc = {}
    for r in placed.collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and all(p["length"] == 64 for p in pieces[1:])
        at = 0
        for p in pieces:
            assert p["start"] == at
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    made = {r["sequence_id"]: r["ids"] for r in packing.materialise(placed, df, path, 64).collect()}
    assert sum(map(len, made.values())) == sum(r["length"] for r in placed.collect()) and max(map(len, made.values())) <= 64
    for r in placed.collect():
        part = made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert packing.pack(df.where("false"), path, 64).count() == 0


def test_sstable_round_trip_and_lookup(spark, docs):
    from pyspark.sql import functions as F

    path, texts = vocabulary("word_bpe_49k.json"), ["b c", None, "", "same same", "x " * 20000, *[f"word {i}" for i in range(300)]]
    df = docs(*texts).withColumn("doc_id", (F.col("doc_id") - 3) * 1_000_003).withColumn("start", F.lit(1))
    df = df.union(df.where("text = 'b c'"))  # a repeated row
    manifest = sstable.write(df, path, 2, _scratch.new_path(spark, "test-sst"), shards=3)
    got = [tuple(r) for r in sstable.read(manifest).orderBy("start").collect()]
    tok, want, start = ChunkTokenizer(path).tok, [], 0
    for r in df.orderBy("doc_id").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert len(sstable.lookup(manifest, -3 * 1_000_003)) == 2
    assert sstable.lookup(manifest, 0)[0].tolist()[-1] == 2
    assert sstable.lookup(manifest, 12345) == []
    empty = sstable.write(df.where("false"), path, 2, _scratch.new_path(spark, "test-sst"))
    assert sstable.read(empty).count() == 0


def test_sstable_shards_by_bytes_and_one_identifier_over_many(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sstable, "SHARD_TEXT", 100)
    df = spark.range(0, 400, 1, 4).select(F.lit(7).alias("doc_id"), F.when(F.col("id") < 300, "same text").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    assert sstable.shard_count(df) > 30
    manifest = sstable.write(df, vocabulary("word_bpe_49k.json"), 2, _scratch.new_path(spark, "test-sst"))
    assert manifest.count() > 5 and manifest.agg(F.max("entries")).first()[0] < 200
    got = sstable.read(manifest).orderBy("start").collect()
    assert len(got) == 400 and {r["doc_id"] for r in got} == {7}
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    tok = ChunkTokenizer(vocabulary("word_bpe_49k.json")).tok
    same = [*tok.encode("same text", add_special_tokens=False).ids, 2]
    found = sstable.lookup(manifest, 7)
    assert len(found) == 400 and sum(x.tolist() == same for x in found) == 300


def test_sstable_null_ids_sort_first(spark):
    df = spark.createDataFrame([(None, "a"), (-5, "b"), (7, "c")], "doc_id long, text string")
    manifest = sstable.write(df, vocabulary("word_bpe_49k.json"), 2, _scratch.new_path(spark, "test-sst"), shards=2)
    assert [r["doc_id"] for r in sstable.read(manifest).orderBy("start").collect()] == [None, -5, 7]
    assert len(sstable.lookup(manifest, None)) == 1
