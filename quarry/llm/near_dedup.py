"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles (words: lower-cased runs between ASCII
white space). Equal texts are one class from the start; what follows sees one of each.

Signature. Weights are discretised at every whole number, and weight space is split into
the intervals (0,1], (1,2], (2,4], (4,8], ...; every shingle has a Poisson process in each,
seeded by the shingle and the interval alone, of a rate in proportion to its width. A point
has a time, a register and, by halving the interval step by step, a weight level; it counts
for a document if the level does not exceed the shingle's weight there. A register holds
the earliest time, so two registers agree with probability equal to the weighted Jaccard
similarity. Times are generated in rising order up to a bound by which all registers are
filled but rarely, and the bound is raised for the rest: most shingles of a long document
cost one draw.

Candidates share one of ``BANDS`` bands of ``ROWS`` registers (at similarity 0.8 all but 1 in
10,000 do). Pairs are not emitted within a band's bucket: first each member is paired
with four hubs of the bucket, the pairs are verified on exact multiset overlap, and components formed; then
only buckets whose members are still in different components are looked at again. In a
small one, pairs across components are verified if their signatures agree in as many registers as is
likely at the threshold (five standard errors). In a large one, whoever is not in the commonest component is
compared with all members, exactly, block by block, and a spanning forest of the links is kept. So no
candidate link between different classes is lost, while a group of copies costs a number of
pairs in proportion to its size.

Defined results: null texts count as empty; equal texts (empty ones too) are one class; a
text of one to four words is one shingle. Rows with equal doc_id count as one document, with
the class of the least. Rows without doc_id are left out. An empty table gives an empty
result. Other columns are not read by ``classes`` and carried through by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _components, _scratch
from . import _text as tx

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
HUBS = 4
SMALL_BUCKET = 32
BLOCK = 512
COLUMNS = 8192
BITMAP_BITS = 1 << 26
SLACK = 5.0  # standard errors


def distinct_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one occurrence of each key, and how often it occurs."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return order[first], np.diff(np.append(first, len(keys)))


def bag_minhash(hashes: np.ndarray, bounds: np.ndarray, registers: int) -> np.ndarray:
    """Signatures (rows x registers, float64 times) of multisets of hashes."""
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    at, weight = distinct_counts(tx.mix64(rows.astype(tx.U64)) ^ hashes)
    seed, doc = hashes[at], rows[at]
    total = np.bincount(doc, weight, n)
    out = np.full((n, registers), np.inf)
    margin, todo = 3.0, total > 0
    while todo.any():
        bound = np.where(todo, (np.log(registers) + margin) / np.maximum(total, 1), -1.0)
        out[todo] = np.inf
        use = todo[doc]
        s, d, w = seed[use], doc[use], weight[use]
        level = 0
        while len(s):
            _process(s, d, w, level, bound, out, registers)
            more = w > (1 << level)
            s, d, w = s[more], d[more], w[more]
            level += 1
        todo = np.isinf(out).any(1) & (total > 0)
        margin *= 3
    return out


def _process(seed, doc, weight, level, bound, out, registers) -> None:
    """Points of one interval: (0,1] at level 0, else (2^(level-1), 2^level]."""
    low = (1 << level) >> 1
    rate = registers * max(1, low)
    flat = out.reshape(-1)
    state = tx.mix64(seed + tx.U64((level + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    time, limit = np.zeros(len(seed)), bound[doc]
    while len(state):
        state = tx.mix64(state + tx.U64(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> tx.U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        on = time <= limit
        state, time, limit, doc, weight = state[on], time[on], limit[on], doc[on], weight[on]
        draw = tx.mix64(state ^ tx.U64(0xA0761D6478BD642F))
        register = ((draw >> tx.U64(32)) * tx.U64(registers) >> tx.U64(32)).astype(np.int64)
        counts, times, cells = slice(None), time, doc * registers + register
        if level > 1:  # halve the interval until one whole number is left
            at = np.full(len(draw), low, np.int64)
            for k in range(level - 1):
                at += ((draw >> tx.U64(k)) & tx.U64(1)).astype(np.int64) << (level - 2 - k)
            counts = at + 1 <= weight
            times, cells = time[counts], cells[counts]
        np.minimum.at(flat, cells, times)


def signed_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, copy`` (128 bits of the text), ``sig`` (a byte a register), ``bands``."""
    registers = BANDS * ROWS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, most=1 << 20):
            h, bounds = tx.shingles(*tx.words(tx.column(b, "text")), SHINGLE)
            times = bag_minhash(h, bounds, registers)
            bits = tx.mix64(times.view(tx.U64))
            empty = np.isinf(times[:, 0])
            bands = bits.reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=tx.U64), bands.shape[:2])
            for k in range(ROWS):
                key = tx.mix64(key * tx.U64(0x9E3779B97F4A7C15) ^ bands[:, :, k])
            sig = (bits & tx.U64(255)).astype(np.uint8)
            listed = [None if e else x for e, x in zip(empty, tx.signed(key), strict=True)]
            yield pa.record_batch(
                [tx.column(b, "doc_id"), tx.column(b, "copy"), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(listed, pa.list_(pa.int64()))],
                names=["doc_id", "copy", "sig", "bands"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("copy"))
    return slim.mapInArrow(sign, "doc_id long, copy binary, sig binary, bands array<long>")


def weighted_jaccard(a: pa.Array, b: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Exact similarity of the shingle multisets, row by row."""
    n, keys, sides, rows = len(a), [], [], []
    for side, col in enumerate((a, b)):
        h, bounds = tx.shingles(*tx.words(col), size)
        row = np.repeat(np.arange(n), np.diff(bounds))
        keys.append(tx.mix64(row.astype(tx.U64)) ^ h)
        sides.append(np.full(len(h), side))
        rows.append(row)
    return multiset_similarity(np.concatenate(keys), np.concatenate(sides), np.concatenate(rows), n)


def multiset_similarity(keys: np.ndarray, sides: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    if not len(keys):
        return np.ones(n)
    order = np.argsort(keys)
    keys, sides, rows = keys[order], sides[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    right = np.add.reduceat(sides, first)
    left = np.diff(np.append(first, len(keys))) - right
    low = np.bincount(rows[first], np.minimum(left, right), n)
    high = np.bincount(rows[first], np.maximum(left, right), n)
    return np.where(high > 0, low / np.maximum(high, 1), 1.0)


def _repeat(rows: DataFrame, *keys: str) -> bool:
    return not rows.groupBy(*keys).count().where("count > 1").isEmpty()


def _once(texts: DataFrame) -> DataFrame:
    """Each different text of an identifier once."""
    return texts.groupBy("id", F.unhex(F.md5("text")).alias("copy")).agg(F.first("text").alias("text")).select("id", "text")


def _texts(docs: DataFrame, needed: DataFrame, once: bool = False) -> DataFrame:
    """``id, text`` of the documents in ``needed(id)``, written; with ``once``, which costs a shuffle of them, no row
    twice. A bitmap of fixed size (``BITMAP_BITS``), broadcast, lets through the needed identifiers and few others, so
    texts that are not needed are not shuffled; where it would be over half full, a join decides instead.

    Joins with the result are to be merged: files of copies are many times smaller than their rows, so
    Spark, which goes by the files, would broadcast texts that the driver can't hold."""
    only = _once if once else lambda x: x
    text = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bit = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS))
    words = needed.select((bit / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = words.toPandas()  # at most BITMAP_BITS / 64 rows
    bits = np.zeros(BITMAP_BITS // 64, tx.U64)
    bits[table["w"].to_numpy(np.int64)] = table["b"].to_numpy(np.int64).view(tx.U64)
    if np.bitwise_count(bits).sum() > BITMAP_BITS // 2:
        return _scratch.write_table(only(text.join(needed, "id", "left_semi")), "texts")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = tx.column(b, "bit").to_numpy().astype(tx.U64)
            ok = np.flatnonzero(shared.value[(at >> tx.U64(6)).astype(np.int64)] >> (at & tx.U64(63)) & tx.U64(1))
            yield b.take(pa.array(ok)).select(["id", "text"])

    return _scratch.write_table(only(text.withColumn("bit", bit).mapInArrow(pick, "id long, text string")), "texts")


def verify(pairs: DataFrame, docs: DataFrame, threshold: float, once: bool = False) -> DataFrame:
    """Pairs ``a, b`` whose exact similarity reaches the threshold, with it. ``once``: identifiers of ``docs`` repeat."""
    held = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), once)
    side = lambda key, name: held.select(F.col("id").alias(key), F.col("text").alias(name)).hint("merge")
    both = pairs.join(side("a", "text"), "a").join(side("b", "other"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, most=1 << 20):
            s = weighted_jaccard(tx.column(b, "text"), tx.column(b, "other"))
            ok = pa.array(np.flatnonzero(s >= threshold))
            yield pa.record_batch([tx.column(b, "a").take(ok), tx.column(b, "b").take(ok), pa.array(s).take(ok)], names=["a", "b", "similarity"])

    out = _scratch.write_table(both.select("a", "b", "text", "other").mapInArrow(compare, "a long, b long, similarity double"), "links")
    _scratch.drop_table(held)
    return out


def _likely(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures agree in as many registers as the threshold makes likely."""
    least = _least(threshold)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = (_matrix(tx.column(b, "sa")) == _matrix(tx.column(b, "sb"))).mean(1)
                ok = pa.array(np.flatnonzero(same >= least))
                yield pa.record_batch([tx.column(b, "a").take(ok), tx.column(b, "b").take(ok)], names=["a", "b"])

    sig = rows.select("doc_id", "sig")
    both = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def _least(threshold: float) -> float:
    return threshold - SLACK * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _elements(held: DataFrame) -> DataFrame:
    """``id, elements``: 32-bit numbers of a text's shingles, each copy of a shingle its own,
    so that multiset overlap is set overlap."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, most=1 << 20):
            h, bounds = tx.shingles(*tx.words(tx.column(b, "text")), SHINGLE)
            rows = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            order = np.lexsort((h, rows))
            h, rows = h[order], rows[order]
            fresh = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]))))
            nth = np.arange(len(h)) - np.repeat(fresh, np.diff(np.append(fresh, len(h))))
            e = (tx.mix64(h + nth.astype(tx.U64) * tx.U64(0x9E3779B97F4A7C15)) >> tx.U64(32)).astype("<u4")
            yield pa.record_batch([tx.column(b, "id"), pa.array([e[bounds[i] : bounds[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], names=["id", "elements"])

    return held.mapInArrow(number, "id long, elements binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of element sets, left x right, by products of 0/1
    matrices over the elements that both sides hold."""
    rows_l, rows_r = (np.repeat(np.arange(len(x)), [len(e) for e in x]) for x in (left, right))
    el, er = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(el, er)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), COLUMNS):
        part = common[at : at + COLUMNS]
        sides = []
        for e, rows, n in ((el, rows_l, len(left)), (er, rows_r, len(right))):
            col = np.minimum(np.searchsorted(part, e), len(part) - 1)
            hit = part[col] == e
            x = np.zeros((n, len(part)), np.float32)
            x[rows[hit], col[hit]] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def _across(members: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Links between different labels within the buckets of ``members(key, doc_id, label, n)``.

    Most members of a bucket carry its commonest label; every other member is compared with
    all members. Others and all are dealt into blocks, each two blocks meet in a task of
    their own, overlap is exact, and of the links found a spanning forest is emitted."""
    counts = members.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.max("c").alias("most"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    dealt = members.join(counts, "key").withColumn("nl", blocks(F.col("all") - F.col("most"))).withColumn("nr", blocks(F.col("all")))
    mine = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = dealt.where("label <> top").select("key", "doc_id", "label", F.lit(0).alias("side"), mine("nl").alias("i"), every("nr").alias("j"))
    all_members = dealt.select("key", "doc_id", "label", F.lit(1).alias("side"), every("nl").alias("i"), mine("nr").alias("j"))
    rows = others.unionByName(all_members).join(_scratch.write_table(_elements(held), "elements").hint("merge"), F.col("doc_id") == F.col("id"))

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, labels, side = (table[c].to_numpy() for c in ("doc_id", "label", "side"))
        sets = [np.frombuffer(x, "<u4") for x in table["elements"].to_pylist()]
        size = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        shared = overlaps([sets[k] for k in left], [sets[k] for k in right])
        union = size[left][:, None] + size[right][None, :] - shared
        x, y = np.nonzero((shared >= threshold * union - 1e-6) & (labels[left][:, None] != labels[right][None, :]))
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        found = []
        for p, q in zip(left[x].tolist(), right[y].tolist(), strict=True):
            a, b = root(int(labels[p])), root(int(labels[q]))
            if a != b:
                parent[a] = b
                found.append((int(ids[p]), int(ids[q])))
        return pa.table({"a": np.array([a for a, _ in found], np.int64), "b": np.array([b for _, b in found], np.int64)})

    return rows.select("key", "i", "j", "side", "doc_id", "label", "elements").groupBy("key", "i", "j").applyInArrow(meet, "a long, b long")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id``: one row per row of ``docs`` with a doc_id. The class is named by
    its least doc_id."""
    rows = _scratch.write_table(signed_rows(docs), "signatures")
    once = _repeat(rows, "doc_id")
    copies = rows.groupBy("copy").agg(F.min("doc_id").alias("rep"))
    reps = rows.join(copies.select("copy", F.col("rep").alias("doc_id")), ["doc_id", "copy"], "left_semi")
    reps = reps.groupBy("doc_id").agg(F.min_by(F.struct("sig", "bands"), "copy").alias("x")).select("doc_id", "x.*")
    reps = _scratch.write_table(reps, "representatives")
    members = reps.select("doc_id", F.explode("bands").alias("key"))
    chosen = [F.min("doc_id"), *(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(k))) for k in range(1, HUBS))]
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.array(*chosen).alias("hubs")).where("n > 1")
    in_bucket = _scratch.write_table(members.join(buckets, "key"), "buckets")  # members of buckets with others only
    star = in_bucket.select("doc_id", F.explode(F.array_distinct("hubs")).alias("hub")).where("doc_id <> hub")
    tested = _scratch.write_table(_likely(star.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct(), reps, threshold), "pairs")
    links = verify(tested, docs, threshold, once)
    short = _components.shortened(links)
    labels = short.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))

    labelled = in_bucket.select("key", "doc_id", "n").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    labelled = _scratch.write_table(labelled, "labelled")
    _scratch.drop_table(in_bucket)
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_members = labelled.join(mixed, "key", "left_semi")
    few = open_members.where(F.col("n") <= SMALL_BUCKET).groupBy("key").agg(F.collect_list(F.struct("label", "doc_id")).alias("m"))
    few = few.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y["label"] > x["label"]), lambda y: F.struct(F.least(x["doc_id"], y["doc_id"]).alias("a"), F.greatest(x["doc_id"], y["doc_id"]).alias("b")))))).alias("p")).select("p.a", "p.b").distinct()
    rest = _likely(few.join(tested.hint("merge"), ["a", "b"], "left_anti"), reps, threshold)
    rest = _scratch.write_table(rest, "pairs")
    found = verify(rest, docs, threshold, once)
    more = found.select("a", "b")
    many = _scratch.write_table(open_members.where(F.col("n") > SMALL_BUCKET), "open")
    if not many.isEmpty():
        held = _texts(docs, many.select(F.col("doc_id").alias("id")).distinct(), once)
        more = more.union(_scratch.write_table(_across(many, held, threshold), "links"))
        _scratch.drop_table(held)
    for read in (reps, tested, rest, labelled, many):
        _scratch.drop_table(read)
    final = _components.components(short.toDF("a", "b").union(more))
    for read in (links, found, short):
        _scratch.drop_table(read)

    named = rows.select("doc_id", "copy").join(copies, "copy").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return named.select("doc_id", F.coalesce("label", "rep").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, whole: DataFrame | None = None) -> DataFrame:
    """``docs`` with one document of each class: the one with the least doc_id. Rows without
    doc_id stay. ``whole(doc_id, text)`` gives texts of some of the documents as they were before they were
    cut: then whoever is a near-duplicate by those goes first, and of the rest, by the texts that they have."""
    if whole is not None and not whole.isEmpty():
        uncut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(whole.select("doc_id").distinct(), "doc_id", "left_anti")
        docs = _scratch.write_table(_firsts(docs, classes(uncut.unionByName(whole.select("doc_id", "text")), threshold)), "kept")
    return _firsts(docs, classes(docs, threshold))


def _firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    kept = found.where("doc_id = class_id").select("doc_id").distinct()
    at = docs.columns.index("doc_id")
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    known = numbered.join(kept, numbered[f"c{at}"].cast("long") == kept["doc_id"], "left_semi")
    return known.union(numbered.where(F.col(f"c{at}").isNull())).toDF(*docs.columns)


def before_cuts(docs: DataFrame, originals: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents whose text is what is left of their original: it differs
    from that of the same doc_id in ``originals``, and its words, one at least, stand there in the same order."""
    slim = lambda df: df.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    now = slim(docs)
    prints = lambda df, k: df.groupBy("id").agg(F.min(F.md5("text")).alias(f"lo{k}"), F.max(F.md5("text")).alias(f"hi{k}"), F.count("*").alias(f"n{k}"))
    # some text of the identifier here differs from one there; rows of equal identifiers never meet in pairs
    changed = prints(now, 0).join(prints(slim(originals), 1), "id").where("least(lo0, lo1) <> greatest(hi0, hi1)").select("id", F.expr("n0 > 1 or n1 > 1").alias("repeats"))
    changed = _scratch.write_table(changed, "changed")
    once = not changed.where("repeats").isEmpty()
    held = _texts(originals, changed.select("id"), once)
    both = held.hint("merge").join((_once(now.join(changed.select("id"), "id", "left_semi")) if once else now).withColumnRenamed("text", "left"), "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for i, (left, original) in enumerate(zip(tx.column(b, "left").to_pylist(), tx.column(b, "text").to_pylist(), strict=True)):
                words, ahead = left.split(), iter(original.split())
                if words and left != original and all(word in ahead for word in words):
                    ok.append(i)
            yield b.take(pa.array(ok, pa.int64())).select(["id", "text"])

    out = both.select("id", "text", "left").mapInArrow(cut, "id long, text string")
    return _scratch.write_table(out.withColumnRenamed("id", "doc_id"), "whole")
