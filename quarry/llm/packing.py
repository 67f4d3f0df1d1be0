"""Best-fit packing: token sequences filled by patterns of document lengths.

Documents are tokenised once; what then moves is lengths only. The histogram of piece
lengths has at most ``capacity`` bins, whatever the corpus, so the plan is made on the
driver: patterns of one to three lengths that fill a sequence exactly get repeat counts
by non-negative least squares against the histogram, counts are rounded, and what is
left over goes by best fit, longest first, run-length grouped by histogram bin. Pieces
find their place by their rank among pieces of equal length; ranks come from running
counts within each written part and prefix sums over parts, so no length, however
common, meets in one task.

Defined results: a null or empty text is the end token alone. A repeated row or doc_id is
packed once per row. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _scratch, _tokens
from . import _text as tx

#: Second lengths of three-part patterns are multiples of capacity / this.
TRIPLE_GRID = 128
NNLS_STEPS = 300

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


# ---------------------------------------------------------------- the plan


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Ascending triples of lengths (0: none) that add up to ``capacity``."""
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    a = np.arange(1, capacity // 2 + 1)
    pairs = a[has[a] & has[capacity - a]]
    out = [np.stack((np.zeros_like(pairs), pairs, capacity - pairs), 1)]
    if has[capacity]:
        out.append(np.array([[0, 0, capacity]]))
    grid = max(1, capacity // TRIPLE_GRID)
    b = np.arange(1, capacity // 2 + 1)
    b = b[has[b] & (b % grid == 0)]
    a = present[present <= capacity // 3]
    if len(a) and len(b):
        x, y = (v.ravel() for v in np.meshgrid(a, b, indexing="ij"))
        z = capacity - x - y
        ok = (x <= y) & (z >= y) & has[np.maximum(z, 0)]
        out.append(np.stack((x[ok], y[ok], z[ok]), 1))
    return np.concatenate(out)


def nnls(parts: np.ndarray, histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Repeat counts x >= 0 minimising the weighted squares of A x - histogram, by
    accelerated projected gradients; A[l, p] is how often pattern p holds length l."""
    if not len(parts):
        return np.zeros(0)
    weight = np.arange(capacity + 1) / capacity  # what is short fits into any gap later
    weight[0] = 0
    flat = parts.ravel()

    def forward(x):
        return np.bincount(flat, np.repeat(x, 3), capacity + 1)

    def back(y):
        return y[parts].sum(1)

    v = np.ones(len(parts))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(weight * forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(parts))
    t = 1.0
    for _ in range(NNLS_STEPS):
        nxt = np.maximum(0, y - step * back(weight * (forward(y) - histogram)))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
    return x


def plan(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ascending; a row holds for
    the ranks up to the next row of its length. Rank r goes to sequence
    ``first sequence + r - first rank``."""
    left = histogram.astype(np.int64).copy()
    filled: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        filled.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    parts = patterns(np.flatnonzero(left), capacity)
    x = nnls(parts, left, capacity)
    for i in np.argsort(-x, kind="stable"):
        n = int(np.floor(x[i] + 0.5))
        if n <= 0:
            break
        lengths, times = np.unique(parts[i][parts[i] > 0], return_counts=True)
        n = min(n, int((left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            filled.append((tuple(int(v) for v in parts[i][::-1] if v), n))
    filled += best_fit(left, capacity)
    rows, sequence, rank = [], 0, np.zeros(capacity + 1, np.int64)
    for lengths, n in filled:
        offset = 0
        for length in lengths:
            rows.append((length, rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    out = np.array(rows, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over equal pieces and equally filled sequences at once."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_rooms = np.zeros(capacity + 1, bool)

    def put(room: int, group: tuple[tuple[int, ...], int]) -> None:
        by_room.setdefault(room, []).append(group)
        open_rooms[room] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            rooms = np.flatnonzero(open_rooms[length:])
            if not len(rooms):
                each = min(capacity // length, n)
                whole = n // each
                put(capacity - each * length, ((length,) * each, whole))
                n -= whole * each
                continue
            room = int(rooms[0]) + length
            held, count = by_room[room].pop()
            if not by_room[room]:
                open_rooms[room] = False
            each = min(room // length, max(1, n // count))
            used = min(count, n // each)
            put(room - each * length, (held + (length,) * each, used))
            if count > used:
                put(room, (held, count - used))
            n -= used * each
    return [g for groups in by_room.values() for g in groups]


# ---------------------------------------------------------------- the operator


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and its place among
    pieces of its length in the part that it was written with (``part, nth``). A document
    over ``capacity`` is cut so that all pieces but the first are full."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part = _tokens.tokenizer(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in tx.slices(batches):
            ids, bounds = tok.encode(tx.column(b, "text"))
            n = np.diff(bounds) + 1
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * capacity
            start = np.where(nth == 0, 0, head[doc] + (nth - 1) * capacity)
            length = np.where(nth == 0, head[doc], capacity)
            raw = ids.astype("<u4")
            end = np.array([end_id], "<u4").tobytes()
            crc = np.empty(len(doc), np.int64)
            for k, (d, s, m) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
                at, last = bounds[d] + s, bounds[d + 1]
                code = zlib.crc32(raw[at : min(at + m, last)])
                crc[k] = zlib.crc32(end, code) if at + m > last else code
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            within = np.arange(len(order)) - np.searchsorted(ordered, ordered, "left")
            rank = np.empty(len(order), np.int64)
            rank[order] = seen[ordered] + within
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.record_batch(
                [tx.column(b, "doc_id").take(pa.array(doc)), pa.array(nth, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Place every piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = _scratch.write_table(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = cut.groupBy("length", "part").count()
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    rows = plan(histogram, capacity)
    keys = (rows[:, 0] << 44) + rows[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda name: tx.column(b, name).to_numpy()
            rank = get("before") + get("nth")
            at = np.searchsorted(keys, (get("length") << 44) + rank, "right") - 1
            yield pa.record_batch(
                [*(tx.column(b, k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    return cut.join(before, ["length", "part"]).mapInArrow(place, PLACED)


def materialise(placed: DataFrame, docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` (array of int). A sequence is
    at most ``capacity`` ids, so grouping by it is bounded. doc_id must be unique here."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokens.tokenizer(tokenizer_path)
        for b in tx.slices(batches):
            ids, bounds = tok.encode(tx.column(b, "text"))
            each = [np.append(ids[bounds[i] : bounds[i + 1]], end_id).astype(np.int32) for i in range(b.num_rows)]
            yield pa.record_batch([tx.column(b, "doc_id"), pa.array(each, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>")
    part = F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int"))
    return (
        placed.join(encoded, "doc_id")
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", part.alias("ids")))), lambda x: x["ids"])).alias("ids"))
    )
