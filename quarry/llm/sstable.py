"""Token-ID output as sorted-string-table shards.

A shard holds the documents of one key range, ascending. Layout, little-endian:

    data blocks   entries of varint shared, varint unshared, varint value bytes,
                  the key bytes not shared with the entry before, the ids
    block index   per block: first key (13 bytes), u64 offset, u32 bytes, u32 crc32
    Bloom filter  bits over the keys' identifiers
    footer        u64 index offset, u64 filter offset, u64 entries, u64 ids,
                  u32 blocks, u32 filter words, u8 id width, u8 hashes, 6 zero bytes,
                  8 magic bytes

A key is one tag byte (0: null identifier, 1: any other), the identifier as a big-endian
64-bit number with its sign bit flipped, and a big-endian 32-bit ordinal that tells apart
the rows of a repeated identifier in a shard. Key order is byte order. Lookup tests the filter,
finds the block by binary search of the index, and reads that block alone.

Shards are ranges of identifier, hash of the text and place among equal rows, so that a repeated
identifier may go on in the next shard; there are as many as keep a shard near ``SHARD_TEXT``
bytes of text.

Each task writes its shard under a name of its own; the manifest names the files of the
tasks that were committed, so a task that is run again harms nothing. Spark's shared folder
is opened through pyarrow.fs, which takes the folder's own URI.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _scratch, _tokens
from . import _text as tx

MAGIC = b"QRYSST01"
FOOTER = struct.Struct("<QQQQIIBB6x8s")
INDEX = struct.Struct("<13sQII")
BLOCK_BYTES = 16 << 10
SHARD_TEXT = 128 << 20
EQUAL_WAYS = 4096  # ways to deal equal rows
BITS_PER_KEY, HASHES = 10, 7
MANIFEST = "shard int, path string, entries long, n_ids long"
ENTRIES = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None, ordinal: int) -> bytes:
    if doc_id is None:
        return b"\0" + bytes(8) + struct.pack(">I", ordinal)
    return b"\1" + struct.pack(">QI", (doc_id + (1 << 63)) & ((1 << 64) - 1), ordinal)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(ids: np.ndarray, words: int) -> np.ndarray:
    """Bit numbers, one row per hash."""
    h = tx.mix64(ids.astype(np.uint64))
    step = tx.mix64(h) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) % np.uint64(words * 64) for k in range(HASHES)])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one shard; entries must come in key order."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[bytes] = []
        self.at = self.n_ids = 0
        self.ids: list[int] = []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), len(key))
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.n_ids += len(ids)
        self.ids.append(0 if key[0] == 0 else struct.unpack(">Q", key[1:9])[0])
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append(INDEX.pack(self.first, self.at, len(self.block), zlib.crc32(self.block)))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        words = max(1, -(-len(self.ids) * BITS_PER_KEY // 64))
        bits = np.zeros(words * 64, bool)
        if self.ids:
            bits[_probes(np.array(self.ids, np.uint64), words).ravel().astype(np.int64)] = True
        index = b"".join(self.index)
        self.out.write(index)
        self.out.write(np.packbits(bits, bitorder="little").tobytes())
        self.out.write(FOOTER.pack(self.at, self.at + len(index), len(self.ids), self.n_ids, len(self.index), words, self.width, HASHES, MAGIC))


class Reader:
    """Lookup and ordered iteration over one shard."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        self.index_at, self.filter_at, self.entries, self.n_ids, blocks, self.words, self.width, _, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        raw = self._at(self.index_at, blocks * INDEX.size)
        self.index = [INDEX.unpack_from(raw, i * INDEX.size) for i in range(blocks)]
        self.firsts = [x[0] for x in self.index]
        self.bits = None

    def _at(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, n, crc = self.index[k]
        data = self._at(offset, n)
        if zlib.crc32(data) != crc:
            raise ValueError("damaged block")
        at, key = 0, b""
        while at < n:
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier."""
        if self.bits is None:
            self.bits = np.unpackbits(np.frombuffer(self._at(self.filter_at, self.words * 8), np.uint8), bitorder="little")
        low = key_of(doc_id, 0)
        hashed = 0 if doc_id is None else struct.unpack(">Q", low[1:9])[0]
        if not self.bits[_probes(np.array([hashed], np.uint64), self.words).ravel().astype(np.int64)].all():
            return []
        found, k = [], max(0, bisect_right(self.firsts, low) - 1)
        while k < len(self.index) and self.firsts[k][:9] <= low[:9]:
            found += [ids for key, ids in self._block(k) if key[:9] == low[:9]]
            k += 1
        return found


def shard_count(docs: DataFrame) -> int:
    """Shards of about ``SHARD_TEXT`` bytes of text, and as many as the session's partitions at least."""
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_TEXT))


def write(docs: DataFrame, tokenizer_path: str, end_id: int, where: str, shards: int | None = None) -> DataFrame:
    """Tokenise ``docs`` and write shards below ``where`` (a URI that all executors
    share); the manifest, one row per shard, is written and read back.

    Defined results: a null or empty text has the end id alone; repeated identifiers are
    kept, ordered by a hash of the text; null identifiers sort first; an empty table makes no shard."""
    spark = docs.sparkSession
    n = shards or shard_count(docs)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = _tokens.tokenizer(tokenizer_path)
        width = 2 if max(tok.tok.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        shard, uri = TaskContext.get().partitionId(), f"{where}/{uuid.uuid4().hex}.sst"
        writer, out, last, ordinal = None, None, object(), 0
        for b in tx.slices(batches):
            if writer is None:
                files, path = _open(uri)
                files.create_dir(path.rpartition("/")[0], recursive=True)
                out = files.open_output_stream(path)
                writer = Writer(out, width)
            ids, bounds = tok.encode(tx.column(b, "text"))
            for i, doc_id in enumerate(tx.column(b, "doc_id").to_pylist()):
                ordinal = ordinal + 1 if doc_id == last else 0
                last = doc_id
                writer.add(key_of(doc_id, ordinal), np.append(ids[bounds[i] : bounds[i + 1]], end_id))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([len(writer.ids)]), pa.array([writer.n_ids])], names=["shard", "path", "entries", "n_ids"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = slim.select("*", F.xxhash64("text").alias("h"), (F.monotonically_increasing_id() % EQUAL_WAYS).alias("way"))
    order = F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("way")
    ordered = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return _scratch.write_table(ordered.mapInArrow(put, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """All entries of the shards: ``doc_id``, ids before it over all shards, count, crc32."""
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(upto), F.lit(0)).alias("before"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, before in zip(tx.column(b, "path").to_pylist(), tx.column(b, "before").to_pylist(), strict=True):
                rows: list[tuple] = []
                for key, ids in Reader(uri):
                    rows.append((id_of(key), before, len(ids), zlib.crc32(ids.astype("<u4"))))
                    before += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n).mapInArrow(scan, ENTRIES)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """Ids of one document, by filter and binary search in each shard (a point query
    from the driver; it reads footers, indexes and filters, and one block per hit)."""
    return [ids for row in manifest.select("path").toLocalIterator() for ids in Reader(row["path"]).get(doc_id)]
