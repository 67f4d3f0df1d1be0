"""Exact tokenisation with the tokenizers library, calling it once per distinct chunk.

Both supported tokenizer families split a text into pieces before they apply merges,
and no piece crosses the chunk borders used here, so the ids of a text are the ids of
its chunks joined. Each Python worker keeps the ids of the chunks it has met, up to a
fixed number.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from . import _text as tx

CACHE_CHUNKS = 1_500_000
SLOTS = 1 << 22
_ready: dict[str, "ChunkTokenizer"] = {}


def tokenizer(path: str) -> "ChunkTokenizer":
    if path not in _ready:
        _ready[path] = ChunkTokenizer(path)
    return _ready[path]


class ChunkTokenizer:
    """Ids of whole columns of text.

    A chunk is a run of non-white bytes; for byte-level vocabularies it takes along
    one blank before it, and the rest of the white space forms chunks of its own.
    Any other kind of tokenizer, and texts with white space beyond ASCII under the
    byte-level split, are given to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        kinds = [x.get("type") for x in pre.get("pretokenizers", [pre])]
        plain = not spec.get("normalizer")
        if plain and kinds == ["ByteLevel"] and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.split = "blank"
        elif kinds == ["Split", "ByteLevel"] and "\\s" in json.dumps(pre["pretokenizers"][0].get("pattern", {})) and pre["pretokenizers"][0].get("invert"):
            self.split = "words"
        else:
            self.split = "whole"
        self._clear()

    def _clear(self) -> None:
        self.count = 0
        self.keys = np.zeros(SLOTS, np.uint64)
        self.entry = np.full(SLOTS, -1, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.begin = np.zeros(1 << 16, np.int32)
        self.length = np.zeros(1 << 16, np.int32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Cache entries of the keys, -1 where there is none. Open addressing with
        linear steps; all keys take a step together until each is settled."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            entry, own = self.entry[slot], self.keys[slot] == keys[left]
            found = own & (entry >= 0)
            out[left[found]] = entry[found]
            on = ~found & (entry >= 0)
            left, slot = left[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        encoded = self._encode(texts)
        n, first = len(encoded), self.count
        lengths = np.fromiter(map(len, encoded), np.int64, n)
        total = int(lengths.sum())
        while first + n > len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
            self.length = np.concatenate((self.length, np.zeros_like(self.length)))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + total] = [i for ids in encoded for i in ids]
        self.begin[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + n] = lengths
        self.used += total
        self.count += n
        slots = (keys & np.uint64(SLOTS - 1)).tolist()
        entry, held = self.entry, self.keys
        for i, (slot, key) in enumerate(zip(slots, keys.tolist(), strict=True)):
            while entry[slot] >= 0:
                slot = (slot + 1) & (SLOTS - 1)
            entry[slot], held[slot] = first + i, key

    def _blank_chunks(self, buf, offsets, starts, ends, rows):
        """Chunk starts and ends in text order, words with a blank before them."""
        first = starts > offsets[rows]
        lead = first.copy()
        lead[first] = buf[starts[first] - 1] == 0x20
        begin = starts - lead
        # white runs: before each word, and at the end of each text
        run_from = offsets[rows].copy()
        same = np.flatnonzero(rows[1:] == rows[:-1]) + 1
        run_from[same] = ends[same - 1]
        tail_from = offsets[:-1].copy()
        tail_from[rows] = ends  # rows ascend: the last word of a row is written last
        long = begin - run_from
        plain = np.flatnonzero((long > 0) & lead)
        apart = np.flatnonzero((long > 0) & ~lead)
        several = apart[long[apart] > 1]
        tails = np.flatnonzero(offsets[1:] > tail_from)
        s = np.concatenate((begin, run_from[plain], begin[apart] - 1, run_from[several], tail_from[tails]))
        e = np.concatenate((ends, begin[plain], begin[apart], begin[several] - 1, offsets[1:][tails]))
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    def _wide_space(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold white space other than the six ASCII characters."""
        n = len(buf)
        hit = (buf >= 0x1C) & (buf <= 0x1F)
        b = np.concatenate((buf, np.zeros(2, np.uint8)))
        for lead in (0xC2, 0xE1, 0xE2, 0xE3):
            at = np.flatnonzero(buf == lead)
            one, two = b[at + 1], b[at + 2]
            if lead == 0xC2:
                found = (one == 0x85) | (one == 0xA0)
            elif lead == 0xE1:
                found = ((one == 0x9A) & (two == 0x80)) | (one == 0xA0)
            elif lead == 0xE2:
                found = ((one == 0x80) & ((two <= 0x8F) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))) | ((one == 0x81) & (two == 0x9F))
            else:
                found = (one == 0x80) & (two == 0x80)
            hit[at[found]] = True
        at = np.flatnonzero(hit[:n])
        return np.unique(np.searchsorted(offsets, at, "right") - 1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all rows, joined, and row bounds into them."""
        buf, offsets = tx.text_buffer(column)
        n = len(offsets) - 1
        if self.split == "whole":
            return self._whole(column)
        if self.count > CACHE_CHUNKS:
            self._clear()
        starts, ends, rows = tx.spans(buf, offsets, tx.SPACE)
        odd = np.zeros(0, np.int64)
        if self.split == "blank":
            odd = self._wide_space(buf, offsets)
            starts, ends = self._blank_chunks(buf, offsets, starts, ends, rows)
        keys = tx.span_hashes(buf, starts, ends, tx.RAW)
        slot = self._find(keys)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            distinct, first = np.unique(keys[missing], return_index=True)
            at = missing[first]
            raw = buf.tobytes()
            self._learn(distinct, [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slot[missing] = self._find(keys[missing])
        length = self.length[slot]
        upto = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
        ids = self.pool[np.arange(upto[-1]) + np.repeat(self.begin[slot] - upto[:-1], length)]
        bounds = upto[np.searchsorted(starts, offsets, "left")]
        if not len(odd):
            return ids, bounds
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(n)]
        for i, got in zip(odd.tolist(), self._encode([buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in odd.tolist()]), strict=True):
            parts[i] = np.array(got, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = self._encode([x or "" for x in column.to_pylist()])
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int64)
        return np.array([i for x in got for i in x], np.uint32), bounds
