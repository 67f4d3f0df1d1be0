"""CRC-32 of many byte spans at once, and of spans joined together.

The checksum is linear over GF(2): that of two joined spans is the first one's, shifted by the second one's length,
exclusive-or the second one's. Shifts by up to 63 bytes are looked up; longer ones add shifts by powers of two.
"""

from __future__ import annotations

import zlib

import numpy as np

_SHORT = 64


def _bytes_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_T = _bytes_table()


def _apply(op: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear operator, given as four tables by byte, on checksums."""
    return op[0][c & 255] ^ op[1][(c >> 8) & 255] ^ op[2][(c >> 16) & 255] ^ op[3][c >> 24]


def _short_shifts() -> np.ndarray:
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [now]
    for _ in range(_SHORT):
        now = _T[now & 255] ^ (now >> np.uint32(8))
        out.append(now)
    return np.stack(out)


_SHIFT = _short_shifts()
_FLAT = _SHIFT.reshape(-1)
_doubled = {6: _SHIFT[_SHORT]}


def _by_power(bit: int) -> np.ndarray:
    if bit not in _doubled:
        half = _by_power(bit - 1)
        _doubled[bit] = np.stack([_apply(half, t) for t in half])
    return _doubled[bit]


def shifted(c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums moved on by so many zero bytes each."""
    at = (lengths & 63) << 10
    out = _FLAT[at + (c & 255)] ^ _FLAT[at + 256 + ((c >> 8) & 255)] ^ _FLAT[at + 512 + ((c >> 16) & 255)] ^ _FLAT[at + 768 + (c >> 24)]
    rest = lengths >> 6
    bit = 6
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _apply(_by_power(bit), out[odd])
        rest, bit = rest >> 1, bit + 1
    return out


def spaced(c: np.ndarray) -> np.ndarray:
    """Checksums of the same bytes and a space."""
    c = ~c
    return ~(_T[(c ^ np.uint32(0x20)) & 255] ^ (c >> np.uint32(8)))


def of_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksum of each span of ``buf``."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, down = starts[order], -sizes[order]
    c = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(min(_SHORT, -int(down[0]) if len(down) else 0)):
        m = int(np.searchsorted(down, -k, "left"))
        c[:m] = _T[(c[:m] ^ buf[at[:m] + k]) & 255] ^ (c[:m] >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = ~c
    for i in np.flatnonzero(sizes > _SHORT):
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes())
    return out
