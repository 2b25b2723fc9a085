"""Vectorised text kernels shared by the operators of this subpackage.

Every kernel works on one block of whole texts (half a MB of UTF-8 bytes held
in numpy arrays, some of 8 bytes a byte), so a task's memory is bounded by the block size or by its
longest single text, whichever is larger.  Nothing is cut: a text longer than
the block size makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_M31 = np.uint64((1 << 31) - 1)
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240607)
# two polynomial hashes modulo the prime 2^31 - 1: a base and a table of byte values for each
_BASES = [int(x) for x in _rng.integers(1 << 20, (1 << 31) - 2, 2)]
_BYTES = [_rng.integers(1, (1 << 31) - 1, 256).astype(np.uint64) for _ in _BASES]

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _fold31(x: np.ndarray) -> np.ndarray:
    """A value congruent modulo 2^31 - 1, below 2^32 for factors below 2^31."""
    return (x & _M31) + (x >> np.uint64(31))


def _mod31(x: np.ndarray) -> np.ndarray:
    x = _fold31(_fold31(_fold31(x)))
    return np.where(x >= _M31, x - _M31, x)


def _pow(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^31 - 1."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        out = np.ones(size, np.uint32)
        done = 1
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = _mod31(out[:more].astype(np.uint64) * np.uint64(pow(base, done, int(_M31))))
            done += more
        if size > 16 * BLOCK_BYTES:  # one very long text: do not keep its tables
            return out
        _powers[base] = have = out
    return have


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """SplitMix finaliser: one order-destroying permutation of 64-bit values per seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & _MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Block:
    """Consecutive texts: ``buf`` bytes, text ``i`` is ``buf[offs[i]:offs[i + 1]]``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, row0: int):
        self.buf, self.offs, self.row0 = buf, offs, row0
        self._prefix: list[np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.offs) - 1

    def lowered(self) -> Block:
        """ASCII A-Z lower-cased, nothing else touched."""
        return Block(LOWER[self.buf], self.offs, self.row0)

    def runs(self, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, first word of each text) of the maximal runs without ``gap`` bytes (ASCII white space)."""
        n = len(self.buf)
        ink = ~gap[self.buf]
        edge = np.zeros(n + 1, bool)
        edge[self.offs] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, ink[:-1]
            after[-1], after[:-1] = False, ink[1:]
        start = np.flatnonzero(ink & (~before | edge[:n]))
        end = np.flatnonzero(ink & (~after | edge[1:])) + 1
        return start, end, np.searchsorted(start, self.offs)

    def _sums(self) -> list[np.ndarray]:
        """For each base the running sums of byte value * base^place (below 2^32 a byte, so they do not wrap)."""
        if self._prefix is None:
            self._prefix = []
            for base, table in zip(_BASES, _BYTES):
                n = len(self.buf)
                pre, power = np.zeros(n + 1, np.uint64), _pow(base, n + 1)
                for lo in range(0, n, 1 << 16):  # in pieces: no other array of the block's length
                    part = table[self.buf[lo : lo + (1 << 16)]]
                    part *= power[lo : lo + len(part)]
                    np.cumsum(_fold31(part), out=pre[lo + 1 : lo + 1 + len(part)])
                    pre[lo + 1 : lo + 1 + len(part)] += pre[lo]
                self._prefix.append(pre)
        return self._prefix

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit content hash of each byte span (same bytes, same hash, anywhere).

        Two polynomials modulo a prime with bases from a fixed seed, so tasks and
        reruns agree: two spans of n bytes collide with a chance of (n / 2^31)^2,
        whatever their bytes.  Callers that return what a hash led to compare bytes.
        """
        out = np.zeros(len(start), np.uint64)
        for base, pre, shift in zip(_BASES, self._sums(), (0, 31)):
            back = _pow(pow(base, -1, int(_M31)), len(self.buf) + 1)[start]
            out |= _mod31(_mod31(pre[end] - pre[start]) * back) << np.uint64(shift)
        with np.errstate(over="ignore"):
            return mix64(out + mix64((end - start).astype(np.uint64), 41))

    def rolling(self, window: int) -> np.ndarray:
        """Hash of the ``window`` bytes before each place from ``window`` on."""
        base, pre = _BASES[0], self._sums()[0]
        back = _pow(pow(base, -1, int(_M31)), len(self.buf) + 1)[: len(self.buf) + 1 - window]
        return mix64(_mod31(_mod31(pre[window:] - pre[:-window]) * back))

    def same_bytes(self, start: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` bytes at ``start`` equal those at ``other``, span by span."""
        step = np.repeat(other - start, size)
        at = np.arange(len(step)) + np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) if len(step) else np.zeros(0, np.int64)
        wrong = np.flatnonzero(self.buf[at] != self.buf[at + step])
        ok = np.ones(len(start), bool)
        ok[np.searchsorted(np.cumsum(size), wrong, "right")] = False
        return ok


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of whole texts."""
    if len(column) == 0:
        return
    buf, offs = text_arrays(column)
    lo, rows = 0, len(offs) - 1
    while lo < rows:
        hi = int(np.searchsorted(offs, offs[lo] + block_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield Block(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo)
        lo = hi


def words_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text); words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    low = block.lowered()
    start, end, first = low.runs()
    return low.hashes(start, end), first


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of one text; fewer words make one shingle, none makes none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    w = min(k, n)
    with np.errstate(over="ignore"):
        h = np.full(n - w + 1, np.uint64(w), np.uint64)
        for i in range(w):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : n - w + 1 + i]
    return np.unique(mix64(h))


def crc32_mod(column: str, m: int):
    """Spark column: crc32(doc_id as text) mod m; a null id counts as the empty text."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(m))
