"""Tokenizer units: text spans whose encoding does not depend on their neighbours.

Both vocabularies first cut a text by a pattern that never joins ink across
white space, so a text cut at the right white space encodes piece by piece:

* ``word_units``: maximal runs without ASCII white space.  The word-end
  vocabulary drops white space altogether.
* ``space_units``: cut before each ASCII white space that follows ink.  The
  byte-level vocabulary keeps white space (at the front of a unit).  After a
  byte that may end a wider Unicode white space no cut is made.

``UnitMemo`` encodes each distinct unit once and keeps the ids for later
blocks and tasks of the same worker, up to a fixed number of entries.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np

from runlens.llm.textblocks import WHITE, Block

MEMO_ENTRIES = 1 << 19


def word_units(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return b.runs()


def space_units(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, n = b.buf, len(b.buf)
    cut = np.zeros(n + 1, bool)
    if n:
        white = WHITE[buf]
        cut[1:n] = white[1:] & ~white[:-1]
        high = np.flatnonzero(cut[:n] & np.r_[False, buf[:-1] >= 0x80])
        before = lambda k: np.where(high >= k, buf[np.maximum(high - k, 0)], 0)
        wide = ((before(2) == 0xC2) & np.isin(before(1), (0x85, 0xA0))) | np.isin(before(3), (0xE1, 0xE2, 0xE3))
        cut[high[wide]] = False
    filled = b.offs[:-1][np.diff(b.offs) > 0]
    cut[filled] = True
    start = np.flatnonzero(cut[:n])
    return start, np.r_[start[1:], n] if len(start) else start, np.searchsorted(start, b.offs)


class UnitMemo:
    """hash and bytes of a unit -> its ids (little-endian uint32 bytes) and, if asked for, its decoded bytes."""

    def __init__(self, encode, decode=None, entries: int = MEMO_ENTRIES):
        self.encode, self.decode, self.entries = encode, decode, entries
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.ids, self.raw = np.empty(1024, object), np.empty(1024, object)
        self.out = np.empty(1024, object) if self.decode else None

    def lookup(self, b: Block, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index into ``ids`` / ``out`` of each unit of a block (valid until the next call).

        A hash only proposes an entry: units are compared byte by byte with the
        first of their hash in the block, and that one with the memo's bytes.
        Whatever differs gets an entry of its own, without a place in the memo.
        """
        if not len(start):
            return np.zeros(0, np.int64)
        uniq, first, inverse = np.unique(b.hashes(start, end), return_index=True, return_inverse=True)
        lead = first[inverse]
        size = end - start
        alike = size == size[lead]
        alike[alike] = b.same_bytes(start[alike], start[lead[alike]], size[alike])
        if self.used > self.entries:
            self._clear()
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == uniq[inside]
        raw = b.buf.tobytes()
        hit = np.flatnonzero(known)
        place = np.zeros(len(uniq), np.int64)
        place[hit] = self.place[at[hit]]
        spans = list(zip(start[first].tolist(), end[first].tolist()))
        clash = [u for u, p in zip(hit.tolist(), place[hit].tolist()) if raw[spans[u][0] : spans[u][1]] != self.raw[p]]
        odd = np.flatnonzero(~alike).tolist()
        new = np.flatnonzero(~known)
        own = [spans[u] for u in clash] + [(int(start[i]), int(end[i])) for i in odd]
        if len(new) or own:
            units = [raw[i:j] for i, j in [spans[u] for u in new.tolist()] + own]
            made = self.encode([u.decode("utf-8") for u in units])
            self._grow(self.used + len(units))
            for k, (unit, ids) in enumerate(zip(units, made), self.used):
                self.raw[k] = unit
                self.ids[k] = array("I", ids).tobytes()
                if self.decode:
                    self.out[k] = self.decode(ids)
            fresh = np.arange(self.used, self.used + len(units))
            place[new] = fresh[: len(new)]
            place[clash] = fresh[len(new) : len(new) + len(clash)]
            self.place = np.insert(self.place, at[new], fresh[: len(new)])
            self.keys = np.insert(self.keys, at[new], uniq[new])
            self.used += len(units)
        got = place[inverse]
        got[odd] = np.arange(self.used - len(odd), self.used)
        return got

    def _grow(self, n: int) -> None:
        if n > len(self.ids):
            for name in ("ids", "raw", "out"):
                have = getattr(self, name)
                if have is not None:
                    more = np.empty(max(n, 2 * len(have)), object)
                    more[: len(have)] = have
                    setattr(self, name, more)


def plain_tokenizer(path: str):
    """The tokenizers library's tokenizer without truncation and padding, one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def library_encoder(path: str):
    t = plain_tokenizer(path)
    return lambda units: [e.ids for e in t.encode_batch_fast(units, add_special_tokens=False)]


def byte_encoder(path: str, ranks_path: str | None = None, pattern: str | None = None):
    """ids as the tokenizers library gives them.  With a rank file of the same
    vocabulary, units of long-settled scripts (below U+0590) without ``<|`` go
    to the faster reader of that file; all others to the library itself."""
    slow = library_encoder(path)
    if not ranks_path:
        return slow
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
    fast = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def encode(units: list[str]) -> list[list[int]]:
        out: list = [None] * len(units)
        rest = []
        for i, u in enumerate(units):
            if "<|" not in u and (u.isascii() or max(u) < "֐"):
                out[i] = fast(u)
            else:
                rest.append(i)
        for i, ids in zip(rest, slow([units[i] for i in rest])):
            out[i] = ids
        return out

    return encode


_memos: dict = {}


def shared_memo(key, make):
    """One memo for each worker process and key: later tasks of the worker reuse what earlier ones encoded."""
    if key not in _memos:
        _memos[key] = make()
    return _memos[key]


def drop_memos() -> None:
    """For tasks that use none: a worker goes from one operator's tasks to the next one's, a memo would stay in its memory."""
    _memos.clear()
