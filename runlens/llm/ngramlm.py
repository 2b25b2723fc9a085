"""Language-model scoring with an Elias-Fano n-gram trie.

The corpus' n-grams are dealt to shards by hash, so no n-gram, however
frequent, and no context makes one task large: a block of texts sends each
distinct n-gram once, with its training count.  A shard adds the counts up,
builds its part of the trie as Elias-Fano levels in a memory-mapped file and
answers the blocks' queries from it:

* contexts: the monotone sequence of context hashes;
* pointers: the monotone sequence of where each context's successors begin;
* successors: made monotone by going on, in each context's range, from the last
  value of the range before.  A query finds its context, takes the range
  from the pointers and searches the successor in that range, relative to
  the value before it;
* one byte a bigram: its joint probability, quantised in steps of 1/8 bit.

Word counts are looked up the same way in a one-level trie and kept exact
(the base score needs them).  The unigram distribution is discounted
absolutely, the mass that is taken off goes to the unknown word:
p(w) = (c - D) / N, p(unknown) = D V / N, quantised in steps of 1/64 of a
decade.  A token costs log10(L p(w | v) + (1 - L) p(w)), v being the token
before (the end token before the first word), or p(w) alone after an unknown v.

Texts are learned from if ``train`` is true; null texts are empty and have the
end token alone.  Extra columns are ignored, repeated rows count each time.
Training counts cover all training texts, nothing is pruned or capped.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.jobs import parts_for, prepare
from runlens.llm.textblocks import blocks, crc32_mod, mix64, words_of
from runlens.session import cut_lineage

END = np.uint64(0xE17D0FD0C5)
WEIGHT = 0.15
BLOCK_TOKENS = 1 << 22
SLICE_TOKENS = 1 << 18
SHARD_KEYS = 2_000_000


class EliasFano:
    """A sorted sequence of integers: low bits packed, high bits in unary with a rank directory."""

    def __init__(self, values: np.ndarray, universe: int, path: str):
        n = len(values)
        self.n, self.low_bits = n, min(56, (universe // max(1, n) or 1).bit_length() - 1)  # 56: read as 8 bytes at any bit
        values = values.astype(np.uint64)
        lows = values & np.uint64((1 << self.low_bits) - 1)
        packed = np.zeros((n * self.low_bits + 7) // 8 + 8, np.uint8)
        for at in range(0, n, 1 << 16):  # a multiple of eight values begins on a byte
            part = lows[at : at + (1 << 16)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : self.low_bits]
            b = np.packbits(bits.ravel(), bitorder="little")
            packed[at * self.low_bits // 8 :][: len(b)] = b
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        length = n + (int(high[-1]) if n else 0) + 2
        unary = np.zeros(-(-length // 64) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        words = np.packbits(unary, bitorder="little").view(np.uint64)
        zeros = np.zeros(len(words) + 1, np.int64)
        np.cumsum(64 - np.bitwise_count(words).astype(np.int64), out=zeros[1:])
        for name, data in (("low", packed), ("high", words), ("zeros", zeros.astype(np.uint32))):
            data.tofile(f"{path}.{name}")
            setattr(self, name, np.memmap(f"{path}.{name}", data.dtype, "r"))
        self.top = int(high[-1]) if n else -1

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        near = np.lib.stride_tricks.as_strided(np.frombuffer(self.low, np.uint8)[:8].view(np.uint64), (len(self.low) - 7,), (1,))
        return (near[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero bit."""
        w = np.searchsorted(self.zeros, k, "right") - 1
        rest, x, pos = k - self.zeros[w].astype(np.int64), ~self.high[w], w * 64
        for step in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(x & np.uint64((1 << step) - 1)).astype(np.int64)
            go = c <= rest
            rest -= c * go
            x >>= (step * go).astype(np.uint64)
            pos = pos + step * go
        return pos

    def find(self, targets: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of each target (int64), -1 where the sequence lacks it; with ``lo`` and ``hi`` only places in that range count."""
        targets = targets.astype(np.uint64)
        out = np.full(len(targets), -1, np.int64)
        bucket = (targets >> np.uint64(self.low_bits)).astype(np.int64)
        live = np.flatnonzero(bucket <= self.top)
        if not len(live):
            return out
        bucket = bucket[live]
        s = np.where(bucket > 0, self._zero(np.maximum(bucket - 1, 0)) + 1 - bucket, 0)
        e = self._zero(bucket) - bucket
        if lo is not None:
            s, e = np.maximum(s, lo[live]), np.minimum(e, hi[live])
        want = targets[live] & np.uint64((1 << self.low_bits) - 1)
        end = e.copy()
        go = np.flatnonzero(s < e)
        while len(go):  # low bits ascend inside a bucket
            mid = (s[go] + e[go]) >> 1
            less = self._low(mid) < want[go]
            s[go[less]] = mid[less] + 1
            e[go[~less]] = mid[~less]
            go = go[s[go] < e[go]]
        at = np.flatnonzero(s < end)
        at = at[self._low(s[at]) == want[at]]
        out[live[at]] = s[at]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``: select in the unary part by its rank directory."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        w = np.searchsorted(ones, i, "right") - 1
        rest, x, pos = i - ones[w], np.array(self.high[w]), w * 64
        for step in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(x & np.uint64((1 << step) - 1)).astype(np.int64)
            go = c <= rest
            rest -= c * go
            x >>= (step * go).astype(np.uint64)
            pos = pos + step * go
        return ((pos - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Byte of a count above 0: 1 + 8 log2, rounded."""
    return np.minimum(255, 1 + np.rint(8 * np.log2(counts))).astype(np.uint8)


class Trie:
    """Two levels over keys context << 32 | successor, with one byte a bigram."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, folder: str):
        context, successor = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        new = np.r_[len(keys) > 0, context[1:] != context[:-1]][: len(keys)]
        begin = np.flatnonzero(new)
        self.contexts = EliasFano(context[begin], 1 << 32, os.path.join(folder, "contexts"))
        self.pointers = EliasFano(np.r_[begin, len(keys)], len(keys) + 1, os.path.join(folder, "pointers"))
        # each range goes on from the last value of the one before: no context is in the values, the pointers tell the ranges apart
        last = np.r_[begin[1:] - 1, len(keys) - 1][: len(begin)]
        base = np.r_[np.uint64(0), np.cumsum(successor[last], dtype=np.uint64)]
        followed = successor + base[:-1][np.cumsum(new) - 1] if len(keys) else successor
        self.successors = EliasFano(followed, int(base[-1]) + 1, os.path.join(folder, "successors"))
        codes.tofile(os.path.join(folder, "codes"))
        self.codes = np.memmap(os.path.join(folder, "codes"), np.uint8, "r") if len(codes) else codes

    def _ranges(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, place behind the last, value that the range goes on from) of the successors of contexts at places ``c``."""
        lo, hi = self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64)
        base = np.zeros(len(c), np.uint64)
        later = np.flatnonzero(lo > 0)
        base[later] = self.successors.get(lo[later] - 1)
        return lo, hi, base

    def query(self, keys: np.ndarray) -> np.ndarray:
        """Codes of sorted keys, 0 where the trie lacks one; each context is looked up once and its pointers bound the search."""
        out = np.zeros(len(keys), np.uint8)
        context = keys >> np.uint64(32)
        new = np.r_[len(keys) > 0, context[1:] != context[:-1]][: len(keys)]
        c = self.contexts.find(context[new])
        held = np.flatnonzero(c >= 0)
        lo, hi, base = self._ranges(c[held])
        row = np.full(len(c), -1, np.int64)
        row[held] = np.arange(len(held))
        row = row[np.cumsum(new) - 1]
        known = np.flatnonzero(row >= 0)
        row = row[known]
        at = self.successors.find(base[row] + (keys[known] & np.uint64(0xFFFFFFFF)), lo[row], hi[row])
        out[known[at >= 0]] = self.codes[at[at >= 0]]
        return out

    def successors_of(self, context: int) -> tuple[np.ndarray, np.ndarray]:
        """(successor hashes, codes) of one context, by its pointers."""
        c = self.contexts.find(np.array([context]))
        if c[0] < 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        lo, hi, base = (x[0] for x in self._ranges(c))
        return self.successors.get(np.arange(lo, hi)) - base, np.asarray(self.codes[lo:hi])


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts as word places: (ids, train, size, words, tokens) of about ``BLOCK_TOKENS`` tokens a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush():
            words, back = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True)
            ids, train, size = (np.concatenate([h[i] for h in held]) for i in range(3))
            row = (ids.tobytes(), train.tobytes(), size.tobytes(), words.tobytes(), zlib.compress(back.astype("<u4").tobytes(), 1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["ids", "train", "size", "words", "tokens"])

        for batch in batches:
            ids, train = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(), batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
            for b in blocks(batch.column("text")):
                words, first = words_of(b)
                n = len(b)
                tokens = np.insert(words, first[1:], END)  # one end after each text
                held.append((ids[b.row0 : b.row0 + n], train[b.row0 : b.row0 + n], np.diff(first) + 1, tokens))
                if sum(len(h[3]) for h in held) >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    made = docs.mapInArrow(run, "ids binary, train binary, size binary, words binary, tokens binary")
    return made.withColumn("block", F.monotonically_increasing_id())


class _View:
    """One block, decoded: its words, token places, training mask and distinct bigrams."""

    def __init__(self, row: dict):
        self.ids, self.size = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["size"], np.int64)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.words, self.tokens = np.frombuffer(row["words"], np.uint64), np.frombuffer(zlib.decompress(row["tokens"]), "<i4")
        self.learned = np.repeat(self.train, self.size)
        self.end = int(np.searchsorted(self.words, END))

    def word_keys(self, counts: bool = True):
        return self.words, np.bincount(self.tokens[self.learned], minlength=len(self.words)).astype(np.uint32) if counts else None

    def bigrams(self):
        """(keys, training counts, place of each token's bigram, context place of each token)."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.r_[0, np.cumsum(self.size)[:-1]]] = self.end
        code = before * np.int64(len(self.words)) + self.tokens
        order = np.argsort(code)
        code = code[order]
        new = np.r_[True, code[1:] != code[:-1]][: len(code)]
        pair = code[new]
        del code
        back = np.empty_like(self.tokens)
        back[order] = np.cumsum(new, dtype=np.int32) - 1
        del order, new
        short = mix64(self.words, 21) >> np.uint64(32)
        keys = (short[pair // len(self.words)] << np.uint64(32)) | short[pair % len(self.words)]
        return keys, np.bincount(back[self.learned], minlength=len(pair)).astype(np.uint32), back, before


def _dealt(keys: np.ndarray, shards: int) -> np.ndarray:
    """Keys ordered by shard, then key; and where each shard begins."""
    shard = (mix64(keys, 31) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((keys, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: steps of the upper halves, which compress well, then the lower halves."""
    upper = (keys >> np.uint64(32)).astype("<u4")
    steps = zlib.compress(np.diff(upper, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)
    return len(steps).to_bytes(8, "little") + steps + keys.astype("<u4").tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(data[:8], "little")
    upper = np.cumsum(np.frombuffer(zlib.decompress(data[8:cut]), "<u4"), dtype=np.uint64)
    return (upper << np.uint64(32)) | np.frombuffer(data[cut:], "<u4").astype(np.uint64)


def _asked(made: DataFrame, level: int, shards: int) -> DataFrame:
    """(shard, block, keys, counts) of every block's distinct n-grams of a level."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                v = _View(row)
                keys, counts = v.word_keys() if level == 1 else v.bigrams()[:2]
                order, cut = _dealt(keys, shards)
                keys, counts = keys[order], counts[order]
                on = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(on.astype(np.int32)), pa.array([row["block"]] * len(on), pa.int64()),
                     pa.array([packed_keys(keys[cut[s] : cut[s + 1]]) for s in on], pa.binary()),
                     pa.array([zlib.compress(counts[cut[s] : cut[s + 1]].tobytes(), 1) for s in on], pa.binary())], ["shard", "block", "keys", "counts"])

    return made.mapInArrow(run, "shard int, block long, keys binary, counts binary")


def _answers(made: DataFrame, level: int, shards: int) -> DataFrame:
    """(level, block, shard, reply): counts (uint32) of words, codes (bytes) of bigrams; block -1 holds a shard's statistics."""

    def resolve(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = int(key[0].as_py())
        rows = [r for b in batches for r in b.select(["block", "keys", "counts"]).to_pylist()]
        asked = [unpacked_keys(r["keys"]) for r in rows]
        ends = np.cumsum([len(a) for a in asked])
        every, back = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(back, np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.uint32) for r in rows])).astype(np.int64)
        keys, counts = every[counts > 0], counts[counts > 0]
        with tempfile.TemporaryDirectory() as folder:  # this task's own scratch
            if level == 1:
                at = EliasFano(keys, 1 << 64, os.path.join(folder, "words")).find(every) if len(keys) else np.full(len(every), -1)
                got = np.where(at >= 0, counts[at] if len(counts) else 0, 0).astype(np.uint32)
                stats = np.array([len(keys), (counts == 1).sum(), (counts == 2).sum()], np.int64)
                yield _reply(level, -1, shard, stats.tobytes())
            else:
                got = Trie(keys, quantised(counts), folder).query(every) if len(keys) else np.zeros(len(every), np.uint8)
        for r, end, a in zip(rows, ends, asked):
            yield _reply(level, r["block"], shard, got[back[end - len(a) : end]].tobytes())

    return _asked(made, level, shards).groupBy("shard").applyInArrow(resolve, "level int, block long, shard int, reply binary")


def _reply(level, block, shard, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([block], pa.int64()), pa.array([shard], pa.int32()),
                                       pa.array([zlib.compress(data, 1)], pa.binary())], ["level", "block", "shard", "reply"])


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text, train).

    An empty table gives no row; with no training text every token is unknown
    with probability 1.
    """
    spark = docs.sparkSession
    prepare(spark)
    made = cut_lineage(_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("train", F.lit(False)).alias("train"))))
    sizes = made.agg(F.sum(F.length("words") / 8), F.sum(F.length("tokens"))).first()
    shards = [parts_for(spark, sizes[0] or 0, SHARD_KEYS), parts_for(spark, (sizes[1] or 0) / 3, SHARD_KEYS)]  # a token takes 2 to 3 bytes
    words = cut_lineage(_answers(made, 1, shards[0]))
    bigrams = _answers(made, 2, shards[1])
    stats = np.zeros(3, np.int64)
    for r in words.where("block = -1").select("reply").toLocalIterator():  # three numbers for each shard
        stats += np.frombuffer(zlib.decompress(r.reply), np.int64)
    v, n1, n2 = (int(x) for x in stats)

    def count(batches):
        for b in batches:
            total = sum(int(np.frombuffer(r["size"], np.int64)[np.frombuffer(r["train"], np.uint8) == 1].sum()) for r in b.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    n = made.select("size", "train").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
    parts = list(shards)

    def score(key, left, right):
        reply = {(r["level"], r["shard"]): r["reply"] for r in right.select(["level", "shard", "reply"]).to_pylist()}
        del right
        out = []
        for row in left.to_pylist():  # one block
            view = _View(row)

            def back(keys, level, kind):
                order, cut = _dealt(keys, parts[level - 1])
                got = np.zeros(len(keys), kind)
                for s in np.flatnonzero(np.diff(cut)):
                    got[order[cut[s] : cut[s + 1]]] = np.frombuffer(zlib.decompress(reply[level, int(s)]), kind)
                return got

            c = back(view.words, 1, np.uint32).astype(np.float64)
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            one = np.where(c > 0, c - discount, discount * v) / n if n else np.ones(len(c))
            one = 10 ** (np.rint(64 * np.log10(one)) / 64)
            keys, _, pair, before = view.bigrams()
            code = back(keys, 2, np.uint8)
            del keys
            first = np.r_[0, np.cumsum(view.size)]
            sums = np.zeros((3, len(view.size)))
            for lo in range(0, len(view.tokens), SLICE_TOKENS):  # a text may lie in several slices
                x = slice(lo, lo + SLICE_TOKENS)
                word, prior, seen = view.tokens[x], c[before[x]], code[pair[x]].astype(np.float64)
                p2 = np.where(seen > 0, np.minimum(1, 2 ** ((seen - 1) / 8) / np.maximum(prior, 1)), 0)
                token = np.log10(np.where(prior > 0, WEIGHT * p2 + (1 - WEIGHT) * one[word], one[word]))
                texts = np.arange(np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, lo + len(word), "left"))
                at = np.maximum(first[texts] - lo, 0)
                for k, values in enumerate((c[word] > 0, base[word], token)):
                    sums[k, texts] += np.add.reduceat(values.astype(np.float64), at)
            out.append([pa.array(view.ids, mask=view.ids == -(1 << 63)), pa.array(view.size), pa.array(sums[0].astype(np.int64)),
                        pa.array(np.full(len(view.size), n, np.int64)), pa.array(sums[1]), pa.array(sums[2])])
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64()] * 4 + [pa.float64()] * 2
        if not out:
            return pa.table({k: pa.array([], t) for k, t in zip(names, kinds)})
        return pa.concat_tables([pa.table(o, names=names) for o in out])

    replies = words.where("block >= 0").unionByName(bigrams)
    return made.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_elias_fano_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("train", crc32_mod("doc_id", 10) != 0)
    return lm_scores(docs).withColumn("held_out", crc32_mod("doc_id", 10) == 0).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
