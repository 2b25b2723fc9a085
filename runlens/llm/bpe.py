"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over ``WINDOW`` bytes cuts each text where the content says so
(about every ``CHUNK`` bytes), so passages that documents share give the same
chunks wherever they stand.  A distinct chunk is encoded once per worker (a
bounded memo spans blocks and tasks): only the part between its first and its
last white space, because what touches a chunk's edge may continue beyond it.
Chunk joins are then repaired: the span from the last white space before the
cut to the first one after it is encoded anew, over as many chunks as it takes
to reach white space on both sides.  There both encodings agree exactly, since
this vocabulary's first pattern never reaches across white space; so the joined
ids are those of the whole text.  Chunks and repaired spans get their ids from
``UnitMemo``, which asks the tokenizers library once for each distinct unit.

Null and empty texts give no ids and an empty decoded text; a text without
any white space is one repaired span.  Every task works on blocks of whole
texts: there is no shuffle, and a lost executor costs its tasks' reruns.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runlens.llm.jobs import prepare
from runlens.llm.textblocks import Block, blocks
from runlens.llm.units import UnitMemo, library_encoder, plain_tokenizer, shared_memo, word_units

WINDOW = 16
CHUNK_BITS = 10
CHUNK_ENTRIES = 1 << 13
LONG_CHUNK = 1 << 15  # longer ones are not kept between blocks


def chunk_cuts(b: Block) -> np.ndarray:
    """Chunk starts of a block and its end; a text's start always begins a chunk."""
    n = len(b.buf)
    cut = np.zeros(n + 1, bool)
    if n > WINDOW:
        cut[WINDOW:] = (b.rolling(WINDOW) >> np.uint64(64 - CHUNK_BITS)) == 0
        near = (b.offs[:-1, None] + np.arange(WINDOW)).ravel()
        cut[near[near < n]] = False  # the window may not reach into the text before
    cut[b.offs] = True
    return np.flatnonzero(cut)


class ChunkEncoder:
    """ids and decoded bytes of whole texts, chunk by chunk."""

    def __init__(self, path: str):
        t = plain_tokenizer(path)
        names = [b""] * t.get_vocab_size(with_added_tokens=True)
        for token, i in t.get_vocab(with_added_tokens=True).items():
            names[i] = token.encode("utf-8")
        # this vocabulary has no decoder: decode() joins the tokens by a space
        if t.decoder is not None:
            raise ValueError("expects a vocabulary whose decode joins tokens by a space")
        self.units = UnitMemo(library_encoder(path), lambda ids: b" ".join([names[i] for i in ids]))
        self.chunks: OrderedDict[bytes, tuple[bytes, bytes]] = OrderedDict()

    def encode(self, b: Block) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian uint32 bytes, decoded UTF-8) of each text of the block."""
        start, end, _ = word_units(b)
        cuts = chunk_cuts(b)
        lo, hi = cuts[:-1], cuts[1:]
        # units inside a chunk, away from both its edges: first and last of each chunk
        inner_from = np.searchsorted(start, lo, "right")
        inner_to = np.maximum(np.searchsorted(end, hi, "left"), inner_from)
        raw = b.buf.tobytes()
        key_list = [raw[i:j] for i, j in zip(lo.tolist(), hi.tolist())]  # the bytes themselves: a chunk is never taken for another
        rep = list({k: c for c, k in enumerate(key_list)}.values())
        fresh = [r for r in rep if key_list[r] not in self.chunks]
        # encode the inner units of new chunks and the repaired spans, nothing else
        need = np.ones(len(start), bool)
        edge = np.zeros(len(start) + 1, np.int64)
        np.add.at(edge, inner_from, 1)
        np.add.at(edge, inner_to, -1)
        need[np.cumsum(edge[:-1]) > 0] = False
        for c in fresh:
            need[inner_from[c] : inner_to[c]] = True
        which = np.flatnonzero(need)
        at = np.full(len(start), -1, np.int64)
        at[which] = self.units.lookup(b, start[which], end[which])
        ids, out = self.units.ids, self.units.out
        of_chunk: dict[bytes, tuple[bytes, bytes]] = {}
        for c in fresh:
            inner = at[inner_from[c] : inner_to[c]]
            of_chunk[key_list[c]] = (b"".join(ids[inner].tolist()), b" ".join([x for x in out[inner].tolist() if x]))
        for r in rep:
            k = key_list[r]
            if k not in of_chunk:
                of_chunk[k] = self.chunks[k]
            if len(k) <= LONG_CHUNK:
                self.chunks[k] = of_chunk[k]
                self.chunks.move_to_end(k)
        while len(self.chunks) > CHUNK_ENTRIES:
            self.chunks.popitem(last=False)
        chunk_of = np.searchsorted(cuts, b.offs).tolist()
        inner_from, inner_to, unit_of = inner_from.tolist(), inner_to.tolist(), np.searchsorted(start, b.offs).tolist()
        for i in range(len(b)):
            got, text, u = [], [], unit_of[i]
            for c in range(chunk_of[i], chunk_of[i + 1]):
                for j in range(u, inner_from[c]):  # repaired spans
                    got.append(ids[at[j]]), text.append(out[at[j]])
                x, y = of_chunk[key_list[c]]
                got.append(x), text.append(y)
                u = max(u, inner_to[c])
            for j in range(u, unit_of[i + 1]):
                got.append(ids[at[j]]), text.append(out[at[j]])
            yield b"".join(got), b" ".join([x for x in text if x])


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Encode and decode ``text`` of each row.

    Returns the id column, n_tokens, ids_sha256, decoded_sha256, and with
    ``keep_ids`` also ids (array of int) and decoded (string).  Other columns
    are ignored; repeated rows are encoded like any other; an empty table
    gives no row.
    """
    prepare(docs.sparkSession)
    extra = ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared_memo(("chunks", vocabulary), lambda: ChunkEncoder(vocabulary))
        for batch in batches:
            rows = []
            for b in blocks(batch.column("text")):
                for ids, text in coder.encode(b):
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest())
                    rows.append(row + ((np.frombuffer(ids, "<u4").astype(np.int32), text.decode("utf-8")) if keep_ids else ()))
            cols = list(zip(*rows)) if rows else [[] for _ in range(5 if keep_ids else 3)]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names[: len(cols) + 1])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def op1_chunk_reuse(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
