"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Input of a step is a word: its hashed word vector plus the mean of the hashed
vectors of its character trigrams (edges marked), through a linear layer.  A GRU
reads each window of ``WINDOW`` words in both directions; attention weights
pool the states; a logistic unit scores the window.  All windows (every
``STRIDE`` words, so a passage of up to half a window lies whole in one; the last
one ends with the text) are scored and a document has the largest window score,
calibrated to 0..1.

The model is trained in numpy on the driver, on a bounded sample: at most
``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled rows of at most ``SAMPLE_CHARS``
characters, those with the smallest id hashes, in windows every ``LEARN_STRIDE``
words (the driver holds them all).  Each epoch takes, of a toxic
document, the window that scores highest at that point, and of a clean one the
highest and another.  Word vectors start with the word's smoothed log odds in
the sample.  Scoring reads whole texts of any length.

Null and empty texts and texts of white space have one empty window, scored
like any other.  If no labelled toxic or clean row exists, every score is the
share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.jobs import prepare, tidy_worker
from runlens.llm.textblocks import Block, blocks, crc32_mod, mix64

WINDOW, STRIDE, LEARN_STRIDE = 48, 24, 40
HIDDEN, WORD_DIM, CHAR_DIM = 6, 6, 4
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 12
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1000, 1500, 8_000
EPOCHS, BATCH, RATE = 4, 128, 0.01
THRESHOLD = 0.7


def _letters_only(b: Block) -> Block:
    """Lower-cased bytes with ASCII punctuation read as white space."""
    low = b.lowered()
    buf = low.buf.copy()
    punct = (buf < 0x80) & ~(((buf >= 97) & (buf <= 122)) | ((buf >= 48) & (buf <= 57)))
    buf[punct] = 0x20
    return Block(buf, b.offs, b.row0)


class Words:
    """Words of one block or of consecutive ones: for each distinct word its row in the word table and its trigrams' rows."""

    def __init__(self, *parts: Block):
        made = [self._of_block(b) for b in parts]
        uniq, self.which, self.first, self.grams, self.size = made[0]
        self.split = np.r_[0, np.cumsum(self.size)[:-1]]
        if len(made) > 1:
            uniq, at, back = np.unique(np.concatenate([m[0] for m in made]), return_index=True, return_inverse=True)
            distinct, words = np.cumsum([0, *[len(m[0]) for m in made]]), np.cumsum([0, *[len(m[1]) for m in made]])
            self.which = np.concatenate([back[n + m[1]] for n, m in zip(distinct, made)])
            self.first = np.concatenate([self.first[:1], *[n + m[2][1:] for n, m in zip(words, made)]])
            self.grams, self.size = np.concatenate([m[3] for m in made]), np.concatenate([m[4] for m in made])
            self.split = np.r_[0, np.cumsum(self.size)[:-1]]
            self.grams, self.size, self.split = self._picked(at)
        self.rows = (uniq % np.uint64(WORD_ROWS)).astype(np.int64)

    @staticmethod
    def _of_block(b: Block) -> tuple[np.ndarray, ...]:
        """(hashes of the distinct words, which of them each word is, first word of each text, trigrams' rows, trigrams of each distinct word)."""
        plain = _letters_only(b)
        start, end, first = plain.runs()
        uniq, at, which = np.unique(plain.hashes(start, end), return_index=True, return_inverse=True)
        start, end = start[at], end[at]
        size = end - start  # a word of n bytes has n trigrams with both edges marked
        split = np.r_[0, np.cumsum(size)[:-1]]
        owner = np.repeat(np.arange(len(uniq)), size)
        pos = start[owner] + np.arange(size.sum()) - split[owner] if len(uniq) else np.zeros(0, np.int64)
        left = np.where(pos > start[owner], plain.buf[np.maximum(pos - 1, 0)], 32).astype(np.uint64)
        right = np.where(pos + 1 < end[owner], plain.buf[np.minimum(pos + 1, max(len(plain.buf) - 1, 0))], 32).astype(np.uint64)
        code = (left << np.uint64(16)) | (plain.buf[pos].astype(np.uint64) << np.uint64(8)) | right
        return uniq, which, first, (mix64(code, 3) % np.uint64(CHAR_ROWS)).astype(np.int64), size

    def _picked(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(trigrams' rows, their number, their first place) of the distinct words ``rows``."""
        size = self.size[rows]
        split = np.r_[0, np.cumsum(size)[:-1]]
        owner = np.repeat(np.arange(len(rows)), size)
        return self.grams[self.split[rows][owner] + np.arange(len(owner)) - split[owner]], size, split

    def take(self, rows: np.ndarray) -> Words:
        """The distinct words ``rows`` alone (no texts)."""
        out = object.__new__(Words)
        out.rows = self.rows[rows]
        out.grams, out.size, out.split = self._picked(rows)
        return out


def windows(first: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all overlapping windows; a text without words has one empty window."""
    n = np.diff(first)
    many = np.maximum(1, -(-(n - WINDOW) // stride) + 1)
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(many.sum()) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
    at = np.minimum(k * stride, np.maximum(n[doc] - WINDOW, 0))
    return doc, first[:-1][doc] + at, np.minimum(n[doc], WINDOW)


def _sig(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """Parameters by name, forward pass and gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s, scale=0.3: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": f(WORD_ROWS, WORD_DIM, scale=0.02), "char": f(CHAR_ROWS, CHAR_DIM, scale=0.05)}
        for d in "fb":
            self.p |= {d + "x": f(WORD_DIM + CHAR_DIM, 3 * HIDDEN), d + "h": f(HIDDEN, 3 * HIDDEN), d + "0": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": f(2 * HIDDEN), "w": f(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, w: Words) -> np.ndarray:
        """Input vector of each distinct word; a last row of zeros pads."""
        out = np.zeros((len(w.rows) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if len(w.rows):
            out[:-1, :WORD_DIM] = self.p["word"][w.rows]
            out[:-1, WORD_DIM:] = np.add.reduceat(self.p["char"][w.grams], w.split) / w.size[:, None]
        return out

    def _direction(self, d: str, x3: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool):
        steps, H = range(idx.shape[1]), HIDDEN
        h = np.zeros((len(idx), H), np.float32)
        states, memory = np.zeros((idx.shape[1], len(idx), H), np.float32), {}
        for t in steps if d == "f" else reversed(steps):
            x, u, m = x3[idx[:, t]], h @ self.p[d + "h"], mask[:, t : t + 1]
            zr = _sig(x[:, : 2 * H] + u[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(x[:, 2 * H :] + r * u[:, 2 * H :])
            new = n + z * (h - n)
            if keep:
                memory[t] = (h, u, z, r, n)
            h = h + m * (new - h)
            states[t] = h
        return states, memory

    def forward(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, mf = self._direction("f", x @ self.p["fx"] + self.p["f0"], idx, mask, keep)
        b, mb = self._direction("b", x @ self.p["bx"] + self.p["b0"], idx, mask, keep)
        s = np.concatenate([f, b], 2)
        e = s @ self.p["a"] + np.where(mask.T > 0, 0, -30).astype(np.float32)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = (e[..., None] * s).sum(0)
        return pooled @ self.p["w"] + self.p["c"][0], (s, e, pooled, mf, mb)

    def gradients(self, w: Words, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        """Weighted logistic loss, back through attention, both directions and the inputs."""
        logit, (s, e, pooled, mf, mb) = self.forward(x, idx, mask, True)
        H, p = HIDDEN, self.p
        dl = ((_sig(logit) - label) * weight / len(label)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        g["w"], g["c"][0] = dl @ pooled, dl.sum()
        dpool = dl[:, None] * p["w"]
        de = e * ((s * dpool).sum(2) - (pooled * dpool).sum(1))
        g["a"] = (de[..., None] * s).sum((0, 1))
        ds = e[..., None] * dpool + de[..., None] * p["a"]
        dx = np.zeros_like(x)
        for d, memory, part in (("f", mf, ds[..., :H]), ("b", mb, ds[..., H:])):
            dh, steps, dx3 = np.zeros((len(idx), H), np.float32), range(idx.shape[1]), np.zeros((len(x), 3 * H), np.float32)
            for t in reversed(steps) if d == "f" else steps:
                h, u, z, r, n = memory[t]
                dh = dh + part[t]
                m = mask[:, t : t + 1]
                dnew, dold = dh * m, dh * (1 - m)
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (h - n) * z * (1 - z)
                dr = dn * u[:, 2 * H :] * r * (1 - r)
                din, du = np.concatenate([dz, dr, dn], 1), np.concatenate([dz, dr, dn * r], 1)
                g[d + "h"] += h.T @ du
                np.add.at(dx3, idx[:, t], din * m)
                dh = dold + dnew * z + du @ p[d + "h"].T
            g[d + "0"] = dx3[:-1].sum(0)
            g[d + "x"] = x.T @ dx3
            dx += dx3 @ p[d + "x"].T
        owner = np.repeat(np.arange(len(w.rows)), w.size)
        g["word"], g["char"] = (w.rows, dx[:-1, :WORD_DIM]), (w.grams, (dx[:-1, WORD_DIM:] / w.size[:, None])[owner])
        return g

    def document_logits(self, w: Words, batch: int = 8192) -> np.ndarray:
        """Largest window logit of each text."""
        doc, at, n = windows(w.first)
        x, which = self.inputs(w), np.r_[w.which, 0]
        out = np.full(len(w.first) - 1, -np.inf, np.float32)
        order = np.argsort(n, kind="stable")  # windows of like length together: less padding
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            idx, mask = gather(which, at[part], n[part], len(w.rows))
            np.maximum.at(out, doc[part], self.forward(x, idx, mask)[0])
        return out

    def scores(self, b: Block) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.document_logits(Words(b)).astype(np.float64) + self.shift, -30, 30)))


def gather(which: np.ndarray, at: np.ndarray, n: np.ndarray, pad: int, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    width = width or max(1, int(n.max(initial=0)))
    place = np.arange(width)
    mask = place < n[:, None]
    idx = np.where(mask, which[np.minimum(at[:, None] + place, len(which) - 1)], pad)
    return idx, mask.astype(np.float32)


def _mask(idx: np.ndarray, pad: int) -> np.ndarray:
    return (idx != pad).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 7) -> BiGRU:
    """A network trained on labelled texts (both labels must occur).

    The texts are read in blocks; of all of them at once the driver holds their words'
    numbers and the windows (4 bytes a word each), not hashes or masks.
    """
    model, r = BiGRU(seed), np.random.default_rng(seed)
    y = np.asarray(labels)
    w = Words(*blocks(pa.array(texts, pa.large_string())))
    w.which = w.which.astype(np.int32)
    # smoothed log odds of each word row start the first word dimension
    df = np.zeros((2, WORD_ROWS), np.int64)
    for lo in range(0, len(texts), 256):
        first = w.first[lo : lo + 257]
        of = np.repeat(np.arange(lo, lo + len(first) - 1), np.diff(first))
        seen = np.unique(of * WORD_ROWS + w.rows[w.which[first[0] : first[-1]]])
        for c in (0, 1):
            df[c] += np.bincount(seen[y[seen // WORD_ROWS] == c] % WORD_ROWS, minlength=WORD_ROWS)
    odds = np.log((df[1] + 0.5) / (y.sum() + 1)) - np.log((df[0] + 0.5) / ((1 - y).sum() + 1))
    model.p["word"][:, 0] = np.clip(odds * (df[0] + df[1]) / (df[0] + df[1] + 8), -2, 3)
    doc, at, n = windows(w.first, LEARN_STRIDE)
    which, pad = np.r_[w.which, np.int32(0)], len(w.rows)
    word_odds = np.r_[model.p["word"][w.rows, 0], 0]
    idx = np.empty((len(doc), max(1, int(n.max(initial=0)))), np.int32)  # ``pad`` where a window has no word
    guide = np.empty(len(doc), word_odds.dtype)
    for i in range(0, len(idx), 4096):
        idx[i : i + 4096], mask = gather(which, at[i : i + 4096], n[i : i + 4096], pad, idx.shape[1])
        guide[i : i + 4096] = np.where(mask > 0, word_odds[idx[i : i + 4096]], -9).max(1)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    state: dict = {}
    step = 0
    for epoch in range(EPOCHS):
        if epoch:
            x = model.inputs(w)
            guide = np.concatenate([model.forward(x, near, _mask(near, pad))[0] for near in (idx[i : i + 1024] for i in range(0, len(idx), 1024))])
        order = np.lexsort((guide, doc))
        top = order[np.r_[np.flatnonzero(np.diff(doc[order])), len(order) - 1]]  # one window of each text: its highest
        other = r.permutation(len(doc))
        other = other[y[doc[other]] == 0][: len(top)]
        rows = r.permutation(np.r_[top, other])
        for i in range(0, len(rows), BATCH):
            part, step = rows[i : i + BATCH], step + 1
            used, near = np.unique(idx[part], return_inverse=True)
            used = used[used < pad]
            own = w.take(used)
            x = model.inputs(own)
            for k, g in model.gradients(own, x, near.reshape(idx[part].shape), _mask(idx[part], pad), y[doc[part]], weight[doc[part]]).items():
                m, v = state.setdefault(k, (np.zeros_like(model.p[k]), np.zeros_like(model.p[k])))
                if isinstance(g, tuple):
                    hit, where = np.unique(g[0], return_inverse=True)
                    full = np.zeros((len(hit), g[1].shape[1]), np.float32)
                    np.add.at(full, where, g[1])
                    m[hit] = 0.9 * m[hit] + 0.1 * full
                    v[hit] = 0.99 * v[hit] + 0.01 * full * full
                    model.p[k][hit] -= RATE * m[hit] / (np.sqrt(v[hit]) + 1e-6)
                else:
                    m[...] = 0.9 * m + 0.1 * g
                    v[...] = 0.99 * v + 0.01 * g * g
                    model.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    # calibrate document maxima: logistic fit of scale and shift on the sample
    logit = model.document_logits(w, 1024).astype(np.float64)  # small batches: the driver also holds the sample
    a, c = 1.0, 0.0
    for _ in range(300):
        e = (1 / (1 + np.exp(-np.clip(a * logit + c, -30, 30))) - y) * weight
        a, c = max(0.05, a - 0.1 * (e * logit).mean()), c - 0.1 * e.mean()
    model.scale, model.shift = float(a), float(c)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded training sample: (doc_id, text, toxic)."""
    rows = docs.join(labels.where("toxic in (0, 1)").select("doc_id", "toxic"), "doc_id").where(F.length("text") <= SAMPLE_CHARS)
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = rows.select("doc_id", "toxic")
    few = ids.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(ids.where("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    return docs.join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic")  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows


def trained_model(docs: DataFrame, labels: DataFrame):
    """A network (or, without both labels, the constant share) from rows whose crc32(doc_id) mod 3 is not 1."""
    prepare(docs.sparkSession)
    pool = docs.select("doc_id", "text").where(crc32_mod("doc_id", 3) != 1)
    rows = sorted(labelled_sample(pool, labels).collect(), key=lambda r: (r.doc_id, r.text, r.toxic))
    y = [r.toxic for r in rows]
    if len(set(y)) < 2:
        return float(y[0]) if y else 0.0
    texts = [r.text for r in rows]
    del rows
    tidy_worker()  # the driver's process goes on as well: it gives back what the rows took, and then the training
    model = train(texts, y)
    tidy_worker()
    return model


def score(docs: DataFrame, model) -> DataFrame:
    """``docs`` with score and predicted added; only ``text`` is looked at."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy_worker()
        m = sent.value
        for batch in batches:
            got = [np.full(len(b), m) if isinstance(m, float) else m.scores(b) for b in blocks(batch.column("text"))]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double, predicted int")


def op3_bigru(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), trained_model(docs, labels))
    return scored.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
