"""N-gram Jaccard join by multiple-global-order prefix filtering.

A document's set holds its distinct ``k``-word shingles (64-bit content
hashes).  Two sets with ``100 * overlap >= 75 * union`` must share a token
among the first ``n - ceil(0.75 n) + 1`` tokens of *any* order of all tokens,
as long as both sets use the same order.  So several global orders give
several necessary conditions, and a pair is verified only if it meets all of
them:

1. ``set_signatures``: one pass gives each document its set's size and
   signature, and a fixed-size count sketch over all tokens.  Equal sets
   (copies) become one representative before anything is paired.
2. Order A puts tokens that the sketch saw seldom first (any function of the
   token is a valid global order; the sketch makes it a selective one, so
   passages that many documents share come last).  Each representative's A
   prefix is posted, dealt by token hash; posting lists with two sets or more
   are kept.
3. Rounds of stars: a posting list points its sets at one hub (a set of the
   smallest component that the list holds); each set proposes one pair, with
   the hub that most of its lists point at.  So a group of near copies costs
   one pair a set, not the square of its size.  Proposed pairs must pass an
   exact bound on the overlap from bit maps of the sets (``SPARE`` bits a shingle or more); then they get
   both sets and must also share a prefix token under the orders B and C (two
   independent token permutations on top of the sketch's levels) before the
   sets are intersected.
4. Sets linked so far share a component.  Whatever a posting list then holds
   from different components is paired directly, without limit (in blocks; only
   pairs within the bound leave a task), and verified in the same way, so no link between different components is missed: the
   components equal the all-pairs join's.

Nulls, empty texts and texts of white space have the empty set: size 0, linked
with nothing, own component.  Repeated rows of one doc_id are one node.
Neither documents nor links reach the driver: it gets the sketch and a
bit filter (4 MB each, whatever the input).  A set signature has 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.jobs import bit_filter, components, count_blobs, fold_counts, parts_for, prepare, tidy_worker
from runlens.llm.textblocks import blocks, mix64, shingles_of, words_of
from runlens.session import cut_lineage

SKETCH = 1 << 22
SKETCH_BLOCK = 1 << 14
FILTER_BITS = 1 << 25
BITS = 2048
SPARE = 4
STAR_ROUNDS = 2
LIST_ROWS = 4096  # longer posting lists are compared block against block
GROUP_ROWS = 4096  # members of lists that one task compares at a time


def _signature(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        s = np.array([mix64(tokens, 11).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)
        x = np.bitwise_xor.reduce(mix64(tokens, 12)) if len(tokens) else np.uint64(0)
        return int(mix64(s ^ mix64(np.array([x]), 13), 14).view(np.int64)[0])


def _bitmap(tokens: np.ndarray) -> bytes:
    """One bit a token; ``SPARE`` bits or more for each, so the bound does not fade with the set's size."""
    bits = max(BITS, 1 << (SPARE * len(tokens) - 1).bit_length()) if len(tokens) else BITS
    on = np.zeros(bits, bool)
    on[(mix64(tokens, 15) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bit maps (rows of 64-bit words) as they would be with fewer bits: the halves laid on each other."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def _differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Number of differing bits of each pair of maps, the larger one folded to the smaller one's size."""
    out = np.zeros(len(x), np.int64)
    sizes = np.array([(len(a), len(b)) for a, b in zip(x, y)], np.int64).reshape(-1, 2)
    for nx, ny in np.unique(sizes, axis=0):
        i = np.flatnonzero((sizes == (nx, ny)).all(1))
        a = np.frombuffer(b"".join([x[k] for k in i]), np.uint64).reshape(len(i), -1)
        b = np.frombuffer(b"".join([y[k] for k in i]), np.uint64).reshape(len(i), -1)
        words = min(nx, ny) // 8
        out[i] = np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum(1)
    return out


def prefix_length(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` must show so that every partner shares one of them."""
    return n - (percent * n + 99) // 100 + 1


def _ranks(tokens: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """Place of each token in a global order: sketch level first, then a permutation of its own."""
    with np.errstate(over="ignore"):
        lev = level[(tokens >> np.uint64(38)).astype(np.int64) % SKETCH].astype(np.uint64)
        return (lev << np.uint64(56)) | (mix64(tokens, 100 + order) >> np.uint64(8))


def prefix(tokens: np.ndarray, level: np.ndarray, order: int, percent: int) -> np.ndarray:
    p = int(prefix_length(len(tokens), percent))
    if p >= len(tokens):
        return tokens
    return tokens[np.argpartition(_ranks(tokens, level, order), p - 1)[:p]]


def _sets(batch: pa.RecordBatch, k: int):
    ids = batch.column("doc_id").to_pylist()
    for b in blocks(batch.column("text")):
        words, first = words_of(b)
        for i in range(len(b)):
            yield ids[b.row0 + i], shingles_of(words[first[i] : first[i + 1]], k)


def set_signatures(docs: DataFrame, k: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, sig) of each document, with its bit map in ``counts`` where the task
    meets the set first; (block, counts) of the tokens' count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy_worker()
        seen: set[int] = set()
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            ids, sizes, sigs, maps = [], [], [], []
            for doc, tokens in _sets(batch, k):
                sig = _signature(tokens)
                ids.append(doc), sizes.append(len(tokens)), sigs.append(sig), maps.append(None)
                if sig not in seen:
                    seen.add(sig)
                    maps[-1] = _bitmap(tokens)
                    np.add.at(counts, (tokens >> np.uint64(38)).astype(np.int64) % SKETCH, 1)
            yield _rows(ids, sizes, sigs, [None] * len(ids), maps)
        made = list(count_blobs(counts, SKETCH_BLOCK))
        void = [None] * len(made)
        yield _rows(void, void, void, [m[0] for m in made], [m[1] for m in made])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig long, block int, counts binary")


def _rows(ids, sizes, sigs, block, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(block, pa.int32()),
         pa.array(counts, pa.binary())], ["doc_id", "n", "sig", "block", "counts"])


def _postings(docs: DataFrame, k: int, percent: int, level_b, parts: int) -> DataFrame:
    """(part, token, sig, n) arrays: the order-A prefix tokens of each distinct set, packed by token part."""

    def run(batches):
        tidy_worker()
        level = np.frombuffer(level_b.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            toks, sigs, sizes = [], [], []
            for _, tokens in _sets(batch, k):
                if not len(tokens):
                    continue
                sig = _signature(tokens)
                if sig in seen:
                    continue
                seen.add(sig)
                own = prefix(tokens, level, 0, percent)
                toks.append(own)
                sigs.append(np.full(len(own), sig, np.int64))
                sizes.append(np.full(len(own), len(tokens), np.int32))
            if not toks:
                continue
            tok, sig, size = np.concatenate(toks), np.concatenate(sigs), np.concatenate(sizes)
            part = (tok % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            tok, sig, size, part = tok[order], sig[order], size[order], part[order]
            cut = np.flatnonzero(np.diff(part)) + 1
            lo, hi = np.r_[0, cut], np.r_[cut, len(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[lo], pa.int32()), *[pa.array([x[i:j].tobytes() for i, j in zip(lo, hi)], pa.binary()) for x in (tok, sig, size)]],
                ["part", "token", "sig", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "part int, token binary, sig binary, n binary")


def _shared(postings: DataFrame) -> DataFrame:
    """(token, sig, n) of the tokens that two distinct sets or more have in their prefix.

    A group is one token part, sized by the number of parts; a token has at
    most one posting for each distinct set and map task.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.frombuffer(t, np.uint64), np.frombuffer(s, np.int64), np.frombuffer(n, np.int32))
               for b in batches for t, s, n in zip(b.column("token").to_pylist(), b.column("sig").to_pylist(), b.column("n").to_pylist())]
        tok, sig, n = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((sig, tok))
        tok, sig, n = tok[order], sig[order], n[order]
        new = np.r_[True, (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])]
        tok, sig, n = tok[new], sig[new], n[new]
        lo = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        many = np.repeat(np.diff(np.r_[lo, len(tok)]), np.diff(np.r_[lo, len(tok)])) > 1
        yield pa.RecordBatch.from_arrays([pa.array(tok[many].view(np.int64)), pa.array(sig[many]), pa.array(n[many].astype(np.int64))], ["token", "sig", "n"])

    return postings.groupBy("part").applyInArrow(run, "token long, sig long, n long")


def _within_bound(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose bit maps differ in too many bits: overlap <= (na + nb - differing bits) / 2, always."""

    def check(batches):
        tidy_worker()
        for b in batches:
            differing = _differing(b.column("x").to_pylist(), b.column("y").to_pylist())
            both = (b.column("na").to_numpy() + b.column("nb").to_numpy() - differing) // 2
            keep = 100 * both >= percent * (b.column("na").to_numpy() + b.column("nb").to_numpy() - both)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    full = (pairs.join(maps.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("map").alias("x")), "a")
            .join(maps.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("map").alias("y")), "b"))
    return full.select("a", "b", "na", "nb", "x", "y").mapInArrow(check, "a long, b long")


def _crossing(rest: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs of one list and different components that pass the size and bit-map bounds.

    Sets that share one rare token share many, so a pair lies in many lists.
    Lists with the same members are compared once, and lists with the same hub meet in one
    group (cut at ``GROUP_ROWS``), which gives a pair once.  Long lists are compared in
    blocks, so a group's memory is bounded however long a list is.
    """
    lists = rest.groupBy("token").agg(F.count("*").alias("m"), F.first("hsig").alias("hub"), F.bit_xor(F.xxhash64("sig")).alias("h1"),
                                      F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("h2"))
    once = cut_lineage(lists.groupBy("m", "h1", "h2").agg(F.min(F.struct("token", "hub")).alias("l")).select("l.*", "m"))
    size = once.agg(F.sum("m")).first()[0] or 0
    parts = parts_for(rest.sparkSession, size, GROUP_ROWS)
    heavy = once.groupBy("hub").agg(F.ceil(F.sum("m") / GROUP_ROWS).alias("salts"))
    bucket = F.pmod(F.xxhash64("hub", F.pmod(F.xxhash64("token"), F.col("salts"))), F.lit(parts)).cast("int")
    once = once.join(heavy, "hub").select("token", F.ceil(F.col("m") / LIST_ROWS).cast("int").alias("nb"), bucket.alias("bucket"))
    rows = rest.select("token", "sig", "component").join(once, "token").join(maps, "sig").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "token", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sig", "n", "component", "map")

    def cross(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("token")
        token, sig, n, comp, own = (t.column(c).to_numpy() for c in ("token", "sig", "n", "component", "own"))
        held = t.column("map").to_pylist()
        del t
        cuts = np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), len(token)].tolist()
        sets = np.unique(sig)
        seen: set[int] = set()  # pairs by their members' numbers in this group
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            found, codes = [], []
            for a, b in _near(sig[lo:hi], n[lo:hi], comp[lo:hi], own[lo:hi], held[lo:hi], key[1].as_py() != key[2].as_py(), percent):
                code = (np.searchsorted(sets, a) * len(sets) + np.searchsorted(sets, b)).tolist()
                new = [k for k, c in enumerate(code) if c not in seen]
                found += zip(a[new].tolist(), b[new].tolist())
                codes += [code[k] for k in new]
                if len(found) > 1 << 14:
                    yield _pairs(found)
                    found, codes = [], []
            if len(seen) < 1 << 18:
                seen.update(codes)
            if found:
                yield _pairs(found)

    return rows.groupBy("bucket", "i", "j").applyInArrow(cross, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _near(sig, n, comp, own, maps, two_blocks: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one list that may link: different components (and blocks), sizes and bit maps within the bounds."""
    size = np.array([len(m) for m in maps])
    # sets that may link have maps of one size or of neighbouring ones: by pairs of sizes
    for small in np.unique(size):
        a = np.flatnonzero(size == small)
        x_bits = np.frombuffer(b"".join([maps[k] for k in a]), np.uint64).reshape(len(a), -1)
        at_once = max(1, (1 << 20) // small)
        for large in (small, 2 * small):
            c = a if large == small else np.flatnonzero(size == large)
            if not len(c):
                continue
            y_bits = x_bits if large == small else _folded(np.frombuffer(b"".join([maps[k] for k in c]), np.uint64).reshape(len(c), -1), small // 8)
            for at in range(0, len(a), 64):
                x = a[at : at + 64]
                ok = (comp[x, None] != comp[c]) & (100 * np.minimum(n[x, None], n[c]) >= percent * np.maximum(n[x, None], n[c]))
                if large == small:
                    ok &= sig[c] < sig[x, None]
                if two_blocks:
                    ok &= own[x, None] != own[c]
                i, j = np.nonzero(ok)
                for lo in range(0, len(i), at_once):
                    p, q = i[lo : lo + at_once], j[lo : lo + at_once]
                    differing = np.bitwise_count(x_bits[p + at] ^ y_bits[q]).sum(1).astype(np.int64)
                    p, q = x[p], c[q]
                    both = (n[p] + n[q] - differing) // 2
                    keep = 100 * both >= percent * (n[p] + n[q] - both)
                    if keep.any():
                        yield np.maximum(sig[p[keep]], sig[q[keep]]), np.minimum(sig[p[keep]], sig[q[keep]])


def _verified(pairs: DataFrame, sets: DataFrame, level_b, percent: int) -> DataFrame:
    """The pairs that pass every order's prefix filter and then the exact overlap."""

    def check(batches):
        tidy_worker()
        level = np.frombuffer(level_b.value, np.uint8)
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok = all(len(np.intersect1d(prefix(x, level, o, percent), prefix(y, level, o, percent), assume_unique=True)) for o in (1, 2))
                if ok:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok = 100 * both >= percent * (len(x) + len(y) - both)
                keep.append(ok)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = (pairs.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x")), "a")
            .join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y")), "b"))
    return full.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text, ...).

    Extra columns are ignored, an empty table gives no row, a null doc_id has
    no node and is its own (null) component.
    """
    spark = docs.sparkSession
    prepare(spark)
    sc = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = cut_lineage(set_signatures(docs, k))
    sized = first.where("block is null").select("doc_id", "n", "sig")
    level_b = sc.broadcast(fold_counts(first.where("block is not null"), SKETCH, SKETCH_BLOCK).tobytes())  # SKETCH bytes, fixed
    tokens = sized.agg(F.sum(F.expr(f"n - ceil({percent} * n / 100) + 1"))).first()[0] or 0
    parts = parts_for(spark, tokens, 500_000)
    reps = sized.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    maps = first.where("block is null and counts is not null").groupBy("sig").agg(F.first("n").alias("n"), F.first("counts").alias("map"))
    shared = cut_lineage(_shared(_postings(docs, k, percent, level_b, parts)))

    def sets_of(wanted: DataFrame) -> DataFrame:
        docs_wanted = wanted.join(reps, "sig").select("rep")
        on_b = sc.broadcast(bit_filter(docs_wanted, "rep", FILTER_BITS).tobytes())  # 4 MB, fixed

        def run(batches):
            tidy_worker()
            on = np.frombuffer(on_b.value, np.uint8)  # a byte a bit would be 32 MB a task
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                hit = (on[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                sub = batch.filter(pa.array(hit))
                out = [(_signature(t), t.tobytes()) for _, t in _sets(sub, k) if len(t)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["sig", "tokens"])

        cells = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("cell"))
        return cells.mapInArrow(run, "sig long, tokens binary").join(wanted, "sig", "left_semi").dropDuplicates(["sig"])

    def linked(pairs: DataFrame) -> DataFrame:
        near = cut_lineage(_within_bound(pairs, maps, percent))
        if near.isEmpty():
            return near.select(F.col("a").alias("u"), F.col("b").alias("v"))
        sets = sets_of(near.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
        r = reps.select(F.col("sig").alias("a"), F.col("rep").alias("u"))
        s = reps.select(F.col("sig").alias("b"), F.col("rep").alias("v"))
        return cut_lineage(_verified(near, sets, level_b, percent).join(r, "a").join(s, "b").select("u", "v"))

    members = cut_lineage(shared.join(reps, "sig"))
    comp = spark.createDataFrame([], "node long, component long")
    tried = spark.createDataFrame([], "a long, b long")
    fits = f"100 * least(n, hn) >= {percent} * greatest(n, hn)"

    def merged(new: DataFrame) -> DataFrame:
        """Components after more links: those so far stand for all links they came from."""
        return components(new.unionByName(comp.select(F.col("node").alias("u"), F.col("component").alias("v"))))

    def mixed() -> DataFrame:
        """Members of the lists that hold more than one component, with their component and their list's hub."""
        now = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        hubs = now.groupBy("token").agg(F.min(F.struct("component", "sig", "n")).alias("hub"), F.max("component").alias("hi")).where("hub.component <> hi")
        return now.join(hubs, "token").select("token", "sig", "n", "component", F.col("hub.sig").alias("hsig"), F.col("hub.n").alias("hn"), F.col("hub.component").alias("hc"))

    def fresh(pairs: DataFrame) -> DataFrame:
        return cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))

    for _ in range(STAR_ROUNDS):
        votes = mixed().where(f"component <> hc and {fits}").groupBy("sig", "hsig").agg(F.count("*").alias("votes"))
        picks = votes.groupBy("sig").agg(F.max(F.struct("votes", "hsig")).alias("best")).select(F.col("sig").alias("a"), F.col("best.hsig").alias("b"))
        picks = fresh(picks)
        if picks.isEmpty():
            break
        tried = tried.unionByName(picks)
        comp = merged(linked(picks))
    rest = fresh(_crossing(cut_lineage(mixed().select("token", "sig", "component", "hsig")), maps, percent))
    if not rest.isEmpty():
        comp = merged(linked(rest))

    named = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    return (sized.join(named, "sig", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")))


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from d),
n as (select doc_id, len(s) as n from s),
t as (select doc_id, unnest(s) as g from s),
o as (select a.doc_id as a, b.doc_id as b, count(*) as c from t a join t b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select o.a, o.b from o join n x on x.doc_id = o.a join n y on y.doc_id = o.b where 100 * o.c >= 75 * (x.n + y.n - o.c)),
r(doc_id, k) as (select doc_id, doc_id from d union select r.doc_id, l.b from r join l on l.a = r.k)
select n.doc_id, cast(n.n as bigint) as n_shingles, min(r.k) as component_id from n join r on r.doc_id = n.doc_id group by 1, 2
"""
