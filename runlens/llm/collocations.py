"""Phrase collocations by best-first branch and bound over growing phrases.

Everything is counted per language.  A phrase of 2 to 4 words that occurs at
least ``LEAST`` times is a candidate; its score is the lowest, over its cuts
into a first part and a rest, of floor(2000000 a / (l + r)).

* Words are counted with their text, then pairs of frequent words: a phrase
  can't be a candidate unless its words and pairs are frequent.
* A phrase p bounds all that grow from it: a longer phrase has a' <= a(p), its
  first word the same count l, and a rest that occurs at least a' times, so it
  scores at most floor(2000000 a / (l + a)).  The frontier is expanded best
  bound first: a round takes every pair whose bound reaches the 2000th best
  score (ties included) among the candidates not known to be dropped, and counts
  in one pass all that grows from it to the right, by one word and by two, and
  what holds the three-word phrases among it with a word before them.
* A candidate that reaches that score is settled by counting its extensions to
  both sides: it is dropped if one of them occurs 0.8 times as often.  (A phrase
  inside one two words longer is also inside the one between, which is as
  frequent, so one word is enough.)  A three-word phrase that reaches it has a
  pair in front whose bound does, so that pass has settled it.
* Rounds end when no pair with a sufficient bound is left to expand, no
  candidate with a sufficient score is left to settle, and no four-word phrase that
  could have one lacks the count of its last three words: then the 2000th
  surviving score of each language, ties included, is settled.  To save passes
  a round also takes what reaches ``SLACK`` of that score; more is counted than
  needed, never less.

Tasks keep one block of texts and bounded count buffers and hand on partial
counts.  Which phrases to count reaches them as bit maps of fixed size
(``FILTER_BITS``); a phrase that they take by mistake is counted exactly like any
other.  Words are known by 64-bit hashes of their bytes (see ``Block.hashes``), phrases by their words.

Null texts are empty, null languages are ``und``; an empty table, or one
without a frequent phrase, gives no row; repeated rows count each time; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.jobs import parts_for, prepare
from runlens.llm.textblocks import Block, blocks, mix64
from runlens.session import cut_lineage

LEAST = 30
TOP = 2000
SLACK = 0.75
FILTER_BITS = 1 << 25
HELD = 1 << 21  # words, pairs or phrases that a task gathers before it adds them up
GROUP_TOKENS = 1_000_000
SPREAD = 8

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP |= _BREAK


def _words(b: Block) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased block, hashes, starts, ends of its words, whether a word and the next one lie in one piece)."""
    low = b.lowered()
    start, end, _ = low.runs(_GAP)
    breaks = np.r_[0, np.cumsum(_BREAK[low.buf])]
    text = np.searchsorted(low.offs, start, "right")
    joined = np.zeros(len(start), bool)
    if len(start):
        joined[:-1] = (breaks[start[1:]] == breaks[end[:-1]]) & (text[1:] == text[:-1])
    return low, low.hashes(start, end), start, end, joined


def _grown(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Filter key of a phrase that is one word longer (a word's own key is its hash)."""
    with np.errstate(over="ignore"):
        return mix64(key * np.uint64(0xD6E8FEB86659FD93) + mix64(word, 7))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    lang = pc.fill_null(batch.column("lang"), "und")
    for value in pc.unique(lang).to_pylist():
        yield value, batch.column("text").filter(pc.equal(lang, value))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, w, word, c): partial counts of words; w 0 without a word holds all of a language's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, dict[int, bytes]] = {}
        held: dict[str, list] = {}

        def flush(lang):
            keys, counts = (np.concatenate(x) for x in zip(*held.pop(lang)))
            keys, back = np.unique(keys, return_inverse=True)
            counts = np.bincount(back, counts).astype(np.int64)
            own = names.pop(lang)
            words = [None, *[own[k].decode("utf-8", "replace") for k in keys.tolist()]]
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), pa.array(np.r_[np.uint64(0), keys].view(np.int64)), pa.array(words, pa.string()),
                 pa.array(np.r_[counts.sum(), counts])], ["lang", "w", "word", "c"])

        for batch in batches:
            for lang, texts in _by_language(batch):
                for b in blocks(texts):
                    low, key, start, end, _ = _words(b)
                    if not len(key):
                        continue
                    keys, first, counts = np.unique(key, return_index=True, return_counts=True)
                    held.setdefault(lang, []).append((keys, counts))
                    own, raw = names.setdefault(lang, {}), low.buf.tobytes()
                    for k, s, e in zip(keys.tolist(), start[first].tolist(), end[first].tolist()):
                        if k not in own:
                            own[k] = raw[s:e]
                    if len(own) > HELD // 4 or sum(len(h[0]) for h in held[lang]) > 2 * HELD:
                        yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    return docs.mapInArrow(run, "lang string, w long, word string, c long")


def key_filters(keys: DataFrame, bits: int = FILTER_BITS) -> dict[str, bytes]:
    """For each ``kind`` that has a row, a bit map of the low bits of the column ``key``: ``bits`` / 8 bytes, whatever the number of keys."""
    block = min(bits, 1 << 21)
    cells = keys.select("kind", F.col("key").bitwiseAND(F.lit(bits - 1)).alias("cell")).distinct()

    def fold(key: tuple, groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = np.zeros(block, bool)
        for pdf in groups:
            on[pdf["cell"].to_numpy() % block] = True
        yield pd.DataFrame({"kind": [key[0]], "block": [key[1]], "on": [np.packbits(on, bitorder="little").tobytes()]})

    out: dict[str, np.ndarray] = {}
    folded = cells.withColumn("block", (F.col("cell") / F.lit(block)).cast("int")).groupBy("kind", "block").applyInPandas(fold, "kind string, block int, on binary")
    for r in folded.collect():  # kinds x bits / 8 bytes
        out.setdefault(r.kind, np.zeros(bits // 8, np.uint8))[r.block * block // 8 : (r.block + 1) * block // 8] = np.frombuffer(r.on, np.uint8)
    return {k: v.tobytes() for k, v in out.items()}


def _on(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    cell = key & np.uint64(len(bits) * 8 - 1)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of parallel word columns and how often each occurs (exact: columns are numbered one by one)."""
    back = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own, at = np.unique(c, return_inverse=True)
        back = np.unique(back * len(own) + at, return_inverse=True)[1]
    _, first, number = np.unique(back, return_index=True, return_inverse=True)
    total = np.bincount(number, counts, minlength=len(first)).astype(np.int64)
    return [c[first] for c in columns], total


def _pair_counts(docs: DataFrame, on_b, parts: int) -> DataFrame:
    """(lang, w1, w2, a, key) of the pairs of frequent words that occur at least ``LEAST`` times.

    Partial counts are dealt by the first word and ``SPREAD`` shares of the
    second one, so no word makes a group; a group adds up as its parts arrive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, held = np.frombuffer(on_b.value, np.uint8), {}

        def flush(lang):
            (a, b), c = _counted([np.concatenate(x) for x in zip(*held.pop(lang))])
            part = (mix64(a, 51) % np.uint64(parts // SPREAD)).astype(np.int64) * SPREAD + (mix64(b, 52) % np.uint64(SPREAD)).astype(np.int64)
            order = np.lexsort((b, a, part))
            a, b, c, part = a[order], b[order], c[order].astype(np.uint32), part[order]
            cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
            rows = [[], [], [], []]
            for lo, hi in zip(cut[:-1], cut[1:]):
                x = a[lo:hi]
                new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                rows[0].append(x[new].tobytes()), rows[1].append(np.diff(np.r_[new, len(x)]).astype(np.uint32).tobytes())
                rows[2].append(b[lo:hi].tobytes()), rows[3].append(c[lo:hi].tobytes())
            on_parts = part[cut[:-1]].astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(on_parts), pa.string()), pa.array(on_parts), *[pa.array(r, pa.binary()) for r in rows]],
                                              ["lang", "part", "first", "runs", "second", "counts"])

        for batch in batches:
            for lang, texts in _by_language(batch):
                for b in blocks(texts):
                    _, key, _, _, joined = _words(b)
                    live = _on(on, key)
                    i = np.flatnonzero(joined[:-1] & live[:-1] & live[1:])
                    if len(i):
                        held.setdefault(lang, []).append((key[i], key[i + 1]))
                        if sum(len(h[0]) for h in held[lang]) > 2 * HELD:
                            yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def merged():
            a, b, c = (np.concatenate(x) for x in zip(*held))
            (a, b), c = _counted([a, b], c)
            return a, b, c

        for batch in batches:
            for r in batch.to_pylist():
                held.append((np.repeat(np.frombuffer(r["first"], np.uint64), np.frombuffer(r["runs"], np.uint32)), np.frombuffer(r["second"], np.uint64),
                             np.frombuffer(r["counts"], np.uint32).astype(np.int64)))
                if sum(len(h[0]) for h in held[1:]) > max(HELD, len(held[0][0])):
                    held[:] = [merged()]
        a, b, c = merged()
        often = c >= LEAST
        a, b, c = a[often], b[often], c[often]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(a), pa.string()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(c),
                                          pa.array(_grown(a, b).view(np.int64))], ["lang", "w1", "w2", "a", "key"])

    sent = docs.mapInArrow(run, "lang string, part int, first binary, runs binary, second binary, counts binary")
    return sent.groupBy("lang", "part").applyInArrow(add, "lang string, w1 long, w2 long, a long, key long")


def _extended(docs: DataFrame, filters: dict) -> DataFrame:
    """(lang, w1..w4, a): exact counts of three- and four-word phrases (w4 0: three words) that hold

    * a pair of the filter ``right`` at their front, or (four words) in their middle;
    * for three words: a pair of the filter ``left`` at their end.

    All pairs in a phrase are frequent (filter ``pairs``).  Counts below ``LEAST`` are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = {k: np.frombuffer(b.value, np.uint8) if b else None for k, b in filters.items()}
        held: dict[str, list] = {}

        def asked(kind, key, pair):
            out = np.zeros(len(pair), bool)
            if on[kind] is not None:
                out[pair] = _on(on[kind], key)
            return out

        def flush(lang):
            cols, c = _counted([np.concatenate(x) for x in zip(*held.pop(lang))])
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), *[pa.array(x.view(np.int64)) for x in cols], pa.array(c)],
                                              ["lang", "w1", "w2", "w3", "w4", "a"])

        for batch in batches:
            for lang, texts in _by_language(batch):
                for b in blocks(texts):
                    _, w, _, _, joined = _words(b)
                    if len(w) < 3:
                        continue
                    at = np.flatnonzero(joined[:-1])
                    key = _grown(w[at], w[at + 1])
                    keep = _on(on["pairs"], key)
                    pair = np.zeros(len(w), bool)  # a frequent pair begins at this word
                    pair[at[keep]] = True
                    right, left = asked("right", key[keep], pair), asked("left", key[keep], pair)
                    three = pair[:-2] & pair[1:-1]
                    i = np.flatnonzero(three & (right[:-2] | left[1:-1]))
                    j = np.flatnonzero(three[:-1] & pair[2:-1] & (right[:-3] | right[1:-2]))
                    found = [(w[i], w[i + 1], w[i + 2], np.zeros(len(i), np.uint64)), (w[j], w[j + 1], w[j + 2], w[j + 3] if len(j) else w[j])]
                    found = [x for x in found if len(x[0])]
                    if found:
                        held.setdefault(lang, []).extend(found)
                        if sum(len(h[0]) for h in held[lang]) > HELD:
                            yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    sent = docs.mapInArrow(run, "lang string, w1 long, w2 long, w3 long, w4 long, a long")
    return sent.groupBy("lang", "w1", "w2", "w3", "w4").agg(F.sum("a").alias("a")).where(F.col("a") >= LEAST)


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)) as a long; exact, the product has up to 27 digits."""
    return F.expr(f"(cast(2000000 as decimal(7,0)) * cast({a} as decimal(20,0))) div (cast({l} as decimal(20,0)) + cast({r} as decimal(20,0)))").cast("long")


def _lowest(df: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """Add l, r and score of the lowest-scoring cut (the first one of equals)."""
    each = [_score("a", x, y) for x, y in cuts]
    df = df.select("*", *[e.alias(f"_s{i}") for i, e in enumerate(each)])
    names = [f"_s{i}" for i in range(len(cuts))]
    low = F.least(*names) if len(cuts) > 1 else F.col(names[0])
    pick = F.coalesce(*[F.when(F.col(n) == low, F.struct(F.col(x).alias("l"), F.col(y).alias("r"))) for n, (x, y) in zip(names, cuts)])
    return df.select("*", low.alias("score"), pick.alias("_cut")).select("*", "_cut.l", "_cut.r").drop("_cut", *names)


class _Mining:
    """The tables of the search: pairs, three- and four-word phrases with their counts and scores.

    ``most`` is the largest count of a phrase one word longer that holds this one, as far
    as known; ``right`` and ``left`` tell to which sides all extensions of a pair were counted.
    """

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        prepare(spark)
        self.sc = spark.sparkContext
        self.docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
        self.words = cut_lineage(_word_counts(self.docs).groupBy("lang", "w", "word").agg(F.sum("c").alias("f")).where(f"word is null or f >= {LEAST}"))
        frequent = self.words.where("word is not null")
        tokens = self.words.where("word is null").agg(F.sum("f")).first()[0] or 0
        parts = -(-parts_for(spark, tokens, GROUP_TOKENS) // SPREAD) * SPREAD
        on_b = self._filter(frequent.select(F.col("w").alias("key")))
        pairs = _pair_counts(self.docs, on_b, parts)
        of = lambda n: frequent.select("lang", F.col("w").alias(f"w{n}"), F.col("f").alias(f"f{n}"))
        pairs = _lowest(pairs.join(of(1), ["lang", "w1"]).join(of(2), ["lang", "w2"]), [("f1", "f2")])
        none = F.lit(0).cast("long").alias("most")
        self.pairs = cut_lineage(pairs.select("lang", "w1", "w2", "key", "a", "f1", "f2", "l", "r", "score", _bound().alias("bound"), none,
                                              F.lit(False).alias("right"), F.lit(False).alias("left")))
        on_b.destroy()
        self.pair_filter = self._filter(self.pairs.select("key"))
        words = "lang string, w1 long, w2 long, w3 long, "
        self.threes = spark.createDataFrame([], words + "a long, a12 long, a23 long, f1 long, f3 long, l long, r long, score long, most long")
        self.fours = spark.createDataFrame([], words + "w4 long, a long, l long, r long, score long, possible long")

    def _filter(self, keys: DataFrame):
        return self.sc.broadcast(key_filters(keys.withColumn("kind", F.lit("all"))).get("all", bytes(FILTER_BITS // 8)))

    def _alive(self, columns: list[str]) -> DataFrame:
        """Candidates that no known phrase drops."""
        none = F.lit(0).cast("long")
        twos = self.pairs.where(~_dropped()).withColumn("w3", none).withColumn("w4", none).select(columns)
        return (twos.unionByName(self.threes.where(~_dropped()).withColumn("w4", none).select(columns))
                .unionByName(self.fours.where("score is not null").select(columns)))

    def round(self) -> bool:
        """Count what the frontier and the unsettled candidates ask for; False if nothing is left to count."""
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
        need = (self._alive(["lang", "score"]).withColumn("place", place).where(f"place <= {TOP}").groupBy("lang")
                .agg(F.floor(F.when(F.count("*") == TOP, F.min("score")).otherwise(F.lit(0)) * F.lit(SLACK)).alias("need")))
        need = cut_lineage(need.coalesce(1))  # a row for each language that has a candidate
        pairs = self.pairs.join(need, "lang", "left").withColumn("need", F.coalesce("need", F.lit(0)))
        settle = ~_dropped() & (F.col("score") >= F.col("need"))
        pairs = pairs.withColumn("go_right", ~F.col("right") & (settle | (F.col("bound") >= F.col("need")))).withColumn("go_left", ~F.col("left") & settle).drop("need")
        lacking = (self.fours.where("score is null").join(need, "lang").where("possible >= need")
                   .select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.lit(True).alias("lacks")).distinct())
        pairs = pairs.join(lacking, ["lang", "w1", "w2"], "left")
        pairs = cut_lineage(pairs.withColumn("go_right", F.col("go_right") | (~F.col("right") & F.coalesce("lacks", F.lit(False)))).drop("lacks"))
        sides = F.array_compact(F.array(*[F.when(F.col(f"go_{s}"), F.lit(s)) for s in ("right", "left")]))
        made = key_filters(pairs.select("key", F.explode(sides).alias("kind")))
        if not made:
            return False
        filters = {k: self.sc.broadcast(made[k]) if k in made else None for k in ("right", "left")}
        got = cut_lineage(_extended(self.docs, filters | {"pairs": self.pair_filter}))
        for b in filters.values():
            if b:
                b.destroy()
        p, three, four = self.pairs, got.where("w4 = 0").drop("w4"), got.where("w4 <> 0")
        new = (three.join(self.threes, ["lang", "w1", "w2", "w3"], "left_anti")
               .join(p.select("lang", "w1", "w2", F.col("a").alias("a12"), "f1"), ["lang", "w1", "w2"])
               .join(p.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"), F.col("f2").alias("f3")), ["lang", "w2", "w3"]))
        new = _lowest(new, [("f1", "a23"), ("a12", "f3")]).withColumn("most", F.lit(0).cast("long")).select(self.threes.columns)
        self.threes = cut_lineage(_held(self.threes.unionByName(new), four, 3))
        pairs = pairs.withColumn("right", F.col("right") | F.col("go_right")).withColumn("left", F.col("left") | F.col("go_left")).drop("go_right", "go_left")
        self.pairs = cut_lineage(_held(pairs, three, 2))
        t = self.threes
        four = four.unionByName(self.fours.select(four.columns)).dropDuplicates(["lang", "w1", "w2", "w3", "w4"])
        four = (four.join(t.select("lang", "w1", "w2", "w3", F.col("a").alias("a123"), "a12", "f1"), ["lang", "w1", "w2", "w3"], "left")
                .join(t.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("a").alias("a234"),
                               F.col("a23").alias("a34"), F.col("f3").alias("f4")), ["lang", "w2", "w3", "w4"], "left"))
        # without its first three words a phrase grew from a pair that does not reach the needed score; without its last three it scores at most this
        four = _lowest(four, [("f1", "a234"), ("a12", "a34"), ("a123", "f4")]).withColumn("possible", F.when(F.col("a123").isNotNull(), _score("a", "f1", "a")))
        whole = F.col("a123").isNotNull() & F.col("a234").isNotNull()
        self.fours = cut_lineage(four.withColumn("score", F.when(whole, F.col("score"))).select(self.fours.columns))
        return True

    def best(self) -> DataFrame:
        all_ = self._alive(["lang", "w1", "w2", "w3", "w4", "a", "l", "r", "score"])
        # everything that ties with the last place stays until the phrases' texts decide
        first = all_.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(f"place <= {TOP}").drop("place")
        first = first.withColumn("id", F.concat_ws(" ", "w1", "w2", "w3", "w4"))
        spread = first.select("lang", "id", F.posexplode(F.filter(F.array("w1", "w2", "w3", "w4"), lambda w: w != 0)).alias("i", "w"))
        texts = spread.join(self.words.where("word is not null"), ["lang", "w"]).groupBy("lang", "id").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
        first = first.join(texts, ["lang", "id"]).join(self.words.where("word is null").select("lang", F.col("f").alias("n")), "lang")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
        return first.withColumn("rank", rank.cast("long")).where(f"rank <= {TOP}").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _bound() -> Column:
    """No phrase that begins with this one scores more: its first word has the count f1, what follows one of at least its own."""
    return _score("a", "f1", "a")


def _dropped() -> Column:
    return F.expr("cast(100 as decimal(3,0)) * cast(most as decimal(20,0)) >= cast(80 as decimal(2,0)) * cast(a as decimal(20,0))")


def _held(t: DataFrame, longer: DataFrame, n: int) -> DataFrame:
    """``t`` (phrases of n words) with ``most`` after more phrases of n + 1 words."""
    words = [f"w{i + 1}" for i in range(n)]
    sides = [F.struct(*[F.col(f"w{i + 1 + s}").alias(w) for i, w in enumerate(words)], F.col("a").alias("now")) for s in (0, 1)]
    held = longer.select("lang", F.explode(F.array(*sides)).alias("p")).select("lang", "p.*").groupBy("lang", *words).agg(F.max("now").alias("now"))
    return t.join(held, ["lang", *words], "left").withColumn("most", F.greatest("most", F.coalesce("now", F.lit(0)))).drop("now")


def collocations(docs: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``TOP`` collocations of ``docs`` (text, lang)."""
    mining = _Mining(docs)
    while mining.round():
        pass
    out = cut_lineage(mining.best())
    mining.pair_filter.destroy()
    return out


def op11_best_first_growth(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || chr(9),
                                                            'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 10) || ' ') as t from documents),
p as (select lang, unnest(string_split(t, chr(10))) as p from t),
w as (select lang, list_filter(string_split(p, ' '), lambda x: x <> '') as w from p where p <> ''),
n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
g as (select lang, m, unnest(list_transform(range(1, greatest(1, len(w) - m + 2)), lambda i: array_to_string(w[i:i + m - 1], ' '))) as g
      from w, (select unnest([1, 2, 3, 4]) as m)),
f as (select lang, m, g, count(*) as a from g group by lang, m, g having count(*) >= 30),
c as (select *, string_split(g, ' ') as v from f where m > 1),
u as (select lang, m, g, a, unnest(list_transform(range(1, m), lambda i: {'k': i, 'x': array_to_string(v[1:i], ' '), 'y': array_to_string(v[i + 1:], ' ')})) as u from c),
v as (select lang, m, g, a, u.k as k, u.x as x, u.y as y from u),
k as (select v.lang, v.m, v.g, v.a, x.a as l, y.a as r, v.k, cast(2000000 as hugeint) * v.a // (x.a + y.a) as s
      from v join f x on x.lang = v.lang and x.g = v.x join f y on y.lang = v.lang and y.g = v.y),
b as (select * from k qualify row_number() over (partition by lang, g order by s, k) = 1),
h as (select lang, g, max(a) as a from (select lang, array_to_string(v[1:m - 1], ' ') as g, a from c where m > 2
                                        union all select lang, array_to_string(v[2:], ' '), a from c where m > 2
                                        union all select lang, array_to_string(v[1:2], ' '), a from c where m > 3
                                        union all select lang, array_to_string(v[2:3], ' '), a from c where m > 3
                                        union all select lang, array_to_string(v[3:4], ' '), a from c where m > 3) group by lang, g)
select b.lang, row_number() over (partition by b.lang order by s desc, b.a desc, b.g) as rank, b.g as phrase, b.a, l, r, n, cast(s as bigint) as score
from b join n on n.lang = b.lang left join h on h.lang = b.lang and h.g = b.g
where h.a is null or 100 * h.a < 80 * b.a
qualify rank <= 2000
"""
