"""Language identification by rank-order profiles.

A text's profile is the list of its ``PROFILE`` most frequent letter n-grams
(1 to 3 letters of one word, the word's edges shown by a space), ordered by
count, ties by code points.  A language's profile is made the same way from
the summed counts of all its training documents.  A document gets the language
with the smallest out-of-place distance: the sum over its n-grams of the
difference of ranks, ``PROFILE`` for an n-gram that the language lacks.

``score`` is second / (first + second) of the two smallest distances (0.5 to
1; with one learned language, 1 - distance / largest possible distance).
Null texts, texts without a letter and texts seen without any learned
language are ``und`` with score 0.  Ties go to the first language in order.
Whole texts are counted, and all training documents; only the profiles
(``PROFILE`` rows a language) reach the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.jobs import prepare, tidy_worker
from runlens.llm.textblocks import crc32_mod

PROFILE = 400
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text (unordered); empty if it has no letter."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_is_letter()[c], c, np.uint32(32)).astype(np.int64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != 32], two, three[c[1:-1] != 32]])


def ranked(grams: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order."""
    code, n = np.unique(grams, return_counts=True)
    return code[np.argsort(-n, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, rank, gram) of every language of ``docs`` (text, lang), from all its rows with a text and a lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy_worker()
        total: dict[str, list] = {}

        def settle(lang):
            codes, counts = (np.concatenate(x) for x in zip(*total[lang]))
            code, back = np.unique(codes, return_inverse=True)
            total[lang] = [(code, np.bincount(back, counts, len(code)).astype(np.int64))]

        for b in batches:
            texts: dict[str, list[str]] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for i in range(0, len(own), 64):
                    got = total.setdefault(lang, [])
                    got.append(np.unique(np.concatenate([ngrams(t) for t in own[i : i + 64]]), return_counts=True))
                    if sum(len(x[0]) for x in got) > 2_000_000:
                        settle(lang)
        for lang in total:
            settle(lang)
            code, n = total[lang][0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "gram", "n"])

    counts = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
            .withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "rank", "gram"))


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.langs = size, sorted({r[0] for r in rows})
        grams = np.unique(np.array([r[2] for r in rows], np.int64))
        self.grams = np.r_[grams, np.int64(np.iinfo(np.int64).max)]
        self.rank = np.full((len(self.grams), len(self.langs)), -1, np.int64)
        for lang, rank, gram in rows:
            self.rank[np.searchsorted(grams, gram), self.langs.index(lang)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.decide(text)[:2]

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text is kept: it has a letter and no second language is as near as the first."""
        own = ranked(ngrams(text or ""), self.size)
        if not len(own) or not self.langs:
            return "und", 0.0, len(own) > 0
        at = np.searchsorted(self.grams, own)
        rank = np.where((self.grams[at] == own)[:, None], self.rank[at], -1)
        apart = np.where(rank >= 0, np.abs(rank - np.arange(len(own))[:, None]), self.size).sum(0)
        best = int(np.argmin(apart))
        if len(self.langs) == 1:
            return self.langs[0], 1 - float(apart[0]) / (self.size * len(own)), True
        second = float(np.delete(apart, best).min())
        total = second + float(apart[best])
        return self.langs[best], second / total if total else 0.5, second > float(apart[best])


def identify(docs: DataFrame, profiles: list[tuple[str, int, int]], size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score added; only ``text`` is looked at."""
    prepare(docs.sparkSession)
    made = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, size))  # size rows a language
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy_worker()
        for b in batches:
            got = [made.value.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", lang_pred string, score double")


def known_language(docs: DataFrame, profiles: list[tuple[str, int, int]], size: int = PROFILE) -> DataFrame:
    """The rows of ``docs`` that have a letter and no tie of two languages; with no or one learned language there is no tie."""
    prepare(docs.sparkSession)
    made = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, size))  # size rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy_worker()
        for b in batches:
            yield b.filter(pa.array([made.value.decide(t)[2] for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def trained_profiles(docs: DataFrame) -> list[tuple[str, int, int]]:
    """Profiles from the documents whose crc32(doc_id) mod 4 is not 2."""
    prepare(docs.sparkSession)
    return [tuple(r) for r in learn_profiles(docs.where(crc32_mod("doc_id", 4) != 2)).collect()]


def op5_rank_order(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = identify(docs.select("doc_id", "text"), trained_profiles(docs))
    return known.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
