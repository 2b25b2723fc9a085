"""Keyed tables: upserts that read and rewrite only the files that can hold their keys (2.13).

A table is a folder of Parquet files in commits, with what is known of each
file beside them:

* ``data/commit=<n>``: rows in the order of their key, cut into ranges, so keys that
  are near each other (and came together) share a file;
* ``blooms/commit=<n>``: a Bloom filter of each file's keys;
* ``files/version=<n>``: the files that make up the table after commit n (commit, path, rows,
  smallest and largest value of the first key column); the newest complete version counts.

An upsert finds, by binary search among the ranges, the files of each
commit that can hold a key, asks those files' Bloom filters, and reads the ones that
answer yes.  Files in which a key is really found are replaced by their other rows, all
else stays as it is, and so do files that were read in vain.  A commit is
written under its number before the version that names it, so one that fails leaves
the table as it was, and a repeated one (a replayed micro-batch) is recognised by its tag.

Keys are one or more columns; a row with a NULL in its key is unlike every other and
is never replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import small_bytes
from ..operators.windows import dedupe_last
from ..session import cut_lineage, ship_package
from .io import _fs, list_versions, read_latest, write_version

FILE_ROWS = 1_000_000
BITS_A_KEY = 12
HASHES = 5
_FILES = "commit long, path string, rows long, lo string, hi string, tag string"
RANGE_BYTES = 200  # of a file's line on its way to the tasks: a path and two key values


def bloom_places(h: np.ndarray, bits: int) -> np.ndarray:
    """The cells of each key hash, ``HASHES`` x n (two halves of the hash, stepped)."""
    with np.errstate(over="ignore"):
        x = h.astype(np.int64).view(np.uint64)
        y = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        return ((x + np.arange(HASHES, dtype=np.uint64)[:, None] * y) >> np.uint64(64 - int(math.log2(bits)))).astype(np.int64)


def bloom_of(h: np.ndarray, bits: int) -> bytes:
    on = np.zeros(bits, bool)
    on[bloom_places(h, bits).ravel()] = True
    return np.packbits(on, bitorder="little").tobytes()


def bloom_holds(bloom: bytes, h: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter (never false for one that is)."""
    b = np.frombuffer(bloom, np.uint8)
    at = bloom_places(h, len(b) * 8)
    return ((b[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def _placed(table: list[tuple[list[str], list[str], list[str]]]):
    """Task function: (path, h) of every file whose range holds a key; ``table`` has (lo, hi, path) lists in order, one for each commit."""

    def run(batches) -> Iterator:
        for b in batches:
            place, h = np.array(b.column("place").to_pylist(), object), b.column("h").to_numpy()
            paths, keys = [], [np.zeros(0, np.int64)]
            for lo, hi, path in table:
                first = np.searchsorted(np.array(hi, object), place, "left")
                last = np.searchsorted(np.array(lo, object), place, "right")
                n = np.maximum(last - first, 0)
                at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                paths += [path[i] for i in at]
                keys.append(np.repeat(h, n))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(np.concatenate(keys))], ["path", "h"])

    return run


class KeyedTable:
    """See the module's text.  ``file_rows`` is the number of rows that a commit aims at for a file."""

    def __init__(self, spark: SparkSession, base: str, keys: list[str], file_rows: int = FILE_ROWS):
        self.spark, self.base, self.keys, self.file_rows = spark, base.rstrip("/"), list(keys), file_rows

    # ---- reading ----

    def files(self) -> DataFrame:
        """The table's files: (commit, path, rows, lo, hi, tag), paths relative to the table."""
        now = read_latest(self.spark, f"{self.base}/files")
        return self.spark.createDataFrame([], _FILES) if now is None else now.select(*[c.split()[0] for c in _FILES.split(", ")])

    def read(self) -> DataFrame | None:
        """All rows; None before the first commit."""
        paths = [r.path for r in self.files().where("path is not null").select("path").collect()]  # file names, as Spark's own listing holds them
        return self._rows(paths) if paths else None

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.base}/data").parquet(*[f"{self.base}/{p}" for p in paths]).drop("commit")

    # ---- writing ----

    def _hash(self) -> Column:
        known = F.lit(True)
        for k in self.keys:
            known = known & F.col(k).isNotNull()
        return F.when(known, F.xxhash64(*self.keys))

    def _place(self, df: DataFrame) -> Column:
        """The first key column as a text that sorts like it; NULL where the key has a NULL."""
        c, kind = F.col(self.keys[0]), dict(df.dtypes)[self.keys[0]]
        if kind in ("timestamp", "timestamp_ntz", "date"):
            c, kind = F.unix_micros(c.cast("timestamp")), "bigint"
        if kind in ("tinyint", "smallint", "int", "bigint"):
            c = F.lpad((c.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
        elif kind != "string":
            raise ValueError(f"a key column of type {kind} has no ranges")
        return F.when(self._hash().isNotNull(), c)

    def _committed(self, rows: DataFrame, n: int, commit: int, tag: str | None) -> DataFrame:
        """Write a commit's files (of ``n`` rows) and their Bloom filters; their lines for the file list."""
        parts = max(1, -(-n // self.file_rows))
        data = f"{self.base}/data/commit={commit}"
        cut = rows.repartitionByRange(parts, *self.keys) if parts > 1 else rows.coalesce(1)
        cut.sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(data)
        bits = 1 << max(10, math.ceil(math.log2(max(1, min(n, 2 * self.file_rows)) * BITS_A_KEY)))
        ship_package(self.spark)

        def partial(batches) -> Iterator:
            """One filter for each file a task reads a part of."""
            held: dict = {}
            for b in batches:
                for p in pc.unique(b.column("path")).to_pylist():
                    mine = b.filter(pc.equal(b.column("path"), p))
                    known = mine.filter(pc.is_valid(mine.column("place")))
                    rows_, lo, hi, on = held.get(p, (0, None, None, np.zeros(bits, bool)))
                    if len(known):
                        on[bloom_places(known.column("h").to_numpy(), bits).ravel()] = True
                        ends = pc.min_max(known.column("place")).as_py()
                        lo, hi = min([ends["min"], *([lo] if lo is not None else [])]), max([ends["max"], *([hi] if hi is not None else [])])
                    held[p] = (rows_ + len(mine), lo, hi, on)
            names = ["path", "rows", "lo", "hi", "bloom"]
            cols = [list(held), *[[v[i] for v in held.values()] for i in range(3)], [np.packbits(v[3], bitorder="little").tobytes() for v in held.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()))], names)

        def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One file's filter and range from those of its parts."""
            out, rows_, lo, hi = np.zeros(bits // 8, np.uint8), 0, [], []
            for b in batches:
                for r in b.to_pylist():
                    out |= np.frombuffer(r["bloom"], np.uint8)
                    rows_ += r["rows"]
                    lo, hi = lo + [r["lo"]] * (r["lo"] is not None), hi + [r["hi"]] * (r["hi"] is not None)
            yield pa.RecordBatch.from_pylist([{"path": key[0].as_py(), "rows": rows_, "lo": min(lo, default=None), "hi": max(hi, default=None), "bloom": out.tobytes()}],
                                             schema=pa.schema([("path", pa.string()), ("rows", pa.int64()), ("lo", pa.string()), ("hi", pa.string()), ("bloom", pa.binary())]))

        written = self.spark.read.parquet(data)
        written = written.select(F.regexp_extract("_metadata.file_path", r"(data/commit=[^/]+/[^/]+)$", 1).alias("path"),
                                 self._hash().alias("h"), self._place(written).alias("place"))
        schema = "path string, rows long, lo string, hi string, bloom binary"
        known = written.mapInArrow(partial, schema).groupBy("path").applyInArrow(merged, schema)
        known.write.mode("overwrite").parquet(f"{self.base}/blooms/commit={commit}")
        lines = self.spark.read.parquet(f"{self.base}/blooms/commit={commit}")
        return lines.select(F.lit(commit).cast("long").alias("commit"), "path", "rows", "lo", "hi", F.lit(tag).cast("string").alias("tag"))

    def candidates(self, keys: DataFrame) -> list[str]:
        """Paths of the files that may hold one of the keys (columns ``h`` and ``place``, distinct, without NULL)."""
        files = self.files().where("lo is not null").orderBy("commit", "lo", "hi").collect()  # a line a file, as Spark's own listing
        commits: dict[int, list] = {}
        for r in files:
            commits.setdefault(r.commit, []).append(r)
        most, groups = max(1, small_bytes(self.spark) // RANGE_BYTES), [[]]
        for lines in commits.values():  # ranges go to the tasks in groups of bounded size
            if groups[-1] and sum(map(len, groups[-1])) + len(lines) > most:
                groups.append([])
            groups[-1].append(lines)
        ship_package(self.spark)
        near = None
        for group in groups if commits else []:
            found = keys.mapInArrow(_placed([([x.lo for x in v], [x.hi for x in v], [x.path for x in v]) for v in group]), "path string, h long")
            near = found if near is None else near.unionByName(found)
        if near is None:
            return []
        blooms = self.spark.read.parquet(*[f"{self.base}/blooms/commit={c}" for c in commits]).select("path", "bloom")

        def ask(key, left, right):
            hit = len(left) and len(right) and bool(bloom_holds(right["bloom"].iloc[0], left["h"].to_numpy()).any())
            return pd.DataFrame({"path": [key[0]] if hit else []}, dtype=object)

        got = near.groupBy("path").cogroup(blooms.groupBy("path")).applyInPandas(ask, "path string")
        return sorted(r.path for r in got.collect())

    def upsert(self, incoming: DataFrame, order: list[str] | None = None, tag: str | None = None) -> dict[str, list[str]]:
        """Insert or replace by key; of several incoming rows with one key the last by ``order`` stays.

        Returns the paths that were read and those that were replaced.  A commit
        with a ``tag`` that the table knows already is not done again.
        """
        files = self.files()
        if tag is not None and not files.where(F.col("tag") == tag).isEmpty():
            return {"read": [], "replaced": []}
        fresh = dedupe_last(incoming, self.keys, order) if order else incoming.dropDuplicates(self.keys)
        known = F.lit(True)
        for k in self.keys:
            known = known & F.col(k).isNotNull()
        fresh = cut_lineage(fresh.where(known).unionByName(incoming.where(~known)))
        read = self.candidates(fresh.select(self._hash().alias("h"), self._place(fresh).alias("place")).where("place is not null"))
        replaced: list[str] = []
        rows, n = fresh, fresh.count()
        if read:
            old = self._rows(read).withColumn("_path", F.regexp_extract(F.col("_metadata.file_path"), r"(data/commit=[^/]+/[^/]+)$", 1))
            keys = fresh.select(*self.keys)
            gone = {r._path: r["count"] for r in old.join(keys, self.keys, "left_semi").groupBy("_path").count().collect()}
            replaced = sorted(gone)
            if replaced:
                # the rows that stay are the file list's count less those just found: the join that keeps them is not run to count them
                held = files.where(F.col("path").isin(replaced)).agg(F.sum("rows")).first()[0]
                n += held - sum(gone.values())
                kept = self._rows(replaced).join(keys, self.keys, "left_anti")
                rows = kept.select(*fresh.columns).unionByName(fresh)
        versions = list_versions(self.spark, f"{self.base}/files")
        commit = versions[-1] + 1 if versions else 0
        lines = self._committed(rows, n, commit, tag)
        stays = files.where(~F.coalesce(F.col("path").isin(replaced), F.lit(False)) if replaced else F.lit(True))
        # a commit without rows has no file but leaves its tag
        mark = self.spark.createDataFrame([(commit, None, 0, None, None, tag)], _FILES) if tag is not None else self.spark.createDataFrame([], _FILES)
        write_version(cut_lineage(stays.unionByName(lines).unionByName(mark)).coalesce(1), f"{self.base}/files", commit)
        return {"read": read, "replaced": replaced}

    def unused(self) -> list[str]:
        """Data files that the newest version does not name: left by replaced rows or a commit that failed."""
        fs, p = _fs(self.spark, f"{self.base}/data")
        if not fs.exists(p):
            return []
        named = {r.path for r in self.files().where("path is not null").select("path").collect()}
        out = []
        for st in fs.listStatus(p):
            for f in fs.listStatus(st.getPath()):
                path = f"data/{st.getPath().getName()}/{f.getPath().getName()}"
                if path.endswith(".parquet") and path not in named:
                    out.append(path)
        return sorted(out)
