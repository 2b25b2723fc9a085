"""Reading one large quoted CSV or JSON list with many tasks.

Records of such files span lines, so a byte range can't be read alone: whether
it begins inside a quoted field (a string, at which depth) depends on all that
comes before.  ``split_records`` finds out in two passes over Spark's own
text splits (any store that Spark reads):

1. Each split runs a small automaton from every state it could begin in and
   gives one row: the state it ends in for each of them (and the change of depth).
   Per file these rows are chained in order, which gives each split its state.
2. Each split is cut into records from its known state.  What a record has in
   other splits (one piece at each end of a split, at most) is put together by
   its place.

The first pass hands on one row a split, the second one shuffles only records
that cross a split's edge; rows stay in the order of the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

# the states of 2^16 splits (8 TB at 128 MB each) take about 8 MB: broadcast up to there
BROADCAST_SPLITS = 1 << 16


@dataclass(frozen=True)
class Grammar:
    """A separator to read pieces by, and an automaton over pieces.

    ``step(state, depth, piece)`` is (state, depth, ends) after a piece and its
    separator; ``ends`` tells that a record ends there.  State 0 at depth 0 begins a file.
    """

    sep: str
    states: int
    step: Callable[[int, int, str], tuple[int, int, bool]]


# ---- CSV: pieces are lines; state 1 is inside quotes ----


def _csv_opens(line: str) -> bool:
    """Whether a line that begins a field ends inside a quoted one (a quote inside an unquoted field is text)."""
    at, n = 0, len(line)
    while at < n:
        if line[at] != '"':
            at = line.find(",", at) + 1
            if not at:
                return False
            continue
        while True:  # a quoted field: to its closing quote
            at = line.find('"', at + 1)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 1
                continue
            break
        at = line.find(",", at) + 1
        if not at:
            return False
    return False


def _csv_step(state: int, depth: int, line: str) -> tuple[int, int, bool]:
    if '"' not in line:
        return state, 0, not state
    # a line inside quotes goes on like a field that has just been opened
    opens = _csv_opens('"' + line if state else line)
    return int(opens), 0, not opens


CSV = Grammar("\n", 2, _csv_step)

# ---- JSON list: pieces end in a brace; state 1 is inside a string, 2 after a backslash in it ----

_MARK = re.compile(r'["\[\]{]')
_IN_STRING = re.compile(r'\\|"')


def _json_step(state: int, depth: int, piece: str) -> tuple[int, int, bool]:
    at, n = 0, len(piece)
    if state == 2 and n:
        state, at = 1, 1
    while at < n:
        m = (_IN_STRING if state else _MARK).search(piece, at)
        if m is None:
            break
        at, c = m.end(), m.group()
        if state:
            if c == '"':
                state = 0
            else:
                state, at = (2, at) if at == n else (1, at + 1)
        elif c == '"':
            state = 1
        else:
            depth += -1 if c == "]" else 1
    if state:
        return 1, depth, False  # the brace itself is text
    return 0, depth - 1, depth == 2


JSON_LIST = Grammar("}", 3, _json_step)


# ---- both passes ----


def _pieces(spark: SparkSession, path, grammar: Grammar) -> DataFrame:
    text = spark.read.option("lineSep", grammar.sep).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def _runs(batches) -> Iterator[tuple[str, int, Iterator]]:
    """(first row of a split, iterator of all its rows); a task may read several splits one after the other."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    ahead = [next(rows, None)]

    def own(head):
        while ahead[0] is not None and ahead[0][:2] == head:
            now = ahead[0]
            ahead[0] = next(rows, None)
            yield now

    while ahead[0] is not None:
        first = ahead[0]
        run = own(first[:2])
        yield first, run
        for _ in run:
            pass


def split_states(spark: SparkSession, path, grammar: Grammar) -> DataFrame:
    """(file, at, state, depth, opening, crlf, head, closing): how each split begins.

    ``opening`` is the first character of the file that is no white space, ``crlf`` tells that its first
    piece ends in a carriage return, ``head`` (in a file's first split) is its first record that is not empty, ``closing`` the depth after the file's last piece and a separator.
    """
    import pandas as pd
    import pyarrow as pa

    ship_package(spark)

    def scan(batches):
        for (file, at, _), run in _runs(batches):
            ends, opening, held, head, crlf = [(s, 0) for s in range(grammar.states)], "", [], None, None
            for _, _, value in run:
                if crlf is None:
                    crlf = value.endswith("\r")
                if not at and head is None and (held or value.strip("\r")):
                    held.append(value)
                    if grammar.step(*ends[0], value)[2]:
                        head = grammar.sep.join(held)
                if not opening:
                    opening = value.lstrip()[:1] or ("" if grammar.sep.isspace() else grammar.sep)
                merged: dict = {}
                for e in ends:
                    if e not in merged:
                        merged[e] = grammar.step(*e, value)[:2]
                ends = [merged[e] for e in ends]
            yield pa.RecordBatch.from_pylist([{"file": file, "at": at, "next": [s for s, _ in ends], "more": [d for _, d in ends], "opening": opening, "crlf": crlf,
                                              "head": head if head is not None else grammar.sep.join(held)}],
                                             schema=pa.schema([("file", pa.string()), ("at", pa.int64()), ("next", pa.list_(pa.int32())),
                                                               ("more", pa.list_(pa.int64())), ("opening", pa.string()), ("crlf", pa.bool_()), ("head", pa.string())]))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """One file's splits: a row each."""
        pdf = pdf.sort_values("at").reset_index(drop=True)
        state, depth, states, depths = 0, 0, [], []
        for to, more in zip(pdf["next"], pdf["more"]):
            states.append(state), depths.append(depth)
            state, depth = int(to[state]), depth + int(more[state])
        first = next((c for c in pdf["opening"] if c), "")
        return pd.DataFrame({"file": pdf["file"], "at": pdf["at"], "state": states, "depth": depths, "opening": first, "crlf": bool(pdf["crlf"][0]), "head": pdf["head"], "closing": depth})

    ends = _pieces(spark, path, grammar).mapInArrow(scan, "file string, at long, next array<int>, more array<long>, opening string, crlf boolean, head string")
    return cut_lineage(ends.groupBy("file").applyInPandas(chain, "file string, at long, state int, depth long, opening string, crlf boolean, head string, closing long"))


def split_records(spark: SparkSession, path, grammar: Grammar, states: DataFrame) -> DataFrame:
    """(file, at, pos, text, first, ended, crlf) of every record: its split and place there, its text without the
    separator that ends it, whether it is the file's first one that is not empty, and whether it ended
    (what follows the last separator in a file did not).  The records' place gives the order of the file.
    """
    import pyarrow as pa

    ship_package(spark)
    known = states.select("file", "at", "state", "depth", "crlf")
    if known.count() <= BROADCAST_SPLITS:
        known = F.broadcast(known)
    rows = _pieces(spark, path, grammar).join(known, ["file", "at"]).select("file", "at", "state", "depth", "crlf", "value")
    names = ["file", "at", "pos", "kind", "text", "first", "ended", "crlf"]

    def cut(batches):
        out: list = [[] for _ in names]
        size = 0

        def put(file, at, pos, kind, held, waits, ended, crlf):
            nonlocal size
            text = grammar.sep.join(held)
            first = waits and bool(text.strip("\r"))
            for column, value in zip(out, (file, at, pos, kind, text, first, ended, crlf)):
                column.append(value)
            size += len(text)
            return waits and not first

        def batch():
            nonlocal size
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()))], names)
            for c in out:
                c.clear()
            size = 0
            return made

        for (file, at, state, depth, crlf, _), run in _runs(batches):
            held: list = []
            # kind 0: whole; 1: goes on in the next split; 2: goes on from the one before
            begun, kind, waits = 0, 2 if state or depth > 1 else 0, not at
            for n, row in enumerate(run):
                state, depth, ends = grammar.step(state, depth, row[5])
                held.append(row[5])
                if ends:
                    waits = put(file, at, begun, kind, held, waits, True, crlf)
                    held, kind, begun = [], 0, n + 1
                    if len(out[0]) >= 1000 or size > 1 << 22:
                        yield batch()
            if held:
                put(file, at, begun, kind or 1, held, waits, False, crlf)
        if out[0]:
            yield batch()

    pieces = rows.mapInArrow(cut, "file string, at long, pos long, kind int, text string, first boolean, ended boolean, crlf boolean")
    # at most two pieces a split cross an edge: a piece of kind 1 begins a record, those of kind 2 after it go on with it
    part = pieces.where("kind > 0").withColumn("record", F.sum((F.col("kind") == 1).cast("int")).over(Window.partitionBy("file").orderBy("at", "pos")))
    whole = part.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "pos", "text", "first", "ended", "crlf"))).alias("p")).select(
        "file", F.col("p")[0]["at"].alias("at"), F.col("p")[0]["pos"].alias("pos"), F.array_join(F.col("p.text"), grammar.sep).alias("text"),
        F.col("p")[0]["first"].alias("first"), F.element_at("p", -1)["ended"].alias("ended"), F.col("p")[0]["crlf"].alias("crlf"))
    return pieces.where("kind = 0").drop("kind").unionByName(whole)
