"""The objects of a top-level array of JSON documents, read by byte ranges.

Spark's text source cuts a file into ranges at any delimiter; with ``}``
as the delimiter every task gets a run of pieces of the document, however
long its lines are.  A piece means something different inside and outside
a string, so each range is scanned twice over: how it leaves the string
state, the depth of brackets and the array at hand, for either way it may
begin.  The summaries (a few numbers a range) are chained in order, and a
second scan, now knowing where each range stands, cuts out the objects.
An object that goes on in the next ranges is put together by the range
where it starts; only such objects (at most one a range) are shuffled.

Works on ``{..., "name": [{...}, {...}], ...}``; keys before and after the
array, nested arrays and objects, and brackets in strings are all allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.session import materialize, ship

_MARK = re.compile(r'"|[{}\[\]]')
_STRING = re.compile(r'(?:[^"\\]|\\.)*', re.S)


class _Scan:
    """Walks the pieces of a document from a known state: whether a string
    is open, how many brackets are, and whether the outermost object's
    value at hand is the array ``name``."""

    def __init__(self, name: str, string: bool = False, depth: int = 0, key: bool = False):
        self.name, self.string, self.depth, self.key = name, string, depth, key

    def named(self, is_name: bool) -> None:
        """A string, or an opened object, at the current depth."""
        if self.depth == 1:
            self.key = is_name

    def feed(self, piece: str) -> list[tuple[int, str]]:
        """(offset, "start" or "end") of the array's objects in ``piece``."""
        out, at, n = [], 0, len(piece)
        while at < n:
            if self.string:
                end = _STRING.match(piece, at).end()
                if end >= n or piece[end] != '"':
                    break  # goes on in the next piece
                self.string, at = False, end + 1
                continue
            m = _MARK.search(piece, at)
            if not m:
                break
            c, at = m.group(), m.end()
            if c == '"':
                end = at + len(self.name)
                self.named(piece.startswith(self.name, at) and piece[end:end + 1] == '"')
                self.string = True
            elif c in "{[":
                if c == "{":
                    self.named(False)  # not an array
                    if self.depth == 2 and self.key:
                        out.append((at - 1, "start"))
                self.depth += 1
            else:
                self.depth -= 1
                if c == "}" and self.depth == 2 and self.key:
                    out.append((at, "end"))
        return out


class _Outline(_Scan):
    """A scan from depth 0 of a range whose own depth is unknown: keeps,
    for every depth that may be the outermost object's, what came last."""

    def __init__(self, name: str, string: bool):
        super().__init__(name, string)
        self.last: dict[int, bool] = {}

    def named(self, is_name: bool) -> None:
        if self.depth <= 1:
            self.last[self.depth] = is_name


def _chained(rows) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """(string, depth, key) at the start of every range."""
    by = {(r.file, r.at, r.start): r for r in rows}
    out, state, before = {}, (False, 0, False), None
    for file, at in sorted({k[:2] for k in by}):
        if file != before:
            state, before = (False, 0, False), file
        out[file, at] = state
        string, depth, key = state
        r = by[file, at, int(string)]
        state = (r.string, depth + r.delta, r.last.get(1 - depth, key))
    return out


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.option("lineSep", "}").text(path)
    return d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def _runs(batches) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file", "at", "value"))))
    for key, group in groupby(rows, key=lambda r: r[:2]):
        yield key, (r[2] for r in group)


def elements(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(value): the text of every object of the array ``name``."""
    ship(spark)
    pieces = _pieces(spark, path)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("start", pa.int32()), ("string", pa.bool_()), ("delta", pa.int64()),
                            ("last", pa.map_(pa.int64(), pa.bool_()))])
        for (file, at), run in _runs(batches):
            scans = [_Outline(name, False), _Outline(name, True)]
            for piece in run:
                for s in scans:
                    s.feed(piece + "}")
            yield pa.RecordBatch.from_pylist([{"file": file, "at": at, "start": k, "string": s.string, "delta": s.depth, "last": list(s.last.items())}
                                              for k, s in enumerate(scans)], schema=schema)

    outline = pieces.mapInArrow(summed, "file string, at long, start int, string boolean, delta long, last map<long,boolean>")
    states = _chained(outline.collect())  # two rows a range
    given = spark.sparkContext.broadcast(states)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("at", pa.int64()), ("value", pa.string()), ("whole", pa.bool_())])
        for (file, at), run in _runs(batches):
            string, depth, key = given.value[file, at]
            scan, out = _Scan(name, string, depth, key), []
            open_: list[str] | None = [] if key and (depth > 2) else None
            started = False
            for piece in run:
                piece += "}"
                done = 0
                for offset, kind in scan.feed(piece):
                    if kind == "start":
                        open_, started, done = [], True, offset
                    elif open_ is not None:
                        open_.append(piece[done:offset])
                        out.append((file, at if started else -1, at, "".join(open_), started))
                        open_, done = None, offset
                if open_ is not None:
                    open_.append(piece[done:])
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if open_ is not None:
                out.append((file, at if started else -1, at, "".join(open_), False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    got = materialize(pieces.mapInArrow(cut, "file string, owner long, at long, value string, whole boolean"), "json-parts")
    whole = got.where("whole").select("value")
    # a part without a start belongs to the last range in which an object was left open
    part = got.where("NOT whole")
    from pyspark.sql import Window
    last = F.last(F.when(F.col("owner") >= 0, F.col("owner")), True).over(Window.partitionBy("file").orderBy("at", "owner").rowsBetween(Window.unboundedPreceding, 0))
    part = part.select("file", "at", "owner", "value", last.alias("first"))
    # in the range where one object ends and another is left open, the ending part comes first
    joined = part.groupBy("file", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "").alias("value"))
    return whole.unionByName(joined.select("value"))
