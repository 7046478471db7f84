"""A Spark data source for large JSON documents: the elements of one array, read by many tasks.

A document is cut into segments of bytes.  A first pass over them, one task per segment, notes how each one changes the
state of a reader: whether it ends inside a string, how many open containers it closes and which ones it leaves open.
Folding these notes gives the state at the start of every segment, so a segment can be read by itself: a task gives the
elements that begin in its segment and reads on to the end of the last one.

``pointer`` names the array: ``$[*]``, ``$.data.children[*]``, ``$.*.businesses[*]``; keys that ``*`` stands for come as
``captures``.  Elements are objects, kept as text.  A document that ends early or closes too much gives the elements that
are whole.  Files are read with Arrow's file systems, so any that it knows by URI will do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package

SEGMENT_BYTES = 8 << 20
LOOK_BACK = 4096
SCHEMA = "file string, file_number int, position bigint, captures array<string>, element string"
POSITION_BITS, FILE_BITS = 36, 18  # of a sequence number; the rest is for the feed

_BRACKET = np.isin(np.arange(256), np.frombuffer(b"{}[]", dtype=np.uint8))

Container = tuple[str, str | None]  # "{" or "[", and the key it stands under


class _LookFurtherBack(Exception):
    """A key begins before the bytes at hand."""


# --- bytes ------------------------------------------------------------------------


def _file(uri: str) -> pa.NativeFile:
    if uri.startswith("file:"):
        uri = uri.removeprefix("file:").removeprefix("//")
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class Piece:
    """Bytes of a file with the marks of its strings and containers; the first ``pad`` bytes are only looked at for keys."""

    def __init__(self, file: pa.NativeFile, start: int, end: int, look_back: int):
        low = max(0, start - look_back)
        data = file.read_at(end - low, low)
        while low and data[:1] == b"\\":  # never begin within a run of backslashes
            step = min(low, 64)
            low -= step
            data = file.read_at(step, low) + data
        self.data, self.start, self.pad = data, start, start - low
        raw = np.frombuffer(data, dtype=np.uint8)
        quotes = np.flatnonzero(raw == 34)
        slashes = np.flatnonzero(raw == 92)
        count = np.arange(len(slashes))
        run = count - np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) != 1, count, 0)) + 1 if len(slashes) else slashes
        last = np.searchsorted(slashes, quotes) - 1  # backslash before each quote
        escaped = np.zeros(len(quotes), dtype=bool)
        near = np.flatnonzero(last >= 0)
        near = near[slashes[last[near]] == quotes[near] - 1]
        escaped[near] = run[last[near]] % 2 == 1
        self.quotes = quotes[~escaped]
        self.inner = self.quotes[self.quotes >= self.pad]
        marks = np.flatnonzero(_BRACKET[raw[self.pad:]]) + self.pad
        self.marks, self.before = marks, np.searchsorted(self.inner, marks)

    def events(self, in_string: bool) -> Iterator[tuple[int, str]]:
        """Brackets outside of strings: (place in ``data``, bracket)."""
        outside = (self.before + in_string) % 2 == 0
        for at in self.marks[outside].tolist():
            yield at, chr(self.data[at])

    def key(self, at: int) -> str | None:
        """The key in front of a container, None for one in an array or the outermost."""
        place = at - 1
        while place >= 0 and self.data[place] in b" \t\r\n":
            place -= 1
        if place >= 0 and self.data[place] != ord(":"):
            return None
        i = int(np.searchsorted(self.quotes, max(place, 0)))
        if place < 0 or i < 2:
            if self.start == self.pad:  # the file has no more
                return None
            raise _LookFurtherBack
        text = self.data[self.quotes[i - 2]:self.quotes[i - 1] + 1].decode("utf-8", "replace")
        try:
            return json.loads(text, strict=False)
        except ValueError:  # no JSON, or the state in question is the wrong one
            return text[1:-1]


    def outer_keys(self, in_string: bool, depth: int) -> list[str]:
        """Keys of the outermost object whose colon lies here; ``depth`` containers are open at the start."""
        raw = np.frombuffer(self.data, dtype=np.uint8)
        colons = np.flatnonzero(raw[self.pad:] == 58) + self.pad
        colons = colons[(np.searchsorted(self.inner, colons) + in_string) % 2 == 0]
        marks = self.marks[(self.before + in_string) % 2 == 0]
        opens = np.isin(raw[marks], np.frombuffer(b"{[", dtype=np.uint8))
        depths = depth + np.concatenate([[0], np.cumsum(np.where(opens, 1, -1))])
        return [self.key(at + 1) for at in colons[depths[np.searchsorted(marks, colons)] == 1].tolist()]


def _with_keys(file: pa.NativeFile, start: int, end: int, use):
    """``use(piece)``, again with more bytes in front as long as a key lies further back."""
    look_back = LOOK_BACK
    while True:
        try:
            return use(Piece(file, start, end, look_back))
        except _LookFurtherBack:
            if look_back > start:
                return use(Piece(file, start, end, start))
            look_back *= 4


# --- the index pass ---------------------------------------------------------------


def _summary(piece: Piece, in_string: bool) -> tuple[int, list[Container]]:
    """(open containers that the segment closes, those it leaves open)."""
    closed, left = 0, []
    for at, mark in piece.events(in_string):
        if mark in "{[":
            left.append((mark, at))
        elif left:
            left.pop()
        else:
            closed += 1
    return closed, [(mark, piece.key(at)) for mark, at in left]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            with _file(row["file"]) as file:
                notes = _with_keys(file, row["start"], row["end"], lambda p: [len(p.inner) % 2, _summary(p, False), _summary(p, True)])
            found.append(json.dumps(notes))
        yield pa.RecordBatch.from_arrays([batch.column("file_number"), batch.column("start"), pa.array(found, pa.string())], ["file_number", "start", "notes"])


@dataclass
class Segment(InputPartition):
    file: str
    file_number: int
    start: int
    end: int
    in_string: bool
    stack: list[Container]


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files (URI, bytes) of a path, folder or pattern, by name; hidden ones and Spark's markers are left out."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(system.globStatus(pattern) or [])
    inside = [list(system.listStatus(s.getPath())) if s.isDirectory() else [s] for s in found]
    files = [(s.getPath().toString(), s.getLen()) for group in inside for s in group if s.isFile()]
    return sorted(f for f in files if not f[0].rsplit("/", 1)[1].startswith(("_", ".")))


def structural_index(spark: SparkSession, path: str, segment_bytes: int = SEGMENT_BYTES) -> list[Segment]:
    """Segments with the reader's state at their starts; one small entry per ``segment_bytes`` of input."""
    files = _files(spark, path)
    cuts = [(name, n, lo, min(lo + segment_bytes, size)) for n, (name, size) in enumerate(files) for lo in range(0, size, segment_bytes)]
    if not cuts:
        return []
    ship_package(spark)
    rows = spark.createDataFrame(cuts, "file string, file_number int, start bigint, end bigint").repartition(len(cuts), "file_number", "start")
    notes = {(r.file_number, r.start): json.loads(r.notes) for r in rows.mapInArrow(_index, "file_number int, start bigint, notes string").collect()}
    out: list[Segment] = []
    in_string, stack = False, []
    for name, number, lo, hi in cuts:
        if lo == 0:
            in_string, stack = False, []
        out.append(Segment(name, number, lo, hi, in_string, list(stack)))
        odd, *by_state = notes[number, lo]
        closed, left = by_state[in_string]
        stack = stack[:max(0, len(stack) - closed)] + [tuple(c) for c in left]
        in_string ^= bool(odd)
    return out


# --- reading ----------------------------------------------------------------------


def parse_pointer(pointer: str) -> list[Container]:
    """The containers around an element, outermost first."""
    tokens = re.findall(r"\.([^.\[\]]+)|(\[\*\])", pointer.removeprefix("$"))
    if "$" + "".join(f".{n}" if n else "[*]" for n, _ in tokens) != pointer or not tokens or not tokens[-1][1]:
        raise ValueError(f"not a pointer to the elements of an array: {pointer}")
    names = [None, *(n or None for n, _ in tokens)]
    return [("[" if many else "{", names[i]) for i, (_, many) in enumerate(tokens)]


def _captures(stack: list[Container], wanted: list[Container]) -> list[str] | None:
    """Keys that ``*`` stands for, if the stack is the one wanted."""
    if len(stack) != len(wanted):
        return None
    for (kind, key), (kind_wanted, name) in zip(stack, wanted):
        if kind != kind_wanted or name not in ("*", key):
            return None
    return [key for (_, key), (_, name) in zip(stack, wanted) if name == "*"]


def _rest_of(file: pa.NativeFile, start: int, size: int, step: int) -> bytes | None:
    """The element that begins at ``start``; None if the file ends within it."""
    while True:
        piece = Piece(file, start, min(start + step, size), 0)
        depth = 0
        for at, mark in piece.events(False):
            depth += 1 if mark in "{[" else -1
            if not depth:
                return piece.data[piece.pad:at + 1]
        if start + step >= size:
            return None
        step *= 2


def read_segment(segment: Segment, wanted: list[Container]) -> Iterator[tuple[int, list[str], bytes]]:
    """(position, captures, text) of the elements that begin in a segment."""
    with _file(segment.file) as file:

        def use(piece: Piece) -> tuple[list, tuple | None]:
            stack = [tuple(c) for c in segment.stack]
            whole, begun = [], None
            for at, mark in piece.events(segment.in_string):
                if mark in "{[":
                    if begun is None and mark == "{" and (keys := _captures(stack, wanted)) is not None:
                        begun = (at, keys)
                    stack.append((mark, piece.key(at) if begun is None and len(stack) < len(wanted) else None))
                elif stack:
                    stack.pop()
                    if begun is not None and len(stack) == len(wanted):
                        whole.append((piece.start - piece.pad + begun[0], begun[1], piece.data[begun[0]:at + 1]))
                        begun = None
            return whole, begun and (piece.start - piece.pad + begun[0], begun[1])

        whole, begun = _with_keys(file, segment.start, segment.end, use)
        yield from whole
        if begun is not None:
            text = _rest_of(file, begun[0], file.size(), segment.end - segment.start)
            if text is not None:
                yield begun[0], begun[1], text


class _Reader(DataSourceReader):
    def __init__(self, segments: list[Segment], wanted: list[Container]):
        self.segments, self.wanted = segments, wanted

    def partitions(self) -> list[InputPartition]:
        return self.segments

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in read_segment(partition, self.wanted):
            held.append(found)
            size += len(found[2])
            if size > 4 << 20:
                yield self._batch(partition, held)
                held, size = [], 0
        if held:
            yield self._batch(partition, held)

    def _batch(self, segment: Segment, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([segment.file] * len(rows)), pa.array([segment.file_number] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2].decode("utf-8", "replace") for r in rows], pa.string()),
        ], ["file", "file_number", "position", "captures", "element"])


class JsonElements(DataSource):
    """``json_elements``: options ``pointer`` and ``segments`` (from ``structural_index``)."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        segments = [Segment(**s) for s in json.loads(self.options["segments"])]
        return _Reader(segments, parse_pointer(self.options["pointer"]))


def elements(spark: SparkSession, path: str, pointer: str, *, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Elements of an array in the JSON documents at ``path``: file, file_number, position, captures, element.

    A path without files gives no rows.
    """
    parse_pointer(pointer)  # a wrong one fails here
    segments = structural_index(spark, path, segment_bytes)
    if not segments:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(JsonElements)
    listed = json.dumps([s.__dict__ for s in segments])
    return spark.read.format("json_elements").option("pointer", pointer).option("segments", listed).load()


def _outer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            with _file(row["file"]) as file:
                found += _with_keys(file, row["start"], row["end"], lambda p: p.outer_keys(row["in_string"], row["depth"]))  # noqa: B023
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["key"])


def object_keys(spark: SparkSession, path: str, *, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Keys of the outermost objects of the JSON documents at ``path``, each as often as it comes.

    Other documents have none, and a path without files gives no rows.
    """
    segments = structural_index(spark, path, segment_bytes)
    if not segments:
        return spark.createDataFrame([], "key string")
    listed = [(s.file, s.start, s.end, s.in_string, len(s.stack)) for s in segments]
    rows = spark.createDataFrame(listed, "file string, start bigint, end bigint, in_string boolean, depth int")
    return rows.repartition(len(listed), "file", "start").mapInArrow(_outer_keys, "key string")


def sequence_number(place_inside: Column | None = None) -> Column:
    """Order of arrival by (file, position); items of one element count on from its position."""
    at = F.col("position") if place_inside is None else F.col("position") + place_inside
    return F.shiftleft(F.col("file_number").cast("long"), POSITION_BITS) + at
